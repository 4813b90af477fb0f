"""Alignment of two tokenizers' tokens by the bytes they own.

A text's bytes, a space and the text, are cut by tokenizer A (byte-level BPE) and by tokenizer B (sentence pieces). Two
arrays hold for each byte the token of A and of B that owns it (np.repeat of token numbers by token sizes). Where the
pair of owners changes an overlap begins; where both change at once there is a cut, and what lies between two cuts is a
group. Spaces begin tokens in both, so groups never cross words and each distinct word of a batch is aligned once.

Counts of linked id pairs (documents that hold a pair) are summed per task and then by Spark. The HOT most frequent
pairs, a set of fixed size, go to all tasks; links of the other pairs meet their counts in a join, in which none is
frequent.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, buffers, mapped, session
from quire.llm.wordwise import ByteLevel, Pieces, distinct, encoded, spread

#: Pairs that are sent to all tasks, at most; 24 bytes each.
HOT = 1 << 20
#: Bytes of texts aligned together, and words whose groups are hashed at once; both bound memory.
TOGETHER, HASHED = 1 << 22, 1 << 18
#: Groups with more links than this are linked by their distinct ids.
WIDE = 1 << 10


def owners(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two tokenisations of the same bytes, by the sizes of their tokens: the overlapping pairs of tokens (numbers in A,
    numbers in B), and the number of the group of each token of A and of B."""
    a = np.repeat(np.arange(len(size_a), dtype=np.int32), size_a)
    b = np.repeat(np.arange(len(size_b), dtype=np.int32), size_b)
    if not len(a):
        return (np.zeros(0, np.int32),) * 4
    new_a, new_b = a[1:] != a[:-1], b[1:] != b[:-1]
    first = np.concatenate(([True], new_a | new_b))
    group = np.zeros(len(a), np.int32)
    np.cumsum(new_a & new_b, out=group[1:])
    return a[first], b[first], group[np.cumsum(size_a) - 1], group[np.cumsum(size_b) - 1]


def _links(ids_a, ids_b, group_a, group_b, n: int):
    """The id pairs linked in each of n groups: (group, A id, B id, how often)."""
    ka, kb = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    at_a, at_b = np.cumsum(ka) - ka, np.cumsum(kb) - kb
    near = ka * kb <= WIDE
    of = group_a[near[group_a]]
    times = kb[of]
    g = np.repeat(of, times)
    left = np.repeat(ids_a[near[group_a]], times)
    inner = np.arange(len(g)) - np.repeat(np.cumsum(times) - times, times)
    right = ids_b[at_b[g] + inner]
    out = [(g, left, right, np.ones(len(g), np.int64))]
    for w in np.flatnonzero(~near):
        x, nx = np.unique(ids_a[at_a[w] : at_a[w] + ka[w]], return_counts=True)
        y, ny = np.unique(ids_b[at_b[w] : at_b[w] + kb[w]], return_counts=True)
        out.append((np.full(len(x) * len(y), w), np.repeat(x, len(y)), np.tile(y, len(x)), np.repeat(nx, len(y)) * np.tile(ny, len(x))))
    if len(out) == 1:
        return out[0]
    g, left, right, times = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(g, kind="stable")
    return g[order], left[order], right[order], times[order]


def _joined(strings: pa.Array, off: np.ndarray, by: str) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(off, pa.int64()), strings), by)


class Words:
    """Distinct words, aligned: `fine` whether both tokenisations give the word's bytes; of fine words, the numbers of
    tokens, groups and links, the linked pairs (codes A << 32 | B, with `times`) and, if asked for, the groups in writing."""

    def __init__(self, known: pa.Array, a: ByteLevel, b: Pieces, names=None):
        off, data = buffers(known)
        n = len(known)
        ids_a, at_a = encoded(known, a)
        ids_b, at_b = encoded(known, b)
        size = np.diff(off)
        whole = lambda m, ids, at: np.add.reduceat(np.append(m.size[ids], 0), np.minimum(at[:-1], len(ids))) * (np.diff(at) > 0) == size if n else np.zeros(0, bool)
        fine = whole(a, ids_a, at_a) & whole(b, ids_b, at_b)
        keep = np.flatnonzero(fine)
        ids_a, at_a = spread(ids_a, at_a, keep)
        ids_b, at_b = spread(ids_b, at_b, keep)
        # sizes agree; now the bytes
        raw_a, raw_b = b"".join(map(a.bytes_of.__getitem__, ids_a.tolist())), b"".join(map(b.bytes_of.__getitem__, ids_b.tolist()))
        where, end = spread(np.arange(int(off[0]), int(off[-1])), off - off[0], keep)
        true = data[where]
        if raw_a != true.tobytes() or raw_b != true.tobytes():
            wrong = (np.frombuffer(raw_a, np.uint8) != true) | (np.frombuffer(raw_b, np.uint8) != true)
            bad = np.unique(np.searchsorted(end, np.flatnonzero(wrong), "right") - 1)
            fine[keep[bad]] = False
            good = np.setdiff1d(np.arange(len(keep)), bad)
            keep = keep[good]
            ids_a, at_a = spread(ids_a, at_a, good)
            ids_b, at_b = spread(ids_b, at_b, good)
        self.fine = fine
        self.overlap_a, self.overlap_b, group_a, group_b = owners(a.size[ids_a], b.size[ids_b])
        groups = int(group_a[-1]) + 1 if len(group_a) else 0
        # a word's groups lie together, from the group of its first token on
        first = np.append(group_a, groups)[at_a]

        def placed(values):
            out = np.zeros(n, np.int64)
            out[keep] = values
            return out

        self.n_a, self.n_b, self.n_groups = placed(np.diff(at_a)), placed(np.diff(at_b)), placed(np.diff(first))
        g, left, right, times = _links(ids_a, ids_b, group_a, group_b, groups)
        self.codes, self.times = left.astype(np.int64) << 32 | right, times
        begin = np.searchsorted(g, first)
        self.first = np.concatenate(([0], np.cumsum(placed(np.diff(begin)))))
        total = np.concatenate(([0], np.cumsum(times)))
        self.n_links = placed(total[begin[1:]] - total[begin[:-1]])
        if names is not None:
            text = []
            for ids, group, own in ((ids_a, group_a, names[0]), (ids_b, group_b, names[1])):
                text.append(_joined(own.take(pa.array(ids)), np.append(np.searchsorted(group, np.arange(groups)), len(ids)), ","))
            each = pc.binary_join_element_wise(*text, pa.scalar("|", pa.string()))
            strings = _joined(each, first, ";")
            back = np.full(n, -1)
            back[keep] = np.arange(len(keep))
            self.text = strings.take(pa.array(back, mask=back < 0))


def _slices(b):
    """Slices of a batch with about TOGETHER bytes of text."""
    off, _ = buffers(b.column("text"))
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + TOGETHER, "right")) - 1)
        yield b.slice(at, to - at)
        at = to


def _occurrences(index: np.ndarray, before: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, how often) of the words of these documents."""
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    key, times = np.unique(doc * known + index, return_counts=True)
    return key // max(known, 1), key % max(known, 1), times


def _whole(words: Words, index: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether all words of each document are fine, and there is one."""
    bad = np.concatenate(([0], np.cumsum(~words.fine[index])))
    return (bad[before[1:]] == bad[before[:-1]]) & (np.diff(before) > 0)


def _spaced(docs: DataFrame, *more) -> DataFrame:
    """The texts with a space before them; empty and null ones stay empty."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*more, F.when(t == "", F.lit("")).otherwise(F.concat(F.lit(" "), t)).alias("text"))


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a, b, n): in how many documents each pair of ids is linked."""

    def scan(batches):
        a, b = ByteLevel(a_path, True), Pieces(b_path)
        held, size = [], 0

        def done():
            codes, n = (np.concatenate(x) for x in zip(*held))
            u, at = np.unique(codes, return_inverse=True)
            sums = np.bincount(at, weights=n, minlength=len(u)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array((u >> 32).astype(np.int32)), pa.array((u & 0xFFFFFFFF).astype(np.int32)), pa.array(sums)], ["a", "b", "n"])

        for batch in batches:
            for part in _slices(batch):
                known, index, before = distinct(*buffers(part.column("text")))
                w = Words(known, a, b)
                ok = _whole(w, index, before)
                doc, word, _ = _occurrences(index, before, len(known))
                doc, word = doc[ok[doc]], word[ok[doc]]
                codes, dense = np.unique(w.codes, return_inverse=True)
                got, at = spread(dense, w.first, word)
                pairs = np.unique(np.repeat(doc, np.diff(at)) * max(len(codes), 1) + got)
                n = np.bincount(pairs % max(len(codes), 1), minlength=len(codes))
                held.append((codes[n > 0], n[n > 0]))
                size += len(held[-1][0])
                if size >= HOT:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    return mapped(_spaced(docs), scan, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _hot(counts: DataFrame, hot: int):
    """Codes, counts and whether they are their A id's highest, of the most frequent pairs, at most `hot` of them: all those
    from a least count on, which is a power of the fourth root of 2."""
    step = F.floor(F.log2("n") * 4)
    left, least = hot, None
    for row in counts.groupBy(step.alias("s")).agg(F.count("*").alias("k")).orderBy(F.desc("s")).collect():  # 4 rows a power of 2
        left -= row.k
        if left < 0:
            break
        least = row.s
    some = counts.where(step >= F.lit(least)) if least is not None else counts.limit(0)
    t = some.select(F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("c"), "n", "top").toArrow()
    c, n, top = (t.column(x).to_numpy() for x in ("c", "n", "top"))
    order = np.argsort(c)
    return c[order], n[order], top[order].astype(np.int64)


def align(docs: DataFrame, a_path: str, b_path: str, hot: int = HOT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    Tokenizer A: path of a byte-level BPE file of the tokenizers library; B: path of a sentence-piece model. Texts that are
    null or empty, or that a tokenizer does not give back byte for byte, have zeros and ''. n_best counts links whose pair is
    in as many documents as any pair of its A id, count_sum adds those numbers over links. Rows with a null doc_id, and rows
    that repeat one, are documents of their own. Further columns are ignored. An empty table gives an empty result."""
    spark = docs.sparkSession
    session(spark)
    scratch = Scratch(spark)
    summed = scratch.keep(pair_counts(docs, a_path, b_path), "summed")
    best = summed.groupBy("a").agg(F.max("n").alias("most"))
    counts = scratch.keep(summed.join(best, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("top")), "counts")
    scratch.drop("summed")
    sent = spark.sparkContext.broadcast(_hot(counts, hot))

    def scan(batches):
        a, b = ByteLevel(a_path, True), Pieces(b_path)
        names = [pa.array([str(i) for i in range(len(m.size))], pa.string()) for m in (a, b)]
        codes, ns, tops = sent.value
        for batch in batches:
            for part in _slices(batch):
                known, index, before = distinct(*buffers(part.column("text")))
                w = Words(known, a, b, names)
                ok = _whole(w, index, before)
                at = np.minimum(np.searchsorted(codes, w.codes), max(len(codes) - 1, 0))
                found = codes[at] == w.codes if len(codes) else np.zeros(len(w.codes), bool)

                def by_word(values):
                    total = np.concatenate(([0], np.cumsum(values)))
                    return total[w.first[1:]] - total[w.first[:-1]]

                def by_doc(values):
                    total = np.concatenate(([0], np.cumsum(values[index])))
                    return pa.array(np.where(ok, total[before[1:]] - total[before[:-1]], 0))

                n = np.where(found, ns[at], 0) if len(codes) else np.zeros(len(w.codes), np.int64)
                top = np.where(found, tops[at], 0) if len(codes) else n
                sums = [by_doc(x) for x in (w.n_a, w.n_b, w.n_groups, w.n_links, by_word(top * w.times), by_word(n * w.times))]
                # links that are not among the hot ones
                rare = np.flatnonzero(~found)
                first = np.searchsorted(rare, w.first)
                doc, word, times = _occurrences(index, before, len(known))
                keep = ok[doc] & (np.diff(first) > 0)[word] if len(word) else np.zeros(0, bool)
                doc, word, times = doc[keep], word[keep], times[keep]
                link, off = spread(rare, first, word)
                of = np.repeat(doc, np.diff(off))
                weight = w.times[link] * np.repeat(times, np.diff(off))
                order = np.lexsort((w.codes[link], of))
                of, code, weight = of[order], w.codes[link][order], weight[order]
                new = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (code[1:] != code[:-1])))) if len(of) else np.zeros(0, int)
                weight = np.add.reduceat(weight, new) if len(new) else weight
                lists = pa.array(np.searchsorted(of[new], np.arange(part.num_rows + 1)).astype(np.int32))
                cold = [pa.ListArray.from_arrays(lists, pa.array(x)) for x in (code[new], weight)]
                # the groups in writing, hashed
                digests = []
                spans = [(d, lo, min(lo + HASHED, before[d + 1])) for d in np.flatnonzero(ok) for lo in range(before[d], before[d + 1], HASHED)]
                lo = 0
                while lo < len(spans):
                    hi = max(lo + 1, int(np.searchsorted([s[2] for s in spans], spans[lo][1] + HASHED, "right")))
                    own = spans[lo:hi]
                    some = w.text.take(pa.array(index[own[0][1] : own[-1][2]]))
                    take = np.concatenate([np.arange(s[1], s[2]) for s in own]) - own[0][1]
                    off = np.concatenate(([0], np.cumsum([s[2] - s[1] for s in own])))
                    for (d, start, _), x in zip(own, _joined(some.take(pa.array(take)), off, ";").to_pylist()):
                        if start == before[d]:
                            digests.append((d, hashlib.sha256()))
                        else:
                            digests[-1][1].update(b";")
                        digests[-1][1].update(x.encode())
                    lo = hi
                sha = [""] * part.num_rows
                for d, h in digests:
                    sha[d] = h.hexdigest()
                columns = [part.column("row"), part.column("doc_id"), *sums, pa.array(sha, pa.string()), *cold]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "cold", "weight"])

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, cold array<long>, weight array<long>"
    rows = _spaced(docs, F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    done = scratch.keep(mapped(rows, scan, schema), "aligned")
    cold = done.where(F.size("cold") > 0).select("row", F.explode(F.arrays_zip("cold", "weight")).alias("x"))
    cold = cold.select("row", F.shiftright("x.cold", 32).cast("int").alias("a"), F.col("x.cold").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "x.weight")
    more = cold.join(counts, ["a", "b"]).groupBy("row").agg(F.sum(F.col("weight") * F.col("n")).alias("more"), F.sum(F.when(F.col("top"), F.col("weight")).otherwise(F.lit(0))).alias("best"))
    out = done.drop("cold", "weight").join(more, "row", "left")
    add = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", add("n_best", "best"), add("count_sum", "more"), "groups_sha256")
