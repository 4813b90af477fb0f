"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A text is lower-cased and split into words of ASCII letters and digits and of non-ASCII characters. At each
anchor (a common word) the next CHAIN words that are no anchors make a signature with it. The fingerprint is the
set of signatures, as sorted hashes. Likeness is Jaccard's. classes() connects all texts of similar fingerprints:
equal sets are one; sets that share a signature none of them can miss, rarest first, form candidate groups; a group is
partitioned by set length, partitions of incompatible lengths never meet, and linked() compares the others by inverted
lists, giving a pair up as soon as its lengths, or what is left of it, rule it out.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SpanHash, in_order, mapped, mix, texts
from quire.llm.ngram_join import components_of

#: Fixed list: common words of English, German, French and Spanish.
ANCHORS = (
    "the of to and a in is it that was for on are with as be by this an or at from "
    "der die das und den von zu mit ist im nicht ein eine auf als auch es an "
    "le la les de des et un une est que dans pour du qui sur pas par au "
    "el los las y en por con para una del se al lo como"
).split()
CHAIN = 2

_U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _hash_words(words: list[str]) -> np.ndarray:
    return np.sort(np.concatenate([SpanHash(np.frombuffer(w.encode(), np.uint8)).of(np.array([0]), np.array([len(w.encode())])) for w in set(words)]))


def signatures(batch: list[str]) -> list[np.ndarray]:
    """Of each text the sorted distinct 32-bit hashes of its signatures. A text without a full chain after an
    anchor has one signature, of the whole text; the empty text has none."""
    low = [t.lower().encode() for t in batch]
    size = np.array([len(x) + 1 for x in low], np.int64)
    off = np.concatenate(([0], np.cumsum(size)))
    data = np.frombuffer(b" ".join(low) + b" ", np.uint8)
    solid = _WORD[data]
    edge = np.diff(np.concatenate(([False], solid, [False])).astype(np.int8))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    w = SpanHash(data).of(s, e)
    row = np.searchsorted(off, s, "right") - 1
    at = np.minimum(np.searchsorted(_ANCHOR, w), len(_ANCHOR) - 1)
    is_anchor = _ANCHOR[at] == w
    anchor, content = np.flatnonzero(is_anchor), np.flatnonzero(~is_anchor)
    k = np.searchsorted(content, anchor)
    ok = k + CHAIN <= len(content)
    anchor, k = anchor[ok], k[ok]
    ok = row[content[k + CHAIN - 1]] == row[anchor] if len(k) else np.zeros(0, bool)
    anchor, k = anchor[ok], k[ok]
    h = w[anchor]
    for j in range(CHAIN):
        h = h * _U(0x9E3779B97F4A7C15) + w[content[k + j]]
    h = (mix(h) >> _U(32)).astype(np.uint32)
    cut = np.searchsorted(row[anchor], np.arange(len(batch) + 1))
    out = []
    for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
        if b > a:
            out.append(np.unique(h[a:b]))
        elif low[i]:
            out.append(np.frombuffer(hashlib.sha256(batch[i].encode()).digest()[:4], "<u4").astype(np.uint32))
        else:
            out.append(np.zeros(0, np.uint32))
    return out


_ANCHOR = _hash_words(ANCHORS)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def encode(x: np.ndarray) -> str:
    return x.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint (hex, 8 digits a signature, ascending) of each text; null texts are
    empty."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                t = part.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in t], pa.int64()), pa.array([encode(x) for x in signatures(t)])], ["doc_id", "n_chars", "fingerprint"])

    kind = dict(docs.dtypes)["doc_id"]
    return mapped(texts(docs), run, f"doc_id {kind}, n_chars long, fingerprint string")


def _members(off: np.ndarray, data: np.ndarray):
    """Signature sets of texts as sorted 64-bit hashes, for components_of()."""
    raw = data[off[0] : off[-1]].tobytes()
    rel = (off - off[0]).tolist()
    for x in signatures([raw[a:b].decode() for a, b in zip(rel, rel[1:])]):
        yield np.sort(mix(x.astype(_U) + _U(1)))


def linked(sets: list[np.ndarray], num: int, den: int, left: int = 0) -> list[tuple[int, int]]:
    """Links (i, j) of positions that connect all sets of a Jaccard similarity of num / den or more; with left, those of
    one of the first `left` sets with one of the others.

    In order of length each set is looked up in inverted lists of the signatures that those before it can't all miss,
    rarest first. A list keeps its sets by component, so that members of one component are not compared with each
    other; it is read from the longest set down and left at the first one too short."""
    if len(sets) < 2:
        return []
    members, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(members), np.int64)
    rank[np.lexsort((members, count))] = np.arange(len(members))
    sizes = [len(s) for s in sets]
    ends = np.cumsum(sizes)
    ranked = [np.sort(rank[inverse[e - n : e]]) for e, n in zip(ends, sizes)]
    up, links = list(range(len(sets))), []
    both = ({}, {}) if left else ({},) * 2  # lists to look up in, and to enter, by side

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in sorted(range(len(sets)), key=lambda i: (sizes[i], i)):
        n, own = sizes[i], ranked[i]
        if not n:
            continue
        prefix = own[: n - -(-n * num // den) + 1].tolist()
        lists, entered = both[i < left], both[i >= left]
        seen = set()
        for at, r in enumerate(prefix):
            held = lists.get(r)
            for k in list(held or ()):
                now = root(k)
                if now != k:
                    held[now] = sorted(held.get(now, []) + held.pop(k), key=lambda j: j[0])
            for k in list(held or ()):
                if root(k) == root(i):
                    continue
                for m, j, place in reversed(held[k]):
                    if m * den < n * num:
                        break  # the partition of shorter sets
                    if j in seen:
                        continue
                    seen.add(j)
                    need = -(-num * (n + m) // (num + den))
                    if 1 + min(n - at - 1, m - place - 1) < need:
                        continue  # at the first shared signature: what is left can't reach it
                    if len(np.intersect1d(own, ranked[j], assume_unique=True)) >= need:
                        links.append((i, j))
                        up[root(j)] = root(i)
                        break
        for place, r in enumerate(prefix):
            entered.setdefault(r, {}).setdefault(root(i), []).append((n, i, place))
    return links


def classes(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_signatures, class_id): documents connected by fingerprints of a likeness of num / den or more, with
    the smallest doc_id of each class.

    Null and empty texts have no signature and are classes of their own. Rows with a null doc_id are left out, rows
    that repeat one count once; further columns are ignored. An empty table gives an empty result."""
    return components_of(docs, _members, linked, num, den).select("doc_id", F.col("n_shingles").alias("n_signatures"), F.col("component_id").alias("class_id"))


def beside_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The next document is that of the next smaller doc_id, after the smallest the largest; equal doc_ids are
    ordered by text. The edited text is the text less its last floor(n / 2) code points, and as many of the
    next text's first, or all. Rows with a null doc_id are left out. An empty table gives an empty result; a
    single document is its own next. Texts are shuffled once, to ranges of doc_id; the document at the head of
    a range is also sent to the range that it follows."""
    spark = docs.sparkSession
    docs = texts(docs.where("doc_id is not null"))
    kind = dict(docs.dtypes)["doc_id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    cuts = sorted(set(cuts or []))  # fewer than the shuffle partitions
    wide = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    if groups:
        coarse = F.size(F.filter(F.array(*[F.lit(g[0]) for g in groups]), lambda x: x <= F.col("doc_id")))
        fine = F.coalesce(F.size(F.filter(F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), F.col("_g")), lambda x: x <= F.col("doc_id"))), F.lit(0))
        docs = docs.withColumn("_g", coarse).withColumn("range", F.when(F.col("_g") == 0, 0).otherwise((F.col("_g") - 1) * wide + fine)).drop("_g")
    else:
        docs = docs.withColumn("range", F.lit(0))
    heads = {r["range"]: r["top"] for r in docs.groupBy("range").agg(F.max("doc_id").alias("top")).collect()}
    if not heads:
        return spark.createDataFrame([], f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    order = sorted(heads)
    follow = {heads[r]: order[(i + 1) % len(order)] for i, r in enumerate(order)}  # a head follows the range above it
    also = F.create_map(*[F.lit(x) for pair in follow.items() for x in pair])
    to = F.when(F.col("doc_id").isin(*follow), F.array(F.struct(F.col("range").cast("int").alias("range"), F.lit(False).alias("copy")), F.struct(also[F.col("doc_id")].cast("int").alias("range"), F.lit(True).alias("copy"))))
    to = to.otherwise(F.array(F.struct(F.col("range").cast("int").alias("range"), F.lit(False).alias("copy"))))
    dealt = docs.select("doc_id", "text", F.explode(to).alias("x")).select("doc_id", "text", "x.range", "x.copy")
    # of rows with a head's doc_id only the first in order is the next document
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held = []  # rows whose next one is still to come

        def work(rows, last):
            t = [r[1] for r in rows] + [last[1]]
            edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(t, t[1:])]
            own, other = signatures(t), signatures(edited)
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows]), pa.array([len(x) for x in t[:-1]], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                pa.array([encode(x) for x in own[:-1]]), pa.array([encode(x) for x in other]),
                pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64())], names)

        size = 0
        for b in batches:
            for at in range(0, b.num_rows, 64):
                p = b.slice(at, 64)
                for row in zip(p.column("doc_id").to_pylist(), p.column("text").to_pylist(), p.column("range").to_pylist(), p.column("copy").to_pylist()):
                    if row[3]:
                        if held and held[0][2] == row[2]:
                            yield work(held, row)
                        held, size = [], 0
                        continue
                    if size > 1 << 18:
                        yield work(held, row)
                        held, size = [], 0
                    held.append(row)
                    size += len(row[1])

    order = ["range", "copy", F.desc("doc_id"), "text"]
    return in_order(dealt, ["range"], order, run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
