"""Token ids as files of blocks, each compressed by a grammar of pairs (Re-Pair).

Documents in order of doc_id are dealt out by ranges; each range is a shard, written as blocks of whole documents with about
BLOCK ids. In a block the most frequent pairs of neighbouring symbols become nonterminals, round after round, until no
pair is frequent or the 16 bits of a symbol are used up. A block is a row of a Parquet table, so Spark's own writer
commits it and any store that Spark reads can hold it:

    shard, block      its place; blocks of a shard are numbered from 0
    doc_ids, sizes    of its documents, in order; a size counts ids with the end
    start, n_ids      ids of the shard before the block, and in it
    terminals         symbols below are ids, the others nonterminals
    left, right       16 bits each: the symbols that nonterminal terminals + i stands for, lower ones
    spans             32 bits each: the number of ids that a nonterminal expands to
    symbols           16 bits each
    marks             64 bits each: ids before symbol 0, STEP, 2 * STEP ... of the block

`index` has a row a shard: ids of all shards before it. piece() expands any range of a block's ids from the mark before it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, mapped, session
from quire.llm.wordwise import ByteLevel

END = 2
#: Ids of a block, about; symbols between two marks.
BLOCK, STEP = 1 << 21, 256
#: Rounds of replacement, nonterminals of a round at most, and how often a pair must stand to be one.
ROUNDS, NEW, LEAST = 6, 3000, 16
_BINS = 20
BLOCKS = "shard int, block int, doc_ids array<long>, sizes array<long>, start long, n_ids long, terminals int, left binary, right binary, spans binary, symbols binary, marks binary"


def _pairs(code: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent pair codes, at most room of them with LEAST occurrences each, sorted; and the places where they
    stand. Bins of hashed codes with few occurrences in all hold no frequent pair, and their places aren't sorted."""
    bin_of = (code * np.uint32(2654435761)) >> np.uint32(32 - _BINS)
    held = np.bincount(bin_of, minlength=1 << _BINS)
    # about twice the pairs that are wanted: the fullest bins
    full = np.sort(held[held >= LEAST])[::-1]
    if not len(full) or room <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    least = full[min(len(full), 2 * room) - 1]
    at = np.flatnonzero((held >= least)[bin_of])
    there = code[at]
    s = np.sort(there)
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    count = np.diff(np.append(first, len(s)))
    often = np.flatnonzero(count >= LEAST)
    often = often[np.lexsort((s[first[often]], -count[often]))[:room]]
    chosen = np.sort(s[first[often]])
    if not len(chosen):
        return chosen, np.zeros(0, np.int64)
    own = np.zeros(1 << _BINS, bool)
    own[(chosen * np.uint32(2654435761)) >> np.uint32(32 - _BINS)] = True
    some = own[bin_of[at]]
    at, there = at[some], there[some]
    hit = chosen[np.minimum(np.searchsorted(chosen, there), len(chosen) - 1)] == there
    return chosen, at[hit]


def grammar(ids: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """symbols, left, right and spans of a sequence of ids below terminals (at most 65536)."""
    seq = ids.astype(np.uint32)
    left, right, spans = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)], np.ones(terminals, np.int64)
    for _ in range(ROUNDS):
        if len(seq) < 2:
            break
        code = (seq[:-1] << np.uint32(16)) | seq[1:]
        chosen, at = _pairs(code, min(NEW, (1 << 16) - len(spans)))
        if not len(chosen):
            break
        # of pairs that overlap, every second one from the first of their run
        run = np.concatenate(([True], at[1:] != at[:-1] + 1))
        begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - begin) % 2 == 0]
        seq[at] = (len(spans) + np.searchsorted(chosen, code[at])).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        a, b = chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)
        left.append(a)
        right.append(b)
        spans = np.concatenate((spans, spans[a] + spans[b]))
    return seq.astype("<u2"), np.concatenate(left).astype("<u2"), np.concatenate(right).astype("<u2"), spans[terminals:].astype("<u4")


class Block:
    """A block's symbols and what they expand to."""

    def __init__(self, terminals: int, left: bytes, right: bytes, spans: bytes, symbols: bytes, marks: bytes):
        self.symbols, self.marks = np.frombuffer(symbols, "<u2"), np.frombuffer(marks, "<i8")
        own = np.frombuffer(spans, "<u4").astype(np.int64)
        self.span = np.concatenate((np.ones(terminals, np.int64), own))
        self.at = np.concatenate((np.arange(terminals), terminals + np.cumsum(own) - own))
        self.flat = np.concatenate((np.arange(terminals, dtype=np.uint32), np.zeros(int(own.sum()), np.uint32)))
        for i, (a, b) in enumerate(zip(np.frombuffer(left, "<u2").tolist(), np.frombuffer(right, "<u2").tolist()), terminals):
            p, n, m = self.at[i], self.span[a], self.span[b]
            self.flat[p : p + n] = self.flat[self.at[a] : self.at[a] + n]
            self.flat[p + n : p + n + m] = self.flat[self.at[b] : self.at[b] + m]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.span[symbols]
        end = np.cumsum(n)
        take = np.repeat((self.at[symbols] - end + n).astype(np.int32), n)
        take += np.arange(len(take), dtype=np.int32)
        return self.flat[take]

    def piece(self, start: int, length: int) -> np.ndarray:
        """Ids start to start + length of the block, from the mark before them on."""
        if length <= 0:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.marks, start, "right")) - 1
        b = int(np.searchsorted(self.marks, start + length, "left"))
        out = self.expand(self.symbols[a * STEP : b * STEP])
        return out[start - self.marks[a] : start - self.marks[a] + length]


def marks_of(symbols: np.ndarray, spans: np.ndarray, terminals: int) -> np.ndarray:
    n = np.concatenate((np.ones(terminals, np.int64), spans.astype(np.int64)))[symbols]
    return (np.cumsum(n) - n)[::STEP].astype("<i8")


def write(docs: DataFrame, tokenizer: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(blocks, index), written and read again. Ids are those of each text (null: empty) and END.

    Documents stand in ascending order of doc_id, nulls last; rows that repeat a doc_id are documents of their own, in
    order of a hash of their text. A document longer than `block` has a block of its own, longer than the others. tokenizer: path of a
    tokenizers file with ids below 65536, present on each machine. Further columns are ignored. An empty table gives
    empty tables."""
    spark = docs.sparkSession
    session(spark)
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def scan(batches):
        model = ByteLevel(tokenizer, False)
        terminals, shard = len(model.size), TaskContext.get().partitionId()
        number, before = 0, 0
        doc_ids, sizes, ids, held = [], [], [], 0

        def done():
            nonlocal number, before, doc_ids, sizes, ids, held
            symbols, left, right, spans = grammar(np.concatenate(ids), terminals)
            marks = marks_of(symbols, spans, terminals)
            row = [[shard], [number], [doc_ids], [sizes], [before], [held], [terminals], *[[x.tobytes()] for x in (left, right, spans, symbols, marks)]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
            names = ["shard", "block", "doc_ids", "sizes", "start", "n_ids", "terminals", "left", "right", "spans", "symbols", "marks"]
            number, before, doc_ids, sizes, ids, held = number + 1, before + held, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names)

        for b in batches:
            flat, at = model.texts(b.column("text"))
            end = np.zeros(len(flat) + b.num_rows, np.uint16)
            to = at[1:] + np.arange(1, b.num_rows + 1)  # behind each document's end
            body = np.ones(len(end), bool)
            body[to - 1] = False
            end[body], end[to - 1] = flat, END
            names, lo = b.column("doc_id").to_pylist(), 0
            while lo < b.num_rows:
                base = int(to[lo - 1]) if lo else 0
                hi = min(b.num_rows, max(lo + 1, int(np.searchsorted(to, base + block - held, "right"))))
                if held and to[hi - 1] - base + held > block:
                    yield done()
                    continue
                doc_ids += names[lo:hi]
                sizes += np.diff(np.append(base, to[lo:hi])).tolist()
                ids.append(end[base : to[hi - 1]].copy())
                held += int(to[hi - 1]) - base
                lo = hi
        if held:
            yield done()

    blocks = scratch.keep(mapped(sorted_rows, scan, BLOCKS), "blocks")
    sums, total = [], 0  # a number for each of `parts` shards
    for shard, n in sorted(map(tuple, blocks.groupBy("shard").agg(F.sum("n_ids")).collect())):
        sums.append((shard, total))
        total += n
    return blocks, scratch.keep(spark.createDataFrame(sums, "shard int, before long").coalesce(1), "index")


def read(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of each document of the files: ids binary of little-endian 32-bit ids; start, the ids of all
    documents before it."""

    def scan(batches):
        for b in batches:
            for row in b.to_pylist():
                x = Block(*[row[c] for c in ("terminals", "left", "right", "spans", "symbols", "marks")])
                flat = x.expand(x.symbols).astype("<u4")
                to = np.cumsum(np.array(row["sizes"], np.int64))
                at = 0
                while at < len(to):  # documents of 4 MB of ids a batch; a longer one comes alone
                    lo = int(to[at - 1]) if at else 0
                    hi = max(at + 1, int(np.searchsorted(to, lo + (1 << 20), "right")))
                    off = np.append(lo, to[at:hi])
                    raw = flat[lo : to[hi - 1]].tobytes()
                    ids = pa.Array.from_buffers(pa.binary(), hi - at, [None, pa.py_buffer((4 * (off - lo)).astype(np.int32).tobytes()), pa.py_buffer(raw)])
                    yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * (hi - at), pa.int32()), pa.array(row["doc_ids"][at:hi], pa.int64()), pa.array(row["start"] + off[:-1]), ids], ["shard", "doc_id", "at", "ids"])
                    at = hi

    rows = mapped(blocks, scan, "shard int, doc_id long, at long, ids binary")
    return rows.join(F.broadcast(index), "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "ids")  # index: a row a shard


def find(blocks: DataFrame, index: DataFrame, doc_ids: list[int]) -> DataFrame:
    """(doc_id, start, ids) of some documents. Only blocks that hold one are read, and of these only the symbols between
    the marks around it are expanded."""
    wanted = F.array(*[F.lit(int(i)).cast("long") for i in doc_ids])
    some = blocks.where(F.arrays_overlap("doc_ids", wanted))
    names = {int(i) for i in doc_ids}

    def scan(batches):
        for b in batches:
            for row in b.to_pylist():
                x = Block(*[row[c] for c in ("terminals", "left", "right", "spans", "symbols", "marks")])
                at = 0
                for name, n in zip(row["doc_ids"], row["sizes"]):
                    if name in names:
                        ids = x.piece(at, n).astype("<u4").tobytes()
                        yield pa.RecordBatch.from_pydict({"shard": pa.array([row["shard"]], pa.int32()), "doc_id": [name], "at": [row["start"] + at], "ids": pa.array([ids], pa.binary())})
                    at += n

    rows = mapped(some, scan, "shard int, doc_id long, at long, ids binary")
    return rows.join(F.broadcast(index), "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "ids")


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of documents that were read."""
    return documents.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
