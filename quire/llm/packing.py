"""Packing along a space-filling curve.

Documents are tokenised once. Hashed token counts are projected to DIMS dimensions, standardised by the
corpus's mean and deviation, and quantised to the cells of a Hilbert curve. Documents in order of (Hilbert
key, doc_id) form one stream, cut every `length` tokens, so neighbours along the curve share sequences and
only the last sequence is padded. Only (key, doc_id, number of tokens) is range-sorted; token ids are
shuffled once, to meet their places.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, buffers, mapped, mix, texts

DIMS, BITS = 4, 10
#: Hashed features of a token.
FEATURES = 1 << 14
#: Texts encoded together, and texts of a task that both encoders must give the same ids for.
TEXTS, COMPARED = 512, 8
END = 0

_PROJECTION = ((mix(np.arange(FEATURES * DIMS, dtype=np.uint64)) >> np.uint64(40)).astype(np.float32) / (1 << 23) - 1).reshape(FEATURES, DIMS)


#: Fixed value: the pieces that byte-level BPE cuts a text into before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBE = "It's 12 naïve café-goers;  they'll\n\n pay £3.50 … 日本 \tok "


class Encoder:
    """Ids of whole texts, those of the tokenizers library.

    If the file is a byte-level BPE whose ids rank its merges, tiktoken merges by these ranks, which is faster, as long
    as that gives the library's ids for a probe and for the first texts of a task. Texts that hold one of the file's
    added tokens, or other white space than single spaces and newlines between words, go to the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.compared = 0
        self.ranked = self._ranked(path)

    def _ranked(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model.get("type", "BPE") != "BPE":
            return None
        # fixed rule of byte-level vocabularies: printable Latin-1 stands for itself, other bytes from U+0100 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(c): c for c in plain} | {chr(0x100 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}
        try:
            ranks = {bytes(byte[c] for c in k): v for k, v in model["vocab"].items() if k not in self.added}
            enc = tiktoken.Encoding("ranked", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
            same = enc.encode_ordinary(_PROBE) == self._library(_PROBE)
        except (KeyError, ValueError):
            return None
        return enc if same else None

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian 16-bit ids of each text; the vocabulary is below 65536."""
        slow = lambda t: array("H", self._library(t)).tobytes()
        if not self.ranked:
            return [slow(t) for t in batch]
        easy = [t.replace("\n", " ") == " ".join(t.split()) and not any(x in t for x in self.added) for t in batch]
        out = [self.ranked.encode_to_numpy(t).astype("<u2").tobytes() if e else slow(t) for t, e in zip(batch, easy)]
        for t, e, ids in zip(batch, easy, out):
            if self.compared >= COMPARED:
                break
            if e:
                self.compared += 1
                if ids != slow(t):
                    self.ranked = None
                    return [slow(t) for t in batch]
        return out


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of rows of integer coordinates below 2**bits (Skilling's transform)."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _tokens(path: str):
    def scan(batches):
        enc = Encoder(path)
        feature = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(FEATURES)).astype(np.int32)
        end, count = np.array([END], "<u2").tobytes(), 0
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                ids = [x + end for x in enc.encode(part.column("text").to_pylist())]
                rows = np.arange(count, count + len(ids)) + (TaskContext.get().partitionId() << 40)
                count += len(ids)
                n = np.array([len(x) // 2 for x in ids], np.int64)
                first = np.cumsum(n) - n
                vec = np.add.reduceat(_PROJECTION[feature[np.frombuffer(b"".join(ids), "<u2")]], first, axis=0) / n[:, None]
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * DIMS), pa.array(vec.astype(np.float64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(rows), pa.array(n), pa.array(ids, pa.binary()), vec], ["doc_id", "row", "n", "ids", "vec"])

    return scan


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, nulls: bool = False) -> DataFrame:
    """(doc_id, start, pieces of ids, doc_tokens, sequence_id, offset): `ids` binary of little-endian 16-bit ids.

    tokenizer: path of a tokenizers file, present on each machine, with ids below 65536. A document's ids are
    those of its text (null: empty) and END. Rows with a null doc_id are left out unless nulls is true; rows that repeat a doc_id are
    documents of their own. Equal keys are ordered by doc_id, so equal texts lie next to each other. Further columns are ignored. An empty
    table gives an empty result."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base = texts(docs if nulls else docs.where("doc_id is not null"))
    tok = scratch.keep(mapped(base, _tokens(tokenizer), "doc_id long, row long, n long, ids binary, vec array<double>"), "tokens")
    stat = tok.select(*[f(F.col("vec")[i]).alias(f"{a}{i}") for i in range(DIMS) for f, a in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    mean = np.array([stat[f"m{i}"] or 0.0 for i in range(DIMS)])
    dev = np.array([stat[f"s{i}"] or 1.0 for i in range(DIMS)])

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = (np.array(b.column("vec").to_pylist(), np.float64) - mean) / dev
            cell = np.clip((1 / (1 + np.exp(-1.7 * np.clip(v, -30, 30)))) * (1 << BITS), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), b.column("n"), pa.array(hilbert(cell, BITS), pa.int64())], ["doc_id", "row", "n", "key"])

    keys = scratch.keep(mapped(tok.select("doc_id", "row", "n", "vec"), place, "doc_id long, row long, n long, key long"), "keys")

    def run(batches):
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n").to_numpy()
            before = np.cumsum(n) - n + total
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.full(len(n), part), pa.int32()), pa.array(before), b.column("n")], ["d", "part", "before", "k"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    curve = keys.repartitionByRange(parts, "key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row")
    placed = scratch.keep(mapped(curve, run, "d long, part int, before long, k long"), "places")
    scratch.drop("keys")
    # a total for each of `parts` partitions
    sums, offset = {}, 0
    for part, k in sorted(map(tuple, placed.groupBy("part").agg(F.sum("k")).collect())):
        sums[part], offset = offset, offset + k
    starts = spark.createDataFrame([(int(a), int(b)) for a, b in sums.items()], "p int, base long")
    placed = placed.join(F.broadcast(starts), F.col("part") == F.col("p")).select("d", (F.col("base") + F.col("before")).alias("at"))

    def cut(batches):
        for b in batches:
            off, data = buffers(b.column("ids"))
            off, at = off // 2, b.column("at").to_numpy()
            n = np.diff(off)
            count = (at + n - 1) // length - at // length + 1  # sequences that a document's ids are in
            i = np.repeat(np.arange(len(n)), count)
            seq = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + (at // length)[i]
            start = np.maximum(at[i], seq * length) - at[i]
            stop = np.minimum(at[i] + n[i], (seq + 1) * length) - at[i]
            ends = np.append(off[i] + start, off[i[-1]] + stop[-1]) if len(i) else np.zeros(1, np.int64)
            ids = pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer((2 * ends).astype(np.int32).tobytes()), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(i)), pa.array(start), ids, pa.array(n[i]), pa.array(seq), pa.array(at[i] + start - seq * length)], ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])

    pieces = tok.select("doc_id", "row", "ids").join(placed, F.col("row") == F.col("d")).select("doc_id", "ids", "at")
    return mapped(pieces, cut, "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")


def digests(pieces: DataFrame) -> DataFrame:
    """Lengths and checksums of pieces, ids as little-endian 32-bit."""

    def crc(batches):
        for b in batches:
            off, data = buffers(b.column("ids"))
            cut = (2 * off).tolist()
            wide = memoryview(np.frombuffer(data.tobytes() if len(data) % 2 else data, "<u2", count=len(data) // 2).astype("<u4").tobytes())
            more = [pa.array(np.diff(off) // 2), pa.array([zlib.crc32(wide[a:z]) for a, z in zip(cut, cut[1:])], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), *more, b.column("doc_tokens"), b.column("sequence_id"), b.column("offset")], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return mapped(pieces, crc, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
