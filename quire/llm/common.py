"""Helpers shared by the training-data operators: Arrow buffers as numpy arrays,
position-independent hashes of byte spans, packed shuffles, bitsets of a checked size,
Python scans that give their memory back, and intermediate tables in the folder the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import ship

#: Text handled in one numpy pass. Bounds a worker's memory at about 60 bytes per byte of it;
#: a single longer text is one pass of its own.
CHUNK_BYTES = 1 << 17

#: Bytes of an Arrow batch that Spark hands to Python, for wide texts; a session's own smaller value stays.
BATCH_BYTES = 8 << 20

_U = np.uint64
pa.set_memory_pool(pa.system_memory_pool())  # the one pool whose free pages release() can return
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Returns free memory to the machine. Python workers outlive their tasks and serve later operators."""
    if _trim:
        _trim(0)


def session(spark: SparkSession) -> None:
    """Makes the session ready for scans in Python: the package on the workers, Arrow batches of BATCH_BYTES at most."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).lower().rstrip("b")
    if int(now) > BATCH_BYTES if now.isdigit() else True:
        spark.conf.set(key, str(BATCH_BYTES))


def mapped(df: DataFrame, scan, schema) -> DataFrame:
    """mapInArrow whose worker gives its memory back at the end of each task."""

    def run(batches):
        try:
            yield from scan(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def grouped(df: DataFrame, key: str, work, schema) -> DataFrame:
    """groupBy(key).applyInArrow whose worker gives its memory back after each group."""

    def run(k, table):
        try:
            return work(k, table)
        finally:
            release()

    return df.groupBy(key).applyInArrow(run, schema)


def in_order(df: DataFrame, by: list[str], order: list[str], scan, schema) -> DataFrame:
    """Rows dealt out by `by`, sorted by `order` (which begins with `by`) and scanned in that order. Spark sorts and
    spills; the scan holds a batch and what it carries over."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mapped(df.repartition(parts, *by).sortWithinPartitions(*order), scan, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


class SpanHash:
    """Hashes of any spans of one byte array; equal bytes have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = _power(n + 1)
        v = _BYTE[data]
        v *= up[:n]
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(v, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.sums[end] - self.sums[start]
        h *= self.down[start]
        h += (end - start).astype(_U) * _U(0xA24BAED4963EE407)
        return mix(h)

    def every(self, k: int) -> np.ndarray:
        """Hash of each span of k bytes."""
        h = self.sums[k:] - self.sums[:-k]
        h *= self.down[: len(h)]
        h += _U(k * 0xA24BAED4963EE407 & (1 << 64) - 1)
        return mix(h)


def buffers(arr) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary Arrow array without nulls."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    raw = arr.buffers()
    off = np.frombuffer(raw[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return off, data


def chunks(off: np.ndarray):
    """Ranges of rows of about CHUNK_BYTES; a longer row comes alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK_BYTES, "right")) - 1))
        yield lo, hi
        lo = hi


def pack(values: np.ndarray, bucket: np.ndarray, n: int) -> list[tuple[int, bytes]]:
    """The records of each bucket as one byte string."""
    if not len(values):
        return []
    order = np.argsort(bucket, kind="stable")
    b, v = bucket[order], values[order]
    cut = np.flatnonzero(np.diff(b)) + 1
    starts = np.concatenate(([0], cut))
    return [(int(b[s]), v[s:e].tobytes()) for s, e in zip(starts, np.append(cut, len(v)))]


def high_bits(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def bucket_bits(spark: SparkSession, each: int = 4) -> int:
    """Buckets of a packed shuffle, as a power of two: each times the shuffle partitions, which
    an operator of the cluster raises with the input."""
    return max(2, (each * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


#: The largest bitset that is sent to all executors has 2 ** MOST_BITS bits (32 MB); sets with less than 6 bits an
#: element in it go by a join instead.
MOST_BITS = 28


class Bits:
    """A set of 64-bit hashes in a power of two of bits: may hold more than was put in, never less."""

    def __init__(self, data: bytes):
        self.data, self.mask = np.frombuffer(data, np.uint8), _U(8 * len(data) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        pos = (hashes.view(_U) & self.mask).astype(np.int64)
        return (self.data[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1

    @staticmethod
    def of(hashes: DataFrame, count: int) -> bytes | None:
        """The set of a column `h` of longs, of which there are count; None if it is larger than all executors should
        get. Slices are made by tasks; the driver gets them in one job, 32 MB at most, and joins them."""
        if 6 * count > 1 << MOST_BITS:
            return None
        bits = min(MOST_BITS, max(16, (8 * count).bit_length()))
        low = bits - 8
        pos = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
        rows = hashes.select(F.shiftright(pos, low).cast("int").alias("slice"), pos.bitwiseAND(F.lit((1 << low) - 1)).alias("pos")).distinct()

        def mark(key, t):
            out = np.zeros(1 << low, np.uint8)
            out[t.column("pos").to_numpy()] = 1
            return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

        out = bytearray(1 << (bits - 3))
        for i, data in grouped(rows, "slice", mark, "slice int, data binary").collect():
            out[i << (low - 3) : (i + 1) << (low - 3)] = data
        return bytes(out)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the cluster names none (tests on one machine),
    a temporary folder is set."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        sc = spark.sparkContext
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="quire-")
        sc.setCheckpointDir(d)
        spark.conf.set("spark.checkpoint.dir", d)
    return d


_open = threading.local()


def _scratches() -> list["Scratch"]:
    if not hasattr(_open, "all"):
        _open.all = []
    return _open.all


class Scratch:
    """Written tables that cut lineage. drop() removes one that is no longer read, clear() all; what is left goes
    when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}"
        _scratches().append(self)
        atexit.register(self.clear)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def clear(self) -> None:
        atexit.unregister(self.clear)
        with contextlib.suppress(Exception):  # a driver that ends may have no JVM any more
            self._delete(self.root)


@contextlib.contextmanager
def scratches():
    """The scratch folders that are opened inside, as a list."""
    before, mine = _scratches(), []
    _open.all = mine
    try:
        yield mine
    finally:
        _open.all = before
        before += mine


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text with null as empty, and further columns."""
    session(docs.sparkSession)
    return docs.select("doc_id", *more, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def own_keys(docs: DataFrame) -> tuple[DataFrame, str | None]:
    """The rows with unique doc_ids, and the column that has the given ones: docs itself and None if those are
    unique, else a written copy whose doc_id is a key of each row."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if not ids.limit(1).count():
        return docs, None
    given = "_given"
    while given in docs.columns:
        given += "_"
    rows = docs.withColumnRenamed("doc_id", given).withColumn("doc_id", F.monotonically_increasing_id())
    return Scratch(docs.sparkSession).keep(rows, "rows"), given


def with_given(rows: DataFrame, given: str | None, columns: list[str]) -> DataFrame:
    """The columns of rows of own_keys(), with the given doc_ids."""
    return rows.select(*[F.col(given).alias(c) if given and c == "doc_id" else c for c in columns])


def parted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose doc_id may be among those of ids, and the others, which need no join with it: a bitset of the ids keeps
    their texts out of the shuffle. None for the others if ids are too many for one; then all rows are in the first."""
    held = Bits.of(ids.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h")), ids.count())
    if held is None:
        return docs, None
    sent, columns, schema = docs.sparkSession.sparkContext.broadcast(held), docs.columns, docs.schema
    marked = docs.withColumn("_h", F.xxhash64(F.col("doc_id").cast("long")))

    def pick(want: bool):
        def scan(batches):
            bits = Bits(sent.value)
            for b in batches:
                keep = bits.has(b.column("_h").to_numpy(zero_copy_only=False).astype(np.int64))
                yield b.filter(pa.array(keep if want else ~keep)).select(columns)

        return mapped(marked, scan, schema)

    return pick(True), pick(False)


#: Edges that one task turns into components by itself; 16 bytes each.
LOCAL_EDGES = 1 << 20


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of these edges and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return nodes, nodes[label] if len(nodes) else nodes


def components(spark: SparkSession, scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, label): the smallest node of each component of the edges (a, b), for nodes that have edges.

    Each task first replaces its edges by a star for each component among them. Up to LOCAL_EDGES of these
    are finished in one task. More take rounds of the smallest neighbour's label and a jump to that label's
    label, whose number grows with the logarithm of a chain's length; each round is written to the shared
    folder, and hot nodes are combined map-side, as min is."""

    def star(batches):
        held, size = [], 0
        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            size += len(held[-1][0])
            if size >= LOCAL_EDGES:
                yield done(held)
                held, size = [], 0
        yield done(held)

    def done(held):
        a, b = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64),) * 2
        nodes, label = smallest(a, b)
        keep = nodes != label
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(label[keep])], ["a", "b"])

    e = scratch.keep(mapped(edges.select("a", "b"), star, "a long, b long"), f"{name}-stars")
    if e.count() <= LOCAL_EDGES:

        def whole(batches):
            held = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
            nodes, label = smallest(*(np.concatenate(x) for x in zip(*held))) if held else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label)], ["node", "label"])

        return scratch.keep(mapped(e.coalesce(1), whole, "node long, label long"), f"{name}-all")
    e = scratch.keep(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    lab = scratch.keep(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), f"{name}-0")
    r = 0
    while True:
        r += 1
        near = e.join(lab, e.a == lab.node).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        step = lab.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = lab.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = step.join(up, "label", "left").select("node", F.least("label", F.coalesce("top", "label")).alias("label"), "old")
        new = scratch.keep(new, f"{name}-{r}")
        changed = new.where("label <> old").limit(1).count()
        scratch.drop(f"{name}-{r - 1}")
        lab = new.select("node", "label")
        if not changed:
            scratch.drop(f"{name}-edges")
            return lab
