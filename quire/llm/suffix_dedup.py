"""Removal of byte strings that start at more than one place, by distributed prefix doubling.

The rank of a position at length k names its next k bytes: equal for equal bytes. Doubling sorts positions by rank
pairs at growing offsets, drops those that have become unique and ranks the rest at the next length, up to the
threshold. Every byte of a corpus is a position; sorting all of them needs tens of bytes of disk for each byte of
text (README has the measurement), so positions enter in groups that are known to repeat only together:

length SEED: a window of `length` bytes is represented by the smallest of the ranks of its SEED-byte strings, its
  anchor. Equal windows have equal anchors at equal offsets. Neighbouring windows with one anchor form a run. Spark
  sorts (rank of the anchor, rank of the run's whole span): a run with a unique rank is dropped; of runs with equal
  pairs each window repeats, and they are done; a run that shares its anchor's rank with another span goes on.
length `length` - WIDE + 1: the windows of a run whose anchors lie at offsets of one wide cell (WIDE of them) share a core
  of that length. Spark sorts (rank of the pair of ranks of its halves, rank of the cell's whole span); what becomes of
  wide cells is as with runs, so those that a repeated string covers are done, and those it ends in go on.
length `length` - CELL + 1: the same cells cut into cells of CELL windows with a longer core. Spark sorts the pairs of ranks
  of its halves; cells with a unique pair are dropped.
length `length`: Spark sorts the pairs of ranks of the halves of the windows left. Those that share one repeat.

A mapper sorts FLUSH positions first and settles what repeats among them: of equal ones a single representative is
dealt out, so a passage in a third of all texts costs a row a flush. An anchor, or core of a wide cell, with more than HOT
spans in one flush goes on with all of them, of which two are dealt out. Ranks are 64-bit hashes, which need no exchange to be equal on
two machines. Each length reads the texts again rather than keep them; which positions go on is told by a bitset of
checked size, beyond it by a join on doc_id.

Bytes are those of UTF-8; a match never crosses documents; nothing is capped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Bits, Scratch, SpanHash, buffers, chunks, in_order, mapped, mix, own_keys, parted, texts, with_given

SEED, WIDE, CELL = 40, 40, 8
#: Positions that a mapper sorts together before it deals them out; spans of an anchor among them that make it hot.
FLUSH, HOT = 1 << 18, 8

_U = np.uint64
_PAIR = _U(0x9E3779B97F4A7C15)
#: Kinds of rows: a position (v, f: its ranks), a hit (doc, at, n windows that repeat), a mark (v: key of a position
#: that goes on), a document (f: its bytes, whole: sha256).
POSITION, HIT, MARK, DOC = range(4)
_ROWS = "kind byte, v long, f long, doc long, at int, n int, whole string"
_NAMES = ["kind", "v", "f", "doc", "at", "n", "whole"]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    m = x
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(x) - width + 1], m[width - size : len(x) - size + 1]) if size < width else m


def _runs(hashes: SpanHash, rel: np.ndarray, length: int):
    """Runs of windows in rows with ends rel: rank, row, first window, number of windows, anchor."""
    n, seed = int(rel[-1]), min(SEED, length)
    if n < length:
        z = np.zeros(0, np.int64)
        return z.astype(_U), z, z, z, z
    h = hashes.every(seed)
    bits = _U(max(24, n.bit_length()))
    m = _sliding_min((h >> bits << bits) | np.arange(len(h), dtype=_U), length - seed + 1)
    pos = (m & _U((1 << int(bits)) - 1)).astype(np.int64)
    ends = np.maximum(rel[1:] - length + 1, rel[:-1])  # after a row's last window
    change = np.zeros(len(pos) + 1, np.int8)
    change[1:-1] = pos[1:] != pos[:-1]
    long = ends > rel[:-1]
    change[rel[:-1][long]] = 1
    change[ends[long]] |= 2
    inside = np.zeros(len(pos) + 1, np.int32)
    np.add.at(inside, rel[:-1][long], 1)
    np.add.at(inside, ends[long], -1)
    inside = np.cumsum(inside[:-1]) > 0
    start = np.flatnonzero((change[:-1] != 0) & inside)
    row = np.searchsorted(rel, start, "right") - 1
    stop = np.minimum(np.append(start[1:], len(pos)), ends[row])
    return mix(h[pos[start]] + _PAIR), row, start, stop - start, pos[start]  # mixed again: the smallest hashes begin with zeros


def _pair(hashes: SpanHash, start: np.ndarray, size: int) -> np.ndarray:
    """Ranks at length size: of the pairs of ranks of both halves."""
    half = size // 2
    return mix(hashes.of(start, start + half) * _PAIR + hashes.of(start + half, start + size))


def _key(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(mix(doc.astype(np.int64).view(_U)) + at.astype(_U) * _U(8191))


def _scan(batches, length: int):
    """Of each chunk of texts: row of the batch, ids, bytes, ends, hashes, and its runs."""
    for b in batches:
        off, data = buffers(b.column("text"))
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        for lo, hi in chunks(off):
            own, rel = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            hashes = SpanHash(own)
            yield (b, lo, hi), ids[lo:hi], own, rel, hashes, _runs(hashes, rel, length)


def _rows(kind: int, doc, v=None, f=None, at=None, n=None, whole=None) -> pa.RecordBatch:
    k = len(doc)
    zero = lambda x, t: pa.array(np.zeros(k, t) if x is None else np.ascontiguousarray(x).astype(t) if x.dtype != _U else x.view(np.int64))
    cols = [pa.array(np.full(k, kind, np.int8)), zero(v, np.int64), zero(f, np.int64), zero(doc, np.int64), zero(at, np.int32), zero(n, np.int32)]
    return pa.RecordBatch.from_arrays([*cols, pa.nulls(k, pa.string()) if whole is None else pa.array(whole, pa.string())], _NAMES)


def _hits(doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Hits, neighbouring windows of a document as one."""
    order = np.lexsort((at, doc))
    doc, at, n = doc[order], at[order], n[order]
    if len(doc):
        end = at + n
        first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] != end[:-1]))))
        last = np.append(first[1:], len(doc)) - 1
        doc, at, n = doc[first], at[first], end[last] - at[first]
    return _rows(HIT, doc, v=mix(doc.astype(np.int64).view(_U)), at=at, n=n)


def _flushed(batches, length: int, take, settle, more=None):
    """take(chunk) gives arrays of positions; settle() gets FLUSH of them and gives rows."""
    held, size = [], 0
    for chunk in _scan(batches, length):
        got = take(*chunk)
        held.append(got)
        size += len(got[0])
        if more:
            yield more(*chunk)
        if size >= FLUSH:
            yield from settle(*map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield from settle(*map(np.concatenate, zip(*held)))


def _settle(v, f, doc, at, n):
    """Of runs or wide cells (v: rank of what their windows share, f: of the whole span) hits of those that repeat among
    them, and positions of different ones."""
    if not len(v):
        return
    order = np.argsort(v)
    v, f = v[order], f[order]
    same = np.concatenate(([False], v[1:] == v[:-1], [False]))
    several = np.flatnonzero(same[1:] | same[:-1])  # only these need their second rank sorted
    second = np.lexsort((f[several], v[several]))
    order[several], f[several] = order[several][second], f[several][second]
    doc, at, n = doc[order], at[order], n[order]
    new = np.concatenate(([True], v[1:] != v[:-1]))
    kind = new | np.concatenate(([True], f[1:] != f[:-1]))
    first = np.flatnonzero(kind)
    twice = np.repeat(np.diff(np.append(first, len(v))) > 1, np.diff(np.append(first, len(v))))
    yield _hits(doc[twice], at[twice], n[twice])
    v, f, doc, at, n, new = (x[first] for x in (v, f, doc, at, n, new))
    group = np.cumsum(new) - 1
    kinds = np.bincount(group)
    hot = kinds[group] > HOT
    yield _rows(MARK, doc[hot], v=_key(doc[hot], at[hot]), at=at[hot])
    nth = np.arange(len(v)) - np.flatnonzero(new)[group]
    go = ~hot | (nth < 2)
    yield _rows(POSITION, doc[go], v=v[go], f=f[go], at=at[go], n=n[go])


def _anchors(length: int):
    """Runs by the rank of their anchor, and the documents."""

    def take(where, ids, own, rel, hashes, runs):
        v, row, start, n, _ = runs
        return v, hashes.of(start, start + n + length - 1), ids[row], start - rel[row], n

    def documents(where, ids, own, rel, hashes, runs):
        sha = [hashlib.sha256(own[s:e]).hexdigest() for s, e in zip(rel[:-1].tolist(), rel[1:].tolist())]
        return _rows(DOC, ids, v=mix(ids.astype(np.int64).view(_U)), f=np.diff(rel), whole=sha)

    return lambda batches: _flushed(batches, length, take, _settle, documents)


def _compared(batches, keys: int):
    """Of sorted rows: rows of other kinds than POSITION as they are; of positions their columns, and for the first and
    second key whether the row before, and the row after, has the same."""
    held = None
    for b in batches:
        kind = b.column("kind").to_numpy()
        k = int(np.count_nonzero(kind == POSITION))
        if k < len(kind):
            yield b.slice(k), None, None, None
        if not k:
            continue
        cols = {c: b.column(c).slice(0, k).to_numpy() for c in ("v", "f", "doc", "at", "n")}
        left = [np.zeros(1, bool)] * keys
        if held:
            cols = {c: np.concatenate((held[0][c], x)) for c, x in cols.items()}
            left = held[1]
        names = ("v", "f")[:keys]
        left = [np.concatenate((s, cols[c][1:] == cols[c][:-1])) for s, c in zip(left, names)]
        if len(cols["v"]) > 1:
            yield None, {c: x[:-1] for c, x in cols.items()}, [s[:-1] for s in left], [s[1:] for s in left]
        held = ({c: x[-1:].copy() for c, x in cols.items()}, [s[-1:].copy() for s in left])
    if held:
        yield None, held[0], held[1], [np.zeros(1, bool)] * keys


def _rank_anchors(batches):
    """Hits of equal pairs; marks of runs, or wide cells, whose first rank has several spans."""
    for rest, x, left, right in _compared(batches, 2):
        if rest is not None:
            yield rest
            continue
        (lv, lf), (rv, rf) = left, right
        hit = lv & lf | rv & rf
        yield _hits(x["doc"][hit], x["at"][hit], x["n"][hit])
        go = lv & ~lf | rv & ~rf
        yield _rows(MARK, x["doc"][go], v=_key(x["doc"][go], x["at"][go]))


def _rank(kind: int):
    """Marks or hits of positions that share their rank."""

    def scan(batches):
        for rest, x, left, right in _compared(batches, 1):
            if rest is not None:
                yield rest
                continue
            same = left[0] | right[0]
            doc = x["doc"][same]
            yield _rows(MARK, doc, v=x["f"][same]) if kind == MARK else _hits(doc, x["at"][same], np.ones(len(doc), np.int64))

    return scan


def _picked(marks, where, keys: np.ndarray) -> np.ndarray:
    """Which keys are marked: by a bitset, or by the lists that the rows of texts bring along."""
    if marks is not None:
        return Bits(marks.value).has(keys)
    b, lo, hi = where
    if "marks" not in b.schema.names:
        return np.ones(len(keys), bool)
    return np.isin(keys.view(np.int64), b.column("marks").slice(lo, hi - lo).flatten().to_numpy())


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the range, and value, of each member of ranges."""
    i = np.repeat(np.arange(len(first)), count)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + first[i]


def _cells(row, start, n, anchor, size: int):
    """Runs, or parts of them, cut into cells: row, first window, number of windows and anchor; and the number of each cell."""
    low = (anchor - start - n + 1) // size
    i, j = _expand(low, (anchor - start) // size - low + 1)
    first = np.maximum(start[i], anchor[i] - (j + 1) * size + 1)
    stop = np.minimum(start[i] + n[i], anchor[i] - j * size + 1)
    return (row[i], first, stop - first, anchor[i]), j


def _size(most: int, length: int) -> int:
    return min(most, length - min(SEED, length) + 1)


def _followed(length: int, where, ids, rel, runs, sizes, marks):
    """The marked runs, cut into cells of each of sizes of which the marked ones go on. marks: bitsets of runs and of each
    size of cells; without one all go on, or, at the last, those that the rows of texts bring along."""
    parts = runs[1:]
    for k, held in enumerate(marks):
        if k:
            parts, _ = _cells(*parts, _size(sizes[k - 1], length))
        if held is not None or k == len(marks) - 1:
            go = _picked(held, where, _key(ids[parts[0]], parts[1] - rel[parts[0]]))
            parts = tuple(x[go] for x in parts)
    return parts


def _core(hashes: SpanHash, anchor: np.ndarray, j: np.ndarray, size: int, length: int) -> np.ndarray:
    return mix(_pair(hashes, anchor - j * size, length - size + 1) + j.astype(_U))


def _wide(length: int, marks):
    """Wide cells of marked runs."""
    size = _size(WIDE, length)

    def take(where, ids, own, rel, hashes, runs):
        (row, first, n, anchor), j = _cells(*_followed(length, where, ids, rel, runs, (), [marks]), size)
        return _core(hashes, anchor, j, size, length), hashes.of(first, first + n + length - 1), ids[row], first - rel[row], n

    return lambda batches: _flushed(batches, length, take, _settle)


def _cores(length: int, *marks):
    """Cells of marked runs, or of their wide cells if there are marks of these, too."""
    size = _size(CELL, length)

    def take(where, ids, own, rel, hashes, runs):
        (row, first, _, anchor), j = _cells(*_followed(length, where, ids, rel, runs, (WIDE,), marks), size)
        return _core(hashes, anchor, j, size, length), _key(ids[row], first - rel[row]), ids[row]

    def settle(v, key, doc):
        _, first, back, count = np.unique(v, return_index=True, return_inverse=True, return_counts=True)
        sure = count[back] > 1
        yield _rows(MARK, doc[sure], v=key[sure])
        yield _rows(POSITION, doc[first], v=v[first], f=key[first])

    return lambda batches: _flushed(batches, length, take, settle)


def _windows(length: int, *marks):
    """Windows of marked cells. marks: of runs, of wide cells if there are such, and of cells."""
    sizes = (WIDE, CELL)[-len(marks) + 1 :]

    def take(where, ids, own, rel, hashes, runs):
        row, first, n, _ = _followed(length, where, ids, rel, runs, sizes, marks)
        k, w = _expand(first, n)
        r = row[k]
        return _pair(hashes, w, length), ids[r], w - rel[r]

    def settle(v, doc, at):
        _, first, back, count = np.unique(v, return_index=True, return_inverse=True, return_counts=True)
        sure = count[back] > 1
        yield _hits(doc[sure], at[sure], np.ones(int(sure.sum()), np.int64))
        yield _rows(POSITION, doc[first], v=v[first], at=at[first])

    return lambda batches: _flushed(batches, length, take, settle)


def _cover(length: int):
    """Of hits in order of (doc, at) each document's removed byte spans."""

    def emit(doc, start, end):
        new = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        cut = pa.array(np.append(new, len(doc)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.ListArray.from_arrays(cut, pa.array(start)), pa.ListArray.from_arrays(cut, pa.array(end))], ["doc_id", "starts", "ends"])

    def scan(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            doc, start = b.column("doc").to_numpy(), b.column("at").to_numpy().astype(np.int64)
            end = start + b.column("n").to_numpy() - 1 + length
            if held:
                doc, start, end = (np.concatenate(x) for x in zip(held, (doc, start, end)))
            base = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1]))) << 40  # documents one after another
            reach = np.maximum.accumulate(base + end)
            first = np.flatnonzero(np.concatenate(([True], base[1:] + start[1:] > reach[:-1])))
            last = np.append(first[1:], len(doc)) - 1
            doc, start, end = doc[first], start[first], (reach - base)[last]
            open_ = int(np.searchsorted(base[first], base[-1]))  # the last document may go on
            if open_:
                yield emit(doc[:open_], start[:open_], end[:open_])
            held = (doc[open_:].copy(), start[open_:].copy(), end[open_:].copy())
        if held:
            yield emit(*held)

    return scan


def _marked(docs: DataFrame, rows: DataFrame):
    """The texts to read for marked positions, and the marks as a broadcast bitset; or, if there are too many for one,
    None, and each text that has marks with a list of them."""
    marks = rows.where(F.col("kind") == MARK).select("doc", "v")
    held = Bits.of(marks.select(F.col("v").alias("h")), marks.count())
    if held is not None:
        return docs, docs.sparkSession.sparkContext.broadcast(held)
    own = marks.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("v").alias("marks"))
    return docs.join(own, F.col("doc_id") == F.col("_doc")).drop("_doc"), None


def repeated_spans(docs: DataFrame, length: int = 200) -> tuple[DataFrame, DataFrame]:
    """Two frames: of each document (doc_id, n_bytes, whole: sha256 of its text), and of those that hold
    repeated strings (doc_id, starts, ends): the byte spans covered by strings of `length` bytes that also
    start elsewhere, in the same document or another.

    Null texts are empty; texts under `length` bytes hold none; rows with a null doc_id are left out; doc_id
    must be unique, and rows of equal texts are copies of each other. Further columns are ignored."""
    spark = docs.sparkSession
    docs = texts(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text"))
    scratch = Scratch(spark)
    rank = lambda take, scan: in_order(mapped(take[0], take[1], _ROWS), ["v"], ["kind", "v", "f"], scan, _ROWS)
    one = scratch.keep(rank((docs, _anchors(length)), _rank_anchors), "anchors")
    some, runs = _marked(docs, one)
    two = scratch.keep(rank((some, _wide(length, runs)), _rank_anchors), "wide")
    some, wide = _marked(docs, two)
    three = scratch.keep(rank((some, _cores(length, runs, wide)), _rank(MARK)), "cores")
    some, cells = _marked(docs, three)
    four = rank((some, _windows(length, runs, wide, cells)), _rank(HIT))
    hits = one.union(two).union(four).where(F.col("kind") == HIT).select("doc", "at", "n")
    spans = scratch.keep(in_order(hits, ["doc"], ["doc", "at"], _cover(length), "doc_id long, starts array<long>, ends array<long>"), "spans")
    scratch.drop("wide")
    scratch.drop("cores")
    return one.where(F.col("kind") == DOC).select(F.col("doc").alias("doc_id"), F.col("f").alias("n_bytes"), "whole"), spans


def _left(text: str, starts, ends) -> tuple[list[bytes], int]:
    raw, at, kept = text.encode(), 0, []
    for s, e in zip(starts, ends):
        kept.append(raw[at:s])
        at = e
    return [*kept, raw[at:]], len(raw)


def digests(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document; see repeated_spans().
    Rows that repeat a doc_id are documents of their own."""
    rows, given = own_keys(docs.where("doc_id is not null"))
    d = _digests(rows, length)
    if given:
        d = d.join(rows.select("doc_id", given), "doc_id").select(F.col(given).cast("long").alias("doc_id"), *d.columns[1:])
    return d


def _digests(docs: DataFrame, length: int) -> DataFrame:
    own, spans = repeated_spans(docs, length)
    docs = texts(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text"))

    def cut(batches):
        for b in batches:
            n, k, sha = [], [], []
            for t, s, e in zip(b.column("text").to_pylist(), b.column("starts").to_pylist(), b.column("ends").to_pylist()):
                h = hashlib.sha256()
                for piece in _left(t, s, e)[0]:
                    h.update(piece)
                n.append(sum(e) - sum(s))
                k.append(len(s))
                sha.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_removed", "n_spans", "kept"])

    some = mapped(parted(docs, spans)[0].join(spans, "doc_id"), cut, "doc_id long, n_removed long, n_spans long, kept string")
    zero = F.lit(0).cast("long")
    return own.join(some, "doc_id", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """The documents, with all columns, less the bytes of repeated strings; where that cuts a character, its
    other bytes go too. n_chars, if there is such a column, is counted anew. Documents that nothing is left of
    are dropped. Rows that repeat a doc_id, or have none, are documents of their own."""
    names = docs.columns
    docs, given = own_keys(docs)
    _, spans = repeated_spans(docs, length)
    columns, schema = docs.columns, docs.schema

    def cut(batches):
        for b in batches:
            text = [x if s is None else b"".join(_left(x or "", s, e)[0]).decode(errors="ignore") for x, s, e in zip(b.column("text").to_pylist(), b.column("starts").to_pylist(), b.column("ends").to_pylist())]
            gone = [s is not None and not x for x, s in zip(text, b.column("starts").to_pylist())]
            i = b.schema.get_field_index("text")
            b = b.set_column(i, "text", pa.array(text, b.schema.field("text").type))
            if "n_chars" in columns:
                i, kind = b.schema.get_field_index("n_chars"), b.schema.field("n_chars").type
                own = [n if s is None else len(x) for n, x, s in zip(b.column("n_chars").to_pylist(), text, b.column("starts").to_pylist())]
                b = b.set_column(i, "n_chars", pa.array(own, kind))
            yield b.filter(pa.array([not g for g in gone], pa.bool_())).select(columns)

    some, rest = parted(docs, spans)
    changed = mapped(some.join(spans.select(F.col("doc_id").alias("_d"), "starts", "ends"), F.col("doc_id") == F.col("_d"), "left").select(*columns, "starts", "ends"), cut, schema)
    return with_given(changed if rest is None else changed.unionByName(rest), given, names)
