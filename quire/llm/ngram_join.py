"""N-gram Jaccard join by a prefix tree over globally ordered sets.

1. Every text becomes its set of word n-grams (64-bit hashes). Equal sets are one class.
2. Global order: n-grams of a single class come first, then shared ones by the number of classes that have
   them, so prefixes are selective. N-grams are counted over all texts, in the lower part of the hash range
   only, which holds enough of them for the prefixes; the rest come last, by hash. (Copies that two mappers
   see count twice; any order gives the same links, only the work differs.)
3. Two sets that are similar enough share an n-gram within their prefixes (as many n-grams as the
   threshold lets one set miss, and one more). A class whose prefix holds n-grams of its own only is done.
   The others are connected where prefixes share an n-gram, first within each mapper's chunk, then over all;
   so a very common n-gram costs one row a chunk.
4. The sets of each connected group go into prefix trees. A set is looked up by one walk that shares the
   overlap of common beginnings and leaves a subtree when what is missing, or what remains, can't reach
   the threshold. A subtree whose sets all belong to the set's component already is skipped: links are
   only needed to connect. Large groups are cut into blocks of similar sizes: each block is joined with itself, and,
   in a task of its own, with each other block of sizes that can be similar, across only.
5. Components of the links found.

Nothing is capped: links are those of the exact Jaccard similarity, up to collisions of 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.llm.common import Bits, Scratch, bucket_bits, buffers, chunks, components, grouped, high_bits, mapped, mix, pack, release, texts
from quire.llm.shingles import set_hash, shingle_sets

#: n-grams are counted in this many times the part of the hash range that a prefix takes of a set.
COUNTED = 2.4
#: Shingles of a block: an eighth of its group's, but between these.
LEAST_TOKENS, BLOCK_TOKENS = 1 << 16, 1 << 20
#: Sets looked up between two layouts of a tree; children from which a node is laid out.
BATCH, WIDE = 64, 16
#: Records a mapper gathers before it sends them.
FLUSH = 1 << 19

_U = np.uint64
_PAIR = np.dtype([("token", "<u8"), ("cls", "<i8")])
_SEEN = np.dtype([("token", "<u4"), ("local", "<u4")])
_SEEN8 = np.dtype([("token", "<u8"), ("local", "<u4")])
_COUNTED = np.dtype([("token", "<u8"), ("local", "<u4"), ("df", "<u4")])
_CLASS = np.dtype([("cls", "<i8"), ("size", "<u4"), ("counted", "<u4"), ("prefix", "<u4")])


def _sets(batch, sets):
    """sets: of offsets and bytes, each text's sorted distinct members as 64-bit hashes."""
    off, data = buffers(batch.column("text"))
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    for lo, hi in chunks(off):
        yield ids[lo:hi], list(sets(off[lo : hi + 1], data))


def prefix_length(size: int, num: int, den: int) -> int:
    """Sets of this size that are similar to another share one of so many first members:
    the overlap is at least size * num / den."""
    return size - -(-size * num // den) + 1


def _read(docs: DataFrame, sets, num: int, den: int, bits: int) -> DataFrame:
    """One scan of the texts. Rows of documents: doc_id, size, cls. Rows of n-grams: bucket, flush, data with
    a _SEEN record for each counted n-gram of each class of a flush. Rows of classes: flush, data with a
    _CLASS record for each and in more the uncounted n-grams its prefix may reach."""
    top = _U(min(int(COUNTED * (den - num) / den * 2**64), 2**64 - 1))

    def scan(batches):
        part = TaskContext.get().partitionId()
        number, ids, sizes, clss, held, classes, more, known, size = 0, [], [], [], [], [], [], {}, 0

        def flush():
            h = np.concatenate([x for x, _ in held]) if held else np.zeros(0, _U)
            v = np.empty(len(h), _SEEN)
            v["token"] = ((h << _U(bits)) >> _U(32)).astype("<u4")
            v["local"] = np.concatenate([np.full(len(x), i, "<u4") for x, i in held]) if held else 0
            rows = pack(v, high_bits(h, bits), 1 << bits)
            own = np.array(classes, _CLASS) if classes else np.zeros(0, _CLASS)
            k, m, name = len(ids), len(rows), part << 32 | number
            cols = {
                "bucket": pa.array([None] * k + [r[0] for r in rows] + [-1], pa.int32()),
                "flush": pa.array([None] * k + [name] * (m + 1), pa.int64()),
                "data": pa.array([None] * k + [r[1] for r in rows] + [own.tobytes()], pa.binary()),
                "more": pa.array([None] * (k + m) + [(np.concatenate(more) if more else np.zeros(0, _SEEN8)).tobytes()], pa.binary()),
                "doc_id": pa.array(ids + [None] * (m + 1), pa.int64()),
                "n_shingles": pa.array(sizes + [None] * (m + 1), pa.int64()),
                "cls": pa.array(clss + [None] * (m + 1), pa.int64()),
            }
            return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

        for b in batches:
            for own_ids, got in _sets(b, sets):
                for doc, x in zip(own_ids.tolist(), got):
                    c = set_hash(x)
                    ids.append(doc)
                    sizes.append(len(x))
                    clss.append(c)
                    if not len(x) or c in known:
                        continue
                    known[c] = i = len(classes)
                    p, low = prefix_length(len(x), num, den), int(np.searchsorted(x, top))
                    classes.append((c, len(x), low, p))
                    held.append((x[:low], i))
                    if p > low:
                        y = np.empty(p - low, _SEEN8)
                        y["token"], y["local"] = x[low:p], i
                        more.append(y)
                    size += low
                if size >= FLUSH or len(ids) >= FLUSH >> 4:
                    yield flush()
                    number, ids, sizes, clss, held, classes, more, known, size = number + 1, [], [], [], [], [], [], {}, 0
        if ids:
            yield flush()

    return mapped(texts(docs), scan, "bucket int, flush long, data binary, more binary, doc_id long, n_shingles long, cls long")


def _shared(bits: int):
    """Of one bucket, the n-grams that more than one class record has, with their counts, by flush."""

    def count(key, t):
        bucket = key[0].as_py()
        data = t.column("data").to_pylist()
        v = np.frombuffer(b"".join(data), _SEEN)
        flush = np.repeat(t.column("flush").to_numpy(), [len(x) // _SEEN.itemsize for x in data])
        order = np.argsort(v["token"], kind="stable")
        v, flush = v[order], flush[order]
        edge = np.flatnonzero(np.concatenate(([True], v["token"][1:] != v["token"][:-1])))
        df = np.diff(np.append(edge, len(v)))
        df = np.repeat(df, df)
        keep = df > 1
        out = np.empty(int(keep.sum()), _COUNTED)
        out["token"] = v["token"][keep].astype(_U) | _U(bucket << 32)
        out["local"], out["df"], flush = v["local"][keep], df[keep], flush[keep]
        order = np.argsort(flush, kind="stable")
        out, flush = out[order], flush[order]
        at = np.flatnonzero(np.concatenate(([True], flush[1:] != flush[:-1]))) if len(flush) else np.zeros(0, int)
        end = np.append(at[1:], len(flush))
        return pa.table({"flush": pa.array(flush[at], pa.int64()), "data": pa.array([out[a:b].tobytes() for a, b in zip(at, end)], pa.binary())})

    return count


def _star(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (token, cls) in order, and the distinct pairs of each class with its token's first class."""
    v = v[np.lexsort((v["cls"], v["token"]))]
    new = np.concatenate(([True], v["token"][1:] != v["token"][:-1])) if len(v) else np.zeros(0, bool)
    lead = np.flatnonzero(new)
    a, b = v["cls"], np.repeat(v["cls"][lead], np.diff(np.append(lead, len(v))))
    a, b = a[a != b], b[a != b]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    return v[lead], np.stack([a[keep], b[keep]], 1)


def _prefixes(bits: int):
    """Of one flush: prefix members that other classes may have, by bucket, and pairs of classes that share
    one within the flush. Global order: counted n-grams of one class only, counted ones by count and token,
    the rest by hash. A class whose prefix holds only n-grams of its own has no partner."""

    def spread(key, left, right):
        out = []
        for data, more in zip(left.column("data").to_pylist(), left.column("more").to_pylist()):
            own, extra = np.frombuffer(data, _CLASS), np.frombuffer(more, _SEEN8)
            got = np.frombuffer(b"".join(right.column("data").to_pylist()), _COUNTED)
            got = got[np.lexsort((got["token"], got["df"], got["local"]))]
            has = np.bincount(got["local"], minlength=len(own))
            need = own["prefix"].astype(np.int64) - (own["counted"] - has)  # after the n-grams of its own
            nth = np.arange(len(got)) - np.repeat(np.cumsum(has) - has, has)
            take = got[nth < need[got["local"]]]
            v = np.empty(len(take), _PAIR)
            v["token"], v["cls"] = take["token"], own["cls"][take["local"]]
            # an n-gram that isn't counted has the first bit set, and so never meets a counted one
            w = np.empty(len(extra), _PAIR)
            w["token"], w["cls"] = extra["token"] | _U(1 << 63), own["cls"][extra["local"]]
            out += [v, w]
        lead, x = _star(np.concatenate(out) if out else np.zeros(0, _PAIR))
        rows = pack(lead, high_bits(mix(lead["token"]), bits), 1 << bits)
        return pa.table({
            "bucket": pa.array([r[0] for r in rows] + [-1] * len(x), pa.int32()),
            "data": pa.array([r[1] for r in rows] + [None] * len(x), pa.binary()),
            "a": pa.array([None] * len(rows) + x[:, 0].tolist(), pa.int64()),
            "b": pa.array([None] * len(rows) + x[:, 1].tolist(), pa.int64()),
        })

    return spread


def _meet(key, t):
    _, x = _star(np.frombuffer(b"".join(t.column("data").to_pylist()), _PAIR))
    return pa.table({"a": pa.array(x[:, 0], pa.int64()), "b": pa.array(x[:, 1], pa.int64())})


class Trie:
    """A path-compressed prefix tree of sets, each an increasing array of ranks."""

    def __init__(self, size: int):
        self.parent = list(range(size))
        self.root = [np.zeros(0, np.int32), {}, None, 0, -1, None]  # ranks of the edge, children, set that ends here, longest rest below, one set below or -2, children side by side

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)

    def _one(self, node: list, i: int) -> None:
        if node[4] == -1:
            node[4] = i
        elif node[4] >= 0 and self.find(node[4]) != self.find(i):
            node[4] = -2

    def insert(self, ranks: np.ndarray, i: int) -> None:
        node, at = self.root, 0
        while True:
            self._one(node, i)
            node[3] = max(node[3], len(ranks) - at)
            if at == len(ranks):
                node[2] = (*(node[2] or ()), i)
                return
            child = node[1].get(int(ranks[at]))
            if child is None:
                node[1][int(ranks[at])] = [ranks[at:], {}, (i,), 0, i, None]
                return
            edge = child[0]
            m = min(len(edge), len(ranks) - at)
            diff = np.flatnonzero(edge[:m] != ranks[at : at + m])
            same = int(diff[0]) if len(diff) else m
            if same < len(edge):  # the edge is cut in two
                lower = [edge[same:], child[1], child[2], child[3], child[4], None]
                child[0], child[1], child[2], child[3] = edge[:same], {int(edge[same]): lower}, None, child[3] + len(edge) - same
            node, at = child, at + same

    def freeze(self) -> None:
        """Lays the children of wide nodes side by side, so that a walk measures them at once."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            kids = list(node[1].values())
            stack += kids
            if len(kids) > WIDE:
                size = np.array([len(k[0]) for k in kids])
                node[5] = (kids, np.concatenate([k[0] for k in kids]), np.cumsum(size) - size, size, np.array([k[0][-1] for k in kids]), np.array([k[3] for k in kids]))
            else:
                node[5] = None

    def link(self, ranks: np.ndarray, i: int, mask: np.ndarray, sizes: list[int], num: int, den: int, links: list) -> None:
        """Unites i with every set of the tree that is similar enough and not yet in its component."""
        n, find = len(ranks), self.find
        mask[ranks] = True
        # after a path of d members of which o are in the set, the pair has at least d + n - o members and
        # at most o + min(rest below, those of the set beyond the path) in common
        stack = [(self.root, 0, 0)]
        while stack:
            node, d, o = stack.pop()
            if node[4] >= 0 and find(node[4]) == find(i):
                continue
            if node[2]:
                for j in node[2]:
                    if find(j) != find(i) and den * o >= num * (n + sizes[j] - o):
                        self.union(i, j)
                        links.append((i, j))
            if node[5]:
                kids, edges, at, size, last, rest = node[5]
                both = o + np.add.reduceat(mask[edges], at, dtype=np.int64)
                most = both + np.minimum(rest, n - np.searchsorted(ranks, last, "right"))
                go = np.flatnonzero(den * most >= num * (d + size + n - both))
                stack += [(kids[k], d + int(size[k]), int(both[k])) for k in go.tolist()]
                continue
            for child in node[1].values():
                edge = child[0]
                both = o + int(np.count_nonzero(mask[edge]))
                most = both + min(child[3], n - int(ranks.searchsorted(edge[-1], "right")))
                if den * most >= num * (d + len(edge) + n - both):
                    stack.append((child, d + len(edge), both))
        mask[ranks] = False


def linked(sets: list[np.ndarray], num: int, den: int, left: int = 0) -> list[tuple[int, int]]:
    """Links (i, j) of positions that connect all sets of a Jaccard similarity of num / den or more; with left, all such
    pairs of one of the first `left` sets and one of the others."""
    if len(sets) < 2:
        return []
    every = np.concatenate(sets)
    members, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.empty(len(members), np.int32)
    rank[np.lexsort((members, -count))] = np.arange(len(members))
    ranked, at = rank[inverse], 0
    sizes = [len(s) for s in sets]
    parts = []
    for k in sizes:
        parts.append(np.sort(ranked[at : at + k]))
        at += k
    key = lambda i: (sizes[i], parts[i].tobytes())
    whole, mask, links = Trie(len(sets)), np.zeros(len(members), bool), []
    if left:
        for i in sorted(range(left), key=key):
            whole.insert(parts[i], i)
        whole.freeze()
        for i in sorted(range(left, len(sets)), key=key):
            whole.link(parts[i], i, mask, sizes, num, den, links)
        return links
    order = sorted(range(len(sets)), key=key)
    for a in range(0, len(order), BATCH):
        # a batch meets the tree of those before it, then its own
        some = order[a : a + BATCH]
        for i in some if a else ():
            whole.link(parts[i], i, mask, sizes, num, den, links)
        own = Trie(0)
        own.parent = whole.parent
        for i in some:
            own.link(parts[i], i, mask, sizes, num, den, links)
            own.insert(parts[i], i)
        if a + BATCH < len(order):
            for i in some:
                whole.insert(parts[i], i)
            whole.freeze()
    return links


def _verified(spark, scratch: Scratch, docs: DataFrame, groups: DataFrame, sets, linked, num: int, den: int) -> DataFrame:
    """Links (a, b) of classes, found by linked() in blocks. groups: (node, label). A bitset of the classes wanted
    keeps other sets out of the shuffle, as long as one is small enough."""
    chosen = Bits.of(groups.select(F.col("node").alias("h")), groups.count())
    sent = spark.sparkContext.broadcast(chosen) if chosen is not None else None

    def pick(batches):
        want = Bits(sent.value) if sent else None
        for b in batches:
            for _, got in _sets(b, sets):
                cls = np.array([set_hash(x) for x in got], np.int64)
                seen: set[int] = set()
                rows = np.flatnonzero(want.has(cls)) if want else np.arange(len(cls))
                rows = [k for k in rows.tolist() if len(got[k]) and not (int(cls[k]) in seen or seen.add(int(cls[k])))]
                yield pa.RecordBatch.from_arrays([pa.array(cls[rows], pa.int64()), pa.array([len(got[k]) for k in rows], pa.int32()), pa.array([got[k].tobytes() for k in rows], pa.binary())], ["cls", "size", "members"])

    found = mapped(texts(docs), pick, "cls long, size int, members binary")
    sets = found.join(groups, found.cls == groups.node).groupBy("cls").agg(F.min("label").alias("label"), F.min("size").alias("size"), F.first("members").alias("members"))
    sets = scratch.keep(sets, "sets")
    # a group's sets in order of size, cut into blocks by a running sum over its sizes
    per = sets.groupBy("label", "size").agg(F.count("*").alias("k"))
    group = Window.partitionBy("label")
    run = group.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.col("k") * F.col("size")
    block = F.least(F.lit(BLOCK_TOKENS), F.greatest(F.lit(min(LEAST_TOKENS, BLOCK_TOKENS)), F.sum(tokens).over(group) / 8))
    placed = per.withColumn("before", F.coalesce(F.sum(tokens).over(run), F.lit(0))).withColumn("block", block)
    # within one size the sets are spread by hash over as many blocks as that size needs
    placed = placed.select(F.col("label").alias("l"), F.col("size").alias("s"), F.floor(F.col("before") / F.col("block")).alias("lo"), F.floor((F.col("before") + tokens - 1) / F.col("block")).alias("hi"))
    dealt = sets.join(placed, (sets.label == placed.l) & (sets["size"] == placed.s)).select("label", "size", "cls", "members", (F.col("lo") + F.pmod(F.xxhash64("cls"), F.col("hi") - F.col("lo") + 1)).alias("block"))
    span = dealt.groupBy("label", "block").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    x, y = span.alias("x"), span.alias("y")
    pairs = x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.block") <= F.col("y.block")) & (F.col("x.most") * den >= F.col("y.least") * num))
    pairs = pairs.select(F.col("x.label").alias("l"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    sides = pairs.select("l", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("own"))
    rows = dealt.join(sides, (dealt.label == sides.l) & (dealt.block == sides.own)).select("l", "i", "j", (F.col("own") != F.col("i")).alias("right"), "cls", "members")

    def walk(key, t):
        t = t.sort_by("right") if key[1] != key[2] else t
        cls = t.column("cls").to_numpy()
        got = [np.frombuffer(m, _U) for m in t.column("members").to_pylist()]
        across = key[1] != key[2]
        left = len(got) - pc.sum(t.column("right")).as_py() if across else 0
        found = linked(got, num, den, left) if not across or 0 < left < len(got) else []
        del got
        release()
        return pa.table({"a": pa.array([int(cls[i]) for i, _ in found], pa.int64()), "b": pa.array([int(cls[j]) for _, j in found], pa.int64())})

    return rows.groupBy("l", "i", "j").applyInArrow(walk, "a long, b long")


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents connected by links den * |A and B| >= num * |A or B|.

    docs: doc_id (unique integers) and text; further columns are ignored. Null and empty texts and texts
    without words have the empty set, no link and themselves as component. Rows with a null doc_id are left
    out. Repeated rows of a doc_id count once. An empty table gives an empty result."""
    return components_of(docs, lambda off, data: shingle_sets(off, data, n), linked, num, den)


def components_of(docs: DataFrame, sets, linked, num: int, den: int) -> DataFrame:
    """jaccard_components() of any sets of texts. sets: see _sets(); linked(sets, num, den): positions (i, j) of links
    that connect all similar sets of a block."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    scratch = Scratch(spark)

    bits = bucket_bits(spark)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    read = scratch.keep(_read(docs, sets, num, den, bits), "read")
    own = read.where("doc_id is not null").select("doc_id", "n_shingles", "cls")
    shared = grouped(read.where("bucket >= 0").select("bucket", "flush", "data"), "bucket", _shared(bits), "flush long, data binary")
    chunk = read.where("bucket = -1").select("flush", "data", "more")
    spread = chunk.groupBy("flush").cogroup(shared.groupBy("flush")).applyInArrow(_prefixes(bits), "bucket int, data binary, a long, b long")
    spread = scratch.keep(spread, "prefixes")
    near = spread.where("bucket = -1").select("a", "b").union(grouped(spread.where("bucket >= 0"), "bucket", _meet, "a long, b long"))
    groups = components(spark, scratch, near, "candidates")
    scratch.drop("prefixes")
    links = scratch.keep(_verified(spark, scratch, docs, groups, sets, linked, num, den), "links")
    scratch.drop("sets")
    comp = components(spark, scratch, links, "linked")
    # the smallest doc_id of each class, then of each component of classes
    classes = own.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    classes = classes.join(comp, classes.cls == comp.node, "left").select("cls", "least", F.coalesce("label", "cls").alias("label"))
    roots = classes.groupBy("label").agg(F.min("least").alias("root"))
    roots = classes.join(roots, "label").select("cls", "root")
    out = own.join(roots, "cls", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id")).alias("component_id"))
    own = scratch.keep(out.dropDuplicates(["doc_id"]), "components")
    scratch.drop("read", "links")
    return own
