"""Training-data operators against brute force on small and odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow.compute  # noqa: F401
import pytest

from quire.llm import chat, common, langid, mixing, ngram_join, packing, sharding, spotsigs, style_tree, suffix_dedup, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _part string, row int, n int, label string"


@pytest.fixture(scope="module")
def table(spark):
    """Copies, near copies, shared passages, null, empty, blank, repetitive and long texts, and clashing columns."""
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 7))) for _ in range(300)]
    say = lambda k: " ".join(r.choices(words, k=k))
    base, passage = say(120), say(60)
    texts = [base, base, base.replace(" ", "  ", 1), base + " mehr", " ".join(base.split()[:110]), say(40) + " " + passage + " " + say(30), passage + "\n" + say(50), None, "", "   \n", "ab" * 400, "é" * 99 + "q" * 300 + "é" * 99, "x y", "X Y", "x y z", say(6000), "123 456", base.upper()]
    texts += [say(r.randint(1, 150)) for _ in range(20)]
    rows = [(3 * i, t, ("en", "fr", None)[i % 3], (None, "a", "b", "")[i % 4], 0, "p", 1, 2, "l") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def plain(table):
    return {r["doc_id"]: r["text"] or "" for r in table.collect()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(plain, n, num, den):
    sets, up = {}, {i: i for i in plain}
    for i, t in plain.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in product(sorted(plain), repeat=2):
        if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: (len(sets[i]), find(i)) for i in plain}


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 80, 100), (1, 30, 100)])
def test_ngram_join(table, plain, n, num, den):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(table, n, num, den).collect()}
    assert got == brute_components(plain, n, num, den)


def test_ngram_join_of_few_words(spark):
    got = ngram_join.jaccard_components(spark.createDataFrame([(1, "a"), (2, " A"), (3, "c")], "doc_id long, text string").coalesce(1), 5, 80, 100)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {1: 1, 2: 1, 3: 3}


def test_trie_links_as_all_pairs():
    r = np.random.default_rng(0)
    for _ in range(20):
        sets = [np.unique(r.integers(0, 30, r.integers(1, 20)).astype(np.uint64)) for _ in range(150)]
        got, want = list(range(150)), list(range(150))

        def root(up, x):
            while up[x] != x:
                x = up[x]
            return x

        for side in (ngram_join, spotsigs):
            cut = side.linked(sets[:60], 60, 100) + [(i + 60, j + 60) for i, j in side.linked(sets[60:], 60, 100)] + side.linked(sets, 60, 100, 60)
            ends = []
            for links in (cut, side.linked(sets, 60, 100)):
                got = list(range(150))
                for i, j in links:
                    a, b = sorted((root(got, i), root(got, j)))
                    got[b] = a
                ends.append([root(got, i) for i in range(150)])
            assert ends[0] == ends[1]
        for i in range(150):
            for j in range(i):
                k = len(np.intersect1d(sets[i], sets[j]))
                if 100 * k >= 60 * (len(sets[i]) + len(sets[j]) - k):
                    a, b = sorted((root(want, i), root(want, j)))
                    want[b] = a
        assert [root(got, i) for i in range(150)] == [root(want, i) for i in range(150)]


def test_suffix_dedup(table, plain):
    count = Counter(b[s : s + 200] for b in (t.encode() for t in plain.values()) for s in range(len(b) - 199))
    for r in suffix_dedup.digests(table).collect():
        b = plain[r["doc_id"]].encode()
        gone = np.zeros(len(b) + 2, bool)
        for s in range(len(b) - 199):
            if count[b[s : s + 200]] > 1:
                gone[s + 1 : s + 201] = True
        kept = bytes(x for x, g in zip(b, gone[1:]) if not g)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())


def dedup_in_process(texts, length, batch=3):
    """The three lengths of suffix dedup without Spark: scans of batches, rows sorted as Spark would."""
    import pyarrow as pa

    docs = [pa.RecordBatch.from_pydict({"doc_id": pa.array(range(i, min(i + batch, len(texts))), pa.int64()), "text": texts[i : i + batch]}) for i in range(0, len(texts), batch)]

    def dealt(scan, rank):
        rows = pa.Table.from_batches([b for part in (docs[::2], docs[1::2]) for b in scan(iter(part))], pa.schema([("kind", pa.int8()), ("v", pa.int64()), ("f", pa.int64()), ("doc", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("whole", pa.string())]))
        rows = rows.sort_by([("kind", "ascending"), ("v", "ascending"), ("f", "ascending")])
        return pa.Table.from_batches(list(rank(iter(rows.to_batches(max_chunksize=7)))), rows.schema)

    class Sent:
        def __init__(self, rows):
            marks = rows.filter(pa.compute.equal(rows["kind"], suffix_dedup.MARK))["v"].to_numpy()
            bits = np.zeros(1 << 16, np.uint8)
            bits[marks.view(np.uint64) & np.uint64((1 << 16) - 1)] = 1
            self.value = np.packbits(bits, bitorder="little").tobytes()

    one = dealt(suffix_dedup._anchors(length), suffix_dedup._rank_anchors)
    two = dealt(suffix_dedup._cores(length, Sent(one)), suffix_dedup._rank(suffix_dedup.MARK))
    three = dealt(suffix_dedup._windows(length, Sent(one), Sent(two)), suffix_dedup._rank(suffix_dedup.HIT))
    hits = pa.concat_tables([x.filter(pa.compute.equal(x["kind"], suffix_dedup.HIT)).select(["doc", "at", "n"]) for x in (one, three)]).sort_by([("doc", "ascending"), ("at", "ascending")])
    spans = [b for b in suffix_dedup._cover(length)(iter(hits.to_batches(max_chunksize=5)))]
    return {d: list(zip(s, e)) for b in spans for d, s, e in zip(*[b.column(c).to_pylist() for c in ("doc_id", "starts", "ends")])}


def test_cells_inside_repeated_strings_are_done_as_a_whole(spark, monkeypatch):
    """A long passage at two odd places costs a few cells where it ends, not each of its windows; the result is that of all
    windows, also where marks don't fit a bitset."""
    from quire.llm import common

    rng = np.random.default_rng(5)
    some = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    passages = [some(1000) for _ in range(20)]
    texts = [some(int(rng.integers(0, 300))) + passages[i % 20] + some(int(rng.integers(0, 300))) for i in range(60)] + [passages[0][:231], passages[1][100:340] * 2, "", "x" * 500]
    want, sent, windows = brute_spans(texts, 200), [], suffix_dedup._windows

    def counted(*given):
        scan = windows(*given)

        def run(batches):
            for b in scan(batches):
                acc.add(int(np.count_nonzero(b.column("kind").to_numpy() == suffix_dedup.POSITION)))
                yield b

        return run

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(suffix_dedup, "_windows", counted)
    monkeypatch.setattr(suffix_dedup, "FLUSH", 1)  # nothing is settled before it is dealt out
    for most in (common.MOST_BITS, 3):
        monkeypatch.setattr(common, "MOST_BITS", most)
        acc = spark.sparkContext.accumulator(0)
        got = {r["doc_id"]: list(zip(r["starts"], r["ends"])) for r in suffix_dedup.repeated_spans(df)[1].collect()}
        assert got == want
        sent.append(acc.value)
    ends = 2 * 63  # of passages
    assert max(sent) <= ends * 24, sent


def brute_spans(texts, length):
    raw = [t.encode() for t in texts]
    count = Counter(b[s : s + length] for b in raw for s in range(len(b) - length + 1))
    out = {}
    for i, b in enumerate(raw):
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                spans = out.setdefault(i, [])
                if spans and s <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], s + length)
                else:
                    spans.append((s, s + length))
    return out


def test_a_bitset_comes_in_one_job(spark):
    """However many shuffle partitions hold its slices: a job each takes minutes at a few hundred of them."""
    held = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    h = [int(x) for x in np.random.default_rng(5).integers(-(1 << 63), 1 << 63, 300)]
    rows = spark.createDataFrame([(x,) for x in h], "h long")
    sc = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup("bitset", "")
        bits = common.Bits(common.Bits.of(rows, len(h)))
        jobs = len(sc.statusTracker().getJobIdsForGroup("bitset"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    assert 0 < jobs <= 5
    low = np.array(h).view(np.uint64) & bits.mask
    assert bits.has(np.array(h)).all() and np.array_equal(bits.has(np.arange(1 << 16)), np.isin(np.arange(1 << 16), low.astype(np.int64)))


@pytest.mark.parametrize("length,flush,hot,chunk", [(200, 50, 1, 300), (200, 1 << 18, 8, 1 << 17), (8, 20, 1, 50), (45, 100, 2, 1000), (1, 10, 8, 20)])
def test_suffix_dedup_lengths(monkeypatch, length, flush, hot, chunk):
    from quire.llm import common

    monkeypatch.setattr(suffix_dedup, "FLUSH", flush)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(common, "CHUNK_BYTES", chunk)
    r = random.Random(length)
    say = lambda k: "".join(r.choices("abcdé ", k=k))
    passage = say(260)
    texts = [say(r.randint(0, 900)) for _ in range(12)] + [say(r.randint(0, 99)) + passage[r.randint(0, 40) :] + say(r.randint(0, 99)) for _ in range(12)] + [passage, passage, "", "aaa" * 200]
    r.shuffle(texts)
    assert dedup_in_process(texts, length) == brute_spans(texts, length)


def test_other_ways_at_scale(spark, table, plain, monkeypatch):
    """Bitsets too large to send, components of more edges than one task takes, and groups of several blocks."""
    from quire.llm import common

    want = sorted(map(tuple, suffix_dedup.digests(table).collect()))
    kept = plain_rows(suffix_dedup.without_repeats(table))
    import corpus_pipeline as cp

    once = plain_rows(cp.near_duplicates(spark, table, ""))
    monkeypatch.setattr(common, "MOST_BITS", 3)
    assert sorted(map(tuple, suffix_dedup.digests(table).collect())) == want
    assert plain_rows(suffix_dedup.without_repeats(table)) == kept
    assert plain_rows(cp.near_duplicates(spark, table, "")) == once
    monkeypatch.setattr(common, "LOCAL_EDGES", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 150)
    monkeypatch.setattr(ngram_join, "LEAST_TOKENS", 10)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(table, 4, 85, 100).collect()}
    assert got == brute_components(plain, 4, 85, 100)


def test_components_of_chains(spark, monkeypatch):
    from quire.llm import common

    monkeypatch.setattr(common, "LOCAL_EDGES", 2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (50, 50)]
    got = common.components(spark, common.Scratch(spark), spark.createDataFrame(edges, "a long, b long").repartition(5), "c").collect()
    assert {x["node"]: x["label"] for x in got if x["node"] != x["label"]} == {i: 0 for i in range(1, 41)} | {95: 90, 100: 90}


def test_packing(table, plain):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    pieces = packing.digests(packing.pack(table, path, 256)).toPandas()
    for i, g in pieces.groupby("doc_id"):
        ids, at = np.array(t.encode(plain[i], add_special_tokens=False).ids + [0], "<u4"), 0
        for p in g.sort_values("start").itertuples():
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    assert set(pieces.doc_id) == set(plain)
    full = pieces.groupby("sequence_id").length.sum().sort_index()
    assert (full.iloc[:-1] == 256).all()
    for _, g in pieces.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == list(g.length.cumsum() - g.length)


def test_encoder_matches_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    odd = ["\n a", "a\n", "\nA b", "a\n\nb", "  x", "it's, 'twas.\nNo? 3,5 a.b...  ", "é. b c", "a  b", "", "x²,", "tab\tx y\r\nz", "<|endoftext|> hi", "日本。 x.", "a b c", "a ́b,"]
    for text, ids in zip(odd, packing.Encoder(path).encode(odd)):
        assert np.frombuffer(ids, "<u2").tolist() == t.encode(text, add_special_tokens=False).ids


def test_hilbert_neighbours_touch():
    cells = np.array(list(product(range(8), repeat=3)))
    key = packing.hilbert(cells, 3)
    assert sorted(key) == list(range(512))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_mixing(table, plain):
    m = mixing.mix(table).toPandas()
    assert sorted(m.doc_id) == sorted(plain)
    assert all(n == len(WORD.findall(plain[i])) for i, n in zip(m.doc_id, m["size"]))
    assert (m.copies <= 3).all() and (m.copies >= 0).all()
    s = m.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"))
    assert abs(s.target.sum() - s["size"].sum()) < 1e-6 * s["size"].sum()
    assert (s.target <= 3 * s["size"] + 1e-6).all()


def test_mixing_against_brute_force(spark):
    """Rates solve each source's dual by bisection; copies are a rate rounded up or down, near the target, and the same
    again."""
    r = random.Random(11)
    rows = [(i, " ".join(["w"] * min(400, int(r.paretovariate(1.1)))), r.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    m = mixing.mix(d).toPandas()
    assert sorted(map(tuple, mixing.mix(d.repartition(2)).select("doc_id", "copies").collect())) == sorted(zip(m.doc_id, m.copies))
    for _, g in m.groupby("source", dropna=False):
        x, target = g["size"] / g["size"].mean(), g.target.iloc[0]
        lo, hi = -60.0, 60.0
        for _ in range(200):
            t = (lo + hi) / 2
            taken = (g["size"] * 3 / (1 + 2 * np.exp(-t * x))).sum()
            lo, hi = (t, hi) if taken < target else (lo, t)
        want = 3 / (1 + 2 * np.exp(-lo * x)) if target < 3 * g["size"].sum() * (1 - 1e-12) else 3 + 0 * x
        assert np.allclose(g.rate, want, atol=1e-5)
        assert ((g.copies >= np.floor(g.rate)) & (g.copies <= np.ceil(g.rate))).all()
        parts = -(-len(g) // mixing.PART)
        assert abs((g["size"] * g.copies).sum() - target) <= parts * g["size"].max() / 2 + 1e-3


def test_targets_by_hand(spark):
    """All combinations of capped sources, by trying each number of them."""
    r = random.Random(12)
    for _ in range(5):
        sizes = {k: r.choice([1, 10, 1000, 0]) * r.randint(1, 9) for k in ["", "a", "b", "c", "é", "Z", None]}
        names = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + [None]
        weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
        level, total = 0.0, sum(sizes.values())
        lo, hi = 0.0, 10.0 * total
        for _ in range(200):
            level = (lo + hi) / 2
            lo, hi = (level, hi) if sum(min(weight[k] * level, 3 * n) for k, n in sizes.items()) < total else (lo, level)
        got = {x["source"]: x["target"] for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert all(abs(got[k] - min(weight[k] * level, 3 * n)) < 1e-6 * total for k, n in sizes.items())


def test_targets(spark):
    rows = [("a", 100), ("b", 1000), ("c", 10), (None, 500)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    # 5, 2, 1, 5 of 1610: a stops at 300, c at 30; the rest is shared 2 to 5
    assert got["a"] == 300 and got["c"] == 30
    assert abs(got["b"] - 1280 * 2 / 7) < 1e-9 and abs(got[None] - 1280 * 5 / 7) < 1e-9


def test_mixing_meets_targets_of_many_documents(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.randint(1, 200), "abcd"[min(3, i % 7)]) for i in range(2000)]
    m = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    m["taken"] = m["size"] * m.copies
    g = m.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(g.taken - g.target) < 0.01 * g.target).all()


def test_sharding(table, plain):
    d = sharding.shard(table, [1.0] * 24).toPandas()
    assert ((d.shard == d.grown_shard) | (d.grown_shard == 24)).all()
    for _, g in d.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert all((n, c) == (len(plain[i].encode()) + 8, zlib.crc32(plain[i].encode())) for i, n, c in zip(d.doc_id, d["size"], d.text_crc32))


def test_sharding_against_brute_force(table, plain):
    """Scores by hashlib and math; slots in parts of two rows."""
    import math

    weights = [1.0, 2.0, 0.0, 1.5]

    def score(key, s, w):
        return -w / math.log((int(hashlib.md5(f"{key}/{s}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52))

    got = {x["doc_id"]: x for x in sharding.shard(table, weights, 2).collect()}
    for i in plain:
        best = max((score(i, s, w), -s) for s, w in enumerate(weights) if w)
        assert got[i]["shard"] == -best[1] and got[i]["grown_shard"] == (4 if score(i, 4, 1.5) > best[0] else -best[1])
    parts = len(plain) // (2 * len(weights)) + 1
    for s in range(4):
        rows = sorted((zlib.crc32(str(i).encode()) % parts, i) for i, x in got.items() if x["shard"] == s)
        assert [got[i]["slot"] for _, i in rows] == list(range(len(rows)))


def test_sharding_weights(spark):
    d = spark.range(20000).selectExpr("id as doc_id", "'x' as text")
    k = sharding.shard(d, [1.0, 3.0]).toPandas().shard.value_counts(normalize=True)
    assert abs(k[1] - 0.75) < 0.02


def test_spotsigs(table, plain):
    order = sorted(plain, reverse=True)
    got = spotsigs.beside_next(table).toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(plain)
    for a, b in zip(order, order[1:] + order[:1]):
        t, n = plain[a], plain[b]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        sa, se, sn = spotsigs.signatures([t, e, n])
        r = got.loc[a]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), spotsigs.encode(sa), spotsigs.encode(se))
        assert abs(r.near_edited - spotsigs.likeness(sa, se)) < 1e-12 and abs(r.near_next - spotsigs.likeness(sa, sn)) < 1e-12


def spot_chains(text):
    """Signatures by the letter of the method: each anchor with the next words that are no anchors."""
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    out = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            rest = [x for x in words[i + 1 :] if x not in spotsigs.ANCHORS][: spotsigs.CHAIN]
            if len(rest) == spotsigs.CHAIN:
                out.add((w, *rest))
    return frozenset(out)


def test_spotsigs_chains():
    r = random.Random(5)
    words = list(spotsigs.ANCHORS[:10]) + ["".join(r.choices("bcdfgé", k=4)) for _ in range(40)]
    texts = [" ".join(r.choices(words, k=r.randint(0, 60))).title() + r.choice(["", ".", " - x9"]) for _ in range(200)]
    got, want = spotsigs.signatures(texts), [spot_chains(t) for t in texts]
    assert [len(x) for x in got] == [len(w) or bool(t) for w, t in zip(want, texts)]
    for _ in range(300):  # likeness of hashed sets is that of the chains
        a, b = r.randrange(200), r.randrange(200)
        if want[a] and want[b]:
            assert abs(spotsigs.likeness(got[a], got[b]) - len(want[a] & want[b]) / len(want[a] | want[b])) < 1e-12


def test_spotsigs_classes(spark, table, empty):
    r = random.Random(5)
    words = list(spotsigs.ANCHORS[:10]) + ["".join(r.choices("bcdfg", k=4)) for _ in range(60)]
    texts = [None, "", "x", "x"]
    for _ in range(4):
        base = [r.choice(words) for _ in range(300)]
        for i in range(12):
            w = list(base)
            for _ in range(i):
                w[r.randrange(300)] = "neu" + str(r.randrange(99))
            texts.append(" ".join(w))
    sets = spotsigs.signatures([t or "" for t in texts])
    up = list(range(len(texts)))
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in product(range(len(texts)), repeat=2):
        if a < b and len(sets[a]) and len(sets[b]) and spotsigs.likeness(sets[a], sets[b]) >= 0.8 - 1e-12:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = spotsigs.classes(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, cls int")).collect()
    assert {x["doc_id"]: (x["n_signatures"], x["class_id"]) for x in got} == {i: (len(sets[i]), find(i)) for i in range(len(texts))}
    assert len({find(i) for i in range(4, len(texts))}) < 48
    assert spotsigs.classes(empty).collect() == []


def test_language_id_learns(spark):
    r = random.Random(2)
    words = {"xx": ["".join(r.choices("abcde", k=4)) for _ in range(50)], "yy": ["".join(r.choices("uvwxy", k=4)) for _ in range(50)]}
    rows = [(i, " ".join(r.choices(words[k], k=r.randint(5, 90))), k, "s") for i, k in enumerate(["xx", "yy"] * 60)]
    d = spark.createDataFrame(rows + [(1000, None, None, "s"), (1001, "12 34 !", "xx", "s"), (1002, "", "yy", "s")], "doc_id long, text string, lang string, source string")
    m = langid.train(langid.sample(d.where("text is not null and lang is not null and doc_id < 1000").where(~langid.held_out(d.doc_id))), 60)
    got = {x["doc_id"]: x for x in langid.predict(d, m, "lang").collect()}
    assert sum(got[i]["lang_pred"] == k for i, _, k, _ in rows) >= 0.97 * len(rows)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))


def test_language_id_learns_whole_texts(spark):
    r = random.Random(8)
    words = {"xx": ["".join(r.choices("abcde", k=4)) for _ in range(50)], "yy": ["".join(r.choices("uvwxy", k=4)) for _ in range(50)]}
    head = "HEADER 0123 " * 360  # 4,320 bytes that all texts begin with
    rows = [(i, head + " ".join(r.choices(words[k], k=1500)), k) for i, k in enumerate(["xx", "yy"] * 20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(d)
    assert got == langid.sample(d.repartition(3)) and len(got) == 5 * len(rows) and all(len(b) == langid.WINDOW for _, b in got)
    m = langid.train(got, 60)
    assert sum(x["lang_pred"] == x["lang"] for x in langid.predict(d, m, "lang").collect()) >= 0.97 * len(rows)
    many = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(230)], "doc_id long, text string, lang string")
    assert {k for k, _ in langid.sample(many)} == {f"l{i}" for i in range(230)}


def test_nothing_learnt_rejects_nothing(spark):
    import corpus_pipeline as cp

    d = spark.createDataFrame([(1, "ein Text", None), (2, "12", None)], "doc_id long, text string, lang string")
    assert cp.language(spark, d, "").collect() == d.collect()


def test_language_tables_are_the_network():
    m = langid.ByteCNN(["a", "b"])
    x = np.random.default_rng(0).integers(0, 256, (5, langid.WINDOW), dtype=np.uint8)
    e, pooled = m.p["emb"][x], []
    for w in langid.WIDTHS:
        cols = np.concatenate([e[:, k : langid.WINDOW - w + 1 + k] for k in range(w)], axis=2)
        pooled.append(np.maximum((cols @ m.p[f"w{w}"]).max(1) + m.p[f"b{w}"], 0))
    assert np.allclose(langid.logits(m.tables(), x), np.concatenate(pooled, 1) @ m.p["out"] + m.p["bias"], atol=1e-4)


def test_language_id_against_the_network(spark):
    """Whole texts of several windows: the mean of the network's own logits, by its unfolded layers."""
    m = langid.ByteCNN(["a", "b", "c"])
    r = random.Random(3)
    texts = ["".join(r.choices("abc éñ\n", k=k)) for k in (1, 255, 256, 257, 1000, 5000, 200_000)]

    def logits(t):
        raw = t.encode()
        out = []
        for at in range(0, len(raw), langid.WINDOW):
            x = np.frombuffer(raw[at : at + langid.WINDOW].ljust(langid.WINDOW), np.uint8)
            e, pooled = m.p["emb"][x], []
            for w in langid.WIDTHS:
                cols = np.concatenate([e[k : langid.WINDOW - w + 1 + k] for k in range(w)], axis=1)
                pooled.append(np.maximum((cols @ m.p[f"w{w}"]).max(0) + m.p[f"b{w}"], 0))
            out.append(np.concatenate(pooled) @ m.p["out"] + m.p["bias"])
        z = np.mean(out, axis=0)
        q = np.exp(z - z.max())
        return q / q.sum()

    got = {x["doc_id"]: x for x in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).collect()}
    for i, t in enumerate(texts):
        q = logits(t)
        assert got[i]["lang_pred"] == m.labels[int(q.argmax())] and abs(got[i]["score"] - q.max()) < 1e-4


def test_sample_is_bounded(spark):
    many = spark.createDataFrame([(i, f"text {i}", f"l{i % 3}") for i in range(900)], "doc_id long, text string, lang string")
    assert len(langid.sample(many, 400, 90)) < 180 and {k for k, _ in langid.sample(many, 400, 90)} == {"l0", "l1", "l2"}


def test_top_k(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(v) for v in r.normal(0, 0.2, 40).round(1)]) for i in range(700)]
    odd = [(700, None), (800, [float("nan")] * 40), (900, [None] + [0.1] * 39), (1000, [1.0, 2.0]), (None, [0.5] * 40), (1100, [])]
    got = {}
    for x in topk.top_k(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    v = np.floor(np.array([np.array(e, np.float32) for _, e in rows]).astype(float) * 1024).astype(np.int64)
    for q in range(0, 700, 100):
        s = v @ v[q]
        best = [k for k in np.lexsort((np.arange(700), -s)) if k != q][:10]
        assert sorted(got.pop(q)) == [(i + 1, k, s[k]) for i, k in enumerate(best)]
    assert not got


def test_style_tree(spark):
    r = random.Random(4)
    pages, want = [], {}
    for i in range(30):
        body = [f"Absatz {i} {r.random()}", f"Zwei &amp; {i}\n  <b>drei</b>"]
        html = f"<html><head><title>t</title></head><body><nav><a>Start</a></nav><div class='x1'>Immer gleich</div><div class=ad>Kauf {i}</div><div class='post'><p>{body[0]}<p>{body[1]}</div><div class='comments'><p>Leser {i}</p></div><script>var a='</p>{i}'</script><footer>f</footer></body>"
        pages.append((i, f"http://h.example/{i}", html))
        want[i] = body[0] + "\n" + f"Zwei & {i} drei"
    pages += [(100, None, None), (101, "http://solo.example", "<body><article><h1>A</h1><p>b<br>c</p><aside>x</aside></article><p>weg"), (102, "http://solo.example", "")]
    want |= {100: "", 101: "A\nb c", 102: ""}
    got = style_tree.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {x["page_id"]: x["text"] for x in got} == want
    assert all(x["n_chars"] == len(x["text"]) for x in got)


def test_mirrored_articles_stay(spark):
    pages = [(i, f"http://h.example/{i}", "<body><div>gleich</div><article><p>Der Artikel</p></article>") for i in range(20)]
    got = style_tree.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {x["text"] for x in got} == {"Der Artikel"}


def test_copies_of_a_page_keep_their_text(spark):
    same = "<body><div><p>Erster Absatz</p><p>Zweiter</p></div></body>"
    pages = [(i, u, same) for i, u in enumerate(["http://copy.example/a", None] * 10)]
    near = [(100 + i, f"http://near.example/{i}", f"<body><div><p>Immer</p></div><nav>{i}</nav><i class=x>{'y' * (i % 2)}</i></body>") for i in range(20)]
    got = style_tree.main_text(spark.createDataFrame(pages + near, "page_id long, url string, html string")).collect()
    assert {x["text"] for x in got if x["page_id"] < 100} == {"Erster Absatz\nZweiter"}
    assert all(x["text"].startswith("Immer") for x in got if x["page_id"] >= 100)
    few = [(i, f"http://h.example/{i}", f"<body><div>gleich</div><p>{'' if i % 4 else f'Text {i}'}</p></body>") for i in range(40)]
    got = style_tree.main_text(spark.createDataFrame(few, "page_id long, url string, html string")).collect()
    assert {x["page_id"]: x["text"] for x in got} == {i: "gleich" if i % 4 else f"Text {i}" for i in range(40)}


def test_entropy_decides_in_articles(spark):
    notice = "<p>Alle Rechte vorbehalten</p><ul><li>Folgen Sie uns</ul>"
    pages = [(i, f"http://h.example/{i}", f"<body><article><h2>Fazit</h2><p>Text {i}</p>{notice}{'<p>Wie im Teil davor</p>' if i % 3 == 0 else ''}</article></body>") for i in range(30)]
    pages += [(100 + i, f"http://few.example/{i}", f"<body><article><p>Text {i}</p>{notice}</article></body>") for i in range(7)]
    pages += [(200 + i, f"http://mirror.example/{i}", f"<body><div>Nr. {i}</div><article><p>Der Artikel</p></article></body>") for i in range(20)]
    got = {x["page_id"]: x["text"] for x in style_tree.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = {i: f"Fazit\nText {i}" + ("\nWie im Teil davor" if i % 3 == 0 else "") for i in range(30)}
    want |= {100 + i: f"Text {i}\nAlle Rechte vorbehalten\nFolgen Sie uns" for i in range(7)} | {200 + i: "Der Artikel" for i in range(20)}
    assert got == want


@pytest.mark.parametrize("html,want", [
    ("<body class='single has-sidebar'><p>A</p></body>", "A"),
    ("<body class='sidebar' hidden><p>A</p></body>", "A"),
    ("<div class='content-with-sidebar'><p>A</p></div>", "A"),
    ("<article class='post has-comments'><p>A</p></article>", "A"),
    ("<article class='comments'><p>A</p></article>", "A"),
    ("<main id='search-results'><p>A</p></main>", "A"),
    ("<div class='share-price'>A</div>", "A"),
    ("<div class='widget'><div class='sidebar'>weg</div><article>A</article></div>", "A"),
    ("<span class='search'><main>A</main></span>", "A"),
    ("<article>A</article><div class='comments'><article>weg</article></div>", "A"),
    ("<div class='comments'>weg</div><p>A", "A"),
    ("<article><p>Sei <math><msup><mi>x</mi><mn>2</mn></msup><annotation>x^2</annotation></math> gut</p></article>", "Sei x2 gut"),
    ("<article><p>A<svg class='i'/>B</p><p>C</p></article>", "AB\nC"),
    ("<article><p>A<svg class='i'>B</p><p>C</p></article>", "AB\nC"),
    ("<article><p>A<svg><path/></svg>B</p><script/><p>C</p><iframe src=x><p>D</p></article>", "AB\nC\nD"),
    ("<article><p>A</p><script>var b;", "A"),
])
def test_names_and_raw_elements_cut_no_text(html, want):
    blocks, _, has_main = style_tree.parse(html)
    assert "\n".join(text for _, text, noise, inside, _ in blocks if not noise and (inside or not has_main)) == want


def test_nested_inline_noise():
    for html, want in [("<p>a <span class=ad><span>Buy</span> now</span> b</p>", "a b"), ("<p>a <span class=ad>x<span/> y</span> b</p>", "a b"), ("<p>a <span class=ad>offen</p>", "a offen")]:
        assert "\n".join(t for _, t, noise, _, _ in style_tree.parse(html)[0] if not noise) == want


def test_html_against_another_parser(spark):
    """Pages of the test tables: the article as the standard library's parser reads it."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks, self.gone = 0, [""], 0

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.inside += 1
            self.gone += tag in ("script", "style")
            if tag in ("p", "h1", "h2", "article", "ul", "li", "div"):
                self.blocks.append("")
            elif tag == "br":
                self.blocks[-1] += " " * bool(self.inside)

        def handle_endtag(self, tag):
            self.gone -= tag in ("script", "style")
            if tag in ("p", "h1", "h2", "article", "ul", "li", "div"):
                self.blocks.append("")
            self.inside -= tag == "article"

        def handle_data(self, data):
            if self.inside and not self.gone:
                self.blocks[-1] += data

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {x["page_id"]: x["text"] for x in style_tree.main_text(pages).collect()}
    for x in pages.collect():
        p = Article()
        p.feed(x["html"] or "")
        p.close()
        assert got[x["page_id"]] == "\n".join(t for t in (" ".join(b.split()) for b in p.blocks) if t)


def test_long_and_odd_pages(spark):
    long = "".join(f"<p>Absatz {i} {'wort ' * 40}</p>" for i in range(4000))
    rows = [(1, "http://a.example", f"<body><main>{long}</main>", "x", 1), (1, "http://a.example", f"<body><main>{long}</main>", "x", 1), (None, None, "<p>A", None, None), (2, "kein host", "", "h", 2), (3, "http://A.example:80/x", "<div>" * 3000 + "tief", "h", 2)]
    got = style_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string, low int")).collect()
    assert sorted((x["page_id"] or 0, len(x["text"].split("\n")) if x["text"] else 0) for x in got) == [(0, 1), (1, 4000), (1, 4000), (2, 0), (3, 1)]


def brute_chat(roles):
    """Least cost by a search over all labels, merges and bridges."""
    cost = {chat.START: 0}
    for r in roles:
        new = {}
        for a, c in cost.items():
            for to in (1, 2, 3):
                label = 0 if r == to else chat.RELABEL
                ways = [label + chat.MERGE] if a == to else []
                if (a, to) in chat.BRIDGE:
                    ways.append(label + chat.INSERT * len(chat.BRIDGE[a, to]))
                for w in ways:
                    new[to] = min(new.get(to, 1 << 30), c + w)
        cost = new
    return min(c + chat.INSERT * len(chat.FINISH[s]) for s, c in cost.items())


def test_chat(spark, monkeypatch):
    r, rows, want = random.Random(6), [], {}
    names = ["system", "user", "assistant", "USER ", "tool", None]
    for conv in range(40):
        n = r.choice([1, 2, 5, 700])
        roles = [r.choice(names) for _ in range(n)]
        rows += [(conv, i, x, r.choice(["hi", "", None, f"t{i}"])) for i, x in enumerate(roles)]
        want[conv] = brute_chat([chat.role_number(x) for x in roles])
    got = chat.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas()
    assert len(got) == len(rows)
    for conv, g in got.groupby("conv_id"):
        assert g.cost.sum() == want[conv]
        out = "".join(g.sort_values("turn").piece)
        said = re.findall(r"<\|im_start\|>(\w+)\n", out)
        assert said.count("system") <= 1 and "system" not in said[1:]
        turns = [x for x in said if x != "system"]
        assert turns == ["user", "assistant"] * (len(turns) // 2) or not turns
        assert out.count("<|im_end|>") == len(said)


def test_chat_odd_rows(spark):
    """Null ids, null and equal turns, repeated rows, clashing columns, a long text; results don't depend on the order."""
    rows = [(1, None, "user", "a", 7, "c"), (1, 0, "assistant", "b", 7, "c"), (1, 0, "assistant", "b", 7, "c"), (1, 0, "assistant", None, 7, "c"), (None, 1, "user", "weg", 7, "c"), (2, 5, None, "x" * 300_000, 7, "c"), (3, 1 << 40, "system", "", 7, "c")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk int, entry string")
    got = sorted(map(str, chat.repaired(d).collect()))
    assert got == sorted(map(str, chat.repaired(d.repartition(3)).collect())) and len(got) == 6
    by = {}
    for x in chat.repaired(d).collect():
        by.setdefault(x["conv_id"], []).append(x)
    assert sum(x["cost"] for x in by[1]) == brute_chat([2, 3, 3, 3]) and sum(x["cost"] for x in by[3]) == brute_chat([1])
    assert any(len(x["piece"]) > 300_000 for x in by[2])


def test_top_k_odd_rows(spark):
    """Repeated rows, clashing columns, and vectors of different lengths."""
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (1, [0.5, 0.0], 1), (2, [1.0], 1), (100, [0.0, 1.0], 1), (100, [0.0, 1.0], 1)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, block int")).collect()
    assert [(x["rank"], x["vec_id"], x["score"]) for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == 0] == [(1, 1, 524288), (2, 1, 524288), (3, 100, 0), (4, 100, 0)]


@pytest.mark.parametrize("name", ["op5_top_k", "op7_sharding", "op9_suffix_dedup", "op10_ngram_join"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    from quire.llm import queries

    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    want = db.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    rows = lambda d: sorted(tuple(map(str, r)) for r in d[names].itertuples(index=False))
    assert len(got) and rows(got) == rows(want)


@pytest.mark.parametrize("run", [
    lambda e: ngram_join.jaccard_components(e, 4, 85, 100), lambda e: suffix_dedup.digests(e), lambda e: suffix_dedup.without_repeats(e), lambda e: mixing.mix(e),
    lambda e: sharding.shard(e, [1.0] * 24), spotsigs.beside_next, lambda e: langid.predict(e, langid.learn(e)),
    lambda e: packing.pack(e, __import__("public_tokenizers").path("byte_bpe_50k.json")),
    lambda e: topk.top_k(e.selectExpr("doc_id as vec_id", "cast(null as array<float>) as embedding")), lambda e: chat.repaired(e.selectExpr("doc_id as conv_id", "doc_id as turn", "lang as role", "text")),
    lambda e: style_tree.main_text(e.selectExpr("doc_id as page_id", "lang as url", "text as html")),
])
def test_empty_tables(empty, run):
    assert run(empty).collect() == []


def test_stages_on_odd_rows(spark, table, plain, tmp_path):
    import corpus_pipeline as cp

    docs, kept = table, None
    for i, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        if i + 1 < len(cp.STAGES):
            assert docs.columns == table.columns
        if i == 0:
            assert {r["doc_id"] for r in docs.collect()} == {k for k, t in plain.items() if re.search(r"[^\W\d_]", t)}
        if i == 1:
            kept = {r["doc_id"]: r["text"] for r in before.collect()}
            assert {r["doc_id"] for r in docs.collect()} == {i for i, (_, c) in brute_components(kept, 5, 80, 100).items() if c == i}
    assert docs.count() > 0


@pytest.fixture(scope="module")
def repeated(spark):
    """Rows that repeat a doc_id, with the same text or another, and rows without a doc_id."""
    r = random.Random(9)
    say = lambda k: " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 7))) for _ in range(k))
    long, other, passage, word = say(90), say(80), say(50), "".join(r.choices("abcdefgh", k=300))
    rows = [(1, long)] * 3 + [(2, "a b")] * 2 + [(3, other + " " + passage), (3, passage + " " + say(60)), (None, say(70)), (None, long), (None, "c d"), (None, "c d"), (4, word), (4, word), (0, say(40)), (5, None), (5, None)]
    return spark.createDataFrame([(i, t, "s", len(t or "")) for i, t in rows], "doc_id long, text string, source string, n_chars long").repartition(3)


def plain_rows(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def brute_cut(texts):
    count = Counter(b[s : s + 200] for b in texts for s in range(len(b) - 199))
    for b in texts:
        gone = {x for s in range(len(b) - 199) if count[b[s : s + 200]] > 1 for x in range(s, s + 200)}
        yield bytes(c for x, c in enumerate(b) if x not in gone)


def test_repeated_rows_stay_through_the_stages(spark, repeated, tmp_path):
    import corpus_pipeline as cp

    rows = plain_rows(repeated)
    once = cp.near_duplicates(spark, repeated, "")
    long = next(t for (i, t), k in rows.items() if k == 3)
    want = Counter({k: n if k[1] is None else 1 for k, n in rows.items()})  # texts without words have no group
    del want[None, long]
    assert once.columns == repeated.columns and plain_rows(once) == want
    once.write.parquet(str(tmp_path / "once"))
    once = spark.read.parquet(str(tmp_path / "once"))
    cut = cp.repeated_strings(spark, once, "")
    pairs = list(want.elements())
    left = Counter((i, t if k == len((t or "").encode()) else b.decode()) for (i, t), b in zip(pairs, brute_cut([(t or "").encode() for _, t in pairs])) for k in [len(b)])
    assert plain_rows(cut) == left and (1, long) in left
    cut.write.parquet(str(tmp_path / "cut"))
    cut = spark.read.parquet(str(tmp_path / "cut"))
    cp.mix(spark, cut, "").write.parquet(str(tmp_path / "mix"))
    assert plain_rows(spark.read.parquet(str(tmp_path / "mix"))) == left  # one source: each row once
    pieces = cp.pack(spark, spark.read.parquet(str(tmp_path / "mix")), "").toPandas()
    assert (pieces.groupby(["sequence_id"]).length.sum().sort_values().iloc[1:] == 1024).all()
    assert Counter(pieces[pieces.start == 0].doc_id.isna()) == Counter(i is None for i, _ in left.elements())


def test_operators_on_repeated_rows(repeated):
    rows = plain_rows(repeated)
    texts = [(t or "").encode() for (i, t), k in rows.items() for _ in range(k)]
    ids = [i for (i, _), k in rows.items() for _ in range(k)]
    want = Counter((i, t.decode()) for i, a, t in zip(ids, texts, brute_cut(texts)) if t or not a)
    assert Counter((i, t or "") for (i, t), k in plain_rows(suffix_dedup.without_repeats(repeated)).items() for _ in range(k)) == want
    assert plain_rows(mixing.mixed(repeated)) == rows  # one source: each row once
    have = [(i, t) for i, t in zip(ids, texts) if i is not None]
    got = Counter((r["doc_id"], r["n_bytes"], r["kept_sha256"]) for r in suffix_dedup.digests(repeated).collect())
    assert got == Counter((i, len(t), hashlib.sha256(k).hexdigest()) for (i, t), k in zip(have, brute_cut([t for _, t in have])))
