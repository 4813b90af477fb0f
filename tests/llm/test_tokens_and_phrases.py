"""op11 to op13 against brute force, on odd rows, long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import align, collocations, repair, wordwise

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
PLAIN = Tokenizer.from_file(A)
PLAIN.encode_special_tokens = True
SPECIAL = Tokenizer.from_file(A)
BYTES, MODEL = wordwise.ByteLevel(A, False), wordwise.Pieces(B)
PIECES = sentencepiece.SentencePieceProcessor(model_file=B)
ODD = [(None, "no id"), (899, "<|endoftext|> <s> x"), (899, "<|endoftext|> <s> x"), (900, None), (901, ""), (902, " "), (903, "a▁b c"), (904, "  ½ ﬁ 日本語。🙂🙂 \t\n x"), (905, "🙂" * 400), (906, "ö" * 50 + " q"), (907, "a  b  c…  d\x1c e\x7f f")]


def own_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    long = " ".join(random.Random(1).choices(["alpha", "beta", "gamma", "delta,", "ε"], k=150_000))
    return [tuple(r) for r in rows] + ODD + [(2000, long)]


def clashing(spark, rows):
    """The rows with columns named like those the operators make."""
    names = ["row", "h", "n", "a", "b", "piece", "m", "lang", "shard", "ids", "start"]
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))


# wordwise


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t.'a1éßñ…—日🙂▁ \x85\x1cs") | st.characters(codec="utf-8"), max_size=40), max_size=6))
def test_words_have_the_libraries_ids(texts):
    ids, at = BYTES.texts(pa.array(texts, pa.string()))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [SPECIAL.encode(t, add_special_tokens=False).ids for t in texts]
    spaced = pa.array([" " + t for t in texts if t], pa.string())
    known, index, before = wordwise.distinct(*wordwise.buffers(spaced))
    flat, at = wordwise.spread(*wordwise.encoded(known, MODEL), index)
    at = at[before]
    assert [flat[at[i] : at[i + 1]].tolist() for i in range(len(spaced))] == PIECES.encode([t for t in texts if t])


@pytest.mark.parametrize("text", ["0 ", "a b ", "日本 ", "a\u00a0 ", "é \n ", " ", "  ", "a  ", "\t ", "a \n"])
def test_a_last_space_is_a_piece(spark, text):
    known, index, before = wordwise.distinct(*wordwise.buffers(pa.array([" " + text], pa.string())))
    flat, at = wordwise.spread(*wordwise.encoded(known, MODEL), index)
    assert flat.tolist() == PIECES.encode(text)
    (row,) = align.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B).collect()
    tokens = _tokens(text)
    assert tokens and (row.n_a, row.n_b) == (len(tokens[0][0]), len(tokens[1][0]))


# op13


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=400), st.integers(0, 30), st.data())
def test_grammar_expands_to_the_ids(ids, copies, data):
    ids = np.array(ids * (1 + copies), np.int64)
    symbols, left, right, spans = repair.grammar(ids, 10)
    assert len(symbols) <= len(ids) and len(left) == len(right) == len(spans)
    marks = repair.marks_of(symbols, spans, 10)
    block = repair.Block(10, *(x.tobytes() for x in (left, right, spans, symbols, marks)))
    assert block.expand(block.symbols).tolist() == ids.tolist()
    start = data.draw(st.integers(0, len(ids)))
    length = data.draw(st.integers(0, len(ids) - start))
    assert block.piece(start, length).tolist() == ids[start : start + length].tolist()


def test_grammar_fills_its_symbols_at_most():
    ids = np.random.default_rng(0).integers(0, 300, 400_000)
    symbols, left, _, spans = repair.grammar(ids, 1 << 16)
    assert not len(left) and symbols.tolist() == ids.tolist()
    symbols, left, right, spans = repair.grammar(np.tile(np.arange(2000) % 1000, 100), 1000)
    assert len(left) and len(symbols) < 20_000 and int(np.concatenate((np.ones(1000, np.int64), spans))[symbols].sum()) == 200_000


@pytest.mark.parametrize("block", [1 << 21, 700])
def test_files_hold_all_ids(spark, block):
    docs = own_documents(spark)
    blocks, index = repair.write(clashing(spark, docs), A, block)
    got = repair.read(blocks, index).orderBy("start").collect()
    want, at = [], 0
    for i, t in sorted(docs, key=lambda r: (r[0] is None, r[0])):
        ids = [*SPECIAL.encode(t or "", add_special_tokens=False).ids, repair.END]
        want.append((i, at, np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [(r.doc_id, r.start, bytes(r.ids)) for r in got] == want
    digest = {tuple(r) for r in repair.digests(repair.read(blocks, index)).collect()}
    assert digest == {(i, s, len(x) // 4, zlib.crc32(x)) for i, s, x in want}
    some = {tuple(r) for r in repair.find(blocks, index, [1, 7, 2000, 12345]).collect()}
    assert some == {w for w in want if w[0] in (1, 7, 2000)}


def test_files_of_nothing(spark):
    blocks, index = repair.write(spark.createDataFrame([], "doc_id long, text string"), A)
    assert not repair.digests(repair.read(blocks, index)).count()


# op12


def _tokens(text):
    byte = {chr(c): c for c in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
    byte |= {chr(0x100 + i): c for i, c in enumerate(c for c in range(256) if chr(c) not in byte)}
    a = PLAIN.encode(" " + text, add_special_tokens=False)
    b = PIECES.encode(text)
    piece = lambda i: bytes([int(PIECES.id_to_piece(i)[3:5], 16)]) if PIECES.is_byte(i) else PIECES.id_to_piece(i).replace("▁", " ").encode()
    return (a.ids, [bytes(byte[c] for c in PLAIN.id_to_token(i)) for i in a.ids]), (b, [piece(i) for i in b])


def by_letter(docs):
    each, held = [], Counter()
    for i, text in docs:
        each.append((i, None))
        if not text:
            continue
        (ia, ba), (ib, bb) = _tokens(text)
        if not b"".join(ba) == b"".join(bb) == (" " + text).encode():
            continue
        ends = lambda x: np.cumsum([len(t) for t in x]).tolist()
        ea, eb, groups, p, q = ends(ba), ends(bb), [], 0, 0
        for cut in sorted(set(ea) & set(eb)):
            x, y = ea.index(cut, p) + 1, eb.index(cut, q) + 1
            groups.append((ia[p:x], ib[q:y]))
            p, q = x, y
        links = Counter()
        for x, y in groups:
            for a, k in Counter(x).items():
                for b, m in Counter(y).items():
                    links[a, b] += k * m
        held.update(links.keys())
        each[-1] = (i, (len(ia), len(ib), groups, links))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    for i, x in each:
        if x is None:
            yield (i, 0, 0, 0, 0, 0, 0, "")
            continue
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in x[2])
        sums = sum(x[3].values()), sum(k for p, k in x[3].items() if held[p] == best[p[0]]), sum(k * held[p] for p, k in x[3].items())
        yield (i, x[0], x[1], len(x[2]), *sums, hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("hot", [align.HOT, 3000, 0])
def test_alignment_by_the_letter(spark, hot, monkeypatch):
    monkeypatch.setattr(align, "HASHED", 20_000)  # the long text is hashed in parts
    docs = own_documents(spark)
    got = align.align(clashing(spark, docs), A, B, hot).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, by_letter(docs)))


def test_owners():
    over_a, over_b, group_a, group_b = align.owners(np.array([3, 2, 4]), np.array([1, 4, 4]))
    assert list(zip(over_a.tolist(), over_b.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2)]
    assert group_a.tolist() == [0, 0, 1] and group_b.tolist() == [0, 0, 1]


def test_wide_groups_are_linked_by_distinct_ids(monkeypatch):
    ids_a, ids_b = np.array([5, 5, 6, 7]), np.array([1, 2, 1, 3, 9])
    group_a, group_b = np.array([0, 0, 0, 1]), np.array([0, 0, 0, 0, 1])
    count = lambda: Counter({(g, a, b): 0 for g, a, b, _ in zip(*align._links(ids_a, ids_b, group_a, group_b, 2))}) + sum((Counter({(int(g), int(a), int(b)): int(n)}) for g, a, b, n in zip(*align._links(ids_a, ids_b, group_a, group_b, 2))), Counter())
    plain = count()
    monkeypatch.setattr(align, "WIDE", 3)
    assert count() == plain and sum(plain.values()) == 13


def test_alignment_of_nothing(spark):
    assert not align.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count()


# op11


def phrases_by_letter(docs, least, longest=4):
    import re

    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        held = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        for p, a in held.items():
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in held.items())
            if not inside:
                score, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                yield lang, " ".join(p), len(p), a, left, right, n[lang], score


@pytest.mark.parametrize("together", [collocations.TOGETHER, 500])
def test_phrases_by_the_letter(spark, together, monkeypatch):
    pick = random.Random(3)
    monkeypatch.setattr(collocations.counts, "__defaults__", (None, together))
    words = ["of", "The", "new", "york", "is", "Ärger", "ﬁ", "a b"]
    docs = [(pick.choice(["en", "de", None, "und", ""]), "".join(pick.choices(words, k=1)[0] + pick.choice([" ", "  ", " \t", ", ", "\r\n", "; ", "!"]) for _ in range(pick.randint(0, 60)))) for _ in range(150)]
    docs += [("en", None), (None, None), ("en", ""), ("en", " \t.,; ")] + [("en", "New York is new york is new york.")] * 40
    df = spark.createDataFrame([(l, t, "x", "x") for l, t in docs], "lang string, text string, piece string, m string")
    got = sorted(map(tuple, collocations.phrases(df, least=5).collect()))
    assert got == sorted(phrases_by_letter(docs, 5)) and len(got) > 20


def test_without_bitsets_counts_are_the_same(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(tuple, collocations.phrases(df, least=8).collect()))
    monkeypatch.setattr(collocations.Bits, "of", staticmethod(lambda hashes, count: None))
    assert sorted(map(tuple, collocations.phrases(df, least=8).collect())) == want and want


def test_scores_past_64_bits(spark):
    """The same arithmetic on counts that 64 bits can't multiply."""
    from pyspark.sql import functions as F

    big = 9 * 10**18
    row = spark.range(1).select(F.lit(big).cast("long").alias("a"), F.lit(big).cast("long").alias("l"), F.lit(big - 1).cast("long").alias("r"))
    assert row.select(collocations.score("a", "l", "r", 2_000_000)).first()[0] == 2_000_000 * big // (2 * big - 1)


def test_phrases_of_nothing(spark):
    c = collocations.phrases(spark.createDataFrame([], "lang string, text string"))
    assert not collocations.top(c, 10).count()


def test_top_breaks_ties_by_bytes(spark):
    rows = [("x", p, 2, a, 1, 1, 9, s) for p, a, s in [("b b", 5, 3), ("a é", 5, 3), ("a z", 5, 3), ("c", 6, 3), ("d", 1, 9)]]
    df = spark.createDataFrame(rows, "lang string, phrase string, words int, a long, l long, r long, n long, score long")
    assert [r.phrase for r in collocations.top(df, 4).orderBy("rank").collect()] == ["d", "c", "a z", "a é"]
