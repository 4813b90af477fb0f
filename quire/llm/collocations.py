"""Collocations: phrases of two to four words that stand together far more often than their parts.

Equal pieces of text (between punctuation) become one row with a multiplicity. N-grams are counted in four scans of these
pieces, one for each length: a task adds up the weighted n-grams of its pieces by numbers of words, deals them out by hash,
and each hash bucket is summed by duckdb, which spills to Spark's own local folders beyond its memory limit. An n-gram is
only sent if both (n-1)-grams inside it are frequent, as far as a bitset of these tells, which lets through too many at
most; where they are too many for a bitset, all are sent. A candidate's parts are frequent, too: requests for their counts
are shuffled to where the counts are, and answers back to the candidates.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Bits, Scratch, SpanHash, bucket_bits, buffers, mapped, mix, session
from quire.llm.wordwise import spans

#: What ends a piece, and what parts words.
ENDS, GAPS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
UNKNOWN = "und"
#: Words of a phrase at most; occurrences at least.
LONGEST, LEAST = 4, 30
#: Bytes of pieces whose n-grams a task adds up together; memory of duckdb in a task.
TOGETHER, MEMORY = 8 << 20, "256MB"


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, m): distinct pieces, each word followed by one space, and how often each stands."""
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    one = F.explode(F.split(low, ENDS)).alias("piece")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), one)
    rows = rows.select("lang", F.ltrim(F.regexp_replace(F.concat("piece", F.lit(" ")), GAPS, " ")).alias("piece")).where("piece <> ''")
    return rows.groupBy("lang", "piece").agg(F.count("*").alias("m"))


def _word_hashes(arr) -> np.ndarray:
    off, data = buffers(arr)
    return SpanHash(data[off[0] : off[-1]]).of(off[:-1] - off[0], off[1:] - off[0])


def _more(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of an n-gram and a further word."""
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + word)


def _phrase_hashes(lang, phrase) -> np.ndarray:
    """Hashes of phrases in their languages."""
    lists = pc.split_pattern(phrase, " ")
    off = lists.offsets.to_numpy().astype(np.int64)
    word = _word_hashes(lists.flatten().cast(pa.binary()))
    off, n = off - off[0], np.diff(off)
    h = word[off[:-1]]
    for k in range(1, int(n.max()) if len(n) else 0):
        longer = np.flatnonzero(n > k)
        h[longer] = _more(h[longer], word[off[:-1][longer] + k])
    return _more(h, _word_hashes(lang.cast(pa.binary())))


def _sums(table: pa.Table, n: int, bits: Bits | None) -> pa.Table:
    """lang, phrase, w, h: the n-grams of these pieces, by weight. Grouped by numbers of words, so equal means equal."""
    langs, text = table.column("lang").combine_chunks().dictionary_encode(), table.column("piece").combine_chunks()
    off, data = buffers(text)
    at = np.flatnonzero(data[off[0] : off[-1]] == 0x20) + off[0] + 1  # ends of words, behind their spaces
    coded = spans(data, np.concatenate((off[:1], at[:-1])), at).dictionary_encode()
    words = pc.binary_replace_slice(coded.dictionary, -1, 1 << 30, b"").cast(pa.string())
    word = coded.indices.to_numpy().astype(np.int64)
    count = np.diff(np.searchsorted(at, off, "right"))
    row = np.repeat(np.arange(len(text)), count)
    m = table.column("m").to_numpy()
    lang_of = langs.indices.to_numpy()
    hashes = _word_hashes(words.cast(pa.binary()))
    tongue = _word_hashes(langs.dictionary.cast(pa.binary()))
    end = np.cumsum(count)[row]  # of each word's piece
    place = np.arange(len(word))
    keep = place + n <= end
    if bits is not None:
        h = hashes[word]
        for k in range(1, n - 1):
            h = _more(h[:-1], hashes[word[k:]])
        known = np.zeros(len(word) + 1, bool)
        known[: len(h)] = bits.has(_more(h, tongue[lang_of[row[: len(h)]]]))
        keep &= known[:-1] & known[1:]
    place = place[keep]
    columns = {f"w{i}": word[place + i] for i in range(n)}
    keys = {"l": lang_of[row[place]]} | ({"a": columns["w0"]} if n == 1 else {"a": columns["w0"] << 32 | columns["w1"]}) | ({} if n < 3 else {"b": columns["w2"]} if n == 3 else {"b": columns["w2"] << 32 | columns["w3"]})
    t = pa.table(keys | {"w": m[row[place]]}).group_by(list(keys), use_threads=False).aggregate([("w", "sum")])
    a = t.column("a").to_numpy()
    ids = [a] if n == 1 else [a >> 32, a & 0xFFFFFFFF]
    if n > 2:
        b = t.column("b").to_numpy()
        ids += [b] if n == 3 else [b >> 32, b & 0xFFFFFFFF]
    phrase = pc.binary_join_element_wise(*[words.take(pa.array(i)) for i in ids], " ")
    h = hashes[ids[0]] if len(a) else np.zeros(0, np.uint64)
    for i in ids[1:]:
        h = _more(h, hashes[i])
    tongues = t.column("l").to_numpy()
    return pa.table({"lang": langs.dictionary.take(pa.array(tongues)), "phrase": phrase, "w": t.column("w_sum"), "h": _more(h, tongue[tongues]) if len(h) else h})


def _blobs(t: pa.Table, buckets: int):
    """A row a bucket, with its part of the table."""
    bucket = (t.column("h").to_numpy() >> np.uint64(40)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    t, bucket = t.select(["lang", "phrase", "w"]).take(pa.array(order)).combine_chunks(), bucket[order]
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(bucket)]):
        sink = pa.BufferOutputStream()
        part = t.slice(lo, hi - lo)
        with pa.ipc.new_stream(sink, part.schema) as out:
            out.write_table(part)
        yield pa.RecordBatch.from_arrays([pa.array([bucket[lo]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "data"])


def counts(rows: DataFrame, n: int, least: int, shorter: bytes | None = None, together: int = TOGETHER) -> DataFrame:
    """(lang, phrase, f, h): the n-grams of these pieces that stand `least` times. shorter: a bitset of the hashes of the
    frequent (n-1)-grams."""
    spark = rows.sparkSession
    buckets = 1 << bucket_bits(spark)
    sent = spark.sparkContext.broadcast(shorter)

    def deal(batches):
        bits = None if sent.value is None else Bits(sent.value)
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= together:
                yield from _blobs(_sums(pa.Table.from_batches(held), n, bits), buckets)
                held, size = [], 0
        if size:
            yield from _blobs(_sums(pa.Table.from_batches(held), n, bits), buckets)

    def add_up(batches):
        own = tempfile.mkdtemp(prefix="quire-duckdb-", dir=os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0])
        try:
            with duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": own}) as con:
                con.execute("create table t (lang varchar, phrase varchar, w bigint)")
                for b in batches:
                    for data in b.column("data"):
                        x = pa.ipc.open_stream(data.as_buffer()).read_all()  # noqa: F841  duckdb finds it by name
                        con.execute("insert into t select lang, phrase, w from x")
                done = con.sql(f"select lang, phrase, sum(w)::bigint as f from t group by lang, phrase having sum(w) >= {int(least)}")
                for out in done.to_arrow_reader(100_000):
                    if out.num_rows:
                        lang, phrase = (out.column(c).cast(pa.string()) for c in ("lang", "phrase"))
                        yield pa.RecordBatch.from_arrays([lang, phrase, out.column("f"), pa.array(_phrase_hashes(lang, phrase).view(np.int64))], ["lang", "phrase", "f", "h"])
        finally:
            shutil.rmtree(own, ignore_errors=True)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = mapped(rows.select("lang", "piece", "m"), deal, "bucket int, data binary").repartition(parts, "bucket")
    return mapped(dealt, add_up, "lang string, phrase string, f long, h long")


def score(a: str, left: str, right: str, scale: int):
    """floor(scale * a / (left + right)), in decimals."""
    d = lambda c: F.col(c).cast("decimal(25, 0)")
    return F.call_function("div", d(a) * F.lit(scale).cast("decimal(10, 0)"), d(left) + d(right))


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, inside: int = 80, scale: int = 2_000_000) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score): the candidates that stay, of all languages.

    a: how often the phrase stands in the language, l and r: its parts at the cut of the lowest score, n: words of the
    language. score: floor(scale * a / (l + r)), in decimal arithmetic. A candidate inside a longer one with at
    least `inside` percent of its occurrences goes. Texts that are null are empty, languages that are null are UNKNOWN; doc_ids
    don't matter, so repeated rows count as often as they stand. Further columns are ignored. An empty table gives an empty
    result."""
    spark = docs.sparkSession
    session(spark)
    scratch = Scratch(spark)
    p = scratch.keep(pieces(docs), "pieces")
    levels, bits = [], None
    for n in range(1, longest + 1):
        c = scratch.keep(counts(p, n, least, bits), f"grams-{n}")
        levels.append(c)
        bits = Bits.of(c.select("h"), c.count())
    size = F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit("")))
    words = scratch.keep(p.groupBy("lang").agg(F.sum(size * F.col("m")).alias("n")), "words")
    scratch.drop("pieces")
    all_counts = levels[0]
    for c in levels[1:]:
        all_counts = all_counts.unionByName(c)
    w = F.split("phrase", " ", -1)
    held = all_counts.select("lang", "phrase", F.col("f").alias("a"), F.size(w).alias("words"), w.alias("w")).where("words > 1")
    # requests for parts, answers, and the cut of the lowest score
    part = lambda a, k: F.array_join(F.slice("w", a, k), " ")
    cut = held.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.explode(F.array(F.struct(part(F.lit(1), F.col("k")).alias("part"), F.lit(True).alias("left")), F.struct(part(F.col("k") + 1, F.col("words") - F.col("k")).alias("part"), F.lit(False).alias("left"))))
    asked = cut.select("lang", "phrase", "a", "words", "k", sides.alias("x")).select("lang", "phrase", "a", "words", "k", "x.part", "x.left")
    counted = all_counts.select("lang", F.col("phrase").alias("part"), "f")
    told = asked.join(counted, ["lang", "part"]).groupBy("lang", "phrase", "a", "words", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    scored = told.withColumn("score", score("a", "l", "r", scale)).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "words")).alias("x")).select("lang", "phrase", "x.a", "x.words", "x.l", "x.r", "x.score")
    # the most frequent longer candidate around each
    lengths = F.expr("explode(flatten(transform(sequence(2, words - 1), z -> transform(sequence(1, words - z + 1), i -> array_join(slice(w, i, z), ' ')))))")
    around = held.where("words > 2").select("lang", lengths.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    within = F.coalesce(F.col("most").cast("decimal(25,0)") * 100 >= F.col("a").cast("decimal(25,0)") * inside, F.lit(False))
    stay = scored.join(around, ["lang", "phrase"], "left").where(~within).drop("most")
    return stay.join(words, "lang").select("lang", "phrase", "words", "a", "l", "r", "n", "score")


#: Parts that a language's candidates are ranked in first.
PARTS = 64


def top(candidates: DataFrame, first: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first of each language by score, a (descending) and phrase (ascending by
    UTF-8 bytes). A language is ranked in hashed parts first, so the last sort gets at most PARTS * first of its rows."""
    by = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = candidates.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).where(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
