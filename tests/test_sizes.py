"""Where rows are dealt, and how often blocks are made: what seconds and memory of large tables depend on."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions import text as T
from quire.operators import blocks as B
from quire.operators import layout, people, splits
from quire.plans import more, registry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def test_affiliation_texts_are_dealt_before_they_are_cut(spark):
    shown = plan(people.affiliation_lines(spark.createDataFrame([(1, "1 Uno, Chile")], "doc_id long, text string"), "doc_id"))
    assert shown.count("Exchange") == 1 and shown.index("Exchange") > shown.rindex("Generate")


def test_plain_texts_are_not_translated(spark):
    texts = ["plain", "año", "½ ㎞", "각", "é", "İ", "…", "ﬁn", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.norm(F.col("t")), T._fold(F.col("t"), T._CANONICAL)).collect()
    assert [r[0] for r in got] == ["plain", "ano", "1⁄2 km", "각", "e", "i", "...", "fin", ""]
    assert [r[1] for r in got] == ["plain", "ano", "½ ㎞", "각", "e", "I", "…", "ﬁn", ""]
    rare = T._rare(T._COMPATIBLE.signs + T._SYLLABLES)
    held = spark.createDataFrame([(c,) for c in T._COMPATIBLE.signs + T._SYLLABLES], "c string")
    assert not held.where(~F.col("c").rlike(rare)).count()


def test_parts_grow_with_the_files(spark, monkeypatch):
    size = lambda: registry.blocks(spark, SF).rdd.getNumPartitions()
    few = size()
    monkeypatch.setattr(B, "DEAL", 10_000)
    assert few >= spark.sparkContext.defaultParallelism and size() > 4 * few


def test_blocks_are_dealt_once(spark):
    assert plan(registry._fused(spark, SF)).count("Exchange") == 1


def test_a_book_is_one_pass_over_the_blocks(spark):
    assert plan(more.queries()["book_texts"](spark, SF)).count("posexplode") <= plan(more.queries()["html_pages"](spark, SF)).count("posexplode")


def test_parts_grow_with_the_texts(spark, tmp_path):
    """Files store a text that repeats once; a part takes as many bytes of text all the same, and equal rows spread."""
    spark.range(4000).selectExpr("id as doc_id", "repeat('abcdefgh', 2500) as text").repartition(1).write.parquet(str(tmp_path / "d"))
    files = spark.read.parquet(str(tmp_path / "d"))
    for by in ("doc_id", ""):
        got = [r["count"] for r in B.dealt(files, "doc_id", "text", by=by).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(got) == 4000 and len(got) >= 4000 * 20_000 // B.DEAL and max(got) < 4000 // 4


def test_one_task_of_a_row_group_holds_no_rows(spark, monkeypatch):
    """Up to DIRECT parts are written straight to files; more are dealt in two steps. Rows dealt by value are not sorted."""
    files = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, files.select("doc_id", "text").collect()))
    monkeypatch.setattr(B, "DEAL", 1000)
    for by in ("doc_id", ""):
        rows = B.dealt(files, "doc_id", "text", by=by)
        shown = plan(rows)
        assert rows.rdd.getNumPartitions() > B.DIRECT and shown.count("Exchange") == 2 and "RoundRobin" not in shown
        assert f", {B.DIRECT})" in shown.replace(", REPARTITION_BY_NUM", ")").replace("))", ")")
        assert sorted(map(tuple, rows.collect())) == want


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_fragment_is_made_once(spark):
    """Not once to ask whether it is empty and once more to keep it."""
    shown = optimized(more.queries()["html_pages"](spark, SF))
    assert shown.count("titulo-principal") == 1 and shown.count("subseccion-bajo") == 2


def test_routed_texts_are_cleaned_once(spark):
    shown = optimized(splits.route(registry.blocks(spark, SF).withColumn("clasificacion", F.lit(P.SECCION))).select("text"))
    assert shown.count("[\u00ad\ufffc\ufffe]") == 1


def test_texts_of_scans_are_made_once(spark):
    assert optimized(layout.text_blocks(more._pages(spark, SF))).count("aggregate(") == 1
    # the size's mean and the text, each once
    assert optimized(layout.raw_blocks(more._pages(spark, SF)).select("seq", "contenido", "size")).count("aggregate(") == 2


def test_strip_knows_the_white_space_of_patterns(spark):
    x = spark.range(0x110000).where("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    differ = T.strip(F.concat("c", F.lit("a b"), "c")) != F.regexp_replace(F.concat("c", F.lit("a b"), "c"), r"(?U)^\s+|\s+$", "")
    assert x.count() == 0x110000 - 2048 and not x.where(differ).count()


def test_guards_change_no_text(spark):
    """What is searched for first lets every text through that the pattern after it may find."""
    tags = [y for x in P.EDITORIAL.replace("\\.", ".").split("|") for y in (x.replace("(?: examinado)?", ""), x.replace("(?: examinado)?", " examinado").replace("?", ""))]
    texts = [z for t in tags for z in (t, f"a {t} b", f"<{t.upper()}", f"x{t}", t[:-1])] + ["", "fin.", "Sinonim\u0131a. k", "Remar\u212as. y", None]
    x = spark.createDataFrame([(t,) for t in texts], "t string")
    assert x.where(~T.editorial(F.col("t")).eqNullSafe(T._editorial(F.col("t")))).collect() == []
    notes = ["Manuscrito  recibido: 5", "MANU\u017fCRIPT revised", "manuscript", "", None]
    x = spark.createDataFrame([(t,) for t in notes], "t string")
    assert x.where(~T.is_date_note(F.col("t")).eqNullSafe(T.has(F.col("t"), P.MANUSCRIPT))).collect() == []
