"""Files a document: layout, bytes, overwriting, appending, failing tasks."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import render
from quire.sources import sinks


def listed(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_many_documents_in_folders_of_bounded_size(spark, tmp_path):
    df = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("<p>é "), F.col("id"), F.lit("</p>")).alias("html")).repartition(8)
    sinks.write_files(df, "html", str(tmp_path / "out"))
    sizes = [len(files) for d, _, files in os.walk(tmp_path / "out") if os.path.basename(os.path.dirname(d)).startswith("part-")]
    assert max(sizes) == sinks.FOLDER and sum(sizes) == 100_000
    back = sinks.read_files(spark, str(tmp_path / "out"))
    assert back.count() == 100_000
    assert not back.select("doc_id", F.col("content").cast("string")).exceptAll(df.select(F.col("doc_id").cast("string"), "html")).count()


def test_names_nulls_and_repeats(spark, tmp_path):
    rows = [("a/b ../c", "x"), (None, "y"), (None, "z"), ("q", None), ("q", "1"), ("q", "2"), ("", "")]
    df = spark.createDataFrame(rows, "doc_id string, html string").coalesce(1)
    sinks.write_files(df, "html", f"file://{tmp_path}/out", "txt")
    back = [(r.doc_id, r.file and r.file.rsplit("/", 1)[-1], None if r.content is None else bytes(r.content).decode()) for r in sinks.read_files(spark, f"file://{tmp_path}/out").collect()]
    assert back == [("a/b ../c", "a_b_c.txt", "x"), (None, "none.txt", "y"), (None, "none.2.txt", "z"), ("q", None, None), ("q", "q.txt", "1"), ("q", "q.2.txt", "2"), ("", ".txt", "")]


def test_a_rerun_replaces_and_append_adds(spark, tmp_path):
    out = str(tmp_path / "out")
    one, two = (spark.range(n).select(F.col("id").alias("doc_id"), F.lit(t).alias("html")) for n, t in ((30, "old"), (7, "new")))
    sinks.write_files(one, "html", out)
    first = listed(out)
    sinks.write_files(two, "html", out)
    again = listed(out)
    assert not {f for f in first if f != "_current"} & set(again) and len([f for f in again if f.endswith(".html")]) == 7
    sinks.write_files(one, "html", out, mode="append")
    assert sorted(bytes(r.content).decode() for r in sinks.read_files(spark, out).collect()) == ["new"] * 7 + ["old"] * 30
    assert not [f for f in os.listdir(out) if f.startswith("_writing")]


def test_a_failed_write_leaves_nothing_and_keeps_the_old(spark, tmp_path):
    out = str(tmp_path / "out")
    sinks.write_files(spark.range(5).select(F.col("id").alias("doc_id"), F.lit("kept").alias("html")), "html", out)
    before = listed(out)

    def broken(batches):
        for b in batches:
            yield b
            if 99 in b["doc_id"].to_pylist():
                raise RuntimeError("killed")

    bad = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("lost").alias("html")).repartitionByRange(4, "doc_id").mapInArrow(broken, "doc_id long, html string")
    with pytest.raises(Exception, match="killed"):
        sinks.write_files(bad, "html", out)
    assert listed(out) == before and sorted(os.listdir(out)) == sorted({f.split("/")[0] for f in before})
    assert {bytes(r.content) for r in sinks.read_files(spark, out).collect()} == {b"kept"}


def test_an_attempt_that_died_leaves_no_file(spark, tmp_path):
    """A retried task: what its first attempt wrote goes with the commit."""
    out = str(tmp_path / "out")
    w = sinks.DocumentWriter({"path": out, "column": "html"}, True)
    left = tmp_path / "out" / f"_writing-{w.write_id}" / "0-dead" / "00"
    left.mkdir(parents=True)
    (left / "1.html").write_text("half")
    good = tmp_path / "out" / f"_writing-{w.write_id}" / "0-good"
    good.mkdir()
    (good / "_index").write_text("")
    w.commit([sinks.Written(str(good), 0, 0), None])
    assert listed(out) == ["_current", f"part-{w.write_id}-00000/_index"]


def test_a_changed_file_is_noticed(spark, tmp_path):
    out = str(tmp_path / "out")
    sinks.write_files(spark.createDataFrame([(1, "abc")], "doc_id long, html string"), "html", out)
    path = next(f for f in listed(out) if f.endswith(".html"))
    (tmp_path / "out" / path).write_text("abd")
    with pytest.raises(Exception, match="not what was written"):
        sinks.read_files(spark, out).collect()


def test_nothing_written_reads_empty(spark, tmp_path):
    assert not sinks.read_files(spark, str(tmp_path / "none")).count()
    sinks.write_files(spark.createDataFrame([], "doc_id long, html string"), "html", str(tmp_path / "out"))
    assert not sinks.read_files(spark, str(tmp_path / "out")).count()


def test_books_come_back_byte_for_byte(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"<html><head><style>p{{}}</style></head><body><p>n {i}</p></body></html>", f"T {i}") for i in range(4)], "doc_id long, html string, title string")
    blocks = spark.createDataFrame([(i, 0, f"Uno {i}", "Título principal", False) for i in range(4)], "doc_id long, seq int, contenido string, clasificacion string, italic boolean")
    books = render.epub_documents(pages, blocks)
    sinks.write_files(books, "epub", str(tmp_path / "out"))
    want = {str(r.doc_id): bytes(r.epub) for r in books.collect()}
    got = {r.doc_id: bytes(r.content) for r in sinks.read_files(spark, str(tmp_path / "out")).collect()}
    assert got == want and len(got) == 4 and all(zipfile.ZipFile(io.BytesIO(x)).namelist()[0] == "mimetype" for x in got.values())
