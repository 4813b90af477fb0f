"""Side files of documents: affiliations, references, figures and workbooks; and files written one a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import orcid_as_given, references
from quire.operators.people import affiliation_lines
from quire.sources.workbooks import CELLS, read_sheets, read_workbooks  # noqa: F401  readers of side files, too

#: Names in the first column of an authors' sheet that make its row a head.
HEAD_NAMES = ["autor", "nombre", "author", "name"]


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; bytes that are no UTF-8 become replacement marks, a byte order mark stays."""
    return spark.read.format("binaryFile").load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(path, ref_no, raw) from 1 on."""
    return _whole(spark, path).select("path", F.posexplode(references(F.col("text"))).alias("i", "raw")).select("path", (F.col("i") + 1).alias("ref_no"), "raw")


def read_affiliations(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, part, aff_id, label, text, email) of affiliation_lines()."""
    return affiliation_lines(_whole(spark, path), "path")


def read_figures(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files whose extension is that of a figure; others are not read."""
    any_case = ",".join("".join(f"[{c}{c.upper()}]" for c in x) for x in P.FIGURE_FILES)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{any_case}}}").load(path).select("path", "content")


def sheets(cells: DataFrame) -> DataFrame:
    """(path, sheet_no, sheet, active) of the sheets that have a cell; read_sheets() has the others, too."""
    return cells.select("path", "sheet_no", "sheet", "active").distinct()


def grids(cells: DataFrame) -> DataFrame:
    """(path, sheet_no, sheet, active, grid): rows up to the last one with a cell, each as wide as the sheet, nulls where no
    value is. Rows without a cell are empty, but for the first, so a stray cell far off costs no full rectangle."""
    fill = lambda items, at, value, gap: F.aggregate(items, F.array().cast(gap), lambda acc, x: F.concat(acc, F.array_repeat(F.lit(None).cast(gap[6:-1]), x[at] - F.size(acc)), F.array(x[value])))
    row = cells.groupBy("path", "sheet_no", "sheet", "active", "r").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("m"))
    row = row.withColumn("line", fill("m", "c", "v", "array<string>"))
    g = row.groupBy("path", "sheet_no", "sheet", "active").agg(F.array_sort(F.collect_list(F.struct("r", "line"))).alias("m"), F.max(F.size("line")).alias("width"))
    null = F.lit(None).cast("string")
    even = lambda x, i: F.when(x.isNotNull(), F.concat(x, F.array_repeat(null, F.col("width") - F.size(x)))).when(i == 0, F.array_repeat(null, F.col("width"))).otherwise(F.array().cast("array<string>"))
    return g.select("path", "sheet_no", "sheet", "active", F.transform(fill("m", "r", "line", "array<array<string>>"), even).alias("grid"))


def chosen_grids(descriptors: DataFrame, cells: DataFrame) -> DataFrame:
    """descriptors (path, hoja, ...) with grid: that of the sheet of this name, else of the active one; null if the file
    has no filled cell there."""
    g = grids(cells).select(F.col("path").alias("_p"), F.col("sheet").alias("_s"), "active", "grid")
    own = g.select("_p", "_s", "grid").withColumnRenamed("grid", "_own")
    named = descriptors.join(own, (F.col("path") == F.col("_p")) & (F.col("hoja") == F.col("_s")), "left").drop("_p", "_s")
    other = g.where("active").select("_p", F.col("grid").alias("_active"))
    return named.join(other, F.col("path") == F.col("_p"), "left").withColumn("grid", F.coalesce("_own", "_active")).drop("_p", "_own", "_active")


def authors(cells: DataFrame) -> DataFrame:
    """(path, ord, nombre, orcid) of the active sheets: first column names, second ORCIDs (as written if of no such
    form); blank and head rows are left out."""
    x = cells.where("active and c < 2").groupBy("path", "r").agg(F.trim(F.max(F.when(F.col("c") == 0, F.col("v")))).alias("nombre"), F.trim(F.coalesce(F.max(F.when(F.col("c") == 1, F.col("v"))), F.lit(""))).alias("_o"))
    x = x.where((F.coalesce("nombre", F.lit("")) != "") & ~F.lower("nombre").isin(HEAD_NAMES))
    return x.select("path", F.row_number().over(Window.partitionBy("path").orderBy("r")).alias("ord"), "nombre", orcid_as_given(F.col("_o"), False).alias("orcid"))


def write_texts(documents: DataFrame, column: str, path: str) -> None:
    """One folder doc_id=... a document with its text as a file; committed like any table, on any store. For exports of
    some thousand documents: a store lists each folder. Larger ones are better kept as the tables they are."""
    documents.select("doc_id", column).write.mode("overwrite").partitionBy("doc_id").option("lineSep", "\n").text(path)
