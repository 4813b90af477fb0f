"""Authors, affiliations and addresses of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import affiliations, author_names, clean, emails, escape, orcid, orcid_as_given, orcid_search, strip


def manual_authors(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(doc_id, ord, nombre, orcid) of rows (doc_id, name, orcid) given by hand, in their order; an address is taken for
    the identifier it holds."""
    x = spark.createDataFrame([(d, i + 1, n or "", o or "") for i, (d, n, o) in enumerate(rows)], "doc_id long, ord int, nombre string, orcid string")
    return x.withColumns({"nombre": strip(F.col("nombre")), "orcid": orcid_as_given(F.col("orcid"))})


def append_authors(first: DataFrame, then: DataFrame) -> DataFrame:
    """The authors of the first table, then those of the second, numbered through for each document."""
    names = ["doc_id", "ord", "nombre", "orcid"]
    both = first.select(*names, F.lit(0).alias("_k")).unionByName(then.select(*names, F.lit(1).alias("_k")))
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("_k", "ord"))).drop("_k")


def listed_authors(authors: DataFrame) -> DataFrame:
    """Authors with clean names and identifiers only; those without a name go."""
    x = authors.select("doc_id", "ord", clean(F.coalesce("nombre", F.lit(""))).alias("nombre"), orcid(F.coalesce("orcid", F.lit(""))).alias("orcid"))
    return x.where("nombre <> ''")


def authors_of_blocks(blocks: DataFrame) -> DataFrame:
    """Authors named by blocks of that label, parted by semicolons, without identifiers."""
    x = blocks.where(F.col("clasificacion") == P.AUTORES).select("doc_id", "seq", F.posexplode(author_names(F.col("contenido"))).alias("i", "nombre"))
    return x.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "i")).alias("ord"), "nombre", F.lit("").alias("orcid"))


def preferred(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first table's rows, and of documents without any the second's."""
    return first.unionByName(second.join(first.select("doc_id").distinct(), "doc_id", "left_anti").select(*first.columns))


def affiliation_lines(texts: DataFrame, *key: str) -> DataFrame:
    """Of texts (key columns, text): key, line, part, aff_id, label, text, email. Lines of `*` and an address are e-mails;
    others one affiliation or more, numbered aff1, aff2 ... for each key. A line without a mark is one affiliation, labelled
    by its number. Texts are dealt by their key before they are cut, as small ones may lie in one row group of a file."""
    line = texts.select(*key, "text").repartition(*key).select(*key, F.posexplode(F.split("text", r"\r?\n")).alias("line", "t")).withColumn("t", clean(F.col("t"))).where("t <> ''")
    mail = F.regexp_extract("t", P.EMAIL_ANY, 0)
    x = line.withColumn("email", F.when(F.col("t").startswith("*") & (mail != ""), mail)).withColumn("_a", affiliations(F.col("t"), by_mark=True))
    whole = F.array(F.struct(F.lit("").alias("label"), F.col("t").alias("body")))
    x = x.withColumn("_a", F.when(F.col("email").isNotNull(), F.array(F.struct(F.lit("").alias("label"), F.lit("").alias("body")))).when(F.size("_a") > 0, F.col("_a")).otherwise(whole))
    x = x.select(*key, "line", "email", F.posexplode("_a").alias("part", "a"))
    n = F.sum(F.col("email").isNull().cast("int")).over(Window.partitionBy(*key).orderBy("line", "part").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_n", n).withColumn("aff_id", F.when(F.col("email").isNull(), F.concat(F.lit("aff"), F.col("_n").cast("string"))))
    return x.select(*key, "line", "part", "aff_id", F.when(F.col("a.label") != "", F.col("a.label")).otherwise(F.col("_n").cast("string")).alias("label"), F.col("a.body").alias("text"), "email")


def affiliations_of_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, aff_id, label, text) of blocks labelled as affiliations, numbered."""
    x = blocks.where(F.col("clasificacion") == P.FILIACION).select("doc_id", "seq", clean(F.col("contenido")).alias("text")).where("text <> ''")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    return x.withColumn("ord", n).select("doc_id", "ord", F.concat(F.lit("aff"), F.col("ord").cast("string")).alias("aff_id"), F.col("ord").cast("string").alias("label"), "text")


def emails_of_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, email): distinct addresses of blocks of that label, in order of their first place."""
    x = blocks.where(F.col("clasificacion") == P.EMAIL).select("doc_id", "seq", F.posexplode(emails(clean(F.col("contenido")))).alias("i", "email"))
    x = x.groupBy("doc_id", "email").agg(F.min(F.struct("seq", "i")).alias("_f"))
    return x.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("_f")).alias("ord"), "email")


def author_links(authors: DataFrame, affs: DataFrame, mails: DataFrame) -> DataFrame:
    """(doc_id, ord, ref_type, rid, label): each author's references, to every affiliation of the document, and the first
    author's to the correspondence, if there is an address."""
    a = authors.select("doc_id", "ord")
    to = a.join(affs.select("doc_id", F.col("aff_id").alias("rid"), "label"), "doc_id").select("doc_id", "ord", F.lit("aff").alias("ref_type"), "rid", "label")
    first = a.groupBy("doc_id").agg(F.min("ord").alias("ord")).join(mails.select("doc_id").distinct(), "doc_id", "left_semi")
    return to.unionByName(first.select("doc_id", "ord", F.lit("corresp").alias("ref_type"), F.lit("cor1").alias("rid"), F.lit("").alias("label")))


#: The sign beside a name that links to its identifier: a green disc.
ICON = "data:image/svg+xml;utf8,%3Csvg xmlns='http://www.w3.org/2000/svg' viewBox='0 0 24 24'%3E%3Ccircle cx='12' cy='12' r='12' fill='%23A6CE39'/%3E%3C/svg%3E"


def _link(css: str, url, title, inner):
    return F.concat(F.lit(f'<a class="{css}" href="'), url, F.lit('" target="_blank" title="'), title, F.lit('">'), inner, F.lit("</a>"))


_IMAGE = f'<img src="{ICON}" alt="ORCID">'


def author_line(listed):
    """HTML of array<struct(nombre, orcid)>: names linked to their identifiers, with a sign; those without one to a search."""
    home = lambda a: F.concat(F.lit(P.ORCID_HOME), strip(a["orcid"]))
    title = lambda a: F.concat(F.lit("ORCID: "), strip(a["orcid"]))
    one = lambda a: F.when(strip(a["orcid"]) != "", F.concat(_link("orcid-autor", home(a), title(a), escape(strip(a["nombre"]))), _link("orcid-icon", home(a), title(a), F.lit(_IMAGE)))).otherwise(
        _link("orcid-autor", orcid_search(strip(a["nombre"])), F.lit("Buscar en ORCID"), escape(strip(a["nombre"]))))
    return F.array_join(F.transform(F.filter(listed, lambda a: strip(a["nombre"]) != ""), one), "; ")


def found_author_line(col):
    """HTML of a line of names: each linked to a search, with a sign."""
    one = lambda n: F.concat(_link("orcid-autor", orcid_search(n), F.concat(F.lit("Buscar "), escape(n), F.lit(" en ORCID")), escape(n)), _link("orcid-icon", orcid_search(n), F.lit("Buscar en ORCID"), F.lit(_IMAGE)))
    return F.array_join(F.transform(author_names(col), one), "; ")


def affiliation_line(col):
    """HTML of a line: an address after `*`, affiliations with their marks raised, or the line itself."""
    p = lambda css, inner: F.concat(F.lit(f'<p class="{css} sin-sangria">'), inner, F.lit("</p>"))
    t, found = strip(col), affiliations(col)
    mail = F.regexp_extract(t, P.PAGE_EMAIL, 0)
    link = p("email", F.concat(F.lit('* <a href="mailto:'), mail, F.lit('">'), escape(mail), F.lit("</a>")))
    parts = F.array_join(F.transform(found, lambda a: p("filiaciones", F.concat(F.lit("<sup>"), escape(a["label"]), F.lit("</sup> "), escape(a["body"])))), "\n")
    return F.when(t == "", "").when(t.rlike(r"^\*\s*" + P.PAGE_EMAIL), link).when(F.size(found) > 0, parts).otherwise(p("filiaciones", escape(t)))


def affiliations_html(text):
    """HTML of a whole file of affiliations."""
    return F.array_join(F.filter(F.transform(F.split(text, r"\r?\n"), affiliation_line), lambda x: x != ""), "\n")
