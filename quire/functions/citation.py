"""References and front-matter notes as structures, all inside Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import clean, date_parts, escape, norm, publication_type, strip

LIT = F.lit


def _trim(col, chars: str):
    return F.regexp_replace(col, rf"^[{chars}]+|[{chars}]+$", "")


def manuscript_dates(col):
    """array<struct(date_type, day, month, year)> of a document's date notes, joined by a blank; entries of unknown
    kind or without a year are left out."""
    marked = F.split(F.regexp_replace(col, r"(?iuU)(?:manuscrito|manuscript)\s+(\w+)\s*:", "\u0001$1\u0002"), "\u0001")
    kinds = F.create_map(*[LIT(x) for kv in P.DATE_TYPES.items() for x in kv])
    parts = F.transform(
        F.slice(marked, LIT(2), F.size(marked)),
        lambda x: F.struct(kinds[F.lower(F.substring_index(x, "\u0002", 1))].alias("date_type"), date_parts(strip(F.substring_index(x, "\u0002", -1))).alias("d")),
    )
    return F.transform(
        F.filter(parts, lambda x: x["date_type"].isNotNull() & (x["d"]["year"] != "")),
        lambda x: F.struct(x["date_type"].alias("date_type"), x["d"]["day"].alias("day"), x["d"]["month"].alias("month"), x["d"]["year"].alias("year")),
    )


def issue_numbers(notes, doi):
    """struct(year, fpage, lpage, volume, issue) of ordered notes. Each is taken from the first note that has it; a note
    with volume and issue together replaces one of them found alone. The year is never that of a note with an ISSN,
    and is taken from the DOI if no note has one."""
    found = lambda t, p, i: F.regexp_extract(t, p, i)
    some = lambda t, p, groups: F.concat(*[found(t, p, g) for g in groups])

    def step(acc, t):
        both = (acc["volume"] != "") & (acc["issue"] != "")
        pages = (acc["fpage"] != "") | (found(t, P.PAGE_RANGE, 1) == "")
        pair = ~both & t.rlike(P.VOLUME_NUMBER)
        volume = F.when(pair, some(t, P.VOLUME_NUMBER, (1, 3, 5, 7))).otherwise(acc["volume"])
        issue = F.when(pair, some(t, P.VOLUME_NUMBER, (2, 4, 6, 8))).otherwise(acc["issue"])
        year = F.when((acc["year"] == "") & ~F.contains(norm(t), LIT("issn")), found(t, P.YEAR, 0)).otherwise(acc["year"])
        return F.struct(
            year.alias("year"), F.when(pages, acc["fpage"]).otherwise(found(t, P.PAGE_RANGE, 1)).alias("fpage"),
            F.when(pages, acc["lpage"]).otherwise(found(t, P.PAGE_RANGE, 2)).alias("lpage"),
            F.when(volume != "", volume).otherwise(some(t, P.VOLUME_ONLY, (1, 2))).alias("volume"),
            F.when(issue != "", issue).otherwise(some(t, P.NUMBER_ONLY, (1, 2, 3))).alias("issue"),
        )

    names = ("year", "fpage", "lpage", "volume", "issue")
    out = F.aggregate(notes, F.struct(*[LIT("").alias(n) for n in names]), step)
    return F.struct(F.when(out["year"] != "", out["year"]).otherwise(found(F.coalesce(doi, LIT("")), P.YEAR, 0)).alias("year"), *[out[n].alias(n) for n in names[1:]])


def _paired(parts):
    """Pieces with the initials after them, at most one such piece each: in a run of initials every second begins anew."""
    none = F.struct(F.array().cast("array<string>").alias("names"), LIT(True).alias("full"))

    def step(acc, x):
        names, joins = acc["names"], ~acc["full"] & x.rlike(r"^[A-ZÁÉÍÓÚÑÜ][.\s]")
        both = F.concat(F.slice(names, LIT(1), F.size(names) - 1), F.array(F.concat(F.element_at(names, -1), LIT(", "), x)))
        return F.struct(F.when(joins, both).otherwise(F.concat(names, F.array(x))).alias("names"), joins.alias("full"))

    return F.aggregate(parts, none, step, lambda acc: acc["names"])


def cited_authors(col):
    """array<struct(surname, given)> of `Name, A. B., Name, C. & Name, D.`. A piece that begins with an initial belongs to
    the one before it, unless that has taken such a piece already."""
    s = F.regexp_replace(F.regexp_replace(strip(col), r"\s*&\s*", ", "), r"(?iuU)\band\b\s*", "")
    parts = F.filter(F.transform(F.split(s, r",\s*(?=[A-ZÁÉÍÓÚÑÜ][a-záéíóúñü]|\.\s*[A-Z]|$)"), lambda x: _trim(x, " .,")), lambda x: x != "")
    named = F.filter(F.transform(_paired(parts), lambda x: _trim(x, " ,.")), lambda x: x != "")
    return F.transform(named, lambda x: F.struct(
        F.when(F.contains(x, LIT(",")), clean(F.substring_index(x, ",", 1))).otherwise(x).alias("surname"),
        F.when(F.contains(x, LIT(",")), clean(F.regexp_replace(x, "^[^,]*,", ""))).otherwise("").alias("given")))


def citations(refs: DataFrame, text: str = "raw") -> DataFrame:
    """Adds pub_type, doi, url, year, authors, article_title, source, volume, issue, fpage, lpage and elocation.

    Absent values are ''. Without a year in parentheses only pub_type, doi and url are set. Only journals have numbers."""
    own = refs.columns
    x = refs.withColumn("_t", clean(F.coalesce(F.col(text), LIT(""))))
    x = x.withColumn("pub_type", publication_type(F.col("_t")))
    x = x.withColumn("doi", F.regexp_extract("_t", "(?i)" + P.CITED_DOI, 1))
    x = x.withColumn("url", F.when(F.col("doi") == "", F.regexp_extract("_t", "(?i)" + P.CITED_URL, 1)).otherwise(""))
    tail = lambda p: _trim(F.regexp_replace("_t", "(?i)" + p, ""), " .")
    x = x.withColumn("_t", F.when(F.col("doi") != "", tail(P.CITED_DOI)).when(F.col("url") != "", tail(P.CITED_URL)).otherwise(F.col("_t")))
    x = x.withColumns({n: F.regexp_replace(n, r"[.),;]+$", "") for n in ("doi", "url")})
    year, bare = "(?iu)" + P.CITED_YEAR, r"\((\d{4})\)"
    full = F.col("_t").rlike(year)
    x = x.withColumn("year", F.when(full, F.trim(F.regexp_extract("_t", year, 1))).otherwise(F.regexp_extract("_t", bare, 1)))
    halves = F.when(full, F.split("_t", year, 2)).otherwise(F.split("_t", bare, 2))
    x = x.withColumn("_h", F.when(F.col("year") != "", halves))
    x = x.withColumn("authors", F.when(F.col("_h").isNotNull(), cited_authors(_trim(F.get("_h", LIT(0)), " ."))).otherwise(F.array().cast("array<struct<surname:string,given:string>>")))
    rest = F.regexp_replace(F.when(full, strip(F.get("_h", LIT(1)))).otherwise(_trim(F.get("_h", LIT(1)), " .")), r"\.+$", "")
    x = x.withColumn("_s", F.filter(F.transform(F.split(F.coalesce(rest, LIT("")), r"\.\s+"), strip), lambda y: y != ""))
    x = x.withColumn("article_title", F.coalesce(F.get("_s", LIT(0)), LIT(""))).withColumn("_j", F.coalesce(F.get("_s", LIT(1)), LIT("")))
    journal = F.col("pub_type") == "journal"
    both, lone = journal & F.col("_j").rlike(P.VOLUME_ISSUE_PAGES), journal & F.col("_j").rlike(P.VOLUME_PAGES)
    cut = lambda p: _trim(F.regexp_replace("_j", p, ""), " ,")
    x = x.withColumn("source", F.when(both, cut(P.VOLUME_ISSUE_PAGES)).when(lone, cut(P.VOLUME_PAGES)).otherwise(F.col("_j")))
    x = x.withColumn("volume", F.when(both, F.regexp_extract("_j", P.VOLUME_ISSUE_PAGES, 1)).when(lone, F.regexp_extract("_j", P.VOLUME_PAGES, 1)).otherwise(""))
    x = x.withColumn("issue", F.when(both, F.regexp_extract("_j", P.VOLUME_ISSUE_PAGES, 2)).otherwise(""))
    x = x.withColumn("_p", _trim(F.when(both, F.regexp_extract("_j", P.VOLUME_ISSUE_PAGES, 3)).when(lone, F.regexp_extract("_j", P.VOLUME_PAGES, 2)).otherwise(""), " ."))
    x = x.withColumn("fpage", F.regexp_extract("_p", P.PAGES, 1)).withColumn("lpage", F.regexp_extract("_p", P.PAGES, 2))
    x = x.withColumn("elocation", F.when(F.col("lpage") == "", F.col("_p")).otherwise(""))
    return x.select(*own, "pub_type", "doi", "url", "year", "authors", "article_title", "source", "volume", "issue", "fpage", "lpage", "elocation")


def element_citation(text: str = "raw"):
    """XML of a row of citations(): the whole text, then its structure; without a year the text again with its kind."""
    tag = lambda name, col, attr="": F.when(F.col(col) != "", F.concat(LIT(f"<{name}{attr}>"), escape(F.col(col)), LIT(f"</{name}>")))
    name = lambda a: F.concat(LIT("<name><surname>"), escape(a["surname"]), LIT("</surname>"), F.when(a["given"] != "", F.concat(LIT("<given-names>"), escape(a["given"]), LIT("</given-names>"))).otherwise(""), LIT("</name>"))
    people = F.when(F.size("authors") > 0, F.concat(LIT('<person-group person-group-type="author">'), F.array_join(F.transform(F.filter("authors", lambda a: a["surname"] != ""), name), ""), LIT("</person-group>")))
    year = F.concat(LIT('<year iso-8601-date="'), F.regexp_extract("year", r"^\d*", 0), LIT('">'), escape(F.col("year")), LIT("</year>"))
    link = F.when(F.col("url") != "", F.concat(LIT('<ext-link ext-link-type="uri" xlink:href="'), F.replace(escape(F.col("url")), LIT('"'), LIT("&quot;")), LIT('">'), escape(F.col("url")), LIT("</ext-link>")))
    kind = F.concat(LIT(' publication-type="'), F.col("pub_type"), LIT('">'))
    inner = F.concat_ws("", people, year, tag("article-title", "article_title"), tag("source", "source"), tag("volume", "volume"), tag("issue", "issue"), tag("fpage", "fpage"), tag("lpage", "lpage"), tag("elocation-id", "elocation"), tag("pub-id", "doi", ' pub-id-type="doi"'), link)
    whole = F.concat(escape(clean(F.col(text))), LIT("</mixed-citation>"))
    return F.concat(LIT("<mixed-citation>"), whole, F.when(F.col("year") != "", F.concat(LIT("<element-citation"), kind, inner, LIT("</element-citation>"))).otherwise(F.concat(LIT("<mixed-citation"), kind, whole)))
