"""Blocks as HTML, JATS and EPUB: a fragment a block, one row a document."""

from __future__ import annotations

import io
import uuid
import zipfile
from html import escape as esc

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.citation import citations, element_citation, issue_numbers, manuscript_dates
from quire.functions.text import (
    affiliations, anchor_text, as_xhtml, author_names, autolink, body_of, clean, country, css_of, date_notes, distinct_keywords, doi, editorial, emails, escape, first_doi_address, html_table,
    is_period, issn, jats_table, keywords, let, norm, person, reference_text, strip,
)
from quire.operators.blocks import with_author_zone
from quire.operators.people import affiliation_lines, affiliations_html, author_line, found_author_line, listed_authors

#: Characters that XML does not know.
ILLEGAL = "[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"


def ordered(col, sep: str, *keys: str):
    """Texts of a group in the order of the keys."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, col.alias("_v")))), lambda x: x["_v"]), sep)


def paragraph_or_list(col, css: str = "cuerpo"):
    """A paragraph, or, at bullets, an introduction and items; an item that ends in a new introduction with a colon
    closes its list and opens another. css: cuerpo, abstract or none."""
    style, more = {"cuerpo": ("cuerpo", " cuerpo-list"), "abstract": ("abstract sin-sangria", " abstract-list")}.get(css, (css, ""))
    return let(strip(col), lambda t: _paragraph_or_list(t, style, more))


def _paragraph_or_list(t, style: str, more: str):
    p = F.lit(f'<p class="{style}">' if style else "<p>")
    parts = F.filter(F.transform(F.split(t, "•"), strip), lambda x: x != "")
    token = lambda kind, text: F.struct(F.lit(kind).alias("k"), text.alias("t"))
    turn = r"(?U)^(.*?[.;])\s+([A-ZÁÉÍÓÚÑ][^:]{4,}:)\s*$"
    item = lambda s: F.when(s.rlike(turn), F.array(token("li", F.regexp_extract(s, turn, 1)), token("p", F.regexp_extract(s, turn, 2)))).otherwise(F.array(token("li", s)))
    bare = t.startswith("•")
    tokens = F.flatten(F.transform(parts, lambda s, i: F.when((i == 0) & ~bare, F.array(token("p", s))).otherwise(item(s))))
    is_li = lambda i: F.coalesce(F.get(tokens, i)["k"] == "li", F.lit(False))
    ul = f'<ul class="lista-bullets{more}">\n'
    lines = F.transform(tokens, lambda x, i: F.when(x["k"] == "p", F.concat(p, editorial(x["t"]), F.lit("</p>"))).otherwise(
        F.concat(F.when(~is_li(i - 1), F.lit(ul)).otherwise(""), F.lit("  <li>"), editorial(x["t"]), F.lit("</li>"), F.when(~is_li(i + 1), "\n</ul>").otherwise(""))))
    return F.when(F.contains(t, F.lit("•")) & (F.size(parts) > 0), F.array_join(lines, "\n")).when(t != "", F.concat(p, editorial(t), F.lit("</p>"))).otherwise("")


def rejoined(col):
    """array<string>: the paragraphs of a fused block; those that the one before does not end are joined to it, a dash
    before a small letter dropped. Sub-headings keep their mark and stand alone."""
    return let(F.filter(F.transform(F.split(col, "\n\n"), strip), lambda x: x != ""), lambda parts: F.when(F.size(parts) < 2, parts).otherwise(_rejoined(parts)))


def _rejoined(parts):
    dash = "[\u2010-\u2014-]\\s*$"

    def step(acc, x):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & ~x.startswith("§SUB§") & ~last.startswith("§SUB§") & ~last.rlike("[.?!:]$")
        both = F.when(last.rlike(dash) & x.rlike("^[a-záéíóúñü]"), F.concat(F.regexp_replace(last, dash, ""), x)).otherwise(F.concat(last, F.lit(" "), x))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(parts, F.array(F.lit("")), lambda acc, x: F.when(F.element_at(acc, -1) == "", F.array(x)).otherwise(step(acc, x)), lambda acc: F.filter(acc, lambda x: x != ""))


def _tag(name: str, body, css: str = ""):
    return F.concat(F.lit(f'<{name} class="{css}">' if css else f"<{name}>"), body, F.lit(f"</{name}>"))


def heading_style(text, grey, journal: str = ""):
    """Classes of a section heading: that of issue data (as is the journal's name, if one is given), or ruled, grey, both or
    none. grey: whether it opens the second or a later abstract."""
    low = F.lower(strip(text))
    pale = F.when(low.isin(P.ABSTRACTS), grey).otherwise(low == "keywords")
    ruled = low.isin(P.RULED)
    named = (norm(text) == norm(F.lit(journal))) if journal else F.lit(False)
    return F.when(text.rlike("(?iu)" + P.META_HEADING) | named, "seccion meta").when(ruled & pale, "seccion con-linea gris").when(ruled, "seccion con-linea").when(pale, "seccion gris").otherwise("seccion")


def styled(blocks: DataFrame, *within: str) -> DataFrame:
    """Adds what a block's look depends on: `gris`, whether it belongs to the second abstract or a later one, and `primero`,
    whether it is the first heading of level 1. Headings of keywords leave the abstract open; others end it. within: columns
    that part a document's blocks into some that know nothing of the others."""
    c = F.col("clasificacion")
    head = c == P.SECCION
    low = F.when(head, F.lower(strip(escape(F.col("contenido")))))  # of headings only: what an And's sides share is evaluated for every text
    opens = head & low.isin(P.ABSTRACTS)
    w = Window.partitionBy("doc_id", *within).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    x = blocks.withColumn("_nth", F.sum(opens.cast("int")).over(w))
    event = F.when(opens, F.col("_nth") >= 2).when((head & ~low.isin("palabras clave", "keywords")) | (c == P.SUB), False)
    x = x.withColumn("gris", F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(False)))
    return x.withColumn("primero", (c == P.SUB) & (F.sum((c == P.SUB).cast("int")).over(w) == 1)).drop("_nth")


def fragment(text="contenido", label="clasificacion", gris="gris", primero="primero", italic="italic", journal: str = ""):
    """HTML of one block by its label and styled()'s columns; null for blocks that are not shown."""
    c, t, grey = F.col(label), F.col(text), F.col(gris)
    plain = escape(t)
    parts = rejoined(t)
    body = F.array_join(F.transform(parts, lambda x: F.when(x.startswith("§SUB§"), _tag("h3", escape(F.substring(x, F.lit(6), F.length(x))), "subseccion-bajo")).otherwise(paragraph_or_list(x))), "\n")
    some = lambda value: let(value, lambda v: F.when(v != "", v))  # noqa: E731  (nullif would make it twice)
    heading = F.concat(F.lit('<h2 class="'), heading_style(plain, grey, journal), F.lit('">'), plain, F.lit("</h2>"))
    key = F.regexp_replace(plain, r"^(?iu)((palabras\s+clave|keywords)\s*[:.]?)\s*", "<strong>$1</strong> ")
    key = F.regexp_replace(key, r"^<strong>([^<]*?)\s+</strong>", "<strong>$1</strong>")
    style = F.when(grey, '<p class="keywords sin-sangria" style="color:#666;font-style:italic;">').otherwise('<p class="keywords sin-sangria">')
    return (
        F.when(c.isin(*P.PASSING), None).when(c == P.TITULO, _tag("h1", plain, "titulo-principal")).when(c == P.TITULO2, _tag("h2", plain, "titulo-secundario"))
        .when(c == P.AUTORES, _tag("p", found_author_line(t), "autores sin-sangria")).when(c == P.FILIACION, affiliation_block(t)).when(c == P.EMAIL, _tag("p", autolink(plain), "email sin-sangria"))
        .when(c == P.SECCION, heading).when(c == P.SUB, F.when(F.col(primero), _tag("h3", plain, "subseccion primer-nivel1")).otherwise(_tag("h3", plain, "subseccion")))
        .when(c == P.SUB2, _tag("h3", plain, "subseccion-bajo")).when(c == P.RESUMEN, F.when(F.col(italic), _tag("p", plain, "abstract sin-sangria")).otherwise(_tag("p", plain, "resumen sin-sangria")))
        .when(c == P.CLAVE, F.concat(style, key, F.lit("</p>"))).when(c == P.ABSTRACT_BODY, some(paragraph_or_list(t, "abstract")))
        .when(c == P.REFERENCIA, F.concat(F.lit('<p style="padding-left:1.5em;text-indent:-1.5em;font-size:10pt;">'), plain, F.lit("</p>")))
        .when(c.isin(P.CUERPO, P.NORMAL), some(body))
    )


def affiliation_block(t):
    one = lambda a: _tag("p", F.concat(F.lit("<sup>"), escape(a["label"]), F.lit("</sup> "), escape(a["body"])), "filiaciones sin-sangria")
    return let(affiliations(t), lambda found: F.when(F.size(found) > 0, F.array_join(F.transform(found, one), "\n")).otherwise(_tag("p", escape(t), "filiaciones sin-sangria")))


def _noted(blocks: DataFrame, *within: str) -> DataFrame:
    """Adds _note: whether a block is one of notes_before_references()."""
    c = F.col("clasificacion")
    ref = F.min(F.when((c == P.SECCION) & F.col("contenido").rlike("(?i)referencia|reference"), F.col("seq"))).over(Window.partitionBy("doc_id", *within))
    early = c.isin(P.CITAR, P.FECHA) & (F.col("_ref").isNull() | (F.col("seq") <= F.col("_ref")))
    x = blocks.withColumn("_ref", ref).withColumn("_early", early)
    w = Window.partitionBy("doc_id", *within, "_early", "clasificacion", F.when(F.col("_early"), F.substring(strip(F.col("contenido")), 1, 80))).orderBy("seq")
    return x.withColumn("_note", F.col("_early") & (F.row_number().over(w) == 1)).drop("_ref", "_early")


def notes_before_references(blocks: DataFrame) -> DataFrame:
    """How-to-cite and date notes that stand before the heading of the references, each text (its first 80 characters)
    once."""
    return _noted(blocks).where("_note").drop("_note")


def _note_lists(of):
    """Columns cite, dates, dois and dated of a group's notes. of(kind, value): their values in order."""
    t = strip(F.col("contenido"))
    left = lambda t: let(first_doi_address(t), lambda d: F.when(d != "", F.regexp_replace(F.replace(t, d, F.lit("")), r"^[ .]+|[ .]+$", "")).otherwise(t))
    lines = let(t, lambda t: F.transform(date_notes(left(t)), lambda x: F.concat(F.lit("  <li>"), escape(x), F.lit("</li>"))))
    dates = of(P.FECHA, lines)
    return [of(P.CITAR, _tag("p", escape(F.col("contenido")), "como-citar")).alias("cite"), F.flatten(dates).alias("dates"),
            F.array_distinct(F.filter(of(P.FECHA, first_doi_address(t)), lambda x: x != "")).alias("dois"), (F.size(dates) > 0).alias("dated")]


def _note_html():
    links = F.transform("dois", lambda d: F.concat(F.lit('  <li><a href="'), d, F.lit('" target="_blank">'), escape(d), F.lit("</a></li>")))
    dates = F.when(F.col("dated"), F.concat(F.array(F.lit('<div class="fechas-manuscrito"><ul>')), F.col("dates"), links, F.array(F.lit("</ul></div>")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(F.lit('<div class="post-referencias">')), F.col("cite"), dates, F.array(F.lit("</div>"))), "\n")


def after_references(notes: DataFrame) -> DataFrame:
    """(doc_id, html): the block after the references: how to cite, the sentences of date notes, then distinct DOI
    addresses in order of their first note."""
    return notes.groupBy("doc_id").agg(*_note_lists(lambda kind, value: _ordered(F.col("clasificacion") == kind, value, "seq"))).select("doc_id", _note_html().alias("html"))


def html_documents(blocks: DataFrame, css: str = "", authors: DataFrame | None = None, affiliation_texts: DataFrame | None = None, references: DataFrame | None = None, journal: str = "", book: bool = False) -> DataFrame:
    """(doc_id, title, html): a page a document of its fragments in order of seq; book: and sections and doi, which
    epub_parts() asks for, of the same pass.

    Blocks between title and abstract are left out. Authors (doc_id, ord, nombre, orcid) stand for author blocks and, with
    the affiliations (doc_id, text: a file's text), follow the first secondary title, without one the first title.
    References (doc_id, ref_no, raw) follow the heading of the references and stand for reference blocks. Notes follow at
    the end. title: the first main title, `Artículo` without one."""
    spark, c = blocks.sparkSession, F.col("clasificacion")
    if "italic" not in blocks.columns:
        blocks = blocks.withColumn("italic", F.lit(False))
    none = lambda schema: spark.createDataFrame([], schema)
    people = authors if authors is not None else none("doc_id long, ord int, nombre string, orcid string")
    people = people.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "nombre", "orcid"))), lambda x: F.struct(x["nombre"].alias("nombre"), x["orcid"].alias("orcid"))).alias("_p"))
    places = affiliation_texts if affiliation_texts is not None else none("doc_id long, text string")
    cited = references if references is not None else none("doc_id long, ref_no int, raw string")
    cited = cited.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_no", "raw"))), lambda x: F.concat(F.lit("  <li>"), escape(x["raw"]), F.lit("</li>"))).alias("_refs"))
    side = people.select("doc_id", _tag("p", author_line(F.col("_p")), "autores sin-sangria").alias("_authors"))
    side = side.join(places.select("doc_id", F.nullif(affiliations_html(F.col("text")), F.lit("")).alias("_affs")), "doc_id", "full").join(cited, "doc_id", "full")
    # one pass over the blocks: all that a page needs of its document comes by windows and one aggregation
    doc = Window.partitionBy("doc_id")
    is_title = (c == P.TITULO).cast("int")
    x = blocks.withColumn("_second", F.max((c == P.TITULO2).cast("int")).over(doc)).withColumn("_title", F.min_by(F.when(is_title == 1, F.col("contenido")), F.when(is_title == 1, F.col("seq"))).over(doc))
    # blocks of the author zone stay for what a book asks of all blocks, but keep to themselves
    x = _noted(styled(with_author_zone(x), "_zone"), "_zone")
    at = F.when(F.col("_second") == 1, c == P.TITULO2).otherwise(c == P.TITULO)
    w = Window.partitionBy("doc_id", "_zone").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_here", at & (F.sum(at.cast("int")).over(w) == 1)).join(side, "doc_id", "left")
    refs = F.when((c == P.SECCION) & F.col("contenido").rlike("(?i)referencia|reference") & (F.size("_refs") > 0), F.concat(F.lit('<ol class="referencias">\n'), F.array_join("_refs", "\n"), F.lit("\n</ol>")))
    gone = F.col("_zone") | c.isin(P.CITAR, P.FECHA) | (c == P.AUTORES) & F.col("_authors").isNotNull() | (c == P.REFERENCIA) & (F.coalesce(F.size("_refs"), F.lit(0)) > 0)
    own = F.when(gone, None).otherwise(F.concat_ws("\n", fragment(journal=journal), F.when(F.col("_here"), F.col("_authors")), F.when(F.col("_here"), F.col("_affs")), refs))
    x = x.withColumn("_f", own)
    noted = lambda kind, value: _ordered(F.col("_note") & ~F.col("_zone") & (c == kind), value, "seq")
    more = _book_columns() if book else []
    g = x.groupBy("doc_id").agg(F.coalesce(clean(F.first("_title")), F.lit("Artículo")).alias("title"), _ordered(F.col("_f") != "", F.col("_f"), "seq").alias("_b"), *_note_lists(noted), *more)
    top = f'<!DOCTYPE html>\n<html lang="es">\n<head>\n  <meta charset="UTF-8">\n  <meta name="viewport" content="width=device-width, initial-scale=1.0">\n  <title>Artículo</title>\n<style>{css}</style>\n</head>\n<body><article>'
    notes = F.when(F.col("dated") | (F.size("cite") > 0), _note_html())
    return g.select("doc_id", "title", F.concat_ws("\n", F.lit(top), F.when(F.size("_b") > 0, F.array_join("_b", "\n")), notes, F.lit("</article></body></html>")).alias("html"), *(["sections", "doi"] if book else []))


def table_html(number, title, grid):
    """A table with its number and title, as it stands in a page."""
    n = number.cast("string")
    named = F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(F.concat(F.lit("Tabla "), n))
    return F.concat(F.lit('\n<div class="tabla-wrapper">\n<p class="tabla-titulo"><strong>Tabla '), n, F.lit(".</strong> "), escape(named), F.lit("</p>\n"), html_table(grid), F.lit("\n</div>\n"))


def figure_html(number, caption, source):
    """A figure with its number and caption. source: an address, as data_uri() gives; null for a file that can't be read."""
    n, text = number.cast("string"), F.coalesce(caption, F.lit(""))
    said = F.concat(F.lit("<strong>Figura "), n, F.lit(".</strong>"), F.when(text != "", F.concat(F.lit(" "), escape(text))).otherwise(""))
    return F.concat(F.lit('<figure id="fig'), n, F.lit('" style="margin:18px auto;text-align:center;">\n  <img src="'), F.coalesce(source, F.lit("imagen.jpg")), F.lit('" alt="Figura '), n,
                    F.lit('" style="max-width:60%;max-height:420px;border:1px solid #bbb;">\n  <figcaption style="font-size:9pt;color:#1a1a1a;margin-top:5px;text-align:left;">'), said, F.lit("</figcaption>\n</figure>"))


def insert_media(pages: DataFrame, media: DataFrame, last: int = 80, heading: str = "") -> DataFrame:
    """Pages (doc_id, html) with media (doc_id, no, anchor, html) after the paragraph that holds the first occurrence of the
    last `last` characters of the anchor, whatever its case; media without one, or whose anchor is not found, go before
    the end of the article, under a heading if one is given. Media of one place keep the order of their numbers.

    A page meets its media once, as a list."""
    m = media.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("no", F.lower(anchor_text(F.col("anchor"), last)).alias("a"), F.col("html").alias("m")))).alias("_m"))
    x = pages.join(m, "doc_id", "left").withColumn("_low", F.when(F.col("_m").isNotNull(), F.lower("html")))
    hit = lambda v: F.when(v["a"] != "", F.position(v["a"], F.col("_low"))).otherwise(0)
    end = lambda v: F.when(v["h"] > 0, F.position(F.lit("</p>"), F.col("html"), v["h"] + F.length(v["a"]))).otherwise(0)
    x = x.withColumn("_m", F.transform("_m", lambda v: F.struct(v["no"].alias("no"), v["a"].alias("a"), v["m"].alias("m"), hit(v).alias("h"))))
    x = x.withColumn("_m", F.transform("_m", lambda v: F.struct(v["no"].alias("no"), v["m"].alias("m"), end(v).alias("e"))))
    tail = F.greatest(F.position(F.lit("</article>"), F.col("html")), F.lit(1))
    placed = F.transform("_m", lambda v: F.struct(F.when(v["e"] > 0, v["e"] + 4).otherwise(tail).alias("at"), (v["e"] <= 0).alias("loose"), v["no"].alias("no"), v["m"].alias("m")))
    x = x.withColumn("_s", F.array_sort(placed))
    open_ = F.lit(f'\n<div class="figuras-finales">\n<h2 style="text-align:center;font-size:10pt;font-weight:700;margin-bottom:14px;">{heading}</h2>\n')
    get = lambda i: F.get("_s", i)
    first_loose = lambda v, i: v["loose"] & ~F.coalesce(get(i - 1)["loose"], F.lit(False))
    last_loose = lambda v, i: v["loose"] & ~F.coalesce(get(i + 1)["loose"], F.lit(False))
    around = lambda v, i: F.concat(F.when(first_loose(v, i), open_).otherwise(""), v["m"], F.lit("\n"), F.when(last_loose(v, i), "</div>\n").otherwise("")) if heading else F.concat(v["m"], F.lit("\n"))
    piece = lambda v, i: F.concat(F.substring("html", F.coalesce(get(i - 1)["at"], F.lit(1)), v["at"] - F.coalesce(get(i - 1)["at"], F.lit(1))), around(v, i))
    rest = F.substring("html", F.element_at("_s", -1)["at"], F.length("html"))
    return x.withColumn("html", F.when(F.coalesce(F.size("_s"), F.lit(0)) <= 0, F.col("html")).otherwise(F.concat(F.array_join(F.transform("_s", piece), ""), rest))).select(*pages.columns)


def illustrated(pages: DataFrame, tables: DataFrame | None = None, figures: DataFrame | None = None) -> DataFrame:
    """Pages (doc_id, html) with tables (doc_id, tab_no, titulo, ancla, grid) and then figures (doc_id, fig_no, pie, ancla,
    source) at their anchors, the last 60 and 80 characters of which are looked for; the others at the end of the article,
    tables under a heading."""
    if tables is not None:
        pages = insert_media(pages, tables.select("doc_id", F.col("tab_no").alias("no"), F.col("ancla").alias("anchor"), table_html(F.col("tab_no"), F.col("titulo"), F.col("grid")).alias("html")), 60, "Tablas")
    if figures is not None:
        pages = insert_media(pages, figures.select("doc_id", F.col("fig_no").alias("no"), F.col("ancla").alias("anchor"), F.concat(F.lit("\n"), figure_html(F.col("fig_no"), F.col("pie"), F.col("source"))).alias("html")))
    return pages


class Publication(NamedTuple):
    """What all articles of a journal share."""

    identifier: str = ""
    title: str = ""
    abbreviation: str = ""
    publisher: str = ""
    year: str = "2026"
    license: str = "https://creativecommons.org/licenses/by/4.0/"
    license_text: str = "Distribuido bajo una licencia Creative Commons Attribution 4.0 International (CC BY 4.0)."


def _attr(value):
    return F.replace(escape(value), F.lit('"'), F.lit("&quot;"))


def _ordered(when, value, *keys: str):
    return F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(*keys, value.alias("v"))))), lambda x: x["v"])


def kwd_group(words, lang: str, title: str):
    """A group of keywords, each spelling of one once; null without any."""
    own = distinct_keywords(words)
    inner = F.concat(F.lit(f'<kwd-group kwd-group-type="author-generated" xml:lang="{lang}"><title>{title}</title>'), F.array_join(F.transform(own, lambda x: F.concat(F.lit("<kwd>"), escape(x), F.lit("</kwd>"))), ""), F.lit("</kwd-group>"))
    return F.when(F.size(own) > 0, inner)


def _contributors(people, affs, mails):
    """XML of arrays of struct(nombre, orcid), struct(aff_id, label, text) and addresses."""
    link = lambda kind, rid, label: F.concat(F.lit(f'<xref ref-type="{kind}" rid="'), rid, F.lit('">'), escape(label), F.lit("</xref>"))
    to = F.array_join(F.transform(affs, lambda a: link("aff", a["aff_id"], a["label"])), "")
    first = F.when(F.size(mails) > 0, link("corresp", F.lit("cor1"), F.lit(""))).otherwise("")

    def one(a, p, i, to, first):
        given = F.when(p["given"] != "", F.concat(F.lit("<given-names>"), escape(p["given"]), F.lit("</given-names>"))).otherwise("")
        who = F.when(a["orcid"] != "", F.concat(F.lit(f'<contrib-id contrib-id-type="orcid" authenticated="false">{P.ORCID_HOME}'), escape(a["orcid"]), F.lit("</contrib-id>"))).otherwise("")
        name = F.concat(F.lit("<name><surname>"), escape(F.when(p["surname"] != "", p["surname"]).otherwise(a["nombre"])), F.lit("</surname>"), given, F.lit("</name>"))
        return F.concat(F.lit('<contrib contrib-type="author">'), who, name, to, F.when(i == 0, first).otherwise(""), F.lit("</contrib>"))

    every = lambda to, first: F.array_join(F.transform(people, lambda a, i: let(person(a["nombre"]), lambda p: one(a, p, i, to, first))), "")
    return F.when(F.size(people) > 0, F.concat(F.lit("<contrib-group>"), let(to, lambda t: let(first, lambda f: every(t, f))), F.lit("</contrib-group>")))


def contributors(authors: DataFrame, affs: DataFrame, mails: DataFrame) -> DataFrame:
    """(doc_id, xml): the group of contributors: authors (doc_id, ord, nombre, orcid) with references to each affiliation
    (doc_id, aff_id, label) of the document, the first one also to the correspondence, if there is an address (doc_id,
    email)."""
    n = F.expr("cast(regexp_extract(aff_id, '[0-9]+', 0) as int)")
    a = authors.groupBy("doc_id").agg(_ordered(F.lit(True), F.struct("nombre", "orcid"), "ord").alias("p"))
    f = affs.select("doc_id", n.alias("n"), "aff_id", "label").groupBy("doc_id").agg(_ordered(F.lit(True), F.struct("aff_id", "label"), "n").alias("f"))
    e = mails.groupBy("doc_id").agg(F.collect_list("email").alias("e"))
    x = a.join(f, "doc_id", "left").join(e, "doc_id", "left")
    none = lambda name, kind: F.coalesce(F.col(name), F.array().cast(kind))
    return x.select("doc_id", _contributors(F.col("p"), none("f", "array<struct<aff_id:string,label:string>>"), none("e", "array<string>")).alias("xml"))


def _affiliation(a):
    at = lambda land: F.when(land["code"] != "", F.concat(F.lit(' country="'), land["code"], F.lit('"'))).otherwise("")
    return let(country(a["text"]), lambda land: F.concat(F.lit('<aff id="'), a["aff_id"], F.lit('"><label>'), escape(a["label"]), F.lit('</label><institution content-type="original">'), escape(a["text"]), F.lit("</institution><country"), at(land), F.lit(">"), escape(land["name"]), F.lit("</country></aff>")))


def affiliations_xml(affs: DataFrame) -> DataFrame:
    """(doc_id, xml): affiliations (doc_id, aff_id, label, text) with the country each names."""
    n = F.expr("cast(regexp_extract(aff_id, '[0-9]+', 0) as int)")
    one = _affiliation({"aff_id": F.col("aff_id"), "label": F.col("label"), "text": F.col("text")})
    return affs.select("doc_id", n.alias("n"), one.alias("_a")).groupBy("doc_id").agg(ordered(F.col("_a"), "", "n").alias("xml"))


def _body(b):
    """XML of array<struct(h, t)>: headings and paragraphs in order."""
    def of(b, some):
        head = lambda x, i: F.concat(F.when(i > 0, "</sec>").otherwise(""), F.lit("<sec><title>"), escape(x["t"]), F.lit("</title>"))
        text = lambda x, i: F.concat(F.when((i == 0) & some, "<sec><title></title>").otherwise(""), F.when(x["t"] != "", F.concat(F.lit("<p>"), escape(x["t"]), F.lit("</p>"))).otherwise(""))
        return F.concat(F.array_join(F.transform(b, lambda x, i: F.when(x["h"], head(x, i)).otherwise(text(x, i))), ""), F.when(some, "</sec>").otherwise(""))

    return let(b, lambda b: let(F.exists(b, lambda x: x["h"]), lambda some: of(b, some)))


def _body_rows():
    """array<struct(h, t)> of a group's headings and paragraphs."""
    part = F.col("part")
    return _ordered(part.isin("heading", "paragraph"), F.struct((part == "heading").alias("h"), strip(F.replace("text", F.lit("§SUB§"), F.lit(""))).alias("t")), "seq")


def body_xml(routed: DataFrame) -> DataFrame:
    """(doc_id, xml): headings open sections, paragraphs stand in the one before; those before the first heading stand in
    one without a title, and without any heading in none. Documents without either have no row."""
    return routed.where(F.col("part").isin("heading", "paragraph")).groupBy("doc_id").agg(_body_rows().alias("b")).select("doc_id", _body(F.col("b")).alias("xml"))


def _cited(refs):
    one = lambda v, i: F.concat(F.lit('<ref id="R'), (i + 1).cast("string"), F.lit('">'), v, F.lit("</ref>"))
    return F.when(F.size(refs) > 0, F.concat(F.lit("<ref-list><title>Referencias</title>"), F.array_join(F.transform(refs, one), ""), F.lit("</ref-list>")))


def references_xml(refs: DataFrame) -> DataFrame:
    """(doc_id, xml): references (doc_id, ref_no, raw) without their marks, whole and structured, numbered R1, R2 ..."""
    r = refs.select("doc_id", "ref_no", reference_text(strip(F.col("raw"))).alias("raw")).where("raw <> ''")
    x = citations(r).withColumn("_x", element_citation()).groupBy("doc_id").agg(_ordered(F.lit(True), F.col("_x"), "ref_no").alias("v"))
    return x.select("doc_id", _cited(F.col("v")).alias("xml"))


def media_xml(tables: DataFrame | None, figures: DataFrame | None, spark) -> DataFrame:
    """(doc_id, xml): sections of the tables (doc_id, tab_no, titulo, grid) and figures (doc_id, fig_no, pie, path)."""
    def section(rows, kind, title, number, inner):
        one = rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(number)))
        return one.withColumn("_x", inner(F.col("_n").cast("string"))).groupBy("doc_id").agg(F.concat(F.lit(f'<sec sec-type="{kind}"><title>{title}</title>'), ordered(F.col("_x"), "", "_n"), F.lit("</sec>")).alias("xml"))

    def caption(word, n, text):
        named = F.when(clean(F.coalesce(text, F.lit(""))) != "", clean(text)).otherwise(F.concat(F.lit(f"{word} "), n))
        return F.concat(F.lit(f"<label>{word} "), n, F.lit(f"</label><caption><title>{word} "), n, F.lit("</title><p>"), escape(named), F.lit("</p></caption>"))

    out = []
    if tables is not None:
        out.append(section(tables, "tables", "Tablas", "tab_no", lambda n: F.concat(F.lit('<table-wrap id="tbl'), n, F.lit('">'), caption("Tabla", n, F.col("titulo")), jats_table(F.col("grid")), F.lit("</table-wrap>"))).withColumn("k", F.lit(0)))
    if figures is not None:
        out.append(section(figures, "figures", "Figuras", "fig_no", lambda n: F.concat(F.lit('<fig id="fig'), n, F.lit('">'), caption("Figura", n, F.col("pie")), F.lit('<graphic xlink:href="'), _attr(F.substring_index("path", "/", -1)), F.lit('"/></fig>'))).withColumn("k", F.lit(1)))
    if not out:
        return spark.createDataFrame([], "doc_id long, xml string")
    both = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return both.groupBy("doc_id").agg(ordered(F.col("xml"), "", "k").alias("xml"))


def jats_documents(routed: DataFrame, publication: Publication = Publication(), authors: DataFrame | None = None, affiliation_texts: DataFrame | None = None,
                   references: DataFrame | None = None, tables: DataFrame | None = None, figures: DataFrame | None = None) -> DataFrame:
    """(doc_id, jats): articles of route()'s parts: journal, identifiers, titles, contributors, affiliations, notes, date
    and numbers of publication, history, permissions, abstracts, keywords, further notes, body, tables, figures and
    references.

    Given authors (doc_id, ord, nombre, orcid), affiliations (doc_id, text of a file) and references (doc_id, ref_no,
    raw) are preferred for a document; others follow from its blocks. Absent values have no element; a document without a
    title is an `Articulo` of the publication's year, one without an ISSN has 0000-0000. Characters that XML does not
    know are left out."""
    spark = routed.sparkSession
    routed = routed.withColumn("text", F.regexp_replace("text", ILLEGAL, ""))
    t, part, c = F.col("text"), F.col("part"), F.col("clasificacion")
    tag = lambda name, body, attr="": F.concat(F.lit(f"<{name}{attr}>"), body, F.lit(f"</{name}>"))
    some = lambda name, value, attr="": F.when(value != "", tag(name, escape(value), attr))
    first = lambda value: F.coalesce(F.min_by(F.when(value != "", value), F.when(value != "", F.col("seq"))), F.lit(""))
    is_title = lambda label: F.when(c == label, t).otherwise("")
    names = ("front_note", "cite_note", "date_note", "keywords_es", "keywords_en", "keywords", "abstract_es", "abstract_en", "abstract_plain_es", "abstract_plain_en")
    # one pass over the blocks: references are structured row by row, the rest of a document is one aggregation
    own = citations(routed.select("doc_id", "seq", "clasificacion", "part", "text", F.when(part == "ref", reference_text(t)).alias("_raw")), "_raw")
    own = own.select("doc_id", "seq", "clasificacion", "part", "text", F.when((part == "ref") & (F.col("_raw") != ""), element_citation("_raw")).alias("_ref"))
    g = own.groupBy("doc_id").agg(
        first(is_title(P.TITULO)).alias("title"), first(is_title(P.TITULO2)).alias("title_en"), first(doi(t)).alias("doi"), first(issn(t)).alias("issn"), *[_ordered(part == n, t, "seq").alias(n) for n in names],
        F.flatten(_ordered(c == P.AUTORES, author_names(t), "seq")).alias("_names"), _ordered(c == P.FILIACION, t, "seq").alias("_places"), F.array_distinct(F.flatten(_ordered(c == P.EMAIL, emails(t), "seq"))).alias("_found"),
        _body_rows().alias("_rows"), _ordered(F.col("_ref").isNotNull(), F.col("_ref"), "seq").alias("_cited"))

    def beside(rows, *names):  # what is given for a document, null where nothing is
        nonlocal g
        g = g.join(rows.select(F.col("doc_id").alias("_d"), *names), F.col("doc_id").eqNullSafe(F.col("_d")), "left").drop("_d")

    people = F.transform("_names", lambda n: F.struct(n.alias("nombre"), F.lit("").alias("orcid")))
    affs = F.transform("_places", lambda x, i: F.struct(F.concat(F.lit("aff"), i + 1).alias("aff_id"), (i + 1).cast("string").alias("label"), x.alias("text")))
    mails, refs, media = F.col("_found"), _cited(F.col("_cited")), F.lit(None).cast("string")
    if authors is not None:
        beside(listed_authors(authors).groupBy("doc_id").agg(_ordered(F.lit(True), F.struct("nombre", "orcid"), "ord").alias("_given_people")), "_given_people")
        people = F.coalesce("_given_people", people)
    if affiliation_texts is not None:
        lines = affiliation_lines(affiliation_texts, "doc_id").groupBy("doc_id")
        beside(lines.agg(_ordered(F.col("email").isNull(), F.struct("aff_id", "label", "text"), "line", "part").alias("_given_affs"), _ordered(F.col("email").isNotNull(), F.col("email"), "line").alias("_given_mails")), "_given_affs", "_given_mails")
        affs, mails = F.coalesce("_given_affs", affs), F.coalesce("_given_mails", mails)
    if references is not None:
        beside(references_xml(references.select("doc_id", "ref_no", F.regexp_replace("raw", ILLEGAL, "").alias("raw"))), F.col("xml").alias("_given_refs"))
        refs = F.coalesce("_given_refs", refs)
    if tables is not None or figures is not None:
        beside(media_xml(tables, figures, spark), F.col("xml").alias("_media"))
        media = F.col("_media")
    mail = lambda m: F.when(F.size(m) > 0, F.concat(F.lit('<author-notes><corresp id="cor1"><label>*</label>'), F.array_join(F.transform(m, lambda x: tag("email", escape(x))), ""), F.lit("</corresp></author-notes>")))
    g = g.withColumn("_p", people).withColumn("_a", affs).withColumn("_e", mails)
    g = g.withColumns({"_people": _contributors(F.col("_p"), F.col("_a"), F.col("_e")), "_affs": F.nullif(F.array_join(F.transform("_a", _affiliation), ""), F.lit("")), "_mail": mail(F.col("_e")), "_body": _body(F.col("_rows")), "_refs": refs, "_media": media})
    n = issue_numbers(F.col("front_note"), F.col("doi"))
    g = g.withColumn("_n", n)
    n, y = F.col("_n"), F.when(F.col("_n.year") != "", F.col("_n.year")).otherwise(F.lit(publication.year))
    journal = "".join([f'<journal-id journal-id-type="publisher-id">{esc(publication.identifier)}</journal-id>', f'<journal-title-group><journal-title>{esc(publication.title)}</journal-title><abbrev-journal-title abbrev-type="publisher">{esc(publication.abbreviation)}</abbrev-journal-title></journal-title-group>'])
    issn_value = F.when(F.col("issn") != "", F.col("issn")).otherwise("0000-0000")
    titles = F.concat(F.lit("<title-group>"), tag("article-title", escape(F.when(F.col("title") != "", F.col("title")).otherwise("Articulo"))), F.when(F.col("title_en") != "", F.concat(F.lit('<trans-title-group xml:lang="en">'), tag("trans-title", escape(F.col("title_en"))), F.lit("</trans-title-group>"))).otherwise(""), F.lit("</title-group>"))
    numbers = [tag("pub-date", tag("year", y), ' pub-type="epub"'), *[some(k, n[k]) for k in ("volume", "issue", "fpage", "lpage")], F.when((n["fpage"] == "") & (n["lpage"] == ""), some("elocation-id", elocation(F.col("doi"))))]
    day = lambda d: F.concat_ws("", F.concat(F.lit('<date date-type="'), d["date_type"], F.lit('">')), some("day", d["day"]), some("month", d["month"]), tag("year", d["year"]), F.lit("</date>"))
    history = F.array_join(F.transform(manuscript_dates(F.array_join("date_note", " ")), day), "")
    rights = F.concat(F.lit("<permissions><copyright-statement>© "), y, F.lit(f" {esc(publication.title)}</copyright-statement>"), tag("copyright-year", y), F.lit(
        f'<copyright-holder>{esc(publication.title)}</copyright-holder><ali:free_to_read/><license license-type="open-access" xlink:href="{esc(publication.license)}" xml:lang="es"><license-p>{esc(publication.license_text)}</license-p></license></permissions>'))
    plain = ' abstract-type="plain-language-summary"'
    abstract = lambda name, element, attr, title: F.when(F.size(name) > 0, tag(element, F.concat(F.lit(f"<title>{title}</title>"), F.array_join(F.transform(F.filter(F.transform(name, lambda x: strip(F.replace(x, F.lit("§SUB§"), F.lit("")))), lambda x: x != ""), lambda x: tag("p", escape(x))), "")), attr))
    abstracts = [abstract("abstract_es", "abstract", "", "Resumen"), abstract("abstract_plain_es", "abstract", plain, "Resumen no técnico"), abstract("abstract_en", "trans-abstract", ' xml:lang="en"', "Abstract"), abstract("abstract_plain_en", "trans-abstract", plain + ' xml:lang="en"', "Non-technical Abstract")]
    words = lambda name: F.flatten(F.transform(name, keywords))
    groups = [kwd_group(words("keywords_es"), "es", "Palabras clave"), kwd_group(words("keywords_en"), "en", "Keywords"), kwd_group(words("keywords"), "es", "Palabras clave")]
    meta = lambda name: lambda x: tag("custom-meta", F.concat(tag("meta-name", F.lit(name)), tag("meta-value", escape(x))))
    period = F.slice(F.filter("front_note", is_period), 1, 1)
    notes = F.array_join(F.concat(F.transform(period, meta("publication-period")), F.transform("cite_note", meta("how-to-cite"))), "")
    article_id = some("article-id", F.col("doi"), ' pub-id-type="doi"')
    head = F.concat_ws("", F.lit(f"<front><journal-meta>{journal}"), tag("issn", issn_value, ' pub-type="epub"'), F.lit(f"<publisher><publisher-name>{esc(publication.publisher)}</publisher-name></publisher></journal-meta><article-meta>"), article_id,
                       F.lit('<article-categories><subj-group subj-group-type="heading"><subject>Research Article</subject></subj-group></article-categories>'), titles, F.col("_people"), F.col("_affs"), F.col("_mail"), *numbers,
                       F.when(history != "", tag("history", history)), rights, *abstracts, *groups, F.when(notes != "", tag("custom-meta-group", notes)), F.lit("</article-meta></front>"))
    spaces = " ".join(f'xmlns:{k}="{v}"' for k, v in P.NAMESPACES.items())
    root = f'<?xml version="1.0" encoding="utf-8"?>\n{P.DOCTYPE}\n<article {spaces} article-type="research-article" dtd-version="1.1" specific-use="sps-1.8" xml:lang="es">'
    return g.select("doc_id", F.concat_ws("", F.lit(root), head, F.lit("<body>"), F.col("_body"), F.col("_media"), F.lit("</body><back>"), F.col("_refs"), F.lit("</back></article>\n")).alias("jats"))


def elocation(col):
    """What stands after the last dot of a DOI."""
    return F.substring_index(col, ".", -1)


def pretty_xml(documents: DataFrame, column: str = "jats") -> DataFrame:
    """Documents indented by two blanks, without empty lines; a text that is no XML stays as it is."""
    from xml.parsers.expat import ExpatError

    def one(x):
        from xml.dom import minidom

        try:
            out = minidom.parseString(x.encode()).toprettyxml(indent="  ", encoding="utf-8").decode()
        except ExpatError:
            return x
        return "\n".join(line for line in out.splitlines() if line.strip()) + "\n"

    def indent(parts):
        for p in parts:
            yield p.assign(**{column: p[column].map(one, na_action="ignore")})

    return documents.mapInPandas(indent, documents.schema)


def _epub(doc_id, title: str, body: str, css: str, sections, authors, doi_: str, publisher: str) -> bytes:
    uid = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{doc_id}/{title}')}"
    text = lambda x: esc(x, quote=False)
    head = text(title)
    points = "".join(f'<navPoint id="nav{i}" playOrder="{i}"><navLabel><text>{text(s)}</text></navLabel><content src="article.xhtml"/></navPoint>' for i, s in enumerate(sections if len(sections) else [title], 1))
    items = {"article": ("article.xhtml", "application/xhtml+xml"), "css": ("style/main.css", "text/css"), "ncx": ("toc.ncx", "application/x-dtbncx+xml")}
    manifest = "".join(f'<item id="{k}" href="{h}" media-type="{m}"/>' for k, (h, m) in items.items())
    creators = "".join(f"<dc:creator>{text(a)}</dc:creator>" for a in (authors if len(authors) else ["Autor desconocido"]))
    own_doi = f'<dc:identifier id="doi">{text(doi_)}</dc:identifier>' if doi_ else ""
    meta = "".join(f'<meta name="dtb:{k}" content="{v}"/>' for k, v in (("uid", uid), ("depth", 1), ("totalPageCount", 0), ("maxPageNumber", 0)))
    xml = '<?xml version="1.0" encoding="UTF-8"?>\n'
    files = {
        "META-INF/container.xml": xml + '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
        "OEBPS/content.opf": xml + f'<package xmlns="http://www.idpf.org/2007/opf" version="2.0" unique-identifier="uid"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="uid">{uid}</dc:identifier><dc:title>{head}</dc:title>{creators}{own_doi}<dc:language>es</dc:language><dc:publisher>{text(publisher)}</dc:publisher></metadata><manifest>{manifest}</manifest><spine toc="ncx"><itemref idref="article"/></spine></package>',
        "OEBPS/toc.ncx": xml + f'<!DOCTYPE ncx PUBLIC "-//NISO//DTD ncx 2005-1//EN" "http://www.daisy.org/z3986/2005/ncx-2005-1.dtd">\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head>{meta}</head><docTitle><text>{head}</text></docTitle><navMap>{points}</navMap></ncx>',
        "OEBPS/article.xhtml": xml + f'<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" lang="es" xml:lang="es"><head><title>{head}</title><link href="style/main.css" rel="stylesheet" type="text/css"/></head><body>{body}</body></html>',
        "OEBPS/style/main.css": css,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), b"application/epub+zip", zipfile.ZIP_STORED)
        for name, body_text in files.items():
            z.writestr(zipfile.ZipInfo(name), body_text.encode(), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _book_columns():
    """Columns sections and doi of a group's blocks: section headings and the first DOI address."""
    t = strip(F.col("contenido"))
    link = F.regexp_replace(F.regexp_extract("contenido", r"https?://doi\.org/\S+", 0), r"\.+$", "")
    return [_ordered((F.col("clasificacion") == P.SECCION) & (t != ""), t, "seq").alias("sections"), F.coalesce(F.min_by(F.when(link != "", link), F.when(link != "", F.col("seq"))), F.lit("")).alias("doi")]


def epub_parts(pages: DataFrame, blocks: DataFrame | None = None, authors: DataFrame | None = None) -> DataFrame:
    """(doc_id, title, body, css, sections, authors, doi): what a book is made of: the page's body as XHTML and its style
    sheet, section headings, authors' names and the first DOI address of html_documents() and its blocks. Without blocks
    the pages are those html_documents() makes for a book, so that blocks are made once only."""
    x = pages.select("doc_id", "title", F.regexp_replace(as_xhtml(body_of(F.col("html"))), ILLEGAL, "").alias("body"), css_of(F.col("html")).alias("css"), *([] if blocks is not None else ["sections", "doi"]))
    if blocks is not None:
        b = blocks.groupBy(F.col("doc_id").alias("_d")).agg(*_book_columns())
        x = x.join(b, F.col("doc_id").eqNullSafe(F.col("_d")), "left").drop("_d")
    who = authors if authors is not None else pages.sparkSession.createDataFrame([], "doc_id long, ord int, nombre string")
    who = who.where("trim(nombre) <> ''").groupBy(F.col("doc_id").alias("_d")).agg(_ordered(F.lit(True), F.trim("nombre"), "ord").alias("authors"))
    return x.join(who, F.col("doc_id").eqNullSafe(F.col("_d")), "left").select("doc_id", "title", "body", "css", "sections", "doi", "authors")


def epub_documents(pages: DataFrame, blocks: DataFrame | None = None, authors: DataFrame | None = None, publisher: str = "") -> DataFrame:
    """(doc_id, epub): EPUB 2.0 of epub_parts(); equal input gives equal bytes."""
    from quire import ship

    ship(pages.sparkSession)
    kind = dict(pages.dtypes)["doc_id"]

    def build(parts):
        some = lambda x: [] if x is None else list(x)
        for p in parts:
            books = [_epub(d, t, b, c, some(s), some(a), o or "", publisher) for d, t, b, c, s, a, o in zip(p.doc_id, p.title, p.body, p.css, p.sections, p.authors, p.doi)]
            yield pd.DataFrame({"doc_id": p.doc_id, "epub": books})

    return epub_parts(pages, blocks, authors).mapInPandas(build, f"doc_id {kind}, epub binary")
