"""The way of a document, from its scanned pages to paragraphs, pages and articles."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import data_uri
from quire.operators import blocks as B
from quire.operators import layout, render, splits


class Scanned(NamedTuple):
    """Documents as fused paragraphs (see paragraphs()), tables (see layout.tables()) and figures (layout.figures())."""

    paragraphs: DataFrame
    tables: DataFrame
    figures: DataFrame


def paragraphs(blocks: DataFrame) -> DataFrame:
    """fuse() of blocks (doc_id, seq, contenido, and the look that labels need): labels, table mode, cuts at headings and
    titles inside blocks, numbers for the parts, and fusion. All of it keeps to the one exchange on doc_id."""
    return B.fuse(splits.renumbered(splits.split_embedded(B.drop_table_rows(B.label(blocks)))))


def scanned(page_blocks: DataFrame, images: DataFrame, pdf_tables: DataFrame) -> Scanned:
    """From the layout relations of pages (see layout.text_blocks(), figures() and tables()): tables with titles, figures
    with captions, and paragraphs of the blocks in reading order that no table covers. From spans to paragraphs blocks are
    dealt once, by doc_id: the windows of a page keep to that. Rows without a doc_id are left out, as windows would make
    one document of them."""
    texts = layout.text_blocks(page_blocks)
    tables = layout.tables(pdf_tables, texts)
    dealt = page_blocks.where("doc_id is not null").repartition("doc_id")
    return Scanned(paragraphs(layout.raw_blocks(dealt, tables)), tables, layout.figures(images, texts))


def pages(x: Scanned, css: str = "", authors: DataFrame | None = None, affiliation_texts: DataFrame | None = None, references: DataFrame | None = None, journal: str = "") -> DataFrame:
    """(doc_id, title, html): html_documents() of the paragraphs, with the tables and figures at their anchors, else at the
    end of the article. A document needs a paragraph to have a page."""
    html = render.html_documents(x.paragraphs, css, authors, affiliation_texts, references, journal)
    return render.illustrated(html, x.tables, x.figures.withColumn("source", data_uri(F.col("path"), F.col("bytes"))))


def articles(x: Scanned, publication: render.Publication = render.Publication(), authors: DataFrame | None = None, affiliation_texts: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """(doc_id, jats): jats_documents() of the routed paragraphs, with tables and figures."""
    return render.jats_documents(splits.route(x.paragraphs), publication, authors, affiliation_texts, references, x.tables, x.figures)
