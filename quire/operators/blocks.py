"""Blocks of documents: labels, zones, table mode, paragraph fusion, reading order, nearest captions.

All windows are partitioned by document and ordered by position, so one exchange on doc_id serves them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import apart, has, is_abstract_heading, is_cite, is_date_note, is_doi_line, row_like, strip

#: Columns of a block besides its text and label that a fused block takes from its first piece.
LOOK = ["size", "bold", "italic", "font", "pnum"]


#: Bytes of text that a task takes with all windows and sorts of a document's blocks.
DEAL = 8 << 20
#: Parts up to which Spark writes an exchange without holding a task's rows (spark.shuffle.sort.bypassMergeThreshold).
DIRECT = 200


def dealt(files: DataFrame, *columns: str, by: str = "doc_id") -> DataFrame:
    """The columns of a table read from files, dealt by doc_id before any work is done on them: windows, groups and joins
    by doc_id then keep to that. There are as many parts as DEAL goes into the texts, so that a part stays as large as it
    is however large the table (its files don't tell: copies of a text are stored once there); one for each core at least,
    as a file may be one row group that a single task would read. Such a task would hold its rows if it wrote more than
    DIRECT parts, so they are spread over that many first. by: "" deals rows by their values, not by doc_id."""
    rows = files.select(*columns)
    size = rows.agg(F.sum(sum(F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in columns))).first()[0] or 0
    parts = max(files.sparkSession.sparkContext.defaultParallelism, -(-size // DEAL))
    if parts > DIRECT:
        rows = rows.withColumn("_at", F.xxhash64(*columns)).repartition(DIRECT, "_at").select(*columns)
    return rows.repartition(parts, *([by] if by else columns))


def by_doc():
    return Window.partitionBy("doc_id").orderBy("seq")


def _ladder(t, size, bold, italic, font, section, cite, date):
    s, low_font = F.bround(size), F.coalesce(F.lower(font), F.lit(""))
    b, i, tnr = bold | low_font.rlike(P.BOLD_FONT), italic | low_font.rlike(P.ITALIC_FONT), low_font.rlike("times|roman")
    lettered = has(t, P.LETTERED, fold=False) & ~has(F.substring(t, 1, 30), r"\.\s+[A-Z]", fold=False)
    institution = has(t, P.INSTITUTION)
    return (
        F.when(section, P.SECCION).when(cite, P.CITAR).when(date, P.FECHA)
        .when(has(t, P.KEYWORDS), P.CLAVE).when(has(t, P.TABLE_TITLE), P.TABLA).when(has(t, P.HAS_EMAIL) & (F.length(t) < 120), P.EMAIL)
        .when((s <= 12) & has(t, r"^\d+\.\s+\S") & ~has(t, r"^\d+\.\d"), P.SUB).when((s <= 12) & has(t, P.LEVEL2), P.SUB2)
        .when((s >= 13) & b & ~i, P.TITULO).when((s >= 13) & b & i, P.TITULO2).when((s == 13) & ~b & ~i, P.AUTORES)
        .when((s == 12) & i, P.EMAIL).when((s == 12) & ~b, P.NORMAL).when((s == 10) & b, P.SECCION).when((s == 10) & ~b, P.SUB)
        .when(lettered & institution, P.FILIACION)
        .when((s == 9) & ~tnr & has(t, P.NUMBERED, fold=False) & institution, P.FILIACION)
        .when((s == 9) & (tnr | (F.length(t) > 100)), P.RESUMEN).when((s == 9) & (F.length(t) < 80), P.FILIACION).when(s == 9, P.RESUMEN)
        .when(F.length(t) < 4, P.IGNORAR).otherwise(P.NORMAL)
    )


def auto_label(text="contenido", size="size", bold="bold", italic="italic", font="font"):
    """The label ladder of front and back matter; the first rule that holds. Bold and italic also go by the font's name."""
    t = strip(F.col(text))
    return _ladder(t, F.col(size), F.col(bold), F.col(italic), F.col(font), F.lower(t).isin(P.SECTIONS), is_cite(t), is_date_note(t) | is_doi_line(t))


def compat(label):
    """Former labels as they are called now."""
    return F.when(label.isin(P.NORMAL, P.AUTORES, P.RESUMEN), P.CUERPO).when(label == P.IMAGEN, P.IGNORAR).otherwise(label)


def label(blocks: DataFrame) -> DataFrame:
    """Adds zone (A, B or C) and clasificacion. The body begins at the first level-1 heading and ends at the
    references heading at or after it. Rows whose `imagen` is true, if there is such a column, keep their label and begin
    or end nothing. Tests that both ladders ask are columns of their own, evaluated once before the exchange on doc_id, which
    takes a stripped text along only where it differs from the text."""
    image = F.col("imagen") if "imagen" in blocks.columns else F.lit(False)
    given = F.col("clasificacion") if "clasificacion" in blocks.columns else F.lit(P.IMAGEN)
    b = blocks.withColumn("_t", strip(F.col("contenido")))
    t = F.col("_t")
    low = F.when(F.length(t) <= max(map(len, P.SECTIONS + P.BODY_SECTIONS)), F.lower(t)).otherwise("")
    b = b.withColumns({"_section": low.isin(P.SECTIONS), "_refs": low.isin("referencias", "references"), "_inner": low.isin(P.BODY_SECTIONS), "_cite": is_cite(t), "_date": is_date_note(t) | is_doi_line(t), "_two": has(t, P.LEVEL2), "_one": has(t, P.LEVEL1)})
    b = b.withColumn("_t", F.nullif(t, F.col("contenido")))
    one = F.col("_one") & ~F.col("_two")
    doc = Window.partitionBy("doc_id")
    b = b.withColumn("_start", F.min(F.when(~image & one & (F.bround("size") <= 12), F.col("seq"))).over(doc))
    b = b.withColumn("_end", F.min(F.when(~image & F.col("_refs") & (F.col("seq") >= F.col("_start")), F.col("seq"))).over(doc))
    b = b.withColumn("_t", F.coalesce("_t", "contenido"))
    inside = F.col("_start").isNotNull() & (F.col("seq") >= F.col("_start")) & (F.col("_end").isNull() | (F.col("seq") < F.col("_end")))
    zone = apart(F.when(inside, "B").when(F.col("_end").isNotNull() & (F.col("seq") >= F.col("_end")), "C").otherwise("A"))
    body = (
        F.when(one, P.SUB).when(F.col("_two"), P.SUB2).when(F.col("_cite"), P.CITAR).when(F.col("_date"), P.FECHA)
        .when(F.col("_inner"), P.SECCION).when(has(t, r"\b(tabla|table)\s+\d+[.:\s]"), P.TABLA).when(has(t, P.FIGURE_TITLE), P.FIGURA).otherwise(P.CUERPO)
    )
    front = compat(_ladder(t, F.col("size"), F.col("bold"), F.col("italic"), F.col("font"), F.col("_section"), F.col("_cite"), F.col("_date")))
    own = F.when(image, given).when(F.col("seq") == F.col("_end"), P.SECCION).when(zone == "B", body).otherwise(front)
    return b.withColumn("zone", zone).withColumn("clasificacion", own).drop("_t", "_section", "_refs", "_inner", "_cite", "_date", "_two", "_one", "_start", "_end")


def drop_table_rows(labelled: DataFrame) -> DataFrame:
    """Rows that table mode keeps. The mode is the last ON or OFF before a row, turned by each TOGGLE since."""
    c, t = F.col("clasificacion"), F.col("contenido")
    body = c == P.CUERPO
    rowish = body & row_like(t)
    ending = c.isin(P.TABLE_ENDS) | (body & (F.length(t) > 200) & t.rlike(r"(?U)[.?!]\s*$"))
    ev = F.when(c == P.TABLA, "ON").when(rowish & ending, "TG").when(rowish, "ON").when(ending, "OFF").otherwise("NOP")
    past = by_doc().rowsBetween(Window.unboundedPreceding, -1)
    b = labelled.withColumn("_ev", ev)
    b = b.withColumn("_rid", F.coalesce(F.sum(F.col("_ev").isin("ON", "OFF").cast("int")).over(past), F.lit(0)))
    b = b.withColumn("_base", F.last(F.when(F.col("_ev") == "ON", True).when(F.col("_ev") == "OFF", False), ignorenulls=True).over(past))
    since = Window.partitionBy("doc_id", "_rid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("_tg", F.coalesce(F.sum((F.col("_ev") == "TG").cast("int")).over(since), F.lit(0)))
    on = F.coalesce(F.col("_base"), F.lit(False)) != (F.col("_tg") % 2 == 1)
    keep = F.when(c == P.TABLA, True).when(F.col("_ev") == "ON", False).when(F.col("_ev") == "OFF", True).when(F.col("_ev") == "TG", on).otherwise(~on)
    return b.where(keep).drop("_ev", "_rid", "_base", "_tg")


def fuse(labelled: DataFrame) -> DataFrame:
    """(doc_id, grp, kind, seq, clasificacion, contenido, and those of LOOK that there are): paragraphs of body text that
    run on are joined.

    kind 0: a block that stands alone, 1: one that passes by, 2: the fused body of the group, with seq and look of its
    first piece. A paragraph runs on unless the one before ends with .?!: or is a heading, or lies more than five pages
    off; a hyphen at its end is dropped. Paragraphs are separated by an empty line. One pass: windows and the aggregation
    share the exchange on doc_id."""
    c = F.col("clasificacion")
    look = [x for x in LOOK if x in labelled.columns]
    b = labelled.select("doc_id", "seq", "clasificacion", "contenido", *look)
    b = b.withColumn("kind", F.when(c.isin(P.ALONE), 0).when(c.isin(P.PASSING), 1).otherwise(2))
    b = b.withColumn("grp", F.count(F.when(F.col("kind") == 0, 1)).over(by_doc().rowsBetween(Window.unboundedPreceding, 0)))
    b = b.withColumn("_t", F.when(F.col("kind") == 2, strip(F.col("contenido"))))
    w = Window.partitionBy("doc_id", "grp", F.col("kind") == 2).orderBy("seq")
    sub, last = c == P.SUB2, F.lag("_t").over(w)
    far = F.abs(F.col("pnum") - F.lag("pnum").over(w)) > 5 if "pnum" in look else F.lit(False)
    new = last.isNull() | (last == "") | last.rlike(r"[.?!:]$") | F.coalesce(F.lag(sub).over(w), F.lit(False)) | sub | far
    b = b.withColumn("_new", new).withColumn("_first", F.lag("_t").over(w).isNull()).withColumn("_next", ~F.coalesce(F.lead("_new").over(w), F.lit(True)))
    text = F.when(F.col("_next") & F.col("_t").endswith("-"), F.expr("left(_t, length(_t) - 1)")).when(F.col("_next"), F.concat("_t", F.lit(" "))).otherwise(F.col("_t"))
    piece = F.concat(F.when(F.col("_new") & ~F.col("_first"), "\n\n").otherwise(""), F.when(sub, "§SUB§").otherwise(""), text)
    rows = F.array_sort(F.collect_list(F.struct("seq", "kind", "clasificacion", F.when(F.col("kind") == 2, piece).otherwise(F.col("contenido")).alias("contenido"), *look)))
    g = b.groupBy("doc_id", "grp").agg(rows.alias("_r"))
    one = lambda x, kind, label, text: F.struct(F.lit(kind).alias("kind") if isinstance(kind, int) else kind.alias("kind"), x["seq"].alias("seq"), label.alias("clasificacion"), text.alias("contenido"), *[x[k].alias(k) for k in look])
    g = g.withColumn("_b", F.filter("_r", lambda x: x["kind"] == 2))
    alone = F.transform(F.filter("_r", lambda x: x["kind"] < 2), lambda x: one(x, x["kind"], x["clasificacion"], x["contenido"]))
    body = one(F.get("_b", F.lit(0)), 2, F.lit(P.CUERPO), F.array_join(F.transform("_b", lambda x: x["contenido"]), ""))
    every = F.concat(alone, F.filter(F.array(body), lambda x: x["seq"].isNotNull()))
    return g.select("doc_id", "grp", F.inline(every)).select("doc_id", "grp", "kind", "seq", "clasificacion", "contenido", *look)


def histogram(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("clasificacion").agg(F.count("*").alias("n"))


def top_labels(blocks: DataFrame, top: int = 6) -> DataFrame:
    """(doc_id, rank, clasificacion, n): each document's commonest labels; of equal ones the one met first."""
    g = blocks.groupBy("doc_id", "clasificacion").agg(F.count("*").alias("n"), F.min("seq").alias("_first"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "_first")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("doc_id", "rank", "clasificacion", "n")


def summary(blocks: DataFrame, **more: DataFrame) -> DataFrame:
    """(doc_id, blocks, labels, and a count of each further table by its name): labels are the six commonest with their
    numbers, as `label: n` parted by bars."""
    g = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"))
    t = top_labels(blocks).groupBy(F.col("doc_id").alias("_d"))
    t = t.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "clasificacion", "n"))), lambda x: F.concat(x["clasificacion"], F.lit(": "), x["n"])), "  |  ").alias("labels"))
    g = g.join(t, F.col("doc_id") == F.col("_d")).drop("_d")
    for name, rows in more.items():
        g = g.join(rows.groupBy(F.col("doc_id").alias("_d")).agg(F.count("*").alias("_n")), F.col("doc_id") == F.col("_d"), "left").withColumn(name, F.coalesce("_n", F.lit(0).cast("long"))).drop("_d", "_n")
    return g


def with_label(blocks: DataFrame, label: str) -> DataFrame:
    """The blocks of a label; all for `Todos`."""
    return blocks if label == "Todos" else blocks.where(F.col("clasificacion") == label)


def search(blocks: DataFrame, query: str, step: int = 0) -> DataFrame:
    """Blocks that hold the query, whatever its case and accents, with hit (from 0), hits (of the document) and current:
    the hit that a cursor is at, which begins at the first and goes round."""
    from quire.functions.text import found_in

    b = blocks.where(found_in(F.col("contenido"), query)).withColumn("hit", F.row_number().over(by_doc()) - 1)
    b = b.withColumn("hits", F.count("*").over(Window.partitionBy("doc_id")))
    return b.withColumn("current", F.col("hit") == F.pmod(F.lit(step), F.col("hits")))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Adds two_columns and ord: pages in two columns (two or more text blocks' middles on either side of 55 % of the
    width) are read left, then right; the rest from top to bottom. Rows whose `imagen` is true, if there is such a column,
    make no column but lie in one."""
    w = Window.partitionBy("doc_id", "pnum")
    left = (F.col("x0") + F.col("x1")) / 2 < 0.55 * F.col("page_w")
    text = ~F.col("imagen") if "imagen" in blocks.columns else F.lit(True)
    two = (F.sum((left & text).cast("int")).over(w) >= 2) & (F.sum((~left & text).cast("int")).over(w) >= 2)
    b = blocks.withColumn("two_columns", two)
    side = F.when(F.col("two_columns") & ~left, 1).otherwise(0)
    return b.withColumn("_side", side).withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("pnum", "_side", "y0", "block_no"))).drop("_side")


def at_edge():
    """Whether a block of a page after the first is a running header or footer by its place."""
    return (F.col("pnum") > 0) & ((F.col("y1") < 0.05 * F.col("page_h")) | (F.col("y0") > 0.95 * F.col("page_h")))


def is_content():
    """Whether a text is neither a running header or footer, nor a header text of the upper 12 %, nor under three
    characters."""
    t, h = strip(F.col("contenido")), F.col("page_h")
    upper = (F.col("pnum") > 0) & (F.col("y1") < 0.12 * h) & has(F.substring(t, 1, 100), P.HEADER_TEXT)
    return ~at_edge() & ~upper & (F.length(t) >= 3)


def without_headers(blocks: DataFrame) -> DataFrame:
    """Without running headers and footers, header texts of the upper 12 % and texts under three characters."""
    return blocks.where(is_content())


def outside_tables(blocks: DataFrame, rects: DataFrame, share: float = 0.4) -> DataFrame:
    """Blocks of which no table rectangle (doc_id, pnum, rx0, ry0, rx1, ry1) of the page covers that share. Rows whose
    `imagen` is true, if there is such a column, stay."""
    r = rects.select(F.col("doc_id").alias("_d"), F.col("pnum").alias("_p"), "rx0", "ry0", "rx1", "ry1")
    w = F.greatest(F.lit(0), F.least("x1", "rx1") - F.greatest("x0", "rx0"))
    h = F.greatest(F.lit(0), F.least("y1", "ry1") - F.greatest("y0", "ry0"))
    area = F.greatest(F.lit(1), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    text = ~F.col("imagen") if "imagen" in blocks.columns else F.lit(True)
    return blocks.join(r, (F.col("doc_id") == F.col("_d")) & (F.col("pnum") == F.col("_p")) & text & (w * h / area >= share), "left_anti")


def nearest(items: DataFrame, texts: DataFrame, score, valid, name: str) -> DataFrame:
    """Of each item (doc_id, pnum, item, ix0, iy0, ix1, iy1) the text of least score on its page, '' if none."""
    t = texts.select(F.col("doc_id").alias("_d"), F.col("pnum").alias("_p"), "x0", "y0", "x1", "y1", "block_no", "contenido")
    wide = F.greatest(F.lit(0), F.least("x1", "ix1") - F.greatest("x0", "ix0")) / F.greatest(F.lit(1), F.least(F.col("x1") - F.col("x0"), F.col("ix1") - F.col("ix0")))
    both = items.join(t, (F.col("doc_id") == F.col("_d")) & (F.col("pnum") == F.col("_p")) & (wide >= 0.15) & valid, "left")
    return both.groupBy("doc_id", "pnum", "item").agg(F.coalesce(F.min_by("contenido", F.when(F.col("_d").isNotNull(), F.struct(score, F.col("block_no")))), F.lit("")).alias(name))


def captions(images: DataFrame, texts: DataFrame) -> DataFrame:
    """The nearest caption at or below each image, without its label."""
    from quire.functions.text import figure_caption

    dy = F.col("y0") - F.col("iy1")
    near = nearest(images, texts, F.abs(dy), (dy >= -8) & (dy <= 180) & has(strip(F.col("contenido")), P.CAPTION), "caption")
    return near.withColumn("caption", figure_caption(F.col("caption")))


def table_titles(tables: DataFrame, texts: DataFrame) -> DataFrame:
    """The nearest table title above, else below, each table, without its label."""
    from quire.functions.text import table_title

    up, down = F.col("iy0") - F.col("y1"), F.col("y0") - F.col("iy1")
    above = (up >= 0) & (up <= 140)
    near = nearest(tables, texts, F.when(above, up).otherwise(down + 200), (above | ((down >= 0) & (down <= 80))) & has(strip(F.col("contenido")), P.TABLE_PREFIX), "title")
    return near.withColumn("title", table_title(F.col("title")))


def body_size(blocks: DataFrame) -> DataFrame:
    """Each document's commonest rounded size; of several the one met first."""
    g = blocks.groupBy("doc_id", F.bround("size").alias("s")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return g.groupBy("doc_id").agg(F.min_by("s", F.struct(-F.col("n"), F.col("first"))).alias("body_size"))


def sections(blocks: DataFrame) -> DataFrame:
    """Adds sec_no, the running number of headings, and has_heading of the document."""
    head = F.col("clasificacion").isin(P.SECCION, P.SUB, P.SUB2)
    return blocks.withColumn("sec_no", F.sum(head.cast("int")).over(by_doc().rowsBetween(Window.unboundedPreceding, 0))).withColumn("has_heading", F.max(head).over(Window.partitionBy("doc_id")))


def with_author_zone(blocks: DataFrame) -> DataFrame:
    """Adds _zone: whether a block lies strictly between a title (the secondary, else the main) and the next abstract
    heading; without a title, or without such a heading after it, none does."""
    doc = Window.partitionBy("doc_id")
    first = lambda cond: F.min(F.when(cond, F.col("seq"))).over(doc)
    c = F.col("clasificacion")
    b = blocks.withColumn("_t", F.coalesce(first(c == P.TITULO2), first(c == P.TITULO)))
    b = b.withColumn("_a", first((c == P.SECCION) & is_abstract_heading(F.col("contenido")) & (F.col("seq") > F.col("_t"))))
    return b.withColumn("_zone", F.coalesce((F.col("seq") > F.col("_t")) & (F.col("seq") < F.col("_a")), F.lit(False))).drop("_t", "_a")


def without_author_zone(blocks: DataFrame) -> DataFrame:
    """Without the blocks of with_author_zone()."""
    return with_author_zone(blocks).where("not _zone").drop("_zone")


def distinct_notes(blocks: DataFrame) -> DataFrame:
    """Of notes with the same first 80 characters in a document the first."""
    w = Window.partitionBy("doc_id", F.substring(strip(F.col("contenido")), 1, 80)).orderBy("seq")
    return blocks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
