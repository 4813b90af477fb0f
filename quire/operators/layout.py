"""From layout relations of pages (blocks of spans, images, ruled tables) to blocks, figures and tables.

Boxes are struct<x0, y0, x1, y1>; pages count from 0, `pagina` from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import squeeze, strip
from quire.operators import blocks as B
from quire.operators.spans import block_text, font_info

#: A picture smaller than this is none.
LEAST_SIDE = 32


def _box(name: str = "bbox"):
    return [F.col(f"{name}.{k}").cast("double").alias(k) for k in ("x0", "y0", "x1", "y1")]


def text_blocks(page_blocks: DataFrame) -> DataFrame:
    """(doc_id, pnum, block_no, contenido, x0, y0, x1, y1) of text blocks of three characters or more: what captions and
    titles are looked for in. page_blocks: doc_id, pnum, page_w, page_h, block_no, type (0 text, 1 image), bbox, lines."""
    # a generator, as a condition on the text would be pushed below it and make each text again
    text = F.explode(F.filter(F.array(strip(block_text())), lambda t: F.length(t) >= 3))
    return page_blocks.where("type = 0").select("doc_id", "pnum", "block_no", text.alias("contenido"), *_box())


def raw_blocks(page_blocks: DataFrame, rects: DataFrame | None = None) -> DataFrame:
    """Blocks in reading order: doc_id, seq, contenido, size, bold, italic, font, imagen, clasificacion (of images: small
    ones and those at the page's edge are passed over), pnum, block_no, x0 to y1, page_w, page_h.

    Columns of a page follow from all its blocks; then running headers and footers, texts that tables cover (rects: see
    outside_tables()), texts under three characters and header texts of the upper zone go. Blocks of other types go."""
    x = page_blocks.where("type in (0, 1)").select("doc_id", "pnum", F.col("page_w").cast("double").alias("page_w"), F.col("page_h").cast("double").alias("page_h"), "block_no", (F.col("type") == 1).alias("imagen"), "lines", *_box())
    w, h = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    number = lambda v: F.bround(v).cast("long").cast("string")
    image = F.concat(F.lit("[IMAGEN "), number(w), F.lit("×"), number(h), F.lit("px]"))
    small = (w < LEAST_SIDE) & (h < LEAST_SIDE)
    # texts before the windows of reading_order(): conditions on them are not pushed below those, where each would make them again
    x = x.withColumn("_f", font_info()).withColumn("contenido", F.when(F.col("imagen"), image).otherwise(block_text())).drop("lines")
    x = B.reading_order(x).drop("two_columns")
    x = x.withColumn("clasificacion", F.when(F.col("imagen"), F.when(small | B.at_edge(), P.IGNORAR).otherwise(P.IMAGEN)))
    x = x.where(F.col("imagen") | B.is_content())
    if rects is not None:
        x = B.outside_tables(x, rects)
    off = lambda name, value: F.when(F.col("imagen"), F.lit(value)).otherwise(F.col(f"_f.{name}")).alias(name)
    seq = (F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1).alias("seq")
    return x.select("doc_id", seq, "contenido", off("size", 0.0), off("bold", False), off("italic", False), off("font", None), "imagen", "clasificacion", "pnum", "block_no", "x0", "y0", "x1", "y1", "page_w", "page_h")


def _first_of_place(rows: DataFrame, *order: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Of rows in the same place of a page (to a tenth of a point) the first."""
    place = [F.bround(F.col(f"bbox.{k}"), 1) for k in ("x0", "y0", "x1", "y1")]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "pnum", *also, *place).orderBy(*order))).where("_n = 1").drop("_n")


def _numbered(rows: DataFrame, name: str, *ties: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("doc_id").orderBy("pagina", "iy0", "ix0", *ties)))


def _items(rows: DataFrame, *item: str) -> DataFrame:
    box = [F.col(f"bbox.{k}").cast("double").alias(f"i{k}") for k in ("x0", "y0", "x1", "y1")]
    return rows.withColumn("item", F.struct(*item)).select("doc_id", "pnum", "item", *box)


def image_name(pnum, number, occurrence, ext):
    """p001_img01_01.png: page, image and occurrence from 1, a plain extension; jpx is written as jpg."""
    plain = F.regexp_replace(F.lower(F.coalesce(ext, F.lit(""))), "[^a-z0-9]", "")
    plain = F.when(plain == "", "png").when(plain == "jpx", "jpg").otherwise(plain)
    return F.format_string("p%03d_img%02d_%02d.%s", pnum + 1, number, occurrence, plain)


def figures(images: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, fig_no, path, pie, ancla, pagina, origen, bytes) of images (doc_id, pnum, xref, img_idx, occ, ext, bbox,
    bytes) of LEAST_SIDE or more either way, each placement once, in order of page, height and side, with the nearest
    caption below. texts: see text_blocks()."""
    x = images.where((F.col("bbox.x1") - F.col("bbox.x0") >= LEAST_SIDE) & (F.col("bbox.y1") - F.col("bbox.y0") >= LEAST_SIDE))
    x = _first_of_place(x, "img_idx", "occ", also=("xref",)).withColumn("item", F.struct("img_idx", "occ"))
    pie = B.captions(_items(x, "img_idx", "occ"), texts)
    x = x.join(pie, ["doc_id", "pnum", "item"]).withColumns({"pagina": F.col("pnum") + 1, "iy0": F.col("bbox.y0"), "ix0": F.col("bbox.x0")})
    x = _numbered(x, "fig_no", "img_idx", "occ")
    return x.select("doc_id", "fig_no", image_name(F.col("pnum"), F.col("img_idx"), F.col("occ"), F.col("ext")).alias("path"), F.col("caption").alias("pie"), F.lit("").alias("ancla"), "pagina", F.lit("auto_pdf").alias("origen"), "bytes")


def clean_grid(grid):
    """Cells squeezed, rows of blanks left out, rows padded to the longest."""
    rows = F.transform(grid, lambda r: F.transform(r, lambda c: squeeze(F.coalesce(c, F.lit("")))))
    rows = F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))
    wide = F.array_max(F.transform(rows, lambda r: F.size(r)))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r))))


def tables(pdf_tables: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, tab_no, grid, titulo, ancla, pagina, origen, pnum, rx0, ry0, rx1, ry1) of pdf_tables (doc_id, pnum, tab_idx,
    bbox, grid): each place once, those with two rows and two columns or more, in order of page, height and side, with the
    nearest title above, else below. The rectangles are those outside_tables() asks for."""
    x = _first_of_place(pdf_tables.where("bbox is not null"), "tab_idx").where(F.size("grid") >= 2).withColumn("grid", clean_grid(F.col("grid")))
    x = x.where((F.size("grid") >= 2) & (F.size(F.get("grid", F.lit(0))) >= 2)).withColumn("item", F.struct("tab_idx"))
    title = B.table_titles(_items(x, "tab_idx"), texts)
    x = x.join(title, ["doc_id", "pnum", "item"]).withColumns({"pagina": F.col("pnum") + 1, "iy0": F.col("bbox.y0"), "ix0": F.col("bbox.x0")})
    x = _numbered(x, "tab_no", "tab_idx")
    return x.select("doc_id", "tab_no", "grid", F.col("title").alias("titulo"), F.lit("").alias("ancla"), "pagina", F.lit("auto_pdf").alias("origen"), "pnum", *[F.col(f"bbox.{k}").cast("double").alias(f"r{k}") for k in ("x0", "y0", "x1", "y1")])


def with_detected(manual: DataFrame, detected: DataFrame, number: str = "tab_no") -> DataFrame:
    """The manual rows, less those detected before, then the newly detected ones, numbered through for each document."""
    names = [c for c in manual.columns if c in detected.columns]
    both = manual.where(~F.col("origen").eqNullSafe("auto_pdf")).select(*names, F.lit(0).alias("_k")).unionByName(detected.select(*names, F.lit(1).alias("_k")))
    return both.withColumn(number, F.row_number().over(Window.partitionBy("doc_id").orderBy("_k", number))).drop("_k")


def first_errors(errors: DataFrame, most: int = 3) -> DataFrame:
    """Of errors (doc_id, kind, seq, message) the first of each kind and document."""
    return errors.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("seq"))).where(F.col("_n") <= most).drop("_n")


def table_diagnosis(documents: DataFrame, found: DataFrame, errors: DataFrame) -> DataFrame:
    """(doc_id, diagnosis): how many tables on how many pages, else what went wrong: errors of kind find, extract or save,
    in this order, the first three of the first kind that there is. found: see tables()."""
    n = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("pagina").alias("pages"))
    e = first_errors(errors).groupBy("doc_id", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "message"))), lambda x: x["message"]), " | ").alias("m"))
    e = e.groupBy("doc_id").pivot("kind", ["find", "extract", "save"]).agg(F.first("m"))
    x = documents.select("doc_id").distinct().join(n, "doc_id", "left").join(e, "doc_id", "left")
    said = (
        F.when(F.col("n") > 0, F.format_string("detectadas %d tabla(s) en %d pagina(s)", "n", "pages"))
        .when(F.col("find").isNotNull(), F.concat(F.lit("la deteccion fallo: "), "find")).when(F.col("extract").isNotNull(), F.concat(F.lit("se detectaron tablas pero no se pudieron extraer: "), "extract"))
        .when(F.col("save").isNotNull(), F.concat(F.lit("se detectaron tablas pero no se pudieron guardar: "), "save")).otherwise("no se detectaron tablas")
    )
    return x.select("doc_id", said.alias("diagnosis"))
