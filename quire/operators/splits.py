"""Blocks cut where a heading or a table title runs on inside them, and overrides of single blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import apart, has, norm, strip
from quire.operators.blocks import auto_label

#: `Abstract` as a word of its own, unless a word on technical matters stands at most 20 characters before it.
ALONE = r"(?i)(?<![\p{L}\d_])abstract(?![\p{L}\d_])"


def split_embedded(labelled: DataFrame) -> DataFrame:
    """Adds sub_seq (0, 1, 2) and cuts a block in text before, heading and text after.

    All of it is one projection and a generator, so rows stay where they are. First headings of P.EMBEDDED, the first of that list that occurs past the beginning, at its first occurrence; else
    `Abstract` alone; else, in body text, a table title up to 200 characters long. The text before a heading gets the
    label its look asks for; the text after keeps the block's. Empty parts are left out, and nothing is cut twice.
    A body block that begins with a table title becomes one."""
    t = F.col("contenido")
    # plain searches say first where patterns and places are worth asking for
    x = labelled.withColumn("_head", F.coalesce(*[F.when(F.when(F.contains(t, F.lit(h)), F.instr(t, h)) > 1, F.lit(h)) for h in P.EMBEDDED], F.lit("")))
    first = F.when(t.rlike("(?i)abstract"), F.regexp_instr(t, F.lit(ALONE))).otherwise(0)
    near = F.lower(F.expr("substring(contenido, greatest(1, _abs - 20), least(20, _abs - 1))"))
    x = x.withColumn("_abs", first)
    x = x.withColumn("_abs", F.when((F.col("_head") == "") & (F.col("_abs") > 1) & ~near.rlike("technical|técnico"), F.col("_abs")).otherwise(0))
    table = r"(?i)(?<![\p{L}\d_])" + P.TABLE_INSIDE
    free = (F.col("_head") == "") & (F.col("_abs") == 0) & (F.col("clasificacion") == P.CUERPO)
    x = x.withColumn("_tab", F.when(free & t.rlike(r"(?i)tab(la|le)\s"), F.regexp_instr(t, F.lit(table))).otherwise(0))
    x = x.withColumn("_title", F.when(F.col("_tab") > 0, F.regexp_extract(t, table, 1)).otherwise(""))
    x = x.withColumn("_at", F.when(F.col("_head") != "", F.instr(t, F.col("_head"))).when(F.col("_abs") > 0, F.col("_abs")).otherwise(F.when(F.col("_tab") > 1, F.col("_tab")).otherwise(0)))
    middle = F.when(F.col("_head") != "", F.col("_head")).when(F.col("_abs") > 0, "Abstract").otherwise(strip(F.col("_title")))
    long = F.when(F.col("_head") != "", F.length("_head")).when(F.col("_abs") > 0, 8).otherwise(F.length("_title"))
    x = x.withColumn("_before", strip(F.expr("substring(contenido, 1, _at - 1)"))).withColumn("_n", long)
    after = strip(F.expr("substring(contenido, _at + _n)"))
    is_title = (F.col("_head") == "") & (F.col("_abs") == 0)
    own = labelled.columns
    again = auto_label(text="_before", font="_no_font")  # labels as they are: former ones stay here
    x = x.withColumn("_no_font", F.lit("")).withColumn("_again", F.when(apart(is_title), F.col("clasificacion")).otherwise(again))
    part = lambda i, text, label: F.struct(F.lit(i).alias("sub_seq"), text.alias("t"), label.alias("c"))
    parts = F.filter(F.array(part(0, F.col("_before"), F.col("_again")), part(1, middle, F.when(is_title, P.TABLA).otherwise(P.SECCION)), part(2, after, F.col("clasificacion"))), lambda p: p["t"] != "")
    same = F.array(part(0, t, F.when(F.col("_tab") == 1, P.TABLA).otherwise(F.col("clasificacion"))))
    x = x.withColumn("_p", F.explode(F.when(F.col("_at") > 1, parts).otherwise(same)))
    rest = [c for c in own if c not in ("contenido", "clasificacion")]
    return x.select(*rest, F.col("_p.t").alias("contenido"), F.col("_p.c").alias("clasificacion"), F.col("_p.sub_seq").alias("sub_seq"))


def last_edits(edits: DataFrame) -> DataFrame:
    """(doc_id, seq, contenido, clasificacion): of a log of edits (doc_id, seq, version, contenido, clasificacion) the last
    value of each block and field that is not null. Edits of one version that differ: the greatest value."""
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("version", c)))[c].alias(c)
    return edits.groupBy("doc_id", "seq").agg(last("contenido"), last("clasificacion"))


def override(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """Blocks with the last non-null contenido and clasificacion of edits (doc_id, seq, contenido, clasificacion, and
    version if there are several of a block). Rows of blocks stay as many as they are."""
    log = edits if "version" in edits.columns else edits.withColumn("version", F.lit(0))
    e = last_edits(log).select("doc_id", "seq", F.col("contenido").alias("_t"), F.col("clasificacion").alias("_c"))
    x = blocks.join(e, ["doc_id", "seq"], "left")
    return x.withColumn("contenido", F.coalesce("_t", "contenido")).withColumn("clasificacion", F.coalesce("_c", "clasificacion")).select(*blocks.columns)


def renumbered(blocks: DataFrame, *order: str) -> DataFrame:
    """Blocks with seq from 0 on without gaps, in the given order (seq, and sub_seq if there is one)."""
    keys = order or tuple(c for c in ("seq", "sub_seq") if c in blocks.columns)
    w = Window.partitionBy("doc_id").orderBy(*keys)
    return blocks.withColumn("seq", F.row_number().over(w) - 1).drop("sub_seq")


def edited(blocks: DataFrame, edits: DataFrame, deletions: DataFrame | None = None) -> DataFrame:
    """Blocks after a log of edits and deletions (doc_id, seq), renumbered. An edit of a deleted block changes nothing."""
    x = override(blocks, edits)
    return renumbered(x if deletions is None else without(x, deletions, "doc_id", "seq"))


def without(rows: DataFrame, deletions: DataFrame, *keys: str) -> DataFrame:
    return rows.join(deletions.select(*keys), list(keys), "left_anti")


def route(labelled: DataFrame, journal: str = "") -> DataFrame:
    """Adds part: where a block goes in a JATS article (null: nowhere), and text, its clean text.

    Parts are ref, front_note, cite_note, date_note, keywords_es, keywords_en, keywords, abstract_es, abstract_en,
    abstract_plain_es, abstract_plain_en, heading and paragraph. What a block is depends on the last heading before it.
    A heading that is the journal's name, if one is given, is a front note."""
    from quire.functions.text import clean, has_clean, is_body_heading, is_meta_heading

    x = labelled.where(has_clean(F.col("contenido"))).withColumn("text", clean(F.col("contenido")))
    c, t = F.col("clasificacion"), F.col("_norm")
    head, sub = c == P.SECCION, c.isin(P.SUB, P.SUB2)
    # headings only are folded, once each: an And would fold every text, as what its sides share is evaluated before them
    x = x.withColumn("_norm", F.when(head, norm(F.col("text"))))
    meta = head & is_meta_heading(t, journal)
    titles = F.create_map(*[F.lit(v) for v in ("resumen", "es", "abstract", "en", "resumen no tecnico", "plain_es", "non-technical abstract", "plain_en")])
    refs = head & t.isin("referencias", "references")
    meta = meta & ~refs
    x = x.withColumn("_mode", F.when(head & ~refs & ~meta, F.coalesce(titles[t], F.lit(""))).when(refs | sub | c.isin(P.CUERPO, P.NORMAL), ""))
    x = x.withColumn("_refs", F.when(refs, True).when(head & ~meta, False))
    w = Window.partitionBy("doc_id").orderBy("seq")
    x = x.withColumn("_mode", F.nullif(F.last("_mode", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit("")))
    x = x.withColumn("_in", F.coalesce(F.last("_refs", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    mode = F.col("_mode")
    part = (
        F.when(meta, "front_note").when(head, F.when(~refs & titles[t].isNull() & is_body_heading(F.col("text"), t), "heading"))
        .when(F.col("_in"), F.when(c.isin(P.REFERENCIA, P.CUERPO, P.NORMAL), "ref"))
        .when(c == P.CITAR, "cite_note").when(c == P.FECHA, "date_note")
        .when(c == P.CLAVE, F.when(mode.isin("es", "plain_es"), "keywords_es").when(mode.isin("en", "plain_en"), "keywords_en").otherwise("keywords"))
        .when(c == "Cuerpo del abstract", F.concat(F.lit("abstract_"), F.coalesce(mode, F.lit("es"))))
        .when((c == P.RESUMEN) & mode.isNotNull(), F.concat(F.lit("abstract_"), mode)).when(sub, "heading").when(c.isin(P.CUERPO, P.NORMAL, P.RESUMEN), "paragraph")
    )
    return x.withColumn("part", part).drop("_norm", "_mode", "_refs", "_in")
