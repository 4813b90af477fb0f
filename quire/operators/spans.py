"""Blocks from layout spans: `lines` is array<struct<spans array<struct<text, size, flags, font>>>>."""

from __future__ import annotations

from pyspark.sql import functions as F

# fixed values: dashes at which a word may be cut at the end of a line
DASHES = "\\-\u00ad\u2010\u2011\u2012\u2013\u2014"
STARTS_LOW = r"^\s*[a-záéíóúñü]"


def font_info(lines="lines"):
    """struct(size, bold, italic, font): mean size (10 without spans), any bold, any italic, commonest font in lower
    case; of several fonts the one met first, '' without spans."""
    spans = F.flatten(F.transform(F.col(lines), lambda x: x["spans"]))
    n = F.coalesce(F.size(spans), F.lit(0))
    fonts = F.transform(spans, lambda s: F.lower(F.coalesce(s["font"], F.lit(""))))
    mean = F.when(n > 0, F.aggregate(spans, F.lit(0.0), lambda a, s: a + s["size"]) / n).otherwise(10.0)
    flag = lambda bit, names: F.coalesce(F.exists(spans, lambda s: (s["flags"].bitwiseAND(F.lit(bit)) != 0) | F.lower(F.coalesce(s["font"], F.lit(""))).rlike(names)), F.lit(False))
    counted = F.transform(F.array_distinct(fonts), lambda f, i: F.struct(F.size(F.filter(fonts, lambda g: g == f)).alias("n"), (-i).alias("i"), f.alias("f")))
    return F.struct(
        mean.alias("size"), flag(16, "bold|black|heavy|semibold|demi").alias("bold"), flag(2, "italic|oblique|kursiv").alias("italic"),
        F.coalesce(F.array_max(counted)["f"], F.lit("")).alias("font"),
    )


def block_text(lines="lines"):
    """Text of a block. A line that ends in a dash is glued to one that goes on in lower case; others get a blank."""
    texts = F.transform(F.col(lines), lambda x: F.array_join(F.transform(x["spans"], lambda s: s["text"]), ""))
    cut = rf"[{DASHES}]\s*$"
    glue = lambda a, b: F.when(a.isNull(), b).when(a.rlike(cut) & b.rlike(STARTS_LOW), F.concat(F.regexp_replace(a, cut, ""), F.ltrim(b))).otherwise(F.concat(a, F.lit(" "), b))
    t = F.coalesce(F.aggregate(texts, F.lit(None).cast("string"), glue), F.lit(""))
    t = F.regexp_replace(F.regexp_replace(F.replace(t, F.lit("\u00ad"), F.lit("")), r"(?U)\s+", " "), r"^ | $", "")
    return F.regexp_replace(t, r"(?U)(\w)[\u2010-\u2014\-]\s+([a-záéíóúñü])", "$1$2")
