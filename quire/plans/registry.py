"""Queries of the document operators over blocks that are derived from the test tables by integer arithmetic,
with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import citation as C
from quire.functions import patterns as P
from quire.functions import text as T
from quire.operators import blocks as B
from quire.operators import render, spans, splits


def _lines(spark, sf_dir, by="doc_id"):
    d = B.dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", by=by)
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def blocks(spark, sf_dir, by="doc_id"):
    """Lines as blocks: a third get a telling beginning, and size, style, font and box follow from numbers."""
    x = _lines(spark, sf_dir, by)
    p, line, k = F.col("pos"), F.col("line"), F.col("doc_id") * 7 + F.col("pos") * 3
    starts = ["1. ", "2.3. ", "Tabla 3. ", "1998 ", None, None, None, "Figura 2. ", None, "Cómo citar: ", None]
    whole = {
        4: "Abstract", 5: "Referencias", 6: "Palabras clave: Uno.; dos, uno ;; Dos", 10: "Manuscrito  recibido: Diciembre 5, 2020", 13: "1998 García-Pérez Soto; Ñu", 14: "Corrected manuscript of 2021",
        15: "Resumen no Técnico:", 16: "Ana Ruiz1,*; Luz Paz²", 17: "ver https://doi.org/10.1/x. Manuscrito aceptado: 20-12-2021. Manuscript revised: mayo 3 2022",
    }
    m = (p + F.col("doc_id")) % 31
    t = F.when(m == 8, F.concat(F.lit("josé.ñandú+1@correo-ü.org "), F.substring(line, 1, 20)))
    for i, s in [*enumerate(starts), (11, "Fig. 3a. "), (12, "Table2: ")]:
        if s:
            t = t.when(m == i, F.concat(F.lit(s), line))
    for i, s in whole.items():
        t = t.when(m == i, F.lit(s))
    block = p % 6
    return x.select(
        "doc_id", p.alias("seq"), t.otherwise(line).alias("contenido"), F.floor(p / 6).cast("int").alias("pnum"), block.alias("block_no"),
        F.element_at(F.array(*[F.lit(float(v)) for v in (9, 10, 12, 13, 8.5)]), (k % 5 + 1).cast("int")).alias("size"),
        ((F.col("doc_id") + p) % 2 == 0).alias("bold"), ((F.col("doc_id") + p * 5) % 3 == 0).alias("italic"),
        F.when(k % 3 == 0, "Times-Roman").when(k % 3 == 1, "Arial").otherwise("Calibri").alias("font"),
        F.lit(600).alias("page_w"), F.lit(800).alias("page_h"), (40 + 300 * ((F.col("doc_id") + p) % 2)).alias("x0"),
        (280 + 300 * ((F.col("doc_id") + p) % 2)).alias("x1"), (20 + 125 * block).alias("y0"), (120 + 125 * block).alias("y1"),
    )


_BLOCKS = """
l as (select doc_id, unnest(generate_series(0, len(a) - 1)) as pos, unnest(a) as line from (select doc_id, string_split(text, chr(10)) as a from documents)),
b as (select doc_id, cast(pos as integer) as seq,
  case (pos + doc_id) % 31 when 8 then 'josé.ñandú+1@correo-ü.org ' || substring(line, 1, 20) when 0 then '1. ' || line when 1 then '2.3. ' || line
    when 2 then 'Tabla 3. ' || line when 3 then '1998 ' || line when 7 then 'Figura 2. ' || line when 9 then 'Cómo citar: ' || line
    when 4 then 'Abstract' when 5 then 'Referencias' when 6 then 'Palabras clave: Uno.; dos, uno ;; Dos' when 10 then 'Manuscrito  recibido: Diciembre 5, 2020' when 11 then 'Fig. 3a. ' || line
    when 12 then 'Table2: ' || line when 13 then '1998 García-Pérez Soto; Ñu' when 14 then 'Corrected manuscript of 2021' when 15 then 'Resumen no Técnico:' when 16 then 'Ana Ruiz1,*; Luz Paz²'
    when 17 then 'ver https://doi.org/10.1/x. Manuscrito aceptado: 20-12-2021. Manuscript revised: mayo 3 2022' else line end as contenido,
  cast(pos // 6 as integer) as pnum, cast(pos % 6 as integer) as block_no,
  ([9.0, 10.0, 12.0, 13.0, 8.5])[cast((doc_id * 7 + pos * 3) % 5 + 1 as integer)]::double as size,
  (doc_id + pos) % 2 = 0 as bold, (doc_id + pos * 5) % 3 = 0 as italic,
  case (doc_id * 7 + pos * 3) % 3 when 0 then 'Times-Roman' when 1 then 'Arial' else 'Calibri' end as font,
  600 as page_w, 800 as page_h, 40 + 300 * ((doc_id + pos) % 2) as x0, 280 + 300 * ((doc_id + pos) % 2) as x1, 20 + 125 * (pos % 6) as y0, 120 + 125 * (pos % 6) as y1
  from l),
"""


def _i(pattern, col="t"):
    return f"regexp_matches({col}, '{pattern}', 'i')"


def _c(pattern, col="t"):
    return f"regexp_matches({col}, '{pattern}')"


def _in(labels):
    return ", ".join("'" + x.replace("'", "''") + "'" for x in labels)


# the SQL states its lists and patterns by itself, not by those of the operators
_IN = _in([
    "resumen", "abstract", "resumen no técnico", "non-technical abstract", "palabras clave", "keywords", "introducción", "introduction", "conclusiones", "conclusions", "referencias",
    "references", "agradecimientos", "acknowledgements", "discusión", "discussion", "metodología", "methods", "resultados", "results", "contribuciones de los autores",
    "contribucción de autores", "authors' contribution", "conflicto de intereses", "conflict of interest", "conflicts of interest", "competing interests", "paleontología sistemática", "systematic palaeontology",
])
_BODY_IN = _in([
    "resumen", "abstract", "resumen no técnico", "non-technical abstract", "palabras clave", "keywords", "referencias", "references", "conclusiones", "conclusions", "agradecimientos",
    "acknowledgements", "acknowledgments", "discusión", "resultados", "introducción", "metodología", "contribuciones de los autores", "contribucción de autores", "contribución de autores",
    "authors' contribution", "conflicto de intereses", "conflict of interest", "conflicts of interest", "competing interests", "declaración de conflictos",
])
_MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre january february march april may june july august september october november december".split()
_ONE, _TWO = r"^[0-9]+[.]\s*\S", r"^[0-9]+[.][0-9]+"
_FIG, _TAB = r"^(figura|figure)\s+[0-9]+[.:\s]", r"^(tabla|table)\s+[0-9]+[.:\s]"
_LETTER = "^[a-zA-Z]{1,3}\\s+[A-ZÁÉÍÓÚÑÜ][a-zA-ZÁÉÍÓÚÑÜáéíóúñü]"
_CITE = f"(starts_with(lower(t), 'cómo citar') or starts_with(lower(t), 'how to cite') or (length(t) < 400 and {_i(r',[[:space:]]*[0-9]+[[:space:]]*[(][0-9]+[)][[:space:]]*,[[:space:]]*[0-9]+[[:space:]]*(–|-)[[:space:]]*[0-9]+')} and not {_i('https?://')}))"
_NOTE = _i(r"manuscrito\s+(recibido|corregido|aceptado)|manuscript\s+(received|revised|accepted)")
_SENTENCE = _c(r"\.\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]")
_DOILINE = f"({_i('https?://doi[.]org/')} and length(t) <= 200 and not ({_SENTENCE} and not {_NOTE}))"
_INST = _i(r",|\b(university|instituto|department|lab|center|centre|museum|college|faculty|school|national|natural)\b")
_LETTERED = f"{_c(_LETTER)} and not {_c(r'[.][[:space:]]+[A-Z]', 'substring(t, 1, 30)')} and {_INST}"
_AUTO = f"""case when lower(t) in ({_IN}) then '{P.SECCION}' when {_CITE} then '{P.CITAR}' when {_NOTE} or {_DOILINE} then '{P.FECHA}'
  when {_i(r'^(palabras\s+clave|keywords)\s*[:.]')} then '{P.CLAVE}' when {_i(_TAB)} then '{P.TABLA}' when {_i(r'@[\p{L}\p{N}_.-]+[.][\p{L}\p{N}_]{2,}')} and length(t) < 120 then '{P.EMAIL}'
  when {_i(r'^\d+\.\s+\S')} and not {_i(r'^\d+\.\d')} and s <= 12 then '{P.SUB}' when {_i(_TWO)} and s <= 12 then '{P.SUB2}'
  when s >= 13 and bold and not italic then '{P.TITULO}' when s >= 13 and bold and italic then '{P.TITULO2}' when s = 13 and not bold and not italic then '{P.AUTORES}'
  when s = 12 and italic then '{P.EMAIL}' when s = 12 and not bold then '{P.NORMAL}' when s = 10 and bold then '{P.SECCION}' when s = 10 and not bold then '{P.SUB}'
  when {_LETTERED} then '{P.FILIACION}'
  when s = 9 and not {_c('times|roman', 'lower(font)')} and {_c('^([0-9]+|[a-zA-Z])\\s+[A-ZÁÉÍÓÚÑÜ]')} and {_INST} then '{P.FILIACION}'
  when s = 9 and ({_c('times|roman', 'lower(font)')} or length(t) > 100) then '{P.RESUMEN}' when s = 9 and length(t) < 80 then '{P.FILIACION}' when s = 9 then '{P.RESUMEN}'
  when length(t) < 4 then '{P.IGNORAR}' else '{P.NORMAL}' end"""
_LABELS = _BLOCKS + f"""
z as (select *, regexp_replace(contenido, '^\\s+|\\s+$', '', 'g') as t, round_even(size, 0) as s from b),
st as (select *, min(case when {_i(_ONE)} and not {_i(_TWO)} and s <= 12 then seq end) over (partition by doc_id) as z0 from z),
en as (select *, min(case when lower(t) in ('referencias', 'references') and seq >= z0 then seq end) over (partition by doc_id) as z1 from st),
au as (select *, {_AUTO} as auto,
  case when {_i(_ONE)} and not {_i(_TWO)} then '{P.SUB}' when {_i(_TWO)} then '{P.SUB2}' when {_CITE} then '{P.CITAR}' when {_NOTE} or {_DOILINE} then '{P.FECHA}'
  when lower(t) in ({_BODY_IN}) then '{P.SECCION}' when {_i(r'\b(tabla|table)\s+\d+[.:\s]')} then '{P.TABLA}' when {_i(_FIG)} then '{P.FIGURA}' else '{P.CUERPO}' end as body,
  case when z0 is not null and seq >= z0 and (z1 is null or seq < z1) then 'B' when z1 is not null and seq >= z1 then 'C' else 'A' end as zone from en),
lab as (select doc_id, seq, contenido, pnum, zone, case when z1 = seq then '{P.SECCION}' when zone = 'B' then body
  when auto in ('{P.NORMAL}', '{P.AUTORES}', '{P.RESUMEN}') then '{P.CUERPO}' when auto = '{P.IMAGEN}' then '{P.IGNORAR}' else auto end as clasificacion, auto from au),
"""


_TABLE_MODE = f"""
ev as (select *, regexp_replace(contenido, '^\\s+|\\s+$', '', 'g') as t, clasificacion = '{P.CUERPO}' and {_c('^(18|19|20)[0-9][0-9]\\s+\\S', 't')} and not {_i('^(18|19|20)[0-9][0-9]\\s+[a-zÁÉÍÓÚÑáéíóúñü-]+(\\s+[a-zÁÉÍÓÚÑáéíóúñü-]+){0,4}\\s*;', 't')} as rowish,
  clasificacion in ({_in(P.TABLE_ENDS)}) or (clasificacion = '{P.CUERPO}' and length(contenido) > 200 and {_c('[.?!]\\s*$', 'contenido')}) as ending from lab),
e2 as (select *, case when clasificacion = '{P.TABLA}' then 'ON' when rowish and ending then 'TG' when rowish then 'ON' when ending then 'OFF' else 'NOP' end as ev from ev),
e3 as (select *, coalesce(sum(case when ev in ('ON', 'OFF') then 1 else 0 end) over w, 0) as rid,
  last_value(case ev when 'ON' then true when 'OFF' then false end ignore nulls) over w as base from e2
  window w as (partition by doc_id order by seq rows between unbounded preceding and 1 preceding)),
e4 as (select *, coalesce(sum(case when ev = 'TG' then 1 else 0 end) over (partition by doc_id, rid order by seq rows between unbounded preceding and 1 preceding), 0) as tg from e3),
kept as (select doc_id, seq, contenido, pnum, clasificacion from e4 where case when clasificacion = '{P.TABLA}' then true when ev = 'ON' then false when ev = 'OFF' then true
  when ev = 'TG' then coalesce(base, false) <> (tg % 2 = 1) else not (coalesce(base, false) <> (tg % 2 = 1)) end),
"""
_FUSE = f"""
k as (select *, case when clasificacion in ({_in(P.ALONE)}) then 0 when clasificacion in ({_in(P.PASSING)}) then 1 else 2 end as kind from kept),
g as (select *, count(case when kind = 0 then 1 end) over (partition by doc_id order by seq) as grp from k),
m0 as (select * replace (regexp_replace(contenido, '^\\s+|\\s+$', '', 'g') as contenido), clasificacion = '{P.SUB2}' as sub from g where kind = 2),
m1 as (select *, lag(contenido) over w as prev, coalesce(lag(sub) over w, false) as psub, lag(pnum) over w as ppnum from m0 window w as (partition by doc_id, grp order by seq)),
m2 as (select *, prev is null or prev = '' or {_c('[.?!:]$', 'prev')} or psub or sub or abs(pnum - ppnum) > 5 as new from m1),
m3 as (select *, sum(case when new then 1 else 0 end) over w as par, not coalesce(lead(new) over w, true) as nxt from m2 window w as (partition by doc_id, grp order by seq)),
m4 as (select *, (case when sub then '§SUB§' else '' end) || case when nxt and contenido like '%-' then left(contenido, length(contenido) - 1) when nxt then contenido || ' ' else contenido end as piece from m3),
p1 as (select doc_id, grp, par, string_agg(piece, '' order by seq) as text, min(seq) as first from m4 group by all),
fused as (select doc_id, grp, kind, seq, clasificacion, contenido from g where kind < 2 union all
  select doc_id, grp, 2 as kind, min(first) as seq, '{P.CUERPO}' as clasificacion, string_agg(text, chr(10) || chr(10) order by par) as contenido from p1 group by doc_id, grp)
"""


def _fused(spark, sf_dir):
    return B.fuse(B.drop_table_rows(B.label(blocks(spark, sf_dir))))


def _items(spark, sf_dir):
    """A box on each page, between its blocks."""
    b = blocks(spark, sf_dir)
    return b.groupBy("doc_id", "pnum").agg(F.lit(1).alias("item")).select("doc_id", "pnum", "item", F.lit(60).alias("ix0"), (100 + 125 * (F.col("doc_id") % 3)).alias("iy0"), F.lit(260).alias("ix1"), (160 + 125 * (F.col("doc_id") % 3)).alias("iy1"))


_ITEMS = "i as (select distinct doc_id, pnum, 1 as item, 60 as ix0, 100 + 125 * (doc_id % 3) as iy0, 260 as ix1, 160 + 125 * (doc_id % 3) as iy1 from b),"
_WIDE = "greatest(0, least(x1, ix1) - greatest(x0, ix0)) / greatest(1, least(x1 - x0, ix1 - ix0))::double >= 0.15"


def _refs(spark, sf_dir):
    """References put together from orders and customers."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    y = (1950 + k % 70).cast("string")
    raw = F.concat(k.cast("string"), F.lit(". Autor, A. B. ("), y, F.lit("). Titulo "), F.col("o_custkey").cast("string"), F.when(k % 5 == 0, F.lit(". Revista, 12(3), 45–67. https://doi.org/10.1234/abc")).when(k % 5 == 1, F.lit(". In Libro (eds.) 10-20.")).when(k % 5 == 2, F.lit(". Informe anual.pdf")).when(k % 5 == 3, F.lit(". http://ejemplo.org/x")).otherwise(F.lit(". Editorial")))
    return o.select(k.alias("ref_no"), raw.alias("raw"), F.concat(F.when(k % 2 == 0, "Diciembre ").otherwise("el Brumario "), (k % 28 + 1).cast("string"), F.when(k % 3 == 0, ", ").otherwise(" "), y).alias("d1"), F.concat((k % 28 + 1).cast("string"), F.lit(" de marzo de "), y).alias("d2"), F.concat((k % 28 + 1).cast("string"), F.when(k % 2 == 0, "/").otherwise("-"), (k % 12 + 1).cast("string"), F.lit("/"), y).alias("d3"))


_REFS = """r as (select o_orderkey as ref_no, cast(o_orderkey as varchar) || '. Autor, A. B. (' || cast(1950 + o_orderkey % 70 as varchar) || '). Titulo ' || cast(o_custkey as varchar) ||
  case o_orderkey % 5 when 0 then '. Revista, 12(3), 45–67. https://doi.org/10.1234/abc' when 1 then '. In Libro (eds.) 10-20.' when 2 then '. Informe anual.pdf' when 3 then '. http://ejemplo.org/x' else '. Editorial' end as raw,
  o_orderkey as k, cast(1950 + o_orderkey % 70 as varchar) as y from orders)"""


def _affiliations(spark, sf_dir):
    """Affiliations whose country is the longest name, of equal ones the first of the list, or the last part, or none."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey")
    place = F.element_at(F.array(*map(F.lit, ("México", "España.", "Chile y China", "Francia, Poland", "Nowhere", "Honduras", "El Salvador, Perú", "Guatemala ;"))), (F.col("c_custkey") % 8 + 1).cast("int"))
    return c.select("c_custkey", F.concat(F.lit("1 Universidad "), F.col("c_name"), F.lit(", "), place).alias("text"))


def _notes(spark, sf_dir):
    """Lines of two affiliations, date notes and tagged text, a customer each."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", F.col("c_nationkey").cast("string").alias("n"))
    k = F.col("c_custkey")
    return c.select(
        "c_custkey", F.when(k % 3 == 0, F.concat(F.lit("1 Instituto "), "c_name")).otherwise(F.concat(F.lit("a Museo "), "c_name", F.lit(", Chile. b Centro "), "n", F.lit(", Cuba."))).alias("line"),
        F.concat(F.lit("Manuscrito recibido: Marzo "), (k % 28 + 1).cast("string"), F.lit(", 2020. Manuscript accepted: 4 de "), F.when(k % 2 == 0, "mayo").otherwise("brumario"), F.lit(" de 2021. Manuscrito raro: 1/1/2000")).alias("dates"),
        F.concat(F.lit("Material. "), "c_name", F.lit(" <b> Remarks. Sinonimia. z")).alias("tagged"),
        F.concat(F.lit("Hay: • "), "c_name", F.lit(" • dos. Otros son: • "), "n").alias("listed"),
        F.array(F.struct(F.array(F.struct(F.concat("c_name", F.lit("ab-")).alias("text"), F.lit(9.0).alias("size"), F.lit(16).alias("flags"), F.lit("Arial").alias("font"))).alias("spans")), F.struct(F.array(F.struct(F.lit("cd  ").alias("text"), F.lit(10.0).alias("size"), F.lit(0).alias("flags"), F.lit("Times").alias("font")), F.struct(F.col("n").alias("text"), F.lit(11.0).alias("size"), F.lit(0).alias("flags"), F.lit("Times").alias("font"))).alias("spans"))).alias("lines"),
    )


def _grid(spark, sf_dir):
    """The nations of each region as a table."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_regionkey", "n_nationkey", F.array("n_name", F.col("n_nationkey").cast("string")).alias("row"))
    g = n.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "row"))), lambda x: x["row"]).alias("rows"))
    return g.select("n_regionkey", F.concat(F.array(F.array(F.lit("a&b"), F.lit("key"))), "rows").alias("grid"))


def _edits(spark, sf_dir):
    return blocks(spark, sf_dir).where("seq % 7 = 0").select("doc_id", "seq", F.when(F.col("seq") % 2 == 0, "nuevo").alias("contenido"), F.when(F.col("seq") % 3 == 0, P.TITULO).alias("clasificacion"))


def queries() -> dict:
    pick = lambda f, *cols: lambda s, d: f(s, d).select(*cols)
    lab = lambda s, d: B.label(blocks(s, d))
    refs = lambda s, d: _refs(s, d)
    long = lambda c: F.col(c).cast("long").alias(c)
    return {
        "block_lines": pick(blocks, "doc_id", "seq", "contenido", "pnum", "size", "bold", "italic", "font"),
        "label_ladder": lambda s, d: blocks(s, d).select("doc_id", "seq", B.auto_label().alias("clasificacion")),
        "zone_ladder": pick(lab, "doc_id", "seq", "zone", "clasificacion"),
        "table_mode": lambda s, d: B.drop_table_rows(lab(s, d)).select("doc_id", "seq", "clasificacion"),
        "fuse_paragraphs": lambda s, d: _fused(s, d).select("doc_id", long("grp"), "kind", "seq", "clasificacion", "contenido"),
        "label_histogram": lambda s, d: B.histogram(_fused(s, d)),
        "reading_order": lambda s, d: B.reading_order(blocks(s, d)).select("doc_id", "seq", "two_columns", long("ord")),
        "header_filter": lambda s, d: B.without_headers(blocks(s, d)).select("doc_id", "seq"),
        "table_overlap_anti": lambda s, d: B.outside_tables(blocks(s, d), _items(s, d).select("doc_id", "pnum", F.col("ix0").alias("rx0"), F.col("iy0").alias("ry0"), F.col("ix1").alias("rx1"), F.col("iy1").alias("ry1"))).select("doc_id", "seq"),
        "caption_nearest": lambda s, d: B.captions(_items(s, d), blocks(s, d)).select("doc_id", "pnum", "caption"),
        "title_nearest": lambda s, d: B.table_titles(_items(s, d), blocks(s, d)).select("doc_id", "pnum", "title"),
        "body_font_mode": lambda s, d: B.body_size(blocks(s, d)),
        "block_search": lambda s, d: B.search(blocks(s, d), " TIÓN", -1).select("doc_id", "seq", long("hit"), long("hits"), "current"),
        "section_number": lambda s, d: B.sections(lab(s, d)).select("doc_id", "seq", long("sec_no"), "has_heading"),
        "author_zone": lambda s, d: B.without_author_zone(lab(s, d)).select("doc_id", "seq"),
        "note_dedup": lambda s, d: B.distinct_notes(lab(s, d).where(F.col("clasificacion").isin(P.FECHA, P.CITAR))).select("doc_id", "seq"),
        "emails": lambda s, d: blocks(s, d).select("doc_id", "seq", F.explode(T.emails(F.col("contenido"))).alias("email")),
        "html_escape": lambda s, d: blocks(s, d).select("doc_id", "seq", T.escape(F.col("contenido")).alias("html")),
        "keywords": lambda s, d: lab(s, d).where(F.col("clasificacion") == P.CLAVE).select("doc_id", "seq", F.explode(T.distinct_keywords(T.keywords(F.col("contenido")))).alias("kw")),
        "ref_prefix": lambda s, d: refs(s, d).select("ref_no", T.reference_text(F.col("raw")).alias("ref")),
        "pub_type": lambda s, d: refs(s, d).select("ref_no", T.publication_type(F.col("raw")).alias("pub_type")),
        "ref_year_pages_doi": lambda s, d: refs(s, d).select("ref_no", F.regexp_extract("raw", r"\((\d{4})\)", 1).alias("year"), F.regexp_extract("raw", P.PAGES, 1).alias("fpage"), F.regexp_extract("raw", P.PAGES, 2).alias("lpage"), F.regexp_extract("raw", P.DOI_URL, 1).alias("doi")),
        "date_parse": lambda s, d: refs(s, d).select("ref_no", F.explode(F.array(*[F.struct(F.lit(c).alias("form"), T.date_parts(F.col(c)).alias("p")) for c in ("d1", "d2", "d3")])).alias("x")).select("ref_no", "x.form", "x.p.day", "x.p.month", "x.p.year"),
        "affil_country": lambda s, d: _affiliations(s, d).select("c_custkey", T.country(F.col("text")).alias("x")).select("c_custkey", "x.name", "x.code"),
        "person_name": lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", T.person(F.concat(F.lit("Ana de "), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.col("c_name"), F.lit(", Luz"))).otherwise(F.col("c_name")))).alias("p")).select("c_custkey", "p.surname", "p.given"),
        "citation_parse": lambda s, d: C.citations(refs(s, d)).select("ref_no", "pub_type", "doi", "url", "year", F.concat_ws("|", F.transform("authors", lambda a: F.concat(a["surname"], F.lit("/"), a["given"]))).alias("authors"), "article_title", "source", "volume", "issue", "fpage", "lpage", "elocation"),
        "affil_split": lambda s, d: _notes(s, d).select("c_custkey", F.posexplode(T.affiliations(F.col("line"))).alias("part", "a")).select("c_custkey", "part", "a.label", "a.body"),
        "manuscript_dates": lambda s, d: _notes(s, d).select("c_custkey", F.explode(C.manuscript_dates(F.col("dates"))).alias("x")).select("c_custkey", "x.*"),
        "editorial_tags": lambda s, d: _notes(s, d).select("c_custkey", T.editorial(F.col("tagged")).alias("html")),
        "bullet_lists": lambda s, d: _notes(s, d).select("c_custkey", render.paragraph_or_list(F.col("listed")).alias("html")),
        "span_blocks": lambda s, d: _notes(s, d).select("c_custkey", spans.block_text().alias("contenido"), spans.font_info().alias("f")).select("c_custkey", "contenido", "f.size", "f.bold", "f.italic", "f.font"),
        "grid_tables": lambda s, d: _grid(s, d).select("n_regionkey", T.html_table(F.col("grid")).alias("html"), T.jats_table(F.col("grid")).alias("jats")),
        "block_override": lambda s, d: splits.override(lab(s, d), _edits(s, d)).select("doc_id", "seq", "contenido", "clasificacion"),
        "block_deletion": lambda s, d: splits.without(blocks(s, d), _edits(s, d), "doc_id", "seq").select("doc_id", "seq"),
        "jats_route": lambda s, d: splits.route(lab(s, d)).select("doc_id", "seq", "part"),
        "reference_split": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(T.references(F.replace(F.col("text"), F.lit("\n"), F.lit("\n7. ")))).alias("ref_no", "raw")),
        "css_extract": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", T.css_of(F.concat(F.lit("<style>@import url('x');"), F.regexp_replace("html", "(?s)^.*?<style>", ""))).alias("css"), F.md5(T.body_of(F.col("html")).cast("binary")).alias("body_md5")),
        "xhtml_fix": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(T.as_xhtml(F.col("html")).cast("binary")).alias("fixed_md5")),
    }


def oracle_sql() -> dict[str, str]:
    w = "with " + _BLOCKS.strip().rstrip(",")
    base = lambda body: f"{w} {body}"
    chain = lambda ctes, body: "with " + ctes.strip().rstrip(",") + " " + body
    lab = lambda body: chain(_LABELS, body)
    return {
        "block_lines": base("select doc_id, seq, contenido, pnum, size, bold, italic, font from b"),
        "label_ladder": lab("select doc_id, seq, auto as clasificacion from lab"),
        "zone_ladder": lab("select doc_id, seq, zone, clasificacion from lab"),
        "table_mode": chain(_LABELS + _TABLE_MODE, "select doc_id, seq, clasificacion from kept"),
        "fuse_paragraphs": chain(_LABELS + _TABLE_MODE + _FUSE, "select doc_id, grp, cast(kind as integer) as kind, seq, clasificacion, contenido from fused"),
        "label_histogram": chain(_LABELS + _TABLE_MODE + _FUSE, "select clasificacion, count(*) as n from fused group by clasificacion"),
        "reading_order": base("""select doc_id, seq, two_columns, row_number() over (partition by doc_id order by pnum, case when two_columns and not lft then 1 else 0 end, y0, block_no) as ord from (
            select *, sum(case when lft then 1 else 0 end) over p >= 2 and sum(case when lft then 0 else 1 end) over p >= 2 as two_columns
            from (select *, (x0 + x1) / 2.0 < 0.55 * page_w as lft from b) window p as (partition by doc_id, pnum))"""),
        "header_filter": base(f"""select doc_id, seq from (select *, regexp_replace(contenido, '^\\s+|\\s+$', '', 'g') as t from b) where not (pnum > 0 and (y1 < 0.05 * page_h or y0 > 0.95 * page_h))
            and not (pnum > 0 and y1 < 0.12 * page_h and {_i(r'^(https?://doi[.]org/|doi[.]org/|[0-9]{1,3}$|paleontolog[íi]a mexicana\s+vol[.])', 'substring(t, 1, 100)')}) and length(t) >= 3"""),
        "table_overlap_anti": chain(_BLOCKS + _ITEMS, """select doc_id, seq from b where not exists (select 1 from i where i.doc_id = b.doc_id and i.pnum = b.pnum
            and greatest(0, least(x1, ix1) - greatest(x0, ix0)) * greatest(0, least(y1, iy1) - greatest(y0, iy0)) / greatest(1, (x1 - x0) * (y1 - y0))::double >= 0.4)"""),
        "caption_nearest": chain(_BLOCKS + _ITEMS, f"""select i.doc_id, i.pnum, regexp_replace(regexp_replace(coalesce(arg_min(trim(regexp_replace(contenido, '\\s+', ' ', 'g')), abs(y0 - iy1) * 1000 + block_no), ''), '^(figura|fig[.]?|figure)\\s*[0-9]+[a-z]?(\\s*-\\s*[a-z])?[.):]?\\s*', '', 'i'), '^[ :\\t-]+|[ :\\t-]+$', '', 'g') as caption from i left join b on i.doc_id = b.doc_id and i.pnum = b.pnum
            and {_WIDE} and y0 - iy1 between -8 and 180 and {_i(r'^\s*(figura|fig[.]?|figure|table|tabla)\s*[0-9]+', 'contenido')} group by i.doc_id, i.pnum"""),
        "title_nearest": chain(_BLOCKS + _ITEMS, f"""select i.doc_id, i.pnum, regexp_replace(regexp_replace(coalesce(arg_min(trim(regexp_replace(contenido, '\\s+', ' ', 'g')), (case when iy0 - y1 between 0 and 140 then iy0 - y1 else y0 - iy1 + 200 end) * 1000 + block_no), ''), '^(tabla|table)\\s*[0-9]+[a-z]?(\\s*-\\s*[a-z])?[.):]?\\s*', '', 'i'), '^[ :\\t-]+|[ :\\t-]+$', '', 'g') as title
            from i left join b on i.doc_id = b.doc_id and i.pnum = b.pnum and {_WIDE} and (iy0 - y1 between 0 and 140 or y0 - iy1 between 0 and 80) and {_i(r'^\s*(tabla|table)\s*[0-9]+', 'contenido')} group by i.doc_id, i.pnum"""),
        "body_font_mode": base("""select doc_id, s as body_size from (select doc_id, round_even(size, 0) as s, row_number() over (partition by doc_id order by count(*) desc, min(seq)) as r from b group by doc_id, round_even(size, 0)) where r = 1"""),
        "block_search": base("""select doc_id, seq, hit, hits, hit = hits - 1 as current from (select doc_id, seq, row_number() over (partition by doc_id order by seq) - 1 as hit, count(*) over (partition by doc_id) as hits
            from b where contains(strip_accents(lower(contenido)), 'tion'))"""),
        "section_number": lab(f"select doc_id, seq, cast(sum(case when h then 1 else 0 end) over (partition by doc_id order by seq) as bigint) as sec_no, max(h) over (partition by doc_id) as has_heading from (select *, clasificacion in ({_in([P.SECCION, P.SUB, P.SUB2])}) as h from lab)"),
        "author_zone": lab(f"""select doc_id, seq from (select *, min(case when clasificacion = '{P.SECCION}' and {_i('^(resumen|abstract|resumen no tecnico|non-technical abstract)[ ]*[:.]?$', "strip_accents(trim(contenido))")} and seq > t0 then seq end) over (partition by doc_id) as a0 from (
            select *, coalesce(min(case when clasificacion = '{P.TITULO2}' then seq end) over (partition by doc_id), min(case when clasificacion = '{P.TITULO}' then seq end) over (partition by doc_id)) as t0 from lab))
            where not coalesce(seq > t0 and seq < a0, false)"""),
        "note_dedup": lab(f"select doc_id, seq from (select *, row_number() over (partition by doc_id, substring(regexp_replace(contenido, '^\\s+|\\s+$', '', 'g'), 1, 80) order by seq) as n from lab where clasificacion in ('{P.FECHA}', '{P.CITAR}')) where n = 1"),
        "emails": base(f"select doc_id, seq, unnest(regexp_extract_all(contenido, '[\\p{{L}}\\p{{N}}_.+%-]+@[\\p{{L}}\\p{{N}}_.-]+[.][\\p{{L}}\\p{{N}}_]{{2,}}')) as email from b"),
        "html_escape": base("select doc_id, seq, replace(replace(replace(contenido, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as html from b"),
        "keywords": lab(f"""select doc_id, seq, kw from (select *, row_number() over (partition by doc_id, seq, lower(kw) order by i) as n from (
            select doc_id, seq, unnest(a) as kw, unnest(range(len(a))) as i from (select doc_id, seq, list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(regexp_replace(contenido, '\\s+', ' ', 'g')), '^(palabras clave|keywords) *[:.]? *', '', 'i'), '[;,]'),
            lambda x: regexp_replace(x, '^[ .;]+|[ .;]+$', '', 'g')), lambda x: x <> '') as a from lab where clasificacion = '{P.CLAVE}'))) where n = 1"""),
        "ref_prefix": f"with {_REFS} select ref_no, regexp_replace(raw, '^\\s*\\[?[0-9]+[.)\\]]\\s*', '') as ref from r",
        "pub_type": f"""with {_REFS} select ref_no, case when contains(lower(raw), 'doi.org') then 'journal' when {_i(',[ ]*[0-9]+[ ]*[(,]', 'raw')} then 'journal' when {_i('[(]eds?[.][)]| in |pp[.] ', 'raw')} then 'book'
            when {_i('[.]pdf|fundación|fundacion|informe|report', 'raw')} then 'report' when contains(lower(raw), 'http') then 'webpage' else 'journal' end as pub_type from r""",
        "ref_year_pages_doi": f"with {_REFS} select ref_no, regexp_extract(raw, '\\((\\d{{4}})\\)', 1) as year, regexp_extract(raw, '([0-9]+)\\s*[–-]\\s*([0-9]+)', 1) as fpage, regexp_extract(raw, '([0-9]+)\\s*[–-]\\s*([0-9]+)', 2) as lpage, regexp_extract(raw, 'https?://doi[.]org/(\\S+)', 1) as doi from r",
        "date_parse": f"""with {_REFS}, f as (select ref_no, unnest(['d1', 'd2', 'd3']) as form, k, y from r)
            select ref_no, form, cast(k % 28 + 1 as varchar) as day, case form when 'd1' then case when k % 2 = 0 then '12' else '' end when 'd2' then '3' else cast(k % 12 + 1 as varchar) end as month, y as year from f""",
        "affil_country": """select c_custkey, ['Mexico', 'Espana', 'Chile', 'Francia', '', 'Honduras', 'El Salvador', 'Guatemala'][cast(c_custkey % 8 + 1 as integer)] as name,
            ['MX', 'ES', 'CL', 'FR', '', 'HN', 'SV', 'GT'][cast(c_custkey % 8 + 1 as integer)] as code from customer""",
        "person_name": "select c_custkey, case when c_custkey % 2 = 0 then 'Ana de ' || c_name else c_name end as surname, case when c_custkey % 2 = 0 then 'Luz' else 'Ana de' end as given from customer",
        "citation_parse": f"""with {_REFS} select ref_no, ['journal', 'book', 'report', 'webpage', 'journal'][cast(k % 5 + 1 as integer)] as pub_type, case when k % 5 = 0 then '10.1234/abc' else '' end as doi,
            case when k % 5 = 3 then 'http://ejemplo.org/x' else '' end as url, y as year, cast(ref_no as varchar) || '. Autor/A. B' as authors, regexp_extract(raw, 'Titulo [0-9]+', 0) as article_title,
            ['Revista', 'In Libro (eds.) 10-20', 'Informe anual.pdf', '', 'Editorial'][cast(k % 5 + 1 as integer)] as source, case when k % 5 = 0 then '12' else '' end as volume, case when k % 5 = 0 then '3' else '' end as issue,
            case when k % 5 = 0 then '45' else '' end as fpage, case when k % 5 = 0 then '67' else '' end as lpage, '' as elocation from r""",
        "affil_split": """select c_custkey, 0 as part, case when c_custkey % 3 = 0 then '1' else 'a' end as label, case when c_custkey % 3 = 0 then 'Instituto ' || c_name else 'Museo ' || c_name || ', Chile' end as body from customer
            union all select c_custkey, 1, 'b', 'Centro ' || c_nationkey || ', Cuba' from customer where c_custkey % 3 <> 0""",
        "manuscript_dates": """select c_custkey, 'received' as date_type, cast(c_custkey % 28 + 1 as varchar) as day, '3' as month, '2020' as year from customer
            union all select c_custkey, 'accepted', '4', case when c_custkey % 2 = 0 then '5' else '' end, '2021' from customer""",
        "editorial_tags": "select c_custkey, '<strong>Material.</strong> ' || c_name || ' &lt;b&gt; <br><strong>Remarks.</strong> <br><strong>Sinonimia.</strong><br>z' as html from customer",
        "bullet_lists": """select c_custkey, concat_ws(chr(10), '<p class="cuerpo">Hay:</p>', '<ul class="lista-bullets cuerpo-list">', '  <li>' || c_name || '</li>', '  <li>dos.</li>', '</ul>', '<p class="cuerpo">Otros son:</p>',
            '<ul class="lista-bullets cuerpo-list">', '  <li>' || c_nationkey || '</li>', '</ul>') as html from customer""",
        "span_blocks": "select c_custkey, c_name || 'abcd ' || c_nationkey as contenido, 10.0::double as size, true as bold, false as italic, 'times' as font from customer",
        "grid_tables": """select n_regionkey, concat_ws(chr(10), '<table class="pm-tabla">', '<thead><tr>', '<th>a&amp;b</th>', '<th>key</th>', '</tr></thead><tbody>', string_agg(concat_ws(chr(10), '<tr>', '<td>' || n_name || '</td>', '<td>' || n_nationkey || '</td>', '</tr>'), chr(10) order by n_nationkey), '</tbody></table>') as html,
            '<table><thead><tr><th>a&amp;b</th><th>key</th></tr></thead><tbody>' || string_agg('<tr><td>' || n_name || '</td><td>' || n_nationkey || '</td></tr>', '' order by n_nationkey) || '</tbody></table>' as jats from nation group by n_regionkey""",
        "block_override": lab(f"select doc_id, seq, case when seq % 14 = 0 then 'nuevo' else contenido end as contenido, case when seq % 21 = 0 then '{P.TITULO}' else clasificacion end as clasificacion from lab"),
        "block_deletion": base("select doc_id, seq from b where seq % 7 <> 0"),
        "jats_route": lab(f"""select doc_id, seq, case when meta then 'front_note' when head and not refs and title is null and ({_c('^[0-9]+([.][0-9]+)*[ .-]+', 'text')} or t in ({_in(['introduccion', 'material y metodos', 'materiales y metodos', 'resultados', 'resultados y discusion', 'discusion', 'conclusiones', 'agradecimientos', 'conflicto de intereses', 'contribuciones de los autores'])})) then 'heading' when head then null
            when coalesce(last_value(case when refs then true when head and not meta then false end ignore nulls) over (w rows between unbounded preceding and current row), false) then case when c in ({_in([P.REFERENCIA, P.CUERPO, P.NORMAL])}) then 'ref' end
            when c = '{P.CITAR}' then 'cite_note' when c = '{P.FECHA}' then 'date_note' when c = '{P.CLAVE}' then case when mode like '%es' then 'keywords_es' when mode like '%en' then 'keywords_en' else 'keywords' end
            when c = '{P.RESUMEN}' and mode <> '' then 'abstract_' || mode when c in ('{P.SUB}', '{P.SUB2}') then 'heading' when c in ({_in([P.CUERPO, P.NORMAL, P.RESUMEN])}) then 'paragraph' end as part from (
            select *, last_value(case when head and not refs and not meta then coalesce(title, '') when refs or c in ({_in([P.SUB, P.SUB2, P.CUERPO, P.NORMAL])}) then '' end ignore nulls) over (partition by doc_id order by seq rows between unbounded preceding and 1 preceding) as mode from (
            select *, head and not refs and {_i('issn|volumen[ ]+[0-9]|vol[.][ ]*[0-9]|num[.][ ]*[0-9]|p[.][ ]*[0-9]+|' + '|'.join(_MONTHS) + '|[(][0-9]{4}[)]')} as meta from (
            select *, head and t in ('referencias', 'references') as refs, case t when 'resumen' then 'es' when 'abstract' then 'en' when 'resumen no tecnico' then 'plain_es' when 'non-technical abstract' then 'plain_en' end as title from (
            select doc_id, seq, clasificacion as c, clasificacion = '{P.SECCION}' as head, text, strip_accents(lower(text)) as t from (
            select *, trim(regexp_replace(contenido, '\\s+', ' ', 'g')) as text from lab) where text <> '')))) window w as (partition by doc_id order by seq)"""),
        "reference_split": r"""select doc_id, cast(unnest(range(len(a))) as integer) as ref_no, unnest(a) as raw from (select doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || '7. '), '(?m)^\s*(?:\[?\d+[.)\]]\s*)'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as a from documents)""",
        "css_extract": """select page_id, regexp_extract(regexp_replace(html, '^.*?<style>', '<style>', 's'), '^(<style>)?(.*?)</style>', 2, 's') as css,
            md5(case when regexp_matches(html, '<body>.*?</body>', 's') then regexp_extract(html, '<body>(.*?)</body>', 1, 's') else html end) as body_md5 from pages""",
        # entities that are references are hidden from the replacement of ampersands
        "xhtml_fix": r"""select page_id, md5(replace(replace(regexp_replace(replace(regexp_replace(regexp_replace(html, '<(br|hr)\s*>', '<\1/>', 'g'), '<(img|input)([^>]*[^/])\s*>', '<\1\2/>', 'g'), chr(1), ''),
            '&(amp;|lt;|gt;|quot;|apos;|#[0-9]+;|#x[0-9a-fA-F]+;)', chr(1) || '\1', 'g'), '&', '&amp;'), chr(1), '&')) as fixed_md5 from pages""",
    }
