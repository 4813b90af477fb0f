"""Further queries of the document operators, each with the same in SQL where SQL can say it; the SQL states its
patterns by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import citation as C
from quire.functions import patterns as P
from quire.functions import text as T
from quire.operators import blocks as B
from quire.operators import chain, layout, people, render, splits
from quire.plans import registry
from quire.plans.registry import _AUTO, _BLOCKS, _FUSE, _LABELS, _TABLE_MODE, _fused, _grid, blocks


def _customers(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", F.col("c_nationkey").cast("string").alias("n"), F.col("c_custkey").alias("k"))


def _pages(spark, sf_dir, scans: bool = False):
    """Pages of layout blocks: two lines of a span each, every thirteenth an image; the first block of a page at its edge
    or in its upper zone. Scans hold the telling texts of blocks() in several sizes, short ones in one line."""
    if scans:
        d = blocks(spark, sf_dir, by="").select("doc_id", F.col("seq").alias("pos"), F.col("contenido").alias("line"))
    else:
        d = registry._lines(spark, sf_dir, by="")
    p, k, no = F.col("pos"), F.col("doc_id") + F.col("pos"), F.col("pos") % 6
    text = F.when((no == 0) & (p % 4 == 0), "12").otherwise(F.col("line"))
    half = F.floor(F.length(text) / 2).cast("int")
    sizes = F.lit(9.0), F.lit(11.0)
    if scans:
        half = F.when(F.length(text) < 60, F.length(text)).otherwise(half)
        sizes = (F.element_at(F.array(*[F.lit(float(v)) for v in (9, 10, 12, 13, 8.5)]), ((F.col("doc_id") * 7 + p * 3) % 5 + 1).cast("int")),) * 2
    span = lambda t, size, flags, font: F.struct(F.array(F.struct(t.alias("text"), size.alias("size"), flags.alias("flags"), font.alias("font"))).alias("spans"))
    first = F.concat(F.substring(text, F.lit(1), half), F.when(k % 5 == 0, "-").otherwise(""))
    lines = F.array(span(first, sizes[0], F.when(k % 3 == 0, 16).otherwise(0), F.when(k % 7 == 0, "Arial-Bold").otherwise("Times")), span(F.substring(text, half + 1, F.length(text)), sizes[1], F.when(k % 4 == 0, 2).otherwise(0), F.lit("Arial")))
    small = F.when(p % 2 == 0, 20.0).otherwise(240.0)
    image = k % 13 == 0
    x0 = 40.0 + 300.0 * (k % 2)
    y0 = F.when(no == 0, F.when(F.col("doc_id") % 2 == 0, 2.0).otherwise(30.0)).otherwise(20.0 + 125.0 * no)
    tall = F.when(no == 0, 30.0).when(image, small - 0.5).otherwise(100.0)
    box = F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + F.when(image, small).otherwise(240.0)).alias("x1"), (y0 + tall).alias("y1"))
    return d.select("doc_id", F.floor(p / 6).cast("int").alias("pnum"), F.lit(600.0).alias("page_w"), F.lit(800.0).alias("page_h"), no.alias("block_no"), F.when(image, 1).otherwise(0).alias("type"), box.alias("bbox"), F.when(~image, lines).alias("lines"))


_PAGES = r"""
l as (select doc_id, unnest(generate_series(0, len(a) - 1)) as pos, unnest(a) as line from (select doc_id, string_split(text, chr(10)) as a from documents)),
p0 as (select doc_id, pos, doc_id + pos as k, cast(pos // 6 as integer) as pnum, cast(pos % 6 as integer) as no, (doc_id + pos) % 13 = 0 as imagen, case when pos % 6 = 0 and pos % 4 = 0 then '12' else line end as t from l),
p1 as (select *, left(t, length(t) // 2) || case when k % 5 = 0 then '-' else '' end as a, substring(t, length(t) // 2 + 1) as b, case when pos % 2 = 0 then 20.0 else 240.0 end as small,
  40.0 + 300.0 * (k % 2) as x0, case when no = 0 then case when doc_id % 2 = 0 then 2.0 else 30.0 end else 20.0 + 125.0 * no end as y0 from p0),
p2 as (select *, x0 + case when imagen then small else 240.0 end as x1, y0 + case when no = 0 then 30.0 when imagen then small - 0.5 else 100.0 end as y1,
  regexp_replace(trim(regexp_replace(case when k % 5 = 0 and regexp_matches(b, '^\s*[a-záéíóúñü]') then left(a, length(a) - 1) || ltrim(b) else a || ' ' || b end, '\s+', ' ', 'g')), '([\p{L}\p{N}_])[‐-—-]\s+([a-záéíóúñü])', '\1\2', 'g') as text from p1),
texts as (select doc_id, pnum, no, text, x0, y0, x1, y1 from p2 where not imagen and length(trim(text)) >= 3),
"""


#: The same with the texts of blocks(), in several sizes.
_SCANS = _BLOCKS + _PAGES.replace(_PAGES[: _PAGES.index("p0 as")].strip(), "sl as (select doc_id, seq as pos, contenido as line from b),").replace("end as t from l)", "end as t from sl)").replace("length(t) // 2", "case when length(t) < 60 then length(t) else length(t) // 2 end")
#: Blocks of pages in SQL; {size} of the texts, and {free}, what else holds of them.
_LAYOUT = """select doc_id, row_number() over (partition by doc_id order by ord) - 1 as seq, contenido, size, bold, italic, font, imagen, clasificacion, pnum from (
            select *, case when imagen then '[IMAGEN ' || round_even(x1 - x0, 0)::bigint || '×' || round_even(y1 - y0, 0)::bigint || 'px]' else text end as contenido, case when imagen then 0.0 else {size} end::double as size,
              not imagen and (k % 3 = 0 or k % 7 = 0) as bold, not imagen and k % 4 = 0 as italic, case when imagen then null when k % 7 = 0 then 'arial-bold' else 'times' end as font,
              case when imagen then case when (x1 - x0 < 32 and y1 - y0 < 32) or (pnum > 0 and (y1 < 40 or y0 > 760)) then 'Ignorar' else 'Imagen' end end as clasificacion,
              row_number() over (partition by doc_id order by pnum, case when two and not lft then 1 else 0 end, y0, no) as ord
            from (select *, sum(case when lft and not imagen then 1 else 0 end) over w >= 2 and sum(case when not lft and not imagen then 1 else 0 end) over w >= 2 as two from (select *, (x0 + x1) / 2 < 330 as lft from p2) window w as (partition by doc_id, pnum)))
            where imagen or ({free} not (pnum > 0 and (y1 < 40 or y0 > 760)) and not (pnum > 0 and y1 < 96 and regexp_matches(substring(trim(text), 1, 100), '^(https?://doi[.]org/|doi[.]org/|[0-9]{{1,3}}$|paleontolog[íi]a mexicana\\s+vol[.])', 'i')) and length(trim(text)) >= 3)"""


def _tables(spark, sf_dir):
    """A ruled table on every third page, the same place twice, some too small; and their documents."""
    p = _pages(spark, sf_dir).select("doc_id", "pnum").distinct().where("pnum % 3 = 0")
    x = p.select("doc_id", "pnum", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("tab_idx"))
    k = F.col("doc_id") + F.col("pnum") + F.col("tab_idx")
    y = F.when(F.col("tab_idx") == 3, 400.04).otherwise(300.0)
    grid = F.when(k % 4 == 0, F.array(F.array(F.lit("una fila")))).otherwise(F.array(F.array(F.lit(" a  b "), F.lit(None).cast("string")), F.array(F.lit(" ")), F.array(F.lit("<c>"), F.lit("d"), F.lit("e"))))
    return x.select("doc_id", "pnum", "tab_idx", F.struct(F.lit(60.0).alias("x0"), y.alias("y0"), F.lit(260.0).alias("x1"), (y + 60).alias("y1")).alias("bbox"), grid.alias("grid"))


def _images(spark, sf_dir):
    p = _pages(spark, sf_dir).select("doc_id", "pnum").distinct()
    x = p.select("doc_id", "pnum", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("img_idx"))
    k = F.col("doc_id") + F.col("pnum")
    wide = F.when((k + F.col("img_idx")) % 5 == 0, 31.0).otherwise(200.0)
    ext = F.element_at(F.array(*map(F.lit, ("png", "JPX", "j.p-g", ""))), (k % 4 + 1).cast("int"))
    y = 100.0 + 125.0 * (F.col("doc_id") % 3) + F.when(F.col("img_idx") == 3, 10.0).otherwise(0.0)
    return x.select("doc_id", "pnum", F.when(F.col("img_idx") == 3, 7).otherwise(5).alias("xref"), "img_idx", F.lit(1).alias("occ"), ext.alias("ext"), F.struct(F.lit(60.0).alias("x0"), y.alias("y0"), (60 + wide).alias("x1"), (y + 60).alias("y1")).alias("bbox"), F.lit(b"x").alias("bytes"))


def _label(s, d):
    return B.label(blocks(s, d))


def _manual(spark, sf_dir):
    """Two authors by hand for every fourth document."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").where("doc_id % 4 = 0")
    return d.select("doc_id", F.inline(F.array(
        F.struct(F.lit(1).alias("ord"), F.lit(" Ruiz,  Ana ").alias("nombre"), F.lit("https://orcid.org/0000-0001-2345-678x").alias("orcid")),
        F.struct(F.lit(2).alias("ord"), F.lit("Luz María Paz").alias("nombre"), F.lit("ninguno").alias("orcid")), F.struct(F.lit(3).alias("ord"), F.lit(" ").alias("nombre"), F.lit("").alias("orcid")))))


def _texts(spark, sf_dir):
    """Files of affiliations, one a customer."""
    c = _customers(spark, sf_dir)
    return c.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("1 Instituto "), "c_name", F.lit(", México\n\n  2 Uno, Chile. b Dos\nInstituto suelto\n* ñé."), "n", F.lit("@ü.org\n* sin correo\n")).alias("text"))


def _links(s, d):
    lab = _label(s, d)
    authors = people.preferred(people.listed_authors(_manual(s, d)), people.authors_of_blocks(lab))
    return people.author_links(authors, people.affiliations_of_blocks(lab), people.emails_of_blocks(lab))


def _embedded(spark, sf_dir):
    """Blocks of which most have a heading or a table title inside them."""
    c = F.col("contenido")
    inside = [" Agradecimientos ", " abstract ", " technical Abstract: ", " Tabla 4. Lista de ", " Resumen no técnico Conflict of interest "]
    t = c
    for i, x in enumerate(inside):
        t = F.when((F.col("doc_id") + F.col("seq")) % 7 == i, F.concat(F.left(c, F.lit(40)), F.lit(x), F.substring(c, 41, 1 << 30))).otherwise(t)
    return blocks(spark, sf_dir).withColumn("contenido", t)


def _log(spark, sf_dir):
    """Up to three edits of a block, one of them of its label only, and edits of blocks that don't exist."""
    b = blocks(spark, sf_dir).where("seq % 5 = 0").select("doc_id", "seq")
    v = F.explode(F.sequence(F.lit(1), F.lit(1) + (F.col("doc_id") % 3).cast("int"))).alias("version")
    e = b.select("doc_id", "seq", v)
    text = F.when((F.col("version") + F.col("seq")) % 4 != 1, F.concat(F.lit("edición "), F.col("version").cast("string")))
    label = F.when((F.col("version") + F.col("seq")) % 3 == 0, F.when(F.col("version") % 2 == 0, P.SUB).otherwise(P.TITULO))
    return e.select("doc_id", "seq", "version", text.alias("contenido"), label.alias("clasificacion")).unionByName(e.where("seq = 0").select("doc_id", (F.col("seq") - 1).alias("seq"), "version", F.lit("nada").alias("contenido"), F.lit(None).cast("string").alias("clasificacion")))


def _html(s, d, book: bool = False):
    return render.html_documents(chain.paragraphs(_embedded(s, d)), "p{}", _manual(s, d), book=book)


def _jats(s, d):
    tabs = layout.tables(_tables(s, d), layout.text_blocks(_pages(s, d)))
    return render.jats_documents(splits.route(chain.paragraphs(_embedded(s, d))), authors=_manual(s, d), tables=tabs)


def _folded_signs(spark, sf_dir):
    """Lines with signs that are several letters, and syllables of Hangul, among their words."""
    signs = F.element_at(F.array(*map(F.lit, ("½ ", "㎞² ", "ﬁn… ", "각 ", "Ǆ ", "ĳ℡"))), ((F.col("doc_id") + F.col("seq")) % 6 + 1).cast("int"))
    return blocks(spark, sf_dir).select("doc_id", "seq", F.concat(F.left("contenido", F.lit(20)), signs, F.substring("contenido", 21, 1 << 30)).alias("contenido"))


def _scanned(spark, sf_dir):
    return chain.scanned(_pages(spark, sf_dir, scans=True), _images(spark, sf_dir), _tables(spark, sf_dir))


def _document_pages(s, d):
    x = _scanned(s, d)
    return chain.pages(x, "p{}", authors=_manual(s, d))


def _document_articles(s, d):
    x = _scanned(s, d)
    return chain.articles(x, authors=_manual(s, d))


def _media(s, d):
    """A note at a word of each page, one at none, one without an anchor."""
    p = s.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("doc_id"), "html")
    word = F.translate(F.substring(F.regexp_extract("html", r"<p>([^<&]{30,})", 1), 5, 20), "aeiou", "AEIOU")
    m = p.select("doc_id", F.inline(F.array(*[F.struct(F.lit(n).alias("no"), a.alias("anchor"), F.concat(F.lit(f"<i>{n}"), F.col("doc_id").cast("string"), F.lit("</i>")).alias("html")) for n, a in ((1, word), (2, F.lit("no está")), (3, F.lit(None).cast("string")), (4, word))])))
    return render.insert_media(p, m, heading="Tablas")


def queries() -> dict:
    long = lambda c: F.col(c).cast("long").alias(c)
    text_of = lambda s, d: layout.text_blocks(_pages(s, d))
    return {
        "layout_blocks": lambda s, d: layout.raw_blocks(_pages(s, d)).select("doc_id", long("seq"), "contenido", "size", "bold", "italic", "font", "imagen", "clasificacion", "pnum"),
        "pdf_figures": lambda s, d: layout.figures(_images(s, d), text_of(s, d)).select("doc_id", long("fig_no"), "path", "pie", "pagina", "origen"),
        "pdf_tables": lambda s, d: layout.tables(_tables(s, d), text_of(s, d)).select("doc_id", long("tab_no"), F.array_join(F.transform("grid", lambda r: F.array_join(r, "|")), "/").alias("grid"), "titulo", "pagina"),
        "table_diagnosis": lambda s, d: layout.table_diagnosis(s.read.parquet(f"{d}/documents.parquet"), layout.tables(_tables(s, d), text_of(s, d)).where("doc_id % 2 = 0"), _pages(s, d).where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "extract").otherwise("find").alias("kind"), (F.col("pnum") * 6 + F.col("block_no")).alias("seq"), F.concat(F.lit("p"), F.col("pnum").cast("string"), F.lit("b"), F.col("block_no").cast("string")).alias("message"))),
        "detected_tables": lambda s, d: layout.with_detected(_customers(s, d).select((F.col("c_custkey") % 50).alias("doc_id"), F.col("c_custkey").alias("tab_no"), F.col("c_name").alias("titulo"), F.when(F.col("c_custkey") % 3 == 0, "auto_pdf").alias("origen")),
                                                      _customers(s, d).where("c_custkey % 7 = 0").select((F.col("c_custkey") % 50).alias("doc_id"), F.col("c_custkey").alias("tab_no"), F.lit("nueva").alias("titulo"), F.lit("auto_pdf").alias("origen"))).select("doc_id", long("tab_no"), "titulo", "origen"),
        "top_labels": lambda s, d: B.top_labels(_label(s, d)).select("doc_id", long("rank"), "clasificacion", "n"),
        "summary": lambda s, d: B.summary(_label(s, d), authors=_manual(s, d)),
        "label_filter": lambda s, d: B.with_label(_label(s, d), P.SECCION).select("doc_id", "seq"),
        "search_offsets": lambda s, d: blocks(s, d).select("doc_id", "seq", F.inline(T.occurrences(F.col("contenido"), "ÁNA"))),
        "abstract_style": lambda s, d: render.styled(_label(s, d)).where(F.col("clasificacion").isin(P.SECCION, P.SUB, P.CLAVE)).select("doc_id", "seq", "gris", "primero", F.when(F.col("clasificacion") == P.SECCION, render.heading_style(T.escape(F.col("contenido")), F.col("gris"))).alias("style")),
        "rejoined": lambda s, d: _fused(s, d).where("kind = 2").select("doc_id", "seq", F.array_join(render.rejoined(F.col("contenido")), "\n\n").alias("contenido")),
        "notes_before_references": lambda s, d: render.notes_before_references(_label(s, d)).select("doc_id", "seq"),
        "after_references": lambda s, d: render.after_references(render.notes_before_references(_label(s, d))),
        "block_authors": lambda s, d: people.authors_of_blocks(_label(s, d).withColumn("clasificacion", F.when(F.col("contenido").startswith("Ana"), P.AUTORES))).select("doc_id", long("ord"), "nombre"),
        "listed_authors": lambda s, d: people.listed_authors(_manual(s, d)),
        "appended_authors": lambda s, d: people.append_authors(_manual(s, d), _manual(s, d).where("doc_id % 8 = 0")).select("doc_id", long("ord"), T.orcid_as_given(F.col("orcid")).alias("orcid")),
        "author_links": _links,
        "author_line": lambda s, d: _customers(s, d).select("c_custkey", F.regexp_replace(people.author_line(F.array(F.struct(F.col("c_name").alias("nombre"), F.when(F.col("k") % 2 == 0, "0000-0001-2345-6789").otherwise("").alias("orcid")), F.struct(F.lit(" ").alias("nombre"), F.lit("x").alias("orcid")), F.struct(F.concat(F.lit("Luz & "), "n").alias("nombre"), F.lit("").alias("orcid")))), 'src="[^"]*"', "src").alias("html")),
        "block_affiliations": lambda s, d: people.affiliations_of_blocks(_label(s, d)).select("doc_id", long("ord"), "aff_id", "label", "text"),
        "block_emails": lambda s, d: people.emails_of_blocks(_label(s, d)).select("doc_id", long("ord"), "email"),
        "affiliation_lines": lambda s, d: people.affiliation_lines(_texts(s, d), "doc_id").select("doc_id", "line", "part", "aff_id", "label", "text", "email"),
        "affiliations_html": lambda s, d: _texts(s, d).select("doc_id", people.affiliations_html(F.col("text")).alias("html")),
        "jats_body": lambda s, d: render.body_xml(splits.route(_label(s, d))),
        "jats_affiliations": lambda s, d: render.affiliations_xml(people.affiliation_lines(_texts(s, d), "doc_id").where("email is null")),
        "jats_contributors": lambda s, d: render.contributors(people.listed_authors(_manual(s, d)), _manual(s, d).where("doc_id % 8 = 0").select("doc_id", F.concat(F.lit("aff"), "ord").alias("aff_id"), F.col("ord").cast("string").alias("label")), _manual(s, d).where("doc_id % 8 = 0").select("doc_id", F.lit("e").alias("email"))),
        "keyword_groups": lambda s, d: _label(s, d).where(F.col("clasificacion") == P.CLAVE).select("doc_id", "seq", render.kwd_group(T.keywords(F.col("contenido")), "es", "Palabras clave").alias("xml")),
        "media_at_anchors": lambda s, d: _media(s, d).select("doc_id", F.md5(F.col("html").cast("binary")).alias("html_md5")),
        "table_and_figure_html": lambda s, d: _grid(s, d).select("n_regionkey", render.table_html(F.col("n_regionkey"), F.when(F.col("n_regionkey") % 2 == 0, "a<b"), F.array(F.array(F.lit("h")), F.array(F.lit("c")))).alias("tabla"), render.figure_html(F.col("n_regionkey"), F.when(F.col("n_regionkey") % 2 == 0, "a<b").otherwise(""), F.lit(None).cast("string")).alias("figura")),
        "small_values": lambda s, d: _customers(s, d).select(
            "c_custkey", T.figure_caption(F.concat(F.element_at(F.array(*map(F.lit, ("Figura 2a - c): ", "FIG 3. - ", "Figure 4", "Figs. 5 "))), (F.col("k") % 4 + 1).cast("int")), "c_name")).alias("caption"),
            T.table_title(F.concat(F.element_at(F.array(*map(F.lit, ("Tabla 2b. ", "TABLE3: ", "Tablas 4 "))), (F.col("k") % 3 + 1).cast("int")), "c_name")).alias("title"),
            T.doi(F.concat(F.when(F.col("k") % 3 == 0, "ver https://doi.org/10.1/").when(F.col("k") % 3 == 1, "10.12345/").otherwise("10.1/"), "n", F.lit(".),; fin"))).alias("doi"),
            T.issn(F.concat(F.lit("ISSN 2007-518"), F.when(F.col("k") % 2 == 0, "x").otherwise("99"))).alias("issn"),
            T.orcid(F.concat(F.lit("a 0000-0001-2345-67"), F.when(F.col("k") % 2 == 0, "8x").otherwise("-"))).alias("orcid"), T.orcid_search(F.concat("c_name", F.lit("  de  "), "n")).alias("search"),
            T.safe_name(F.concat(F.lit("/a.b/"), F.element_at(F.array(*map(F.lit, ("__Ñandú  2.", ".pdf", "un archivo muy largo con nombre."))), (F.col("k") % 3 + 1).cast("int")), F.lit("pdf"))).alias("safe"),
            T.anchor_text(F.concat(F.lit("uno pa-\n labra­  "), "c_name"), 24).alias("anchor"), render.elocation(F.concat(F.lit("10.1/x."), "n")).alias("elocation"),
            F.regexp_extract(F.concat("n", F.lit(", 6 de abril")), r"^\d*", 0).alias("iso_year"), T.is_period(F.concat(F.element_at(F.array(*map(F.lit, ("Enero - abril 2020", "enero2020", "MAYO de ", "mar. 2020"))), (F.col("k") % 4 + 1).cast("int")), "n")).alias("period"),
            T.clean(F.concat(F.lit(" a­￼\n "), "c_name")).alias("clean"), T.autolink(T.escape(F.concat(F.lit("<"), "n", F.lit("@a-b.org> y c@d")))).alias("link"),
            F.array_join(T.paragraphs(F.concat(F.lit("uno\n\n\n§SUB§ 1.1 "), "c_name", F.lit("\n\n \n\ndos\ntres"))), "|").alias("paragraphs"), F.md5(T.data_uri(F.concat("c_name", F.element_at(F.array(*map(F.lit, (".PNG", ".jpeg", ".tiff"))), (F.col("k") % 3 + 1).cast("int"))), F.col("c_name").cast("binary")).cast("binary")).alias("uri_md5")),
        "issue_numbers": lambda s, d: _customers(s, d).select("c_custkey", C.issue_numbers(F.array(F.lit("ISSN 2007-5189, 1999"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("Vol. "), "n")).otherwise(F.concat(F.lit("núm. "), "n")), F.when(F.col("k") % 3 == 0, F.lit("Volumen 13, núm. 2, 2024, p. 45–67")).otherwise("p. 5")), F.lit("10.1/j.2001.5")).alias("x")).select("c_custkey", "x.*"),
        "split_blocks": lambda s, d: splits.renumbered(splits.split_embedded(B.drop_table_rows(B.label(_embedded(s, d))))).select("doc_id", long("seq"), "clasificacion", "contenido"),
        "split_fused": lambda s, d: chain.paragraphs(_embedded(s, d)).select("doc_id", "kind", long("seq"), "clasificacion", "contenido"),
        "edit_log": lambda s, d: splits.edited(_label(s, d), _log(s, d), blocks(s, d).where("seq % 11 = 3")).select("doc_id", long("seq"), "clasificacion", "contenido"),
        "compatible_folds": lambda s, d: _folded_signs(s, d).select("doc_id", "seq", T.norm(F.col("contenido")).alias("folded")),
        "search_decomposed": lambda s, d: blocks(s, d).select("doc_id", "seq", F.inline(T.occurrences(F.replace("contenido", F.lit("a"), F.lit("a\u0301")), "ÁNA"))),
        "document_paragraphs": lambda s, d: _scanned(s, d).paragraphs.select("doc_id", "kind", long("seq"), "clasificacion", "contenido"),
        "document_pages": _document_pages,
        "document_articles": _document_articles,
        "html_pages": _html,
        "jats_articles": _jats,
        "epub_parts": lambda s, d: render.epub_parts(_html(s, d, book=True), authors=_manual(s, d)),
        "book_texts": lambda s, d: render.epub_parts(_html(s, d, book=True), authors=_manual(s, d)).withColumns({n: F.array_join(n, "|") for n in ("sections", "authors")}),
    }


#: In SQL: headings that run on inside blocks, and how blocks are cut there.
_HEADS = [
    "Non-technical Abstract", "Non-Technical Abstract", "Resumen no técnico", "Resumen no Técnico", "Acknowledgments", "Acknowledgements", "Agradecimientos", "Conflicts of interest", "Conflict of interest",
    "Competing interests", "Conflicto de intereses", "Authors'' Contribution", "Contribuciones de los autores", "Contribucción de autores", "Contribucción de Autores", "Contribución de Autores",
]
_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_EMBEDDED = _LABELS.replace("z as (select", """be as (select * replace (case (doc_id + seq) % 7 when 0 then left(contenido, 40) || ' Agradecimientos ' || substring(contenido, 41) when 1 then left(contenido, 40) || ' abstract ' || substring(contenido, 41)
  when 2 then left(contenido, 40) || ' technical Abstract: ' || substring(contenido, 41) when 3 then left(contenido, 40) || ' Tabla 4. Lista de ' || substring(contenido, 41)
  when 4 then left(contenido, 40) || ' Resumen no técnico Conflict of interest ' || substring(contenido, 41) else contenido end as contenido) from b),
z as (select""").replace(" from b),\nst as", " from be),\nst as").replace("contenido, pnum, zone,", "contenido, pnum, size, bold, italic, zone,") + _TABLE_MODE.replace("contenido, pnum,", "contenido, pnum, size, bold, italic,")
_WORDS = r"[^\p{L}\p{N}_]"
_ABSTRACT = rf"(?is)^((?:.*?{_WORDS})??)abstract(?:{_WORDS}|$)"
_TITLE = rf"(?is)^((?:.*?{_WORDS})??)((?:tabla|table)\s+\d+[.:\s][^\n]{{0,200}})"
_SPLIT = f"""
h1 as (select *, case {' '.join(f"when instr(contenido, '{h}') > 1 then '{h}'" for h in _HEADS)} else '' end as head, case when regexp_matches(contenido, '{_ABSTRACT}') then length(regexp_extract(contenido, '{_ABSTRACT}', 1)) + 1 else 0 end as abs0 from kept),
h2 as (select *, case when head = '' and abs0 > 1 and not regexp_matches(lower(substring(contenido, greatest(1, abs0 - 20), least(20, abs0 - 1))), 'technical|técnico') then abs0 else 0 end as abs1 from h1),
h3 as (select *, head = '' and abs1 = 0 and clasificacion = '{P.CUERPO}' and regexp_matches(contenido, '{_TITLE}') as tab from h2),
h4 as (select *, case when tab then length(regexp_extract(contenido, '{_TITLE}', 1)) + 1 else 0 end as tab0, case when tab then regexp_extract(contenido, '{_TITLE}', 2) else '' end as title from h3),
h5 as (select *, case when head <> '' then instr(contenido, head) when abs1 > 0 then abs1 when tab0 > 1 then tab0 else 0 end as cut_at, case when head <> '' then length(head) when abs1 > 0 then 8 else length(title) end as n from h4),
h6 as (select *, {_STRIP("substring(contenido, 1, cut_at - 1)")} as t, {_STRIP("substring(contenido, cut_at + n)")} as after, round_even(size, 0) as s, '' as font from h5),
cut as (
  select doc_id, seq, 0 as sub_seq, case when cut_at <= 1 then contenido else t end as contenido, case when cut_at <= 1 then case when tab0 = 1 then '{P.TABLA}' else clasificacion end when head = '' and abs1 = 0 then clasificacion else {_AUTO} end as clasificacion, pnum, cut_at from h6
  union all select doc_id, seq, 1, case when head <> '' then head when abs1 > 0 then 'Abstract' else {_STRIP("title")} end, case when head = '' and abs1 = 0 then '{P.TABLA}' else '{P.SECCION}' end, pnum, cut_at from h6 where cut_at > 1
  union all select doc_id, seq, 2, after, clasificacion, pnum, cut_at from h6 where cut_at > 1),
parts as (select doc_id, row_number() over (partition by doc_id order by seq, sub_seq) - 1 as seq, contenido, clasificacion, pnum from cut where cut_at <= 1 or contenido <> ''),
"""


def oracle_sql() -> dict[str, str]:
    chained = lambda ctes, body: "with " + ctes.strip().rstrip(",") + " " + body
    lab = lambda body: chained(_LABELS, body)
    wide = "greatest(0, least(x1, ix1) - greatest(x0, ix0)) / greatest(1, least(x1 - x0, ix1 - ix0)) >= 0.15"
    manual = """a as (select doc_id, unnest([1, 2, 3]) as ord from documents where doc_id % 4 = 0),
      m as (select doc_id, ord, [' Ruiz,  Ana ', 'Luz María Paz', ' '][ord] as nombre, ['https://orcid.org/0000-0001-2345-678x', 'ninguno', ''][ord] as orcid from a),"""
    pages = "pg as (select distinct doc_id, pnum from p0),"
    tables = _PAGES + pages + """
      tb as (select *, case when tab_idx = 3 then 400.04 else 300.0 end as iy0, (doc_id + pnum + tab_idx) % 4 = 0 as few from (select doc_id, pnum, unnest([1, 2, 3]) as tab_idx from pg where pnum % 3 = 0)),
      t1 as (select doc_id, pnum, tab_idx, 60.0 as ix0, iy0, 260.0 as ix1, iy0 + 60 as iy1 from (select *, row_number() over (partition by doc_id, pnum, round(iy0, 1) order by tab_idx) as nth from tb) where nth = 1 and not few),
      tt as (select i.doc_id, i.pnum, i.tab_idx, any_value(i.iy0) as iy0, regexp_replace(regexp_replace(coalesce(arg_min(text, (case when i.iy0 - y1 between 0 and 140 then i.iy0 - y1 else y0 - iy1 + 200 end) * 1000 + no), ''),
        '^(tabla|table)\\s*[0-9]+[a-z]?(\\s*-\\s*[a-z])?[.):]?\\s*', '', 'i'), '^[ :\\t-]+|[ :\\t-]+$', '', 'g') as titulo from t1 i left join texts x on x.doc_id = i.doc_id and x.pnum = i.pnum and """ + wide + """
        and (i.iy0 - y1 between 0 and 140 or y0 - iy1 between 0 and 80) and regexp_matches(text, '^(tabla|table)\\s*[0-9]+', 'i') group by i.doc_id, i.pnum, i.tab_idx),
      found as (select doc_id, row_number() over (partition by doc_id order by pnum, iy0, tab_idx) as tab_no, ' a  b ' as g, titulo, pnum + 1 as pagina from tt),"""
    head = """low in ('resumen', 'abstract', 'resumen no técnico', 'non-technical abstract')"""
    esc = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    notes = """select doc_id, seq, clasificacion, contenido from (select *, row_number() over (partition by doc_id, clasificacion, substring(trim(contenido), 1, 80) order by seq) as nth from (
            select *, min(case when clasificacion = 'Encabezado sección' and regexp_matches(contenido, 'referencia|reference', 'i') then seq end) over (partition by doc_id) as ref from lab)
            where clasificacion in ('Cómo citar', 'Fecha manuscrito') and (ref is null or seq <= ref)) where nth = 1"""
    # scans: tables of layout, blocks outside them, labels (images keep theirs), table mode, splits, fusion
    scans = tables.replace(_PAGES, _SCANS)
    scans = scans[: scans.index("tt as (")].strip() + "\nlb as (" + _LAYOUT.format(size="([9.0, 10.0, 12.0, 13.0, 8.5])[cast((doc_id * 7 + pos * 3) % 5 + 1 as integer)]", free="""not exists (select 1 from t1 where t1.doc_id = z0.doc_id and t1.pnum = z0.pnum
              and greatest(0, least(x1, ix1) - greatest(x0, ix0)) * greatest(0, least(y1, iy1) - greatest(y0, iy0)) / greatest(1, (x1 - x0) * (y1 - y0)) >= 0.4) and""").replace("(partition by doc_id, pnum)))\n", "(partition by doc_id, pnum))) z0\n") + "),"
    image = _LABELS[len(_BLOCKS) :].replace(" from b),\nst as", " from lb),\nst as").replace("min(case when ", "min(case when not imagen and ").replace("case when z1 = seq", "case when imagen then given when z1 = seq").replace("z as (select *,", "z as (select * exclude (clasificacion), clasificacion as given,")
    image = image.replace("contenido, pnum, zone,", "contenido, pnum, size, bold, italic, zone,") + _TABLE_MODE.replace("contenido, pnum,", "contenido, pnum, size, bold, italic,")
    return {
        "compatible_folds": chained(_BLOCKS, """select doc_id, seq, lower(trim(regexp_replace(strip_accents(left(contenido, 20)) || ['1⁄2 ', 'km2 ', 'fin... ', chr(4352) || chr(4449) || chr(4520) || ' ', 'DZ ', 'ijTEL'][cast((doc_id + seq) % 6 + 1 as integer)] || strip_accents(substring(replace(contenido, '²', '2'), 21)), '\\s+', ' ', 'g'))) as folded from b"""),
        "search_decomposed": chained(_BLOCKS, """select doc_id, seq, p as at, 1::integer as line, p as "column", 1::integer as end_line, e as end_column from (
            select doc_id, seq, (i - 1 + n - length(replace(left(contenido, i - 1), 'a', '')))::integer as p, (i + 2 + n2 - length(replace(left(contenido, i + 2), 'a', '')))::integer as e from (
            select *, i - 1 as n, i + 2 as n2 from (select doc_id, seq, contenido, unnest(list_filter(range(1, length(contenido) - 1), lambda i: substring(strip_accents(lower(contenido)), i, 3) = 'ana')) as i from b)))"""),
        "document_paragraphs": chained(scans + image + _SPLIT + _FUSE.replace("from kept)", "from parts)").replace("p1 as (", "fp as (").replace("from p1 ", "from fp "), "select doc_id, cast(kind as integer) as kind, seq, clasificacion, contenido from fused"),
        "split_blocks": chained(_EMBEDDED + _SPLIT, "select doc_id, seq, clasificacion, contenido from parts"),
        "split_fused": chained(_EMBEDDED + _SPLIT + _FUSE.replace("from kept)", "from parts)"), "select doc_id, cast(kind as integer) as kind, seq, clasificacion, contenido from fused"),
        "edit_log": lab("""select doc_id, row_number() over (partition by doc_id order by seq) - 1 as seq, clasificacion, contenido from (
            select lab.doc_id, lab.seq, coalesce(l, clasificacion) as clasificacion, coalesce(t, contenido) as contenido from lab left join (
            select doc_id, seq, arg_max(case when version % 2 = 0 then 'Subencabezado' else 'Título principal' end, version) filter ((version + seq) % 3 = 0) as l, arg_max('edición ' || version, version) filter ((version + seq) % 4 <> 1) as t
            from (select doc_id, seq, unnest(range(1, 2 + doc_id % 3)) as version from b where seq % 5 = 0) group by doc_id, seq) e on e.doc_id = lab.doc_id and e.seq = lab.seq where lab.seq % 11 <> 3)"""),
        "rejoined": chained(_LABELS + _TABLE_MODE + _FUSE, r"""select doc_id, seq, case when len(a) = 0 then '' else list_reduce(a, lambda acc, x: case
            when starts_with(x, '§SUB§') or starts_with(string_split(acc, chr(10) || chr(10))[-1], '§SUB§') or regexp_matches(acc, '[.?!:]$') then acc || chr(10) || chr(10) || x
            when regexp_matches(acc, '[‐-—-]\s*$') and regexp_matches(x, '^[a-záéíóúñü]') then regexp_replace(acc, '[‐-—-]\s*$', '') || x else acc || ' ' || x end) end as contenido from (
            select doc_id, seq, list_filter(list_transform(string_split(contenido, chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> '') as a from fused where kind = 2)"""),
        "after_references": lab(f"""select doc_id, concat_ws(chr(10), '<div class="post-referencias">', string_agg(case when clasificacion = 'Cómo citar' then '<p class="como-citar">' || {esc('contenido')} || '</p>' end, chr(10) order by seq),
              case when bool_or(clasificacion = 'Fecha manuscrito') then concat_ws(chr(10), '<div class="fechas-manuscrito"><ul>', string_agg(lines, chr(10) order by seq), string_agg(case when first and doi <> '' then '  <li><a href="' || doi || '" target="_blank">' || {esc('doi')} || '</a></li>' end, chr(10) order by seq), '</ul></div>') end, '</div>') as html from (
            select *, row_number() over (partition by doc_id, doi order by seq) = 1 as first, case when clasificacion = 'Fecha manuscrito' then nullif(array_to_string(list_transform(list_filter(string_split(regexp_replace(rest, '([.!?])\\s+(Manuscrito|Manuscript)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x) <> ''), lambda x: '  <li>' || {esc('trim(x)')} || '</li>'), chr(10)), '') end as lines from (
            select *, case when doi <> '' then regexp_replace(replace(t, doi, ''), '^[ .]+|[ .]+$', '', 'g') else t end as rest from (
            select *, trim(contenido) as t, case when clasificacion = 'Fecha manuscrito' then regexp_extract(trim(contenido), '(https?://doi[.]org/\\S+)', 1) else '' end as doi from ({notes})))) group by doc_id"""),
        "jats_body": f"""select doc_id, string_agg(piece, '' order by seq) || case when bool_or(part = 'heading') then '</sec>' else '' end as xml from (
            select doc_id, seq, part, case when part = 'heading' then case when i > 1 then '</sec>' else '' end || '<sec><title>' || {esc('t')} || '</title>' else case when i = 1 and headed then '<sec><title></title>' else '' end || '<p>' || {esc('t')} || '</p>' end as piece from (
            select r.doc_id, r.seq, r.part, trim(regexp_replace(contenido, '\\s+', ' ', 'g')) as t, row_number() over (partition by r.doc_id order by r.seq) as i, bool_or(r.part = 'heading') over (partition by r.doc_id) as headed
            from ({registry.oracle_sql()['jats_route']}) r join ({chained(_BLOCKS, 'select doc_id, seq, contenido from b')}) c on r.doc_id = c.doc_id and r.seq = c.seq where r.part in ('heading', 'paragraph'))) group by doc_id""",
        "layout_blocks": chained(_PAGES, _LAYOUT.format(size="10.0", free="")),
        "pdf_figures": chained(_PAGES + pages + """
            im as (select *, doc_id + pnum as k, 100.0 + 125.0 * (doc_id % 3) + case when img_idx = 3 then 10.0 else 0.0 end as iy0, case when (doc_id + pnum + img_idx) % 5 = 0 then 31.0 else 200.0 end as w from (select doc_id, pnum, unnest([1, 2, 3]) as img_idx from pg)),
            i1 as (select *, 60.0 as ix0, 60.0 + w as ix1, iy0 + 60 as iy1 from (select *, row_number() over (partition by doc_id, pnum, case when img_idx = 3 then 7 else 5 end, iy0, w order by img_idx) as nth from im where w >= 32) where nth = 1),""",
            """select doc_id, row_number() over (partition by doc_id order by pnum, iy0, img_idx) as fig_no, printf('p%03d_img%02d_01.', pnum + 1, img_idx) || ['png', 'jpg', 'jpg', 'png'][cast(k % 4 + 1 as integer)] as path, pie, pnum + 1 as pagina, 'auto_pdf' as origen from (
            select i.doc_id, i.pnum, img_idx, any_value(k) as k, any_value(iy0) as iy0, regexp_replace(regexp_replace(coalesce(arg_min(text, abs(y0 - iy1) * 1000 + no), ''), '^(figura|fig[.]?|figure)\\s*[0-9]+[a-z]?(\\s*-\\s*[a-z])?[.):]?\\s*', '', 'i'), '^[ :\\t-]+|[ :\\t-]+$', '', 'g') as pie
            from i1 i left join texts x on x.doc_id = i.doc_id and x.pnum = i.pnum and """ + wide + """ and y0 - iy1 between -8 and 180 and regexp_matches(text, '^(figura|fig[.]?|figure|table|tabla)\\s*[0-9]+', 'i') group by i.doc_id, i.pnum, img_idx)"""),
        "pdf_tables": chained(tables, "select doc_id, tab_no, 'a b||/<c>|d|e' as grid, titulo, pagina from found"),
        "table_diagnosis": chained(tables + """f as (select doc_id, 'detectadas ' || count(*) || ' tabla(s) en ' || count(distinct pagina) || ' pagina(s)' as m from found where doc_id % 2 = 0 group by doc_id),
            e as (select doc_id, string_agg('p' || pnum || 'b' || no, ' | ' order by pos) as m from (select *, row_number() over (partition by doc_id order by pos) as nth from p0 where doc_id % 3 = 0) where nth <= 3 group by doc_id),""",
            "select d.doc_id, coalesce(f.m, case when d.doc_id % 9 = 0 then 'se detectaron tablas pero no se pudieron extraer: ' else 'la deteccion fallo: ' end || e.m, 'no se detectaron tablas') as diagnosis from documents d left join f on d.doc_id = f.doc_id left join e on d.doc_id = e.doc_id"),
        "detected_tables": """select doc_id, row_number() over (partition by doc_id order by z, tab_no) as tab_no, titulo, origen from (select c_custkey % 50 as doc_id, 0 as z, c_custkey as tab_no, c_name as titulo, null::varchar as origen from customer where c_custkey % 3 <> 0
            union all select c_custkey % 50, 1, c_custkey, 'nueva', 'auto_pdf' from customer where c_custkey % 7 = 0)""",
        "top_labels": lab("select * from (select doc_id, row_number() over (partition by doc_id order by count(*) desc, min(seq)) as rank, clasificacion, count(*) as n from lab group by doc_id, clasificacion) where rank <= 6"),
        "summary": lab("""select doc_id, any_value(total) as blocks, string_agg(clasificacion || ': ' || n, '  |  ' order by rank) as labels, case when doc_id % 4 = 0 then 3 else 0 end::bigint as authors from (
            select doc_id, row_number() over (partition by doc_id order by count(*) desc, min(seq)) as rank, clasificacion, count(*) as n, sum(count(*)) over (partition by doc_id)::bigint as total from lab group by doc_id, clasificacion) where rank <= 6 group by doc_id"""),
        "label_filter": lab("select doc_id, seq from lab where clasificacion = 'Encabezado sección'"),
        "search_offsets": chained(_BLOCKS, """select doc_id, seq, (i - 1)::integer as at, (len(string_split(left(contenido, i - 1), chr(10))))::integer as line, (length(string_split(left(contenido, i - 1), chr(10))[-1]))::integer as "column",
            (len(string_split(left(contenido, i + 2), chr(10))))::integer as end_line, (length(string_split(left(contenido, i + 2), chr(10))[-1]))::integer as end_column
            from (select doc_id, seq, contenido, unnest(list_filter(range(1, length(contenido) - 1), lambda i: substring(strip_accents(lower(contenido)), i, 3) = 'ana')) as i from b)"""),
        "abstract_style": lab(f"""select doc_id, seq, gris, primero, case when clasificacion = 'Encabezado sección' then case
              when regexp_matches(e, 'issn|volumen\\s+[0-9]|vol[.]\\s*[0-9]|núm[.]\\s*[0-9]|p[.]\\s*[0-9][0-9]|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre|january|february|march|april|june|july|august|september|october|november|december|[(][0-9]{{4}}[)]', 'i') then 'seccion meta'
              when ruled and pale then 'seccion con-linea gris' when ruled then 'seccion con-linea' when pale then 'seccion gris' else 'seccion' end end as style from (
            select *, case when {head} then gris else low = 'keywords' end as pale, low in ('resumen', 'abstract', 'resumen no técnico', 'non-technical abstract', 'referencias', 'references', 'contribuciones de los autores', 'contribución de autores', 'contribucción de autores', 'author contribution',
              'author contributions', 'authors'' contribution', 'agradecimientos', 'acknowledgements', 'acknowledgments', 'conflicto de intereses', 'conflict of interest', 'conflicts of interest', 'competing interests') as ruled from (
            select *, coalesce(last_value(case when opens then nth >= 2 when (clasificacion = 'Encabezado sección' and low not in ('palabras clave', 'keywords')) or clasificacion = 'Subencabezado' then false end ignore nulls) over w, false) as gris,
              clasificacion = 'Subencabezado' and sum(case when clasificacion = 'Subencabezado' then 1 else 0 end) over w = 1 as primero from (
            select *, clasificacion = 'Encabezado sección' and {head} as opens, sum(case when clasificacion = 'Encabezado sección' and {head} then 1 else 0 end) over (partition by doc_id order by seq) as nth from (
            select *, replace(replace(replace(contenido, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as e, lower(trim(replace(replace(replace(contenido, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))) as low from lab))
            window w as (partition by doc_id order by seq rows between unbounded preceding and current row))) where clasificacion in ('Encabezado sección', 'Subencabezado', 'Palabras clave')"""),
        "notes_before_references": lab("""select doc_id, seq from (select *, row_number() over (partition by doc_id, clasificacion, substring(trim(contenido), 1, 80) order by seq) as nth from (
            select *, min(case when clasificacion = 'Encabezado sección' and regexp_matches(contenido, 'referencia|reference', 'i') then seq end) over (partition by doc_id) as ref from lab)
            where clasificacion in ('Cómo citar', 'Fecha manuscrito') and (ref is null or seq <= ref)) where nth = 1"""),
        "block_authors": lab("""select doc_id, row_number() over (partition by doc_id order by seq, i) as ord, nombre from (
            select doc_id, seq, unnest(range(len(a))) as i, unnest(a) as nombre from (select doc_id, seq, list_filter(list_transform(string_split(contenido, ';'), lambda x: trim(regexp_replace(trim(x), '[0-9,*¹²³]+$', ''))), lambda x: x <> '') as a from lab where starts_with(contenido, 'Ana')))"""),
        "listed_authors": chained(manual, "select doc_id, ord, trim(regexp_replace(nombre, '\\s+', ' ', 'g')) as nombre, upper(regexp_extract(orcid, '[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9Xx]', 0)) as orcid from m where trim(nombre) <> ''"),
        "appended_authors": chained(manual, "select doc_id, row_number() over (partition by doc_id order by z, ord) as ord, case when ord = 1 then '0000-0001-2345-678x' else orcid end as orcid from (select doc_id, ord, orcid, 0 as z from m union all select doc_id, ord, orcid, 1 from m where doc_id % 8 = 0)"),
        "author_links": lab("""select a.doc_id, a.ord, 'aff' as ref_type, 'aff' || f.n as rid, f.n::varchar as label from (select doc_id, unnest([1, 2]) as ord from documents where doc_id % 4 = 0) a
            join (select doc_id, row_number() over (partition by doc_id order by seq) as n from lab where clasificacion = 'Filiación' and trim(contenido) <> '') f on a.doc_id = f.doc_id
            union all select doc_id, 1, 'corresp', 'cor1', '' from (select distinct doc_id from lab where doc_id % 4 = 0 and clasificacion = 'Email / Metadatos' and regexp_matches(contenido, '[\\p{L}\\p{N}_.+%-]+@[\\p{L}\\p{N}_.-]+[.][\\p{L}\\p{N}_]{2,}'))"""),
        "author_line": """select c_custkey, case when c_custkey % 2 = 0 then '<a class="orcid-autor" href="https://orcid.org/0000-0001-2345-6789" target="_blank" title="ORCID: 0000-0001-2345-6789">' || c_name || '</a><a class="orcid-icon" href="https://orcid.org/0000-0001-2345-6789" target="_blank" title="ORCID: 0000-0001-2345-6789"><img src alt="ORCID"></a>'
            else '<a class="orcid-autor" href="https://orcid.org/orcid-search/search?searchQuery=' || regexp_replace(c_name, '\\s+', '+', 'g') || '" target="_blank" title="Buscar en ORCID">' || c_name || '</a>' end
            || '; <a class="orcid-autor" href="https://orcid.org/orcid-search/search?searchQuery=Luz+&+' || c_nationkey || '" target="_blank" title="Buscar en ORCID">Luz &amp; ' || c_nationkey || '</a>' as html from customer""",
        "block_affiliations": lab("select doc_id, n as ord, 'aff' || n as aff_id, n::varchar as label, t as text from (select doc_id, trim(regexp_replace(contenido, '\\s+', ' ', 'g')) as t, row_number() over (partition by doc_id order by seq) as n from lab where clasificacion = 'Filiación' and trim(contenido) <> '')"),
        "block_emails": lab("""select doc_id, row_number() over (partition by doc_id order by f, g) as ord, email from (select doc_id, email, min(seq) as f, arg_min(i, seq * 1000 + i) as g from (
            select doc_id, seq, unnest(range(len(a))) as i, unnest(a) as email from (select doc_id, seq, regexp_extract_all(contenido, '[\\p{L}\\p{N}_.+%-]+@[\\p{L}\\p{N}_.-]+[.][\\p{L}\\p{N}_]{2,}') as a from lab where clasificacion = 'Email / Metadatos')) group by doc_id, email)"""),
        "affiliation_lines": """select c_custkey as doc_id, unnest([0, 2, 2, 3, 4, 5]) as line, unnest([0, 0, 1, 0, 0, 0]) as part, unnest(['aff1', 'aff2', 'aff3', 'aff4', null, 'aff5']) as aff_id, unnest(['1', '2', 'b', '4', '4', '5']) as label,
            unnest(['Instituto ' || c_name || ', México', 'Uno, Chile', 'Dos', 'Instituto suelto', '', '* sin correo']) as text, unnest([null, null, null, null, 'ñé.' || c_nationkey || '@ü.org', null]) as email from customer""",
        "affiliations_html": """select c_custkey as doc_id, concat_ws(chr(10), '<p class="filiaciones sin-sangria"><sup>1</sup> Instituto ' || c_name || ', México</p>', '<p class="filiaciones sin-sangria"><sup>2</sup> Uno, Chile</p>', '<p class="filiaciones sin-sangria"><sup>b</sup> Dos</p>',
            '<p class="filiaciones sin-sangria">Instituto suelto</p>', '<p class="email sin-sangria">* <a href="mailto:ñé.' || c_nationkey || '@ü.org">ñé.' || c_nationkey || '@ü.org</a></p>', '<p class="filiaciones sin-sangria">* sin correo</p>') as html from customer""",
        "jats_affiliations": """select c_custkey as doc_id, '<aff id="aff1"><label>1</label><institution content-type="original">Instituto ' || c_name || ', México</institution><country country="MX">Mexico</country></aff><aff id="aff2"><label>2</label><institution content-type="original">Uno, Chile</institution><country country="CL">Chile</country></aff>'
            || '<aff id="aff3"><label>b</label><institution content-type="original">Dos</institution><country></country></aff><aff id="aff4"><label>4</label><institution content-type="original">Instituto suelto</institution><country></country></aff>'
            || '<aff id="aff5"><label>5</label><institution content-type="original">* sin correo</institution><country></country></aff>' as xml from customer""",
        "jats_contributors": """select doc_id, '<contrib-group><contrib contrib-type="author"><contrib-id contrib-id-type="orcid" authenticated="false">https://orcid.org/0000-0001-2345-678X</contrib-id><name><surname>Ruiz</surname><given-names>Ana</given-names></name>'
            || case when doc_id % 8 = 0 then '<xref ref-type="aff" rid="aff1">1</xref><xref ref-type="aff" rid="aff2">2</xref><xref ref-type="aff" rid="aff3">3</xref><xref ref-type="corresp" rid="cor1"></xref>' else '' end || '</contrib><contrib contrib-type="author"><name><surname>Paz</surname><given-names>Luz María</given-names></name>'
            || case when doc_id % 8 = 0 then '<xref ref-type="aff" rid="aff1">1</xref><xref ref-type="aff" rid="aff2">2</xref><xref ref-type="aff" rid="aff3">3</xref>' else '' end || '</contrib></contrib-group>' as xml from documents where doc_id % 4 = 0""",
        "keyword_groups": lab("""select doc_id, seq, '<kwd-group kwd-group-type="author-generated" xml:lang="es"><title>Palabras clave</title>' || string_agg('<kwd>' || replace(replace(replace(kw, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</kwd>', '' order by i) || '</kwd-group>' as xml from (
            select *, row_number() over (partition by doc_id, seq, lower(kw) order by i) as nth from (select doc_id, seq, unnest(a) as kw, unnest(range(len(a))) as i from (
            select doc_id, seq, list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(regexp_replace(contenido, '\\s+', ' ', 'g')), '^(palabras clave|keywords) *[:.]? *', '', 'i'), '[;,]'), lambda x: regexp_replace(x, '^[ .;]+|[ .;]+$', '', 'g')), lambda x: x <> '') as a
            from lab where clasificacion = 'Palabras clave'))) where nth = 1 group by doc_id, seq"""),
        "media_at_anchors": """with p as (select page_id as doc_id, html, substring(regexp_extract(html, '<p>([^<&]{30,})', 1), 5, 20) as w from pages),
            q as (select *, trim(regexp_replace(regexp_replace(w, '-\\s+', '', 'g'), '\\s+', ' ', 'g')) as a from p),
            r as (select *, case when a <> '' then instr(lower(html), lower(a)) else 0 end as h from q),
            s as (select *, case when h > 0 then instr(substring(html, h + length(a)), '</p>') else 0 end as e, greatest(instr(html, '</article>'), 1) as z from r),
            t as (select *, case when e > 0 then h + length(a) + e + 2 + 1 end as spot from s),
            u as (select *, '<i>1' || doc_id || '</i>' || chr(10) as i1, '<i>2' || doc_id || '</i>' || chr(10) as i2, '<i>3' || doc_id || '</i>' || chr(10) as i3, '<i>4' || doc_id || '</i>' || chr(10) as i4,
              chr(10) || '<div class="figuras-finales">' || chr(10) || '<h2 style="text-align:center;font-size:10pt;font-weight:700;margin-bottom:14px;">Tablas</h2>' || chr(10) as o from t)
            select doc_id, md5(case when spot is null then left(html, z - 1) || o || i1 || i2 || i3 || i4 || '</div>' || chr(10) || substring(html, z)
              when spot <= z then left(html, spot - 1) || i1 || i4 || substring(html, spot, z - spot) || o || i2 || i3 || '</div>' || chr(10) || substring(html, z)
              else left(html, z - 1) || o || i2 || i3 || '</div>' || chr(10) || substring(html, z, spot - z) || i1 || i4 || substring(html, spot) end) as html_md5 from u""",
        "table_and_figure_html": """select r_regionkey as n_regionkey, chr(10) || '<div class="tabla-wrapper">' || chr(10) || '<p class="tabla-titulo"><strong>Tabla ' || r_regionkey || '.</strong> ' || case when r_regionkey % 2 = 0 then 'a&lt;b' else 'Tabla ' || r_regionkey end || '</p>' || chr(10)
            || concat_ws(chr(10), '<table class="pm-tabla">', '<thead><tr>', '<th>h</th>', '</tr></thead><tbody>', '<tr>', '<td>c</td>', '</tr>', '</tbody></table>') || chr(10) || '</div>' || chr(10) as tabla,
            '<figure id="fig' || r_regionkey || '" style="margin:18px auto;text-align:center;">' || chr(10) || '  <img src="imagen.jpg" alt="Figura ' || r_regionkey || '" style="max-width:60%;max-height:420px;border:1px solid #bbb;">' || chr(10)
            || '  <figcaption style="font-size:9pt;color:#1a1a1a;margin-top:5px;text-align:left;"><strong>Figura ' || r_regionkey || '.</strong>' || case when r_regionkey % 2 = 0 then ' a&lt;b' else '' end || '</figcaption>' || chr(10) || '</figure>' as figura from region""",
        "small_values": """select c_custkey, regexp_replace(regexp_replace(['Figura 2a - c): ', 'FIG 3. - ', 'Figure 4', 'Figs. 5 '][cast(c_custkey % 4 + 1 as integer)] || c_name, '^(figura|fig[.]?|figure)\\s*[0-9]+[a-z]?(\\s*-\\s*[a-z])?[.):]?\\s*', '', 'i'), '^[ :\\t-]+|[ :\\t-]+$', '', 'g') as caption,
            regexp_replace(regexp_replace(['Tabla 2b. ', 'TABLE3: ', 'Tablas 4 '][cast(c_custkey % 3 + 1 as integer)] || c_name, '^(tabla|table)\\s*[0-9]+[a-z]?(\\s*-\\s*[a-z])?[.):]?\\s*', '', 'i'), '^[ :\\t-]+|[ :\\t-]+$', '', 'g') as title,
            ['10.1/' || c_nationkey, '10.12345/' || c_nationkey, ''][cast(c_custkey % 3 + 1 as integer)] as doi, case when c_custkey % 2 = 0 then '2007-518X' else '' end as issn, case when c_custkey % 2 = 0 then '0000-0001-2345-678X' else '' end as orcid,
            'https://orcid.org/orcid-search/search?searchQuery=' || regexp_replace(c_name || '  de  ' || c_nationkey, '\\s+', '+', 'g') as search, ['and_2', 'pdfpdf', 'un_archivo_muy_largo_con'][cast(c_custkey % 3 + 1 as integer)] as safe,
            trim(right('uno palabra ' || c_name, 24)) as anchor, c_nationkey::varchar as elocation, c_nationkey::varchar as iso_year, [true, true, false, false][cast(c_custkey % 4 + 1 as integer)] as period, 'a ' || c_name as clean,
            '&lt;<a href="mailto:' || c_nationkey || '@a-b.org">' || c_nationkey || '@a-b.org</a>&gt; y c@d' as link, 'uno|1.1 ' || c_name || '|dos' || chr(10) || 'tres' as paragraphs,
            md5('data:' || ['image/png', 'image/jpeg', 'image/jpeg'][cast(c_custkey % 3 + 1 as integer)] || ';base64,' || to_base64(encode(c_name))) as uri_md5 from customer""",
        "issue_numbers": """select c_custkey, case when c_custkey % 3 = 0 then '2024' else '2001' end as year, case when c_custkey % 3 = 0 then '45' else '' end as fpage, case when c_custkey % 3 = 0 then '67' else '' end as lpage,
            case when c_custkey % 3 = 0 then '13' when c_custkey % 2 = 0 then c_nationkey::varchar else '' end as volume, case when c_custkey % 3 = 0 then '2' when c_custkey % 2 = 1 then c_nationkey::varchar else '' end as issue from customer""",
    }
