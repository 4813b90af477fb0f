"""Functions and operators of articles on hand-made inputs."""

import io
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from quire.functions import citation as C
from quire.functions import patterns as P
from quire.functions import text as T
from quire.operators import render, spans, splits
from quire.sources import files


def one(spark, col, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i").select(col(F.col("t"))).collect()]


def test_affiliations(spark):
    got = one(spark, T.affiliations, "1 Instituto de Geología, UNAM", "1 Uno, México. 2 Dos, Chile; b Tres", "Sur y Zapote s/n. Colonia Centro", "", None, "a* Department of X")
    assert [[tuple(a) for a in x] for x in got] == [
        [("1", "Instituto de Geología, UNAM")], [("1", "Uno, México"), ("2", "Dos, Chile"), ("b", "Tres")], [("Sur", "y Zapote s/n. Colonia Centro")], [], [], [("a", "Department of X")]]


def test_references(spark):
    assert one(spark, T.references, "1. A\nb\n2) C\n[3] D", "x\n\ny", "") == [["A\nb", "C", "D"], ["x\n\ny"], []]


def test_editorial(spark):
    assert one(spark, T.editorial, "Material. a & b", "x Sinonimia. y", "DESCRIPCIÓN. z") == ["<strong>Material.</strong> a &amp; b", "x <br><strong>Sinonimia.</strong><br>y", "<strong>DESCRIPCIÓN.</strong> z"]


def test_country(spark):
    got = one(spark, T.country, "UNAM, México.", "X, Honduras .;", "Nowhere", "El Salvador, Chile", "Chile and China", "Poland, Francia", "x, España", "USA")
    assert [tuple(x) for x in got] == [("Mexico", "MX"), ("Honduras", "HN"), ("", ""), ("El Salvador", "SV"), ("Chile", "CL"), ("Francia", "FR"), ("Espana", "ES"), ("United States", "US")]
    assert one(spark, T.country_code, "España", "méxico", "Perú") == ["", "MX", "PE"]


def test_doi_and_captions(spark):
    assert one(spark, T.doi, "see https://doi.org/10.1/a).", "10.1234/b;", "none") == ["10.1/a", "10.1234/b", ""]
    assert one(spark, T.figure_caption, "Figura 2a. Mapa") == ["Mapa"]
    assert one(spark, T.table_title, "Tabla 3: Datos") == ["Datos"]


def test_manuscript_dates(spark):
    got = one(spark, C.manuscript_dates, "Manuscrito recibido: Diciembre 5, 2020 Manuscript accepted: 3 de marzo de 2021. Manuscrito raro: 1/1/2000", "nothing")
    assert [[tuple(d) for d in x] for x in got] == [[("received", "5", "12", "2020"), ("accepted", "3", "3", "2021")], []]


def test_issue_numbers(spark):
    df = spark.createDataFrame([(["ISSN 2007-5189, 1999", "Vol. 5", "Volumen 13, núm. 2, 2024, p. 45–67"], "x.2001"), ([], "10.1/j.2001.5"), (["no. 3"], None)], "n array<string>, d string")
    assert [tuple(r[0]) for r in df.select(C.issue_numbers(F.col("n"), F.col("d"))).collect()] == [("2024", "45", "67", "13", "2"), ("2001", "", "", "", ""), ("", "", "", "", "3")]


def test_initials_and_words_at_accents(spark):
    got = one(spark, C.cited_authors, "Andújar, J. A., . K. L., . M. N. & Ñu, B.", "Uno, A. and Andújar, B.", "")
    assert [[tuple(a) for a in x] for x in got] == [[("Andújar", "J. A, K. L"), ("M. N", ""), ("Ñu", "B")], [("Uno", "A. Andújar, B")], []]
    got = one(spark, C.manuscript_dates, "Manuscrito recibido: s/f Manuscrito revisión: 3 de mayo de 2020")
    assert got == [[]]  # the second note's date is not the first's
    assert one(spark, T.editorial, "Horizonte y localidad. z", "éMaterial. x", "Material.\u00a0Remarks. y") == ["<strong>Horizonte y localidad.</strong> z", "éMaterial. x", "<strong>Material.</strong> <br><strong>Remarks.</strong> y"]


def test_lines_that_begin_with_a_mark_only(spark):
    lines = ["1) instituto de x", "Sur 5 x", "abcd 5 x", "1)"]
    got = one(spark, lambda c: T.affiliations(c, by_mark=True), *lines)
    assert [[tuple(a) for a in x] for x in got] == [[("1", "instituto de x")], [("Sur", "5 x")], [], []]
    assert one(spark, T.affiliations, *lines) == [[], [], [], []]


def test_citations(spark):
    raw = [
        "García, A. B., & López, C. (2001). Un título. Revista de Cosas, 12(3), 45–67. https://doi.org/10.1234/abc.",
        "Ríos, D. (en prensa). Otro. Boletín, 9, e12.", "Sin año. Nada", "Soto, E. (1999). Libro (Eds.). Editorial", None, "",
    ]
    x = C.citations(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")).orderBy("i")
    rows = x.collect()
    assert [tuple(a) for a in rows[0].authors] == [("García", "A. B"), ("López", "C")]
    assert tuple(rows[0])[2:6] == ("journal", "10.1234/abc", "", "2001")
    assert tuple(rows[0])[7:] == ("Un título", "Revista de Cosas", "12", "3", "45", "67", "")
    assert (rows[1].year, rows[1].source, rows[1].volume, rows[1].elocation) == ("en prensa", "Boletín", "9", "e12")
    assert rows[2].year == "" and rows[2].authors == [] and rows[3].source == "Editorial" and rows[5].year == ""
    for r in x.select(F.concat(F.lit("<r>"), C.element_citation(), F.lit("</r>")).alias("x")).where("raw is not null").collect():
        ElementTree.fromstring(r.x)


def test_tables(spark):
    df = spark.createDataFrame([([["a", "b"], [None, None], ["<", None], [""]],), ([],), (None,)], "g array<array<string>>")
    html, jats = zip(*df.select(T.html_table(F.col("g")), T.jats_table(F.col("g"))).collect())
    assert html[0].replace("\n", "") == '<table class="pm-tabla"><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>&lt;</td><td></td></tr><tr><td></td><td></td></tr></tbody></table>'
    assert jats[0] == "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>&lt;</td><td></td></tr></tbody></table>"
    assert html[1] == html[2] == "<p><em>[Tabla vacía]</em></p>" and jats[1] == jats[2]


def test_spans(spark):
    s = lambda t, size=10.0, flags=0, font="Arial": (t, size, flags, font)
    df = spark.createDataFrame([(0, [([s("paleon-")],), ([s("tología "), s("es", 13.0, 16)],), ([s("X")],)]), (1, [([s("a", 9.0, 2, "Times"), s("b", 9.0, 0, "ArialBold")],)]), (2, [])], "i int, lines array<struct<spans:array<struct<text:string,size:double,flags:int,font:string>>>>")
    got = df.orderBy("i").select(spans.block_text().alias("t"), spans.font_info().alias("f")).collect()
    assert [r.t for r in got] == ["paleontología es X", "ab", ""]
    assert [tuple(r.f) for r in got] == [(10.75, True, False, "arial"), (9.0, True, True, "times"), (10.0, False, False, "")]


def blocks(spark, *rows):
    return spark.createDataFrame([(1, i, t, c, 9.0, False, False, "Arial", 0) for i, (t, c) in enumerate(rows)], "doc_id long, seq int, contenido string, clasificacion string, size double, bold boolean, italic boolean, font string, pnum int")


def test_split_embedded(spark):
    x = blocks(spark, ("antes Agradecimientos después", P.CUERPO), ("una Abstract dos", P.CUERPO), ("Non technical abstract x", P.CUERPO), ("ver Tabla 1. Datos\nfin", P.CUERPO), ("Tabla 2. T", P.CUERPO), ("nada", P.NORMAL), ("Agradecimientos", P.CUERPO), ("", P.CUERPO))
    got = [(r.seq, r.sub_seq, r.contenido, r.clasificacion) for r in splits.split_embedded(x).orderBy("seq", "sub_seq").collect()]
    assert [g[2] for g in got if g[0] == 0] == ["antes", "Agradecimientos", "después"] and got[1][3] == P.SECCION
    assert [g[2] for g in got if g[0] == 1] == ["una", "Abstract", "dos"]
    assert [g[2:] for g in got if g[0] == 2] == [("Non technical abstract x", P.CUERPO)]
    assert [g[2:] for g in got if g[0] == 3] == [("ver", P.CUERPO), ("Tabla 1. Datos", P.TABLA), ("fin", P.CUERPO)]
    assert [g[2:] for g in got if g[0] > 3] == [("Tabla 2. T", P.TABLA), ("nada", P.NORMAL), ("Agradecimientos", P.CUERPO), ("", P.CUERPO)]


def test_override_and_without(spark):
    x = blocks(spark, ("a", P.CUERPO), ("b", P.CUERPO))
    e = spark.createDataFrame([(1, 1, None, P.TITULO)], "doc_id long, seq int, contenido string, clasificacion string")
    assert [(r.contenido, r.clasificacion) for r in splits.override(x, e).orderBy("seq").collect()] == [("a", P.CUERPO), ("b", P.TITULO)]
    assert splits.without(x, e, "doc_id", "seq").count() == 1


@pytest.fixture(scope="module")
def article(spark):
    return blocks(
        spark, ("Un título", P.TITULO), ("Volumen 3, enero 2020", P.SECCION), ("Resumen", P.SECCION), ("corto", P.RESUMEN), ("Palabras clave: a; b", P.CLAVE), ("pre", P.CUERPO), ("largo", P.RESUMEN),
        ("1. Uno", P.SUB), ("p1 a@b.org\n\n§SUB§1.1 x", P.CUERPO), ("Cosas", P.SECCION), ("p2 & q", P.NORMAL), ("Referencias", P.SECCION), ("r1", P.REFERENCIA), ("Fig", P.FIGURA), ("r2", P.CUERPO))


def test_route(article):
    assert [r.part for r in splits.route(article).orderBy("seq").collect()] == [None, "front_note", None, "abstract_es", "keywords_es", "paragraph", "paragraph", "heading", "paragraph", None, "paragraph", None, "ref", None, "ref"]


def test_jats(article):
    r = render.jats_documents(splits.route(article)).collect()[0]
    root = ElementTree.fromstring(r.jats.encode())
    assert root.findtext(".//article-title") == "Un título" and root.findtext(".//issn") == "0000-0000"
    assert [p.text for p in root.findall("./body/sec/p")] == ["pre", "largo", "p1 a@b.org 1.1 x", "p2 & q"]
    assert [s.findtext("title") for s in root.findall("./body/sec")] == ["", "1. Uno"]
    assert [x.get("id") for x in root.findall(".//ref")] == ["R1", "R2"] and root.findtext(".//abstract/p") == "corto"


def test_keywords(spark):
    assert one(spark, T.keywords, "Palabras clave: Uno., dos ;; .", "KEYWORDS a, b.c", "", None) == [["Uno", "dos"], ["a", "b.c"], [], None]


def test_jats_has_all_parts(spark):
    x = blocks(
        spark, ("T", P.TITULO), ("Volumen 13, núm. 2, enero - abril 2024, p. 45–67", P.SECCION), ("ISSN 2007-5189", P.SECCION), ("Cite así & ya", P.CITAR), ("Manuscrito recibido: Diciembre 5, 2020.", P.FECHA),
        ("Resumen", P.SECCION), ("c", P.RESUMEN), ("Palabras clave: uno., Uno; <dos>", P.CLAVE), ("Abstract", P.SECCION), ("d", P.RESUMEN), ("Keywords: one", P.CLAVE), ("Cosas", P.SECCION), ("p", P.CUERPO), ("Keywords: all", P.CLAVE),
        ("Referencias", P.SECCION), ("García, A. B. (2001). Un título. Revista, 12(3), 45–67.", P.REFERENCIA), ("Sin año", P.REFERENCIA))
    m = ElementTree.fromstring(render.jats_documents(splits.route(x)).collect()[0].jats.encode())
    meta = m.find("./front/article-meta")
    assert [meta.findtext(p) for p in ("pub-date/year", "volume", "issue", "fpage", "lpage")] == ["2024", "13", "2", "45", "67"]
    assert [[k.text for k in g.findall("kwd")] for g in meta.findall("kwd-group")] == [["uno", "<dos>"], ["one"], ["all"]]
    assert [(d.get("date-type"), d.findtext("day"), d.findtext("month"), d.findtext("year")) for d in meta.findall("history/date")] == [("received", "5", "12", "2020")]
    assert [(c.findtext("meta-name"), c.findtext("meta-value")) for c in meta.iter("custom-meta")] == [("publication-period", "Volumen 13, núm. 2, enero - abril 2024, p. 45–67"), ("how-to-cite", "Cite así & ya")]
    assert [(r.get("id"), r.findtext("element-citation/person-group/name/surname"), r.findtext("element-citation/year")) for r in m.iter("ref")] == [("R1", "García", "2001"), ("R2", None, None)]
    assert [r.findtext("mixed-citation") for r in m.iter("ref")][1] == "Sin año"


def test_html_media_and_epub(spark, article, tmp_path):
    page = render.html_documents(article, "p{}")
    html = page.collect()[0].html
    assert "<h1 class=\"titulo-principal\">Un título</h1>" in html and '<h3 class="subseccion-bajo">1.1 x</h3>' in html and "Fig" not in html
    media = spark.createDataFrame([(1, 1, "P1 A@b", "<i>1</i>"), (1, 2, "p1 a@b", "<i>2</i>"), (1, 3, "absent", "<i>3</i>"), (1, 4, None, "<i>4</i>")], "doc_id long, no int, anchor string, html string")
    got = render.insert_media(page, media).collect()[0].html
    assert 'p1 a@b.org</p><i>1</i>\n<i>2</i>\n' in got and "<i>3</i>\n<i>4</i>\n</article>" in got
    for piece in ("<i>1</i>\n<i>2</i>\n", "<i>3</i>\n<i>4</i>\n"):
        got = got.replace(piece, "", 1)
    assert got == html
    book = render.epub_documents(page, article).collect()[0].epub
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        assert z.namelist()[0] == "mimetype" and z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED and len(z.namelist()) == 6
        for n in z.namelist()[1:-1]:
            ElementTree.fromstring(z.read(n))
    assert render.epub_documents(page, article.where("false")).collect()[0].epub
    files.write_texts(page, "html", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).collect()[0].value.rstrip("\n") == html


def test_lists(spark):
    f = lambda c: render.paragraph_or_list(c)
    got = one(spark, f, "hola", "Son: • uno • dos. Otros son: • tres", "• a", "", "•")
    assert got[0] == '<p class="cuerpo">hola</p>' and got[3] == "" and got[4] == '<p class="cuerpo">•</p>'
    assert got[1].replace("\n", "") == '<p class="cuerpo">Son:</p><ul class="lista-bullets cuerpo-list">  <li>uno</li>  <li>dos.</li></ul><p class="cuerpo">Otros son:</p><ul class="lista-bullets cuerpo-list">  <li>tres</li></ul>'
    assert got[2].count("<ul") == got[2].count("</ul>") == 1


def book(sheets):
    cell = lambda c, r, v: f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{ns}"><sheetData>' + "".join(f'<row r="{r + 1}">' + "".join(cell(c, r, v) for c, v in enumerate(row) if v) + "</row>" for r, row in enumerate(rows)) + "</sheetData></worksheet>")
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(book({"Uno": [["Autor", "ORCID"], ["Ana Ruiz", "https://orcid.org/0000-0001-2345-678X"], ["", ""], ["Luz", "no"]], "Dos": [["x", "", "y"]]}))
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    cells = files.read_workbooks(spark, str(tmp_path / "*.xlsx"))
    assert [tuple(r)[1:] for r in files.authors(cells).orderBy("ord").collect()] == [(1, "Ana Ruiz", "0000-0001-2345-678X"), (2, "Luz", "no")]
    assert [r.grid for r in files.grids(cells).orderBy("sheet_no").collect()][1] == [["x", None, "y"]]
    (tmp_path / "r.txt").write_text("1. Uno\n2. Dos")
    assert [(r.ref_no, r.raw) for r in files.read_references(spark, str(tmp_path / "r.txt")).orderBy("ref_no").collect()] == [(1, "Uno"), (2, "Dos")]
    (tmp_path / "f.txt").write_text("1 Instituto A\n\n2 Uno. 3 Dos\nInstituto sin marca.\n* x@y.org\n")
    got = files.read_affiliations(spark, str(tmp_path / "f.txt")).orderBy("line", "part").collect()
    assert [(r.aff_id, r.label, r.text, r.email) for r in got] == [("aff1", "1", "Instituto A", None), ("aff2", "2", "Uno", None), ("aff3", "3", "Dos", None), ("aff4", "4", "Instituto sin marca.", None), (None, "4", "", "x@y.org")]
    (tmp_path / "i.PNG").write_bytes(b"\x89PNG")
    assert [r[0] for r in files.read_figures(spark, str(tmp_path)).select(T.data_uri(F.col("path"), F.col("content"))).collect()] == ["data:image/png;base64,iVBORw=="]


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark):
    from quire.plans import more

    return {k: {r["doc_id"]: r for r in more.queries()[k](spark, SF).collect()} for k in ("html_pages", "jats_articles", "epub_parts")}


def test_every_page_and_book_is_well_formed(made):
    for i, r in made["epub_parts"].items():
        ElementTree.fromstring(f"<body>{r.body}</body>")
        assert r.css == "p{}" and (r.authors or []) == (["Ruiz,  Ana", "Luz María Paz"] if i % 4 == 0 else [])
    for r in made["html_pages"].values():
        assert r.html.startswith("<!DOCTYPE html>\n<html lang=\"es\">") and r.html.endswith("</article></body></html>") and r.html.count("primer-nivel1") <= 1
        assert ("orcid.org/0000-0001-2345-678x" in r.html or "<h1" not in r.html and "<h2 class=\"titulo" not in r.html) if r.doc_id % 4 == 0 else "Luz María" not in r.html


def test_every_article_is_well_formed(made):
    order = ["article-id", "article-categories", "title-group", "contrib-group", "aff", "author-notes", "pub-date", "volume", "issue", "fpage", "lpage", "elocation-id", "history", "permissions", "abstract", "trans-abstract", "kwd-group", "custom-meta-group"]
    for r in made["jats_articles"].values():
        root = ElementTree.fromstring(r.jats.encode())
        assert [x.tag for x in root] == ["front", "body", "back"]
        at = [order.index(x.tag) for x in root.find("front/article-meta")]
        assert at == sorted(at)
        ids = {x.get("id") for x in root.iter() if x.get("id")}
        assert {x.get("rid") for x in root.iter("xref")} <= ids
        assert all(x[0].tag == "title" for x in root.iter("sec"))


def test_long_articles(spark):
    rows = [(1, i, f"Uno {i}" if i % 50 == 1 else "Material. Texto & más.", P.SUB if i % 50 == 1 else P.CUERPO, 9.0, False, False, "Arial", 0) for i in range(20_000)]
    x = spark.createDataFrame(rows, "doc_id long, seq int, contenido string, clasificacion string, size double, bold boolean, italic boolean, font string, pnum int")
    root = ElementTree.fromstring(render.jats_documents(splits.route(x)).collect()[0].jats.encode())
    assert len(list(root.iter("p"))) == 19_600 and len(root.findall("body/sec")) == 401
    page = render.html_documents(x)
    with zipfile.ZipFile(io.BytesIO(render.epub_documents(page, x).collect()[0].epub)) as z:
        assert len(list(ElementTree.fromstring(z.read("OEBPS/article.xhtml")).iter("{http://www.w3.org/1999/xhtml}strong"))) == 19_600


def test_page_rules(spark):
    x = blocks(
        spark, ("T", P.TITULO), ("T2", P.TITULO2), ("perdido", P.CUERPO), ("Resumen", P.SECCION), ("uno-\n\ndos\n\nTres.\n\ncuatro", P.CUERPO), ("Keywords: a", P.CLAVE), ("Abstract", P.SECCION), ("Keywords", P.SECCION),
        ("Keywords: b", P.CLAVE), ("1. Uno", P.SUB), ("2. Dos", P.SUB), ("• a • b", P.ABSTRACT_BODY), ("1 Instituto, Chile. 2 Dos, Perú", P.FILIACION), ("Ana1; Luz", P.AUTORES), ("cita & así", P.CITAR), ("cita & así", P.CITAR),
        ("Manuscrito recibido: 1/2/2020. Manuscrito aceptado: x. https://doi.org/10.1/x.", P.FECHA), ("Referencias", P.SECCION), ("r1", P.REFERENCIA), ("tarde", P.CITAR))
    html = render.html_documents(x).collect()[0].html
    assert "perdido" not in html and "tarde" not in html and html.count("cita &amp; así") == 1
    assert '<p class="cuerpo">unodos Tres.</p>\n<p class="cuerpo">cuatro</p>' in html
    assert '<h2 class="seccion con-linea">Resumen</h2>' in html and '<h2 class="seccion con-linea gris">Abstract</h2>' in html and '<h2 class="seccion gris">Keywords</h2>' in html
    assert '<p class="keywords sin-sangria"><strong>Keywords:</strong> a</p>' in html and 'font-style:italic;"><strong>Keywords:</strong> b</p>' in html
    assert '<h3 class="subseccion primer-nivel1">1. Uno</h3>\n<h3 class="subseccion">2. Dos</h3>' in html and '<ul class="lista-bullets abstract-list">' in html
    assert '<sup>1</sup> Instituto, Chile</p>\n<p class="filiaciones sin-sangria"><sup>2</sup> Dos, Perú</p>' in html and "Buscar Ana en ORCID" in html
    assert '<li>Manuscrito recibido: 1/2/2020.</li>\n  <li>Manuscrito aceptado: x</li>\n  <li><a href="https://doi.org/10.1/x." target="_blank">' in html
    people = spark.createDataFrame([(1, 1, "Ana & Co", "0000-0001-2345-6789")], "doc_id long, ord int, nombre string, orcid string")
    refs = spark.createDataFrame([(1, 2, "dos"), (1, 1, "<uno>")], "doc_id long, ref_no int, raw string")
    html = render.html_documents(x, "", people, spark.createDataFrame([(1, "* a@b.org")], "doc_id long, text string"), refs).collect()[0].html
    assert "Buscar Ana" not in html and "r1" not in html and '<ol class="referencias">\n  <li>&lt;uno&gt;</li>\n  <li>dos</li>\n</ol>' in html
    assert html.index("T2") < html.index("Ana &amp; Co") < html.index("mailto:a@b.org") < html.index("Resumen")


def test_article_rules(spark):
    x = blocks(spark, ("Título", P.TITULO), ("Title", P.TITULO2), ("Ana Ruiz1; Paz, Luz", P.AUTORES), ("Instituto, Chile", P.FILIACION), ("a@b.org a@b.org c@d.org", P.EMAIL), ("Mi Revista", P.SECCION), ("https://doi.org/10.1/x.2019.77", P.FECHA), ("p", P.CUERPO), ("Referencias", P.SECCION), ("[1] Sin", P.REFERENCIA))
    routed = splits.route(x, "mi revista")
    assert routed.where("contenido = 'Mi Revista'").first().part == "front_note"
    tables = spark.createDataFrame([(1, 4, "", [["a", "b"], ["c"]])], "doc_id long, tab_no int, titulo string, grid array<array<string>>")
    figures = spark.createDataFrame([(1, 2, "Pie", "x/y.png")], "doc_id long, fig_no int, pie string, path string")
    root = ElementTree.fromstring(render.jats_documents(routed, render.Publication(title="R & S"), tables=tables, figures=figures).collect()[0].jats.encode())
    m = root.find("front/article-meta")
    assert [(c.findtext("name/surname"), c.findtext("name/given-names"), [r.get("rid") for r in c.findall("xref")]) for c in m.iter("contrib")] == [("Ruiz", "Ana", ["aff1", "cor1"]), ("Paz", "Luz", ["aff1"])]
    assert m.findtext("aff/country") == "Chile" and [e.text for e in m.iter("email")] == ["a@b.org", "c@d.org"] and m.findtext("title-group/trans-title-group/trans-title") == "Title"
    assert m.findtext("pub-date/year") == "2019" and m.findtext("elocation-id") == "77" and m.findtext("permissions/copyright-holder") == "R & S"
    assert root.findtext("body/sec[@sec-type='tables']/table-wrap/caption/p") == "Tabla 1" and root.findtext("body/sec[@sec-type='figures']/fig/caption/p") == "Pie"
    assert [r.text for r in root.iter("mixed-citation")] == ["Sin", "Sin"]
    given = spark.createDataFrame([(1, "1 Uno, Perú\n* z@z.org")], "doc_id long, text string")
    root = ElementTree.fromstring(render.pretty_xml(render.jats_documents(routed, affiliation_texts=given)).collect()[0].jats.encode())
    assert [a.findtext("institution") for a in root.iter("aff")] == ["Uno, Perú"] and [e.text for e in root.iter("email")] == ["z@z.org"]


def test_fused_blocks_keep_the_look_of_the_first(spark):
    from quire.operators import blocks as B

    rows = [(1, 0, "uno", P.CUERPO, 8.0, True, False, "Arial", 3), (1, 1, "dos", P.CUERPO, 9.0, False, True, "Times", 4)]
    x = spark.createDataFrame(rows, "doc_id long, seq int, contenido string, clasificacion string, size double, bold boolean, italic boolean, font string, pnum int")
    assert [tuple(r) for r in B.fuse(x).collect()] == [(1, 0, 2, 0, P.CUERPO, "uno dos", 8.0, True, False, "Arial", 3)]


def test_images_are_passed_over(spark):
    from quire.operators import blocks as B

    rows = [(1, 0, "1. Imagen", 0.0, False, False, None, 0, True, P.IMAGEN), (1, 1, "1. Uno", 9.0, False, False, "Arial-BoldItalic", 0, False, None), (1, 2, "Título", 14.0, False, False, "Arial-Bold", 0, False, None), (1, 3, "[x]", 0.0, False, False, None, 0, True, P.IGNORAR)]
    x = spark.createDataFrame(rows, "doc_id long, seq int, contenido string, size double, bold boolean, italic boolean, font string, pnum int, imagen boolean, clasificacion string")
    assert [(r.zone, r.clasificacion) for r in B.label(x).orderBy("seq").collect()] == [("A", P.IMAGEN), ("B", P.SUB), ("B", P.CUERPO), ("B", P.IGNORAR)]
    assert [r[0] for r in x.where("seq = 2").select(B.auto_label()).collect()] == [P.TITULO]


def test_sheets_and_grids(spark):
    cells = spark.createDataFrame([("f", 0, "A", False, 0, 0, "x"), ("f", 0, "A", False, 3, 2, "y"), ("f", 1, "B", True, 0, 0, "z"), ("f", 1, "B", True, 1_048_575, 16_383, "far")], files.CELLS)
    assert sorted((r.sheet, r.active) for r in files.sheets(cells).collect()) == [("A", False), ("B", True)]
    d = spark.createDataFrame([("f", "A"), ("f", "no"), ("g", "A")], "path string, hoja string")
    got = {(r.path, r.hoja): r.grid for r in files.chosen_grids(d, cells.where("r < 9")).collect()}
    assert got == {("f", "A"): [["x", None, None], [], [], [None, None, "y"]], ("f", "no"): [["z"]], ("g", "A"): None}
    assert files.grids(cells).where("sheet = 'B'").selectExpr("size(grid)", "size(grid[1048575])").first() == (1_048_576, 16_384)


def test_manual_authors(spark):
    from quire.operators import people

    got = people.manual_authors(spark, [(1, " Ana ", "https://orcid.org/0000-0001-2345-678x"), (1, None, "nada")])
    assert [tuple(r) for r in got.orderBy("ord").collect()] == [(1, 1, "Ana", "0000-0001-2345-678x"), (1, 2, "", "nada")]


def test_illustrated(spark):
    page = spark.createDataFrame([(1, "<article><p>uno dos</p><p>tres</p></article>")], "doc_id long, html string")
    tables = spark.createDataFrame([(1, 1, "T", "UNO dos", [["a"]]), (1, 2, "", "", [["b"]])], "doc_id long, tab_no int, titulo string, ancla string, grid array<array<string>>")
    figures = spark.createDataFrame([(1, 1, "F", "tres", None), (1, 2, "", "nada", "data:x")], "doc_id long, fig_no int, pie string, ancla string, source string")
    html = render.illustrated(page, tables, figures).collect()[0].html
    order = [html.index(x) for x in ("uno dos", "Tabla 1.", "tres</p>", 'id="fig1"', ">Tablas</h2>", "Tabla 2.", 'id="fig2"', "</article>")]
    assert order == sorted(order) and 'src="imagen.jpg"' in html and 'src="data:x"' in html


def test_journal_heading(spark):
    x = blocks(spark, ("Mi Revista", P.SECCION), ("Otra", P.SECCION))
    html = render.html_documents(x, journal="mi revista").collect()[0].html
    assert '<h2 class="seccion meta">Mi Revista</h2>' in html and '<h2 class="seccion">Otra</h2>' in html
