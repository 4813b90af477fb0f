"""From the layout of pages to whole documents."""

import re
from xml.etree import ElementTree

import pytest

from quire.operators import chain
from quire.plans import more

SF = "/root/testdata/sf0.001"
SPAN = "struct<text:string,size:double,flags:int,font:string>"
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
PAGES = f"doc_id long, pnum int, page_w double, page_h double, block_no int, type int, bbox {BOX}, lines array<struct<spans:array<{SPAN}>>>"
IMAGES = f"doc_id long, pnum int, xref int, img_idx int, occ int, ext string, bbox {BOX}, bytes binary"
TABLES = f"doc_id long, pnum int, tab_idx int, bbox {BOX}, grid array<array<string>>"


def page(spark, *rows):
    """Rows: doc_id, page, number, text (None: an image), size, flags, box."""
    return spark.createDataFrame([(d, p, 600.0, 800.0, n, int(t is None), box, None if t is None else [([(line, s, f, "Arial")],) for line in t.split("|")]) for d, p, n, t, s, f, box in rows], PAGES)


@pytest.fixture(scope="module")
def small(spark):
    at = lambda y, h=20.0: (40.0, float(y), 280.0, y + h)
    pages = page(
        spark, (1, 0, 0, "Un <título>", 14.0, 16, at(60)), (1, 0, 1, "1. Introducción", 10.0, 0, at(100)), (1, 0, 2, "El texto que con-|tinúa & sigue", 9.0, 0, at(140)), (1, 0, 3, "en otro bloque.", 9.0, 0, at(180)),
        (1, 0, 4, None, 0.0, 0, at(300, 100.0)), (1, 0, 5, "Figura 1. Un hueso", 9.0, 0, at(410)), (1, 0, 6, "Tabla 1. Medidas", 9.0, 0, at(470)), (1, 0, 7, "celda uno celda dos", 9.0, 0, at(500)),
        (1, 1, 0, "https://doi.org/10.1/x", 9.0, 0, at(50)), (1, 1, 1, "31", 9.0, 0, at(770)), (1, 1, 2, "2. Fin", 10.0, 0, at(160)), (1, 1, 3, "Fin del texto. Agradecimientos A todos.", 9.0, 0, at(200)), (2, 0, 0, "", 9.0, 0, at(60)), (None, 0, 0, "sin documento", 9.0, 0, at(60)))
    images = spark.createDataFrame([(1, 0, 5, 1, 1, "png", at(300, 100.0), b"x"), (1, 0, 5, 1, 2, "png", at(300, 100.0), b"x"), (1, 0, 6, 2, 1, "png", (0.0, 0.0, 20.0, 20.0), b"y")], IMAGES)
    tables = spark.createDataFrame([(1, 0, 1, (40.0, 495.0, 280.0, 530.0), [["a", "b"], ["celda uno", "celda dos"]]), (1, 0, 2, (300.0, 495.0, 400.0, 530.0), [["sola"]])], TABLES)
    return chain.scanned(pages, images, tables)


def test_paragraphs_of_scans(small):
    got = [(r.doc_id, r.clasificacion, r.contenido) for r in small.paragraphs.orderBy("doc_id", "seq").collect()]
    assert got == [
        (1, "Título principal", "Un <título>"), (1, "Subencabezado", "1. Introducción"), (1, "Cuerpo", "El texto que continúa & sigue en otro bloque."), (1, "Imagen", "[IMAGEN 240×100px]"),
        (1, "Pie de figura", "Figura 1. Un hueso"), (1, "Título tabla", "Tabla 1. Medidas"), (1, "Subencabezado", "2. Fin"), (1, "Filiación", "Fin del texto."), (1, "Encabezado sección", "Agradecimientos"), (1, "Cuerpo", "A todos.")]


def test_page_of_scans(small):
    (r,) = chain.pages(small).collect()
    html = r.html
    assert r.doc_id == 1 and html.count("<table") == 1 and html.count("<figure ") == 1
    assert "Un &lt;título&gt;" in html and "El texto que continúa &amp; sigue en otro bloque." in html and "<h2 class=\"seccion con-linea\">Agradecimientos</h2>" in html
    assert "<strong>Tabla 1.</strong> Medidas" in html and "<strong>Figura 1.</strong> Un hueso" in html and 'src="data:image/png;base64,eA=="' in html
    assert html.count("celda uno") == 1 and "doi.org" not in html and "<p>31" not in html  # in the table only; headers are gone


def test_article_of_scans(small):
    (r,) = chain.articles(small).collect()
    root = ElementTree.fromstring(r.jats.encode())
    assert root.findtext(".//article-title") == "Un <título>" and [s.findtext("title") for s in root.findall("./body/sec")][-2:] == ["Tablas", "Figuras"]
    assert root.findtext(".//table-wrap/caption/p") == "Medidas" and root.findtext(".//fig/caption/p") == "Un hueso" and len(root.findall(".//td")) == 2


def test_empty_relations(spark):
    none = chain.scanned(spark.createDataFrame([], PAGES), spark.createDataFrame([], IMAGES), spark.createDataFrame([], TABLES))
    assert none.paragraphs.count() == chain.pages(none).count() == chain.articles(none).count() == 0


def test_blocks_are_dealt_once(spark):
    """Between spans and paragraphs there is one exchange of the blocks; tables' places come beside it."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = more.queries()["document_paragraphs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(re.findall(r"Exchange hashpartitioning\(doc_id#\d+L?, \d+\)", plan)) == 1


def test_every_scanned_document(spark):
    """Whole pages and articles of the smallest tables: each is well-formed and has every table and figure of its document
    once, in order."""
    x = more._scanned(spark, SF)
    count = lambda rows: {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    tables, figures, docs = count(x.tables), count(x.figures), {r.doc_id for r in x.paragraphs.select("doc_id").distinct().collect()}
    html, jats = ({r.doc_id: r[-1] for r in more.queries()[k](spark, SF).collect()} for k in ("document_pages", "document_articles"))
    assert set(html) == set(jats) == docs and tables and figures
    for d in docs:
        want = list(range(1, figures.get(d, 0) + 1))
        assert [int(n) for n in re.findall(r'<figure id="fig(\d+)"', html[d])] == want
        assert len(re.findall("<table ", html[d])) == tables.get(d, 0)
        root = ElementTree.fromstring(jats[d].encode())
        assert [int(f.get("id")[3:]) for f in root.iter("fig")] == want and len(list(root.iter("table-wrap"))) == tables.get(d, 0)
