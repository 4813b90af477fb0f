"""Column helpers on rows written by hand."""

import unicodedata

from pyspark.sql import functions as F

from quire.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_clean_and_norm(spark):
    assert one(spark, " a­ b  c ", T.clean) == "a b c"
    assert one(spark, " Introducción  Ñandú", T.norm) == "introduccion nandu"
    assert one(spark, "São Tomé Åø ﬁn ĳ ². Ệ\u0301x", T.norm) == "sao tome aø fin ij 2. ex"
    assert one(spark, "São ﬁ ²", T.unaccented) == "Sao ﬁ ²"


def test_folds_equal_normal_forms_of_all_code_points(spark):
    every = [chr(i) for i in range(1, 0x110000) if unicodedata.category(chr(i)) not in ("Cs", "Cn")]
    rows = spark.createDataFrame([(every[i : i + 500],) for i in range(0, len(every), 500)], "c array<string>").select(F.explode("c").alias("c"))
    forms = {"n": ("NFKD", lambda x: unicodedata.combining(x) == 0), "d": ("NFD", lambda x: unicodedata.category(x) != "Mn")}
    got = rows.select("c", T._fold(F.col("c"), T._COMPATIBLE).alias("n"), T.unaccented(F.col("c")).alias("d")).collect()
    assert len(got) == len(every)
    for name, (form, keep) in forms.items():
        assert [r.c for r in got if r[name] != "".join(x for x in unicodedata.normalize(form, r.c) if keep(x))] == []


def test_folds_of_whole_texts(spark):
    text = "½ km² de ﬁn… ㎞, 각각 Ǆ  𝐀😀 A\u0301ngel ﷺ"
    plain = "".join(x for x in unicodedata.normalize("NFKD", text) if unicodedata.combining(x) == 0)
    assert one(spark, text, T.norm) == " ".join(plain.split()).lower()
    assert one(spark, "", T.norm) == "" and one(spark, None, T.norm) is None


def test_places_are_those_of_the_text_itself(spark):
    find = lambda text, query: [(x["at"], x["line"], x["column"], x["end_line"], x["end_column"]) for x in one(spark, text, lambda c: T.occurrences(c, query))]
    apart = "a\u0301n\u0303a\u0301"  # letters with marks of their own
    assert find(f"x {apart}\n{apart}.", "aña") == [(2, 1, 2, 1, 8), (9, 2, 0, 2, 6)]
    assert find("İ ana", "ANA") == [(2, 1, 2, 1, 5)]
    assert find("x½² y½²", "½²") == [(1, 1, 1, 1, 3), (5, 1, 5, 1, 7)]  # canonical folds leave these signs
    assert find("나각 가", "가") == [(1, 1, 1, 1, 2), (3, 1, 3, 1, 4)]  # the first letters of a syllable are the syllable
    assert find("각각", "각") == [(0, 1, 0, 1, 1), (1, 1, 1, 1, 2)]
    long = find(("y" * 50 + apart) * 2000, "ÁÑA")
    assert len(long) == 2000 and long[-1] == (1999 * 56 + 50, 1, 1999 * 56 + 50, 1, 2000 * 56)


def test_escape(spark):
    assert one(spark, "a < b & c > \"d\"", T.escape) == "a &lt; b &amp; c &gt; \"d\""


def test_person(spark):
    p = one(spark, "García López, Ana María.", T.person)
    assert (p["surname"], p["given"]) == ("García López", "Ana María")
    p = one(spark, "Ana María Ruiz", T.person)
    assert (p["surname"], p["given"]) == ("Ruiz", "Ana María")
    p = one(spark, "Platón", T.person)
    assert (p["surname"], p["given"]) == ("Platón", "")


def test_dates(spark):
    for text, want in [("Diciembre 5, 2020", ("5", "12", "2020")), ("3 de abril de 1999", ("3", "4", "1999")), ("1/2/2003", ("1", "2", "2003")), ("foo 5, 2020", ("5", "", "2020")), ("Diciembre 20 2025", ("20", "12", "2025")), ("20-12-2025", ("20", "12", "2025")), ("nada", ("", "", ""))]:
        p = one(spark, text, T.date_parts)
        assert (p["day"], p["month"], p["year"]) == want


def test_orcid_country_prefix(spark):
    assert one(spark, "https://orcid.org/0000-0001-2345-678x", T.orcid) == "0000-0001-2345-678X"
    assert tuple(one(spark, "Instituto, Ciudad de México", T.country)) == ("Mexico", "MX")
    assert one(spark, "[12] Autor", T.reference_text) == "Autor"


def test_occurrences_overlap_and_count_lines(spark):
    find = lambda text, query="ÁNA": [tuple(x) for x in one(spark, text, lambda c: T.occurrences(c, query))]
    assert find("Ananas") == [(0, 1, 0, 1, 3), (2, 1, 2, 1, 5)]
    assert find("xx\nÁna anana\n") == [(3, 2, 0, 2, 3), (7, 2, 4, 2, 7), (9, 2, 6, 2, 9)]
    assert find("a.c abc", ".C") == [(1, 1, 1, 1, 3)]
    assert find("") == find("an\na") == find("Ananas", " ") == []
    long = find("x\n" * 5000 + "ana" * 5000)
    assert len(long) == 5000 and long[-1] == (24997, 5001, 14997, 5001, 15000)
