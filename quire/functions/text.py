"""Column helpers for text, all inside Catalyst."""

from __future__ import annotations

import re
import sys
import unicodedata
from typing import NamedTuple

from pyspark.sql import functions as F

from quire.functions import patterns as P


#: Between several letters in a list of them.
_GAP = "\u0001"


class _Folds(NamedTuple):
    """A normal form less its marks: letters for one (`one`, `base`), marks, which have none, and signs that are several
    letters (`signs`, `letters`)."""

    one: str
    base: str
    marks: str
    signs: str
    letters: str


def _folding(form: str) -> _Folds:
    """The folds of all code points by their decompositions; Hangul syllables are left to _syllable()."""
    is_mark = (lambda x: unicodedata.combining(x) != 0) if form == "NFKD" else (lambda x: unicodedata.category(x) == "Mn")
    one, marks, signs = {}, [], {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if unicodedata.category(c) in ("Cs", "Cn") or "가" <= c <= "힣":
            continue
        plain = "".join(x for x in unicodedata.normalize(form, c) if not is_mark(x))
        if plain == "":
            marks.append(c)
        elif len(plain) == 1 and plain != c:
            one[c] = plain
        elif len(plain) > 1:
            signs[c] = plain
    return _Folds("".join(one), "".join(one.values()), "".join(marks), "".join(signs), _GAP.join(signs.values()))


_COMPATIBLE, _CANONICAL = _folding("NFKD"), _folding("NFD")
_SYLLABLES = "".join(map(chr, range(0xAC00, 0xD7A4)))
# fixed values: the letters of Hangul syllables: first, second, last
_FIRST, _SECOND, _LAST = ("".join(map(chr, range(a, b))) for a, b in ((0x1100, 0x1113), (0x1161, 0x1176), (0x11A8, 0x11C3)))


def let(value, use):
    """use(value), with the value evaluated once, however often use asks for it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def apart(value):
    """The value as it is, in a projection that Spark compiles as several small methods. Within a whole stage a projection of
    many conditions is one method, and the JVM only interprets methods of more than 8,000 bytes."""
    return let(value, lambda v: v)


def has(col, pattern: str, fold: bool = True):
    """Whether a pattern is found; white space, digits and words in it are those of any script."""
    return col.rlike(("(?iU)" if fold else "(?U)") + pattern)


#: White space of any script, as `(?U)\\s` has it.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(col):
    """Without white space around it; looks at the ends only, where a pattern would be tried at every letter."""
    return F.trim(col, F.lit(SPACE))


def squeeze(col):
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def clean(col):
    """Without soft hyphens and object marks, white space squeezed."""
    return squeeze(F.regexp_replace(col, "[­￼￾]", ""))


def has_clean(col):
    """Whether clean() leaves anything; found at the first such letter. To ask clean() itself would evaluate it once more, as
    conditions are pushed below the columns that they ask for."""
    return col.rlike("(?U)[^\\s­￼￾]")


def _syllable(c):
    """The two or three letters of a Hangul syllable, which follow from its place."""
    at = F.ascii(c) - 0xAC00
    pick = lambda letters, i: F.substring(F.lit(letters), i.cast("int") + 1, F.lit(1))
    return F.concat(pick(_FIRST, F.floor(at / 588)), pick(_SECOND, F.floor(at % 588 / 28)), F.when(at % 28 > 0, pick(_LAST, at % 28 - 1)).otherwise(""))


def _letters(c, folds: _Folds):
    """What one character folds to, if it is several letters, else itself."""
    of = lambda i: F.when(i > 0, F.element_at(F.split(F.lit(folds.letters), _GAP), i)).when(c.between("가", "힣"), _syllable(c)).otherwise(c)
    return let(F.instr(F.lit(folds.signs), c), of)


def _holds(col, characters: str):
    """Whether a text holds one of the characters, of which there may be thousands."""
    return F.translate(col, characters, "") != col


def _rare(characters: str) -> str:
    """A pattern that finds each of the characters, and others of scripts that are seldom met: what is none of the ranges
    of common characters between them."""
    held, common = set(map(ord, characters)), []
    for lo, hi in ((0x0000, 0x036F), (0x2010, 0x2027)):
        for c in range(lo, hi + 1):
            if c not in held:
                if common and common[-1][1] == c - 1:
                    common[-1][1] = c
                else:
                    common.append([c, c])
    return "[^" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in common) + "]"


def _fold(col, folds: _Folds):
    """ASCII stays as it is. Texts without signs of several letters need one translation only; in others each such sign is
    replaced first. Translations look each character up, so a pattern says first which texts need one."""
    return F.when(~col.rlike(r"[^\x00-\x7F]"), col).otherwise(_folded(col, folds))


def _folded(col, folds: _Folds):
    rare = F.filter(F.array_distinct(F.split(col, "")), lambda c: (F.instr(F.lit(folds.signs), c) > 0) | c.between("가", "힣"))
    wide = F.aggregate(rare, col, lambda acc, c: F.replace(acc, c, _letters(c, folds)))
    some = folds.signs + _SYLLABLES
    return F.translate(F.when(col.rlike(_rare(some)) & _holds(col, some), wide).otherwise(col), folds.one + folds.marks, folds.base)


def norm(col):
    """Lower case, squeezed, in compatible decomposition (NFKD) without marks: signs of several letters become these."""
    return F.lower(squeeze(_fold(col, _COMPATIBLE)))


def unaccented(col):
    """Without accents: canonical decompositions (NFD) less their marks."""
    return _fold(col, _CANONICAL)


def found_in(col, query: str):
    """Whether a text holds the query, whatever its case and accents; nothing holds an empty one."""
    q = query.strip()
    return F.contains(unaccented(F.lower(col)), unaccented(F.lower(F.lit(q)))) if q else F.lit(False)


def occurrences(col, query: str):
    """array<struct(at, line, column, end_line, end_column)>: all places of the query, overlapping ones too, whatever case
    and accents; at from 0, lines from 1, columns from 0. Places are those of the text as it is: where letters have marks
    of their own or are several, found places are mapped back, and one ends with its last letter's marks."""
    q = query.strip()
    empty = F.array().cast("array<struct<at:int,line:int,column:int,end_line:int,end_column:int>>")
    if not q:
        return F.when(F.lit(False), empty).otherwise(empty)
    want = unaccented(F.lower(F.lit(q)))
    n = F.length(want)
    # a cut before each place: places are what the pieces before them measure; so are the beginnings of lines
    cut = lambda low: F.split(low, F.concat(F.lit("(?=\\Q"), want, F.lit("\\E)")))
    ends = lambda pieces, more: F.aggregate(pieces, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x) + more)), lambda acc: F.slice(acc, 1, F.size(pieces)))
    at = lambda low: let(cut(low), lambda pieces: F.filter(ends(pieces, 0), lambda x, i: (i > 0) | low.startswith(want)))
    row = lambda lines, i: F.filter(lines, lambda x: x <= i)
    place = lambda s, a, b: F.struct(s["a"].alias("at"), F.size(a).alias("line"), (s["a"] - F.element_at(a, -1)).alias("column"), F.size(b).alias("end_line"), (s["b"] - F.element_at(b, -1)).alias("end_column"))
    one = lambda lines, s: let(F.struct(row(lines, s["a"]).alias("a"), row(lines, s["b"]).alias("b")), lambda r: place(s, r["a"], r["b"]))
    # for each letter of the folded text the place of the character it came from
    source = F.flatten(F.transform(F.split(col, ""), lambda c, k: F.array_repeat(k, F.length(unaccented(F.lower(c))))))
    end = lambda last, after: F.when(after > last, after).otherwise(last + 1)
    mapped = lambda hits: let(source, lambda src: F.array_distinct(F.transform(hits, lambda i: F.struct(F.get(src, i).alias("a"), end(F.get(src, i + n - 1), F.coalesce(F.get(src, i + n), F.length(col))).alias("b")))))
    plain = lambda hits: F.transform(hits, lambda i: F.struct(i.alias("a"), (i + n).alias("b")))
    spans = let(let(unaccented(F.lower(col)), at), lambda hits: F.when(_holds(col, "İ" + _CANONICAL.marks + _CANONICAL.signs + _SYLLABLES), mapped(hits)).otherwise(plain(hits)))
    found = let(ends(F.split(col, "\n"), 1), lambda lines: F.transform(spans, lambda s: one(lines, s)))
    return F.when(found_in(col, query) & (want != ""), found).otherwise(empty)


def keywords(col):
    """The keywords of a line, without its label, blanks, dots and semicolons around them, and empty ones."""
    t = F.regexp_replace(clean(col), r"(?iu)^(palabras\s+clave|keywords)\s*[:.]?\s*", "")
    return F.filter(F.transform(F.split(t, "[;,]"), lambda x: F.regexp_replace(x, r"^[ .;]+|[ .;]+$", "")), lambda x: x != "")


def distinct_keywords(words):
    """Of keywords that differ in case only the first spelling, in order."""
    lower = F.transform(words, F.lower)
    return F.filter(words, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def emails(col, pattern: str = P.EMAIL_ANY):
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))


def escape(col):
    return F.replace(F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def reference_text(col):
    return F.regexp_replace(col, P.REF_PREFIX, "")


def orcid(col):
    """The identifier in upper case, '' if there is none."""
    return F.upper(F.regexp_extract(col, "(?i)" + P.ORCID, 0))


def orcid_as_given(col, fold: bool = True):
    """The identifier as written, in lists by hand in any case; what has none stays as it is."""
    found = F.regexp_extract(strip(col), ("(?i)" if fold else "") + P.ORCID, 0)
    return F.when(found != "", found).otherwise(strip(col))


def orcid_search(name):
    return F.concat(F.lit(P.ORCID_SEARCH), F.regexp_replace(name, r"(?U)\s+", "+"))


def author_names(col):
    """array<string>: the names of a line, parted by semicolons, without the marks after them."""
    parts = F.transform(F.split(col, ";"), lambda x: strip(F.regexp_replace(strip(x), P.AUTHOR_TAIL, "")))
    return F.filter(parts, lambda x: x != "")


def person(col):
    """struct(surname, given) of a name."""
    return let(F.regexp_replace(clean(col), r"^[ .]+|[ .]+$", ""), _person)


def _person(name):
    parts = F.split(name, " ")
    comma = F.contains(name, F.lit(","))
    surname = F.when(comma, strip(F.substring_index(name, ",", 1))).when(F.size(parts) == 1, name).otherwise(F.element_at(parts, -1))
    given = F.when(comma, strip(F.regexp_replace(name, r"^[^,]*,", ""))).when(F.size(parts) == 1, F.lit("")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " "))
    return F.struct(surname.alias("surname"), given.alias("given"))


def is_cite(col):
    low = F.lower(F.substring(col, 1, 11))
    return low.startswith("cómo citar") | low.startswith("how to cite") | ((F.length(col) < 400) & has(col, P.CITE_NUMBERS) & ~has(col, "https?://"))


def is_date_note(col):
    return F.when(has(col, "manuscri"), has(col, P.MANUSCRIPT)).otherwise(F.when(col.isNotNull(), False))


def is_doi_line(col):
    sentence = has(col, r"\.\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]", fold=False)
    return has(col, "https?://doi\\.org/") & (F.length(col) <= 200) & ~(sentence & ~is_date_note(col))


def row_like(col):
    """Begins as a row of a table does, with a year, and is no list of names by year."""
    t = strip(col)
    return has(t, P.YEAR_ROW, fold=False) & ~has(t, P.TAXON_LIST)


def is_abstract_heading(col):
    return norm(col).rlike(P.ABSTRACT_HEADING)


def publication_type(col):
    """Ordered; the first rule that holds."""
    low = F.lower(col)
    return (
        F.when(F.contains(low, F.lit("doi.org")), "journal").when(has(col, r",\s*\d+\s*[\(,]"), "journal")
        .when(has(col, r"\(eds?\.\)| in |pp\. "), "book").when(has(col, r"\.pdf|fundación|fundacion|informe|report"), "report")
        .when(F.contains(low, F.lit("http")), "webpage").otherwise("journal")
    )


def months():
    return F.create_map(*[F.lit(x) for kv in P.MONTHS.items() for x in kv])


def date_parts(col):
    """struct(day, month, year) of strings, '' where absent, of `Word d, yyyy`, `d de word de yyyy` or `d/m/yyyy`; an
    unknown month is ''."""
    found = F.array(*[F.regexp_extract(col, p, 0) for p in P.DATES])
    words = lambda f: F.split(F.regexp_replace(F.coalesce(F.nullif(f[0], F.lit("")), F.nullif(f[1], F.lit("")), f[2]), r"\s+de\s+|[,\s/\-]+", "\u0001"), "\u0001")
    month = lambda x: F.coalesce(months()[F.lower(x)], F.lit(""))
    part = lambda day, month, year: F.struct(day.alias("day"), month.alias("month"), year.alias("year"))
    at = lambda w, i: F.coalesce(F.get(w, F.lit(i)), F.lit(""))
    by_form = lambda f, w: F.when(f[0] != "", part(at(w, 1), month(at(w, 0)), at(w, 2))).when(f[1] != "", part(at(w, 0), month(at(w, 1)), at(w, 2))).otherwise(part(at(w, 0), at(w, 1), at(w, 2)))
    return let(found, lambda f: let(words(f), lambda w: by_form(f, w)))


def last_part(col):
    """What stands after the last comma, without blanks, dots and semicolons, empty parts left out."""
    parts = F.filter(F.transform(F.split(col, ","), lambda x: F.regexp_replace(x, r"^[ .;]+|[ .;]+$", "")), lambda x: x != "")
    return F.coalesce(F.get(F.reverse(parts), F.lit(0)), F.lit(""))


def country_code(name):
    return F.coalesce(F.create_map(*[F.lit(x) for kv in P.CODES.items() for x in kv])[norm(name)], F.lit(""))


def country(col):
    """struct(name, code) of the longest country name in an affiliation (of equally long ones the first of the list),
    else of the country that its last part names, '' if none."""
    pair = lambda name, code: F.struct(name.alias("name"), code.alias("code"))
    order = sorted(P.COUNTRIES, key=len, reverse=True)  # stable: of equal lengths the first of the list stays first

    def of(low, guess):
        out = F.lit(None).cast("struct<name:string,code:string>")
        for key in reversed(order):
            name, iso = P.COUNTRIES[key]
            out = F.when(F.contains(low, F.lit(key)) & low.rlike(rf"\b{key}\b"), pair(F.lit(name), F.lit(iso))).otherwise(out)
        last = let(country_code(guess), lambda code: F.when((guess != "") & (code != ""), pair(guess, code)).otherwise(pair(F.lit(""), F.lit(""))))
        return F.coalesce(out, last)

    return let(norm(col), lambda low: let(last_part(col), lambda guess: of(low, guess)))


def _tag_ends() -> str:
    """A pattern that finds each editorial tag by its full stop and the four letters before it; others end so too."""
    tags = [x for tag in P.EDITORIAL.split("|") for x in (re.sub(r"\(\?:.*?\)\?", "", tag), re.sub(r"\(\?:(.*?)\)\?", r"\1", tag))]
    return r"(?iuU)\.(?<=(?:" + "|".join(dict.fromkeys(x[-6:-2] for x in tags)) + r")\.)"


_TAG_ENDS = _tag_ends()


def editorial(col):
    """Escaped text with editorial tags in bold, on a line of their own unless they begin it. Tags are looked for only where
    one may end: word by word they would be tried at each letter."""
    return F.when(col.rlike(_TAG_ENDS), _editorial(col)).otherwise(strip(escape(col)))


def _editorial(col):
    t = F.regexp_replace(escape(col), rf"(?iuU)\b({P.EDITORIAL})\s*", "<br><strong>$1</strong> ")
    t = F.regexp_replace(t, "^<br>", "")  # an escaped text has no tag of its own
    return strip(F.replace(t, F.lit("<strong>Sinonimia.</strong> "), F.lit("<strong>Sinonimia.</strong><br>")))


def affiliations(col, by_mark: bool = False):
    """array<struct(label, body)> of a line: one after its mark, or several after marks that follow .;:) or begin it.
    by_mark: a line that has none of these may begin with a mark and anything after it, small letters and digits too."""
    return let(squeeze(F.coalesce(col, F.lit(""))), lambda t: _affiliations(t, by_mark))


def _affiliations(t, by_mark: bool):
    mark = r"([0-9]+|[A-Za-z]{1,3})"
    whole = rf"^{mark}\s*[).:\-*]?\s+([A-ZÁÉÍÓÚÑÜ].*)$"
    body = lambda x, chars: F.regexp_replace(x, rf"^[ \-{chars}\t]+|[ \-{chars}\t]+$", "")
    pair = lambda label, text: F.struct(label.alias("label"), text.alias("body"))
    one = body(F.regexp_extract(t, whole, 2), ":")
    several = F.split(F.regexp_replace(t, rf"(^|[.;:)])\s*(?={mark}\s+[A-Za-zÁÉÍÓÚÑÜáéíóúñü])", "$1\u0001"), "\u0001")
    cut = F.transform(F.slice(several, F.lit(2), F.size(several)), lambda x: pair(F.regexp_extract(x, "^" + mark, 1), body(F.regexp_replace(x, "^" + mark, ""), ".:;")))
    single = t.rlike(whole) & ~one.rlike(rf"[.;:)]\s+{mark}\s+[A-ZÁÉÍÓÚÑÜ]")
    if by_mark:
        loose = rf"^{mark}\s*[).:\-]?\s+(.*)$"
        cut = F.when(F.size(several) == 1, F.array(pair(F.regexp_extract(t, loose, 1), F.regexp_extract(t, loose, 2)))).otherwise(cut)
    return F.filter(F.when(single, F.array(pair(F.regexp_extract(t, whole, 1), one))).otherwise(cut), lambda x: x["body"] != "")


def references(col):
    """array<string>: the texts between marks at line beginnings; lines, if that leaves nothing."""
    kept = lambda x: F.filter(F.transform(x, strip), lambda y: y != "")
    marked = kept(F.split(col, r"(?m)^\s*(?:\[?\d+[.)\]]\s*)"))
    return let(marked, lambda m: F.when(F.size(m) > 0, m).otherwise(kept(F.split(col, "\n"))))


def figure_caption(col):
    """A caption without its label."""
    return F.regexp_replace(F.regexp_replace(squeeze(col), "(?iu)" + P.FIGURE_PREFIX, ""), r"^[ \-:\t]+|[ \-:\t]+$", "")


def table_title(col):
    """A title without its label."""
    return F.regexp_replace(F.regexp_replace(squeeze(col), "(?iu)" + P.TABLE_PREFIX, ""), r"^[ \-:\t]+|[ \-:\t]+$", "")


def paragraphs(col):
    """array<string> of a fused block, without the marks of sub-headings."""
    return F.filter(F.transform(F.split(col, r"\n{2,}"), lambda x: strip(F.replace(x, F.lit("§SUB§"), F.lit("")))), lambda x: x != "")


def doi(col):
    """The DOI of an address, else one by its form, without closing punctuation."""
    by_form = F.regexp_extract(col, r"(10\.\d{4,9}/\S+)", 1)
    by_url = F.regexp_extract(col, "(?i)" + P.DOI_URL, 1)
    return F.regexp_replace(F.when(by_url != "", by_url).otherwise(by_form), r"[.),;]+$", "")


def issn(col):
    return F.upper(F.regexp_extract(col, P.ISSN, 0))


def autolink(col):
    """E-mail addresses of an escaped text as links."""
    return F.regexp_replace(col, f"({P.PAGE_EMAIL})", '<a href="mailto:$1">$1</a>')


def is_meta_heading(folded, journal: str = ""):
    """Whether a heading, as norm() has it, holds an ISSN, a number, pages, a month or a year, or is the journal's name."""
    months = "|".join(P.MONTHS)
    found = folded.rlike(rf"issn|volumen\s+\d|vol\.\s*\d|num\.\s*\d|p\.\s*\d+|{months}|\(\d{{4}}\)")
    return found | (folded == norm(F.lit(journal))) if journal else found


def is_period(col):
    """Names a month and, soon after it, a year."""
    return col.rlike(P.PERIOD)


def date_notes(col):
    """array<string>: the sentences of a date note, each from its `Manuscrito` on."""
    return F.filter(F.transform(F.split(col, r"(?<=[.!?])\s+(?=Manuscrito|Manuscript)"), strip), lambda x: x != "")


def first_doi_address(col):
    return F.regexp_extract(col, r"(https?://doi\.org/\S+)", 1)


def css_of(html):
    """The style sheet of a page without its imports, which other files would have to bring."""
    return F.regexp_replace(F.regexp_extract(html, r"(?s)<style>(.*?)</style>", 1), r"@import\s+url\([^)]+\)\s*;?\s*", "")


def body_of(html):
    """What stands in a page's body; the whole page if it has none."""
    return F.when(html.rlike(r"(?s)<body>.*?</body>"), F.regexp_extract(html, r"(?s)<body>(.*?)</body>", 1)).otherwise(html)


def as_xhtml(html):
    """Empty elements closed, and ampersands that begin no reference escaped."""
    t = F.regexp_replace(html, r"<(br|hr)\s*>", "<$1/>")
    t = F.regexp_replace(t, r"<(img|input)([^>]*[^/])\s*>", "<$1$2/>")
    return F.regexp_replace(t, r"&(?!amp;|lt;|gt;|quot;|apos;|#\d+;|#x[\da-fA-F]+;)", "&amp;")


def anchor_text(col, last: int = 80):
    """What is looked for of an anchor: its last characters, without soft hyphens, hyphens at line ends and line ends."""
    t = squeeze(F.regexp_replace(F.regexp_replace(F.coalesce(col, F.lit("")), "[\u00ad\ufffc\ufffe]", ""), r"-\s+", ""))
    return strip(F.right(t, F.lit(last)))


def safe_name(path):
    """A file's name without folder and extension, in letters, digits, _ and -, 24 characters at most; `pdf` if none."""
    base = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    t = F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")
    return F.left(F.when(t == "", "pdf").otherwise(t), F.lit(24))


def is_body_heading(col, folded):
    """Whether a text, and it as norm() has it, is a heading of the body."""
    return strip(col).rlike(r"^\d+(\.\d+)*[\s.\-]+") | folded.isin(P.BODY_HEADINGS)


def data_uri(path, content):
    """A figure's bytes as a data address; an unknown extension counts as JPEG."""
    kinds = F.create_map(*[F.lit(x) for kv in P.MIME.items() for x in kv])
    return F.concat(F.lit("data:"), F.coalesce(kinds[F.lower(F.substring_index(path, ".", -1))], F.lit("image/jpeg")), F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def html_table(grid):
    """An array<array<string>> as an HTML table: the first row is the head, rows of nulls only are left out, the others are
    filled up to the longest."""
    return let(grid, _html_table)


def _html_table(grid):
    width = F.array_max(F.transform(grid, lambda r: F.size(r)))
    even = lambda r: F.concat(r, F.array_repeat(F.lit(None).cast("string"), width - F.size(r)))
    cells = lambda row, tag: F.array_join(F.transform(row, lambda c: F.concat(F.lit(f"<{tag}>"), escape(F.coalesce(c, F.lit(""))), F.lit(f"</{tag}>"))), "\n")
    rest = F.filter(F.slice(grid, F.lit(2), F.size(grid)), lambda r: F.exists(r, lambda c: c.isNotNull()))
    line = lambda row, tag: F.concat_ws("\n", F.when(F.size(row) > 0, cells(row, tag)))
    rows = F.transform(rest, lambda r: F.concat_ws("\n", F.lit("<tr>"), line(even(r), "td"), F.lit("</tr>")))
    head = F.concat_ws("\n", F.lit("<thead><tr>"), line(even(F.get(grid, F.lit(0))), "th"), F.lit("</tr></thead><tbody>"))
    return F.when(F.coalesce(F.size(grid), F.lit(0)) <= 0, "<p><em>[Tabla vacía]</em></p>").otherwise(F.concat_ws("\n", F.lit('<table class="pm-tabla">'), head, F.when(F.size(rows) > 0, F.array_join(rows, "\n")), F.lit("</tbody></table>")))


def jats_table(grid):
    """The same as a JATS table; all rows are padded to the longest, and rows of blanks only are left out first."""
    full = F.filter(F.transform(grid, lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit("")))), lambda r: F.exists(r, lambda c: F.trim(c) != ""))
    width = F.array_max(F.transform(full, lambda r: F.size(r)))
    even = F.transform(full, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    line = lambda row, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(row, lambda c: F.concat(F.lit(f"<{tag}>"), escape(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    body = F.array_join(F.transform(F.slice(even, F.lit(2), F.size(even)), lambda r: line(r, "td")), "")
    return F.when(F.size(full) > 0, F.concat(F.lit("<table><thead>"), line(F.get(even, F.lit(0)), "th"), F.lit("</thead><tbody>"), body, F.lit("</tbody></table>"))).otherwise("<p>[No se pudo leer tabla: tabla vacia]</p>")
