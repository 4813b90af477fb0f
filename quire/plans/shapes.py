"""Queries of the parsers over texts of many shapes, put together from parts by the order's number, with SQL that parses
the same texts again by splits, positions and windows. The text alone is stated once for both."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import citation as C
from quire.functions import patterns as P
from quire.operators import people, render

_UPPER, _LOWER = "A-ZÁÉÍÓÚÑÜ", "a-záéíóúñü"
_W = r"\p{L}\p{N}_"


def _pick(key: str, *options: str) -> str:
    """An option by a number, as SQL of either engine."""
    words = "|".join(options).replace("'", "''")
    return f"split_part('{words}', '|', cast(({key}) % {len(options)} + 1 as int))"


_SURNAMES = ["García-Pérez", "Smith", "Andújar", "Ñu", "de la Cruz", "van Andel", "O'Higgins", "Müller", "UNESCO", "Ruiz Soto"]
_GIVEN = [", J. A.", ", K.", "", ", M.-L.", ", . J. K.", ", . J. K., . L. M.", ", A. y otros"]
_BETWEEN = [", ", " & ", ", & ", " and ", "; ", ", And ", ", . P. Q., "]
_CITATION = " || ".join([
    _pick("k % 11", *_SURNAMES), _pick("k % 13", *_GIVEN),
    f"case when k % 3 > 0 then {_pick('k % 7', *_BETWEEN)} || {_pick('k % 17', *_SURNAMES)} || {_pick('k % 19', *_GIVEN)} else '' end",
    f"case when k % 5 > 2 then {_pick('k % 23', *_BETWEEN)} || {_pick('k * 3 % 29', *_SURNAMES)} || {_pick('k * 5 % 31', *_GIVEN)} else '' end",
    _pick("k * 3 % 37", " (2001). ", " (2013, 21 de agosto). ", " (in press). ", " (EN PRENSA). ", " (s. f.). ", " (2003) ", " (Diciembre 2022). ", ". (1999).", " 2010. ", " (1987a). ", " (2011,  mayo).  "),
    _pick("k * 5 % 41", "Title of a thing", "Sobre el caso: un estudio", "The U.S. case", "Fossils in Mexico", "Informe final", "A 2.5 m core, 3, 4", ""), "' ' || cast(k as string)",
    _pick("k * 7 % 43", ". Journal of Things, 12(3), 45–67", ". Revista Ñ, 7, e2021AV44", ". Revista, 8 (2) , 101 - 110.", ". In A. Uno (Ed.), Libro (pp. 3-9)", ". Editorial", "", ". Journal, 5(Suppl.), 3–4", ". Boletín, 12(3)", ". Anuario, 9, 77.  Más", ". Rep. Ser., 3(1), 5-6"),
    _pick("k * 11 % 47", "", ". https://doi.org/10.1234/abc.5", ". HTTPS://DOI.ORG/10.1/X(2001)051[06:A]2.0.CO;2.", " https://ejemplo.org/a/b.pdf . ", ". http://x.org/y),", " doi.org/10.5/z", ". https://doi.org/10.1/a b"),
])

_MARKS = ["1", "a", "12", "ab", "2)", "b.", "3 -", "Sur", "1 a", "c:", "*", "abcd"]
_PLACES = ["Instituto de Geología", "department of Earth", "Museo", "5 Norte", "Óptica, Centro", "C.P. 09230, Pz. de la Paz", "J. Ñ. Lab", "s/n. Colonia Uno"]
_LINE = " || ".join([
    _pick("k % 13", *_MARKS), "' '", _pick("k % 11", *_PLACES), _pick("k % 7", "; ", ". ", " ", ", ", ") ", ": ", " ;"), _pick("k % 17", "2", "b", "", "de", "xyz", "33", "4)"), "' '", _pick("k % 19", *_PLACES, "", "--"),
    _pick("k % 5", ".", "", ";", " - ", ", Chile"),
])
_AFFILIATION = f"{_LINE} || case when k % 3 = 0 then concat(chr(10), {_pick('k % 23', *_MARKS)}, '  ', {_pick('k % 29', *_PLACES)}) else '' end || case when k % 4 = 0 then concat(chr(10), '* josé.', cast(k as string), '@correo-ü.org y otro@x.mx') else '' end"

_NOTE = [
    " || ".join([_pick(f"k % {a}", "Manuscrito recibido: ", "Manuscript received : ", "Manuscrito revisión: ", "MANUSCRITO CORREGIDO: ", "Manuscript  accepted:", "Manuscrito aceptado ", "manuscrito Revised:"),
                 _pick(f"k % {b}", "Diciembre 5, 2020", "5 de mayo de 2021", "20-12-2021", "3/4/2019", "s/f", "mayo 2022", "Foo 3 1999", "1 de Ñoño de 2000", "abril 7 , 2018")])
    for a, b in ((11, 13), (17, 19), (23, 29))
]
_NOTES = " || ' ' || ".join(_NOTE)

_ITEMS = ["uno", "Dos. Otros son:", "Remarks. x", "tres; Más cosas aquí:", "a & <b>", "Horizonte y localidad. z Sinonimia.  q", "éMaterial. no", "Material. Remarks. dos", "descripción. sí", "", "Sinonimia. SINONIMIA. fin"]
_LISTED = " || ".join([_pick("k % 7", "", "Hay:", "Material. Uno", "  Sinonimia. Dos ", "Texto Localidad."), *[f"case when k % {m} > {n} then {_pick(f'k % {p}', '•', ' • ', '•  ')} || {_pick(f'k % {q}', *_ITEMS)} else '' end" for m, n, p, q in ((4, 0, 3, 13), (5, 1, 7, 17), (3, 0, 11, 19), (9, 4, 5, 23))]])


def _texts(spark, sf_dir, text: str):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as k").selectExpr("k as o_orderkey", f"{text} as text")


def queries():
    names = lambda: F.concat_ws("|", F.transform("authors", lambda a: F.concat(a["surname"], F.lit("/"), a["given"])))
    return {
        "citation_shapes": lambda s, d: C.citations(_texts(s, d, _CITATION), "text").select("o_orderkey", "pub_type", "doi", "url", "year", names().alias("authors"), "article_title", "source", "volume", "issue", "fpage", "lpage", "elocation"),
        "affiliation_shapes": lambda s, d: people.affiliation_lines(_texts(s, d, _AFFILIATION), "o_orderkey"),
        "date_note_shapes": lambda s, d: _texts(s, d, _NOTES).select("o_orderkey", F.posexplode(C.manuscript_dates(F.col("text"))).alias("place", "x")).select("o_orderkey", "place", "x.*"),
        "list_shapes": lambda s, d: _texts(s, d, _LISTED).select("o_orderkey", render.paragraph_or_list(F.col("text")).alias("html")),
    }


_CLEAN = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def _with(text: str) -> str:
    return f"with k as (select o_orderkey as k from orders), r as (select k as o_orderkey, {text} as text from k), t as (select o_orderkey, text, {_CLEAN.format('text')} as t from r)"


_YEAR = r"(?i)\((\d{4}(?:[,\s]+[^)]+)?|in press|en prensa)\)\.\s*"
_DOI, _URL = r"(?i)https?://doi\.org/(\S+?)[.\s]*$", r"(?i)(https?://\S+?)[.\s]*$"
_ISSUE, _VOLUME = r",\s*(\d+)\s*\((\d+)\)\s*,\s*(.+)$", r",\s*(\d+)\s*,\s*(.+)$"



def esc(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def same(a: str, b: str, key: str) -> str:
    return " and ".join(f"{a}.{c} = {b}.{c}" for c in key.split(", "))


def citation_ctes(source: str, key: str) -> str:
    """CTEs from a relation (key columns, t, squeezed) to `cited`: its columns and those of citations(); people: names as XML."""
    both = same("cv", "a7", key)
    return f"""
cl as (select *, regexp_extract(t, '{_DOI}', 0) as dm, regexp_extract(t, '{_URL}', 0) as um,
  case when contains(lower(t), 'doi.org') or regexp_matches(t, ',\\s*\\d+\\s*[(,]') then 'journal' when regexp_matches(lower(t), '[(]eds?[.][)]| in |pp[.] ') then 'book'
    when regexp_matches(lower(t), '[.]pdf|fundación|fundacion|informe|report') then 'report' when contains(lower(t), 'http') then 'webpage' else 'journal' end as pub_type from {source}),
cx as (select *, rtrim(regexp_extract(t, '{_DOI}', 1), '.),;') as doi, case when dm = '' then rtrim(regexp_extract(t, '{_URL}', 1), '.),;') else '' end as url,
  case when dm <> '' then trim(left(t, instr(t, dm) - 1), ' .') when um <> '' then trim(left(t, instr(t, um) - 1), ' .') else t end as x from cl),
cy as (select *, regexp_extract(x, '{_YEAR}', 0) as m, regexp_extract(x, '[(](\\d{{4}})[)]', 0) as m2 from cx),
ch as (select *, case when m <> '' then trim(regexp_extract(x, '{_YEAR}', 1)) else trim(m2, '()') end as year,
  case when m <> '' then left(x, instr(x, m) - 1) when m2 <> '' then left(x, instr(x, m2) - 1) else '' end as a,
  rtrim(case when m <> '' then trim(substr(x, instr(x, m) + length(m))) when m2 <> '' then trim(substr(x, instr(x, m2) + 6), ' .') else '' end, '.') as rest from cy),
cs as (select *, list_filter(list_transform(string_split_regex(rest, '\\.\\s+'), lambda z: trim(z)), lambda z: z <> '') as s from ch),
cj as (select *, coalesce(s[1], '') as article_title, coalesce(s[2], '') as j, case when pub_type <> 'journal' then '' else regexp_extract(coalesce(s[2], ''), '{_ISSUE}', 0) end as im, case when pub_type <> 'journal' then '' else regexp_extract(coalesce(s[2], ''), '{_VOLUME}', 0) end as vm from cs),
cv as (select *, case when im <> '' then im else vm end as cut, trim(case when im <> '' then regexp_extract(im, '{_ISSUE}', 3) when vm <> '' then regexp_extract(vm, '{_VOLUME}', 2) else '' end, ' .') as pages from cj),
-- authors: pieces, then a piece of initials goes to the piece before it, unless that has taken one already
a1 as (select {key}, regexp_replace(regexp_replace(trim(a, ' .'), '\\s*&\\s*', ', ', 'g'), '(?i)(^|[^{_W}])and(?:\\s+|([^{_W}\\s])|$)', '\\1\\2', 'g') as a from ch where year <> ''),
a2 as (select {key}, list_filter(list_transform(string_split(regexp_replace(a, ',\\s*([{_UPPER}][{_LOWER}]|\\.\\s*[A-Z]|$)', chr(1) || '\\1', 'g'), chr(1)), lambda z: trim(z, ' .,')), lambda z: z <> '') as a from a1),
a3 as (select {key}, unnest(generate_series(1, len(a))) as i, unnest(a) as p from a2),
a4 as (select *, sum(case when i = 1 or not regexp_matches(p, '^[{_UPPER}][.\\s]') then 1 else 0 end) over (partition by {key} order by i) as run from a3),
a5 as (select *, (row_number() over (partition by {key}, run order by i) - 1) // 2 as pair from a4),
a6 as (select {key}, min(i) as i, trim(string_agg(p, ', ' order by i), ' ,.') as p from a5 group by {key}, run, pair),
a7 as (select {key}, string_agg('<name><surname>' || {esc("case when contains(p, ',') then trim(split_part(p, ',', 1)) else p end")} || '</surname>' || case when contains(p, ',') and trim(substr(p, instr(p, ',') + 1)) <> '' then '<given-names>' || {esc("trim(substr(p, instr(p, ',') + 1))")} || '</given-names>' else '' end || '</name>', '' order by i) as people, string_agg(case when contains(p, ',') then trim(split_part(p, ',', 1)) || '/' || trim(substr(p, instr(p, ',') + 1)) else p || '/' end, '|' order by i) as authors from a6 group by {key}),
cited as (select cv.*, coalesce(authors, '') as authors, people, case when cut <> '' then trim(left(j, instr(j, cut) - 1), ' ,') else j end as source,
  case when im <> '' then regexp_extract(im, '{_ISSUE}', 1) when vm <> '' then regexp_extract(vm, '{_VOLUME}', 1) else '' end as volume, regexp_extract(im, '{_ISSUE}', 2) as issue,
  regexp_extract(pages, '(\\d+)\\s*[–-]\\s*(\\d+)', 1) as fpage, regexp_extract(pages, '(\\d+)\\s*[–-]\\s*(\\d+)', 2) as lpage, case when regexp_matches(pages, '\\d\\s*[–-]\\s*\\d') then '' else pages end as elocation
from cv left join a7 on {both}),"""


_CITATION_SQL = f"""{_with(_CITATION)},{citation_ctes('t', 'o_orderkey').rstrip(',')}
select o_orderkey, pub_type, doi, url, year, authors, article_title, source, volume, issue, fpage, lpage, elocation from cited"""

_MARK = "([0-9]+|[A-Za-z]{1,3})"


def affiliation_ctes(source: str, key: str) -> str:
    """CTEs from a relation (key columns, t, squeezed) to `marked` (key columns, pos, label, body): affiliations after marks."""
    return f"""
am as (select *, trim(regexp_extract(t, '^{_MARK}\\s*[).:*-]?\\s+([{_UPPER}].*)$', 2), ' -:' || chr(9)) as own, regexp_extract(t, '^{_MARK}\\s*[).:*-]?\\s+([{_UPPER}].*)$', 1) as mark from {source}),
af as (select *, own <> '' and not regexp_matches(own, '[.;:)]\\s+{_MARK}\\s+[{_UPPER}]') as single from am),
-- every place where a mark stands at the beginning or after a closing sign
ap as (select *, unnest(generate_series(1, length(t))) as pos from af where not single),
ast as (select *, regexp_extract(substr(t, pos), '^{_MARK}\\s+[{_UPPER}{_LOWER}]', 1) as found from ap where pos = 1 or regexp_matches(rtrim(left(t, pos - 1)), '[.;:)]$')),
ag as (select *, coalesce(lead(pos) over (partition by {key} order by pos), length(t) + 1) as until from ast where found <> ''),
marked as (select * from (select {key}, pos, found as label, trim(substr(t, pos + length(found), until - pos - length(found)), ' -.:;' || chr(9)) as body from ag) where body <> ''
  union all select {key}, 0, mark, own from af where single),
loose as (select {key}, regexp_extract(t, '^{_MARK}\\s*[).:-]?\\s+(.*)$', 1) as label, regexp_extract(t, '^{_MARK}\\s*[).:-]?\\s+(.*)$', 2) as body from af where not single and not exists (select 1 from ag where {same('ag', 'af', key)}) and regexp_matches(t, '^{_MARK}\\s*[).:-]?\\s+.')),"""


_AFFILIATION_SQL = f"""{_with(_AFFILIATION)},
ln as (select o_orderkey, unnest(generate_series(0, len(a) - 1)) as line, unnest(a) as raw from (select o_orderkey, string_split(text, chr(10)) as a from r)),
c as (select o_orderkey, line, {_CLEAN.format('raw')} as t from ln where trim(raw) <> ''),
m as (select *, case when starts_with(t, '*') then nullif(regexp_extract(t, '[{_W}.\\-+%]+@[{_W}.\\-]+\\.[{_W}]{{2,}}', 0), '') end as email from c),
f as (select o_orderkey, line, t from m where email is null),{affiliation_ctes('f', 'o_orderkey, line')}
kept as (select o_orderkey, line, pos, label, body from marked union all select o_orderkey, line, 0, label, body from loose union all select o_orderkey, line, 0, '', '' from m where email is not null),
al as (select m.o_orderkey, m.line, m.email, coalesce(k.pos, 0) as pos, coalesce(k.label, '') as label, case when k.body is null then m.t else k.body end as text from m left join kept k on k.o_orderkey = m.o_orderkey and k.line = m.line),
n as (select *, row_number() over (partition by o_orderkey, line order by pos) - 1 as part, sum(case when email is null then 1 else 0 end) over (partition by o_orderkey order by line, pos rows unbounded preceding) as n from al)
select o_orderkey, cast(line as integer) as line, cast(part as integer) as part, case when email is null then 'aff' || cast(n as bigint) end as aff_id, case when label <> '' then label else cast(cast(n as bigint) as varchar) end as label, text, email from n"""

_MONTHS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in P.MONTHS.items()) + "}"
_FORMS = [r"([A-Za-záéíóúñÁÉÍÓÚÑ]+)\s+(\d{1,2})[,\s]+(\d{4})", r"(\d{1,2})\s+de\s+([A-Za-záéíóúñ]+)\s+de\s+(\d{4})", r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})"]


def date_ctes(source: str, key: str) -> str:
    """CTEs from a relation (key columns, text) to `dated` (key columns, place, date_type, day, month, year)."""
    return f"""
ds as (select {key}, string_split(regexp_replace(text, '(?i)(?:manuscrito|manuscript)\\s+([{_W}]+)\\s*:', chr(1) || '\\1' || chr(2), 'g'), chr(1)) as a from {source}),
de as (select {key}, unnest(generate_series(2, len(a))) as i, unnest(a[2:]) as e from ds),
dd as (select {key}, i, case lower(split_part(e, chr(2), 1)) when 'recibido' then 'received' when 'received' then 'received' when 'corregido' then 'rev-recd' when 'revised' then 'rev-recd' when 'aceptado' then 'accepted' when 'accepted' then 'accepted' end as date_type, split_part(e, chr(2), 2) as v from de),
df as (select *, case when regexp_matches(v, '{_FORMS[0]}') then 1 when regexp_matches(v, '{_FORMS[1]}') then 2 when regexp_matches(v, '{_FORMS[2]}') then 3 end as form from dd),
dg as (select *, case form when 1 then regexp_extract(v, '{_FORMS[0]}', 2) when 2 then regexp_extract(v, '{_FORMS[1]}', 1) else regexp_extract(v, '{_FORMS[2]}', 1) end as day,
  case form when 1 then coalesce({_MONTHS}[lower(regexp_extract(v, '{_FORMS[0]}', 1))], '') when 2 then coalesce({_MONTHS}[lower(regexp_extract(v, '{_FORMS[1]}', 2))], '') else regexp_extract(v, '{_FORMS[2]}', 2) end as month,
  case form when 1 then regexp_extract(v, '{_FORMS[0]}', 3) when 2 then regexp_extract(v, '{_FORMS[1]}', 3) else regexp_extract(v, '{_FORMS[2]}', 3) end as year from df where date_type is not null and form is not null),
dated as (select {key}, cast(row_number() over (partition by {key} order by i) - 1 as integer) as place, date_type, day, month, year from dg),"""


_DATES_SQL = f"""{_with(_NOTES)},{date_ctes('t', 'o_orderkey').rstrip(',')}
select * from dated"""


def _tagged(col: str) -> str:
    """Editorial tags in one pass; a letter with an accent is no boundary, which RE2 does not know."""
    safe = f"regexp_replace(replace(replace(replace({col}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)([áéíóúñü])({P.EDITORIAL})', '\\1_Q_\\2', 'g')"
    bold = f"regexp_replace({safe}, '(?i)\\b({P.EDITORIAL})\\s*', '<br><strong>\\1</strong> ', 'g')"
    return f"trim(replace(replace(regexp_replace({bold}, '^<br>', ''), '_Q_', ''), '<strong>Sinonimia.</strong> ', '<strong>Sinonimia.</strong><br>'))"


_TURN = f"^(.*?[.;])\\s+([A-ZÁÉÍÓÚÑ][^:]{{4,}}:)\\s*$"


def list_ctes(source: str, key: str) -> str:
    """CTEs from a relation (key columns, t, stripped) to `listed` (key columns, html): paragraphs and lists."""
    return f"""
lp as (select {key}, t, list_filter(list_transform(string_split(t, '•'), lambda z: trim(z)), lambda z: z <> '') as a from {source}),
lu as (select {key}, t, unnest(generate_series(1, len(a))) as i, unnest(a) as s from lp where contains(t, '•')),
lw as (select {key}, i * 2 as i, case when i = 1 and not starts_with(t, '•') then 'p' else 'li' end as kind, case when (i > 1 or starts_with(t, '•')) and regexp_matches(s, '{_TURN}') then regexp_extract(s, '{_TURN}', 1) else s end as s from lu
  union all select {key}, i * 2 + 1, 'p', regexp_extract(s, '{_TURN}', 2) from lu where (i > 1 or starts_with(t, '•')) and regexp_matches(s, '{_TURN}')
  union all select {key}, 0, 'p', t from lp where t <> '' and (not contains(t, '•') or len(a) = 0)),
ln as (select *, coalesce(lag(kind) over v, 'p') as before, coalesce(lead(kind) over v, 'p') as after from lw window v as (partition by {key} order by i)),
lo as (select {key}, i, case when kind = 'p' then '<p class="cuerpo">' || {_tagged('s')} || '</p>' else case when before = 'p' then '<ul class="lista-bullets cuerpo-list">' || chr(10) else '' end || '  <li>' || {_tagged('s')} || '</li>' || case when after = 'p' then chr(10) || '</ul>' else '' end end as x from ln),
listed as (select {key}, string_agg(x, chr(10) order by i) as html from lo group by {key}),"""


_LIST_SQL = f"""with k as (select o_orderkey as k from orders), t as (select k as o_orderkey, trim({_LISTED}) as t from k),{list_ctes('t', 'o_orderkey').rstrip(',')}
select t.o_orderkey, coalesce(html, '') as html from t left join listed using (o_orderkey)"""


def oracle_sql():
    return {"citation_shapes": _CITATION_SQL, "affiliation_shapes": _AFFILIATION_SQL, "date_note_shapes": _DATES_SQL, "list_shapes": _LIST_SQL}
