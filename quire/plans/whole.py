"""SQL of whole pages and books, made of the SQL of their parts: labels, table mode, splits, fusion, styles, paragraphs and
lists, affiliations, notes."""

from __future__ import annotations

from quire.functions import patterns as P
from quire.plans import more, registry
from quire.plans.more import _EMBEDDED, _PAGES, _SCANS, _SPLIT
from quire.plans.registry import _FUSE
from quire.plans.shapes import affiliation_ctes, citation_ctes, date_ctes, esc, list_ctes

_W = r"\p{L}\p{N}_"
_DISC = "data:image/svg+xml;utf8,%3Csvg xmlns=''http://www.w3.org/2000/svg'' viewBox=''0 0 24 24''%3E%3Ccircle cx=''12'' cy=''12'' r=''12'' fill=''%23A6CE39''/%3E%3C/svg%3E"
_SIGN = f'<img src="{_DISC}" alt="ORCID">'
_ABSTRACTS = "('resumen', 'abstract', 'resumen no técnico', 'non-technical abstract')"
_RULED = """('resumen', 'abstract', 'resumen no técnico', 'non-technical abstract', 'referencias', 'references', 'contribuciones de los autores', 'contribución de autores', 'contribucción de autores', 'author contribution',
  'author contributions', 'authors'' contribution', 'agradecimientos', 'acknowledgements', 'acknowledgments', 'conflicto de intereses', 'conflict of interest', 'conflicts of interest', 'competing interests')"""
_META = "issn|volumen\\s+[0-9]|vol[.]\\s*[0-9]|núm[.]\\s*[0-9]|p[.]\\s*[0-9][0-9]|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre|january|february|march|april|may|june|july|august|september|october|november|december|[(][0-9]{4}[)]"


def _listed(name: str, orcid: str) -> str:
    url = f"https://orcid.org/{orcid}"
    return f'<a class="orcid-autor" href="{url}" target="_blank" title="ORCID: {orcid}">{name}</a><a class="orcid-icon" href="{url}" target="_blank" title="ORCID: {orcid}">{_SIGN}</a>'


#: The authors given for each fourth document; the third has a blank for a name.
_GIVEN = '<p class="autores sin-sangria">' + _listed("Ruiz,  Ana", "https://orcid.org/0000-0001-2345-678x") + "; " + _listed("Luz María Paz", "ninguno") + "</p>"
_TOP = '<!DOCTYPE html>\n<html lang="es">\n<head>\n  <meta charset="UTF-8">\n  <meta name="viewport" content="width=device-width, initial-scale=1.0">\n  <title>Artículo</title>\n<style>p{}</style>\n</head>\n<body><article>'

_SEARCH = "'https://orcid.org/orcid-search/search?searchQuery=' || regexp_replace(z, '\\s+', '+', 'g')"
_FOUND = f"""'<a class="orcid-autor" href="' || {_SEARCH} || '" target="_blank" title="Buscar ' || {esc('z')} || ' en ORCID">' || {esc('z')} || '</a><a class="orcid-icon" href="' || {_SEARCH} || '" target="_blank" title="Buscar en ORCID">{_SIGN}</a>'"""

_PAGE = f"""
w0 as (select doc_id, seq, clasificacion as c, contenido, trim(contenido, ' ' || chr(9) || chr(10)) as s, lower(trim({esc('contenido')})) as low from fused),
w1 as (select *, max(case when c = 'Título secundario' then 1 else 0 end) over d as second, min(case when c = 'Título principal' then seq end) over d as t1, min(case when c = 'Título secundario' then seq end) over d as t2 from w0 window d as (partition by doc_id)),
w2 as (select *, min(case when c = 'Encabezado sección' and regexp_matches(strip_accents(s), '^(resumen|abstract|resumen no tecnico|non-technical abstract)[ ]*[:.]?$', 'i') and seq > coalesce(t2, t1) then seq end) over (partition by doc_id) as a0 from w1),
titles as (select doc_id, regexp_replace(trim(contenido), '\\s+', ' ', 'g') as title from w0 where c = 'Título principal' qualify row_number() over (partition by doc_id order by seq) = 1),
w3 as (select *, c = 'Encabezado sección' and low in {_ABSTRACTS} as opens from w2 where not coalesce(seq > coalesce(t2, t1) and seq < a0, false)),
w4 as (select *, sum(case when opens then 1 else 0 end) over o as nth, c = case when second = 1 then 'Título secundario' else 'Título principal' end as place, min(case when c = 'Encabezado sección' and regexp_matches(contenido, 'referencia|reference', 'i') then seq end) over (partition by doc_id) as ref
  from w3 window o as (partition by doc_id order by seq)),
w5 as (select *, coalesce(last_value(case when opens then nth >= 2 when (c = 'Encabezado sección' and low not in ('palabras clave', 'keywords')) or c = 'Subencabezado' then false end ignore nulls) over o, false) as gris,
  sum(case when c = 'Subencabezado' then 1 else 0 end) over o as subs, place and sum(case when place then 1 else 0 end) over o = 1 as here from w4 window o as (partition by doc_id order by seq rows between unbounded preceding and current row)),
-- paragraphs of bodies, the broken ones rejoined
b1 as (select doc_id, seq, list_filter(list_transform(string_split(contenido, chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> '') as a from w5 where c = 'Cuerpo'),
b2 as (select doc_id, seq, string_split(list_reduce(a, lambda acc, x: case when starts_with(x, '§SUB§') or starts_with(string_split(acc, chr(10) || chr(10))[-1], '§SUB§') or regexp_matches(acc, '[.?!:]$') then acc || chr(10) || chr(10) || x
  when regexp_matches(acc, '[‐-—-]\\s*$') and regexp_matches(x, '^[a-záéíóúñü]') then regexp_replace(acc, '[‐-—-]\\s*$', '') || x else acc || ' ' || x end), chr(10) || chr(10)) as a from b1 where len(a) > 0),
b3 as (select doc_id, seq, unnest(generate_series(1, len(a))) as par, unnest(a) as t from b2),
b4 as (select * from b3 where not starts_with(t, '§SUB§')),{list_ctes('b4', 'doc_id, seq, par')}
bodies as (select b3.doc_id, b3.seq, string_agg(case when starts_with(t, '§SUB§') then '<h3 class="subseccion-bajo">' || {esc('substr(t, 6)')} || '</h3>' else html end, chr(10) order by b3.par) as body from b3 left join listed on listed.doc_id = b3.doc_id and listed.seq = b3.seq and listed.par = b3.par group by b3.doc_id, b3.seq),
q0 as (select doc_id, seq, regexp_replace(trim(contenido), '\\s+', ' ', 'g') as t from w5 where c = 'Filiación'),{affiliation_ctes('q0', 'doc_id, seq')}
places as (select doc_id, seq, string_agg('<p class="filiaciones sin-sangria"><sup>' || {esc('label')} || '</sup> ' || {esc('body')} || '</p>', chr(10) order by pos) as html from marked group by doc_id, seq),
w6 as (select w5.*, {esc('contenido')} as e, body, html as place_html from w5 left join bodies on bodies.doc_id = w5.doc_id and bodies.seq = w5.seq left join places on places.doc_id = w5.doc_id and places.seq = w5.seq),
w7 as (select doc_id, seq, here, case c when 'Título principal' then '<h1 class="titulo-principal">' || e || '</h1>' when 'Título secundario' then '<h2 class="titulo-secundario">' || e || '</h2>'
  when 'Autores' then case when doc_id % 4 > 0 then '<p class="autores sin-sangria">' || array_to_string(list_transform(list_filter(list_transform(string_split(contenido, ';'), lambda x: trim(regexp_replace(trim(x), '[0-9,*¹²³⁰-ₜ]+$', ''))), lambda x: x <> ''), lambda z: {_FOUND}), '; ') || '</p>' end
  when 'Filiación' then coalesce(place_html, '<p class="filiaciones sin-sangria">' || e || '</p>')
  when 'Email / Metadatos' then '<p class="email sin-sangria">' || regexp_replace(e, '([{_W}.-]+@[{_W}.-]+[.][{_W}]{{2,}})', '<a href="mailto:\\1">\\1</a>', 'g') || '</p>'
  when 'Encabezado sección' then '<h2 class="' || case when regexp_matches(e, '{_META}', 'i') then 'seccion meta' else 'seccion' || case when low in {_RULED} then ' con-linea' else '' end || case when case when low in {_ABSTRACTS} then gris else low = 'keywords' end then ' gris' else '' end end || '">' || e || '</h2>'
  when 'Subencabezado' then case when subs = 1 then '<h3 class="subseccion primer-nivel1">' else '<h3 class="subseccion">' end || e || '</h3>' when 'Subencabezado-bajo' then '<h3 class="subseccion-bajo">' || e || '</h3>'
  when 'Palabras clave' then case when gris then '<p class="keywords sin-sangria" style="color:#666;font-style:italic;">' else '<p class="keywords sin-sangria">' end || regexp_replace(regexp_replace(e, '^(?i)((?:palabras\\s+clave|keywords)\\s*[:.]?)\\s*', '<strong>\\1</strong> '), '\\s+</strong>', '</strong>') || '</p>'
  when 'Cuerpo' then nullif(body, '') end as f from w6),
w8 as (select doc_id, string_agg(case when here and doc_id % 4 = 0 then f || chr(10) || '{_GIVEN}' else f end, chr(10) order by seq) as f from w7 group by doc_id),
n1 as (select doc_id, seq, c, contenido, s, regexp_extract(s, 'https?://doi[.]org/\\S+', 0) as doi from w5 where c in ('Cómo citar', 'Fecha manuscrito') and (ref is null or seq <= ref) qualify row_number() over (partition by doc_id, c, left(s, 80) order by seq) = 1),
n2 as (select *, row_number() over (partition by doc_id, c, doi order by seq) = 1 as own, case when c = 'Fecha manuscrito' then nullif(array_to_string(list_transform(list_filter(list_transform(string_split(
  regexp_replace(case when doi <> '' then trim(replace(s, doi, ''), ' .') else s end, '([.!?])\\s+(Manuscrito|Manuscript)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> ''), lambda x: '  <li>' || {esc('x')} || '</li>'), chr(10)), '') end as lines from n1),
notes as (select doc_id, concat_ws(chr(10), '<div class="post-referencias">', string_agg(case when c = 'Cómo citar' then '<p class="como-citar">' || {esc('contenido')} || '</p>' end, chr(10) order by seq),
  case when bool_or(lines is not null) then concat_ws(chr(10), '<div class="fechas-manuscrito"><ul>', string_agg(lines, chr(10) order by seq), string_agg(case when c = 'Fecha manuscrito' and own and doi <> '' then '  <li><a href="' || doi || '" target="_blank">' || {esc('doi')} || '</a></li>' end, chr(10) order by seq), '</ul></div>') end, '</div>') as notes,
  bool_or(c = 'Cómo citar' or lines is not null) as noted from n2 group by doc_id),
pages_ as (select w8.doc_id, coalesce(title, 'Artículo') as title, concat_ws(chr(10), '{_TOP}', f, case when noted then notes end, '</article></body></html>') as html from w8 left join titles on titles.doc_id = w8.doc_id left join notes on notes.doc_id = w8.doc_id),
"""

_BOOK = f"""
x1 as (select doc_id, title, regexp_replace(regexp_replace(html[instr(html, '<body>') + 6 : instr(html, '</body>') - 1], '<(br|hr)\\s*>', '<\\1/>', 'g'), '<(img|input)([^>]*[^/])\\s*>', '<\\1\\2/>', 'g') as body from pages_),
x2 as (select doc_id, title, replace(replace(regexp_replace(body, '&(amp;|lt;|gt;|quot;|apos;|#[0-9]+;|#x[0-9a-fA-F]+;)', chr(2) || '\\1', 'g'), '&', '&amp;'), chr(2), '&') as body from x1),
heads as (select doc_id, string_agg(case when c = 'Encabezado sección' and s <> '' then s end, '|' order by seq) as sections, coalesce(arg_min(rtrim(regexp_extract(contenido, 'https?://doi[.]org/\\S+', 0), '.'), seq) filter (regexp_extract(contenido, 'https?://doi[.]org/\\S+', 0) <> ''), '') as doi from w0 group by doc_id),
"""


#: Countries by the longest name, then that of the last part.
_LONGEST = " ".join(f"when regexp_matches(low, '\\b{k}\\b') then ['{n}', '{c}']" for k, (n, c) in sorted(P.COUNTRIES.items(), key=lambda kv: -len(kv[0])))
_LAST = " ".join(f"when '{k}' then [part, '{c}']" for k, c in P.CODES.items())
_SPACES = " ".join(f'xmlns:{k}="{v}"' for k, v in P.NAMESPACES.items())
_ROOT = f'<?xml version="1.0" encoding="utf-8"?>\n{P.DOCTYPE}\n<article {_SPACES} article-type="research-article" dtd-version="1.1" specific-use="sps-1.8" xml:lang="es">'
_JOURNAL = '<front><journal-meta><journal-id journal-id-type="publisher-id"></journal-id><journal-title-group><journal-title></journal-title><abbrev-journal-title abbrev-type="publisher"></abbrev-journal-title></journal-title-group>'
_SUBJECT = '<article-categories><subj-group subj-group-type="heading"><subject>Research Article</subject></subj-group></article-categories>'
_GRID = "<table><thead><tr><th>a b</th><th></th><th></th></tr></thead><tbody><tr><td>&lt;c&gt;</td><td>d</td><td>e</td></tr></tbody></table>"
_RIGHTS = "</copyright-year><copyright-holder></copyright-holder><ali:free_to_read/><license license-type=\"open-access\" xlink:href=\"https://creativecommons.org/licenses/by/4.0/\" xml:lang=\"es\"><license-p>Distribuido bajo una licencia Creative Commons Attribution 4.0 International (CC BY 4.0).</license-p></license></permissions>"
_ROUTE = registry.oracle_sql()["jats_route"]
_PARTS = _ROUTE[_ROUTE.index("select doc_id, seq, case when meta") :].replace("from lab", "from fused")


def _some(tag: str, value: str, attr: str = "") -> str:
    return f"case when {value} <> '' then '<{tag}{attr}>' || {esc(value)} || '</{tag}>' else '' end"


def _keywords(part: str, name: str, lang: str, title: str) -> str:
    return f"""
{name}1 as (select doc_id, seq, unnest(generate_series(1, len(a))) as i, unnest(a) as w from (select doc_id, seq, list_filter(list_transform(string_split_regex(regexp_replace(text, '^(palabras clave|keywords) *[:.]? *', '', 'i'), '[;,]'), lambda x: trim(x, ' .;')), lambda x: x <> '') as a from j1 where part = '{part}')),
{name} as (select doc_id, '<kwd-group kwd-group-type="author-generated" xml:lang="{lang}"><title>{title}</title>' || string_agg('<kwd>' || {esc('w')} || '</kwd>', '' order by seq, i) || '</kwd-group>' as {name} from (select * from {name}1 qualify row_number() over (partition by doc_id, lower(w) order by seq, i) = 1) group by doc_id),"""



def _article(tabs: str, figs: str = "") -> str:
    """CTEs from fused paragraphs to `articles`. tabs, figs: SQL of their tables and figures."""
    figures = f"""
figs as ({figs}),
figures_ as (select doc_id, '<sec sec-type="figures"><title>Figuras</title>' || string_agg('<fig id="fig' || n || '"><label>Figura ' || n || '</label><caption><title>Figura ' || n || '</title><p>' || {esc("case when trim(pie) <> '' then trim(pie) else 'Figura ' || n end")} || '</p></caption><graphic xlink:href="' || path || '"/></fig>', '' order by n) || '</sec>' as figures
  from (select *, row_number() over (partition by doc_id order by fig_no) as n from figs) group by doc_id),""" if figs else """
figures_ as (select 0 as doc_id, '' as figures where false),"""
    return f"""
jr as ({_PARTS}),
j1 as (select f.doc_id, f.seq, clasificacion as c, trim(regexp_replace(contenido, '\\s+', ' ', 'g')) as text, jr.part from fused f join jr on jr.doc_id = f.doc_id and jr.seq = f.seq),
j2 as (select *, rtrim(coalesce(nullif(regexp_extract(text, '(?i)https?://doi[.]org/(\\S+)', 1), ''), regexp_extract(text, '(10[.][0-9]{{4,9}}/\\S+)', 1)), '.),;') as doi, regexp_extract(text, '\\b[0-9]{{4}}-[0-9]{{3}}[0-9Xx]\\b', 0) as issn from j1),
j3 as (select doc_id, coalesce(arg_min(text, seq) filter (c = 'Título principal'), '') as title, coalesce(arg_min(text, seq) filter (c = 'Título secundario'), '') as title_en, coalesce(arg_min(doi, seq) filter (doi <> ''), '') as doi, coalesce(upper(arg_min(issn, seq) filter (issn <> '')), '0000-0000') as issn,
  coalesce(arg_min(regexp_extract(text, '\\b(19|20)[0-9][0-9]\\b', 0), seq) filter (part = 'front_note' and not contains(lower(text), 'issn') and regexp_matches(text, '\\b(19|20)[0-9][0-9]\\b')), '') as year,
  coalesce(string_agg('<custom-meta><meta-name>how-to-cite</meta-name><meta-value>' || {esc('text')} || '</meta-value></custom-meta>', '' order by seq) filter (part = 'cite_note'), '') as cites,
  coalesce(arg_min(text, seq) filter (part = 'front_note' and regexp_matches(text, '({'|'.join(P.MONTHS)}).{{1,30}}[0-9]{{4}}', 'i')), '') as period from j2 group by doc_id),
-- affiliations, addresses, authors
k1 as (select doc_id, row_number() over (partition by doc_id order by seq) as n, text, lower(strip_accents(text)) as low, coalesce(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' .;')), lambda x: x <> '')[-1], '') as part from j1 where c = 'Filiación'),
k2 as (select *, coalesce(case {_LONGEST} end, case lower(strip_accents(part)) {_LAST} end, ['', '']) as land from k1),
affs as (select doc_id, string_agg('<aff id="aff' || n || '"><label>' || n || '</label><institution content-type="original">' || {esc('text')} || '</institution><country' || case when land[2] <> '' then ' country="' || land[2] || '"' else '' end || '>' || {esc('land[1]')} || '</country></aff>', '' order by n) as affs, string_agg('<xref ref-type="aff" rid="aff' || n || '">' || n || '</xref>', '' order by n) as links from k2 group by doc_id),
ml1 as (select doc_id, seq, unnest(regexp_extract_all(text, '[{_W}.+%-]+@[{_W}.-]+[.][{_W}]{{2,}}')) as m from j1 where c = 'Email / Metadatos'),
mails as (select doc_id, string_agg('<email>' || {esc('m')} || '</email>', '' order by seq) as mails from (select doc_id, m, min(seq) as seq from ml1 group by doc_id, m) group by doc_id),
p1_ as (select doc_id, seq, unnest(generate_series(1, len(a))) as i, unnest(a) as name from (select doc_id, seq, list_filter(list_transform(string_split(text, ';'), lambda x: trim(regexp_replace(trim(x), '[0-9,*¹²³⁰-ₜ]+$', ''))), lambda x: x <> '') as a from j1 where c = 'Autores' and doc_id % 4 > 0)
  union all select doc_id, 0, i, ['Ruiz, Ana', 'Luz María Paz'][i] from (select doc_id, unnest([1, 2]) as i from j3 where doc_id % 4 = 0)),
p2_ as (select doc_id, row_number() over (partition by doc_id order by seq, i) as n, name, trim(name, ' .') as who, case when doc_id % 4 = 0 and i = 1 then '<contrib-id contrib-id-type="orcid" authenticated="false">https://orcid.org/0000-0001-2345-678X</contrib-id>' else '' end as id from p1_),
p3_ as (select *, case when contains(who, ',') then trim(split_part(who, ',', 1)) else string_split(who, ' ')[-1] end as surname, case when contains(who, ',') then trim(substr(who, instr(who, ',') + 1)) else trim(left(who, length(who) - length(string_split(who, ' ')[-1]))) end as given from p2_),
people as (select p.doc_id, '<contrib-group>' || string_agg('<contrib contrib-type="author">' || id || '<name><surname>' || {esc("case when surname <> '' then surname else name end")} || '</surname>' || {_some('given-names', 'given')} || '</name>' || coalesce(links, '') || case when n = 1 and mails is not null then '<xref ref-type="corresp" rid="cor1"></xref>' else '' end || '</contrib>', '' order by n) || '</contrib-group>' as people
  from p3_ p left join affs on affs.doc_id = p.doc_id left join mails on mails.doc_id = p.doc_id group by p.doc_id),
-- history, keywords
dn as (select doc_id, string_agg(text, ' ' order by seq) as text from j1 where part = 'date_note' group by doc_id),{date_ctes('dn', 'doc_id')}
history as (select doc_id, string_agg('<date date-type="' || date_type || '">' || {_some('day', 'day')} || {_some('month', 'month')} || '<year>' || year || '</year></date>', '' order by place) as history from dated where year <> '' group by doc_id),{_keywords('keywords_es', 'kes', 'es', 'Palabras clave')}{_keywords('keywords_en', 'ken', 'en', 'Keywords')}{_keywords('keywords', 'kno', 'es', 'Palabras clave')}
-- sections of the body
s1 as (select doc_id, seq, part = 'heading' as h, trim(replace(text, '§SUB§', '')) as t, row_number() over (partition by doc_id order by seq) as i, bool_or(part = 'heading') over (partition by doc_id) as headed from j1 where part in ('heading', 'paragraph')),
secs as (select doc_id, string_agg(case when h then case when i > 1 then '</sec>' else '' end || '<sec><title>' || {esc('t')} || '</title>' else case when i = 1 and headed then '<sec><title></title>' else '' end || {_some('p', 't')} end, '' order by seq) || case when bool_or(h) then '</sec>' else '' end as body from s1 group by doc_id),
-- references, structured
r0 as (select doc_id, seq, trim(regexp_replace(regexp_replace(text, '^\\s*\\[?[0-9]+[.)\\]]\\s*', ''), '\\s+', ' ', 'g')) as t from j1 where part = 'ref'),
r1 as (select * from r0 where t <> ''),{citation_ctes('r1', 'doc_id, seq')}
r2 as (select doc_id, seq, row_number() over (partition by doc_id order by seq) as n, '<mixed-citation>' || {esc('t')} || '</mixed-citation>' || case when year = '' then '<mixed-citation publication-type="' || pub_type || '">' || {esc('t')} || '</mixed-citation>' else '<element-citation publication-type="' || pub_type || '">'
  || case when authors <> '' then '<person-group person-group-type="author">' || people || '</person-group>' else '' end || '<year iso-8601-date="' || regexp_extract(year, '^[0-9]*', 0) || '">' || {esc('year')} || '</year>' || {_some('article-title', 'article_title')} || {_some('source', 'source')} || {_some('volume', 'volume')} || {_some('issue', 'issue')} || {_some('fpage', 'fpage')} || {_some('lpage', 'lpage')}
  || {_some('elocation-id', 'elocation')} || {_some('pub-id', 'doi', ' pub-id-type="doi"')} || case when url <> '' then '<ext-link ext-link-type="uri" xlink:href="' || replace({esc('url')}, '"', '&quot;') || '">' || {esc('url')} || '</ext-link>' else '' end || '</element-citation>' end as x from cited),
refs as (select doc_id, '<ref-list><title>Referencias</title>' || string_agg('<ref id="R' || n || '">' || x || '</ref>', '' order by n) || '</ref-list>' as refs from r2 group by doc_id),
tabs as ({tabs}),{figures}
media as (select doc_id, '<sec sec-type="tables"><title>Tablas</title>' || string_agg('<table-wrap id="tbl' || n || '"><label>Tabla ' || n || '</label><caption><title>Tabla ' || n || '</title><p>' || {esc("case when trim(titulo) <> '' then trim(titulo) else 'Tabla ' || n end")} || '</p></caption>{_GRID}</table-wrap>', '' order by n) || '</sec>' as media
  from (select *, row_number() over (partition by doc_id order by tab_no) as n from tabs) group by doc_id),
j4 as (select *, case when year <> '' then year when regexp_matches(doi, '\\b(19|20)[0-9][0-9]\\b') then regexp_extract(doi, '\\b(19|20)[0-9][0-9]\\b', 0) else '2026' end as y from j3),
articles as (select j4.doc_id, concat('{_ROOT}{_JOURNAL}<issn pub-type="epub">', issn, '</issn><publisher><publisher-name></publisher-name></publisher></journal-meta><article-meta>', {_some('article-id', 'doi', ' pub-id-type="doi"')}, '{_SUBJECT}<title-group><article-title>', {esc("case when title <> '' then title else 'Articulo' end")}, '</article-title>',
  case when title_en <> '' then '<trans-title-group xml:lang="en"><trans-title>' || {esc('title_en')} || '</trans-title></trans-title-group>' else '' end, '</title-group>', people, affs, '<author-notes><corresp id="cor1"><label>*</label>' || mails || '</corresp></author-notes>', '<pub-date pub-type="epub"><year>', y, '</year></pub-date>', {_some('elocation-id', "string_split(doi, '.')[-1]")},
  '<history>' || history || '</history>', '<permissions><copyright-statement>© ', y, ' </copyright-statement><copyright-year>', y, '{_RIGHTS}', kes, ken, kno,
  case when period <> '' or cites <> '' then '<custom-meta-group>' || case when period <> '' then '<custom-meta><meta-name>publication-period</meta-name><meta-value>' || {esc('period')} || '</meta-value></custom-meta>' else '' end || cites || '</custom-meta-group>' end, '</article-meta></front><body>', body, media, figures, '</body><back>', refs, '</back></article>' || chr(10)) as jats
  from j4 left join people on people.doc_id = j4.doc_id left join affs on affs.doc_id = j4.doc_id left join mails on mails.doc_id = j4.doc_id left join history on history.doc_id = j4.doc_id left join kes on kes.doc_id = j4.doc_id left join ken on ken.doc_id = j4.doc_id left join kno on kno.doc_id = j4.doc_id
  left join secs on secs.doc_id = j4.doc_id left join media on media.doc_id = j4.doc_id left join figures_ on figures_.doc_id = j4.doc_id left join refs on refs.doc_id = j4.doc_id),
"""


#: Pages with the tables of scans under a heading and figures after them; none has an anchor.
_GRID_HTML = '<table class="pm-tabla">\n<thead><tr>\n<th>a b</th>\n<th></th>\n<th></th>\n</tr></thead><tbody>\n<tr>\n<td>&lt;c&gt;</td>\n<td>d</td>\n<td>e</td>\n</tr>\n</tbody></table>'


def _illustrated(tabs: str, figs: str) -> str:
    return f"""
tabs as ({tabs}),
figs as ({figs}),
ts as (select doc_id, '\n<div class="figuras-finales">\n<h2 style="text-align:center;font-size:10pt;font-weight:700;margin-bottom:14px;">Tablas</h2>\n' || string_agg('\n<div class="tabla-wrapper">\n<p class="tabla-titulo"><strong>Tabla ' || tab_no || '.</strong> ' || {esc("case when titulo <> '' then titulo else 'Tabla ' || tab_no end")} || '</p>\n{_GRID_HTML}\n</div>\n\n', '' order by tab_no) || '</div>\n' as ts from tabs group by doc_id),
fs as (select doc_id, string_agg('\n<figure id="fig' || fig_no || '" style="margin:18px auto;text-align:center;">\n  <img src="data:image/' || case when path like '%png' then 'png' else 'jpeg' end || ';base64,eA==" alt="Figura ' || fig_no || '" style="max-width:60%;max-height:420px;border:1px solid #bbb;">\n  <figcaption style="font-size:9pt;color:#1a1a1a;margin-top:5px;text-align:left;">' || '<strong>Figura ' || fig_no || '.</strong>' || case when pie <> '' then ' ' || {esc('pie')} else '' end || '</figcaption>\n</figure>\n', '' order by fig_no) as fs from figs group by doc_id),
shown as (select p.doc_id, title, replace(html, '</article>', coalesce(ts, '') || coalesce(fs, '') || '</article>') as html from pages_ p left join ts on ts.doc_id = p.doc_id left join fs on fs.doc_id = p.doc_id),
"""


def oracle_sql() -> dict[str, str]:
    chained = lambda ctes, body: "with " + ctes.strip().rstrip(",") + " " + body
    paragraphs = _EMBEDDED + _SPLIT + _FUSE.replace("from kept)", "from parts)").replace("p1 as (", "fp as (").replace("from p1 ", "from fp ").rstrip() + ","
    page = paragraphs + _PAGE
    parts = more.oracle_sql()
    of_scans = parts["document_paragraphs"]
    scans = of_scans[len("with ") : of_scans.rindex(" select doc_id, cast(kind")] + ","
    tabs, figs = (parts[n].replace(_PAGES.lstrip(), _SCANS.lstrip()) for n in ("pdf_tables", "pdf_figures"))
    return {
        "jats_articles": chained(paragraphs + _article(parts["pdf_tables"]), "select doc_id, jats from articles"),
        "document_articles": chained(scans + _article(tabs, figs), "select doc_id, jats from articles"),
        "document_pages": chained(scans + _PAGE + _illustrated(tabs, figs), "select doc_id, title, html from shown"),
        "html_pages": chained(page, "select doc_id, title, html from pages_"),
        "book_texts": chained(page + _BOOK, "select x2.doc_id, title, body, 'p{}' as css, coalesce(sections, '') as sections, case when x2.doc_id % 4 = 0 then 'Ruiz,  Ana|Luz María Paz' end as authors, doi from x2 join heads on heads.doc_id = x2.doc_id"),
    }
