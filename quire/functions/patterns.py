"""Word lists, label names and patterns of the document model."""

# fixed values: labels
CUERPO, TITULO, TITULO2 = "Cuerpo", "Título principal", "Título secundario"
SECCION, SUB, SUB2 = "Encabezado sección", "Subencabezado", "Subencabezado-bajo"
CLAVE, CITAR, FECHA = "Palabras clave", "Cómo citar", "Fecha manuscrito"
TABLA, FIGURA, FILIACION, EMAIL = "Título tabla", "Pie de figura", "Filiación", "Email / Metadatos"
ABSTRACT_BODY = "Cuerpo del abstract"
IGNORAR, AUTORES, NORMAL, RESUMEN, REFERENCIA, IMAGEN = "Ignorar", "Autores", "Normal", "Resumen / Abstract", "Referencia", "Imagen"

# fixed values: section names of front and back matter (lower case)
SECTIONS = [
    "resumen", "abstract", "resumen no técnico", "non-technical abstract", "palabras clave", "keywords", "introducción", "introduction",
    "conclusiones", "conclusions", "referencias", "references", "agradecimientos", "acknowledgements", "discusión", "discussion",
    "metodología", "methods", "resultados", "results", "contribuciones de los autores", "contribucción de autores",
    "authors' contribution", "conflicto de intereses", "conflict of interest", "conflicts of interest", "competing interests",
    "paleontología sistemática", "systematic palaeontology",
]
# fixed values: section names of the body zone (lower case)
BODY_SECTIONS = [
    "resumen", "abstract", "resumen no técnico", "non-technical abstract", "palabras clave", "keywords", "referencias", "references",
    "conclusiones", "conclusions", "agradecimientos", "acknowledgements", "acknowledgments", "discusión", "resultados", "introducción",
    "metodología", "contribuciones de los autores", "contribucción de autores", "contribución de autores", "authors' contribution",
    "conflicto de intereses", "conflict of interest", "conflicts of interest", "competing interests", "declaración de conflictos",
]
# fixed values: headings that may run on in a block, in the order they are looked for
EMBEDDED = [
    "Non-technical Abstract", "Non-Technical Abstract", "Resumen no técnico", "Resumen no Técnico", "Acknowledgments", "Acknowledgements",
    "Agradecimientos", "Conflicts of interest", "Conflict of interest", "Competing interests", "Conflicto de intereses",
    "Authors' Contribution", "Contribuciones de los autores", "Contribucción de autores", "Contribucción de Autores", "Contribución de Autores",
]
# fixed values: accent-free headings of a body section
BODY_HEADINGS = [
    "introduccion", "material y metodos", "materiales y metodos", "resultados", "resultados y discusion", "discusion", "conclusiones",
    "agradecimientos", "conflicto de intereses", "contribuciones de los autores",
]
# fixed values: labels that stand alone, and labels that pass a paragraph by
ALONE = [TITULO, TITULO2, AUTORES, FILIACION, EMAIL, CITAR, FECHA, SECCION, SUB, CLAVE, REFERENCIA]
PASSING = [IMAGEN, IGNORAR, FIGURA, TABLA]
# fixed values: labels that end a table
TABLE_ENDS = [SUB, SUB2, SECCION, CITAR, FECHA]

# fixed values: patterns valid in Java and RE2
CITE_NUMBERS = r",\s*\d+\s*\(\d+\)\s*,\s*\d+\s*[–\-]\s*\d+"
MANUSCRIPT = r"(manuscrito\s+recibido|manuscrito\s+corregido|manuscrito\s+aceptado|manuscript\s+received|manuscript\s+revised|manuscript\s+accepted)"
KEYWORDS = r"^(palabras\s+clave|keywords)\s*[:.]"
TABLE_TITLE = r"^(tabla|table)\s+\d+[.:\s]"
FIGURE_TITLE = r"^(figura|figure)\s+\d+[.:\s]"
#: Inside brackets: what a word is made of, in any script.
WORD = r"\p{L}\p{N}_"
HAS_EMAIL = rf"@[{WORD}.\-]+\.[{WORD}]{{2,}}"
EMAIL_ANY = rf"[{WORD}.\-+%]+@[{WORD}.\-]+\.[{WORD}]{{2,}}"
LEVEL1, LEVEL2 = r"^\d+\.\s*\S", r"^\d+\.\d+"
YEAR_ROW = r"^(18|19|20)\d\d\s+\S"
TAXON_LIST = r"^(18|19|20)\d\d\s+[A-Za-zÁÉÍÓÚÑáéíóúñü\-]+(\s+[A-Za-zÁÉÍÓÚÑáéíóúñü\-]+){0,4}\s*;"
REF_PREFIX = r"^\s*\[?\d+[.)\]]\s*"
ORCID = r"\d{4}-\d{4}-\d{4}-\d{3}[\dX]"
ISSN = r"\b\d{4}-\d{3}[\dXx]\b"
DOI_URL = r"https?://doi\.org/(\S+)"
PAGES = r"(\d+)\s*[–-]\s*(\d+)"
FIGURE_PREFIX = r"^(figura|fig\.?|figure)\s*\d+[a-z]?(\s*-\s*[a-z])?[.):]?\s*"
CAPTION = r"^\s*(figura|fig\.?|figure|table|tabla)\s*\d+[a-z]?(\s*-\s*[a-z])?[.):]?\s*"
ABSTRACT_HEADING = r"^(resumen|abstract|resumen no tecnico|non-technical abstract)\s*[:.]?$"
BOLD_FONT, ITALIC_FONT = "bold|black|heavy|semibold|demi", "italic|oblique|kursiv"
HEADER_TEXT = r"^(https?://doi\.org/|doi\.org/|\d{1,3}$|paleontolog[íi]a mexicana\s+vol\.)"

# fixed values: further patterns of marks, institutions, citations and numbers
LETTERED = r"^[a-zA-Z]{1,3}\s+[A-ZÁÉÍÓÚÑÜ][a-zA-ZÁÉÍÓÚÑÜáéíóúñü]"
NUMBERED = r"^(\d+|[a-zA-Z])\s+[A-ZÁÉÍÓÚÑÜ]"
INSTITUTION = r",|\b(university|instituto|department|lab|center|centre|museum|college|faculty|school|national|natural)\b"
TABLE_INSIDE = r"((tabla|table)\s+\d+[.:\s][^\n]{0,200})"
TABLE_PREFIX = r"^(tabla|table)\s*\d+[a-z]?(\s*-\s*[a-z])?[.):]?\s*"
CITED_YEAR = r"\((\d{4}(?:[,\s]+[^)]+)?|in press|en prensa)\)\.\s*"
CITED_DOI, CITED_URL = r"https?://doi\.org/(\S+?)[.\s]*$", r"(https?://\S+?)[.\s]*$"
VOLUME_ISSUE_PAGES, VOLUME_PAGES = r",\s*(\d+)\s*\((\d+)\)\s*,\s*(.+)$", r",\s*(\d+)\s*,\s*(.+)$"
YEAR = r"\b(19|20)\d{2}\b"
PAGE_RANGE = r"(?i)\bp\.\s*(\d+)\s*[–\-]\s*(\d+)\b"
VOLUME_NUMBER = r"[Vv]olumen?\s*(\d+)[,\s]+n[úu]m\.?\s*(\d+)|[Vv]ol\.?\s*(\d+)[,\s]+n[úu]m\.?\s*(\d+)|[Vv]ol\.?\s*(\d+)[,\s(]+[Nn]o\.?\s*(\d+)|\bv\.?\s*(\d+)[,\s(]+(\d+)\)"
VOLUME_ONLY = r"[Vv]olumen?\s*(\d+)|[Vv]ol\.?\s*(\d+)"
NUMBER_ONLY = r"n[úu]m\.?\s*(\d+)|[Nn]o\.?\s*(\d+)|[Nn]°\.?\s*(\d+)"
# fixed values: editorial tags, each with its full stop
EDITORIAL = (
    r"Sinonimia\.|Material(?: examinado)?\.|Referred material\.|Descripción\.|Description\.|Etología\.|Especie tipo\.|Type species\.|"
    r"Medidas\.|Dimensions\.|Distribución\.|Occurrence\.|Otras localidades\.|Other occurrences\.|Discusión\.|Remarks\.|Comentarios\.|"
    r"Comments\.|Repositorio\.|Repository\.|Localidad\.|Locality\.|Nuevo registro\.|Horizonte\.|Horizonte y localidad\.|Horizon and locality\."
)
# fixed values: labels of manuscript dates
DATE_TYPES = {"recibido": "received", "received": "received", "corregido": "rev-recd", "revised": "rev-recd", "aceptado": "accepted", "accepted": "accepted"}
# fixed values: media types of figures by extension
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp"}
FIGURE_FILES = ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tiff"]
# fixed values: headings of a page by style (lower case)
RULED = [
    "resumen", "abstract", "resumen no técnico", "non-technical abstract", "referencias", "references", "contribuciones de los autores",
    "contribución de autores", "contribucción de autores", "author contribution", "author contributions", "authors' contribution",
    "agradecimientos", "acknowledgements", "acknowledgments", "conflicto de intereses", "conflict of interest", "conflicts of interest", "competing interests",
]
ABSTRACTS = ["resumen", "abstract", "resumen no técnico", "non-technical abstract"]
META_HEADING = (
    r"issn|volumen\s+\d|vol\.\s*\d|núm\.\s*\d|p\.\s*\d{2,}|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|"
    r"diciembre|january|february|march|april|june|july|august|september|october|november|december|\(\d{4}\)"
)
PAGE_EMAIL = rf"[{WORD}.\-]+@[{WORD}\-.]+\.[{WORD}]{{2,}}"
AUTHOR_TAIL = r"[\d,*\u00b9\u00b2\u00b3\u2070-\u209f]+$"
ORCID_HOME, ORCID_SEARCH = "https://orcid.org/", "https://orcid.org/orcid-search/search?searchQuery="
# fixed values: namespaces and document type of articles
NAMESPACES = {"ali": "http://www.niso.org/schemas/ali/1.0/", "xsi": "http://www.w3.org/2001/XMLSchema-instance", "xlink": "http://www.w3.org/1999/xlink", "mml": "http://www.w3.org/1998/Math/MathML"}
DOCTYPE = '<!DOCTYPE article PUBLIC "-//NLM//DTD JATS (Z39.96) Journal Publishing DTD v1.1 20151215//EN" "https://jats.nlm.nih.gov/publishing/1.1/JATS-journalpublishing1.dtd">'

# fixed values: month names
MONTHS = {
    "enero": "1", "febrero": "2", "marzo": "3", "abril": "4", "mayo": "5", "junio": "6", "julio": "7", "agosto": "8",
    "septiembre": "9", "octubre": "10", "noviembre": "11", "diciembre": "12", "january": "1", "february": "2", "march": "3",
    "april": "4", "may": "5", "june": "6", "july": "7", "august": "8", "september": "9", "october": "10", "november": "11", "december": "12",
}
# fixed values: forms of dates: month day year, day month year, numbers
DATES = (r"([A-Za-záéíóúñÁÉÍÓÚÑ]+)\s+(\d{1,2})[,\s]+(\d{4})", r"(\d{1,2})\s+de\s+([A-Za-záéíóúñ]+)\s+de\s+(\d{4})", r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})")
# fixed values: countries looked for in an affiliation: accent-free key, name, code
COUNTRIES = {
    "espana": ("Espana", "ES"), "spain": ("Spain", "ES"), "chile": ("Chile", "CL"), "mexico": ("Mexico", "MX"), "colombia": ("Colombia", "CO"),
    "argentina": ("Argentina", "AR"), "venezuela": ("Venezuela", "VE"), "peru": ("Peru", "PE"), "ecuador": ("Ecuador", "EC"),
    "uruguay": ("Uruguay", "UY"), "bolivia": ("Bolivia", "BO"), "costa rica": ("Costa Rica", "CR"), "panama": ("Panama", "PA"),
    "paraguay": ("Paraguay", "PY"), "el salvador": ("El Salvador", "SV"), "nicaragua": ("Nicaragua", "NI"), "cuba": ("Cuba", "CU"),
    "united states": ("United States", "US"), "estados unidos": ("Estados Unidos", "US"), "usa": ("United States", "US"),
    "united kingdom": ("United Kingdom", "GB"), "reino unido": ("Reino Unido", "GB"), "francia": ("Francia", "FR"), "france": ("France", "FR"),
    "australia": ("Australia", "AU"), "dinamarca": ("Dinamarca", "DK"), "denmark": ("Denmark", "DK"), "china": ("China", "CN"),
    "polonia": ("Polonia", "PL"), "poland": ("Poland", "PL"), "iran": ("Iran", "IR"), "canada": ("Canada", "CA"), "alemania": ("Alemania", "DE"),
    "germany": ("Germany", "DE"), "brasil": ("Brasil", "BR"), "brazil": ("Brazil", "BR"), "italia": ("Italia", "IT"), "italy": ("Italy", "IT"),
    "portugal": ("Portugal", "PT"), "islandia": ("Islandia", "IS"), "iceland": ("Iceland", "IS"),
}
# fixed values: codes of countries that are the last part of an affiliation, accent-free
CODES = {
    "spain": "ES", "chile": "CL", "mexico": "MX", "colombia": "CO", "argentina": "AR", "venezuela": "VE", "peru": "PE",
    "ecuador": "EC", "uruguay": "UY", "bolivia": "BO", "costa rica": "CR", "guatemala": "GT", "honduras": "HN", "panama": "PA",
    "paraguay": "PY", "el salvador": "SV", "nicaragua": "NI", "republica dominicana": "DO", "cuba": "CU", "united states": "US",
    "estados unidos": "US", "united kingdom": "GB", "reino unido": "GB", "francia": "FR", "france": "FR", "australia": "AU",
    "dinamarca": "DK", "denmark": "DK", "china": "CN", "polonia": "PL", "poland": "PL", "iran": "IR", "canada": "CA",
}
#: A month and a year at most 30 characters later: the period of a publication.
PERIOD = r"(?iu)(enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre|january|february|march|april|may|june|july|august|september|october|november|december).{1,30}(\d{4})"
