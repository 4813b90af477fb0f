"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged: elements with equal paths of tags and classes are one node. A leaf node's
importance is one less the mean entropy of its contents over the pages that have it (contents that every page
repeats have entropy 1), an inner node's that of its presentations, the sequences of its children, and its
leaves' weighed by pages: (1 - DECAY ** l) of its own, l the number of presentations, the rest theirs. Branches
below LEAST are removed from each page of the host, unless nothing would be left of it. Pages of equal blocks are
copies and count as one page.

Few pages are little evidence: a node seen on m distinct pages of a host counts as if PRIOR more, on which it was of full
importance, stood beside them ((m - 1) against PRIOR).

Tags and whole names that mean a role are decided beforehand: navigation, adverts, forms and the like go, and the
flow text of an article is no node that can go whole; a page with an article or main element has its text there.
In there entropy decides on each content of a leaf: one that so many of the host's distinct pages have that its
importance, one less its entropy over these, is below INSIDE goes, headings and cells of tables and definition lists
excepted; INSIDE_PRIOR pages stand against that. Entropy decides on all other nodes.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, mapped, session

DECAY, LEAST, INSIDE = 0.9, 0.4, 0.1
PRIOR, INSIDE_PRIOR = 3.0, 2.0
#: Removed paths of all hosts that are sent to every task, in bytes; more are joined by host.
SENT_BYTES = 32 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_HOLDS = re.compile(r"<(?:article|main)[\s>]", re.I)
_NAMES = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW = {"script", "style", "template", "noscript", "textarea", "title", "svg", "iframe", "select", "annotation", "annotation-xml", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= set("math semantics mrow mi mo mn ms mtext mspace msub msup msubsup munder mover munderover mmultiscripts mprescripts mfrac msqrt mroot mstyle mpadded mphantom menclose merror mtable mtr mtd maction".split())
NOISE_TAGS = {"head", "nav", "header", "footer", "aside", "form", "dialog", "menu", "button", "fieldset", "optgroup", "option"} | RAW
NOISE_NAMES = set(
    "nav navbar navigation menu header footer sidebar aside ad ads advert advertisement adsense sponsor sponsored promo banner "
    "cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription share sharing social "
    "related recommended breadcrumb breadcrumbs comment comments reply replies respond disqus form login signup search "
    "pagination pager toolbar widget complementary contentinfo".split()
)
HOLDERS = {"html", "body", "article", "main"}
FLOW = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table thead tbody tfoot tr td th caption figure figcaption div section hgroup details summary address hr".split())
KEPT = {"h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "dt", "dd", "caption", "figcaption", "pre"}
_WITHIN = r"/(?:article|main)(?:[./]|$)"
_CLOSES_P = FLOW | {"article", "main", "nav", "aside", "header", "footer", "form", "fieldset"}
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


def _noise(tag: str, attrs: str) -> tuple[bool, bool, str]:
    """Whether an element's tag or state makes it no content, whether a name of it does, and its name in paths.
    Only whole names count, and none of those that hold the page or its text."""
    bad, named, label = tag in NOISE_TAGS, False, tag
    if attrs and not attrs.isspace():
        for name, value in _NAMES.findall(attrs):
            name, value = name.lower(), value.strip("\"' ").lower()
            if name in ("class", "id", "role"):
                named = named or tag not in HOLDERS and any(v in NOISE_NAMES for v in value.split())
                if name == "class":
                    label = f"{tag}.{'.'.join(sorted(value.split()))}"
            elif tag not in ("html", "body") and (name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value)):
                bad = True
    return bad, named, label


def _end(html: str, tag: str, at: int) -> int:
    """Where the element that was opened before at ends, inner ones of its tag counted; -1 if it doesn't."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?:\s[^>]*)?(/?)>", re.I).finditer(html, at):
        if m[1]:
            depth -= 1
            if not depth:
                return m.end()
        elif not m[2]:
            depth += 1
    return -1


def parse(html: str) -> tuple[list[tuple], dict[str, list[str]], bool]:
    """Blocks (path, text, noise, in an article or main, protected) in page order; children of each path; whether
    there is an article or main outside noise. Where all of them are in branches of a telling name, the names of those
    branches do not count. Inline tags belong to their block, which ends where a block's tag begins or ends;
    unclosed elements end with their parent."""
    blocks, children, stack, buf, at, n = [], defaultdict(list), [], [], 0, len(html)
    has_main = False
    root = ("", "", False, False, False, ())  # tag, path, noise, inside main, protected, branches of a telling name
    top, names, held = root, 0, set()

    def flush():
        text = " ".join(unescape("".join(buf)).split())
        buf.clear()
        if text:
            blocks.append((top[1], text, top[2], top[3], top[4], top[5]))

    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            buf.append(html[at:])
            break
        if m.start() > at:
            buf.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, attrs = tag.lower(), m[3]
        if m[1]:
            if tag in INLINE:
                continue
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    top = stack[-1] if stack else root
                    break
            continue
        if tag in RAW:
            end = None if tag == "svg" and attrs.endswith("/") else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            if end:
                at = end.end()
            elif tag in ("script", "style") and not attrs.endswith("/"):  # what follows is code
                at = n
            if tag != "svg":
                buf.append(" ")
            continue
        if tag in ("br", "hr", "img", "wbr"):
            if tag == "hr":
                flush()
            elif tag == "br":
                buf.append(" ")
            continue
        if tag in VOID:
            continue
        bad, named, label = _noise(tag, attrs)
        if tag in INLINE and not (bad or named):
            continue
        if tag in INLINE:  # an inline element of a telling name, as a span of class advert, is a branch of its own
            end = _end(html, tag, at)
            if end >= 0 and not _HOLDS.search(html, at, end):
                at = end
            continue
        flush()
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] not in FLOW or stack[i][0] in ("td", "th", "li", "div", "section"):
                    break
        if tag in _SIBLINGS:
            same, stop = _SIBLINGS[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in stop:
                    break
                if stack[i][0] in same:
                    del stack[i:]
                    break
        if tag == "body":  # what head left open ends here
            stack = [x for x in stack if x[0] == "html"]
        up = stack[-1] if stack else root
        kids = children[up[1]]
        if not kids or kids[-1] != label:
            kids.append(label)
        bad, within = bad or up[2], up[5]
        if named:
            names += 1
            within = (*within, names)
        main = tag in ("article", "main") and not bad
        has_main = has_main or main and not within
        if main:
            held.update(within)
        inside = up[3] or main
        keep = main or up[4] and label in FLOW and tag in FLOW and tag not in ("div", "section")
        top = (tag, f"{up[1]}/{label}", bad, inside, keep, within)
        stack.append(top)
        if attrs.endswith("/") and tag not in FLOW:
            stack.pop()
            top = stack[-1] if stack else root
    flush()
    if has_main:
        held.clear()
    return [(b[0], b[1], b[2] or not held.issuperset(b[5]), b[3], b[4]) for b in blocks], children, has_main


def host(url):
    """The host of a URL in lower case without port; a null or other text is the host ''."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.$", ""), F.lit(""))


_SEEN = "host string, page string, seen array<struct<path:string,leaf:boolean,content:string,v:bigint>>"


def _observe(batches):
    """(host, page, seen): a hash of the page's blocks, and how often it has each content of a leaf and each
    presentation of an inner node; an empty content stands for the node itself."""
    for b in batches:
        pages, rows = [], []
        for html in b.column("html").to_pylist():
            blocks, children, _ = parse(html)
            pages.append(hashlib.md5("\n".join(f"{path}\t{text}" for path, text, noise, _, _ in blocks if not noise).encode("utf-8", "surrogatepass")).hexdigest())
            seen = defaultdict(int)
            for path, text, noise, _, _ in blocks:
                if not noise:
                    seen[path, True, str(hash_text(text))] += 1
                    seen[path, True, ""] = 1
            for path, kids in children.items():
                seen[path, False, str(hash_text("|".join(kids)))] += 1
                seen[path, False, ""] = 1
            rows.append([{"path": p, "leaf": leaf, "content": c, "v": v} for (p, leaf, c), v in seen.items()])
        kind = pa.list_(pa.struct([("path", pa.string()), ("leaf", pa.bool_()), ("content", pa.string()), ("v", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(pages, pa.string()), pa.array(rows, kind)], ["host", "page", "seen"])


def hash_text(t: str) -> int:
    import zlib

    raw = t.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 32 | zlib.adler32(raw)


def observed(pages: DataFrame) -> DataFrame:
    """(host, path, leaf, content, c, l) over the distinct pages of each host: c the sum of the counts of a
    content, l that of c ln c. Pages of equal blocks are copies and count once. pages: host, html."""
    once = mapped(pages, _observe, _SEEN).dropDuplicates(["host", "page"])
    flat = once.select("host", F.explode("seen").alias("x")).select("host", "x.*")
    return flat.groupBy("host", "path", "leaf", "content").agg(F.sum("v").alias("c"), F.sum(F.col("v") * F.log("v")).alias("l"))


def importance(seen: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of the nodes of each host's style tree. seen: see observed()."""
    # entropy of a leaf's content over pages to the base of their number: (ln c - l / c) / ln m
    node = seen.groupBy("host", "path", "leaf").agg(
        F.max(F.when(F.col("content") == "", F.col("c"))).alias("m"),
        F.avg(F.when((F.col("content") != "") & F.col("leaf"), F.log("c") - F.col("l") / F.col("c"))).alias("spread"),
        F.sum(F.when(F.col("content") != "", F.col("c") * F.log("c"))).alias("clogc"),
        F.sum(F.when(F.col("content") != "", F.col("c"))).alias("n"),
        F.sum(F.when(F.col("content") != "", 1)).alias("k"),
    )
    ln = F.log(F.greatest("m", F.lit(2)).cast("double"))
    leaf = node.where("leaf").select("host", "path", "m", F.greatest(F.lit(0.0), 1 - F.col("spread") / ln).alias("own"))
    style = node.where("not leaf").select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("m").alias("pm"), (F.greatest(F.lit(0.0), F.log("n") - F.col("clogc") / F.col("n")) / ln).alias("shape"), (1 - F.pow(F.lit(DECAY), F.col("k"))).alias("part"))
    up = F.expr("transform(sequence(1, size(split(path, '/')) - 1), i -> array_join(slice(split(path, '/'), 1, i + 1), '/'))")
    below = leaf.withColumn("p", F.explode(up)).groupBy("host", "p").agg((F.sum(F.col("own") * F.col("m")) / F.sum("m")).alias("below"), F.max("m").alias("m"))
    both = below.join(style.withColumnRenamed("p", "q"), (F.col("host") == F.col("h")) & (F.col("p") == F.col("q")), "left")
    value = F.when(F.col("shape").isNull(), F.col("below")).otherwise(F.col("part") * F.greatest("shape", "below") + (1 - F.col("part")) * F.col("below"))
    pages = F.coalesce("pm", "m")
    return both.select("host", F.col("p").alias("path"), pages.alias("pages"), (1 - _evidence(pages, PRIOR) * (1 - value)).alias("importance"))


def _evidence(pages, prior: float):
    return (pages - 1) / (pages - 1 + prior)


def repeated(seen: DataFrame) -> DataFrame:
    """(host, path, content) of leaves in an article or main that most of a host's distinct pages have."""
    own = seen.where(F.col("leaf") & (F.col("content") != "") & (F.col("c") > 1) & F.col("path").rlike(_WITHIN))
    own = own.where(~F.regexp_extract("path", r"([^./]+)[^/]*$", 1).isin(*KEPT))
    pages = seen.where("not leaf and path = '' and content = ''").select(F.col("host").alias("h"), F.col("c").alias("m")).where("m > 1")
    entropy = (F.log("c") - F.col("l") / F.col("c")) / F.log("m")
    return own.join(pages, F.col("host") == F.col("h")).where(1 - _evidence(F.col("m"), INSIDE_PRIOR) * entropy < INSIDE).select("host", "path", "content")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page.

    Null html is empty; a null url, or one without a host, is of the host ''. A page without main text has the
    empty one. Repeated rows are kept. Rows of a large host spread over tasks: its statistics are sums, combined
    before the shuffle, copies of a page too, and its removed paths are sent to all tasks up to SENT_BYTES, beyond that
    joined to pages by host, where Spark splits the skewed side. Further columns are ignored."""
    spark = pages.sparkSession
    session(spark)
    scratch = Scratch(spark)
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), host(F.col("url")).alias("host"))
    seen = scratch.keep(observed(p.select("host", "html")), "seen")
    low = importance(seen).where(F.col("importance") < LEAST)
    low = low.select("host", "path").union(repeated(seen).select("host", F.concat_ws("\n", "path", "content")))
    low = scratch.keep(low.groupBy(F.col("host").alias("h")).agg(F.collect_set("path").alias("low")), "low")
    scratch.drop("seen")
    sent = low.agg(F.sum(F.expr("aggregate(low, 0L, (a, x) -> a + length(x) + 16)"))).first()[0] or 0
    low = F.broadcast(low) if sent <= SENT_BYTES else low
    kind = dict(pages.dtypes)["page_id"]

    def extract(batches):
        for b in batches:
            out = []
            for html, low in zip(b.column("html").to_pylist(), b.column("low").to_pylist()):
                blocks, _, has_main = parse(html)
                gone = set(low or ())
                kept, every = [], []
                for path, text, noise, inside, protected in blocks:
                    if noise or has_main and not inside:
                        continue
                    every.append(text)
                    if gone and f"{path}\n{hash_text(text)}" in gone:
                        continue
                    if gone and not protected:
                        # branches below the nearest article or main, or below body
                        names = path.split("/")
                        start = max([i for i, x in enumerate(names) if x.split(".")[0] in ("html", "body", "article", "main")], default=0)
                        if any("/".join(names[: i + 1]) in gone for i in range(start + 1, len(names))):
                            continue
                    kept.append(text)
                out.append("\n".join(kept or every))  # no page consists of boilerplate alone
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = p.join(low, F.col("host") == F.col("h"), "left").select("page_id", "url", "html", "low")
    return mapped(joined, extract, f"page_id {kind}, url string, text string, n_chars long")
