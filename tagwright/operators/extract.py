"""Article extraction from raw HTML, XML and RTF (X1-X7, S3 helpers).

The original parses one file at a time with DOM libraries. Here each
extractor is a column expression over the raw markup, so extraction is a
map-only stage over a table of raw files and parallelises with the input
splits. Elements are found and removed by a fold over the markup cut at the
tags of interest, which counts their depth: nested elements end where a DOM
parser ends them, an element without an end tag reaches to the end. The fold
goes in blocks, so its time is linear in the elements of a page. Quoted
attribute values may hold ``>``; scripts and styles hold no elements. XML uses
Spark's ``xpath``.
"""

from __future__ import annotations

import html.entities
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS_CLASS, fold_blocks
from ..functions.text import once as _once


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _character(code: Column) -> Column:
    """The character of a numeric reference; 80-9F (hex) mean code page 1252."""
    bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF) | code.isNull()
    text = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, 0xFFFD).otherwise(code)), 8, "0")), "UTF-32")
    return F.translate(text, _C1, CP1252_HIGH)


def decode_entities(t: Column) -> Column:
    """Character references, named (HTML 4) and numeric, once each: ``&amp;lt;``
    gives ``&lt;``. Unknown names stay as they are."""
    names = dict(html.entities.name2codepoint) | {"apos": 39}
    named = F.create_map(*[F.lit(x) for n, c in sorted(names.items()) for x in (n, chr(c))])

    def piece(x: Column, i: Column) -> Column:
        ref = F.regexp_extract(x, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        number = F.when(ref.rlike("^#[xX]"), F.conv(F.substring(ref, 3, 8), 16, 10)).otherwise(F.substring(ref, 2, 8))
        char = F.when(ref.startswith("#"), _character(number.try_cast("int"))).otherwise(F.try_element_at(named, ref))
        known = F.concat(char, F.substring(x, F.length(ref) + 2, 1 << 30))
        return F.when(i == 0, x).otherwise(F.coalesce(F.when(ref != "", known), F.concat(F.lit("&"), x)))
    return F.when(t.contains("&"), F.array_join(F.transform(F.split(t, "&", -1), piece), "")).otherwise(t)


# The rest of a tag: a value in quotes after ``=`` may hold any character.
TAG_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>"""


def strip_tags(t: Column) -> Column:
    return F.regexp_replace(t, r"(?s)<!--.*?-->|<" + TAG_REST, "")


# HTML's implied end of a paragraph (public HTML parsing rules): a <p> ends
# at </p>, at the start tag of any of these block elements, or at the end of
# its container -- as a DOM parser such as lxml builds it.
P_CLOSERS = ["address", "article", "aside", "blockquote", "dd", "details", "div", "dl", "dt",
             "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
             "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre",
             "section", "table", "ul"]
P_OPEN = r"(?i)<p(?=[\s>])" + TAG_REST
P_END = r"(?is)(?:</p\s*>|<(?:" + "|".join(P_CLOSERS) + r")(?:[\s/>]|$)).*"


@dataclass(frozen=True)
class Node:
    """Elements of a tag, with an id, a class (one of the element's classes,
    or, with blanks, all of them as written), or any further pattern that the
    attributes contain."""
    tag: str
    id: str | None = None
    cls: str | None = None
    attr: str | None = None

    def opening(self) -> str:
        """Pattern of the opening tag at the start of a piece."""
        want = ""
        if self.id is not None:
            want += rf"""(?=[^>]*\sid\s*=\s*(?:"{self.id}"|'{self.id}'|{self.id}(?=[\s>])))"""
        if self.cls is not None:
            own = self.cls if " " in self.cls else rf"""(?:[^"'>]*\s)?{self.cls}(?:\s[^"'>]*)?"""
            want += rf"""(?=[^>]*\sclass\s*=\s*(?:"{own}"|'{own}'|{self.cls}(?=[\s>])))"""
        if self.attr is not None:
            want += rf"(?=[^>]*{self.attr})"
        return rf"(?is)^<{self.tag}(?=[\s/>]){want}" + TAG_REST


def _without_scripts(markup: Column) -> Column:
    return F.regexp_replace(markup, r"(?is)<(script|style)(?=[\s/>])" + TAG_REST + r".*?</\1\s*+>", "")


def _cut(markup: Column, tags: Sequence[str]) -> Column:
    """The markup, without comments, scripts and styles (whose content is no
    markup), cut before each start and end of ``tags``."""
    plain = _without_scripts(F.regexp_replace(markup, r"(?s)<!--.*?-->", ""))
    return F.split(plain, r"(?i)(?=</?(?:" + "|".join(tags) + r")(?=[\s/>]))", -1)


def find(markup, node: Node, every: bool = False) -> Column:
    """Inner markup of the first element of ``node``, or of every outermost
    one, concatenated; null when there is none."""
    if node.tag == "p":
        return _find_paragraphs(_c(markup), node, every)
    start, stop = rf"(?i)^<{node.tag}(?=[\s/>])", rf"(?i)^</{node.tag}(?=[\s/>])"

    def step(acc: Column, x: Column) -> tuple[dict, Column]:
        opens, closes, inside = x.rlike(start), x.rlike(stop), acc["depth"] > 0
        enters = ~inside & x.rlike(node.opening())
        if not every:
            enters = enters & ~acc["found"]
        depth = (F.when(enters, 1).when(inside & opens, acc["depth"] + 1).when(inside & closes, acc["depth"] - 1)
                 .otherwise(acc["depth"]))
        kept = F.when(enters, F.regexp_replace(x, node.opening(), "")).when(inside & (depth > 0), x)
        return {"depth": depth.cast("int"), "found": acc["found"] | enters}, kept

    folded = fold_blocks(_cut(_c(markup), [node.tag]), {"depth": F.lit(0), "found": F.lit(False)}, step, "string")
    return _once(folded, lambda r: F.when(r["found"], F.array_join(r["out"], "")))


def _find_paragraphs(markup: Column, node: Node, every: bool) -> Column:
    pieces = F.filter(_cut(markup, ["p"]), lambda x: x.rlike(node.opening()))
    inner = F.transform(pieces, lambda x: F.regexp_replace(F.regexp_replace(x, node.opening(), ""), P_END, ""))
    return _once(inner, lambda a: F.when(F.size(a) > 0, F.array_join(a, "") if every else a[0]))


def find_path(markup, path: Sequence[Node], every: bool = False) -> Column:
    """Elements within elements: the first of each node, ``every`` one of the last."""
    out = _c(markup)
    for node in path[:-1]:
        out = find(out, node)
    return find(out, path[-1], every)


def container(html_, tag: str, attr_pattern: str = "") -> Column:
    """Inner markup of the first ``<tag ...>``; null when absent.
    ``attr_pattern`` restricts the opening tag (e.g. ``class="ad"``)."""
    return find(html_, Node(tag, attr=attr_pattern or None))


def remove(markup, nodes: Sequence[Node], first_only: bool = False, residue: str = "") -> Column:
    """The markup without the elements of ``nodes`` (only the first one found,
    with ``first_only``); ``residue`` is put in their place."""
    paragraphs, others = [n for n in nodes if n.tag == "p"], [n for n in nodes if n.tag != "p"]
    out = _c(markup)
    for n in paragraphs:
        out = _remove_paragraphs(out, n, first_only)
    if not others:
        return out
    tags = sorted({n.tag for n in others})
    name = r"^</?([a-zA-Z][a-zA-Z0-9_]*)"

    def step(acc: Column, x: Column) -> tuple[dict, Column]:
        own = F.lower(F.regexp_extract(x, name, 1))
        inside, closes = acc["depth"] > 0, x.startswith("</")
        hit = F.lit(False)
        for n in others:
            hit = hit | x.rlike(n.opening())
        enters = ~inside & hit
        if first_only:
            enters = enters & ~acc["done"]
        same = inside & (own == acc["name"])
        depth = (F.when(enters, 1).when(same & closes, acc["depth"] - 1).when(same, acc["depth"] + 1).otherwise(acc["depth"]))
        kept = (F.when(inside & (depth == 0), F.regexp_replace(x, r"(?s)^</[^>]*>?", residue)).when(~inside & ~enters, x))
        return {"depth": depth.cast("int"), "name": F.when(enters, own).otherwise(acc["name"]), "done": acc["done"] | enters}, kept

    state = {"depth": F.lit(0), "name": F.lit(""), "done": F.lit(False)}
    return F.array_join(fold_blocks(_cut(out, tags), state, step, "string")["out"], "")


def _remove_paragraphs(markup: Column, node: Node, first_only: bool) -> Column:
    end = P_END[:-2]        # without the rest of the piece, which stays

    def step(acc: Column, x: Column) -> tuple[dict, Column]:
        hit = x.rlike(node.opening())
        if first_only:
            hit = hit & ~acc["done"]
        body = F.regexp_replace(x, node.opening(), "")
        left = F.element_at(F.split(body, "(?=" + end + ")", 2), 2)
        kept = F.when(hit, F.when(body.rlike(end), F.coalesce(F.when(body.rlike("^" + end), body), left))).otherwise(x)
        return {"done": acc["done"] | hit}, kept

    return F.array_join(fold_blocks(_cut(markup, ["p"]), {"done": F.lit(False)}, step, "string")["out"], "")


def remove_nodes(html_, tags: Sequence[str] = ("div",), extra: Sequence[str] = ()) -> Column:
    """Delete whole elements of ``tags`` and any extra raw patterns
    (comments, scripts)."""
    t = _c(html_)
    for pat in extra:
        t = F.regexp_replace(t, pat, "")
    return remove(t, [Node(tag) for tag in tags])


def paragraph_text(body) -> Column:
    """Concatenate the text of every ``<p>`` with no separator (X1 core).
    The body is split at each paragraph opening; each piece is cut at its
    implied end (``P_END``), so unclosed paragraphs keep their text."""
    pieces = F.split(_without_scripts(_c(body)), P_OPEN, -1)
    paras = F.transform(F.slice(pieces, 2, 1 << 30), lambda x: F.regexp_replace(x, P_END, ""))
    return decode_entities(strip_tags(F.array_join(paras, "")))


def node_paragraphs(body) -> Column:
    """Paragraphs of a node that are in no ``div`` of it; null gives "". A
    removed ``div`` leaves the paragraph end that its start tag implies."""
    return paragraph_text(remove(F.coalesce(_c(body), F.lit("")), [Node("div")], residue="</p>"))


def html_paragraph_text(html_) -> Column:
    """The text of every paragraph of the ``article`` elements that is not
    inside a ``div``, concatenated; a missing article gives ""."""
    return node_paragraphs(find(html_, Node("article"), every=True))


def whole_text(body) -> Column:
    """All text of a node."""
    return decode_entities(strip_tags(_c(body)))


def first_present(*extractors: Column, default: str = "") -> Column:
    """The first extractor that found its container (non-null) wins."""
    return F.coalesce(*extractors, F.lit(default))


def nonblank(c: Column) -> Column:
    """``c`` when it has a non-blank character, else null (for fallbacks
    that move on when a container is present but empty)."""
    return _once(c, lambda x: F.when(~is_blank(x), x))


def is_blank(c: Column) -> Column:
    """``text.strip() == ""`` in Python terms (Unicode blanks)."""
    return F.coalesce(c, F.lit("")).rlike("(?U)^" + WS_CLASS + "*$")


def fallback_text(html_) -> Column:
    """X3 chain used for blog pages: article paragraphs, else the headline,
    else the page title, else ""."""
    return first_present(nonblank(html_paragraph_text(html_)), nonblank(whole_text(container(html_, "h1"))),
                         nonblank(whole_text(container(html_, "title"))))


@dataclass(frozen=True)
class Rule:
    """Where a source keeps its text, one of several places in order: a path of
    elements, ``every`` last one or the first; its paragraphs outside ``div``s
    or, with ``whole``, all its text without the first ``div`` (a caption)."""
    source: str
    priority: int
    path: tuple[Node, ...]
    every: bool = False
    whole: bool = False


# --- fixed values: the containers of the studied sources, by id and class
SOURCE_RULES = [
    Rule("NYT", 1, (Node("div", cls="mod-nytimesarticletext mod-articletext"),), every=True),
    Rule("NYT", 2, (Node("div", id="article"), Node("div", id="articleBody")), every=True),
    Rule("NYT", 3, (Node("div", id="article"), Node("div", cls="articleBody")), every=True),
    Rule("NYT", 4, (Node("div", id="article"), Node("p", cls="summaryText")), whole=True),
    Rule("NYT", 5, (Node("div", id="content"), Node("div", cls="entry-content"), Node("div", cls="entry-content"))),
    Rule("NYT", 6, (Node("div", id="content"), Node("div", cls="entry-content"))),
    Rule("NYT", 7, (Node("nyt_text"),)),
    Rule("LA", 1, (Node("div", id="fullTextZoneId", cls="t-zone"),)),
    Rule("LA", 2, (Node("div", id="abstractZone"),)),
    Rule("SF", 1, (Node("div", id="fontprefs_bottom"),)),
    Rule("SF", 2, (Node("td", cls="text1md"), Node("font"))),
    Rule("DMNB", 1, (Node("div", id="content"), Node("div", cls="docBody"), Node("div", cls="mainText")), whole=True),
    Rule("MIHB", 1, (Node("div", id="content"), Node("div", cls="docBody"), Node("div", cls="mainText")), whole=True),
]
# paragraphs that are no text: all of the first kind, the first of the second
SOURCE_REMOVALS = {"SF": [(Node("p", cls="dtlcomment"), False), (Node("p", id="pageno"), True)]}
# --- end of fixed values


def _rule_text(body: Column) -> Column:
    return F.when(body.isNotNull(), node_paragraphs(body))


def _rule_text_whole(body: Column) -> Column:
    return F.when(body.isNotNull(), whole_text(remove(body, [Node("div")], first_only=True)))


def source_text(source: str, html_, rules: Sequence[Rule] = SOURCE_RULES, removals=None) -> Column:
    """The text by the first rule of ``source`` whose container exists, else ""."""
    markup = _c(html_)
    for node, first_only in (SOURCE_REMOVALS if removals is None else removals).get(source, []):
        markup = remove(markup, [node], first_only)
    out = []
    for r in sorted((r for r in rules if r.source == source), key=lambda r: r.priority):
        found = find_path(markup, r.path, r.every)
        out.append(_once(found, _rule_text_whole if r.whole else _rule_text))
    return first_present(*out)


def text_by_source(article_id, html_, rules: Sequence[Rule] = SOURCE_RULES) -> Column:
    """Dispatch on the letters that the id starts with; null for a source
    without rules."""
    source = F.regexp_extract(_c(article_id), "^([A-Za-z]+)", 1)
    return dispatch_by_source(source, _c(html_), {s: source_text(s, html_, rules) for s in dict.fromkeys(r.source for r in rules)})


BOILERPLATE = dict(tags=("nav", "footer", "script", "style", "div"),
                   extra=(r"(?s)<!--.*?-->", r"(?is)<head(?:\s[^>]*)?>.*?</head>"))


def body_text(html_) -> Column:
    """Text of the page after boilerplate removal (X4 + tag stripping)."""
    body = F.coalesce(container(html_, "body"), _c(html_))
    return whole_text(remove_nodes(body, **BOILERPLATE))


def host_label(url) -> Column:
    """First label of the URL host: ``https://m.site.net/...`` -> ``m``."""
    return F.regexp_extract(_c(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^./:?#]+)", 1)


def dispatch_by_source(source: Column, html, rules: dict[str, Column]) -> Column:
    """Pick the extractor by source; an unknown source gives null (and
    is counted as not recognised by the audit)."""
    out = None
    for name, expr in rules.items():
        out = F.when(source == name, expr) if out is None else out.when(source == name, expr)
    return out


def page_text_by_host(url, html) -> Column:
    src = host_label(url)
    return dispatch_by_source(src, html, {
        "www": html_paragraph_text(html),
        "blog": fallback_text(html),
        "m": body_text(html),
    })


RECOGNISED_HOSTS = ("www", "blog", "m")


# --- X5: XML ------------------------------------------------------------------------
XML_PARA_XPATH = ("/*/txtdt/text/paragraph/text()[not(preceding-sibling::*)] | "
                  "/*/txtdt/text/paragraph/cht/text()[not(preceding-sibling::*)]")


def xml_is_wellformed(xml) -> Column:
    """True when the XML parses (malformed rows are quarantined, not fatal)."""
    parsed = F.from_xml(_c(xml), "a string, _corrupt_record string",
                        {"mode": "PERMISSIVE", "rowTag": "r",
                         "columnNameOfCorruptRecord": "_corrupt_record"})
    return F.coalesce(parsed["_corrupt_record"].isNull(), F.lit(False))


def xml_paragraph_text(xml) -> Column:
    """For every ``txtdt/text/paragraph``: its leading text, then the leading
    text of each direct ``cht`` child (tails and deeper text ignored); all
    concatenated. Null for malformed XML."""
    x = _c(xml)
    return F.when(xml_is_wellformed(x), F.array_join(F.xpath(x, F.lit(XML_PARA_XPATH)), ""))


# --- X6: RTF ------------------------------------------------------------------------
# --- fixed values: the head of a formatted run (the order of its control words
# is part of the file format), and the characters that code page 1252 puts at
# 80-9F (hex), in order; U+FFFD where it has none
RTF_RUN = r"(?s)\{\\cs[0-9]*\\lang1033\\langfe1033\\b[0-9]*\\i[0-9]*\\ul[0-9]*\\strike[0-9]*\\scaps[0-9]*\\fs[0-9]*\\afs[0-9]*\\charscalex[0-9]*\\expndtw-*[0-9]*\\cf[0-9]*\\dn[0-9]*.*?\}"  # noqa: E501
CP1252_HIGH = "€\ufffd‚ƒ„…†‡ˆ‰Š‹Œ\ufffdŽ\ufffd\ufffd‘’“”•–—˜™š›œ\ufffdžŸ"
# --- end of fixed values

_C1 = "".join(map(chr, range(0x80, 0xA0)))
_HEX_OPEN, _HEX_CLOSE = "\u0001", "\u0002"


def _byte_piece(piece: Column, i: Column) -> Column:
    # every piece after the first starts with the two hex digits of a \'hh
    byte = F.translate(F.decode(F.unhex(F.substring(piece, 1, 2)), "ISO-8859-1"), _C1, CP1252_HIGH)
    return F.when(i == 0, piece).when(piece.rlike("^[0-9a-fA-F]{2}"), F.concat(byte, F.substring(piece, 3, 1 << 30))).otherwise(piece)


def _unit_piece(piece: Column, i: Column) -> Column:
    # after \u: a number, a blank at most, and one character for older readers
    n = F.pmod(F.regexp_extract(piece, "^(-?[0-9]+)", 1).try_cast("int"), F.lit(1 << 16))
    rest = F.regexp_replace(piece, r"^-?[0-9]+ ?(?:\\'[0-9a-fA-F]{2}|[^\\{}])?", "")
    return F.when(i == 0, piece).otherwise(F.concat(F.lit(_HEX_OPEN), F.lpad(F.hex(n), 4, "0"), F.lit(_HEX_CLOSE), rest))


def _utf16_piece(piece: Column, i: Column) -> Column:
    # hex digits of UTF-16 units up to the closing mark; halves of a pair alone are no character
    units = F.regexp_extract_all(F.substring_index(piece, _HEX_CLOSE, 1), F.lit("[0-9A-F]{4}"), F.lit(0))

    def whole(u, k):
        high, low = u.rlike("^D[89AB]"), u.rlike("^D[C-F]")
        after = F.coalesce(F.get(units, k + 1), F.lit("")).rlike("^D[C-F]")
        before = F.coalesce(F.get(units, k - 1), F.lit("")).rlike("^D[89AB]")
        return F.when((high & ~after) | (low & ~before), "FFFD").otherwise(u)
    text = F.decode(F.unhex(F.array_join(F.transform(units, whole), "")), "UTF-16BE")
    rest = F.substring(piece, F.locate(_HEX_CLOSE, piece) + 1, 1 << 30)
    return F.when(i == 0, piece).otherwise(F.concat(text, rest))


def _pieces(text: Column, sep: str, fn) -> Column:
    return F.array_join(F.transform(F.split(text, sep, -1), fn), "")


def rtf_plain(run: Column) -> Column:
    """Text of one RTF run: braces and control words (``\\word`` with optional
    numeric argument and one delimiting blank) removed, ``\\par`` and
    ``\\line`` as line ends, ``\\tab`` as a tab, ``\\'hh`` in code page 1252,
    ``\\uN`` as UTF-16 units (the character after it, for older readers, is
    skipped)."""
    body = F.regexp_replace(run, r"^\{|\}$", "")
    marks = "[" + _HEX_OPEN + _HEX_CLOSE + "]"
    body = _once(body, lambda t: F.when(t.rlike(marks), F.regexp_replace(t, marks, "")).otherwise(t))
    body = F.regexp_replace(body, r"\\(?:par|line)(?![a-zA-Z])-?[0-9]* ?", "\n")
    body = F.regexp_replace(body, r"\\tab(?![a-zA-Z])-?[0-9]* ?", "\t")

    def units(t: Column) -> Column:
        return F.replace(_pieces(t, r"\\u(?=-?[0-9])", _unit_piece), F.lit(_HEX_CLOSE + _HEX_OPEN), F.lit(""))

    # most runs have no escaped character: the decoding steps wait for their mark
    body = _once(body, lambda t: F.when(t.contains("\\u"), units(t)).otherwise(t))
    body = F.regexp_replace(body, r"\\[a-zA-Z]+-?[0-9]* ?", "")
    body = _once(body, lambda t: F.when(t.contains(_HEX_OPEN), _pieces(t, _HEX_OPEN, _utf16_piece)).otherwise(t))
    return _once(body, lambda t: F.when(t.contains("\\'"), _pieces(t, r"\\'", _byte_piece)).otherwise(t))


def rtf_run_text(raw) -> Column:
    """Each formatted run, decoded; non-empty ones joined, each preceded
    by a newline."""
    runs = F.regexp_extract_all(_c(raw), F.lit(RTF_RUN), 0)
    texts = F.filter(F.transform(runs, rtf_plain), lambda s: s != "")
    return F.array_join(F.transform(texts, lambda s: F.concat(F.lit("\n"), s)), "")


# --- S3: a folder of raw files ---------------------------------------------------------
def read_raw_files(spark: SparkSession, path: str, id_pattern: str = r"([^/]+?)(?:\.[^./]*)?$",
                   encoding: str = "UTF-8", glob: str | None = None) -> DataFrame:
    """One row per file: ``article_id`` taken from the file path by
    ``id_pattern`` (group 1) and ``raw`` decoded with ``encoding`` (the
    original reads HTML as ISO-8859-1). Splits are whole files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path)
    return df.select(F.regexp_extract(F.col("path"), id_pattern, 1).alias("article_id"),
                     F.decode(F.col("content"), encoding).alias("raw"))


# --- X7: audit ------------------------------------------------------------------------
def extraction_audit(expected: DataFrame, extracted: DataFrame, key: str = "article_id",
                     text: str = "text", recognised: str = "recognised") -> DataFrame:
    """Counts per status: ``missing`` (expected, no file), ``unread`` (file
    not expected), ``unrecognised`` (no extractor), ``blank`` (extracted
    only blanks), ``extracted``. Anti-joins both ways, one aggregate."""
    exp = expected.select(F.col(key).cast("string").alias(key)).distinct()
    got = extracted.select(F.col(key).cast("string").alias(key), text, recognised)
    missing = exp.join(got, key, "left_anti").select(F.lit("missing").alias("status"))
    unread = got.join(exp, key, "left_anti").select(F.lit("unread").alias("status"))
    st = (F.when(~F.col(recognised), "unrecognised")
          .when(is_blank(F.col(text)), "blank").otherwise("extracted"))
    read = got.join(exp, key, "left_semi").select(st.alias("status"))
    return (missing.unionByName(unread).unionByName(read)
            .groupBy("status").agg(F.count("*").alias("n")))
