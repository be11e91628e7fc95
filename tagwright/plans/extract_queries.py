"""Registered queries for article extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as EX
from ..session import scratch_path
from ..sources.tables import read_table
from .registry import register


def _pages(spark, sf, cols=("page_id", "url", "html")):
    return read_table(spark, sf, "pages", list(cols))


# The twins' own patterns: the test pages are written in lower case, nest no
# container in itself, and hold these entities only.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&amp;", "&")]
P_OPEN = r"<p(?:\s[^>]*)?>"
P_END = (r"(?s)(?:</p>|<(?:address|article|aside|blockquote|div|dl|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol"
         r"|p|pre|section|table|ul)(?:[\s/>]|$)).*")
DIV_OPEN = r"<div(?:[\s/>]|$)"
DIV_CLOSE = r"</div\s*>"


# --- SQL twins of the extractors ---------------------------------------------------
def s_container(h, tag):
    p = f"(?s)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>"
    return f"(CASE WHEN regexp_matches({h}, '{p}') THEN regexp_extract({h}, '{p}', 1) END)"


def s_remove(h, tags, extra=()):
    for tag in tags:
        h = f"regexp_replace({h}, '(?s)<{tag}(?:\\s[^>]*)?>.*?</{tag}>', '', 'g')"
    for p in extra:
        h = f"regexp_replace({h}, '{p}', '', 'g')"
    return h


def s_entities(t):
    for ent, ch in ENTITIES:
        t = f"replace({t}, '{ent}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return t


def s_strip(t):
    return f"regexp_replace({t}, '<[^>]*>', '', 'g')"


def s_article_text(h):
    """Pieces after each <p>; a piece counts when the div depth (a clamped
    fold over the earlier pieces) is zero; each is cut at its implied end."""
    pieces = f"string_split_regex(coalesce({s_container(h, 'article')}, ''), '{P_OPEN}')"
    delta = (f"len(regexp_extract_all(x, '{DIV_OPEN}')) - "
             f"len(regexp_extract_all(x, '{DIV_CLOSE}'))")
    depth = f"list_reduce(p[1:k-1], lambda acc, x: greatest(acc + {delta}, 0), 0)"
    parts = (f"list_transform(range(2, len(p) + 1), lambda k: CASE WHEN {depth} = 0 "
             f"THEN regexp_replace(p[k], '{P_END}', '') ELSE '' END)")
    return s_entities(s_strip(f"(SELECT array_to_string({parts}, '') FROM (SELECT {pieces} AS p))"))


def s_nonblank(x):
    return f"(CASE WHEN NOT regexp_matches(coalesce({x}, ''), '^\\s*$') THEN {x} END)"


def s_fallback(h):
    h1 = s_entities(s_strip(f"coalesce({s_container(h, 'h1')}, '')"))
    title = s_entities(s_strip(f"coalesce({s_container(h, 'title')}, '')"))
    return f"coalesce({s_nonblank(s_article_text(h))}, {s_nonblank(h1)}, {s_nonblank(title)}, '')"


def s_body_text(h):
    body = f"coalesce({s_container(h, 'body')}, {h})"
    return s_entities(s_strip(s_remove(body, ("nav", "footer", "script", "style", "div"), ("(?s)<!--.*?-->", "(?s)<head(?:\\s[^>]*)?>.*?</head>"))))


S_HOST = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^./:?#]+)', 1)"


def s_dispatch(h="html"):
    return (f"CASE {S_HOST} WHEN 'www' THEN {s_article_text(h)} WHEN 'blog' THEN {s_fallback(h)} "
            f"WHEN 'm' THEN {s_body_text(h)} END")


# --- X1-X4 --------------------------------------------------------------------------
@register("html_paragraph_text", op="X1", sql=f"""
SELECT page_id, {s_article_text('html')} AS text FROM pages
""")
def q_html_paragraph_text(spark, sf):
    return _pages(spark, sf, ("page_id", "html")).select(
        "page_id", EX.html_paragraph_text(F.col("html")).alias("text"))


@register("html_dispatch_by_source", op="X2", sql=f"""
SELECT page_id, {S_HOST} AS source, {s_dispatch()} AS text FROM pages
""")
def q_html_dispatch_by_source(spark, sf):
    p = _pages(spark, sf)
    return p.select("page_id", EX.host_label(F.col("url")).alias("source"),
                    EX.page_text_by_host(F.col("url"), F.col("html")).alias("text"))


@register("html_fallback_chain", op="X3", sql=f"""
SELECT page_id, {s_fallback('html')} AS text FROM pages
""")
def q_html_fallback_chain(spark, sf):
    return _pages(spark, sf, ("page_id", "html")).select(
        "page_id", EX.fallback_text(F.col("html")).alias("text"))


@register("html_remove_nodes", op="X4", sql=f"""
SELECT page_id, {s_body_text('html')} AS text FROM pages
""")
def q_html_remove_nodes(spark, sf):
    return _pages(spark, sf, ("page_id", "html")).select(
        "page_id", EX.body_text(F.col("html")).alias("text"))


# --- X2 + X3 by the rule table: documents in the layouts of the studied sources ---------
LAYOUTS = [
    ("NYT", '<div class="mod-nytimesarticletext mod-articletext">', "</div>"),
    ("NYT", '<div id="article"><div><p>image</p></div><div id="articleBody">', "<div><p>box</p></div></div></div>"),
    ("NYT", '<div id="content"><div class="entry-content"><p>outer</p><div class="entry-content">', "</div></div></div>"),
    ("LA", '<div id="fullTextZoneId" class="x t-zone">', "</div>"),
    ("SF", '<p class="dtlcomment">mail</p><div id="fontprefs_bottom"><P ID="pageno">A1</P>', "</div>"),
    ("DMNB", '<div id="content"><div class="docBody"><div class="mainText"><div>caption<div>deep</div></div>', "</div></div></div>"),
    ("ZZ", "<article>", "</article>"),
]


def documents_in_layouts(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    kind = F.pmod(F.col("doc_id"), F.lit(len(LAYOUTS)))
    paras = F.concat(F.lit("<p>"), F.replace(_xml_escape(F.col("text")), F.lit("\n"), F.lit("<p>")))

    def pick(k):
        return F.element_at(F.array(*[F.lit(row[k]) for row in LAYOUTS]), (kind + 1).cast("int"))
    return d.select("doc_id", F.concat(pick(0), F.col("doc_id").cast("string")).alias("article_id"),
                    F.concat(F.lit("<html><body>"), pick(1), paras, pick(2), F.lit("</body></html>")).alias("html"))


@register("html_source_rules", op="X2+X3", sql=f"""
SELECT doc_id, CASE WHEN doc_id % {len(LAYOUTS)} < {len(LAYOUTS) - 1} THEN replace(text, chr(10), '') END AS text FROM documents
""")
def q_html_source_rules(spark, sf):
    pages = documents_in_layouts(spark, sf)
    return pages.select("doc_id", EX.text_by_source(F.col("article_id"), F.col("html")).alias("text"))


# --- X5: documents wrapped as XML ----------------------------------------------------------
def _xml_escape(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def _xml_paragraph(line):
    first = F.substring_index(line, " ", 1)
    rest = F.substring(line, F.length(first) + 1, 1 << 30)
    return F.concat(F.lit("<paragraph>"), _xml_escape(first), F.lit("<cht>"), _xml_escape(rest),
                    F.lit("<i>nested</i></cht>tail</paragraph>"))


def documents_as_xml(spark, sf):
    """Each line of a document becomes a ``paragraph`` whose first word is
    the leading text and the rest a ``cht`` child, followed by a nested
    element and a tail that extraction must ignore."""
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    paras = F.array_join(F.transform(F.split("text", "\n", -1), _xml_paragraph), "")
    return d.select("doc_id", F.concat(F.lit("<r><txtdt><text>"), paras,
                                       F.lit("</text></txtdt></r>")).alias("xml"))


@register("xml_paragraph_text", op="X5", sql="""
SELECT doc_id, replace(text, chr(10), '') AS text FROM documents
""")
def q_xml_paragraph_text(spark, sf):
    x = documents_as_xml(spark, sf)
    return x.select("doc_id", EX.xml_paragraph_text(F.col("xml")).alias("text"))


# --- X6: documents wrapped as RTF -----------------------------------------------------------
RUN_HEAD = ("{\\cs15\\lang1033\\langfe1033\\b0\\i0\\ul0\\strike0\\scaps0\\fs24\\afs24"
            "\\charscalex100\\expndtw0\\cf1\\dn0 ")


def _rtf_char(c):
    code = F.ascii(c)
    plain = (code < 128) & ~c.isin("\\", "{", "}")
    byte = F.concat(F.lit("\\'"), F.lower(F.hex(F.encode(c, "ISO-8859-1"))))
    unit = F.concat(F.lit("\\u"), code.cast("string"), F.lit("?"))
    # Latin-1 characters alternate between the two escapes, others need the second
    return F.when(plain, c).when((code < 256) & (code % 2 == 0), byte).otherwise(unit)


RTF_TAIL = "\\'92\\par\\tab end\\line \\u-10179?\\u-8704?"


def documents_as_rtf(spark, sf):
    """Each line becomes one formatted run that ends in ``RTF_TAIL`` (a byte of
    code page 1252, paragraph, tab, line end, a character beyond 16 bits);
    characters outside ASCII and the RTF specials are escaped, paragraphs are
    separated by ``\\par``. Lines that need no escape are copied."""
    d = read_table(spark, sf, "documents", ["doc_id", "text"])

    def run(line):
        per_char = F.array_join(F.transform(F.split(line, "", -1), _rtf_char), "")
        esc = F.when(line.rlike(r"[^\x00-\x7F]|[\\{}]"), per_char).otherwise(line)
        return F.concat(F.lit(RUN_HEAD), esc, F.lit(RTF_TAIL + "}"))
    body = F.array_join(F.transform(F.split("text", "\n", -1), run), "\\par\n")
    return d.select("doc_id", F.concat(F.lit("{\\rtf1\\ansi "), body, F.lit("}")).alias("rtf"))


@register("rtf_run_text", op="X6", sql="""
SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
  lambda l: chr(10) || l || chr(8217) || chr(10) || chr(9) || 'end' || chr(10) || chr(128512)), '') AS text FROM documents
""")
def q_rtf_run_text(spark, sf):
    r = documents_as_rtf(spark, sf)
    return r.select("doc_id", EX.rtf_run_text(F.col("rtf")).alias("text"))


# --- X7, J8 ----------------------------------------------------------------------------
def _extracted(spark, sf):
    p = _pages(spark, sf)
    return p.select(F.col("page_id").alias("article_id"),
                    EX.page_text_by_host(F.col("url"), F.col("html")).alias("text"),
                    EX.host_label(F.col("url")).isin(*EX.RECOGNISED_HOSTS).alias("recognised"))


def _expected(spark, sf):
    """The articles that were asked for: the ids of all labelled documents. Pages
    without a label were not asked for, labels without a page are missing."""
    return read_table(spark, sf, "labels", ["doc_id"]).select(F.col("doc_id").alias("article_id"))


AUDIT_SQL = f"""
WITH e AS (SELECT DISTINCT doc_id AS article_id FROM labels),
x AS (SELECT page_id AS article_id, {s_dispatch()} AS text,
             {S_HOST} IN ('www', 'blog', 'm') AS recognised FROM pages)
SELECT status, count(*) AS n FROM (
  SELECT 'missing' AS status FROM e WHERE article_id NOT IN (SELECT article_id FROM x)
  UNION ALL SELECT 'unread' FROM x WHERE article_id NOT IN (SELECT article_id FROM e)
  UNION ALL SELECT CASE WHEN NOT recognised THEN 'unrecognised'
                        WHEN regexp_matches(coalesce(text, ''), '^\\s*$') THEN 'blank'
                        ELSE 'extracted' END FROM x WHERE article_id IN (SELECT article_id FROM e))
GROUP BY status
"""


@register("extraction_audit", op="X7", sql=AUDIT_SQL)
def q_extraction_audit(spark, sf):
    return EX.extraction_audit(_expected(spark, sf), _extracted(spark, sf))


@register("anti_join_audit", op="J8", sql="""
SELECT l.doc_id FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE
  n_chars > 2000)
""")
def q_anti_join_audit(spark, sf):
    """Labelled articles with no long text: the left-anti half of the audit."""
    lab = read_table(spark, sf, "labels", ["doc_id"])
    long_docs = read_table(spark, sf, "documents", ["doc_id", "n_chars"]).where(
        F.col("n_chars") > 2000)
    return lab.join(long_docs, "doc_id", "left_anti")


# --- S3: pages as a folder of files ------------------------------------------------------
@register("scan_raw_articles", op="S3", sql="""
SELECT page_id, html FROM pages
""")
def q_scan_raw_articles(spark, sf):
    """Pages as raw files: one file per page in a few folders, read back whole."""
    path = scratch_path(spark, "raw-pages")
    pages = _pages(spark, sf, ("page_id", "html"))
    # the writer starts a new file after each row; every row names its page first
    named = pages.select(F.concat(F.col("page_id").cast("string"), F.lit("\n"), F.col("html")).alias("value"))
    # each task has a folder of its own, which the commit moves as a whole and the listing reads by itself
    named.withColumn("folder", F.spark_partition_id()).write.option("maxRecordsPerFile", 1).partitionBy("folder").text(path)
    raw = EX.read_raw_files(spark, path, glob="part-*")
    # the text writer ends every file with one line separator
    body = F.expr("substring(raw, locate('\n', raw) + 1, length(raw) - locate('\n', raw) - 1)")
    return raw.select(F.substring_index("raw", "\n", 1).cast("bigint").alias("page_id"), body.alias("html"))
