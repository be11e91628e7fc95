"""Extraction edge cases."""

from pyspark.sql import functions as F

from tagwright.operators import extract as EX


def test_xml_tails_ignored_and_malformed_quarantined(spark):
    good = ("<r><txtdt><text><paragraph>Lead <cht>child<i>deep</i> inner-tail</cht> tail"
            "</paragraph><paragraph>Two</paragraph></text></txtdt></r>")
    df = spark.createDataFrame([(1, good), (2, "<r><txtdt>"), (3, None)], "i int, x string")
    got = {r.i: r.t for r in df.select("i", EX.xml_paragraph_text(F.col("x")).alias("t")).collect()}
    assert got == {1: "Lead childTwo", 2: None, 3: None}


def test_html_paragraphs(spark):
    html = ('<html><body><article><h1>T</h1><p>One &amp; <b>two</b></p><div><p>ad</p></div>'
            '<p class="x">three</p></article></body></html>')
    df = spark.createDataFrame([(html,), ("<html></html>",)], "h string")
    got = [r.t for r in df.select(EX.html_paragraph_text(F.col("h")).alias("t")).collect()]
    assert got == ["One & twothree", ""]


def test_rtf_runs(spark):
    head = ("{\\cs15\\lang1033\\langfe1033\\b0\\i0\\ul0\\strike0\\scaps0\\fs24\\afs24"
            "\\charscalex100\\expndtw0\\cf1\\dn0 ")
    raw = "{\\rtf1 " + head + "Hello \\'e9t\\'e9}\\par " + head + "}\\par " + head + "World}}"
    df = spark.createDataFrame([(raw,)], "r string")
    assert df.select(EX.rtf_run_text(F.col("r"))).first()[0] == "\nHello été\nWorld"


def test_host_label(spark):
    df = spark.createDataFrame([("https://m.site.net/x",), ("http://www.a.com",)], "u string")
    assert [r[0] for r in df.select(EX.host_label(F.col("u"))).collect()] == ["m", "www"]


class _ParagraphDom:
    """Brute-force reference with the stdlib parser: text of the <p>
    elements of the first <article>, HTML's implied paragraph ends, div
    subtrees dropped."""

    def __init__(self, html):
        from html.parser import HTMLParser

        from tagwright.operators.extract import P_CLOSERS
        outer = self
        self.parts, self.state = [], "before"
        self.div, self.in_p = 0, False

        class P(HTMLParser):
            def handle_starttag(self, tag, attrs):
                if outer.state == "before" and tag == "article":
                    outer.state = "in"
                    return
                if outer.state != "in":
                    return
                if tag in P_CLOSERS:
                    outer.in_p = False
                if tag == "div":
                    outer.div += 1
                if tag == "p" and outer.div == 0:
                    outer.in_p = True

            def handle_endtag(self, tag):
                if outer.state != "in":
                    return
                if tag == "article":
                    outer.state = "after"
                elif tag == "div" and outer.div:
                    outer.div -= 1
                elif tag == "p":
                    outer.in_p = False

            def handle_data(self, data):
                if outer.state == "in" and outer.in_p and outer.div == 0:
                    outer.parts.append(data)

        P(convert_charrefs=True).feed(html)

    def text(self):
        return "".join(self.parts)


def test_paragraphs_equal_dom_rules_on_pages(spark):
    from tagwright.sources.tables import read_table
    pages = read_table(spark, "/root/testdata/sf0.01", "pages", ["page_id", "html"])
    rows = pages.select("page_id", "html", EX.html_paragraph_text(F.col("html")).alias("t")).collect()
    assert len(rows) == 250
    for r in rows:
        assert r.t == _ParagraphDom(r.html).text(), r.page_id


def test_unclosed_and_div_closed_paragraphs(spark):
    html = ("<article><p>one<b>two<p>three<div>ad<p>hidden</p></div>four"
            "<p>five <h2>head</h2> six<p>last</article><p>outside</p>")
    df = spark.createDataFrame([(html,)], "h string")
    got = df.select(EX.html_paragraph_text(F.col("h"))).first()[0]
    assert got == _ParagraphDom(html).text() == "onetwothreefive last"


def test_nested_and_stray_divs(spark):
    html = ("<article><p>a<div>x<div>y</div><p>in nested</p>z</div><p>b</p>"
            "</div><p>c<div><p>d</div></div></div><p>e</p></article>")
    df = spark.createDataFrame([(html,)], "h string")
    got = df.select(EX.html_paragraph_text(F.col("h"))).first()[0]
    assert got == _ParagraphDom(html).text()


# --- hand-made pages: markup, expected text -----------------------------------------
PARAGRAPHS = [
    ("<ARTICLE><P>Rate hike</P></ARTICLE>", "Rate hike"),
    ("<article><p>Fed&#8217;s &mdash; caf&eacute; &#x1F600; &#146; &amp;lt; &bogus; A&B</p></article>",
     "Fed’s — café \U0001f600 ’ &lt; &bogus; A&B"),
    ("<article><p>one</p></article>x<article><p>two</p></article>", "onetwo"),
    ("<article><div><div><p>in</p></div><p>still in</p></div><p>out</p></article>", "out"),
    ("<article><p>a<div>gone</div>b<p>c</article>", "ac"),
    ("<article><!-- <p>no</p> --><p>yes</p></article>", "yes"),
    ("<article><DIV class=x><P>no</DIV><p>yes", "yes"),
    ("<p>no article</p>", ""), ("", ""), (None, ""),
]


def _body(inner):
    return f"<html><body>{inner}</body></html>"


SOURCES = [
    ("NYT1", _body('<div class="mod-nytimesarticletext mod-articletext"><p>a</p></div>x<div class="mod-nytimesarticletext '
                   'mod-articletext"><p>b</p><div><p>no</p></div></div><div id="article"><div id="articleBody"><p>no</p></div></div>'), "ab"),
    ("NYT2", _body('<div id="article"><div><p>img</p></div><div id="articleBody"><div>no</div><p>a</p></div>'
                   "<DIV ID='articleBody'><p>b</p></DIV></div>"), "ab"),
    ("NYT3", _body('<div id=article><div class="main articleBody"><p>a</p></div></div>'), "a"),
    ("NYT4", _body('<div id="article"><p class="summaryText">Sum <b>mary</b><p>no</div>'), "Sum mary"),
    ("NYT5", _body('<div id="content"><div class="entry-content"><p>no</p><div class="entry-content"><p>in</p></div></div></div>'), "in"),
    ("NYT6", _body('<div id="content"><div class="entry-content"><p>only</p></div></div>'), "only"),
    ("NYT7", _body("<nyt_text><p>old</p></nyt_text>"), "old"),
    ("NYT8", _body("<p>nothing</p>"), ""),
    ("LA1", _body('<div class="t-zone" id="fullTextZoneId"><p>full</p></div><div id="abstractZone"><p>no</p></div>'), "full"),
    ("LA2", _body('<div id="fullTextZoneId"><p>no</p></div><div id="abstractZone"><p>abs</p></div>'), "abs"),
    ("SF1", _body('<div id="fontprefs_bottom"><p class="dtlcomment">mail</p><p id="pageno">A1</p><p>text</p><p id="pageno">two</p>'
                  '<p class="x dtlcomment">mail2<p>end</div>'), "texttwoend"),
    ("SF2", _body('<table><td class="text1md"><font size=2><p>cell</p></font><font><p>no</p></font></td></table>'), "cell"),
    ("DMNB1", _body('<div id="content"><div class="docBody"><div class="mainText"><div>caption<div>deep</div></div>Head <p>one</p>'
                    "<div>kept</div>tail</div></div></div>"), "Head onekepttail"),
    ("MIHB1", _body('<div id="content"><div class="docBody"><div class="mainText">plain</div></div></div>'), "plain"),
    ("XX1", _body("<article><p>x</p></article>"), None),
]


def test_paragraphs_of_hand_made_pages(spark):
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(PARAGRAPHS)], "i int, html string")
    got = {r.i: r.t for r in df.select("i", EX.html_paragraph_text("html").alias("t")).collect()}
    for i, (markup, text) in enumerate(PARAGRAPHS):
        assert got[i] == text, markup


def test_source_rules(spark):
    df = spark.createDataFrame([(i, m) for i, m, _ in SOURCES], "id string, html string")
    got = {r.id: r.t for r in df.select("id", EX.text_by_source("id", "html").alias("t")).collect()}
    for i, markup, text in SOURCES:
        assert got[i] == text, (i, markup)


def test_containers_and_removal(spark):
    body = '<div id="articleBody"><div>img</div>text <div>more</div></div><div>after</div>'
    df = spark.createDataFrame([(body,)], "h string")
    row = df.select(EX.container("h", "div", 'id="articleBody"').alias("inner"),
                    EX.remove_nodes(F.lit("a<div>x<div>y</div>LEAK</div>b<NAV>n</nav>c</div>d"), ("div", "nav")).alias("left"),
                    EX.remove(F.lit("<div>1</div><div>2</div>"), [EX.Node("div")], first_only=True).alias("first")).first()
    assert row.inner == "<div>img</div>text <div>more</div>"
    assert row.left == "abc</div>d"
    assert row.first == "<div>2</div>"


RTF_HEAD = ("{\\cs15\\lang1033\\langfe1033\\b0\\i0\\ul0\\strike0\\scaps0\\fs24\\afs24\\charscalex100\\expndtw0\\cf1\\dn0 ")
RTF_CASES = [
    (r"it\'92s \'93ok\'94", "it’s “ok”"), (r"x\par next", "x\nnext"), ("a\\" + "u8217?b", "a’b"),
    ("a\\" + "u8217 \\'92b", "a’b"), ("\\" + "u-10179?\\" + "u-8704?!", "\U0001f600!"), (r"a\tab b\line c", "a\tb\nc"),
    ("\\" + "u-10179?x", "�x"), (r"caf\'e9 \parade ok", "café ok"), ("plain", "plain"), (r"50\'80", "50€"),
]


def test_rtf_characters(spark):
    df = spark.createDataFrame([(i, RTF_HEAD + c + "}") for i, (c, _) in enumerate(RTF_CASES)], "i int, raw string")
    got = {r.i: r.t for r in df.select("i", EX.rtf_run_text("raw").alias("t")).collect()}
    for i, (raw, text) in enumerate(RTF_CASES):
        assert got[i] == "\n" + text, raw


def test_quoted_attributes_and_scripts(spark):
    page = ("<article><p title='a>b' x=\"<p>\">One</p><script>var s = '<p>no</p></article>';</script><p data-x = \"1 > 0\">two"
            "<style>p > a {}</style> it's</p><p a=b'c>three 'four'</p></article>")
    df = spark.createDataFrame([(page,)], "html string")
    assert df.select(EX.html_paragraph_text("html")).first()[0] == "Onetwo it'sthree 'four'"


def test_page_of_many_paragraphs(spark):
    """The fold's time is linear in the elements of a page."""
    import time
    n = 20_000
    page = "<article>" + "".join(f"<p class='x'>paragraph {i} <b>of</b> many</p><div><p>no</p></div>" for i in range(n)) + "</article>"
    df = spark.createDataFrame([(page,)], "html string").cache()
    df.count()
    t0 = time.perf_counter()
    text = df.select(EX.html_paragraph_text("html")).first()[0]
    assert time.perf_counter() - t0 < 20
    assert text == "".join(f"paragraph {i} of many" for i in range(n))
