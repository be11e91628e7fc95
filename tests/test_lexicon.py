"""Dictionary tagging: pattern building, Python-equivalent matches, edge rows."""

import re

import pytest
from pyspark.sql import functions as F

from tagwright.functions.patterns import Lexicon
from tagwright.operators import dictionary_table as DT
from tagwright.operators import lexicon as LX
from tagwright.plans import fixtures as FX
from tagwright.sources.dictionaries import shipped_lexicon


def spans(spark, texts, lex):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    out = LX.tag_text(df, "text", lex, "all").orderBy("id").collect()
    return [(r.x_found if False else r[f"{lex.name}_found"],
             [(m.term, m.start, m.end) for m in r[f"{lex.name}_matches"]]) for r in out]


def python_spans(text, lex):
    return [(m.group(0), m.start(), m.end()) for m in lex.python_pattern().finditer(text)]


def test_length_order_and_parts():
    lex = Lexicon.of([("white house", 0), ("white", 0), ("er", 1)])
    assert lex.body() == r"\ber|\bwhite\b|\bwhite[- ]+house\b"
    strict = Lexicon.of([("white house", 0)], flexible_multi_word=False)
    assert strict.body() == r"\bwhite house\b"


def test_empty_dictionary_and_unknown_search_type(spark):
    with pytest.raises(ValueError):
        Lexicon.of([])
    df = spark.createDataFrame([("x",)], "text string")
    with pytest.raises(ValueError):
        LX.tag_text(df, "text", FX.UP, "some")


def test_hawkish_sentence(spark):
    hawk = shipped_lexicon("hawkish")
    got = spans(spark, ["Monetary policy has hiked and increased a lot in the liftoff"], hawk)
    assert got[0][1] == [("hike", 20, 24), ("increas", 30, 37), ("liftoff", 53, 60)]


def test_policy_sentence(spark):
    pol = shipped_lexicon("policy_terms")
    got = spans(spark, ["Fiscal policy in the white house is regulation federal Reserve"], pol)
    assert [t for t, _, _ in got[0][1]] == ["white house", "regulation", "federal Reserve"]


def test_edge_rows(spark):
    cut = Lexicon.of([("cut", 1), ("white house", 0)], name="e")
    texts = ["cut at start", "", "nothing here", "white - house", "écut"]
    got = spans(spark, texts, cut)
    assert got[0] == (True, [("cut", 0, 3)])
    assert got[1] == (False, [])
    assert got[2] == (False, [])
    assert got[3][1] == [("white - house", 0, 13)]
    assert got[4] == (False, [])


def test_shorter_term_first(spark):
    lex = Lexicon.of([("white house", 0), ("white", 0)], name="w")
    assert [t for t, _, _ in spans(spark, ["the white house"], lex)[0][1]] == ["white"]


def test_flag_only_and_first(spark):
    df = spark.createDataFrame([("Monetary policy has hiked",)], "text string")
    hawk = shipped_lexicon("hawkish")
    r = LX.tag_text(df, "text", hawk, "all", return_matches=False).first()
    assert r.hawkish_found is True and len(r.hawkish_matches) == 0
    r = LX.tag_text(df, "text", hawk, "first").first()
    assert [(m.term, m.start, m.end) for m in r.hawkish_matches] == [("hike", 20, 24)]


@pytest.mark.parametrize("lex", [FX.UP, FX.DOWN, FX.LEX_A, FX.LEX_B, FX.LEX_C],
                         ids=lambda x: x.name)
def test_matches_equal_python_re_on_whole_documents(spark, lex):
    from tagwright.sources.tables import read_table
    d = read_table(spark, "/root/testdata/sf0.001", "documents", ["doc_id", "text"])
    rows = LX.tag_text(d, "text", lex, "all").collect()
    for r in rows:
        want = python_spans(r.text, lex)
        got = [(m.term, m.start, m.end) for m in r[f"{lex.name}_matches"]]
        assert got == want, r.doc_id


def test_phrase_terms(spark):
    df = spark.createDataFrame([(1, "economy"), (2, " economy "), (3, "a white  house b"),
                                (4, None)], "id int, text string")
    terms = ["economy", "white house"]
    got = {r.id: r.m for r in df.select("id", LX.phrase_terms_matched("text", terms).alias("m"))
           .collect()}
    assert got == {1: [], 2: ["economy"], 3: ["white house"], 4: []}


@pytest.mark.parametrize("seed", [4, 5])
def test_large_dictionary_equals_the_lexicon(spark, seed):
    """Flags, counts and spans of a table of terms and of the regular expression
    of the same terms."""
    import random
    rng = random.Random(seed)
    pairs = [("white house", False), ("said", False), ("well-known", False), ("regulat", True), ("state-of-the art", False),
             ("anti-infl", True), ("a b c", True), ("über", True), ("x", False), ("a-b", False), ("don't", False), ("s&p 500", False),
             ("u.s", True), ("u.s.", False), ("&", False), ("&&", True), ("c++", False), ("& co", False), ("at&", True), ("house", True),
             ("white", False), ("b c", False), ("$5", False), ("5%", True), ("σσ", True), ("K", False), ("a", True), ("the art", False)]
    pairs = pairs[:14] if seed == 4 else pairs
    bits = ["white", "house", "said", "well", "known", "regulation", "regulat", "state", "of", "the", "art", "anti", "inflation",
            "a", "b", "c", "Überzug", "x1", "X", "-", " ", " ", " ", "--", ". ", "\n", "_", "Don't", "S&P", "500", "U.S", ".", "&", "&&",
            "C++", "AT&T", "co", "$5", "5%", "ΣΣΣ", "K", "houses", "'"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(900)]
    texts += ["The White House said", "nothing", None, "well known", "well-known", "white - house", "white-house", "state-of-the-art",
              "state of the art", "deregulation", "anti inflation", "", "x&&y", "x&y", "R& co", "s&p  - 500"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "said"), (1, "said"), (1, "said")], "doc_id int, text string")
    terms = spark.createDataFrame(pairs + pairs[:3] + [("  ", True), (None, True)], "term string, part boolean")
    lex = Lexicon.of(pairs, escape=True)
    expected = docs.select("doc_id", LX.match_count("text", lex).cast("long").alias("n_matches"), LX.match_spans("text", lex).alias("spans")).collect()
    got = DT.large_dictionary_spans(docs, "doc_id", "text", terms).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    flags = DT.large_dictionary_tag(docs, "doc_id", "text", terms).collect()
    assert sorted(map(repr, flags)) == sorted(repr(type(flags[0])(doc_id=r.doc_id, found=r.n_matches > 0)) for r in expected)
    assert DT.large_dictionary_tag(docs, "doc_id", "text", terms.limit(0)).where("found").count() == 0


def test_dictionary_at_hand_and_joined(spark):
    """A dictionary that every task gets needs no shuffle of texts, and gives
    what the join of a larger one gives."""
    pairs = [("a", True), ("ab c", False), ("abc", True), ("ß", True), ("ss x", False), ("x-1", True), ("c", False), ("1", True), ("& c", False)]
    texts = ["abc ab  c", "ABC ab-C abcd", "STRASSE ss x sS-x ßx", "x-1 x-12 x 1", "R& c c", None, "", "nothing of it", "1c c1 ſs x"]
    docs = spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id int, text string")
    terms = spark.createDataFrame(pairs, "term string, part boolean")
    near, far = (DT.large_dictionary_spans(docs, "doc_id", "text", terms, at_hand) for at_hand in (DT.AT_HAND, 0))
    assert sorted(map(repr, near.collect())) == sorted(map(repr, far.collect()))
    expected = docs.select("doc_id", LX.match_spans("text", Lexicon.of(pairs, escape=True)).alias("spans")).collect()
    assert sorted(repr((r.doc_id, r.spans)) for r in near.collect()) == sorted(repr((r.doc_id, r.spans)) for r in expected)
    near, far = (DT.large_dictionary_tag(docs, "doc_id", "text", terms, at_hand) for at_hand in (DT.AT_HAND, 0))
    assert sorted(near.collect()) == sorted(far.collect())
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()


def test_terms_wait_under_their_rarest_token(spark):
    """A token that very many terms share is no anchor where another is at hand."""
    terms = spark.createDataFrame([(f"the w{i}", False) for i in range(500)] + [("the", False)], "term string, part boolean")
    per_unit = DT._anchors(terms).groupBy("unit").count().agg(F.max("count")).first()[0]
    assert per_unit == 1


def test_flagship_counts(spark):
    import __spark_entry__ as E
    got = {r.prediction: r.n for r in E.entry(spark).collect()}
    assert got == {"hawkish": 128, "neutral": 39, "dovish": 33}


def test_all_dictionaries_counts(spark):
    from tagwright.plans import QUERIES
    got = {r.prediction: r.n for r in QUERIES["all_dictionaries_rule"](spark, "/root/testdata/sf0.001")
           .groupBy("prediction").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 35, 0: 165}


def test_python_pattern_is_plain_re():
    assert isinstance(FX.UP.python_pattern(), re.Pattern)


def test_spans_of_a_text_with_very_many_matches(spark):
    import time
    lex = Lexicon.of([("rate", 0), ("rate hike", 0)])
    text = "a rate hike, " * 100_000
    df = spark.createDataFrame([(text,), ("rate",), (None,)], "text string").cache()
    df.count()
    t0 = time.perf_counter()
    rows = df.select(LX.match_spans("text", lex).alias("s")).collect()
    assert time.perf_counter() - t0 < 30
    spans = [[(x["term"], x["start"], x["end"]) for x in r["s"]] for r in rows]
    expected = [(m.group(), *m.span()) for m in lex.python_pattern().finditer(text)]
    assert spans == [expected, [("rate", 0, 4)], []]
