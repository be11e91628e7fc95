"""Scalar text functions and dictionary files."""

from pyspark.sql import functions as F

from tagwright.functions import text as TX
from tagwright.sources import dictionaries as DS


def one(spark, col, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(col(F.col("t")).alias("x")).first().x


def test_clean_sequence(spark):
    assert one(spark, TX.clean_sequence, "A_b-c's 12² x,,y") == "a b-c's x y"


def test_clean_delete_punct(spark):
    assert one(spark, TX.clean_delete_punct, None) == ""
    assert one(spark, TX.clean_delete_punct, "U.S. 3%") == "us 3"


def test_word_count_and_accents(spark):
    assert one(spark, TX.word_count, "  a b\tc\n\x1cd  ") == 4
    assert one(spark, TX.word_count, None) == 0
    assert one(spark, lambda c: TX.strip_accents_ascii(F.lower(c)), "Ärger ﬁn ß é") == "arger fin  e"


def test_argmax(spark):
    df = spark.createDataFrame([([0.1, 0.5, 0.5, -1.0],)], "a array<float>")
    assert df.select(TX.argmax(F.col("a"))).first()[0] == 1


def test_part_truthiness(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text("term,part\na,yes\nb,no\nc,1 \nd,0\n")
    got = {r.term: r.part for r in DS.read_dictionary_table(spark, str(p)).collect()}
    assert got == {"a": True, "b": True, "c": True, "d": False}
    strict = {r.term: r.part for r in DS.read_dictionary_table(spark, str(p), True).collect()}
    assert strict == {"a": True, "b": False, "c": True, "d": False}
    assert [DS.part_value(v) for v in ("yes", "no", "1 ", "0")] == [True, True, True, False]
    lex = DS.lexicon_from_table(DS.read_dictionary_table(spark, str(p)), name="t")
    assert dict(zip(lex.terms, lex.part_of_word)) == got


def test_shipped_dovish_terms_are_all_prefixes():
    lex = DS.shipped_lexicon("dovish")
    assert all(lex.part_of_word)
    assert r"\bdovish" in lex.body() and r"\bdovish\b" not in lex.body()
