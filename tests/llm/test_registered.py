"""Every operator has its query, and queries give the columns of their contract."""

import pytest

import __spark_entry__ as E
from cases import SF

COLUMNS = {
    "op1": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op2": ["doc_id", "size", "source_size", "target", "taken"],
    "op3": ["doc_id", "fingerprint", "component_id"],
    "op4": ["doc_id", "expected_grade", "p_top", "kept"],
    "op5": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op6": ["page_id", "host", "path", "rule", "verdict"],
    "op7": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op8": ["doc_id", "held_out", "lang_pred", "score"],
    "op9": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op10": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op11": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    "op12": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op13": ["query_id", "rank", "vec_id", "score"],
}

#: The number of rows, for those with one a row or key of their table.
ROWS = {op: "SELECT count(*) FROM parquet.`{0}/documents.parquet`" for op in COLUMNS if op != "op12"}
ROWS |= {"op6": "SELECT count(*) FROM parquet.`{0}/pages.parquet`",
         "op11": "SELECT count(DISTINCT conv_id) FROM parquet.`{0}/conversations.parquet`",
         "op13": "SELECT 10 * count(*) FROM parquet.`{0}/embeddings.parquet` WHERE vec_id % 100 = 0"}


@pytest.mark.parametrize("op", COLUMNS)
def test_columns(spark, op):
    name, = (n for n in E.queries() if n.startswith(f"{op}_"))
    df = E.queries()[name](spark, SF)
    assert df.columns[:1] == COLUMNS[op][:1] and set(COLUMNS[op]) <= set(df.columns)
    if op in ROWS:
        assert df.count() == spark.sql(ROWS[op].format(SF)).first()[0]
