"""Registered queries of the pipeline operators: each applies its operator,
with production parameters, to its whole table. Oracles are DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import mine_phrases
from .common import load
from .conversation_repair import BLANKS, DELETE, INSERT, REROLE, TRUNCATED, damage, repair_conversations
from .decontaminate import decontaminate
from .language import label_languages
from .lm_score import lm_score
from .metric_search import SCALE, top_matches
from .mix import mix_sources
from .quality_model import classify_quality
from .quality_rules import quality_rules
from .simhash import simhash_groups
from .suffix_dedup import remove_repeats
from .tokens import token_round_trip
from .url_filter import ABSOLUTE, DAMPING, HREF, ROUNDS, SCHEME, filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def tokenizer_path() -> str:
    """The public tokenizer's file, looked up on the machine that encodes."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"], with_text=False)


@query("op2_mix_sources")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(load(spark, sf_dir, "documents", "doc_id", "text", "source"), keep=["doc_id"]).drop("copies")


@query("op3_simhash_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(load(spark, sf_dir, "documents", "doc_id", "text"))


@query("op4_quality_model")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(load(spark, sf_dir, "documents", "doc_id", "text"),
                            load(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), keep=["doc_id"])


@query("op5_token_records")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(load(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path)


def _link_graph_sql() -> str:
    """The operator's rounds written out, one query part a round."""
    def host(u: str) -> str:
        return f"translate({u}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    parts = [f"""
p AS (SELECT page_id, html, {host("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM (SELECT *, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages))""", """
r(verdict, h, pre) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
      ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))""", """
hp AS (SELECT DISTINCT host, path FROM p)""", """
best AS (SELECT host, path, arg_max(verdict, length(h || pre)) AS verdict, arg_max(h || pre, length(h || pre)) AS rule
      FROM hp JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY ALL)""", """
hosts AS (SELECT host, count(*) AS pages, count(*) FILTER (verdict = 'allow') AS allowed,
        count(*) FILTER (verdict = 'block') AS blocked
      FROM p LEFT JOIN best USING (host, path) WHERE host <> '' GROUP BY host)""", """
seeds AS (SELECT host, allowed / greatest(1, sum(allowed) OVER ()) AS t, blocked / greatest(1, sum(blocked) OVER ()) AS d,
        pages / sum(pages) OVER () AS share FROM hosts)""", f"""
hrefs AS (SELECT host, unnest(regexp_extract_all(html, {quoted(HREF)}, 1)) AS href FROM p WHERE host <> '')""", f"""
links AS MATERIALIZED (SELECT host AS src, dst, count(*) AS n FROM (
      SELECT host, CASE WHEN regexp_matches(href, {quoted(ABSOLUTE)}) THEN {host(f"regexp_extract(href, {quoted(ABSOLUTE)}, 1)")}
        WHEN regexp_matches(href, {quoted(SCHEME)}) THEN NULL ELSE host END AS dst FROM hrefs)
      WHERE dst <> '' GROUP BY ALL)""", """
x0 AS MATERIALIZED (SELECT host, t, d FROM seeds)"""]
    for k in range(1, ROUNDS + 1):
        parts.append(f"""
x{k} AS MATERIALIZED (SELECT host, sum(t) AS t, sum(d) AS d FROM (
      SELECT host, {1 - DAMPING!r} * t AS t, {1 - DAMPING!r} * d AS d FROM seeds
      UNION ALL SELECT dst, {DAMPING} * t * n / sum(n) OVER (PARTITION BY src), 0 FROM links LEFT JOIN x{k - 1} ON host = src
      UNION ALL SELECT src, 0, {DAMPING} * d * n / sum(n) OVER (PARTITION BY dst) FROM links LEFT JOIN x{k - 1} ON host = dst)
      GROUP BY host)""")
    return "WITH " + ",".join(parts) + f"""
SELECT page_id, p.host AS host, p.path AS path, rule,
  coalesce(verdict, CASE WHEN round(x.d - x.t - share, 9) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (host, path) LEFT JOIN x{ROUNDS} x ON p.host = x.host LEFT JOIN seeds ON p.host = seeds.host"""


@query("op6_url_filter", _link_graph_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(load(spark, sf_dir, "pages", "page_id", "url", "html"), keep=["page_id"])


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(load(spark, sf_dir, "documents", "doc_id", "text", "lang"), keep=["doc_id"])


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_languages(load(spark, sf_dir, "documents", "doc_id", "text", "lang"), keep=["doc_id"])


@query("op9_lm_score")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(load(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"])


_TEN_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op10_decontaminate", f"""
WITH d AS (SELECT doc_id, {_TEN_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_TEN_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n,
         array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, p, dw.n AS n FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit
         FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    benchmark = load(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate(docs, benchmark, keep=["doc_id"]).drop("item_ids")


def _repair_sql() -> str:
    """Damage as in the contract, then the cheapest edits row by row: the least
    (cost, audit) per place after each row, with the lines written so far."""
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    return f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' ||
      coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS lot FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE lot WHEN 4 THEN 'user' ELSE role END AS role,
    CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE lot WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM k),
o AS (SELECT *, rtrim(text, {blanks}) AS ended, role[1] AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM d),
f AS MATERIALIZED (SELECT *, CASE WHEN ended = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair, count(*) OVER (PARTITION BY conv_id) AS n FROM o),
step(p, x, q, line) AS (VALUES (0, 's', 1, NULL), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'),
    (3, 'u', 2, 'user')),
ins(p, q, c, a, l) AS (SELECT s, s, 0, '', []::VARCHAR[] FROM (SELECT unnest(range(4)) AS s)
    UNION ALL SELECT p, q, {INSERT}, 'I', [line || ':'] FROM step WHERE line IS NOT NULL
    UNION ALL SELECT unnest([0, 1]), 3, {2 * INSERT}, 'II', ['user:', 'assistant:']),
edit(p, q, x, kind, c) AS (SELECT s, s, NULL, 'D', {DELETE} FROM (SELECT unnest(range(4)) AS s)
    UNION ALL SELECT p, q, x, 'K', 0 FROM step UNION ALL SELECT p, q, line, 'R', {REROLE} FROM step WHERE line IS NOT NULL),
moves AS MATERIALIZED (SELECT e.p, i.q, e.x, e.kind, e.c + i.c AS c, e.kind || i.a AS a, i.l FROM edit e JOIN ins i ON e.q = i.p),
v(conv_id, i, s, best) AS (
    SELECT conv_id, 0::BIGINT, q, {{'c': c, 'a': a, 'l': l}} FROM (SELECT DISTINCT conv_id FROM f), ins WHERE p = 0
    UNION ALL
    SELECT v.conv_id, f.i, m.q, min({{'c': best.c + m.c + CASE WHEN m.kind <> 'D' AND f.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END,
        'a': best.a || m.a,
        'l': list_concat(best.l, list_concat(CASE m.kind WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [f.role || ':' || f.text]
             ELSE [m.x || ':' || f.text] END, m.l))}})
    FROM v JOIN f ON v.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = v.i + 1 JOIN moves m ON m.p = v.s
      AND (m.kind = 'D' OR f.fault NOT IN ('blank', 'duplicate') AND (m.kind = 'R' OR m.x = f.initial))
    GROUP BY v.conv_id, f.i, m.q),
done AS (SELECT v.conv_id, min(best) AS best FROM v JOIN (SELECT DISTINCT conv_id, n FROM f) f
    ON v.conv_id IS NOT DISTINCT FROM f.conv_id AND v.i = f.n WHERE s IN (0, 3) GROUP BY v.conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
    coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts ON c.conv_id IS NOT DISTINCT FROM counts.conv_id
    LEFT JOIN done ON c.conv_id IS NOT DISTINCT FROM done.conv_id"""


@query("op11_repair_conversations", _repair_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")), times_col="times")


@query("op13_top_matches", f"""
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS uid,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.uid AS query_uid, c.vec_id, c.uid, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.uid <> c.uid WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_uid ORDER BY score DESC, vec_id NULLS LAST, uid))::INTEGER AS rank,
    vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_uid ORDER BY score DESC, vec_id NULLS LAST, uid) <= 10""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_matches(load(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query("op12_phrase_collocations", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS f
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)
    GROUP BY ALL HAVING k = 1 OR count(*) >= 100),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM g WHERE k > 1),
cuts AS (SELECT c.*, j, x.f AS l, y.f AS r, n, 1000 * n * a // (x.f::HUGEINT * y.f) AS score
    FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN n USING (lang)
    JOIN g x ON x.lang = c.lang AND x.k = j AND x.g = array_to_string(w[1:j], ' ')
    JOIN g y ON y.lang = c.lang AND y.k = c.k - j AND y.g = array_to_string(w[j + 1:], ' ')),
s AS (SELECT lang, g AS phrase, a, n, arg_min({'l': l, 'r': r, 's': score}, (score, j)) AS b FROM cuts GROUP BY ALL),
kept AS (SELECT s.* FROM s ANTI JOIN (SELECT a.lang, a.g FROM c a JOIN c b ON a.lang = b.lang AND b.k > a.k
      AND 100 * b.a >= 100 * a.a AND contains(' ' || b.g || ' ', ' ' || a.g || ' ')) h ON s.lang = h.lang AND s.phrase = h.g)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY b.s DESC, a DESC, phrase) AS rank,
    phrase, a, b.l AS l, b.r AS r, n::BIGINT AS n, b.s::BIGINT AS score FROM kept) WHERE rank <= 2000""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(load(spark, sf_dir, "documents", "text", "lang"))
