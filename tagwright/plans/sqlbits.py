"""DuckDB SQL fragments used by the oracles (independent of Spark)."""

from __future__ import annotations

# ASCII punctuation minus '-' and "'", as an RE2 class (single quotes doubled
# for the SQL literal; none present here).
PUNCT_RE2 = r"""[!"#$%&()*+,./:;<=>?@\[\\\]^_`{|}~]"""


def clean_delete_punct(x: str) -> str:
    return f"coalesce(regexp_replace(lower({x}), '{PUNCT_RE2}', '', 'g'), '')"


def clean_sequence(x: str) -> str:
    t = f"regexp_replace(lower({x}), '{PUNCT_RE2}', ' ', 'g')"
    t = f"regexp_replace({t}, '[0-9]', '', 'g')"
    return f"regexp_replace({t}, '\\s+', ' ', 'g')"


def word_tokens(x: str) -> str:
    """``str.split()`` for ASCII blanks."""
    return f"list_filter(string_split_regex(coalesce({x}, ''), '\\s+'), lambda w: w <> '')"


def word_count(x: str) -> str:
    return f"CAST(len({word_tokens(x)}) AS BIGINT)"


def md5_key(seed: int, key: str) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR))"
