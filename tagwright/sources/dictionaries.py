"""Dictionary tables ``term, part`` (S8) and the shipped lexicons.

``part`` marks terms that may begin a longer word. The original tool casts
the column by truthiness, so in a file of ``yes``/``no`` strings *every* term
becomes a prefix term ("no" is a non-empty string). That is the default here
for parity; ``strict_part=True`` reads yes/no as meant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import Lexicon

DICTIONARY_SCHEMA = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("part", T.StringType()),
])


def part_flag(part: Column, strict: bool = False) -> Column:
    """Truthiness of a ``part`` cell: blanks trimmed; numbers by value;
    any other non-empty string is true (or yes/true only, when strict)."""
    p = F.trim(part)
    num = p.try_cast("double")
    if strict:
        other = F.lower(p).isin("yes", "y", "true", "t")
    else:
        other = F.length(p) > 0
    return (F.when(p.isNull(), F.lit(False))
            .when(num.isNotNull(), num != 0)
            .otherwise(other))


def part_value(value, strict: bool = False) -> bool:
    """Driver-side twin of :func:`part_flag` for one cell."""
    if value is None:
        return False
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return value != 0
    s = str(value).strip()
    try:
        return float(s) != 0
    except ValueError:
        if strict:
            return s.lower() in ("yes", "y", "true", "t")
        return len(s) > 0


def read_dictionary_table(spark: SparkSession, path: str,
                          strict_part: bool = False) -> DataFrame:
    """Read a ``term,part`` CSV into ``term string, part boolean``."""
    raw = (spark.read.schema(DICTIONARY_SCHEMA).option("header", True)
           .option("ignoreTrailingWhiteSpace", False).csv(path))
    return raw.select(F.col("term"), part_flag(F.col("part"), strict_part).alias("part"))


def lexicon_from_table(df: DataFrame, name: str = "lexicon", **kw) -> Lexicon:
    """A dictionary table as a pattern. A dictionary is a hand-made word list,
    one alternation in the plan; ``large_dictionary_tag`` gives the same flag
    by a join where the terms themselves are data."""
    rows = df.select("term", "part").collect()
    return Lexicon(tuple(r.term for r in rows), tuple(bool(r.part) for r in rows),
                   name=name, **kw)


# --- fixed values ----------------------------------------------------------
# The five dictionaries shipped with the original study, as (term, part)
# cells exactly as written in its files (part cells verbatim, including the
# trailing blank after two digits). They must stay equal to the originals
# for the same labels.
FIXED_DICTIONARY_CELLS: dict[str, list[tuple[str, str]]] = {
    "hawkish": [("tight", "1"), ("hike", "1"), ("increas", "1 "), ("hawkish", "0"),
                ("taper", "0"), ("liftoff", "0")],
    "dovish": [("ease", "yes"), ("easing", "yes"), ("cut", "yes"), ("dovish", "no"),
               ("reduc", "yes"), ("decrea", "yes")],
    "policy_terms": [("regulation", "0"), ("deficit", "0"), ("federal reserve", "0 "),
                     ("white house", "0"), ("congress", "0"), ("legislation", "0")],
    "economy_terms": [("economic", "0"), ("economy", "0")],
    "uncertainty_terms": [("uncertain", "0"), ("uncertainty", "0")],
}
# The phrase lists of the article-level labeller (D9), in their order.
FIXED_PHRASES: dict[str, list[str]] = {
    "uncertainty": ["uncertain", "uncertainty"],
    "economic": ["economic", "economy"],
    "policy": ["regulation", "federal reserve", "deficit", "congress", "legislation",
               "white house"],
}
# --- end of fixed values ---------------------------------------------------


def shipped_lexicon(name: str, strict_part: bool = False, **kw) -> Lexicon:
    cells = FIXED_DICTIONARY_CELLS[name]
    return Lexicon(tuple(t for t, _ in cells),
                   tuple(part_value(p, strict_part) for _, p in cells), name=name, **kw)
