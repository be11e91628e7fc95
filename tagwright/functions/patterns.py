"""Dictionary -> one alternation pattern.

A lexicon is a small driver-side list of terms. It compiles to ONE regular
expression literal, so Spark compiles it once per task and every row is
matched inside whole-stage code generation -- no per-term pass, no UDF.

Rules kept for result parity:
* terms are ordered by character length, ascending and stable, so at one
  start position the shorter term wins ("white" before "white house");
* a single-word term is ``\\bterm\\b``, or ``\\bterm`` when it may be the start
  of a longer word (``part_of_word``);
* a multi-word term ``w1 w2`` is ``\\bw1[- ]+w2\\b`` (any run of blanks and
  hyphens between the words); with ``flexible_multi_word=False`` exactly one
  blank;
* terms are not escaped unless ``escape=True`` (a ``.`` in a term is a
  wildcard, as in the original tool);
* Spark runs Java regular expressions. Even with the ``U`` flag Java's word
  class differs from Python's (Python also counts numeric characters such
  as superscript two as word characters; Java counts combining marks), so
  for Spark every ``\\b`` is written as lookarounds over Python's word class
  ``[\\p{L}\\p{N}_]``: ``(?<!W)`` before and ``(?!W)`` after a term edge
  that is a letter or digit, the two-sided form otherwise.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Python's \w for str patterns: letters, numbers of every kind, underscore.
PY_WORD = r"[\p{L}\p{N}_]"
PY_BOUNDARY = rf"(?:(?<={PY_WORD})(?!{PY_WORD})|(?<!{PY_WORD})(?={PY_WORD}))"


def _is_word_char(ch: str) -> bool:
    return ch == "_" or ch.isalnum()


def _java_boundaries(piece: str) -> str:
    """Rewrite the ``\\b`` of one term piece for Java: a boundary next to a
    literal letter or digit needs only a one-sided lookaround."""
    out = []
    i = 0
    while i < len(piece):
        if piece.startswith(r"\b", i):
            before = piece[i - 1] if i > 0 else ""
            after = piece[i + 2] if i + 2 < len(piece) else ""
            if after and _is_word_char(after) and (i == 0 or before in "|("):
                out.append(f"(?<!{PY_WORD})")
            elif before and _is_word_char(before) and (i + 2 == len(piece) or after in "|)"):
                out.append(f"(?!{PY_WORD})")
            else:
                out.append(PY_BOUNDARY)
            i += 2
        elif piece[i] == "\\" and i + 1 < len(piece):
            out.append(piece[i:i + 2])
            i += 2
        else:
            out.append(piece[i])
            i += 1
    return "".join(out)


@dataclass(frozen=True)
class Lexicon:
    terms: tuple[str, ...]
    part_of_word: tuple[bool, ...]
    ignore_case: bool = True
    flexible_multi_word: bool = True
    escape: bool = False
    name: str = "lexicon"

    def __post_init__(self):
        if len(self.terms) != len(self.part_of_word):
            raise ValueError("terms and part_of_word differ in length")
        if not self.terms:
            # an empty alternation matches everywhere; refuse it
            raise ValueError(f"lexicon {self.name!r} has no terms")

    @classmethod
    def of(cls, pairs, **kw) -> "Lexicon":
        pairs = list(pairs)
        return cls(tuple(t for t, _ in pairs), tuple(bool(p) for _, p in pairs), **kw)

    # D1 -------------------------------------------------------------------
    def info(self) -> list[tuple[str, bool, bool, int]]:
        """(term, part_of_word, is_single_word, length_order) sorted by
        length, ascending and stable."""
        rows = [(t, p, len(t.split()) == 1, len(t))
                for t, p in zip(self.terms, self.part_of_word)]
        return sorted(rows, key=lambda r: r[3])

    # D2 -------------------------------------------------------------------
    def _piece(self, term: str, part: bool, single: bool) -> str:
        lit = re.escape if self.escape else (lambda s: s)
        if single:
            return r"\b" + lit(term) + ("" if part else r"\b")
        sep = r"[- ]+" if self.flexible_multi_word else " "
        return r"\b" + sep.join(lit(w) for w in term.split(" ")) + r"\b"

    def body(self) -> str:
        """The alternation with ``\\b`` boundaries (Python ``re`` syntax)."""
        return "|".join(self._piece(t, p, s) for t, p, s, _ in self.info())

    def spark_pattern(self) -> str:
        """Java pattern whose word boundaries follow Python's word class."""
        pieces = [_java_boundaries(self._piece(t, p, s)) for t, p, s, _ in self.info()]
        lead = f"(?<!{PY_WORD})"
        if all(pc.startswith(lead) for pc in pieces):
            # the same assertion opens every alternative: test it once per
            # position (same leftmost-first result, fewer checks)
            body = lead + "(?:" + "|".join(pc[len(lead):] for pc in pieces) + ")"
        else:
            body = "|".join(pieces)
        return ("(?iuU)" if self.ignore_case else "(?uU)") + body

    def python_pattern(self) -> re.Pattern:
        return re.compile(self.body(), re.IGNORECASE if self.ignore_case else 0)

    def ascii_pattern(self) -> str:
        """RE2 form for an ASCII-masked text (independent oracles)."""
        return ("(?i)" if self.ignore_case else "") + self.body()


# Python's \s also matches U+001C..U+001F, Java's Unicode \s does not.
PY_SPACE_RUN = r"[\s\x{1C}-\x{1F}]+"


def phrase_pattern(term: str) -> str:
    """A phrase surrounded by whitespace on both sides, words separated
    by any whitespace run: ``\\s+w1\\s+w2\\s+`` (case-sensitive)."""
    return "(?U)" + PY_SPACE_RUN + PY_SPACE_RUN.join(term.split()) + PY_SPACE_RUN
