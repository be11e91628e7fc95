"""How the registered queries cast the driver tables in the roles of the
original study (see FIXTURES.md): ``documents`` is the corpus, ``labels`` the
human labels, ``events`` the coder votes, ``pages`` the raw articles,
``conversations`` the free-text model answers, ``embeddings`` the vectors.

The economic terms of the shipped dictionaries never occur in the synthetic
prose, so the queries use five small test lexicons in the same ``term,part``
form (1 = may start a longer word).
"""

from __future__ import annotations

from ..functions.patterns import Lexicon

# Test lexicons (FIXTURES.md section 3).
UP = Lexicon.of([("er", 1), ("the", 0), ("in the", 0)], name="up")
DOWN = Lexicon.of([("of", 0), ("he", 1), ("for the", 0), ("an", 0), ("and", 0), ("to", 0)],
                  name="down")
LEX_A = Lexicon.of([("of the", 0), ("license", 0), ("der", 0)], name="a")
LEX_B = Lexicon.of([("this", 0), ("tion", 0)], name="b")
LEX_C = Lexicon.of([("for", 0), ("er", 1), ("that", 0)], name="c")

# Phrase lists for the article-level labeller (D9), one per role.
PHRASES_A = ["of the", "license", "der"]
PHRASES_B = ["this", "tion"]
PHRASES_C = ["for", "that"]

SEED = 92
TEST_SHARE = 0.2
N_FOLDS = 5

# Votes: key (user_id, day); a vote is 1 for these event types.
VOTE_TYPES = ("purchase", "signup")

# A short stop list for the bag-of-words queries over the four-language test
# prose (the library default is Spark ML's English list).
STOP_WORDS = ["a", "an", "and", "de", "der", "die", "el", "en", "in", "is", "it", "la", "le",
              "of", "que", "the", "to", "und"]
VOCAB_SIZE = 2000
# Iterations of the L1 fits, the library's default; all 25 penalties are tried.
MAX_ITER = 200
