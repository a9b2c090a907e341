"""Small tables for the operators' tests."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, fp string, rep long, a long, tag string, target string"


def documents(spark, rows):
    """Documents (doc_id, text[, lang[, source]]) with further columns whose names operators use inside."""
    full = []
    for row in rows:
        doc_id, text, lang, source = (*row, None, None)[:4] if len(row) < 4 else row[:4]
        full.append((doc_id, text, lang, source, None if text is None else len(text), 1, "x", 2, 3, "y", None))
    return spark.createDataFrame(full, DOCS)


def prose(seed: int, n: int, words: int = 200) -> str:
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefgh") for _ in range(pick.randint(2, 5))) for _ in range(n))


AWKWARD = [
    (1, None, None, None),
    (2, "", "en", "s"),
    (3, " \t\n\x0b\x0c\r ", None, "s"),
    (4, "one", "en", None),
    (5, "one", "en", None),
    (5, "one", "en", None),
    (None, "text without an id", None, None),
    (6, "x" * 200_000, "en", "s"),
    (7, "word " * 50_000, None, "s"),
    (8, "é ü   　 ½ \U0001f600 é", "fr", ""),
]
