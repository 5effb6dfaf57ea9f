"""Tables for the edge cases that every operator must take, and plain versions of the contracts."""

import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bm_slot int, digest string, key string, words string"


def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns whose names operators use inside."""
    long_ = " ".join(f"w{k % 700}" for k in range(20_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 1), (2, "alpha beta gamma delta epsilon zeta ", "en", "a", 1), (3, "alphabetagammadeltaepsilonzeta", None, None, None),
        (4, None, None, None, None), (5, "", "en", "b", 0), (6, " \t\n", "en", "b", 0), (7, long_, "en", "b", 1), (8, long_ + " tail", "en", "c", 1),
        (9, "é😀 ünï", "fr", "é", 1), (10, "one two", "en", "a", 1), (10, "one two", "en", "a", 1), (11, "Mail a.b@c.example.com, +49 (30) 123-4567 or 10.0.0.1.", "en", "c", 1),
    ]
    return spark.createDataFrame([(*r, 0, "d", "k", "w") for r in rows], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall((text or "").encode().lower())
