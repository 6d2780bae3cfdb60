"""Small tables with the cases that every operator must handle."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, d string, t string, size string"


def prose(rng, n):
    words = "the of and to in that is was for with as by on be at from this have not are but they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through".split()
    return " ".join(rng.choice(words) for _ in range(n))


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, equal texts, extra columns with
    clashing names."""
    rng = random.Random(11)
    long = prose(rng, 30_000)
    same = prose(rng, 60)
    texts = [(1, same, "en", "a"), (2, same, "en", "b"), (2, same, "en", "b"), (3, None, None, None), (4, "", "en", ""), (5, long, "en", "a"), (6, long + " tail", "de", "a"), (None, prose(rng, 50), None, "c"), (7, " \t\n", "fr", "c"), (8, "x" * 5000, "en", "c"), (9, "12 34 !!", None, "b"), (10, same.replace("the", "THE"), "en", None), (11, "a b", "en", "a"), (12, "ünï çødé 日本語 текст", "en", "a")]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "r", "k", "d", "t", "z") for i, t, lang, s in texts], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
