"""Small corpora with the cases that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, score double, keep string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_rows():
    """Null and empty texts, null ids, repeated rows, ties, a very long text, columns with clashing names."""
    rng = random.Random(5)
    long = words(rng, 60_000)
    shared = "This very line is shared by quite a few documents of the corpus."
    texts = [None, "", " \n\t", "one", "one two three", words(rng, 40), long, long, f"{shared}\nown 1", f"own 2\n  {shared.upper()}\t", f"{shared}\n{shared}", f"x\n{shared}", f"{shared}", "Ünïcödé ßtraße. Ça va? Où est l'été.\nNächste Zeile", "a" * 300]
    rows = [(i, t, "en" if i % 3 else None, "s", len(t) if t else None, i, 0.5, "x") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "text without an id, long enough to be a line of its own right here", "en", None, None, None, None, None)]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
