"""Rows with nulls, empty and long texts, ties, repeats, and extra columns with clashing names."""

import random

from pyspark.sql import types as T

WORDS = [f"w{i}" for i in range(40)] + ["é", "ÄB", "x" * 300, "ñandú", "don't", "42"]
SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("chunk", T.IntegerType()), ("bucket", T.StringType()), ("n_words", T.LongType()), ("rep", T.LongType()))]
)


def prose(rng, n, words=WORDS):
    return "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", " "]) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    shared = prose(rng, 60)
    base = prose(rng, 90)
    texts = [None, "", " \n ", "one", "one two three", shared, prose(rng, 20000), "x" * 50000]
    for i in range(n):
        kind = i % 6
        t = prose(rng, rng.randint(1, 150))
        if kind == 0:
            t = t + shared + prose(rng, 20)
        elif kind == 1:
            words = base.split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            t = " ".join(words)
        elif kind == 2 and len(texts) > 10:
            t = rng.choice(texts[5:])
        elif kind == 3:
            t = t + t
        texts.append(t)
    rows = [(i, t, "en" if i % 3 else None, "s", None, "b", i, i) for i, t in enumerate(texts)]
    rows.append((5, texts[5], "en", "s", 1, None, 0, 0))  # a repeated row
    rows.append((None, "a row without an id " + shared, None, None, None, None, None, None))
    rng.shuffle(rows)
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)


def in_order(spark, rows):
    """(doc_id, text) by ascending id, null ids first, and by the hash of the text."""
    hashed = {r.text: r.h for r in frame(spark, rows).selectExpr("text", "xxhash64(text) as h").distinct().collect()}
    return [(r[0], r[1] or "") for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))]
