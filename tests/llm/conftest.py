import random

import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, words):
    return " ".join("".join(rng.choice(("an", "the", "ou", "re", "sh", "é", "ción", "ß")) for _ in range(rng.randint(1, 3))) for _ in range(words)) + "."


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): copies, near copies, shared passages, license lines, odd and empty texts."""
    rng = random.Random(3)
    rows = [prose(rng, rng.randint(20, 250)) for _ in range(60)]
    passage = prose(rng, 120)
    for k in range(0, 12):
        rows[k] = f"{rows[k]}\n{passage}\n{prose(rng, 30)}"
    rows += [rows[20]] * 9 + [rows[21]] * 3
    for k in range(15):
        words = rows[22].split(" ")
        words[rng.randrange(len(words))] = f"new{k}"
        rows.append(" ".join(words))
    rows += [
        "", None, " \n\t ", "one", "One two three", "one two three", "a b c d e", "É", "x" * 30_000, "ab" * 900, "ab " * 700,
        rows[30] + " Released under the MIT License.", "licensed under the Apache License, Version 2.0. CC BY-NC 4.0 cc-by-nc",
        "This work is licensed under the GNU General Public License, version 3.", "don't STOP's 'll've \x1c\x85 ½²ǅ 🙂👍🏽 <|endoftext|> 한국어",
        " ".join(rows[:40]),
    ]
    return list(enumerate(rows))


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "xx", f"src{i % 3}", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(5, "doc_id")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, repeated rows, ties, and columns named like the operators' own."""
    rows = [(1, "a b c d e f g", None, None, 1), (1, "a b c d e f g", None, None, 1), (None, "a b c d e f g", "x", None, None),
            (None, None, None, None, None), (2, None, None, "s", 0), (3, "", "y", "s", 0), (2, "other words of one number", None, None, 2)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    for name in ("n", "k1", "id", "key", "row", "score", "part", "word", "shingles", "rep", "root", "first", "digest", "left", "hot", "_k1", "_gone", "_left"):
        df = df.withColumn(name, F.lit("mine"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
