"""Polarity guard: hand-made pairs, symmetry, and agreement of its two forms."""

import random
import re

import pyarrow as pa
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from echoledger.functions import guard as G, vectors as V
from echoledger.operators import similarity as S

GOLDEN = [
    ("compress the archive", "decompress the archive", False),
    ("lock my screen", "unlock my screen", False),
    ("encrypt a disk", "decrypt a disk", False),
    ("enable swap", "disable swap", False),
    ("inhale slowly", "exhale slowly", False),
    ("increase volume", "decrease volume", False),
    ("translate english to french", "translate french to english", False),
    ("cast an int into a float", "cast float into int", False),
    ("open the port", "close the port", False),
    ("raise an error", "catch an error", False),
    ("do remove it", "do not remove it", False),
    ("it works", "it doesn't work, isn't it", False),
    ("how to go from home to work", "how to go from work to home", False),
    ("how to reach the station", "how to reach a station", True),
    ("sort a list in python", "python list sorting", True),
    ("lock and unlock", "unlock", True),
    ("move a to a", "move a to a", True),
    ("to begin", "begin to", True),
    ("", "", True),
    ("knot tying", "tying", True),
    ("nöt here", "here", True),
    ("import a module", "export a module", False),
    ("encode the file", "decode the file", False),
    ("never write twice", "write twice", False),
    ("can't open it", "can open it", False),
    ("undo the change", "redo the change", False),
    ("zip the folder", "unzip the folder", False),
    ("read from disk", "write to disk", False),
    ("copy a from left to right", "copy a from right to left", False),
    ("lock the door", "lock the gate", True),
    ("plant a tree", "water a tree", True),
    ("convert miles to km", "convert miles to km quickly", True),
    ("do it now", "undo it now", False),
    ("able hands", "enable hands", True),
]


def native(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    f = df.select("i", G.features(F.col("a")).alias("a"), G.features(F.col("b")).alias("b"))
    both = f.select("i", G.is_safe(F.col("a"), F.col("b")).alias("ab"), G.is_safe(F.col("b"), F.col("a")).alias("ba")).orderBy("i").collect()
    return [(r.ab, r.ba) for r in both]


def test_golden_pairs(spark):
    got = native(spark, [(a, b) for a, b, _ in GOLDEN])
    for (a, b, want), (ab, ba) in zip(GOLDEN, got):
        assert ab == ba == want, (a, b)


words = st.sampled_from(
    "lock unlock encode decode enable disable import export increase decrease able enable in out to into a the an not no "
    "never read write catch raise throw un de zip unzip dezip asleep desleep ensleep x y z don't go undo redo do non".split()
)
texts = st.lists(words, max_size=7).map(" ".join)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(texts, texts), min_size=20, max_size=60))
def test_columns_and_block_matrices_agree(spark, pairs):
    both = native(spark, pairs)
    want = [ab for ab, _ in both]
    assert all(ab == ba for ab, ba in both)
    rows = spark.createDataFrame(
        [(i, 0, [1.0], "", t) for i, t in enumerate([p[0] for p in pairs] + [p[1] for p in pairs])],
        "id int, ts long, vec array<double>, family string, text string",
    )
    table = S.prepare(rows, "id", F.col("ts"), "vec", "family", "text").orderBy("id").toPandas()
    n = len(pairs)
    bad = S._conflicts(table.iloc[:n].reset_index(drop=True), table.iloc[n:].reset_index(drop=True))
    assert [not bad[i, i] for i in range(n)] == want


def test_features_of_long_batches_with_nulls_stand_in_their_own_rows(spark):
    texts = [None if i % 7 == 0 else "" if i % 7 == 1 else f"unmap w{i} x{i} into the disk" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    got = {r.i: r for r in df.select("i", G.features(F.col("t")).alias("g"), V.hashed_terms(F.col("t")).alias("v")).collect()}
    assert "ArrowEvalPython" in df.select(G.features(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    for i, t in enumerate(texts):
        g, v = got[i].g, got[i].v
        if t is None:
            assert g.words is None and g.opp is None and v is None
        elif t == "":
            assert g.words == [] and g.opp == [] and len(v) == 384 and not any(v)
        else:
            assert g.words == ["unmap", f"w{i}", f"x{i}", "into", "the", "disk"] and [tuple(o) for o in g.opp] == [("unmap", "map"), ("disk", "k")]
            assert (g.source, g.target) == (f"x{i}", "disk") and abs(sum(x * x for x in v) - 1) < 1e-9


def test_negation_looks_at_first_letters_and_finds_what_the_plain_form_finds(spark):
    plain = rf"(^|{G._EDGE})({'|'.join(G.NEGATIONS)})({G._EDGE}|$)|n't"
    ends = ["", " ", "\n", "\r\n", "_", "é", "1", "-", "\U0001d400", "\U0001f600", "x"]
    texts = [a + w + b for w in (*G.NEGATIONS, "nono", "isn't", "noté") for a in ends for b in ends]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.where(G.has_negation(F.col("t")) != F.regexp_like(F.lower("t"), F.lit(plain))).count() == 0
    assert G.NEGATION_PATTERN.startswith("(?=[cnw])")


def test_words_are_read_without_a_regex():
    """Words and directions of any text are those of the pattern [a-z0-9]+, letters beyond ASCII and odd bytes included."""
    from echoledger.functions.words import words_of

    rnd = random.Random(8)
    for _ in range(300):
        text = "".join(rnd.choice("abz09AZ _-'\n\t\x00\x1c\x85\u00a0\u2028é\u0131ß漢\U0001f600") for _ in range(rnd.randrange(40)))
        assert words_of(text) == re.findall(r"[a-z0-9]+", text)
    texts = ["", "from a the b to the c", "to c", "b into", "x to y into a z", "the to the", None]
    got = G._word_features(pa.array(texts)).to_pylist()
    assert [(g["source"], g["target"]) for g in got] == [(None, None), ("b", "c"), (None, None), (None, None), ("y", "z"), (None, None), (None, None)]
    assert [g["words"] for g in got[:3]] == [[], ["from", "a", "the", "b", "to", "c"], ["to", "c"]] and got[-1]["words"] is None


def test_known_words_are_made_once_and_bounded(monkeypatch):
    from echoledger.functions import words

    monkeypatch.setattr(words, "_WORDS", 100)
    made = []
    known = words.Known(lambda w: made.append(w) or w.upper())
    for i in range(1000):
        assert known[f"w{i}"] == known[f"w{i}"] == f"W{i}" and len(known) <= 100
    assert len(made) == 1000
