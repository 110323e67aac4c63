import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoledger.llm import phrases

COLUMNS = "doc_id bigint, text string, lang string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, most=phrases.MOST):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            own = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(own)
            for n in range(1, 5):
                counts[lang or "und"].update(tuple(own[i : i + n]) for i in range(len(own) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in found.items():
            for n in range(2, len(p)):
                gone |= {q for i in range(len(p) - n + 1) if 100 * a >= 80 * f[q := p[i : i + n]]}
        rows_ = []
        for p, a in found.items():
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if p not in gone:
                rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "city", "hall", "é", "x1", "#", "ß-ß", "a", "b", "\x00", "한국"] + [f"w{k}" for k in range(60)]
    fixed = [["New", "York", "city", "hall"], ["a", "b", "a", "b"], ["of", "the"], ["x1", "#", "é"]]
    rows = []
    for k in range(n):
        own = []
        for _ in range(rng.randrange(60)):
            own += rng.choice(fixed) if rng.random() < 0.3 else [rng.choice(vocabulary[: rng.choice((8, 74))])]
            own[-1] += rng.choice(("", "", "", "", ",", ".", "\n", " \t ", "!?", "\x0b"))
        rows.append((k, " ".join(own), rng.choice(("en", "en", "en", "de", None, "und"))))
    return rows + [(None, None, "en"), (1, "", None), (1, " .,\n\t", "fr"), rows[3], rows[3]]


@pytest.mark.parametrize("shard_words, step_bytes, partitions", [(1 << 20, 1 << 20, 4), (40, 64, 3), (7, 16, 2)])
def test_collocations_equal_brute_force(spark, shard_words, step_bytes, partitions):
    rows = corpus(2, 150)
    df = spark.createDataFrame(rows, COLUMNS).repartition(partitions)
    for name in ("id", "word", "f", "c", "shard", "n", "seq", "words", "p", "left", "rank"):
        df = df.withColumn(name, F.lit("mine"))
    got = sorted(tuple(r) for r in phrases.collocations(df, least=5, shard_words=shard_words, step_bytes=step_bytes).collect())
    assert got == brute(rows, 5)


def test_piece_longer_than_a_shard(spark):
    rng = random.Random(8)
    rows = [(1, " ".join(rng.choice("abcdef") for _ in range(3000)), "en"), (2, "x" * 5000 + " a b " + "y" * 3000 + ". a b" * 50, "en")]
    df = spark.createDataFrame(rows, COLUMNS).coalesce(1)
    shards = phrases.shards_of(df, 50, 100)
    assert shards.where("carried > 0").count() > 5 and shards.agg(F.sum("n")).first()[0] == 3000 + 4 + 100
    for most in (phrases.MOST, 5):
        got = sorted(tuple(r) for r in phrases.collocations(df, 10, most, shard_words=50, step_bytes=100).collect())
        assert got == brute(rows, 10, most)


def test_index_counts_and_words_of_one_hash(monkeypatch, spark):
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 6, 4000).astype(np.int32)
    index = phrases.PhraseIndex(seq)
    want = {n: Counter(tuple(seq[i : i + n].tolist()) for i in range(len(seq) - n + 1) if seq[i : i + n].all()) for n in (2, 3, 4)}
    for n, found in zip((2, 3, 4), (phrases.PhraseIndex(seq, 2).pairs(), *index.longer())):
        assert {tuple(p): c for *p, c in zip(*(x.tolist() for x in found))} == want[n]
    real = phrases.words

    def colliding(*args):
        first, hashes, starts, ends = real(*args)
        return first, hashes % np.uint64(7), starts, ends

    monkeypatch.setattr(phrases, "words", colliding)
    shard, text = phrases._Shard(), b"ab cd ab ef gh ab ij"
    first, hashes, starts, ends = phrases.words(np.array([0, len(text)]), np.frombuffer(text, np.uint8), 0, 1, phrases.BETWEEN)
    shard.add(np.frombuffer(text, np.uint8), hashes, starts, ends, np.arange(7) == 0)
    *_, own, counts = shard.row(1, "en")
    assert dict(zip(own, counts.tolist())) == {b"ab": 3, b"cd": 1, b"ef": 1, b"gh": 1, b"ij": 1}


def test_scores_pass_64_bits(spark):
    big = (1 << 62) + 1
    df = spark.createDataFrame([(big, big, big), (big, 1 << 62, big)], "a long, x long, y long")
    got = [r[0] for r in df.select(phrases._score("a", "x", "y")).collect()]
    assert got == [2000000 * big // (2 * big), 2000000 * big // (big + (1 << 62))]


def test_empty_tables(spark):
    for rows in ([], [(1, None, None)], [(1, "one two", "en")]):
        assert phrases.collocations(spark.createDataFrame(rows, COLUMNS)).count() == 0


def test_each_step_deletes_its_shuffles(spark, monkeypatch):
    """Tables are counted while Spark deletes the shuffles of a step that has been written; the session's own setting comes back."""
    from echoledger.llm import phrases

    name, seen, keep = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], phrases.Tables.keep
    before = spark.conf.get(name, None)
    monkeypatch.setattr(phrases.Tables, "keep", lambda self, df, label: seen.append((label, spark.conf.get(name, None))) or keep(self, df, label))
    docs = spark.createDataFrame([(i, "one two three four", "en") for i in range(40)], "doc_id long, text string, lang string")
    found = {r.phrase: r.a for r in phrases.collocations(docs).collect()}
    assert found == {"one two three four": 40}
    assert [on for label, on in seen if label == "pairs"] == ["true"] and spark.conf.get(name, None) == before
