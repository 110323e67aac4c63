"""Quality, licenses, decontamination, archives and the pipeline."""

import os
import random
import re

import numpy as np
import pytest

from echoledger.llm import archive, decontaminate, licenses, quality
from echoledger.llm.shared import Tables

SF = "/root/testdata/sf0.01"


def test_licenses(docs, texts):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, text in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(k, label) for p, label in licenses.BASE_PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert sum("gpl-3" in r.labels for r in got.values()) == 1


def test_matching_statistics():
    rng = random.Random(1)
    templates = [[rng.randrange(4) for _ in range(rng.randint(3, 30))] for _ in range(8)]
    automaton = licenses.SuffixAutomaton(templates)
    known = {tuple(t[a:b]) for t in templates for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
    text = [rng.randrange(5) for _ in range(300)]
    for k, (state, length) in enumerate(automaton.statistics(text)):
        assert length == max([n for n in range(1, k + 2) if tuple(text[k + 1 - n : k + 1]) in known], default=0)
        for which, end in automaton.ends[state].items() if length else ():
            assert templates[which][end + 1 - length : end + 1] == text[k + 1 - length : k + 1]


def test_edited_notice_is_chained(spark):
    words = licenses.TEMPLATES[2][0].split()
    words[6] = words[15] = "changed"
    df = spark.createDataFrame([(1, "before it " + " ".join(words) + " after"), (2, "a clean text of the person")], "doc_id bigint, text string")
    (row,) = licenses.spans(df).collect()
    assert (row.doc_id, row.label, row.first_word, row.last_word) == (1, "mit", 2, len(words) + 1) and 0.8 < row.share < 1


def test_every_notice_of_one_template_is_a_span(spark):
    notice = licenses.TEMPLATES[2][0]
    n, gap = len(re.findall("[A-Za-z0-9]+", notice)), "other words of the file " * 20
    df = spark.createDataFrame([(1, f"{notice} {gap} {notice} {gap} {notice}")], "doc_id bigint, text string")
    got = sorted((r.first_word, r.last_word) for r in licenses.spans(df).collect() if r.label == "mit")
    assert got == [(k * (n + 100), k * (n + 100) + n - 1) for k in range(3)]


def test_leaks(spark, docs, texts):
    items = [(7, "what is the colour of anrethe shou\nthe colour is reanou."), (8, "one lonely question of several words here"), (9, ""), (None, "x y z"), (10, None)]
    leaky = [(1000, "before WHAT is the colour of anrethe shou\nThe colour is reanou.### after"), (1001, "what is the colour of anrethe shou and no answer to it"),
             (1002, "pad " * 900 + "one lonely question of several words here" + " pad" * 900)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(leaky, "doc_id bigint, text string"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r.items for r in decontaminate.leaks(rows, bench).collect()}
    assert len(got) == len(texts) + 3 and {i: x for i, x in got.items() if x} == {1000: "7", 1002: "8"}
    assert {r.doc_id for r in decontaminate.clean_documents(rows, bench).collect()} == set(got) - {1000, 1002}
    assert decontaminate.leaks(rows, bench.limit(0)).where("contaminated").count() == 0


def test_shards_give_the_rows_of_one_index(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: f"w{min(int(rng.expovariate(0.02)), 400)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 40))) + "\n" + " ".join(word() for _ in range(4))) for i in range(120)]
    texts = []
    for i, (_, t) in enumerate(items):
        for part in range(4):
            q = t.replace("\n", " ").split(" ")
            texts.append((4 * i + part, " ".join(w if rng.random() < 0.94 - 0.09 * part else word() for w in q) + f" tail {i}"))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    one = sorted(map(tuple, decontaminate.leaks(docs, bench, 0.3, 0.0).collect()))
    left = sorted(r.doc_id for r in decontaminate.clean_documents(docs, bench, 0.5, 0.3).collect())
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 3000)
    assert sorted(map(tuple, decontaminate.leaks(docs, bench, 0.3, 0.0).collect())) == one
    assert sorted(r.doc_id for r in decontaminate.clean_documents(docs, bench, 0.5, 0.3).collect()) == left
    assert any(r[1] for r in one)


def test_retrieval_is_all_above_the_threshold():
    rng = random.Random(2)
    rows = [(k, " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randint(5, 30)))) for k in range(70)]
    index = decontaminate.Index.build(rows)
    terms = [np.unique(rng.sample(range(len(index.terms)), 25)) for _ in range(50)]
    p, i = index.retrieve(np.repeat(np.arange(50), [len(t) for t in terms]), np.concatenate(terms), 50, 0.4)
    term_of = np.repeat(np.arange(len(index.terms)), np.diff(index.item_at))
    want = {(q, k) for q, t in enumerate(terms) for k in range(70) if index.weight[(index.item == k) & np.isin(term_of, t)].sum() >= 0.4}
    assert set(zip(p.tolist(), i.tolist())) == want and want


def test_archive(spark):
    long = "é" * 60
    rows = [(5, "u5", long), (2, "u\r\nX: 2", long), (2, "u2", long), (9, None, long), (1, "u1", "short"), (3, "u3", "short"), (4, "u4", None), (None, "n", long), (6, "u6", "\r\n\r\nWARC-Type: revisit")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((tuple(r) for r in archive.round_trip(pages).collect()), key=lambda r: (r[0] or 0, r[3]))
    assert [(r[0], r[1], r[3], r[4]) for r in got] == [
        (None, 120, "revisit", 2), (1, 5, "response", None), (2, 120, "response", None), (2, 120, "response", None), (3, 5, "response", None),
        (4, 0, "response", None), (5, 120, "revisit", 2), (6, 22, "response", None), (9, 120, "revisit", 2)]
    folder = Tables(spark, "test-archive").root
    archive.write(pages, folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == 4
    files = archive.export(spark, folder, f"{folder}/warc").collect()
    raw = b"".join(open(r.file, "rb").read() for r in files)
    assert raw.count(b"WARC/1.1\r\n") == len(rows) and sum(r.records for r in files) == len(rows) and raw.count("é".encode()) == 120
    assert archive.round_trip(pages.limit(0)).count() == 0


def test_damaged_payload_is_refused(spark):
    folder = Tables(spark, "test-damaged").root
    archive.write(spark.createDataFrame([(1, "u", "x" * 200)], "page_id bigint, url string, html string"), folder)
    spark.createDataFrame([(r.digest, bytearray(b"y" * 200)) for r in spark.read.parquet(f"{folder}/payloads").collect()], "digest string, payload binary").write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="differs from its digest"):
        archive.read(spark, folder).collect()


def test_trees_fit_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = quality.fit_trees(x[:3000], y[:3000], trees=40)
    assert ((trees.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert quality.fit_trees(x, np.ones(4000)).score(x[:2]).min() > 0.99 and quality.fit_trees(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_scans_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None), (2, 0)], "doc_id bigint, quality int")
    assert quality.quality_scores(odd, labels).count() == 7 and quality.quality_scores(empty, labels).count() == 0
    assert quality.filter_documents(odd, quality.fit(odd, labels), 0.0).columns == odd.columns
    assert licenses.scan(odd).count() == 7 and licenses.scan(empty).count() == 0
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id bigint, text string")
    assert decontaminate.leaks(odd, bench).where("contaminated").count() == 3 and decontaminate.leaks(empty, bench).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_pipeline_stages(spark):
    import corpus_pipeline

    tables = Tables(spark, "test-pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = tables.keep(stage(spark, docs, SF), f"s{k}")
        counts.append(docs.count())
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
    assert counts[0] > counts[1] > counts[2] == counts[3] > counts[4] == counts[5] > 0.7 * counts[0]
