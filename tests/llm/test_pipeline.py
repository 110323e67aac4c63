"""The pipeline's stages, each on the rows of the one before, against brute force."""

import os
import re

import pytest

from echoledger.llm import decontaminate
from echoledger.llm.shared import Tables
from tests.llm.test_dedup import lower, near_roots, removed

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_stages_equal_brute_force(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    tables = Tables(spark, "test-pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [{r.doc_id: r for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = tables.keep(stage(spark, docs, SF), f"s{k}")
        made = docs.collect()
        rows.append({r.doc_id: r for r in made})
        assert len(rows[-1]) == len(made)
        if k == 2:
            leaks = {r.doc_id for r in decontaminate.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
    source, good, single, stripped, clean, ids = rows
    assert all(source[i] == r for i, r in good.items()) and len(good) > 0.6 * len(source)
    _, roots = near_roots([(i, r.text) for i, r in good.items()])
    assert single == {i: r for i, r in good.items() if roots[i] == i} and len(single) < len(good)
    raw, mask = removed([(i, r.text) for i, r in single.items()], corpus_pipeline.REPEAT_BYTES)
    changed = 0
    for i, r in single.items():
        left, at = [], 0
        for c in r.text or "":
            n = len(c.encode())
            if not mask[i][at : at + n].all():
                left.append(c)
            at += n
        text = "".join(left)
        changed += text != (r.text or "")
        assert stripped[i].text == (r.text if r.text is None else text) and stripped[i].n_chars == (len(text) if mask[i].any() else r.n_chars)
    assert changed and set(stripped) == set(single)
    assert clean == {i: r for i, r in stripped.items() if i not in leaks}
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in clean.values():
        text = f" {' '.join(words(r.text))} "
        assert not any(f" {' '.join(w)} " in text for w in items if w)
    library = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    assert set(ids) == set(clean)
    for i, r in clean.items():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert ids[i].ids == want and ids[i].decoded == library.decode(want, skip_special_tokens=False)


def test_stages_of_odd_and_empty_tables(spark, odd, empty, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0), (None, 1, None), (3, None, 0), (2, 0, 1)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "q w e r t y u i o p"), (None, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for table in (odd, empty):
            got = stage(spark, table, str(tmp_path))
            assert (got.columns == table.columns or name == "BPE encoding and decoding") and got.count() <= table.count()
