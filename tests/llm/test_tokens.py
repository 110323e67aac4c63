"""Encoding, token files and language-model scores."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from echoledger.llm import bpe, mixing, tokenfiles  # noqa: E402
from echoledger.llm.shared import Tables  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("lexicon", [0, 25, bpe.LEXICON_WORDS])
def test_ids_and_decoding(docs, texts, library, lexicon):
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digests(docs, PATH, lexicon).collect()}
    for i, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        sums = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)]
        assert got[i] == (len(ids), *sums), text


def test_lexicon_shares_suffixes_and_finds_all_words():
    vocabulary = bpe.Vocabulary(PATH)
    words = ["station", "nation", "ration", "stations", "a", "naïve", "'s", "…"]
    lexicon = bpe.Lexicon(bpe.build_lexicon(words, vocabulary))
    assert len(lexicon.final) < sum(len(w.encode()) for w in words) - 8
    raw = [w.encode() for w in [*words, "statio", "x", "nations"]]
    ends = np.cumsum([len(w) for w in raw])
    number = lexicon.find(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], np.array([len(w) for w in raw]))
    assert (number[-3:] == -1).all()
    for w, n in zip(words, number):
        assert lexicon.ids[lexicon.first[n] : lexicon.first[n + 1]].tolist() == vocabulary.merge(w)


def test_encoding_of_odd_rows(odd, empty):
    rows = bpe.encode(odd, PATH).collect()
    assert sorted(len(r.ids) for r in rows) == [0, 0, 0, 5, 7, 7, 7] and bpe.encode(empty, PATH).count() == 0


def test_long_words_merge_as_in_the_library(library):
    vocabulary = bpe.Vocabulary(PATH)
    rng = np.random.default_rng(3)
    for word in ("".join(rng.choice(list("abcdeinrst"), 3000)), "ab" * 400, "a" * 777, "é" * 100 + "ß" * 50, "".join(rng.choice(list("anthe"), 1 << 20))):
        assert vocabulary.merge(word) == library.encode(word, add_special_tokens=False).ids
    for _ in range(300):
        word = "".join(rng.choice(list("anthei"), rng.integers(1, 90)))
        ids = [vocabulary.ids[c] for c in word[:-1]] + [vocabulary.ids[word[-1] + vocabulary.end]]
        assert vocabulary._merge_long(ids) == vocabulary.merge(word) == library.encode(word, add_special_tokens=False).ids


def test_words_are_remembered_by_their_bytes(texts, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    vocabulary = bpe.Vocabulary(PATH)
    encoder = bpe.Encoder(vocabulary.special, vocabulary.split, vocabulary.merge_all)
    rows = [t or "" for _, t in texts if len(t or "") < 5000]
    for _ in range(2):
        for i in range(0, len(rows), 7):
            offsets, ids = encoder.encode(rows[i : i + 7])
            got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
            assert got == [library.encode(t, add_special_tokens=False).ids for t in rows[i : i + 7]]
    memo, hashes = bpe.Memo(), np.array([5], np.uint64)
    data, zero, two = np.frombuffer(b"abcd", np.uint8), np.array([0]), np.array([2])
    memo.add(hashes, data, zero, two, np.array([7], np.int32), np.array([1]))
    assert memo.find(hashes, data, zero, two).tolist() == [0] and memo.find(hashes, data, two, two).tolist() == [-1]
    memo.add(hashes, data, two, two, np.array([8], np.int32), np.array([1]))
    assert memo.find(hashes, data, zero, two).tolist() == [0] and len(memo.hashes) == 1


def test_token_files_of_one_id_do_not_depend_on_the_layout(spark):
    rows = [(1, "one two three"[: k % 13] + " more" * (k % 7)) for k in range(300)] + [(1, None), (2, "x")]
    one = spark.createDataFrame(rows, "doc_id bigint, text string")
    other = spark.createDataFrame(rows[::-1], "doc_id bigint, text string").repartition(7)
    first, second = (sorted(tuple(r) for r in tokenfiles.checksums(df, PATH).collect()) for df in (one, other))
    assert first == second


def test_token_files(spark, docs, texts, library):
    folder = Tables(spark, "test-token-files").root
    manifest = tokenfiles.write(docs, PATH, folder, group_ids=2000, files=3)
    got = {r.doc_id: r for r in tokenfiles.read(spark, manifest).collect()}
    start = 0
    for i, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids) == (start, len(ids), ids)
        start += len(ids)
    meta = pq.ParquetFile(manifest.first().file).metadata
    column = meta.row_group(0).column(0)
    assert meta.num_row_groups > 1 and column.has_offset_index and "DELTA_BINARY_PACKED" in column.encodings
    assert [r.n_tokens for r in tokenfiles.read(spark, manifest, "doc_id", "n_tokens").where("doc_id = 3").collect()] == [got[3].n_tokens]
    sums = {r.doc_id: r.ids_crc32 for r in tokenfiles.checksums(docs, PATH).collect()}
    assert sums == {i: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for i, r in got.items()}


def test_token_files_of_odd_rows(odd, empty):
    got = sorted((r.start, r.n_tokens) for r in tokenfiles.checksums(odd, PATH).collect())
    assert [s for s, _ in got] == np.cumsum([0, *(n for _, n in got)])[:-1].tolist()
    assert tokenfiles.checksums(empty, PATH).count() == 0


def test_base_scores(docs, texts, monkeypatch):
    monkeypatch.setattr(mixing, "TABLE_WORDS", 40)
    monkeypatch.setattr(mixing, "LEXICON", 16)
    got = {r.doc_id: r for r in mixing.scores(docs).collect()}
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for i, t in texts}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_context_mixing_learns(spark):
    """Words that follow one another are far likelier than by their counts alone."""
    rows = [(i, " ".join(f"w{(i * 7 + k * 3) % 50}" for k in range(200))) for i in range(200)]
    got = mixing.scores(spark.createDataFrame(rows, "doc_id bigint, text string")).where("held_out").collect()
    assert sum(r.score for r in got) > 0.5 * sum(r.base_score for r in got)


def test_huffman_paths_are_a_code():
    m = mixing.Model.build([(k, 100 - k) for k in range(50)], 4000, 60, 10)
    sizes = np.diff(m.path_at)
    assert sum(2.0**-s for s in sizes) == pytest.approx(1.0)


def test_scores_of_odd_rows(odd, empty):
    assert mixing.scores(odd).count() == 7 and mixing.scores(empty).count() == 0
