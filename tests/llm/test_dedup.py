"""Near-duplicates, repeated strings and fingerprints against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from echoledger.llm import components, fingerprints, neardup, suffixes
from echoledger.llm.shared import Tables


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_roots(texts):
    s = {i: shingles(t) for i, t in texts}
    links = [(i, j) for i in s for j in s if i < j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])]
    return s, roots(s, links)


def test_near_duplicates(docs, texts):
    sets, want = near_roots(texts)
    got = neardup.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in want}


def test_large_group_of_near_copies(spark):
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join([*base[: i % 190], f"x{i}", *base[i % 190 + 1 :]])) for i in range(600)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.component_id for r in got.collect()} == {0}


def copies(n, words, edits, seed=1):
    """Texts of which many pairs lie just under and just over 0.75, and the brute-force roots."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    rows = []
    for i in range(n):
        own = list(base)
        for k in rng.sample(range(words), rng.choice(edits)):
            own[k] = f"x{i}-{k}"
        rows.append((i, " ".join(own)))
    number = {}
    sets = [shingles(t) for _, t in rows]
    for s in sets:
        for x in s:
            number[x] = number.get(x, 0) + 1
    number = {x: k for k, x in enumerate(x for x, c in number.items() if c > 1)}
    m = np.zeros((n, len(number)), np.float32)
    for i, s in enumerate(sets):
        m[i, [number[x] for x in s if x in number]] = 1
    common, size = m @ m.T, np.array([len(s) for s in sets])
    a, b = np.nonzero(100 * common >= 75 * (size[:, None] + size[None] - common))
    return rows, roots(range(n), [(i, j) for i, j in zip(a.tolist(), b.tolist()) if i < j])


def test_crowded_copies_around_the_threshold(spark):
    rows, want = copies(2200, 300, (4, 5, 6, 7))
    assert len(set(want.values())) > 1
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_pair_outside_the_window_of_its_deepest_order(spark):
    """Rows 1 and 3 meet in a later order only: in the first, row 2 lies between them and the window is one row."""
    first = neardup.FIRST_TREES
    one = np.arange(neardup.HASHES, dtype=">u2")
    other = one + np.uint16(1000)
    tree = slice(first * neardup.DEPTH, (first + 1) * neardup.DEPTH)
    other[tree] = one[tree]
    rows = [(1, 100, one.tobytes(), 1), (2, 100, other.astype(">u2").tobytes(), 2), (3, 100, one.tobytes(), 3)]
    reps = spark.createDataFrame([(i, n, bytearray(s), c) for i, n, s, c in rows], "id bigint, n bigint, sig binary, comp bigint")
    got = neardup.candidates(reps, Tables(spark, "test"), range(first, neardup.TREES), 1)
    assert [tuple(r) for r in got.collect()] == [(1, 3)]


def test_two_texts_of_one_id_keep_their_links(spark):
    a, b = ([f"{c}{k}" for k in range(80)] for c in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "end"])), (3, " ".join([*b, "end"]))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_near_duplicates_of_odd_rows(odd, empty):
    got = sorted(tuple(r)[:4] for r in neardup.near_duplicates(odd).collect() if r.doc_id is not None)
    assert got == [(1, 3, 1, True), (1, 3, 1, True), (2, 0, 2, True), (2, 1, 2, True), (3, 0, 3, True)]
    assert [r.component_id for r in neardup.near_duplicates(odd).collect() if r.doc_id is None] == [None, None]
    left = neardup.one_of_each(odd)
    # Document 2 has two texts, and both stay.
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [1, 2, 2, 3]
    assert neardup.near_duplicates(empty).count() == 0


def test_one_of_each_keeps_different_texts_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(80)) for x in "abc")
    rows = [(2, ""), (2, "other text of one id"), (2, a), (2, a), (1, a + " end"), (5, b), (5, c), (4, c + " end"), (None, a)]
    left = neardup.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS _gone", "2 AS kept"))
    assert sorted(tuple(r)[:2] for r in left.collect() if r.doc_id) == sorted(
        [(1, a + " end"), (2, ""), (2, "other text of one id"), (4, c + " end"), (5, b)])
    assert left.columns == ["doc_id", "text", "_gone", "kept"] and left.where("doc_id IS NULL").count() == 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90)], "a bigint, b bigint")
    got = {r.id: r.root for r in components.components(edges, Tables(spark, "test")).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 100: 90}


def removed(texts, length):
    raw = {i: (t or "").encode() for i, t in texts}
    where = {}
    for i, b in raw.items():
        for k in range(len(b) - length + 1):
            where.setdefault(b[k : k + length], []).append((i, k))
    mask = {i: np.zeros(len(b), bool) for i, b in raw.items()}
    for places in where.values():
        if len(places) > 1:
            for i, k in places:
                mask[i][k : k + length] = True
    return raw, mask


@pytest.mark.parametrize("length,hot", [(400, 20_000), (100, 5)])
def test_repeated_spans(docs, texts, monkeypatch, length, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    raw, mask = removed(texts, length)
    want = {}
    for i, m in mask.items():
        kept = bytes(np.frombuffer(raw[i], np.uint8)[~m])
        want[i] = (len(m), int(m.sum()), int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in suffixes.repeated_spans(docs, length).collect()} == want
    left = {r.doc_id: r for r in suffixes.strip_repeats(docs, length).collect()}
    for i, t in texts:
        if not mask[i].any():
            assert left[i].text == t
        else:
            assert left[i].n_chars == len(left[i].text) and len(left[i].text.encode()) >= want[i][0] - want[i][1]


def test_long_texts_are_sampled_in_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 101, n, dtype=np.uint8) for n in (3000, 0, 70, 64, 9000, 12)]
    texts[4][5000:6000] = texts[0][:1000]
    data, rows = np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    sample = suffixes.Sample(64)
    whole = sample.places(data, rows)
    assert len(whole[0]) > 300
    for piece in (50, 64, 700, 5000):
        monkeypatch.setattr(suffixes, "PIECE", piece)
        assert all(np.array_equal(x, y) for x, y in zip(whole, sample.places(data, rows)))


def test_repeats_of_odd_rows(odd, empty):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffixes.repeated_spans(odd, 64).collect())
    assert [g[2] for g in got] == [0] * 7
    assert suffixes.strip_repeats(odd, 64).columns == odd.columns and suffixes.strip_repeats(odd, 64).count() == 7
    assert suffixes.repeated_spans(empty).count() == 0 and suffixes.strip_repeats(empty).count() == 0


def test_fingerprints(docs, texts):
    order = sorted(texts, key=lambda r: -r[0])
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    assert len(got) == len(texts)
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_next <= 1 and (got[i].near_edited > 0.5 or not text)
        assert got[i].near_edited == 1 or got[i].fingerprint != got[i].edited_fingerprint
    same = {}
    for i, text in texts:
        same.setdefault(text or "", set()).add(got[i].fingerprint)
    assert all(len(f) == 1 for f in same.values()) and len({min(f) for f in same.values()}) == len(same)


def test_prefix_hashes():
    p = fingerprints.PrefixHashes(fingerprints.code_points("abracadabra abracadabrx"))
    assert p.common(0, 12) == 10 and p.equal(0, 7, 4) and not p.equal(0, 1, 2)
    f = fingerprints.fingerprints([fingerprints.code_points("x" * 500), fingerprints.code_points("y" * 500)])
    assert fingerprints.likeness(fingerprints.Fingerprint.parse(str(f[0])), f[0]) == 1.0 and fingerprints.likeness(*f) == 0.0


def test_fingerprints_of_odd_rows(odd, empty):
    got = fingerprints.edited_fingerprints(odd).collect()
    assert len(got) == 7 and fingerprints.edited_fingerprints(empty).count() == 0
    assert fingerprints.fingerprint_documents(odd).count() == 7
