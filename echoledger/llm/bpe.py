"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

Frequent words, counted over all documents, are compiled into an automaton whose states share
suffixes; arcs carry additive outputs whose sum numbers the word, and the number finds its ids.
Workers memory-map it and walk all distinct words of a batch at once. Words outside it are merged
exactly, pair by pair. Texts are cut into words as the vocabulary file says: special tokens, NFC,
lower case, then contractions, runs of letters, single digits and runs of other signs.

Defined cases: null and empty texts have no ids and decode to an empty text; texts of any length
are encoded whole; special-token strings inside a text become their id, as the library does by
default; repeated rows are encoded each; the lexicon size never changes a result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import tempfile
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from echoledger.llm.shared import Tables, commonest, documents_of, mix, powers

#: Words in the automaton, and the bytes that one of them may have: together they bound its size.
LEXICON_WORDS, LEXICON_BYTES = 200_000, 40
#: Merged words in each of the two generations that a worker remembers.
REMEMBERED = 1 << 18
#: Symbols up to which a word's best merge is found by looking at all of them.
SHORT_WORD = 48
#: Characters of text that one vectorised step works on.
STEP_CHARS = 1 << 20

_WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_CONTRACTIONS = {"s": 1, "t": 1, "m": 1, "d": 1, "re": 2, "ve": 2, "ll": 2}
_BASE = 0x9E3779B97F4A7C15
_NARROW_CODES = mix(np.arange(1, 257, dtype=np.uint64))
_classes: list[np.ndarray] = []


def character_classes() -> np.ndarray:
    """Class of every code point; made once in a process."""
    if not _classes:
        kinds = {"L": _LETTER, "N": _NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[list(_WHITE)] = _SPACE
        _classes.append(table)
    return _classes[0]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


def normal(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def narrow(text: str) -> bool:
    """Whether all code points fit a byte."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def cut_words(texts: list[str], bytes_do: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of normalised texts: (code points, as bytes if those do, starts, ends, first word of each text and the end)."""
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("latin-1"), np.uint8) if bytes_do else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    if not len(points):
        none = np.empty(0, np.int64)
        return points, none, none, np.zeros(len(texts) + 1, np.int64)
    kind = character_classes()[points]
    new = np.empty(len(kind), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= kind == _NUMBER
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(kind))
    # An apostrophe that is a run of its own takes the s, t, m, d, re, ve or ll that follows it.
    marks = np.flatnonzero((points[starts] == 39) & (ends - starts == 1) & (ends < len(points)))
    if len(marks):
        marks = marks[kind[ends[marks]] == _LETTER]
        moved_start, drop = starts.copy(), np.zeros(len(starts), bool)
        for m in marks:
            s, e = int(ends[m]), int(ends[m + 1])
            head = "".join(map(chr, points[s : min(s + 2, e)]))
            take = _CONTRACTIONS.get(head[:1]) or _CONTRACTIONS.get(head) or 0
            if take:
                ends[m] = s + take
                moved_start[m + 1] = s + take
                drop[m + 1] = s + take == e
        starts = moved_start[~drop]
        ends = ends[~drop]
    word = kind[np.minimum(starts, len(kind) - 1)] != _SPACE
    starts, ends = starts[word], ends[word]
    rows = np.concatenate(([0], np.cumsum(sizes)))
    return points, starts, ends, np.searchsorted(starts, rows)


def distinct_words(points: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(one place of each distinct word, which of them each word is, its hash)."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    n = len(points)
    prefix = np.zeros(n + 1, np.uint64)
    codes = _NARROW_CODES[points] if points.dtype == np.uint8 else mix(points.astype(np.uint64) + np.uint64(1))
    np.cumsum(codes * powers(_BASE, n), out=prefix[1:])
    hashes = mix((prefix[ends] - prefix[starts]) * powers(pow(_BASE, -1, 1 << 64), n)[starts])
    found, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    return at, which, found


def joined_words(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words in UTF-8 with a line feed between: words hold no white space."""
    size = ends - starts + 1
    total = np.concatenate(([0], np.cumsum(size)))
    picked = points[np.minimum(np.repeat(starts - total[:-1], size) + np.arange(total[-1]), len(points) - 1)]
    picked[total[1:] - 1] = 10
    raw = picked[:-1].tobytes()
    return raw.decode("latin-1").encode() if points.dtype == np.uint8 else raw.decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


class Vocabulary:
    """Ids, merges and special tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.ids = file["model"]["vocab"]
        self.end = file["model"]["end_of_word_suffix"] or ""
        merges = (m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"])
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [names.get(i, "") for i in range(max(names) + 1)]
        self.letters = byte_letters()
        self.split = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the lowest-ranking neighbours merge first, the leftmost of equals."""
        chars = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        chars[-1] += self.end
        ids = [self.ids[c] for c in chars if c in self.ids]
        if len(ids) > SHORT_WORD:
            return self._merge_long(ids)
        none = (1 << 60, -1)
        ranks = [self.merges.get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best[0] == none[0]:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [best[1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = self.merges.get((ids[k], ids[k + 1]), none)
            if k:
                ranks[k - 1] = self.merges.get((ids[k - 1], ids[k]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges from a heap over linked neighbours; stale entries are passed over."""
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*merges[p], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heap = [(rank, k, left, right, new) for rank, new, k, left, right in heap]
        heapq.heapify(heap)
        while heap:
            _, k, left, right, new = heapq.heappop(heap)
            j = after[k]
            if ids[k] != left or j >= n or ids[j] != right:
                continue
            ids[k], ids[j] = new, -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for x in (before[k], k):
                if x >= 0 and after[x] < n and (pair := (ids[x], ids[after[x]])) in merges:
                    rank, made = merges[pair]
                    heapq.heappush(heap, (rank, x, *pair, made))
        return [i for i in ids if i >= 0]

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one after the other, number of ids of each)."""
        rows = [self.merge(w) for w in words]
        return np.array([i for r in rows for i in r], np.int32), np.array([len(r) for r in rows], np.int64)

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


class Lexicon:
    """Minimal acyclic transducer over bytes, as flat arrays in one buffer.

    Arcs are sorted by state and byte. The outputs along a word's path add up to its number in
    sorted order; `ids[first[number] : first[number + 1]]` are its token ids.
    """

    def __init__(self, buffer):
        head = np.frombuffer(buffer, np.int64, 4)
        arcs, states, count, total = map(int, head)
        at = 32
        self.keys = np.frombuffer(buffer, np.int64, arcs, at)
        at += 8 * arcs
        self.first = np.frombuffer(buffer, np.int64, count + 1, at)
        at += 8 * (count + 1)
        self.target = np.frombuffer(buffer, np.int32, arcs, at)
        at += 4 * arcs
        self.output = np.frombuffer(buffer, np.int32, arcs, at)
        at += 4 * arcs
        self.ids = np.frombuffer(buffer, np.int32, total, at)
        at += 4 * total
        self.final = np.frombuffer(buffer, np.bool_, states, at)

    @staticmethod
    def compile(entries: dict[bytes, list[int]]) -> bytes:
        """Adds the words in sorted order; each finished suffix is replaced by an equal state met before."""
        ordered = sorted(w for w in entries if w)
        register: dict[tuple, int] = {}
        arcs_of: list[tuple] = []
        finals: list[bool] = []

        def settle(node: list) -> int:
            key = (node[1], tuple(node[0]))
            if key not in register:
                register[key] = len(arcs_of)
                arcs_of.append(key[1])
                finals.append(node[1])
            return register[key]

        path: list[list] = [[[], False]]
        before = b""
        for word in [*ordered, b""]:
            same = 0
            while same < len(word) and same < len(before) and word[same] == before[same]:
                same += 1
            while len(path) - 1 > same:
                done = settle(path.pop())
                path[-1][0].append((before[len(path) - 1], done))
            for _ in range(same, len(word)):
                path.append([[], False])
            if word:
                path[-1][1] = True
                before = word
        root = settle(path[0])
        below: list[int] = []
        for arcs, final in zip(arcs_of, finals):  # targets come before their sources
            below.append(final + sum(below[t] for _, t in arcs))
        rename = {root: 0} | {s: k + 1 for k, s in enumerate(s for s in range(len(arcs_of)) if s != root)}
        rows = []
        for s, arcs in enumerate(arcs_of):
            passed = int(finals[s])
            for byte, t in arcs:
                rows.append((rename[s] << 8 | byte, rename[t], passed))
                passed += below[t]
        rows.sort()
        final = np.zeros(len(arcs_of), bool)
        for s, f in enumerate(finals):
            final[rename[s]] = f
        ids = [entries[w] for w in ordered]
        first = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
        table = np.array(rows, np.int64).reshape(-1, 3)
        flat = np.array([i for x in ids for i in x], np.int32)
        head = np.array([len(table), len(final), len(ordered), len(flat)], np.int64)
        return b"".join(a.tobytes() for a in (
            head, table[:, 0].copy(), first, table[:, 1].astype(np.int32), table[:, 2].astype(np.int32), flat, final))

    def find(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of the words that lie at `starts` in `data`; -1 where it is not in the lexicon."""
        number = np.zeros(len(starts), np.int64)
        state = np.zeros(len(starts), np.int64)
        alive = np.flatnonzero(lengths > 0) if len(self.keys) else np.empty(0, np.int64)
        number[lengths == 0] = -1
        if not len(self.keys):
            number[:] = -1
        for step in range(int(lengths.max(initial=0))):
            alive = alive[lengths[alive] > step]
            if not len(alive):
                break
            key = state[alive] << 8 | data[starts[alive] + step]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[k] == key
            number[alive[~known]] = -1
            alive, k = alive[known], k[known]
            state[alive] = self.target[k]
            number[alive] += self.output[k]
        number[(number >= 0) & ~self.final[state]] = -1
        return number


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Memo:
    """Words met before and their ids: arrays sorted by hash, in which a batch of words is found at once.

    A word is found only if its bytes are equal; the hash finds the place to compare.
    """

    def __init__(self) -> None:
        self.hashes = np.empty(0, np.uint64)
        self.places = np.empty((4, 0), np.int64)  # first id, ids, first byte, bytes
        self.ids, self.text = np.empty(0, np.int32), np.empty(0, np.uint8)

    def find(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Place of each word; -1 for words not met."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.hashes):
            return out
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        some = np.flatnonzero((self.hashes[at] == hashes) & (self.places[3, at] == lengths))
        own = at[some]
        same = self.text[_ranges(self.places[2, own], lengths[some])] == data[_ranges(starts[some], lengths[some])]
        if len(some):
            firsts = np.cumsum(lengths[some]) - lengths[some]
            out[some] = np.where(np.logical_and.reduceat(same, firsts), own, -1)
        return out

    def add(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Words with distinct ascending hashes; one whose hash is taken is not remembered."""
        at = np.searchsorted(self.hashes, hashes)
        taken = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        taken[inside] = self.hashes[at[inside]] == hashes[inside]
        firsts, begins = np.cumsum(sizes) - sizes + len(self.ids), np.cumsum(lengths) - lengths + len(self.text)
        self.ids = np.concatenate((self.ids, ids))
        self.text = np.concatenate((self.text, data[_ranges(starts, lengths)]))
        new = np.stack((firsts, sizes, begins, lengths))[:, ~taken]
        self.places = np.insert(self.places, at[~taken], new, axis=1)
        self.hashes = np.insert(self.hashes, at[~taken], hashes[~taken])


class Encoder:
    """Encodes lists of texts; `merge_all` gives the ids of words that the lexicon lacks."""

    def __init__(self, special: dict[str, int], split, merge_all: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], lexicon: Lexicon | None = None):
        self.special, self.split, self.merge_all, self.lexicon = special, split, merge_all, lexicon
        self.young, self.old = Memo(), Memo()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets int64[n + 1], ids int32) of all texts."""
        odd = [k for k, t in enumerate(texts) if self.split and "<|" in t and self.split.search(t)]
        if not odd:
            return self._plain(texts)
        pieces: list[str] = []
        plan: list[list[int]] = []
        for k, t in enumerate(texts):
            row, at = [], 0
            for m in self.split.finditer(t) if self.split and "<|" in t else ():
                pieces.append(t[at : m.start()])
                row += [len(pieces) - 1, -1 - self.special[m.group()]]
                at = m.end()
            pieces.append(t[at:])
            plan.append([*row, len(pieces) - 1])
        offsets, ids = self._plain(pieces)
        rows = [np.concatenate([ids[offsets[p] : offsets[p + 1]] if p >= 0 else np.array([-1 - p], np.int32) for p in row]) for row in plan]
        return np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64), np.concatenate(rows).astype(np.int32)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts whose code points fit bytes go by bytes, the others by code points."""
        texts = [normal(t) for t in texts]
        fits = np.fromiter(map(narrow, texts), bool, len(texts))
        if fits.all() or not fits.any():
            return self._step(texts, bool(fits.all()))
        sizes, starts, found, base = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64), [], 0
        for kind in (True, False):
            rows = np.flatnonzero(fits == kind)
            offsets, ids = self._step([texts[k] for k in rows.tolist()], kind)
            sizes[rows], starts[rows] = np.diff(offsets), offsets[:-1] + base
            found.append(ids)
            base += len(ids)
        return np.concatenate(([0], np.cumsum(sizes))), np.concatenate(found)[_ranges(starts, sizes)]

    def _step(self, texts: list[str], bytes_do: bool) -> tuple[np.ndarray, np.ndarray]:
        points, starts, ends, rows = cut_words(texts, bytes_do)
        at, which, hashes = distinct_words(points, starts, ends)
        if not len(at):
            return np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int32)
        raw = joined_words(points, starts[at], ends[at])
        data = np.frombuffer(raw, np.uint8)
        breaks = np.flatnonzero(data == 10)  # words hold no white space
        w_start = np.concatenate(([0], breaks + 1))
        w_size = np.append(breaks, len(data)) - w_start
        first, size, pool, base = np.empty(len(at), np.int64), np.empty(len(at), np.int64), [], 0

        def take(words: np.ndarray, ids: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> None:
            nonlocal base
            pool.append(ids[_ranges(firsts, sizes)])
            first[words], size[words] = base + np.cumsum(sizes) - sizes, sizes
            base += len(pool[-1])

        rest = np.arange(len(at))
        if self.lexicon:
            number = self.lexicon.find(data, w_start, w_size)
            known = np.flatnonzero(number >= 0)
            begin = self.lexicon.first[number[known]]
            take(known, self.lexicon.ids, begin, self.lexicon.first[number[known] + 1] - begin)
            rest = np.flatnonzero(number < 0)
        for memo in (self.young, self.old):
            place = memo.find(hashes[rest], data, w_start[rest], w_size[rest])
            met, own = rest[place >= 0], memo.places[:, place[place >= 0]]
            take(met, memo.ids, own[0], own[1])
            if memo is self.old and len(met):
                self.young.add(hashes[met], data, w_start[met], w_size[met], pool[-1], own[1])
            rest = rest[place < 0]
        if len(rest):
            s, e = w_start[rest].tolist(), (w_start[rest] + w_size[rest]).tolist()
            ids, sizes = self.merge_all([raw[x:y].decode("utf-8", "surrogatepass") for x, y in zip(s, e)])
            take(rest, ids, np.cumsum(sizes) - sizes, sizes)
            self.young.add(hashes[rest], data, w_start[rest], w_size[rest], ids, sizes)
        if len(self.young.hashes) > REMEMBERED:
            self.young, self.old = Memo(), self.young
        length = size[which]
        total = np.concatenate(([0], np.cumsum(length)))
        return total[rows], np.concatenate(pool)[_ranges(first[which], length)]


def text_steps(texts: list[str], limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `limit` characters."""
    i = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield i, k
            i, size = k, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


def frequent_words(docs: DataFrame, split_at: list[str], most: int = LEXICON_WORDS) -> list[str]:
    """The commonest pre-tokens of all documents: counted in tasks, summed by shuffle, at most `most` brought back."""
    pattern = re.compile("|".join(map(re.escape, split_at))) if split_at else None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            counts: dict[bytes, int] = {}
            for i, j in text_steps(texts):
                rows = texts[i:j]
                if pattern:
                    rows = [pattern.sub(" ", t) if "<|" in t else t for t in rows]
                rows = [normal(t) for t in rows]
                for bytes_do in (True, False):
                    points, starts, ends, _ = cut_words([t for t in rows if narrow(t) == bytes_do], bytes_do)
                    at, which, _ = distinct_words(points, starts, ends)
                    if len(at):
                        found = joined_words(points, starts[at], ends[at]).split(b"\n")
                        for w, n in zip(found, np.bincount(which, minlength=len(at)).tolist()):
                            counts[w] = counts.get(w, 0) + n
            short = {w: n for w, n in counts.items() if len(w) <= LEXICON_BYTES}
            yield pa.RecordBatch.from_arrays([pa.array(list(short), pa.binary()).cast(pa.string()), pa.array(list(short.values()), pa.int64())], ["word", "c"])

    tables = Tables(docs.sparkSession, "bpe-words")
    counts = tables.keep(
        documents_of(docs, "text").mapInArrow(counted, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c")).where("c > 1"), "words")
    found = sorted(r["word"] for r in commonest(counts, most, "word"))
    tables.drop(counts)
    return found


def build_lexicon(words: list[str], vocabulary: Vocabulary) -> bytes:
    return Lexicon.compile({w.encode(): vocabulary.merge(w) for w in words})


_opened: dict[tuple, Encoder] = {}


def worker_encoder(path: str, lexicon) -> tuple[Encoder, Vocabulary]:
    """One encoder in a worker process; the automaton lies in a nameless mapped file."""
    key = (path, lexicon.id if hasattr(lexicon, "id") else id(lexicon))
    if key not in _opened:
        _opened.clear()
        vocabulary = Vocabulary(path)
        with tempfile.TemporaryFile() as f:
            f.write(lexicon.value)
            f.flush()
            mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        _opened[key] = (Encoder(vocabulary.special, vocabulary.split, vocabulary.merge_all, Lexicon(mapped)), vocabulary)
    return _opened[key]


def encode(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, ids array<int> and the text decoded from them, for every document."""
    return _encoded(docs, path, lexicon_words, False)


def digests(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids in decimal and of the decoded text."""
    return _encoded(docs, path, lexicon_words, True)


def _encoded(docs: DataFrame, path: str, lexicon_words: int, digest: bool) -> DataFrame:
    vocabulary = Vocabulary(path)
    words = frequent_words(docs, list(vocabulary.special), lexicon_words)
    shared = docs.sparkSession.sparkContext.broadcast(build_lexicon(words, vocabulary))  # bounded by LEXICON_WORDS x LEXICON_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, vocab = worker_encoder(path, shared)
        decimal = [str(i) for i in range(len(vocab.tokens))]
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in text_steps(texts):
                offsets, ids = encoder.encode(texts[i:j])
                part = b.column(0).slice(i, j - i)
                if not digest:
                    rows = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                    plain = ids.tolist()
                    text = [vocab.decode(plain[x:y]) for x, y in zip(offsets, offsets[1:])]
                    yield pa.RecordBatch.from_arrays([part, rows, pa.array(text, pa.string())], ["doc_id", "ids", "decoded"])
                    continue
                plain, sums, decoded = ids.tolist(), [], []
                for x, y in zip(offsets.tolist(), offsets[1:].tolist()):
                    row = plain[x:y]
                    sums.append(hashlib.sha256(" ".join(map(decimal.__getitem__, row)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(vocab.decode(row).encode("utf-8", "replace")).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(np.diff(offsets), pa.int64()), pa.array(sums), pa.array(decoded)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "doc_id bigint, ids array<int>, decoded string"
    return documents_of(docs, "doc_id", "text").mapInArrow(run, schema)
