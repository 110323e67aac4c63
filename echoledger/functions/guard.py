"""Polarity guard: does a pair of texts ask opposite things.

Each text is reduced once to the few features that can conflict; a pair is then
checked on those features, as columns here and as matrices in the block kernel.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from echoledger.functions.binding import let
from echoledger.functions.words import Known, words_of

# Words, prefixes and pairs that results depend on.
NEGATIONS = ("not", "no", "never", "without", "cannot", "none", "non")
ARTICLES = ("a", "an", "the")
DIRECTION_WORDS = ("to", "into")
NEGATING_PREFIXES = ("un", "de", "dis", "non", "ir", "il")
KNOWN_PREFIXES = ("un", "de", "dis", "non", "ir", "il", "im", "in", "en", "ex", "a", "re")
OPPOSING_PREFIXES = (("en", "de"), ("en", "dis"), ("im", "ex"), ("in", "ex"), ("in", "de"), ("a", "de"))
OPPOSITES = (
    ("read", "write"), ("add", "remove"), ("get", "set"), ("push", "pull"),
    ("open", "close"), ("start", "stop"), ("show", "hide"), ("up", "down"),
    ("in", "out"), ("on", "off"), ("left", "right"), ("min", "max"),
    ("first", "last"), ("before", "after"), ("asc", "desc"),
    ("ascending", "descending"), ("true", "false"), ("input", "output"),
    ("source", "target"), ("login", "logout"), ("upload", "download"),
    ("redo", "undo"), ("expand", "collapse"), ("accept", "reject"),
    ("allow", "deny"), ("commit", "rollback"), ("raise", "catch"),
    ("throw", "catch"), ("buy", "sell"), ("send", "receive"),
    ("publish", "consume"), ("master", "replica"),
)

_EDGE = r"[^\p{L}\p{N}_]"
# one letter beyond 16 bits is written out: without it Java looks back by half of such a letter
_INNER = "[\\p{L}\\p{N}_\U00010000]"
# the first letter is looked at before anything else, as most places of a text have another
NEGATION_PATTERN = rf"(?=[{''.join(sorted({w[0] for w in NEGATIONS}))}])(?:(?<!{_INNER})(?:{'|'.join(NEGATIONS)})(?!{_INNER})|n't)"
_NEGATED_WORD = rf"^(?:{'|'.join(NEGATING_PREFIXES)})(.+)$"
# No known prefix starts another, so a word has at most one; only some of them oppose.
_OPPOSABLE = tuple(p for p in KNOWN_PREFIXES if any(p in pair for pair in OPPOSING_PREFIXES))
_OPPOSABLE_WORD = rf"^({'|'.join(_OPPOSABLE)})(?=.{{3,}}$)"
_STEM, _PREFIX = re.compile(_NEGATED_WORD), re.compile(_OPPOSABLE_WORD)
#: Texts that are read at a time.
_TEXTS = 64


def _table(pairs) -> dict[str, list[str]]:
    """Each member of a pair to the members it opposes."""
    table: dict[str, list[str]] = {}
    for x, y in pairs:
        table.setdefault(x, []).append(y)
        table.setdefault(y, []).append(x)
    return table


_SWAPS, _LEXICON = _table(OPPOSING_PREFIXES), _table(OPPOSITES)


def has_negation(text: Column) -> Column:
    return F.regexp_like(F.lower(text), F.lit(NEGATION_PATTERN))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def only_in(a: Column, b: Column) -> Column:
    """Distinct words of a that b lacks."""
    return F.array_except(a, b)


def direction(toks: Column) -> Column:
    """struct(source, target) around the last to/into, skipping articles; NULL without both."""
    n = F.size(toks)

    def around(r: Column) -> Column:
        at = n - r  # tokens before the direction word
        plain = lambda t: ~t.isin(*ARTICLES)
        source = F.try_element_at(F.filter(F.slice(toks, F.lit(1), F.greatest(at, F.lit(0))), plain), F.lit(-1))
        target = F.try_element_at(F.filter(F.slice(toks, at + 2, F.greatest(r - 1, F.lit(0))), plain), F.lit(1))
        pair = F.struct(source.alias("source"), target.alias("target"))
        inside = (r > 1) & (at > 0) & source.isNotNull() & target.isNotNull()
        return F.when(inside, pair)

    def from_end(rev: Column) -> Column:
        places = [F.array_position(rev, w) for w in DIRECTION_WORDS]
        nearest = F.array_min(F.filter(F.array(*places), lambda p: p > 0))
        return nearest.cast("int")

    return let(let(F.reverse(toks), from_end), around)


def _opposites(word: str) -> tuple[str, ...]:
    """Words that reverse this one: its stem without a negating prefix, the same stem
    under an opposing prefix, and its partners in the lexicon."""
    stem = _STEM.match(word) if word.startswith(NEGATING_PREFIXES) else None
    prefix = _PREFIX.match(word) if word.startswith(_OPPOSABLE) else None
    swapped = [p + word[prefix.end(1):] for p in _SWAPS[prefix[1]]] if prefix else []
    return (*([stem[1]] if stem else []), *swapped, *_LEXICON.get(word, ()))


def _way(toks: list[str], own: dict[str, None]) -> tuple[str | None, str | None]:
    """What direction gives, for one list of tokens and its distinct words."""
    if not any(w in own for w in DIRECTION_WORDS):
        return None, None
    at = next((i for i in range(len(toks) - 1, -1, -1) if toks[i] in DIRECTION_WORDS), -1)
    source = next((toks[i] for i in range(at - 1, -1, -1) if toks[i] not in ARTICLES), None)
    target = next((toks[i] for i in range(at + 1, len(toks)) if toks[i] not in ARTICLES), None)
    return (source, target) if source is not None and target is not None else (None, None)


# given as a type, because text would need a session while this module is loaded
_WORD_FEATURES = StructType([
    StructField("words", ArrayType(StringType())),
    StructField("opp", ArrayType(StructType([StructField("x", StringType()), StructField("y", StringType())]))),
    StructField("source", StringType()), StructField("target", StringType())])


def _word_features(texts: pa.Array) -> pa.Array:
    """Distinct words, opposed pairs and direction of lower-cased texts: one pass over a text, opposites looked up once a word."""
    known, out = Known(_opposites), []
    for start in range(0, len(texts), _TEXTS):
        some = texts.slice(start, _TEXTS)
        words, n_words, xs, ys, n_pairs, ways = [], [0], [], [], [0], []
        for t in some.to_pylist():
            toks = words_of(t or "")
            own = dict.fromkeys(toks)
            for w, found in zip(own, map(known.__getitem__, own)):
                for y in found:
                    if y not in own:
                        xs.append(w)
                        ys.append(y)
            words.extend(own)
            n_words.append(len(words))
            n_pairs.append(len(xs))
            ways.append(_way(toks, own))
        pairs = pa.StructArray.from_arrays([pa.array(xs, pa.string()), pa.array(ys, pa.string())], ["x", "y"])
        missing = some.is_null()
        out.append(pa.StructArray.from_arrays([
            pa.ListArray.from_arrays(pa.array(n_words, pa.int32()), pa.array(words, pa.string()), mask=missing),
            pa.ListArray.from_arrays(pa.array(n_pairs, pa.int32()), pairs, mask=missing),
            pa.array([w[0] for w in ways], pa.string()), pa.array([w[1] for w in ways], pa.string())], ["words", "opp", "source", "target"]))
    return pa.concat_arrays(out) if out else pa.array([], to_arrow_type(_WORD_FEATURES))


def features(text: Column) -> Column:
    """struct(neg, words, opp, source, target): all the guard needs to know about a text."""
    # made here: a module that holds a function of a session cannot be sent to tasks
    read = F.arrow_udf(_word_features, _WORD_FEATURES)(F.lower(text))
    return F.struct(has_negation(text).alias("neg"), *[read[c].alias(c) for c in ("words", "opp", "source", "target")])


def _opposed_to(a: Column, b: Column) -> Column:
    """Some word of a, absent from b, has its opposite in b and not in a."""
    meets = F.arrays_overlap(F.transform(a["opp"], lambda o: o["y"]), b["words"])
    return meets & F.exists(
        a["opp"], lambda o: F.array_contains(b["words"], o["y"]) & ~F.array_contains(b["words"], o["x"])
    )


def negation_conflict(a: Column, b: Column) -> Column:
    return a["neg"] != b["neg"]


def word_conflict(a: Column, b: Column) -> Column:
    return F.coalesce(_opposed_to(a, b) | _opposed_to(b, a), F.lit(False))


def direction_conflict(a: Column, b: Column) -> Column:
    swapped = (a["source"] == b["target"]) & (a["target"] == b["source"]) & (a["source"] != a["target"])
    return F.coalesce(swapped, F.lit(False))


def is_safe(a: Column, b: Column) -> Column:
    """True unless the texts behind the two feature structs conflict; the order of a and b never matters."""
    return ~(negation_conflict(a, b) | direction_conflict(a, b) | word_conflict(a, b))
