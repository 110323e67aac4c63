import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from echoledger.llm import turns

COLUMNS = "conv_id bigint, turn bigint, role string, text string"


def damaged(rows):
    out = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fate == 1:
            text = ""
        elif fate == 2:
            text = re.sub("[.!?]", "", text)
        elif fate == 4:
            role = "user"
        out[c] += [(t, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def cheapest(rows):
    """(cost, audit, lines) by trying all edits."""
    pattern = re.compile("(s?(ua)+)?")

    def can(roles):  # may this start of a pattern still be finished?
        return any(pattern.fullmatch(roles + end) for end in ("", "a", "ua"))

    @lru_cache(None)
    def rest(i, roles, inserts):
        found = []
        if i == len(rows) and pattern.fullmatch(roles):
            found.append((0, "", ()))
        short = lambda r: r[:-2] if len(r) > 3 else r  # a pair less leaves the same roles possible
        if inserts < 2:
            for role in ("user", "assistant"):
                if can(roles + role[0]):
                    c, a, t = rest(i, short(roles + role[0]), inserts + 1)
                    found.append((c + 2, "I" + a, (f"{role}:", *t)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, t = rest(i + 1, roles, 0)
            found.append((c + 3, "D" + a, t))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                for edit, new, cost in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if new[:1] and can(roles + new[0]):
                        c, a, t = rest(i + 1, short(roles + new[0]), 0)
                        found.append((c + cost + more, edit + a, (f"{new}:{text}", *t)))
        return min(found) if found else (10**9, "", ())

    return rest(0, "", 0)


def brute(rows):
    out = []
    for c, own in damaged(rows).items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, listed, illegal = set(), [], 0
        for k, (_, role, text) in enumerate(own):
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            listed.append((role, text, fault))
            illegal += k > 0 and own[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        known = [t for t, *_ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit, lines = cheapest(tuple(listed))
        count = [sum(f == name for *_, f in listed) for name in ("blank", "duplicate", "truncated")]
        out.append((c, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        t = rng.randint(-2, 3)
        for _ in range(rng.randint(0, longest)):
            t += rng.choice((1, 1, 1, 2, 3))
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "sys", "usher", "bot", "", "User", None))
            text = rng.choice(("Yes.", "No!", "why", "Yes.", "", " \t", "end.\n ", "é", None, "a? b", "x" * 40 + "."))
            rows.append((c, rng.choice((t, t, t, t, None)), role, text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_reports_equal_brute_force(spark, seed):
    rows = conversations(seed, 80) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, None, None)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    for name in ("present", "fault", "digest", "later", "c", "d", "fate", "times", "n"):
        df = df.withColumn(name, F.lit("mine"))
    got = sorted((tuple(r) for r in turns.damaged_reports(df).collect()), key=repr)
    assert got == brute(rows)


def test_giant_conversation_spills(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(("user", "assistant")), f"turn {rng.randrange(9000)}{rng.choice('.!x')}") for t in range(6000)]
    rows += [(8, t, ("user", "assistant")[t % 2], f"{t} " + "long " * 5000 + ".") for t in range(6)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    assert turns.TRACE_ROWS > 6000
    small = {r.conv_id: r for r in turns.reports(turns.damage(df), spill_bytes=512).collect()}
    large = {r.conv_id: r for r in turns.damaged_reports(df).collect()}
    assert small == large and len(large[7].audit) > 5000
    # A conversation that is longer than one block of backpointers.
    block, turns.TRACE_ROWS = turns.TRACE_ROWS, 50
    try:
        state, other = turns.Conversation(256), turns.Conversation()
        for k, (_, t, role, text) in enumerate(rows[:2000]):
            for s in (state, other):
                s.add(t, role, text, 3 if text[-1] == "x" else 0)
        audit = state.audit()
        turns.TRACE_ROWS = block
        assert audit == other.audit()
        assert list(state.repaired(audit[1])) == list(other.repaired(audit[1]))
    finally:
        turns.TRACE_ROWS = block


def test_repaired_turns_alternate_and_match_their_digest(spark):
    df = spark.createDataFrame(conversations(9, 60), COLUMNS)
    hurt = turns.damage(df)
    made = {}
    for r in sorted(turns.repaired_turns(hurt).collect(), key=lambda r: (r.conv_id, r.position)):
        made.setdefault(r.conv_id, []).append(r)
    for r in turns.reports(hurt).collect():
        own = made.get(r.conv_id, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in own))
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in own).encode()).hexdigest() == r.repaired_sha256
        assert "".join(x.edit for x in own) == r.audit.replace("D", "")


def test_empty_table(spark):
    df = spark.createDataFrame([], COLUMNS)
    assert turns.damaged_reports(df).count() == 0
    assert turns.repaired_turns(df).columns == ["conv_id", "position", "edit", "role", "text"]
