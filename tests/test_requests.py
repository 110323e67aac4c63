"""Canonical requests: what folds together, what stays apart, what is turned away."""

import json

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from echoledger.functions import canonical as C
from echoledger.operators import requests as N
from echoledger.sources import logs


def keys(spark, bodies):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    return {r.i: r for r in N.canonicalize(df).collect()}


BASE = {"model": "claude-3-5-haiku-20241022", "messages": [{"role": "user", "content": "hi"}]}


def test_bodies_that_ask_the_same_share_a_key(spark):
    same = [
        BASE,
        {**BASE, "model": " Claude-3-5-HAIKU-20250101\t"},
        {"messages": [{"content": [{"text": "hi", "type": "text"}], "role": "user"}], "model": "claude-3-5-haiku"},
        {**BASE, "messages": [{"role": "user", "content": [{"type": "text", "text": "hi", "cache_control": {"type": "x"}}]}]},
        {**BASE, "system": ""},
        {**BASE, "system": None},
        {**BASE, "tool_choice": None},
        {**BASE, "unheard_of": 1},
        *({**BASE, f: {"any": [1]}} for f in C.IGNORED_FIELDS),
    ]
    found = keys(spark, [json.dumps(b) for b in same])
    assert len(found) == len(same)
    assert len({r.prompt_hash for r in found.values()}) == 1


def test_bodies_that_ask_otherwise_do_not(spark):
    tool = [{"name": "f"}]
    other = [
        BASE,
        {**BASE, "model": "claude-3-5-sonnet"},
        {**BASE, "system": "be brief"},
        {**BASE, "tools": tool},
        {**BASE, "tools": tool, "tool_choice": {"type": "any"}},
        {**BASE, "tool_choice": {"type": "auto"}},
        {**BASE, "messages": [{"role": "assistant", "content": "hi"}]},
        {**BASE, "messages": [{"role": "user", "content": [{"type": "text", "text": "hi"}, {"type": "image", "id": 1}]}]},
        {**BASE, "messages": [{"role": "user", "content": [{"type": "image", "id": 1}, {"type": "text", "text": "hi"}]}]},
        {"messages": BASE["messages"]},
    ]
    found = keys(spark, [json.dumps(b) for b in other])
    assert len({r.prompt_hash for r in found.values()}) == len(other)
    explicit = keys(spark, [json.dumps({**BASE, "tools": tool, "tool_choice": {"type": "auto"}}), json.dumps(other[3])])
    assert explicit[0].prompt_hash == explicit[1].prompt_hash


def test_canonical_form_and_embedding_text(spark):
    body = {
        "model": "M", "system": [{"type": "text", "text": "sys", "cache_control": {}}, {"type": "image"}],
        "messages": [{"role": "user", "content": "q \"x\" é"}, {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool_use", "z": 1, "a": 2}]}, {"content": None}],
    }
    r = keys(spark, [json.dumps(body)])[0]
    assert r.prompt_text == (
        '{"messages":[{"content":[{"text":"q \\"x\\" é","type":"text"}],"role":"user"},'
        '{"content":[{"text":"a","type":"text"},{"a":2,"type":"tool_use","z":1}],"role":"assistant"},{"content":null,"role":null}],'
        '"model":"m","system":[{"text":"sys","type":"text"},{"type":"image"}]}'
    )
    assert r.embed_text == 'sys\nuser: q "x" é\nassistant: a'
    assert r.model == "m"


def test_embedding_text_falls_back_to_its_input(spark):
    df = spark.createDataFrame([("not json",), ('{"messages":[]}',), ('{"messages":[{"content":[{"type":"image"}]}]}',)], "t string")
    for row in df.select("t", C.embedding_text(F.col("t")).alias("e")).collect():
        assert row.e == row.t


def test_rejects(spark):
    cases = {
        "{": "invalid_json", "[1]": "not_object", '{"messages":null}': "messages_not_list", '{"messages":[1]}': "message_not_object",
        '{"a":1,"a":2}': "duplicate_key", '{"messages":[]} trailing': "invalid_json", '{"messages":[]}{"a":1}': "invalid_json",
        '{"messages":[]},{"a":1}': "invalid_json", "": "invalid_json", '{"messages":"x"}': "messages_not_list",
    }
    df = spark.createDataFrame([(b,) for b in [*cases, json.dumps(BASE), "{}"]], "body string")
    assert {r.body: r.reject_reason for r in N.rejects(df).collect()} == cases
    assert N.canonicalize(df).count() == 2


json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-1000, 1000) | st.text(max_size=6),
    lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(max_size=4), v, max_size=3),
    max_leaves=6,
)


def shuffled(v, rnd):
    if isinstance(v, dict):
        items = list(v.items())
        rnd.shuffle(items)
        return {k: shuffled(x, rnd) for k, x in items}
    return [shuffled(x, rnd) for x in v] if isinstance(v, list) else v


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(json_values, json_values, st.text(max_size=8)), min_size=1, max_size=8), st.randoms())
def test_key_order_never_matters(spark, parts, rnd):
    bodies = []
    for tools, block, text in parts:
        body = {"model": "m", "tools": tools, "messages": [{"role": "user", "content": [{"type": "x", "v": block}, {"type": "text", "text": text}]}]}
        bodies += [json.dumps(body), json.dumps(shuffled(body, rnd), ensure_ascii=False, indent=1)]
    found = keys(spark, bodies)
    for i in range(0, len(bodies), 2):
        assert found[i].prompt_hash == found[i + 1].prompt_hash


def test_scans(spark, tmp_path):
    (tmp_path / "log.json").write_text("\n".join(json.dumps(r) for r in [
        {"request_id": "1", "method": "POST", "path": "/v1/messages", "body": "{}"},
        {"request_id": "2", "method": "GET", "path": "/v1/messages", "body": "{}"},
        {"request_id": "3", "method": "POST", "path": "/v1/models", "body": "{}"},
    ]))
    log = logs.read_request_log(spark, str(tmp_path / "log.json"))
    assert [r.request_id for r in logs.eligible(log).collect()] == ["1"]
    (tmp_path / "pairs.jsonl").write_text('// note\n\n  {"a":"x","b":"y","expect":"hit"}\n{"a":"x","b":"z","expect":"miss"}\n  // end')
    pairs = logs.read_pairs(spark, str(tmp_path / "pairs.jsonl"))
    assert sorted((r.a, r.b, r.expect) for r in pairs.collect()) == [("x", "y", "hit"), ("x", "z", "miss")]


def test_stream_flag(spark):
    bodies = ['{"stream":true}', '{"stream":false}', '{"stream":1}', '{"stream":0}', '{"stream":null}', "{}", "bad", '{"stream":"no"}']
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    assert [r.w for r in df.select(C.wants_stream(F.col("b")).alias("w")).collect()] == [True, False, True, False, False, False, False, True]
