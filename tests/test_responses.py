"""Event streams and JSON messages: counting, assembling, replaying."""

import json

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from echoledger.functions import responses as R
from echoledger.operators import responses as RS


def column(spark, raws, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    return [r.x for r in df.select("i", expr(F.col("raw")).alias("x")).orderBy("i").collect()]


def sse(*events, eol="\n"):
    return "".join(f"event: {e['type']}{eol}data: {json.dumps(e)}{eol}{eol}" for e in events)


START = {"type": "message_start", "message": {"id": "m", "type": "message", "usage": {"input_tokens": 11, "output_tokens": 1}}}
TEXT = {"type": "content_block_start", "index": 0, "content_block": {"type": "text", "text": ""}}
TOOL = {"type": "content_block_start", "index": 1, "content_block": {"type": "tool_use", "id": "t", "name": "f", "input": {}}}


def said(t, index=0):
    return {"type": "content_block_delta", "index": index, "delta": {"type": "text_delta", "text": t}}


def argued(t, index=1):
    return {"type": "content_block_delta", "index": index, "delta": {"type": "input_json_delta", "partial_json": t}}


def closed(n, reason="end_turn"):
    return {"type": "message_delta", "delta": {"stop_reason": reason}, "usage": {"output_tokens": n}}


def test_tokens(spark):
    whole = sse(START, TEXT, said("a"), closed(4), closed(9))
    cases = [
        (whole, (11, 9)),
        (whole.replace("\n", "\r\n"), (11, 9)),
        ("data: {broken\n" + whole, (11, 9)),
        (sse(START, {**START, "message": {"usage": {"input_tokens": 7}}}), (7, 0)),
        (sse({**START, "message": {"usage": {"input_tokens": "x"}}}, closed(3), closed(None), closed("y")), (0, 3)),
        ("", (0, 0)),
        ('  {"usage":{"input_tokens":5,"output_tokens":6}}', (5, 6)),
        ('{"usage":{"input_tokens":5,"output_tokens":"many"}}', (0, 0)),
        ('{"usage":null}', (0, 0)),
        ('{"usage":{"input_tokens":5', (0, 0)),
    ]
    got = column(spark, [c[0] for c in cases], R.tokens)
    assert [(g.input_tokens, g.output_tokens) for g in got] == [c[1] for c in cases]


def test_assembly(spark):
    raws = [
        sse(START, TEXT, said("He"), said("llo"), {"type": "content_block_stop", "index": 0}, closed(2), {"type": "message_stop"}),
        sse(START, TEXT, TOOL, argued('{"a":'), argued("1}"), said("x"), closed(2, "tool_use"), eol="\r\n"),
        sse(START, TOOL, argued("{bad")),
        sse(START, TOOL, argued("")),
        sse(START, TEXT, said("lost", 5)),
        "",
    ]
    a, b, c, d, e, f = (json.loads(x) for x in column(spark, raws, R.assemble))
    assert a == {"id": "m", "type": "message", "content": [{"type": "text", "text": "Hello"}], "stop_reason": "end_turn", "usage": {"output_tokens": 2}}
    assert b["content"] == [{"type": "text", "text": "x"}, {"type": "tool_use", "id": "t", "name": "f", "input": {"a": 1}}]
    assert b["stop_reason"] == "tool_use"
    assert c["content"] == [{}, {"type": "tool_use", "id": "t", "name": "f", "input": {}, "partial_json_unparsed": "{bad"}]
    assert d["content"][1]["input"] == {}
    assert e["content"] == [{"type": "text", "text": ""}]
    assert f == {"content": []}


def test_completeness_and_replay_routing(spark):
    stream = sse(START, TEXT, said("hi"), closed(1), {"type": "message_stop"})
    message = '{"type":"message","content":[{"type":"text","text":"hi"}]}'
    rows = [(stream, 500, True), (sse(START), 200, False), (message, 200, True), (message, 500, False), ('{"type":"error"}', 200, False), (message[:-1], 200, False)]
    df = spark.createDataFrame(rows, "raw string, status int, want boolean")
    assert df.where(R.is_complete(F.col("raw"), F.col("status")) != F.col("want")).count() == 0
    both = spark.createDataFrame([(stream, True), (stream, False), (message, True), (message, False)], "raw string, s boolean")
    out = [r.x for r in both.select(R.replay(F.col("raw"), F.col("s")).alias("x")).collect()]
    assert out[0] == stream and out[3] == message
    assert json.loads(out[1])["content"] == [{"type": "text", "text": "hi"}]
    assert out[2].startswith("event: message_start\ndata: ") and out[2].endswith('data: {"type":"message_stop"}\n\n')
    assert column(spark, ["plain", "[1]"], R.expand) == ["plain", "[1]"]


blocks = st.one_of(
    st.builds(lambda t: {"type": "text", "text": t}, st.text(max_size=12)),
    st.builds(lambda k, v: {"type": "tool_use", "id": k, "name": "f", "input": {k: v}}, st.text(max_size=5), st.integers(-9, 9) | st.text(max_size=5)),
    st.builds(lambda n: {"type": "image", "n": n}, st.integers(0, 9)),
)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.lists(blocks, max_size=4), st.sampled_from(["end_turn", "tool_use", None]), st.integers(0, 99)), min_size=1, max_size=10))
def test_round_trip(spark, messages):
    raws = [
        json.dumps({"id": "m", "type": "message", "content": c, "stop_reason": s, "usage": {"input_tokens": 1, "output_tokens": n}})
        for c, s, n in messages
    ]
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(raws)], "response_id string, raw string")
    assert RS.round_trip_report(df).where("not (same_content and same_stop and same_output_tokens)").count() == 0
