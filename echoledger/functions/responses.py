"""Response buffers: token counts, assembly, replay and completeness, as column expressions.

A buffer is one row, so everything here works inside the row and never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from echoledger.functions.binding import let
from echoledger.functions.canonical import json_list, kind, parse_whole, part
from echoledger.sources.logs import data_events


def is_json_form(raw: Column) -> Column:
    return F.startswith(F.regexp_replace(raw, r"^\s+", ""), F.lit("{"))


def _typed(event: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(event, "$.type", "string") == name, F.lit(False))


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def stream_tokens(raw: Column) -> Column:
    """struct(input_tokens, output_tokens) of an event stream; the last report wins."""
    return let(data_events(raw, indented=False), _reported)


def _reported(events: Column) -> Column:
    start = _last(F.filter(events, lambda e: _typed(e, "message_start")))
    reports = F.filter(
        F.transform(
            F.filter(events, lambda e: _typed(e, "message_delta")),
            lambda e: F.try_variant_get(e, "$.usage.output_tokens", "bigint"),
        ),
        lambda n: n.isNotNull(),
    )
    return F.struct(
        F.coalesce(F.try_variant_get(start, "$.message.usage.input_tokens", "bigint"), F.lit(0)).alias("input_tokens"),
        F.coalesce(_last(reports), F.lit(0)).alias("output_tokens"),
    )


def message_tokens(raw: Column) -> Column:
    """struct(input_tokens, output_tokens) of a JSON message; one bad count voids both."""
    return let(parse_whole(raw), _usage)


def _usage(v: Column) -> Column:
    def count(name: str) -> tuple[Column, Column]:
        path = f"$.usage.{name}"
        n = F.try_variant_get(v, path, "bigint")
        given = part(v, path)
        falsy = F.is_variant_null(given) | (F.to_json(given) == '""')
        return F.coalesce(n, F.lit(0)), given.isNotNull() & n.isNull() & ~falsy

    n_in, bad_in = count("input_tokens")
    n_out, bad_out = count("output_tokens")
    void = bad_in | bad_out
    zero = F.lit(0).cast("bigint")
    return F.struct(
        F.when(void, zero).otherwise(n_in).alias("input_tokens"),
        F.when(void, zero).otherwise(n_out).alias("output_tokens"),
    )


def tokens(raw: Column) -> Column:
    return F.when(is_json_form(raw), message_tokens(raw)).otherwise(stream_tokens(raw))


def _variant_map(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def _put(fields: Column, **values: Column) -> Column:
    """Fields with the given keys set; a NULL value leaves the key out."""
    names = list(values)
    rest = F.map_filter(fields, lambda k, _: ~k.isin(*names))
    entries = F.filter(
        F.array(*[F.struct(F.lit(n).alias("key"), values[n].alias("value")) for n in names]),
        lambda e: e["value"].isNotNull(),
    )
    return F.map_concat(rest, F.map_from_entries(entries))


def _indexed(events: Column, kind_name: str) -> Column:
    """array<struct(pos, idx, e)> of one event type, with idx defaulting to 0."""
    rows = F.transform(
        events,
        lambda e, i: F.struct(
            i.alias("pos"),
            F.coalesce(F.try_variant_get(e, "$.index", "int"), F.lit(0)).alias("idx"),
            e.alias("e"),
        ),
    )
    return F.filter(rows, lambda r: _typed(r["e"], kind_name))


def finalize_tool_input(partial: Column) -> tuple[Column, Column]:
    """(input, leftover) of a tool call: undecodable text gives {} and is kept aside."""
    parsed = parse_whole(partial)
    empty = F.parse_json(F.lit("{}"))
    value = F.when(partial.isNull(), F.lit(None)).otherwise(F.coalesce(parsed, empty))
    leftover = F.when((partial != "") & parsed.isNull(), partial.cast("variant"))
    return value, leftover


def _block(i: Column, starts: Column, deltas: Column) -> Column:
    own = _last(F.filter(starts, lambda s: s["idx"] == i))
    opened = F.try_element_at(F.filter(starts, lambda s: s["idx"] >= i), F.lit(1))

    def pieces(b: Column, delta_type: str, field: str) -> Column:
        picked = F.filter(
            b["mine"], lambda d: F.coalesce(F.try_variant_get(d["e"], "$.delta.type", "string") == delta_type, F.lit(False))
        )
        texts = F.transform(picked, lambda d: F.coalesce(F.try_variant_get(d["e"], f"$.delta.{field}", "string"), F.lit("")))
        first = F.try_variant_get(b["own"], f"$.content_block.{field}", "string")
        return F.when(
            (F.size(texts) > 0) | first.isNotNull(), F.concat(F.coalesce(first, F.lit("")), F.array_join(texts, ""))
        )

    def built(f: Column) -> Column:
        value, leftover = finalize_tool_input(f["partial"])
        return F.to_variant_object(
            _put(
                F.map_filter(f["fields"], lambda k, _: k != F.lit("partial_json")),
                text=F.coalesce(f["text"].cast("variant"), f["fields"]["text"]),
                input=F.coalesce(value, f["fields"]["input"]),
                partial_json_unparsed=leftover,
            )
        )

    def fields(b: Column) -> Column:
        found = F.struct(
            _variant_map(part(b["own"], "$.content_block")).alias("fields"),
            pieces(b, "text_delta", "text").alias("text"),
            pieces(b, "input_json_delta", "partial_json").alias("partial"),
        )
        return let(found, built)

    def since(o: Column) -> Column:
        mine = F.filter(deltas, lambda d: (d["idx"] == i) & (d["pos"] > F.coalesce(o["own"]["pos"], o["opened"]["pos"])))
        return let(F.struct(o["own"]["e"].alias("own"), mine.alias("mine")), fields)

    return let(F.struct(own.alias("own"), opened.alias("opened")), since)


def assemble(raw: Column) -> Column:
    """JSON message out of an event stream; the last delta's usage replaces the opening one."""
    return let(data_events(raw), _message)


def _message(events: Column) -> Column:
    parts = F.struct(
        _indexed(events, "content_block_start").alias("starts"),
        _indexed(events, "content_block_delta").alias("deltas"),
        _indexed(events, "message_delta").alias("closing"),
        _last(_indexed(events, "message_start")).alias("head"),
    )
    return let(parts, _merge)


def _merge(p: Column) -> Column:
    n_blocks = F.coalesce(F.array_max(F.transform(p["starts"], lambda s: s["idx"])), F.lit(-1)) + 1
    blocks = F.transform(
        F.when(n_blocks > 0, F.sequence(F.lit(0), n_blocks - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.to_json(_block(i, p["starts"], p["deltas"])),
    )
    content = F.parse_json(F.concat(F.lit("["), F.array_join(blocks, ","), F.lit("]")))

    def latest(path: str) -> Column:
        after = F.filter(p["closing"], lambda d: d["pos"] > F.coalesce(p["head"]["pos"], F.lit(-1)))
        values = F.filter(F.transform(after, lambda d: part(d["e"], path)), lambda x: x.isNotNull())
        return _last(values)

    def filled(base: Column) -> Column:
        return _put(
            base,
            content=content,
            stop_reason=F.coalesce(latest("$.delta.stop_reason"), base["stop_reason"]),
            stop_sequence=F.coalesce(latest("$.delta.stop_sequence"), base["stop_sequence"]),
            usage=F.coalesce(latest("$.usage"), base["usage"]),
        )

    return F.to_json(F.to_variant_object(let(_variant_map(part(p["head"]["e"], "$.message")), filled)))


def _or_null(json: Column) -> Column:
    return F.coalesce(json, F.lit("null"))


def _string_json(text: Column) -> Column:
    return F.to_json(text.cast("variant"))


def message_events(raw: Column) -> Column:
    """array<struct(block, step, name, data)>: the events that replay a JSON message.

    Opening and closing events carry block -1 and the block count; NULL when raw is not a JSON object.
    """
    return let(F.try_parse_json(raw), _replay_events)


def _replay_events(v: Column) -> Column:
    content = F.coalesce(json_list(part(v, "$.content")), F.array().cast("array<variant>"))
    head = F.map_filter(_variant_map(v), lambda k, _: ~k.isin("content", "stop_reason", "stop_sequence"))
    head_json = F.to_json(F.to_variant_object(_put(head, content=F.parse_json(F.lit("[]")))))

    def event(block: Column, step: int, name: str, *pieces: Column | str) -> Column:
        return F.struct(
            block.cast("int").alias("block"),
            F.lit(step).alias("step"),
            F.lit(name).alias("name"),
            F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces]).alias("data"),
        )

    def block_events(b: Column, i: Column) -> Column:
        idx = i.cast("string")
        kind_name = F.coalesce(F.try_variant_get(b, "$.type", "string"), F.lit(""))
        is_text, is_tool = kind_name == "text", kind_name == "tool_use"
        shell = (
            F.when(is_text, F.lit('{"type":"text","text":""}'))
            .when(
                is_tool,
                F.concat(
                    F.lit('{"type":"tool_use","id":'), _or_null(F.to_json(part(b, "$.id"))),
                    F.lit(',"name":'), _or_null(F.to_json(part(b, "$.name"))), F.lit(',"input":{}}'),
                ),
            )
            .otherwise(F.to_json(b))
        )
        text = F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit(""))
        args = F.coalesce(F.to_json(part(b, "$.input")), F.lit("{}"))
        delta = F.when(
            is_text, F.concat(F.lit('{"type":"text_delta","text":'), _string_json(text), F.lit("}"))
        ).when(is_tool, F.concat(F.lit('{"type":"input_json_delta","partial_json":'), _string_json(args), F.lit("}")))
        three = F.array(
            event(i, 0, "content_block_start", '{"type":"content_block_start","index":', idx, ',"content_block":', shell, "}"),
            event(i, 1, "content_block_delta", '{"type":"content_block_delta","index":', idx, ',"delta":', delta, "}"),
            event(i, 2, "content_block_stop", '{"type":"content_block_stop","index":', idx, "}"),
        )
        return F.filter(three, lambda e: e["data"].isNotNull())

    n = F.size(content)
    out = F.coalesce(F.try_variant_get(v, "$.usage.output_tokens", "bigint"), F.lit(0))
    opening = F.array(event(F.lit(-1), 0, "message_start", '{"type":"message_start","message":', head_json, "}"))
    closing = F.array(
        event(
            n, 0, "message_delta", '{"type":"message_delta","delta":{"stop_reason":',
            _or_null(F.to_json(part(v, "$.stop_reason"))), ',"stop_sequence":',
            _or_null(F.to_json(part(v, "$.stop_sequence"))), '},"usage":{"output_tokens":', out.cast("string"), "}}",
        ),
        event(n, 1, "message_stop", '{"type":"message_stop"}'),
    )
    return F.when(kind(v) == "OBJECT", F.concat(opening, F.flatten(F.transform(content, block_events)), closing))


def expand(raw: Column) -> Column:
    """Event-stream text that replays a JSON message; anything else passes through."""
    lines = F.transform(
        message_events(raw), lambda e: F.concat(F.lit("event: "), e["name"], F.lit("\ndata: "), e["data"], F.lit("\n\n"))
    )
    return F.coalesce(F.array_join(lines, ""), raw)


def is_complete(raw: Column, status: Column) -> Column:
    """Only finished answers may be stored: a closing event, or a whole JSON message with status 200."""
    whole = F.try_variant_get(parse_whole(raw), "$.type", "string") == "message"
    json_done = (status == 200) & is_json_form(raw) & whole
    return F.contains(raw, F.lit("event: message_stop")) | F.coalesce(json_done, F.lit(False))


def replay(raw: Column, stream: Column) -> Column:
    """The stored answer in the form the caller asked for."""
    json_form = is_json_form(raw)
    return (
        F.when(stream & json_form, expand(raw))
        .when(stream, raw)
        .when(json_form, raw)
        .otherwise(assemble(raw))
    )
