"""Request bodies to canonical text, key and embedding text, as column expressions.

Bodies are parsed once into VARIANT, whose JSON form has sorted keys and no
whitespace; the five top-level parts are then joined in their sorted order.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from echoledger.functions.binding import let

# Request fields that never change what is asked, so never the key.
IGNORED_FIELDS = (
    "temperature",
    "top_p",
    "top_k",
    "max_tokens",
    "stop_sequences",
    "stream",
    "metadata",
    "service_tier",
    "cache_control",
    "container",
    "inference_geo",
    "output_config",
    "thinking",
)

_TRIM = r"^\s+|\s+$"


def parse_whole(text: Column) -> Column:
    """Text as VARIANT where all of it is one JSON value; the parser alone stops after the first value.

    Only one value stays whole both as the sole element of a list and as a field's value.
    """
    listed = F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")) == 1
    field = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.when(F.coalesce(listed & field, F.lit(False)), F.try_parse_json(text))


def part(v: Column, path: str) -> Column:
    """Sub-value as VARIANT: SQL NULL when absent, a variant null when JSON null."""
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """Leading word of the variant's schema: OBJECT, ARRAY, STRING, VOID, ..."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def json_list(v: Column) -> Column:
    """The elements when v is a JSON array, else SQL NULL."""
    return F.try_variant_get(v, "$", "array<variant>")


def model_family(model: Column) -> Column:
    trimmed = F.regexp_replace(model, _TRIM, "")
    return F.regexp_replace(F.lower(trimmed), r"-[0-9]{8}$", "")


def strip_marker(block: Column) -> Column:
    """JSON text of a content block without its caching marker."""
    fields = F.try_variant_get(block, "$", "map<string,variant>")
    rest = F.map_filter(fields, lambda k, _: k != F.lit("cache_control"))
    return F.when(part(block, "$.cache_control").isNull(), F.to_json(block)).otherwise(F.to_json(F.to_variant_object(rest)))


def _blocks(v: Column) -> Column:
    """Content in block-list form; shapes that are neither text nor list stay as they are."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(json_list(v), strip_marker), ","), F.lit("]"))
    single = F.concat(F.lit('[{"text":'), F.to_json(v), F.lit(',"type":"text"}]'))
    return F.when(kind(v) == "STRING", single).when(kind(v) == "ARRAY", listed).otherwise(F.to_json(v))


def content_json(content: Column) -> Column:
    return F.coalesce(let(content, _blocks), F.lit("null"))


def system_json(system: Column) -> Column:
    """Block-list form, or NULL where the system prompt counts as absent."""
    blank = F.is_variant_null(system) | (F.try_variant_get(system, "$", "string") == "")
    return F.when(F.coalesce(blank, F.lit(False)), F.lit(None)).otherwise(_blocks(system))


def message_json(message: Column) -> Column:
    role = F.coalesce(F.to_json(part(message, "$.role")), F.lit("null"))
    return F.concat(F.lit('{"content":'), content_json(part(message, "$.content")), F.lit(',"role":'), role, F.lit("}"))


def _text_json(text: Column) -> Column:
    return F.to_json(text.cast("variant"))


def model_json(v: Column) -> Column:
    model = part(v, "$.model")
    text = F.when(F.is_variant_null(model), F.lit("None")).otherwise(
        F.coalesce(F.try_variant_get(model, "$", "string"), F.to_json(model))
    )
    return F.when(model.isNotNull(), _text_json(model_family(text)))


def tool_choice_json(v: Column) -> Column:
    """Dropped when null, and when it only restates the default beside tools."""
    choice = part(v, "$.tool_choice")
    text = F.to_json(choice)
    default = (text == '{"type":"auto"}') & part(v, "$.tools").isNotNull()
    return F.when(choice.isNull() | F.is_variant_null(choice) | default, F.lit(None)).otherwise(text)


def canonical_text(v: Column) -> Column:
    """Canonical JSON of a parsed body; fields outside the five parts never appear."""
    messages = F.array_join(F.transform(json_list(part(v, "$.messages")), message_json), ",")
    return F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            F.concat(F.lit('"messages":['), F.coalesce(messages, F.lit("")), F.lit("]")),
            F.concat(F.lit('"model":'), model_json(v)),
            F.concat(F.lit('"system":'), system_json(part(v, "$.system"))),
            F.concat(F.lit('"tool_choice":'), tool_choice_json(v)),
            F.concat(F.lit('"tools":'), F.to_json(part(v, "$.tools"))),
        ),
        F.lit("}"),
    )


def _one_value(body: Column) -> Column:
    """Whether a body reads as a single value once repeated keys are let pass."""
    lists = F.get_json_object(F.concat(F.lit("["), body, F.lit("]")), "$[1]").isNull()
    return F.get_json_object(body, "$").isNotNull() & F.get_json_object(F.concat(F.lit('{"v":'), body, F.lit("}")), "$.v").isNotNull() & lists


def reject_reason(body: Column, v: Column) -> Column:
    """Why a body cannot be keyed; NULL when it can."""
    messages = part(v, "$.messages")
    odd = F.exists(json_list(messages), lambda m: kind(m) != "OBJECT")
    return (
        F.when(v.isNull() & _one_value(body), "duplicate_key")
        .when(v.isNull(), "invalid_json")
        .when(kind(v) != "OBJECT", "not_object")
        .when(messages.isNotNull() & (kind(messages) != "ARRAY"), "messages_not_list")
        .when(odd, "message_not_object")
    )


def prompt_key(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def extract_model(text: Column) -> Column:
    return F.try_variant_get(parse_whole(text), "$.model", "string")


def wants_stream(body: Column) -> Column:
    """Truth of the body's stream field the way a dynamic language reads it."""
    s = F.to_json(part(parse_whole(body), "$.stream"))
    return F.coalesce(~s.isin("false", "null", "0", '""', "[]", "{}"), F.lit(False))


def _text_blocks(blocks: Column) -> Column:
    texts = F.filter(
        F.coalesce(blocks, F.array().cast("array<variant>")),
        lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == "text", F.lit(False)),
    )
    return F.transform(texts, lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")))


def embedding_text(canonical: Column) -> Column:
    """What gets embedded: the words alone, with roles only where several turns need telling apart."""

    def spoken(turns: Column) -> Column:
        def words(m: Column) -> Column:
            said = _text_blocks(json_list(part(m, "$.content")))
            role = part(m, "$.role")
            name = F.when(role.isNull(), F.lit("")).otherwise(F.coalesce(F.try_variant_get(role, "$", "string"), F.lit("None")))
            return F.when(F.size(turns) > 1, F.transform(said, lambda t: F.concat(name, F.lit(": "), t))).otherwise(said)

        return F.coalesce(F.flatten(F.transform(turns, words)), F.array().cast("array<string>"))

    def words_of(v: Column) -> Column:
        system = _text_blocks(json_list(part(v, "$.system")))
        parts = F.concat(system, let(json_list(part(v, "$.messages")), spoken))
        return let(parts, lambda p: F.when(F.size(p) > 0, F.array_join(p, "\n")))

    return F.coalesce(let(F.try_parse_json(canonical), words_of), canonical)
