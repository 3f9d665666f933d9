"""Score payloads and JSON objects inside text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sweeplens.functions.layers import let, squeeze


def payload_score(payload: Column) -> Column:
    """Score of a VARIANT payload: ``score``, ``math_score``, ``eq_score``, or itself.

    The first field that is present decides, even when it cannot be read as a
    number; the row then has a NULL score and goes to the rejects.
    """
    def present(name: str) -> Column:
        return F.try_variant_get(payload, f"$.{name}", "variant").isNotNull()

    def number(path: str) -> Column:
        return F.try_variant_get(payload, path, "string").try_cast("double")

    return (
        F.when(present("score"), number("$.score"))
        .when(present("math_score"), number("$.math_score"))
        .when(present("eq_score"), number("$.eq_score"))
        .otherwise(number("$"))
    )


# Pieces of a text whose concatenation is the text: an escaped character, a quote, a brace, or anything between.
_PIECES = r"(?s)\\.|[\"{}]|[^\"{}\\]+|\\"
_OBJECT = "map<string, variant>"


def _object_length(text: Column) -> Column:
    """Characters of the balanced object that ``text`` starts with; NULL when it does not end."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("read"), F.lit(None).cast("int").alias("end"))

    def step(at: Column, piece: Column) -> Column:
        depth = F.when(at["quoted"], at["depth"]).when(piece == "{", at["depth"] + 1).when(piece == "}", at["depth"] - 1).otherwise(at["depth"])
        read = at["read"] + F.length(piece)
        closed = (depth == 0) & ~at["quoted"] & (piece == "}")
        return F.struct(depth.alias("depth"), (at["quoted"] != (piece == '"')).alias("quoted"), read.alias("read"),
                        F.coalesce(at["end"], F.when(closed, read)).alias("end"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), start, step, lambda at: at["end"])


def first_json_object(text: Column) -> Column:
    """First balanced JSON object in free text as ``map<string, variant>``; NULL when there is none or it is no JSON.

    Only the first ``{`` is tried.  The map keeps the textual order and repeated
    keys; ``member`` takes the last of them.  NaN and infinite numbers are read.
    """
    from_brace = F.when(text.contains("{"), F.substr(text, F.position(F.lit("{"), text)))
    body = let(from_brace, lambda t: F.substr(t, F.lit(1), _object_length(t)))
    return F.from_json(body, _OBJECT, {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true"})


def member(obj: Column, name: str) -> Column:
    """Value of a key as VARIANT, the last one given; NULL when it is absent."""
    found = F.filter(F.map_entries(obj), lambda e: e["key"] == name)
    return F.when(F.size(found) > 0, F.element_at(found, -1)["value"])


# Fields every agent action must carry.
ACTION_FIELDS = {
    "read_file": ["path"],
    "search": ["query"],
    "replace_text": ["path", "old", "new"],
    "write_file": ["path", "content"],
    "run_tests": [],
    "finish": ["summary"],
}


def required_fields(action: Column) -> Column:
    """Required fields of an action, NULL for an unknown one."""
    chain = None
    for name, fields in ACTION_FIELDS.items():
        value = F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>")
        chain = F.when(action == name, value) if chain is None else chain.when(action == name, value)
    return chain


def action_name(obj: Column) -> Column:
    return squeeze(F.try_variant_get(member(obj, "action"), "$", "string"))


def action_status(obj: Column) -> Column:
    """``ok``, ``parse_error``, ``unsupported`` or ``missing_fields``."""
    keys = F.map_keys(obj)
    required = required_fields(action_name(obj))
    return (
        F.when(obj.isNull() | ~F.array_contains(keys, "action"), "parse_error")
        .when(required.isNull(), "unsupported")
        .when(F.size(F.array_except(required, keys)) > 0, "missing_fields")
        .otherwise("ok")
    )
