"""Layer sequences, blocks and count vectors as column expressions.

``n`` (the layer count) may be an int or a column, so one plan can expand
configurations of many models at once.  Malformed input becomes NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_ARRAY = "array<int>"
BLOCK_ARRAY = "array<struct<i:int,j:int>>"
PAIR_TEXT = r"^\(?\s*(-?\d+)\s*,\s*(-?\d+)\s*\)?$"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def as_col(value: int | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value) if isinstance(value, int) else F.col(value)


def squeeze(text: Column) -> Column:
    """Strip every kind of white space at both ends (``trim`` alone strips blanks)."""
    return F.btrim(text, F.lit(SPACES))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Column expressions have no variables: a sub-expression used five times is
    evaluated five times.  A one-element array binds it to a lambda argument.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def null_of(type_name: str) -> Column:
    return F.lit(None).cast(type_name)


# --- expansion -------------------------------------------------------------

def baseline_layers(n: int | Column) -> Column:
    return F.sequence(F.lit(0), as_col(n).cast("int") - 1)


def is_baseline(layers: Column, n: int | Column) -> Column:
    return layers == baseline_layers(n)


def block_is_valid(n: int | Column, i: Column, j: Column) -> Column:
    return ((i == 0) & (j == 0)) | ((i >= 0) & (i < j) & (j <= as_col(n)))


def expand_block(n: int | Column, i: Column, j: Column) -> Column:
    """Layers ``0..j-1`` then ``i..n-1``; (0,0) is the unmodified order."""
    n = as_col(n).cast("int")
    i, j = i.cast("int"), j.cast("int")
    doubled = F.concat(F.sequence(F.lit(0), j - 1), F.sequence(i, n - 1))
    return F.when((i == 0) & (j == 0), baseline_layers(n)).when(block_is_valid(n, i, j), doubled)


def insert_after_last(layers: Column, anchor: Column, extra: Column) -> Column:
    """Insert ``extra`` behind the right-most ``anchor``; unchanged if absent."""
    def spliced(from_end: Column) -> Column:
        head = F.size(layers) - from_end + 1
        return F.when(from_end == 0, layers).otherwise(
            F.concat(F.slice(layers, F.lit(1), head), extra, F.slice(layers, head + 1, F.size(layers)))
        )

    return let(F.array_position(F.reverse(layers), anchor).cast("int"), spliced)


def expand_blocks(n: int | Column, blocks: Column) -> Column:
    """Fold blocks into the baseline order, left to right.

    The first block needs no special case: inserting it into the baseline gives
    the same sequence as :func:`expand_block`.
    """
    def step(acc: Column, block: Column) -> Column:
        i, j = block["i"], block["j"]
        return (
            F.when((i == 0) & (j == 0), acc)
            .when(block_is_valid(n, i, j), insert_after_last(acc, j - 1, F.sequence(i, j - 1)))
            .otherwise(null_of(INT_ARRAY))
        )

    return F.aggregate(blocks, baseline_layers(n).cast(INT_ARRAY), step)


def layers_are_valid(n: int | Column, layers: Column) -> Column:
    inside = (F.array_min(layers) >= 0) & (F.array_max(layers) < as_col(n))
    return F.coalesce(inside & ~F.exists(layers, lambda x: x.isNull()), F.lit(False))


def valid_or_null(n: int | Column, layers: Column) -> Column:
    return let(layers, lambda x: F.when(layers_are_valid(n, x), x))


# --- text forms ------------------------------------------------------------

def layer_spec(layers: Column) -> Column:
    return F.concat(F.lit("layers:"), F.array_join(layers, ","))


def block_spec(blocks: Column) -> Column:
    pairs = F.transform(blocks, lambda b: F.concat_ws(",", b["i"].cast("string"), b["j"].cast("string")))
    return F.when(F.size(blocks) == 0, F.lit("0,0")).otherwise(F.array_join(pairs, ";"))


# Whole-text patterns decide whether a spec is usable; the numbers are then cut
# out and cast in bulk, which stays in generated code.
_INT = r"[+-]?\d+"
_LIST = rf"\s*(?:{_INT}\s*)?(?:,\s*(?:{_INT}\s*)?)*$"
_PAIR = rf"(?:\(\s*{_INT}\s*,\s*{_INT}\s*\)|{_INT}\s*,\s*{_INT})"
_BLOCKS = rf"[\s;]*{_PAIR}\s*(?:;\s*(?:{_PAIR}\s*)?)*$"
_NO_GAPS = rf"^\s*{_INT}\s*(?:,\s*{_INT}\s*)*$"
_LIST_SPEC = rf"(?i)^layers:{_LIST}"
_BLOCK_SPEC = rf"(?i)^(?:blocks:)?{_BLOCKS}"


def _numbers(text: Column) -> Column:
    """All integers of a text, whatever their length; NULL when one does not fit."""
    def whole(found: Column) -> Column:
        return F.when(~F.exists(found, lambda x: x.isNull()), found)

    return let(F.regexp_extract_all(text, F.lit(_INT), F.lit(0)).try_cast(INT_ARRAY), whole)


def _paired(numbers: Column) -> Column:
    """Flat ``i, j, i, j`` numbers to block structs."""
    return F.transform(
        F.sequence(F.lit(0), F.size(numbers) - 2, F.lit(2)),
        lambda k: F.struct(F.get(numbers, k).alias("i"), F.get(numbers, k + 1).alias("j")))


def parse_blocks(text: Column) -> Column:
    """``blocks:3,6;4,6`` with or without brackets; empty items are skipped."""
    return F.when(squeeze(text).rlike(_BLOCK_SPEC), let(_numbers(text), _paired))


def parse_pair(text: Column) -> Column:
    """``(i, j)`` or ``i,j`` as a block struct, else NULL."""
    return F.when(squeeze(text).rlike(PAIR_TEXT), F.get(let(_numbers(text), _paired), F.lit(0)))


def spec_kind(text: Column) -> Column:
    """Which spelling a spec uses: ``layers``, ``pair``, ``blocks`` or NULL."""
    body = squeeze(text)
    return (
        F.when(body.rlike(r"(?i)^layers:"), "layers")
        .when(body.rlike(PAIR_TEXT), "pair")
        .when(body.rlike(r"(?i)^blocks:|[;,]"), "blocks")
    )


def parse_spec(n: int | Column, text: Column) -> Column:
    """Any text spelling to the canonical layer list; NULL when unusable.

    A bare pair is read as a block before anything else, so an explicit list of
    two layers needs the ``layers:`` prefix.  A pair is a one-block list, so
    both share one expansion.
    """
    body = squeeze(text)

    def layers(numbers: Column) -> Column:
        return (
            F.when(body.rlike(_LIST_SPEC) & (F.size(numbers) > 0), numbers)
            .when(body.rlike(_BLOCK_SPEC) | body.rlike(PAIR_TEXT), expand_blocks(n, _paired(numbers)))
        )

    return valid_or_null(n, let(_numbers(text), layers))


def parse_sequence_key(n: int | Column, key: Column) -> Column:
    """Integer-array key: two elements are a block, otherwise a layer list."""
    pair = expand_block(n, F.get(key, F.lit(0)), F.get(key, F.lit(1)))
    return valid_or_null(n, F.when(F.size(key) == 2, pair).otherwise(key.cast(INT_ARRAY)))


def parse_document(n: int | Column, doc: Column) -> Column:
    """A VARIANT spec to layers: text, an integer array, or an object.

    Of an object's ``layers``, ``layer_indices``, ``blocks``, ``key`` and
    ``spec`` the first that is present decides, even when it is unusable.
    """
    def within(path: str, kind: str) -> Column:
        return F.try_variant_get(doc, path, kind)

    def is_text(path: str) -> Column:
        return F.schema_of_variant(within(path, "variant")) == "STRING"

    def either(path: str) -> Column:
        return F.when(is_text(path), parse_spec(n, within(path, "string"))).otherwise(parse_sequence_key(n, within(path, INT_ARRAY)))

    def pair(path: str) -> Column:
        numbers = within(path, INT_ARRAY)
        listed = F.when(F.size(numbers) == 2, F.struct(F.get(numbers, F.lit(0)).alias("i"), F.get(numbers, F.lit(1)).alias("j")))
        block = F.when(is_text(path), parse_pair(within(path, "string"))).otherwise(listed)
        return let(block, lambda b: expand_block(n, b["i"], b["j"]))

    options = [("layers", within("$.layers", INT_ARRAY)), ("layer_indices", within("$.layer_indices", INT_ARRAY)),
               ("blocks", expand_blocks(n, parse_blocks(within("$.blocks", "string")))), ("key", pair("$.key")), ("spec", either("$.spec"))]
    chosen = None
    for name, value in options:
        present = within(f"$.{name}", "variant").isNotNull()
        chosen = F.when(present, value) if chosen is None else chosen.when(present, value)
    return valid_or_null(n, F.when(F.schema_of_variant(doc).startswith("OBJECT<"), chosen).otherwise(either("$")))


# --- count vectors ---------------------------------------------------------

def encode_counts(layers: Column, n: int | Column) -> Column:
    """How often each layer runs; NULL when a layer is out of range."""
    def counts(x: Column) -> Column:
        # Size difference to the list without the layer: array_remove runs in generated code.
        times = F.transform(baseline_layers(n), lambda l: F.size(x) - F.size(F.array_remove(x, l)))
        return F.when(layers_are_valid(n, x), times)

    return let(layers, counts)


def decode_counts(counts: Column, n: int | Column) -> Column:
    def decoded(x: Column) -> Column:
        ok = (F.size(x) == as_col(n)) & (F.array_min(x) >= 0)
        return F.when(ok, F.flatten(F.transform(x, lambda c, i: F.array_repeat(i, c))))

    return let(counts, decoded)


def counts_to_csv(counts: Column) -> Column:
    return F.array_join(counts, ",")


def counts_from_csv(text: Column, n: int | Column | None = None) -> Column:
    usable = squeeze(text).rlike(_NO_GAPS)
    if n is None:
        return F.when(usable, _numbers(text))
    return let(_numbers(text), lambda x: F.when(usable & (F.size(x) == as_col(n)), x))


def extra_layers(layers: Column, n: int | Column) -> Column:
    return F.size(layers) - as_col(n)


def relative_overhead(layers: Column, n: int | Column) -> Column:
    n = as_col(n)
    return F.when(n > 0, extra_layers(layers, n) / n).otherwise(F.lit(0.0))


def counts_overhead(counts: Column, n: int | Column) -> Column:
    n = as_col(n)
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    return F.when(F.size(counts) == n, (total - n) / n)


def duplicated_layers(layers: Column) -> Column:
    """Layers that run more than once as ``array<struct<layer,times>>``."""
    def counted(x: Column) -> Column:
        return F.transform(
            F.sort_array(F.array_distinct(x)),
            lambda l: F.struct(l.alias("layer"), (F.size(x) - F.size(F.array_remove(x, l))).alias("times")))

    return F.filter(let(layers, counted), lambda e: e["times"] > 1)


def block_label(i: Column, j: Column, n: int | Column) -> Column:
    """Readable form of a block: ``baseline`` or ``[[0-j]-[i+1-n]]``."""
    return F.when((i == 0) & (j == 0), "baseline").otherwise(
        F.format_string("[[0-%d]-[%d-%d]]", j.cast("int"), (i + 1).cast("int"), as_col(n).cast("int"))
    )
