"""Text, path and cell helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sweeplens.functions.layers import squeeze

# Line terminators, source suffixes.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
SOURCE_SUFFIXES = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rs", ".c", ".cc", ".cpp", ".h", ".hpp", ".rb",
)


def lines_of(text: Column) -> Column:
    """Lines without terminators; one trailing terminator adds no line."""
    parts = F.split(text, LINE_BREAK)
    trimmed = F.when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
    ).otherwise(parts)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(trimmed)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Directory of a path; the root is the empty string."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def dir_depth(directory: Column) -> Column:
    return F.when(directory == "", 0).otherwise(F.size(F.split(directory, "/")))


def suffix(path: Column) -> Column:
    """Lower-cased last extension with its dot; hidden files have none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


# What test folders are called, how names of test files begin and end.
TEST_FOLDER = r"(^|/)(test|tests)(/|$)"
TEST_BEGIN, TEST_END = r"^test_", r"(_test\.py|\.test\.js|\.spec\.js|\.test\.ts|\.spec\.ts)$"


def is_test_path(path: Column) -> Column:
    name = F.lower(file_name(path))
    return path.rlike(TEST_FOLDER) | name.rlike(TEST_BEGIN) | name.rlike(TEST_END)


def is_source_path(path: Column, include_tests: bool = False) -> Column:
    known = suffix(path).isin(*SOURCE_SUFFIXES)
    return known if include_tests else known & ~is_test_path(path)


# --- snippets --------------------------------------------------------------

def snippet_bounds(lines: Column, center: Column, max_lines: int) -> Column:
    """``struct<start, end>`` (1-based, inclusive) of a window clamped to the file."""
    total = F.size(lines)
    half = max(1, max_lines // 2)
    middle = F.greatest(F.lit(0), F.least(total - 1, center - 1))
    end = F.least(total, F.greatest(F.lit(0), middle - half) + max_lines)
    start = F.greatest(F.lit(0), end - max_lines)
    empty = total == 0
    return F.struct(
        F.when(empty, 1).otherwise(start + 1).cast("int").alias("start"),
        F.when(empty, 1).otherwise(end).cast("int").alias("end"),
    )


def snippet_text(lines: Column, bounds: Column) -> Column:
    return F.when(F.size(lines) == 0, "").otherwise(
        F.array_join(F.slice(lines, bounds["start"], bounds["end"] - bounds["start"] + 1), "\n")
    )


def snippet_size(lines: Column, bounds: Column) -> Column:
    """Lines of ``snippet_text``: an empty last line ends the text before it and does not count."""
    last = F.get(lines, bounds["end"] - 1)
    return F.when(F.size(lines) == 0, 0).otherwise(
        bounds["end"] - bounds["start"] + 1 - F.coalesce((last == "").cast("int"), F.lit(0)))


# What a definition looks like, what a comment line starts with.
DEFINITION = (
    r"(?U)^\s*(def|class|async def)\s+"
    r"|^\s*(function|export function|export class|class)\s+"
    r"|^\s*(public|private|protected)?\s*(class|interface|void|int|String|boolean)\s+"
)
COMMENT_START = r"^(#|//|/\*|\*)"


def first_definition_line(lines: Column) -> Column:
    """First line that looks like a definition, else first non-blank, else 1."""
    def defines(line: Column) -> Column:
        bare = squeeze(line)
        return (bare != "") & ~bare.rlike(COMMENT_START) & line.rlike(DEFINITION)

    definition = F.array_position(F.transform(lines, defines), F.lit(True))
    filled = F.array_position(F.transform(lines, lambda l: squeeze(l) != ""), F.lit(True))
    return F.coalesce(F.nullif(definition, F.lit(0)), F.nullif(filled, F.lit(0)), F.lit(1)).cast("int")


# --- cells -----------------------------------------------------------------

def slug(text: Column) -> Column:
    """Lower case, blanks to dashes, other punctuation dropped, dashes collapsed."""
    dashed = F.translate(F.lower(text), " ", "-")
    kept = F.regexp_replace(dashed, r"[^a-z0-9-]", "")
    return F.regexp_replace(F.regexp_replace(kept, "-+", "-"), "^-|-$", "")


def version_key(text: Column) -> Column:
    """Numeric segments of a dotted version; NULL when a segment is no number."""
    parts = F.transform(F.split(text, r"\."), lambda x: x.try_cast("int"))
    return F.when(~F.exists(parts, lambda x: x.isNull()), parts)


def parse_bool(text: Column) -> Column:
    """true/false in any case with white space around; anything else NULL."""
    word = F.lower(squeeze(text))
    return F.when(word == "true", True).when(word == "false", False)


def stable_hash(seed: int | str, *parts: Column) -> Column:
    """Portable order key for seeded shuffles: md5 of seed and parts."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def eta_text(seconds: Column) -> Column:
    """``42s``, ``3.5m`` or ``2h 5m``."""
    hours = F.floor(seconds / 3600)
    return (
        F.when(seconds < 0, "0s")
        .when(seconds < 60, F.format_string("%.0fs", seconds))
        .when(seconds < 3600, F.format_string("%.1fm", seconds / 60))
        .otherwise(F.format_string("%dh %dm", hours, F.floor((seconds % 3600) / 60)))
    )


def path_stamp(path: Column) -> Column:
    """Run stamp inside a path: full, minute or day form; 0 when absent."""
    def found(pattern: str) -> Column:
        raw = F.regexp_replace(F.regexp_extract(path, pattern, 1), "_", "")
        return F.nullif(raw, F.lit("")).cast("long")

    patterns = (r"(20[0-9]{6}_[0-9]{6})", r"(20[0-9]{6}_[0-9]{4})", r"(20[0-9]{6})")
    return F.coalesce(*[found(p) for p in patterns], F.lit(0).cast("long"))
