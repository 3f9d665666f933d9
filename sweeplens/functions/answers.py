"""Scoring of free-text model responses as column expressions.

All of it is stateless, so the same expressions run on batch and stream input.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from sweeplens.functions.layers import squeeze

# Section headers, score range, neutral fill, ladder confidences.
FIRST_HEADER = r"first pass scores:"
REVISED_HEADER = r"revised scores:"
CRITIQUE_HEADER = r"critique:"
END_MARKER = r"\[end of answer\]"
NAMED_NUMBER = r"(?<=[A-Za-z]):\s*(\d+(?:\.\d+)?)"  # looked for by its colon; what stands before the name tells nothing
LOOSE_NUMBER = r"\b(\d+(?:\.\d+)?)\b"
ANY_SCRIPT = "(?U)"  # digits, blanks and word borders of all scripts: needed, and paid for, beyond ASCII only
NEUTRAL = 5.0
EMOTIONS = 4
MAX_SCORE = 10.0

_FOREIGN_DIGITS = "".join(
    chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"
)
_PLAIN_DIGITS = "".join(str(unicodedata.decimal(c)) for c in _FOREIGN_DIGITS)


def strip_thinking(text: Column) -> Column:
    """Drop closed think blocks, then an unclosed one up to the end."""
    closed = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return squeeze(F.when(F.contains(text, F.lit("<think>")), F.regexp_replace(closed, r"(?s)<think>.*", "")).otherwise(text))


def _plain(run: Column) -> Column:
    """Digits of any script to ASCII; plain runs skip the lookup."""
    return F.when(run.rlike("^[0-9.]*$"), run).otherwise(F.translate(run, _FOREIGN_DIGITS, _PLAIN_DIGITS))


def digit_runs(text: Column) -> Column:
    """Every run of decimal digits; signs, points and separators are lost."""
    runs = F.regexp_extract_all(text, F.lit(r"(?U)\d+"), F.lit(0))
    return F.transform(runs, _plain)


def answer_score(actual: Column, estimate: Column) -> Column:
    """Digit-aligned similarity of two non-negative whole numbers in text form.

    Both are right-padded with zeros to one length; leading digits decide the
    ratio and the length gap scales it.  Doubles of the leading 38 digits keep
    the error near 1e-16 whatever the length.
    """
    def bare(x: Column) -> Column:
        return F.regexp_replace(x, r"^0+(?=\d)", "")

    def padded(x: Column, width: Column) -> Column:
        return F.left(F.rpad(x, width, "0"), F.lit(38)).cast("double")

    a, e = bare(actual), bare(estimate)
    width = F.greatest(F.length(a), F.length(e))
    gap = width - F.least(F.length(a), F.length(e))
    x, y = padded(a, width), padded(e, width)
    top = F.greatest(x, y)
    ratio = (F.lit(1.0) - F.abs(x - y) / top) * (F.lit(1.0) - gap / width)
    usable = a.rlike(r"^\d+$") & e.rlike(r"^\d+$")
    return F.when(usable & (top > 0), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def best_answer_score(actual: Column, runs: Column) -> Column:
    """Best similarity over all extracted numbers; none extracted scores 0."""
    text = actual.cast("string")
    return F.coalesce(F.array_max(F.transform(runs, lambda r: answer_score(text, r))), F.lit(0.0))


# --- four-emotion answers --------------------------------------------------

def _section(text: Column, header: str, *stops: str) -> Column:
    tail = "|".join((*stops, r"\z"))
    return F.regexp_extract(text, rf"(?isu){header}(.*?)(?:{tail})", 1)


def _numbers(text: Column, pattern: str, most: int | None = None) -> Column:
    """Numbers matched by group 1 of ``pattern`` (the first ``most``) that lie in the score range."""
    def found(mode: str) -> Column:
        runs = F.regexp_extract_all(text, F.lit(mode + pattern), F.lit(1))
        return F.slice(runs, 1, most) if most else runs

    ascii_only = F.octet_length(text) == F.length(text)
    foreign = F.transform(found(ANY_SCRIPT), lambda x: _plain(x).try_cast("double"))
    values = F.when(ascii_only, found("").try_cast("array<double>")).otherwise(foreign)
    return F.filter(values, lambda v: v.isNotNull() & (v >= 0) & (v <= MAX_SCORE))


def _pad(values: Column) -> Column:
    fill = F.array_repeat(F.lit(NEUTRAL), EMOTIONS)
    return F.slice(F.concat(values, fill), 1, EMOTIONS)


def section_numbers(section: Column) -> Column:
    """First four ``Name: number`` values of a section, range-filtered."""
    return _numbers(section, NAMED_NUMBER, EMOTIONS)


def named_scores(kept: Column) -> Column:
    """Scores of a section from its numbers, at least three needed."""
    return F.when(F.size(kept) >= 3, _pad(kept))


def loose_scores(text: Column) -> Column:
    return _numbers(text, LOOSE_NUMBER)


def revised_section(text: Column) -> Column:
    return _section(text, REVISED_HEADER, END_MARKER)


def first_section(text: Column, mode: str = "blend") -> Column:
    stops = (CRITIQUE_HEADER,) if mode == "blend" else (END_MARKER, CRITIQUE_HEADER, REVISED_HEADER)
    return _section(text, FIRST_HEADER, *stops)


def emotion_ladder(first: Column, revised: Column, loose: Column, mode: str = "blend") -> Column:
    """Pick the most trusted extraction: ``struct<values, confidence>``."""
    def rung(values: Column, confidence: Column | float) -> Column:
        conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.struct(values.alias("values"), conf.cast("double").alias("confidence"))

    found = F.size(loose)
    tail = (
        rung(F.slice(loose, 1, EMOTIONS), 0.5),
        rung(_pad(loose), found / 8.0),
    )
    if mode == "first_pass":
        ladder = F.when(first.isNotNull(), rung(first, 1.0))
    elif mode == "blend":
        both = F.zip_with(first, revised, lambda a, b: a * 0.5 + b * 0.5)
        ladder = (
            F.when(first.isNotNull() & revised.isNotNull(), rung(both, 1.0))
            .when(revised.isNotNull(), rung(revised, 0.9))
            .when(first.isNotNull(), rung(first, 0.8))
        )
    else:
        raise ValueError(f"unknown extraction mode: {mode}")
    return ladder.when(found >= EMOTIONS, tail[0]).otherwise(tail[1])


def emotion_score(values: Column, reference: Column, confidence: Column) -> Column:
    """Closeness to the reference, pulled to 0.5 as confidence falls."""
    diffs = F.zip_with(
        values, reference, lambda p, r: F.abs(F.coalesce(p, F.lit(NEUTRAL)) - F.coalesce(r, F.lit(NEUTRAL)))
    )
    total = F.aggregate(diffs, F.lit(0.0), lambda acc, d: acc + d)
    raw = F.greatest(F.lit(0.0), F.lit(1.0) - total / (MAX_SCORE * EMOTIONS))
    weighted = confidence * raw + (F.lit(1.0) - confidence) * 0.5
    return F.when(values.isNull(), F.lit(0.5)).otherwise(weighted)


def reference_values(record: Column) -> Column:
    """Four reference scores of a probe record, missing ones neutral."""
    names = [f"emotion{k}_score" for k in range(1, EMOTIONS + 1)]
    return F.array(*[F.coalesce(record[n].cast("double"), F.lit(NEUTRAL)) for n in names])
