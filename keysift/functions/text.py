"""Positions, digests and shortened forms of matched text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Cut lengths of the reports.
REDACT_KEEP = 4
REDACT_OVER = 8
STABLE_PREFIX = 8
CLIP_OVER, CLIP_KEEP = 40, 20
FINGERPRINT_LENGTH = 32
FINGERPRINT_SHOWN = 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside higher-order functions."""
    return F.transform(F.array(value), body).getItem(0)


def sql_string(text: str) -> str:
    """The text as an SQL string literal, whatever the session's escaping rules.

    Expressions with hundreds of literals are built as one SQL text: a call per literal would
    cost the driver more than a small scan takes.
    """
    return ' r"\'" '.join(f"r'{part}'" for part in text.split("'"))


def byte_length(s: Column) -> Column:
    return F.octet_length(s)


def match_position(text: Column, offset: Column) -> tuple[Column, Column]:
    """1-based line and column of a 0-based character offset; columns count code points."""
    prefix = F.left(text, offset)
    line = F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1
    return line, F.length(F.substring_index(prefix, "\n", -1)) + 1


def match_context(lines: Column, first_line: Column, last_line: Column, around: int = 2) -> Column:
    """The lines of a match with ``around`` lines before and after, cut at the ends of the text."""
    start = F.greatest(first_line - around, F.lit(1))
    stop = F.least(last_line + around, F.size(lines))
    return F.slice(lines, start, stop - start + 1)


def fingerprint(rule_id: Column, file: Column, line: Column, column: Column, match: Column) -> Column:
    """Identity of a finding: rule, file, place and matched text."""
    return F.left(F.sha2(F.concat(rule_id, file, line.cast("string"), F.lit(":"),
                                  column.cast("string"), match), 256), F.lit(FINGERPRINT_LENGTH))


def stable_fingerprint(rule_id: Column, file: Column, match: Column) -> Column:
    """Identity that survives moved lines: rule, file and the first bytes of the match."""
    head = F.substring(F.encode(match, "UTF-8"), 1, STABLE_PREFIX)
    return F.left(F.sha2(F.concat(F.encode(rule_id, "UTF-8"), F.encode(file, "UTF-8"), head), 256),
                  F.lit(FINGERPRINT_LENGTH))


def redact(match: Column) -> Column:
    keep = F.lit(REDACT_KEEP)
    return (F.when(byte_length(match) > REDACT_OVER,
                   F.concat(F.left(match, keep), F.lit("***"), F.right(match, keep)))
            .otherwise("***"))


def truncate(s: Column, limit: int) -> Column:
    return F.when(byte_length(s) > limit, F.concat(F.left(s, F.lit(limit)), F.lit("..."))).otherwise(s)


def clip_match(match: Column) -> Column:
    keep = F.lit(CLIP_KEEP)
    return (F.when(byte_length(match) > CLIP_OVER,
                   F.concat(F.left(match, keep), F.lit("..."), F.right(match, keep)))
            .otherwise(match))


def fingerprint_short(fp: Column) -> Column:
    return (F.when(F.length(fp) > FINGERPRINT_SHOWN,
                   F.concat(F.left(fp, F.lit(FINGERPRINT_SHOWN)), F.lit("..."))).otherwise(fp))
