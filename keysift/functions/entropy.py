"""Randomness scores of a string column, as built-in Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from keysift.functions.text import byte_length

# The penalties of the score.
SEQUENCE_PENALTY = 1.2
ONE_CASE_FACTOR = 0.8
PENALTY_FACTORS = {"hex": 0.9, "base64": 0.95, "lowercase": 0.8, "nosymbols": 0.85}
HEX_LADDERS = ("0123456789abcdef", "abcdef0123456789")
LADDER_LENGTH = 16
LADDER_SHARE = 0.8
LADDER_MIN_LENGTH = 10


def is_hex(s: Column) -> Column:
    return (s == "") | s.rlike(r"^[0-9a-fA-F]+\z")


def is_one_case(s: Column) -> Column:
    """Has ASCII letters, and they are all lower case or all upper case."""
    return s.rlike("[a-z]") != s.rlike("[A-Z]")


def is_base64(s: Column) -> Column:
    return s.rlike(r"^[A-Za-z0-9+/]+={0,2}\z") & (byte_length(s) % 4 == 0)


def is_all_lowercase(s: Column) -> Column:
    return ~s.rlike("[A-Z]")


def has_symbol(s: Column) -> Column:
    return s.rlike("[^0-9A-Za-z]")


def is_sequential_or_repeated(s: Column) -> Column:
    """One byte repeated, a 64-bit integer, or hex close to counting up through the digits."""
    repeated = s.rlike(r"(?s)^([\x00-\x7F])\1*\z")
    integer = s.rlike(r"^[+-]?[0-9]+\z") & s.try_cast("bigint").isNotNull()
    head = F.split(F.lower(F.left(s, F.lit(LADDER_LENGTH))), "")
    ladders = []
    for ladder in HEX_LADDERS:
        same = F.aggregate(F.zip_with(head, F.split(F.lit(ladder), ""), lambda a, b: (a == b).cast("int")),
                           F.lit(0), lambda total, equal: total + equal)
        ladders.append((F.length(s) >= LADDER_LENGTH) & (same > LADDER_SHARE * LADDER_LENGTH))
    counting = (is_hex(s) & (F.length(s) >= LADDER_MIN_LENGTH) & s.rlike("[a-f]")
                & reduce(lambda a, b: a | b, ladders))
    return repeated | F.coalesce(integer, F.lit(False)) | counting


def shannon_entropy(s: Column) -> Column:
    """Bits per character; shares are character counts over the length in bytes.

    Sorting the characters turns the counts into lengths of runs, so the cost grows with the
    length of the string and not with the number of different characters in it.
    """
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(s, "")), ""),
                                F.lit(r"(?s)(.)\1*"), F.lit(0))
    size = byte_length(s)
    bits = F.aggregate(runs, F.lit(0.0),
                       lambda total, run: total - F.length(run) / size * F.log2(F.length(run) / size))
    return F.when(s == "", F.lit(0.0)).otherwise(bits)


def adjusted_entropy(s: Column, penalties: tuple[str, ...] = ()) -> Column:
    """Shannon entropy lowered for counting or repeated hex and for one-case strings.

    ``penalties`` multiplies the result once per named penalty that applies; names may repeat
    and unknown names are ignored.  A one-character hex string scores minus infinity.
    """
    size = byte_length(s)
    sequence = (F.when(size == 1, F.lit(float("inf")))
                .otherwise(F.lit(SEQUENCE_PENALTY) / F.log2(size.cast("double"))))
    score = shannon_entropy(s) - F.when(is_hex(s) & is_sequential_or_repeated(s), sequence).otherwise(0.0)
    score = score * F.when(is_one_case(s), ONE_CASE_FACTOR).otherwise(1.0)
    score = F.when(s == "", 0.0).otherwise(score)
    applies = {"hex": is_hex(s), "base64": is_base64(s), "lowercase": is_all_lowercase(s),
               "nosymbols": ~has_symbol(s)}
    for name in penalties:
        if name in applies:
            score = score * F.when(applies[name], PENALTY_FACTORS[name]).otherwise(1.0)
    return score
