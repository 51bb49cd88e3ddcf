"""Row-level data-quality flags and text standardisation, as plain columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderlens.rules import SMALL_N_NOTE, Rules

# Fixed value: the characters a strict trim removes (space, tab, line feed,
# vertical tab, form feed, carriage return, no-break space).
STRIP_CHARS = " \t\n\x0b\x0c\r\xa0"


def strict_date(c: Column, field: str) -> Column:
    """'YYYY-MM-DDT00:00:00Z' to date; empty becomes NULL; anything else stops the job."""
    ok = (F.length(c) == 20) & c.endswith("T00:00:00Z")
    bad = F.raise_error(F.concat(F.lit(f"{field}: unexpected date format "), c))
    return (
        F.when(c.isNull() | (c == ""), F.lit(None).cast("date"))
        .when(ok, F.to_date(F.substring(c, 1, 10)))
        .otherwise(bad.cast("date"))
    )


def utc_day(ts: Column) -> Column:
    """Calendar day of an instant in UTC, whatever the session time zone."""
    return F.to_date(F.to_utc_timestamp(ts, F.current_timezone()))


def date_flag(d: Column, r: Rules) -> Column:
    return (
        F.when(d.isNull(), F.lit(None))
        .when(d == F.lit(r.placeholder_date).cast("date"), "PLACEHOLDER")
        .when(d >= F.lit(r.impossible_from).cast("date"), "IMPOSSIBLE")
        .when(d >= F.lit(r.future_from).cast("date"), "FUTURE")
        .otherwise("VALID")
    )


def extreme_flag(amount: Column, threshold) -> Column:
    return F.when(amount >= F.lit(threshold), "EXTREME")


def zero_flag(amount: Column) -> Column:
    return F.when(amount == 0, "ZERO_VALUE")


def count_class(n: Column, r: Rules) -> Column:
    """NORMAL / ELEVATED / ANOMALOUS; a missing or non-positive count stops the job."""
    return (
        F.when(n > r.elevated_max, "ANOMALOUS")
        .when(n > r.normal_max, "ELEVATED")
        .when(n >= 1, "NORMAL")
        .otherwise(F.raise_error(F.lit("number of tenderers must be 1 or more")).cast("string"))
    )


def incomplete_flag(identifier: Column, bare: str) -> Column:
    return F.when(identifier == bare, "INCOMPLETE")


def test_entity_flag(buyer: Column, r: Rules) -> Column:
    return F.when(buyer == r.test_buyer_id, "TEST_ENTITY")


def multi_project_flag(n: Column) -> Column:
    return F.when(n > 1, "MULTI_PROJECT")


def standard_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strict_trim(c: Column) -> Column:
    return F.nullif(F.btrim(c, F.lit(STRIP_CHARS)), F.lit(""))


def looks_like_test(parts: list[Column], r: Rules) -> Column:
    words = "|".join(r.test_words)
    return F.concat_ws(" ", *parts).rlike(rf"(?i)\b({words})\b")


def sequence_key(identifier: Column) -> Column:
    """Integer order of a numeric string id; a malformed id fails under ANSI mode."""
    return identifier.cast("bigint")


def buyer_code(buyer: Column, r: Rules) -> Column:
    return F.regexp_replace(buyer, r.buyer_code_prefix, "")


def small_n_note(n: Column, k: int, text: str = SMALL_N_NOTE) -> Column:
    return F.when(n < k, text).otherwise("")


def materiality(pct: Column, r: Rules) -> Column:
    return (
        F.when(pct >= r.high_pct, "HIGH").when(pct >= r.moderate_pct, "MODERATE").otherwise("LOW")
    )
