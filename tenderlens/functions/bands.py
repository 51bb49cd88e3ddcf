"""One generic band builder and the fixed presentation bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def band(rules: list[tuple[Column, str]], default) -> Column:
    """First matching predicate wins; ``default`` labels the rest."""
    out = F.when(rules[0][0], rules[0][1])
    for predicate, label in rules[1:]:
        out = out.when(predicate, label)
    return out.otherwise(default)


def upper_bounds(c: Column, bounds: list, labels: list, strict: int = 0) -> Column:
    """Label ``c`` by ascending upper bounds; the first ``strict`` bounds are exclusive."""
    rules = [
        ((c < b) if i < strict else (c <= b), labels[i]) for i, b in enumerate(bounds)
    ]
    return band(rules, labels[len(bounds)])


# Band labels of the published result sets.
PARTICIPATION = [
    "1  single bidder",
    "2  two tenderers",
    "3  3-5 tenderers",
    "4  6-10 tenderers",
    "5  11-20 tenderers",
    "6  21-50 tenderers",
    "7  51-100 tenderers",
    "8  101-1,000 (ELEVATED, sensitivity only)",
]
RATIO = [
    "1  award below half of budget (<0.5)",
    "2  award 50-90% of budget",
    "3  award within 10% of budget (0.9-1.1)",
    "4  award 110-150% of budget",
    "5  award 1.5x-10x budget",
    "6  award above 10x budget (check units / budget entry)",
]
DURATION = [
    "1  up to 7 days",
    "2  8-30 days",
    "3  31-90 days",
    "4  91-180 days",
    "5  181-365 days",
    "6  over 1 year",
]
IMPLEMENTATION = [
    "1  transactions and milestones",
    "2  milestones only",
    "3  transactions only",
    "4  no implementation data",
]
COVERAGE = [
    "1  full coverage (100%)",
    "2  90% to under 100%",
    "3  50% to under 90%",
    "4  under 50%",
    "5  none reported (0%)",
]
RATIO_NEAR = [
    "ratio 90 to 110",
    "ratio 900 to 1,100",
    "other ratio above 10",
    "ratio 10 or below",
]
STAGES = ["planning", "tender", "award", "contract", "implementation"]


def participation_band(n: Column, labels=PARTICIPATION) -> Column:
    return upper_bounds(n, [1, 2, 5, 10, 20, 50, 100], labels)


def ratio_band(r: Column, labels=RATIO) -> Column:
    return upper_bounds(r, [0.5, 0.9, 1.1, 1.5, 10], labels, strict=2)


def ratio_near(r: Column, labels=RATIO_NEAR) -> Column:
    return band(
        [(r.between(90, 110), labels[0]), (r.between(900, 1100), labels[1]), (r > 10, labels[2])],
        labels[3],
    )


def duration_band(days: Column, labels=DURATION) -> Column:
    return upper_bounds(days, [7, 30, 90, 180, 365], labels)


def implementation_type(tx: Column, ms: Column, labels=IMPLEMENTATION) -> Column:
    return band(
        [((tx > 0) & (ms > 0), labels[0]), (ms > 0, labels[1]), (tx > 0, labels[2])], labels[3]
    )


def coverage_band(rate: Column, labels=COVERAGE) -> Column:
    return band(
        [(rate == 1, labels[0]), (rate >= 0.9, labels[1]), (rate >= 0.5, labels[2]),
         (rate > 0, labels[3])],
        labels[4],
    )


def stage_rank(tags: Column) -> Column:
    """Highest lifecycle stage (1 planning … 5 implementation) among the observed tags."""
    ranks = [F.when(F.array_contains(tags, s), i) for i, s in enumerate(STAGES, start=1)]
    return F.greatest(*ranks)


def stage_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in STAGES]), rank - 1)
