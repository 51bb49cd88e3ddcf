"""Mixing sources to target weights by temperature.

With token shares p of the sources, the weights are w = p**a / sum(p**a).  The
exponent a is found by bisection: either the one whose weights have a target
entropy, or the smallest in [0, 1] at which no source is repeated more often
than a limit.  A budget of B tokens gives a source w * B tokens; without a given
budget B is the least with which every source is read once in full.

Weights become whole passes over a source and a part of one more.  Every pass is
a permutation in blocks: documents are ordered by a hash of their id and the
pass, the leading bits are the block.  The partial pass ends at the hash up to
which the source's remaining budget lasts; that cut is found by adding up
tokens per leading bits, then per further bits, then per hash, so no task sees
a whole source.  The result of a source is one row (passes, cut), so realising
the mix joins documents with the small table of sources and nothing else.

Bisection evaluates 33 exponents at a time as one aggregate over the table of
sources; the sources are never collected.

Defined results: a null source is a source of its own; sources without tokens
keep one copy of their documents and have weight 0; documents of equal hash
(repeated rows) are taken or left together; null texts have no tokens.  A
document is never cut.  Input columns whose names this module gives (mix_...) are
replaced, other extra columns stay.  An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tenderlens.llm.storage import stored

REPEATS = 2.0
GRID, ROUNDS = 32, 6
WORD = r"[^\x20\x09-\x0D]+"
COARSE, FINE = 52, 28  # bits that a block and a sub-block leave out


def token_table(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens): words of every whole text."""
    return docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_tokens"),
    )


def _curves(shares: DataFrame, exponents: list[float]) -> list:
    """For each exponent: sum of p**a, entropy of the weights, largest p**(a-1) and p**(1-a)."""
    a = F.col("a")
    rows = shares.withColumn("a", F.explode(F.array(*[F.lit(float(x)) for x in exponents])))
    p = F.col("p")
    return rows.groupBy("a").agg(
        F.sum(F.pow(p, a)).alias("z"), F.sum(F.pow(p, a) * F.log(p)).alias("s"),
        F.max(F.pow(p, a - 1)).alias("up"), F.max(F.pow(p, 1 - a)).alias("down"),
    ).withColumn("entropy", F.log("z") - a * F.col("s") / F.col("z")).orderBy("a").collect()


def exponent(shares: DataFrame, total: float, entropy: float | None = None, repeats: float | None = None,
             budget: float | None = None) -> tuple[float, object]:
    """The exponent and its row of ``_curves``."""
    def fits(row) -> bool:
        if entropy is not None:
            return row.entropy <= entropy
        most = row.up * row.down if budget is None else row.up * budget / total / row.z
        return most <= repeats * (1 + 1e-12)

    low, high = 0.0, 64.0 if entropy is not None else 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        rows = _curves(shares, grid)
        first = next((i for i, r in enumerate(rows) if fits(r)), None)
        if first is None:
            return rows[-1].a, rows[-1]  # out of reach: the last exponent that may be used
        chosen = rows[first]
        if first == 0:
            return chosen.a, chosen
        low, high = rows[first - 1].a, chosen.a
    return chosen.a, chosen


def _order(doc_id: Column, turn: Column) -> Column:
    return F.xxhash64(doc_id, turn.cast("bigint"))


def _reach(rows: DataFrame, key: str) -> DataFrame:
    """Per source: the last key before which the budget holds in full, and what is left of it there."""
    sums = rows.groupBy("source", "left", key).agg(F.sum("n_tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    upto = sums.withColumn("before", F.coalesce(before, F.lit(0))).withColumn(
        "fits", F.col("before") + F.col("tokens") <= F.col("left")
    )
    # The first key that does not fit is the edge; everything before it is in.
    return upto.where(~F.col("fits")).groupBy("source").agg(
        F.min(F.struct(F.col(key).alias("edge"), (F.col("left") - F.col("before")).alias("rest"))).alias("m")
    ).select("source", F.col("m.edge").alias("edge"), F.col("m.rest").alias("rest"))


def plan(tokens: DataFrame, entropy: float | None = None, repeats: float | None = REPEATS, budget: float | None = None) -> DataFrame:
    """(source, tokens, weight, passes, cut): one row per source.

    A document of the source has ``passes`` copies, and one more if the hash of
    its id and ``passes`` is not above ``cut``.
    """
    totals = stored(tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "mix-sources")
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return totals.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1).cast("bigint").alias("passes"),
                             F.lit(None).cast("bigint").alias("cut"))
    shares = totals.where("tokens > 0").select("source", "tokens", (F.col("tokens") / F.lit(float(total))).alias("p"))
    a, at = exponent(shares, float(total), entropy, repeats, budget)
    amount = float(budget) if budget is not None else total * at.z * at.down
    p = F.col("tokens") / F.lit(float(total))
    weight = F.when(F.col("tokens") > 0, F.pow(p, F.lit(a)) / F.lit(at.z)).otherwise(0.0)
    wanted = F.floor(F.col("weight") * F.lit(amount) + F.lit(1e-6)).cast("bigint")
    sources = totals.withColumn("weight", weight).withColumn("wanted", wanted).select(
        "source", "tokens", "weight",
        F.when(F.col("tokens") > 0, F.floor(F.col("wanted") / F.col("tokens"))).otherwise(1).cast("bigint").alias("passes"),
        F.when(F.col("tokens") > 0, F.col("wanted") % F.col("tokens")).otherwise(0).cast("bigint").alias("left"),
    )
    sources = stored(sources, "mix-weights")
    key = sources.select(F.col("source").alias("_s"), "passes", "left")
    rows = tokens.join(key, F.col("source").eqNullSafe(F.col("_s"))).where("left > 0").select(
        "source", "left", "n_tokens", _order(F.col("doc_id"), F.col("passes")).alias("hash")
    ).withColumns({"block": F.shiftright("hash", COARSE), "part": F.shiftright("hash", FINE)})

    def narrowed(by: str, edges: DataFrame) -> DataFrame:
        edges = edges.select(F.col("source").alias("_s"), "edge", "rest")
        same = F.col("source").eqNullSafe(F.col("_s")) & (F.col(by) == F.col("edge"))
        return rows.join(edges, same).select("source", F.col("rest").alias("left"), "n_tokens", "hash", "block", "part")

    parts = _reach(narrowed("block", _reach(rows, "block")), "part")
    hashes = _reach(narrowed("part", parts), "hash").select(F.col("source").alias("_s"), (F.col("edge") - 1).alias("cut"))
    out = sources.join(hashes, F.col("source").eqNullSafe(F.col("_s")), "left")
    return stored(out.select("source", "tokens", "weight", "passes", "cut"), "mix-plan")


def realise(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Every copy of every document: the columns of ``docs`` and mix_pass, mix_block, mix_weight."""
    key = sources.select(F.col("source").alias("mix_source"), F.col("passes").alias("mix_passes"),
                         F.col("cut").alias("mix_cut"), F.col("weight").alias("mix_weight"))
    docs = docs.drop("mix_pass", "mix_block", "mix_weight", "mix_source", "mix_passes", "mix_cut")
    rows = docs.join(key, docs["source"].cast("string").eqNullSafe(F.col("mix_source")))
    more = F.coalesce(_order(F.col("doc_id"), F.col("mix_passes")) <= F.col("mix_cut"), F.lit(False)).cast("bigint")
    copies = F.col("mix_passes") + more
    rows = rows.where(copies > 0).withColumn("mix_pass", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)))
    block = F.shiftright(_order(F.col("doc_id"), F.col("mix_pass")), COARSE) + F.lit(1 << (63 - COARSE))
    return rows.withColumn("mix_block", block).select(*[F.col(f"`{c}`") for c in docs.columns], "mix_pass", "mix_block", "mix_weight")


def mixture(docs: DataFrame, entropy: float | None = None, repeats: float | None = REPEATS, budget: float | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, mix_pass, mix_block, mix_weight): the mix without texts."""
    tokens = stored(token_table(docs), "mix-tokens")
    return realise(tokens, plan(tokens, entropy, repeats, budget))
