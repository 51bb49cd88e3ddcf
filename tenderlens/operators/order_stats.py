"""Exact order statistics without an unbounded single-task sort.

A value is mapped to one of some ten thousand monotone log-scale buckets. A
histogram of the buckets (bounded size) gives the count and sum in front of
each bucket; only the rows inside a bucket are then sorted, each bucket in its
own task. Where rows need a place of their own, a bucket that many of them tie in is
cut into ranges of the whole order, tie-break keys included. Results are exact:
bucket and range decide where the work happens, never what the answer is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEPS_PER_OCTAVE = 256
# Ranges of a whole table at most, sampled rows for each, rows of a range at least, splitters compared at a time.
_RANGES, _SAMPLED, _RANGE_ROWS, _CHUNK = 1024, 16, 4096, 32


def value_bucket(value: Column) -> Column:
    """Monotone bucket number, 0.3% wide: money spans some 10,000 buckets, and
    one bucket of 4-decimal amounts holds a bounded number of distinct values."""
    x = value.cast("double")
    b = (F.signum(x) * F.floor(F.log2(F.abs(x) + 1) * _STEPS_PER_OCTAVE)).cast("int")
    # Never NULL: no null filter is pushed to one side of the bucket joins only,
    # so both sides keep the same plan and the pre-aggregated shuffle is reused.
    return F.coalesce(b, F.lit(0))


def _keys(groups) -> list[str]:
    return list(groups) if groups else ["_all"]


def _with_key(df: DataFrame, groups) -> DataFrame:
    return df if groups else df.withColumn("_all", F.lit(0))


def _before(hist: DataFrame, keys: list[str], sums: list[str], cell: tuple = ("_b",)) -> DataFrame:
    """Running totals strictly in front of each bucket, and group totals."""
    w = Window.partitionBy(*keys).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    zero = F.lit(0)
    return hist.select(
        *keys,
        *cell,
        *[F.col(c).alias(f"_in_{c}") for c in sums],
        *[F.coalesce(F.sum(c).over(w), zero).alias(f"_before_{c}") for c in sums],
        *[F.sum(c).over(whole).alias(f"_total_{c}") for c in sums],
    )


def _place(p: float, n: Column, exclusive: bool) -> Column:
    """Place of a percentile among n sorted values, counted from zero."""
    if exclusive:
        return F.greatest(F.lit(0.0), F.least(F.lit(p) * (n + 1) - 1, (n - 1).cast("double")))
    return F.lit(p) * (n - 1)


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values ``_v`` with the sum of their counts ``_c`` and their bucket."""
    return rows.groupBy(*keys, "_v").agg(F.sum("_c").alias("_c")).withColumn("_b", value_bucket(F.col("_v")))


def exact_percentiles(
    df: DataFrame, value: str, probs: dict[str, float], groups: tuple | list = (), exclusive: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Interpolated percentiles per group (``percentile_cont`` semantics).

    ``exclusive`` puts the percentile at p (n + 1), counted from one, so that the
    sample's ends are not the population's; places outside are the ends. A row
    counts as often as ``weight`` says.

    Equal values are pre-aggregated before they are shuffled, so one value
    holding a third of the rows is one row per map task. Without groups only the values
    of the buckets that hold a percentile are shuffled; the input is read twice.
    Group keys must be non-null; NULL values are ignored.
    """
    keys = _keys(groups)
    src = _with_key(df, groups).filter(F.col(value).isNotNull())
    src = src.select(*keys, F.col(value).alias("_v"), (F.col(weight) if weight else F.lit(1)).alias("_c"))
    freq = _counted(src, keys) if groups else src.withColumn("_b", value_bucket(F.col("_v")))
    hist = _before(freq.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c")), keys, ["_c"])
    n = F.col("_total__c")
    names = list(probs)
    wanted = []
    for i, name in enumerate(names):
        exact = _place(float(probs[name]), n, exclusive)
        wanted.append(F.struct(F.lit(2 * i).alias("i"), F.floor(exact).alias("at")))
        wanted.append(F.struct(F.lit(2 * i + 1).alias("i"), F.ceil(exact).alias("at")))
    lo, hi = F.col("_before__c"), F.col("_before__c") + F.col("_in__c")
    targets = hist.withColumn(
        "_want", F.filter(F.array(*wanted), lambda t: (t["at"] >= lo) & (t["at"] < hi))
    ).filter(F.size("_want") > 0)
    if not groups:  # two buckets for each percentile at most
        freq = _counted(freq.join(F.broadcast(targets.select(*keys, "_b")), [*keys, "_b"], "left_semi"), keys)
    w = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = (
        freq.join(targets.select(*keys, "_b", "_before__c", "_total__c", "_want"), [*keys, "_b"])
        .withColumn("_upto", F.col("_before__c") + F.sum("_c").over(w))
        .withColumn(
            "_hit",
            F.filter(
                "_want",
                lambda t: (t["at"] < F.col("_upto")) & (t["at"] >= F.col("_upto") - F.col("_c")),
            ),
        )
        .filter(F.size("_hit") > 0)
        .select(*keys, F.col("_v").cast("double").alias("_v"), "_total__c", F.explode("_hit.i").alias("_i"))
    )
    aggs = [F.max(F.when(F.col("_i") == j, F.col("_v"))).alias(f"_q{j}") for j in range(2 * len(names))]
    q = inside.groupBy(*keys).agg(F.max("_total__c").alias("_n"), *aggs)
    out = []
    for i, name in enumerate(names):
        exact = _place(float(probs[name]), F.col("_n"), exclusive)
        part = exact - F.floor(exact)
        a, b = F.col(f"_q{2 * i}"), F.col(f"_q{2 * i + 1}")
        # Ten places: an exact tie stays a tie when the caller rounds it.
        out.append(F.round(a + (b - a) * part, 10).alias(name))
    return q.select(*list(groups), *out)


def with_position(
    df: DataFrame,
    order: list[tuple[str, str]],
    name: str,
    groups: tuple | list = (),
    kind: str = "rank",
    running: dict[str, str] | None = None,
    count_as: str | None = None,
    rank_keys: int | None = None,
    split_ties: bool = False,
) -> DataFrame:
    """Global (or per-group) ``rank`` / ``row_number`` in ``order``.

    ``order`` is a list of (column, 'asc' | 'desc'); the first is numeric and
    not null. ``running`` maps a column to the name of its running sum
    (current row included; give a unique last order key); its group total is
    kept as ``<name>_total``. ``rank_keys`` ranks on the leading keys only.
    ``count_as`` names the number of rows of the group. ``split_ties`` cuts the
    buckets into ranges of the whole order, for tables of which any share may tie in the
    first column; it reads the input twice more. Without it a bucket is one task, which
    suits tables of one row per entity. A plain rank never sorts ties.
    """
    running = running or {}
    if kind == "rank" and not running:
        return _with_rank(df, order[:rank_keys], name, groups, count_as)
    if kind == "rank" and split_ties:
        ranked = _with_rank(df, order[:rank_keys], name, groups, count_as)
        out = with_position(ranked, order, "_place", groups, "row_number", running, split_ties=True)
        return out.select(*ranked.columns, *[c for alias in running.values() for c in (alias, f"{alias}_total")])
    keys = _keys(groups)
    cell = ("_b", "_r") if split_ties else ("_b",)
    src = _with_ranges(df, order, groups) if split_ties else _with_bucket(df, order, groups)
    sums = ["_c", *running]
    hist = _before(
        src.groupBy(*keys, *cell).agg(F.count(F.lit(1)).alias("_c"), *[F.sum(c).alias(c) for c in running]), keys, sums, cell
    ).select(*keys, *cell, *[f"_before_{c}" for c in sums], *[f"_total_{c}" for c in sums])
    w = Window.partitionBy(*keys, *cell).orderBy(*_sorted_by(order), *(["_t"] if split_ties else []))
    ranked = Window.partitionBy(*keys, *cell).orderBy(*_sorted_by(order[:rank_keys]))
    place = F.rank().over(ranked) if kind == "rank" else F.row_number().over(w)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = src.join(hist, [*keys, *cell])
    out = out.withColumn(name, (F.col("_before__c") + place).cast("bigint"))
    for c, alias in running.items():
        out = out.withColumn(alias, F.col(f"_before_{c}") + F.sum(c).over(upto))
        out = out.withColumnRenamed(f"_total_{c}", f"{alias}_total")
    keep = [*df.columns, name]
    for alias in running.values():
        keep += [alias, f"{alias}_total"]
    if count_as:
        out = out.withColumn(count_as, F.col("_total__c").cast("bigint"))
        keep.append(count_as)
    return out.select(*keep)


def _sorted_by(order: list[tuple[str, str]]) -> list[Column]:
    return [F.col(c).desc() if d == "desc" else F.col(c).asc() for c, d in order]


def _in_front(splitter: Column, order: list[tuple[str, str]]) -> Column:
    """Whether a splitter comes strictly before the row, with nulls where a sort puts them."""
    out = F.lit(False)
    for c, direction in reversed([*order, ("_t", "asc")]):
        s, x = splitter[c], F.col(c)
        less = (s > x) | (s.isNotNull() & x.isNull()) if direction == "desc" else (s < x) | (s.isNull() & x.isNotNull())
        out = F.coalesce(less, F.lit(False)) | (s.eqNullSafe(x) & out)
    return out


def _with_bucket(df: DataFrame, order: list[tuple[str, str]], groups: tuple | list) -> DataFrame:
    first, direction = order[0]
    b = value_bucket(F.col(first))
    return _with_key(df, groups).withColumn("_b", -b if direction == "desc" else b)


def _with_ranges(df: DataFrame, order: list[tuple[str, str]], groups: tuple | list) -> DataFrame:
    """The rows with bucket ``_b``, range ``_r`` and a last tie-break ``_t``, a hash of the row.

    Splitters are evenly spaced rows of a sample in the whole order, chosen by hash, so
    any share of the rows may tie in the leading value: a range holds some 1/1024 of the
    table, or ``_RANGE_ROWS`` rows. At most about ``_RANGES`` splitters go to every task;
    a row meets those of its own bucket, the heads of chunks first.
    """
    keys = _keys(groups)
    whole = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    src = _with_bucket(df, order, groups).withColumn("_t", F.xxhash64(*whole))
    n = src.agg(F.count(F.lit(1))).scalar()
    columns = list(dict.fromkeys([c for c, _ in order] + ["_t"]))
    rate = F.least(F.lit(1.0), F.lit(float(_RANGES * _SAMPLED)) / F.greatest(n, F.lit(1)))
    step = F.greatest(F.lit(_SAMPLED), F.ceil(F.lit(_RANGE_ROWS) * rate))
    drawn = src.filter(F.pmod(F.xxhash64(*columns, F.lit(1)), F.lit(1 << 40)) < rate * float(1 << 40))
    all_keys = list(dict.fromkeys([*keys, "_b", *columns]))
    w = Window.partitionBy(F.lit(0)).orderBy(*keys, *_sorted_by(order), "_t")  # the sample, a bounded number of rows
    splitters = drawn.select(*all_keys).withColumn("_i", F.row_number().over(w)).filter(F.col("_i") % step == 0)
    held = splitters.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(F.struct("_i", *columns))).alias("_s"))
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_s") - 1) / _CHUNK).cast("int")), lambda i: F.slice("_s", i * _CHUNK + 1, F.lit(_CHUNK)))
    held = held.select(*keys, "_b", chunks.alias("_chunks")).withColumn("_heads", F.transform("_chunks", lambda c: c[0]))
    out = src.join(F.broadcast(held), [*keys, "_b"], "left")
    passed = F.size(F.filter("_heads", lambda s: _in_front(s, order)))
    out = out.withColumn("_h", F.when(F.col("_heads").isNotNull(), passed).otherwise(0))
    inside = F.size(F.filter(F.get("_chunks", F.col("_h") - 1), lambda s: _in_front(s, order)))
    out = out.withColumn("_r", F.when(F.col("_h") > 0, (F.col("_h") - 1) * _CHUNK + inside).otherwise(0))
    return out.drop("_heads", "_chunks", "_h")


def _with_rank(
    df: DataFrame, order: list[tuple[str, str]], name: str, groups: tuple | list, count_as: str | None
) -> DataFrame:
    """Rank of a value is one more than the rows in front of it, so it is worked
    out on the distinct values: ties of any number are one row per map task, and
    no task sorts them. Rows get their rank by a join that Spark can split."""
    keys = _keys(groups)
    src = _with_key(df, groups)
    columns = [c for c, _ in order]
    first, direction = order[0]
    b = value_bucket(F.col(first))
    values = src.groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", -b if direction == "desc" else b)
    hist = _before(values.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c")), keys, ["_c"])
    cols = [F.col(c).desc() if d == "desc" else F.col(c).asc() for c, d in order]
    w = Window.partitionBy(*keys, "_b").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    ranked = values.join(hist.select(*keys, "_b", "_before__c", "_total__c"), [*keys, "_b"]).select(
        *[F.col(c).alias(f"_k_{c}") for c in dict.fromkeys([*keys, *columns])],
        (F.col("_before__c") + F.coalesce(F.sum("_c").over(w), F.lit(0)) + 1).cast("bigint").alias(name),
        F.col("_total__c").cast("bigint").alias("_n"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in dict.fromkeys([*keys, *columns])]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    out = src.join(ranked, condition)
    extra = [F.col("_n").alias(count_as)] if count_as else []
    return out.select(*df.columns, name, *extra)


def percent_rank(rank: Column, n: Column) -> Column:
    return F.when(n > 1, (rank - 1) / (n - 1).cast("double")).otherwise(F.lit(0.0))


def ntile(row_number: Column, n: Column, k: int) -> Column:
    """Tile of a row from its position; the first ``n % k`` tiles are one longer."""
    size, extra = F.floor(n / k), n % k
    cut = extra * (size + 1)
    return (
        F.when(row_number <= cut, F.floor((row_number - 1) / (size + 1)) + 1)
        .otherwise(extra + F.floor((row_number - 1 - cut) / F.greatest(size, F.lit(1))) + 1)
        .cast("bigint")
    )


def top_rows(
    df: DataFrame, order: list[tuple[str, str]], n: int, groups: tuple | list = (), name: str = "position"
) -> DataFrame:
    """The first ``n`` rows in ``order`` with their position. Both forms prune
    on the map side: a global top-n keeps n rows per task, a grouped one n
    rows per group and task (window group limit)."""
    cols = [F.col(c).desc() if d == "desc" else F.col(c).asc() for c, d in order]
    if groups:
        w = Window.partitionBy(*groups).orderBy(*cols)
        return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    few = df.orderBy(*cols).limit(n).withColumn("_all", F.lit(0))
    w = Window.partitionBy("_all").orderBy(*cols)
    return few.withColumn(name, F.row_number().over(w)).drop("_all")


def depth_to_share(
    df: DataFrame, value: str, shares: dict[str, str], groups: tuple | list = ()
) -> DataFrame:
    """How many of the largest values are needed to reach each share of the total.

    The total is that of all values, zero and negative ones included.
    ``shares`` maps an output name to a decimal share such as '0.5'. Equal
    values are one row, so ties cost nothing.
    """
    keys = _keys(groups)
    src = _with_key(df, groups).filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))

    def counted(rows: DataFrame) -> DataFrame:
        """Distinct values with their count, sum and bucket; running sums grow over the positive ones only."""
        return rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"), F.sum("_v").alias("_a")).withColumns(
            {"_b": -value_bucket(F.col("_v")), "_s": F.when(F.col("_v") > 0, F.col("_a")).otherwise(F.lit(0))})

    # The goal is a share of everything. Without groups the values of the buckets that hold a goal are all that is shuffled.
    freq = counted(src) if groups else src.withColumns({
        "_b": -value_bucket(F.col("_v")), "_c": F.lit(1), "_a": F.col("_v"), "_s": F.when(F.col("_v") > 0, F.col("_v")).otherwise(F.lit(0))})
    hist = _before(
        freq.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c"), F.sum("_s").alias("_s"), F.sum("_a").alias("_a")),
        keys, ["_c", "_s", "_a"],
    )
    total = F.col("_total__a")
    goals = [
        F.struct(F.lit(i).alias("i"), (total * F.lit(s).cast("decimal(4,3)")).cast("decimal(38,6)").alias("goal"))
        for i, s in enumerate(shares.values())
    ]
    before, upto = F.col("_before__s"), F.col("_before__s") + F.col("_in__s")
    targets = hist.withColumn(
        "_want", F.filter(F.array(*goals), lambda t: (t["goal"] > before) & (t["goal"] <= upto))
    ).filter(F.size("_want") > 0).select(*keys, "_b", "_before__c", "_before__s", "_want")
    if not groups:
        freq = counted(src.withColumn("_b", -value_bucket(F.col("_v"))).join(F.broadcast(targets.select(*keys, "_b")), [*keys, "_b"], "left_semi"))
    w = Window.partitionBy(*keys, "_b").orderBy(F.col("_v").desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    inside = (
        freq.join(targets, [*keys, "_b"])
        .withColumn("_n0", F.col("_before__c") + F.coalesce(F.sum("_c").over(w), zero))
        .withColumn("_s0", F.col("_before__s") + F.coalesce(F.sum("_s").over(w), zero))
        .withColumn("_t", F.explode("_want"))
        .filter((F.col("_t.goal") > F.col("_s0")) & (F.col("_t.goal") <= F.col("_s0") + F.col("_s")))
        .withColumn("_need", F.col("_t.goal") - F.col("_s0"))
        # Whole multiples and their remainder are exact on decimals.
        .withColumn("_depth", F.col("_n0") + F.expr("_need div _v") + F.when(F.col("_need") % F.col("_v") > 0, 1).otherwise(0))
    )
    return inside.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("_t.i") == i, F.col("_depth"))).cast("bigint").alias(name)
            for i, name in enumerate(shares)
        ]
    ).select(*list(groups), *shares)
