"""Export tables: aggregates, facts, dictionary encoding, exact minor units, presentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.functions import bands
from tenderlens.plans.common import mark, rows, union
from tenderlens.plans.questions_supply import AWARD
from tenderlens.plans.views import method
from tenderlens.rules import METHOD_NOT_STATED
from tenderlens.sources.sinks import replace_tables

SAFE_INTEGER = 2**53


def lifecycle_cells(v) -> DataFrame:
    return v.lifecycle_stage.groupBy("buyer_id", "buyer_id_flag", "highest_stage_rank").agg(rows().alias("processes"))


def is_whole_minor(amount: Column, factor: int = 100) -> Column:
    x = amount * factor
    return x == F.floor(x)


def budget_cells(v) -> DataFrame:
    b = F.col("budget_amount")
    return v.budget_eligible.groupBy("buyer_id").agg(
        rows().alias("lines"), F.sum(b).alias("budget"), F.bool_and(is_whole_minor(b)).alias("whole_minor_units")
    )


def contract_cells(v) -> DataFrame:
    kind = bands.implementation_type(
        F.col("transaction_count"), F.col("implementation_milestone_count"), [F.lit(i) for i in range(1, 5)]
    )
    return v.contract_implementation_coverage.groupBy(
        "buyer_id", "buyer_id_flag", "contract_status", kind.alias("data_type"), "has_implementation"
    ).agg(rows().alias("contracts"))


def supplier_cells(v) -> DataFrame:
    return v.supplier_award_eligible.groupBy("supplier_id").agg(
        F.min("supplier_name").alias("name_low"), F.max("supplier_name").alias("name_high"),
        F.max("name_variant_count").alias("name_variant_count"), rows().alias("awards"),
        F.max("distinct_supplier_count").alias("distinct_supplier_count"),
    )


def award_facts(v) -> DataFrame:
    sup = v.supplier_award_eligible.select("award_id", "supplier_id")
    flag = v.award_scale_flag.select("award_id", "dropped_decimal_test", "sibling_lot_test", F.lit(True).alias("_f"))
    no = F.lit(False)
    return (
        v.award_value_eligible.select("award_id", "buyer_id", "buyer_id_flag", "procurement_method_details", AWARD)
        .join(sup, "award_id", "left")
        .join(flag, "award_id", "left")
        .select(
            "award_id", "buyer_id", "buyer_id_flag", "procurement_method_details", AWARD, "supplier_id",
            F.coalesce("_f", no).alias("is_flagged"),
            F.coalesce("dropped_decimal_test", no).alias("dropped_decimal_test"),
            F.coalesce("sibling_lot_test", no).alias("sibling_lot_test"),
        )
    )


def budget_award_facts(v) -> DataFrame:
    return mark(v.budget_award_comparison, v.award_scale_flag, "award_id", "is_flagged").select(
        "buyer_id", "buyer_id_flag", "procurement_method_details", "budget_amount", AWARD, "variance_amount",
        "award_to_budget_ratio", "is_flagged",
    )


def timing_facts(v) -> DataFrame:
    who = ["buyer_id", "buyer_id_flag"]
    none = F.lit(None).cast("string")
    return union(
        [
            v.tender_duration_eligible.select(
                F.lit("tender_duration").alias("fact"), *who, F.col("procurement_method_details").alias("method"),
                F.year("tender_start_date").alias("year"), F.col("tender_duration_days").alias("days")),
            v.award_lag_eligible.select(
                F.lit("award_lag").alias("fact"), *who, F.col("procurement_method_details").alias("method"),
                F.year("award_date").alias("year"), F.col("award_lag_days").alias("days")),
            v.signature_lag_eligible.select(
                F.lit("signature_lag").alias("fact"), *who, none.alias("method"),
                F.lit(None).cast("int").alias("year"), F.col("signature_lag_days").alias("days")),
        ]
    )


def dictionary(values: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """Dense 0-based index of the distinct keys. Ids are numbered inside hash
    buckets and shifted by the sizes of the buckets before them, so no task
    ever holds the whole dictionary."""
    d = values.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(
        "_b", F.pmod(F.xxhash64(key), F.lit(buckets))
    )
    sizes = d.groupBy("_b").agg(rows().alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"))  # <= buckets rows
    w = Window.partitionBy("_b").orderBy(key)
    return d.join(shift, "_b").select(key, (F.col("_shift") + F.row_number().over(w) - 1).alias("index"))


def encode(facts: DataFrame, column: str, codes: DataFrame, key: str, out: str, bare: str | None = None) -> DataFrame:
    """Replace a value by its index; the reserved id becomes -1, an unknown value stays NULL."""
    c = codes.select(F.col(key).alias(column), F.col("index").alias(out))
    joined = facts.join(c, column, "left")
    if bare is not None:
        joined = joined.withColumn(out, F.when(F.col(column) == bare, F.lit(-1)).otherwise(F.col(out)))
    return joined.drop(column)


def encoded_awards(v) -> DataFrame:
    facts = award_facts(v).withColumn("procurement_method", method()).drop("procurement_method_details")
    buyers = dictionary(v.dim_buyer, "buyer_id")
    methods = dictionary(v.dim_procurement_method, "procurement_method")
    facts = encode(facts, "buyer_id", buyers, "buyer_id", "buyer_index", v.rules.bare_buyer_id)
    return encode(facts, "procurement_method", methods, "procurement_method", "method_index")


def encoding_guard(v) -> DataFrame:
    """Rows, codes outside the dictionary, and how many codes each fact column uses."""
    e = encoded_awards(v)
    n_buyers = v.dim_buyer.agg(rows()).scalar()
    n_methods = v.dim_procurement_method.agg(rows()).scalar()
    b, m = F.col("buyer_index"), F.col("method_index")
    return e.agg(
        rows().alias("facts"),
        F.count_if(b.isNull() | (b < -1) | (b >= n_buyers)).alias("buyers_outside"),
        F.count_if(m.isNull() | (m < 0) | (m >= n_methods)).alias("methods_outside"),
        F.count_if(b == -1).alias("bare_buyer_facts"),
        F.count_distinct("buyer_index").alias("buyers_used"),
        F.count_distinct("method_index").alias("methods_used"),
    )


def minor_units(amount: Column, factor: int = 100) -> Column:
    """Exact integer minor units; a fraction or an overflow stops the job."""
    x = amount * factor
    ok = is_whole_minor(amount, factor) & (F.abs(x) < SAFE_INTEGER)
    return F.when(amount.isNull(), F.lit(None).cast("bigint")).when(ok, x.cast("bigint")).otherwise(
        F.raise_error(F.lit("amount is not a whole number of minor units")).cast("bigint")
    )


def award_minor_units(v) -> DataFrame:
    return v.award_value_eligible.select("award_id", minor_units(F.col(AWARD)).alias("value_minor"))


def presentation(df: DataFrame, keep: dict[str, str], fill: dict[str, str] | None = None) -> DataFrame:
    """Keep and rename columns and label their NULLs, for a reporting tool."""
    fill = fill or {}
    return df.select(
        *[
            (F.coalesce(F.col(c), F.lit(fill[c])) if c in fill else F.col(c)).alias(name)
            for c, name in keep.items()
        ]
    )


# view -> columns shown; where a view has a method it is renamed and its NULL labelled.
_METHOD = "procurement_method_details"
PRESENTED = {
    "dim_buyer": ["buyer_id", "buyer_name", "buyer_code", "buyer_label"],
    "dim_procurement_method": ["procurement_method", "is_not_stated"],
    "lifecycle_stage": ["ocid", "buyer_id", "release_count", "highest_stage_rank", "highest_stage"],
    "budget_eligible": ["ocid", "budget_project_id", "buyer_id", "budget_amount", "multi_project_flag"],
    "competition_eligible": ["ocid", "buyer_id", _METHOD, "tender_status", "number_of_tenderers", "in_primary_population", "is_single_bidder"],
    "award_value_eligible": ["ocid", "award_id", "buyer_id", _METHOD, "award_value_amount", "award_date"],
    "supplier_award_eligible": ["ocid", "award_id", "buyer_id", _METHOD, "supplier_id", "supplier_name", "award_value_amount"],
    "budget_award_comparison": ["ocid", "award_id", "buyer_id", _METHOD, "budget_amount", "award_value_amount", "award_to_budget_ratio"],
    "tender_duration_eligible": ["ocid", "buyer_id", _METHOD, "tender_start_date", "tender_duration_days"],
    "award_lag_eligible": ["ocid", "award_id", "buyer_id", _METHOD, "award_date", "award_lag_days"],
    "signature_lag_eligible": ["ocid", "contract_id", "buyer_id", "date_signed", "signature_lag_days"],
    "contract_implementation_coverage": ["ocid", "contract_id", "buyer_id", "contract_status", "has_implementation"],
    "entity_benchmark": ["buyer_id", "process_count", "award_n", "award_value_total", "single_bidder_rate"],
    "metric_population": ["metric_id", "candidate_count", "eligible_count", "eligible_pct"],
    "dq_impact": ["metric_id", "dq_ref", "impact_type", "records_with_issue", "pct_of_candidate"],
}
_TYPES = {"number_of_tenderers": "bigint", "highest_stage_rank": "bigint", "release_count": "bigint"}


def presented(v, view: str) -> DataFrame:
    """The reporting projection of a view: named, labelled and typed columns."""
    df = getattr(v, view)
    typed = df.withColumns({c: F.col(c).cast(t) for c, t in _TYPES.items() if c in df.columns})
    keep = {c: "procurement_method" if c == _METHOD else c for c in PRESENTED[view]}
    return presentation(typed, keep, {_METHOD: METHOD_NOT_STATED})


TABLES = {
    "lifecycle": lifecycle_cells,
    "budget": budget_cells,
    "contracts": contract_cells,
    "suppliers": supplier_cells,
    "awards": award_facts,
    "budget_award": budget_award_facts,
    "timing": timing_facts,
}


def export_tables(v, root: str) -> str:
    """Every export table as Parquet, published as one set."""
    return replace_tables({name: build(v) for name, build in TABLES.items()}, root)
