"""Dimensions and latest-per-key tables built from staging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.functions import flags
from tenderlens.model import Staging
from tenderlens.operators.latest import latest_per_key
from tenderlens.rules import Rules


def build_dim_buyer(releases: DataFrame, r: Rules) -> DataFrame:
    """One row per buyer id; most frequent name, ties to the latest release.
    Two chained aggregates on the same leading key, no join."""
    per_name = releases.filter(F.col("buyer_id").isNotNull()).groupBy("buyer_id", "buyer_name").agg(
        F.count(F.lit(1)).alias("n"), F.max("release_seq").alias("latest")
    )
    named = F.when(F.col("buyer_name").isNotNull(), F.struct("n", "latest"))
    return per_name.groupBy("buyer_id").agg(
        F.max_by("buyer_name", named).alias("buyer_name_raw"),
        F.sum("n").alias("release_count"),
    ).select(
        "buyer_id",
        flags.standard_name(F.col("buyer_name_raw")).alias("buyer_name"),
        "buyer_name_raw",
        "release_count",
        flags.incomplete_flag(F.col("buyer_id"), r.bare_buyer_id).alias("buyer_id_flag"),
        flags.test_entity_flag(F.col("buyer_id"), r).alias("test_entity_flag"),
    )


def supplier_observations(parties: DataFrame, award_suppliers: DataFrame) -> DataFrame:
    from_parties = parties.filter(F.array_contains("roles", "supplier")).select(
        F.col("party_id").alias("supplier_id"),
        F.col("party_name_raw").alias("name_raw"),
        "release_seq",
        F.lit(True).alias("is_party"),
    )
    from_awards = award_suppliers.select(
        "supplier_id",
        F.col("supplier_name_raw").alias("name_raw"),
        "release_seq",
        F.lit(False).alias("is_party"),
    )
    return from_parties.unionByName(from_awards).withColumn("name", flags.strict_trim(F.col("name_raw")))


def build_dim_supplier(parties: DataFrame, award_suppliers: DataFrame, r: Rules) -> DataFrame:
    """Supplier ids seen as party or on an award. The modal *trimmed* name
    decides; the stored raw name is its latest published spelling."""
    obs = supplier_observations(parties, award_suppliers).filter(F.col("supplier_id").isNotNull())
    per_name = obs.groupBy("supplier_id", "name").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("release_seq").alias("latest"),
        F.max_by("name_raw", F.struct("release_seq", "name_raw")).alias("spelling"),
        F.bool_or("is_party").alias("as_party"),
        F.bool_or(~F.col("is_party")).alias("on_award"),
    )
    named = F.when(F.col("name").isNotNull(), F.struct("n", "latest", "name"))
    return per_name.groupBy("supplier_id").agg(
        F.max_by("spelling", named).alias("supplier_name_raw"),
        F.count("name").alias("name_variant_count"),
        F.bool_or("as_party").alias("in_supplier_parties"),
        F.bool_or("on_award").alias("in_award_suppliers"),
    ).select(
        "supplier_id",
        flags.standard_name(F.col("supplier_name_raw")).alias("supplier_name"),
        "supplier_name_raw",
        "name_variant_count",
        "in_supplier_parties",
        "in_award_suppliers",
        flags.incomplete_flag(F.col("supplier_id"), r.bare_supplier_id).alias("supplier_id_flag"),
    )


def build_budget_lines(planning: DataFrame) -> DataFrame:
    lines = planning.filter(F.col("budget_project_id").isNotNull()).drop("budget_id")
    return latest_per_key(lines, ["ocid", "budget_project_id"], ["release_seq"]).select(
        "ocid",
        "budget_project_id",
        "release_id",
        "release_seq",
        "buyer_id",
        "party_flag",
        "budget_amount",
        "budget_currency",
        "budget_description",
        "budget_project",
        "budget_amount_flag",
        "budget_monetary_flag",
    )


def release_facts(releases: DataFrame) -> DataFrame:
    """One aggregate per process: count, latest id and buyer, all tags seen.
    Distinct tag *combinations* are collected, a small set per process."""
    return releases.groupBy("ocid").agg(
        F.count(F.lit(1)).alias("release_count"),
        F.max_by("release_id", "release_seq").alias("latest_release_id"),
        F.max_by("buyer_id", "release_seq").alias("buyer_id"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tag")))).alias("tags_observed"),
    )


def pick_latest(section: DataFrame, prefix: str, identifier: str) -> DataFrame:
    """Latest release of each process that contains the section."""
    newest = F.max_by(F.struct("release_id", identifier), F.struct("release_seq", identifier))
    return section.groupBy("ocid").agg(newest.alias("_p")).select(
        "ocid",
        F.col("_p.release_id").alias(f"{prefix}_release_id"),
        F.col(f"_p.{identifier}").alias(identifier),
    )


def build_process_snapshot(stg: Staging, budget_lines: DataFrame) -> DataFrame:
    """One row per process; every input is first reduced to its ``ocid``, so the
    joins run on one row per process and share the partitioning."""
    per_process = release_facts(stg.releases).filter(F.size("tags_observed") > 0)
    lines = budget_lines.groupBy("ocid").agg(F.count(F.lit(1)).alias("_lines"))
    contracts = stg.contracts.select(
        "ocid", F.col("release_id").alias("award_release_id"), "award_id", "contract_id"
    )
    return (
        per_process.join(pick_latest(stg.tender, "tender", "tender_id"), "ocid", "left")
        .join(pick_latest(stg.awards, "award", "award_id"), "ocid", "left")
        .join(contracts, ["ocid", "award_release_id", "award_id"], "left")
        .join(lines, "ocid", "left")
        .select(
            "ocid",
            "release_count",
            "latest_release_id",
            "buyer_id",
            "tags_observed",
            "tender_release_id",
            "tender_id",
            "award_release_id",
            "award_id",
            "contract_id",
            F.coalesce("_lines", F.lit(0)).alias("budget_line_count"),
            flags.multi_project_flag(F.col("_lines")).alias("multi_project_flag"),
        )
    )


def without_test(df: DataFrame, dim_buyer: DataFrame, r: Rules) -> DataFrame:
    """Attach the buyer's name and flag; drop the test entity."""
    buyers = dim_buyer.filter(F.col("test_entity_flag").isNull()).select("buyer_id", "buyer_name", "buyer_id_flag")
    return df.filter(F.col("buyer_id") != r.test_buyer_id).join(buyers, "buyer_id")


def implementation_counts(stg: Staging) -> DataFrame:
    """Transactions and implementation milestones per contract, from their tables."""
    tx = stg.transactions.groupBy("contract_id").agg(F.count(F.lit(1)).alias("transaction_count"))
    ms = stg.milestones.filter("milestone_source = 'IMPLEMENTATION'").groupBy("contract_id").agg(
        F.count(F.lit(1)).alias("implementation_milestone_count")
    )
    return tx.join(ms, "contract_id", "full")


def build_process_sections(
    stg: Staging, snapshot: DataFrame, dim_buyer: DataFrame, r: Rules, implementation: DataFrame | None = None
) -> DataFrame:
    """One wide row per process of a real buyer: the fields of its latest tender, award and contract.
    ``implementation`` has the ``implementation_counts`` if they need not be counted from the staging tables.

    The joins that every view of these populations needs are made once, on keys
    that are unique on the staging side; the views are filters over this table.
    """
    tender = stg.tender.select(
        "ocid", F.col("release_id").alias("tender_release_id"), "procurement_method_details",
        F.col("status").alias("tender_status"), "number_of_tenderers", "tenderer_count_flag",
        "tender_start_date", "tender_end_date", "tender_start_date_flag", "tender_end_date_flag",
    )
    award = stg.awards.select(
        "ocid", "award_id", F.col("status").alias("award_status"), "award_value_amount", "award_value_currency",
        "award_value_flag", "award_monetary_flag", "award_date", "award_date_flag",
    )
    per_release = stg.awards.groupBy("ocid", F.col("release_id").alias("award_release_id")).agg(
        F.count(F.lit(1)).alias("awards_in_release")
    )
    contract = stg.contracts.select(
        "ocid", "contract_id", F.col("release_id").alias("contract_release_id"), F.col("status").alias("contract_status"),
        "has_implementation", "date_signed", "date_signed_flag",
    )
    counts = implementation if implementation is not None else implementation_counts(stg)
    base = without_test(
        snapshot.select("ocid", "buyer_id", "release_count", "tags_observed", "tender_release_id", "tender_id",
                        "award_release_id", "award_id", "contract_id"), dim_buyer, r)
    return (
        base.join(tender, ["ocid", "tender_release_id"], "left")
        .join(award, ["ocid", "award_id"], "left")
        .join(per_release, ["ocid", "award_release_id"], "left")
        .join(contract, ["ocid", "contract_id"], "left")
        .join(counts, "contract_id", "left")
        .fillna({"transaction_count": 0, "implementation_milestone_count": 0})
    )
