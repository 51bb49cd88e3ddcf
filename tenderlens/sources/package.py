"""Nested release documents to the nine flat staging tables.

Every flatten is narrow (select / explode), reads only the nested fields it
needs (nested column pruning), and carries the release's ``ocid`` and
``release_seq`` so that no later step has to join a section to its release.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlens.functions import flags
from tenderlens.model import (
    MONEY,
    PACKAGE_SCHEMA,
    RELEASE_FIELDS,
    RELEASE_SCHEMA,
    RELEASE_STRUCT,
    Staging,
)
from tenderlens.rules import Rules
from tenderlens.sources import splits


def read_package(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """JSON package objects, one per file. A package is a single read task, so
    the releases are spread right after the explode; ``read_package_split`` reads a large one by many."""
    releases = (
        spark.read.schema(PACKAGE_SCHEMA)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .json(path)
        .select(F.inline("releases"))
    )
    return releases.repartition(partitions) if partitions else releases.repartition("id")


# Files up to this size are parsed whole by one task; a gzip file holds some twenty times its size.
WHOLE_BYTES, WHOLE_GZIP_BYTES = 16 << 20, 1 << 20


def _is_gzip(file: Column | str) -> Column:
    return F.endswith(file, F.lit(".gz"))


def _is_small(spark: SparkSession) -> Column:
    """Whether one task reads the file anyway and can hold its text and its releases."""
    share = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    most = F.when(_is_gzip("_metadata.file_name"), min(WHOLE_GZIP_BYTES, share)).otherwise(min(WHOLE_BYTES, share))
    return F.col("_metadata.file_size") <= most


def _not_whole() -> Column:
    return F.raise_error(F.lit("a package was not read whole, or its brackets do not close"))


def _whole_packages(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The releases of the small packages, each parsed where it is read: no text is moved."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path, wholetext=True)
    files = files.filter(_is_small(spark)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    files = files.withColumn("outside", F.regexp_replace(F.regexp_replace("value", r"(?s)\\.", ""), '"[^"]*"', ""))

    def but(mark: str) -> Column:
        return F.length(F.replace("outside", F.lit(mark), F.lit("")))

    read = _is_gzip("file") | (F.octet_length("value") == F.col("bytes"))  # a gzip file has a checksum of its own
    whole = read & (but("{") == but("}")) & (but("[") == but("]"))
    text = F.when(whole, F.ltrim("value", F.lit("\ufeff"))).otherwise(_not_whole())
    parsed = F.from_json(text, f"struct<releases:array<{RELEASE_STRUCT}>>", {"mode": "FAILFAST"})
    return files.select(parsed.alias("package")).select(F.inline("package.releases"))


def _packages_in_pieces(spark: SparkSession, path: str, pattern: str, of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The text of every object in an array of a package's root, and one row per file with what was read of it.

    A file is read by many tasks as the pieces between opening braces. Whether a
    piece begins inside a string follows from the quotes in front of it, and with that how
    deep it is nested; both are sums over the file, taken inside the blocks first.
    """
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # without escaped characters every quote is a real one
    pieces = splits.records(spark, path, pattern, "{", of).withColumn("plain", plain).withColumn("cut", F.split("plain", '"', -1))

    def count(text: Column, mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    # Outside strings is every other part: from the first if the piece begins outside, else from the second.
    outside = [F.array_join(F.filter("cut", every), "") for every in (lambda _, i: i % 2 == 0, lambda _, i: i % 2 == 1)]
    closed = F.array(*[count(x, "}") for x in outside])
    listed = F.array(*[count(x, "[") - count(x, "]") for x in outside])
    named = F.regexp_extract("value", r'"([^"\\]*)"\s*:\s*\[[^\[\]{}"]*$', 1)
    pieces = pieces.select(
        "file", "bytes", "block", "nth", "value", "length", (F.size("cut") - 1).alias("quotes"), closed.alias("closed"),
        listed.alias("listed"), F.nullif(named, F.lit("")).alias("name"),
    )
    w = splits.in_block()
    pieces = pieces.withColumn("i", F.row_number().over(w)).withColumn("turn", splits.sum_in_front("quotes", w) % 2)
    first = (F.col("block") == 0) & (F.col("i") == 1)

    def nested(parity: Column) -> tuple[Column, Column]:
        """Change of the depth in braces and in brackets, if the block begins outside (0) or inside (1) a string."""
        inside = ((F.col("turn") + parity) % 2).cast("int")
        opened = F.when(first | (inside == 1), 0).otherwise(1)
        return opened - F.get("closed", inside), F.get("listed", inside)

    sums = [F.sum(c).alias(f"{kind}{k}") for k in (0, 1) for kind, c in zip(("braces", "brackets"), nested(F.lit(k)))]
    blocks = pieces.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"), F.max("bytes").alias("bytes"), F.sum("quotes").alias("quotes"), *sums)
    over = splits.over_blocks()
    blocks = blocks.withColumn("parity", (splits.sum_in_front("quotes", over) % 2).cast("int"))
    for kind in ("braces", "brackets"):
        blocks = blocks.withColumn(kind, F.when(F.col("parity") == 0, F.col(f"{kind}0")).otherwise(F.col(f"{kind}1")))
    blocks = blocks.withColumns({f"{kind}_before": splits.sum_in_front(kind, over) for kind in ("braces", "brackets")})
    read = blocks.groupBy("file").agg(
        (F.sum("n") - 1 + F.sum("length")).alias("read"), F.max("bytes").alias("bytes"), F.sum("braces").alias("braces"),
        F.sum("brackets").alias("brackets"))

    braces, brackets = nested(F.col("parity"))
    placed = pieces.join(blocks.select("file", "block", "parity", "braces_before", "brackets_before"), ["file", "block"])
    placed = placed.withColumns({"braces": braces, "brackets": brackets, "inside": (F.col("turn") + F.col("parity")) % 2})
    placed = placed.withColumns({
        "braces_before": F.col("braces_before") + splits.sum_in_front("braces", w),
        "brackets_before": F.col("brackets_before") + splits.sum_in_front("brackets", w),
    })
    in_root_array = (F.col("braces_before") + F.col("braces") == 1) & (F.col("brackets_before") + F.col("brackets") == 1)
    starts = (F.col("inside") == 0) & ~first & (F.col("braces_before") == 1) & (F.col("brackets_before") == 1)
    here = F.struct("block", "i")
    placed = placed.withColumns({"array": F.when(in_root_array, F.col("name")), "start": F.when(starts, here)})
    tails = placed.groupBy("file", "block").agg(
        F.max_by("array", F.when(F.col("array").isNotNull(), F.col("i"))).alias("array"), F.max("start").alias("start"))
    carried = tails.select(
        "file", "block", splits.last_in_front("array", over).alias("array_before"), splits.last_in_front("start", over).alias("start_before"))
    placed = placed.join(carried, ["file", "block"]).withColumns({
        "array": F.coalesce(splits.last_in_front("array", w), F.col("array_before")),
        "object": F.coalesce(F.last("start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("start_before")),
    })
    # What follows the last brace of an object is no part of its value; the parser stops there.
    ordered = F.array_sort(F.collect_list(F.struct("block", "i", "value")))
    objects = placed.filter("object IS NOT NULL").groupBy("file", "object").agg(
        F.max(F.when(F.col("start").isNotNull(), F.col("array"))).alias("array"),
        F.concat(F.lit("{"), F.array_join(F.transform(ordered, lambda x: x["value"]), "{")).alias("text"))
    return objects, read


def read_package_split(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The releases of JSON package objects, one per file, a large package read by many tasks.

    Equal to ``read_package`` whatever the layout of the text and wherever Spark cuts the
    files. It stops if a byte of a file was not read or its brackets do not close. Only the text of a
    package that is larger than a task reads and holds is moved. Files may be in gzip (each is one task then).
    """
    objects, read = _packages_in_pieces(spark, path, pattern, ~_is_small(spark))
    unread = ~F.col("read").isin(F.col("bytes"), F.col("bytes") - 3) & ~_is_gzip("file")
    broken = read.filter(unread | (F.col("braces") != 0) | (F.col("brackets") != 0))
    whole = F.when(broken.agg(F.count(F.lit(1))).scalar() == 0, F.lit(True)).otherwise(_not_whole().cast("boolean"))
    text = objects.filter(F.col("array") == "releases").filter(whole)
    split = text.select(F.from_json("text", RELEASE_STRUCT, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return _whole_packages(spark, path, pattern).unionByName(split)


def write_packages(rows: DataFrame, path: str, published: str | Column, per_package: int = 2000,
                   document: Callable[[DataFrame, list[str]], DataFrame] | None = None) -> None:
    """Release packages of about ``per_package`` releases each, one gzip JSON file per package.

    ``rows`` are the releases, or what ``document`` makes them from; it keeps the named columns beside them.
    The rows are dealt to the packages and sorted, so the documents and their text are made on the way
    to the file, one at a time, and are neither shuffled nor gathered in a list.
    """
    files = max(1, -(-rows.count() // per_package))
    of_package = Window.partitionBy("file").orderBy("file")
    dealt = rows.select("*", F.pmod(F.xxhash64(*rows.columns), F.lit(files)).alias("file"))
    if (tasks := files // 50) > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        dealt = dealt.repartition(tasks, "file")  # so that a task sorts in memory, however many rows there are
    dealt = dealt.select(
        "*", F.row_number().over(of_package).alias("nth"), F.lead("file").over(of_package).isNull().alias("is_last"))
    # In the order of the files, as the writer asks for it, else it would sort the texts.
    dealt = dealt.sortWithinPartitions("file", "nth")
    releases = document(dealt, ["file", "nth", "is_last"]) if document else dealt
    head = F.to_json(F.struct(
        F.lit("urn:package").alias("uri"), F.lit("1.1").alias("version"),
        (F.lit(published) if isinstance(published, str) else published).alias("publishedDate"),
    ))
    opening = F.concat(F.rtrim(head, F.lit("}")), F.lit(',"releases":['))
    text = F.concat(
        F.when(F.col("nth") == 1, opening).otherwise(","), F.to_json(F.struct(*RELEASE_FIELDS)),
        F.when(F.col("is_last"), "]}").otherwise(""))
    releases.select("file", text.alias("value")).write.partitionBy("file").option("compression", "gzip").text(path)


def published_dates(spark: SparkSession, path: str) -> DataFrame:
    """(published): the distinct package dates below ``path``; the releases are not parsed."""
    return spark.read.schema("publishedDate string").option("multiLine", True).json(path).select(
        F.col("publishedDate").alias("published")
    ).distinct()


def read_release_lines(spark: SparkSession, path: str) -> DataFrame:
    """Releases as JSON lines: splittable, the form to use at scale."""
    return spark.read.schema(RELEASE_SCHEMA).option("mode", "FAILFAST").json(path)


def _empty(array: Column) -> Column:
    return F.size(F.coalesce(array, F.array())) == 0


def _lineage(*extra: str) -> list[Column]:
    return [
        F.col("id").alias("release_id"),
        F.col("ocid"),
        flags.sequence_key(F.col("id")).alias("release_seq"),
        *[F.col(c) for c in extra],
    ]


def _day(path: str, name: str) -> Column:
    return flags.strict_date(F.col(path), path).alias(name)


def flatten_releases(releases: DataFrame) -> DataFrame:
    no_tags = F.array().cast("array<string>")
    return releases.select(
        *_lineage(),
        F.to_timestamp(F.nullif("date", F.lit(""))).alias("release_date"),
        F.coalesce("tag", no_tags).alias("tag"),
        F.col("initiationType").alias("initiation_type"),
        "language",
        F.col("buyer.id").alias("buyer_id"),
        F.col("buyer.name").alias("buyer_name"),
        F.when(_empty(F.col("parties")), "NO_PARTIES").alias("party_flag"),
    )


def flatten_planning(releases: DataFrame, r: Rules) -> DataFrame:
    b = "planning.budget."
    return releases.select(
        *_lineage(),
        F.col("buyer.id").alias("buyer_id"),
        F.when(_empty(F.col("parties")), "NO_PARTIES").alias("party_flag"),
        F.col(b + "id").alias("budget_id"),
        F.col(b + "projectID").alias("budget_project_id"),
        F.col(b + "amount.amount").alias("budget_amount"),
        F.col(b + "amount.currency").alias("budget_currency"),
        F.col(b + "description").alias("budget_description"),
        F.col(b + "project").alias("budget_project"),
    ).withColumns(
        {
            "budget_amount_flag": flags.extreme_flag(F.col("budget_amount"), r.extreme_budget),
            "budget_monetary_flag": flags.zero_flag(F.col("budget_amount")),
        }
    )


def flatten_tender(releases: DataFrame, r: Rules) -> DataFrame:
    t = "tender."
    return (
        releases.filter(F.col("tender").isNotNull())
        .select(
            *_lineage(),
            F.col(t + "id").alias("tender_id"),
            F.col(t + "title").alias("title"),
            F.col(t + "description").alias("description"),
            F.col(t + "status").alias("status"),
            F.col(t + "procurementMethod").alias("procurement_method"),
            F.col(t + "procurementMethodDetails").alias("procurement_method_details"),
            F.col(t + "procurementMethodRationale").alias("procurement_method_rationale"),
            F.col(t + "numberOfTenderers").alias("number_of_tenderers"),
            F.col(t + "value.amount").alias("tender_value_amount"),
            F.col(t + "value.currency").alias("tender_value_currency"),
            _day(t + "tenderPeriod.startDate", "tender_start_date"),
            _day(t + "tenderPeriod.endDate", "tender_end_date"),
            F.col(t + "awardCriteria").alias("award_criteria"),
            F.col(t + "awardCriteriaDetails").alias("award_criteria_details"),
            F.col(t + "hasEnquiries").alias("has_enquiries"),
            F.col(t + "submissionMethod").alias("submission_method"),
            F.col(t + "submissionMethodDetails").alias("submission_method_details"),
        )
        .withColumns(
            {
                "tenderer_count_flag": flags.count_class(F.col("number_of_tenderers"), r),
                "tender_value_monetary_flag": flags.zero_flag(F.col("tender_value_amount")),
                "tender_start_date_flag": flags.date_flag(F.col("tender_start_date"), r),
                "tender_end_date_flag": flags.date_flag(F.col("tender_end_date"), r),
            }
        )
    )


def _elements(releases: DataFrame, field: str, name: str) -> DataFrame:
    """One row per element of the list; documents made for one element have it in the list's place."""
    listed = isinstance(releases.schema[field].dataType, T.ArrayType)
    return releases.select(*_lineage(), (F.explode(field) if listed else F.col(field)).alias(name))


def _awards(releases: DataFrame) -> DataFrame:
    return _elements(releases, "awards", "a")


def flatten_awards(releases: DataFrame, r: Rules) -> DataFrame:
    return (
        _awards(releases)
        .select(
            F.col("a.id").alias("award_id"),
            "release_id",
            "ocid",
            "release_seq",
            F.col("a.title").alias("title"),
            F.col("a.description").alias("description"),
            F.col("a.status").alias("status"),
            _day("a.date", "award_date"),
            F.col("a.value.amount").alias("award_value_amount"),
            F.col("a.value.currency").alias("award_value_currency"),
        )
        .withColumns(
            {
                "award_value_flag": flags.extreme_flag(F.col("award_value_amount"), r.extreme_award),
                "award_monetary_flag": flags.zero_flag(F.col("award_value_amount")),
                "award_date_flag": flags.date_flag(F.col("award_date"), r),
            }
        )
    )


def flatten_award_suppliers(releases: DataFrame) -> DataFrame:
    return (
        _awards(releases)
        .select("a.id", "ocid", "release_seq", F.posexplode("a.suppliers").alias("pos", "s"))
        .select(
            F.col("id").alias("award_id"),
            "ocid",
            "release_seq",
            (F.col("pos") + 1).alias("supplier_seq"),
            F.col("s.id").alias("supplier_id"),
            flags.standard_name(F.col("s.name")).alias("supplier_name"),
            F.col("s.name").alias("supplier_name_raw"),
        )
    )


def _contracts(releases: DataFrame) -> DataFrame:
    return _elements(releases, "contracts", "c")


def flatten_contracts(releases: DataFrame, r: Rules) -> DataFrame:
    tx, ms = F.col("c.implementation.transactions"), F.col("c.implementation.milestones")
    return (
        _contracts(releases)
        .select(
            F.col("c.id").alias("contract_id"),
            "release_id",
            "ocid",
            "release_seq",
            F.col("c.awardID").alias("award_id"),
            F.col("c.title").alias("title"),
            F.col("c.description").alias("description"),
            F.col("c.status").alias("status"),
            F.col("c.value.amount").alias("contract_value_amount"),
            F.col("c.value.currency").alias("contract_value_currency"),
            _day("c.dateSigned", "date_signed"),
            _day("c.period.startDate", "period_start_date"),
            _day("c.period.endDate", "period_end_date"),
            (~_empty(tx) | ~_empty(ms)).alias("has_implementation"),
        )
        .withColumns(
            {
                "contract_monetary_flag": flags.zero_flag(F.col("contract_value_amount")),
                "date_signed_flag": flags.date_flag(F.col("date_signed"), r),
                "period_start_date_flag": flags.date_flag(F.col("period_start_date"), r),
                "period_end_date_flag": flags.date_flag(F.col("period_end_date"), r),
            }
        )
    )


def flatten_transactions(releases: DataFrame) -> DataFrame:
    return (
        _contracts(releases)
        .select(F.col("c.id").alias("contract_id"), F.explode("c.implementation.transactions").alias("x"))
        .select(
            "contract_id",
            F.col("x.id").alias("transaction_id"),
            F.col("x.value.amount").alias("transaction_value"),
            F.col("x.value.currency").alias("transaction_currency"),
            F.col("x.payer.id").alias("payer_id"),
            F.col("x.payer.name").alias("payer_name"),
            F.col("x.payee.id").alias("payee_id"),
            F.col("x.payee.name").alias("payee_name"),
            flags.zero_flag(F.col("x.value.amount")).alias("transaction_monetary_flag"),
        )
    )


def flatten_milestones(releases: DataFrame, r: Rules) -> DataFrame:
    """Both origins in one pass: each contract yields (source, milestones) pairs."""
    contracts = _contracts(releases).select(
        F.col("c.id").alias("contract_id"),
        F.explode(
            F.array(
                F.struct(F.lit("CONTRACT").alias("source"), F.col("c.milestones").alias("items")),
                F.struct(
                    F.lit("IMPLEMENTATION").alias("source"),
                    F.col("c.implementation.milestones").alias("items"),
                ),
            )
        ).alias("o"),
    )
    return (
        contracts.select(
            "contract_id", F.col("o.source").alias("milestone_source"), F.explode("o.items").alias("m")
        )
        .select(
            "contract_id",
            "milestone_source",
            F.col("m.id").alias("milestone_id"),
            F.col("m.title").alias("title"),
            F.col("m.description").alias("description"),
            F.col("m.code").alias("code"),
            _day("m.dueDate", "due_date"),
            _day("m.dateMet", "date_met"),
            F.col("m.status").alias("status"),
        )
        .withColumns(
            {
                "due_date_flag": flags.date_flag(F.col("due_date"), r),
                "date_met_flag": flags.date_flag(F.col("date_met"), r),
            }
        )
    )


def implementation_counts(releases: DataFrame) -> DataFrame:
    """(contract_id, transaction_count, implementation_milestone_count) of all contracts that report any:
    the rows of ``flatten_transactions`` and of the implementation in ``flatten_milestones``, never made."""
    def n(items):
        return F.size(F.coalesce(F.col(f"c.implementation.{items}"), F.array())).cast("bigint")

    counted = _contracts(releases).select(
        F.col("c.id").alias("contract_id"), n("transactions").alias("transaction_count"),
        n("milestones").alias("implementation_milestone_count"))
    return counted.filter(F.col("transaction_count") + F.col("implementation_milestone_count") > 0).groupBy("contract_id").agg(
        *[F.sum(c).alias(c) for c in counted.columns[1:]])


def flatten_parties(releases: DataFrame, r: Rules) -> DataFrame:
    p = releases.select(*_lineage(), F.explode("parties").alias("p"))
    no_roles = F.array().cast("array<string>")
    return p.select(
        "release_id",
        "ocid",
        "release_seq",
        F.col("p.id").alias("party_id"),
        flags.standard_name(F.col("p.name")).alias("party_name"),
        F.col("p.name").alias("party_name_raw"),
        F.col("p.identifier.scheme").alias("identifier_scheme"),
        F.col("p.identifier.id").alias("identifier_id"),
        F.coalesce("p.roles", no_roles).alias("roles"),
    ).withColumn(
        "supplier_id_flag",
        F.when(
            F.array_contains("roles", "supplier"),
            flags.incomplete_flag(F.col("party_id"), r.bare_supplier_id),
        ),
    )


# What each flatten of an exploded list reads inside it; has_implementation needs no more of its lists than their ids.
READS = {
    "awards": [f"awards.{x}" for x in ("id", "title", "description", "status", "date", "value")],
    "award_suppliers": ["awards.id", "awards.suppliers"],
    "contracts": [f"contracts.{x}" for x in (
        "id", "awardID", "title", "description", "status", "value", "dateSigned", "period",
        "implementation.transactions.id", "implementation.milestones.id")],
    "transactions": ["contracts.id", "contracts.implementation.transactions"],
    "milestones": ["contracts.id", "contracts.milestones", "contracts.implementation.milestones"],
}


COUNTED = ["contracts.id", "contracts.implementation.transactions.id", "contracts.implementation.milestones.id"]


def flatten(releases: DataFrame, r: Rules, narrow: Callable[[list[str]], DataFrame] | None = None) -> Staging:
    """The nine tables. Where the documents are made when they are read, ``narrow`` gives those that have a
    tender, an award or a contract, with only these paths and without a list around it."""
    of = {name: narrow(paths) if narrow else releases for name, paths in {"tender": ["tender"], **READS}.items()}
    return Staging(
        releases=flatten_releases(releases),
        planning=flatten_planning(releases, r),
        tender=flatten_tender(of["tender"], r),
        awards=flatten_awards(of["awards"], r),
        award_suppliers=flatten_award_suppliers(of["award_suppliers"]),
        contracts=flatten_contracts(of["contracts"], r),
        transactions=flatten_transactions(of["transactions"]),
        milestones=flatten_milestones(of["milestones"], r),
        parties=flatten_parties(releases, r),
    )


# ------------------------------------------------------------------
# Independent profile of the nested documents (no explode)
# ------------------------------------------------------------------
def source_totals(releases: DataFrame, r: Rules) -> DataFrame:
    """One wide row: counts, money totals, non-null dates and flag counts taken from the
    documents with higher-order functions: a different path from the explodes."""
    total = {}

    def n(name, c):
        total[name] = F.sum(c.cast("bigint")).cast("string")

    def money(name, amounts):
        total[name] = F.sum(
            F.aggregate(
                amounts,
                F.lit(0).cast("decimal(30,4)"),
                lambda acc, x: (acc + F.coalesce(x, F.lit(0).cast(MONEY))).cast("decimal(30,4)"),
            )
        ).cast("decimal(38,4)").cast("string")

    def count_if(arr, pred):
        return F.size(F.filter(arr, pred))

    awards = F.coalesce("awards", F.array().cast(RELEASE_FIELDS["awards"]))
    contracts = F.coalesce("contracts", F.array().cast(RELEASE_FIELDS["contracts"]))
    parties = F.coalesce("parties", F.array().cast(RELEASE_FIELDS["parties"]))
    suppliers = F.flatten(F.transform(awards, lambda a: F.coalesce(a["suppliers"], F.array().cast("array<struct<id:string,name:string>>"))))
    tx = F.flatten(F.filter(F.transform(contracts, lambda c: c["implementation"]["transactions"]), lambda x: x.isNotNull()))
    ms_c = F.flatten(F.filter(F.transform(contracts, lambda c: c["milestones"]), lambda x: x.isNotNull()))
    ms_i = F.flatten(F.filter(F.transform(contracts, lambda c: c["implementation"]["milestones"]), lambda x: x.isNotNull()))
    ms = F.concat(ms_c, ms_i)
    budget = F.col("planning.budget.amount.amount")
    tender = F.col("tender")

    n("count.releases", F.lit(1))
    n("count.planning", F.lit(1))
    n("count.tender", tender.isNotNull())
    n("count.awards", F.size(awards))
    n("count.award_suppliers", F.size(suppliers))
    n("count.contracts", F.size(contracts))
    n("count.transactions", F.size(tx))
    n("count.milestones", F.size(ms))
    n("count.parties", F.size(parties))
    n("count.contracts_with_implementation", count_if(
        contracts,
        lambda c: (F.size(F.coalesce(c["implementation"]["transactions"], F.array())) > 0)
        | (F.size(F.coalesce(c["implementation"]["milestones"], F.array())) > 0)))

    money("money.budget", F.array(budget))
    money("money.tender_value", F.array(F.col("tender.value.amount")))
    money("money.award", F.transform(awards, lambda a: a["value"]["amount"]))
    money("money.contract", F.transform(contracts, lambda c: c["value"]["amount"]))
    money("money.transaction", F.transform(tx, lambda x: x["value"]["amount"]))

    date_arrays = {
        "tender_start_date": F.array(F.col("tender.tenderPeriod.startDate")),
        "tender_end_date": F.array(F.col("tender.tenderPeriod.endDate")),
        "award_date": F.transform(awards, lambda a: a["date"]),
        "date_signed": F.transform(contracts, lambda c: c["dateSigned"]),
        "period_start_date": F.transform(contracts, lambda c: c["period"]["startDate"]),
        "period_end_date": F.transform(contracts, lambda c: c["period"]["endDate"]),
        "due_date": F.transform(ms, lambda m: m["dueDate"]),
        "date_met": F.transform(ms, lambda m: m["dateMet"]),
    }
    lo, fut, imp = r.placeholder_date, r.future_from, r.impossible_from
    for name, arr in date_arrays.items():
        day = F.transform(arr, lambda x: F.substring(x, 1, 10))
        n(f"date.{name}", count_if(day, lambda x: F.coalesce(x != "", F.lit(False))))
        n(f"flag.{name}.PLACEHOLDER", count_if(day, lambda x: F.coalesce(x == lo, F.lit(False))))
        n(f"flag.{name}.FUTURE", count_if(day, lambda x: F.coalesce((x >= fut) & (x < imp), F.lit(False))))
        n(f"flag.{name}.IMPOSSIBLE", count_if(day, lambda x: F.coalesce(x >= imp, F.lit(False))))
        n(f"flag.{name}.VALID", count_if(day, lambda x: F.coalesce((x != "") & (x != lo) & (x < fut), F.lit(False))))

    def amount_is(arr, pred):
        return count_if(arr, lambda x: F.coalesce(pred(x), F.lit(False)))

    award_amounts = F.transform(awards, lambda a: a["value"]["amount"])
    n("flag.budget.ZERO_VALUE", F.coalesce(budget == 0, F.lit(False)))
    n("flag.budget.EXTREME", F.coalesce(budget >= F.lit(r.extreme_budget), F.lit(False)))
    n("flag.tender_value.ZERO_VALUE", F.coalesce(F.col("tender.value.amount") == 0, F.lit(False)))
    n("flag.award.ZERO_VALUE", amount_is(award_amounts, lambda x: x == 0))
    n("flag.award.EXTREME", amount_is(award_amounts, lambda x: x >= F.lit(r.extreme_award)))
    n("flag.contract.ZERO_VALUE", amount_is(F.transform(contracts, lambda c: c["value"]["amount"]), lambda x: x == 0))
    n("flag.transaction.ZERO_VALUE", amount_is(F.transform(tx, lambda x: x["value"]["amount"]), lambda x: x == 0))
    tenderers = F.col("tender.numberOfTenderers")
    n("flag.tenderers.NORMAL", F.coalesce(tenderers <= r.normal_max, F.lit(False)))
    n("flag.tenderers.ELEVATED", F.coalesce((tenderers > r.normal_max) & (tenderers <= r.elevated_max), F.lit(False)))
    n("flag.tenderers.ANOMALOUS", F.coalesce(tenderers > r.elevated_max, F.lit(False)))
    n("flag.party.NO_PARTIES", F.size(parties) == 0)
    n("flag.party.INCOMPLETE", count_if(
        parties,
        lambda p: F.coalesce(F.array_contains(p["roles"], "supplier") & (p["id"] == r.bare_supplier_id), F.lit(False))))
    # The distinct count is its own aggregate: next to the sums it would make
    # Spark shuffle one wide partial row per process.
    processes = releases.select("ocid").distinct().agg(F.count(F.lit(1)).cast("string")).scalar()
    wide = releases.agg(*[c.alias(k.replace(".", "__")) for k, c in total.items()])
    return wide.withColumn("count__processes", processes)


def source_profile(releases: DataFrame, r: Rules) -> DataFrame:
    """``source_totals`` as (item, source_value) rows."""
    wide = source_totals(releases, r)
    return wide.unpivot([], list(wide.columns), "item", "source_value").select(
        F.regexp_replace("item", "__", ".").alias("item"), "source_value"
    )
