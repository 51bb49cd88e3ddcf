"""Release documents derived from order / line-item tables.

One release per order, many releases per customer (= process), so the whole
pipeline runs on any TPC-H-shaped data. Everything an order's document needs
from its lines is one hash aggregate of fixed width (no collect_list): a hot
order is reduced on the map side before the shuffle.
"""

from __future__ import annotations

from collections.abc import Collection
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.model import MILESTONES, MONEY, RELEASE_FIELDS, TRANSACTIONS
from tenderlens.rules import Rules

ORDER_RULES = Rules(
    bare_buyer_id="B-",
    bare_supplier_id="S-",
    test_buyer_id="B-7",
    buyer_code_prefix="^B-",
    currency="USD",
    extreme_budget=Decimal("495000"),
    extreme_award=Decimal("600000"),
    normal_max=8,
    elevated_max=11,
    placeholder_date="1990-01-01",
    future_from="2001-01-01",
    impossible_from="2001-10-01",
    study_future_year=2000,
    study_impossible_year=2001,
    profile_extreme_value=Decimal("400000"),
    ratio_low=Decimal("5"),
    ratio_high=Decimal("20"),
    sibling_factor=10,
    huge_ratio=20,
    unit=1e3,
    unit_label="k",
)

_LINE_PRICE = "decimal(18,4)"


def _iso(day: Column) -> Column:
    return F.concat(day.cast("string"), F.lit("T00:00:00Z"))


def _money(amount: Column) -> Column:
    return F.struct(amount.cast(MONEY).alias("amount"), F.lit("USD").alias("currency"))


def _milestone(mid: Column, due: Column, status: str | None) -> Column:
    nil = F.lit(None).cast("string")
    return F.struct(
        mid.alias("id"),
        nil.alias("title"),
        nil.alias("description"),
        nil.alias("code"),
        due.alias("dueDate"),
        due.alias("dateMet"),
        F.lit(status).cast("string").alias("status"),
    )


def _kept(first: tuple[Column, Column], second: tuple[Column, Column], kind: str) -> Column:
    """Array of those of two (condition, element) pairs whose condition holds, in order.

    Branches, as a filter over the array would take the whole stage out of generated code."""
    (a, x), (b, y) = first, second
    return F.when(a & b, F.array(x, y)).when(a, F.array(x)).when(b, F.array(y)).otherwise(F.array().cast(kind))


_SUPPLIER_DIGITS = Decimal(10) ** 15
# A sum is kept as billions and the rest; a lead code of a price and a supplier below these fits a long.
_BILLION, _LEAD_UNITS = 10**9, 9 * 10**9


def _units(price: Column) -> Column:
    """The price as decimal(18,4), in whole ten-thousandths. A double near a whole number of them
    becomes that number in the decimal cast too; the others are cast."""
    scaled = price * 10000
    near = (F.abs(price) < 1e10) & (F.abs(scaled - F.rint(scaled)) < 0.25)
    return F.when(near, F.rint(scaled).cast("bigint")).otherwise((price.cast(_LINE_PRICE) * 10000).cast("bigint"))


def _total(name: str, where: Column | None = None) -> list[Column]:
    """An exact sum as two longs, which a hash aggregate updates in place; decimals are objects made anew for every line."""
    return [F.sum(part if where is None else F.when(where, part)).alias(f"{name}_{kind}")
            for kind, part in (("billions", F.expr(f"units div {_BILLION}")), ("rest", F.col("units") % _BILLION))]


def _summed(name: str) -> Column:
    billions, rest = (F.col(f"{name}_{kind}").cast("decimal(19,0)") for kind in ("billions", "rest"))
    units = (billions * F.lit(_BILLION).cast("decimal(10,0)") + rest).cast("decimal(33,0)")
    return (units * F.lit(Decimal("0.0001"))).cast("decimal(28,4)")


def _lead_codes() -> list[Column]:
    """(price, supplier, status) packed into one ordered number: a long where it fits, else a decimal.
    A fixed-width buffer keeps the aggregate hash-based; a struct would force it to sort."""
    rest = F.col("l_suppkey") * 1000 + F.ascii("l_linestatus")
    units = F.col("units")
    fits = units.between(0, _LEAD_UNITS - 1) & rest.between(0, _BILLION - 1)
    wide = units.cast("decimal(18,0)") * F.lit(_SUPPLIER_DIGITS).cast("decimal(16,0)") + rest.cast("decimal(18,0)")
    return [F.max(F.when(fits, units * _BILLION + rest)).alias("lead_code"),
            F.max(F.when(~fits, wide.cast("decimal(38,0)"))).alias("wide_lead_code")]


def _lead() -> tuple[Column, Column]:
    code, wide, digits = F.col("lead_code"), F.col("wide_lead_code"), F.lit(_SUPPLIER_DIGITS).cast("decimal(16,0)")
    units = F.expr(f"lead_code div {_BILLION}").cast("decimal(18,0)")
    whole = F.greatest(wide, (units * digits + (code % _BILLION).cast("decimal(18,0)")).cast("decimal(38,0)"))
    rest = F.when(wide.isNull(), code % _BILLION).otherwise((whole % digits).cast("bigint"))
    return F.floor(rest / 1000).cast("bigint"), F.chr(rest % 1000)


def line_facts(lineitem: DataFrame) -> DataFrame:
    li = lineitem.select(
        "l_orderkey",
        "l_suppkey",
        _units(F.col("l_extendedprice")).alias("units"),
        "l_returnflag",
        "l_linestatus",
        F.to_date("l_shipdate").alias("ship"),
    )

    def part(flag, status):
        return (F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status)

    per_part, facts = [], ["l_orderkey", "n_lines", _summed("line_value").alias("line_value"), "first_ship", "last_ship"]
    for s in ("F", "O"):
        per_part += [
            *_total(f"r_{s}", part("R", s)),
            F.min(F.when(part("A", s), F.col("ship"))).alias(f"a_{s}"),
            F.max(F.when(part("N", s), F.lit(1))).alias(f"n_{s}"),
        ]
        facts += [_summed(f"r_{s}").alias(f"r_{s}"), f"a_{s}", f"n_{s}"]
    lead_supplier, lead_status = _lead()
    return li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        *_total("line_value"),
        F.min("ship").alias("first_ship"),
        F.max("ship").alias("last_ship"),
        *_lead_codes(),
        *per_part,
    ).select(*facts, lead_supplier.alias("lead_supplier"), lead_status.alias("lead_status"))


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat row per order: the order, the facts of its lines and its buyer.

    Buyers are joined to the narrow orders before the lines are, so the wide rows
    are not shuffled again.
    """

    def table(name):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    buyers = (
        table("customer")
        .join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select("c_custkey", "c_nationkey", "n_name")
    )
    orders = table("orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left").drop("c_custkey")
    return orders.join(line_facts(table("lineitem")), F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


def order_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested releases with exactly the schema of the package reader."""
    return order_documents(order_rows(spark, sf_dir))


def order_documents(d: DataFrame, reads: Collection[str] | None = None, keep: Collection[str] = ()) -> DataFrame:
    """The release of each order row. Every leaf has its type, so no cast of a whole
    section stands between a document and who reads one field of it.

    ``reads`` names the paths inside one of tender, ``awards`` and ``contracts`` that are read. Then only the
    releases that have this section come, with the section itself, or the one element of its list, in its place:
    a list or a condition around it would be made whole for whoever reads one field. The columns in ``keep`` stay beside it.
    """
    k = F.col("o_orderkey")
    section = next(iter(reads)).split(".")[0] if reads else None

    def is_read(path):
        return reads is None or any(x == path or x.startswith(f"{path}.") or path.startswith(f"{x}.") for x in reads)

    def struct(path, **made):
        return F.struct(*[c.alias(n) for n, c in made.items() if is_read(f"{path}.{n}")])

    def listed(path, first, second, whole):
        """Both elements with all fields, or with their id where nothing else of them is read."""
        if is_read(f"{path}.status") or is_read(f"{path}.value"):
            return _kept(first, second, whole)
        (a, x), (b, y) = first, second
        return _kept((a, F.struct(x["id"].alias("id"))), (b, F.struct(y["id"].alias("id"))), "array<struct<id:string>>")

    key = k.cast("string")
    nil = F.lit(None).cast("string")

    def every(n, rest=0):
        return k % n == rest

    def label(prefix, suffix=""):
        return F.concat(F.lit(prefix), key, F.lit(suffix))

    has_tender = F.col("o_orderstatus").isin("O", "F")
    has_award = (F.col("o_orderstatus") == "F") & F.col("n_lines").isNotNull()
    # A process either signs contracts or not, and keeps its buyer: what the views assume of real processes.
    has_contract = has_award & (F.col("o_custkey") % 5 != 0)
    has_impl = has_contract & F.coalesce("r_F", "r_O", F.datediff("a_F", F.lit("1970-01-01")),
                                         F.datediff("a_O", F.lit("1970-01-01"))).isNotNull()
    bare_buyer = F.col("o_custkey") % 97 == 0
    buyer_id = F.when(bare_buyer, "B-").otherwise(F.concat(F.lit("B-"), F.col("c_nationkey").cast("string")))
    buyer_name = F.when(~bare_buyer, F.col("n_name"))
    supp = F.col("lead_supplier")
    supplier_id = F.when(supp % 10 == 0, "S-").otherwise(F.concat(F.lit("S"), supp.cast("string")))
    supplier_name = F.when(every(9), F.concat(F.lit("Supplier  "), supp.cast("string"), F.lit("\t"))).otherwise(
        F.concat(F.lit("Supplier "), supp.cast("string")))

    award_value = (
        F.when(every(60), F.lit(0).cast(MONEY))
        .when(every(3), F.floor("line_value").cast(MONEY))
        .otherwise(F.col("line_value").cast(MONEY))
    )
    total_price = F.col("o_totalprice").cast(_LINE_PRICE).cast(MONEY)
    budget_amount = (
        F.when(every(100, 1), F.lit(0).cast(MONEY))
        .when(every(100, 2), F.lit(None).cast(MONEY))
        .otherwise(total_price)
    )
    ocid = F.concat(F.lit("P"), F.col("o_custkey").cast("string"))
    project = F.when(
        ~every(40), F.concat(F.lit("L"), ocid, F.when(every(10), "-1").otherwise("-0"))
    )
    start = (
        F.when(every(4), F.lit(None).cast("date"))
        .when(every(45), F.lit("1990-01-01").cast("date"))
        .otherwise(F.to_date("o_orderdate"))
    )

    supplier_ref = F.struct(supplier_id.alias("id"), supplier_name.alias("name"))
    buyer_ref = F.struct(buyer_id.alias("id"), buyer_name.alias("name"))

    def party(ref_id, ref_name, roles):
        return F.struct(
            ref_id.alias("id"),
            ref_name.alias("name"),
            F.struct(F.lit("ORDERS").alias("scheme"), ref_id.alias("id")).alias("identifier"),
            F.array(*[F.lit(x) for x in roles]).alias("roles"),
        )

    award = struct(
        "awards",
        id=label("A"),
        title=label("Award "),
        description=nil,
        status=F.when(every(7), "cancelled").when(every(7, 1), nil).otherwise("active"),
        date=_iso(F.col("first_ship")),
        value=_money(award_value),
        suppliers=F.array_repeat(supplier_ref, F.when(every(25), 3).otherwise(1)),
    )

    def transaction(s):
        return F.col(f"r_{s}").isNotNull(), F.struct(
            label("X", f"-{s}").alias("id"),
            _money(F.col(f"r_{s}")).alias("value"),
            buyer_ref.alias("payer"),
            supplier_ref.alias("payee"),
        )

    def planned(s):
        return F.col(f"n_{s}").isNotNull(), _milestone(label("N", f"-{s}"), nil, None)

    def met(s):
        return F.col(f"a_{s}").isNotNull(), _milestone(label("M", f"-{s}"), _iso(F.col(f"a_{s}")), "met")

    contract = struct(
        "contracts",
        id=label("C"),
        awardID=label("A"),
        title=label("Contract "),
        description=nil,
        status=F.col("lead_status"),
        value=_money(award_value),
        dateSigned=_iso(F.col("last_ship")),
        period=F.struct(
            F.when(every(2), _iso(F.col("first_ship"))).alias("startDate"),
            _iso(F.col("last_ship")).alias("endDate"),
        ),
        milestones=listed("contracts.milestones", planned("F"), planned("O"), MILESTONES),
        implementation=struct(
            "contracts.implementation",
            transactions=listed("contracts.implementation.transactions", transaction("F"), transaction("O"), TRANSACTIONS),
            milestones=listed("contracts.implementation.milestones", met("F"), met("O"), MILESTONES),
        ),
    )
    tender = F.struct(
        label("T").alias("id"),
        label("Tender ").alias("title"),
        label("Goods and services of order ").alias("description"),
        F.when(every(30), nil).when(F.col("o_orderstatus") == "F", "complete").otherwise("active").alias("status"),
        F.lit("open").alias("procurementMethod"),
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("procurementMethodDetails"),
        nil.alias("procurementMethodRationale"),
        F.coalesce("n_lines", F.lit(1)).cast("int").alias("numberOfTenderers"),
        _money(F.when(has_award, award_value).otherwise(total_price)).alias("value"),
        F.struct(_iso(start).alias("startDate"), _iso(F.col("last_ship")).alias("endDate")).alias("tenderPeriod"),
        F.struct(nil.alias("endDate")).alias("awardPeriod"),
        nil.alias("awardCriteria"),
        nil.alias("awardCriteriaDetails"),
        every(6).alias("hasEnquiries"),
        F.array(F.lit("written")).alias("submissionMethod"),
        nil.alias("submissionMethodDetails"),
    )
    buyer_party = party(buyer_id, buyer_name, ["buyer", "procuringEntity"])
    supplier_party = party(supplier_id, supplier_name, ["supplier"])
    parties = F.when(
        ~every(50),
        F.when(has_award & ~every(11), F.array(buyer_party, supplier_party)).otherwise(F.array(buyer_party)),
    )
    # Each stage includes the one before it, so the tags are always the first few.
    stages = (has_tender, has_award, has_contract, has_impl)
    tags = [F.lit(t) for t in ("planning", "tender", "award", "contract", "implementation")]
    tag = F.array(tags[0])
    for n, reached in enumerate(stages, 2):
        tag = F.when(reached, F.array(*tags[:n])).otherwise(tag)
    columns = {
        "id": key,
        "ocid": ocid,
        "date": _iso(F.to_date("o_orderdate")),
        "tag": tag,
        "initiationType": F.lit("tender"),
        "language": F.lit("en"),
        "buyer": buyer_ref,
        "parties": parties,
        "planning": F.struct(
            F.struct(
                label("G").alias("id"),
                project.alias("projectID"),
                F.when(project.isNotNull(), F.concat(F.lit("Programme "), ocid)).alias("project"),
                label("Budget of order ").alias("description"),
                F.when(~every(100, 2), _money(budget_amount)).alias("amount"),
            ).alias("budget")
        ),
        "tender": F.when(has_tender, tender),
        "awards": F.when(has_award, F.array(award)),
        "contracts": F.when(has_contract, F.array(contract)),
    }
    if section:
        held, element = {"tender": (has_tender, tender), "awards": (has_award, award), "contracts": (has_contract, contract)}[section]
        d, columns[section] = d.filter(held), element
    return d.select(*[columns[name].alias(name) for name in RELEASE_FIELDS], *keep)
