"""Line facts are exact whatever the prices, and no decimal is summed or made for a line."""

from datetime import datetime

from pyspark.sql import functions as F

from tenderlens.sources.order_releases import line_facts

_LINES = (
    "l_orderkey bigint, l_suppkey bigint, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
)
_DAY = datetime(1995, 3, 4)


def _prices():
    odd = [0.0, -0.0, 0.00005, 0.00015, 1.00005, 2.67535, 12.34565, -12.34565, -7.5, 0.1 + 0.2, 1e-9, 899999.9999, 900000.0,
           99999.99, 9999999999.9999, 1e10, 12345678901.23455, 9e13, 99999999999999.0, -99999999999999.0, None]
    rows = [(i, 7, x, f, s) for i, x in enumerate(odd) for f, s in (("R", "F"), ("R", "O"), ("A", "F"), (None, None))]
    rows += [(100, s, x, "R", "F") for s in (1, 999_999, 1_000_000, 10**11, None) for x in (5.25, 900000.0)]
    rows += [(101, s, 5.25, "R", t) for s in (1, 999_999, 1_000_000) for t in ("F", "O")] + [(102, 3, 9.9e13, "R", "F")] * 40
    rows += [(103, 3, None, "R", "F"), (None, 4, 2.5, "R", "O"), (104, 2, 8.0, "N", "O"), (104, 10**7, 8.0, "N", "F"), (104, 3, -1.0, "N", "F")]
    return [(*r, _DAY) for r in rows]


def _plainly(lines):
    """The same facts from decimals."""
    price = F.col("l_extendedprice").cast("decimal(18,4)")
    digits = F.lit(10**15).cast("decimal(16,0)")
    code = ((price * 10000).cast("decimal(18,0)") * digits
            + (F.col("l_suppkey") * 1000 + F.ascii("l_linestatus")).cast("decimal(18,0)")).cast("decimal(38,0)")
    rest = (F.col("code") % digits).cast("bigint")
    returned = [F.sum(F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == s), price)).alias(f"r_{s}") for s in "FO"]
    return lines.groupBy("l_orderkey").agg(F.sum(price).alias("line_value"), *returned, F.max(code).alias("code")).select(
        "l_orderkey", "line_value", "r_F", "r_O", F.floor(rest / 1000).cast("bigint").alias("lead_supplier"),
        F.chr(rest % 1000).alias("lead_status"))


def test_sums_and_leading_lines_are_exact(spark):
    lines = spark.createDataFrame(_prices(), _LINES)
    expected, found = _plainly(lines), line_facts(lines)
    found = found.select(*expected.columns)
    assert found.dtypes == expected.dtypes
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_no_decimal_is_summed(spark):
    """The sums were decimals of 28 digits, made anew for each line."""
    plan = line_facts(spark.createDataFrame(_prices(), _LINES))._jdf.queryExecution().optimizedPlan()
    assert "sum(price" not in plan.toString() and "sum((units" in plan.toString()
