"""Steps that must cost what a query reads: tables on demand, documents."""

import gzip
import json
from datetime import date, datetime
from decimal import Decimal

from tenderlens import catalog
from tenderlens.model import RELEASE_SCHEMA
from tenderlens.plans import core, deliverables
from tenderlens.plans.workspace import DerivedWorkspace
from tenderlens.sources import package
from tenderlens.sources.order_releases import ORDER_RULES, order_documents, order_rows

SF_DIR = "/root/testdata/sf0.001"


def _fresh(spark):
    return DerivedWorkspace(spark, lambda: order_rows(spark, SF_DIR), order_documents, ORDER_RULES)


def test_a_query_builds_only_the_tables_it_reads(spark):
    for name, tables in {"f12_buyer_labels": {"rows", "dim_buyer"}, "j03_left_composite": {"rows"}}.items():
        ws = _fresh(spark)
        assert catalog.QUERIES[name](ws).count() > 0
        assert set(ws._built) == tables, name
        ws.close()


def test_fields_of_documents_are_made_without_the_rest(spark):
    ws = _fresh(spark)
    rows = ws.stg.awards.select("award_id", "status")
    read = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in read and "o_totalprice" not in read
    assert ws.documents.schema.simpleString() == spark.createDataFrame([], RELEASE_SCHEMA).schema.simpleString()
    # No filter over an array: such a stage would not be generated code.
    assert "lambda" not in ws.documents._jdf.queryExecution().executedPlan().toString()
    ws.close()


def test_derived_staging_equals_the_stored_documents(spark):
    ws = _fresh(spark)
    again = package.flatten(ws.releases, ws.rules).tables()
    for name, table in ws.stg.tables().items():
        assert table.exceptAll(again[name]).count() == again[name].exceptAll(table).count() == 0, name
    ws.close()


_ROWS = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
    "o_orderpriority string, c_nationkey int, n_name string, n_lines bigint, line_value decimal(28,4), first_ship date, "
    "last_ship date, r_F decimal(28,4), a_F date, n_F int, r_O decimal(28,4), a_O date, n_O int, lead_supplier bigint, "
    "lead_status string"
)


def _order_rows(spark):
    day, at, x = date(1995, 3, 4), datetime(1995, 1, 2, 3, 4), Decimal("12.5000")
    lines = [  # n_lines, line_value, first_ship, last_ship, r_F, a_F, n_F, r_O, a_O, n_O, lead_supplier, lead_status
        (2, x, day, day, x, day, 1, x, day, 1, 11, "F"),
        (1, x, None, day, None, None, None, x, None, None, 20, "O"),
        (1, None, day, None, None, day, None, None, None, 1, None, None),
        (None,) * 12,
    ]
    heads = [(s, p, n) for s in ("F", "O", None) for p, n in ((None, None), (100.25, 7))]
    both = [(k, 3 * k % 25, s, p, at if p else None, "1-URGENT", n, n and "PERU", *line)
            for k, ((s, p, n), line) in enumerate(((h, line) for h in heads for line in lines), 24)]
    return spark.createDataFrame([*both, *both[:3]], _ROWS)


def test_lists_are_made_with_the_fields_that_are_read(spark):
    """All fields of a contract were made for a table that reads its transactions only."""
    rows = _order_rows(spark)
    ws = DerivedWorkspace(spark, lambda: rows, order_documents, ORDER_RULES)
    whole = package.flatten(order_documents(rows), ORDER_RULES).tables()
    for name in package.READS:
        table = getattr(ws.stg, name)
        assert table.schema == whole[name].schema, name
        found = sorted(map(str, table.collect()))
        assert found and found == sorted(map(str, whole[name].collect())), name
    unread = {"transactions": ("last_ship", "a_F", "n_F", "line_value"), "milestones": ("last_ship", "line_value"),
              "contracts": ("n_F",), "award_suppliers": ("first_ship", "line_value"), "awards": ("lead_supplier",)}
    for name, fields in unread.items():
        scan = getattr(ws.stg, name)._jdf.queryExecution().executedPlan().toString().split("FileScan")[1].split("DataFilters")[0]
        assert not [f for f in fields if f in scan], name
    ws.close()


def test_a_field_of_a_section_is_made_without_the_section(spark):
    """A list or a condition around a tender, an award or a contract had the whole of it made for one field."""
    rows = _order_rows(spark)
    ws = DerivedWorkspace(spark, lambda: rows, order_documents, ORDER_RULES)
    whole = package.flatten(order_documents(rows), ORDER_RULES)
    for name, field in {"tender": "status", "awards": "status", "contracts": "status"}.items():
        table = getattr(ws.stg, name).select("ocid", field)
        plan = table._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "explode" not in plan and "struct" not in plan and "title" not in plan, name
        assert sorted(map(str, table.collect())) == sorted(map(str, getattr(whole, name).select("ocid", field).collect()))
    ws.close()


def test_packages_are_made_of_rows_on_the_way_to_the_file(spark, tmp_path):
    """Whole documents were stored, shuffled and gathered in lists to be written as text."""
    rows = _order_rows(spark)
    ws = DerivedWorkspace(spark, lambda: rows, order_documents, ORDER_RULES)
    path = str(tmp_path / "packages")
    package.write_packages(ws.rows, path, "2001-02-03T00:00:00Z", per_package=6, document=ws.document)
    assert set(ws._built) == {"rows"}
    texts = [json.loads(gzip.open(f).read()) for f in (tmp_path / "packages").rglob("part-*")]
    assert len(texts) > 1 and {x["publishedDate"] for x in texts} == {"2001-02-03T00:00:00Z"}
    whole = sorted(map(str, ws.releases.collect()))
    for read in (package.read_package, package.read_package_split):
        assert sorted(map(str, read(spark, path).drop("file").collect())) == whole
    package.write_packages(ws.releases, f"{path}2", "2001-02-03T00:00:00Z", per_package=6)
    assert sorted(map(str, package.read_package_split(spark, f"{path}2").collect())) == whole
    ws.close()


def test_many_packages_are_sorted_by_more_tasks_than_the_session_names(spark, tmp_path):
    """All rows of the packages went through the session's shuffle partitions, whatever their number."""
    rows, path = _order_rows(spark), str(tmp_path / "packages")
    for _ in range(2):
        rows = rows.unionAll(rows)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        package.write_packages(rows, path, "2001", per_package=1, document=lambda d, keep: order_documents(d, keep=keep))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert len({f.name.split("-")[1] for f in (tmp_path / "packages").rglob("part-*")}) == 2
    found = package.read_package_split(spark, path).collect()
    assert sorted(map(str, found)) == sorted(map(str, order_documents(rows).collect()))


def test_scan_and_package_day_store_no_documents(spark):
    """Both queries stored all documents as a table and as plain text; the days of all releases were shuffled to one day's join."""
    rows = _order_rows(spark)
    ws = DerivedWorkspace(spark, lambda: rows, order_documents, ORDER_RULES)
    dates = [r["date"] for r in order_documents(rows).select("date").collect()]
    day = deliverables.equal_to_package_date(ws)
    assert tuple(day.first()) == (date(1995, 1, 2), dates.count("1995-01-02T00:00:00Z"), len(dates))
    join = day._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
    assert join.count("Aggregate") == 2  # the distinct dates of the packages, and releases per day
    assert sum(r["releases"] for r in deliverables.package_scan(ws).collect()) == len(dates)
    assert set(ws._built) == {"rows"}
    ws.close()


def test_implementation_is_counted_without_its_rows(spark):
    """Transactions and milestones were exploded with all fields to be counted per contract."""
    rows = _order_rows(spark)
    ws = DerivedWorkspace(spark, lambda: rows, order_documents, ORDER_RULES)
    none = {"transaction_count": 0, "implementation_milestone_count": 0}
    plain = core.implementation_counts(package.flatten(order_documents(rows), ORDER_RULES)).fillna(none)
    columns = ["contract_id", *none]
    found = sorted(map(str, ws.implementation.select(columns).collect()))
    assert found and found == sorted(map(str, plain.select(columns).collect()))
    assert "explode" not in ws.implementation._jdf.queryExecution().optimizedPlan().toString().lower()
    ws.close()
