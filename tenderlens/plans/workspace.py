"""Materialisation: each table is built once, written to shared storage, and read back.

Writing cuts the lineage: losing an executor never recomputes more than the
table being built. The folder comes from ``spark.checkpoint.dir``. Every build of
a table goes to a folder of its own, so a reader of an earlier build keeps its
files until ``close`` removes the workspace.
"""

from __future__ import annotations

import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Collection
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property
from threading import Lock, RLock

from pyspark.sql import DataFrame, SparkSession

from tenderlens.model import RELEASE_FIELDS, Core, Staging
from tenderlens.operators.concentration import holder_totals
from tenderlens.plans import core as core_plan
from tenderlens.plans import impact, register, views
from tenderlens.rules import Rules
from tenderlens.sources import files, package, sinks


_FOLDERS: dict[str, str] = {}


def use_folder(spark: SparkSession, folder: str) -> None:
    """The folder for this application where its session names none; every executor must reach it."""
    _FOLDERS[spark.sparkContext.applicationId] = folder


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, else the one given to ``use_folder``."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or _FOLDERS.get(context.applicationId)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return folder.rstrip("/")


class Workspace:
    """Build-once tables over one source of release documents."""

    def __init__(
        self,
        spark: SparkSession,
        releases: Callable[[], DataFrame],
        rules: Rules,
        root: str | None = None,
    ):
        self.spark = spark
        self.rules = rules
        self.root = root or f"{shared_folder(spark)}/tenderlens/{uuid.uuid4().hex}"
        self._releases = releases
        self._built: dict[str, DataFrame] = {}
        self._building: dict[str, RLock] = defaultdict(RLock)
        self._lock = Lock()

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stored table; several threads that ask for it at once wait for one build."""
        with self._lock:
            building = self._building[name]
        with building:
            if name not in self._built:
                path = f"{self.root}/{name}-{uuid.uuid4().hex}"
                build().write.parquet(path)
                self._built[name] = self.spark.read.parquet(path)
            return self._built[name]

    def tables(self, builds: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
        """Independent tables, written as concurrent Spark jobs."""
        with ThreadPoolExecutor(max_workers=4) as pool:
            return dict(zip(builds, pool.map(lambda n: self.table(n, builds[n]), builds)))

    @cached_property
    def releases(self) -> DataFrame:
        return self.table("release_documents", self._releases)

    @cached_property
    def stg(self) -> Staging:
        flat = package.flatten(self.releases, self.rules).tables()
        return Staging(**self.tables({n: (lambda df=df: df) for n, df in flat.items()}))

    @property
    def documents(self) -> DataFrame:
        """The release documents for whoever reads some of their fields: the stored ones."""
        return self.releases

    @property
    def rows(self) -> DataFrame:
        """What ``document`` makes release documents from: here they are the stored documents themselves."""
        return self.releases

    def document(self, rows: DataFrame, keep: Collection[str] = ()) -> DataFrame:
        """The documents of some of ``rows``, with the columns in ``keep`` beside them."""
        return rows.select(*RELEASE_FIELDS, *keep)

    @property
    def implementation(self) -> DataFrame:
        """Transactions and implementation milestones per contract."""
        return core_plan.implementation_counts(self.stg)

    @cached_property
    def core(self) -> StoredCore:
        return StoredCore(self)

    @cached_property
    def v(self) -> Views:
        return Views(self.core, keep=lambda name, build: self.table(f"vw_{name}", build))

    def build_all(self, pinned: DataFrame | None = None, source: str | None = None) -> dict[str, DataFrame]:
        """Staging, core and every view, in dependency order.

        With ``pinned`` (a file manifest) and ``source`` (the folder of the input
        files), the input must equal the manifest before and after the load.
        """
        if pinned is not None:
            sinks.gated(pinned, lambda: sinks.file_manifest(self.spark, source), lambda: self.stg)
        v, c = self.v, self.core
        with ThreadPoolExecutor(max_workers=4) as pool:
            list(pool.map(lambda name: getattr(c, name), CORE_TABLES[:3]))
            for wave in VIEW_WAVES:
                list(pool.map(lambda name: getattr(v, name), wave))
        v.supplier_totals
        return dict(self._built)

    def refresh_snapshot(self) -> StoredCore:
        """Rebuild budget lines, snapshot and sections and publish them at once; views on top are built anew when asked for.

        The new tables are written beside the old ones. They become current
        together, when one row is appended to the run log after all are whole;
        a failed refresh leaves the old ones, and open readers keep their files.
        """
        stg, r = self.stg, self.rules
        new = Workspace(self.spark, self._releases, r, f"{self.root}/refresh-{uuid.uuid4().hex}")
        lines = new.table("budget_lines", lambda: core_plan.build_budget_lines(stg.planning))
        snapshot = new.table("process_snapshot", lambda: core_plan.build_process_snapshot(stg, lines))
        new.table("process_sections", lambda: core_plan.build_process_sections(stg, snapshot, self.core.dim_buyer, r))
        log = self.spark.createDataFrame([(time.time_ns(), new.root)], "published_at bigint, folder string")
        log.coalesce(1).write.mode("append").parquet(f"{self.root}/refreshes")
        for name in [n for n in self._built if n.startswith("vw_")]:
            del self._built[name]
        self._built |= new._built
        self.__dict__.pop("core", None)
        self.__dict__.pop("v", None)
        return self.core

    def close(self) -> None:
        """Remove every table of this workspace."""
        files.remove(self.spark, self.root)
        self._built.clear()


CORE_TABLES = ["budget_lines", "dim_buyer", "dim_supplier", "process_snapshot", "process_sections"]


class StoredCore:
    """``Core`` whose tables are each built and stored when they are first asked for,
    so a query pays for those that it reads."""

    def __init__(self, ws: Workspace):
        self._ws, self.stg, self.rules = ws, ws.stg, ws.rules

    @cached_property
    def budget_lines(self) -> DataFrame:
        return self._ws.table("budget_lines", lambda: core_plan.build_budget_lines(self.stg.planning))

    @cached_property
    def dim_buyer(self) -> DataFrame:
        return self._ws.table("dim_buyer", lambda: core_plan.build_dim_buyer(self.stg.releases, self.rules))

    @cached_property
    def dim_supplier(self) -> DataFrame:
        return self._ws.table(
            "dim_supplier", lambda: core_plan.build_dim_supplier(self.stg.parties, self.stg.award_suppliers, self.rules))

    @cached_property
    def process_snapshot(self) -> DataFrame:
        return self._ws.table("process_snapshot", lambda: core_plan.build_process_snapshot(self.stg, self.budget_lines))

    @cached_property
    def process_sections(self) -> DataFrame:
        return self._ws.table("process_sections", lambda: core_plan.build_process_sections(
            self.stg, self.process_snapshot, self.dim_buyer, self.rules, self._ws.implementation))


class DerivedWorkspace(Workspace):
    """A workspace whose documents are a narrow projection of stored flat rows.

    ``rows`` are written once. A staging table is flattened from the documents of these rows when it is
    read, so only the sections and fields that a query asks for are ever made; ``releases``
    stores the whole documents for those who read them as files. ``document`` takes the rows and, if
    only one section is wanted, the paths inside it that are; ``keep`` names columns of the rows to leave beside the document.
    """

    def __init__(self, spark: SparkSession, rows: Callable[[], DataFrame], document: Callable[..., DataFrame],
                 rules: Rules, root: str | None = None):
        super().__init__(spark, lambda: self.documents, rules, root)
        self._rows, self._document = rows, document

    @property
    def rows(self) -> DataFrame:
        return self.table("rows", self._rows)

    def document(self, rows: DataFrame, keep: Collection[str] = ()) -> DataFrame:
        return self._document(rows, keep=keep)

    @cached_property
    def documents(self) -> DataFrame:
        return self._document(self.rows)

    @cached_property
    def stg(self) -> Staging:
        rows = self.rows
        return package.flatten(self.documents, self.rules, lambda paths: self._document(rows, paths))

    @property
    def implementation(self) -> DataFrame:
        """Counted in the lists: neither transactions nor milestones are made."""
        return package.implementation_counts(self._document(self.rows, package.COUNTED))


# Views of one wave read only core tables and earlier waves.
VIEW_WAVES = [
    [
        "lifecycle_stage",
        "budget_eligible",
        "competition_eligible",
        "award_value_eligible",
        "tender_duration_eligible",
        "award_lag_eligible",
        "signature_lag_eligible",
        "contract_implementation_coverage",
        "dim_buyer",
    ],
    ["supplier_award_eligible", "budget_award_comparison"],
    ["award_scale_flag", "entity_benchmark", "dim_procurement_method"],
    ["metric_population", "dq_impact"],
]
VIEW_NAMES = [name for wave in VIEW_WAVES for name in wave]


class Views:
    """The 16 analytics views over one ``Core``; lazy unless ``keep`` materialises them."""

    def __init__(self, core: Core, keep: Callable | None = None):
        self.core = core
        self.rules = core.rules
        self._keep = keep or (lambda name, build: build())

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEW_NAMES:
            raise AttributeError(name)
        df = self._keep(name, lambda: self.plan(name))
        setattr(self, name, df)
        return df

    @cached_property
    def supplier_totals(self) -> DataFrame:
        """Awards and value per supplier: what every overall concentration question starts from."""
        return self._keep("supplier_totals", lambda: holder_totals(
            self.supplier_award_eligible, "supplier_id", "award_value_amount"))

    def plan(self, name: str) -> DataFrame:
        """The view's own plan over the core tables (never its stored copy)."""
        c = self.core
        if name in ("supplier_award_eligible", "budget_award_comparison"):
            return getattr(views, name)(c, self.award_value_eligible)
        if name in ("entity_benchmark", "award_scale_flag"):
            return getattr(views, name)(c, self)
        if name == "dim_buyer":
            return views.dim_buyer_view(c)
        if name == "dim_procurement_method":
            return views.dim_procurement_method(self)
        if name == "metric_population":
            return register.metric_population(self)
        if name == "dq_impact":
            return impact.dq_impact(self)
        return getattr(views, name)(c)
