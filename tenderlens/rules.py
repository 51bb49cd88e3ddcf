"""Thresholds, reserved identifiers and analytic parameters, in one frozen object.

Every operator takes a ``Rules`` so the same plan runs on public contracting
data (the defaults) and on any other table of the right shape.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal


@dataclass(frozen=True)
class Rules:
    # Fixed values of the public procurement data set.
    bare_buyer_id: str = "NG-BPP-"
    bare_supplier_id: str = "NG-BPP-"
    test_buyer_id: str = "NG-BPP-BPP-NOC-90"
    buyer_code_prefix: str = "^NG-BPP-BPP-NOC-"
    currency: str = "NGN"
    extreme_budget: Decimal = Decimal("1000000000000")
    extreme_award: Decimal = Decimal("1000000000000")
    normal_max: int = 100
    elevated_max: int = 1000
    placeholder_date: str = "2001-01-01"
    future_from: str = "2026-01-01"
    impossible_from: str = "2051-01-01"
    # The snapshot study classes dates by their year alone.
    study_future_year: int = 2026
    study_impossible_year: int = 2051
    # The profiler looks at awards and tender values from here on, below the flag of extreme awards.
    profile_extreme_value: Decimal = Decimal("500000000000")
    # Whole words that mark a buyer as a possible test entity; a portal may
    # add its own name.
    test_words: tuple = ("test", "tests", "testing", "demo", "dummy", "sample", "trial")
    # Scale-error tests.
    ratio_low: Decimal = Decimal("50")
    ratio_high: Decimal = Decimal("200")
    sibling_factor: int = 500
    # Analytic parameters (not data rules).
    min_awards: int = 10
    min_tenders: int = 30
    min_contracts: int = 20
    min_processes: int = 30
    min_method_ocids: int = 30
    min_entity_ocids: int = 10
    small_n: int = 30
    small_kpi_entities: int = 10
    high_pct: float = 10.0
    moderate_pct: float = 1.0
    small_budget: Decimal = Decimal("100000")
    huge_ratio: int = 1000000
    # Money columns in result sets are divided by ``unit`` and carry its label.
    unit: float = 1e9
    unit_label: str = "ngn_bn"


METHOD_NOT_STATED = "(method not stated)"
STATUS_NOT_STATED = "(status not stated)"
SMALL_N_NOTE = "small n: read with caution"
