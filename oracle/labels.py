"""Labels that the impact results carry, stated here apart from the package that is compared."""

# The label of the row of all reasons.
ALL_REASONS = "All exclusion reasons combined (candidate minus eligible)"

# Metric, order, name, grain.
METRIC_META = [
    ("ALL", 0, "All OCID-level metrics (process snapshot)", "OCID"),
    ("M-P01", 1, "Total planned budget by entity", "budget line"),
    ("M-C01 / M-C02", 2, "Median tenderers; single-bidder rate (primary)", "OCID"),
    ("M-V01", 3, "Median award value", "OCID (one award)"),
    ("M-S01", 4, "Top-supplier award value concentration", "award"),
    ("P4-BvA", 5, "Budget-to-award comparison", "OCID"),
    ("M-E01", 6, "Median tender duration (days)", "OCID"),
    ("M-E02", 7, "Median award lag (days)", "OCID"),
    ("P5-SIG", 8, "Contract signature lag (days)", "contract"),
    ("M-E03", 9, "Lifecycle conversion", "OCID"),
    ("M-I01", 10, "Implementation reporting coverage", "contract"),
    ("ENTITY", 11, "Procuring-entity benchmark", "buyer"),
]

# Issue, name, treatment, note.
ISSUE_META = [
    ("DQ-01", "Repeated OCIDs (multi-release processes)", "RETAIN", "Kept: the snapshot takes each section from its latest release, so nothing is counted twice."),
    ("DQ-02", "Planning-only processes", "RETAIN", "Kept: later-stage metrics describe only the processes that got further."),
    ("DQ-04", "Elevated tenderer count", "FLAG", "Left out of the primary result, kept in the sensitivity population."),
    ("DQ-05", "Anomalous tenderer count", "EXCLUDE_FROM_METRIC", "Left out of both competition populations."),
    ("DQ-06", "Extreme budget", "EXCLUDE_FROM_METRIC", "One such value would dominate any total."),
    ("DQ-07", "Extreme award value", "EXCLUDE_FROM_METRIC", "One such value would dominate any total."),
    ("DQ-08", "Placeholder date", "EXCLUDE_FROM_METRIC", "Left out of the timing metric that needs the date."),
    ("DQ-09", "Future or impossible date", "EXCLUDE_FROM_METRIC", "Left out of the timing metric that needs the date."),
    ("DQ-11", "Implementation transaction dates absent", "RETAIN", "Transactions show presence only; payment timing is not measurable."),
    ("DQ-12", "Implementation transaction value semantics unclear", "RETAIN", "Transaction values are never summed."),
    ("DQ-13", "Supplier ID with several name variants", "RETAIN", "Never merged: concentration is a lower bound."),
    ("DQ-14", "Incomplete supplier ID", "EXCLUDE_FROM_METRIC", "The supplier cannot be identified; state this with every concentration figure."),
    ("DQ-16", "Zero monetary value", "EXCLUDE_FROM_METRIC", "Zero is unusable, not a real amount."),
    ("DQ-18", "Release with no parties array", "EXCLUDE_FROM_METRIC", "The buyer cannot be confirmed."),
    ("DQ-19", "Incomplete buyer ID", "EXCLUDE_FROM_METRIC", "Left out of per-entity measures, kept in overall counts."),
    ("DQ-20", "Portal test entity", "EXCLUDE_FROM_METRIC", "Removed before each candidate population is defined."),
    ("C-06", "Several unrelated budget lines on one OCID", "EXCLUDE_FROM_METRIC", "No rule says which line the award answers."),
    ("DATE-ORDER", "Date chronology conflict (end before start)", "EXCLUDE_FROM_METRIC", "Negative durations are left out, not corrected."),
    ("OTHER", "Other eligibility rule (status, missing value, missing date, no budget line)", "EXCLUDE_FROM_METRIC", "Not a numbered issue; missing values are never imputed."),
]
