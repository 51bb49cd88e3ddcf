"""URL filters: host and path rules first, gradient-boosted trees for the rest.

Everything is DataFrame functions and the Spark ML tree learner.

* Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.  Path:
  from there up to ``?``, ``#`` or the end.  Null or without ``://``: both empty.
* A rule ``host/path`` fits its host and all subdomains when the path of the URL
  starts with the rule's; the longest rule wins, a tie goes to the first in
  text order.  A host's suffixes are looked up in the rule map, so the cost per
  URL is its number of labels, however many rules there are.
* URLs that a rule decides are the labelled examples (block = 1).  The trees
  learn lexical features: lengths, depth, digit ratios, character entropy,
  parameter counts, and smoothed block rates of the host's last label, its last
  two labels and the first path segment.  The rates are counts over all
  labelled URLs; an example's own copies are left out of the rates it learns from.
* The trees are fitted on at most ``SAMPLE`` different labelled URLs, half of
  the places for each class, the lowest hashes of the URL. An example weighs as much as
  its copies, and each class as much as in the whole table.
* Features are worked out once and written; training and scoring read that table.

Defined results: URLs without a label of either class, or an empty table, get
``allow`` where no rule fits.  Repeated rows are judged each, extra columns are not
read.  Suffixes without labelled URLs have the overall rate.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.llm.storage import stored

# The rules of the contract.
RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}
SAMPLE = 10_000
TREES, DEPTH = 12, 4
SMOOTHING = 20.0


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise("")
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    path = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")
    return F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null.

    Rules are grouped by host; every suffix of the host is one look-up.
    """
    by_host: dict[str, list[str]] = {}
    for rule in sorted(rules):
        by_host.setdefault(rule.split("/", 1)[0], []).append(rule)
    if not by_host:
        return F.lit(None).cast("string")
    pairs = [x for h, rs in sorted(by_host.items()) for x in (F.lit(h), F.array(*map(F.lit, rs)))]
    table = F.create_map(*pairs)
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    found = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(table, s), F.array().cast("array<string>"))))
    fits = F.filter(found, lambda r: F.startswith(path, F.substring(r, F.instr(r, "/"), F.length(r))))
    ranked = F.array_sort(F.transform(fits, lambda r: F.struct((-F.length(r)).alias("n"), r.alias("rule"))))
    return F.try_element_at(ranked, F.lit(1))["rule"]


def _entropy(text: Column) -> Column:
    """Bits per character of the whole text: its sorted characters are read once, run by run."""
    letters = F.sort_array(F.split(text, ""))
    n = F.length(text).cast("double")

    def ended(a: Column) -> Column:
        return a["bits"] + F.when(a["run"] > 1, a["run"] * F.log2(a["run"])).otherwise(0.0)

    runs = F.aggregate(
        letters,
        F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("bits")),
        lambda a, c: F.struct(
            c.alias("last"),
            F.when(c == a["last"], a["run"] + 1.0).otherwise(1.0).alias("run"),
            F.when(c == a["last"], a["bits"]).otherwise(ended(a)).alias("bits"),
        ),
        ended,
    )
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.log2(n) - runs / n, F.lit(0.0)))


def _digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", "")) / F.greatest(F.length(text), F.lit(1))


LEXICAL = (
    "url_length", "host_length", "path_length", "depth", "labels", "hyphens", "url_digits", "host_digits", "host_entropy",
    "path_entropy", "parameters", "query_length", "fragment", "secure", "rate_last", "rate_domain", "rate_segment",
)
_KEYS = ("last", "domain", "segment")


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the features that need the URL alone, and the keys of the suffix statistics."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    return pages.select(
        "*",
        F.length(url).cast("double").alias("url_length"),
        F.length(host).cast("double").alias("host_length"),
        F.length(path).cast("double").alias("path_length"),
        F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("double").alias("depth"),
        F.size(labels).cast("double").alias("labels"),
        (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).cast("double").alias("hyphens"),
        _digits(url).alias("url_digits"),
        _digits(host).alias("host_digits"),
        _entropy(host).alias("host_entropy"),
        _entropy(path).alias("path_entropy"),
        F.size(F.filter(F.split(query, "&"), lambda s: s != "")).cast("double").alias("parameters"),
        F.length(query).cast("double").alias("query_length"),
        F.contains(url, F.lit("#")).cast("double").alias("fragment"),
        F.startswith(F.lower(url), F.lit("https:")).cast("double").alias("secure"),
        F.element_at(labels, -1).alias("last"),
        F.substring_index(host, ".", -2).alias("domain"),
        F.regexp_extract(path, r"^/([^/]*)", 1).alias("segment"),
    )


def _rates(labelled: DataFrame) -> dict[str, DataFrame]:
    """Per key: how many labelled rows have it, and how many of these are blocked; written, as each is read twice."""
    return {
        key: stored(labelled.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("bad")), f"url-rates-{key}")
        for key in _KEYS
    }


def _with_rates(rows: DataFrame, rates: dict[str, DataFrame], overall: float, copies: Column, own: Column) -> DataFrame:
    """Joins the smoothed block rate of each key without ``copies`` rows of label ``own``; Spark sizes the joins itself."""
    for key, rate in rates.items():
        bad, n = F.coalesce("bad", F.lit(0.0)) - copies * own, F.coalesce("n", F.lit(0)) - copies
        value = (bad + F.lit(SMOOTHING * overall)) / (n + F.lit(SMOOTHING))
        rows = rows.join(rate, key, "left").withColumn(f"rate_{key}", value).drop("n", "bad")
    return rows


def _examples(labelled: DataFrame, sample: int) -> DataFrame:
    """Different labelled URLs with ``copies`` and ``weight``: at most sample / 2 of each class, by the lowest hashes."""
    # All else follows from the URL: its copies are one row in each task before they are shuffled.
    alike = [c for c in labelled.columns if c in LEXICAL or c in _KEYS]
    urls = labelled.groupBy("place", "place2", "blocked", *alike).agg(F.count(F.lit(1)).alias("copies"))
    each = [urls.where(F.col("blocked") == c).orderBy("place", "place2").limit(max(1, sample // 2)) for c in (0.0, 1.0)]
    chosen = stored(each[0].unionByName(each[1]), "url-examples")
    whole = labelled.groupBy("blocked").agg(F.count(F.lit(1)).alias("rows"))
    drawn = chosen.groupBy("blocked").agg(F.sum("copies").alias("drawn"))
    share = whole.join(drawn, "blocked").select("blocked", (F.col("rows") / F.col("drawn")).alias("share"))
    return chosen.join(share, "blocked").withColumn("weight", F.col("copies") * F.col("share")).drop("share")


def judge(pages: DataFrame, rules: dict[str, str] = RULES, sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page; score is the trees' block probability."""
    rows = pages.select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    verdicts = F.create_map(*[F.lit(x) for pair in sorted(rules.items()) for x in pair]) if rules else None
    rows = rows.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    decided = F.try_element_at(verdicts, F.col("rule")) if rules else F.lit(None).cast("string")
    rows = rows.withColumn("decided", F.when(F.col("rule").isNotNull(), decided))
    hashes = {"place": F.xxhash64("url"), "place2": F.xxhash64(F.lit(1), "url")}
    featured = lexical(rows).withColumns({"blocked": (F.col("decided") == "block").cast("double"), **hashes}).drop("url")
    featured = stored(featured, "url-features")
    labelled = featured.where("decided is not null")
    n, blocked = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("blocked"), F.lit(0.0))).first()
    if blocked in (0, n):
        verdict = F.coalesce("decided", F.lit("allow"))
        return featured.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.lit(0.0).alias("score"))
    rates, gather = _rates(labelled), VectorAssembler(inputCols=list(LEXICAL), outputCol="features")
    learn = _with_rates(_examples(labelled, sample), rates, blocked / n, F.col("copies"), F.col("blocked"))
    examples = stored(learn.select("blocked", "weight", *LEXICAL), "url-learn")
    trees = GBTClassifier(
        featuresCol="features", labelCol="blocked", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11,
    ).fit(gather.transform(examples))
    none = F.lit(0.0)
    scored = trees.transform(gather.transform(_with_rates(featured, rates, blocked / n, none, none)))
    scored = scored.withColumn("score", vector_to_array("probability")[1])
    learnt = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("decided", learnt).alias("verdict"), "score")
