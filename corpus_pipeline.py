"""The corpus pipeline: quality, language, near-duplicates, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared checkpoint folder and reads it back as the next
stage's ``docs``, so a lost executor repeats tasks of one stage only.  All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.llm import bpe, jaccard, langid, mixing, quality
from tenderlens.llm.queries import VOCABULARY
from tenderlens.llm.storage import prepare, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the classifier go."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that the network sees in them, go."""
    prepare(spark)
    return langid.keep(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by five-word shingles at 0.8 or more, the first by id and hash of the text stays.

    Rows are told apart by id and text, so different texts of one id are judged each,
    and a missing id, last in the order, is an id like others.  Of rows with the same id
    and text one stays, the first by its other columns; rows that have no words and no id
    all stay.
    """
    prepare(spark)
    text = F.col("text").cast("string")
    key = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("print"))
    # All fields may be null here: Arrow compares the nullability of inner fields.
    key = key.cast(f"struct<missing:boolean,id:{docs.schema['doc_id'].dataType.simpleString()},print:bigint>")
    found = jaccard.join_components(docs.select(key.alias("doc_id"), text.alias("text")), jaccard.Rule(words=5, num=80, den=100))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    name = "_key"
    while name in docs.columns:  # an extra column keeps its name and values
        name += "_"
    rest = docs.withColumn(name, key).join(gone.withColumnRenamed("doc_id", name), name, "left_anti")
    again = found.where("set_id is not null or not doc_id.missing").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    again = again.where("n > 1").select(F.col("doc_id").alias(name))
    if again.isEmpty():
        return rest.select(*docs.columns)
    # Maps have no order: their text decides.
    order = [F.to_json(c) if "map<" in kind else F.col(c) for c, kind in docs.dtypes]
    one = rest.join(again, name, "left_semi").groupBy(name).agg(F.min_by(F.struct(*docs.columns), F.struct(*order)).alias("row"))
    return rest.join(again, name, "left_anti").select(*docs.columns).unionByName(one.select("row.*"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them: once at least, twice at most."""
    prepare(spark)
    tokens = stored(mixing.token_table(docs), "mix-tokens")
    return mixing.realise(docs, mixing.plan(tokens)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, with the digests of the round trip."""
    prepare(spark)
    return bpe.digests(bpe.round_trip(docs, VOCABULARY), extra=("ids",))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", tokens),
]

# Learned models decide in the first two stages: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
