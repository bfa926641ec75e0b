"""From raw documents to shards of training data, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``; the last adds each document's shard.
"""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import decontaminate, jaccard_join, mixture, rule_ledger, sharding
from signalloom.llm.common import hinted, hints_of, table
from signalloom.llm.queries import SHARD_BYTES, WEIGHTS, levels
from signalloom.session import written

#: Near duplicates by word shingles: five words, similarity of 0.8 or more.
WORDS, PERCENT = 5, 80
#: The mixture reads each document once at most, and this part of all tokens.
SHARE = 0.9


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the marks of toxic texts are learnt from ``labels``, if that table is there."""
    try:
        labels = table(spark, sf_dir, "labels")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn("no table of labels: quality_rules goes by the list of words alone")
        return rule_ledger.keep_good(docs)
    return rule_ledger.keep_good(docs, "v2", rule_ledger.learn(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays, whatever else has its doc_id.

    Rows that repeat a doc_id and its text leave one; so do rows without doc_id that share a text with words.
    """
    groups = written(jaccard_join.members(docs, WORDS, PERCENT).select("doc_id", "th", "component"), "pipeline-groups")
    linked = groups.where("component IS NOT NULL")
    first = linked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("row"))
    stay = first.select("row.doc_id", "row.th")
    texts = groups.where("doc_id IS NOT NULL OR component IS NOT NULL").groupBy("doc_id", "th").agg(F.count("*").alias("n"), F.bool_or(F.col("component").isNotNull()).alias("linked"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "th")]
    gone = texts.where("linked").alias("a").join(stay.alias("b"), same, "left_anti").select("doc_id", "th", F.lit("gone").alias("mark"))
    twice = texts.where("n > 1").alias("a").join(gone.alias("b"), same, "left_anti").select("doc_id", "th", F.lit("one").alias("mark"))
    marks = written(gone.unionByName(twice), "pipeline-near")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("th"))
    hints = hints_of(marks, "doc_id", "th")
    told = hinted(rows, hints).alias("a").join(marks.alias("b"), same, "left").select("row", "a.doc_id", "a.th", "mark")
    single = hinted(rows, hints, there=False).select("row.*").unionByName(told.where("mark IS NULL").select("row.*"))
    repeated = told.where("mark = 'one'").dropDuplicates(["doc_id", "th"]).select("row.*")
    return single.unionByName(repeated)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The part of the documents that meets the target weights stays."""
    return mixture.take(docs, levels(), WEIGHTS, share=SHARE, epochs=1)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its shard."""
    return sharding.assign(docs, SHARD_BYTES)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", shards),
]
ORACLE_SQL = None  # retrieval by a factorisation is not SQL; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
