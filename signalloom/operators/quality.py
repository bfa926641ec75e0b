"""Declarative data-quality rules.

A rule is ``(name, condition, key, detail)``; all row rules of a dataset run in
one scan, and every check returns ``(rule, dataset, row_key, detail)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.functions.dates import parse_instant
from signalloom.functions.numbers import is_finite

COLUMNS = ["rule", "dataset", "row_key", "detail"]
VIOLATION = "rule string, dataset string, row_key string, detail string"


@dataclass
class Rule:
    name: str
    violated: Column
    detail: Column


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def not_blank(column: str) -> Rule:
    c = F.col(column)
    return Rule("not_blank", c.isNull() | (F.length(F.trim(c)) == 0), F.lit(column))


def finite_range(column: str, low: float | None = None, high: float | None = None, nullable: bool = False) -> Rule:
    c = F.col(column)
    bad = ~is_finite(c)
    if low is not None:
        bad = bad | (c < low)
    if high is not None:
        bad = bad | (c > high)
    if nullable:
        bad = c.isNotNull() & bad
    return Rule("finite_range", bad, F.concat(F.lit(f"{column}="), _text(c)))


def one_of(column: str, values: list) -> Rule:
    c = F.col(column)
    return Rule("enum", c.isNull() | ~c.isin(values), F.concat(F.lit(f"{column}="), _text(c)))


def valid_timestamp(column: str) -> Rule:
    c = F.col(column)
    return Rule("valid_timestamp", parse_instant(c).isNull(), F.concat(F.lit(f"{column}="), _text(c)))


def ordered_fields(low: str, high: str, strict: bool = False) -> Rule:
    bad = F.col(low) >= F.col(high) if strict else F.col(low) > F.col(high)
    return Rule("cross_field", bad, F.lit(f"{low}>{high}"))


def conditional(name: str, when: Column, require: Column) -> Rule:
    """``require`` has to hold wherever ``when`` does."""
    return Rule("conditional", when & ~F.coalesce(require, F.lit(False)), F.lit(name))


def must_match(column: str, regex: str) -> Rule:
    c = F.col(column)
    return Rule("pattern", ~F.coalesce(c.rlike(regex), F.lit(False)), F.lit(f"{column} must match"))


def must_not_match(column: str, regex: str) -> Rule:
    return Rule("pattern", F.col(column).rlike(regex), F.lit(f"{column} must not match"))


def must_contain(column: str, other: str) -> Rule:
    bad = ~F.coalesce(F.contains(F.col(column), F.col(other).cast("string")), F.lit(False))
    return Rule("pattern", bad, F.lit(f"{column} must contain {other}"))


def length_between(column: str, low: int = 0, high: int | None = None) -> Rule:
    n = F.length(column)
    bad = n < low if high is None else (n < low) | (n > high)
    return Rule("length", bad, F.concat(F.lit(f"{column}:"), _text(n)))


def non_empty_array(column: str, at_most: int | None = None) -> Rule:
    n = F.size(column)
    bad = F.col(column).isNull() | (n <= 0)
    if at_most is not None:
        bad = bad | (n > at_most)
    return Rule("required_collection", bad, F.lit(column))


def filtered_upstream(name: str, present: Column) -> Rule:
    return Rule("row_filtered_upstream", present, F.lit(name))


def check_rows(df: DataFrame, dataset: str, key: Column, rules: list[Rule]) -> DataFrame:
    """All row rules of one dataset in a single scan."""
    found = [
        F.when(
            F.coalesce(r.violated, F.lit(False)),
            F.struct(F.lit(r.name).alias("rule"), F.lit(dataset).alias("dataset"),
                     key.cast("string").alias("row_key"), r.detail.alias("detail")),
        )
        for r in rules
    ]
    return df.select(F.inline(F.filter(F.array(*found), lambda v: v.isNotNull())))


def _violations(df: DataFrame, rule: str, dataset: str, key: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"), F.lit(dataset).alias("dataset"), key.cast("string").alias("row_key"),
        detail.alias("detail"),
    )


def foreign_key(df: DataFrame, dataset: str, key: str, column: str, dimension: DataFrame, ref: str) -> DataFrame:
    """Rows (or array elements) whose id is missing from the dimension."""
    is_array = dict(df.dtypes)[column].startswith("array")
    value = F.explode(column) if is_array else F.col(column)
    ids = df.select(F.col(key).alias("_key"), value.alias("_ref"))
    known = dimension.select(F.col(ref).alias("_ref")).distinct()
    return _violations(ids.join(known, "_ref", "left_anti"), "foreign_key", dataset, F.col("_key"), _text(F.col("_ref")))


def unique(df: DataFrame, dataset: str, *columns: str) -> DataFrame:
    twice = df.groupBy(*columns).agg(F.count("*").alias("_n")).where("_n > 1")
    return _violations(twice, "unique", dataset, F.concat_ws("|", *columns), F.concat(F.lit("n="), _text(F.col("_n"))))


def cardinality(
    df: DataFrame, dataset: str, by: str, groups: DataFrame | None = None, at_least: int = 0, at_most: int | None = None
) -> DataFrame:
    """Groups with too few or too many rows; ``groups`` lists those that must exist."""
    counts = df.groupBy(by).agg(F.count("*").alias("_n"))
    if groups is not None:
        counts = groups.select(by).distinct().join(counts, by, "left")
    n = F.coalesce("_n", F.lit(0))
    bad = (n < at_least) if at_most is None else ((n < at_least) | (n > at_most))
    if groups is not None:
        bad = bad | (n == 0)
    return _violations(counts.where(bad), "cardinality", dataset, F.col(by), F.concat(F.lit("n="), _text(n)))


def sorted_descending(df: DataFrame, dataset: str, by: str, order: str, value: str) -> DataFrame:
    """Positions of a published list where the value rises.

    Positions are consecutive, so each row meets its predecessor by an
    equi-join on ``order - 1`` and no list has to fit into one task.
    """
    here = df.select(by, F.col(order).alias("_at"), F.col(value).alias("_v"))
    before = df.select(by, (F.col(order) + 1).alias("_at"), F.col(value).alias("_b"))
    bad = here.join(before, [by, "_at"]).where("_v > _b")
    return _violations(bad, "sorted", dataset, F.concat_ws("|", by, "_at"), F.lit(f"{value} rises"))


def threshold_consistency(edges: DataFrame, dataset: str, threshold: float, window: int) -> DataFrame:
    """Correlation edges below their threshold or off their window."""
    bad = edges.where((F.abs("r") < threshold - 1e-9) | (F.col("n") != window))
    return _violations(bad, "threshold", dataset, F.concat_ws("|", "a", "b"), F.concat(F.lit("r="), _text(F.col("r"))))


def no_fabricated_history(daily: DataFrame, dataset: str, depth_days: float, day: str = "date") -> DataFrame:
    """More distinct days than the collection can have seen."""
    import math

    days = daily.agg(F.count_distinct(day).alias("_n")).where(F.col("_n") > math.ceil(depth_days) + 1)
    return _violations(days, "fabricated_history", dataset, F.lit("days"), _text(F.col("_n")))


def required_columns(df: DataFrame, dataset: str, types: dict[str, str]) -> DataFrame:
    """Schema check: columns that are missing or have another kind of type."""
    have = dict(df.dtypes)
    bad = [
        ("required_collection", dataset, c, have.get(c, "missing"))
        for c, kind in types.items()
        if not have.get(c, "").startswith(kind)
    ]
    return df.sparkSession.createDataFrame(bad, VIOLATION)


def union_violations(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(part.select(*COLUMNS))
    return out


def stored_as_declared(spark, path: str, declared, dataset: str) -> DataFrame:
    """Violations of an optional Parquet dataset: none where it is absent; where it is there, every file has to be
    readable and every declared column stored with its type.

    Meant for published datasets: their files are read in tasks, one at a time.
    """
    from pyspark.errors import AnalysisException
    from pyspark.sql.pandas.types import to_arrow_schema

    from signalloom.sources.readers import stored_schemas

    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], VIOLATION)
    wanted = [(f.name, str(f.type)) for f in to_arrow_schema(declared)]
    expected = spark.createDataFrame(wanted, "name string, want string")
    schemas = stored_schemas(files.where(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]")))
    found = schemas.where("readable").select("path", F.explode("columns").alias("c")).select("path", "c.name", F.col("c.type").alias("kind"))
    sound = schemas.where("readable").select("path")
    held = sound.join(F.broadcast(expected)).join(found, ["path", "name"], "left")
    wrong = held.where("kind IS NULL OR kind <> want").select(
        F.lit("stored_schema").alias("rule"), F.col("name").alias("row_key"),
        F.when(F.col("kind").isNull(), F.lit("missing")).otherwise(F.concat(F.col("kind"), F.lit(" for "), F.col("want"))).alias("detail"),
    ).distinct()
    unreadable = schemas.where("NOT readable").agg(F.count("*").alias("n")).where("n > 0").select(
        F.lit("stored_schema").alias("rule"), F.lit("files").alias("row_key"), F.concat(F.lit("unreadable="), F.col("n").cast("string")).alias("detail")
    )
    return wrong.unionByName(unreadable).select("rule", F.lit(dataset).alias("dataset"), "row_key", "detail")
