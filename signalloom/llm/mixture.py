"""Mixing sources to target weights by hierarchical budgeting.

Documents hang in a tree (say domain, language, source).  A token budget runs from
the root to the leaves: every node shares what it got among its children by weight,
no child gets more than its subtree can supply (its tokens times the allowed epochs),
and what one child cannot take goes to its siblings.  As a subtree's supply is known
before its share is set, only what all siblings together cannot take has been given
to the ancestor's other children.

A leaf then reads its documents in seeded epochs: whole epochs first, and of the last
one the longest prefix of its seeded order that fits the rest of the budget.  The end
of the prefix is found by radix descent over the order's hash: each pass sums one
level of 256 slices per leaf, so no leaf, however large, is sorted in one task.

Null level values count as the empty name, null texts as no tokens; texts of any length are counted whole.  Documents without
tokens follow the order and cost nothing, and are read no more often than others.  Repeated rows are separate documents with the
same place in the order: those on the edge of the prefix are all in or all out.  An empty
table gives an empty result.  Names the operator adds start with an underscore.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.session import written

_BITS, _STEP, _EDGE_ROWS = 60, 8, 64
_MOST_LEAVES, _SALTS = 100_000, 64


def count_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def place_in_order(seed: int, epoch: Column, key: Column) -> Column:
    """A 60-bit number that shuffles an epoch."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("long")


def _weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    """The given weight of a child's name; names that are not listed weigh 1."""
    listed = weights.get(level, {})
    if not listed:
        return F.lit(1.0)
    named = F.create_map(*[F.lit(x) for name, w in listed.items() for x in (name, float(w))])
    return F.coalesce(F.element_at(named, F.col(level)), F.lit(1.0))


def allocate(supply: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, float]], budget: Column) -> DataFrame:
    """Leaves with ``_got``, their tokens of the budget.

    ``supply`` has one row per leaf: levels and ``_capacity``.  ``budget`` is an
    aggregate expression over the leaves (for instance a share of their capacity).
    Children are shared out by water filling: in the order of capacity per weight,
    a child is filled while that ratio is below the level the rest would reach.
    """
    nodes = supply.agg(F.least(budget.cast("double"), F.sum("_capacity").cast("double")).alias("_budget")).withColumn("_root", F.lit(0))
    above: list[str] = ["_root"]
    leaves = supply.withColumn("_root", F.lit(0))
    for depth, level in enumerate(levels, 1):
        path = ["_root", *levels[:depth]]
        children = leaves.groupBy(*path).agg(F.sum("_capacity").cast("double").alias("_capacity")).withColumn("_weight", _weight(level, weights))
        children = children.where("_weight > 0 AND _capacity > 0").join(nodes, above)
        family = Window.partitionBy(*above)
        before = family.orderBy(F.col("_capacity") / F.col("_weight"), level).rowsBetween(Window.unboundedPreceding, -1)
        so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))  # noqa: E731,B023
        reach = (F.col("_budget") - so_far("_capacity")) / F.greatest(F.sum("_weight").over(family) - so_far("_weight"), F.lit(1e-12))
        filled = children.withColumn("_reach", reach).withColumn("_full", F.col("_capacity") / F.col("_weight") <= F.col("_reach"))
        water = F.max(F.when(~F.col("_full"), F.col("_reach"))).over(family)
        nodes = filled.select(*path, F.when(F.col("_full"), F.col("_capacity")).otherwise(F.greatest(water, F.lit(0.0)) * F.col("_weight")).alias("_budget"))
        above = path
    return nodes.select(*levels, F.floor(F.round("_budget", 6)).cast("long").alias("_got"))


def plan_leaves(
    docs: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, float]], share: float = 0.6, epochs: int = 2,
    seed: int = 7, key: str = "doc_id",
) -> DataFrame:
    """Per leaf: ``_epochs`` read in full, and the last ``(_place, _key)`` of the epoch read in part (null: none).

    ``docs`` has ``key``, levels and ``_tokens``; ``share`` is the budget as a part of all tokens.
    """
    narrow = docs.select(F.col(key).alias("_key"), *levels, "_tokens")
    leaves = narrow.groupBy(*levels).agg(F.sum("_tokens").alias("_supply"), F.count("*").alias("_rows"))
    leaves = written(leaves, "mixture-leaves")
    supply = leaves.select(*levels, (F.col("_supply") * epochs).alias("_capacity"))
    got = allocate(supply, levels, weights, F.sum("_capacity") * share / epochs)
    leaf = leaves.join(got, list(levels), "left").select(
        *levels,
        F.when(F.col("_supply") > 0, F.floor(F.coalesce("_got", F.lit(0)) / F.col("_supply"))).otherwise(F.lit(0)).cast("long").alias("_epochs"),
        F.when(F.col("_supply") > 0, F.coalesce("_got", F.lit(0)) % F.col("_supply")).otherwise(F.lit(0)).cast("long").alias("_rest"),
        F.lit(0).cast("long").alias("_prefix"),
    )
    leaf = written(leaf, "mixture-shares")
    spread = _spread(leaf, levels)
    most = leaves.agg(F.max("_rows")).first()[0] or 1
    passes = min(_BITS // _STEP, max(1, math.ceil(math.log(max(1.0, most / _EDGE_ROWS), 1 << _STEP))))
    for k in range(1, passes + 1):
        inside = spread(narrow, leaf).withColumn("_place", place_in_order(seed, F.col("_epochs"), F.col("_key")))
        slices = (
            inside.where(F.shiftright("_place", _BITS - _STEP * (k - 1)) == F.col("_prefix"))
            .groupBy(*levels, "_epochs", "_rest", F.shiftright("_place", _BITS - _STEP * k).alias("_slice"))
            .agg(F.sum("_tokens").alias("_tokens"))
        )
        so_far = F.sum("_tokens").over(Window.partitionBy(*levels).orderBy("_slice"))
        # the edge is the first slice that does not fit whole; beyond the last one everything fits
        leaf = written(
            slices.withColumn("_sum", so_far).groupBy(*levels, "_epochs").agg(
                F.coalesce(F.min(F.when(F.col("_sum") > F.col("_rest"), F.col("_slice"))), F.max("_slice")).alias("_prefix"),
                (F.first("_rest") - F.coalesce(F.max(F.when(F.col("_sum") <= F.col("_rest"), F.col("_sum"))), F.lit(0))).alias("_rest"),
            ),
            f"mixture-edge-{k}",
        )
    # the edge slice holds a bounded number of places per leaf; rows of one place come as one
    inside = spread(narrow, leaf).withColumn("_place", place_in_order(seed, F.col("_epochs"), F.col("_key")))
    at = F.shiftright("_place", _BITS - _STEP * passes)
    places = inside.where(at == F.col("_prefix")).groupBy(*levels, "_rest", "_place", "_key").agg(F.sum("_tokens").alias("_tokens"))
    edge = places.withColumn("_sum", F.sum("_tokens").over(Window.partitionBy(*levels).orderBy("_place", "_key")))
    last = edge.groupBy(*levels).agg(F.max(F.when(F.col("_sum") <= F.col("_rest"), F.struct("_place", "_key"))).alias("_last"))
    return leaf.join(last, list(levels), "left").select(*levels, "_epochs", "_prefix", "_last", F.lit(_BITS - _STEP * passes).alias("_shift"))


def _spread(plan: DataFrame, levels: Sequence[str]):
    """A join of rows with a written table of one row per leaf, by the levels, that does not gather a leaf's rows in one task.

    Up to :data:`_MOST_LEAVES` leaves every task holds the table; beyond them rows are salted.
    """
    few = plan.count() <= _MOST_LEAVES

    def join(rows: DataFrame, leaves: DataFrame) -> DataFrame:
        if few:
            return rows.join(F.broadcast(leaves), list(levels))
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).cast("int").alias("_salt")  # any salt finds its leaf
        copies = leaves.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        return rows.select("*", salt).join(copies, [*levels, "_salt"]).drop("_salt")

    return join


def mix(
    docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, float]], tokens: Column | None = None,
    share: float = 0.6, epochs: int = 2, seed: int = 7, key: str = "doc_id",
) -> DataFrame:
    """All documents' ``key``, levels, ``n_tokens`` and ``copies`` (how often the mixture reads them; 0: not at all)."""
    named = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()]
    narrow = written(docs.select(F.col(key), *named, (count_words() if tokens is None else tokens).alias("_tokens")), "mixture-documents")
    plan = written(plan_leaves(narrow, list(levels), weights, share, epochs, seed, key), "mixture-plan")
    told = _spread(plan, list(levels))(narrow, plan)
    return told.select(key, *levels, F.col("_tokens").alias("n_tokens"), _copies(seed, F.col(key), epochs).alias("copies"))


def _copies(seed: int, key: Column, most: int) -> Column:
    """Whole epochs, and one more inside the prefix of the last; never more than the epochs allowed."""
    place = place_in_order(seed, F.col("_epochs"), key)
    at = F.call_function("shiftright", place, F.col("_shift"))
    on_edge = (at == F.col("_prefix")) & F.coalesce(F.struct(place.alias("_place"), key.alias("_key")) <= F.col("_last"), F.lit(False))
    chosen = (at < F.col("_prefix")) | on_edge
    return F.least(F.col("_epochs") + F.when(chosen, F.lit(1)).otherwise(F.lit(0)), F.lit(most)).cast("long")


def take(
    docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, float]],
    share: float = 0.6, epochs: int = 1, seed: int = 7, key: str = "doc_id",
) -> DataFrame:
    """The mixture itself: the documents' rows, each as often as it is read.

    The plan has one row per leaf; rows are not shuffled for it, up to :data:`_MOST_LEAVES` leaves.
    """
    names = [f"_level{i}" for i in range(len(levels))]
    named = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(names, levels.values())]
    given = dict(zip(names, [weights.get(n, {}) for n in levels]))
    narrow = written(docs.select(F.col(key), *named, count_words().alias("_tokens")), "mixture-documents")
    plan = written(plan_leaves(narrow, names, given, share, epochs, seed, key), "mixture-plan")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(key).alias("_id"), *named)
    chosen = _spread(plan, names)(row, plan).select("_row", _copies(seed, F.col("_id"), epochs).alias("_copies")).where("_copies > 0")
    if epochs > 1:
        chosen = chosen.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"))
    return chosen.select("_row.*")
