"""Data-quality rules over the order tables, labels and pages."""

from pyspark.sql import functions as F

from signalloom.operators import quality as Q
from signalloom.plans import tables as T
from signalloom.plans.registry import query


def _row(rule, dataset, key, detail, table, where):
    return (
        f"SELECT '{rule}' AS rule, '{dataset}' AS dataset, CAST({key} AS VARCHAR) AS row_key, {detail} AS detail FROM {table} WHERE {where}"
    )


def _check(spark, d, table, key, *rules):
    return Q.check_rows(T.table(spark, d, table), table, F.col(key), list(rules))


@query("dq_not_blank", _row("not_blank", "documents", "doc_id", "'third'", "documents", "length(trim(split_part(text, chr(10), 3))) = 0"))
def dq_not_blank(spark, d):
    docs = T.table(spark, d, "documents").withColumn("third", F.split_part("text", F.lit("\n"), F.lit(3)))
    return Q.check_rows(docs, "documents", F.col("doc_id"), [Q.not_blank("third")])


@query("dq_finite_range", _row("finite_range", "customer", "c_custkey", "'c_acctbal'", "customer", "c_acctbal < 0 OR c_acctbal > 9000"))
def dq_finite_range(spark, d):
    found = _check(spark, d, "customer", "c_custkey", Q.finite_range("c_acctbal", 0, 9000))
    return found.withColumn("detail", F.split_part("detail", F.lit("="), F.lit(1)))


@query("dq_enum", _row("enum", "orders", "o_orderkey", "'o_orderpriority=' || o_orderpriority", "orders", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"))
def dq_enum(spark, d):
    return _check(spark, d, "orders", "o_orderkey", Q.one_of("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]))


@query("dq_valid_timestamp", _row("valid_timestamp", "orders", "o_orderkey", "'stamp=soon'", "orders", "o_orderkey % 5 = 0"))
def dq_valid_timestamp(spark, d):
    at = F.when(F.pmod("o_orderkey", F.lit(5)) == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    orders = T.table(spark, d, "orders").withColumn("stamp", at)
    return Q.check_rows(orders, "orders", F.col("o_orderkey"), [Q.valid_timestamp("stamp")])


@query("dq_foreign_key", _row("foreign_key", "documents", "doc_id", "CAST(doc_id AS VARCHAR)", "documents", "doc_id NOT IN (SELECT doc_id FROM labels)"))
def dq_foreign_key(spark, d):
    return Q.foreign_key(T.table(spark, d, "documents"), "documents", "doc_id", "doc_id", T.table(spark, d, "labels"), "doc_id")


@query("dq_unique", "SELECT 'unique' AS rule, 'documents' AS dataset, CAST(n_chars AS VARCHAR) || '|' || lang AS row_key, 'n=' || count(*) AS detail FROM documents GROUP BY n_chars, lang HAVING count(*) > 1")
def dq_unique(spark, d):
    return Q.unique(T.table(spark, d, "documents"), "documents", "n_chars", "lang")


@query("dq_cardinality", "SELECT 'cardinality' AS rule, 'supplier' AS dataset, CAST(n_nationkey AS VARCHAR) AS row_key, 'n=' || count(s_suppkey) AS detail FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey HAVING count(s_suppkey) = 0 OR count(s_suppkey) > 4")
def dq_cardinality(spark, d):
    nations = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"))
    found = Q.cardinality(T.table(spark, d, "supplier"), "supplier", "s_nationkey", nations, at_most=4)
    return found


@query("dq_cross_field", _row("cross_field", "lineitem", "l_orderkey", "'l_tax>l_discount'", "lineitem", "l_tax > l_discount"))
def dq_cross_field(spark, d):
    return _check(spark, d, "lineitem", "l_orderkey", Q.ordered_fields("l_tax", "l_discount"))


@query("dq_conditional", _row("conditional", "lineitem", "l_orderkey", "'returned lines are full price'", "lineitem", "l_returnflag = 'R' AND NOT l_discount = 0"))
def dq_conditional(spark, d):
    rule = Q.conditional("returned lines are full price", F.col("l_returnflag") == "R", F.col("l_discount") == 0)
    return _check(spark, d, "lineitem", "l_orderkey", rule)


@query("dq_pattern", " UNION ALL ".join([
    _row("pattern", "pages", "page_id", "'url must match'", "pages", "NOT regexp_matches(url, '^https://')"),
    _row("pattern", "pages", "page_id", "'html must not match'", "pages", "regexp_matches(html, '&(amp|lt);')"),
    _row("pattern", "pages", "page_id", "'url must contain page_id'", "pages", "NOT contains(url, CAST(page_id AS VARCHAR))"),
]))
def dq_pattern(spark, d):
    return _check(spark, d, "pages", "page_id", Q.must_match("url", "^https://"), Q.must_not_match("html", "&(amp|lt);"),
                  Q.must_contain("url", "page_id"))


@query("dq_length", _row("length", "documents", "doc_id", "'text:' || length(text)", "documents", "length(text) < 40 OR length(text) > 5000"))
def dq_length(spark, d):
    return _check(spark, d, "documents", "doc_id", Q.length_between("text", 40, 5000))


@query("dq_sorted", """SELECT 'sorted' AS rule, 'events' AS dataset, a.day || '|' || a.hour AS row_key, 'n rises' AS detail FROM
  (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, date_part('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL) a JOIN
  (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, date_part('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL) b
  ON a.day = b.day AND a.hour = b.hour + 1 WHERE a.n > b.n""")
def dq_sorted(spark, d):
    hourly = T.table(spark, d, "events").groupBy(
        F.to_date("ts").cast("string").alias("day"), F.hour("ts").alias("at")
    ).agg(F.count("*").alias("n"))
    return Q.sorted_descending(hourly, "events", "day", "at", "n")


@query("dq_threshold_consistency", """SELECT 'threshold' AS rule, 'lineitem' AS dataset, l_orderkey || '|' || l_linenumber AS row_key, 'n=' || l_linenumber AS detail
  FROM lineitem WHERE abs(l_discount) < 0.05 - 1e-9 OR l_linenumber <> 3""")
def dq_threshold(spark, d):
    edges = T.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_discount").alias("r"), F.col("l_linenumber").alias("n")
    )
    found = Q.threshold_consistency(edges, "lineitem", 0.05, 3)
    return found.withColumn("detail", F.concat(F.lit("n="), F.split_part("row_key", F.lit("|"), F.lit(2))))


@query("dq_no_fabricated_history", "SELECT 'fabricated_history' AS rule, 'events' AS dataset, 'days' AS row_key, CAST(count(DISTINCT CAST(ts AS DATE)) AS VARCHAR) AS detail FROM events HAVING count(DISTINCT CAST(ts AS DATE)) > 13")
def dq_history(spark, d):
    return Q.no_fabricated_history(T.table(spark, d, "events").select(F.to_date("ts").alias("date")), "events", 11.5)


@query("dq_row_filtered_upstream", _row("row_filtered_upstream", "documents", "doc_id", "'short'", "documents", "n_chars <= 180"))
def dq_filtered(spark, d):
    return _check(spark, d, "documents", "doc_id", Q.filtered_upstream("short", F.col("n_chars") <= 180))


@query("dq_required_collections", _row("required_collection", "embeddings", "vec_id", "'near'", "(SELECT *, list_filter(embedding, lambda x: x > 0.3) AS near FROM embeddings)", "len(near) = 0 OR len(near) > 2"))
def dq_collections(spark, d):
    near = T.table(spark, d, "embeddings").withColumn("near", F.filter("embedding", lambda x: x > 0.3))
    return Q.check_rows(near, "embeddings", F.col("vec_id"), [Q.non_empty_array("near", 2)])


@query("dq_optional_dataset", """SELECT 'unique' AS rule, 'labels' AS dataset, source || '|' || toxic AS row_key, 'n=' || count(*) AS detail
  FROM labels JOIN documents USING (doc_id) GROUP BY source, toxic HAVING count(*) > 1
  UNION ALL SELECT 'stored_schema', 'malformed', * FROM (VALUES ('quality', 'missing'), ('toxic', 'string for int32'), ('files', 'unreadable=1')) v""")
def dq_optional(spark, d):
    """An optional dataset: absent, it violates nothing; sound, its rows are checked; malformed, what is stored is held against what is declared."""
    import uuid

    from signalloom.session import shared_folder
    from signalloom.sources.readers import optional_source

    given = T.table(spark, d, "labels")
    schema = given.schema
    place = f"{shared_folder(spark)}/signalloom/labels-{uuid.uuid4().hex}"
    given.write.parquet(f"{place}/sound")
    given.select("doc_id", F.col("toxic").cast("string").alias("toxic")).write.parquet(f"{place}/malformed/a")
    spark.range(1).select(F.lit("no table at all").alias("value")).write.text(f"{place}/malformed/b")
    labels = optional_source(spark, f"{place}/sound", schema, "parquet").unionByName(optional_source(spark, f"{place}/absent", schema, "parquet"))
    joined = labels.join(T.table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    stored = [Q.stored_as_declared(spark, f"{place}/{name}", schema, name) for name in ("absent", "sound", "malformed")]
    return Q.union_violations(Q.unique(joined, "labels", "source", "toxic"), *stored)


@query("dq_all_rules", " UNION ALL ".join([
    _row("finite_range", "supplier", "s_suppkey", "'s_acctbal'", "supplier", "s_acctbal < 0"),
    _row("foreign_key", "supplier", "s_suppkey", "CAST(s_nationkey AS VARCHAR)", "supplier", "s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)"),
]))
def dq_all(spark, d):
    supplier, nation = T.table(spark, d, "supplier"), T.table(spark, d, "nation")
    rows = Q.check_rows(supplier, "supplier", F.col("s_suppkey"), [Q.finite_range("s_acctbal", 0), Q.not_blank("s_name")])
    named = rows.withColumn("detail", F.split_part("detail", F.lit("="), F.lit(1)))
    return Q.union_violations(named, Q.foreign_key(supplier, "supplier", "s_suppkey", "s_nationkey", nation.where("n_regionkey <> 2"), "n_nationkey"))
