"""Activity, history and streaming queries over ``events``."""

from pyspark.sql import functions as F

from signalloom.functions.numbers import round_half_up
from signalloom.operators import history as H
from signalloom.operators.rankings import newest
from signalloom.plans import tables as T
from signalloom.plans.registry import query
from signalloom.plans.sample import AS_OF

EV = f"""ev AS (SELECT event_id AS id, 'c' || user_id AS cluster_id, ts, event_type AS category,
  'g' || (user_id % 20) AS g, CAST(ts AS DATE) AS day,
  (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 3600000000.0 AS age FROM events)"""
RANGES = "ranges AS (SELECT * FROM (VALUES ('24H', 24), ('7D', 168), ('30D', 720)) r(\"range\", hours))"
GRID = "grid AS (SELECT DISTINCT g AS id FROM ev)"
ENTITY_RANGE = f"""{EV}, {RANGES}, {GRID}, counted AS (
  SELECT r."range", e.g AS id, count(*) FILTER (age < hours) AS n,
    count(*) FILTER (age >= hours) AS previous
  FROM ev e, ranges r WHERE age >= 0 AND age < 2 * hours GROUP BY ALL),
per AS (SELECT r."range", g.id, coalesce(n, 0) AS n, coalesce(previous, 0) AS previous,
    CASE WHEN 720 >= 2 * r.hours THEN CAST(coalesce(n, 0) - coalesce(previous, 0) AS DOUBLE) END AS delta,
    720 >= 2 * r.hours AS previous_complete
  FROM grid g CROSS JOIN ranges r LEFT JOIN counted c ON c."range" = r."range" AND c.id = g.id)"""


def _entity_range(spark, d):
    out = H.entity_range(T.events(spark, d), T.entity_groups(spark, d), AS_OF, 720)
    return out.withColumn("delta", F.col("delta").cast("double"))


@query("range_stats", f"WITH {ENTITY_RANGE} SELECT * FROM per")
def range_stats(spark, d):
    return _entity_range(spark, d)


@query("ranges_doc", f"""WITH {EV}, {RANGES} SELECT r."range", count(e.id) AS event_count,
  720 >= 2 * r.hours AS previous_complete FROM ranges r LEFT JOIN ev e ON age >= 0 AND age < hours
  GROUP BY r."range", r.hours""")
def ranges_doc(spark, d):
    return H.range_summary(T.events(spark, d), AS_OF, 720)


@query("category_range", f"""WITH {EV}, {RANGES} SELECT "range", category, count(*) AS n
  FROM ev, ranges WHERE age >= 0 AND age < hours GROUP BY ALL""")
def category_range(spark, d):
    return H.category_range(T.events(spark, d), AS_OF)


@query("top_entities", f"""WITH {ENTITY_RANGE} SELECT "range", CAST(rank AS INTEGER) AS rank, id, n, delta FROM (
  SELECT *, row_number() OVER (PARTITION BY "range" ORDER BY n DESC, id) AS rank FROM per WHERE n > 0) WHERE rank <= 8""")
def top_entities(spark, d):
    return H.top_entities(_entity_range(spark, d))


@query("daily_category_counts", f"WITH {EV} SELECT day AS \"date\", category, count(*) AS n FROM ev GROUP BY ALL")
def daily_category_counts(spark, d):
    return H.daily_category_counts(T.events(spark, d))


@query("map_counts", f"""WITH {EV}, c AS (SELECT day AS "date", category, count(*) AS n FROM ev GROUP BY ALL)
  SELECT "date", string_agg(category || '=' || n, ',' ORDER BY category) AS counts FROM c GROUP BY ALL""")
def map_counts(spark, d):
    maps = H.counts_as_map(H.daily_category_counts(T.events(spark, d)), "date", "category")
    pairs = F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return maps.select("date", F.array_join(F.sort_array(pairs), ",").alias("counts"))


@query("history_depth", f"""WITH {EV} SELECT min(day) AS first_day,
  floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(CAST(min(day) AS TIMESTAMP))) / 86400000000.0 * 10 + 0.5) / 10 AS history_depth_days
  FROM ev""")
def history_depth(spark, d):
    return H.history_depth(T.events(spark, d), AS_OF)


def _stored_history(spark, d):
    """The events as a stored history, written through the sink; its folder."""
    import uuid

    from signalloom.session import shared_folder
    from signalloom.sources.tables import upsert_days

    path = f"{shared_folder(spark)}/signalloom/history-{uuid.uuid4().hex}"
    upsert_days(T.events(spark, d).select("id", "category", "published_at", "collected_on"), path, "id")
    return path


@query("read_history", f"WITH {EV} SELECT category, count(*) AS n FROM ev WHERE day >= DATE '2024-01-20' GROUP BY ALL")
def read_history(spark, d):
    from signalloom.sources.readers import read_history as read

    return read(spark, _stored_history(spark, d), "2024-01-20").groupBy("category").agg(F.count("*").alias("n"))


@query("drop_expired", f"WITH {EV} SELECT day AS collected_on, count(*) AS n FROM ev WHERE day >= DATE '2024-01-21' GROUP BY ALL")
def drop_expired(spark, d):
    from signalloom.sources.tables import drop_expired as drop

    path = _stored_history(spark, d)
    drop(spark, path, AS_OF, 10)
    return spark.read.parquet(path).groupBy("collected_on").agg(F.count("*").alias("n"))


@query("prune_retention", f"WITH {EV} SELECT day AS collected_on, count(*) AS n FROM ev WHERE day >= DATE '2024-01-21' GROUP BY ALL")
def prune_retention(spark, d):
    kept = H.prune_retention(T.events(spark, d), AS_OF, 10)
    return kept.groupBy("collected_on").agg(F.count("*").alias("n"))


@query("write_documents", """SELECT 'events' AS dataset, event_type AS name, count(*) AS n FROM events GROUP BY ALL
  UNION ALL SELECT 'nations', n_name, 1 FROM nation""")
def write_documents(spark, d):
    import uuid

    from signalloom.session import shared_folder
    from signalloom.sources.tables import write_documents as write

    folder = f"{shared_folder(spark)}/signalloom/documents-{uuid.uuid4().hex}"
    events = T.events(spark, d).groupBy(F.col("category").alias("name")).agg(F.count("*").alias("n"))
    nations = T.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit(1).alias("n"))
    write({"events": events, "nations": nations}, folder)
    back = [spark.read.schema("name string, n bigint").json(f"{folder}/{x}").withColumn("dataset", F.lit(x)) for x in ("events", "nations")]
    return back[0].unionByName(back[1]).select("dataset", "name", "n")


def _landed(documents, name):
    """JSON documents, one a line, in a folder of the shared place."""
    import uuid

    from signalloom.session import shared_folder

    path = f"{shared_folder(documents.sparkSession)}/signalloom/{name}-{uuid.uuid4().hex}"
    documents.write.text(path)
    return path


def _customer_documents(spark, d):
    """Customers as entities of their nation, a hundred to a document; every seventh document breaks off in the middle."""
    customer, nation = T.table(spark, d, "customer"), T.table(spark, d, "nation")
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    node = F.struct(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), (F.col("c_nationkey") % 4).cast("int").alias("layer"),
                    (F.col("c_custkey") % 100).cast("int").alias("importance"), F.array(F.lower("c_name")).alias("match"))
    edge = F.struct(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("from"), F.col("n_name").alias("to"), F.lit("in").alias("type"))
    number = F.floor(F.col("c_custkey") / 100).alias("doc")
    grouped = rows.groupBy(number).agg(F.collect_list(node).alias("nodes"), F.collect_list(edge).alias("connections"))
    told = grouped.select("doc", F.to_json(F.struct("doc", "nodes", "connections")).alias("value"))
    cut = F.substring("value", 1, (F.length("value") / 2).cast("int"))
    return told.select(F.when(F.col("doc") % 7 == 3, cut).otherwise(F.col("value")).alias("value"))


@query("load_dims", """SELECT 'c' || c_custkey AS id, CAST(c_nationkey % 4 AS INTEGER) AS layer, CAST(c_custkey % 100 AS INTEGER) AS importance, lower(c_name) AS term, n_name AS dst
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE (c_custkey // 100) % 7 <> 3""")
def load_dims(spark, d):
    """Entities and edges landed as many documents and loaded back, spread over tasks; broken ones are left out."""
    from signalloom.sources import readers

    path = _landed(_customer_documents(spark, d), "entities")
    nodes, edges = readers.load_entities(spark, path, lines=True), readers.load_edges(spark, path, lines=True)
    return nodes.join(edges, F.col("id") == F.col("src")).select("id", "layer", "importance", F.element_at("match", 1).alias("term"), "dst")


@query("broken_dims", "SELECT DISTINCT CAST(c_custkey // 100 AS BIGINT) AS doc FROM customer WHERE (c_custkey // 100) % 7 = 3")
def broken_dims(spark, d):
    from signalloom.sources import readers

    path = _landed(_customer_documents(spark, d), "entities")
    documents = readers.load_documents(spark, path, True, nodes=readers.ENTITY_SCHEMA, connections=readers.EDGE_SCHEMA)
    return readers.broken_documents(documents).select(F.regexp_extract("document", r'"doc":(\d+)', 1).cast("bigint").alias("doc"))


@query("load_registry", """SELECT s_suppkey AS suppkey, 'm' || s_suppkey AS key, s_name AS name, n_name AS org, coalesce(l.n, 0) AS n
  FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) l ON l_suppkey = s_suppkey""")
def load_registry(spark, d):
    """Suppliers as tracked models, landed, loaded, and looked up by the line items' entity ids."""
    from signalloom.sources import readers

    supplier, nation = T.table(spark, d, "supplier"), T.table(spark, d, "nation")
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey").cast("string")
    model = F.struct(F.concat(F.lit("m"), key).alias("key"), F.col("s_name").alias("name"), F.col("n_name").alias("org"),
                     F.concat(F.lit("e"), key).alias("entity_id"), F.create_map(F.lit("forum"), F.col("s_name")).alias("queries"))
    documents = rows.groupBy((F.col("s_suppkey") % 10).alias("doc")).agg(F.collect_list(model).alias("models"))
    registry = readers.load_registry(spark, _landed(documents.select(F.to_json(F.struct("models")).alias("value")), "registry"), lines=True)
    counts = T.table(spark, d, "lineitem").groupBy(F.concat(F.lit("e"), F.col("l_suppkey").cast("string")).alias("entity_id")).agg(F.count("*").alias("n"))
    ids = registry.select("entity_id").join(counts, "entity_id", "left")
    found = readers.model_lookup(ids, registry)
    return found.select(F.substring("key", 2, 20).cast("bigint").alias("suppkey"), "key", F.element_at("queries", "forum").alias("name"), "org", F.coalesce("n", F.lit(0)).alias("n"))


@query("load_views", """WITH r AS (SELECT p_brand AS view, p_type AS item, CAST(max(p_size) AS DOUBLE) AS score FROM part GROUP BY ALL),
  k AS (SELECT *, rank() OVER (PARTITION BY view ORDER BY score DESC) AS rk, row_number() OVER (PARTITION BY view ORDER BY score DESC, item) - 1 AS ord FROM r),
  l AS (SELECT *, count(*) OVER (PARTITION BY view, rk) AS same FROM k)
  SELECT view, CAST(ord AS INTEGER) AS ord, item, CASE WHEN same > 1 THEN 'T-' ELSE '' END || CASE WHEN rk < 10 THEN '0' ELSE '' END || rk AS rank_label FROM l""")
def load_views(spark, d):
    """Brands as curated rankings of part types: landed, loaded, and labelled by :func:`rankings.rank_with_ties`."""
    from pyspark.sql import Window

    from signalloom.operators.rankings import rank_with_ties
    from signalloom.sources import readers

    scores = T.table(spark, d, "part").groupBy(F.col("p_brand").alias("view"), F.col("p_type").alias("item")).agg(F.max("p_size").cast("double").alias("score"))
    ranked = scores.withColumn("rank", F.rank().over(Window.partitionBy("view").orderBy(F.desc("score"))))
    row = F.struct(F.col("rank").alias("_r"), "item", "rank", "score")
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda r: F.struct(r["rank"].alias("rank"), r["item"].alias("item"), r["score"].alias("score")))
    views = ranked.groupBy("view").agg(rows.alias("rows"))
    documents = views.select(F.to_json(F.struct(F.array(F.struct("view", "rows")).alias("views"))).alias("value"))
    loaded = readers.load_views(spark, _landed(documents, "views"), lines=True)
    return rank_with_ties(loaded.withColumn("w", F.lit(None).cast("double"))).select("view", "ord", "item", "rank_label")


@query("days_ago", f"SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY")
def days_ago(spark, d):
    from signalloom.functions.dates import days_ago as ago

    return T.events(spark, d).where(F.col("published_at") >= ago(10, AS_OF)).select("id")


DOCUMENT = f"""{ENTITY_RANGE},
  t AS (SELECT "range", id, n, row_number() OVER (PARTITION BY "range" ORDER BY n DESC, id) AS rank FROM per WHERE n > 0),
  s AS (SELECT day, category, count(*) AS n FROM ev GROUP BY ALL),
  dp AS (SELECT (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(CAST(min(day) AS TIMESTAMP))) / 3600000000.0 AS hours_held FROM ev)
  SELECT r."range", (SELECT count(*) FROM ev WHERE age >= 0 AND age < hours) AS event_count, hours_held >= 2 * hours AS previous_complete, floor(hours_held / 24.0 * 10 + 0.5) / 10 AS history_depth_days,
    (SELECT string_agg(id || ':' || n || ':' || previous, ',' ORDER BY id) FROM per p WHERE p."range" = r."range") AS entities,
    (SELECT string_agg(category || ':' || n, ',' ORDER BY category) FROM (SELECT category, count(*) AS n FROM ev WHERE age >= 0 AND age < hours GROUP BY ALL)) AS categories,
    (SELECT string_agg(rank || ':' || id, ',' ORDER BY rank) FROM t WHERE t."range" = r."range" AND rank <= 8) AS top,
    (SELECT string_agg(CAST(day AS VARCHAR) || ':' || category || ':' || n, ',' ORDER BY day, category) FROM s) AS daily
  FROM ranges r CROSS JOIN dp"""


@query("ranges_document", f"WITH {DOCUMENT}")
def ranges_document(spark, d):
    doc = H.ranges_document(T.events(spark, d), T.entity_groups(spark, d), AS_OF)
    told = lambda c, *fields: F.array_join(F.transform(c, lambda e: F.concat_ws(":", *[e[f].cast("string") for f in fields])), ",").alias(c)
    return doc.select(
        "range", "event_count", "previous_complete", "history_depth_days", told("entities", "id", "n", "previous"),
        told("categories", "category", "n"), told("top", "rank", "id"), told("daily", "date", "category", "n"),
    )


def _last(events, kind):
    row = F.max_by(F.struct("cluster_id", "category", "id"), F.struct("published_at", "id")).alias("r")
    return events.where(F.col("category") == kind).groupBy("cluster_id").agg(row).select("r.*")


@query("upsert_today", f"""WITH {EV}, k AS (SELECT cluster_id, category, id,
    row_number() OVER (PARTITION BY cluster_id, category ORDER BY ts DESC, id DESC) AS rn FROM ev),
  old AS (SELECT * FROM k WHERE rn = 1 AND category = 'view'), fresh AS (SELECT * FROM k WHERE rn = 1 AND category = 'purchase')
  SELECT coalesce(f.cluster_id, o.cluster_id) AS cluster_id, coalesce(f.category, o.category) AS category, coalesce(f.id, o.id) AS id
  FROM old o FULL JOIN fresh f ON o.cluster_id = f.cluster_id""")
def upsert_today(spark, d):
    events = T.events(spark, d)
    return H.merge_today(_last(events, "view"), _last(events, "purchase"))


@query("compact_event", """SELECT event_id AS id, 'c' || user_id AS cluster_id, event_type AS category, ts AS published_at,
  'g' || (user_id % 20) AS entities FROM events""")
def compact_event(spark, d):
    blank = F.lit(None)
    shaped = T.events(spark, d).withColumns(
        {"title": blank.cast("string"), "family": blank.cast("string"), "significance": blank.cast("int"),
         "source_count": blank.cast("int"), "verification": blank.cast("string")}
    )
    return H.compact_event(shaped).select(
        "id", "cluster_id", "category", "published_at", F.array_join("entity_ids", ",").alias("entities")
    )


@query("latest_per_cluster", f"""WITH {EV} SELECT cluster_id, max(day) AS collected_on FROM ev GROUP BY ALL""")
def latest_per_cluster(spark, d):
    return H.latest_per_cluster(T.events(spark, d)).select("cluster_id", "collected_on")


@query("window_filter", """SELECT event_type AS category, count(*) AS n FROM events
  WHERE ts > TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-17 00:00:00' GROUP BY ALL""")
def window_filter(spark, d):
    start, end = (F.lit(x).cast("timestamp") for x in ("2024-01-10 00:00:00", "2024-01-17 00:00:00"))
    return T.events(spark, d).where(H.in_window(F.col("published_at"), start, end)).groupBy("category").agg(
        F.count("*").alias("n")
    )


@query("staleness_filter", f"WITH {EV} SELECT category, count(*) AS n FROM ev WHERE age <= 240 GROUP BY ALL")
def staleness_filter(spark, d):
    kept = H.staleness_filter(T.events(spark, d), AS_OF, 10)
    return kept.groupBy("category").agg(F.count("*").alias("n"))


@query("activity_norm", f"""WITH {ENTITY_RANGE}, w AS (SELECT id, n, delta FROM per WHERE "range" = '7D'),
  top AS (SELECT id FROM w WHERE n > 0 ORDER BY n DESC, id LIMIT 4)
  SELECT id, n, {"floor(n / greatest((SELECT max(n) FROM w), 1) * 1000000.0 + 0.5) / 1000000.0"} AS norm,
    greatest((SELECT max(abs(delta)) FROM w), 1) AS max_abs_delta, id IN (SELECT id FROM top) AS is_top FROM w""")
def activity_norm(spark, d):
    week = _entity_range(spark, d).where("`range` = '7D'").select("id", "n", "delta")
    return H.activity_levels(week).withColumn("norm", round_half_up(F.col("norm"), 6))


@query("most_active", f"""WITH {ENTITY_RANGE} SELECT id, n FROM per WHERE "range" = '7D' AND n > 0 ORDER BY n DESC, id LIMIT 5""")
def most_active(spark, d):
    return H.most_active(_entity_range(spark, d).where("`range` = '7D'").select("id", "n"))


@query("river", "SELECT event_id AS id, ts AS published_at FROM events ORDER BY ts DESC, event_id LIMIT 24 OFFSET 16")
def river(spark, d):
    return newest(T.events(spark, d).select("id", "published_at"), "published_at", "id", 24, 16)


@query("pool_newest_first", """SELECT event_id AS id, row_number() OVER (ORDER BY ts DESC, event_id) - 1 AS pos FROM events""")
def pool_newest_first(spark, d):
    from signalloom.operators.clusters import with_positions

    return with_positions(T.events(spark, d).select("id", "published_at"), F.col("published_at").desc(), F.col("id")).select("id", "pos")


# ---- streaming: the landed file is polled and read to its end ---------------
def _drain(spark, d, shape, keys, value="n"):
    """Run a streaming aggregation over the landed events and return its last state."""
    from signalloom.session import shared_folder
    from signalloom.streaming.jobs import stream_ingest
    import uuid

    base = f"{shared_folder(spark)}/signalloom/stream-{uuid.uuid4().hex}"
    schema = T.table(spark, d, "events").schema
    source = stream_ingest(spark, f"{d}/events*.parquet", schema)
    out = shape(source)

    def land(batch, number):
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")

    job = (
        out.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    job.awaitTermination()
    landed = spark.read.parquet(f"{base}/out")
    return landed.groupBy(*keys).agg(F.max_by(value, "_batch").alias(value))


@query("stream_daily_counts", "SELECT CAST(ts AS DATE) AS \"date\", event_type AS category, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, d):
    from signalloom.streaming.jobs import stream_daily_counts as counts

    return _drain(spark, d, lambda s: counts(s, "ts", "event_type", "40 days"), ["date", "category"])


@query("stream_range_counts", """SELECT w AS until, event_type AS category, count(*) AS n FROM (
  SELECT event_type, unnest(generate_series(date_trunc('hour', ts) + INTERVAL 1 HOUR, date_trunc('hour', ts) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS w
  FROM events) GROUP BY ALL""")
def stream_range_counts(spark, d):
    from signalloom.streaming.jobs import stream_range_counts as counts

    return _drain(spark, d, lambda s: counts(s, "ts", "event_type", delay="40 days"), ["until", "category"])


@query("stream_dedupe", "SELECT event_type AS category, count(DISTINCT user_id) AS n FROM events GROUP BY ALL")
def stream_dedupe(spark, d):
    from signalloom.streaming.jobs import stream_dedupe as dedupe

    def shape(s):
        keyed = s.withColumn("k", F.concat_ws("|", "event_type", F.col("user_id").cast("string")))
        return dedupe(keyed, "k", "ts", "60 days").select("k", "event_type", F.lit(1).alias("n"))

    firsts = _drain(spark, d, shape, ["k", "event_type"])
    return firsts.groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n"))


@query("stream_ingest", "SELECT event_id AS id, event_type AS category, 1 AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def stream_late(spark, d):
    from signalloom.streaming.jobs import stream_late_drop

    def shape(s):
        kept = stream_late_drop(s, "ts", 16, AS_OF)
        return kept.select(F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.lit(1).alias("n"))

    return _drain(spark, d, shape, ["id", "category"])


@query("stream_daily_upsert", """SELECT CAST(ts AS DATE) AS collected_on, user_id, max(event_id) AS event_id FROM events GROUP BY ALL""")
def stream_daily_upsert(spark, d):
    import uuid

    from signalloom.session import shared_folder
    from signalloom.streaming.jobs import stream_daily_upsert as upsert, stream_ingest

    base = f"{shared_folder(spark)}/signalloom/upsert-{uuid.uuid4().hex}"
    schema = T.table(spark, d, "events").schema
    source = stream_ingest(spark, f"{d}/events*.parquet", schema).select("event_id", "user_id", "ts")
    upsert(source, f"{base}/out", "user_id", "ts", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("collected_on", "user_id", "event_id")


@query("stream_change_gate", "SELECT max(event_id) AS version FROM events")
def stream_change_gate(spark, d):
    """The gate runs twice over the landed events; the second run finds nothing newer."""
    import uuid

    from signalloom.session import shared_folder
    from signalloom.streaming.jobs import last_version, stream_change_gate as gate, stream_ingest

    base = f"{shared_folder(spark)}/signalloom/gate-{uuid.uuid4().hex}"
    schema = T.table(spark, d, "events").schema
    for run in ("first", "second"):
        source = stream_ingest(spark, f"{d}/events*.parquet", schema)
        checkpoint = f"{base}/{run}"
        done = f"{base}/state"
        job = gate(source, done, "event_id", lambda v: None).option("checkpointLocation", checkpoint)
        job.trigger(availableNow=True).start().awaitTermination()
    last_version(spark, done)
    return spark.read.parquet(f"{done}-version").select("version")
