"""Reading landed files, dimensions and the event history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def optional_source(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "json", **options) -> DataFrame:
    """The dataset, or no rows of its declared schema when it is absent."""
    try:
        return spark.read.format(fmt).schema(schema).options(**options).load(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def read_history(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Retained event partitions; unreadable files are skipped (see :func:`skipped_files`), old days pruned."""
    events = spark.read.option("ignoreCorruptFiles", "true").parquet(path)
    return events if since is None else events.where(F.col("collected_on") >= F.to_date(F.lit(since)))


def _named(path) -> F.Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def stored_schemas(files: DataFrame) -> DataFrame:
    """``path, content`` of Parquet files to ``path, readable, columns`` (name and type), read from their footers in tasks."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            readable, columns = [], []
            for content in batch.column("content"):
                try:
                    schema = pq.read_schema(pa.BufferReader(content.as_buffer()))
                    readable.append(True)
                    columns.append([{"name": f.name, "type": str(f.type)} for f in schema])
                except (pa.ArrowInvalid, OSError):
                    readable.append(False)
                    columns.append([])
            kind = pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(readable), pa.array(columns, kind)], names=["path", "readable", "columns"])

    return files.select("path", "content").mapInArrow(run, "path string, readable boolean, columns array<struct<name:string,type:string>>")


def skipped_files(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """``(file, length)`` of the stored files that :func:`read_history` could not read.

    Files that gave a row are sound; of the few others the footers are read, as sound files may hold no row.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    files = listed.withColumn("_day", F.to_date(F.regexp_extract("path", "collected_on=([0-9-]+)", 1)))
    if since is not None:
        files = files.where(F.col("_day") >= F.to_date(F.lit(since)))
    read = read_history(spark, path, since).select(_named(F.input_file_name()).alias("file")).distinct()
    silent = files.select(_named(F.col("path")).alias("file"), "path", "length").join(read, "file", "left_anti")
    contents = listed.join(silent.select("path"), "path", "left_semi")
    broken = stored_schemas(contents).where("NOT readable").select("path")
    return silent.join(broken, "path", "left_semi").select("file", "length")


ENTITY_SCHEMA = (
    "id string, name string, version string, org string, layer int, importance int, "
    "match array<string>, why string, links array<struct<label:string,url:string>>"
)
EDGE_SCHEMA = "`from` string, `to` string, type string"
MODEL_SCHEMA = (
    "key string, name string, brand string, org string, version string, version_label string, entity_id string, queries map<string,string>"
)
VIEW_SCHEMA = (
    "view string, snapshot string, rows array<struct<rank:int,item:string,org:string,score:double,unit:string,stat:string,note:string,pct:double>>"
)
_CORRUPT = "_corrupt_record"


def load_documents(spark: SparkSession, path: str, lines: bool = False, **arrays: str) -> DataFrame:
    """Documents with the named arrays (name to DDL of an element), one row a document, beside ``_corrupt_record``.

    ``path`` is a file, a folder or a pattern.  A file is one document, or, with ``lines``, one document a
    line: large dimensions are landed that way, and their files are split over tasks.
    """
    shape = ", ".join(f"{name} array<struct<{_as_struct(ddl)}>>" for name, ddl in arrays.items()) + f", {_CORRUPT} string"
    texts = spark.read.text(path, wholetext=not lines).where(F.length(F.trim("value")) > 0)
    parsed = F.from_json("value", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    return texts.select(parsed.alias("d")).select("d.*")


def broken_documents(documents: DataFrame) -> DataFrame:
    """The text of documents that are no JSON, or whose arrays are not of the declared type."""
    return documents.where(F.col(_CORRUPT).isNotNull()).select(F.col(_CORRUPT).alias("document"))


def load_entities(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The entity dimension from documents with a ``nodes`` array."""
    return load_documents(spark, path, lines, nodes=ENTITY_SCHEMA).select(F.inline("nodes"))


def load_edges(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    found = load_documents(spark, path, lines, connections=EDGE_SCHEMA).select(F.inline("connections"))
    return found.select(F.col("from").alias("src"), F.col("to").alias("dst"), "type")


def load_registry(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The model registry from documents with a ``models`` array."""
    return load_documents(spark, path, lines, models=MODEL_SCHEMA).select(F.inline("models"))


def load_views(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Curated views (rankings and shares) from documents with a ``views`` array: one row per listed item, ``ord`` its place."""
    found = load_documents(spark, path, lines, views=VIEW_SCHEMA).select(F.inline("views"))
    return found.select("view", "snapshot", F.posexplode("rows").alias("ord", "_row")).select("view", "snapshot", "ord", "_row.*")


def _as_struct(ddl: str) -> str:
    fields = T.StructType.fromDDL(ddl).fields
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in fields)


def entity_rules(entities: DataFrame, at_most: int = 1_000) -> list[dict]:
    """The curated dimension as literals for the plan; its size is checked."""
    rows = entities.select("id", "importance", "match").limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"more than {at_most} entities are no plan as literals; use operators.entities.link_terms, a join")
    return [r.asDict() for r in rows]


def model_lookup(ids: DataFrame, registry: DataFrame, key: str = "entity_id") -> DataFrame:
    """Registry row of each entity id, null when it is not a tracked model."""
    return ids.join(registry, key, "left")


def union_feeds(*feeds: DataFrame) -> DataFrame:
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    return out
