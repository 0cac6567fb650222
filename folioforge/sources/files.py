"""JSON, JSON-lines, Parquet and text sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge import schemas
from folioforge.operators.store import preferred, upsert

#: File names of a document's folder in order of preference.
VARIANTS = {"text": ("text_enriched", "text_clean", "text"), "table": ("table_normalized", "table_clean", "table")}
KINDS = {"metadata": schemas.META, "text": schemas.TEXT, "table": schemas.TABLE, "image": schemas.IMAGE}


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON; a missing path is an error."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_if_exists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Like ``read_json``; an empty table of the schema where the path is missing."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return read_json(spark, path, schema) if found is not None and len(found) else spark.createDataFrame([], schema)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_jsonl(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(by) if by else w).json(path)


def append_log(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append to a log partitioned by the UTC date of ``ts``."""
    append_jsonl(df.withColumn("dt", F.to_date(ts)), path, "dt")


def read_log_days(spark: SparkSession, path: str, schema: str, first: str, last: str) -> DataFrame:
    """The log's days from ``first`` to ``last``; other days' folders are pruned."""
    return spark.read.schema(f"{schema}, dt date").option("mode", "DROPMALFORMED").json(path).where(F.col("dt").between(first, last))


def read_bundles(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Rows of all documents' folders under ``root``: per document the preferred file variant; doc_id, where a row lacks it,
    from the folder's name."""
    if kind not in VARIANTS:
        return _with_folder(read_json_if_exists(spark, f"{root}/*/{kind}.json", KINDS[kind]))
    parts = [_with_folder(read_json_if_exists(spark, f"{root}/*/{name}.json", KINDS[kind])).withColumn("variant", F.lit(k)) for k, name in enumerate(VARIANTS[kind])]
    return preferred(reduce(DataFrame.unionByName, parts), "folder", F.col("variant")).drop("variant")


def _with_folder(df: DataFrame) -> DataFrame:
    folder = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    return df.withColumn("folder", folder).withColumn("doc_id", F.coalesce("doc_id", "folder"))


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """doc_id and name of every file one level below ``root``; contents are not read."""
    paths = spark.read.format("binaryFile").load(f"{root}/*/*").select("path")
    return paths.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("doc_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))


def write_bundle(tables: dict[str, DataFrame], root: str) -> None:
    """One JSON dataset per kind."""
    for kind, df in tables.items():
        df.write.mode("overwrite").json(f"{root}/{kind}")


def write_markdown(pages: DataFrame, root: str) -> None:
    """One text dataset a document, partitioned by doc_id, pages in order."""
    rows = pages.repartition("doc_id").sortWithinPartitions("doc_id", "page").select("doc_id", F.col("markdown").alias("value"))
    rows.write.mode("overwrite").partitionBy("doc_id").text(root)


def upsert_parquet(spark: SparkSession, path: str, new: DataFrame, key: str = "id") -> None:
    """Upsert by key into a Parquet store by writing its next version beside the last; the one before the last is kept for its
    readers, older ones go. Each call writes the whole store, so batches should be large."""
    jvm = spark.sparkContext._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(hadoop)
    done = sorted(int(s.getPath().getName()[1:]) for s in (fs.listStatus(base) if fs.exists(base) else []) if s.getPath().getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    merged = upsert(spark.read.parquet(f"{path}/v{done[-1]}"), new, key) if done else new
    merged.write.mode("overwrite").parquet(f"{path}/v{done[-1] + 1 if done else 1}")
    for old in done[:-1]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(base, f"v{old}"), True)


def rebuild_parquet(path: str, rows: DataFrame) -> None:
    """Truncate a store and write it anew from ``rows``, as its first version."""
    spark = rows.sparkSession
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(base, True)
    rows.write.parquet(f"{path}/v1")


def tail(log: DataFrame, n: int, ts: str = "ts") -> DataFrame:
    """The last ``n`` rows of a log in the order in which they were written."""
    return log.orderBy(F.desc(ts)).limit(n).orderBy(ts)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a store."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName()[1:]) for s in fs.listStatus(base) if s.getPath().getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{path}/v{max(done)}")


def page_range(spec: Column, last: Column) -> Column:
    """Pages of ``all``, ``a-b`` or ``p,q``."""
    span = F.sequence(F.split(spec, "-")[0].try_cast("int"), F.least(last, F.split(spec, "-")[1].try_cast("int")))
    some = F.array_compact(F.transform(F.split(spec, ","), lambda p: F.trim(p).try_cast("int")))
    return F.when(F.lower(F.trim(spec)) == "all", F.sequence(F.lit(1), last)).when(spec.rlike(r"^\s*\d+-\d+\s*$"), span).otherwise(some)
