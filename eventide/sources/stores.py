"""Stores: partitioned Parquet tables of bars, features, events, returns, graphs and records, written and scanned by Spark."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.operators.joins import overlay_join
from eventide.sources.bars import read_bar_csv, write_bars


def scan_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars below a path, at any depth, of any mix of schemas: columns that some files lack are null there."""
    return spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(path)


#: Names under which a dataset may be found, the best first.
ALIASES = {"panel": ("full", "pilot", "smoke")}


def resolved(spark: SparkSession, root: str, name: str) -> tuple[str, DataFrame]:
    """The dataset of a name or alias below root: the first of the alias's candidates that has files. Returns which it is,
    as only a full panel counts as evidence."""
    tried = ALIASES.get(name, (name,))
    for candidate in tried:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{candidate}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return candidate, scan_bars(spark, f"{root}/{candidate}")
    raise FileNotFoundError(f"none of {', '.join(tried)} below {root}")


def load_panel(spark: SparkSession, path: str, overlay: str | None, days: list[str], columns: list[str]) -> DataFrame:
    """Some days and columns of a panel, with an overlay's columns joined on instrument, day and clock; repeated keys of an
    overlay are an error."""
    keys = ["instrument_id", "trading_date", "minute_of_day"]
    panel = spark.read.parquet(path).filter(F.col("trading_date").isin(*days))
    if overlay:
        more = spark.read.parquet(overlay).filter(F.col("trading_date").isin(*days))
        panel = overlay_join(panel, more.select(*keys, *[c for c in more.columns if c not in panel.columns]), keys)
    return panel.select(*columns)


def write_partitioned(df: DataFrame, path: str, keys: list[str]) -> None:
    """Partitioned by keys; only partitions that df has are replaced. Rows are dealt by key and a salt, so that a partition
    has a few files and no task a whole large partition."""
    dealt = df.repartition(*keys, F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys][:2]), F.lit(4)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*keys).parquet(path)


def write_missing_days(rows: DataFrame, path: str, day: str) -> int:
    """Appends the days that the table at `path` doesn't have yet and returns their number; a run over days that are all there
    writes nothing. A day is there once it has a row: days are written whole, so that a run that was cut short is taken up
    where it ended."""
    spark = rows.sparkSession
    if _exists(spark, path):
        rows = rows.join(spark.read.schema(rows.schema).parquet(path).select(day).distinct(), day, "left_anti")
    days = rows.select(day).distinct().count()
    if days:
        write_partitioned(rows, path, [day])
    return days


def write_job_returns(returns: DataFrame, path: str, batch_id: str, stage: str) -> None:
    write_partitioned(returns.withColumn("batch_id", F.lit(batch_id)).withColumn("stage", F.lit(stage)), path, ["batch_id", "stage", "job_id"])


def read_job_returns(spark: SparkSession, path: str, batch_id: str, stage: str, job_ids: list[str] | None = None) -> DataFrame:
    """Returns of a stage, of some jobs: batch, stage and job prune the scan."""
    r = spark.read.parquet(path).filter((F.col("batch_id") == batch_id) & (F.col("stage") == stage))
    return r.filter(F.col("job_id").isin(*job_ids)) if job_ids is not None else r


def write_features(features: DataFrame, path: str, version: str) -> None:
    """A feature version's days; days that are there already and in `features` too are replaced."""
    write_partitioned(features.withColumn("version", F.lit(version)), path, ["version", "session_date"])


def read_features(spark: SparkSession, path: str, version: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("version") == version).select(*columns)


def append_experiment(rows: DataFrame, path: str, experiment_id: str) -> None:
    """Events or outcomes of an experiment, beside those of others."""
    rows.withColumn("experiment_id", F.lit(experiment_id)).write.mode("append").partitionBy("experiment_id").parquet(path)


def append_records(records: DataFrame, path: str) -> None:
    """A log of records, one JSON object a line, with the time of writing."""
    records.withColumn("recorded_at", F.current_timestamp()).write.mode("append").json(path)


def search_records(spark: SparkSession, path: str, text: str, limit: int | None = 50) -> DataFrame:
    """Records that contain the text in any column, in any case; the latest `limit` ones."""
    r = spark.read.json(path)
    said = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in r.columns if c != "recorded_at"]))
    found = r.filter(F.contains(said, F.lit(text.lower())))
    return found if limit is None else found.orderBy(F.desc("recorded_at")).limit(limit)


def write_graph(edges: DataFrame, lineage: DataFrame, path: str) -> None:
    """Edges by week, and what they were made from."""
    write_partitioned(edges, f"{path}/edges", ["as_of"])
    write_partitioned(lineage, f"{path}/lineage", ["as_of"])


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/lineage")


def write_news_cache(news: DataFrame, path: str) -> None:
    """Insights by month, publication times as text in UTC."""
    said = F.date_format("published_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    write_partitioned(news.withColumn("month", F.to_date(F.date_trunc("month", "published_ts"))).withColumn("published", said).drop("published_ts"), path, ["month"])


def read_news_cache(spark: SparkSession, path: str) -> DataFrame:
    """The months of a cache as one table, publication times to the microsecond."""
    n = spark.read.parquet(path)
    return n.withColumn("published_ts", F.to_timestamp_ntz("published", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))).drop("published")


def manifest_status(spark: SparkSession, path: str) -> DataFrame:
    """Landed manifests (JSON lines: file, status, bytes, rows, seconds) by the last status of each file."""
    m = spark.read.schema("file string, status string, bytes long, rows long, seconds double, at string").json(path)
    last = m.groupBy("file").agg(F.max_by(F.struct("status", "bytes", "rows", "seconds"), "at").alias("m")).select("file", "m.*")
    return last.groupBy("status").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.try_divide(F.sum("bytes"), F.sum("seconds")).alias("bytes_per_second"))


def ingest_progress(spark: SparkSession, path: str, expected: int) -> DataFrame:
    """One row over landed manifests (JSON lines: file, status, conversion, bytes, rows, at), by the last line of each file:
    files expected, downloaded, converted and failed, bytes, rows, files a second between the first and the last
    download, and the seconds that the rest will take at that rate."""
    m = spark.read.schema("file string, status string, conversion string, bytes long, rows long, at string").json(path)
    last = m.groupBy("file").agg(F.max_by(F.struct("status", "conversion", "bytes", "rows", "at"), "at").alias("m")).select("m.*")
    done, converted = F.col("status").isin("downloaded", "skipped_verified"), F.col("conversion") == "ok"
    failed = (F.col("status") == "failed") | F.coalesce(F.col("conversion") == "failed", F.lit(False))
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0).cast("long"))
    at = F.when(done, F.unix_micros(F.try_to_timestamp("at")))
    s = last.agg(
        F.lit(expected).cast("long").alias("expected"), F.count_if(done).alias("downloaded"), F.count_if(converted).alias("converted"), F.count_if(failed).alias("failed"),
        total("bytes", done).alias("bytes"), total("rows", converted).alias("rows"), ((F.max(at) - F.min(at)) / 1e6).alias("_elapsed"),
    )
    s = s.withColumn("files_per_second", F.try_divide("downloaded", "_elapsed"))
    return s.withColumn("seconds_left", F.try_divide(F.greatest(F.lit(0), F.col("expected") - F.col("downloaded")), F.col("files_per_second"))).drop("_elapsed")


def spec_hash(spec: dict) -> str:
    """SHA-256 of a specification as JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def manifest_hash(files: DataFrame) -> DataFrame:
    """files(path, length, modificationTime), as the binaryFile source gives them: one digest of all, whatever their order,
    as the sum of the files' own digests."""
    one = F.conv(F.substring(F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.sha2(F.coalesce(F.sum(one), F.lit(0)).cast("string"), 256).alias("digest"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def new_files(spark: SparkSession, landed: str, manifest: str) -> DataFrame:
    """path, length, modified of landed files (a pattern) that the manifest doesn't have in this very form: new and changed
    ones. File contents aren't read."""
    files = spark.read.format("binaryFile").load(landed).select("path", "length", F.col("modificationTime").alias("modified"))
    if not _exists(spark, manifest):
        return files
    done = spark.read.schema("path string, length long, modified timestamp").parquet(manifest)
    return files.join(done, ["path", "length", "modified"], "left_anti")


def convert_landed(spark: SparkSession, landed: str, path: str, manifest: str) -> int:
    """Landed day files (gzip CSV, a file holds whole days) to the day-partitioned store; returns how many files were read.

    Files that are there in the same form aren't read again; a changed one replaces its days and no others. The manifest is
    written after the store: a run that is cut short repeats its files and ends with the same store."""
    fresh = new_files(spark, landed, manifest)
    seen = fresh.collect()  # a name and form a file of this run, as they were before reading
    if seen:
        write_bars(read_bar_csv(spark, [r.path for r in seen]), path)
        spark.createDataFrame([tuple(r) for r in seen], fresh.schema).write.mode("append").parquet(manifest)
    return len(seen)
