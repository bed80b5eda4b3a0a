"""Shards that keep landing: extensions of the batch operators to streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from duoscope.operators import audit


def arriving(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """Files that land in a folder, as a stream; a schema is needed, nothing is inferred."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def first_deliveries(stream: DataFrame, keys: list[str], time: str, late: str = "30 days") -> DataFrame:
    """Each id once, as long as its deliveries lie within the watermark: state is bounded by it."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def running_confusion(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Paired outcomes so far; the state is one row per group."""
    return audit.confusion(stream, keys)


def windowed_errors(stream: DataFrame, time: str, keys: list[str], width: str = "1 day", late: str = "30 days") -> DataFrame:
    """Calls and failed calls per window, closed when the watermark passes."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("calls"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def _folder(spark: SparkSession, target: str):
    """The file system of ``target`` and a maker of its paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(target).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, target: str) -> list[int]:
    """Batches whose list of buckets was finished."""
    fs, path = _folder(spark, target)
    if not fs.exists(path(target)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(target))]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("list="))


def _buckets(spark: SparkSession, target: str, version: int) -> dict[int, int]:
    """Which batch wrote each bucket last, as of a batch; a row per bucket."""
    rows = spark.read.text(f"{target}/list={version}").collect()
    return dict(tuple(map(int, r["value"].split())) for r in rows if r["value"])


def keep_latest(target: str, keys: list[str], order: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that keeps the newest row of each key below ``target``.

    Keys are dealt to buckets by hash.  A batch reads and writes only the
    buckets that its keys are in, and then lists which batch each bucket was
    written by last; that list appears at once, so that a batch that is tried
    again gives the same table and readers never see half of it.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fs, path = _folder(spark, target)
        before = [v for v in _versions(spark, target) if v < epoch]
        held = _buckets(spark, target, before[-1]) if before else {}
        mine = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        rows = batch.withColumn("_bucket", mine)
        touched = [r["_bucket"] for r in rows.select("_bucket").distinct().collect()]  # at most as many as there are buckets
        old = [f"{target}/version={held[b]}/_bucket={b}" for b in touched if b in held]
        if old:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumn("_bucket", mine))
        w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
        newest = rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
        newest.write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/version={epoch}")
        now = {**held, **dict.fromkeys(touched, epoch)}
        draft, done = path(f"{target}/draft"), path(f"{target}/list={epoch}")
        out = fs.create(draft, True)
        out.writeBytes("".join(f"{b} {v}\n" for b, v in sorted(now.items())))
        out.close()
        fs.delete(done, True)
        fs.rename(draft, done)
        # what neither this list nor the one before it names is no longer read
        for v in before[:-1]:
            fs.delete(path(f"{target}/list={v}"), True)
        used = set(held.items()) | set(now.items())
        for v in {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path(target)) if s.getPath().getName().startswith("version=")}:
            for s in fs.listStatus(path(f"{target}/version={v}")):
                name = s.getPath().getName()
                if name.startswith("_bucket=") and (int(name.split("=")[1]), v) not in used and v < epoch:
                    fs.delete(s.getPath(), True)

    return write


def read_latest(spark: SparkSession, target: str) -> DataFrame:
    """The table as the last finished batch left it."""
    version = _versions(spark, target)[-1]
    return spark.read.parquet(*[f"{target}/version={v}/_bucket={b}" for b, v in sorted(_buckets(spark, target, version).items())])
