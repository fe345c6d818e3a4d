"""Sinks: replace by partition, insert or ignore, upsert, and records of what is done."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lookups import new_rows, pending


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# Signs that names of partition folders have in hexadecimal.
_ESCAPED = frozenset("\"#%'*/:=?\\{[]^\x7f")


def _folder(value) -> str:
    """A partition's value as its folder has it."""
    return "".join(f"%{ord(c):02X}" if c in _ESCAPED or c < " " else c for c in str(value))


def partition_path(path: str, **keys) -> str:
    return "/".join([path, *(f"{c}={_folder(v)}" for c, v in keys.items())])


def drop_partition(spark: SparkSession, path: str, **keys) -> None:
    _delete(spark, partition_path(path, **keys))


def replace_partitions(df: DataFrame, path: str, *by: str, only: dict[str, object] | None = None) -> None:
    """Write df over the partitions that it has rows of; others stay. `only` names the partition that df is all of: it is
    emptied if df is."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    if only:
        kept = df
        for c, v in only.items():
            kept = kept.where(F.col(c) == F.lit(v))
        if kept.isEmpty():
            drop_partition(df.sparkSession, path, **{c: only[c] for c in by if c in only})


def insert_new(df: DataFrame, path: str, keys: list[str], *order: str) -> None:
    """Append rows whose key the table doesn't have."""
    spark = df.sparkSession
    there = spark.read.parquet(path) if exists(spark, path) else df.limit(0)
    new_rows(df, there, keys, *order).write.mode("append").parquet(path)


def upsert_partition(df: DataFrame, path: str, keys: list[str], by: str) -> None:
    """Replace rows of the same key, within the partitions that df touches; the new state of those is written aside, then put in place."""
    spark = df.sparkSession
    if not exists(spark, path):
        return replace_partitions(df, path, by)
    there = spark.read.parquet(path).join(df.select(by).distinct(), by, "left_semi").join(df.select(*keys), keys, "left_anti")
    whole = there.unionByName(df, allowMissingColumns=True)
    # Aside first, under a name of its own: what is read isn't overwritten, and writers don't meet there.
    aside = f"{path}.next-{uuid.uuid4().hex}"
    whole.write.parquet(aside)
    replace_partitions(spark.read.schema(whole.schema).parquet(aside), path, by)
    _delete(spark, aside)
    return None


def holds(rows: DataFrame, **keys) -> bool:
    """Whether there is a row with these values; the first one found ends the search."""
    for c, v in keys.items():
        rows = rows.where(F.col(c) == F.lit(v))
    return not rows.isEmpty()


def files_of(listed: DataFrame, period: str) -> DataFrame:
    """The files (name, partition) that a period is read from: of history:SNAPSHOT:YYYY-MM those of the month, of history-year:SNAPSHOT:YYYY those of the
    year's months, and those of the year as a whole."""
    last = period.rsplit(":", 1)[-1]
    return listed.where((F.col("partition") == last) | F.startswith("partition", F.lit(f"{last}-")) | (F.col("partition") == last[:4]))


def write_status(spark: SparkSession, path: str, job: str, **what) -> None:
    """Add a line on a job to a table of its states; the latest line is its state."""
    row = spark.createDataFrame([(job, json.dumps(what, default=str, sort_keys=True))], "job string, state string")
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def status(spark: SparkSession, path: str) -> DataFrame:
    """job, state, at: the latest line of each job."""
    return spark.read.parquet(path).groupBy("job").agg(F.max_by("state", "at").alias("state"), F.max("at").alias("at"))


def run_pending(spark: SparkSession, listed: DataFrame, manifest: str, key: str, work) -> int:
    """Call work(rows to do) for what the manifest doesn't list, then list it: a run that was stopped goes on where it was."""
    done = spark.read.parquet(manifest) if exists(spark, manifest) else listed.select(key).limit(0)
    todo = pending(listed, done, key)
    n = todo.count()
    if n:
        work(todo)
        todo.select(key, F.current_timestamp().alias("done_at")).write.mode("append").parquet(manifest)
    return n


class SomeFailed(RuntimeError):
    """What failed of several units of work, by key; the others are done."""

    def __init__(self, failed: dict[str, Exception]) -> None:
        super().__init__("; ".join(f"{k}: {str(e).splitlines()[0] if str(e) else type(e).__name__}" for k, e in sorted(failed.items())))
        self.failed = failed


def run_each(spark: SparkSession, keys: Iterable[str], work: Callable[[str], object], done: Callable[[str, object], None] = lambda key, found: None, workers: int = 3) -> dict[str, object]:
    """work(key) for each key, `workers` at a time, from threads of the driver; done(key, result) in this one as each ends. Returns the results.

    The jobs of a key have its tag, and a pool of its own where the scheduler is a fair one: keys share the cluster evenly. A key that fails has what it still runs cancelled, and
    no other is touched; when all have ended, SomeFailed says which did."""
    context = spark.sparkContext

    def one(key: str) -> object:
        tag = f"unit-{uuid.uuid4().hex}"
        context.setLocalProperty("spark.scheduler.pool", tag)
        context.addJobTag(tag)
        try:
            return work(key)
        except BaseException:
            context.cancelJobsWithTag(tag)
            raise
        finally:
            context.removeJobTag(tag)
            context.setLocalProperty("spark.scheduler.pool", None)

    found: dict[str, object] = {}
    failed: dict[str, Exception] = {}
    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        running = {pool.submit(inheritable_thread_target(spark)(one), key): key for key in keys}
        for future in as_completed(running):
            key = running[future]
            try:
                found[key] = future.result()
                done(key, found[key])
            except Exception as e:  # noqa: BLE001
                failed[key] = e
    if failed:
        raise SomeFailed(failed)
    return found


def run_pending_each(spark: SparkSession, listed: DataFrame, manifest: str, key: str, work: Callable[[str], object], workers: int = 3) -> int:
    """run_each() over the keys that the manifest doesn't list; each is listed when it is done, whatever becomes of the others. How many there were."""
    there = spark.read.parquet(manifest) if exists(spark, manifest) else listed.select(key).limit(0)
    todo = sorted(r[key] for r in pending(listed.select(key).distinct(), there, key).collect())  # a row a file

    def done(name: str, _: object) -> None:
        row = spark.range(1).select(F.lit(name).alias(key), F.current_timestamp().alias("done_at"))
        row.write.mode("append").parquet(manifest)

    run_each(spark, todo, work, done, workers)
    return len(todo)


def fingerprint(rows: DataFrame) -> str:
    """A digest of a table's rows, whatever their order: of their number, and of the sum and the exclusive or of their hashes."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(rows.columns)])
    r = rows.select(h.alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return f"{r['n']:x}-{int(r['s'] or 0) & (1 << 64) - 1:016x}-{(r['x'] or 0) & (1 << 64) - 1:016x}"


def _record(spark: SparkSession, path: str) -> dict | None:
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if exists(spark, path) else None


def _put(spark: SparkSession, path: str, what: dict) -> None:
    """A small file, there as a whole or not at all."""
    jvm = spark.sparkContext._jvm
    aside, p = (jvm.org.apache.hadoop.fs.Path(x) for x in (f"{path}.{uuid.uuid4().hex}", path))
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = store.create(aside, True)
    out.write(bytearray(json.dumps(what, sort_keys=True).encode()))
    out.close()
    store.delete(p, False)
    if not store.rename(aside, p):
        raise OSError(f"can't put {path} in place")


def resumed(spark: SparkSession, folder: str, mark: str, shards: list[str], make: Callable[[str], DataFrame], workers: int = 1) -> list[DataFrame]:
    """make(shard) for each shard, written under folder; what an earlier run has written for the same mark is read instead.

    A shard's record is put in place after its rows, and names them and the mark: rows that a stopped run left, and those of another mark, count for nothing, and are deleted once
    the shard is written anew."""

    def one(shard: str) -> dict:
        record = f"{folder}/{_folder(shard.rstrip('/').rsplit('/', 1)[-1])}-{uuid.uuid5(uuid.NAMESPACE_URL, shard).hex[:8]}.record"
        old = _record(spark, record)
        if old and old["mark"] == mark and exists(spark, old["rows"]):
            return old
        rows = make(shard)
        new = {"shard": shard, "mark": mark, "rows": f"{record}.{uuid.uuid4().hex}", "schema": rows.schema.json()}
        rows.write.parquet(new["rows"])
        _put(spark, record, new)
        if old:
            _delete(spark, old["rows"])
        return new

    found = run_each(spark, shards, one, workers=workers)
    return [spark.read.schema(T.StructType.fromJson(json.loads(found[s]["schema"]))).parquet(found[s]["rows"]) for s in shards]
