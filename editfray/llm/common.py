"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package

#: Characters that count as white space around lines and between words.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, where one machine is all there is, one set here."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="editfray-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut the lineage: write df to the shared folder, and read it back with its own schema.

    A lost executor costs only the tasks it ran: what was written stays."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame | None) -> None:
    """Delete what cut() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def numbered(written: DataFrame, at: str, row: str) -> DataFrame:
    """Written rows with their number from 0 on in the column `row`, in place of `at`: what monotonically_increasing_id() gave them then."""
    part, start = free(written, "part", "start")
    # One row a partition of the writer reaches the driver.
    starts, begin = [], 0
    for r in sorted(written.groupBy(F.shiftright(at, 33).alias("part")).agg(F.count("*").alias("n")).collect()):
        starts.append((r["part"], begin))
        begin += r["n"]
    starts = written.sparkSession.createDataFrame(starts, f"{part} long, {start} long")
    dealt = written.withColumn(part, F.shiftright(at, 33)).join(starts, part)
    return dealt.select(*named(written, at), (F.col(start) + F.col(at).bitwiseAND((1 << 33) - 1)).alias(row))


def numbered_nulls(docs: DataFrame, id_col: str, row: str) -> DataFrame | None:
    """The rows of docs without an id, written, with their number from 0 on in the column `row`; None if there are none."""
    nulls = docs.where(quoted(id_col).isNull())
    if not nulls.limit(1).count():
        return None
    (at,) = free(docs, "at")
    return numbered(cut(nulls.withColumn(at, F.monotonically_increasing_id()), "nulls"), at, row)


def ascii_lower(c):
    """Lower-case A-Z alone. lower() is the same on pure ASCII, and much faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fold(doc_id: int | None) -> int:
    """crc32 of the id as text, modulo 5; 0 is held out. A null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5


def fold_column(c):
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % 5


def slices(batch, column: str, limit: int = 1 << 20) -> Iterator:
    """Cut an Arrow batch by rows so that no slice but a single long text has over `limit` bytes of text."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start or batch.num_rows == 0:
        yield batch.slice(start)


def release() -> None:
    """Give memory that Arrow holds for later back: Python workers live on between tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def quoted(name: str) -> Column:
    """The column of this name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def named(df: DataFrame, *but: str) -> list[Column]:
    """The columns of df except those of `but`."""
    return [quoted(c) for c in df.columns if c not in but]


def free(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of df has, in any case of its letters."""
    used, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name in used:
            name += "_"
        out.append(name)
    return out


def arrow_map(df: DataFrame, make: Callable[[], Callable], schema, text: str | None = None) -> DataFrame:
    """mapInArrow with a function that make() builds once in each task; with `text`, on slices of bounded text."""

    ship_package(df.sparkSession)

    def run(batches):
        f = make()
        for b in batches:
            for s in slices(b, text) if text else (b,):
                if s.num_rows:
                    yield f(s)
        release()

    return df.mapInArrow(run, schema)
