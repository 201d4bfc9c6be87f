"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words and is stripped from lines: space and TAB to CR.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or the checkpoint folder that the caller has set. Where both are
    unset, a temporary one if the session is local (tests); on a cluster that is an error, since executors couldn't read it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spanveil-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def saved(df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there, and a lost executor costs
    no more than its running tasks. ``by``: a column whose values get folders of their own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanveil-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def bucketed(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Write ``df`` as a table in the shared folder, bucketed and sorted by ``keys`` into as many buckets as a shuffle has partitions, and
    read it back: a join with such a table, or of a shuffle by ``keys`` with it, moves no row of it."""
    spark = df.sparkSession
    table_name = f"spanveil_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table_name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).bucketBy(n, *keys).sortBy(*keys).saveAsTable(table_name)
    out = spark.table(table_name)
    out._saved_path, out._saved_table = path, table_name
    return out


def forget(df: DataFrame | None) -> None:
    """Delete what saved() or bucketed() wrote, when no later result depends on it."""
    path, table_name = getattr(df, "_saved_path", None), getattr(df, "_saved_table", None)
    if table_name:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table_name}")
    if path:
        jvm_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(jvm_path, True)


def tidy() -> None:
    """Give freed memory back to the system: a worker lives on between tasks, and what it holds counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``limit`` bytes of text, so that memory doesn't follow the batch size.
    One row is never cut."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total + n > limit and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
        tidy()


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8 bytes: bytes.split() separates at exactly the six characters of SPACE."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def n_words(text) -> F.Column:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text):
    """Lower-case A-Z alone. Texts that are all ASCII take the fast built-in; others a translation."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
