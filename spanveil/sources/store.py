"""Replacement records: a turn replaces what the store had of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def save_turns(records: DataFrame, path: str) -> None:
    """``records`` (session_id, turn_id, entity_id, attr_type, action, source_text, placeholder, s, e, ...): all turns in them replace the
    stored ones, also those of which nothing is left; KEEP is not stored. Only the buckets of the sessions concerned are rewritten;
    one that ends up empty is removed."""
    spark = records.sparkSession
    rows = records.where("action <> 'KEEP' or action is null").withColumn("bucket", bucket_of(F.col("session_id")))
    turns = records.select("session_id", "turn_id").distinct()
    if _exists(spark, path):
        touched = turns.select(bucket_of(F.col("session_id")).alias("bucket")).distinct()
        kept = spark.read.parquet(path).join(touched, "bucket", "left_semi").join(turns, ["session_id", "turn_id"], "left_anti")
        # What is read is overwritten, so the merged buckets are staged beside the store first.
        staging = f"{path.rstrip('/')}__staging"
        kept.unionByName(rows, allowMissingColumns=True).write.mode("overwrite").parquet(staging)
        rows = spark.read.parquet(staging)
        left = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # at most BUCKETS
        for r in touched.collect():
            if r["bucket"] not in left:
                _delete(spark, f"{path.rstrip('/')}/bucket={r['bucket']}")
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(path)


def bucket_of(session):
    return F.pmod(F.xxhash64(session), BUCKETS).cast("int")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def load(spark: SparkSession, path: str, session: str | None = None, turn: int | None = None, placeholder: str | None = None, source_text: str | None = None) -> DataFrame:
    """Stored records, by any of session, turn, placeholder and source text. A session reads its own bucket alone."""
    rows = spark.read.parquet(path)
    if session is not None:
        bucket = spark.range(1).select(bucket_of(F.lit(session)).alias("b")).first()["b"]
        rows = rows.where((F.col("bucket") == bucket) & (F.col("session_id") == session))
    for column, value in (("turn_id", turn), ("placeholder", placeholder), ("source_text", source_text)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.drop("bucket")


def read_lines(spark: SparkSession, path: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(file, line_no, text) of text files under a path, without those that a glob of ``ignore`` names. A file is one row
    until its lines are numbered: meant for files that a task can hold."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    for glob in ignore:
        rows = rows.where(~F.col("file").like("%" + glob.replace("*", "%").replace("?", "_")))
    return rows.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


def lint(spark: SparkSession, path: str, ignore: tuple[str, ...] = (), **analysis) -> DataFrame:
    """(file, line_no, column, entity_type, score, text): what the analyzer finds, line by line."""
    from spanveil.operators.recognizers import analyze

    lines = read_lines(spark, path, ignore).withColumn("line_key", F.concat_ws(":", "file", "line_no"))
    found = analyze(lines, "line_key", "text", **analysis)
    return found.join(lines.select("line_key", "file", "line_no"), "line_key").select("file", "line_no", (F.col("s") + 1).alias("column"), "entity_type", "score", "text")


def formatted(found: DataFrame, style: str = "standard") -> DataFrame:
    """(file, line_no, line): findings as lines of a report; styles are standard, parsable, github and auto (standard)."""
    place, what = F.concat_ws(":", "line_no", "column"), F.concat_ws(" ", "entity_type", F.format_number("score", 2))
    forms = {
        "standard": F.concat(F.lit("  "), place, F.lit("  "), what),
        "parsable": F.concat(F.col("file"), F.lit(":"), place, F.lit(": ["), "entity_type", F.lit("] "), F.format_number("score", 2)),
        "github": F.concat(F.lit("::error file="), "file", F.lit(",line="), "line_no", F.lit(",col="), "column", F.lit("::"), what),
    }
    if style not in (*forms, "auto"):
        raise ValueError(f"no style {style!r}")
    return found.select("file", "line_no", forms.get(style, forms["standard"]).alias("line"))
