"""Placeholder allocation over sessions, the same fold in batch and in Structured Streaming.

Rows: session_id, turn_id, s, attr_type, canonical, text. A key's rows are taken in the order (turn, start); state is its entities.
A turn that comes late is numbered after what is there. A turn that is sent again gets the numbers it had: its values are known.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanveil.operators.entities import Entity, Session, address_spec, placeholder
from spanveil.operators.placeholders import allocate_equal, render, same_keys

OUT = "session_id string, turn_id long, s long, attr_type string, text string, entity_id long, placeholder string"
COLUMNS = ["session_id", "turn_id", "s", "attr_type", "canonical", "text", "parts"]
FUZZY = ("name", "organization", "address")


def fold(session: Session, rows: pd.DataFrame) -> pd.DataFrame:
    """Number the rows of one session and update it."""
    out = []
    for r in rows.sort_values(["turn_id", "s"], kind="stable").itertuples(index=False):
        own = json.loads(r.parts) if isinstance(r.parts, str) else None
        e = session.number(r.attr_type, r.text or "", r.canonical or "", own)
        out.append((r.session_id, r.turn_id, r.s, r.attr_type, r.text, e.number, placeholder(e, r.text or "", own)))
    return pd.DataFrame(out, columns=["session_id", "turn_id", "s", "attr_type", "text", "entity_id", "placeholder"])


def _shaped(rows: DataFrame) -> DataFrame:
    """COLUMNS of ``rows``; components, if there, as JSON in the order of their types."""
    parts = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("components")))) if "components" in rows.columns else F.lit(None).cast("string")
    return rows.select(F.col("session_id").cast("string").alias("session_id"), F.col("turn_id").cast("long").alias("turn_id"), F.col("s").cast("long").alias("s"), "attr_type", "canonical", "text", parts.alias("parts"))


def _grouped(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which of a session's names, organizations and addresses are one entity: the first value of each stands for it, with the parts that its
    members have brought so far."""
    session, out = Session(), []
    for r in pdf.sort_values(["turn_id", "s"], kind="stable").itertuples(index=False):
        own = json.loads(r.parts) if isinstance(r.parts, str) else None
        e = session.number(r.attr_type, r.text or "", r.canonical or "", own)
        out.append((r.session_id, r.attr_type, r.canonical, r.text, r.parts, str(e.number), address_spec(own)))
    return pd.DataFrame(out, columns=["session_id", "attr_type", "canonical", "text", "parts", "entity", "spec"])


def allocate(rows: DataFrame) -> DataFrame:
    """Batch: values that compare by equality are numbered by joins and windows alone; names, organizations and addresses, whose comparison
    is a rule over pairs, first pass a fold over a session's distinct values that says which are one. Nulls are values."""
    rows = _shaped(rows)
    keys = ["session_id", "attr_type", "canonical", "text", "parts"]
    fuzzy = F.col("attr_type").isin(*FUZZY)
    first = rows.where(fuzzy).groupBy(*keys).agg(F.min(F.struct("turn_id", "s")).alias("f")).select(*keys, F.col("f.turn_id").alias("turn_id"), F.col("f.s").alias("s"))
    groups = first.select(*COLUMNS).groupBy("session_id").applyInPandas(_grouped, "session_id string, attr_type string, canonical string, text string, parts string, entity string, spec string")
    marked = same_keys(rows, groups, keys, "left").withColumn("own", F.col("canonical")).withColumn("canonical", F.when(fuzzy, F.col("entity")).otherwise(F.col("canonical")))
    numbered = allocate_equal(marked, "session_id", "turn_id").withColumn("entity_id", F.col("entity_id").cast("long"))
    return numbered.withColumn("placeholder", render(F.col("attr_type"), F.col("entity_id"), F.coalesce("text", F.lit("")), F.col("spec"))).select(*[c.split()[0] for c in OUT.split(", ")])


def _dump(session: Session) -> str:
    return json.dumps([[e.number, e.attr, e.canonical, e.components, e.first_text] for e in session.entities], ensure_ascii=False)


def _load(text: str | None) -> Session:
    return Session([Entity(*x) for x in json.loads(text)] if text else [])


def allocate_stream(rows: DataFrame, idle: str | None = None) -> DataFrame:
    """Stream: the session's entities are keyed state. ``idle`` (milliseconds as text) ends sessions that stay silent so long."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        session = _load(state.get[0] if state.exists else None)
        out = fold(session, pd.concat(list(batches)))
        state.update((_dump(session),))
        if idle:
            state.setTimeoutDuration(int(idle))
        yield out

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return _shaped(rows).groupBy("session_id").applyInPandasWithState(step, OUT, "entities string", "append", timeout)


def upsert(path: str):
    """A sink for foreachBatch: each (session, turn) of a batch replaces what the store had of it, in a version of its own; the latest
    version of a turn counts. Runs again with the same batch write the same version."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/version={batch_id:012d}")

    return write


def read_store(spark, path: str) -> DataFrame:
    """The records of the latest version of each turn."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    latest = rows.groupBy("session_id", "turn_id").agg(F.max("version").alias("version"))
    return rows.join(latest, ["session_id", "turn_id", "version"])


def counts_by_window(rows: DataFrame, at: str = "ts", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Entities by type and tumbling window of event time, with a watermark: an extension for monitoring."""
    return rows.withWatermark(at, late).groupBy(F.window(at, width), "attr_type").agg(F.count("*").alias("n"))
