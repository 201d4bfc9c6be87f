"""Decisions: what happens to each candidate, checked against candidates, sessions and personas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_only(candidates: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Replace all by placeholders, but for those below the confidence threshold."""
    confidence = F.col("confidence") if "confidence" in candidates.columns else F.lit(1.0)
    return candidates.withColumn("action", F.when(confidence < threshold, "KEEP").otherwise("GENERICIZE"))


def persona_first(candidates: DataFrame, slots: DataFrame, active: DataFrame) -> DataFrame:
    """A persona's value where the session's active persona has a slot of the type, else a placeholder. ``active``: session_id, persona_id."""
    have = slots.select("persona_id", "attr_type", F.lit(True).alias("has")).distinct()
    rows = candidates.join(active, "session_id", "left").join(have, ["persona_id", "attr_type"], "left")
    return rows.withColumn("action", F.when(F.col("has"), "PERSONA_SLOT").otherwise("GENERICIZE")).drop("has")


def constrain(actions: DataFrame, candidates: DataFrame, slots: DataFrame) -> DataFrame:
    """Legal actions only. An action without its candidate, of another type than it, or a PERSONA_SLOT without a persona or slot stops the
    job; KEEP loses its replacement."""
    known = candidates.select("candidate_id", F.col("attr_type").alias("_attr"))
    filled = slots.select("persona_id", F.col("attr_type").alias("_slot")).distinct()
    rows = actions.join(known, "candidate_id", "left")
    s = filled.withColumnRenamed("persona_id", "_persona")
    rows = rows.join(s, (F.col("persona_id") == F.col("_persona")) & (F.col("attr_type") == F.col("_slot")), "left")

    def check(bad: Column, message: str, other: Column) -> Column:
        return F.when(bad, F.raise_error(F.concat(F.lit(message), F.col("candidate_id"))).cast("string")).otherwise(other)

    legal = check(F.col("_attr").isNull(), "no candidate ", F.col("action"))
    legal = check(F.col("_attr").isNotNull() & (F.col("_attr") != F.col("attr_type")), "another type than candidate ", legal)
    legal = check(F.col("_attr").isNotNull() & (F.col("action") == "PERSONA_SLOT") & F.col("_slot").isNull(), "no persona slot for ", legal)
    text = F.when(F.col("action") == "KEEP", F.lit(None).cast("string")).otherwise(F.col("replacement"))
    return rows.withColumn("action", legal).withColumn("replacement", text).drop("_attr", "_persona", "_slot")


def history(records: DataFrame) -> DataFrame:
    """Records of a session for a decision: latest turns first, longer placeholders first."""
    return records.orderBy(F.col("turn_id").desc(), F.length("placeholder").desc())


def personas_by_exposure(personas: DataFrame, exposures: DataFrame) -> DataFrame:
    """Personas that were exposed least first."""
    return personas.join(exposures, "persona_id", "left").orderBy(F.coalesce("exposures", F.lit(0)), "persona_id")


def apply_columns(df: DataFrame, types: dict[str, str], config: dict[str, tuple[str, dict]], operators=None) -> DataFrame:
    """``df`` with one operator applied to whole cells of each typed column (dotted paths reach into structs); NON_PII columns stay."""
    from spanveil.operators.anonymizer import Operators

    table = (operators or Operators()).anonymize
    for path, entity in types.items():
        if entity == "NON_PII":
            continue
        name, params = config.get(entity, config.get("DEFAULT", ("replace", {})))
        new = table[name](F.col(path).cast("string"), F.lit(entity), params)
        root, _, rest = path.partition(".")
        df = df.withColumn(root, F.col(root).withField(rest, new) if rest else new)
    return df
