"""Personas and their slots: nested JSON documents as tables, merged by key."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOT = "struct<value:string,aliases:array<string>>"
PERSONA = (
    "persona_id string, display_name string, slots struct<"
    f"name:array<struct<full:{SLOT},family:{SLOT},given:{SLOT},alias:{SLOT},middle:{SLOT}>>,phone:array<{SLOT}>,bank_number:array<{SLOT}>,"
    f"passport_number:array<{SLOT}>,driver_license:array<{SLOT}>,email:array<{SLOT}>,id_number:array<{SLOT}>,organization:array<{SLOT}>,"
    "address:array<struct<components:array<struct<level:string,value:string,strength:string>>>>>"
)
SCALARS = ("phone", "bank_number", "passport_number", "driver_license", "email", "id_number", "organization")
STRENGTHS = ("weak", "soft", "hard")


def read_personas(spark: SparkSession, path: str, root: str = "true_personas") -> DataFrame:
    """Persona documents of a JSON file whose root holds a list under ``root``."""
    return spark.read.schema(f"{root} array<struct<{_colons(PERSONA)}>>").option("multiLine", True).json(path).select(F.explode(root).alias("p")).select("p.*")


def _colons(ddl: str) -> str:
    """Column definitions as fields of a struct."""
    return ",".join(":".join(part.split(" ", 1)) for part in _columns(ddl))


def _columns(ddl: str) -> list[str]:
    parts, depth, now = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(now.strip())
            now = ""
        else:
            now += c
    return [*parts, now.strip()]


def slots(personas: DataFrame) -> DataFrame:
    """(persona_id, attr_type, slot_no, component, value, aliases, strength): one row a slot or part of one."""
    out = None
    for attr in SCALARS:
        rows = personas.select("persona_id", F.posexplode(f"slots.{attr}").alias("slot_no", "x")).select("persona_id", F.lit(attr).alias("attr_type"), "slot_no", F.lit("value").alias("component"), "x.value", F.coalesce("x.aliases", F.array().cast("array<string>")).alias("aliases"), F.lit("hard").alias("strength"))
        out = rows if out is None else out.unionByName(rows)
    names = personas.select("persona_id", F.posexplode("slots.name").alias("slot_no", "x"))
    for part in ("full", "family", "given", "alias", "middle"):
        out = out.unionByName(names.where(F.col(f"x.{part}.value").isNotNull()).select("persona_id", F.lit("name").alias("attr_type"), "slot_no", F.lit(part).alias("component"), F.col(f"x.{part}.value").alias("value"), F.coalesce(f"x.{part}.aliases", F.array().cast("array<string>")).alias("aliases"), F.lit("hard").alias("strength")))
    parts = personas.select("persona_id", F.posexplode("slots.address").alias("slot_no", "x")).select("persona_id", "slot_no", F.inline("x.components"))
    return out.unionByName(parts.select("persona_id", F.lit("address").alias("attr_type"), "slot_no", F.col("level").alias("component"), "value", F.array().cast("array<string>").alias("aliases"), F.coalesce("strength", F.lit("hard")).alias("strength")))


def merge_slots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Slots of both, by (persona, type, component, value): aliases are united in order, the newer strength wins."""
    rows = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    key = ["persona_id", "attr_type", "component", "value"]
    merged = rows.groupBy(*key).agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("age", "slot_no", "aliases"))), lambda x: x["aliases"]))).alias("aliases"), F.max_by("strength", "age").alias("strength"), F.min(F.struct("age", "slot_no")).alias("first"))
    number = F.row_number().over(Window.partitionBy("persona_id", "attr_type", "component").orderBy("first", "value")) - 1
    return merged.withColumn("slot_no", number).select("persona_id", "attr_type", "slot_no", "component", "value", "aliases", "strength")


def write_slots(rows: DataFrame, path: str) -> None:
    """Replace a stored table in one commit, dealt by type."""
    rows.write.mode("overwrite").partitionBy("attr_type").parquet(path)


ATTRS = (*SCALARS, "name", "address")


def validated(rows: DataFrame) -> DataFrame:
    """``rows`` of slots, checked: persona, known type, value and strength must be there. A bad row stops the job and says which."""
    bad = F.coalesce(F.trim("persona_id") == "", F.lit(True)) | ~F.coalesce(F.col("attr_type").isin(*ATTRS), F.lit(False)) | F.coalesce(F.trim("value") == "", F.lit(True)) | ~F.coalesce(F.col("strength").isin(*STRENGTHS), F.lit(False))
    said = F.concat_ws(" ", F.lit("no legal slot:"), "persona_id", "attr_type", "component", "value", "strength")
    return rows.withColumn("persona_id", F.when(bad, F.raise_error(said).cast("string")).otherwise(F.col("persona_id")))


def merge_write(rows: DataFrame, path: str) -> DataFrame:
    """Merge slots into the stored ones under ``path`` and write all in one commit; returns the stored table. The old version is read while the new one
    is written beside it, and then replaced."""
    from spanveil.sources.store import _delete, _exists

    spark = rows.sparkSession
    merged = merge_slots(spark.read.parquet(path).select(*SLOT_COLUMNS), rows.select(*SLOT_COLUMNS)) if _exists(spark, path) else merge_slots(rows.select(*SLOT_COLUMNS).where("false"), rows.select(*SLOT_COLUMNS))
    staging = f"{path.rstrip('/')}__staging"
    merged.write.mode("overwrite").parquet(staging)
    write_slots(spark.read.parquet(staging), path)
    _delete(spark, staging)
    return spark.read.parquet(path).select(*SLOT_COLUMNS)


SLOT_COLUMNS = ("persona_id", "attr_type", "slot_no", "component", "value", "aliases", "strength")


def merged_stats(rows: DataFrame) -> DataFrame:
    """(persona_id, attr_type, component, exposures, last_at, last_session): statistics of several sources added up; of equal times the later source
    counts. ``rows``: those columns and ``age``, the place of their source."""
    return rows.groupBy("persona_id", "attr_type", "component").agg(F.sum("exposures").alias("exposures"), F.max("last_at").alias("last_at"), F.max_by("last_session", F.struct("last_at", "age")).alias("last_session"))


def ingest_organization(value):
    """struct<value, aliases>: the name without its legal form, and the whole name as an alias where that differs."""
    from spanveil.functions.normalize import LEGAL_FORMS, _quoted

    one = "(?i)(?<=.)[\\s,.]*(?<![A-Za-z])(" + "|".join(_quoted(s) for s in sorted(LEGAL_FORMS, key=lambda s: (-len(s), s))) + ")[\\s.]*$"
    whole = F.trim(F.regexp_replace(value, r"\s+", " "))
    short = F.regexp_replace(F.regexp_replace(whole, one, ""), one, "")
    return F.struct(short.alias("value"), F.when(short != whole, F.array(whole)).otherwise(F.array().cast("array<string>")).alias("aliases"))


def ingest_address(value):
    """The components of a raw address as array<struct<level, value, strength>>, each level and value once."""
    from spanveil.operators.address import parse_address

    @F.pandas_udf("array<struct<level:string,value:string,strength:string>>")
    def parts(values: pd.Series) -> pd.Series:
        return values.map(lambda t: [{"level": k, "value": v, "strength": "hard"} for k, v in dict.fromkeys((c.type, c.text) for c in parse_address(t))])

    return parts(value)


def component_bag(bags):
    """An array of components (level, value, strength) without repeats by level and value, in order; a later strength counts."""
    key = lambda x: F.concat_ws("\u0000", x["level"], x["value"])
    keys = F.array_distinct(F.transform(bags, key))
    return F.transform(keys, lambda k: F.element_at(F.filter(bags, lambda x: key(x) == k), -1))


def dictionary(rows: DataFrame) -> DataFrame:
    """(attr_type, term, persona_id, strength): values and aliases as terms; blanks go, a term once."""
    terms = rows.select("attr_type", F.explode(F.concat(F.array("value"), "aliases")).alias("term"), "persona_id", "strength")
    return terms.withColumn("term", F.trim("term")).where("term <> ''").dropDuplicates(["attr_type", "term"])


def pick_slot(source: DataFrame, rows: DataFrame, fakes: str = "persona_id") -> DataFrame:
    """``source`` (persona_id, attr_type, text) with the persona's replacement: slot number is the first 8 bytes of the text's SHA-256
    modulo the persona's slots of the type; an alias, if there are any, is chosen by the same hash."""
    full = rows.where(F.col("component").isin("value", "full"))
    listed = full.groupBy(fakes, "attr_type").agg(F.array_sort(F.collect_list(F.struct("slot_no", "value", "aliases"))).alias("slots"))
    h = F.conv(F.substring(F.sha2("text", 256), 1, 16), 16, 10).cast("decimal(20,0)")
    out = source.join(listed, [fakes, "attr_type"], "left").withColumn("_n", (h % F.size("slots")).cast("int"))
    slot = F.get("slots", F.col("_n"))
    every = F.concat(F.array(slot["value"]), slot["aliases"])
    return out.withColumn("replacement", F.get(every, (h % F.size(every)).cast("int"))).drop("slots", "_n")


def ingest_name(value):
    """struct<full, family, given> of a raw name."""
    t = F.trim(F.regexp_replace(value, r"\s+", " "))
    latin = t.rlike("[A-Za-z]")
    return F.struct(t.alias("full"), F.when(latin & t.contains(" "), F.regexp_extract(t, "([^ ]+)$", 1)).when(~latin, F.substring(t, 1, 1)).alias("family"), F.when(latin, F.regexp_extract(t, "^([^ ]+)", 1)).otherwise(F.substring(t, 2, 10)).alias("given"))


def address_slots(rows: DataFrame) -> DataFrame:
    """(persona_id, slot_no, components, road): a persona's addresses whole, those alone that are precise enough to be looked up: a part below the
    district, or two levels above."""
    from spanveil.operators.entities import LEVEL_OF

    parts = rows.where("attr_type = 'address'").groupBy("persona_id", "slot_no", "component").agg(F.min("value").alias("value"))
    whole = parts.groupBy("persona_id", "slot_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("component", "value")))).alias("components"))
    levels = F.create_map(*[F.lit(x) for pair in LEVEL_OF.items() for x in pair])
    kinds = F.array_distinct(F.filter(F.transform(F.map_keys("components"), lambda k: F.try_element_at(levels, k)), lambda x: x.isNotNull()))
    return whole.where(F.arrays_overlap(kinds, F.array(F.lit("ROAD"), F.lit("DTL"))) | (F.size(kinds) >= 2)).withColumn("road", _road(F.col("components")))


def _road(components):
    return F.coalesce(F.lower(F.regexp_replace(F.try_element_at(components, F.lit("road")), r"[^\p{L}\p{N}]", "")), F.lit(""))


def with_personas(records: DataFrame, rows: DataFrame) -> DataFrame:
    """``records`` (attr_type, canonical, components, ...) with ``persona_id``: the first persona, by id, that has the value. Canonical forms decide; an address is
    compared, by parts, with those of the same road first and then with those without one, so no pair of unlike roads is made."""
    from spanveil.functions.normalize import canonical
    from spanveil.operators.entities import same_address
    from spanveil.operators.placeholders import same_keys

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([same_address(json.loads(x), json.loads(y)) for x, y in zip(a, b, strict=True)])

    plain = rows.where(F.col("component").isin("value", "full") & (F.col("attr_type") != "address"))
    known = plain.withColumn("canonical", canonical(F.col("attr_type"), F.col("value"))).where("canonical <> ''").groupBy("attr_type", "canonical").agg(F.min("persona_id").alias("_by_value"))
    places = address_slots(rows)
    asked = records.where("attr_type = 'address' and size(components) > 0").select("components").withColumn("_json", F.to_json("components")).dropDuplicates(["_json"]).withColumn("_road", _road(F.col("components")))
    pairs = asked.select("_json", F.explode(F.array_distinct(F.array("_road", F.lit("")))).alias("road")).join(places.select("persona_id", "road", F.to_json("components").alias("_own")), "road")
    hits = pairs.where(same(F.col("_json"), F.col("_own"))).groupBy("_json").agg(F.min(F.struct((F.col("road") == "").alias("late"), "persona_id")).alias("_hit"))
    out = same_keys(records, known, ["attr_type", "canonical"], "left").withColumn("_json", F.to_json("components"))
    out = same_keys(out, hits, ["_json"], "left")
    return out.withColumn("persona_id", F.when(F.col("attr_type") == "address", F.col("_hit.persona_id")).otherwise(F.col("_by_value"))).drop("_by_value", "_hit", "_json")
