"""Placeholders: allocate entity numbers in a session, render them, parse them, rewrite text and restore it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions.spans import splice

# Short code of each attribute type.
CODES = {
    "name": "NAME",
    "organization": "ORG",
    "address": "ADDR",
    "phone": "PHONE",
    "email": "EMAIL",
    "id_number": "ID_NUMBER",
    "bank_number": "BANK_CARD",
    "license_plate": "LICENSE_PLATE",
    "driver_license": "DRIVER_LICENSE",
    "passport_number": "PASSPORT",
    "time": "TIME",
    "amount": "AMOUNT",
    "details": "DETAIL",
    "num": "NUM",
    "alnum": "ALNUM",
}
PLACEHOLDER = r"\[\[([A-Z_]+)#([0-9]+)(?:\.([A-Z0-9=+\-]+))?\]\]"


def code_of(attr: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair]), attr)


def render(attr: Column, number: Column, text: Column, spec: Column | None = None) -> Column:
    """[[TYPE#n]]; an address has its SPEC if there is one, a number or code the length of its source."""
    spec = F.lit(None).cast("string") if spec is None else spec
    tail = F.when(attr.isin("num", "alnum"), F.concat(F.lit(".LEN="), F.length(text))).when((attr == "address") & (spec != ""), F.concat(F.lit("."), spec)).otherwise("")
    return F.concat(F.lit("[["), code_of(attr), F.lit("#"), number.cast("string"), tail, F.lit("]]"))


def parse(text: Column) -> Column:
    """struct<label, number, spec> of a placeholder; null for anything else."""
    whole = f"^{PLACEHOLDER}$"
    return F.when(
        text.rlike(whole),
        F.struct(F.regexp_extract(text, whole, 1).alias("label"), F.regexp_extract(text, whole, 2).cast("bigint").alias("number"), F.regexp_extract(text, whole, 3).alias("spec")),
    )


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined to the other columns of ``b`` by keys that may be null: null meets null."""
    b = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return a.join(b, on, how).drop(*[f"_{k}" for k in keys])


#: Turns of a session are numbered in stretches of so many bits of their number, so that no window holds a whole session.
TURN_BITS = 12


def allocate_equal(rows: DataFrame, session: str, turn: str) -> DataFrame:
    """``rows`` (session, turn, s, attr_type, canonical, ...) with entity_id: values of a session that agree in type and canonical
    form share a number; numbers follow the first appearance by (turn, start) and run over all types. Nulls are values.

    The first appearances are found by an aggregate, which also shrinks the input before anything is numbered. A number is a rank in
    its turn, plus the values of the turns before in a stretch of turns, plus those of the stretches before: a session that holds a
    third of all rows is spread over its turns, and only a row a stretch meets in one task. ``turn`` is a whole number."""
    keys = [session, "attr_type", "canonical"]
    first = rows.groupBy(*keys).agg(F.min(F.struct(F.col(turn).cast("long").alias("t"), F.col("s").alias("s"))).alias("first"))
    first = first.select(*keys, F.col("first.t").alias("t"), F.col("first.s").alias("at"), F.shiftright("first.t", TURN_BITS).alias("stretch"))
    per_turn = first.groupBy(session, "stretch", "t").agg(F.count("*").alias("n"))
    per_stretch = per_turn.groupBy(session, "stretch").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_turn = per_turn.select(session, "stretch", "t", before(Window.partitionBy(session, "stretch").orderBy("t")).alias("turns_before"))
    per_stretch = per_stretch.select(session, "stretch", before(Window.partitionBy(session).orderBy("stretch")).alias("stretches_before"))
    rank = F.row_number().over(Window.partitionBy(session, "t").orderBy("at", "attr_type", "canonical"))
    numbers = same_keys(same_keys(first.withColumn("rank", rank), per_turn, [session, "stretch", "t"]), per_stretch, [session, "stretch"])
    numbers = numbers.select(*keys, (F.col("rank") + F.col("turns_before") + F.col("stretches_before")).cast("int").alias("entity_id"))
    return same_keys(rows, numbers, keys)


def rewrite(docs: DataFrame, edits: DataFrame, key: str, text: str = "text", out: str = "sanitized") -> DataFrame:
    """``docs`` with ``out``: the spans of ``edits`` (key, s, e, placeholder) replaced. Only edited documents carry an array; the spans
    must be disjoint."""
    per = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("s", "e", F.col("placeholder").alias("new")))).alias("_edits"))
    return docs.join(per, key, "left").withColumn(out, F.when(F.col("_edits").isNull(), F.col(text)).otherwise(splice(F.col(text), F.col("_edits")))).drop("_edits")


def restore(answers: DataFrame, records: DataFrame, keys: list[str], text: str = "text", out: str = "restored") -> DataFrame:
    """``answers`` with ``out``: each placeholder that ``records`` (keys, placeholder, source_text, first_seen) knows for the same
    keys replaced by the first source text of that placeholder. An address placeholder of a known entity with another SPEC gets the
    parts that its SPEC names, if ``records`` has components (type -> text). Unknown ones stay, and so does every other character.

    Records become one map a key, so the answers are read once; the text is cut at the placeholders and joined again."""
    if "components" not in records.columns:
        records = records.withColumn("components", F.lit(None).cast("map<string,string>"))
    first = records.groupBy(*keys, "placeholder").agg(F.min("first_seen").alias("seen"), F.min_by(F.struct("source_text", "components"), "first_seen").alias("r"))
    first = first.withColumn("tag", parse(F.col("placeholder"))).withColumn("entity", F.concat_ws("#", "tag.label", "tag.number"))
    texts = first.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "r.source_text"))).alias("_known"))
    places = first.where((F.col("tag.label") == CODES["address"]) & F.col("r.components").isNotNull()).groupBy(*keys, "entity").agg(F.min_by(F.to_json("r.components"), "seen").alias("c"))
    places = places.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("entity", "c"))).alias("_places"))
    known = same_keys(texts, places, keys, "left")
    rows = same_keys(answers, known, keys, "left").withColumn("_cut", F.split(text, PLACEHOLDER, -1)).withColumn("_tags", F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)))

    def back(tag: Column) -> Column:
        bits = parse(tag)
        place = F.from_json(F.try_element_at("_places", F.concat_ws("#", bits["label"], bits["number"])), "map<string,string>")
        part = F.when((bits["label"] == CODES["address"]) & (bits["spec"] != "") & place.isNotNull(), projected(place, bits["spec"]))
        return F.coalesce(F.try_element_at("_known", tag), F.when(part != "", part), tag)

    joined = F.array_join(F.flatten(F.transform("_cut", lambda piece, i: F.array(piece, F.when(i < F.size("_tags"), back(F.get("_tags", i))).otherwise("")))), "")
    return rows.withColumn(out, F.when(F.col("_known").isNull() | (F.size("_tags") == 0), F.col(text)).otherwise(joined)).drop("_known", "_places", "_cut", "_tags")


def projected(components: Column, spec: Column) -> Column:
    """The parts of an address (type -> text) that a SPEC names, from the largest to the smallest; with spaces between parts in Latin letters."""
    from spanveil.operators.entities import LEVEL_OF, LEVELS

    order = [k for level in LEVELS for k in LEVEL_OF if LEVEL_OF[k] == level]
    parts = F.array(*[F.when(F.array_contains(F.split(spec, "-"), LEVEL_OF[k]), F.try_element_at(components, F.lit(k))) for k in order])
    parts = F.filter(parts, lambda x: x.isNotNull())
    return F.trim(F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[\\x00-\\x{2E80}]*$"), F.concat(x, F.lit(" "))).otherwise(x)), ""))
