"""Metadata of candidates: merged, deduplicated, and read from JSON.

Metadata is map<string, array<string>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METADATA = "map<string,array<string>>"


def merged(a: Column, b: Column) -> Column:
    """The union of two metadata maps: by key the values of both, each once, the first one's first. Null is empty."""
    empty = F.from_json(F.lit("{}"), METADATA)
    none = F.array().cast("array<string>")
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda k, x, y: F.array_distinct(F.concat(F.coalesce(x, none), F.coalesce(y, none))))


def united(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metadata): all metadata of a key's rows, values sorted, each once. Values are grouped before they are listed, so a key with many
    rows isn't a long list."""
    values = rows.select(*keys, F.explode_outer("metadata").alias("_k", "_v")).select(*keys, "_k", F.explode_outer("_v").alias("_x")).distinct()
    lists = values.groupBy(*keys, "_k").agg(F.array_sort(F.collect_list("_x")).alias("_v"))
    none = F.array().cast("array<struct<_k:string,_v:array<string>>>")
    maps = F.filter(F.array_sort(F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", "_v")))), lambda x: x.isNotNull())
    return lists.groupBy(*keys).agg(F.map_from_entries(F.coalesce(maps, none)).alias("metadata"))


CANDIDATE_KEY = ["source", "canonical", "attr_type", "block_id", "s", "e"]


def distinct_candidates(rows: DataFrame, key: str = "doc_id", by: list[str] | None = None) -> DataFrame:
    """``rows`` (key, source, canonical, attr_type, block_id, s, e, text, strength, metadata, ...): one a key of CANDIDATE_KEY, the strongest and then first
    text; metadata united. For recognized blocks ``by`` is (attr_type, block_id, text)."""
    from spanveil.operators.placeholders import same_keys

    keys = [key, *(by or CANDIDATE_KEY)]
    rest = [c for c in rows.columns if c not in keys and c != "metadata"]
    order = F.struct(*([-F.col("strength")] if "strength" in rest else []), *[F.col(c) for c in rest])
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")) if rest else rows.select(*keys).distinct()
    return same_keys(first, united(rows, keys), keys).select(*keys, *([f"_r.{c}" for c in rest]), "metadata")


def alias_state(text: Column) -> Column:
    """struct<aliases: map<string, string>, counters: map<string, int>> of a session's state in JSON; what isn't JSON is empty."""
    state = F.from_json(text, "aliases map<string,string>, counters map<string,int>", {"mode": "PERMISSIVE"})
    return F.struct(F.coalesce(state["aliases"], F.from_json(F.lit("{}"), "map<string,string>")).alias("aliases"), F.coalesce(state["counters"], F.from_json(F.lit("{}"), "map<string,int>")).alias("counters"))


def write_alias_state(aliases: Column, counters: Column) -> Column:
    return F.to_json(F.struct(aliases.alias("aliases"), counters.alias("counters")))


SUSPECTS = "array<struct<levels:array<string>,value:string,key:string,origin:string>>"


def suspects(text: Column) -> Column:
    """Suspects of an address component from JSON; items without a level or value are dropped, what isn't JSON is empty."""
    items = F.coalesce(F.from_json(text, SUSPECTS), F.array().cast(SUSPECTS))
    return F.filter(items, lambda x: F.coalesce((F.size(x["levels"]) > 0) & (x["value"] != ""), F.lit(False)))
