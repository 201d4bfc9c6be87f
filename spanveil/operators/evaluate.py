"""Evaluation of detected spans against known ones, exposure roll-ups and column typing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.operators.joins import islands

TAG = r"【PII:([A-Z_]+):([^】]*)】(.*?)【/PII】"


def read_tagged(df: DataFrame, key: str, text: str = "text_with_tags") -> tuple[DataFrame, DataFrame]:
    """(texts, known): tagged texts without their tags, and the spans that were tagged (key, entity_type, tag_id, s, e, text). The text is cut
    at the tags; no character of it serves as a mark."""
    found = lambda group: F.regexp_extract_all(text, F.lit(f"(?s){TAG}"), F.lit(group))
    rows = df.select(key, F.split(text, f"(?s){TAG}", -1).alias("cut"), found(1).alias("types"), found(2).alias("ids"), found(3).alias("values"))
    between = F.transform("cut", lambda piece, i: F.concat(piece, F.coalesce(F.get("values", i), F.lit(""))))
    texts = rows.select(key, F.array_join(between, "").alias("text"))
    each = rows.select(key, F.posexplode("values").alias("i", "text"), "cut", "types", "ids", "values")
    s = F.aggregate(F.slice("cut", 1, F.col("i") + 1), F.lit(0), lambda n, p: n + F.length(p)) + F.aggregate(F.slice("values", 1, F.col("i")), F.lit(0), lambda n, p: n + F.length(p))
    known = each.select(key, F.get("types", F.col("i")).alias("entity_type"), F.get("ids", F.col("i")).alias("tag_id"), s.alias("s"), "text")
    return texts, known.withColumn("e", F.col("s") + F.length("text")).select(key, "entity_type", "tag_id", "s", "e", "text")


def judge(gold: DataFrame, found: DataFrame, key: str, generic: tuple[str, ...] = ("num", "alnum")) -> DataFrame:
    """``gold`` (key, gold_id, entity_type, s, e) with covered, exact_covered, ratio and status. Coverage is the length of the union of
    overlaps; a status is exact if found spans of the right type take part, generic if only generic ones do."""
    g, f = gold.alias("g"), found.alias("f")
    hits = g.join(f, (F.col(f"g.{key}") == F.col(f"f.{key}")) & (F.col("g.s") < F.col("f.e")) & (F.col("f.s") < F.col("g.e")))
    kind = F.when(F.col("f.entity_type") == F.col("g.entity_type"), "exact").when(F.col("f.entity_type").isin(*generic), "generic").otherwise("wrong")
    hits = hits.select(F.col(f"g.{key}").alias(key), F.col("g.gold_id").alias("gold_id"), kind.alias("kind"), F.greatest("g.s", "f.s").alias("s"), F.least("g.e", "f.e").alias("e"))

    def total(rows: DataFrame, name: str) -> DataFrame:
        merged = islands(rows, [key, "gold_id"], F.col("s") <= F.col("_end"))
        return merged.groupBy(key, "gold_id").agg(F.sum(F.col("e") - F.col("s")).alias(name))

    out = gold.join(total(hits.where("kind <> 'wrong'"), "covered"), [key, "gold_id"], "left").join(total(hits.where("kind = 'exact'"), "exact_covered"), [key, "gold_id"], "left")
    out = out.fillna(0, ["covered", "exact_covered"]).withColumn("ratio", F.col("covered") / (F.col("e") - F.col("s")))
    whole = F.col("covered") >= F.col("e") - F.col("s")
    status = F.when(F.col("covered") == 0, "miss").when(F.col("exact_covered") > 0, F.when(whole, "exact_complete").otherwise("exact_fragment")).when(whole, "generic_complete").otherwise("generic_fragment")
    return out.withColumn("status", status)


def classify_found(found: DataFrame, gold: DataFrame, key: str, generic: tuple[str, ...] = ("num", "alnum")) -> DataFrame:
    """``found`` (key, found_id, entity_type, s, e) with class: exact_overlap, generic_overlap, wrong_type_overlap or background_fp."""
    f, g = found.alias("f"), gold.alias("g")
    rows = f.join(g, (F.col(f"g.{key}") == F.col(f"f.{key}")) & (F.col("g.s") < F.col("f.e")) & (F.col("f.s") < F.col("g.e")), "left")
    rows = rows.groupBy(F.col(f"f.{key}").alias(key), F.col("f.found_id").alias("found_id"), F.col("f.entity_type").alias("entity_type")).agg(
        F.bool_or(F.col("f.entity_type") == F.col("g.entity_type")).alias("same"), F.count("g.s").alias("n")
    )
    return rows.withColumn("class", F.when(F.col("same"), "exact_overlap").when((F.col("n") > 0) & F.col("entity_type").isin(*generic), "generic_overlap").when(F.col("n") > 0, "wrong_type_overlap").otherwise("background_fp")).drop("same", "n")


def summary(judged: DataFrame) -> DataFrame:
    """Rates by entity type and, as ``ALL``, over all: one roll-up."""
    rate = lambda *names: F.round(F.avg(F.col("status").isin(*names).cast("double")), 6)
    out = judged.rollup("entity_type").agg(
        F.count("*").alias("n"),
        rate("exact_complete").alias("exact_rate"),
        rate("exact_complete", "exact_fragment").alias("exact_any_rate"),
        rate("generic_complete", "generic_fragment").alias("generic_rate"),
        rate("miss").alias("miss_rate"),
        F.round(F.avg("ratio"), 6).alias("coverage"),
    )
    return out.withColumn("entity_type", F.coalesce("entity_type", F.lit("ALL")))


def coverage_matrix(judged: DataFrame, weight: str | None = None, exclusive: bool = False) -> DataFrame:
    """(threshold, n, share): entities covered wholly, by half and at all; weighted if a weight is named. ``exclusive``: each entity counts at its best
    threshold alone, and those not covered as ``none``, so that the shares add up to 1."""
    w = F.col(weight) if weight else F.lit(1)
    names = ("1.0", "0.5", "any", "none") if exclusive else ("1.0", "0.5", "any")
    rows = judged.select("ratio", w.cast("double").alias("w"), F.explode(F.array(*[F.lit(n) for n in names])).alias("threshold"))
    if exclusive:
        met = F.col("threshold") == F.when(F.col("ratio") >= 1, "1.0").when(F.col("ratio") >= 0.5, "0.5").when(F.col("ratio") > 0, "any").otherwise("none")
    else:
        met = F.when(F.col("threshold") == "1.0", F.col("ratio") >= 1).when(F.col("threshold") == "0.5", F.col("ratio") >= 0.5).otherwise(F.col("ratio") > 0)
    return rows.groupBy("threshold").agg(F.count_if(met).alias("n"), F.round(F.sum(F.when(met, F.col("w")).otherwise(0.0)) / F.sum("w"), 6).alias("share"))


def latency(rows: DataFrame, column: str) -> DataFrame:
    """count, mean, median and 95th percentile by nearest rank, least and largest of a column of milliseconds. The ranks are taken from
    the counts of distinct values."""
    return rows.agg(
        F.count(column).alias("n"), F.round(F.avg(column), 6).alias("mean"), F.expr(f"percentile_disc(0.5) within group (order by {column})").cast(rows.schema[column].dataType).alias("median"),
        F.expr(f"percentile_disc(0.95) within group (order by {column})").cast(rows.schema[column].dataType).alias("p95"), F.min(column).alias("least"), F.max(column).alias("most"),
    )


def weakest(table: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` types with the lowest exact rate, larger types first among equals."""
    return table.where("entity_type <> 'ALL'").orderBy("exact_any_rate", F.col("n").desc(), "entity_type").limit(k)


def deltas(a: DataFrame, b: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Differences of paired metrics, second less first."""
    x, y = a.alias("a"), b.alias("b")
    return x.join(y, F.col(f"a.{key}") == F.col(f"b.{key}")).select(F.col(f"a.{key}").alias(key), *[F.round(F.col(f"b.{m}") - F.col(f"a.{m}"), 6).alias(f"{m}_delta") for m in metrics])


def token_recall(rows: DataFrame) -> DataFrame:
    """(n_tokens, n_found, recall) of expected tokens in predicted ones; columns ``expected`` and ``predicted`` are arrays of strings."""
    hit = F.size(F.array_intersect("expected", "predicted"))
    return rows.agg(F.sum(F.size(F.array_distinct("expected"))).alias("n_tokens"), F.sum(hit).alias("n_found")).withColumn("recall", F.round(F.col("n_found") / F.col("n_tokens"), 6))


def exposure(rows: DataFrame, keys: list[str], count: str, at: str, session: str) -> DataFrame:
    """(keys, exposures, last_at, last_session): counts are summed, the last exposure is the latest."""
    return rows.groupBy(*keys).agg(F.sum(count).alias("exposures"), F.max(at).alias("last_at"), F.max(F.struct(at, session))[session].alias("last_session"))


def column_types(df: DataFrame, columns: list[str], detect, strategy: str = "most_common", mixed: float = 0.5, sample: int | None = None, seed: int = 123) -> DataFrame:
    """(column, entity_type, share, n): the entity type of each column by a vote over its cells. ``detect`` maps (cell_id, text) to (cell_id,
    entity_type, score). Cells vote once for each type in them; columns without any are NON_PII. ``sample``: so many rows vote, the first by a
    hash of ``seed`` and their cells; reruns choose the same."""
    if sample is not None:
        df = df.select(*[F.col(c) for c in columns]).orderBy(F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in columns])).limit(sample)
    cells = df.select(F.monotonically_increasing_id().alias("row"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot("row", columns, "column", "text")
    cells = cells.where("text is not null").withColumn("cell_id", F.concat_ws(":", "column", "row"))
    total = cells.groupBy("column").agg(F.count("*").alias("cells"))
    votes = detect(cells.select("cell_id", "text")).groupBy("cell_id", "entity_type").agg(F.max("score").alias("score"))
    votes = votes.withColumn("column", F.substring_index("cell_id", ":", 1)).groupBy("column", "entity_type").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"))
    votes = votes.join(total, "column").withColumn("share", F.round(F.col("n") / F.col("cells"), 6))
    common, sure = [F.col("n").desc(), F.col("score").desc(), F.col("entity_type")], [F.col("score").desc(), F.col("n").desc(), F.col("entity_type")]
    w = lambda order: Window.partitionBy("column").orderBy(*order)
    votes = votes.withColumn("by_n", F.row_number().over(w(common))).withColumn("by_score", F.row_number().over(w(sure)))
    if strategy == "mixed":
        top = F.max(F.when(F.col("by_n") == 1, F.col("share"))).over(Window.partitionBy("column"))
        votes = votes.withColumn("rank", F.when(top > mixed, F.col("by_n")).otherwise(F.col("by_score")))
    else:
        votes = votes.withColumn("rank", F.col("by_n" if strategy == "most_common" else "by_score"))
    best = votes.where("rank = 1").select("column", "entity_type", "share", "n")
    return total.join(best, "column", "left").select("column", F.coalesce("entity_type", F.lit("NON_PII")).alias("entity_type"), F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
