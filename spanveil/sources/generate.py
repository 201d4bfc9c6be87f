"""Synthetic addresses with known components, for evaluation: any number of rows, each a function of its number and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Parts to draw from.
EN_ROADS = ("Oak", "Madison", "Couch", "Memorial", "Maple", "Lake", "Sunset", "Highland")
EN_KINDS = ("St", "Ave", "Road", "Blvd", "Drive", "Lane")
EN_CITIES = (("Seattle", "WA"), ("Portland", "OR"), ("Miami", "FL"), ("Austin", "TX"), ("Denver", "CO"), ("Boston", "MA"))
ZH_CITIES = (("江苏省", "苏州市"), ("广东省", "广州市"), ("浙江省", "杭州市"), ("四川省", "成都市"))
ZH_DISTRICTS, ZH_ROADS = ("工业园区", "天河区", "西湖区", "武侯区"), ("青年路", "中山路", "南京路", "景明路")


def _pick(values: tuple, salt: str, seed: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64("id", F.lit(salt), F.lit(seed)), len(values)) + 1).cast("int"))


def _number(low: int, high: int, salt: str, seed: int) -> Column:
    return (F.pmod(F.xxhash64("id", F.lit(salt), F.lit(seed)), high - low) + low).cast("string")


def addresses(spark: SparkSession, rows: int, locale: str = "en", seed: int = 42) -> DataFrame:
    """(id, locale, text, format, components): four styles in turn - basic, with building or sub-parts, with detail, and city tail."""
    base = spark.range(rows)
    style = F.pmod(F.col("id"), 4)
    if locale == "en":
        at = F.pmod(F.xxhash64("id", F.lit("city"), F.lit(seed)), len(EN_CITIES)).cast("int")
        city, state = (F.get(F.array(*[F.lit(c[k]) for c in EN_CITIES]), at) for k in (0, 1))
        parts = {"number": _number(100, 9000, "n", seed), "road": F.concat_ws(" ", _pick(EN_ROADS, "r", seed), _pick(EN_KINDS, "k", seed)), "city": city, "province": state, "postal_code": _number(10000, 99999, "z", seed), "unit": F.concat(F.lit("Suite "), _number(100, 999, "u", seed))}
        p = lambda k: F.col(f"p.{k}")
        street, tail = F.concat_ws(" ", p("number"), p("road")), F.concat(p("city"), F.lit(", "), p("province"), F.lit(" "), p("postal_code"))
        text = F.when(style == 0, F.concat_ws(", ", street, tail)).when(style == 1, F.concat_ws(", ", street, p("unit"), tail)).when(style == 2, F.concat(p("unit"), F.lit(", "), tail)).otherwise(street)
        used = {0: ("number", "road", "city", "province", "postal_code"), 1: ("number", "road", "unit", "city", "province", "postal_code"), 2: ("unit", "city", "province", "postal_code"), 3: ("number", "road")}
        names = ("forward_basic", "forward_with_detail", "detail_tail", "street_only")
    elif locale == "zh":
        at = F.pmod(F.xxhash64("id", F.lit("city"), F.lit(seed)), len(ZH_CITIES)).cast("int")
        province, city = (F.get(F.array(*[F.lit(c[k]) for c in ZH_CITIES]), at) for k in (0, 1))
        parts = {"province": province, "city": city, "district": _pick(ZH_DISTRICTS, "d", seed), "road": _pick(ZH_ROADS, "r", seed), "number": F.concat(_number(1, 400, "n", seed), F.lit("号")), "building": F.concat(_number(1, 30, "b", seed), F.lit("号楼")), "room": F.concat(_number(101, 2000, "m", seed), F.lit("室"))}
        used = {0: tuple(parts), 1: ("city", "district", "road", "number"), 2: ("city", "road", "number", "building", "room"), 3: ("road", "number")}
        text = F.lit(None).cast("string")
        for k, keys in used.items():
            text = F.when(style == k, F.concat(*[F.col(f"p.{n}") for n in keys])).otherwise(text)
        names = ("forward_full", "forward_short", "forward_detail", "road_only")
    else:
        raise ValueError(f"no locale {locale!r}")
    rows_ = base.withColumn("p", F.struct(*[c.alias(k) for k, c in parts.items()]))
    kept = F.lit(None).cast("map<string,string>")
    for k, keys in used.items():
        kept = F.when(style == k, F.map_from_arrays(F.array(*[F.lit(n) for n in keys]), F.array(*[F.col(f"p.{n}") for n in keys]))).otherwise(kept)
    return rows_.select("id", F.lit(locale).alias("locale"), text.alias("text"), F.get(F.array(*[F.lit(n) for n in names]), style.cast("int")).alias("format"), kept.alias("components"))
