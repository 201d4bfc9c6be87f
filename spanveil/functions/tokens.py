"""The unit tokenizer: every character of a text belongs to one unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What counts as one ideographic unit, the break marks of recognized text, and break characters.
CJK = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff"
OCR_BREAK, INLINE_GAP = "<OCR_BREAK>", "\ue000"
HARD_BREAKS, SOFT_BREAKS = ";；。！？!?", ",，、:：-—|\\/()（）"

UNIT = rf"{INLINE_GAP}|{OCR_BREAK}| |[{CJK}]|[A-Za-z][A-Za-z0-9]*|[0-9]+[A-Za-z][A-Za-z0-9]*|[0-9]+(?:[ -]?[0-9]+)*|(?s:.)"


def unit_texts(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))


def unit_kind(u: Column) -> Column:
    return (
        F.when(u == INLINE_GAP, "inline_gap")
        .when(u == OCR_BREAK, "ocr_break")
        .when(u == " ", "space")
        .when(u.rlike(f"^[{CJK}]$"), "cjk_char")
        .when(u.rlike("^[A-Za-z]+$"), "ascii_word")
        .when(u.rlike("^[A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*$"), "alnum_run")
        .when(u.rlike("^[0-9]"), "digit_run")
        .when(u.rlike(r"^\p{P}$"), "punct")
        .otherwise("other_char")
    )


def units(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, unit_id, kind, text, char_start, char_end), one row a unit. Offsets are a running sum by key."""
    rows = df.select(key, F.posexplode(unit_texts(F.col(text))).alias("unit_id", "text"))
    upto = Window.partitionBy(key).orderBy("unit_id").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text")).over(upto)
    return rows.select(key, "unit_id", unit_kind(F.col("text")).alias("kind"), "text", (end - F.length("text")).alias("char_start"), end.alias("char_end"))


def kind_counts(df: DataFrame) -> DataFrame:
    """(kind, n) over all texts. Counted a text at a time, so single units never reach a shuffle."""
    return df.select(F.explode(unit_texts(F.col("text"))).alias("u")).groupBy(unit_kind(F.col("u")).alias("kind")).agg(F.count("*").alias("n"))
