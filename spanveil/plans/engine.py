"""The engine: sanitize and restore tables of texts, with pluggable steps, and SQL functions of the same operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from spanveil.functions import normalize
from spanveil.functions.spans import plain
from spanveil.operators import dictionary, placeholders
from spanveil.operators.decide import label_only
from spanveil.operators.kernel import detect, detect_text
from spanveil.operators.structured import candidates, merge_numbers
from spanveil.sources import repository, store
from spanveil.streaming.sessions import allocate


def detect_all(requests: DataFrame, protection: str, local: DataFrame | None = None, locale: str = "mixed") -> DataFrame:
    """(doc_id, s, e, text, attr_type, canonical, components): structured entities that pass the gate, and the kernel's outside of them; an
    address or plate swallows the numbers and codes that lie in it.

    ``local``: dictionary entries for all requests. Column ``terms`` of ``requests``, if there, has entries of each request's own, from earlier
    turns. Structured values that a dictionary knows have its type."""
    none = F.lit(None).cast("map<string,string>")
    hard = merge_numbers(candidates(requests.select("doc_id", "text")).select("doc_id", "plain_text", "s", "e", "text", "attr_type", "canonical", "emitted"))
    if local is not None:
        hard = dictionary.locked(hard, local).withColumn("emitted", F.col("emitted") | F.col("by_dictionary"))
        hard = hard.withColumn("canonical", F.when(F.col("by_dictionary"), normalize.canonical(F.col("attr_type"), F.col("text"))).otherwise(F.col("canonical")))
    hard = hard.where("emitted").select("doc_id", "s", "e", "text", "attr_type", "canonical", none.alias("components"))
    soft = detect(requests, protection=protection, locale=locale, terms="terms" if "terms" in requests.columns else None, local=local)
    soft = soft.select("doc_id", "s", "e", "text", "attr_type", normalize.canonical(F.col("attr_type"), F.col("text")).alias("canonical"), F.when(F.size("components") > 0, F.col("components")).alias("components"))
    a, b = hard.alias("a"), soft.alias("b")
    outside = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("b.s") < F.col("a.e")) & (F.col("a.s") < F.col("b.e")), "left_anti")
    return outside.unionByName(soft)


class Engine:
    """Steps are looked up by name, so any can be replaced: detect, decide, allocate, rewrite, restore, save, load, personas. Slots that the
    caller's runtime needs beyond tables (recognition of pixels, drawing) are not here."""

    def __init__(self, spark: SparkSession, protection: str = "strong", locale: str = "mixed", local: DataFrame | None = None, **steps: Callable):
        self.spark = spark
        self.protection = protection if protection in ("strong", "balanced", "weak") else "strong"
        self.locale, self.local = locale, local
        self.steps: dict[str, Callable] = {
            "detect": lambda requests, protection: detect_all(requests, protection, self.local, self.locale),
            "decide": label_only,
            "allocate": allocate,
            "rewrite": placeholders.rewrite,
            "restore": placeholders.restore,
            "save": store.save_turns,
            "load": store.load,
            "personas": repository.read_personas,
        }
        for name, step in steps.items():
            self.register(name, step)

    def register(self, name: str, step: Callable) -> None:
        if name not in self.steps:
            raise KeyError(f"no step {name!r}")
        self.steps[name] = step

    def use_personas(self, slots: DataFrame) -> None:
        """Take another dictionary; what is sanitized from now on sees it, since nothing of the old one is kept."""
        self.local = dictionary.of_personas(slots)

    def write_privacy_repository(self, slots: DataFrame, path: str) -> DataFrame:
        """Merge validated ``slots`` into the stored ones under ``path``, and use the result from now on."""
        merged = repository.merge_write(repository.validated(slots), path)
        self.use_personas(merged)
        return merged

    def sanitize(self, requests: DataFrame, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(texts, records) of ``requests`` (session_id, turn_id, text): texts have ``sanitized``; records are the replacements, with
        ``planned`` and ``applied``. ``history``: records of former runs; those of earlier turns of a session are its dictionary."""
        requests = requests.withColumn("session_id", F.col("session_id").cast("string")).withColumn("text", plain(F.col("text"))).withColumn("doc_id", F.concat_ws("|", "session_id", "turn_id"))
        seen = dictionary.earlier_turns(requests, history) if history is not None else requests
        found = self.steps["decide"](self.steps["detect"](seen, self.protection)).where("action <> 'KEEP'")
        keyed = found.join(requests.select("doc_id", "session_id", F.col("turn_id").cast("long").alias("turn_id")), "doc_id")
        numbered = self.steps["allocate"](keyed)
        ends = keyed.select("session_id", "turn_id", F.col("s").cast("long").alias("s"), "e", "doc_id", "components")
        records = numbered.join(ends, ["session_id", "turn_id", "s"]).withColumn("action", F.lit("GENERICIZE")).withColumn("planned", F.lit(True)).withColumn("applied", F.lit(True))
        texts = self.steps["rewrite"](requests, records.select("doc_id", F.col("s").cast("int").alias("s"), "e", "placeholder"), "doc_id")
        return texts.drop("doc_id"), records.withColumnRenamed("text", "source_text").drop("doc_id")

    def restore(self, answers: DataFrame, records: DataFrame) -> DataFrame:
        """``answers`` (session_id, turn_id, text) with ``restored``: only the records of the same turn count. An address comes back with the parts
        that its placeholder's SPEC names."""
        known = records.select("session_id", "turn_id", "placeholder", "source_text", "components", F.col("s").alias("first_seen"))
        return self.steps["restore"](answers.withColumn("session_id", F.col("session_id").cast("string")).withColumn("turn_id", F.col("turn_id").cast("long")), known, ["session_id", "turn_id"])

    def register_sql(self) -> None:
        """SQL users get ``detect_pii(text)``, a table function, and ``mask_pii(text)``."""

        @udtf(returnType="s int, e int, text string, attr_type string, strength int")
        class DetectPii:
            def eval(self, text: str):
                for x in detect_text(text):
                    yield x.s, x.e, text[x.s : x.e], x.attr, x.strength

        self.spark.udtf.register("detect_pii", DetectPii)

        @F.pandas_udf("string")
        def mask_pii(texts):
            def one(t):
                for x in reversed(detect_text(t)):
                    t = t[: x.s] + f"<{x.attr.upper()}>" + t[x.e :]
                return t

            return texts.map(one)

        self.spark.udf.register("mask_pii", mask_pii)
