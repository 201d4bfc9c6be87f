"""Dictionaries: entries of personas and earlier turns, found in texts by an automaton or by a join, and looked up by value.

Entries: text, attr_type, role, component, strength, source. Small dictionaries, by their measured size, go to every task as an automaton; larger
ones meet the n-grams of the texts in a hash join, which needs no size bound. Both find the same matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions.matcher import FOLD_RUN, PLURALS, Matcher
from spanveil.functions.spans import plain

ENTRY = ("text", "attr_type", "role", "component", "strength", "source")
#: Largest dictionary that goes to every task, in entries and characters.
MOST_ENTRIES, MOST_CHARS = 200_000, 8_000_000
#: Strength of a dictionary term by its letters, digits and ideographs.
WEAK_CHARS, SOFT_CHARS = 1, 3


def fits(entries: DataFrame) -> bool:
    """Whether a dictionary is small enough for an automaton in every task; one aggregate over it."""
    n = entries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first()
    return n["n"] <= MOST_ENTRIES and n["c"] <= MOST_CHARS


def folded(text: Column) -> Column:
    """The folded form of a text, as ``matcher.fold`` has it: A-Z in lower case, l as i in runs of FOLD_RUN letters or more."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.regexp_extract_all(low, F.lit("[a-z]+|[^a-z]+"), F.lit(0))
    long = low.rlike("[a-z]{%d,}" % FOLD_RUN) & F.contains(low, F.lit("l"))
    return F.when(long, F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[a-z]{%d,}$" % FOLD_RUN), F.translate(r, "l", "i")).otherwise(r)), "")).otherwise(low)


def strength_by_length(text: Column) -> Column:
    n = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return F.when(n <= WEAK_CHARS, 0).when(n <= SOFT_CHARS, 1).otherwise(2)


def _scan(docs: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """(key, s, e, term): matches by an automaton that every task has."""
    terms = sorted({r["text"] for r in entries.select("text").distinct().collect()})
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher.of((t, t) for t in terms)
        shape = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("term", pa.string())]))
        for batch in batches:
            found = [[{"s": m.s, "e": m.e, "term": m.term} for m in matcher.find(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, shape)], [key, "found"])

    return docs.mapInArrow(run, f"`{key}` {kind}, found array<struct<s:int,e:int,term:string>>").select(key, F.inline("found"))


_TOKEN = r"[A-Za-z0-9]+|(?s:[^A-Za-z0-9])"


def _join(docs: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """The same matches by hash joins: runs of tokens (words, or single other characters) for terms in ASCII, runs of characters for
    others. Only lengths that some term has are made. Tokens are numbered and placed by one window a text."""
    terms = entries.select("text").distinct().withColumn("ascii", F.octet_length("text") == F.length("text"))
    tokens = F.regexp_extract_all(F.col("text"), F.lit(_TOKEN), F.lit(0))
    lengths = terms.select("ascii", F.when(F.col("ascii"), F.size(tokens)).otherwise(F.length("text")).alias("n")).distinct().collect()
    out = docs.select(key, F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit("").alias("term")).where("false")
    for ascii_ in (True, False):
        wanted = sorted(r["n"] for r in lengths if r["ascii"] == ascii_)
        if not wanted:
            continue
        parts = tokens if ascii_ else F.split("text", "")
        rows = docs.where("text <> ''").select(key, F.posexplode(parts).alias("i", "w")).where("w <> ''")
        w = Window.partitionBy(key).orderBy("i")
        rows = rows.withColumn("e", F.sum(F.length("w")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("s", F.col("e") - F.length("w"))
        grams = []
        for n in wanted:
            more = [F.lead("w", k).over(w) for k in range(1, n)]
            whole = F.concat("w", *more) if more else F.col("w")
            grams.append(F.struct(whole.alias("g"), F.lead("e", n - 1).over(w).alias("e")))
            if n == 1 and ascii_:  # a plural has the span of the whole word
                for ending in PLURALS:
                    stem = F.when(F.lower("w").endswith(ending) & F.col("w").rlike("^[A-Za-z0-9]+$"), F.expr(f"substring(w, 1, length(w) - {len(ending)})"))
                    grams.append(F.struct(stem.alias("g"), F.col("e").alias("e")))
        rows = rows.select(key, "s", F.array(*grams).alias("grams")).select(key, "s", F.inline("grams")).where("g is not null and e is not null")
        rows = rows.withColumn("g", folded(F.col("g"))) if ascii_ else rows
        dictionary = terms.where("ascii" if ascii_ else "not ascii").select(F.col("text").alias("term"), (folded(F.col("text")) if ascii_ else F.col("text")).alias("g"))
        found = rows.join(dictionary, "g").select(key, F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"), "term")
        out = out.unionByName(found)
    return out


def matches(docs: DataFrame, entries: DataFrame, key: str = "doc_id", text: str = "text", join: bool | None = None) -> DataFrame:
    """(key, s, e, term): where the entries' texts stand in ``docs``. ``join``: force one of the two ways; else the dictionary's size decides."""
    docs = docs.select(key, plain(F.col(text)).alias("text"))
    entries = entries.select(F.trim("text").alias("text")).where("text <> ''")
    return _join(docs, entries, key) if (not fits(entries) if join is None else join) else _scan(docs, entries, key)


def attach(docs: DataFrame, entries: DataFrame, key: str, out: str, text: str = "text") -> DataFrame:
    """``docs`` with ``out``: the entries that stand in each text, added to what the column already has. For dictionaries too large for every
    task."""
    found = matches(docs, entries, key, text, join=True).select(key, F.col("term").alias("_term")).distinct()
    full = entries.select(*ENTRY).join(found, F.col("text") == F.col("_term")).drop("_term")
    own = full.groupBy(key).agg(F.collect_list(F.struct(*ENTRY)).alias("_own"))
    empty = F.array().cast(dict(own.dtypes)["_own"])
    have = F.coalesce(F.col(out), empty) if out in docs.columns else empty
    return docs.join(own, key, "left").withColumn(out, F.concat(have, F.coalesce("_own", empty))).drop("_own")


def of_personas(slots: DataFrame) -> DataFrame:
    """Entries of persona slots: values and aliases; parts of names and addresses keep their component. A text of a type counts once."""
    terms = slots.select("attr_type", "component", "strength", F.explode(F.concat(F.array("value"), "aliases")).alias("text"))
    name = F.col("attr_type") == "name"
    role = F.when(name, F.when(F.col("component") == "middle", "given").otherwise(F.col("component"))).otherwise("value")
    level = F.when(F.col("attr_type") == "address", F.col("component")).otherwise("")
    strength = F.when(F.col("strength") == "hard", strength_by_length(F.col("text"))).when(F.col("strength") == "soft", 1).otherwise(0)
    rows = terms.select(F.trim("text").alias("text"), "attr_type", role.alias("role"), level.alias("component"), F.when(F.col("attr_type").isin("name", "organization", "address"), strength).otherwise(2).alias("strength"), F.lit("local").alias("source"))
    return rows.where("text <> ''").dropDuplicates(["text", "attr_type", "role", "component"])


def of_records(records: DataFrame) -> DataFrame:
    """(session_id, turn_id, entries): what each turn adds to the dictionary of its session. ``records``: session_id, turn_id, attr_type, source_text
    and, if there, components. Names give their parts, addresses their components."""
    parts = F.col("components") if "components" in records.columns else F.lit(None).cast("map<string,string>")
    entry = lambda text, role, component: F.struct(text.alias("text"), F.col("attr_type"), role.alias("role"), component.alias("component"), strength_by_length(text).alias("strength"), F.lit("session").alias("source"))
    text = F.trim("source_text")
    words = F.split(text, " +")
    latin_name = (F.col("attr_type") == "name") & text.rlike("^[A-Za-z][A-Za-z .'’-]*$") & (F.size(words) > 1)
    whole = F.array(entry(text, F.when(F.col("attr_type") == "name", "full").otherwise("value"), F.lit("")))
    names = F.when(latin_name, F.array(entry(words[0], F.lit("given"), F.lit("")), entry(F.element_at(words, -1), F.lit("family"), F.lit("")))).otherwise(F.array_except(whole, whole))
    pieces = F.when((F.col("attr_type") == "address") & parts.isNotNull(), F.transform(F.map_entries(parts), lambda p: entry(p["value"], F.lit("value"), p["key"]))).otherwise(F.array_except(whole, whole))
    rows = records.select("session_id", "turn_id", F.explode(F.concat(whole, names, pieces)).alias("x")).where("x.text <> ''")
    return rows.groupBy("session_id", "turn_id").agg(F.collect_set("x").alias("entries"))


def earlier_turns(requests: DataFrame, records: DataFrame, out: str = "terms") -> DataFrame:
    """``requests`` (session_id, turn_id, ...) with ``out``: the entries of earlier turns of the session, and of these alone."""
    turns = of_records(records)
    r, t = requests.select("session_id", "turn_id").distinct().alias("r"), turns.alias("t")
    seen = r.join(t, (F.col("r.session_id") == F.col("t.session_id")) & (F.col("t.turn_id") < F.col("r.turn_id")))
    own = seen.groupBy(F.col("r.session_id").alias("session_id"), F.col("r.turn_id").alias("turn_id")).agg(F.array_distinct(F.flatten(F.collect_list("t.entries"))).alias(out))
    return requests.join(own, ["session_id", "turn_id"], "left")


def lookup_keys(entries: DataFrame) -> DataFrame:
    """Entries of structured types by lookup key, one a key: session before local, the first by text. Names, addresses, organizations, e-mail and
    times have none."""
    from spanveil.operators.lookup import first_entries, with_keys

    rows = entries.where(~F.col("attr_type").isin("name", "address", "organization", "email", "time"))
    keyed = with_keys(rows, "text").withColumn("priority", F.struct(F.when(F.col("source") == "session", 0).otherwise(1).alias("a"), F.col("text").alias("b"), F.col("attr_type").alias("c")))
    return first_entries(keyed.select("lookup_key", "priority", F.col("attr_type").alias("known_type"), "source"))


def locked(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """``candidates`` (text, attr_type, ...) whose digits, or letters and digits, a dictionary knows: its type replaces the one found, and
    ``by_dictionary`` says so."""
    keys = lookup_keys(entries)
    digits, alnum = F.regexp_replace("text", "[^0-9]", ""), F.upper(F.regexp_replace("text", "[^A-Za-z0-9]", ""))
    key = F.when(F.col("attr_type").isin("email", "time", "amount"), None).when(F.col("text").rlike("[A-Za-z]"), alnum).otherwise(digits)
    rows = candidates.withColumn("lookup_key", key).join(keys.drop("source"), "lookup_key", "left")
    return rows.withColumn("attr_type", F.coalesce("known_type", "attr_type")).withColumn("by_dictionary", F.col("known_type").isNotNull()).drop("lookup_key", "known_type")
