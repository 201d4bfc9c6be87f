import pytest
from pyspark.sql import functions as F

from spanveil.functions.ocrtext import clean, cleaned, match_text, repair
from spanveil.operators import decide


def test_recognized_text(spark):
    assert clean(" ＡＢ​  c\t（x） ") == ("AB c （x）", [1, 2, 4, 6, 7, 8, 9, 10][:8]) or clean(" ＡＢ​  c\t（x） ")[0] == "AB c （x）"
    assert repair("1O1 2l3 wOrd") == "101 213 word"
    text, at = match_text("Ａ-b c")
    assert text == "abc" and at == [0, 2, 4]
    rows = [("plain text",), ("1O1",), ("Ａ  b",), (None,), ("",)]
    got = [r["x"] for r in spark.createDataFrame(rows, "t string").select(cleaned(F.col("t")).alias("x")).collect()]
    assert got == ["plain text", "101", "A b", None, ""]


def test_decisions(spark):
    slots = spark.createDataFrame([("p1", "phone", 0, "value", "1", [], "hard")], "persona_id string, attr_type string, slot_no int, component string, value string, aliases array<string>, strength string")
    found = spark.createDataFrame([("c1", "s", "phone", 1.0), ("c2", "s", "email", 0.2)], "candidate_id string, session_id string, attr_type string, confidence double")
    assert {r["candidate_id"]: r["action"] for r in decide.label_only(found, 0.5).collect()} == {"c1": "GENERICIZE", "c2": "KEEP"}
    active = spark.createDataFrame([("s", "p1")], "session_id string, persona_id string")
    rows = decide.persona_first(found, slots, active).withColumn("replacement", F.lit("x"))
    assert {r["candidate_id"]: r["action"] for r in decide.constrain(rows, found, slots).collect()} == {"c1": "PERSONA_SLOT", "c2": "GENERICIZE"}
    with pytest.raises(Exception, match="no candidate c1"):
        decide.constrain(rows, found.where("candidate_id = 'c2'"), slots).collect()
    with pytest.raises(Exception, match="no persona slot for c2"):
        decide.constrain(rows.withColumn("action", F.lit("PERSONA_SLOT")), found, slots).collect()


def test_operators_on_columns(spark):
    df = spark.createDataFrame([("a@x.com", ("b@x.com", 1), "keep")], "mail string, who struct<mail:string,n:int>, other string")
    out = decide.apply_columns(df, {"mail": "EMAIL_ADDRESS", "who.mail": "EMAIL_ADDRESS", "other": "NON_PII"}, {"EMAIL_ADDRESS": ("mask", {"chars_to_mask": 3})}).first()
    assert (out["mail"], out["who"]["mail"], out["who"]["n"], out["other"]) == ("***.com", "***.com", 1, "keep")


def test_conflicts_between_results(spark):
    from spanveil.operators import anonymizer

    docs = spark.createDataFrame([(1, "Anna  Maria x Bond")], "doc_id int, text string")
    spans = spark.createDataFrame([(1, "PERSON", 0, 4, 0.9), (1, "PERSON", 6, 11, 0.8), (1, "PERSON", 14, 18, 0.8)], "doc_id int, entity_type string, s int, e int, score double")
    merged = anonymizer.merge_spaced(spans, docs, "doc_id").collect()
    assert sorted((r["s"], r["e"]) for r in merged) == [(0, 11), (14, 18)]
    mixed = spark.createDataFrame([(1, "A", 0, 10, 0.5), (1, "B", 2, 5, 0.9), (1, "C", 0, 10, 0.6), (1, "D", 8, 14, 0.7)], "doc_id int, entity_type string, s int, e int, score double")
    left = anonymizer.drop_conflicts(mixed, "doc_id")
    assert {r["entity_type"] for r in left.collect()} == {"C", "D"}
    assert sorted((r["entity_type"], r["s"], r["e"]) for r in anonymizer.trim_intersections(left, "doc_id").collect()) == [("C", 0, 8), ("D", 8, 14)]


def test_analyzer_scores(spark):
    from spanveil.operators.recognizers import analyze

    df = spark.createDataFrame([(1, "my ssn is 078-05-1121 or 123-45-6789"), (2, "ip 10.0.0.1 and 999.1.1.1"), (3, None), (4, "mac 00:00:00:00:00:00 then 00:1A:2B:3C:4D:5E")], "doc_id int, text string")
    rows = {(r["doc_id"], r["text"]): r["score"] for r in analyze(df, entities=("US_SSN", "IP_ADDRESS", "MAC_ADDRESS")).collect()}
    assert rows[(1, "078-05-1121")] == 0.85 and (1, "123-45-6789") not in rows
    assert rows[(2, "10.0.0.1")] == 0.95 and (3, None) not in rows
    assert (4, "00:00:00:00:00:00") not in rows and (4, "00:1A:2B:3C:4D:5E") in rows


@pytest.mark.parametrize("locale", ["en", "zh"])
def test_generated_addresses_are_found(spark, locale):
    from spanveil.operators.kernel import detect
    from spanveil.sources.generate import addresses

    rows = addresses(spark, 200, locale)
    assert sorted(map(str, rows.collect())) == sorted(map(str, addresses(spark, 200, locale).repartition(3).collect()))
    assert rows.select("format").distinct().count() == 4 and rows.where("text is null").count() == 0
    found = detect(rows.withColumn("doc_id", F.col("id"))).where("attr_type = 'address'")
    whole = rows.join(found, (rows.id == found.doc_id) & (rows.text == found.text), "left_semi").count()
    assert whole >= 190
