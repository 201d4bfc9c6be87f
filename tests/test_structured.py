import re

import pytest
from pyspark.sql import functions as F

from spanveil.functions import checks, normalize, validators
from spanveil.functions.spans import find_spans, plain, splice, union_length
from spanveil.operators.structured import candidates


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,emails",
    [
        ("邮箱 foo_xyz-xyz.xyz@gmail.com. I am", ["foo_xyz-xyz.xyz@gmail.com"]),
        ("(foo@gmail.com)", ["foo@gmail.com"]),
        ("foo@gmail.comabc", []),
        ("foo@gmail.com_xyz", []),
        ("我的kctfqcb33@163.com", ["kctfqcb33@163.com"]),
        ("", []),
        (None, []),
    ],
)
def test_emails_and_their_borders(spark, text, emails):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    found = candidates(df).where("attr_type = 'email'").collect()
    assert [r["text"] for r in found] == emails


@pytest.mark.parametrize("text", ["2024年", "35%", "第12条", "No.123", "15kg"])
def test_numbers_that_are_not_private(spark, text):
    assert candidates(spark.createDataFrame([(1, text)], "doc_id int, text string")).where("attr_type = 'num'").count() == 0


@pytest.mark.parametrize(
    "text,attr,canonical,emitted",
    [
        ("+1 (743) 555-3824", "num", "+17435553824", True),
        ("电话（86）13800000001", "phone", "13800000001", True),
        ("4111111111111111", "bank_number", "4111111111111111", True),
        ("4111111111111112", "num", "4111111111111112", True),
        ("341234560512345", "id_number", "341234560512345", True),
        ("well-known", "alnum", "WELLKNOWN", True),
        ("a1", "alnum", "A1", False),
        ("1234", "num", "1234", False),
    ],
)
def test_routes_and_gate(spark, text, attr, canonical, emitted):
    rows = candidates(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert [(r["attr_type"], r["canonical"], r["emitted"]) for r in rows] == [(attr, canonical, emitted)]


def test_addresses_of_machines_are_not_numbers(spark):
    df = spark.createDataFrame([(1, "152.143.123.131")], "doc_id int, text string")
    assert candidates(df).where("emitted").count() == 0


def test_spans_agree_with_a_regular_expression_engine(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = docs.select("doc_id", plain(F.col("text")).alias("t")).select("doc_id", find_spans(F.col("t"), "[0-9]{2,}").alias("x")).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        assert [(x["s"], x["e"], x["text"]) for x in r["x"]] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]{2,}", texts[r["doc_id"]])]


def test_offsets_count_code_points(spark):
    df = spark.createDataFrame([("é你😀12x34",)], "t string")
    assert [tuple(x) for x in df.select(find_spans(F.col("t"), "[0-9]+").alias("x")).first()["x"]] == [(3, 5, "12"), (6, 8, "34")]


def test_splice_and_union(spark):
    df = spark.createDataFrame([("abcdef", [(1, 2, "XX"), (4, 6, "")])], "t string, e array<struct<s:int,e:int,new:string>>")
    assert df.select(splice(F.col("t"), F.col("e")).alias("x")).first()["x"] == "aXXcd"
    df = spark.createDataFrame([([(0, 3), (2, 5), (5, 6), (9, 10)],)], "e array<struct<s:int,e:int>>")
    assert df.select(union_length(F.col("e")).alias("x")).first()["x"] == 7


@pytest.mark.parametrize(
    "f,text,want",
    [
        (normalize.phone, "+86 138-0000-0001", "13800000001"),
        (normalize.phone, "+1 (202) 555-0111", "2025550111"),
        (normalize.phone, "+44 20 7946 0958", "442079460958"),
        (normalize.email, "A.b+c @Example.com", "a.b+c@example.com"),
        (normalize.name, "keVIN dANiEI", "kevln danlel"),
        (normalize.alnum, "ab-12 cd", "AB12CD"),
        (normalize.plate, "粤b h15z0", "粤BH15Z0"),
        (normalize.amount, "USD 12", "12"),
        (normalize.amount, "1,234.50", "1"),
        (normalize.digits, "6222 0000 1234 5678", "6222000012345678"),
        (validators.content_shape, "john.doe", "alnum"),
        (validators.content_shape, "123_456", "num"),
        (validators.content_shape, "9:05", "time"),
        (validators.content_shape, "word", None),
    ],
)
def test_canonical_forms(spark, f, text, want):
    assert one(spark, f(F.col("t")), t=text) == want


def test_organizations_lose_their_legal_form(spark):
    from spanveil.functions.lexicons import ORG_SUFFIXES, ZH_ORG_SUFFIXES

    every = (*ORG_SUFFIXES, *ZH_ORG_SUFFIXES)
    assert one(spark, normalize.organization(F.col("t"), every), t="想的美工作室") == "想的美"
    assert one(spark, normalize.organization(F.col("t"), every), t="Acme Holdings Ltd") == "acme"


@pytest.mark.parametrize(
    "f,good,bad",
    [
        (checks.abn, "51824753556", "51824753557"),
        (checks.acn, "004085616", "004085617"),
        (checks.tfn, "876543210", "876543211"),
        (checks.verhoeff, "2363", "2364"),
        (checks.pesel, "44051401359", "44051401358"),
        (checks.nhs, "9434765919", "9434765918"),
        (checks.aba, "111000025", "111000026"),
        (checks.npi, "1245319599", "1245319598"),
        (checks.iban, "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"),
        (checks.es_letter, "12345678Z", "12345678A"),
        (checks.es_letter, "X1234567L", "X1234567M"),
        (checks.fi_code, "131052-308T", "131052-308U"),
        (checks.de_tax, "86095742719", "86095742718"),
        (validators.cn_id18, "11010519491231002X", "110105194912310021"),
        (checks.kvnr, "A123456787", "A123456781"),
        (checks.rvnr, "15070649C102", "15070649C104"),
        (checks.gstin, "27ABCDE1234F1Z5", "39ABCDE1234F1Z5"),
        (checks.it_fiscal, "RSSMRA85T10A562S", "RSSMRA85T10A562T"),
    ],
)
def test_checksums(spark, f, good, bad):
    assert one(spark, f(F.col("t")), t=good) is True
    assert not one(spark, f(F.col("t")), t=bad)


def test_queries_keep_numbers_and_hosts_of_all_kinds(spark, tmp_path):
    from spanveil.plans import queries

    def good(n, body="37828224631000"):  # Luhn check digit
        d = [int(c) for c in body]
        total = sum((2 * x - 9 if x > 4 else 2 * x) if i % 2 == 0 else x for i, x in enumerate(reversed(d)))
        return body + str(-total % 10)

    weights = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
    ids = [b + "10X98765432"[sum(int(c) * w for c, w in zip(b, weights, strict=True)) % 11] for b in (f"11010119900307{i:03d}" for i in range(40))]
    ids = [x for x in ids if x.isdigit()]
    pan18, amex = good(18, "62220210011223344"), good(15)
    texts = [*(f"id {x} end" for x in ids), f"card {pan18}", f"amex {amex} or 4111-1111-1111-1111 or 4111 1111 1111 1111", "write to jo@example.org or amy@mail.com", "nothing"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path)).collect()
    route = {r["text"]: r["check_name"] for r in run("structured_route")}
    assert len(ids) > 30 and route == {**{x: "validated_id_cn_18" for x in ids}, pan18: "validated_bank_number_pan", amex: route[amex]}
    assert {(r["text"], r["s"]) for r in run("analyze_email")} == {("jo@example.org", 9), ("amy@mail.com", 27)}
    assert {amex, "4111-1111-1111-1111", "4111 1111 1111 1111"} <= {r["text"] for r in run("analyze_card")}


def test_cards_of_16_digits_agree_with_sql(spark, tmp_path, same):
    import duckdb

    from spanveil.plans import queries

    numbers = ["1232810148878564", "1704182936937500", "4111111111111111", "5555555555554444", "6011111111111117", "3530111333300000", "4111111111111112"]
    frame = spark.createDataFrame([(i, f"card {n} end") for i, n in enumerate(numbers)], "doc_id long, text string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.analyze_card(spark, str(tmp_path)).toPandas()
    same(got, con.execute(queries.ORACLE_SQL["analyze_card"]).df())
    assert sorted(got["doc_id"]) == [2, 3, 4, 5]


def test_airline_cards_stay(spark, tmp_path):
    from spanveil.plans import queries

    spark.createDataFrame([(1, "card 122000000000003 or 1232-8101-4887-8564")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r["text"] for r in queries.analyze_card(spark, str(tmp_path)).collect()] == ["122000000000003"]
