import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanveil.operators import anonymizer, entities, evaluate, geometry, joins
from spanveil.operators.kernel import detect, detect_text
from spanveil.plans.engine import Engine
from spanveil.sources import repository, store
from spanveil.streaming import sessions


@pytest.mark.parametrize(
    "text,want",
    [
        ("815 Madison Ave", [("815 Madison Ave", "address")]),
        ("922 Memorial Dr SE", [("922 Memorial Dr SE", "address")]),
        ("Biscayne Commerce Hall", [("Biscayne Commerce Hall", "address")]),
        ("Suite 320, Miami, FL 33131", [("Suite 320, Miami, FL 33131", "address")]),
        ("245 Couch St, Burnside Offices, Suite 1708, Portland, OR 97205", [("245 Couch St, Burnside Offices, Suite 1708, Portland, OR 97205", "address")]),
        ("note 123 alpha beta", []),
        ("住址道路：景明路187号。", [("景明路187号", "address")]),
        ("苏州市工业园区青年路323号国际广场1号楼5层1581室", [("苏州市工业园区青年路323号国际广场1号楼5层1581室", "address")]),
        ("187号", []),
        ("欧阳南京路88号", [("欧阳", "name"), ("南京路88号", "address")]),
        ("陈南宁路88号", [("南宁路88号", "address")]),
        ("My name is James Bond, from Acme Trading Inc.", [("James Bond", "name"), ("Acme Trading Inc.", "organization")]),
        ("", []),
        (None, []),
    ],
)
def test_kernel(text, want):
    assert [(text[x.s : x.e], x.attr) for x in detect_text(text)] == want


def test_protection_levels():
    assert detect_text("met Alice Qwerty there", protection="strong") and not detect_text("met Alice Qwerty there", protection="weak")


@pytest.mark.parametrize(
    "a,b,want",
    [
        ({"city": "Bellevue", "road": "Main Street", "unit": "Apt 205"}, {"city": "Bellevue", "road": "Main Street", "unit": "#205"}, True),
        ({"road": "Main Street", "unit": "Apt 205"}, {"road": "Main Street", "suite": "205"}, False),
        ({"suite": "300"}, {"suite": "320"}, False),
        ({"text": "中山路"}, {"road": "中山路"}, False),
        ({"road": "中山路", "room": "101室"}, {"road": "中山路"}, True),
        ({"road": "中山路", "room": "101室"}, {"road": "中山路", "room": "201室"}, False),
    ],
)
def test_same_address(a, b, want):
    assert entities.same_address(a, b) is want
    assert entities.same_address(b, a) is want


def test_same_names_and_numbers():
    assert entities.same_name("Alice", "Alice Brown") and not entities.same_name("José", "José") and entities.same_name("José", "José", strict=True)
    assert entities.same_organization("Think Beauty Studio", "think beauty") and not entities.same_organization("A", "")
    assert entities.numbers_agree(["101"], ["201", "101"]) and entities.numbers_agree(["101"], ["301", "201", "101"])
    assert entities.numbers_agree(["101", "202"], ["303", "101", "202", "505"]) and not entities.numbers_agree(["101", "202"], ["303", "101", "404", "505"])


def test_address_specs_and_numbers_of_a_session():
    s = entities.Session()
    one = s.number("address", "x", "x", {"city": "上海", "district": "浦东新区", "poi": "阳光国际", "building": "10", "detail": "102"})
    two = s.number("address", "y", "y", {"city": "上海", "district": "浦东", "poi": "阳光", "building": "10", "detail": "102"})
    assert one is two and entities.placeholder(two, "y", {"city": "上海", "district": "浦东", "detail": "102"}) == "[[ADDR#1.CITY-DIST-DTL]]"
    assert entities.placeholder(two, "z", {"road": "中山路"}) == "[[ADDR#1.ROAD]]"
    assert entities.placeholder(s.number("address", "百亿补贴", "百亿补贴"), "百亿补贴") == "[[ADDR#2]]"
    assert entities.project(one.components, "CITY") == "上海"
    a = entities.Aliases()
    assert [a.alias("email", "a@x"), a.alias("email", "b@x"), a.alias("email", "a@x"), a.alias("email", "a@x", 0.5)] == ["email:1", "email:2", "email:1", "email:3"]


ROWS = [("s1", 1, 0, "email", "a@x.com", "a@x.com"), ("s1", 1, 9, "name", "alice brown", "Alice Brown"), ("s1", 2, 4, "name", "alice", "Alice"), ("s1", 2, 9, "email", "a@x.com", "A@x.com"), ("s2", 1, 0, "num", "12345", "12345")]
DDL = "session_id string, turn_id int, s int, attr_type string, canonical string, text string"
WANT = [("s1", 1, 0, "[[EMAIL#1]]"), ("s1", 1, 9, "[[NAME#2]]"), ("s1", 2, 4, "[[NAME#2]]"), ("s1", 2, 9, "[[EMAIL#1]]"), ("s2", 1, 0, "[[NUM#1.LEN=5]]")]


@pytest.mark.parametrize("partitions", [1, 4])
def test_batch_allocation(spark, partitions):
    out = sessions.allocate(spark.createDataFrame(ROWS, DDL).repartition(partitions)).collect()
    assert sorted((r["session_id"], r["turn_id"], r["s"], r["placeholder"]) for r in out) == WANT


def test_stream_replay_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, DDL)
    for turn in (1, 2):
        rows.where(f"turn_id = {turn}").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sessions.allocate_stream(stream).writeStream.foreachBatch(sessions.upsert(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = sessions.read_store(spark, str(tmp_path / "out")).collect()
    assert sorted((r["session_id"], r["turn_id"], r["s"], r["placeholder"]) for r in out) == WANT


def test_engine_round_trip(spark):
    rows = spark.createDataFrame([("s", 1, "My name is James Bond, mail a@x.com"), ("s", 2, None), ("t", 1, "电话（86）13800000001")], "session_id string, turn_id int, text string")
    texts, records = Engine(spark).sanitize(rows)
    got = {(r["session_id"], r["turn_id"]): r["sanitized"] for r in texts.collect()}
    assert got[("s", 1)] == "My name is [[NAME#1]], mail [[EMAIL#2]]" and "13800000001" not in got[("t", 1)]
    back = Engine(spark).restore(texts.select("session_id", "turn_id", F.col("sanitized").alias("text")), records)
    assert {r["restored"] for r in back.collect()} == {"My name is James Bond, mail a@x.com", "", "电话（86）13800000001"}
    other = spark.createDataFrame([("s", 2, "[[NAME#1]] and [[NAME#9]]")], "session_id string, turn_id int, text string")
    assert Engine(spark).restore(other, records).first()["restored"] == "[[NAME#1]] and [[NAME#9]]"


def test_store_replaces_a_turn(spark, tmp_path):
    ddl = "session_id string, turn_id int, placeholder string, source_text string, action string"
    path = str(tmp_path / "store")
    store.save_turns(spark.createDataFrame([("s", 1, "[[A#1]]", "a", "GENERICIZE"), ("s", 2, "[[B#2]]", "b", "GENERICIZE"), ("u", 1, "[[C#1]]", "c", "KEEP")], ddl), path)
    store.save_turns(spark.createDataFrame([("s", 2, "[[D#3]]", "d", "GENERICIZE")], ddl), path)
    assert sorted(r["source_text"] for r in store.load(spark, path, session="s").collect()) == ["a", "d"]
    assert store.load(spark, path, placeholder="[[A#1]]").count() == 1 and store.load(spark, path, session="u").count() == 0


def test_personas(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"true_personas": [{"persona_id": "p1", "slots": {"name": [{"full": {"value": "Alice Brown", "aliases": ["Ally"]}}], "phone": [{"value": "1", "aliases": []}, {"value": "2"}], "address": [{"components": [{"level": "city", "value": "Paris"}]}]}}]}', encoding="utf-8")
    rows = repository.slots(repository.read_personas(spark, str(tmp_path / "p.json")))
    assert rows.count() == 4
    merged = repository.merge_slots(rows, rows.where("attr_type = 'phone'").limit(1)).where("attr_type = 'phone'")
    assert merged.count() == 2
    assert {r["term"] for r in repository.dictionary(rows).collect()} == {"Alice Brown", "Ally", "1", "2", "Paris"}
    picked = repository.pick_slot(spark.createDataFrame([("p1", "phone", "555")], "persona_id string, attr_type string, text string"), rows).first()
    assert picked["replacement"] in ("1", "2")


def test_anonymizer(spark):
    docs = spark.createDataFrame([(1, "My name is Bond, James Bond"), (2, None)], "doc_id int, text string")
    spans = spark.createDataFrame([(1, "PERSON", 11, 15), (1, "PERSON", 17, 27)], "doc_id int, entity_type string, s int, e int")
    texts, items = anonymizer.anonymize(docs, spans, "doc_id", {"PERSON": ("replace", {"new_value": "BIP"})})
    assert {r["doc_id"]: r["anonymized"] for r in texts.collect()} == {1: "My name is BIP, BIP", 2: None}
    assert sorted((r["s"], r["e"]) for r in items.collect()) == [(11, 14), (16, 19)]
    with pytest.raises(ValueError):
        anonymizer.hashed(F.lit("x"), F.lit(""), {"salt": "short"})
    ops = anonymizer.Operators()
    ops.add("shout", lambda t, e, p: F.upper(t))
    texts, _ = anonymizer.anonymize(docs, spans, "doc_id", {"DEFAULT": ("shout", {})}, ops)
    assert texts.where("doc_id = 1").first()["anonymized"] == "My name is BOND, JAMES BOND"


def test_tagged_texts(spark):
    df = spark.createDataFrame([(1, "a【PII:NAME:1】Bob【/PII】c【PII:TEL:2】12【/PII】"), (2, "plain")], "k int, text_with_tags string")
    texts, known = evaluate.read_tagged(df, "k")
    assert {r["k"]: r["text"] for r in texts.collect()} == {1: "aBobc12", 2: "plain"}
    assert sorted((r["entity_type"], r["s"], r["e"], r["text"]) for r in known.collect()) == [("NAME", 1, 4, "Bob"), ("TEL", 5, 7, "12")]


BLOCKS = [("i", "l1", "Name", 20, 0, 60, 20), ("i", "v1", "QaROIIne mCinTyRe", 20, 26, 160, 20), ("i", "l2", "Email Address", 20, 60, 120, 20), ("i", "l3", "Mobile number", 20, 120, 120, 20), ("i", "x", " ", 500, 0, 10, 10)]
BLOCK_DDL = "image_id string, block_id string, text string, x int, y int, width int, height int"


def test_geometry(spark):
    blocks = spark.createDataFrame(BLOCKS, BLOCK_DDL)
    order = geometry.reading_order(geometry.usable(blocks)).orderBy("position").collect()
    assert [r["block_id"] for r in order] == ["l1", "v1", "l2", "l3"]
    labels = spark.createDataFrame([("i", "l1", "name"), ("i", "l2", "email"), ("i", "l3", "phone")], "image_id string, block_id string, attr_type string")
    bound = {r["label_id"]: r["value_id"] for r in geometry.bind_labels(geometry.usable(blocks), labels).collect()}
    assert bound["l1"] == "v1"
    assert geometry.trusted_labels(blocks.join(labels, ["image_id", "block_id"])).count() == 3
    s = geometry.stitched(blocks).first()
    at = {x["block_id"]: x["start"] for x in s["starts"]}
    assert s["text"][at["l2"] :].startswith("Email Address")
    poly = spark.createDataFrame([([(0.4, 1.2), (10.1, 5.0)],)], "p array<struct<x:double,y:double>>")
    assert tuple(poly.select(geometry.box(F.col("p")).alias("b")).first()["b"]) == (0, 1, 11, 4)


def test_band_and_asof_edges(spark):
    empty = spark.createDataFrame([], "doc_id int, attr_type string, at int")
    one = spark.createDataFrame([(1, "name", 5)], "doc_id int, attr_type string, at int")
    assert joins.band_boost(one, empty, "doc_id").first()["boost"] == 0
    assert joins.band_boost(empty, one, "doc_id").count() == 0


def test_fold_keeps_first_match():
    out = sessions.fold(entities.Session(), pd.DataFrame([(*r, None) for r in ROWS[:3]], columns=["session_id", "turn_id", "s", "attr_type", "canonical", "text", "parts"]))
    assert out.entity_id.tolist() == [1, 2, 2]


def test_chains_of_a_whole_table_against_brute_force(spark):
    from collections import defaultdict

    from spanveil.plans import queries

    sf_dir = "/root/testdata/sf0.01"
    pages = defaultdict(list)
    for (k,) in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").collect():
        pages[k // 50].append((k, k * 37 % 600, k * 91 % 900))
    want = set()
    for page, blocks in pages.items():
        for k, x, y in blocks:
            right = min(((u, i) for i, u, v in blocks if i != k and abs(v - y) < 20 and u >= x + 40), default=(0, -1))[1]
            below = min(((v, i) for i, u, v in blocks if i != k and v >= y + 20 and abs(u - x) <= 20), default=(0, -1))[1]
            want.add((page, k, right, below))
    got = [tuple(r) for r in queries.QUERIES["ocr_page_chains"](spark, sf_dir).select("image_id", "block_id", "right_id", "below_id").collect()]
    assert len(got) == len(want) > 2000 and set(got) == want
    assert sum(r[2] >= 0 for r in got) > 1000 and sum(r[3] >= 0 for r in got) > 1000


def test_detect_is_detect_text_of_every_row(spark):
    import random

    texts = ["we met at Acme limited", "Acme & Sons limited", "ship it to 12a Main street", "ship it to 798 8th street", "she lives at Riverside homes", "ask James-Smith", "name：James", "call me 王小明", "no entity here", "12 x street", "", None]
    parts = ["acme", "Acme", "james", "James", "smith", "Smith", "inc", "limited", "12", "12a", "8th", "21st", "main", "street", "homes", "suite 3", "#4", "name", "address", ":", "：", "my name is", "i am", "我叫", "王小明", "粤B12345", "OR", "or", "97205", "usa", "ſt", "ıs", "this is", "\xa0", "\u2003", "\n", "&", ",", "-", "’", "Main", "Street", "上海", "路", "12号", "是", "公司"]
    rng = random.Random(1)
    texts += [rng.choice(["", " ", "\n"]).join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted((r["doc_id"], r["s"], r["e"], r["attr_type"]) for r in detect(rows, hard=False).collect())
    want = sorted((i, x.s, x.e, x.attr) for i, t in enumerate(texts) for x in detect_text(t))
    assert got == want and {g[0] for g in got} >= {0, 1, 2, 3, 4, 5, 6, 7}
    for t in texts:  # spans are disjoint and lie in the text
        spans = detect_text(t)
        assert all(a.e <= b.s for a, b in zip(spans, spans[1:], strict=False)) and all(0 <= x.s < x.e <= len(t) for x in spans)
    hard = detect(rows.where("doc_id < 12")).collect()
    assert {r["doc_id"] for r in hard} >= {0, 1, 2, 3, 4, 6, 7}


def test_store_forgets_a_turn_that_is_sent_empty(spark, tmp_path):
    ddl = "session_id string, turn_id int, placeholder string, source_text string, action string"
    path = str(tmp_path / "store")
    store.save_turns(spark.createDataFrame([("s", 1, "[[A#1]]", "a", "GENERICIZE"), ("t", 1, "[[B#1]]", "b", "GENERICIZE")], ddl), path)
    store.save_turns(spark.createDataFrame([("s", 1, "[[A#1]]", "a", "KEEP")], ddl), path)
    assert [r["source_text"] for r in store.load(spark, path).collect()] == ["b"]


def test_restoring_keeps_every_character(spark):
    from spanveil.operators import placeholders

    answers = spark.createDataFrame([(1, "a\x02b\x02c [[NAME#1]]\x01 [[ADDR#2.CITY]] [[ADDR#2.ROAD-DTL]] [[X#1]]"), (2, "none"), (None, "[[NAME#1]]")], "k int, text string")
    records = spark.createDataFrame([(1, "[[NAME#1]]", "Bob", None, 1), (1, "[[NAME#1]]", "Rob", None, 2), (1, "[[ADDR#2.CITY-ROAD]]", "x", {"city": "Miami", "road": "Oak St", "number": "12"}, 1), (None, "[[NAME#1]]", "Ann", None, 1)], "k int, placeholder string, source_text string, components map<string,string>, first_seen int")
    got = {r["k"]: r["restored"] for r in placeholders.restore(answers, records, ["k"]).collect()}
    assert got == {1: "a\x02b\x02c Bob\x01 Miami Oak St 12 [[X#1]]", 2: "none", None: "Ann"}


def test_allocation_keeps_rows_without_text(spark):
    rows = [("s", 1, 0, "email", None, None), ("s", 1, 4, "name", None, None), ("s", 2, 0, "email", "a@x", "a@x"), (None, 1, 0, "num", "5", "5")]
    out = sessions.allocate(spark.createDataFrame(rows, DDL)).collect()
    assert sorted((str(r["session_id"]), r["turn_id"], r["s"], r["entity_id"]) for r in out) == [("None", 1, 0, 1), ("s", 1, 0, 1), ("s", 1, 4, 2), ("s", 2, 0, 3)]


def test_numbers_run_over_stretches_of_turns(spark):
    from spanveil.operators.placeholders import allocate_equal

    rows = [("s", t, k, "email", f"v{(t * 7 + k) % 900}") for t in (0, 5, 4095, 4096, 9000, 2**40) for k in range(40)]
    out = allocate_equal(spark.createDataFrame(rows, "session string, turn long, s int, attr_type string, canonical string"), "session", "turn").collect()
    want = {}
    for _, _, _, _, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want.setdefault(v, len(want) + 1)
    assert all(r["entity_id"] == want[r["canonical"]] for r in out) and len(out) == len(rows)


def test_tags_need_no_marks(spark):
    df = spark.createDataFrame([(1, "a\x01【PII:NAME:1】B\x02b【/PII】\x03【PII:TEL:2】12【/PII】")], "k int, text_with_tags string")
    texts, known = evaluate.read_tagged(df, "k")
    assert texts.first()["text"] == "a\x01B\x02b\x0312"
    assert sorted((r["entity_type"], r["s"], r["e"], r["text"]) for r in known.collect()) == [("NAME", 2, 5, "B\x02b"), ("TEL", 6, 8, "12")]
