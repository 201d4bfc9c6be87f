"""Dictionaries, clues, addresses, conflicts, merging and pages against rules by hand and brute force."""

import json
import re

import pytest
from pyspark.sql import functions as F

from spanveil.functions import ocrtext
from spanveil.functions.matcher import Matcher, fold
from spanveil.operators import address as adr
from spanveil.operators import clues as cl
from spanveil.operators import dictionary, geometry, merge, recognizers
from spanveil.operators.kernel import Span, beats, detect, detect_text, settle
from spanveil.operators.structured import PATTERNS, candidates, merge_numbers
from spanveil.plans import queries
from spanveil.plans.engine import Engine
from spanveil.sources import lexicon, repository, store


def found(text, **more):
    return [(text[x.s : x.e], x.attr) for x in detect_text(text, **more)]


# Dictionaries and lexicons


def test_matcher_folds_and_keeps_word_edges():
    m = Matcher.of([("ln", 1), ("Daniel", 2), ("张三", 3), ("New York", 4), ("Jordan", 5), ("daniel", 6), ("", 7)])
    text = "in dANiEI 王张三李 new york Jordans Jordanes jordanx xJordan"
    got = sorted((x.s, x.e, x.payload) for x in m.find(text))
    assert fold("in ln Bill") == "in ln biii"
    assert got == [(3, 9, 2), (3, 9, 6), (11, 13, 3), (15, 23, 4), (24, 31, 5), (32, 40, 5)]


def test_both_ways_of_matching_agree(spark):
    docs = spark.createDataFrame([(1, "in dANiEI 王张三李 new york Jordans jordanx jordan"), (2, "Visit New York, Jordanes U.S. éJordan İl"), (3, ""), (4, None)], "doc_id long, text string")
    entries = spark.createDataFrame([("ln",), ("Daniel",), ("张三",), ("New York",), ("Jordan",), ("U.S.",), (" ",), ("三李",)], "text string")
    one, two = (sorted(map(tuple, dictionary.matches(docs, entries, join=j).collect())) for j in (False, True))
    assert one == two and len(one) == 10
    assert dictionary.matches(docs, entries.where("false"), join=True).count() == 0


def test_lexicons_of_all_shapes(spark, tmp_path):
    files = {
        "surnames": {"hard": ["Nguyen"], "soft": ["Lee", "Lee", " "]},
        "address_keys": [{"component_type": "road", "keywords": [{"text": "quay", "strength": "hard"}]}],
        "countries": {"countries": [{"canonical": "Norway", "aliases": [{"text": "Norge", "strength": "soft"}]}]},
        "places": {"provinces": {"hard": ["Oslo"]}, "cities": {"soft": ["Bergen"]}},
        "not_names": ["Monday"],
        "numerals": [{"text": "一", "normalized": "1"}],
    }
    for name, payload in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(payload, ensure_ascii=False), encoding="utf-8")
    terms = lexicon.read_lexicon(spark, {k: str(tmp_path / f"{k}.json") for k in files})
    got = {(t.text, t.family, t.role, t.strength, t.component, t.canonical) for t in terms}
    assert got == {("Nguyen", "name", "family", 2, "", ""), ("Lee", "name", "family", 1, "", ""), ("quay", "address", "key", 2, "road", ""), ("Norge", "address", "value", 1, "country", "Norway"), ("Oslo", "address", "value", 2, "province", ""), ("Bergen", "address", "value", 1, "city", ""), ("Monday", "negative", "name", 2, "", ""), ("一", "control", "value", 2, "", "1")}
    with pytest.raises(ValueError):
        lexicon.parse("countries", {"countries": [{"canonical": "A", "aliases": [{"text": "x"}]}, {"canonical": "B", "aliases": [{"text": "X"}]}]})
    assert lexicon.lexicon_table(spark, terms).count() == len(terms)
    rows = spark.createDataFrame([(1, "met Kim Nguyen there")], "doc_id int, text string")
    assert [r["text"] for r in detect(rows, hard=False, lexicon=terms).collect()] == ["Kim Nguyen"] and detect(rows, hard=False).count() == 0


def test_dictionaries_of_the_row_and_of_all(spark):
    entry = "struct<text:string,attr_type:string,role:string,component:string,strength:int,source:string>"
    rows = spark.createDataFrame([(1, "ask Zorblatt about Qux Works", [("Zorblatt", "name", "full", "", 2, "session")]), (2, "ask Zorblatt", [])], f"doc_id int, text string, own array<{entry}>")
    local = spark.createDataFrame([("Qux Works", "organization", "value", "", 2, "local")], "text string, attr_type string, role string, component string, strength int, source string")
    got = sorted((r["doc_id"], r["text"], r["attr_type"]) for r in detect(rows, hard=False, terms="own", local=local).collect())
    assert got == [(1, "Qux Works", "organization"), (1, "Zorblatt", "name")]
    attached = {r["doc_id"]: [x["text"] for x in r["own"]] for r in dictionary.attach(rows, local, "doc_id", "own").collect()}
    assert attached == {1: ["Zorblatt", "Qux Works"], 2: []}


def test_a_value_of_turn_one_is_found_in_turn_two_alone(spark):
    rows = spark.createDataFrame([("s", 1, "ask Zorblatt"), ("s", 2, "ask Zorblatt"), ("t", 2, "ask Zorblatt")], "session_id string, turn_id int, text string")
    history = spark.createDataFrame([("s", 1, "name", "Zorblatt", None)], "session_id string, turn_id int, attr_type string, source_text string, components map<string,string>")
    texts, _ = Engine(spark).sanitize(rows, history)
    assert {(r["session_id"], r["turn_id"]): r["sanitized"] for r in texts.collect()} == {("s", 1): "ask Zorblatt", ("s", 2): "ask [[NAME#1]]", ("t", 2): "ask Zorblatt"}


def test_personas_are_a_dictionary(spark, tmp_path):
    slots = spark.createDataFrame([("p", "organization", 0, "value", "Qux Works", ["QuxCo"], "hard"), ("p", "passport_number", 0, "value", "A1234567", [], "hard")], "persona_id string, attr_type string, slot_no int, component string, value string, aliases array<string>, strength string")
    engine = Engine(spark)
    engine.write_privacy_repository(slots, str(tmp_path / "repo"))
    engine.write_privacy_repository(slots.where("attr_type = 'organization'").withColumn("aliases", F.array(F.lit("Quxers"))), str(tmp_path / "repo"))
    texts, records = engine.sanitize(spark.createDataFrame([("s", 1, "Quxers and QuxCo, pass a1234567")], "session_id string, turn_id int, text string"))
    assert {r["attr_type"] for r in records.collect()} == {"organization", "passport_number"} and "Qux" not in texts.first()["sanitized"]
    with pytest.raises(Exception, match="no legal slot"):
        repository.validated(slots.withColumn("strength", F.lit("odd"))).collect()


def test_records_know_their_persona(spark):
    slots = [("p2", "email", 0, "value", "A@x.org"), ("p1", "email", 0, "value", "a@x.org"), ("p1", "address", 0, "road", "Oak St"), ("p1", "address", 0, "number", "12"), ("p1", "address", 0, "city", "Miami"), ("p3", "address", 0, "city", "Miami"), ("p2", "address", 1, "city", "Boston"), ("p2", "address", 1, "province", "MA")]
    slots = spark.createDataFrame([(*x, [], "hard") for x in slots], "persona_id string, attr_type string, slot_no int, component string, value string, aliases array<string>, strength string")
    assert {r["persona_id"] for r in repository.address_slots(slots).collect()} == {"p1", "p2"}  # a city alone isn't enough
    rows = [(1, "email", "a@x.org", None), (2, "email", None, None), (3, "address", "x", {"road": "Oak St", "number": "12"}), (4, "address", "x", {"road": "Elm St", "number": "12"}), (5, "address", "x", {"city": "Boston", "province": "MA"}), (6, "address", "x", None)]
    got = repository.with_personas(spark.createDataFrame(rows, "k int, attr_type string, canonical string, components map<string,string>"), slots)
    assert {r["k"]: r["persona_id"] for r in got.collect()} == {1: "p1", 2: None, 3: "p1", 4: None, 5: "p2", 6: None}


# Clues


def clue(s, e, family, role, strength=2, source="lexicon", text="", attr=None, component=()):
    return cl.Clue(s, e, family, role, attr or family, strength, text, component, "", source)


def test_rules_between_clues():
    assert [(c.s, c.e) for c in cl.inside_active([clue(2, 4, "name", "given"), clue(5, 7, "name", "given"), clue(3, 8, "address", "value", component=("postal_code",))], [(0, 5), (1, 2)])] == [(5, 7), (3, 8)]
    merged = cl.same_attr([clue(0, 2, "address", "value", component=("province",)), clue(0, 2, "address", "value", component=("city",))])
    assert [c.component for c in merged] == [("province", "city")]
    assert [(c.s, c.e) for c in cl.same_attr([clue(0, 4, "organization", "value"), clue(2, 4, "organization", "value")])] == [(0, 4)]
    assert [c.strength for c in cl.same_attr([clue(0, 4, "organization", "value", 1), clue(2, 4, "organization", "value", 2)])] == [2]
    assert [c.s for c in cl.same_attr([clue(0, 4, "name", "alias"), clue(0, 4, "name", "full")])] == [0]
    assert [(c.s, c.e) for c in cl.seed_groups([clue(0, 9, "label", "label"), clue(2, 4, "label", "label"), clue(8, 12, "label", "start")])] == [(8, 12)]
    text = "name is James"
    assert [c.role for c in cl.seeded(text, [clue(0, 4, "label", "label", attr="name")])] == ["start"]
    assert [c.role for c in cl.seeded("name: x", [clue(0, 4, "label", "label", attr="name")])] == ["label"]
    assert [c.role for c in cl.seeded("name x", [clue(0, 4, "label", "label", attr="name")])] == ["inspire"]


def test_a_seed_drops_what_it_covers_but_hard_dictionary_clues():
    inner = [clue(1, 3, "name", "given", 1), clue(1, 3, "organization", "value", 2, "local")]
    out = cl.resolve("x" * 10 + "\n", [clue(0, 10, "label", "label", attr="name"), *inner], [])
    assert [(c.family, c.role) for c in out] == [("label", "label"), ("organization", "value")]


@pytest.mark.parametrize("negatives,strength,want", [([], 1, 1), ([(0, 9)], 2, None), ([(2, 4)], 2, 2), ([(2, 4)], 1, 0), ([(1, 5)], 1, 0), ([(1, 5)], 0, None), ([(4, 8)], 2, 1), ([(4, 8)], 0, None)])
def test_negative_words(negatives, strength, want):
    assert cl.negative_effect(1, 5, strength, negatives) == want


def test_inspiring_labels_raise_by_distance():
    def raised(text, s):
        out = cl.boosted(text, [clue(0, 4, "label", "inspire", attr="name"), clue(s, s + 2, "name", "given", 0)])
        return out[1].strength

    assert [raised("name x王明", 6), raised("name a b 王明", 9), raised("name a b c d e 王明", 15), raised("name。王明", 5)] == [2, 1, 0, 0]


def test_units_both_ways():
    text = "ab 王 12-34x。y"
    u = cl.Units(text)
    for i in range(len(text)):
        a, b = u.chars(u.at(i), u.at(i))
        assert a <= i < b and u.span(a, b) == (u.at(i), u.at(i))
    assert u.after(1) == 1 and u.at(len(text)) == len(u.starts)
    index = cl.unit_index(u, [clue(0, 2, "name", "given"), clue(0, 4, "address", "value"), clue(3, 4, "negative", "negative", attr="ui")])
    assert set(index[0]["families"]) == {"name", "address"} and len(index[2]["covers"]) == 1 and index[2]["negative"] == {"ui"}


def test_segments_are_what_cuts_leave():
    assert cl.segments(10, [(2, 4), (3, 6), (9, 10)]) == [(0, 2), (6, 9)] and cl.segments(0, []) == []
    assert [cl.by_length(x) for x in ("张", "abc", "阿里巴巴", "ab-c")] == [0, 1, 2, 1]


# Detection


@pytest.mark.parametrize(
    "text,want",
    [
        ("we met at Acme limited", [("Acme limited", "organization")]),
        ("Google", [("Google", "organization")]),
        ("腾讯科技有限公司", [("腾讯科技有限公司", "organization")]),
        ("company: Acme Labs", [("Acme Labs", "organization")]),
        ("company: Acme", []),
        ("Country/Region: Belgium", [("Belgium", "address")]),
        ("Belgium", []),
        ("收货地址：上海路79", [("上海路79", "address")]),
        ("景明路10-1-102", [("景明路10-1-102", "address")]),
        ("景明路187号，鼓楼区，南京市，中国", [("景明路187号，鼓楼区，南京市，中国", "address")]),
        ("高兴", []),
        ("王小明", [("王小明", "name")]),
        ("姓名：李四", [("李四", "name")]),
        ("ask James-Smith", [("James-Smith", "name")]),
        ("he went to Paul Smith Street", [("Paul Smith", "name")]),
    ],
)
def test_detector(text, want):
    assert found(text) == want


def test_long_labelled_values_and_levels():
    value = "江苏省苏州市工业园区青年路12号" + "，备注" * 40
    assert found("地址：" + value)[0][0] == "江苏省苏州市工业园区青年路12号"
    assert found("the name James") == [("James", "name")] and found("he said James") == []
    assert found("met Alice Qwerty there", protection="balanced") == [] and found("met Alice Qwerty there", protection="odd") == [("Alice Qwerty", "name")]
    assert found("王小明 met James Smith", locale="en_us") == [("James Smith", "name")] and found("王小明 met James Smith", locale="zh_cn") == [("王小明", "name")]
    with pytest.raises(ValueError):
        detect_text("x", locale="fr")


def test_time_grows_with_the_text():
    import time

    def took(n):
        text = "Name: James Bond\nAddress: 815 Madison Ave, Seattle, WA 98101\n" * n
        start = time.perf_counter()
        assert len(detect_text(text)) == 2 * n
        return time.perf_counter() - start

    took(20)
    assert took(800) < 12 * took(200)


def test_conflicts():
    span = lambda s, e, attr, strength=2, by="x", **more: Span(s, e, attr, strength, by, **more)
    assert beats(span(0, 5, "license_plate", 1), span(0, 9, "address"))
    assert beats(span(0, 9, "address", 1), span(2, 5, "name")) and beats(span(0, 5, "name", 2), span(3, 9, "address", 1))
    assert beats(span(0, 5, "organization", by="suffix"), span(3, 9, "address")) and beats(span(3, 9, "address"), span(0, 5, "name"))
    assert beats(span(0, 5, "name", source="local"), span(3, 9, "address"))
    text = "James Smith Street"
    out = settle(text, [span(0, 11, "name", 1), span(6, 18, "address", 2)])
    assert [(text[x.s : x.e], x.attr) for x in out] == [("James", "name"), ("Smith Street", "address")]


def test_spans_against_structured_entities():
    text = "James Smith, 815 Madison Ave, Seattle"
    assert [x.attr for x in detect_text(text, [(0, 5, "email")])] == ["address"]
    assert [x.attr for x in detect_text(text, [(13, 16, "num")])] == ["name", "address"]


# Addresses


def test_components_of_addresses():
    get = lambda t: adr.find_addresses(t)[0].parts()
    assert get("Suite 320, Miami, FL 33131") == {"suite": "Suite 320", "city": "Miami", "province": "FL", "postal_code": "33131"}
    assert get("苏州市工业园区青年路323号国际广场1号楼5层1581室") == {"city": "苏州市", "district": "工业园区", "road": "青年路", "number": "323号", "poi": "国际广场", "building": "1号楼", "detail": "5层", "room": "1581室"}
    assert get("上海路79") == {"road": "上海路", "number": "79"} and adr.find_addresses("上海路79")[0].components[0].suspects[0]["value"] == "上海"
    assert [a.parts() for a in adr.find_addresses("815 Madison Ave, 798 SW 8th St")] == [{"number": "815", "road": "Madison Ave"}, {"number": "798", "road": "SW 8th St"}]
    assert [c.type for c in adr.digit_tail("10-1-102", "road")] == ["building", "unit", "room"] and adr.digit_tail("10-1-102", "building") == [] and adr.digit_tail("123456", "road") == []


def test_levels_paths_and_strength():
    both = ("province", "city")
    assert adr.admin_paths([("吉林", both), ("吉林", ("city",))], {}) == [("province", "city")]
    assert adr.admin_paths([("广东", ("province",)), ("苏州", ("city",))]) == [] and adr.admin_paths([("江苏", ("province",)), ("苏州", ("city",))]) == [both]
    assert adr.possible_levels("上海") == both and adr.possible_levels("x") == ()
    C = adr.Component
    assert adr.strength_of([C("road", "Oak", "St"), C("number", "5")]) == 2 and adr.strength_of([C("city", "Miami")]) == 1 and adr.strength_of([C("district", "x")]) == 0


def test_traces_and_canonical_forms():
    parts = adr.parse_address("江苏省苏州市工业园区青年路12号3号楼1201室")
    assert adr.from_trace(adr.trace(parts)) == parts
    old = {"value": ["state:WA", "street:Main", "poi:A", "poi:AB", "odd:x", "city:"], "suspects": ["[", '[{"levels": ["city"], "value": "x"}, {"levels": []}, 3]']}
    got = adr.from_trace(old)
    assert [(c.type, c.value) for c in got] == [("province", "WA"), ("road", "Main"), ("poi", "AB")] and got[1].suspects == [{"levels": ["city"], "value": "x", "key": "", "origin": ""}]
    n = adr.normalize({"province": "WA", "city": "Bellevue", "road": "Main Street", "house_number": "5176", "unit": "Apt 205"})
    assert n["canonical"] == "province=washington|city=bellevue|road=mainstreet|number=5176|unit=205" and n["numbers"] == [] and n["spec"] == "PROV-CITY-ROAD-DTL" and n["has_admin"]
    assert adr.canonical_part("country", "usa") == adr.canonical_part("country", "United States")
    assert adr.number_tokens("甲二十三栋005A") == ["a", "23", "5", "a"] and [adr.zh_number(x) for x in ("十", "一百零二", "二〇一", "x")] == [10, 102, 201, None]
    line = adr.parse_address("245 Couch St, Suite 1708, Portland, OR 97205")
    assert adr.render(line) == "245 Couch St, Suite 1708, Portland, OR 97205" and adr.render(line, ("road", "city")) == "Couch St, Portland" and adr.render(parts, ("city", "road")) == "苏州市青年路"


def test_generated_addresses_are_taken_apart(spark, sf_dir):
    rows = queries.QUERIES["address_recall"](spark, sf_dir).collect()
    assert len(rows) == 8 and all(r["recall"] >= 0.9 for r in rows)


# Structured values


def test_labels_bind_and_let_through(spark):
    df = spark.createDataFrame([(1, "card number: 4111111111111111 and phone 4111111111111111, code 1234"), (2, "U.S.A visit; 12 or 1234"), (3, "code" + " x" * 30 + " 1234"), (4, None)], "doc_id int, text string")
    got = [(r["doc_id"], r["text"], r["attr_type"], r["mismatch"], r["emitted"]) for r in candidates(df).orderBy("doc_id", "s").collect()]
    assert got == [(1, "4111111111111111", "bank_number", False, True), (1, "4111111111111111", "num", True, True), (1, "1234", "num", False, True), (2, "12", "num", False, False), (2, "1234", "num", False, False), (3, "1234", "num", False, False)]


def test_neighbouring_numbers_are_one(spark):
    df = spark.createDataFrame([(1, "+1234 (12) 99 x 5"), (2, "77")], "doc_id int, text string")
    rows = spark.createDataFrame([(1, "12 345  67 a 8", 0, 2, "12", "num", "12"), (1, "12 345  67 a 8", 3, 6, "345", "num", "345"), (1, "12 345  67 a 8", 8, 10, "67", "num", "67"), (1, "12 345  67 a 8", 13, 14, "8", "num", "8"), (2, "ab cd", 0, 2, "ab", "alnum", "AB"), (2, "ab cd", 3, 5, "cd", "alnum", "CD")], "doc_id int, plain_text string, s int, e int, text string, attr_type string, canonical string")
    got = sorted((r["doc_id"], r["s"], r["e"], r["text"], r["canonical"]) for r in merge_numbers(rows).collect())
    assert got == [(1, 0, 10, "12 345  67", "1234567"), (1, 13, 14, "8", "8"), (2, 0, 2, "ab", "AB"), (2, 3, 5, "cd", "CD")] and df.count() == 2


def test_hard_spans_of_whole_documents_against_an_engine_of_regular_expressions(spark, sf_dir):
    from spanveil.operators.structured import ANY, COUNTRY_CODES, NOT_PRIVATE

    docs = {r["doc_id"]: (r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = set()
    for i, text in docs.items():
        plain = text.replace("\x01", "").replace("\x02", "")
        t, taken = plain.replace("（", "(").replace("）", ")"), []
        if not re.search(ANY, t):
            continue
        no = [m.span() for m in re.finditer(NOT_PRIVATE.replace(r"\b", r"(?![A-Za-z0-9_])"), t)]
        for group, kind, pattern in PATTERNS:
            old = list(taken)
            for m in re.finditer(re.sub(r"\\s", r"[ \\t\\n\\x0b\\f\\r]", pattern), t):
                digits = re.sub("[^0-9]", "", m[0])
                if any(m.start() < e and s < m.end() for s, e in old):
                    continue
                if (group == "alnum" and (not re.search("[A-Za-z]", m[0]) or m[0].lower() in COUNTRY_CODES)) or (group == "phone" and len(digits) < 10):
                    continue
                if group == "num" and (len(digits) < 2 or any(s <= m.start() and m.end() <= e for s, e in no)):
                    continue
                taken.append(m.span())
                want.add((i, m.start(), m.end(), kind))
    got = {(r["doc_id"], r["s"], r["e"], r["kind"]) for r in queries.QUERIES["hard_documents"](spark, sf_dir).collect()}
    assert got == want and len(want) > 20


# Merging


def test_metadata(spark):
    df = spark.createDataFrame([({"a": ["1", "2"], "b": ["x"]}, {"a": ["2", "3"]}), (None, {"c": ["y"]})], "a map<string,array<string>>, b map<string,array<string>>")
    assert [r["m"] for r in df.select(merge.merged(F.col("a"), F.col("b")).alias("m")).collect()] == [{"a": ["1", "2", "3"], "b": ["x"]}, {"c": ["y"]}]
    rows = spark.createDataFrame([(1, "p", "x", "name", None, 0, 2, "X", 1, {"k": ["b"]}), (1, "p", "x", "name", None, 0, 2, "x", 2, {"k": ["a"], "j": []}), (1, "p", "y", "name", None, 0, 2, "y", 1, None)], "doc_id int, source string, canonical string, attr_type string, block_id string, s int, e int, text string, strength int, metadata map<string,array<string>>")
    got = {r["canonical"]: (r["text"], r["metadata"]) for r in merge.distinct_candidates(rows).collect()}
    assert got["x"][0] == "x" and got["x"][1]["k"] == ["a", "b"] and got["y"] == ("y", {})
    assert merge.distinct_candidates(rows, by=["attr_type", "block_id", "text"]).count() == 3


def test_state_and_suspects_in_json(spark):
    df = spark.createDataFrame([('{"aliases": {"a": "name:1"}, "counters": {"name": 1}}', '[{"levels": ["city"], "value": "x"}, {"levels": [], "value": "y"}, {"value": "z"}]'), ("{", "nonsense"), (None, None)], "a string, s string")
    got = df.select(merge.alias_state(F.col("a")).alias("a"), F.size(merge.suspects(F.col("s"))).alias("n")).collect()
    assert [r["n"] for r in got] == [1, 0, 0] and got[0]["a"]["counters"] == {"name": 1} and got[1]["a"]["aliases"] == {} and got[2]["a"]["counters"] == {}
    bag = spark.createDataFrame([([("city", "x", "soft"), ("city", "y", "soft"), ("city", "x", "hard")],)], "b array<struct<level:string,value:string,strength:string>>")
    assert [tuple(x) for x in bag.select(repository.component_bag(F.col("b")).alias("b")).first()["b"]] == [("city", "x", "hard"), ("city", "y", "soft")]
    raw = spark.createDataFrame([("Acme Trading Co., Ltd.", "12 Oak St, Miami, FL")], "o string, a string")
    r = raw.select(repository.ingest_organization(F.col("o")).alias("o"), repository.ingest_address(F.col("a")).alias("a")).first()
    assert r["o"]["value"] == "Acme Trading" and r["o"]["aliases"] == ["Acme Trading Co., Ltd."] and [x["level"] for x in r["a"]] == ["number", "road", "city", "province"]


# Analyzer


def test_context_counts_tokens_of_any_length(spark):
    long = "x" * 500
    df = spark.createDataFrame([(1, f"card {long} {long} 4111111111111112 4012888888881881"), (2, f"card {long} a b c d {long} 078-05-1120 123-45-6788"), (3, "ssn a b c d 123-45-6788"), (4, "ssn a b c d e 123-45-6788")], "doc_id int, text string")
    got = {r["doc_id"]: r["score"] for r in recognizers.analyze(df, entities=("US_SSN",)).collect()}
    assert got[3] > got[4]


def test_chunks_values_models_and_lines(spark, tmp_path):
    text = "word " * 60 + "mail jo@example.org now " + "word " * 60
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    whole = [(r["s"], r["e"], r["text"]) for r in recognizers.analyze(df, entities=("EMAIL_ADDRESS",)).collect()]
    assert [(r["s"], r["e"], r["text"]) for r in recognizers.analyze_chunks(df, entities=("EMAIL_ADDRESS",)).collect()] == whole and len(whole) == 1
    rows = spark.createDataFrame([(1, ("a@x.org", ["b@x.org", "no"]), {"k": "c@x.org", "skip": "d@x.org"}, 5)], "id int, s struct<a:string,b:array<string>>, m map<string,string>, n int")
    got = sorted((r["path"], r["text"]) for r in recognizers.analyze_values(rows, "id", skip=("m.skip",), entities=("EMAIL_ADDRESS",)).collect())
    assert got == [("m.k", "c@x.org"), ("s.a", "a@x.org"), ("s.b.0", "b@x.org")]
    model = lambda texts: [[("PERSON", 0, 4, 0.9)] if t.startswith("word") else [] for t in texts]
    assert [tuple(r)[1:] for r in recognizers.with_model(df, model).collect()] == [("PERSON", 0, 4, "word", 0.9)]
    (tmp_path / "a.txt").write_text("x\nmail jo@example.org\n", encoding="utf-8")
    (tmp_path / "b.log").write_text("mail jo@example.org\n", encoding="utf-8")
    found_ = store.lint(spark, str(tmp_path), ignore=("*.log",), entities=("EMAIL_ADDRESS",))
    assert [(r["line_no"], r["column"]) for r in found_.collect()] == [(2, 6)]
    assert store.formatted(found_, "github").first()["line"].endswith("line=2,col=6::EMAIL_ADDRESS 0.50")


# Pages


def test_chunks_of_a_page_map_back(spark):
    blocks = spark.createDataFrame([("i", "l1", "Ｎame ", 0, 0, 40, 20), ("i", "v1", "138 0000", 50, 0, 60, 20), ("i", "v2", "0001", 0, 30, 60, 20), ("i", "z", "far", 500, 400, 60, 20), ("i", "x", " ", 0, 900, 5, 5)], "image_id string, block_id string, text string, x int, y int, width int, height int")
    pages = geometry.chunked(blocks)
    page = pages.first()
    br, gap = geometry.OCR_BREAK, geometry.INLINE_GAP
    assert page["text"] == f"{br}Name{gap}138 0000{gap}0001{br}far{br}"
    s = page["text"].index("138")
    number = geometry.bridged_numbers(pages).collect()
    assert [(r["s"], r["check_name"]) for r in number] == [(s, "validated_phone_cn")]
    spans = spark.createDataFrame([("i", s, s + 13), ("i", page["text"].index("far"), page["text"].index("far") + 3)], "image_id string, s int, e int")
    got = {r["s"]: ([tuple(b) for b in r["blocks"]], r["x"], r["y"], r["width"], r["height"]) for r in geometry.remap(spans, pages, blocks).collect()}
    assert got[s] == ([("v1", 0, 8), ("v2", 0, 4)], 0, 0, 110, 50) and got[page["text"].index("far")][0] == [("z", 0, 3)]


def test_label_trust_says_why(spark):
    rows = [("i", "a", 20, 0, 20), ("i", "b", 22, 60, 20), ("i", "c", 20, 121, 22), ("i", "d", 400, 180, 20), ("i", "e", 20, 240, 90), ("i", "f", 20, 900, 20), ("j", "a", 0, 0, 20), ("j", "b", 0, 9, 20)]
    labels = spark.createDataFrame(rows, "image_id string, block_id string, x int, y int, height int")
    got = {(r["image_id"], r["block_id"]): r["reason"] for r in geometry.label_trust(labels).collect()}
    assert got == {("i", "a"): None, ("i", "b"): None, ("i", "c"): None, ("i", "d"): "x", ("i", "e"): "height", ("i", "f"): "rhythm", ("j", "a"): "height", ("j", "b"): "height"}


def test_match_text_by_type():
    assert ocrtext.match_text("+86 138-00", "phone") == ("8613800", [1, 2, 4, 5, 6, 8, 9]) and ocrtext.match_text("a.b", "email")[0] == "a.b"
    text = "call 138-0000 0001 or 13800000001"
    assert [text[s:e] for s, e in ocrtext.find_value(text, "13800000001", "phone")] == ["138-0000 0001", "13800000001"]
