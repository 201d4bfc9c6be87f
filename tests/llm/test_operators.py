"""Operators against brute force, round trips and held-out accuracy, on small tables with awkward rows."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanveil.llm import licenses, linededup, media, mixing, neardup, queries, segment, sharding, toxicity, urlfilter
from spanveil.llm.quality import keep_good, quality_rules

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text_of(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def docs(spark):
    """Null, empty and blank texts, ties, repeats, near copies, a long text; extra columns with names the operators use."""
    base = text_of(1, 120)
    near = [base.replace(" ", "  ", 3), base.upper(), " ".join(base.split()[:-8]), " ".join(base.split()[4:]), base + " " + text_of(9, 30)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (6, base), *[(10 + i, t) for i, t in enumerate(near)], (20, text_of(2, 90) + "\nshared line\n"), (21, text_of(3, 90) + "\n SHARED line"), (22, text_of(4, 4000)), (23, "\n".join(["same"] * 80)), (24, "héé ▁ \n\n 漢字 😀 x"), (25, text_of(5, 60)), (25, text_of(5, 60))]
    return spark.createDataFrame([(i, t, "key", 7, f"s{i % 3}" if i % 4 else None) for i, t in rows], "doc_id long, text string, key string, size int, source string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, sf_dir, same, name):
    same(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df())


# Near duplicates


def shingles(text):
    w = [x.lower() for x in (text or "").encode().split()]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    """doc_id -> smallest reachable doc_id, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def test_near_duplicates_against_all_pairs(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = components(rows)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]])
    assert {r["n_shingles"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert neardup.near_duplicates(empty).count() == 0


def two_texts(seed):
    """Two unlike texts of equal length, and a near copy of each."""
    a, b = text_of(seed, 100), text_of(seed + 1, 100)
    b = b[: len(a)] + "x" * (len(a) - len(b))
    return a, b, " ".join(a.split()[:-4]), " ".join(b.split()[:-4])


def test_a_repeated_doc_id_is_one_document(spark):
    rows, want = [], {None: None}
    cases = (
        (lambda a, b, x, y: [(3, a), (5, a), (5, b), (7, b)], {3: 3, 5: 3, 7: 3}),
        (lambda a, b, x, y: [(1, x), (5, a), (5, b), (9, y)], {1: 1, 5: 1, 9: 1}),
        (lambda a, b, x, y: [(5, x), (7, a), (7, b), (9, y)], {5: 5, 7: 5, 9: 5}),
        (lambda a, b, x, y: [(5, a), (5, None), (2, a), (5, a)], {2: 2, 5: 2}),
        (lambda a, b, x, y: [(None, a), (None, b), (4, a)], {4: 4}),
    )
    for k, (case, expected) in enumerate(cases):
        rows += [(i if i is None else 100 * k + i, t) for i, t in case(*two_texts(1000 + 10 * k))]
        want |= {100 * k + i: 100 * k + j for i, j in expected.items()}
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]])


def test_one_row_of_each_group_of_texts_stays(spark):
    a, b, _, near_b = two_texts(31)
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (7, b, 4), (7, near_b, 5), (3, a, 6), (None, a, 7), (None, text_of(40, 50), 8), (8, None, 9), (8, None, 9), (9, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int")
    out = neardup.first_of_group(docs)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(3, a), (5, b), (None, text_of(40, 50)), (8, None), (8, None), (9, "")]))
    assert neardup.first_of_group(docs.where("false")).count() == 0


def test_a_group_of_drifting_copies_is_one_by_links(spark):
    """Copies of copies: links make one component though its ends differ. What the rounds leave goes through the blocks."""
    rng, words, rows = np.random.default_rng(3), text_of(7, 150).split(), []
    for i in range(160):
        for k in rng.integers(0, len(words), 2):
            words[k] = f"w{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    want = components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for rounds in ((4, 12, neardup.BANDS), (neardup.BANDS,)):
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, rounds=rounds, block=16).collect()}
        assert got == want


def test_posterior_bounds():
    least = neardup.least_matches(0.75, 1e-6)
    assert list(least) == sorted(least) and least[-1] < 0.75 * neardup.HASHES
    sig = np.arange(neardup.HASHES, dtype=np.uint32)[None, :]
    alive, matches = neardup.surviving(np.vstack([sig, sig]), np.vstack([sig, sig + 1]), 0.75, 1e-6)
    assert alive.tolist() == [0] and matches.tolist() == [neardup.HASHES]


def test_connected_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in neardup.connected(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# Media


def test_media_round_trip(docs, empty):
    got = {}
    for r in media.media_columns(docs).collect():
        got.setdefault(r["doc_id"], r)
    for row in docs.collect():
        raw = (row["text"] or "").encode()
        body = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        r = got[row["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]))
        # The stored form by hand: the payload after a 32-byte head, its key frames each tenth unit, and the file's own size.
        data = media.write_media(body)
        assert data[32 : 32 + len(body)] == body and (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
        want = [(32 + k, 192) for k in range(0, len(body), 1920)]
        assert [tuple(x) for x in r["keyframes"]] == want and (r["codec"], r["timescale"], r["duration"]) == ("raw ", 8000, len(body))
        crc = zlib.crc32(b"".join(struct.pack(">qq", *x) for x in want))
        assert r["feature"] == f"codec=raw  timescale=8000 duration={len(body)} samples={len(body) // 192} keyframes={len(want)} ranges={crc:08x}"
    assert got[4]["media_sha256"] == got[5]["media_sha256"] and got[4]["feature"] == got[5]["feature"]
    assert media.media_columns(empty).count() == 0


def test_key_frames_and_broken_files(spark):
    data = media.write_media(bytes(range(192)) * 25)
    (track,) = media.probe(data)
    assert (track.codec, track.handler, track.duration, track.timescale, len(track.sizes)) == ("raw ", "soun", 4800, 8000, 25)
    assert [s for _, s in track.keyframes()] == [192] * 3
    assert all(data[a : a + n] == bytes(range(192)) for a, n in track.keyframes())
    bad = [data[:-5], b"", b"abc", data[:40] + b"\xff" * 20, struct.pack(">I4s", 4, b"moov"), media.box(b"free", b"x")]
    at = data.index(b"stsz") + 4
    huge = data[: at + 8] + struct.pack(">I", 4_000_000_000) + data[at + 12 :]  # 4 billion samples of 192 bytes
    at = data.index(b"stsc") + 4
    many = data[: at + 12] + struct.pack(">I", 4_000_000_000) + data[at + 16 :]  # a chunk of 4 billion samples: more than there are
    assert [t.keyframes() for t in media.probe(many)] == [track.keyframes()]
    bad.append(huge)
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate([data, *bad])] + [(99, None)], "k int, f binary")
    status = {r["k"]: r["status"] for r in media.probe_media(df, "k", "f").collect()}
    assert status[0] == "ok" and all(s != "ok" for k, s in status.items() if k)


def test_fragments_and_explicit_sizes():
    full, box = media.full, media.box
    sizes = (5, 7, 3)
    tfhd = full(b"tfhd", struct.pack(">I", 1))
    trun = lambda at: full(b"trun", struct.pack(">IiI", 3, at, 0), *[struct.pack(">I", s) for s in sizes], flags=0x205)
    moof = lambda at: box(b"moof", full(b"mfhd", struct.pack(">I", 1)), box(b"traf", tfhd, trun(at)))
    head = box(b"moov", box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, 0)), box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 0)))), box(b"mvex", full(b"trex", struct.pack(">5I", 1, 1, 40, 0, 0x10000))))
    frag = moof(len(moof(0)) + 8)
    data = head + frag + box(b"mdat", b"aaaaabbbbbbbccc")
    (track,) = media.probe(data)
    assert media.payload(data, track) == b"aaaaabbbbbbbccc" and track.duration == 120
    assert [data[a : a + n] for a, n in track.keyframes()] == [b"aaaaa"]


# Quality


def test_quality_rules(docs, empty):
    rows = {r["doc_id"]: r for r in quality_rules(docs, order=["symbols", "word_length", "dup_lines", "letters", "bullets", "all_caps"]).collect()}
    assert (rows[1]["n_words"], rows[1]["base_failed"], rows[1]["kept"]) == (0, True, False)
    assert rows[23]["n_dup_lines"] == 79 and rows[23]["n_repeat_words"] == 80
    other = {r["doc_id"]: r["kept"] for r in quality_rules(docs, order=["all_caps", "bullets", "letters", "dup_lines", "word_length", "symbols"]).collect()}
    assert other == {i: r["kept"] for i, r in rows.items()}
    kept = keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, k in other.items() if k}
    for order in (["few_words", "repeats", "symbols", "word_length", "dup_lines", "letters", "bullets", "all_caps"], ["all_caps", "letters", "repeats", "bullets", "dup_lines", "few_words", "word_length", "symbols"]):
        assert sorted(map(str, keep_good(docs, order=order).collect())) == sorted(map(str, kept.collect()))
    assert quality_rules(empty).count() == 0 and keep_good(empty).count() == 0


def test_quality_sample_is_spread_over_the_table(spark):
    from spanveil.llm.quality import BASE_RULES, RULES, plan_cascade, sampled

    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.col("id")).alias("text")).coalesce(1)
    at = sorted(int(r["text"].split()[1]) for r in sampled(df, 500, 100).collect())
    assert 350 < len(at) <= 1000 and at[0] < 1000 and at[-1] > 19_000
    plan = plan_cascade(df, (*BASE_RULES, *RULES))
    assert plan[0][2] == 1.0 and {r.name for r, _, _ in plan} == {r.name for r in (*BASE_RULES, *RULES)}


# Toxicity


def slow_grams(text):
    """The hashed n-grams of a text, character by character."""
    flat, out, m = " " + " ".join((text or "").lower().split()) + " ", set(), (1 << 64) - 1
    for n in toxicity.SIZES:
        for i in range(len(flat) - n + 1):
            h = 0
            for c in flat[i : i + n]:
                h = (h * int(toxicity._K) + ord(c) + 1) & m
            out.add(int(neardup.mix(np.array([(h + n) & m], np.uint64))[0]) >> (64 - toxicity.BITS))
    return out


def test_toxicity_against_plain_counts(spark):
    """Ratios, selection and scores by dictionaries and loops."""
    import math

    rows = [(i, f"{text_of(i, 12)} {'awful hated rubbish' if i % 3 == 0 else 'kind welcome praise'}") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
    fit = [(t, int(i % 3 == 0)) for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    n = [sum(y == k for _, y in fit) for k in (0, 1)]
    count = [{}, {}]
    for t, y in fit:
        for h in slow_grams(t):
            count[y][h] = count[y].get(h, 0) + 1
    ratio = {}
    for h in {*count[0], *count[1]}:
        a, b = count[1].get(h, 0) + 1, count[0].get(h, 0) + 1
        x = math.log(a / (n[1] + 2)) - math.log(b / (n[0] + 2))
        if abs(x) / math.sqrt(1 / a + 1 / b) >= toxicity.LEAST_Z:
            ratio[h] = x
    weight, intercept = toxicity.train(docs, labels)
    assert ratio and set(np.flatnonzero(weight).tolist()) <= set(ratio)
    assert all(weight[h] * x > 0 for h, x in ratio.items() if weight[h])
    for i, t in rows:
        z = intercept + sum(float(weight[h]) for h in slow_grams(t))
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-6


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score_toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] == r["toxic"] for r in got)
    assert len(got) > 50 and hit / len(got) > 0.93
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_toxicity_edges(docs, empty, spark):
    none = spark.createDataFrame([(4, None), (5, 3)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs, none).collect()
    assert len(rows) == docs.count() and {r["score"] for r in rows} == {0.5}
    one = spark.createDataFrame([(4, 1), (6, 0), (6, 0)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, one).collect()}
    assert all(0 <= s <= 1 for s in rows.values()) and rows[1] == rows[2] == rows[3]
    assert toxicity.score_toxicity(empty, one).count() == 0


# Mixing


def test_mixing_meets_targets(docs, empty):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        b = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        b[0] += r["taken"]
        b[1] = max(b[1], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert abs(sum(b[2] for b in by.values()) - 1.5 * total) < 1e-6
    for taken, largest, target, size in by.values():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= 2 * largest
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs.repartition(3)).collect()))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    times = {}
    for r in rows:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + r["times"]
    assert {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {i: n for i, n in times.items() if n}
    assert mixing.mix_sources(empty).count() == 0


def test_boundary_bucket_is_refined_to_one_document(spark):
    """Many rows with sizes that differ widely: the source's sum is as near its target as whole documents allow."""
    rows = [(i, "w " * (1 + i % 97), "a" if i % 3 else "b") for i in range(3000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 49 for r in got)


# Sharding


@pytest.mark.parametrize("n", [1, 2, 3, 24, 1000, 4097])
def test_feistel_is_a_permutation(n):
    f = sharding.Feistel(n, 5)
    p = f(np.arange(n))
    assert sorted(p.tolist()) == list(range(n)) and (f.inverse(p) == np.arange(n)).all()


def test_shards(docs, empty):
    rows = sharding.shard_rows(docs, 4).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert all(r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["grown_shard"] is None for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, sharding.shard_rows(docs.repartition(5), 4).collect()))
    assert sharding.shard_rows(empty).count() == 0
    # Rank, Feistel rounds and place in whole numbers.
    m = (1 << 64) - 1

    def mix(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & m
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & m
        return x ^ x >> 31

    n = len(rows)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    keys = [mix((k + 11 * 1000003) & m) for k in range(1, sharding.ROUNDS + 1)]

    def permuted(x):
        while True:
            left, right = x >> half, x & ((1 << half) - 1)
            for k in keys:
                left, right = right, left ^ (mix((right + k) & m) & ((1 << half) - 1))
            x = left << half | right
            if x < n:
                return x

    order = sorted((r["doc_id"], r["text_crc32"], r["size"]) for r in rows)
    want = sorted((*r, permuted(i) % 4, permuted(i) // 4) for i, r in enumerate(order))
    assert sorted((r["doc_id"], r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in rows) == want


# Licences


def test_licence_gate_loses_nothing_and_finds_notices(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = licenses.train(docs)
    cache = licenses.Hashes()
    for row in docs.limit(60).collect():
        fast = [(x["passage"], x["family"]) for x in licenses.scan_text(row["text"], model, cache)]
        slow = []
        for i, words in enumerate(licenses.passages(row["text"])):
            if words:
                p = model.probabilities(words, cache)
                if p.argmax() != licenses.NONE:
                    slow.append((i, licenses.NAMES[int(p.argmax())] if p.max() >= model.least else "unknown"))
        assert fast == slow
    found = licenses.by_document(licenses.scan_licenses(docs)).join(docs.select("doc_id", "text"), "doc_id").collect()
    for notice, family in (("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("GNU General Public License, version 3.", "GPL"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"), ("All rights reserved.", "Proprietary")):
        rows = [r for r in found if notice in r["text"]]
        assert rows and all(family in r["families"].split(",") for r in rows)
    plain = [r for r in found if "icense" not in r["text"] and "rights reserved" not in r["text"]]
    assert sum(r["n_confirmed"] > 0 for r in plain) <= 0.01 * len(plain)


def test_unknown_licences_are_not_named(docs, empty):
    model = licenses.train(docs)
    cache = licenses.Hashes()
    named = sum(any(x["confirmed"] for x in licenses.scan_text(t, model, cache)) for t in licenses.OTHERS)
    assert named <= 2
    # Notices that neither fit, calibration nor templates hold.
    from spanveil.llm.license_texts import PLAIN_TEST, TEST

    right = wrong = 0
    for family, notices in TEST.items():
        for t in notices:
            found = {x["family"] for x in licenses.scan_text(t, model, cache) if x["confirmed"]}
            right += family in found
            wrong += len(found - {family})
    wrong += sum(any(x["confirmed"] for x in licenses.scan_text(t, model, cache)) for t in (*PLAIN_TEST, *licenses.OTHERS[1::2]))
    n = sum(map(len, TEST.values()))
    assert right / n >= 0.9 and right / (right + wrong) >= 0.9
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(empty).count() == 0


# Lines


def test_line_runs_over_batches(spark):
    rows = [(i, "\n".join([f"own {i}", "common", "few" if i < 5 else "", " Common "])) for i in range(30)] + [(99, None), (98, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for batches in (1, 4, 7):
        got = {r["doc_id"]: r for r in linededup.line_dedup(df, batches=batches).collect()}
        assert all(got[i]["n_lines"] == 4 and got[i]["n_dropped"] == 2 for i in range(30))
        assert got[3]["kept_sha256"] == hashlib.sha256(b"own 3\nfew").hexdigest()
        assert got[99]["n_lines"] == got[98]["n_lines"] == 1 and got[99]["kept_sha256"] == hashlib.sha256(b"").hexdigest()


def test_line_dedup_keeps_columns(docs, empty):
    out = linededup.drop_frequent_lines(docs, min_docs=2)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert "shared" not in text[20].lower() and "shared" not in text[21].lower() and text[1] is None
    assert linededup.line_dedup(empty).count() == 0


# URLs


def test_automaton_against_regular_expressions():
    import re

    globs = [urlfilter.Glob("*a*", "*"), urlfilter.Glob("x?", "/*b"), urlfilter.Glob("*.org", "/p*"), urlfilter.Glob("", ""), *[urlfilter.Glob(f"h{i}*", f"/{i}*z") for i in range(30)]]
    a = urlfilter.Automaton(globs)
    assert a.words > 1
    urls = [("", ""), ("xa", "/cb"), ("e.org", "/pq"), ("e.org", "/q/e.org/p"), ("banana", ""), ("h3é", "/3zz"), ("h29", "/29" + "y" * 200 + "z"), ("xab", "/b")]
    fits = a.match([urlfilter.symbols(*u) for u in urls])
    one = lambda g: "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g)
    for u, row in zip(urls, fits, strict=True):
        assert row.tolist() == [bool(re.fullmatch(one(g.host), u[0], re.S)) and bool(re.fullmatch(one(g.path), u[1], re.S)) for g in globs]


def test_url_edges(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/x"), (4, "HTTP://A.Example.ORG/es/x?q#f"), (5, "x://example.org/en/12"), (6, "x://org"), (7, "x://notexample.org/es/"), (8, "x://h?://y"), (9, "x://" + "a" * 5000 + ".com/de/")]
    df = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"][:20], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(df).collect()}
    assert got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[5][2:] == ("example.org/en/1", "block") and got[6] == ("org", "", None, "allow")
    assert got[7][2:] == ("org/", "allow") and got[8][0] == "h" and got[9][2:] == ("com/de/", "block")
    assert urlfilter.judge_urls(df.where("false")).count() == 0


# Segmentations


@pytest.fixture(scope="module")
def vocab():
    return segment.load_vocabulary()


def every_path(text, vocab):
    ids = {p: i for i, p in enumerate(vocab.raw) if i > 258}
    t, out = " " + text, []

    def walk(i, path, lp):
        if i == len(t):
            out.append((tuple(path), lp))
            return
        for n in range(1, min(16, len(t) - i) + 1):
            k = ids.get(t[i : i + n].encode())
            if k is not None:
                walk(i + n, [*path, k], lp + vocab.score[k])
        if t[i].encode() not in ids:
            walk(i + 1, [*path, *[int(vocab.byte_id[b]) for b in t[i].encode()]], lp + vocab.rare + segment.BYTE_PENALTY)

    walk(0, [], 0.0)
    z = np.logaddexp.reduce([lp for _, lp in out])
    return {p: lp - z for p, lp in out}


def test_samples_follow_the_lattice(vocab):
    text, n = "the é\n▁x", 3000
    paths = every_path(text, vocab)
    got = segment.sample_texts([text] * n, list(range(n)), vocab, 3, 1.0)
    first = {}
    for samples in got:
        assert len({tuple(s[0].tolist()) for s in samples}) == 3
        for ids, lp, inclusion in samples:
            assert abs(paths[tuple(ids.tolist())] - lp) < 1e-9 and 0 < inclusion <= 1
        first[tuple(samples[0][0].tolist())] = first.get(tuple(samples[0][0].tolist()), 0) + 1
    for p, lp in sorted(paths.items(), key=lambda x: -x[1])[:4]:
        assert abs(first.get(p, 0) / n - np.exp(lp)) < 0.03
    # Weighting by inclusion scores estimates a sum over all paths without bias.
    want = sum(np.exp(lp) * len(p) for p, lp in paths.items())
    assert abs(np.mean([sum(np.exp(lp) / q * len(ids) for ids, lp, q in s) for s in got]) - want) < 0.05


def test_small_lattices_are_exhausted(vocab):
    paths = every_path("ab", vocab)
    (samples,) = segment.sample_texts(["ab"], [1], vocab, 50, 1.0)
    assert {tuple(s[0].tolist()) for s in samples} == set(paths) and all(s[2] == 1.0 for s in samples)


def test_encoding_round_trip(docs, empty):
    out = segment.sample_segmentations(docs, k=2)
    assert out.where("not exact").count() == 0
    again = segment.sample_segmentations(docs.repartition(4), k=2)
    key = lambda df: sorted((r["doc_id"], r["sample"], tuple(r["ids"]), r["log_prob"]) for r in df.collect())
    assert key(out) == key(again)
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all(r["text"] == text[r["doc_id"]] for r in segment.decode_segmentations(out).collect())
    assert segment.sample_segmentations(empty).count() == 0


def test_segmentation_memory_does_not_follow_the_batch(vocab):
    import random
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(1500)) for _ in range(320)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    assert batch.nbytes > 2 << 20
    tracemalloc.start()
    n = sum(b.num_rows for b in segment.segment_batches(iter([batch]), vocab, 2, 1.0, 17, True, None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2 * len(texts)
    assert peak < 160 << 20


# Pipeline


def test_pipeline_against_its_stages_by_hand(spark, tmp_path):
    import corpus_pipeline as pipeline

    lines = [f"{text_of(i, 70)}\ncommon footer line" for i in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(lines)] + [(100, lines[5] + " tail", "en", "s2", 9), (101, "short", "en", "s0", 5), (102, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"o{k}"))
        docs = spark.read.parquet(str(tmp_path / f"o{k}"))
        assert k == len(pipeline.STAGES) - 1 or docs.columns == columns
        seen[name] = docs
    assert {r["doc_id"] for r in seen["quality rules"].collect()} == {*range(40), 100}
    assert all("footer" not in r["text"] and r["n_chars"] == len(r["text"]) for r in seen["line dedup"].collect() if r["doc_id"] != 100)
    assert {r["doc_id"] for r in seen["near dedup"].collect()} == set(range(40))
    assert seen["sentencepiece"].where("not exact").count() == 0
    got = pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, seen["sentencepiece"].collect()))


BSD_WRAPPED = """Copyright (c) 2019, The Regents
All rights kept.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
ISC_WRAPPED = """Copyright (c) 2020 Jo Doe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE."""


def test_wrapped_licences_are_found(spark):
    prose = "\n".join(" ".join(WORDS[(i * 7 + k) % 19] for k in range(12)) for i in range(60))
    quoted = lambda t, mark: "\n".join(mark + line for line in t.split("\n"))
    texts = [(f, v) for f, t in (("BSD", BSD_WRAPPED), ("ISC", ISC_WRAPPED)) for v in (t, t.replace("\n", "\r\n"), quoted(t, " * "), quoted(t, "# "), f"{prose}\n{t}\n\n{prose}")]
    rows = [(i, t) for i, (_, t) in enumerate(texts)] + [(100, prose), (101, ""), (102, None), (103, "One line.\nAnother one.\n")]
    train_on = [(200 + i, text_of(i, 40) + ". " + text_of(i + 50, 40)) for i in range(50)]
    docs = spark.createDataFrame(rows + train_on, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.by_document(licenses.scan_licenses(docs)).collect()}
    assert [got[i]["families"] for i in range(len(texts))] == [f for f, _ in texts]
    assert got[100]["n_found"] == 0 and got[101]["n_passages"] == got[102]["n_passages"] == 1 and got[103]["n_passages"] == 5


def test_windows_hold_most_of_any_notice():
    for n in (97, 100, 144, 145, 500):
        windows = licenses._joined(b"\n".join(b"w%d" % i for i in range(n)))
        held = [set(w.split()) for w in windows]
        assert set().union(*held) == {b"w%d" % i for i in range(n)}
        for size in (10, 48, 80):
            for k in range(n - size + 1):
                run = {b"w%d" % i for i in range(k, k + size)}
                assert max(len(run & h) for h in held) >= 0.6 * size


def test_licence_fit_takes_passages_of_whole_texts(spark, monkeypatch):
    lines = [f"{text_of(i, 8)} mark{i}" for i in range(5000)]
    text = "\n\n".join(lines)
    chosen = licenses.ordinary_passages(text, set())
    places = sorted(lines.index(p.decode()) for p in chosen)
    assert len(places) == licenses.FIT_PASSAGES and places[-1] > 2500 and text.index(lines[places[-1]]) > 20_000
    long = " ".join(f"w{i}" for i in range(9000))
    (run,) = licenses.ordinary_passages(long, set())
    assert len(run.split()) == licenses.FIT_WORDS and run.decode() in long
    seen = []
    monkeypatch.setattr(licenses, "fit", lambda p: seen.append(p))
    docs = spark.createDataFrame([(1, text), (2, None), (None, "x y")], "doc_id long, text string")
    licenses.train(docs)
    licenses.train(docs.repartition(3))
    assert seen[0] == seen[1] == [p.split() for p in chosen]


def test_repeated_documents_get_samples_of_their_own(spark):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([(1, text_of(1, 60)), (1, text_of(1, 60)), (None, "a b"), (2, None)], "doc_id long, text string")
    rows = pipeline.encode(spark, docs, "").collect()
    one = {(r["pass"], r["sample"]): tuple(r["ids"]) for r in rows if r["doc_id"] == 1}
    assert len(one) == 4 and len(set(one.values())) == 4
    again = pipeline.encode(spark, docs.repartition(3), "").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    plain = {r["sample"]: tuple(r["ids"]) for r in segment.sample_segmentations(docs.where("doc_id = 1").limit(1)).collect()}
    assert plain == {s: x for (n, s), x in one.items() if n == 0}


def test_near_dedup_stage_loses_no_text(spark):
    import corpus_pipeline as pipeline

    a, b, _, _ = two_texts(61)
    docs = spark.createDataFrame([(3, a, 1), (5, a, 2), (5, b, 3), (7, b, 4), (9, None, 5)], "doc_id long, text string, `a.b` int")
    out = pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns and sorted((r["doc_id"], r["a.b"]) for r in out.collect()) == [(3, 1), (5, 3), (9, 5)]


# Awkward rows for every operator and stage


@pytest.fixture(scope="module")
def odd(spark):
    """Null doc_ids, a doc_id with two texts of one length, rows that repeat, null in every column, and a column with a dot in its name."""
    a, b, _, _ = two_texts(77)
    rows = [(None, a, "s1", 1), (None, text_of(5, 70), "s1", 2), (7, a, "s1", 3), (7, b, "s2", 4), (8, b, None, 5), (9, None, None, None), (9, None, None, None), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` int")


def test_operators_take_awkward_rows(spark, odd):
    n = odd.count()
    ids = sorted(str(r["doc_id"]) for r in odd.collect())
    labels = spark.createDataFrame([(7, 1), (8, 0), (None, 1)], "doc_id long, toxic int")
    outputs = {
        "op1": neardup.near_duplicates(odd),
        "op2": media.media_columns(odd),
        "op3": quality_rules(odd, order=["symbols", "word_length", "dup_lines", "letters", "bullets", "all_caps"]),
        "op4": toxicity.score_toxicity(odd, labels),
        "op5": mixing.mix_sources(odd),
        "op6": sharding.shard_rows(odd, 3),
        "op7": licenses.by_document(licenses.scan_licenses(odd)),
        "op8": linededup.line_dedup(odd, min_docs=2),
    }
    for name, out in outputs.items():
        got = out.collect()
        assert len(got) == n and sorted(str(r["doc_id"]) for r in got) == ids, name
        if name == "op1":
            assert {(r["doc_id"], r["component_id"]) for r in got} == {(None, None), (7, 7), (8, 7), (9, 9)}
        if name == "op8":  # both rows of text a lose their line, and both of b
            assert sorted(r["n_dropped"] for r in got) == [0] * 4 + [1] * 4
    seg = segment.sample_segmentations(odd, k=1).collect()
    assert sorted(str(r["doc_id"]) for r in seg) == ids and all(r["exact"] for r in seg)


def test_every_row_is_a_document_of_its_own_for_lines(spark):
    df = spark.createDataFrame([(i % 2, f"own {i}\ncommon") for i in range(11)], "doc_id long, text string")
    assert [r["n_dropped"] for r in linededup.line_dedup(df).collect()] == [1] * 11


def test_stages_take_awkward_rows(spark, odd, monkeypatch):
    import corpus_pipeline as pipeline

    columns = odd.columns
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, odd, "")
        assert out.columns == columns, name
        out.collect()
        assert stage(spark, odd.where("false"), "").count() == 0
    assert pipeline.near_dedup(spark, odd, "").where("text is null").count() == 3
    assert sorted(r["a.b"] for r in pipeline.near_dedup(spark, odd, "").where("text is not null").collect()) == [2, 3, 4]
    assert pipeline.encode(spark, odd.drop("a.b"), "").select("doc_id", "pass").distinct().count() > 4
