"""Every operator on a small table of edge cases, against brute force or the tokenizer library."""

import hashlib
import re
import struct
import zlib

import numpy as np
import pytest

from mailspark.llm import (
    bpe, exact_dedup, jaccard_join, language, lexical, merkle, neighbours, packing, pii, quality, sharding, suffix_dedup, toxicity,
)
from pyspark.sql import functions as F

from mailspark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, bucket int, row string"
WORDS = "the of and to in that was his with for had not but they from her she which you were all".split()


def prose(seed, n):
    pick = np.random.default_rng(seed)
    return " ".join(w + str(pick.integers(0, 50)) for w in pick.choice(WORDS, n))


PASSAGE = prose(1, 60)
TEXTS = {
    0: prose(2, 120),
    1: prose(2, 120),  # a copy
    2: prose(2, 118) + " two others",  # a near copy
    3: prose(3, 50) + " " + PASSAGE,
    4: PASSAGE + " " + prose(4, 50),
    5: None,
    6: "",
    7: " \t\n ",
    8: "one",
    9: "ONE",
    10: "mail ann@site.example.org or 10.0.0.256, 192.168.1.7; card 4111 1111 1111 1111; +49 151 2345678",
    11: "bob at site dot example dot org, plus four nine one five one two three four five six seven",
    12: "être où naïve ÇA <|endoftext|> it's 'street 日本語 ́",
    13: prose(5, 20_000),
    14: "ab " * 400,
    15: prose(2, 120).replace(" ", "\n\t"),
    16: "one two three",
    17: "12345 !!!",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "fr", None if i == 4 else f"s{i % 3}", 1, "x", 7, "y") for i, t in TEXTS.items()]
    return spark.createDataFrame([*rows, rows[8]], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(frame, key="doc_id"):
    return {r[key]: r for r in frame.collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_exact_dedup_buckets_hold_either_side(spark, monkeypatch):
    """One small id beside all others, or none at all: the history is next to empty, buckets are bounded all the same."""
    monkeypatch.setattr(exact_dedup, "BUCKET", 50)
    used = []
    look_up = exact_dedup.look_up
    monkeypatch.setattr(exact_dedup, "look_up", lambda index, new, buckets: used.append(buckets) or look_up(index, new, buckets))
    texts = [(n, f"text {n // 2}") for n in range(1000)]
    far = spark.createDataFrame([(10**12 + n if n else 0, t) for n, t in texts], "doc_id long, text string")
    found = exact_dedup.dedup(far).collect()
    assert len(found) == 1000 and sum(r.kept for r in found) == 500
    assert {(r.keep_id, r.group_size) for r in found} == {(10**12 + n if n else 0, 2) for n in range(0, 1000, 2)}
    bare = spark.createDataFrame([(None, t) for _, t in texts], "doc_id long, text string")
    assert all(r.kept and r.group_size == 2 for r in exact_dedup.dedup(bare).collect())
    assert used == [10, 10]


def test_exact_dedup(docs, none):
    found = rows_of(exact_dedup.dedup(docs))
    digests = {i: sha(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()) for i, t in TEXTS.items()}
    for i, own in digests.items():
        same = [j for j, other in digests.items() if other == own]
        assert (found[i].keep_id, found[i].kept, found[i].text_sha256) == (min(same), i == min(same), own)
        assert found[i].group_size == len(same) + (8 in same)
    assert exact_dedup.dedup(none).collect() == []
    assert set(exact_dedup.distinct_documents(docs).columns) == set(docs.columns)


def test_rows_without_an_id_come_last(spark):
    rows = spark.createDataFrame([(None, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    found = {(r.doc_id, r.text_sha256): r.kept for r in exact_dedup.dedup(rows).collect()}
    assert found == {(None, sha(b"a")): False, (3, sha(b"a")): True, (None, sha(b"b")): True}


def test_perfect_hash_is_minimal_and_perfect():
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(3000)), np.uint8).reshape(-1, 32)
    sizes, bits = exact_dedup.perfect_hash(digests)
    assert sorted(exact_dedup.slots(digests, sizes, bits)) == list(range(3000))


def expected_ids():
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(tokenizer_path())
    return own, {i: own.encode(t or "", add_special_tokens=False).ids for i, t in TEXTS.items()}


def test_bpe_equals_the_library(docs, none):
    own, ids = expected_ids()
    found = rows_of(bpe.round_trip(docs, tokenizer_path()))
    for i, wanted in ids.items():
        assert found[i].n_tokens == len(wanted)
        assert found[i].ids_sha256 == sha(struct.pack(f"<{len(wanted)}I", *wanted))
        assert found[i].decoded_sha256 == sha(own.decode(wanted, skip_special_tokens=False).encode())
    encoded = bpe.encode(docs, tokenizer_path())
    assert rows_of(encoded)[12].ids == ids[12]
    assert rows_of(bpe.decode(encoded, tokenizer_path()))[12].text == own.decode(ids[12], skip_special_tokens=False)
    assert bpe.round_trip(none, tokenizer_path()).collect() == []


@pytest.mark.parametrize("text", ["aaaaaaa aaaa", "ΣΑΣ İ ½ ² Ⅷ x²y", "'s ''s !'s don't'll 're're", "a​b　c\x1cd\x85e", "🙂🙂 가 각"])
def test_bpe_odd_texts(text):
    own, _ = expected_ids()
    assert bpe.PairIndexEncoder(tokenizer_path()).encode([text])[0].tolist() == own.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("shares", [None, {"s0": 3, "s1": 1}])
def test_packing(docs, none, shares):
    _, ids = expected_ids()
    pieces = packing.pack(docs, tokenizer_path(), shares).toPandas().sort_values(["sequence_id", "offset"])
    place = (pieces["sequence_id"] * packing.WINDOW + pieces["offset"]).to_numpy()
    assert place[0] == 0 and (place[1:] == place[:-1] + pieces["length"].to_numpy()[:-1]).all()
    assert (pieces["offset"] + pieces["length"] <= packing.WINDOW).all()
    for i, own in ids.items():
        whole, at = [*own, packing.END], 0
        mine = pieces[pieces["doc_id"] == i].drop_duplicates("start").sort_values("start") if i == 8 else pieces[pieces["doc_id"] == i].sort_values("start")
        for p in mine.itertuples():
            assert p.start == at and p.doc_tokens == len(whole)
            at += p.length
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *whole[p.start : at]))
        assert at == len(whole)
    assert packing.pack(none, tokenizer_path()).collect() == []


def test_packing_keeps_to_the_shares():
    sizes = {"a": 400_000, "b": 100_000, "c": 77_777}
    schedule = packing.Schedule(sizes, {"a": 2, "b": 1, "c": 1})
    places = {}
    for j, queue in enumerate(schedule.queues):
        slots = np.arange(sizes[queue] // packing.SLOT)
        places[queue] = schedule.token_starts(np.full(len(slots), j), slots) // packing.SLOT
        assert (np.diff(places[queue]) > 0).all()
    every = np.concatenate(list(places.values()))
    assert sorted(every) == list(range(len(every)))
    early = {q: int((p < 640).sum()) for q, p in places.items()}
    assert abs(early["a"] - 320) <= 3 and abs(early["b"] - 160) <= 3 and abs(early["c"] - 160) <= 3


def test_quality(spark, none):
    good = [(i, prose(i, 80 + i % 40).capitalize() + ".", 1) for i in range(200)]
    bad = [(200 + i, "spam!! " * (30 + i % 20), 0) for i in range(100)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    labels = rows.select("doc_id", "quality")
    found = quality.classify(rows.select("doc_id", "text"), labels).join(labels, "doc_id").filter("held_out").collect()
    assert found and all(r.predicted == r.quality for r in found)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "x")], "doc_id long, text string")
    scores = [r.score for r in quality.classify(odd, labels).collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 for s in scores)
    assert quality.classify(none, labels).collect() == []


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute_components(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = {x: a if y == b else y for x, y in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("block", [2_000_000, 500])
def test_jaccard_join(spark, docs, none, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    base = prose(9, 100).split()
    chain = {100 + i: " ".join(base[i:] + prose(10, i).split()) for i in range(12)}
    texts = TEXTS | chain
    more = spark.createDataFrame(list(chain.items()), "doc_id long, text string")
    found = jaccard_join.links(docs.select("doc_id", "text").union(more), 4, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(texts, 4, 85)
    if block > 500:
        assert jaccard_join.links(none, 4, 85).collect() == []


@pytest.mark.parametrize("words", [4, 5])
def test_jaccard_join_of_lone_short_texts(spark, monkeypatch, words):
    monkeypatch.setattr(jaccard_join, "CHUNK", 1)  # every text is a run of its own
    texts = {n: " ".join(["hello", "wide", "world", "of", "mail"][:n]) for n in range(6)} | {9: "A" * 5000 + " " + "b" * 5000}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = jaccard_join.links(frame.repartition(7), words, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(texts, words, 85)
    lone = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in jaccard_join.links(lone, words, 85).collect()] == [(1, 1)]


def test_near_copies_leave_rows_without_an_id(spark):
    text = "one two three four five six seven eight nine ten"
    rows = spark.createDataFrame([(None, text, "a"), (1, text, "b"), (2, text, "c"), (None, None, "d")], "doc_id long, text string, _gone string")
    rows = rows.withColumnRenamed("_gone", "_id").withColumn("lang", F.lit("en"))
    kept = jaccard_join.representatives(rows, 5, 80).collect()
    assert sorted(r["_id"] for r in kept) == ["a", "b", "d"]
    assert sorted(r["_id"] for r in exact_dedup.distinct_documents(rows).collect()) == ["a", "b", "d"]
    assert sorted(r["_id"] for r in language.with_language(rows).filter("doc_id is not null").collect()) == ["b", "c"]


def test_sharding_spreads_a_group_over_salts(spark):
    rows = spark.createDataFrame([(i, "same" if i % 3 else f"own {i}") for i in range(900)], "doc_id long, text string")
    numbered, total = sharding.numbered(rows)
    links = sharding.equal_text_links(numbered, total, 4).toPandas()
    assert len(links) == 600 and links["row"].is_unique
    assert links.groupby("hub").size().max() <= total // 4 and links["hub"].nunique() == 3


def test_pii(docs, none):
    found = rows_of(pii.spans(docs))
    assert (found[10].n_email, found[10].n_ip, found[10].n_card, found[10].n_phone) == (1, 1, 1, 1)
    text = TEXTS[11]
    spans = [(k, text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in found[11].spans.split(","))]
    assert spans == [
        ("email", "bob at site dot example dot org"),
        ("phone", "plus four nine one five one two three four five six seven"),
    ]
    assert found[5].base_sha256 == sha(b"") and found[5].spans == ""
    assert pii.spans(none).collect() == []
    clean = rows_of(pii.redact(docs))
    assert clean[11].text == "<EMAIL>, <PHONE>" and clean[5].text is None and clean[0].text == TEXTS[0]


PLAIN = ["word", "met", "at", "dot", "x", "12", "one", "The", ".", "@", "(", "und", "trash.hair", "at home.Then"]


def disguised(pick):
    """(what stands in a text, its kind) of a random identifier in a random disguise."""
    choose = lambda *options: options[pick.integers(len(options))]
    kind = choose("email", "ip", "phone", "card")
    dot = choose(" (dot) ", "[.]", " dot ", "{ punkt }", " [dot]", "(point)")
    if kind == "email":
        local = choose(".", dot).join(choose("mary", "j", "x" * 80, "a_b%c") for _ in range(pick.integers(1, 7)))
        domain = dot.join(["ex"] + [choose("site", "mail", "a-b") for _ in range(pick.integers(0, 8))] + ["org"])
        return local + choose(" (at) ", "[at]", " at ", " @ ", "@", " arroba ", "<at>") + domain, kind
    if kind == "ip":
        return dot.join(str(pick.integers(0, 256)) for _ in range(4)), kind
    names = {v: k for k, v in pii.DIGIT_WORDS.items() if k.isascii()}
    if kind == "phone":
        words = [choose(names[d], d) for d in "49151" + "".join(map(str, pick.integers(0, 10, pick.integers(5, 9))))]
        return "plus " + choose(" ", "-", "  ").join(words), kind
    return choose(" ", "-").join([names["4"], *(choose(names["1"], "1") for _ in range(15))]), kind


def test_pii_finds_disguises_wherever_they_stand():
    pick = np.random.default_rng(31)
    for _ in range(1500):
        own, kind = disguised(pick)
        before, after = (" ".join(pick.choice(PLAIN[:2] + PLAIN[7:8], pick.integers(0, 5))) for _ in range(2))
        for text in (own, f"{before}; {own}; {after}", f"\U0001d54f {own}"):  # the last has an odd letter before it
            start = text.index(own)
            spans = [s for s in pii.find(text)[1] if s[0] == kind]
            assert spans == [(kind, start, start + len(own))], text


def test_pii_leaves_prose_alone():
    pick = np.random.default_rng(32)
    for _ in range(500):
        text = " ".join(pick.choice([w for w in PLAIN if w not in ("@", "dot")], 12))
        assert pii.find(text) == ([], []), text


def test_pii_offsets_through_all_layers():
    text = "𝕏 m\u0430ry (at) ex\u0430mple (dot) org; plus four nine one five one 234 five six 78; \uff14111 1111 1111 1111"
    assert [(k, text[a:b]) for k, a, b in pii.find(text)[1]] == [
        ("email", "m\u0430ry (at) ex\u0430mple (dot) org"), ("card", "\uff14111 1111 1111 1111"),
        ("phone", "plus four nine one five one 234 five six 78"),
    ]


@pytest.mark.parametrize("part", ["( ", " ", "dot ", " at ", "a dot b at ", "one ", "@ ", "a@", "1.", "[ ]"])
def test_pii_takes_time_in_proportion(part):
    import time

    start = time.perf_counter()
    pii.find("mary " + part * 100_000 + "(at) example (dot) com")
    assert time.perf_counter() - start < 10


def test_pii_base_spans_equal_the_patterns():
    pick = np.random.default_rng(3)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
    for _ in range(3000):
        text = "".join(pick.choice(list("a@.-  b1239"), pick.integers(1, 30)))
        wanted = [("email", *m.span()) for m in email.finditer(text)]
        wanted += [("ip", *m.span()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [s for s in pii.detect(text) if s[0] in ("email", "ip")] == wanted


def test_sharding(spark, docs, none):
    group = [(1000 + i, "same text") for i in range(30)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(group, "doc_id long, text string"))
    found = sharding.shard(rows, 4).toPandas()
    counts = found.groupby("shard").size()
    assert len(found) == len(TEXTS) + 31 and counts.max() - counts.min() <= 1
    for _, own in found.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    first = found.set_index("doc_id").loc[0]
    assert (first["size"], first["text_crc32"]) == (len(TEXTS[0]) + 8, zlib.crc32(TEXTS[0].encode()))
    assert sharding.shard(none, 4).collect() == []


def test_sharding_brings_copies_together(spark):
    rows = spark.createDataFrame([(i, f"text {i % 40 if i < 80 else i}") for i in range(240)], "doc_id long, text string")
    found = sharding.shard(rows, 4).toPandas().set_index("doc_id")["shard"]
    assert sum(found[i] != found[i + 40] for i in range(40)) <= 2


def test_neighbours(spark):
    pick = np.random.default_rng(5)
    vectors = pick.normal(size=(900, 8))
    vectors[7] = vectors[3]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0] * 7), (2004, [None, *[1.0] * 7])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    found = neighbours.search(frame, "vec_id % 50 = 0 or vec_id = 2000").collect()
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    hits = 0
    for q in range(0, 900, 50):
        near = units @ units[q]
        near[q] = -9
        hits += len(set(np.argsort(-near)[:5]) & {r.vec_id for r in found if r.query_id == q})
        assert [r.rank for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == [1, 2, 3, 4, 5]
    assert len(found) == 90 and hits >= 81
    few = neighbours.search(frame.filter("vec_id in (0, 3, 7)"), "vec_id = 0").collect()
    assert [(r.vec_id, r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(3, 1), (7, 2)]
    assert neighbours.search(frame.limit(0), "vec_id = 0").collect() == []


def test_neighbours_of_a_hot_leaf_are_split_on_both_sides(spark, monkeypatch):
    """A third of all vectors in one place and of one id, blocks and parts of a few rows: the same answer as by brute force."""
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "PART", 15)
    pick = np.random.default_rng(6)
    vectors = pick.normal(size=(900, 6))
    vectors[:300] = [3.0, 1.0, 2.0, 0.5, -1.0, 4.0]
    vectors[:300] += pick.normal(size=(300, 6)) * 1e-3
    ids = [50 * i if i % 2 == 0 else i for i in range(900)]
    ids[300:400] = [7] * 100
    frame = spark.createDataFrame(
        [(i, [float(x) for x in v], "x") for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>, leaf string"
    ).repartition(4)
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in neighbours.search(frame, "vec_id % 50 = 0").collect()}
    rows = neighbours.usable(frame)
    asked = [i for i in range(900) if ids[i] % 50 == 0]
    exact = neighbours.brute_force(rows, vectors[asked], np.array([ids[i] for i in asked]), 5).collect()
    assert len(found) == len(exact) == 5 * len({ids[i] for i in asked})
    right = sum(found[r.query_id, r["rank"]][0] == r.vec_id for r in exact)
    assert right >= 0.95 * len(exact)


@pytest.mark.parametrize("chunk", [2_000_000, 300])
def test_suffix_dedup(docs, none, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    small = docs.filter("doc_id <> 13")
    found = rows_of(suffix_dedup.remove_repeats(small))
    seen = set()
    for i in sorted(set(TEXTS) - {13}):
        data = (TEXTS[i] or "").encode()
        windows = [data[k : k + 50] for k in range(len(data) - 49)]
        gone = np.zeros(len(data), bool)
        for k, w in enumerate(windows):
            if w in seen:
                gone[k : k + 50] = True
        seen.update(windows)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert tuple(found[i]) == (i, len(data), int(gone.sum()), spans, sha(kept))
    if chunk > 300:
        assert suffix_dedup.remove_repeats(none).collect() == []


def test_suffix_dedup_of_passages_twice_in_a_document(spark):
    passage, frame, short = prose(61, 40), prose(62, 30), prose(63, 12)
    around = frame[:90] + short + frame[90:]
    texts = {
        2: prose(64, 20) + passage + prose(65, 20) + short + prose(66, 20),
        5: passage + prose(67, 20) + passage + prose(68, 20) + around + prose(69, 20) + around,
        7: around + prose(70, 20) + around + passage,
    }
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in (1, 10_000):  # each document in a batch of its own, and as they come
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            found, seen = rows_of(suffix_dedup.remove_repeats(rows)), set()
            for i in sorted(texts):
                data = texts[i].encode()
                windows = [data[k : k + 50] for k in range(len(data) - 49)]
                gone = np.zeros(len(data), bool)
                for k, w in enumerate(windows):
                    gone[k : k + 50] |= w in seen
                seen.update(windows)
                assert found[i].n_removed == gone.sum()
                assert found[i].kept_sha256 == sha(bytes(b for b, g in zip(data, gone, strict=True) if not g))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_language(spark, none):
    pick = np.random.default_rng(6)
    alphabets = {"aa": "abcde ", "bb": "fghij "}
    rows = [(i, "".join(pick.choice(list(alphabets[l]), 300)), l) for i, l in enumerate(["aa", "bb"] * 60)]
    odd = [(500, None, None), (501, "", None), (502, "123 !", None), (503, rows[0][1] + " " + rows[1][1], None), (504, "x", None)]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    found = rows_of(language.predict(frame))
    assert all(found[i].lang_pred == l for i, _, l in rows)
    assert [found[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3
    assert found[503].n_languages == 2 and 0.4 <= found[503].score <= 0.6
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(120))
    assert language.predict(none).collect() == []
    assert 500 not in rows_of(language.with_language(frame)) and 504 in rows_of(language.with_language(frame))


def test_language_of_four_and_of_none(spark):
    pick = np.random.default_rng(8)
    alphabets = ["abcde ", "fghij ", "klmno ", "pqrst "]
    write = lambda a, n: "".join(pick.choice(list(a), n))
    rows = [(i, write(alphabets[i % 4], 3000), f"l{i % 4}") for i in range(160)]
    rows += [(900, " ".join(write(a, 400) for a in alphabets), None), (901, write("uvwxyz ", 3000), None), (902, "z", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = rows_of(language.predict(frame))
    assert found[900].n_languages == 4 and abs(found[900].score - 0.25) < 0.06
    assert (found[900].fits, found[901].fits, found[902].fits) == (True, False, True)
    kept = rows_of(language.with_language(frame))
    assert set(kept) == {i for i, _, _ in rows} - {901}
    unlabelled = frame.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.predict(unlabelled).collect()} == {"und"}
    assert set(rows_of(language.with_language(unlabelled))) == {i for i, _, _ in rows}


def test_mixture_equals_plain_em():
    pick = np.random.default_rng(11)
    table = np.log(pick.dirichlet(np.ones(language.CELLS) * 0.05, size=3) + 1e-12).astype(np.float32)
    text = "".join(pick.choice(list("abcdefgh "), 2000))
    cells, _ = language.trigrams([text])
    parts = [table[:, cells[k : k + language.SEGMENT]].sum(axis=1, dtype=float) for k in range(0, len(cells), language.SEGMENT)]
    share = np.full(3, 1 / 3)
    for _ in range(language.ROUNDS):
        weights = []
        for p in parts:
            w = share * np.exp(p - p.max())
            weights.append(w / w.sum())
        share = np.mean(weights, axis=0)
    fitted, _ = language._fit(np.array(parts), np.array([0]), np.zeros(len(parts), int), np.ones((1, 3)))
    assert np.allclose(fitted[0], share, atol=1e-6)


def merkle_rows(rows):
    """What the manifest says of rows (doc_id, source, lang, n_chars, text), hash by hash."""

    def hashed(*parts):
        return sha("".join(parts).encode())

    def leaf(row, more=0):
        values = [*row[:3], None if row[3] is None else row[3] + more, row[4]]
        return hashed(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def levels(nodes):
        found = [nodes]
        while len(found[-1]) > 1:
            found.append([hashed(*found[-1][i : i + 2]) for i in range(0, len(found[-1]), 2)])
        return found

    def siblings(tree, i):
        return [((i >> k) % 2, level[(i >> k) ^ 1] if (i >> k) ^ 1 < len(level) else "") for k, level in enumerate(tree[:-1])]

    held = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        held.setdefault(row[2], []).append(row)
    names = sorted(held, key=lambda n: (n is not None, (n or "").encode()))
    trees = [levels([leaf(r) for r in held[n]]) for n in names]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, (name, tree) in enumerate(zip(names, trees, strict=True)):
        for i, row in enumerate(held[name]):
            path = siblings(tree, i) + siblings(top, k)
            changed = row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            up = leaf(row, int(changed))
            for on_the_left, other in path:
                up = hashed(other, up) if on_the_left else hashed(up, other)
            proof = hashed(*(other for _, other in path))
            out.append((row[0], leaf(row), tree[-1][0], top[-1][0], proof, up, up == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_merkle(spark, none, bits):
    rows = [(i, f"s{i % 3}", ["en", "fr", None, "日", "é"][i % 5] if i < 60 else "en", i % 9 or None, prose(i, 5)) for i in range(90)]
    rows += [(200, None, "lone", None, None), (None, "s", "en", 4, ""), (None, "s", None, 7, None), rows[3], (7, "x", "fr", 2, "other")]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    frame = frame.withColumn("pos", F.lit(1)).withColumn("key", F.lit("k")).repartition(5)
    found = merkle.verified(merkle.manifest(frame, bits)).collect()
    assert sorted(map(tuple, found), key=str) == merkle_rows(rows)
    assert {r.verified for r in found} == {True, False}
    if bits == 10:
        assert merkle.prove(none).collect() == []


def test_merkle_of_one_row(spark):
    row = (1, None, None, None, None)
    frame = spark.createDataFrame([row], "doc_id long, source string, lang string, n_chars long, text string")
    assert [tuple(r) for r in merkle.prove(frame).collect()] == merkle_rows([row])


def ranked_by_counting(docs, items, best):
    """{item: [(doc_id, score)]} by scoring every document for every item."""
    split = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, split(t)) for i, t in docs]
    n_docs, n_words = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    counts = [(i, len(b), {w: b.count(w) for w in set(b)}) for i, b in bags]
    found = {}
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(split(text))
    for item, words in asked.items():
        rows = []
        for i, n, held in counts:
            score = 0
            for word in words & set(held):
                df = sum(word in h for _, _, h in counts)
                tf, m = held[word], 50 + (50 * n * n_docs) // n_words
                score += int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1)))) * ((10**9 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                rows.append((i, score))
        rows.sort(key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        if rows:
            found[item] = rows[:best]
    return found


@pytest.mark.parametrize(("best", "pairs", "shard", "block", "chunk"), [(50, 200_000, 32_000_000, 128, 10**6), (3, 7, 500, 2, 40), (1, 50, 5000, 4, 200)])
def test_lexical_search(spark, docs, none, monkeypatch, best, pairs, shard, block, chunk):
    for name, value in {"SHARD": shard, "BLOCK": block, "CHUNK": chunk}.items():
        monkeypatch.setattr(lexical, name, value)
    texts = [(i, t) for i, t in TEXTS.items() if i != 13] + [(8, "one"), (None, "naïve one"), (30, prose(3, 50) * 3)]
    texts += [(100 + i, prose(40 + i, 30) + " rare" * (i % 4)) for i in range(60)]
    items = [(1, prose(2, 15)), (2, "one RARE the0"), (3, None), (4, "!?"), (5, "nowhere"), (6, prose(3, 9)), (1, "rare"), (None, "naïve 日本語")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumn("term", F.lit(3)).repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
        rows = lexical.search(frame, asked, best, pairs).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    found = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        found.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(found[r.item_id])
    assert found == ranked_by_counting(texts, items, best)
    if best == 50:
        assert lexical.search(none, asked).collect() == [] and lexical.search(docs, asked.limit(0)).collect() == []


def test_lexical_search_leaves_blocks_packed():
    pick = np.random.default_rng(12)
    n = 20_000
    words = pick.integers(20, 400, n)
    rare = np.sort(pick.choice(n, 80, replace=False))
    doc, term = np.concatenate((rare, np.arange(n))), np.repeat([0, 1], [80, n])
    row = lexical.shard_row(list(range(n)), words, doc, term, np.ones(n + 80, int))
    shard = lexical.Shard({c: column[0] for c, column in row.items()}, n, int(words.sum()))
    asked = []
    for t, df in ((0, 80), (1, n)):
        points = lexical.weight(n, df)
        asked.append((t, points, points * int(shard.bound.max())))
    docs, scores = shard.search(asked, 0, 10)
    assert shard.unpacked < 100  # the frequent list has 157 blocks
    whole = np.zeros(n, np.int64)
    for t, points, _ in asked:
        own = np.flatnonzero(term == t)
        np.add.at(whole, doc[own], points * lexical.impact(1, words[doc[own]], n, int(words.sum())))
    assert sorted(scores.tolist())[-10:] == sorted(whole.tolist())[-10:]


RUDE = ["blockhead", "nitwit", "dunce"]


def rude_rows(n):
    """Texts of which every third has a rude word, some of them in disguise."""
    pick = np.random.default_rng(21)
    disguises = [lambda w: w, lambda w: w.replace("i", "1").replace("o", "0"), " ".join, lambda w: w[0] + w[1] * 4 + w[2:]]
    rows = []
    for i in range(n):
        words = [w for w in prose(i, 30 + i % 20).split()]
        words = [re.sub("[0-9]", "", w) for w in words]
        if i % 3 == 0:
            words.insert(pick.integers(len(words)), disguises[pick.integers(4)](RUDE[i // 3 % 3]))
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


def test_toxicity(spark, none):
    rows = rude_rows(900)
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5)
    labels = frame.select("doc_id", "toxic").union(spark.createDataFrame([(9999, 1), (None, 1)], "doc_id long, toxic int"))
    docs = frame.withColumn("cell", F.lit(1)).select("doc_id", "text", "cell", F.lit(1).alias("toxic"), F.lit("x").alias("held_out"))
    found = rows_of(toxicity.classify(docs, labels))
    truth = {i: t for i, _, t in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in found.items() if r.held_out} == set(held) and len(found) == 900
    right = sum(found[i].predicted == truth[i] for i in held)
    assert right >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    odd = spark.createDataFrame([(2000, None), (2001, ""), (2002, " \n"), (None, "nitwit"), (2000, None)], "doc_id long, text string")
    scores = toxicity.classify(docs.select("doc_id", "text").union(odd), labels).filter("doc_id >= 2000 or doc_id is null").collect()
    assert len(scores) == 5 and sum(r.predicted for r in scores) == 1
    assert toxicity.classify(none, labels).collect() == []


def test_toxicity_without_two_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for label, score in ((None, 0.5), (1, 1.0), (0, 0.0)):
        labels = spark.createDataFrame([(i, label) for i in range(10)], "doc_id long, toxic int")
        assert [r.score for r in toxicity.classify(docs, labels).collect()] == [score] * 2


def test_restored_texts(spark, none):
    rows = [(i, t) for i, t, _ in rude_rows(300)] + [(1000 + i, " ".join(RUDE)) for i in range(40)]
    model = toxicity.language_model(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = {
        1: "a N1TW1T here", 2: "n i t w i t", 3: "d.u.n.c.e!", 4: "blooooockhead", 5: "bl0ckh3ad, dunce", 6: None, 7: "",
        8: "the 45.114.23.72", 9: "1 2 3 4 5", 10: "of the and",
    }
    wanted = {
        1: "a nitwit here", 2: "nitwit", 3: "dunce!", 4: "blockhead", 5: "blockhead, dunce", 6: None, 7: "",
        8: "the 45.114.23.72", 9: "1 2 3 4 5", 10: "of the and",
    }
    found = rows_of(toxicity.restore(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model))
    assert {i: r.restored for i, r in found.items()} == wanted
    assert toxicity.restore(none).collect() == []


def test_decoder_takes_the_cheapest_of_all_readings():
    pick = np.random.default_rng(22)
    model = np.log(pick.dirichlet(np.ones(64) * 0.3, size=64 * 64) + 1e-9).ravel().tolist()

    def readings(ways, a, b):
        if not ways:
            yield (-model[(a * 64 + b) * 64] if b else 0.0), ""
            return
        for symbol, own, extra in ways[0]:
            if symbol is None:
                here, after = extra, (a, b)
            elif symbol == 0:
                here, after = extra - (model[(a * 64 + b) * 64] if b else 0.0), (0, 0)
            else:
                here, after = extra - model[(a * 64 + b) * 64 + symbol], (b, symbol)
            for cost, rest in readings(ways[1:], *after):
                yield here + cost, own + rest

    for _ in range(60):
        text = "".join(pick.choice(list("ab01@ .!*xx"), pick.integers(1, 7)))
        assert toxicity.decode(text, model) == min(readings(toxicity.lattice(text), 0, 0))[1] or np.isclose(
            min(readings(toxicity.lattice(text), 0, 0))[0],
            min(c for c, t in readings(toxicity.lattice(text), 0, 0) if t == toxicity.decode(text, model)),
        )


def test_long_texts_are_scored_in_stretches(monkeypatch):
    words = " ".join(f"word{i} n i t w i t bl0ck" for i in range(400))
    whole = [(t, r) for t, _, r in toxicity.joined([words, "x", None or ""])]
    monkeypatch.setattr(toxicity, "CHUNK", 300)
    parts = list(toxicity.stretches([words, "x", ""]))
    assert len(parts) > 20 and " ".join(t for r, t in parts if r == 0) == words and len(whole) == 1
    assert all(not re.search(r"\b\w$", t) for _, t in parts[:-3])
    model = np.full(64**3, -3.0, np.float32)
    cells = []
    for chunk in (300, 10**6):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        decoder = toxicity.Decoder(model)
        cells.append(sorted(c for text, ends, _ in toxicity.joined([words]) for c in toxicity.windows(*decoder.restored(text, ends))[0].tolist()))
    assert cells[0] == cells[1]


def test_quotas_keep_sizes():
    pick = np.random.default_rng(41)
    for _ in range(300):
        n = pick.integers(1, 9)
        asked = pick.integers(0, 30, (n, n)) * (pick.random((n, n)) < 0.6)
        np.fill_diagonal(asked, 0)
        free = pick.integers(0, 20, n) * pick.integers(0, 2)
        granted, filled = sharding.quotas(asked, free)
        assert (granted >= 0).all() and (granted <= asked).all() and (filled.sum(axis=1) <= free).all()
        moves = granted + filled
        assert (moves.sum(axis=0) == moves.sum(axis=1)).all()
    ring = np.roll(np.eye(5, dtype=int), 1, axis=1) * 7
    assert (sharding.quotas(ring, np.zeros(5, int))[0] == ring).all()  # a cycle needs no opposite requests
    one_way = np.array([[0, 9], [0, 0]])
    assert sharding.quotas(one_way, np.array([0, 4]))[0].sum() == 4


@pytest.mark.parametrize(("size", "least", "most_cut"), [(2, 0.95, 0.05), (3, 0.9, 0.1), (20, 0.3, 0.2)])
def test_sharding_moves_where_all_texts_have_copies(spark, size, least, most_cut):
    n = 4800
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.xxhash64(F.pmod(F.xxhash64("id"), F.lit(n // size))).cast("string").alias("text"))
    numbered, total = sharding.numbered(rows)
    links = sharding.written(sharding.equal_text_links(numbered, total, 24), "links")
    start = numbered.select("row", F.pmod("row", F.lit(24)).cast("int").alias("shard"))
    before = sharding.kept_together(start, links).first()
    ended = sharding.propagate(start, links, total, 24)
    after = sharding.kept_together(ended, links).first()
    assert after.whole >= least * after.hubs and after.cut < most_cut * before.cut
    counts = [r["count"] for r in ended.groupBy("shard").count().collect()]
    assert len(counts) == 24 and max(counts) - min(counts) <= 1
