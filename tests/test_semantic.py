import numpy as np
import pytest
from pyspark.sql import functions as F

from mail_rows import ids
from mailspark.functions.text import token_overlap, tokens
from mailspark.functions.vectors import cosine_distance
from mailspark.operators import semantic, vector_index


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(400, 16))
    rows = [(f"m{n:03}", [float(x) for x in v]) for n, v in enumerate(data)]
    return data, spark.createDataFrame(rows, "message_id string, vec array<float>").cache()


def brute(data, query):
    data = data.astype("float32").astype("float64")
    return 1 - data @ query / (np.linalg.norm(data, axis=1) * np.linalg.norm(query))


def test_distance_range_and_null(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 3.0]), (3, [-2.0, 0.0]), (4, None)]
    frame = spark.createDataFrame(rows, "k int, vec array<float>")
    found = {r["k"]: r["d"] for r in frame.select("k", cosine_distance(F.col("vec"), [2.0, 0.0]).alias("d")).collect()}
    assert found == {1: 0.0, 2: 1.0, 3: 2.0, 4: None}


def test_nearest_equals_brute_force(cloud):
    data, vectors = cloud
    query = data[5] + 0.1
    expected = np.argsort(brute(data, query), kind="stable")[:20]
    found = semantic.nearest(vectors, query.tolist(), 20)
    assert ids(found) == [f"m{n:03}" for n in expected]


def test_nearest_to_each_equals_single_searches(cloud):
    data, vectors = cloud
    queries = {f"q{n}": data[n].tolist() for n in (3, 8, 21)}
    hits = semantic.nearest_to_each(vectors, queries, 7)
    found = {}
    for row in hits.orderBy("query", "rank").collect():
        found.setdefault(row["query"], []).append(row["message_id"])
    for name, query in queries.items():
        assert found[name] == ids(semantic.nearest(vectors, query, 7))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_ties_and_missing_vectors(spark):
    rows = [("b", [1.0]), ("a", [1.0]), ("n", None)]
    vectors = spark.createDataFrame(rows, "message_id string, vec array<float>")
    assert ids(semantic.nearest(vectors, [1.0], 3)) == ["a", "b", "n"]
    assert ids(semantic.nearest_to_each(vectors, {"q": [1.0]}, 3).orderBy("rank")) == ["a", "b"]


def test_bound_applies_after_the_nearest_n(sample, spark):
    rows = [("<1@x>", [1.0, 0.0]), ("<2@x>", [1.0, 0.2]), ("<3@x>", [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "message_id string, vec array<float>")
    found = semantic.semantic_search(sample, vectors, [1.0, 0.0])
    assert ids(found) == ["<1@x>", "<2@x>"]
    assert ids(semantic.semantic_search(sample, vectors, [1.0, 0.0], n=1)) == ["<1@x>"]
    assert semantic.semantic_search(sample, vectors, None).columns == found.columns


def test_approximate_search_recall_and_pruning(spark, cloud, tmp_path):
    data, vectors = cloud
    index = vector_index.build_index(vectors, str(tmp_path / "index"), tables=8, bits=4)
    distance, hits = dict(zip((f"m{n:03}" for n in range(400)), brute(data, data[9]))), 0
    for n in range(0, 400, 40):
        exact = set(ids(semantic.nearest(vectors, data[n].tolist(), 10)))
        hits += len(exact & set(ids(index.nearest(data[n].tolist(), 10))))
    assert hits >= 80
    found = index.nearest(data[9].tolist(), 10).collect()
    assert all(abs(r["dist"] - distance[r["message_id"]]) < 1e-5 for r in found)
    candidates = index.candidates(data[9].tolist())
    plan = candidates._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((" in plan and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert candidates.select("table_no", "bucket").distinct().count() <= 8 * 2**vector_index.TURNED
    all_rows = index.nearest(data[9].tolist(), 400, turned=4)  # every bucket
    assert set(ids(all_rows)) == set(ids(vectors.filter("vec is not null")))


def test_index_of_odd_vectors(spark, tmp_path):
    rows = [("a", [1.0, 0.0]), ("b", None), ("zero", [0.0, 0.0]), ("a", [0.9, 0.1])]
    vectors = spark.createDataFrame(rows, "message_id string, vec array<float>")
    index = vector_index.build_index(vectors, str(tmp_path / "i"))
    assert ids(index.nearest([1.0, 0.0], 5, turned=9)) == ["a"] and index.bits == 1
    none = vector_index.build_index(vectors.limit(0), str(tmp_path / "n"))
    assert none.nearest([1.0], 5).count() == 0
    with pytest.raises(ValueError):
        vector_index.build_index(vectors.union(spark.createDataFrame([("c", [1.0])], vectors.schema)), str(tmp_path / "w"))
    assert [vector_index.bits_for(n) for n in (0, 4096, 10**6, 10**10)] == [1, 1, 8, 22]


def test_nearest_to_each_in_blocks(spark, cloud, monkeypatch):
    monkeypatch.setattr(semantic, "QUERIES_AT_ONCE", 3)
    data, vectors = cloud
    extra = spark.createDataFrame([("zero", [0.0] * data.shape[1]), ("m000", data[0].tolist()), ("none", None)], vectors.schema)
    asked = {f"q{n}": data[n].tolist() for n in range(8)}
    found = {}
    for r in semantic.nearest_to_each(vectors.union(extra).repartition(3), asked, 4).orderBy("query", "rank").collect():
        found.setdefault(r["query"], []).append(r["message_id"])
    names = [f"m{n:03}" for n in range(400)] + ["m000"]
    for n in range(8):
        dist = brute(np.vstack((data, data[:1])), data[n])
        assert found[f"q{n}"] == [names[i] for i in sorted(range(401), key=lambda i: (round(dist[i], 12), names[i]))[:4]]
    every = semantic.nearest_to_each(extra, {"q": data[1].tolist()}, 9).orderBy("rank").collect()
    assert [(r["message_id"], r["dist"] is None) for r in every] == [("m000", False), ("zero", True)]


def test_hashed_terms(spark):
    documents = spark.createDataFrame(
        [("a", "red green"), ("b", "green RED"), ("c", None)], "message_id string, text string"
    )
    found = {r["message_id"]: r["vec"] for r in semantic.embed_documents(documents).collect()}
    assert found["a"] == found["b"] != found["c"]
    assert all(len(v) == semantic.VECTOR_WIDTH and abs(np.linalg.norm(v) - 1) < 1e-5 for v in found.values())
    query = semantic.embed_query(spark, "red")
    nearest = semantic.nearest(semantic.embed_documents(documents), query, 3)
    assert set(ids(nearest)[:2]) == {"a", "b"}
    assert semantic.embed_query(spark, "") is None


def test_model_embedder_gets_batches_with_the_prompt(spark):
    def load():
        return lambda texts: [[float(len(t)), float(t.startswith("title: none | text: "))] for t in texts]

    documents = spark.createDataFrame([("a", "xy"), ("b", "")], "message_id string, text string")
    embedded = semantic.embed_documents(documents, semantic.model_embedder(load))
    prefix = len(semantic.DOCUMENT_PREFIX)
    assert {r["message_id"]: r["vec"] for r in embedded.collect()} == {"a": [prefix + 2.0, 1.0], "b": [prefix, 1.0]}


def test_rerank(spark):
    documents = spark.createDataFrame(
        [("a", "the red car"), ("b", "Red  car"), ("c", "red car")], "message_id string, text string"
    )
    hits = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "message_id string, dist double")
    best = semantic.rerank_best(documents, hits, "car red", 2).first()
    assert (best["message_id"], best["score"]) == ("b", 1.0)


def test_overlap_of_nothing_is_zero(spark):
    frame = spark.createDataFrame([(" ", "")], "a string, b string")
    assert frame.select(token_overlap(tokens(F.col("a")), tokens(F.col("b"))).alias("s")).first()["s"] == 0.0


def test_hybrid_search_lists_repeated_ids_once_each(spark, emails_of):
    from mailspark.plans.mail_search import search_mail

    mail = emails_of(*[{"message_id": "<r@x>", "email_start": 100 * i} for i in range(3)])
    vectors = spark.createDataFrame([("<r@x>", [1.0, 0.0])] * 3, "message_id string, vec array<float>")
    found = search_mail(mail, "rag:anything", vectors=vectors, embed=lambda text: [1.0, 0.0])
    assert found.page.count() == 3
    assert found.meta.first()["total_count"] == 3
