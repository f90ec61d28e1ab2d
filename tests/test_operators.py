import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import generate, prepare, summary, text


def test_dense_ids_and_batches(spark):
    df = spark.range(1003).withColumn("k", F.xxhash64("id")).repartition(7)
    got = prepare.dense_ids(df, ["k"], name="n", start=5).orderBy("k").collect()
    assert [r.n for r in got] == list(range(5, 1008))
    sizes = {r[0]: r[1] for r in prepare.batch_numbers(df, ["k"], 100).groupBy("batch").count().collect()}
    assert sizes == {**{k: 100 for k in range(10)}, 10: 3}
    assert prepare.dense_ids(df.limit(0), ["k"], name="n").count() == 0
    with pytest.raises(ValueError):
        prepare.batch_numbers(df, ["k"], 0)


def test_slices_samples_splits(spark):
    df = spark.range(50)
    assert [r.id for r in prepare.slice_rows(df, ["id"], 10, 13).collect()] == [10, 11, 12]
    a = [r.id for r in prepare.sample(df, "id", 9).collect()]
    assert len(set(a)) == 9 and a == [r.id for r in prepare.sample(df.repartition(5), "id", 9).collect()]
    train, test = prepare.train_test(df, ["id"], train=30, test=5)
    assert (train.count(), test.count(), train.join(test, "id").count()) == (30, 5, 0)
    clash = df.select("id", *(F.lit(k).alias(c) for k, c in enumerate(("at", "_at", "part", "own", "n", "before", "_n"))))
    assert prepare.slice_rows(clash, ["id"], 10, 13).columns == clash.columns
    assert [c.columns for c in prepare.train_test(clash, ["id"], train=3, test=2, by=["n"])] == [clash.columns] * 2
    assert prepare.batch_numbers(clash, ["id"], 10, name="batch").columns == [*clash.columns, "batch"]
    both = prepare.union_all([spark.range(2), spark.range(1).withColumn("x", F.lit(1))])
    assert both.count() == 3 and both.columns == ["id", "x"]


def test_stats(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", None)], "g string, v double")
    got = {r.g: tuple(r)[1:] for r in summary.value_stats(df, ["g"], "v").collect()}
    assert got == {"a": (2, 2.0, 1.0, 3.0, math.sqrt(2)), "b": (1, 2.0, 2.0, 2.0, 0.0), "c": (0, None, None, None, None)}


def test_tfidf(spark):
    docs = spark.createDataFrame([(1, "The cat the CAT a"), (2, "dog cat"), (3, None), (4, "a I")], "doc_id bigint, text string")
    got = {(r.doc_id, r.term): r.weight for r in text.tfidf(docs).collect()}
    idf = {t: math.log(5 / (1 + df)) + 1 for t, df in (("the", 1), ("cat", 2), ("dog", 1))}
    n1, n2 = math.hypot(2 * idf["the"], 2 * idf["cat"]), math.hypot(idf["dog"], idf["cat"])
    want = {(1, "the"): 2 * idf["the"] / n1, (1, "cat"): 2 * idf["cat"] / n1, (2, "dog"): idf["dog"] / n2, (2, "cat"): idf["cat"] / n2}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert [r.term for r in text.vocabulary(text.terms(docs), 2).collect()] == ["cat", "the"]
    sparse = {r.doc_id: r.sparse_embedding for r in text.sparse_vectors(docs).collect()}
    assert set(sparse[1]) == {0, 2} and sparse[3] == {} and sparse[4] == {}
    words = spark.createDataFrame([(1, "é日本 naïve")], "doc_id bigint, text string")
    assert {r.term for r in text.terms(words, pattern=text.UNICODE_TOKEN).collect()} == {"é日本", "naïve"}


def test_encoder(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "doc_id bigint, text string")
    got = {r.doc_id: r.dense_embedding for r in text.dense_vectors(docs, lambda: lambda ts: [[len(t), 1] for t in ts]).collect()}
    assert got == {1: [3.0, 1.0], 2: None, 3: [0.0, 1.0]}
    assert text.embeddings(docs, lambda: lambda ts: [[1.0] for _ in ts]).columns == ["doc_id", "sparse_embedding", "dense_embedding"]


def test_vectors(spark):
    v = generate.random_vectors(spark, 5000, 3).toPandas()
    x = np.stack(v.embedding)
    assert sorted(v.id) == list(range(5000)) and 0 <= x.min() and x.max() < 1 and abs(x.mean() - 0.5) < 0.02
    assert v.sort_values("id").embedding.map(tuple).tolist() == generate.random_vectors(spark, 5000, 3).repartition(2).toPandas().sort_values("id").embedding.map(tuple).tolist()
    c = generate.cluster_vectors(spark, 1001, 16, 5).toPandas()
    centre = [np.stack(c[c.id % 5 == k].embedding).mean(0) for k in range(5)]
    assert min(np.linalg.norm(centre[a] - centre[b]) for a in range(5) for b in range(a)) > 10
    assert abs(np.stack(c[c.id % 5 == 0].embedding).std(0).mean() - 2) < 0.2


def test_standardize_pca_mixture(spark):
    df = generate.cluster_vectors(spark, 900, 6, 3)
    out, mean, deviation = generate.standardize(df, "embedding")
    x = np.stack(out.toPandas().standardized)
    assert np.abs(x.mean(0)).max() < 1e-6 and np.abs(x.std(0) - 1).max() < 1e-6
    back = generate.restore(out, "standardized", mean, deviation).toPandas()
    np.testing.assert_allclose(np.stack(back.restored), np.stack(back.embedding), atol=1e-4)
    projected, components, m, share = generate.pca(df, "embedding", 6)
    assert abs(share.sum() - 1) < 1e-6
    whole = generate.unproject(projected, "projected", components, m).toPandas()
    np.testing.assert_allclose(np.stack(whole.restored), np.stack(whole.embedding), atol=1e-4)
    weights, means, covariances = generate.mixture(df, "embedding", 3)
    drawn = np.stack(generate.mixture_sample(spark, weights, means, covariances, 3000).toPandas().embedding)
    np.testing.assert_allclose(drawn.mean(0), np.stack(df.toPandas().embedding).mean(0), atol=1.5)


def test_tfidf_with_few_known_terms(spark, monkeypatch):
    """A vocabulary beyond what workers hold is joined, with the same weights; one that they hold needs no shuffle of texts."""
    docs = spark.createDataFrame([(1, "the cat the dog_1"), (2, "cat naps"), (3, None), (4, "a"), (5, "rare words the")], "doc_id bigint, text string")
    want = {(r.doc_id, r.term): r.weight for r in text.tfidf(docs, max_features=None).collect()}
    plan = text.tfidf(docs, max_features=2)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert "Exchange" not in text.sparse_vectors(docs)._jdf.queryExecution().toString()
    sparse = {r.doc_id: r.sparse_embedding for r in text.sparse_vectors(docs).collect()}
    monkeypatch.setattr(text, "_KNOWN", 2)
    got = {(r.doc_id, r.term): r.weight for r in text.tfidf(docs, max_features=None).collect()}
    assert got.keys() == want.keys() and len(got) == 8 and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert {r.doc_id: r.sparse_embedding for r in text.sparse_vectors(docs).collect()} == sparse
