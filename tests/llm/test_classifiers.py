import random

import numpy as np
from fixtures import documents, edge_rows, prose
from pyspark.sql import functions as F

from conftest import SF
from vecloom.llm import language_id, toxicity
from vecloom.llm.common import drawn
from vecloom.llm.queries import QUERIES

BIG = SF.replace("0.001", "0.01")


def table(spark, name, sf=BIG):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_language_held_out(spark):
    docs = table(spark, "documents")
    model = language_id.fit(docs.where("doc_id % 2 = 0"))
    got = language_id.identify(docs.where("doc_id % 2 = 1"), model).join(docs, "doc_id").toPandas()
    kept = got[~got.rejected]
    assert len(kept) > 0.97 * len(got) and (kept.lang_pred == kept.lang).mean() > 0.97
    _, _, rejected = model.classify(["日本語の文章です。" * 30, "12345 67890 !!! " * 50, "Привет мир как дела " * 30, "xqzj vkwq zzxq jqxv " * 40])
    assert rejected.all()
    assert len(model.langs) > len(set(model.langs))  # several centroids each


def test_language_brute_force(spark):
    """Each query row is what the plain formula gives."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in QUERIES["op6_language_id"](spark, SF).collect()}
    for r in docs.collect():
        x = language_id.ngram_counts(r.text, model.bits) * model.idf
        s = model.centroids @ x / max(np.linalg.norm(x), 1e-30)
        size = min(len(r.text).bit_length(), len(model.least) - 1)
        assert abs(got[r.doc_id].similarity - s.max()) < 1e-4
        assert got[r.doc_id].rejected == bool(s.max() < model.least[size]) and (got[r.doc_id].rejected or got[r.doc_id].lang_pred == model.langs[s.argmax()])


def test_language_edges(spark):
    rows = edge_rows()
    docs = documents(spark, rows)
    model = language_id.fit(docs, least_rows=1)
    assert set(model.langs) == {"en", "ja"}
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id}
    assert all(by[k].rejected and by[k].similarity == 0 and by[k].lang_pred is None for k in (3, 4, 5))
    assert by[6].lang_pred == "en" and by[8].lang_pred == "ja"
    kept = language_id.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in got)
    none = language_id.fit(documents(spark, []))
    assert all(r.rejected for r in language_id.identify(docs, none).collect())
    assert language_id.identify(documents(spark, []), model).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = (table(spark, t, BIG.replace("0.01", "0.1")) for t in ("documents", "labels"))
    even = labels.where("doc_id % 2 = 0")
    got = toxicity.score(docs, toxicity.fit(docs, even)).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "truth"), "doc_id").join(docs, "doc_id").toPandas()
    truth = got.truth == 1
    assert got.toxic[truth].mean() > 0.85 and got.toxic[~truth].mean() < 0.01  # the labels have noise
    for lang, least in (("en", 0.9), ("fr", 0.8), ("de", 0.75), ("es", 0.5)):  # es has 16 toxic documents to learn from
        assert got.toxic[truth & (got.lang == lang)].mean() >= least, lang


def test_toxicity_is_brute_force(spark):
    """Each row of the query is what the plain formula gives."""
    import re

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, SF).collect()}
    assert len(got) == docs.count() and model.weights
    for r in docs.collect():
        parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", r.text) if p]
        z = []
        for p in parts:
            own = {f for w in re.findall(r"\w+", p.lower()) for f in [w] + [w[:k] + "*" for k in toxicity.PREFIXES if len(w) > k]}
            z.append(max(0, sum(model.weights.get(f, 0) for f in own)) + model.bias)
        p = 1 - np.prod([(1 - 1 / (1 + np.exp(-x))) * (1 + np.exp(model.bias)) for x in z]) if z else 0.0
        assert abs(got[r.doc_id].toxicity - p) < 1e-5
        if abs(p - model.threshold) > 1e-5:
            assert got[r.doc_id].toxic == (p >= model.threshold)
            assert len(got[r.doc_id].offending) == (sum(x >= min(0, max(z) - 1) for x in z) if p >= model.threshold else 0)


def test_fits_are_bounded(spark):
    """Of one id with many rows, be they equal or not, no more documents than the bound are drawn."""
    rng = random.Random(7)
    same = [(1, prose(rng, 20), "en", "s", 0)] * 3000 + [(1, prose(rng, 20), "en", "s", 0) for _ in range(2000)] + [(None, prose(rng, 20), "fr", "s", 0) for _ in range(30)]
    docs = spark.createDataFrame(same, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows = drawn(docs, F.col("lang"), "doc_id", "text", 10, 7).collect()
    assert len(rows) == 20 == len({(r.id, r.text) for r in rows}) and sum(r.label == "fr" for r in rows) == 10
    assert len(drawn(docs, F.col("lang"), "doc_id", "text", 10, 7, most_labels=1).collect()) == 10
    labels = spark.createDataFrame([(1, 1)], "id bigint, label int")
    assert len(drawn(docs, labels, "doc_id", "text", 10, 7).collect()) == 10


def test_offending_sentences(spark):
    rng = random.Random(2)
    rows, labels, where = [], [], {}
    for k in range(300):
        parts = [prose(rng, 8) for _ in range(6)]
        if k % 3 == 0:
            at = rng.randrange(6)
            parts[at] = f"You {rng.choice(['idiot', 'moron'])} of a {rng.choice(WORDS_)}."
            where[k] = parts[at]
        rows.append((k, " ".join(parts)))
        labels.append((k, int(k in where)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    for r in toxicity.score(docs, model).collect():
        assert r.toxic == (r.doc_id in where), r
        if r.toxic:
            assert r.offending == [where[r.doc_id]]
            parts = toxicity.sentences(rows[r.doc_id][1])
            assert [parts[i] for i in r.offending_at] == r.offending
            z = model.logits(parts)
            p = 1 / (1 + np.exp(-np.maximum(z, model.bias)))
            assert abs(r.toxicity - (1 - np.prod((1 - p) * (1 + np.exp(model.bias))))) < 1e-5  # the noisy-or


WORDS_ = ["day", "part", "oil"]


def test_long_texts_are_not_toxic_by_length():
    model = toxicity.Model({"vile": 12.0}, -6.0, 0.5)
    assert not model.judge("A word. " * 50_000)[1] and model.judge("A word. " * 50_000 + "A vile one.")[1]
    assert not toxicity.Model({}, 0.5, 0.5).judge("A word. " * 10)[1]


def test_toxicity_edges(spark):
    rows = edge_rows()
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (10, 0), (99, 1), (6, 7)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, least_documents=1)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id}
    assert all(by[k].toxicity == 0 and not by[k].toxic and by[k].offending == [] for k in (3, 4))
    kept = toxicity.civil(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.toxic for r in got)
    none = toxicity.fit(docs, labels.where("toxic = 5"))
    assert not any(r.toxic for r in toxicity.score(docs, none).collect())
    assert toxicity.score(documents(spark, []), model).count() == 0
    assert toxicity.fit(documents(spark, []), labels).weights == {}
