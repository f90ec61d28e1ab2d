"""Queries over the test tables, one or more for each operator, with equivalent SQL. All read whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import metrics, scalars
from vecloom.operators import generate, knn, prepare, summary, text, validate
from vecloom.schema import Field, Kind, Schema

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = 10


def query(sql: str | None = None, name: str | None = None):
    """Registers a function as a query, with its SQL."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Nearest neighbours. Vectors are scaled, for on unit vectors most metrics rank alike.


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("label"))).alias("v"))


_SCALED = "s AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x * (1 + label)) AS v FROM embeddings)"
_DISTANCE = {
    "cosine": "list_cosine_distance(a.v, b.v)",
    "l2": "list_distance(a.v, b.v)",
    "sql2": "list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
    "l1": "list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2])))",
    "chebyshev": "list_max(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2])))",
    "ip": "-list_inner_product(a.v, b.v)",
    "canberra": "list_sum(list_transform(list_zip(a.v, b.v), lambda p: CASE WHEN abs(p[1]) + abs(p[2]) = 0 THEN 0 ELSE abs(p[1] - p[2]) / (abs(p[1]) + abs(p[2])) END))",
}


def _knn_sql(distance: str, condition: str = "true", columns: str = "q_id, rk, t_id") -> str:
    return f"""WITH {_SCALED}, d AS (SELECT a.vec_id AS q_id, b.vec_id AS t_id, {distance} AS distance FROM s a, s b WHERE {condition}),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, t_id)::INTEGER AS rk FROM d) SELECT {columns} FROM r WHERE rk <= {K}"""


def _knn(metric: str, strategy: str = "auto", where: str | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = scaled(spark, sf_dir)
        return knn.knn(rows, rows, vector="v", pk="vec_id", k=K, metric=metric, strategy=strategy, where=where).select("q_id", "rk", "t_id")

    return run


for _name, _metric in (("cosine", "cosine"), ("l2", "l2"), ("sql2", "sqeuclidean"), ("l1", "l1"), ("chebyshev", "chebyshev"), ("ip", "ip"), ("canberra", "canberra")):
    query(_knn_sql(_DISTANCE[_name]), f"knn_{_name}")(_knn(_metric))
query(_knn_sql(_DISTANCE["cosine"]), "knn_native_cosine")(_knn("cosine", "native"))
query(_knn_sql(_DISTANCE["l2"]), "knn_native_l2")(_knn("l2", "native"))
query(_knn_sql(_DISTANCE["cosine"], "b.label < 5"), "knn_filtered")(_knn("cosine", where="label < 5"))


@query(_knn_sql(_DISTANCE["cosine"]))
def knn_two_phase_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(spark, sf_dir)
    parts = [knn.knn(rows, rows, vector="v", pk="vec_id", k=K, where=w) for w in ("label < 5", "label >= 5")]
    return knn.merged(parts, K).select("q_id", "rk", "t_id")


@query(_knn_sql(_DISTANCE["l2"]).replace("q_id, rk, t_id FROM r", "q_id AS vec_id, rk AS place, t_id AS neighbor FROM r"))
def neighbors_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(spark, sf_dir)
    found = knn.neighbours(rows, rows, vector="v", pk="vec_id", k=K, metric="l2")
    return found.select("vec_id", F.posexplode("neighbors_id").alias("place", "neighbor")).select("vec_id", (F.col("place") + 1).alias("place"), "neighbor")


@query(f"WITH {_SCALED} SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_cosine_distance(a.v, b.v), 6) AS cosine, round(list_distance(a.v, b.v), 6) AS l2 FROM s a, s b")
def pairwise_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(spark, sf_dir)
    return knn.pairwise(rows, rows, vector="v", pk="vec_id", digits=6)


# Vectors


@query(f"WITH {_SCALED} SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM s")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled(spark, sf_dir).select("vec_id", F.round(metrics.l2_norm("v"), 6).alias("norm"))


@query(f"WITH {_SCALED}, n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM s) SELECT vec_id, (i - 1)::INTEGER AS at, round(v[i] / norm, 6) AS x FROM n, range(1, len(v) + 1) r(i)")
def normalized_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled(spark, sf_dir).select("vec_id", F.posexplode(metrics.normalized("v")).alias("at", "x")).select("vec_id", "at", F.round("x", 6).alias("x"))


_MOMENTS = f"{_SCALED}, e AS (SELECT vec_id, i - 1 AS pos, v[i] AS x FROM s, range(1, len(v) + 1) r(i)), m AS (SELECT pos, avg(x) AS mean, stddev_pop(x) AS deviation FROM e GROUP BY pos)"


@query(f"WITH {_MOMENTS} SELECT pos::INTEGER AS at, round(mean, 6) AS mean, round(deviation, 6) AS deviation FROM m")
def vector_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.moments(scaled(spark, sf_dir), "v").select("at", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query(f"WITH {_MOMENTS} SELECT vec_id, pos::INTEGER AS at, round((x - mean) / deviation, 6) AS x FROM e JOIN m USING (pos)")
def standardized_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _, _ = generate.standardize(scaled(spark, sf_dir), "v")
    return out.select("vec_id", F.posexplode("standardized").alias("at", "x")).select("vec_id", "at", F.round("x", 6).alias("x"))


@query()
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.pca(scaled(spark, sf_dir), "v", 8)[0].select("vec_id", "projected")


@query()
def gmm_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    projected = generate.pca(scaled(spark, sf_dir), "v", 8)[0]
    return generate.mixture_sample(spark, *generate.mixture(projected, "projected", 3), rows=10_000)


@query()
def random_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.random_vectors(spark, 10_000, 64)


@query()
def cluster_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.cluster_vectors(spark, 10_000, 64, 5)


# Scans, projections, splits


def _scan(name: str):
    return lambda spark, sf_dir: table(spark, sf_dir, name)


for _name in TABLES:
    query(f"SELECT * FROM {_name}", f"scan_{_name}")(_scan(_name))


@query("SELECT vec_id, label, (i - 1)::INTEGER AS at, embedding[i] AS x FROM embeddings, range(1, len(embedding) + 1) r(i)")
def scan_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("at", "x"))


@query("SELECT doc_id AS chunk_id, text AS body, source FROM documents")
def rename_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "chunk_id").withColumnRenamed("text", "body").select("chunk_id", "body", "source")


@query("SELECT row_number() OVER (ORDER BY lang, doc_id) - 1 AS idx, doc_id FROM documents")
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.dense_ids(table(spark, sf_dir, "documents"), ["lang", "doc_id"], name="idx").select("idx", "doc_id")


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 900 OFFSET 100")
def slice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.slice_rows(table(spark, sf_dir, "events"), ["event_id"], 100, 1000).select("event_id", "user_id")


_BATCHES = "WITH b AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch FROM orders)"


@query(f"{_BATCHES} SELECT o_orderkey, batch FROM b")
def batch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.batch_numbers(table(spark, sf_dir, "orders"), ["o_orderkey"], 1000).select("o_orderkey", "batch")


@query(f"{_BATCHES} SELECT batch, count(*) AS n FROM b GROUP BY batch")
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_numbers(spark, sf_dir).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


_SPLIT = "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS n FROM documents)"


@query(f"{_SPLIT} SELECT doc_id, source, CASE WHEN n <= 20 THEN 'train' ELSE 'test' END AS split FROM r WHERE n <= 25")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    train, test = prepare.train_test(docs, [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")], train=20, test=5, by=["source"])
    return prepare.union_all([train.withColumn("split", F.lit("train")), test.withColumn("split", F.lit("test"))])


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT p_partkey, p_name FROM part")
def union_all_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = {"customer": "c_cust", "supplier": "s_supp", "part": "p_part"}
    return prepare.union_all([table(spark, sf_dir, t).select(F.col(f"{c}key").alias("id"), F.col(f"{c[0]}_name").alias("name")) for t, c in pick.items()])


@query("SELECT 'train' AS split, count(*) AS num_rows, 5::BIGINT AS num_columns FROM documents UNION ALL SELECT 'test', count(*), 3 FROM pages")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.split_summary({"train": table(spark, sf_dir, "documents"), "test": table(spark, sf_dir, "pages")})


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS largest, round(coalesce(stddev_samp(value), 0), 6) AS deviation FROM events GROUP BY event_type")
def bench_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summary.value_stats(table(spark, sf_dir, "events"), ["event_type"], "value")
    return s.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "least", "largest", "deviation")))


# Scalars


@query("SELECT l_returnflag, greatest(1, ceil(count(*) / 10000.0))::BIGINT AS epochs FROM lineitem GROUP BY l_returnflag")
def epoch_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")).select("l_returnflag", scalars.epochs("n", 10_000).alias("epochs"))


@query("SELECT source, greatest(10000, round_even(33554432.0::DOUBLE / (sum(strlen(text)) / count(*)::DOUBLE) / 10000.0::DOUBLE, 0) * 10000)::BIGINT AS rows_per_file FROM documents GROUP BY source")
def rows_per_file_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n"))
    return sizes.select("source", scalars.rows_per_file(F.col("b"), F.col("n"), 32 << 20).alias("rows_per_file"))


@query("SELECT lang, printf('%.3f MB', sum(strlen(text)) / 1048576.0::DOUBLE) AS size FROM documents GROUP BY lang")
def size_mb_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.octet_length("text")).alias("b")).select("lang", scalars.size_mb("b").alias("size"))


@query("SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, list_extract(string_split(url, '/'), -1) AS base, string_split(list_extract(string_split(url, '/'), -1), '.')[1] AS stem FROM pages")
def file_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", scalars.scheme("url").alias("scheme"), scalars.basename("url").alias("base"), scalars.stem("url").alias("stem"))


# Validation

DOCUMENTS = Schema((Field("doc_id", Kind.INT64, is_primary=True), Field("text", Kind.VARCHAR, max_length=2000), Field("lang", Kind.VARCHAR, max_length=2), Field("source", Kind.VARCHAR, max_length=4), Field("n_chars", Kind.INT16)))


@query(
    "SELECT doc_id::VARCHAR AS pk, 'text' AS field, 'max_length' AS rule FROM documents WHERE length(text) > 2000 UNION ALL SELECT doc_id::VARCHAR, 'source', 'max_length' FROM documents WHERE length(source) > 4 "
    "UNION ALL SELECT doc_id::VARCHAR, 'lang', 'max_length' FROM documents WHERE length(lang) > 2 UNION ALL SELECT doc_id::VARCHAR, 'n_chars', 'range' FROM documents WHERE n_chars NOT BETWEEN -32768 AND 32767"
)
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.violations(table(spark, sf_dir, "documents"), DOCUMENTS)


@query("SELECT 'x' AS field, 'required' AS rule, count(*) AS broken FROM documents WHERE lang = 'en'")
def validate_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("lang") != "en", F.col("text")).alias("x"))
    return validate.counts(docs, Schema((Field("x", Kind.STRING),)))


@query("SELECT source, count(*) FILTER (length(text) <= 200) AS good, count(*) FILTER (length(text) > 200) AS bad FROM documents GROUP BY source")
def validate_varchar(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = validate.within_length("text", 200)
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad"))


_AS_TEXT = "CASE WHEN user_id % 3 = 0 THEN 'u' || user_id WHEN user_id % 3 = 1 THEN user_id || '.5' ELSE user_id::VARCHAR END"


@query(f"SELECT event_type, count(*) FILTER (regexp_matches({_AS_TEXT}, '^[0-9]+$')) AS whole, count(*) FILTER (try_cast({_AS_TEXT} AS DOUBLE) IS NOT NULL) AS numbers FROM events GROUP BY event_type")
def validate_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    shown = F.when(u % 3 == 0, F.concat(F.lit("u"), u.cast("string"))).when(u % 3 == 1, F.concat(u.cast("string"), F.lit(".5"))).otherwise(u.cast("string"))
    return table(spark, sf_dir, "events").select("event_type", shown.alias("t")).groupBy("event_type").agg(F.count_if(F.col("t").rlike("^[0-9]+$") & validate.is_integer("t")).alias("whole"), F.count_if(validate.is_float("t")).alias("numbers"))


@query("SELECT label, count(*) FILTER (len(e) = 64) AS good, count(*) FILTER (len(e) <> 64) AS bad FROM (SELECT label, CASE WHEN label < 3 THEN embedding[1:63] ELSE embedding END AS e FROM embeddings) GROUP BY label")
def validate_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.when(F.col("label") < 3, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    ok = validate.has_dim("e", 64)
    return table(spark, sf_dir, "embeddings").select("label", e.alias("e")).groupBy("label").agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad"))


@query("SELECT conv_id, len(l) <= 4 AS fits, len(list_filter(l, lambda x: length(x) > 100)) = 0 AS short FROM (SELECT conv_id, list(text) AS l FROM conversations GROUP BY conv_id)")
def validate_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("l"))
    return lists.select("conv_id", validate.within_capacity("l", 4).alias("fits"), validate.elements_within_length("l", 100).alias("short"))


_PROPS = "CASE WHEN event_id % 4 = 0 THEN '[' || props || ']' WHEN event_id % 4 = 1 THEN props || '}' ELSE props END"


@query(f"SELECT event_type, count(*) FILTER (ok) AS good, count(*) FILTER (NOT ok) AS bad FROM (SELECT event_type, CASE WHEN json_valid(p) THEN json_type(p) = 'OBJECT' ELSE false END AS ok FROM (SELECT event_type, {_PROPS} AS p FROM events)) GROUP BY event_type")
def validate_json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 4
    p = F.when(m == 0, F.concat(F.lit("["), "props", F.lit("]"))).when(m == 1, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    ok = validate.is_json_object("p")
    return table(spark, sf_dir, "events").select("event_type", p.alias("p")).groupBy("event_type").agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad"))


# Texts

_TERMS = """t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]{2,}')) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM c GROUP BY term)"""


@query(f"WITH {_TERMS} SELECT term, df, total FROM d ORDER BY total DESC, term LIMIT 500")
def tfidf_vocab_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.vocabulary(text.terms(table(spark, sf_dir, "documents")), 500)


def _tfidf_sql(vocabulary: str) -> str:
    return f"""WITH {_TERMS}, v AS ({vocabulary}), w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1) AS w FROM c JOIN v USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""


@query(_tfidf_sql("SELECT * FROM d"))
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tfidf(table(spark, sf_dir, "documents"), max_features=None).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(_tfidf_sql("SELECT * FROM d ORDER BY total DESC, term LIMIT 500"))
def tfidf_max_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tfidf(table(spark, sf_dir, "documents"), max_features=500).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query()
def sparse_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.sparse_vectors(table(spark, sf_dir, "documents"))


@query(
    f"""WITH {_TERMS}, v AS (SELECT *, row_number() OVER (ORDER BY term) - 1 AS place FROM (SELECT * FROM d ORDER BY total DESC, term LIMIT 10000)),
w AS (SELECT doc_id, place, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1) AS w FROM c JOIN v USING (term))
SELECT doc_id, place::INTEGER AS place, round((w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 4) AS weight FROM w"""
)
def sparse_embeddings_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = sparse_embeddings(spark, sf_dir).select("doc_id", F.explode("sparse_embedding").alias("place", "weight"))
    return each.select("doc_id", "place", F.round(F.col("weight").cast("double"), 4).alias("weight"))


for _name, _sql in (
    ("braycurtis", "list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2]))) / list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] + p[2])))"),
    ("minkowski", "list_distance(a.v, b.v)"),
):
    query(_knn_sql(_sql), f"knn_{_name}")(_knn(_name))
