"""TF-IDF relationally, and a hook for dense text encoders."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.sources.shared import cut

#: Runs of two or more word characters.
TOKEN = r"[A-Za-z0-9_]{2,}"
UNICODE_TOKEN = r"(?U)\b\w\w+\b"
#: Terms that a worker holds at once: a vocabulary, or those counted before they are given away.
_KNOWN = 1 << 18


def terms(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", pattern: str = TOKEN) -> DataFrame:
    """(id, term, tf): how often each token occurs in each text, in lower case. Null texts have none."""
    each = docs.select(F.col(id_col), F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(pattern), F.lit(0))).alias("term"))
    return each.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counted: DataFrame, max_features: int | None = None) -> DataFrame:
    """(term, df, total) of terms(); the max_features terms with the largest total, ties in the order of terms."""
    all_ = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    return all_ if max_features is None else all_.orderBy(F.desc("total"), "term").limit(max_features)


def _split(docs: DataFrame, id_col: str, text_col: str, pattern: str) -> tuple[DataFrame, Callable[[pa.Array], Iterator[Counter]]]:
    """(id, text or its tokens), and what counts the tokens of each row of the second column."""
    shown = F.lower(text_col) if pattern == TOKEN else F.regexp_extract_all(F.lower(text_col), F.lit(pattern), F.lit(0))
    find = re.compile(TOKEN, re.ASCII).findall if pattern == TOKEN else lambda tokens: tokens

    def counted(column: pa.Array) -> Iterator[Counter]:
        for x in column:
            yield Counter(() if (x := x.as_py()) is None else find(x))

    return docs.select(F.col(id_col), shown.alias("text")), counted


def frequencies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_features: int | None = None, pattern: str = TOKEN) -> DataFrame:
    """vocabulary() of terms(), of texts with unique ids: counted in each task, so that only sums move."""
    rows, counted = _split(docs, id_col, text_col, pattern)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = Counter(), Counter()

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*df], pa.string()), pa.array(df.values(), pa.int64()), pa.array((total[t] for t in df), pa.int64())], names=["term", "df", "total"])

        for batch in batches:
            for own in counted(batch.column(1)):
                df.update(own.keys())
                total.update(own)
                if len(df) > _KNOWN:
                    yield given()
                    df.clear()
                    total.clear()
        yield given()

    sums = rows.mapInArrow(count, "term string, df bigint, total bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    return sums if max_features is None else sums.orderBy(F.desc("total"), "term").limit(max_features)


def _idf(docs: DataFrame, max_features: int | None, **columns) -> DataFrame:
    rows = docs.count()
    return frequencies(docs, max_features=max_features, **columns).select("term", "df", (F.ln((F.lit(rows) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def tfidf(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_features: int | None = 10_000, pattern: str = TOKEN) -> DataFrame:
    """(id, term, weight): tf * (ln((1 + n) / (1 + df)) + 1), scaled to a norm of 1 for each document.

    n counts the rows of docs, those with a null text too. Ids must be unique. Documents without any known term have no rows.
    With a bounded vocabulary, which every worker knows, texts are split once for the frequencies and again for the weights,
    and nothing else moves. Else terms are joined.
    """
    if max_features is None or max_features > _KNOWN:
        counted = cut(terms(docs, id_col=id_col, text_col=text_col, pattern=pattern))  # texts are split once
        rows = docs.count()
        idf = vocabulary(counted, max_features).select("term", (F.ln((F.lit(rows) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
        weighed = counted.join(idf, "term").select(id_col, "term", (F.col("tf") * F.col("idf")).alias("w"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
        return weighed.select(id_col, "term", (F.col("w") / norm).alias("weight"))
    known = _idf(docs, max_features, id_col=id_col, text_col=text_col, pattern=pattern).toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(known["term"].to_pylist(), known["idf"].to_pylist())))
    kind = docs.schema[id_col].dataType.simpleString()
    rows, counted = _split(docs, id_col, text_col, pattern)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            at, names, weights = [], [], []
            for i, own in enumerate(counted(batch.column(1))):
                found = [(t, n * w) for t, n in own.items() if (w := get(t)) is not None]
                w = np.array([w for _, w in found])
                at.append(np.full(len(found), i))
                names += [t for t, _ in found]
                weights.append(w / np.sqrt(w @ w))
                if len(names) > 1 << 16 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(at))), pa.array(names, pa.string()), pa.array(np.concatenate(weights))], names=[id_col, "term", "weight"])
                    at, names, weights = [], [], []

    return rows.mapInArrow(weigh, f"`{id_col}` {kind}, term string, weight double")


def sparse_vectors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_features: int = 10_000, pattern: str = TOKEN) -> DataFrame:
    """(id, sparse_embedding): a map from the term's place in the sorted vocabulary to its weight, empty without terms."""
    from vecloom.operators.prepare import dense_ids

    if max_features > _KNOWN:
        weights = cut(tfidf(docs, id_col=id_col, text_col=text_col, max_features=max_features, pattern=pattern))
        places = dense_ids(weights.select("term").distinct(), ["term"], name="place")
        maps = weights.join(places, "term").groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("place").cast("int").alias("k"), F.col("weight").cast("float").alias("v"))))).alias("sparse_embedding"))
        return docs.select(id_col).join(maps, id_col, "left").select(id_col, F.coalesce("sparse_embedding", F.create_map().cast("map<int,float>")).alias("sparse_embedding"))
    found = _idf(docs, max_features, id_col=id_col, text_col=text_col, pattern=pattern).toArrow()
    idf = sorted(zip(found["term"].to_pylist(), found["idf"].to_pylist()), key=lambda x: x[0].encode())
    shared = docs.sparkSession.sparkContext.broadcast({t: (i, w) for i, (t, w) in enumerate(idf)})
    rows, counted = _split(docs, id_col, text_col, pattern)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            at, ends, places, weights = 0, [0], [], []
            for i, own in enumerate(counted(batch.column(1))):
                row = sorted((x[0], n * x[1]) for t, n in own.items() if (x := get(t)) is not None)
                w = np.array([w for _, w in row])
                places += [k for k, _ in row]
                weights.append((w / np.sqrt(w @ w)).astype(np.float32))
                ends.append(len(places))
                if len(places) > 1 << 16 or i == batch.num_rows - 1:
                    maps = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()), pa.array(np.concatenate(weights), pa.float32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ends) - 1), maps], names=[id_col, "sparse_embedding"])
                    at, ends, places, weights = i + 1, [0], [], []

    return rows.mapInArrow(weigh, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, sparse_embedding map<int,float>")


def dense_vectors(docs: DataFrame, make_encoder: Callable[[], Callable[[list[str]], "object"]], *, id_col: str = "doc_id", text_col: str = "text", batch_size: int = 256) -> DataFrame:
    """(id, dense_embedding): what the encoder gives for each text; null texts have null.

    make_encoder is called once in each task; the encoder takes a list of texts and gives a vector for each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                texts = part.column(1).to_pylist()
                some = [t for t in texts if t is not None]
                got = iter(encode(some) if some else [])
                vectors = [None if t is None else [float(x) for x in next(got)] for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=[id_col, "dense_embedding"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, dense_embedding array<float>")


def embeddings(docs: DataFrame, make_encoder: Callable[[], Callable], *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, sparse_embedding, dense_embedding)."""
    sparse = sparse_vectors(docs, id_col=id_col, text_col=text_col, **options)
    return sparse.join(dense_vectors(docs, make_encoder, id_col=id_col, text_col=text_col), id_col)
