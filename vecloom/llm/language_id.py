"""Language identification by nearest centroid over TF-IDF character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import drawn, map_arrow, slices, where_text

SCHEMA = "lang_pred string, similarity double, rejected boolean"
_MUL = np.uint32(2654435761)
_MIX = np.uint32(40503)
WINDOWS = range(3, 13)
_PLAIN = np.arange(128, dtype=np.uint32)
_PLAIN[[c for c in range(128) if not chr(c).isalpha()]] = 32


def ngram_counts(text: str, bits: int) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of characters of the whole text, in 2**bits buckets.

    Runs of ASCII characters that aren't letters count as one space.
    """
    a = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.where(a < 128, _PLAIN[np.minimum(a, 127)], a)
    a = a[np.r_[True, (a[1:] != 32) | (a[:-1] != 32)]]
    if len(a) < 2:
        return np.zeros(1 << bits, np.int64)
    shift = np.uint32(32 - bits)
    one = (a + np.uint32(1)) * _MUL
    two = (one[:-1] * _MIX) ^ (one[1:] >> np.uint32(3))
    three = (two[:-1] * _MIX) ^ (one[2:] >> np.uint32(5))
    size = 1 << bits
    out = np.zeros(size, np.int64)
    for h in (one, two, three):
        if len(h):
            out += np.bincount(((h * _MUL) ^ (h >> np.uint32(15))) >> shift, minlength=size)
    return out


@dataclass
class Model:
    langs: list[str]
    """The language of each centroid."""
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray
    """The smallest similarity that is accepted, by the logarithm to base 2 of the number of characters."""
    bits: int

    def classify(self, texts: list[str | None]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        best, sims = np.full(len(texts), -1), np.zeros(len(texts))
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            if not self.langs:
                break
            m = np.zeros((len(part), 1 << self.bits), np.float32)
            for k, t in enumerate(part):
                if t:
                    m[k] = ngram_counts(t, self.bits)
            s = _unit(m * self.idf) @ self.centroids.T
            best[at : at + len(part)] = s.argmax(1)
            sims[at : at + len(part)] = s.max(1)
        size = np.array([len(t).bit_length() if t and t.strip() else 0 for t in texts], dtype=int)
        rejected = (size == 0) | (sims <= 0) | (sims < self.least[np.minimum(size, len(self.least) - 1)])
        return [None if r else self.langs[b] for b, r in zip(best, rejected)], sims, rejected


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means whose first centres are the mean and then, each time, the row farthest from all centres."""
    c = _unit(x.mean(0, keepdims=True))
    while len(c) < min(k, len(x)):
        c = np.vstack([c, x[(x @ c.T).max(1).argmin()]])
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = _unit(np.vstack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))]))
    return c


def fit(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_language: int = 300,
    least_rows: int = 3,
    clusters: int = 4,
    bits: int = 12,
    accept: float = 0.5,
    seed: int = 7,
) -> Model:
    """Centroids of each language, from at most rows_per_language labelled documents of it, drawn in a seeded order.

    The sample is the documented bound of the fit (and the 256 languages with the most documents); classification covers
    all rows. Rows of the same id and text are one document. Rows without text or label don't count, nor do languages with
    fewer than least_rows documents. accept times the 1% quantile of the similarity of the
    sample (whole texts and windows of 8, 16, ... characters) to its own language is the rejection threshold of each
    length. Texts without letters are rejected. With no labelled row the model has no centroid and rejects every document.
    """
    sample = drawn(docs, F.col(lang_col).cast("string"), id_col, text_col, rows_per_language, seed)

    def start():
        def step(batch):
            out = []
            for i, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                rng = np.random.default_rng([seed, *(i or "").encode()])
                parts = [text]
                for b in WINDOWS:
                    n = (3 << b) >> 1
                    if n < len(text):
                        at = int(rng.integers(0, len(text) - n + 1))
                        parts.append(text[at : at + n])
                for k, t in enumerate(parts):
                    if t.strip():
                        c = ngram_counts(t, bits)
                        nz = np.flatnonzero(c)
                        out.append((i, lang, k == 0, len(t).bit_length(), nz.astype(np.int32), c[nz].astype(np.float32)))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.list_(pa.int32())), pa.array(cols[5], pa.list_(pa.float32()))],
                    names=["id", "lang", "whole", "size", "at", "n"],
                )

        return step

    got = map_arrow(sample, "id string, lang string, whole boolean, size int, at array<int>, n array<float>", start).toArrow().to_pylist()
    got.sort(key=lambda r: (r["lang"], not r["whole"], r["id"] or "", r["size"], r["at"], r["n"]))
    whole = [r for r in got if r["whole"]]
    kept = sorted(lang for lang in {r["lang"] for r in whole} if sum(r["lang"] == lang for r in whole) >= least_rows)
    f = 1 << bits

    def dense(rows):
        m = np.zeros((len(rows), f), np.float32)
        for k, r in enumerate(rows):
            m[k, r["at"]] = r["n"]
        return m

    df = np.zeros(f)
    for r in whole:
        df[r["at"]] += 1
    idf = (np.log((1 + len(whole)) / (1 + df)) + 1).astype(np.float32)
    langs, centroids = [], []
    sims: dict[int, list[float]] = {}
    for lang in kept:
        c = _cluster(_unit(dense([r for r in whole if r["lang"] == lang]) * idf), clusters)
        centroids.append(c)
        langs += [lang] * len(c)
        rows = [r for r in got if r["lang"] == lang]
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            for r, s in zip(part, (_unit(dense(part) * idf) @ c.T).max(1)):
                sims.setdefault(r["size"], []).append(float(s))
    least = np.zeros(34)
    for b in sorted(sims):
        if len(sims[b]) >= 20 and b > min(WINDOWS):
            least[b:] = max(least[b - 1], accept * float(np.quantile(sims[b], 0.01)))
    return Model(langs, np.vstack(centroids).astype(np.float32) if centroids else np.zeros((0, f), np.float32), idf, least, bits)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, lang_pred, similarity, rejected) for each row of docs; other columns are not looked at.

    lang_pred is the language of the centroid with the largest cosine; rows whose cosine is below the model's threshold
    for their length are rejected, with lang_pred null. Null, empty and blank texts are rejected with similarity 0.
    Repeated rows give repeated results; equal cosines go to the first centroid in order of language. A text of any
    length counts as a whole. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}"

    def start():
        m = shared.value

        def step(batch):
            for part in slices(batch, 1):
                lang, sims, rejected = m.classify(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lang, pa.string()), pa.array(np.round(sims.astype(float), 6)), pa.array(rejected)],
                    names=[id_col, "lang_pred", "similarity", "rejected"],
                )

        return step

    return map_arrow(docs.select(id_col, text_col), schema, start)


def accepted(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that identify() doesn't reject; each row is judged for itself, whatever its id."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return where_text(docs, text_col, lambda: lambda texts: ~np.asarray(shared.value.classify(texts)[2], bool))
