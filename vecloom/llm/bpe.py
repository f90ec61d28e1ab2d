"""Byte-pair encoding and decoding with forced-boundary splitting, and token counts."""

from __future__ import annotations

import base64
import importlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vecloom.llm.common import map_arrow, slices

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text into words before merges, as the vocabulary's own tokenizer does.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space beyond ASCII, which cuts must not follow.
_WIDE_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CACHED = 200_000


class _Cache(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= _CACHED:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Bpe:
    """A vocabulary, and the byte pairs at which a text can be cut without changing its tokens.

    A pair of bytes that is inside no token can't be merged over, so the tokens on both sides are the same if the text is
    cut between them. The cut must also leave the splitting into words as it is; it does if the byte before it ends a
    character that isn't white space (white space looks ahead) and the one after it begins a character other than the
    apostrophe (which begins contractions).
    """

    def __init__(self, path: str = DEFAULT_VOCABULARY, pattern: str = PATTERN):
        tiktoken = importlib.import_module("tiktoken")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        inside = np.zeros((256, 256), bool)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            t = np.frombuffer(token, np.uint8)
            inside[t[:-1], t[1:]] = True
        cuts = ~inside
        cuts[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32], :] = False
        cuts[:, 0x80:0xC0] = False
        cuts[:, ord("'")] = False
        self.cuts = cuts.ravel()
        self.ids = _Cache(lambda b: np.array(self.encoding.encode_ordinary(b.decode("utf-8")), "<i4").tobytes())
        self.texts = self.bytes_of.__getitem__

    def boundaries(self, data: bytes, text: str) -> np.ndarray:
        """Places in data at which it can be cut."""
        b = np.frombuffer(data, np.uint8)
        at = np.flatnonzero(self.cuts[b[:-1].astype(np.uint16) * np.uint16(256) + b[1:]]) + 1
        if len(at) and not text.isascii() and _WIDE_SPACE.search(text):
            wide = {len(text[: m.end()].encode("utf-8")) for m in _WIDE_SPACE.finditer(text)} if len(text) < 2000 else _ends(text)
            at = at[~np.isin(at, list(wide))]
        return at

    def encode(self, text: str) -> np.ndarray:
        data = text.encode("utf-8")
        if not data:
            return np.zeros(0, np.int32)
        at = [0, *self.boundaries(data, text).tolist(), len(data)]
        return np.frombuffer(b"".join(map(self.ids.__getitem__, map(data.__getitem__, map(slice, at[:-1], at[1:])))), "<i4")

    def decode(self, ids) -> str:
        return b"".join(map(self.texts, ids)).decode("utf-8", "replace")

    def pieces(self, text: str, most: int) -> list[bytes]:
        """text in UTF-8, cut into pieces of about most bytes at boundaries(); a stretch without one stays whole."""
        data = text.encode("utf-8")
        if len(data) <= most:
            return [data]
        places = self.boundaries(data, text)
        out, at = [], 0
        while len(data) - at > most and len(places):
            k = int(np.searchsorted(places, at + most, side="right")) - 1
            k = k if k >= 0 and places[k] > at else k + 1  # the last one within reach, else the next
            if k >= len(places):
                break
            out.append(data[at : places[k]])
            at = int(places[k])
        out.append(data[at:])
        return out


def _ends(text: str) -> np.ndarray:
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    width = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
    return np.cumsum(width)[[m.start() for m in _WIDE_SPACE.finditer(text)]]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    """One of each in a worker process."""
    return Bpe(path)


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """One row (id, tokens, n_tokens) for each row of docs: the ids of the whole text's tokens; other columns are dropped.

    The ids are those that the vocabulary's own tokenizer gives. A null text has null tokens and null n_tokens, an empty
    one no tokens. Repeated rows give repeated results; an empty table gives an empty result. path must be readable on
    every executor.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, tokens array<int>, n_tokens int"

    def start():
        bpe = vocabulary(path)

        def step(batch):
            for part in slices(batch, 1, 4 << 20):
                got = [None if t is None else bpe.encode(t) for t in part.column(1).to_pylist()]
                sizes = np.array([0 if g is None else len(g) for g in got], np.int64)
                null = np.array([g is None for g in got])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(null, False))
                flat = pa.array(np.concatenate([np.zeros(0, np.int32), *(g for g in got if g is not None)]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, flat), pa.array(sizes.astype(np.int32), mask=null)], names=[id_col, "tokens", "n_tokens"])

        return step

    return map_arrow(docs.select(id_col, text_col), schema, start)


def decode(encoded: DataFrame, *, id_col: str = "doc_id", tokens_col: str = "tokens", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """One row (id, text) for each row of encoded; null tokens give a null text, no tokens an empty one.

    Ids outside the vocabulary raise an error; bytes that aren't UTF-8 become U+FFFD.
    """
    schema = f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string"

    def start():
        bpe = vocabulary(path)

        def step(batch):
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else bpe.decode(x) for x in part.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

        return step

    return map_arrow(encoded.select(id_col, tokens_col), schema, start)


def round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """encode() with a column decoded_equal: whether the ids decode to the very text (null for a null text)."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, tokens array<int>, n_tokens int, decoded_equal boolean"

    def start():
        bpe = vocabulary(path)

        def step(batch):
            for part in slices(batch, 1, 4 << 20):
                texts = part.column(1).to_pylist()
                got = [None if t is None else bpe.encode(t) for t in texts]
                equal = [None if t is None else bpe.decode(g.tolist()) == t for t, g in zip(texts, got)]
                sizes = np.array([0 if g is None else len(g) for g in got], np.int64)
                null = np.array([g is None for g in got])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(null, False))
                flat = pa.array(np.concatenate([np.zeros(0, np.int32), *(g for g in got if g is not None)]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(offsets, flat), pa.array(sizes.astype(np.int32), mask=null), pa.array(equal, pa.bool_())],
                    names=[id_col, "tokens", "n_tokens", "decoded_equal"],
                )

        return step

    return map_arrow(docs.select(id_col, text_col), schema, start)
