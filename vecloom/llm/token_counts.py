"""Token counts: lengths only, from batches of even size in bytes."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vecloom.llm.bpe import DEFAULT_VOCABULARY, vocabulary
from vecloom.llm.common import map_arrow, slices


def balanced(sizes: list[int], most: int) -> list[list[int]]:
    """Places of the items, in batches of at most `most` bytes each; an item that is larger has a batch for itself.

    The largest item goes first into the batch that has the most room, so that batches are alike; where that breaks the
    bound there is one batch more.
    """
    large = [[k] for k, x in enumerate(sizes) if x > most]
    order = sorted((k for k, x in enumerate(sizes) if x <= most), key=lambda k: (-sizes[k], k))
    bins = max(1, -(-sum(sizes[k] for k in order) // most))
    while True:
        room = [(0, j) for j in range(bins)]
        out: list[list[int]] = [[] for _ in range(bins)]
        for k in order:
            load, j = heapq.heappop(room)
            out[j].append(k)
            heapq.heappush(room, (load + sizes[k], j))
        if max(room)[0] <= most:
            return large + [b for b in out if b]
        bins += 1


def count(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_VOCABULARY, batch_bytes: int = 1 << 18, piece_bytes: int = 1 << 14) -> DataFrame:
    """One row (id, n_tokens, n_bytes) for each row of docs, of the whole text; other columns are dropped.

    Texts above piece_bytes are split where that changes no token: at byte pairs that are inside no token of the
    vocabulary. Only a stretch without such a place, as of one letter repeated, stays whole. Batches hold at most batch_bytes,
    but for larger pieces. A null text has null counts, an empty one zeros. Repeated rows give repeated
    results; an empty table gives an empty result.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, n_bytes bigint"

    def start():
        bpe = vocabulary(path)

        def step(batch):
            for part in slices(batch, 1, 4 << 20):
                texts = part.column(1).to_pylist()
                pieces, owner = [], []
                for k, t in enumerate(texts):
                    if t:
                        own = bpe.pieces(t, piece_bytes)
                        pieces += own
                        owner += [k] * len(own)
                data = [p.decode("utf-8") for p in pieces]
                n = np.zeros(len(texts), np.int64)
                for group in balanced([*map(len, pieces)], batch_bytes):
                    lengths = [*map(len, bpe.encoding.encode_ordinary_batch([data[k] for k in group], num_threads=1))]
                    np.add.at(n, [owner[k] for k in group], lengths)
                size = np.zeros(len(texts), np.int64)
                np.add.at(size, owner, [*map(len, pieces)])
                null = np.array([t is None for t in texts])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, mask=null), pa.array(size, mask=null)], names=[id_col, "n_tokens", "n_bytes"])

        return step

    return map_arrow(docs.select(id_col, text_col), schema, start)
