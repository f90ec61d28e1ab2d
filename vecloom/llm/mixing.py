"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.common import cut
from vecloom.operators.prepare import dense_ids

#: Defaults, which SQL below shares.
SHARD_TOKENS, BLOCK_TOKENS, BUDGET_PERCENT, SEED = 1 << 22, 1024, 60, 17
#: Values of the quotient that are counted at once, and how many sources may be left to rank in full.
_GRID, _CLOSE = 256, 10_000
#: Cutoffs that may be broadcast, a row of about 60 bytes each.
_MOST_CUTOFFS = 1 << 20


def _identity(id_col: str, source_col: str, text_col: str, seed: int) -> dict[str, Column]:
    """The source, and a seeded hash of the id and the text, which orders documents."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return {
        "source": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
        "h": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text))),
    }


def _shard(shards: int) -> Column:
    return F.conv(F.substring("h", 17, 8), 16, 10).cast("bigint") % F.lit(shards)


def apportion(sources: DataFrame, budget: int) -> DataFrame:
    """(source, quota) of sources (source, w, blocks): the budget's blocks by highest quotients w / (2 * j + 1).

    Equal quotients go to the source first by name. A source gets at most its blocks; those without a positive weight get
    none. Quotients of which some budget are larger are found by counting them on a grid that narrows; only those of the
    last interval are listed and ranked.
    """
    live = cut(sources.where("w > 0 and blocks > 0").select("source", F.col("w").cast("double").alias("w"), F.col("blocks").cast("bigint").alias("blocks")))
    total, top, low, most = live.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.max("w"), F.min("w"), F.max("blocks")).first()
    if budget <= 0 or not total:
        return live.select("source", "blocks").limit(0).withColumnRenamed("blocks", "quota")
    if budget >= total:
        return live.select("source", F.col("blocks").alias("quota"))
    lo, hi, above, below = low / (2 * most + 1), 2 * top, total, 0  # above blocks have a quotient of lo or more, below one of hi
    larger = lambda limit: F.least("blocks", F.greatest(F.lit(0), F.floor((F.col("w") / limit + 1) / 2).cast("bigint")))
    while above - below > _CLOSE and hi / lo > 1 + 1e-9:
        grid = [lo * (hi / lo) ** (k / _GRID) for k in range(1, _GRID)]
        at = live.select("w", "blocks", F.posexplode(F.array(*map(F.lit, grid))).alias("k", "limit"))
        counts = dict(at.groupBy("k").agg(F.sum(larger(F.col("limit")))).collect())
        for k, limit in enumerate(grid):
            if counts[k] > budget:
                lo, above = limit, counts[k]
            else:
                hi, below = limit, counts[k]
                break
    # The interval is widened, for a quotient and its count are rounded; what lies above it is taken anyway.
    ends = live.select("source", "w", "blocks", larger(F.lit(hi * (1 + 1e-9))).alias("sure"), F.least("blocks", larger(F.lit(lo * (1 - 1e-9))) + 1).alias("top"))
    left = budget - ends.agg(F.sum("sure")).first()[0]
    open_ = ends.where("top > sure").select("source", "w", F.explode(F.sequence("sure", F.col("top") - 1)).alias("j"))
    ranked = dense_ids(open_.select("source", "j", (F.col("w") / (2 * F.col("j") + 1)).alias("q")), [F.desc("q"), F.col("source"), F.col("j")], name="rank")
    more = ranked.where(F.col("rank") < left).groupBy("source").agg(F.count(F.lit(1)).alias("more"))
    return ends.join(more, "source", "left").select("source", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("quota")).where("quota > 0")


def _plan(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights, budget_percent: int, block_tokens: int, shard_tokens: int, seed: int) -> tuple[DataFrame, int]:
    """(id, source, h, n, m, shard, block, quota) of documents in the chosen blocks; the number of shards."""
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^ \t\n\r]+")).cast("bigint"), F.lit(0)).alias("n"), *(c.alias(k) for k, c in _identity(id_col, source_col, text_col, seed).items()))
    # Rows of the same id, source and text are one document with m copies; h tells documents apart.
    own = cut(own.groupBy("source", "h", "n", "id").agg(F.count(F.lit(1)).alias("m")))
    total = own.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    placed = own.withColumn("shard", _shard(shards))
    cells = placed.groupBy("shard", "source").agg(F.sum(F.col("n") * F.col("m")).alias("t"))
    cells = cut(cells.select("shard", "source", "t", F.greatest(F.lit(1), F.ceil(F.col("t") / F.lit(block_tokens))).cast("bigint").alias("blocks")))
    sources = cells.groupBy("source").agg(F.sum("t").alias("t"), F.sum("blocks").alias("blocks"))
    if weights is None:
        weighed = sources.select("source", F.sqrt(F.col("t").cast("double")).alias("w"), "blocks")
    else:
        given = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items() if w > 0], "source string, w double")
        weighed = sources.join(given, "source").select("source", "w", "blocks")
    budget = (cells.agg(F.sum("blocks")).first()[0] or 0) * budget_percent // 100
    quotas = apportion(weighed, budget).join(sources.select("source", F.col("blocks").alias("all")), "source")
    # A source's quota is spread over its shards in proportion to their blocks; what is rounded off is carried on.
    upto = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    spread = cells.join(quotas, "source").withColumn("upto", F.sum("blocks").over(upto))
    part = lambda x: F.expr(f"cast(cast(quota as decimal(18, 0)) * cast({x} as decimal(18, 0)) div cast(all as decimal(18, 0)) as bigint)")
    cell_quotas = cut(spread.select("shard", "source", "blocks", (part("upto") - part("(upto - blocks)")).alias("quota")).where("quota > 0"))
    order = Window.partitionBy("shard", "source").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("m")).over(order), F.lit(0)))
    # A document without tokens behind the last full block starts no block of its own.
    block = F.least(F.floor(F.col("before") / F.lit(block_tokens)).cast("bigint"), F.col("blocks") - 1)
    return placed.join(cell_quotas, ["shard", "source"]).withColumn("block", block).where("block < quota"), shards


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: dict[str, float] | None = None,
    budget_percent: int = BUDGET_PERCENT,
    block_tokens: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    seed: int = SEED,
) -> DataFrame:
    """The chosen rows: (id, source, shard, block, n_tokens, quota).

    Documents go to shards of about shard_tokens tokens by a seeded hash of their id and text. In each shard a source's
    documents lie in a seeded order, cut into blocks each block_tokens tokens; a document belongs to the block in which it
    starts. budget_percent of all blocks are given to sources one by one, each to the source with the largest quotient
    weight / (2 * blocks so far + 1) that has a block left; equal quotients go to the source first by name. A source's blocks
    are spread over its shards in proportion to what it has there, remainders carried from shard to shard; a shard's quota
    are its first blocks in the seeded order, so that a source's tokens in a shard are off by one document at most.

    weights are the targets by source; sources without a positive weight get nothing. Without weights, each source weighs
    the square root of its tokens in the whole table. A token is a run of characters other than space, tab and line
    ends. Null and empty sources are one source, named ''. Null and empty texts have no tokens and go with the block in
    which they lie. Rows with the same id, source and text are one document, of all their tokens, and stay or go together;
    rows that share only the id, or a null id, are each for themselves. An empty table gives an empty result. Other columns
    are not looked at.
    """
    chosen, _ = _plan(docs, id_col, source_col, text_col, weights, budget_percent, block_tokens, shard_tokens, seed)
    each = chosen.select("id", "source", "shard", "block", "n", "quota", F.explode(F.sequence(F.lit(1).cast("bigint"), "m")))
    return each.select(F.col("id").alias(id_col), "source", "shard", "block", F.col("n").alias("n_tokens"), "quota")


def chosen(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: dict[str, float] | None = None,
    budget_percent: int = BUDGET_PERCENT,
    block_tokens: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    seed: int = SEED,
) -> DataFrame:
    """The rows of docs, with all columns, that mix() chooses.

    Those of a source and shard are its first ones in the seeded order. So one cutoff tells them, which each row is held
    against for itself; the cutoffs are broadcast unless there are too many, and the texts then don't move.
    """
    found, shards = _plan(docs, id_col, source_col, text_col, weights, budget_percent, block_tokens, shard_tokens, seed)
    cutoffs = cut(found.groupBy("shard", "source").agg(F.max("h").alias("last")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(k) for k, c in _identity(id_col, source_col, text_col, seed).items())).withColumn("shard", _shard(shards))
    if cutoffs.count() <= _MOST_CUTOFFS:
        cutoffs = F.broadcast(cutoffs)
    return rows.join(cutoffs, ["shard", "source"]).where("h <= last").select("row.*")


SQL = rf"""
WITH own AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0)::BIGINT AS n,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents
), placed AS (
  SELECT source, h, n, doc_id, count(*) AS m, ('0x' || substr(h, 17, 8))::BIGINT % (SELECT greatest(1, (sum(n) + {SHARD_TOKENS - 1}) // {SHARD_TOKENS})::BIGINT FROM own) AS shard
  FROM own GROUP BY source, h, n, doc_id
), ordered AS (
  SELECT *, coalesce(sum(n * m) OVER (PARTITION BY shard, source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM placed
), cells AS (
  SELECT shard, source, sum(n * m) AS t, greatest(1, (sum(n * m) + {BLOCK_TOKENS - 1}) // {BLOCK_TOKENS})::BIGINT AS blocks FROM placed GROUP BY shard, source
), sources AS (
  SELECT source, sqrt(sum(t)::DOUBLE) AS w, sum(blocks)::BIGINT AS total FROM cells GROUP BY source
), ranked AS (
  SELECT source, row_number() OVER (ORDER BY w / (2 * j + 1) DESC, source, j) AS rank FROM (SELECT source, w, unnest(range(total)) AS j FROM sources WHERE w > 0)
), given AS (
  SELECT source, count(*)::HUGEINT AS quota FROM ranked WHERE rank <= (SELECT sum(blocks) * {BUDGET_PERCENT} // 100 FROM cells) GROUP BY source
), spread AS (
  SELECT c.*, g.quota AS given, s.total, sum(c.blocks) OVER (PARTITION BY source ORDER BY shard) AS upto FROM cells c JOIN given g USING (source) JOIN sources s USING (source)
), quotas AS (
  SELECT shard, source, blocks, (given * upto // total - given * (upto - blocks) // total)::BIGINT AS quota FROM spread
)
SELECT doc_id, source, shard::BIGINT AS shard, least(before // {BLOCK_TOKENS}, blocks - 1)::BIGINT AS block, n AS n_tokens, quota
FROM ordered JOIN quotas USING (shard, source) CROSS JOIN unnest(range(m)) AS copies(k)
WHERE least(before // {BLOCK_TOKENS}, blocks - 1) < quota
"""
