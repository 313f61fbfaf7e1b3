"""Mixing sources to target weights with a low-discrepancy schedule.

A source's documents are shuffled by a keyed hash and laid end to end; every
BLOCK_TOKENS tokens are a block, so a long document is in many blocks and a
block may hold the end of one document and the start of the next.  Slot t of
the schedule is at the point t * golden ratio mod 1 of the cumulative weights,
which names its source, and takes that source's next block: whatever stretch
of slots is taken, each source has its share of tokens up to a few blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from onomast.llm.bloom import packed, unpacked
from onomast.llm.shared import cut, limit_batches

#: 2**32 times the golden ratio's fraction: slot t is at the point t * GOLDEN mod 2**32.
GOLDEN = 2654435769
BLOCK_TOKENS = 4096
#: Target weight of a source where none are given: its tokens to this power.
POWER = 0.5
SEED = 7
#: Slots, and about so many documents, within which ranks and places are counted.
SLOTS, PART_ROWS = 1 << 16, 200_000
#: Sources whose shares may go with a function to every task (some 50 bytes each).
MAX_SOURCES = 1_000_000


def words(text: Column) -> Column:
    """Tokens as the budget counts them: runs without blank, tab, line feed, form feed, return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def _running(df: DataFrame, key: list[str], part: Column, order: list[str], value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` before each row within ``key``, ordered by ``part`` and ``order``.

    The parts are summed first, then each is counted on its own, so one hot
    key doesn't end in one task.
    """
    df = df.withColumn("_part", part)
    totals = df.groupBy(*key, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*key, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(totals, [*key, "_part"]).withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_part", "_base")


def points(slots: np.ndarray) -> np.ndarray:
    """Where in 0 .. 2**32 slots fall; only a slot's last 32 bits matter."""
    return (slots.astype(np.uint64) & np.uint64(0xFFFFFFFF)) * np.uint64(GOLDEN) & np.uint64(0xFFFFFFFF)


def schedule(weights: list[tuple[str, float]], slots: int, spark: SparkSession) -> DataFrame:
    """(slot, source, rank): slot t goes to the source in whose part of the cumulative weights its point falls; rank counts a source's slots."""
    if len(weights) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    total = sum(w for _, w in weights)
    run, ends = 0.0, []
    for _, w in weights:
        run += w
        ends.append(int(run / total * 2**32))
    ends[-1] = 2**32
    bounds, names = np.array(ends, np.uint64), pa.array([n for n, _ in weights])

    @F.arrow_udf("string")
    def source(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            yield names.take(pa.array(np.searchsorted(bounds, points(ids.to_numpy()), side="right")))

    all_slots = spark.range(slots).select(F.col("id").alias("slot"), F.coalesce(source("id"), F.lit("")).alias("source"), F.lit(1).alias("_one"))  # never null: else joins ask for that with a second worker in the task
    return _running(all_slots, ["source"], F.floor(F.col("slot") / SLOTS), ["slot"], "_one", "rank").drop("_one")


def _placed(docs: DataFrame, block_tokens: int, seed: int, weights: dict[str, float] | None, power: float) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, digest, source, n, place, last) of each document, (source, block, slot, epoch) of each slot, and the number of slots; without texts."""
    spark = docs.sparkSession
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    small = cut(docs.select("doc_id", F.xxhash64("text").alias("digest"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), words(F.col("text")).alias("n"), F.md5(F.concat(F.lit(f"{seed}:"), ident)).alias("key")))
    sizes = small.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("rows")).orderBy("source").collect()  # a row for each source
    use = [(r["source"], float(r["tokens"]) ** power if weights is None else float(weights.get(r["source"], 0.0)), max(1, -(-r["tokens"] // block_tokens))) for r in sizes]
    use = [x for x in use if x[1] > 0]
    total = sum(b for _, _, b in use)
    blocks = spark.createDataFrame(pa.table({"source": pa.array([s for s, _, _ in use], pa.string()), "blocks": pa.array([b for _, _, b in use], pa.int64())}))  # rows of Python would be read by workers of their own
    digits = 2
    while sizes and max(r["rows"] for r in sizes) > PART_ROWS * 16**digits:
        digits += 1
    placed = _running(small, ["source"], F.substring("key", 1, digits), ["key", "digest"], "n", "place").join(blocks, "source")
    placed = placed.withColumn("last", F.col("blocks") - 1)
    slots = schedule([(s, w) for s, w, _ in use], total, spark).join(blocks, "source") if use else spark.range(0).select(F.lit("").alias("source"), F.col("id").alias("slot"), F.col("id").alias("rank"), F.lit(1).cast("long").alias("blocks"))
    return placed, slots.select("source", "slot", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("epoch")), total


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_tokens: int = BLOCK_TOKENS, power: float = POWER, seed: int = SEED) -> DataFrame:
    """(doc_id, source, slot, epoch, block, place, first, n_tokens): the mixture of ``docs`` (doc_id, text, source), in as many slots as it has blocks.

    A row is the stretch of a document's tokens that is in a slot's block:
    ``n_tokens`` of them from the document's ``first`` on.  Every block has
    ``block_tokens`` tokens but the last of a source.  A source with more
    slots than blocks starts again (``epoch``), one with fewer leaves some
    out.  Ordering by slot, place, doc_id, first is the training order;
    ``place`` counts the tokens before the document in its source.

    A null source is a source of its own, named "".  A null or empty text has
    no tokens and goes with the block that it falls in.  Repeated rows are
    placed one by one.  Sources whose weight is 0 or that aren't in
    ``weights`` are left out; so is one without any token where weights follow
    sizes.  An empty table gives an empty result.  Other columns aren't read.
    """
    placed, slots, _ = _placed(docs, block_tokens, seed, weights, power)
    begin, end = F.col("place"), F.col("place") + F.col("n")
    at = F.least(F.floor(begin / block_tokens), F.col("last"))
    each = placed.withColumn("block", F.explode(F.sequence(at, F.greatest(at, F.floor((end - 1) / block_tokens)))))
    low = F.greatest(begin, F.col("block") * block_tokens)
    each = each.select("doc_id", "source", "block", "place", (low - begin).alias("first"), F.greatest(F.least(end, (F.col("block") + 1) * block_tokens) - low, F.lit(0)).alias("n_tokens"))
    each = each.withColumn("first", F.when(F.col("n_tokens") > 0, F.col("first")).otherwise(0))
    return each.join(slots, ["source", "block"]).select("doc_id", "source", "slot", "epoch", "block", "place", F.col("first").cast("long"), F.col("n_tokens").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents: doc_id, source, slot, epoch, block, place, first, n_tokens."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


SQL = f"""
WITH t AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) AS BIGINT) AS n, md5('{SEED}:' || CAST(doc_id AS VARCHAR)) AS key FROM documents
), p AS (
  SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM t
), s AS (
  SELECT source, greatest(1, CAST(ceil(sum(n) / {BLOCK_TOKENS}.0) AS BIGINT)) AS blocks, sqrt(CAST(sum(n) AS DOUBLE)) AS w FROM t GROUP BY source
), c AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY source DESC) = 1 THEN 4294967296
    ELSE CAST(floor(sum(w) OVER (ORDER BY source) / sum(w) OVER () * 4294967296) AS BIGINT) END AS hi FROM s
), r AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY source), 0) AS lo FROM c),
slots AS (
  SELECT source, blocks, t.slot, row_number() OVER (PARTITION BY source ORDER BY t.slot) - 1 AS rank
  FROM (SELECT range AS slot FROM range((SELECT CAST(sum(blocks) AS BIGINT) FROM s))) t JOIN r ON (t.slot * {GOLDEN}) % 4294967296 >= lo AND (t.slot * {GOLDEN}) % 4294967296 < hi
), q AS (SELECT p.*, blocks, least(place // {BLOCK_TOKENS}, blocks - 1) AS b0 FROM p JOIN s USING (source)),
e AS (SELECT *, unnest(range(b0, greatest(b0, (place + n - 1) // {BLOCK_TOKENS}) + 1)) AS block FROM q)
SELECT doc_id, e.source, slot, CAST(rank // e.blocks AS BIGINT) AS epoch, CAST(block AS BIGINT) AS block, place, CAST(CASE WHEN n = 0 THEN 0 ELSE greatest(place, block * {BLOCK_TOKENS}) - place END AS BIGINT) AS first,
  CAST(CASE WHEN n = 0 THEN 0 ELSE least(place + n, (block + 1) * {BLOCK_TOKENS}) - greatest(place, block * {BLOCK_TOKENS}) END AS BIGINT) AS n_tokens
FROM e JOIN slots ON e.source = slots.source AND block = rank % e.blocks
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixture's documents in its order, whole, each in every slot of the block in which it starts.

    Files and the rows in them are in the order of slots, so the next stage
    encodes the training order.  A document is found again by its id and
    digest and, where rows repeat, by its turn among them.  Texts are
    compressed while they are shuffled.
    """
    placed, slots, total = _placed(docs, BLOCK_TOKENS, SEED, None, POWER)
    names = ["_mix_id", "_mix_null", "_mix_digest", "_mix_turn"]
    keys = lambda digest: [F.coalesce("doc_id", F.lit(0)).alias("_mix_id"), F.col("doc_id").isNull().alias("_mix_null"), digest.alias("_mix_digest")]
    turn = F.row_number().over(Window.partitionBy(*names[:3]).orderBy(F.lit(1)))
    at = placed.select(*keys(F.col("digest")), F.col("source").alias("source"), F.least(F.floor(F.col("place") / BLOCK_TOKENS), F.col("last")).alias("block"), F.col("place").alias("_mix_place"))
    at = at.withColumn("_mix_turn", turn).join(slots, ["source", "block"]).select(*names, F.col("slot").alias("_mix_slot"), "_mix_place")
    limit_batches(spark)
    rest = F.struct(F.lit(0).alias("_mix_none"), *[c for c in docs.columns if c != "text"]).alias("_mix_row")
    whole = docs.select(*keys(F.xxhash64("text")), rest, packed(F.col("text")).alias("_mix_text")).withColumn("_mix_turn", turn)
    parts = max(1, min(total // 64 + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = whole.join(at, names).withColumn("_mix_part", F.expr(f"cast(_mix_slot * {parts} div {max(1, total)} as int)"))
    return found.repartitionById(parts, F.col("_mix_part")).sortWithinPartitions("_mix_slot", "_mix_place", "_mix_id").select(*[unpacked(F.col("_mix_text")).alias("text") if c == "text" else F.col("_mix_row")[c].alias(c) for c in docs.columns])
