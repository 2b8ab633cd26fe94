"""Operator 5: mixing sources to target weights by temperature.

A source with n tokens gets the weight ``n ** alpha``, normalised.  ``alpha`` = 1 keeps the corpus' shares, smaller
values raise small sources.  It is bisected on [0, 1] to the smallest value at which the entropy of the
weights is at most ``target_entropy`` (nats; null: no bound) and no source is repeated more than
``max_repeat`` times.  The largest source is used once, so source s is used (n_max / n_s) ** (1 - alpha) >= 1
times: whole epochs, and a last one that ends when the token budget is met.  No document is dropped.

The weights are realised as budgeted block permutations: in every epoch a source's documents stand in
an order of their own (a seeded hash), a document's place in its source's budget, as a share, is its place in
the whole run, the run is cut into blocks of about ``block_tokens`` tokens (each then holds every
source's share), and the documents of a block are permuted by another hash.

Prefix sums of tokens go in two steps, over hash ranges of about ``RANGE_ROWS`` documents and inside
each range, so a source with a third of all rows is many ranges.  A document counts its words (at
least 1, so that empty texts advance too).

Defined cases: null text = empty text; null source is a source of its own; null doc_id is kept; repeated
rows take part each; a text longer than a block is one document of one block; one source or an empty table:
alpha = 1 or no rows; other columns pass through
``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as C

MAX_REPEAT = 2.0
BLOCK_TOKENS = 1 << 20
RANGE_ROWS = 2000
SEED = 5


def token_count(text: Column) -> Column:
    """Words of a text, at least 1."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")), F.lit(1)).cast("long")


def fit_exponent(sources: DataFrame, max_repeat: float, target_entropy: float | None, levels: int = 30) -> float:
    """The smallest exponent in [0, 1] that meets both bounds (1 if only it, or none, does).

    ``sources`` has one row per source (``tokens``) and stays distributed: one aggregate evaluates the 63
    points of six levels of bisection at once."""
    top, least = sources.agg(F.max("tokens"), F.min("tokens")).first()
    if not top:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(-(-levels // 6)):
        points = [low + (high - low) * i / 64 for i in range(64)]
        rel = F.col("tokens") / F.lit(float(top))
        grid = sources.select(rel.alias("r"), F.explode(F.array(*[F.lit(p) for p in points])).alias("a"))
        w = F.pow("r", "a")
        rows = grid.groupBy("a").agg(F.sum(w).alias("z"), F.sum(w * F.log("r")).alias("l")).select(
            "a", (F.log("z") - F.col("a") * F.col("l") / F.col("z")).alias("h")).collect()
        entropy = {r["a"]: r["h"] for r in rows}
        ok = [p for p in points if (top / least) ** (1 - p) <= max_repeat * (1 + 1e-12)
              and (target_entropy is None or entropy[p] <= target_entropy + 1e-12)]
        if ok and ok[0] == low:
            return low
        step = (high - low) / 64
        high = ok[0] if ok else high
        low = high - step
    return high


def plan(docs: DataFrame, row_id: str, max_repeat: float = MAX_REPEAT, target_entropy: float | None = None,
         block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """``row_id, doc_id, source, n_tokens, epoch, block, position`` of every use of a document."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = C.materialise(docs.select(F.col(row_id).alias("row_id"), "doc_id", F.coalesce(source, F.lit("")).alias("source"),
                                     token_count(F.col("text")).alias("n_tokens")), "mix-rows")
    sources = C.materialise(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows")), "mix-sources")
    alpha = fit_exponent(sources, max_repeat, target_entropy)
    top = sources.agg(F.max("tokens")).first()[0] or 1
    used = sources.withColumn("repeat", F.pow(F.lit(float(top)) / F.col("tokens"), F.lit(1 - alpha)))
    used = used.withColumn("budget", F.col("tokens") * F.col("repeat")).withColumn(
        "ranges", F.greatest(F.lit(1), F.ceil(F.col("n_rows") / RANGE_ROWS)).cast("long"))
    blocks = max(1, round((used.agg(F.sum("budget")).first()[0] or 0) / block_tokens))
    # Whole epochs and a last part; an epoch of almost no budget is not begun.
    epochs = F.ceil(F.col("repeat") - 1e-9).cast("int")
    uses = rows.join(used, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    h = F.xxhash64(F.lit(seed), "epoch", "doc_id", "row_id")
    uses = uses.withColumn("h", h).withColumn("range", F.expr("pmod(shiftrightunsigned(h, 1), ranges)"))
    key = ["source", "epoch", "range"]
    sums = uses.groupBy(*key).agg(F.sum("n_tokens").alias("t"))
    earlier = Window.partitionBy("source", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("head"))
    inside = Window.partitionBy(*key).orderBy("h", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = uses.withColumn("upto", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(sums, key)
    at = F.col("epoch") * F.col("tokens") + F.col("head") + F.col("upto")
    placed = placed.withColumn("at", at / F.col("budget")).where("epoch = 0 OR at < 1")
    placed = placed.withColumn("block", F.least(F.floor(F.col("at") * blocks), F.lit(blocks - 1)).cast("long"))
    order = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "epoch", "doc_id", "row_id"), "row_id", "epoch")
    return placed.select("row_id", "doc_id", "source", "n_tokens", "epoch", "block", F.row_number().over(order).cast("long").alias("position"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents (all their columns), each once per use, in the order of the blocks."""
    columns = docs.columns
    rows, row_id = C.numbered(docs, "mix-documents")
    uses = plan(rows, row_id, **options).select(F.col("row_id").alias(row_id), F.struct("block", "position").alias(f"{row_id}_at"))
    out = rows.join(uses, row_id)
    return out.repartition(F.col(f"{row_id}_at.block")).sortWithinPartitions(f"{row_id}_at").select(*columns)
