"""Mixing sources to temperature weights, DataFrame functions only.

Source token shares are raised to an exponent and normalised. The exponent is bisected so that the weights meet a least
entropy or a largest number of repetitions. The weights are realised as a stream of blocks with one token budget: every
source goes through seeded permutations of its rows, epoch by epoch, and fills its part of each block; the rows of a
block are permuted among themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prefix_sums, read_table, written

#: Halvings of the exponent's range that one pass over the source table evaluates, and passes.
HALVINGS, PASSES = 5, 6
#: A source's permutation is cut into ranges of the hash, so no task needs a whole source.
HASH_BITS = 36


@dataclass(frozen=True)
class Target:
    """Either a least entropy of the weights as a part of its largest value (log of the sources), or most repetitions."""

    entropy: float | None = None
    repetitions: float | None = None


def source_table(docs: DataFrame, source: str = "source", tokens: str = "n_tokens") -> DataFrame:
    """Per source: rows, tokens and share. A hot source is summed where it lies before anything is sent."""
    sums = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_rows"), F.sum(tokens).alias("tokens"))
    total = sums.agg(F.sum("tokens")).first()[0]
    return sums.select("source", "n_rows", "tokens", (F.col("tokens") / F.lit(total)).alias("share"))


def weighted(sources: DataFrame, exponents: list[float]) -> DataFrame:
    """Per exponent: entropy of the weights, its largest value, and the repetitions of the most repeated source if every source is gone through once at least."""
    w = sources.withColumn("a", F.explode(F.array(*map(F.lit, exponents)))).withColumn("w", F.pow("share", "a"))
    rep = F.pow("share", F.col("a") - 1)
    return w.groupBy("a").agg(
        (F.log(F.sum("w")) - F.sum(F.col("w") * F.log("w")) / F.sum("w")).alias("entropy"),
        F.log(F.count("*")).alias("most"),
        (F.max(rep) / F.min(rep)).alias("repetitions"),
    )


def exponent(sources: DataFrame, target: Target) -> float:
    """The largest exponent in [0, 1] that meets the entropy, or the least that meets the repetition limit.

    Entropy and repetitions fall as the exponent grows. A target that the ends of the range already meet or can't
    meet gives that end.
    """
    low, high = 0.0, 1.0
    meets_below = target.entropy is not None

    def good(r) -> bool:
        return r["entropy"] >= target.entropy * r["most"] if meets_below else r["repetitions"] <= target.repetitions

    n = 1 << HALVINGS
    for p in range(PASSES):
        grid = [low + (high - low) * i / n for i in range(n + 1)]
        rows = {r["a"]: good(r) for r in weighted(sources, grid).collect()}
        if not rows:
            return 1.0
        if p == 0 and (rows[1.0] if meets_below else rows[0.0]):
            return 1.0 if meets_below else 0.0
        if p == 0 and not (rows[0.0] if meets_below else rows[1.0]):
            return 0.0 if meets_below else 1.0
        a, b = 0, n
        while b - a > 1:  # bisection
            mid = (a + b) // 2
            if rows[grid[mid]] == meets_below:
                a = mid
            else:
                b = mid
        low, high = grid[a], grid[b]
    return low if meets_below else high


def mixture(docs: DataFrame, target: Target, block_tokens: int = 1 << 20, seed: int = 17, budget: int | None = None, id_col: str = "doc_id", source: str = "source", tokens: str = "n_tokens") -> DataFrame:
    """The stream as rows (doc_id, source, n_tokens, epoch, block, position, weight).

    A source's quota is its weight times the budget; without one, the budget is the least at which every row of every
    source comes once at least. Each source repeats its rows in whole epochs, and in a last part of one while the tokens
    before a row are under the quota. A null source is a source of its own; rows count one token at least; an empty table
    gives no rows. Equal and repeated rows have places of their own. `position` numbers the rows of a block.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.greatest(F.coalesce(F.col(tokens), F.lit(1)), F.lit(1)).cast("long").alias("n_tokens"))
    rows = written(rows, "mix-rows")
    sources = written(source_table(rows), "mix-sources")
    a = exponent(sources, target)
    norm = sources.agg(F.sum(F.pow("share", F.lit(a))).alias("z"), F.max(F.pow("share", F.lit(1 - a))).alias("top"), F.sum("tokens").alias("total")).first()
    plan = sources.withColumn("weight", F.pow("share", F.lit(a)) / F.lit(norm["z"]))
    # budget / share^(1-a) is constant over sources at the most needy one
    whole = F.lit(float(budget) if budget is not None else (norm["top"] or 0.0) * (norm["z"] or 0.0) * (norm["total"] or 0))
    plan = plan.select(
        F.col("source").alias("s"), "weight", F.col("tokens").alias("s_tokens"), F.ceil(F.col("weight") * whole * (1 - 1e-12)).alias("quota"),
        F.greatest(F.ceil(whole / block_tokens), F.lit(1)).alias("blocks"))
    copies = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    copies = copies.withColumn("epoch", F.explode(F.expr("sequence(0L, cast(ceil(quota / s_tokens) AS bigint) - 1)")))
    copies = copies.withColumn("hash", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "epoch", "doc_id"), 64 - HASH_BITS))
    # three levels of ranges of the hash: a window of the upper two holds 2^(HASH_BITS / 3) rows at most
    placed = prefix_sums(copies, "hash", "n_tokens", "before", within=("source", "epoch"), tie=F.struct("doc_id", "n_tokens"), bits=HASH_BITS // 3)
    placed = placed.withColumn("at", F.col("epoch") * F.col("s_tokens") + F.col("before")).where(F.col("at") < F.col("quota"))
    # every source, however small, is spread over all blocks
    placed = placed.withColumn("block", F.least(F.floor(F.col("at") * F.col("blocks") / F.col("quota")), F.col("blocks") - 1))
    in_block = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "epoch", "doc_id", "source"), "doc_id", "epoch", "at", "source")
    return placed.select("doc_id", "source", "n_tokens", "epoch", "block", (F.row_number().over(in_block) - 1).cast("long").alias("position"), "weight")


#: Pieces of a text before any merge, as byte-level tokenizers cut them: contractions, words, numbers, marks and blanks.
PIECES = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"


def n_pieces(text: str) -> Column:
    """Tokens of a text as far as DataFrame functions can count them: its pieces before merges. Null: none.

    A caller who has counts of a tokenizer passes them to `mixture` instead.
    """
    return F.coalesce(F.regexp_count(F.col(text), F.lit(PIECES)), F.lit(0)).cast("long")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", n_pieces("text").alias("n_tokens"))
    return mixture(docs, Target(repetitions=2.0))
