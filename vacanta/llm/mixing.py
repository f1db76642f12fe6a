r"""Mixing sources to target weights by temperature.

Token shares p of the sources are raised to an exponent between 0 (equal) and 1 (as they are) and normalised.
The exponent is found by bisection: the one whose weights have a wanted entropy, or the smallest under which no source is
repeated more often than a limit. Sums over sources are computed by Spark for a grid of exponents at once, so sources are
never collected. The weights become token budgets: the total is the smallest under which every document is
read at least once, or a given one. A source is read in passes, each in an order of its own (md5 of seed, pass
and doc_id); the last pass ends when its budget is used up. The stream of each source is cut evenly over the
blocks of the mixture, so every block holds the target weights, and a block is ordered by a keyed permutation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from vacanta.session import settle, skew_join

SEED = 17
# Words of one block of the mixture.
BLOCK_TOKENS = 1_000_000
# Rows whose running sum one task computes, about.
PREFIX_ROWS = 20_000
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _bisect(holds, low: float, high: float) -> float:
    """The smallest exponent between `low` and `high` at which `holds` is true, to the last bit of a double."""
    while True:
        middle = (low + high) / 2
        if middle in (low, high):
            return high
        low, high = (low, middle) if holds(middle) else (middle, high)


def exponent_for_repetition(largest: int, smallest: int, limit: float) -> float:
    """The smallest exponent under which the smallest source is repeated `limit` times at most, the largest being read once."""
    if limit < 1:
        raise ValueError("no source can be read less than once")
    repeats = lambda a: (smallest / largest) ** (a - 1)
    return 0.0 if repeats(0.0) <= limit else _bisect(lambda a: repeats(a) <= limit, 0.0, 1.0)


def exponent_for_entropy(shares: DataFrame, entropy: float, steps: int = 64) -> float:
    """The exponent whose weights have `entropy` (nats); 0 or 1 where it is out of reach. One job per `steps`-fold refinement."""
    low, high = 0.0, 1.0
    p = F.col("tokens") / F.lit(float(shares.agg(F.sum("tokens")).first()[0] or 1))
    while high - low > 1e-13:
        grid = [low + (high - low) * i / steps for i in range(steps + 1)]
        sums = shares.where("tokens > 0").agg(*[s for i, a in enumerate(grid) for s in (F.sum(F.pow(p, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{i}"))]).first()
        # Entropy falls as the exponent grows.
        below = [i for i, a in enumerate(grid) if sums[f"z{i}"] and math.log(sums[f"z{i}"]) - a * sums[f"l{i}"] / sums[f"z{i}"] <= entropy]
        if not below:
            return high
        if below[0] == 0:
            return low
        low, high = grid[below[0] - 1], grid[below[0]]
    return high


def mix(docs: DataFrame, repetition: float | None = 2.0, entropy: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """`(doc_id, source, tokens, pass, block, place)`: one row for every reading of a document of `docs(doc_id, source, text, ...)`.

    Give `repetition` or `entropy`, not both. Rows with a null source form one source with those of the empty name. Empty
    texts hold no words; a source of such texts only is read once. Repeated rows are documents of their own,
    rows that share a doc_id are ordered by their length. With no `budget`, every row is read at least once; with one, the first
    pass of a source may end before its last row. Other columns are ignored; an empty table gives an empty result.
    """
    base = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), word_count(F.col("text")).alias("tokens")))
    shares = settle(base.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    rows, total, largest, smallest = base.count(), *shares.where("tokens > 0").agg(F.sum("tokens"), F.max("tokens"), F.min("tokens")).first()
    total, largest, smallest = total or 0, largest or 1, smallest or 1
    if (repetition is None) == (entropy is None):
        raise ValueError("give a repetition limit or an entropy")
    exponent = exponent_for_repetition(largest, smallest, repetition) if entropy is None else exponent_for_entropy(shares, entropy)
    repeats = F.pow(F.col("tokens") / F.lit(float(largest)), F.lit(exponent - 1))
    wanted = F.floor(repeats * F.col("tokens") + F.lit(0.5)).cast("long")
    plan = shares.select("source", F.col("tokens").alias("held"), F.when(F.col("tokens") > 0, wanted).otherwise(F.lit(0)).alias("wanted"))
    if budget is not None:
        whole = plan.agg(F.sum("wanted")).first()[0] or 1
        plan = plan.withColumn("wanted", F.floor(F.col("wanted") * F.lit(budget / whole) + F.lit(0.5)).cast("long"))
    plan = settle(plan)
    blocks = max(1, -(-(plan.agg(F.sum("wanted")).first()[0] or 0) // block_tokens))
    digits = min(8, max(1, math.ceil(math.log(max(rows, 1) / PREFIX_ROWS + 1, 16))))

    passes = F.when(F.col("held") > 0, F.greatest(F.ceil(F.col("wanted") / F.col("held")), F.lit(1)).cast("long")).otherwise(F.lit(1).cast("long"))
    read = skew_join(base, plan, ["source"], "inner", salts=32).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    read = read.withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("pass").cast("string"), name)))
    read = settle(read.withColumn("slice", F.substring("key", 1, digits)))
    # Words before a row in its pass: those of the slices before, and of the rows before in its own slice.
    slices = read.groupBy("source", "pass", "slice").agg(F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy("source", "pass").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("source", "pass", "slice", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "pass", "slice").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = read.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(slices, ["source", "pass", "slice"])
    start = F.col("pass") * F.col("held") + F.col("base") + F.col("inside")
    taken = placed.withColumn("start", start).where((F.col("start") < F.col("wanted")) | ((F.col("tokens") == 0) & (F.col("pass") == 0)))
    block = F.least(F.floor(F.col("start") / F.greatest(F.col("wanted"), F.lit(1)) * F.lit(blocks)).cast("long"), F.lit(blocks - 1).cast("long"))
    taken = taken.withColumn("block", block)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("block"), F.col("pass").cast("string"), name))
    place = F.row_number().over(Window.partitionBy("block").orderBy("order", "pass", "doc_id", "source", "tokens"))
    return taken.withColumn("order", order).select("doc_id", "source", "tokens", "pass", "block", place.alias("place"))


def copies(mixed: DataFrame) -> DataFrame:
    """`(doc_id, copies)`: how often each document is read."""
    return mixed.groupBy("doc_id").agg((F.max("pass") + 1).alias("copies"))
