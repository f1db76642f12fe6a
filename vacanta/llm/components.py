"""Connected components of a link table by repeated contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vacanta.session import settle

# Fixed random masks: they change the order of the ids in every round, so chains of ascending ids shrink too.
_MASKS = [0x3C6EF372FE94F82B, 0x1B873593CC9E2D51, 0x52DCE729A54FF53A, 0x2545F4914F6CDD1D, 0x6A09E667F3BCC908, 0x0F1BBCDCBFA53E0B]


def components(links: DataFrame) -> DataFrame:
    """`(id, label)` for every id of `links(a, b)`: the smallest id it can reach.

    Each round sends every id to the neighbour that is first in a masked order and keeps the links between
    different targets, once each. A chain, a star and a dense group all shrink by a constant factor. Tables of
    links and ids are written to the shared folder, so a lost executor repeats one round at most.
    """
    live = settle(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    ids = live.select(F.col("a").alias("id")).union(live.select("b")).distinct().withColumn("root", F.col("id"))
    turn = 0
    while not live.isEmpty():
        mask = F.lit(_MASKS[turn % len(_MASKS)] >> (turn // len(_MASKS) % 8))
        both = live.union(live.select("b", "a"))
        near = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(mask)).alias("m"))
        near = near.select(F.col("a").alias("id"), F.least(F.col("m"), F.col("id").bitwiseXOR(mask)).bitwiseXOR(mask).alias("to"))
        # One jump: an id goes to the target of its target.
        target = settle(near.join(near.select(F.col("id").alias("to"), F.col("to").alias("then")), "to").select("id", F.col("then").alias("to")))
        live = settle(
            live.join(target.withColumnRenamed("id", "a").withColumnRenamed("to", "ta"), "a").join(target.withColumnRenamed("id", "b").withColumnRenamed("to", "tb"), "b")
            .select(F.col("ta").alias("a"), F.col("tb").alias("b")).where("a <> b").distinct()
        )
        ids = ids.join(target.withColumnRenamed("id", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
        turn += 1
        if turn % 4 == 0:  # the plan of the ids grows by a join a round
            ids = settle(ids)
    ids = settle(ids)
    smallest = ids.groupBy("root").agg(F.min("id").alias("label"))
    return ids.join(smallest, "root").select("id", "label")
