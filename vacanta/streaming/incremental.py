"""Incremental rules over landed snapshots. Each has a batch form that gives the same rows.

Streams read files and run with `availableNow`; state is kept by Spark's state store where a built-in
operator holds it, and in bucket tables written by `foreachBatch` where a rule needs a join with what
was known. Such a table notes the number of the last batch it took, so a batch that comes again counts once; what a
batch emits goes to a folder of its number. Batches are aggregated before they meet state, so a hot key never lands
whole in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vacanta.operators.filters import DAY
from vacanta.rules import signals as R
from vacanta.session import checkpoint_dir, settle, skew_join
from vacanta.sources.buckets import BucketTable
from vacanta.sources.sinks import read_table, upsert_offers, write_snapshots, write_version


def file_stream(spark: SparkSession, folder: str, schema, pattern: str, per_trigger: int = 1000) -> DataFrame:
    """Landed Parquet files as a stream; only files whose name fits the pattern are read."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder of the session."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything that has landed, into a Parquet table, and read it back."""
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    else:
        each(stream, lambda batch, n: write_version(batch, out), checkpoint, mode)
        return read_table(spark, out)
    return spark.read.schema(stream.schema).parquet(out)


def each(stream: DataFrame, work: Callable[[DataFrame, int], object], checkpoint: str, mode: str = "append") -> None:
    """Run `work` on every micro-batch of what has landed."""

    def call(batch: DataFrame, n: int) -> None:
        work(batch, n)

    q = stream.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def upsert_stream(batches: DataFrame, root: str, now: Column, checkpoint: str) -> None:
    """Each micro-batch merged into the offers table: longest text per key, then one join with the known rows."""
    each(batches, lambda batch, n: upsert_offers(batch, root, now, "offers", n), checkpoint)


def emit(rows: DataFrame, out: str, number: int) -> None:
    """What a micro-batch gives out: written again in place if the batch runs again."""
    rows.write.mode("overwrite").parquet(f"{out}/batch={number}")


def drop_repeats(stream: DataFrame, id: str = "offer_id", at: str = "ts", delay: str = "1 day") -> DataFrame:
    """Repeats of an offer id inside a run, dropped while the watermark holds them."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([id])


def archive_absent(offers: DataFrame, read: DataFrame, now: Column, source: str = "source", id: str = "dedup_key") -> DataFrame:
    """Active offers of the boards just read in full that are no longer listed: archived at the time of reading."""
    boards = read.select(source).distinct().withColumn("_read", F.lit(True))
    listed = read.select(source, id).distinct().withColumn("_listed", F.lit(True))
    j = offers.join(boards, source, "left").join(listed, [source, id], "left")
    gone = F.col("_read") & F.col("_listed").isNull() & F.col("archived_at").isNull()
    return j.withColumn("archived_at", F.when(gone, now).otherwise(F.col("archived_at"))).drop("_read", "_listed")


def archive_silent(seen: DataFrame, now: Column, days: int = R.ENGINE_SILENCE_DAYS, id: str = "offer_id", at: str = "ts") -> DataFrame:
    """Offers known from engines alone and not seen for `days`: id and time of the last sight."""
    last = seen.groupBy(id).agg(F.max(at).alias("last_seen_at"))
    return last.filter(F.timestamp_diff("MICROSECOND", F.col("last_seen_at"), now) > days * DAY * 1_000_000)


def silences(seen: DataFrame, days: int = R.ENGINE_SILENCE_DAYS, id: str = "offer_id", at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each time an offer falls silent for `days`: id and time of the last sight before.

    A session of sights ends `days` after its last one. On a stream it is given out when the watermark passes that
    end; on a table, when the latest sight of all, less `delay`, does. Spark keeps one short row per open session.
    """
    marked = seen.withWatermark(at, delay) if seen.isStreaming else seen
    sessions = marked.groupBy(id, F.session_window(at, f"{days} days").alias("w")).agg(F.max(at).alias("last_seen_at"))
    if not seen.isStreaming:
        end = seen.agg(F.date_trunc("MILLISECOND", F.max(at)).alias("end")).select((F.col("end") - F.expr(f"INTERVAL {delay}")).alias("end"))
        sessions = sessions.join(F.broadcast(end), F.col("w.end") <= F.col("end"))
    return sessions.select(id, "last_seen_at")


def absences(listings: DataFrame, reads: DataFrame, delay: str = "1 hour", longest: str = "60 days") -> DataFrame:
    """Offers a full read of their board no longer shows: `(source, offer_id, archived_at)`.

    `listings(source, offer_id, run_at)` are the offers each read showed, `reads(source, run_at, previous_at)` the reads
    themselves with the time of the read before (at most `longest` earlier). What the read before showed is
    expected again; what is expected and not listed is gone. The same joins serve tables and streams; on streams a
    read is decided when the watermark has passed it.
    """

    def timed(df: DataFrame, *columns: Column) -> DataFrame:
        picked = df.select(*columns)
        return picked.withWatermark(picked.columns[0], delay) if df.isStreaming else picked

    before = timed(listings, F.col("run_at").alias("p_at"), F.col("source").alias("p_source"), F.col("offer_id").alias("p_offer"))
    now = timed(listings, F.col("run_at").alias("l_at"), F.col("source").alias("l_source"), F.col("offer_id").alias("l_offer"))
    read = timed(reads, F.col("run_at").alias("r_at"), F.col("source").alias("r_source"), F.col("previous_at").alias("r_previous"))
    follows = F.expr(f"p_source = r_source AND p_at = r_previous AND r_at > p_at AND r_at <= p_at + INTERVAL {longest}")
    expected = before.join(read, follows).select("r_at", "r_source", "p_offer")
    missing = expected.join(now, F.expr("r_source = l_source AND p_offer = l_offer AND r_at = l_at"), "left_outer").filter("l_at IS NULL")
    return missing.select(F.col("r_source").alias("source"), F.col("p_offer").alias("offer_id"), F.col("r_at").alias("archived_at"))


def day_counts(stream: DataFrame, at: str = "ts", zone: str = "Europe/Paris", delay: str = "2 hours") -> DataFrame:
    """Rows per local day; a day is emitted once the watermark has passed it."""
    local = stream.withColumn("local", F.from_utc_timestamp(at, zone)).withWatermark("local", delay)
    return local.groupBy(F.window("local", "1 day")).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "n")


def sliding_counts(df: DataFrame, days: int, key: str | None = None, at: str = "ts", delay: str | None = "1 day") -> DataFrame:
    """Rows over the last `days` days, one window per day; the same for a stream and a table."""
    src = df.withWatermark(at, delay) if df.isStreaming and delay else df
    by = [F.window(at, f"{days} days", "1 day").alias("w")] + ([F.col(key)] if key else [])
    return src.groupBy(*by).agg(F.count("*").alias("n")).select(F.to_date("w.end").alias("day"), *([key] if key else []), "n")


def count_reposts(sights: DataFrame, known: DataFrame | None, runs: DataFrame, days: int = 2) -> DataFrame:
    """State per offer after one run: `(offer_id, published_at, run, reposts)`, `run` being the last one that saw it.

    `sights` holds offer_id, seen_at, published_at and run (one number); `known` the state of the same
    offers before; `runs(run, run_at)` the time each run ended. An offer that a run missed was archived when that
    run ended; back more than `days` later, with a publication date more than `days` later, is one repost.
    """
    last = sights.groupBy("offer_id").agg(F.max("seen_at").alias("seen_at"), F.max_by("published_at", F.struct("seen_at", "published_at")).alias("published_at"), F.max("run").alias("run"))
    if known is None:
        return last.select("offer_id", "published_at", "run", F.lit(0).alias("reposts"))
    k = known.select("offer_id", F.col("published_at").alias("_p"), F.col("run").alias("_r"), F.col("reposts").alias("_n"))
    missed = runs.select((F.col("run") - 1).alias("_r"), F.col("run_at").alias("_a"))
    j = last.join(k, "offer_id", "full_outer").join(missed, "_r", "left")
    span = days * DAY * 1_000_000
    away = (F.col("run") > F.col("_r") + 1) & (F.timestamp_diff("MICROSECOND", "_a", "seen_at") > span)
    again = away & (F.timestamp_diff("MICROSECOND", "_p", "published_at") > span)
    return j.select("offer_id", F.coalesce("published_at", "_p").alias("published_at"), F.coalesce("run", "_r").alias("run"), (F.coalesce("_n", F.lit(0)) + F.coalesce(again, F.lit(False)).cast("int")).alias("reposts"))


def reposts_stream(sights: DataFrame, root: str, runs: DataFrame, checkpoint: str, days: int = 2) -> BucketTable:
    """Reposts counted run by run in a bucket table below `root`; only the buckets of offers just seen are rewritten."""
    table = BucketTable(sights.sparkSession, root, "offer_id")
    each(sights, lambda batch, n: table.merge(batch, lambda known, rows: count_reposts(rows, known, runs, days), "sights", n), checkpoint)
    return table


def send_messages(matches: DataFrame, sent: DataFrame | None, now: Column, hours: int = 20) -> tuple[DataFrame, DataFrame]:
    """(messages, state): people due with what is new since their last message, and when each was last written to.

    Only matches later than the last message count, to the microsecond. `matches` holds user_id, ts; the state
    has one row per person.
    """
    before = sent if sent is not None else matches.sparkSession.createDataFrame([], "user_id bigint, sent_at timestamp")
    j = matches.select("user_id", "ts").join(before, "user_id", "left")
    due = F.col("sent_at").isNull() | (F.timestamp_diff("SECOND", "sent_at", now) >= hours * 3600)
    fresh = F.col("ts") > F.coalesce("sent_at", now - F.expr("INTERVAL 1 DAY"))
    messages = j.filter(due & fresh).groupBy("user_id").agg(F.count("*").alias("n"))
    state = messages.select("user_id", now.alias("sent_at")).unionByName(before.join(messages, "user_id", "left_anti"))
    return messages, state


_MESSAGE_STATE = "user_id bigint, sent_at timestamp, pending bigint"


def messages_stream(matches: DataFrame, root: str, out: str, now: Callable[[DataFrame], Column], checkpoint: str, hours: int = 20) -> DataFrame:
    """Messages of every run, `(user_id, n, sent_at)`: what `send_messages` gives over all matches so far.

    The state holds a person's last message and the number of matches since, so earlier matches are not read again.
    `now(batch)` is the time of the run.
    """
    table = BucketTable(matches.sparkSession, root, "user_id")

    def work(batch: DataFrame, n: int) -> None:
        if table.done("matches", n):
            return
        at = now(batch)
        known = table.read()
        known = batch.sparkSession.createDataFrame([], _MESSAGE_STATE) if known is None else known
        fresh = F.col("ts") > F.coalesce("sent_at", at - F.expr("INTERVAL 1 DAY"))
        new = skew_join(batch.select("user_id", "ts"), known.select("user_id", "sent_at"), ["user_id"], "left").filter(fresh).groupBy("user_id").agg(F.count("*").alias("new"))
        waiting = known.filter("pending > 0").select("user_id")
        rows = new.select("user_id").union(waiting).distinct().join(new, "user_id", "left").join(known, "user_id", "left")
        total = F.coalesce("pending", F.lit(0)) + F.coalesce("new", F.lit(0))
        due = F.coalesce(F.timestamp_diff("SECOND", "sent_at", at) >= hours * 3600, F.lit(True)) & (total > 0)
        told = settle(rows.select("user_id", total.alias("n"), due.alias("due"), F.when(due, at).otherwise(F.col("sent_at")).alias("sent_at")))
        emit(told.filter("due").select("user_id", "n", "sent_at"), out, n)

        def step(known: DataFrame | None, changed: DataFrame) -> DataFrame:
            after = changed.select("user_id", F.col("sent_at"), F.when(F.col("due"), F.lit(0)).otherwise(F.col("n")).cast("bigint").alias("pending"))
            return after if known is None else after.unionByName(known.join(after, "user_id", "left_anti"))

        table.merge(told, step, "matches", n)

    each(matches, work, checkpoint)
    return matches.sparkSession.read.schema("user_id bigint, n bigint, sent_at timestamp, batch int").parquet(out)


def drop_alerts(runs: DataFrame, before: DataFrame | None, least: int = 10, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(alerts, state): sources whose run fell under `share` of the one before; the state is the count of that run."""
    state = runs.select("source", F.col("offers_seen").alias("previous_seen"))
    if before is None:
        return runs.withColumn("previous_seen", F.lit(None).cast("bigint")).limit(0), state
    j = runs.join(before, "source", "left")
    alerts = j.filter((F.col("previous_seen") > least) & (F.col("offers_seen") < share * F.col("previous_seen")))
    return alerts, state.unionByName(before.join(state.select("source"), "source", "left_anti"))


def alerts_stream(sights: DataFrame, root: str, out: str, checkpoint: str, least: int = 10, share: float = 0.5) -> DataFrame:
    """Alerts of every run, `(source, offers_seen, previous_seen, batch)`: each micro-batch of `sights(source)` is one run."""
    table = BucketTable(sights.sparkSession, root, "source")

    def work(batch: DataFrame, n: int) -> None:
        if table.done("runs", n):
            return
        counts = settle(batch.groupBy("source").agg(F.count("*").alias("offers_seen")))
        emit(drop_alerts(counts, table.read(), least, share)[0].select("source", "offers_seen", "previous_seen"), out, n)
        table.merge(counts, lambda known, rows: drop_alerts(rows, known, least, share)[1], "runs", n)

    each(sights, work, checkpoint)
    return sights.sparkSession.read.schema("source string, offers_seen bigint, previous_seen bigint, batch int").parquet(out)


def refresh_snapshots(arrivals: DataFrame, by: list[str], root: str, path: str, checkpoint: str) -> None:
    """Daily pictures kept up to date: counts per `by` and day; only days that new offers fall into are written again.

    `arrivals` holds the columns of `by` and `day`. A bucket table by day adds counts up, once per micro-batch.
    """
    table = BucketTable(arrivals.sparkSession, root, "day")

    def step(known: DataFrame | None, rows: DataFrame) -> DataFrame:
        both = rows if known is None else known.select(*rows.columns).unionByName(rows)
        return both.groupBy(*by, "day").agg(F.sum("n").cast("bigint").alias("n"))

    def work(batch: DataFrame, n: int) -> None:
        counts = settle(batch.groupBy(*by, "day").agg(F.count("*").alias("n")))
        table.merge(counts, step, "arrivals", n)
        days = counts.select("day").distinct()
        if not counts.isEmpty():
            write_snapshots(table.read().join(days, "day", "left_semi"), path)

    each(arrivals, work, checkpoint)
