"""Streams over the events table, and the batch forms that give the same rows."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from vacanta.session import settle
from vacanta.sources import sinks
from vacanta.sources.buckets import BucketTable
from vacanta.streaming import incremental as I
from vacanta.workloads.binding import EVENTS_NOW, NOW, OFFERS, ntz, offers, table
from vacanta.workloads.demand import MERGED as _MERGED, merged_rows, state_and_batch
from vacanta.workloads.registry import query
from vacanta.workloads.runs import runs


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return I.file_stream(spark, sf, schema, "events.parquet").withColumn("ts", F.to_timestamp(F.col("ts").cast("string")))


@query("stream_repeats", "SELECT user_id, min(CAST(ts AS DATE)) IS NOT NULL AS seen FROM events GROUP BY 1")
def stream_repeats(spark, sf):
    """One row per id inside the watermark: all events land in one run here."""
    once = I.drop_repeats(event_stream(spark, sf).withColumn("offer_id", F.col("user_id")), delay="40 days").select("user_id", F.lit(True).alias("seen"))
    return I.drain(once, I.scratch(spark, "repeats"), I.scratch(spark, "repeats-ck"))


def in_runs(spark, df, parts, work):
    """Lands the parts of a table one after the other; after each landing the stream takes in what is new."""
    landing, checkpoint = I.scratch(spark, "landing"), I.scratch(spark, "landing-ck")
    for part in parts:
        df.filter(part).write.mode("append").parquet(landing)
        I.each(I.file_stream(spark, landing, df.schema, "*.parquet"), work, checkpoint)


@query("stream_upsert", _MERGED)
def stream_upsert(spark, sf):
    """Documents merged into a fresh offers table by micro-batches: the engines' first, then those that replace them.

    Between the two some offers are archived. The second batch is sent twice, which changes nothing.
    """
    root = I.scratch(spark, "offers")
    state, batch = state_and_batch(spark, sf)
    first = state.select(*[c for c in state.columns if c in batch.columns], F.get("sources", F.lit(0)).alias("source_key"), F.get("urls", F.lit(0))["url"].alias("source_url"), F.lit(0).alias("part"))
    both = first.unionByName(batch.withColumn("part", F.lit(1)), allowMissingColumns=True).withColumn("ordinal", F.lit(0))
    merge = lambda rows, n: sinks.upsert_offers(rows.drop("part"), root, ntz(NOW), "offers", n)

    def work(rows, n):
        merge(rows, n)
        if n == 0:
            sinks.archive_keys(state.filter("archived_at IS NOT NULL").select("dedup_key", "archived_at"), root)
        else:
            merge(rows, n)

    in_runs(spark, both, [F.col("part") == 0, F.col("part") == 1], work)
    return merged_rows(sinks.read_table(spark, root))


@query("archive_absent", f"""WITH {OFFERS}, l AS (SELECT offer_id FROM offers JOIN labels ON doc_id = offer_id WHERE quality = 1), b AS (SELECT DISTINCT source FROM offers JOIN labels ON doc_id = offer_id WHERE quality = 1)
    SELECT offer_id, strftime(CASE WHEN archived_at IS NULL AND source IN (SELECT source FROM b) AND offer_id NOT IN (SELECT offer_id FROM l) THEN TIMESTAMP '{NOW}' ELSE archived_at END, '%Y-%m-%d') AS archived FROM offers""")
def archive_absent(spark, sf):
    o = offers(spark, sf).withColumn("dedup_key", F.col("offer_id"))
    listed = o.join(table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("offer_id")), "offer_id", "left_semi").select("source", "dedup_key")
    return I.archive_absent(o, listed, ntz(NOW)).select("offer_id", F.date_format("archived_at", "yyyy-MM-dd").alias("archived"))


_SIGHTS = "sights AS (SELECT user_id || '-' || event_type AS offer_id, ts FROM events)"


def sights(events):
    """An offer of the reading tables: what one person does of one kind."""
    return events.select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("offer_id"), F.col("ts").cast("timestamp").alias("ts"))


@query("archive_silent", f"WITH {_SIGHTS} SELECT offer_id, max(ts) AS last_seen_at FROM sights GROUP BY 1 HAVING max(ts) < TIMESTAMP '{EVENTS_NOW}' - INTERVAL 2 DAY")
def archive_silent(spark, sf):
    return I.archive_silent(sights(table(spark, sf, "events")), ntz(EVENTS_NOW), days=2)


_SILENCES = f"""WITH {_SIGHTS}, after AS (SELECT offer_id, ts, lead(ts) OVER (PARTITION BY offer_id ORDER BY ts) AS next FROM sights)
    SELECT offer_id, ts AS last_seen_at FROM after WHERE (next IS NULL OR next - ts >= INTERVAL 2 DAY) AND ts + INTERVAL 2 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)"""


@query("silences", _SILENCES)
def silences(spark, sf):
    return I.silences(sights(table(spark, sf, "events")), days=2)


@query("stream_silence", _SILENCES)
def stream_silence(spark, sf):
    """Ids that stay silent for two days of event time, each time they do: sessions that the watermark closes."""
    return I.drain(I.silences(sights(event_stream(spark, sf)), days=2), I.scratch(spark, "silence"), I.scratch(spark, "silence-ck"))


_ABSENT = """WITH l AS (SELECT DISTINCT event_type AS source, user_id AS offer_id, CAST(ts AS DATE) AS day FROM events),
    r AS (SELECT source, day, lag(day) OVER (PARTITION BY source ORDER BY day) AS before FROM (SELECT DISTINCT source, day FROM l))
    SELECT r.source, p.offer_id, strftime(r.day, '%Y-%m-%d') AS archived FROM r JOIN l p ON p.source = r.source AND p.day = r.before
    LEFT JOIN l n ON n.source = r.source AND n.day = r.day AND n.offer_id = p.offer_id WHERE n.day IS NULL AND r.day < (SELECT max(day) FROM l)"""


def board_reads(spark, sf):
    """Full reads of boards: every kind of event is a board read once a day, its people are the offers listed."""
    listed = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("offer_id"), F.date_trunc("DAY", "ts").cast("timestamp").alias("run_at")).distinct()
    earlier = F.lag("run_at").over(Window.partitionBy("source").orderBy("run_at"))
    return listed, listed.select("source", "run_at").distinct().withColumn("previous_at", earlier)


@query("absences", _ABSENT)
def absences(spark, sf):
    """Offers that the next read of their board no longer shows, except by the last reads."""
    listed, reads = board_reads(spark, sf)
    last = listed.agg(F.max("run_at").alias("last"))
    gone = I.absences(listed, reads).join(F.broadcast(last), F.col("archived_at") < F.col("last"))
    return gone.select("source", "offer_id", F.date_format("archived_at", "yyyy-MM-dd").alias("archived"))


@query("stream_absences", _ABSENT)
def stream_absences(spark, sf):
    """The same from two streams: an outer join that gives a row out when the watermark has passed the read."""
    frames = []
    for name, df in zip(("listings", "reads"), board_reads(spark, sf)):
        folder = I.scratch(spark, name)
        df.write.parquet(folder)
        frames.append(I.file_stream(spark, folder, df.schema, "*.parquet"))
    out = I.drain(I.absences(*frames), I.scratch(spark, "absent"), I.scratch(spark, "absent-ck"))
    return out.select("source", "offer_id", F.date_format("archived_at", "yyyy-MM-dd").alias("archived"))


@query("stream_day_counts", "SELECT strftime(CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris' AS DATE), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def stream_day_counts(spark, sf):
    out = I.drain(I.day_counts(event_stream(spark, sf)), I.scratch(spark, "days"), I.scratch(spark, "days-ck"), mode="complete")
    return out.select(F.col("day").cast("string").alias("day"), "n")


_WINDOWS = "SELECT strftime(CAST(d AS DATE), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events, (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-01', INTERVAL 1 DAY)) AS d) WHERE ts >= d - INTERVAL {0} DAY AND ts < d GROUP BY ALL"


@query("stream_week_counts", _WINDOWS.format(7))
def stream_week_counts(spark, sf):
    """Seven-day windows by source, one per day, from the stream."""
    out = I.drain(I.sliding_counts(event_stream(spark, sf), 7, "event_type"), I.scratch(spark, "weeks"), I.scratch(spark, "weeks-ck"), mode="complete")
    return out.select(F.col("day").cast("string").alias("day"), "event_type", "n")


@query("month_counts", _WINDOWS.format(30))
def month_counts(spark, sf):
    return I.sliding_counts(table(spark, sf, "events"), 30, "event_type").select(F.col("day").cast("string").alias("day"), "event_type", "n")


# Runs of the events: every third day ends one.
RUN_DAYS, RUNS = 3, 10
_START = "2024-01-01"


def run_of(ts):
    return F.floor(F.datediff(ts, F.lit(_START).cast("date")) / RUN_DAYS).cast("int")


def run_ends(spark):
    end = F.timestamp_add("DAY", ((F.col("run") + 1) * RUN_DAYS).cast("int"), F.lit(_START).cast("timestamp"))
    return spark.range(RUNS + 1).select(F.col("id").cast("int").alias("run")).withColumn("run_at", end)


def event_runs(spark, sf, work):
    """The events landed run by run."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("run", run_of(F.col("ts")))
    in_runs(spark, e, [F.col("run") == n for n in range(RUNS)], work)


_RUN = f"date_diff('day', DATE '{_START}', CAST(ts AS DATE)) // {RUN_DAYS}"
_END = f"(TIMESTAMP '{_START}' + to_days(CAST({{0}} * {RUN_DAYS} AS INTEGER)))"


@query("stream_reposts", f"""WITH {_SIGHTS}, r AS (SELECT offer_id, {_RUN} AS run, max(ts) AS seen FROM sights GROUP BY ALL),
    l AS (SELECT *, lag(run) OVER o AS before, lag(seen) OVER o AS earlier FROM r WINDOW o AS (PARTITION BY offer_id ORDER BY run))
    SELECT offer_id, CAST(count(*) FILTER (run > before + 1 AND seen - {_END.format('(before + 2)')} > INTERVAL 2 DAY AND seen - earlier > INTERVAL 2 DAY) AS INTEGER) AS reposts FROM l GROUP BY offer_id""")
def stream_reposts(spark, sf):
    """Runs of three days: an offer that a run misses is archived with it, and one that comes back counts a repost."""
    root, ends = I.scratch(spark, "reposts"), settle(run_ends(spark))
    state = BucketTable(spark, root, "offer_id")

    def work(batch, n):
        seen = sights(batch).select("offer_id", F.col("ts").alias("seen_at"), F.col("ts").alias("published_at"), run_of(F.col("ts")).alias("run"))
        for _ in range(2):  # the second time, the batch is known
            state.merge(seen, lambda known, rows: I.count_reposts(rows, known, ends), "sights", n)

    event_runs(spark, sf, work)
    return state.read().select("offer_id", "reposts")


@query("stream_messages", f"""WITH RECURSIVE v AS (SELECT user_id, ts, {_RUN} AS run FROM events WHERE event_type = 'view'),
    people AS (SELECT DISTINCT user_id FROM v),
    told AS (SELECT user_id, -1 AS run, CAST(NULL AS TIMESTAMP) AS sent_at, CAST(0 AS BIGINT) AS n FROM people
      UNION ALL SELECT t.user_id, t.run + 1, CASE WHEN k.n > 0 THEN {_END.format('(t.run + 2)')} ELSE t.sent_at END, k.n FROM told t,
        LATERAL (SELECT CASE WHEN t.sent_at IS NULL OR {_END.format('(t.run + 2)')} - t.sent_at >= INTERVAL 100 HOUR THEN count(*) ELSE 0 END AS n FROM v
                 WHERE v.user_id = t.user_id AND v.run <= t.run + 1 AND v.ts > coalesce(t.sent_at, {_END.format('(t.run + 2)')} - INTERVAL 1 DAY)) k WHERE t.run < {RUNS - 1})
    SELECT user_id, strftime(sent_at, '%Y-%m-%d') AS sent, n FROM told WHERE n > 0""")
def stream_messages(spark, sf):
    """Runs of three days, a message every 100 hours at most: matches of a run in between are told by the next one."""
    out = I.scratch(spark, "messages-out")
    ends = {n: F.lit(f"{_START} 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit((n + 1) * RUN_DAYS)) for n in range(RUNS)}
    landing, checkpoint, root = I.scratch(spark, "landing"), I.scratch(spark, "messages-ck"), I.scratch(spark, "messages")
    views = table(spark, sf, "events").filter("event_type = 'view'").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    for n in range(RUNS):
        views.filter(run_of(F.col("ts")) == n).write.mode("append").parquet(landing)
        told = I.messages_stream(I.file_stream(spark, landing, views.schema, "*.parquet"), root, out, lambda batch, n=n: ends[n], checkpoint, hours=100)
    return told.select("user_id", F.date_format("sent_at", "yyyy-MM-dd").alias("sent"), "n")


@query("stream_alerts", f"""WITH r AS (SELECT event_type AS source, {_RUN} AS run, count(*) AS seen FROM events GROUP BY ALL), l AS (SELECT *, lag(seen) OVER (PARTITION BY source ORDER BY run) AS previous_seen FROM r)
    SELECT source, CAST(run AS INTEGER) AS run, seen AS offers_seen, previous_seen FROM l WHERE previous_seen > 10 AND seen < 0.95 * previous_seen""")
def stream_alerts(spark, sf):
    """Every run against the one before, whose counts the state holds."""
    landing, checkpoint, root, out = (I.scratch(spark, n) for n in ("landing", "alerts-ck", "alerts", "alerts-out"))
    e = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"))
    for n in range(RUNS):
        e.filter(run_of(F.col("ts")) == n).write.mode("append").parquet(landing)
        alerts = I.alerts_stream(I.file_stream(spark, landing, e.schema, "*.parquet"), root, out, checkpoint, share=0.95)
    return alerts.select("source", F.col("batch").alias("run"), "offers_seen", "previous_seen")


@query("drop_alerts", "WITH r AS (SELECT event_type AS source, CAST(ts AS DATE) AS day, count(*) AS seen FROM events GROUP BY ALL), d AS (SELECT a.source, a.seen AS offers_seen, b.seen AS previous_seen FROM r a JOIN r b ON a.source = b.source WHERE a.day = DATE '2024-01-30' AND b.day = DATE '2024-01-29') SELECT * FROM d WHERE previous_seen > 10 AND offers_seen < 0.95 * previous_seen")
def drop_alerts(spark, sf):
    r = runs(spark, sf).select("source", "day", "offers_seen")
    one = lambda d: r.filter(F.col("day") == F.lit(d).cast("date")).select("source", "offers_seen")
    _none, state = I.drop_alerts(one("2024-01-29"), None)
    return I.drop_alerts(one("2024-01-30"), state, share=0.95)[0].select("source", "offers_seen", "previous_seen")


@query("append_runs", "SELECT event_type AS source, count(DISTINCT CAST(ts AS DATE)) AS runs, count(*) AS seen FROM events GROUP BY 1")
def append_runs(spark, sf):
    path = I.scratch(spark, "runs")
    sinks.append_runs(runs(spark, sf).select("source", "day", "offers_seen"), path)
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("runs"), F.sum("offers_seen").alias("seen"))


@query("daily_snapshots", "SELECT event_type AS profile_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def daily_snapshots(spark, sf):
    """Daily pictures refreshed as events land in two halves that share a day; each event counts once."""
    path, root, landing, checkpoint = (I.scratch(spark, n) for n in ("snapshots", "counts", "landing", "snapshots-ck"))
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("profile_id"), F.to_date("ts").alias("day"))
    middle = F.lit("2024-01-15").cast("date")
    early = (F.col("day") < middle) | ((F.col("day") == middle) & (F.col("event_id") % 2 == 0))
    for part in (early, ~early):
        e.filter(part).write.mode("append").parquet(landing)
        I.refresh_snapshots(I.file_stream(spark, landing, e.schema, "*.parquet"), ["profile_id"], root, path, checkpoint)
    return spark.read.parquet(path).select("profile_id", F.col("day").cast("string").alias("day"), "n")
