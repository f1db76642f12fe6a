"""Session set-up, reliable lineage cuts and the size checks every broadcast goes through."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows above which a side is joined by shuffle instead of being sent to every executor.
BROADCAST_ROWS = 200_000


def get_session(app: str = "vacanta", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the cluster's own setting, a temporary one in local runs only."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    local = tempfile.mkdtemp(prefix="vacanta-checkpoint-")
    spark.sparkContext.setCheckpointDir(local)
    return local


# Tables settled since the current step of a job began; None outside such jobs.
_step: list[str] | None = None


def begin_step(spark: SparkSession) -> None:
    """Starts a step of a job: tables settled by the step before are removed.

    For jobs whose steps read what the step before has written elsewhere, in full. Elsewhere settled tables stay.
    """
    global _step
    jvm = spark._jvm
    for table in _step or []:
        path = jvm.org.apache.hadoop.fs.Path(table)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _step = []


def end_steps(spark: SparkSession) -> None:
    """The last step is over: what it settles from now on, and has settled, stays."""
    global _step
    _step = None


def settle(df: DataFrame, compression: str | None = None, keep: bool = False) -> DataFrame:
    """Compute once into a table of the shared checkpoint folder and read it back.

    The lineage ends there, so a lost executor never costs the whole plan, several readers never repeat
    the work, and the size of the table is known to the planner. In a step of a job (`begin_step`) the table goes
    when the next step begins, unless it is to `keep`.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/vacanta-{uuid.uuid4().hex}"
    if _step is not None and not keep:
        _step.append(path)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether `df` is proven to hold at most `max_rows` rows (reads at most one row more)."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """`df` with a broadcast hint when its size is proven, unchanged otherwise."""
    if fits_broadcast(df, max_rows):
        return F.broadcast(df), True
    return df, False


def skew_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", salts: int = 16) -> DataFrame:
    """Join of a large side, whose keys may be hot, with a side that is unique on `on`.

    Each key of the small side is repeated `salts` times and the rows of the large side are spread over
    those copies by a hash of the row, so one key never lands in one task.
    """
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in hashable(big)]), F.lit(salts)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def hashable(df: DataFrame) -> list[str]:
    """Columns a hash function accepts (maps and variants are not)."""
    return [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
