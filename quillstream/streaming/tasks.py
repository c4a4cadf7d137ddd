"""Tasks: the latest state of each, what is stuck, recent or expired; in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STUCK_S, KEEP_H, RECENT_MOST, RECENT = 600, 24, 100, 20
TASK = (
    "task_id string, status string, progress double, created_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz,"
    " last_activity timestamp_ntz, result string, error_message string, text string, filename string, options string"
)
TERMINAL = ("completed", "failed")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Stored tasks; a corrupt file is passed over, unknown fields are left out."""
    return spark.read.schema(TASK).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)


def write_tasks(tasks: DataFrame, path: str) -> None:
    tasks.write.mode("append").json(path)


def submit(spark: SparkSession, rows: DataFrame, now) -> DataFrame:
    """Pending tasks from rows with task_id, text, filename."""
    t = F.lit(now).cast("timestamp_ntz")
    return rows.select("task_id", F.lit("pending").alias("status"), F.lit(0.0).alias("progress"), t.alias("created_at"), t.alias("last_activity"), "text", "filename")


def latest(events: DataFrame) -> DataFrame:
    """events: task_id, ts, status, progress. The first terminal state wins; else the newest state."""
    end = F.col("status").isin(*TERMINAL)
    state = F.struct("status", "progress", "ts")
    both = events.groupBy("task_id").agg(
        F.min_by(F.when(end, state), F.when(end, F.struct("ts", "status"))).alias("final"), F.max_by(state, F.struct("ts", "status")).alias("newest"), F.count(F.lit(1)).alias("n_events")
    )
    return both.select("task_id", F.coalesce("final", "newest").alias("s"), "n_events").select("task_id", "s.status", "s.progress", F.col("s.ts").alias("ts"), "n_events")


def _age(c, now):
    return F.timestamp_diff("SECOND", c, F.lit(now).cast("timestamp_ntz"))


def stuck(tasks: DataFrame, now, after_s: int = STUCK_S) -> DataFrame:
    """Processing tasks without a sign of life, or with none at all, and pending ones that nobody took."""
    life = F.coalesce("last_activity", "started_at")
    late = lambda c: F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {after_s} SECONDS") > c
    running = (F.col("status") == "processing") & (life.isNull() | late(life))
    waiting = (F.col("status") == "pending") & F.coalesce(late(F.col("created_at")), F.lit(False))
    return tasks.where(running | waiting)


def sweep(tasks: DataFrame, now, after_s: int = STUCK_S) -> DataFrame:
    """All tasks, the stuck ones as failed."""
    gone = stuck(tasks, now, after_s).select("task_id", F.lit(True).alias("_gone"))
    t = F.coalesce("_gone", F.lit(False))
    return tasks.join(gone, "task_id", "left").withColumns({
        "status": F.when(t, "failed").otherwise(F.col("status")), "error_message": F.when(t, "no sign of life").otherwise(F.col("error_message")),
    }).drop("_gone")


def expired(tasks: DataFrame, now, hours: int = KEEP_H) -> DataFrame:
    return tasks.where(F.col("created_at") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS"))


def recent(tasks: DataFrame, n: int = RECENT) -> DataFrame:
    return tasks.orderBy(F.col("created_at").desc_nulls_last(), "task_id").limit(max(1, min(n, RECENT_MOST)))


def lookup(tasks: DataFrame, task_id: str) -> DataFrame:
    return tasks.where(F.col("task_id") == task_id)


def status_view(tasks: DataFrame) -> DataFrame:
    return tasks.select("task_id", "status", "progress", "created_at", "started_at", "completed_at", "error_message")


def process_stream(events: DataFrame, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, every: str | None = None):
    """Each micro-batch of submitted tasks goes through `work` and is appended to `sink`; a batch whose work
    fails is appended as failed tasks. A batch that runs again writes the same folder again."""

    def batch(df: DataFrame, n: int):
        try:
            out = work(df)
            out.write.mode("overwrite").json(f"{sink}/batch={n}")
        except Exception as e:
            df.select("task_id", F.lit("failed").alias("status"), F.lit(str(e)[:500]).alias("error_message")).write.mode("overwrite").json(f"{sink}/batch={n}")

    w = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def latest_stream(events: DataFrame) -> DataFrame:
    """Newest state of each task of a stream (output mode complete or update)."""
    return events.groupBy("task_id").agg(F.max_by(F.struct("status", "progress", "ts"), "ts").alias("s"), F.count(F.lit(1)).alias("n_events")).select("task_id", "s.status", "s.progress", F.col("s.ts").alias("ts"), "n_events")


def silent_stream(events: DataFrame, after_s: int = STUCK_S) -> DataFrame:
    """Spells of activity of each task: a gap of more than after_s ends one (session windows, event time)."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{after_s} seconds")
    return t.groupBy(F.session_window("ts", f"{after_s} seconds"), "task_id").agg(F.count(F.lit(1)).alias("n_events")).select("task_id", "session_window.start", "session_window.end", "n_events")
