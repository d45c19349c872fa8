"""Structured Streaming jobs: live progress, event counts, stalled jobs, incremental enrichment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pataspark.functions.scoring import eta_seconds, progress_pct, rate_per_second
from pataspark.schemas import CHUNK_EVENTS
from pataspark.sources.writers import write_partitions

# A job without events for this long is stalled.
STALL_SECONDS = 60


def read_chunk_events(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(CHUNK_EVENTS).option("maxFilesPerTrigger", max_files).parquet(path)


def _progress_columns() -> list[Column]:
    processed, total, seconds = F.col("processed"), F.col("total_rows"), F.col("elapsed_seconds")
    return [progress_pct(processed, total).alias("progress_pct"),
            rate_per_second(processed, seconds).alias("rows_per_second"),
            eta_seconds(processed, total, seconds).alias("eta_seconds")]


def _job_totals(completed: DataFrame) -> DataFrame:
    seconds = F.unix_timestamp(F.max("event_time")) - F.unix_timestamp(F.min("event_time"))
    totals = completed.groupBy("job_id").agg(
        F.sum("row_count").alias("processed"), F.max("total_rows").alias("total_rows"),
        F.count("*").alias("completed_chunks"), seconds.alias("elapsed_seconds"))
    return totals.select("*", *_progress_columns())


def live_progress(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Progress per job; a chunk that is reported again within the watermark counts once."""
    done = events.filter(F.col("status") == "completed").withWatermark("event_time", watermark)
    return _job_totals(done.dropDuplicatesWithinWatermark(["job_id", "chunk_index"]))


def progress_snapshot(events: DataFrame) -> DataFrame:
    """Batch twin of :func:`live_progress`: the first completion of each chunk counts."""
    done = events.filter(F.col("status") == "completed").groupBy("job_id", "chunk_index").agg(
        F.min_by(F.struct("row_count", "total_rows", "event_time"), F.struct("event_time", "row_count")).alias("e"))
    return _job_totals(done.select("job_id", "chunk_index", "e.*"))


def failed_attempts(events: DataFrame) -> DataFrame:
    return (events.filter(F.col("status") == "failed").groupBy("job_id")
            .agg(F.count("*").alias("failed_attempts")))


def events_per_bucket(events: DataFrame, bucket: str = "1 day", watermark: str | None = None) -> DataFrame:
    """Events per type and tumbling window; with a watermark also usable on a stream."""
    df = events.withWatermark("ts", watermark) if watermark else events
    return (df.groupBy(F.window("ts", bucket).alias("w"), "event_type").agg(F.count("*").alias("event_count"))
            .select(F.col("w.start").alias("bucket_start"), "event_type", "event_count"))


JOB_STATES = "job_id string, state string, processed long, total_rows long, completed_chunks int, last_event timestamp"
# Of every job of a bucket: chunks counted so far, their rows, the total, the newest event in milliseconds, where the job stands,
# and when its timer runs out.
_JOB_STATE = "jobs array<string>, chunks array<array<int>>, processed array<long>, total_rows array<long>, last_ms array<long>, states array<string>, due array<long>"
RUNNING, FINISHED, STALLED = "running", "finished", "stalled"
# Jobs are kept in so many buckets, as a call of Python and its frames cost far more than the events of a job.
JOB_BUCKETS = 4_096


def _job_state(stall_seconds: int, forget_seconds: int) -> Callable:
    def step(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        now = group.getCurrentWatermarkMs()
        jobs = {job: (set(chunks), *rest) for job, chunks, *rest in zip(*group.get)} if group.exists else {}
        rows: list[tuple] = []

        def keep(job: str, chunks: set[int], processed: int, total: int, last: int, state: str, seconds: int) -> None:
            jobs[job] = (chunks, processed, total, last, state, max(last + 1000 * seconds, now + 1))

        heard: dict[str, tuple[int, int, dict[int, tuple[int, int]]]] = {}
        if not group.hasTimedOut:
            for events in batches:
                for job, chunk, count, of, status, ms in zip(events["job_id"].tolist(), events["chunk_index"].tolist(), events["row_count"].tolist(),
                                                             events["total_rows"].tolist(), events["status"].tolist(), events["_ms"].tolist()):
                    last, total, first = heard.get(job, (0, 0, {}))
                    if status == "completed":
                        first[chunk] = min(first.get(chunk, (ms, count)), (ms, count))
                    heard[job] = max(last, ms), max(total, of), first
        for job in [j for j, (*_, due) in jobs.items() if due < now and j not in heard]:
            chunks, processed, total, last, state, _ = jobs[job]
            if state == RUNNING:
                keep(job, chunks, processed, total, last, STALLED, forget_seconds)
                rows.append((job, STALLED, processed, total, len(chunks), last))
            else:
                del jobs[job]
        for job, (last, total, first) in heard.items():
            chunks, processed, known_total, known_last, state, _ = jobs.get(job, (set(), 0, 0, 0, RUNNING, 0))
            last, total = max(last, known_last), max(total, known_total)
            if state == FINISHED:  # a late repeat of a finished job
                keep(job, set(), processed, total, last, FINISHED, stall_seconds)
                continue
            processed += sum(count for chunk, (_, count) in first.items() if chunk not in chunks)
            chunks = chunks | set(first)
            state = FINISHED if total and processed >= total else RUNNING
            keep(job, set() if state == FINISHED else chunks, processed, total, last, state, stall_seconds)
            rows.append((job, state, processed, total, len(chunks), last))
        if jobs:
            columns = list(zip(*((job, sorted(chunks), *rest) for job, (chunks, *rest) in jobs.items())))
            group.update(tuple(list(c) for c in columns))
            group.setTimeoutTimestamp(max(min(columns[-1]), now + 1))
        else:
            group.remove()
        if rows:
            found = pd.DataFrame(rows, columns=["job_id", "state", "processed", "total_rows", "completed_chunks", "last_event"])
            yield found.astype({"completed_chunks": "int32"}).assign(last_event=pd.to_datetime(found["last_event"], unit="ms"))

    return step


def job_states(events: DataFrame, stall_seconds: int = STALL_SECONDS, forget_seconds: int = 7 * 86_400, watermark: str = "10 seconds") -> DataFrame:
    """Stream of job states (update mode): a row when a job moves on, finishes, or falls silent.

    A job's first completion of each chunk counts. A finished job gives up its chunks at once and leaves the state
    when the watermark passes ``stall_seconds`` after its last event, so repeats until then are not a new job. A running job
    without events for that long is emitted as stalled; it goes on where it was if events come again within ``forget_seconds``,
    and is released after that. Events without job, chunk or time are left out; no row count is 0.
    """
    filled = events.filter("job_id IS NOT NULL AND chunk_index IS NOT NULL AND event_time IS NOT NULL")
    rows = filled.withWatermark("event_time", watermark).select(
        F.pmod(F.xxhash64("job_id"), F.lit(JOB_BUCKETS)).alias("_bucket"),
        "job_id", "chunk_index", F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("total_rows", F.lit(0)).alias("total_rows"),
        F.coalesce("status", F.lit("")).alias("status"), "event_time", F.unix_millis("event_time").alias("_ms"))
    return rows.groupBy("_bucket").applyInPandasWithState(
        _job_state(stall_seconds, forget_seconds), JOB_STATES, _JOB_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def follow_job_states(events: DataFrame, target: str, checkpoint: str, **limits: object) -> StreamingQuery:
    """Write the rows of :func:`job_states`, a partition per micro-batch, and stop when no events are left.

    A batch that is repeated after a failure replaces its own partition.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        write_partitions(batch.withColumn("batch_id", F.lit(batch_id)), target, ["batch_id"])

    return (job_states(events, **limits).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def newest_states(written: DataFrame) -> DataFrame:
    """The last row of every job among those that :func:`follow_job_states` wrote."""
    fields = [c for c in written.columns if c not in ("job_id", "batch_id")]
    return written.groupBy("job_id").agg(F.max_by(F.struct(*fields), "batch_id").alias("s")).select("job_id", "s.*")


def job_states_snapshot(events: DataFrame, asof: Column, stall_seconds: int = STALL_SECONDS) -> DataFrame:
    """Batch twin of :func:`job_states`: where every job stands at ``asof``."""
    filled = events.filter("job_id IS NOT NULL AND chunk_index IS NOT NULL AND event_time IS NOT NULL")
    done = progress_snapshot(filled).select("job_id", "processed", "completed_chunks")
    total = filled.groupBy("job_id").agg(F.coalesce(F.max("total_rows"), F.lit(0)).alias("total_rows"), F.max("event_time").alias("last_event"))
    df = total.join(done, "job_id", "left").withColumn("processed", F.coalesce("processed", F.lit(0)))
    silent = F.unix_timestamp(asof) - F.unix_timestamp("last_event") > stall_seconds
    state = (F.when((F.col("total_rows") > 0) & (F.col("processed") >= F.col("total_rows")), FINISHED)
             .when(silent, STALLED).otherwise(RUNNING))
    return df.select("job_id", state.alias("state"), "processed", "total_rows",
                     F.coalesce("completed_chunks", F.lit(0)).cast("int").alias("completed_chunks"), "last_event")


def enrich_incrementally(source: DataFrame, enrich: Callable[[DataFrame], DataFrame], target: str, checkpoint: str,
                         keys: tuple[str, ...] = ("job_id", "chunk_index")) -> StreamingQuery:
    """Process files as they land and stop when none are left.

    Each micro-batch owns the partitions (job, chunk, batch) that it writes. A batch that is repeated after a failure
    replaces its own files and nothing else, and a chunk may be spread over any number of batches.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        write_partitions(enrich(batch).withColumn("batch_id", F.lit(batch_id)), target, [*keys, "batch_id"])

    return (source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
