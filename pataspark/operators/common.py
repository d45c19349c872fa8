"""Helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from functools import reduce
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# A lookup side is only broadcast up to this many rows (about 100 bytes each).
BROADCAST_ROWS = 1_000_000
# Rows that a step which can be cut into rounds shuffles at a time, so that its disk is bounded whatever the input.
ROUND_ROWS = 8_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a lookup for broadcast only after its rows were counted.

    The count stops at ``max_rows + 1``. A larger side is returned without a hint, so the
    join becomes a shuffle join that adaptive execution can split where keys are skewed.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def join_exploded(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join by shuffle of sides that were exploded into keys.

    Spark estimates such a side from the rows before the explode, so left alone it broadcasts a side that is a
    hundred times as large as estimated, through the driver.
    """
    return left.join(right.hint("merge"), list(keys))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session: the one named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("Set spark.checkpoint.dir to a folder all executors can reach")
            folder = tempfile.mkdtemp(prefix="pataspark-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning, _cleaned, _before = Lock(), [0], [None]
# Tables written since the innermost :func:`settle` began.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("pataspark_written", default=None)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside removes its shuffle files when it ends, not when the driver happens to collect garbage."""
    with _cleaning:
        if not _cleaned[0]:
            _before[0] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _cleaned[0] += 1
    try:
        yield
    finally:
        with _cleaning:
            _cleaned[0] -= 1
            if not _cleaned[0]:
                spark.conf.unset(_CLEANUP) if _before[0] is None else spark.conf.set(_CLEANUP, _before[0])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame that several joins read to the checkpoint folder, once: as compressed columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(make: Callable[[], DataFrame | tuple[int, Callable[[int], DataFrame]]]) -> DataFrame:
    """Write the frame that ``make`` returns, then remove the tables that were written on the way to it.

    Instead of a frame it may return a number of rounds and what makes the rows of each.
    """
    before = _WRITTEN.set([])
    try:
        made, inner = make(), _WRITTEN.get()
    finally:
        _WRITTEN.reset(before)
    out = cut_lineage(made) if isinstance(made, DataFrame) else in_rounds(*made)
    sc = out.sparkSession.sparkContext
    for path in map(sc._jvm.org.apache.hadoop.fs.Path, inner):
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    return out


def in_rounds(rounds: int, step: Callable[[int], DataFrame]) -> DataFrame:
    """Rows of all rounds. Each is written before the next begins, so that the shuffles of one at a time are on disk."""
    return reduce(DataFrame.unionByName, [settle(lambda: step(i)) for i in range(rounds)])


def rounds_for(rows: float | None, most: int = ROUND_ROWS) -> int:
    """Rounds of about ``most`` shuffled rows each."""
    return int((rows or 0) // most) + 1


def of_round(i: int, rounds: int, *key: Column | str) -> Column:
    """Whether a key belongs to round ``i``."""
    return F.pmod(F.xxhash64(*key), F.lit(rounds)) == i if rounds > 1 else F.lit(True)


def spread(df: DataFrame) -> DataFrame:
    """Spread rows that are few in bytes but each a lot of work over all cores.

    Adaptive execution packs a small shuffle into a single task; a fixed number keeps it apart.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks)


def together(spark: SparkSession, *steps: Callable) -> list:
    """Results of steps that do not read each other. The short jobs of one fill the cores that another leaves idle."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(copy_context().run, inheritable_thread_target(spark)(step)) for step in steps]]


def last_row_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the row that comes last in ``order`` for every key (partial aggregation first)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of every key. Spark cuts each map task's groups to k rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_non_empty(*cols: Column) -> Column:
    """First value that is neither NULL nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cols])


def any_case_equal(a: Column, b: Column) -> Column:
    """Literal comparison without regard to case."""
    return F.lower(a) == F.lower(b)
