"""Registry of queries and the frames they start from."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from pataspark.operators.common import cut_lineage, shared_folder, shuffles_removed, spread
from pataspark.operators.pincode import one_row_per_pin
from pataspark.operators.spatial import prepare_boundaries
from pataspark.plans.address import ReferenceData
from pataspark.workload.views import DUCK, VIEWS, Dialect, needed, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def oracle(body: str, *views: str, **more: str) -> str:
    return with_views(DUCK, body, *views, **more)


def duck_token_parts(rows: str, columns: str) -> str:
    """SQL that adds to rows with texts a and b what both share, and what only one has: distinct tokens in order, joined (i, x, y)."""
    def tokens(c: str) -> str:
        return f"list_sort(list_distinct(list_filter(regexp_split_to_array({c}, '\\s+'), lambda t: t <> '')))"
    return f"""
    SELECT {columns}, array_to_string(list_filter(ta, lambda t: list_contains(tb, t)), ' ') AS i,
           array_to_string(list_filter(ta, lambda t: NOT list_contains(tb, t)), ' ') AS x, array_to_string(list_filter(tb, lambda t: NOT list_contains(ta, t)), ' ') AS y
    FROM (SELECT *, {tokens('a')} AS ta, {tokens('b')} AS tb FROM ({rows}) AS pairs) AS parts"""


# Length of the longest common subsequence of x and y: the usual table, row by row, as a fold.
DUCK_SUBSEQUENCE = """list_last(list_reduce(string_split(y, ''), lambda r, c: list_transform(range(1, len(r) + 1), lambda j:
    list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN k > 1 AND x[k - 1] = c THEN r[k - 1] + 1 ELSE r[k] END))), list_transform(range(0, length(x) + 1), lambda n: 0)))"""


def duck_token_set(a: str = "a", b: str = "b") -> str:
    """SQL for the token-set ratio from the parts i, x and y, by its definition."""
    def overlap(part: str) -> str:
        return f"100 - 100 * (1 + length({part}))::DOUBLE / (2 * length(i) + 1 + length({part}))"
    rest = f"100 - 100 * (length(x) + length(y) - 2 * {DUCK_SUBSEQUENCE})::DOUBLE / (2 * (length(i) + CASE WHEN i <> '' THEN 1 ELSE 0 END) + length(x) + length(y))"
    return f"""CASE WHEN i = '' AND (x = '' OR y = '') THEN 0 WHEN x = '' OR y = '' THEN 100 WHEN i = '' THEN {rest}
      ELSE greatest({rest}, {overlap('x')}, {overlap('y')}) END"""


def query(name: str, sql: str | None = None):
    """Register ``fn(source)`` under a name, with its SQL twin if there is one."""
    def register(fn: Callable[["Source"], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Source(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


# Derived tables that many queries read: written once per application and folder.
STORED = ("f_pin", "f_distinct_word", "f_word", "f_locality", "f_census", "f_record")
_STORE: dict[tuple[str, str, str], str] = {}


class Source:
    """Driver tables and derived domain tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def view(self, name: str) -> DataFrame:
        """A derived table. Those in STORED are read from a table in the shared folder."""
        if name in STORED:
            return self.spark.read.parquet(self._stored(name))
        return self.spark.sql(self._text(name))

    def _text(self, name: str) -> str:
        d = Dialect(self.sf_dir)
        parts = [f"{n} AS (SELECT * FROM parquet.`{self._stored(n)}`)" if n in STORED and n != name else f"{n} AS ({VIEWS[n][0](d)})"
                 for n in needed((name,), stop=[n for n in STORED if n != name])]
        return f"WITH {', '.join(parts)} SELECT * FROM {name}"

    def _stored(self, name: str) -> str:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORE:
            path = f"{self.scratch()}-{name}"
            rows = self._text(name)
            with shuffles_removed(self.spark):
                spread(self.spark.sql(rows)).write.option("compression", "zstd").parquet(path)
            _STORE[key] = path
        return _STORE[key]

    def scratch(self) -> str:
        """A new folder next to the checkpoints."""
        return f"{shared_folder(self.spark)}/{uuid.uuid4().hex}"

    @cached_property
    def dictionary(self) -> DataFrame:
        aliases = F.when(F.col("alias").isNotNull(), F.array("alias")).otherwise(F.array().cast("array<string>"))
        return self.view("f_locality").select(
            "id", "canonical_name", aliases.alias("aliases"), "pincode", "city", "district", "state", "latitude",
            "longitude", "population", "source")

    @cached_property
    def directory(self) -> DataFrame:
        lists = self.view("f_pin_locality").groupBy("pincode").agg(F.collect_list("locality").alias("localities"))
        none = F.array().cast("array<string>")
        return (self.view("f_pin").drop("s_suppkey", "s_nationkey").join(lists, "pincode", "left")
                .withColumn("localities", F.coalesce("localities", none)))

    @cached_property
    def pins(self) -> DataFrame:
        return one_row_per_pin(self.view("f_pin").drop("s_suppkey", "s_nationkey"))

    @cached_property
    def census(self) -> DataFrame:
        return self.view("f_census")

    @cached_property
    def records(self) -> DataFrame:
        return spread(self.view("f_record").select(
            "record_id", "job_id", "row_index", "patient_id", "line1", "line2", "landmark", "pincode", "city",
            "district", "state", "country"))

    @cached_property
    def processed(self) -> DataFrame:
        """Processed records with ``before`` and ``after`` address structs."""
        def side(p: str):
            return F.struct(*[F.col(f"{p}_{f}").alias(f) for f in (
                "line1", "pincode", "locality", "city", "district", "state")])
        return self.view("f_processed").withColumn("before", side("b")).withColumn("after", side("a"))

    @cached_property
    def raw_boundaries(self) -> DataFrame:
        """Rectangles as boundary rows, with a hole where one is given."""
        def ring(x0: str, x1: str, y0: str, y1: str):
            corners = ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))
            return F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corners])
        outer, hole = ring("x0", "x1", "y0", "y1"), ring("hx0", "hx1", "hy0", "hy1")
        rings = F.when(F.col("hx0").isNull(), F.array(outer)).otherwise(F.array(outer, hole))
        return self.view("f_rect").select("osm_id", "admin_level", "name", "name_en", rings.alias("rings"))

    @cached_property
    def boundaries(self) -> DataFrame:
        return prepare_boundaries(self.raw_boundaries)

    @cached_property
    def references(self) -> ReferenceData:
        """The reference tables as written tables, which is what a job reads in practice; two of them only select from tables written before."""
        return ReferenceData(cut_lineage(self.directory), self.dictionary, self.census, self.boundaries)
