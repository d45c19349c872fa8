"""Column profiles and detection of address columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pataspark.functions.text import PIN_FORMAT, PIN_IN_TEXT, percentage, value_shape
from pataspark.operators.common import top_k

# Words looked for inside column names (scored detection).
NAME_KEYWORDS = (
    "address", "addr", "line1", "line2", "street", "road", "lane", "locality", "area", "colony",
    "sector", "block", "plot", "house", "flat", "apartment", "apt", "building", "bldg", "floor",
    "flr", "landmark", "near", "opp", "behind", "beside", "next", "to", "pincode", "pin", "zip",
    "postal", "city", "town", "village", "district", "dist", "state", "st", "country", "nation",
)
# Words looked for in names and values (any-hit detection).
ANY_HIT_KEYWORDS = (
    "address", "addr", "street", "road", "lane", "avenue", "locality", "area", "colony", "nagar",
    "sector", "block", "city", "town", "village", "district", "dist", "state", "pincode", "pin",
    "zip", "postal", "landmark", "near", "opp", "behind", "house", "flat", "apartment", "apt",
    "floor", "building",
)
PIN_WORDS = ("pincode", "pin", "zip", "postal")
LOCALITY_SUFFIXES = ("nagar", "colony", "sector", "extension", "layout", "vihar", "pura", "ganj")
NAME_SCORE_NEEDED = CONTENT_SCORE_NEEDED = 2
SAMPLE_VALUES, DETECT_VALUES = 5, 20

# Rows of one block of the index when the first values of a column are searched.
_BLOCK_ROWS = 65_536


def to_long(df: DataFrame, columns: list[str], row_index: str | None = None) -> DataFrame:
    """(column_name, value as text[, row_index]), NULLs kept."""
    ids = [row_index] if row_index else []
    text = df.select(*ids, *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    return text.unpivot(ids, list(columns), "column_name", "value")


def first_values(df: DataFrame, columns: list[str], row_index: str, k: int) -> DataFrame:
    """First k non-NULL values of every column in row order: (column_name, value, position).

    Rows are first counted per block of the index. Only blocks up to the one that holds a
    column's k-th value are then read again, so the ranking works on a sliver of the table.
    """
    long = (to_long(df, columns, row_index).filter(F.col("value").isNotNull())
            .withColumn("block", F.floor(F.col(row_index) / _BLOCK_ROWS)))
    # Every block that holds a value adds at least one, so k blocks always suffice.
    blocks = long.select("column_name", "block").distinct()
    counts = top_k(blocks, ["column_name"], [F.col("block")], k)
    limit = counts.groupBy("column_name").agg(F.max("block").alias("last_block"))
    near = (long.join(F.broadcast(limit), "column_name")
            .filter(F.col("block") <= F.col("last_block")))
    return (top_k(near, ["column_name"], [F.col(row_index)], k, rank="position")
            .select("column_name", "value", "position"))


def profile_columns(df: DataFrame, columns: list[str] | None = None, *, approximate: bool = False) -> DataFrame:
    """NULL %, distinct values (NULL counts as one), shortest and longest value per column.

    Equal values are first counted together, so a frequent value is one row in the shuffle.
    """
    columns = columns or df.columns
    dtypes = dict(df.dtypes)
    types = F.create_map(*[F.lit(x) for c in columns for x in (c, dtypes[c])])
    long = to_long(df, columns)
    length = F.length("value")
    if approximate:
        grouped = long.groupBy("column_name").agg(
            F.count("*").alias("total"), F.count("value").alias("filled"),
            F.approx_count_distinct("value").alias("values"),
            F.min(length).alias("min_length"), F.max(length).alias("max_length"))
    else:
        per_value = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
        grouped = per_value.groupBy("column_name").agg(
            F.sum("n").alias("total"),
            F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("filled"),
            F.count("value").alias("values"),
            F.min(length).alias("min_length"), F.max(length).alias("max_length"))
    missing = F.col("total") - F.col("filled")
    return grouped.select(
        "column_name", types[F.col("column_name")].alias("dtype"),
        percentage(missing, F.col("total")).alias("null_pct"),
        (F.col("values") + F.when(missing > 0, 1).otherwise(0)).alias("distinct_count"),
        F.coalesce("min_length", F.lit(0)).alias("min_length"),
        F.coalesce("max_length", F.lit(0)).alias("max_length"),
        F.col("total").alias("row_count"))


def sample_values(df: DataFrame, columns: list[str], row_index: str, k: int = SAMPLE_VALUES) -> DataFrame:
    """First k non-NULL values per column as an array in row order."""
    firsts = first_values(df, columns, row_index, k)
    ordered = F.array_sort(F.collect_list(F.struct("position", "value")))
    return firsts.groupBy("column_name").agg(ordered["value"].alias("sample_values"))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def detect_address_columns(df: DataFrame, row_index: str, columns: list[str] | None = None) -> DataFrame:
    """Scored detection: (column_name, name_score, content_score, detected).

    A name scores one point per keyword found anywhere inside it; content is scored on the
    column's first 20 values.
    """
    columns = columns or [c for c in df.columns if c != row_index]
    name_scores = F.create_map(*[x for c in columns for x in (
        F.lit(c), F.lit(sum(kw in c.lower() for kw in NAME_KEYWORDS)))])
    v = F.lower("value")
    points = (
        F.when(_any([F.contains(v, F.lit(w)) for w in PIN_WORDS]), 2).otherwise(0)
        + F.when(_any([F.endswith(v, F.lit(s)) for s in LOCALITY_SUFFIXES]), 1).otherwise(0)
        + F.when(v.rlike(PIN_IN_TEXT), 2).otherwise(0))
    content = (first_values(df, columns, row_index, DETECT_VALUES)
               .groupBy("column_name").agg(F.sum(points).alias("content_score")))
    all_columns = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return (all_columns.join(content, "column_name", "left")
            .select("column_name", name_scores[F.col("column_name")].alias("name_score"),
                    F.coalesce("content_score", F.lit(0)).cast("int").alias("content_score"))
            .withColumn("detected", (F.col("name_score") >= NAME_SCORE_NEEDED)
                        | (F.col("content_score") >= CONTENT_SCORE_NEEDED)))


def detect_any_hit(df: DataFrame, row_index: str, columns: list[str] | None = None) -> DataFrame:
    """Any-hit detection: a keyword in the name, in the first 5 values, or a value that is a PIN."""
    columns = columns or [c for c in df.columns if c != row_index]
    named = F.create_map(*[x for c in columns for x in (
        F.lit(c), F.lit(any(kw in c.lower() for kw in ANY_HIT_KEYWORDS)))])
    hit = (_any([F.contains(F.lower("value"), F.lit(w)) for w in ANY_HIT_KEYWORDS])
           | F.col("value").rlike(PIN_FORMAT))
    content = (first_values(df, columns, row_index, SAMPLE_VALUES)
               .groupBy("column_name").agg(F.max(hit).alias("content_hit")))
    all_columns = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return (all_columns.join(content, "column_name", "left")
            .select("column_name",
                    (named[F.col("column_name")] | F.coalesce("content_hit", F.lit(False))).alias("detected")))


def dominant_shapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent value shape per column and its share of the filled values."""
    shapes = (to_long(df, columns).filter(F.col("value").isNotNull())
              .groupBy("column_name", value_shape(F.col("value")).alias("shape"))
              .agg(F.count("*").alias("n")))
    best = F.max_by("shape", F.struct("n", "shape"))
    return shapes.groupBy("column_name").agg(
        best.alias("dominant_shape"), percentage(F.max("n"), F.sum("n")).alias("format_share"),
        F.count("*").alias("shape_count"))


def column_validity(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Share of filled values that satisfy each column's rule, in one pass."""
    aggregates = []
    for name, rule in rules.items():
        filled = F.coalesce(F.col(name), F.lit("")) != ""
        aggregates += [F.count_if(filled).alias(f"f_{name}"), F.count_if(filled & rule).alias(f"v_{name}")]
    one = df.agg(*aggregates)
    rows = F.explode(F.array(*[F.struct(
        F.lit(n).alias("column_name"), F.col(f"f_{n}").alias("filled"), F.col(f"v_{n}").alias("valid"))
        for n in rules]))
    return one.select(rows.alias("r")).select("r.*").withColumn(
        "validity", percentage(F.col("valid"), F.col("filled")))
