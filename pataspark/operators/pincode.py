"""PIN-code directory joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pataspark.functions.text import PIN_FORMAT, is_pin, name_key
from pataspark.operators.common import broadcast_if_small, last_row_wins, top_k

# Confidence of a directory hit.
PIN_CONFIDENCE = 100


def one_row_per_pin(directory: DataFrame, order: tuple[str, ...] | None = None) -> DataFrame:
    """One office per PIN: the last in load order, or head before sub before branch.

    At most 800,000 rows can be left, as a PIN has six digits and starts with 1 to 8.
    """
    valid = directory.filter(is_pin(F.col("pincode")))
    if order:
        return last_row_wins(valid, ["pincode"], list(order))
    office = (F.when(F.col("office_type") == "head", 3).when(F.col("office_type") == "sub", 2)
              .when(F.col("office_type") == "branch", 1).otherwise(0))
    ranked = valid.withColumn("_office", office)
    return last_row_wins(ranked, ["pincode"], ["_office", "office_name"]).drop("_office")


def resolve_pins(df: DataFrame, pins: DataFrame, pin: str = "pincode") -> DataFrame:
    """Add ``pin_*`` columns for a PIN that is well formed and known, NULL otherwise.

    ``pins`` has one row per PIN (see :func:`one_row_per_pin`).
    """
    lookup = broadcast_if_small(pins.select(
        F.col("pincode").alias("_lookup_pin"), F.col("district").alias("pin_district"),
        F.col("state").alias("pin_state"), F.col("taluk").alias("pin_taluk"),
        F.col("latitude").alias("pin_latitude"), F.col("longitude").alias("pin_longitude"),
        F.lit(PIN_CONFIDENCE).alias("pin_confidence"),
    ).filter(F.col("_lookup_pin").rlike(PIN_FORMAT)))
    return df.join(lookup, F.col(pin) == F.col("_lookup_pin"), "left").drop("_lookup_pin")


def pin_localities(directory: DataFrame) -> DataFrame:
    """One row per PIN and locality with the number of directory rows that name the pair."""
    exploded = directory.select("pincode", "district", "state",
                                F.explode("localities").alias("locality"))
    keyed = exploded.withColumn("locality_key", name_key(F.col("locality")))
    return (keyed.filter((F.col("locality_key") != "") & is_pin(F.col("pincode")))
            .groupBy("locality_key", "pincode", "district", "state")
            .agg(F.count("*").alias("frequency"), F.min("locality").alias("locality")))


def localities_for_pin(queries: DataFrame, directory: DataFrame) -> DataFrame:
    """(pincode) → its localities."""
    pairs = pin_localities(directory).select("pincode", "locality").distinct()
    return queries.select("pincode").distinct().join(pairs, "pincode")


def reverse_lookup(queries: DataFrame, directory: DataFrame) -> DataFrame:
    """(locality, district, state) → candidate PINs ranked by frequency.

    District and state narrow the candidates only when both are given.
    """
    q = (queries.select("locality", "district", "state").distinct()
         .withColumn("locality_key", name_key(F.col("locality"))))
    pairs = pin_localities(directory).select(
        "locality_key", "pincode", F.col("district").alias("_district"),
        F.col("state").alias("_state"), "frequency")
    given = (F.coalesce(F.col("district"), F.lit("")) != "") & (F.coalesce(F.col("state"), F.lit("")) != "")
    same = ((F.lower("district") == F.lower("_district")) & (F.lower("state") == F.lower("_state")))
    hits = (q.join(pairs, "locality_key").filter(~given | same)
            .groupBy("locality", "district", "state", "pincode").agg(F.sum("frequency").alias("frequency")))
    return hits.withColumn("rank", F.rank().over(_by_frequency()))


def _by_frequency():
    from pyspark.sql import Window
    return Window.partitionBy("locality", "district", "state").orderBy(F.desc("frequency"))


def infer_pin(queries: DataFrame, directory: DataFrame) -> DataFrame:
    """Best candidate PIN per (locality, district, state); the smaller PIN wins a tie."""
    best = top_k(reverse_lookup(queries, directory).drop("rank"), ["locality", "district", "state"],
                 [F.desc("frequency"), F.col("pincode")], 1)
    return best.select("locality", "district", "state", F.col("pincode").alias("inferred_pincode"))


def pin_problem(pin: Column, known: Column) -> Column:
    """'missing', 'malformed', 'unknown' or 'ok'."""
    return (F.when(F.coalesce(pin, F.lit("")) == "", "missing").when(~is_pin(pin), "malformed")
            .when(~known, "unknown").otherwise("ok"))


def pin_problems(df: DataFrame, pins: DataFrame, shared_above: int) -> DataFrame:
    """Per PIN value: its problem, the rows that use it, and whether it is shared by too many.

    Values are counted first, so the join sees each distinct PIN once.
    """
    used = df.groupBy("pincode").agg(F.count("*").alias("row_count"))
    known = pins.select(F.col("pincode").alias("_known_pin")).distinct()
    joined = used.join(known, F.col("pincode") == F.col("_known_pin"), "left")
    return joined.select(
        "pincode", pin_problem(F.col("pincode"), F.col("_known_pin").isNotNull()).alias("problem"), "row_count",
        (F.col("pincode").isNotNull() & (F.col("row_count") > shared_above)).alias("shared"))
