"""How five text filters interact: a cooperative game of removals, solved by its potential.

A coalition is a set of filters, numbered by its bits (A is 1, B is 2, up to E with 16); its worth is the number of documents
that at least one of its filters removes. Every document is reduced to the coalition of filters that it fails, so the
32 worths of a part come from at most 32 counts. Shapley values are differences of the potential of Hart and Mas-Colell, and
every step of every filter order is a difference of two worths.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pataspark.llm.common import let, text_or_empty, words_of

FILTERS = "ABCDE"
ALL = 2 ** len(FILTERS) - 1
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 3
SYMBOLS = "[#$%&*|]"
# Potentials of games with whole worths are whole multiples of 1 / lcm(1, ..., 5).
_SCALE = 60
_ORDERS = 120
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def _fails_alone(text: Column) -> Column:
    """Coalition of those filters A to D that a text fails."""
    counts = let(words_of(text), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")))

    def coalition(c: Column) -> Column:
        return (F.when(c["words"] < MIN_WORDS, bit("A")).otherwise(0)
                + F.when(100 * c["distinct"].cast("long") < MIN_DISTINCT_PERCENT * c["words"].cast("long"), bit("B")).otherwise(0))
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    return (let(counts, coalition)
            + F.when(100 * capitals.cast("long") > MAX_CAPITAL_PERCENT * F.length(text).cast("long"), bit("C")).otherwise(0)
            + F.when(text.rlike(SYMBOLS), bit("D")).otherwise(0))


def failing_coalitions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows by part, coalition of failed filters, and labels: part, fails, good, toxic, rows.

    Texts leave the scan as a 128-bit hash and a coalition. Copies are counted together before they meet the least doc_id of
    their text, so a text that very many documents share is a few rows by then.
    """
    text = text_or_empty("text")
    measured = docs.select(
        "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.md5(text).alias("text_hash"),
        _fails_alone(text).alias("fails"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = measured.join(marks, "doc_id", "left").na.fill(False, ["good", "toxic"])
    kinds = ["part", "fails", "good", "toxic"]
    rows = marked.groupBy("doc_id", "text_hash", *kinds).agg(F.count("*").alias("rows"))
    # Rows without doc_id are neither smaller nor larger than others.
    named = F.col("doc_id").isNotNull()
    copies = rows.groupBy("text_hash", *kinds).agg(
        F.sum("rows").alias("rows"), F.coalesce(F.sum(F.when(named, F.col("rows"))), F.lit(0)).alias("named"),
        F.min(F.when(named, F.struct("doc_id", "rows"))).alias("least"))
    least_id = F.min("least.doc_id").over(Window.partitionBy("text_hash"))
    repeated = F.col("named") - F.when(F.col("least.doc_id") == least_id, F.col("least.rows")).otherwise(0)
    split = copies.withColumn("repeated", repeated).select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("fails"), (F.col("rows") - F.col("repeated")).alias("rows")),
        F.struct((F.col("fails") + bit("E")).alias("fails"), F.col("repeated").alias("rows")))).alias("k"))
    return split.groupBy("part", "k.fails", "good", "toxic").agg(F.sum("k.rows").alias("rows"))


def worths(counted: DataFrame) -> DataFrame:
    """Rows, labelled good and toxic, that each of the 32 coalitions removes: part, total, worth (array by coalition)."""
    held = counted.select("*", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("coalition"))
    gone = F.when(F.col("fails").bitwiseAND(F.col("coalition")) != 0, F.col("rows")).otherwise(F.lit(0))
    by_coalition = held.groupBy("part", "coalition").agg(
        F.sum("rows").alias("total"), F.sum(gone).alias("removed"),
        F.sum(F.when(F.col("good"), gone).otherwise(F.lit(0))).alias("good"), F.sum(F.when(F.col("toxic"), gone).otherwise(F.lit(0))).alias("toxic"))
    return by_coalition.groupBy("part").agg(
        F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("coalition", "removed", "good", "toxic"))).alias("worth"))


def potentials(worth: Column) -> Column:
    """Potential of each coalition's game, times 60: P(S) = (worth(S) + sum over i in S of P(S without i)) / |S|.

    A coalition without one member has a smaller number, so one walk in ascending order meets what it needs; the division is exact.
    """
    def next_one(known: Column, s: Column) -> Column:
        below = F.lit(0).cast("long")
        for name in FILTERS:
            below = below + F.when(s.bitwiseAND(F.lit(bit(name))) != 0, F.get(known, s - bit(name))).otherwise(F.lit(0))
        return F.concat(known, F.array(F.call_function("div", _SCALE * F.get(worth, s)["removed"] + below, F.bit_count(s).cast("long"))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ALL)), F.array(F.lit(0).cast("long")), next_one)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every step of all 120 filter orders within each part: what it removes, what earlier filters had taken, and Shapley values.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (times 120). A
    part is a value of lang (null counts as the empty string). Null texts count as empty; an empty text fails A only, and E where an
    earlier one is empty too. Rows are documents: repeated rows count each, and those of the least doc_id of a text do not
    fail E. A row without doc_id fails A to D only and has no labels. Several label rows of one document count as good or
    toxic where any says so; null labels say nothing. Other columns are not read. An empty table has no parts and gives no rows.
    """
    games = worths(failing_coalitions(docs, labels)).withColumn("potential", potentials(F.col("worth")))
    orders = F.explode(F.lit(["".join(p) for p in permutations(FILTERS)]))
    steps = games.select("*", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    def member(at: Column) -> Column:
        return F.get(F.lit([bit(f) for f in FILTERS]), F.instr(F.lit(FILTERS), F.substring("filter_order", at, F.lit(1))) - 1)
    before = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda s, at: s + member(at)) - member(F.col("step"))
    placed = steps.withColumn("before", before).withColumn("own", member(F.col("step")))

    def worth(coalition: Column) -> Column:
        return F.get("worth", coalition)
    without, after, now = worth(ALL - F.col("own")), worth(F.col("before") + F.col("own")), worth(F.col("before"))
    removed = after["removed"] - now["removed"]
    return placed.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), (F.col("total") - after["removed"]).alias("kept"), removed.alias("removed"),
        (worth(F.col("own"))["removed"] - removed).alias("redundant"), (worth(F.lit(ALL))["removed"] - without["removed"]).alias("unique_fails"),
        (after["good"] - now["good"]).alias("good_lost"), (after["toxic"] - now["toxic"]).alias("toxic_lost"),
        (_ORDERS // _SCALE * (F.get("potential", F.lit(ALL)) - F.get("potential", ALL - F.col("own")))).alias("shapley"))
