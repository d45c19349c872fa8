"""Line deduplication by overlapping windows of three lines. Only DataFrame functions.

Consecutive lines with text are hashed three at a time, windows found twice or more anywhere are looked
up, the first occurrence (smallest doc_id, null last, then text, then place) stays, and later ones are removed by merging
the lines they cover. A document is a doc_id with one text; a row without doc_id is a document of its own.
Both lookups are merge joins at every size: what they look up grows with the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pataspark.llm.common import packed, shared_table, unpacked, without_positions

LINES = 3
# What tells documents apart.
KEY = ("id", "content", "copy")


def _norm(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def _filled(text: Column) -> Column:
    """Lines with text, as their place in the text and two hashes."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), _norm(x).alias("x")))
    filled = F.filter(lines, lambda s: s["x"] != "")
    return F.transform(filled, lambda s: F.struct(s["at"].alias("at"), F.xxhash64(s["x"]).alias("h"), F.xxhash64(s["x"], F.lit(1)).alias("g")))


def documents(docs: DataFrame) -> DataFrame:
    """Every row packed, with the key of its document: id, content (hash of the text) and copy.

    Rows without doc_id are written once and numbered there, so that exact copies among them are told apart;
    their content hashes the whole row, which makes their order that of the rows.
    """
    text = F.coalesce("_text", F.lit(""))
    named = packed(docs.filter(F.col("doc_id").isNotNull()), "doc_id", "text").select(
        "*", F.xxhash64(text).alias("content"), F.lit(0).cast("long").alias("copy"))
    unnamed = packed(docs.filter(F.col("doc_id").isNull()), "doc_id", "text").select(
        "*", F.xxhash64(text, F.to_json("_row")).alias("content"), F.monotonically_increasing_id().alias("copy"))
    return named.union(shared_table(unnamed)).withColumnRenamed("_doc_id", "id")


def windows(rows: DataFrame, lines: int = LINES) -> DataFrame:
    """One row per window: key of the document, two hashes, and the places of its first and last line."""
    df = rows.select(*KEY, _filled(F.coalesce("_text", F.lit(""))).alias("filled")).filter(F.size("filled") >= lines)
    at = F.sequence(F.lit(1), F.size("filled") - (lines - 1))

    def one(k: Column) -> Column:
        part = [F.element_at("filled", k + i) for i in range(lines)]
        return F.struct(F.xxhash64(*[p["h"] for p in part]).alias("w1"), F.xxhash64(*[p["g"] for p in part]).alias("w2"),
                        part[0]["at"].alias("lo"), part[-1]["at"].alias("hi"))
    return df.select(*KEY, F.inline(F.transform(at, one)))


def repeated_windows(rows: DataFrame, lines: int = LINES) -> DataFrame:
    """Windows found in more than one place, with their first occurrence."""
    place = F.struct(F.col("id").isNull().alias("unnamed"), *KEY, "lo", "hi")
    found = windows(rows, lines).groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    return found.filter("first <> last").select("w1", "w2", "first")


def covered_lines(rows: DataFrame, lines: int = LINES) -> DataFrame:
    """Per document the places of all lines to remove, ascending."""
    repeated = shared_table(repeated_windows(rows, lines))
    later = windows(rows, lines).join(repeated.hint("merge"), ["w1", "w2"])
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("content") == F.col("first.content")) & (F.col("copy") == F.col("first.copy"))
    # Lines of the first occurrence itself stay, also where a later one overlaps it.
    start = F.when(same, F.greatest("lo", F.col("first.hi") + 1)).otherwise(F.col("lo"))
    later = later.filter(~(same & (F.col("lo") == F.col("first.lo")))).select(*KEY, start.alias("lo"), "hi").filter("lo <= hi")
    cover = F.flatten(F.transform("ranges", lambda r: F.sequence(r["lo"], r["hi"])))
    return (later.groupBy(*KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
            .select(*KEY, F.array_sort(F.array_distinct(cover)).alias("places")))


def dedup_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """Every row with its text after removal, ``n_lines`` (all lines), ``n_removed`` and ``removed`` (places from 0).

    Lines are compared without white space at their ends; empty lines are passed over, but go with a
    window that spans them. Texts with fewer than three filled lines lose nothing. Rows with the same doc_id and
    text are one document: a window at the same place of both counts as one occurrence. Different texts under one doc_id
    are different documents, and so is every row without doc_id, also an exact copy. A null text stays null.
    A text whose lines are all removed becomes empty. An empty table gives no rows. Columns named as results are replaced.
    """
    rows = documents(docs)
    places = shared_table(covered_lines(rows, lines)).alias("c").hint("merge")
    df = rows.alias("d").join(places, F.col("d.id").eqNullSafe(F.col("c.id")) & (F.col("d.content") == F.col("c.content"))
                              & (F.col("d.copy") == F.col("c.copy")), "left")
    own = F.split(F.coalesce("_text", F.lit("")), "\n")
    gone = F.filter(F.coalesce("places", F.array().cast("array<int>")), lambda p: p < F.size(own))
    text = F.when(F.col("places").isNull(), F.col("_text")).otherwise(F.array_join(without_positions(own, gone), "\n"))
    return unpacked(df, docs.columns, text=text, n_lines=F.size(own).cast("long"), n_removed=F.size(gone).cast("long"), removed=gone)
