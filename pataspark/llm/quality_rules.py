"""Quality rules: measures of each text, and lines that too many documents of a host repeat.

Only DataFrame functions. Normalised lines are hashed, the distinct documents per host and line are counted,
lines above the limits are removed, and a document that loses most of its text is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pataspark.llm.common import let, packed, shared_table, unpacked, without_positions, words_of

# Base rules.
WINDOW, MIN_WORDS, MAX_REPEATED_PERCENT = 8, 20, 30
SYMBOLS = "[#*$%&|<>]"
# A line is removed from a host if more documents of it have the line than MAX_DOCUMENTS, or more than this
# percentage of the host's documents; a share speaks only above SHARE_DOCUMENTS documents. Either limit decides alone.
MAX_DOCUMENTS, MAX_SHARE_PERCENT, SHARE_DOCUMENTS = 40, 10, 10
# A document is depleted when less than this percentage of its characters is left.
MIN_LEFT_PERCENT = 30


def _windows(hashes: Column, window: int) -> Column:
    """Hash of every window of words, from the words' hashes."""
    def made(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(window)]))
    return let(hashes, lambda h: F.when(F.size(h) >= window, made(h)).otherwise(F.array().cast("array<bigint>")))


def _repeated(windows: Column, window: int) -> Column:
    """Words covered by windows that occur twice or more, from window hashes in text order.

    The windows are sorted with their places; equal neighbours repeat, and their places say what they cover.
    """
    def places(sorted_windows: Column) -> Column:
        def twice(p: Column, k: Column) -> Column:
            before, after = F.get(sorted_windows, k - 1)["h"], F.get(sorted_windows, k + 1)["h"]
            return F.coalesce(before == p["h"], F.lit(False)) | F.coalesce(after == p["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(sorted_windows, twice), lambda p: p["i"]))

    def covered(at: Column) -> Column:
        each = F.transform(at, lambda p, k: F.coalesce(F.least(F.lit(window), p - F.get(at, k - 1)), F.lit(window)))
        return F.aggregate(each, F.lit(0), lambda total, n: total + n)
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(placed, places), covered).cast("long")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the text, the first included."""
    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) < F.size(w), _repeated(w, window)).otherwise(F.lit(0).cast("long"))
    return let(_windows(F.transform(words, lambda w: F.xxhash64(w)), window), count)


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, runs of white space as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), "[ \t-\r]+", " "))


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("_text"), F.lit(""))
    df = (packed(docs, "doc_id", "text", "source")
          .withColumn("_host", F.coalesce(F.col("_source"), F.lit("")))
          .withColumn("_content", F.xxhash64(text))
          .withColumn("_words", words_of(text))
          .withColumn("_lines", F.split(text, "\n")))
    df = df.withColumn("_worded", F.filter("_lines", lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0))
    df = df.select(
        "_row", "_doc_id", "_host", "_content", "_lines", F.size("_words").cast("long").alias("_n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("_word_chars"),
        (F.size(F.split(text, SYMBOLS)) - 1).cast("long").alias("_n_symbols"),
        (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long").alias("_n_dup_lines"),
        repeated_words(F.col("_words")).alias("_n_repeat_words"), F.length(text).cast("long").alias("_chars"))
    failed = (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > MAX_REPEATED_PERCENT * F.col("_n_words"))
    return df.withColumn("_base_failed", failed)


def _lines(docs: DataFrame) -> DataFrame:
    """Every line with a word: document, host, content, place, key of the normalised line, its characters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(
        F.col("doc_id").alias("_doc_id"), F.coalesce("source", F.lit("")).alias("_host"), F.xxhash64(text).alias("_content"),
        F.posexplode(F.split(text, "\n")).alias("_at", "_line")).withColumn("_norm", normalised(F.col("_line"))).filter("_norm <> ''")
    return lines.select("_doc_id", "_host", "_content", "_at", F.xxhash64("_norm").alias("_key"), F.length("_line").alias("_length"))


def frequent_lines(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, max_share_percent: float = MAX_SHARE_PERCENT,
                   share_documents: int = SHARE_DOCUMENTS) -> DataFrame:
    """Lines above either limit (_host, _key, documents).

    A document is a doc_id with its text: repeated rows count once, copies under other ids count each. A null
    source and an empty one are the same host.
    """
    in_documents = _lines(docs).select("_host", "_key", "_doc_id", "_content").distinct()
    counts = in_documents.groupBy("_host", "_key").agg(F.count("*").alias("documents")).filter(F.col("documents") > min(max_documents, share_documents))
    documents = docs.select(F.coalesce("source", F.lit("")).alias("_host"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_content"))
    hosts = documents.distinct().groupBy("_host").agg(F.count("*").alias("all_documents"))
    share = (F.col("documents") > share_documents) & (100 * F.col("documents") > max_share_percent * F.col("all_documents"))
    return counts.join(hosts, "_host").filter((F.col("documents") > max_documents) | share).select("_host", "_key", "documents")


def quality_rules(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, max_share_percent: float = MAX_SHARE_PERCENT,
                  min_left_percent: float = MIN_LEFT_PERCENT, share_documents: int = SHARE_DOCUMENTS) -> DataFrame:
    """Every row with its measures, the verdicts, and ``clean_text``, the text without frequent lines.

    A null text has no words and fails the base rule; its clean text is empty. Equal rows get equal
    results. Rows without doc_id are told apart by their content. An empty table gives no rows. Columns that have the name of a
    result are replaced by it, all others stay.
    """
    frequent = shared_table(frequent_lines(docs, max_documents, max_share_percent, share_documents))
    hits = _lines(docs).join(frequent, ["_host", "_key"])
    removed = hits.groupBy("_doc_id", "_host", "_content").agg(F.collect_set(F.struct("_at", "_length")).alias("_gone"))
    df = _measured(docs).alias("d").join(
        removed.alias("r"), F.col("d._doc_id").eqNullSafe(F.col("r._doc_id")) & (F.col("d._host") == F.col("r._host"))
        & (F.col("d._content") == F.col("r._content")), "left")
    gone = F.coalesce(F.col("r._gone"), F.array().cast("array<struct<_at:int,_length:int>>"))
    n_gone = F.size(gone).cast("long")
    # A removed line takes its line break with it.
    left = F.col("_chars") - F.aggregate(gone, F.lit(0), lambda n, x: n + x["_length"] + 1)
    depleted = (n_gone > 0) & (100 * left < min_left_percent * F.col("_chars"))
    at = F.sort_array(F.transform(gone, lambda x: x["_at"]))
    clean = F.array_join(without_positions(F.col("_lines"), at), "\n")
    return unpacked(
        df, docs.columns, n_words=F.col("_n_words"), word_chars=F.col("_word_chars"), n_symbols=F.col("_n_symbols"),
        n_dup_lines=F.col("_n_dup_lines"), n_repeat_words=F.col("_n_repeat_words"), base_failed=F.col("_base_failed"),
        n_frequent_lines=n_gone, depleted=depleted, kept=~(F.col("_base_failed") | depleted), clean_text=clean)
