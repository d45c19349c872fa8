"""The operators as registered queries over whole tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pataspark.llm import decontaminate, embedding_links, filter_audit, licenses, line_dedup, minhash, mixing, quality_rules, secrets, sharding, tokens, toxicity, whitening

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: counts and spans of the base patterns, and all spans with those of the lexer."""
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"),
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every text, and the verdict with cross-document line frequency per source."""
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_lines")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines removed from every text because a window of three lines occurred before, and the md5 of what is left."""
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every text: places of the base phrases, and all labels after suppression."""
    first = F.transform("base", lambda b: b["first_word"])
    base = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    more = F.transform("detections", lambda d: d["label"])
    score = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0))
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"), score.alias("score"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text, written in blocks and read back."""
    import public_tokenizers
    blocks = tokens.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return tokens.read_tokens(blocks)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.planned_copies(docs).select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target",
        (F.col("_size") * F.col("copies")).alias("taken"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document in a uniform shuffle with exact shard sizes."""
    text = F.coalesce("text", F.lit(""))
    return sharding.shuffled_into_shards(_table(spark, sf_dir, "documents")).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicate documents for every document."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items whose text occurs in each document, also with words substituted."""
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "n_items", "items", "matched_words")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("offending").cast("long").alias("n_offending"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of all filter orders per language, with the Shapley value of the step's filter."""
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every vector."""
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op13_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of close vectors of the same label, and component, of every vector."""
    return embedding_links.linked_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_secret_scan, op2_quality_rules, op3_line_dedup, op4_license_scan, op5_token_ids, op6_source_mixing, op7_sharding,
    op8_near_duplicates, op9_decontamination, op10_toxicity, op11_filter_audit, op12_embedding_whitening, op13_embedding_links)}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '')"

_OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host, {_WORDS} AS w FROM documents),
  win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8) AS u),
  twice AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before
            FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM win) AS u WHERE n > 1),
  rep AS (SELECT doc_id, CAST(sum(CASE WHEN before IS NULL THEN 8 ELSE least(8, i - before) END) AS BIGINT) AS n_repeat FROM twice GROUP BY doc_id),
  line AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS l FROM d),
  norm AS (SELECT *, trim(regexp_replace(regexp_replace(lower(l), '[0-9]', '0', 'g'), '[ \t-\r]+', ' ', 'g')) AS k FROM line),
  dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup FROM norm WHERE k <> '' GROUP BY doc_id),
  hosts AS (SELECT host, count(DISTINCT (doc_id, md5(text))) AS n FROM d GROUP BY host),
  freq AS (SELECT host, k FROM (SELECT host, k, count(DISTINCT (doc_id, md5(text))) AS c FROM norm WHERE k <> '' GROUP BY host, k) AS f JOIN hosts USING (host)
           WHERE c > {quality_rules.MAX_DOCUMENTS} OR (c > {quality_rules.SHARE_DOCUMENTS} AND 100 * c > {quality_rules.MAX_SHARE_PERCENT} * n)),
  gone AS (SELECT doc_id, count(*) AS n_gone, CAST(sum(length(l) + 1) AS BIGINT) AS chars FROM norm JOIN freq USING (host, k) GROUP BY doc_id),
  m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
          CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
          coalesce(n_repeat, 0) AS n_repeat_words, coalesce(n_gone, 0) AS n_frequent_lines, length(text) AS chars, coalesce(gone.chars, 0) AS lost
        FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)),
  v AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEATED_PERCENT} * n_words AS base_failed,
          n_frequent_lines > 0 AND 100 * (chars - lost) < {quality_rules.MIN_LEFT_PERCENT} * chars AS depleted FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR depleted) AS kept, n_frequent_lines FROM v"""

_OP3 = r"""
WITH line AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS l, len(ls) AS n
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) AS s),
  filled AS (SELECT doc_id, i, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM line
             WHERE trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
  win AS (SELECT doc_id, i AS lo, lead(i, 2) OVER w AS hi, x || chr(10) || lead(x, 1) OVER w || chr(10) || lead(x, 2) OVER w AS t
          FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  first AS (SELECT doc_id, lo, hi, first_value(doc_id) OVER w AS fd, first_value(lo) OVER w AS fl, first_value(hi) OVER w AS fh
            FROM win WHERE hi IS NOT NULL WINDOW w AS (PARTITION BY t ORDER BY doc_id, lo)),
  gone AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = fd THEN greatest(lo, fh + 1) ELSE lo END, hi + 1)) AS i
           FROM first WHERE NOT (doc_id = fd AND lo = fl)),
  left_over AS (SELECT l.doc_id, max(n) AS n_lines, count(g.i) AS n_removed, string_agg(CAST(g.i AS VARCHAR), ',' ORDER BY g.i) AS removed,
                  md5(coalesce(string_agg(CASE WHEN g.i IS NULL THEN l.l END, chr(10) ORDER BY l.i), '')) AS text_md5
                FROM line AS l LEFT JOIN gone AS g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, coalesce(removed, '') AS removed, text_md5 FROM left_over"""

_OP6 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
             md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
  r AS (SELECT *, 3 * source_size AS room, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS k FROM s),
  v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(room) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
  t AS (SELECT source, source_size, CASE WHEN level * weight >= room THEN CAST(room AS DOUBLE)
               ELSE (SELECT arg_min(level, k) FROM v WHERE level * weight < room) * weight END AS target FROM v),
  u AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size * {2 ** mixing.UNIT_BITS} + 0.5) ELSE 0 END AS BIGINT) AS units,
               CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(source, '')), 1, {mixing.UNIT_BITS // 4}) AS BIGINT) AS start FROM t),
  p AS (SELECT doc_id, size, source_size, target, units,
          start + units * row_number() OVER (PARTITION BY d.source ORDER BY lpad(CAST(length(bin(size)) AS VARCHAR), 3, '0') || substr(bin(size), 2, 3), h) AS reached
        FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, CAST(size * ((reached >> {mixing.UNIT_BITS}) - ((reached - units) >> {mixing.UNIT_BITS})) AS BIGINT) AS taken FROM p"""

_OP8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda w: w <> '') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x
        FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0) AS u),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
  link AS (SELECT a, b FROM pair JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= {minhash.PERCENT} * (na.n + nb.n - c)),
  reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT doc_id, b FROM reach JOIN link ON a = other),
  c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

_OP11 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
  m AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
  f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, MAP {{
            'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
            'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
            'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)}} AS fails
        FROM d LEFT JOIN m USING (doc_id)),
  g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY part, fails),
  o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) AS u WHERE NOT contains(filter_order, x)),
  st AS (SELECT filter_order, step, filter_order[step] AS own, string_split(filter_order[:step - 1], '') AS before
         FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(filter_order) = 5) AS u),
  x AS (SELECT part, filter_order, step, own, n, n_good, n_toxic, fails[own] AS failing, len(list_filter(before, lambda b: b <> '' AND fails[b])) > 0 AS gone,
               len(list_filter(map_values(fails), lambda b: b)) AS n_fails FROM g, st),
  r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed,
               coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant, coalesce(sum(n) FILTER (failing AND n_fails = 1), 0) AS unique_fails,
               coalesce(sum(n_good) FILTER (NOT gone AND failing), 0) AS good_lost, coalesce(sum(n_toxic) FILTER (NOT gone AND failing), 0) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""

ORACLES: dict[str, str] = {"op2_quality_rules": _OP2, "op3_line_dedup": _OP3, "op6_source_mixing": _OP6, "op8_near_duplicates": _OP8, "op11_filter_audit": _OP11}
