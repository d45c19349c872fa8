"""Domain tables derived from the driver tables by SQL that both Spark and DuckDB accept.

``Dialect`` hides the few expressions that differ. Each view is a text with the views it reads
listed; :func:`with_views` puts the needed ones in front of a query. Nothing is sampled or
cut: every word of every document becomes a locality, every locality is listed under its PIN, and
every customer becomes a record.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    """SQL spelling of one engine; ``sf_dir`` is set for Spark, which reads files by path."""

    sf_dir: str | None = None

    @property
    def spark(self) -> bool:
        return self.sf_dir is not None

    def table(self, name: str) -> str:
        return f"parquet.`{self.sf_dir}/{name}.parquet`" if self.spark else name

    def hash(self, expr: str, digits: int = 7) -> str:
        """Whole number from the first hex digits of the md5 of a text."""
        head = f"substr(md5({expr}), 1, {digits})"
        return f"CAST(conv({head}, 16, 10) AS BIGINT)" if self.spark else f"CAST('0x' || {head} AS BIGINT)"

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})" if self.spark else f"({a} // {b})"

    def split_rows(self, expr: str, pattern: str) -> str:
        return (f"explode(split({expr}, '{pattern}'))" if self.spark
                else f"unnest(regexp_split_to_array({expr}, '{pattern}'))")

    def title(self, expr: str) -> str:
        """First letter of the text in upper case; the engines differ on the upper case of ß."""
        return f"CASE WHEN {expr} LIKE 'ß%' THEN {expr} ELSE upper(substr({expr}, 1, 1)) || substr({expr}, 2) END"


DUCK = Dialect()
# Parts over which words are numbered.
PARTS = 256


def _pin(d: Dialect) -> str:
    return f"""
    SELECT s_suppkey, s_nationkey,
           lpad(CAST((1 + s_nationkey % 8) * 100000 + s_suppkey AS STRING), 6, '0') AS pincode,
           s_name AS office_name,
           CASE s_suppkey % 3 WHEN 0 THEN 'head' WHEN 1 THEN 'sub' ELSE 'branch' END AS office_type,
           CASE s_suppkey % 2 WHEN 0 THEN 'delivery' ELSE 'non_delivery' END AS delivery_status,
           n_name AS district, r_name AS state, 'TALUK_' || CAST(s_suppkey % 7 AS STRING) AS taluk,
           r_name || ' CIRCLE' AS circle, n_name || ' REGION' AS region, n_name || ' DIVISION' AS division,
           CASE WHEN s_suppkey % 13 = 0 THEN 3e1 ELSE 12e0 + CAST(s_suppkey % 100 AS DOUBLE) / 1e2 END AS latitude,
           7e1 + 5 * r_regionkey + {d.div('s_nationkey', '5')} + 5e-1 + CAST(s_suppkey % 29 - 14 AS DOUBLE) / 1e2 AS longitude
    FROM {d.table('supplier')} JOIN {d.table('nation')} ON s_nationkey = n_nationkey
         JOIN {d.table('region')} ON n_regionkey = r_regionkey"""


def _distinct_word(d: Dialect) -> str:
    return f"""
    SELECT w AS word, {d.hash('w')} AS h FROM (SELECT DISTINCT w FROM (
            SELECT {d.split_rows('lower(text)', '[^\\\\p{L}]+' if d.spark else '[^\\p{L}]+')} AS w FROM {d.table('documents')}) AS s
          WHERE w <> '') AS u"""


def _word(d: Dialect) -> str:
    """Words with a gapless number: counted per part of the hash, so that no window holds them all."""
    return f"""
    SELECT word, h, h % (SELECT count(*) FROM {d.table('supplier')}) AS home,
           row_number() OVER (PARTITION BY h % {PARTS} ORDER BY h, word) - 1 + before AS number
    FROM f_distinct_word JOIN (
      SELECT part, CAST(coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM (SELECT h % {PARTS} AS part, count(*) AS n FROM f_distinct_word GROUP BY h % {PARTS}) AS c) AS b ON part = h % {PARTS}"""


def _locality(d: Dialect) -> str:
    return f"""
    SELECT {d.hash('word', 13)} AS id, h, word,
           ({d.title('word')}) || CASE WHEN h % 5 = 0 THEN ' Nagar' WHEN h % 11 = 0 THEN ' Colony' ELSE '' END AS canonical_name,
           CASE WHEN h % 4 = 0 THEN substr(word, 1, length(word) - 1) END AS alias,
           pincode, 'CITY_' || CAST(s_nationkey AS STRING) AS city, district, state, latitude, longitude,
           h % 200000 AS population,
           CASE h % 3 WHEN 0 THEN 'india_post' WHEN 1 THEN 'osm' ELSE 'census' END AS source,
           taluk, s_suppkey, s_nationkey
    FROM f_word JOIN f_pin ON s_suppkey = home"""


def _pin_locality(d: Dialect) -> str:
    return "SELECT pincode, district, state, canonical_name AS locality FROM f_locality"


def _census(d: Dialect) -> str:
    state, district = ("lpad(CAST(r_regionkey + 1 AS STRING), 2, '0')", "lpad(CAST(n_nationkey + 1 AS STRING), 4, '0')")
    none = "CAST(NULL AS STRING)"
    return f"""
    SELECT {state} AS state_code, r_name AS state_name, {none} AS district_code, {none} AS district_name,
           {none} AS subdistrict_code, {none} AS subdistrict_name, {none} AS village_code, {none} AS village_name,
           'State' AS level, CAST(NULL AS BIGINT) AS population
    FROM {d.table('region')}
    UNION ALL
    SELECT {state}, r_name, {district}, n_name, {none}, {none}, {none}, {none}, 'District', CAST(NULL AS BIGINT)
    FROM {d.table('nation')} JOIN {d.table('region')} ON n_regionkey = r_regionkey
    UNION ALL
    SELECT {state}, r_name, {district}, n_name, {none}, {none}, 'C' || CAST(n_nationkey AS STRING),
           'CITY_' || CAST(n_nationkey AS STRING), 'City', CAST(500000 AS BIGINT)
    FROM {d.table('nation')} JOIN {d.table('region')} ON n_regionkey = r_regionkey
    UNION ALL
    SELECT DISTINCT {state}, r_name, {district}, n_name, {district} || substr(taluk, 7), taluk, {none}, {none},
           'Sub-district', CAST(NULL AS BIGINT)
    FROM f_pin JOIN {d.table('nation')} ON s_nationkey = n_nationkey JOIN {d.table('region')} ON n_regionkey = r_regionkey
    UNION ALL
    SELECT {state}, r_name, {district}, n_name, {district} || substr(taluk, 7), taluk, CAST(id AS STRING), canonical_name,
           CASE id % 20 WHEN 0 THEN 'City' WHEN 1 THEN 'Town' ELSE 'Village' END, population
    FROM f_locality JOIN {d.table('nation')} ON s_nationkey = n_nationkey
         JOIN {d.table('region')} ON n_regionkey = r_regionkey"""


def _record(d: Dialect) -> str:
    return f"""
    SELECT c_custkey AS record_id, 'job_' || CAST(c_custkey % 4 AS STRING) AS job_id, c_custkey AS row_index,
           c_name AS patient_id, true_name, true_pin,
           'No ' || CAST(c_custkey AS STRING) || ', ' || ({d.title('typed')}) || ' Rd' AS line1,
           typed AS line2, '  Opp   ' || c_mktsegment AS landmark,
           CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '9' || substr(true_pin, 2) ELSE true_pin END AS pincode,
           CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'CITTY' || substr(true_city, 5) ELSE true_city END AS city,
           CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE true_district END AS district,
           CASE WHEN c_custkey % 2 = 1 THEN NULL ELSE true_state END AS state,
           'India' AS country, typed
    FROM (SELECT c_custkey, c_name, c_mktsegment, canonical_name AS true_name, pincode AS true_pin, city AS true_city,
                 district AS true_district, state AS true_state,
                 CASE c_custkey % 5 WHEN 0 THEN canonical_name
                      WHEN 1 THEN substr(canonical_name, 1, 2) || substr(canonical_name, 4)
                      WHEN 2 THEN substr(canonical_name, 1, 2) || substr(canonical_name, 2)
                      WHEN 3 THEN substr(canonical_name, 1, 4)
                      ELSE upper(replace(canonical_name, 'ß', 'ss')) END AS typed
          FROM (SELECT *, c_custkey % (SELECT count(*) FROM f_word) AS picked FROM {d.table('customer')}) AS c
               LEFT JOIN f_word AS w ON number = picked LEFT JOIN f_locality AS l ON l.word = w.word) AS t"""


def _processed(d: Dialect) -> str:
    tier = "CASE WHEN {0} >= 85 THEN 'high' WHEN {0} >= 60 THEN 'medium' WHEN {0} >= 40 THEN 'low' ELSE 'unverified' END"
    return f"""
    SELECT record_id, job_id, row_index, chunk_index, created_at, latitude, longitude, hh, overall,
           'No ' || CAST(hh % 5 AS STRING) AS b_line1,
           CASE WHEN hh % 3 = 0 THEN NULL WHEN hh % 17 = 0 THEN '9' || substr(pincode, 2) ELSE pincode END AS b_pincode,
           CASE WHEN hh % 5 = 0 THEN NULL ELSE 'LOC_' || CAST(hh % 50 AS STRING) END AS b_locality,
           CASE WHEN hh % 4 = 0 THEN NULL ELSE city END AS b_city,
           CASE WHEN hh % 7 = 0 THEN NULL ELSE district END AS b_district,
           CASE WHEN hh % 2 = 1 THEN NULL ELSE state END AS b_state,
           'No ' || CAST(hh % 5 AS STRING) AS a_line1,
           CASE WHEN hh % 29 = 0 THEN NULL ELSE pincode END AS a_pincode,
           'Loc_' || CAST(hh % 50 AS STRING) AS a_locality,
           CASE WHEN hh % 31 = 0 THEN NULL ELSE city END AS a_city,
           CASE WHEN hh % 91 = 0 THEN NULL ELSE district END AS a_district,
           CASE WHEN hh % 37 = 0 THEN NULL ELSE state END AS a_state,
           {tier.format('overall')} AS confidence_tier, {tier.format('overall_before')} AS tier_before,
           CASE WHEN overall >= 85 THEN 'auto' WHEN hh % 11 = 0 THEN 'manual_verified' WHEN hh % 13 = 0 THEN 'rejected'
                ELSE 'needs_review' END AS review_status,
           CASE WHEN overall = 100 THEN 'exact' WHEN overall >= 50 THEN 'fuzzy' WHEN overall >= 30 THEN 'inferred'
                ELSE 'manual' END AS match_method
    FROM (SELECT o_orderkey AS record_id, 'job_' || CAST(o_custkey % 40 AS STRING) AS job_id, o_orderkey AS row_index,
                 CAST({d.div('o_orderkey', '10000')} AS INT) AS chunk_index, CAST(o_orderdate AS TIMESTAMP) AS created_at,
                 {d.hash('CAST(o_orderkey AS STRING)')} AS hh,
                 CAST({d.hash('CAST(o_orderkey AS STRING)')} % 101 AS INT) AS overall,
                 CAST({d.div(d.hash('CAST(o_orderkey AS STRING)'), '101')} % 101 AS INT) AS overall_before,
                 pincode, 'CITY_' || CAST(s_nationkey AS STRING) AS city, district, state, latitude, longitude
          FROM (SELECT *, {d.hash('CAST(o_orderkey AS STRING)')} % (SELECT count(*) FROM {d.table('supplier')}) AS home
                FROM {d.table('orders')}) AS o JOIN f_pin ON s_suppkey = home) AS t"""


def _chunk(d: Dialect) -> str:
    return f"""
    SELECT CAST(l_orderkey AS STRING) AS job_id, l_linenumber AS chunk_index,
           CAST(sum(l_quantity) AS BIGINT) AS row_count,
           CASE WHEN max(l_returnflag) = 'R' THEN 'failed' WHEN min(l_linestatus) = 'F' THEN 'completed' ELSE 'pending' END AS status,
           CASE WHEN max(l_returnflag) = 'R' AND l_linenumber % 2 = 0 THEN 'timeout' END AS error_message,
           CAST(max(l_shipdate) AS TIMESTAMP) AS completed_at
    FROM {d.table('lineitem')} GROUP BY l_orderkey, l_linenumber"""


def _job(d: Dialect) -> str:
    return f"""
    SELECT CAST(o_orderkey AS STRING) AS job_id, o_custkey % 50 AS user_id, o_orderpriority AS filename,
           CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status,
           CAST(o_orderdate AS TIMESTAMP) AS created_at,
           CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS TIMESTAMP) END AS completed_at,
           coalesce(total_rows, 0) AS total_rows, coalesce(processed_rows, 0) AS processed_rows,
           coalesce(failed_rows, 0) AS failed_rows, coalesce(manual_review_rows, 0) AS manual_review_rows
    FROM {d.table('orders')} LEFT JOIN (
      SELECT job_id AS j, CAST(sum(row_count) AS BIGINT) AS total_rows,
             CAST(sum(CASE WHEN status = 'completed' THEN row_count ELSE 0 END) AS BIGINT) AS processed_rows,
             CAST(sum(CASE WHEN status = 'failed' THEN row_count ELSE 0 END) AS BIGINT) AS failed_rows,
             CAST(sum(row_count % 7) AS BIGINT) AS manual_review_rows
      FROM f_chunk GROUP BY job_id) AS c ON j = CAST(o_orderkey AS STRING)"""


def _stats(d: Dialect) -> str:
    def n(expr: str) -> str:
        return f"CAST(sum({expr}) AS BIGINT)"

    def band(low: str, high: str) -> str:
        return f"CASE WHEN cents >= {low} AND cents < {high} THEN q ELSE 0 END"

    return f"""
    SELECT job_id, {n('q')} AS total_records, {n(d.div('q * 6', '10'))} AS complete_addresses_before,
           {n(d.div('q', '3'))} AS missing_pincode_before, {n(d.div('q', '4'))} AS missing_locality_before,
           {n(d.div('q', '5'))} AS missing_city_before, {n(d.div('q', '6'))} AS missing_district_before,
           {n(d.div('q', '7'))} AS missing_state_before, {n(d.div('q', '8'))} AS invalid_addresses_before,
           {n('q % 3')} AS duplicate_addresses_before, CAST({n('q')} % 61 AS DOUBLE) AS overall_quality_before,
           {n(d.div('q', '4'))} AS pincodes_added, {n(d.div('q', '9'))} AS cities_added, {n(d.div('q', '5'))} AS districts_added,
           {n(d.div('q', '7'))} AS states_added, {n('q % 5')} AS spell_corrections, {n(d.div('q', '2'))} AS improved_records,
           {n('q % 7')} AS manual_review_records, CAST({n('q')} % 101 AS DOUBLE) AS final_quality_score,
           CAST({n('q')} % 101 - {n('q')} % 61 AS DOUBLE) AS improvement_percentage,
           {n(band('0', '4'))} AS confidence_high, {n(band('4', '7'))} AS confidence_medium,
           {n(band('7', '9'))} AS confidence_low, {n(band('9', '11'))} AS confidence_unverified,
           CAST({n('ln')} AS DOUBLE) AS profiling_time, CAST({n('tax')} AS DOUBLE) AS processing_time,
           CAST({n('cents')} AS DOUBLE) AS reporting_time, CAST({n('ln + tax')} AS DOUBLE) AS export_time
    FROM (SELECT CAST(l_orderkey AS STRING) AS job_id, CAST(l_quantity AS BIGINT) AS q, l_linenumber AS ln,
                 CAST(round(l_discount * 100) AS BIGINT) AS cents, CAST(round(l_tax * 100) AS BIGINT) AS tax
          FROM {d.table('lineitem')}) AS t
    GROUP BY job_id"""


def _audit(d: Dialect) -> str:
    return f"""
    SELECT event_id AS id, user_id AS record_id, 'job_' || CAST(user_id % 5 AS STRING) AS job_id,
           CASE event_type WHEN 'click' THEN 'city' WHEN 'view' THEN 'district' WHEN 'signup' THEN 'state'
                WHEN 'purchase' THEN 'pincode' ELSE 'line1' END AS field_name,
           CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'old_' || CAST(event_id % 97 AS STRING) END AS old_value,
           'new_' || CAST(event_id % 89 AS STRING) AS new_value,
           CASE event_type WHEN 'click' THEN 'spell_correction' WHEN 'view' THEN 'hierarchy_enrichment'
                WHEN 'signup' THEN 'parsing' WHEN 'purchase' THEN 'manual_override' ELSE 'normalization' END AS processing_method,
           CAST(floor(value) AS INT) % 101 AS confidence,
           CASE event_id % 7 WHEN 0 THEN 'india_post' WHEN 1 THEN 'osm' WHEN 2 THEN 'census' WHEN 3 THEN 'libpostal'
                WHEN 4 THEN 'rapidfuzz' WHEN 5 THEN 'manual' ELSE 'inferred' END AS source_dataset,
           CASE WHEN event_type = 'purchase' THEN CAST(user_id AS STRING) END AS user_id, ts AS created_at
    FROM {d.table('events')}"""


def _rect(d: Dialect) -> str:
    hole = "CAST(NULL AS DOUBLE)"
    strip = f"7e1 + 5 * n_regionkey + {d.div('n_nationkey', '5')}"
    return f"""
    SELECT CAST(1000 + r_regionkey AS BIGINT) AS osm_id, 4 AS admin_level, r_name AS name, 'State of ' || r_name AS name_en,
           7e1 + 5 * r_regionkey AS x0, 75e0 + 5 * r_regionkey AS x1, 1e1 AS y0, 15e0 AS y1,
           CASE WHEN r_regionkey = 1 THEN 7545e-2 END AS hx0, CASE WHEN r_regionkey = 1 THEN 7555e-2 END AS hx1,
           CASE WHEN r_regionkey = 1 THEN 123e-1 END AS hy0, CASE WHEN r_regionkey = 1 THEN 125e-1 END AS hy1
    FROM {d.table('region')}
    UNION ALL
    SELECT CAST(2000 + n_nationkey AS BIGINT), 6, n_name, 'District of ' || n_name, {strip}, {strip} + 1, 1e1, 15e0,
           {hole}, {hole}, {hole}, {hole} FROM {d.table('nation')}
    UNION ALL
    SELECT CAST(3000 + n_nationkey AS BIGINT), 8, 'CITY_' || CAST(n_nationkey AS STRING), 'Town of ' || n_name,
           {strip} + 2e-1, {strip} + 8e-1, 11e0, 14e0, {hole}, {hole}, {hole}, {hole} FROM {d.table('nation')}"""


# name → (text, views it reads)
VIEWS: dict[str, tuple[Callable[[Dialect], str], tuple[str, ...]]] = {
    "f_pin": (_pin, ()),
    "f_distinct_word": (_distinct_word, ()),
    "f_word": (_word, ("f_distinct_word",)),
    "f_locality": (_locality, ("f_word", "f_pin")),
    "f_pin_locality": (_pin_locality, ("f_locality",)),
    "f_census": (_census, ("f_pin", "f_locality")),
    "f_record": (_record, ("f_word", "f_locality")),
    "f_processed": (_processed, ("f_pin",)),
    "f_chunk": (_chunk, ()),
    "f_job": (_job, ("f_chunk",)),
    "f_stats": (_stats, ()),
    "f_audit": (_audit, ()),
    "f_rect": (_rect, ()),
}


def needed(names: tuple[str, ...], stop: Sequence[str] = ()) -> list[str]:
    """The named views and all they read, in order; what the views in ``stop`` read is not followed."""
    seen: set[str] = set()

    def visit(name: str) -> None:
        if name not in seen:
            seen.add(name)
            for dep in () if name in stop else VIEWS[name][1]:
                visit(dep)

    for n in names:
        visit(n)
    return [n for n in VIEWS if n in seen]


def with_views(d: Dialect, body: str, *names: str, **more: str) -> str:
    """A query with the named views (and further texts) as common table expressions."""
    parts = [f"{n} AS ({VIEWS[n][0](d)})" for n in needed(names)]
    parts += [f"{n} AS ({text})" for n, text in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
