"""Queries over joins, matching, parsing, spatial joins, aggregates, jobs and reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pataspark.functions import scoring, text
from pataspark.operators import (
    audit, census, dashboard, dictionary, jobs, lookups, match, parse, pincode, quality, spatial, spelling,
)
from pataspark.operators.common import cut_lineage, first_non_empty, last_row_wins, spread, top_k
from pataspark.plans import address as plans, results
from pataspark.streaming import progress
from pataspark.workload.base import duck_token_parts, duck_token_set, Source, oracle, query
from pataspark.workload.queries_text import _ADDRESS_SQL, _duck_clean, _duck_expand, _one_byte

ASOF = datetime(2001, 8, 1)


# -- filters --------------------------------------------------------------------------------

@query("b3_json_path", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def b3(s: Source):
    return s.table("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("b4_tier_filter", oracle("SELECT record_id, confidence_tier FROM f_processed WHERE confidence_tier IN ('high', 'low')", "f_processed"))
def b4(s: Source):
    return lookups.with_tiers(s.view("f_processed"), ["high", "low"]).select("record_id", "confidence_tier")


@query("b5_review_queue", oracle("SELECT record_id, overall FROM f_processed WHERE confidence_tier IN ('low', 'unverified')", "f_processed"))
def b5(s: Source):
    return lookups.review_queue(s.view("f_processed")).select("record_id", "overall")


@query("b5_review_queue_by_status", oracle("SELECT record_id, overall, confidence_tier FROM f_processed WHERE review_status = 'needs_review'", "f_processed"))
def b5_status(s: Source):
    return lookups.review_queue(s.view("f_processed"), "needs_review").select("record_id", "overall", "confidence_tier")


@query("b6_job_filters", oracle("""
    SELECT job_id, filename FROM f_job WHERE user_id = 7 AND status = 'completed' AND created_at >= TIMESTAMP '1996-01-01'
           AND created_at < TIMESTAMP '2000-01-01'""", "f_job"))
def b6(s: Source):
    return lookups.filter_jobs(s.view("f_job"), user_id=7, status="completed", created_from=datetime(1996, 1, 1),
                               created_before=datetime(2000, 1, 1)).select("job_id", "filename")


@query("b7_pins_by_district_state", oracle("SELECT pincode, office_name FROM f_pin WHERE lower(district) = 'nation_3' AND lower(state) = 'europe'", "f_pin"))
def b7(s: Source):
    return lookups.pins_in(s.directory, "Nation_3", "Europe").select("pincode", "office_name")


@query("b7_localities_by_city", oracle("""
    SELECT id, canonical_name FROM f_locality WHERE lower(city) = 'city_3' AND lower(district) = 'nation_3' AND lower(state) = 'europe'""", "f_locality"))
def b7_localities(s: Source):
    return lookups.localities_in(s.dictionary, "city_3", "Nation_3", "EUROPE").select("id", "canonical_name")


@query("b8_name_search", oracle("""
    SELECT village_name, village_code FROM f_census WHERE contains(lower(village_name), 'ther') ORDER BY village_name, village_code LIMIT 50""", "f_census"))
def b8(s: Source):
    return lookups.search_names(s.census, "village_name", "THER", order=["village_name", "village_code"]).select("village_name", "village_code")


@query("b9_alias_search", oracle("SELECT id, canonical_name FROM f_locality WHERE alias = 'ndste' ORDER BY id LIMIT 50", "f_locality"))
def b9(s: Source):
    return lookups.search_alias(s.dictionary, "ndste").select("id", "canonical_name")


@query("b10_records_of_jobs", oracle("""
    SELECT record_id, job_id FROM f_processed WHERE job_id IN (SELECT 'job_' || CAST(user_id AS VARCHAR) FROM f_job WHERE status = 'failed' AND filename = '5-LOW')""",
    "f_processed", "f_job"))
def b10(s: Source):
    chosen = lookups.filter_jobs(s.view("f_job"), status="failed", filename="5-LOW").select(
        F.concat(F.lit("job_"), F.col("user_id").cast("string")).alias("job_id"))
    return lookups.of_jobs(s.view("f_processed"), chosen).select("record_id", "job_id")


@query("b11_coordinate_box", oracle("""
    SELECT pincode FROM f_pin WHERE latitude BETWEEN 6 AND 38 AND longitude BETWEEN 68 AND 98""", "f_pin"))
def b11(s: Source):
    return lookups.valid_coordinates(s.view("f_pin")).select("pincode")


@query("b12_census_level", oracle("""
    SELECT district_code, district_name FROM f_census WHERE level = 'District' AND lower(state_name) = 'asia'""", "f_census"))
def b12(s: Source):
    return census.at_level(s.census, "District", state_name="Asia").select("district_code", "district_name")


# -- PIN and census joins -------------------------------------------------------------------

@query("c1_pin_lookup", oracle("""
    SELECT record_id, district AS pin_district, state AS pin_state, taluk AS pin_taluk, latitude AS pin_latitude,
           CASE WHEN p.pincode IS NOT NULL THEN 100 END AS pin_confidence
    FROM (SELECT record_id, pincode AS pin FROM f_record) AS r LEFT JOIN f_pin AS p ON p.pincode = r.pin AND r.pin SIMILAR TO '[1-8][0-9]{5}'""",
    "f_record", "f_pin"))
def c1(s: Source):
    return pincode.resolve_pins(s.records.select("record_id", "pincode"), s.pins).select(
        "record_id", "pin_district", "pin_state", "pin_taluk", "pin_latitude", "pin_confidence")


@query("c2_locality_to_pins", oracle("""
    SELECT locality, district, state, pincode, frequency, CAST(rank() OVER (PARTITION BY locality, district, state ORDER BY frequency DESC) AS INT) AS rank
    FROM (SELECT q.locality, q.district, q.state, p.pincode, count(*) AS frequency
          FROM (SELECT DISTINCT typed AS locality, district, state FROM f_record) AS q
          JOIN f_pin_locality AS p ON lower(trim(p.locality)) = lower(trim(q.locality))
          WHERE q.district IS NULL OR q.state IS NULL OR (lower(q.district) = lower(p.district) AND lower(q.state) = lower(p.state))
          GROUP BY 1, 2, 3, 4)""", "f_record", "f_pin_locality"))
def c2(s: Source):
    asked = s.view("f_record").select(F.col("typed").alias("locality"), "district", "state")
    return pincode.reverse_lookup(asked, s.directory)


@query("c3_pin_to_localities", oracle("SELECT DISTINCT pincode, locality FROM f_pin_locality WHERE pincode IN (SELECT pincode FROM f_record)",
                                      "f_pin_locality", "f_record"))
def c3(s: Source):
    return pincode.localities_for_pin(s.records, s.directory)


@query("g4_pins_in_district", oracle("""
    SELECT DISTINCT l.pincode FROM f_pin_locality AS l WHERE l.pincode IN (SELECT pincode FROM f_pin WHERE district = 'NATION_3' AND state = 'EUROPE')""",
    "f_pin_locality", "f_pin"))
def g4(s: Source):
    wanted = lookups.pins_in(s.pins, "NATION_3", "EUROPE").select("pincode")
    return pincode.pin_localities(s.directory).select("pincode").distinct().join(wanted, "pincode", "left_semi")


@query("c10_hierarchy_from_pin", oracle("""
    SELECT p.pincode, p.district, p.state, p.taluk, t.city, 95 AS confidence FROM f_pin AS p JOIN (
      SELECT DISTINCT lower(district_name) AS d, lower(state_name) AS s, village_name AS city FROM f_census WHERE level IN ('Town', 'City')) AS t
      ON lower(p.district) = t.d AND lower(p.state) = t.s""", "f_pin", "f_census"))
def c10(s: Source):
    return census.hierarchy_from_pin(s.pins, s.census)


@query("c10_main_city", oracle("""
    SELECT lower(district_name) AS town_district, lower(state_name) AS town_state, min(village_name) AS main_city
    FROM f_census WHERE level IN ('Town', 'City') GROUP BY 1, 2""", "f_census"))
def c10_main(s: Source):
    return census.main_city(s.census)


@query("c11_search_any_level", oracle("""
    SELECT q.query, c.state_code, c.district_code, c.subdistrict_code, c.village_code, c.level, c.matched_level
    FROM (SELECT DISTINCT district AS query FROM f_record WHERE district IS NOT NULL UNION SELECT DISTINCT typed FROM f_record) AS q
    JOIN (SELECT *, 'state_name' AS matched_level, lower(state_name) AS k FROM f_census UNION ALL
          SELECT *, 'district_name', lower(district_name) FROM f_census UNION ALL
          SELECT *, 'subdistrict_name', lower(subdistrict_name) FROM f_census UNION ALL
          SELECT *, 'village_name', lower(village_name) FROM f_census) AS c ON lower(q.query) = c.k""", "f_record", "f_census"))
def c11(s: Source):
    r = s.view("f_record")
    asked = r.select(F.col("district").alias("query")).union(r.select("typed")).filter("query IS NOT NULL").distinct()
    return census.search_by_name(asked, s.census)


@query("c12_codes", oracle("""
    SELECT DISTINCT n.state_code, n.district_code, c.district_name FROM (SELECT DISTINCT state_code, district_code FROM f_census WHERE level = 'Town') AS n
    JOIN f_census AS c ON c.state_code = n.state_code AND c.district_code = n.district_code AND c.level = 'District'""", "f_census"))
def c12(s: Source):
    return census.districts_by_code(s.census.filter("level = 'Town'"), s.census)


@query("c12_state_codes", oracle("SELECT DISTINCT state_code, state_name FROM f_census", "f_census"))
def c12_states(s: Source):
    return census.states_by_code(s.census, s.census)


@query("c13_city_names", oracle("SELECT village_name AS city FROM f_census WHERE level IN ('Town', 'City')", "f_census"))
def c13(s: Source):
    return census.all_city_names(s.census)


# -- locality matching ----------------------------------------------------------------------

_Q = "SELECT DISTINCT lower(trim(typed)) AS query FROM f_record"
_N = "SELECT DISTINCT lower(canonical_name) AS name FROM f_locality"


def _texts(s: Source):
    return cut_lineage(spread(match.distinct_queries(s.view("f_record"), "typed")))


def _names(s: Source):
    return cut_lineage(spread(match.distinct_names(s.dictionary)))


@query("c4_exact_match", oracle("SELECT query, name FROM q JOIN n ON query = name", "f_record", "f_locality", q=_Q, n=_N))
def c4(s: Source):
    return match.exact_matches(_texts(s), _names(s))


@query("c5_alias_match", oracle("""
    SELECT DISTINCT query, lower(canonical_name) AS name FROM q JOIN f_locality ON query = lower(alias)""", "f_record", "f_locality", q=_Q))
def c5(s: Source):
    return match.alias_matches(_texts(s), s.dictionary)


@query("c6_prefix_match", oracle("SELECT query, name FROM q JOIN n ON starts_with(name, query)", "f_record", "f_locality", q=_Q, n=_N))
def c6(s: Source):
    return match.prefix_matches(_texts(s), _names(s))


@query("c7_edit_distance_match", oracle(f"""
    SELECT query, name FROM q JOIN n ON length(name) BETWEEN length(query) - 2 AND length(query) + 2 AND levenshtein({_one_byte('query')}, {_one_byte('name')}) <= 2""",
    "f_record", "f_locality", q=_Q, n=_N))
def c7(s: Source):
    return match.edit_distance_matches(_texts(s), _names(s))


def _reaching(pairs: str, threshold: int) -> str:
    """SQL for (query, name, name_id, base): the pairs of a table at or above a threshold.

    Subsequences are only counted where edits, of which no pair has more than insertions and deletions, leave it in reach.
    """
    apart = 100 - threshold
    return f"""SELECT query, name, name_id, base FROM (SELECT query, name, name_id, {duck_token_set()} AS base
      FROM ({duck_token_parts(f"SELECT query, name, name_id, query AS a, name AS b FROM {pairs}", "query, name, name_id")}) AS p
      WHERE (i <> '' AND (x = '' OR y = '' OR 200 * length(i) >= {threshold} * (2 * length(i) + 1 + least(length(x), length(y)))))
        OR 100 * levenshtein({_one_byte('x')}, {_one_byte('y')}) <= {apart} * (2 * (length(i) + CASE WHEN i <> '' THEN 1 ELSE 0 END) + length(x) + length(y))) AS s
      WHERE base >= {threshold}"""


# All pairs at or above the threshold by definition: they share a token, or their whole texts are close.
_TOKEN_SET_SQL = f"""
    tokened AS (SELECT query AS text, TRUE AS asked, 0 AS name_id FROM q UNION ALL SELECT name, FALSE, name_id FROM numbered),
    split AS (SELECT *, list_sort(list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''))) AS tokens FROM tokened),
    sides AS (SELECT *, array_to_string(tokens, ' ') AS joined, unnest(tokens) AS token FROM split),
    sharing AS (SELECT DISTINCT a.text AS query, b.text AS name, b.name_id FROM sides AS a JOIN sides AS b ON a.token = b.token WHERE a.asked AND NOT b.asked),
    whole AS MATERIALIZED (SELECT DISTINCT text, asked, name_id, joined, {_one_byte('joined')} AS plain FROM sides),
    near AS (SELECT a.text AS query, b.text AS name, b.name_id FROM whole AS a JOIN whole AS b ON a.asked AND NOT b.asked
      AND 100 * abs(length(a.joined) - length(b.joined)) <= {100 - match.THRESHOLD} * (length(a.joined) + length(b.joined))
      AND 100 * levenshtein(a.plain, b.plain) <= {100 - match.THRESHOLD} * (length(a.joined) + length(b.joined))),
    pairs AS MATERIALIZED (SELECT * FROM sharing UNION SELECT * FROM near),
    by_tokens AS ({_reaching("pairs", match.THRESHOLD)})"""


def _token_set_twin(rest: str) -> str:
    numbered = "SELECT lower(trim(canonical_name)) AS name, min(id) AS name_id FROM f_locality WHERE trim(canonical_name) <> '' GROUP BY 1"
    text = oracle("\x00", "f_record", "f_locality", q=_Q + " WHERE trim(typed) <> ''", numbered=numbered)
    return text.replace("\x00", f", {_TOKEN_SET_SQL} {rest}")


@query("c8_token_set_match", _token_set_twin(f"""
    SELECT query, name, round(base, 6) AS score FROM by_tokens
    QUALIFY row_number() OVER (PARTITION BY query ORDER BY base DESC, name_id) <= {match.TOKEN_SET_LIMIT}"""))
def c8(s: Source):
    found = match.token_set_matches(_texts(s), _names(s))
    return found.select("query", "name", F.round("base", 6).alias("score"))


_BOOSTS = (("same_pin", scoring.BOOST_PIN), ("same_district", scoring.BOOST_DISTRICT), ("same_state", scoring.BOOST_STATE),
           (f"coalesce(population > {scoring.LARGE_POPULATION}, FALSE)", scoring.BOOST_POPULATION))


def _boosted(rows: str) -> str:
    """SQL that raises the score step by step, each step capped at 100."""
    for condition, points in _BOOSTS:
        rows = f"SELECT * REPLACE (CASE WHEN {condition} THEN least(100::DOUBLE, score + {points}) ELSE score END AS score) FROM ({rows}) AS b"
    return rows


# Every candidate of every kind beside every record of its name, without blocking or early cuts.
_LOCALITY_MATCH_SQL = f""",
    aliased AS (SELECT DISTINCT query, lower(trim(canonical_name)) AS name FROM q JOIN f_locality ON query = lower(trim(alias))),
    plain_query AS MATERIALIZED (SELECT query, {_one_byte('query')} AS plain, length(query) AS size FROM q),
    plain_name AS MATERIALIZED (SELECT name, name_id, {_one_byte('name')} AS plain, length(name) AS size FROM numbered),
    other AS (SELECT query, name, name_id FROM aliased JOIN numbered USING (name)
      UNION SELECT query, name, name_id FROM q JOIN numbered ON starts_with(name, query)
      UNION SELECT query, name, name_id FROM plain_query AS a JOIN plain_name AS b ON b.size BETWEEN a.size - {match.MAX_EDITS} AND a.size + {match.MAX_EDITS}
        AND levenshtein(a.plain, b.plain) <= {match.MAX_EDITS}),
    candidates AS (SELECT * FROM by_tokens UNION {_reaching("other", match.THRESHOLD - scoring.MAX_BOOST)}),
    asked AS (SELECT DISTINCT lower(trim(typed)) AS query, pincode AS ctx_pincode, district AS ctx_district, state AS ctx_state FROM f_record),
    records AS (SELECT *, lower(trim(canonical_name)) AS name FROM f_locality),
    met AS (SELECT a.*, r.* EXCLUDE (name), c.base AS score,
        CASE WHEN c.query = c.name THEN 'exact' WHEN (c.query, c.name) IN (SELECT (query, name) FROM aliased) THEN 'exact_alias'
             WHEN starts_with(c.name, c.query) THEN 'prefix' ELSE 'fuzzy' END AS method,
        coalesce(a.ctx_pincode = r.pincode, FALSE) AS same_pin, coalesce(lower(a.ctx_district) = lower(r.district), FALSE) AS same_district,
        coalesce(lower(a.ctx_state) = lower(r.state), FALSE) AS same_state
      FROM asked AS a JOIN candidates AS c USING (query) JOIN records AS r ON r.name = c.name),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query, ctx_pincode, ctx_district, ctx_state ORDER BY score DESC,
        list_position(['exact', 'exact_alias', 'prefix', 'fuzzy'], method), same_pin DESC, same_district DESC, same_state DESC,
        population DESC NULLS LAST, canonical_name, pincode NULLS FIRST, id) AS rank
      FROM ({_boosted("SELECT * FROM met")}) AS boosted WHERE score >= {match.THRESHOLD})
    SELECT query, ctx_pincode, ctx_district, ctx_state, canonical_name, pincode, city, district, state, source, latitude, longitude,
           round(score, 6) AS score, method, rank::INT AS rank FROM ranked WHERE rank <= {match.MATCH_LIMIT}"""


@query("c9_locality_match", _token_set_twin(_LOCALITY_MATCH_SQL))
def c9(s: Source):
    asked = s.view("f_record").select(F.col("typed").alias("query"), F.col("pincode").alias("ctx_pincode"),
                                      F.col("district").alias("ctx_district"), F.col("state").alias("ctx_state"))
    return match.match_localities(asked, s.dictionary).withColumn("score", F.round("score", 6))


@query("e2_best_match_per_query", oracle("""
    SELECT query, name FROM (SELECT query, name, row_number() OVER (PARTITION BY query ORDER BY length(name), name) AS rn
      FROM q JOIN n ON starts_with(name, query)) WHERE rn = 1""", "f_record", "f_locality", q=_Q, n=_N))
def e2(s: Source):
    hits = match.prefix_matches(_texts(s), _names(s))
    return top_k(hits, ["query"], [F.length("name"), F.col("name")], 1).select("query", "name")


@query("e3_last_row_wins", """
    SELECT l_orderkey, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1""")
def e3(s: Source):
    rows = s.table("lineitem").select("l_orderkey", "l_shipdate", "l_partkey", "l_suppkey")
    return last_row_wins(rows, ["l_orderkey"], ["l_shipdate", "l_partkey", "l_suppkey"]).drop("l_shipdate")


@query("e7_rank_by_frequency", oracle("""
    SELECT locality, district, state, pincode FROM (
      SELECT q.locality, q.district, q.state, p.pincode, row_number() OVER (PARTITION BY q.locality, q.district, q.state ORDER BY count(*) DESC, p.pincode) AS rn
      FROM (SELECT DISTINCT typed AS locality, district, state FROM f_record) AS q
      JOIN f_pin_locality AS p ON lower(trim(p.locality)) = lower(trim(q.locality))
      WHERE q.district IS NULL OR q.state IS NULL OR (lower(q.district) = lower(p.district) AND lower(q.state) = lower(p.state))
      GROUP BY 1, 2, 3, 4) WHERE rn = 1""", "f_record", "f_pin_locality"))
def e7(s: Source):
    asked = s.view("f_record").select(F.col("typed").alias("locality"), "district", "state")
    return pincode.infer_pin(asked, s.directory).withColumnRenamed("inferred_pincode", "pincode")


def _closest(asked: str, places: str, parent: str, threshold: int) -> str:
    """SQL for the closest place of every distinct (query, parent), all pairs within the parent compared."""
    pairs = f"""SELECT a.query, a.parent, p.place, a.query AS a, p.name AS b FROM asked AS a JOIN keyed AS p ON a.parent = p.parent"""
    long_enough = f"i <> '' OR 100 * abs(length(x) - length(y)) <= {100 - threshold} * (length(x) + length(y))"
    return f"""asked AS (SELECT DISTINCT lower(trim(query)) AS query, lower(trim(parent)) AS parent FROM ({asked}) AS q WHERE trim(query) <> ''),
      keyed AS (SELECT lower(trim(place)) AS name, lower(trim(parent)) AS parent, min(place) AS place FROM ({places}) AS p WHERE trim(place) <> '' GROUP BY 1, 2),
      parts AS ({duck_token_parts(pairs, "query, parent, place, b")}),
      scored AS (SELECT *, {duck_token_set()} AS score FROM parts WHERE {long_enough}),
      best AS (SELECT query, parent, place, score FROM scored WHERE score >= {threshold} QUALIFY row_number() OVER (PARTITION BY query, parent ORDER BY score DESC, b) = 1)
    SELECT query, {{columns}} place AS corrected, score FROM best"""


def _closest_twin(asked: str, places: str, threshold: int, columns: str, *views: str) -> str:
    text = oracle("\x00", *views)
    return text.replace("\x00", ", " + _closest(asked, places, "parent", threshold).format(columns=columns))


@query("c17_city_spelling", _closest_twin(
    "SELECT city AS query, '' AS parent FROM f_record", "SELECT village_name AS place, '' AS parent FROM f_census WHERE level IN ('City', 'Town')",
    spelling.CITY_THRESHOLD, "", "f_record", "f_census"))
def c17(s: Source):
    cities = s.census.filter("level IN ('City', 'Town')").select(F.col("village_name").alias("place"))
    return spelling.correct_names(s.records.select(F.col("city").alias("query")), cities, spelling.CITY_THRESHOLD)


@query("c17_district_spelling", _closest_twin(
    "SELECT district || 'x' AS query, state AS parent FROM f_record WHERE trim(state) <> ''", "SELECT DISTINCT district AS place, state AS parent FROM f_pin",
    spelling.DISTRICT_THRESHOLD, "parent AS state,", "f_record", "f_pin"))
def c17_district(s: Source):
    asked = s.view("f_record").select(F.regexp_replace("true_pin", "^.*$", "").alias("_"), "district", "state")
    typed = asked.select(F.concat(F.col("district"), F.lit("x")).alias("query"), "state")
    places = s.pins.select(F.col("district").alias("place"), "state").distinct()
    return spelling.correct_names_within(typed, places, "state", spelling.DISTRICT_THRESHOLD)


@query("c18_context_merge", oracle("""
    SELECT record_id, coalesce(nullif(trim(r.district), ''), p.district) AS district, coalesce(nullif(trim(r.state), ''), p.state) AS state
    FROM f_record AS r LEFT JOIN f_pin AS p ON p.pincode = r.pincode""", "f_record", "f_pin"))
def c18(s: Source):
    r = pincode.resolve_pins(s.records, s.pins)
    return r.select("record_id", first_non_empty(F.col("district"), F.col("pin_district")).alias("district"),
                    first_non_empty(F.col("state"), F.col("pin_state")).alias("state"))


# -- parsing --------------------------------------------------------------------------------

_PARSE_SQL = rf"""
    SELECT record_id, house_number, street, coalesce(locality, others[-1]) AS locality,
           CASE WHEN locality IS NOT NULL THEN others[-1] ELSE others[-2] END AS sublocality, city, district, state,
           list_extract(regexp_extract_all(address, '\b[1-8][0-9]{{5}}\b'), -1) AS pincode
    FROM (SELECT record_id, any_value(address) AS address,
                 arg_max(value, position) FILTER (label = 'house_number') AS house_number,
                 arg_max(value, position) FILTER (label = 'street') AS street,
                 arg_max(value, position) FILTER (label = 'locality') AS locality,
                 list(value ORDER BY position) FILTER (label = 'other') AS others,
                 arg_max(value, position) FILTER (label = 'city') AS city,
                 arg_max(value, position) FILTER (label = 'district') AS district,
                 arg_max(value, position) FILTER (label = 'state') AS state
          FROM (SELECT record_id, address, position, CASE WHEN label = 'house_number' THEN house ELSE part END AS value, label FROM (
                SELECT t.*, CASE WHEN lower(part) = 'india' THEN 'country' WHEN regexp_matches(part, '\b[1-8][0-9]{{5}}\b') THEN 'pincode'
                     WHEN house <> '' THEN 'house_number' WHEN regexp_matches(part, '(?i)^(?:{'|'.join(parse.NOISE_WORDS)})($|[^\p{{L}}\p{{N}}_])') THEN 'landmark'
                     WHEN regexp_matches(part, '(?i)(^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(parse.STREET_WORDS)})$') THEN 'street'
                     WHEN EXISTS (SELECT 1 FROM f_census AS c WHERE lower(c.state_name) = lower(part)) THEN 'state'
                     WHEN EXISTS (SELECT 1 FROM f_census AS c WHERE lower(c.district_name) = lower(part)) THEN 'district'
                     WHEN EXISTS (SELECT 1 FROM f_census AS c WHERE c.level IN ('Town', 'City') AND lower(c.village_name) = lower(part)) THEN 'city'
                     WHEN EXISTS (SELECT 1 FROM f_locality AS l WHERE lower(l.canonical_name) = lower(part)) THEN 'locality'
                     ELSE 'other' END AS label
                FROM (SELECT record_id, address, trim(p) AS part, position,
                             regexp_extract(trim(p), '{parse.HOUSE_PART}', 1) AS house
                      FROM (SELECT record_id, address, unnest(parts) AS p, generate_subscripts(parts, 1) AS position
                            FROM (SELECT record_id, address, string_split({_duck_expand('address', text.PARSE_ABBREVIATIONS)}, ',') AS parts FROM (
                                  SELECT record_id, {_ADDRESS_SQL} AS address FROM (SELECT record_id,
                                  {', '.join(f"{_duck_expand(_duck_clean(c), text.NORMALIZE_ABBREVIATIONS)} AS {c}" for c in ('line1', 'line2', 'landmark', 'city', 'district', 'state', 'pincode', 'country'))}
                                  FROM f_record)))) WHERE trim(p) <> '') AS t))
          GROUP BY record_id)"""


@query("k3_parse_addresses", oracle(_PARSE_SQL, "f_record", "f_census", "f_locality"))
def k3(s: Source):
    refs = plans.ReferenceData(s.directory, cut_lineage(s.dictionary), cut_lineage(s.census))
    return plans.add_parsed(plans.normalize_addresses(s.records), refs).select(
        "record_id", *[F.col(f"parsed.{c}").alias(c) for c in (
            "house_number", "street", "locality", "sublocality", "city", "district", "state", "pincode")])


# -- spatial --------------------------------------------------------------------------------

_IN = """longitude > x0 AND longitude < x1 AND latitude > y0 AND latitude < y1
         AND NOT (hx0 IS NOT NULL AND longitude BETWEEN hx0 AND hx1 AND latitude BETWEEN hy0 AND hy1)"""
_INSIDE = """o.x0 <= i.x0 AND o.x1 >= i.x1 AND o.y0 <= i.y0 AND o.y1 >= i.y1
             AND (o.hx0 IS NULL OR o.hx1 <= i.x0 OR o.hx0 >= i.x1 OR o.hy1 <= i.y0 OR o.hy0 >= i.y1)"""
_TREE = f"""SELECT i.osm_id AS city_id, i.name AS city_name, o.name AS district_name, t.name AS state_name,
      i.x0, i.x1, i.y0, i.y1, i.hx0, i.hx1, i.hy0, i.hy1
    FROM f_rect AS i JOIN f_rect AS o ON i.admin_level = 8 AND o.admin_level = 6 AND {_INSIDE}
    JOIN (SELECT d.osm_id AS did, x.name FROM f_rect AS d JOIN f_rect AS x ON d.admin_level = 6 AND x.admin_level = 4
          AND {_INSIDE.replace('o.', 'x.').replace('i.', 'd.')}) AS t ON t.did = o.osm_id"""


@query("c14_validate_hierarchy", oracle("""
    SELECT pincode, CASE WHEN city_name IS NULL THEN 'No containing hierarchy found for coordinates'
      WHEN lower(district_name) <> lower(expected) THEN 'District mismatch: expected ''' || expected || ''', found ''' || district_name || ''''
      ELSE '' END AS errors
    FROM (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN 'Nowhere' ELSE district END AS expected FROM f_pin) LEFT JOIN tree
      ON longitude > x0 AND longitude < x1 AND latitude > y0 AND latitude < y1""", "f_pin", "f_rect", tree=_TREE))
def c14(s: Source):
    df = s.view("f_pin").withColumn("city", F.concat(F.lit("city_"), "s_nationkey")).withColumn(
        "district", F.when(F.col("s_suppkey") % 3 == 0, "Nowhere").otherwise(F.col("district")))
    return spatial.validate_hierarchy(df, s.boundaries).select("pincode", F.array_join("errors", "; ").alias("errors"))


@query("c15_choropleth_state", oracle(f"""
    SELECT osm_id, name, name_en, count(*) AS record_count FROM f_processed JOIN f_rect ON admin_level = 4 AND {_IN}
    GROUP BY osm_id, name, name_en""", "f_processed", "f_rect"))
def c15(s: Source):
    return spatial.choropleth(s.view("f_processed"), s.boundaries, "state")


@query("c15_choropleth_district", oracle(f"""
    SELECT osm_id, name, name_en, count(*) AS record_count FROM f_processed JOIN f_rect ON admin_level = 6 AND {_IN}
    GROUP BY osm_id, name, name_en""", "f_processed", "f_rect"))
def c15_district(s: Source):
    return spatial.choropleth(s.view("f_processed"), s.boundaries, "district")


@query("c16_smallest_boundary", oracle(f"""
    SELECT DISTINCT longitude AS x, latitude AS y, osm_id, name, name_en, admin_level FROM f_pin JOIN f_rect ON admin_level = 8 AND {_IN}""",
    "f_pin", "f_rect"))
def c16(s: Source):
    return spatial.smallest_boundary(spatial.distinct_points(s.view("f_pin")), s.boundaries, 8)


@query("c22_place_admin_names", oracle(f"""
    SELECT s_suppkey AS place_id, max(name) FILTER (admin_level = 4) AS state_name, max(name) FILTER (admin_level = 6) AS district_name,
           max(name) FILTER (admin_level = 8) AS city_name, max(name) FILTER (admin_level = 10) AS village_name
    FROM f_pin LEFT JOIN f_rect ON {_IN} GROUP BY s_suppkey""", "f_pin", "f_rect"))
def c22(s: Source):
    points = s.view("f_pin").select(F.col("s_suppkey").alias("osm_id"), F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    return spatial.place_admin_names(points, s.boundaries)


@query("c23_boundary_containment", oracle(f"""
    SELECT o.osm_id AS outer_id, o.name AS outer_name, i.osm_id AS inner_id, i.name AS inner_name
    FROM f_rect AS o JOIN f_rect AS i ON o.admin_level = 4 AND i.admin_level = 6 AND {_INSIDE}""", "f_rect"))
def c23(s: Source):
    return spatial.boundary_contains(s.boundaries, 4, 6)


# -- counts and quality ---------------------------------------------------------------------

for _name, _column in (("d4_by_review_status", "review_status"), ("d5_by_tier", "confidence_tier")):
    query(_name, oracle(f"SELECT {_column}, count(*) AS row_count FROM f_processed GROUP BY 1", "f_processed"))(
        lambda s, c=_column: jobs.count_by(s.view("f_processed"), c))


@query("d6_chunks_by_status", oracle("SELECT status, count(*) AS row_count FROM f_chunk GROUP BY 1", "f_chunk"))
def d6(s: Source):
    return jobs.count_by(s.view("f_chunk"), "status")


_SHARES = """SELECT {k}, record_count, round(record_count * 100.0::DOUBLE / sum(record_count) OVER (), 2) AS percentage,
    round(record_count * 100.0::DOUBLE / all_records, 2) AS pct_of_all
    FROM (SELECT *, sum(record_count) OVER () AS all_records FROM ({g}) ORDER BY record_count DESC, {k} LIMIT {n})"""


@query("d7_state_distribution", oracle(_SHARES.format(
    k="state", n=3, g="SELECT coalesce(a_state, 'Unknown') AS state, count(*) AS record_count FROM f_processed GROUP BY 1"), "f_processed"))
def d7(s: Source):
    return dashboard.state_distribution(s.view("f_processed").withColumnRenamed("a_state", "state"), limit=3)


@query("d8_district_distribution", oracle(_SHARES.format(
    k="district, state", n=50, g="SELECT coalesce(a_district, 'Unknown') AS district, coalesce(a_state, 'Unknown') AS state, count(*) AS record_count "
    "FROM f_processed GROUP BY 1, 2"), "f_processed"))
def d8(s: Source):
    r = s.view("f_processed").withColumnsRenamed({"a_state": "state", "a_district": "district"})
    return dashboard.district_distribution(r.drop("b_state"))


@query("d8_districts_of_state", oracle(_SHARES.format(
    k="district, state", n=50, g="SELECT coalesce(a_district, 'Unknown') AS district, a_state AS state, count(*) AS record_count "
    "FROM f_processed WHERE lower(a_state) = 'asia' GROUP BY 1, 2"), "f_processed"))
def d8_state(s: Source):
    r = s.view("f_processed").withColumnsRenamed({"a_state": "state", "a_district": "district"})
    return dashboard.district_distribution(r, state="Asia")


_JS = "SELECT j.*, s.* EXCLUDE (job_id) FROM f_job AS j LEFT JOIN f_stats AS s ON s.job_id = j.job_id"


def _jobs_with_stats(s: Source):
    return jobs.with_stats(s.view("f_job"), s.view("f_stats"))


@query("c21_job_with_stats", oracle("SELECT job_id, status, total_rows, total_records, final_quality_score FROM js", "f_job", "f_stats", js=_JS))
def c21(s: Source):
    return _jobs_with_stats(s).select("job_id", "status", "total_rows", "total_records", "final_quality_score")


_KPI = """
    SELECT CAST(sum(total_rows) AS BIGINT) AS total_records, CAST(sum(processed_rows) AS BIGINT) AS processed_records,
           CAST(sum(total_rows - processed_rows) AS BIGINT) AS pending_records, CAST(sum(failed_rows) AS BIGINT) AS failed_records,
           CAST(sum(manual_review_rows) AS BIGINT) AS manual_review_records,
           round(count(*) FILTER (status = 'completed') * 100.0::DOUBLE / count(*) FILTER (done), 2) AS success_rate,
           round(avg(final_quality_score) FILTER (done AND final_quality_score <> 0), 2) AS avg_quality_score,
           round(avg((confidence_high * 92.5::DOUBLE + confidence_medium * 72 + confidence_low * 49.5::DOUBLE + confidence_unverified * 20) / t) FILTER (done AND t > 0), 2) AS avg_confidence,
           round(sum(processing_time) FILTER (done), 2) AS total_processing_time
    FROM (SELECT *, status IN ('completed', 'failed', 'cancelled') AS done,
                 confidence_high + confidence_medium + confidence_low + confidence_unverified AS t FROM js)"""


@query("d9_kpi_overview", oracle(_KPI, "f_job", "f_stats", js=_JS))
def d9(s: Source):
    return dashboard.kpi_overview(_jobs_with_stats(s))


_BEFORE_SQL = ", ".join(f"CAST(sum({c}_before) AS BIGINT) AS before_{c}" for c in dashboard._BEFORE)
_AFTER_SQL = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in dashboard._AFTER)


_COMPARISON = f"""
    SELECT CAST(sum(total_rows) FILTER (total_records IS NOT NULL) AS BIGINT) AS total_records, {_BEFORE_SQL}, {_AFTER_SQL},
           round(avg(coalesce(overall_quality_before, 0)), 2) AS before_quality_pct, round(avg(coalesce(final_quality_score, 0)), 2) AS after_quality_pct,
           round(avg(coalesce(final_quality_score, 0)) - avg(coalesce(overall_quality_before, 0)), 2) AS quality_improvement,
           round(sum(pincodes_added + cities_added + districts_added + states_added) * 100.0::DOUBLE / sum(total_rows) FILTER (total_records IS NOT NULL), 2) AS fill_rate
    FROM js"""


@query("d10_quality_comparison", oracle(_COMPARISON, "f_job", "f_stats", js=_JS))
def d10(s: Source):
    return dashboard.quality_comparison(_jobs_with_stats(s))


_TIER_TOTALS = "SELECT " + ", ".join(
    f"CAST(sum(confidence_{t}) AS BIGINT) AS {t}" for t in ("high", "medium", "low", "unverified")) + " FROM f_stats"


@query("d11_tier_totals", oracle(_TIER_TOTALS, "f_stats"))
def d11(s: Source):
    return dashboard.tier_totals(s.view("f_stats"))


_THROUGHPUT = """
    SELECT CAST(completed_at AS DATE) AS date, count(*) AS jobs_processed, CAST(sum(processed_rows) AS BIGINT) AS records_processed,
           round(CASE WHEN coalesce(sum(processing_time), 0) = 0 THEN 0.0::DOUBLE ELSE sum(processed_rows)::DOUBLE / sum(processing_time) END, 2) AS avg_records_per_second,
           round(coalesce(sum(processing_time), 0.0::DOUBLE) / count(*), 2) AS avg_processing_time_seconds
    FROM js WHERE status = 'completed' AND completed_at >= TIMESTAMP '2001-08-01' - INTERVAL 365 DAY GROUP BY 1"""


@query("d12_daily_throughput", oracle(_THROUGHPUT, "f_job", "f_stats", js=_JS))
def d12(s: Source):
    return dashboard.daily_throughput(_jobs_with_stats(s), ASOF, 365)


_FAILURES = """
    SELECT coalesce(error_message, 'processing_error') AS category, count(*) AS error_count FROM f_chunk WHERE status = 'failed' GROUP BY 1"""


@query("d13_failure_categories", oracle(_FAILURES, "f_chunk"))
def d13(s: Source):
    return dashboard.failure_categories(s.view("f_chunk"))


@query("d14_audit_summary", oracle("""
    SELECT CASE WHEN g = 3 THEN 'total' WHEN g = 1 THEN 'method' ELSE 'field' END AS dimension,
           CASE WHEN g = 1 THEN processing_method WHEN g = 2 THEN field_name END AS value, changes, avg_confidence, user_overrides
    FROM (SELECT processing_method, field_name, grouping(processing_method, field_name) AS g, count(*) AS changes,
                 round(avg(confidence), 2) AS avg_confidence, count(user_id) AS user_overrides
          FROM f_audit GROUP BY GROUPING SETS ((processing_method), (field_name), ()))""", "f_audit"))
def d14(s: Source):
    return audit.audit_summary(s.view("f_audit"))


_SIDE_FIELDS = ("pincode", "locality", "city", "district", "state")


def _baseline_sql(p: str) -> str:
    missing = [f"count(*) FILTER (coalesce(trim({p}_{f}), '') = '')" for f in _SIDE_FIELDS]
    cols = ", ".join(f"{m} AS missing_{f}" for m, f in zip(missing, _SIDE_FIELDS))
    complete = " AND ".join(f"coalesce(trim({p}_{f}), '') <> ''" for f in _SIDE_FIELDS)
    key = "lower(concat_ws('|', " + ", ".join(f"coalesce({p}_{f}, '')" for f in ("line1",) + _SIDE_FIELDS) + "))"
    return f"""SELECT count(*) AS total_records, count(*) FILTER ({complete}) AS complete_addresses, {cols},
        count(*) FILTER (coalesce({p}_pincode, '') <> '' AND NOT {p}_pincode SIMILAR TO '[1-8][0-9]{{5}}') AS invalid_addresses,
        count(*) - count(DISTINCT {key}) AS duplicate_addresses,
        round((5 * count(*) - ({' + '.join(missing)})) * 100.0::DOUBLE / (5 * count(*)), 2) AS overall_quality_pct FROM f_processed"""


@query("d15_quality_baseline", oracle(_baseline_sql("b"), "f_processed"))
def d15(s: Source):
    return quality.quality_baseline(s.processed.select("before.*"), ["line1", *_SIDE_FIELDS])


@query("d17_quality_measured_after", oracle(_baseline_sql("a"), "f_processed"))
def d17(s: Source):
    return quality.quality_baseline(s.processed.select("after.*"), ["line1", *_SIDE_FIELDS])


@query("d17_fields_added", oracle("SELECT " + ", ".join(
    f"count(*) FILTER (b_{f} IS NULL AND a_{f} IS NOT NULL) AS {f}_added, count(*) FILTER (b_{f} <> a_{f}) AS {f}_corrected" for f in _SIDE_FIELDS)
    + " FROM f_processed", "f_processed"))
def d17_added(s: Source):
    return quality.fields_added(s.processed, "before", "after")


@query("d18_completeness_and_fill_rate", oracle("""
    SELECT job_id, complete_addresses_before * 100.0::DOUBLE / total_records AS completeness_pct,
           (total_records - missing_pincode_before) * 100.0::DOUBLE / total_records AS pincode_fill_rate FROM f_stats""", "f_stats"))
def d18(s: Source):
    return s.view("f_stats").select("job_id", *quality.completeness_rates(
        F.col("total_records"), F.col("complete_addresses_before"), F.col("missing_pincode_before")))


@query("d19_chunk_results", oracle("""
    SELECT job_id, chunk_index, count(*) AS processed, count(*) FILTER (overall >= 60) AS succeeded, count(*) FILTER (overall < 60) AS failed
    FROM f_processed GROUP BY 1, 2""", "f_processed"))
def d19(s: Source):
    return jobs.chunk_results(s.view("f_processed"))


@query("d20_locality_dictionary", oracle("""
    SELECT canonical_name, pincode, district, state, arg_min(source, priority) AS source, median(latitude) AS latitude,
           max(population) AS population, count(*) > 0 AS built
    FROM (SELECT replace(upper(substr(locality, 1, 1)), 'ẞ', 'Ss') || substr(locality, 2) AS canonical_name, p.pincode, p.district, p.state, CAST(NULL AS VARCHAR) AS city,
                 f.latitude, CAST(NULL AS BIGINT) AS population, 'india_post' AS source, 0 AS priority
          FROM f_pin_locality AS p JOIN f_pin AS f ON f.pincode = p.pincode
          UNION ALL SELECT replace(upper(substr(canonical_name, 1, 1)), 'ẞ', 'Ss') || substr(canonical_name, 2) AS canonical_name, pincode, district, state, city, latitude, NULL, 'osm', 1 FROM f_locality
          UNION ALL SELECT replace(upper(substr(canonical_name, 1, 1)), 'ẞ', 'Ss') || substr(canonical_name, 2) AS canonical_name, pincode, district, state, NULL, latitude, population, 'census', 2 FROM f_locality)
    GROUP BY canonical_name, pincode, city, district, state""", "f_pin_locality", "f_pin", "f_locality"))
def d20(s: Source):
    villages = s.dictionary.select(F.col("canonical_name").alias("village_name"), "pincode", F.col("district").alias("district_name"),
                                   F.col("state").alias("state_name"), "latitude", "longitude", "population")
    places = s.dictionary.select(F.col("canonical_name").alias("name"), F.try_element_at("aliases", F.lit(1)).alias("alt_name"),
                                 "pincode", "city", "district", "state", "latitude", "longitude")
    built = dictionary.build_dictionary(dictionary.from_post_offices(s.directory), dictionary.from_places(places),
                                        dictionary.from_census(villages))
    return built.select("canonical_name", "pincode", "district", "state", "source", "latitude", "population",
                        (F.col("id") > 0).alias("built"))


@query("g2_union_of_sources", oracle("""
    SELECT source, count(*) AS n, count(city) AS with_city, count(population) AS with_population FROM (
      SELECT 'india_post' AS source, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS BIGINT) AS population FROM f_pin_locality
      UNION ALL SELECT 'osm', city, NULL FROM f_locality UNION ALL SELECT 'census', NULL, population FROM f_locality) GROUP BY 1""",
    "f_pin_locality", "f_locality"))
def g2(s: Source):
    villages = s.dictionary.select(F.col("canonical_name").alias("village_name"), "pincode", F.col("district").alias("district_name"),
                                   F.col("state").alias("state_name"), "latitude", "longitude", "population")
    places = s.dictionary.select(F.col("canonical_name").alias("name"), F.lit(None).cast("string").alias("alt_name"),
                                 "pincode", "city", "district", "state", "latitude", "longitude")
    whole = dictionary.combine_sources(dictionary.from_post_offices(s.directory), dictionary.from_places(places),
                                       dictionary.from_census(villages))
    return whole.groupBy("source").agg(F.count("*").alias("n"), F.count("city").alias("with_city"), F.count("population").alias("with_population"))


@query("g3_array_dedup", oracle("SELECT id, len(list_distinct([alias, alias, lower(canonical_name)])) AS names FROM f_locality", "f_locality"))
def g3(s: Source):
    both = F.concat("aliases", "aliases", F.array(F.lower("canonical_name")))
    return s.dictionary.select("id", F.size(F.array_distinct(both)).cast("bigint").alias("names"))


@query("d21_duplicate_addresses", oracle("""
    SELECT address, row_count FROM (SELECT lower(concat_ws('|', coalesce(b_line1, ''), coalesce(b_locality, ''), coalesce(b_city, ''))) AS address, count(*) AS row_count
    FROM f_processed GROUP BY 1) WHERE row_count > 1""", "f_processed"))
def d21(s: Source):
    key = quality.address_key(F.col("b_line1"), F.col("b_locality"), F.col("b_city"))
    return quality.duplicates(s.view("f_processed"), [key], ["address"])


@query("d21_duplicate_patients", "SELECT patient, row_count FROM (SELECT o_custkey AS patient, count(*) AS row_count FROM orders GROUP BY 1) WHERE row_count > 1")
def d21_patients(s: Source):
    return quality.duplicates(s.table("orders"), [F.col("o_custkey")], ["patient"])


@query("d22_row_counts", oracle("SELECT (SELECT count(*) FROM f_pin) AS pins, (SELECT count(*) FROM f_locality) AS localities", "f_pin", "f_locality"))
def d22(s: Source):
    pins = s.view("f_pin").agg(F.count("*").alias("pins"))
    return pins.select("pins", s.dictionary.agg(F.count("*")).scalar().alias("localities"))


_COUNT = "({})".format(" + ".join("CAST({0}_" + f + " IS NOT NULL AS INT)" for f in _SIDE_FIELDS))


@query("d23_improvement", oracle(f"""
    SELECT CASE WHEN a > b THEN 'improved' WHEN a < b THEN 'degraded' ELSE 'unchanged' END AS change, count(*) AS record_count
    FROM (SELECT {_COUNT.format('a')} AS a, {_COUNT.format('b')} AS b FROM f_processed) GROUP BY 1""", "f_processed"))
def d23(s: Source):
    return quality.improvement(s.processed, "before", "after")


@query("d24_tier_flow", oracle("SELECT tier_before, confidence_tier AS tier_after, count(*) AS record_count FROM f_processed GROUP BY 1, 2", "f_processed"))
def d24(s: Source):
    return quality.tier_flow(s.view("f_processed").withColumnRenamed("confidence_tier", "tier_after"))


@query("d25_drill_down", oracle("""
    SELECT state, district, city, locality, CAST(grouping(state, district, city, locality) AS INT) AS level_mask, count(*) AS record_count
    FROM (SELECT coalesce(a_state, 'Unknown') AS state, coalesce(a_district, 'Unknown') AS district, coalesce(a_city, 'Unknown') AS city,
          coalesce(a_locality, 'Unknown') AS locality FROM f_processed) GROUP BY ROLLUP (state, district, city, locality)""", "f_processed"))
def d25(s: Source):
    return dashboard.drill_down(s.processed.select("after.*"))


@query("d26_completeness_over_time", oracle(" UNION ALL ".join(f"""
    SELECT CAST(created_at AS DATE) AS date, count(*) AS total, 'b_{f}' AS column_name, count(b_{f}) AS filled,
           round(count(b_{f}) * 100.0::DOUBLE / count(*), 2) AS completeness FROM f_processed GROUP BY 1""" for f in ("pincode", "city", "state")), "f_processed"))
def d26(s: Source):
    return dashboard.completeness_over_time(s.view("f_processed"), ["b_pincode", "b_city", "b_state"])


@query("d26_top_mismatches", oracle("""
    SELECT 'District mismatch: expected ?, found ?' AS pattern, count(*) AS record_count FROM f_processed
      JOIN tree ON longitude > x0 AND longitude < x1 AND latitude > y0 AND latitude < y1
    WHERE coalesce(b_district, '') <> '' AND lower(b_district || 'x') <> lower(district_name)
    UNION ALL SELECT 'No containing hierarchy found for coordinates', count(*) FROM f_processed WHERE NOT EXISTS (
      SELECT 1 FROM tree WHERE longitude > x0 AND longitude < x1 AND latitude > y0 AND latitude < y1)""", "f_processed", "f_rect", tree=_TREE))
def d26_top(s: Source):
    df = s.view("f_processed").select("latitude", "longitude", F.col("b_city").alias("city"),
                                      F.concat("b_district", F.lit("x")).alias("district"), F.col("b_state").alias("state"))
    return dashboard.top_mismatches(spatial.validate_hierarchy(df, s.boundaries))


@query("d28_stage_times", oracle(" UNION ALL ".join(
    f"SELECT '{x}' AS stage, sum({x}_time) AS seconds FROM f_stats" for x in ("profiling", "processing", "reporting", "export")), "f_stats"))
def d28(s: Source):
    return jobs.stage_times(s.view("f_stats"))


@query("d29_pin_problems", oracle("""
    SELECT r.pincode, CASE WHEN r.pincode IS NULL THEN 'missing' WHEN NOT r.pincode SIMILAR TO '[1-8][0-9]{5}' THEN 'malformed'
           WHEN p.pincode IS NULL THEN 'unknown' ELSE 'ok' END AS problem, row_count, r.pincode IS NOT NULL AND row_count > 100 AS shared
    FROM (SELECT b_pincode AS pincode, count(*) AS row_count FROM f_processed GROUP BY 1) AS r LEFT JOIN f_pin AS p ON p.pincode = r.pincode""",
    "f_processed", "f_pin"))
def d29(s: Source):
    return pincode.pin_problems(s.view("f_processed").select(F.col("b_pincode").alias("pincode")), s.pins, 100)


# -- jobs, pages, audit ---------------------------------------------------------------------

@query("c19_rows_to_resume", oracle("""
    SELECT record_id FROM (SELECT o_orderkey AS record_id, CAST(o_orderkey AS VARCHAR) AS job_id, CAST(o_custkey % 7 + 1 AS INT) AS chunk_index FROM orders) AS r
    WHERE NOT EXISTS (SELECT 1 FROM f_chunk AS c WHERE c.status = 'completed' AND c.job_id = r.job_id AND c.chunk_index = r.chunk_index)""", "f_chunk"))
def c19(s: Source):
    rows = s.table("orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderkey").cast("string").alias("job_id"),
                                    (F.col("o_custkey") % 7 + 1).cast("int").alias("chunk_index"))
    return jobs.rows_to_resume(rows, s.view("f_chunk")).select("record_id")


@query("g5_chunks_to_resume", oracle("SELECT job_id, chunk_index FROM f_chunk EXCEPT SELECT job_id, chunk_index FROM f_chunk WHERE status = 'completed'", "f_chunk"))
def g5(s: Source):
    return jobs.chunks_to_resume(s.view("f_chunk"))


@query("c20_record_trail", oracle("""
    SELECT id, record_id, field_name FROM f_audit WHERE record_id IN (SELECT s_suppkey FROM f_pin WHERE office_type = 'head')""", "f_audit", "f_pin"))
def c20(s: Source):
    heads = s.view("f_pin").filter("office_type = 'head'").select(F.col("s_suppkey").alias("record_id"))
    return audit.record_trail(s.view("f_audit"), heads).select("id", "record_id", "field_name")


@query("f1_record_page", oracle("SELECT record_id, row_index FROM f_processed WHERE job_id = 'job_3' AND confidence_tier = 'low' ORDER BY row_index LIMIT 50 OFFSET 10",
                                "f_processed"))
def f1(s: Source):
    return lookups.record_page(s.view("f_processed"), "job_3", 10, 50, confidence_tier="low").select("record_id", "row_index")


@query("f2_recent_jobs", oracle("""
    SELECT job_id, status, strftime(created_at, '%Y-%m-%d') AS created FROM f_job ORDER BY created_at DESC, job_id DESC LIMIT 10""", "f_job"))
def f2(s: Source):
    return lookups.recent_jobs(s.view("f_job")).select("job_id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("f2_report_list", oracle("""
    SELECT job_id, filename FROM f_job WHERE status = 'completed' ORDER BY created_at DESC, job_id DESC LIMIT 20""", "f_job"))
def f2_reports(s: Source):
    return lookups.recent_jobs(s.view("f_job"), 20, status="completed").select("job_id", "filename")


@query("f6_audit_page", oracle("SELECT id, field_name FROM f_audit WHERE job_id = 'job_2' ORDER BY created_at, id LIMIT 100 OFFSET 50", "f_audit"))
def f6(s: Source):
    return audit.audit_page(s.view("f_audit"), "job_2", 50, 100).select("id", "field_name")


@query("f8_pending_chunks", oracle("SELECT job_id, chunk_index, row_count FROM f_chunk WHERE status = 'pending'", "f_chunk"))
def f8(s: Source):
    return lookups.pending_chunks(s.view("f_chunk")).select("job_id", "chunk_index", "row_count")


@query("k12_job_progress", oracle("""
    SELECT *, CASE WHEN completed_chunks = total_chunks THEN 'completed' WHEN completed_chunks + failed_chunks = total_chunks THEN 'failed'
           WHEN pending_chunks = total_chunks THEN 'queued' ELSE 'processing' END AS status,
           round(processed_rows * 100.0::DOUBLE / total_rows, 2) AS progress_pct
    FROM (SELECT job_id, count(*) AS total_chunks, count(*) FILTER (status = 'completed') AS completed_chunks, count(*) FILTER (status = 'failed') AS failed_chunks,
          count(*) FILTER (status = 'pending') AS pending_chunks, CAST(sum(row_count) AS BIGINT) AS total_rows,
          CAST(coalesce(sum(row_count) FILTER (status = 'completed'), 0) AS BIGINT) AS processed_rows FROM f_chunk GROUP BY job_id)""", "f_chunk"))
def k12(s: Source):
    return jobs.job_progress(s.view("f_chunk"))


_DECISIONS = """SELECT user_id AS record_id, CASE WHEN event_type = 'purchase' THEN 'manual_verified' ELSE 'rejected' END AS review_status,
    'user_' || CAST(event_id % 9 AS VARCHAR) AS reviewed_by, ts AS reviewed_at FROM events WHERE event_type IN ('purchase', 'error')"""


def _review_frames(s: Source):
    base = s.view("f_processed").select("record_id", "job_id", "review_status", F.lit(None).cast("string").alias("reviewed_by"),
                                        F.lit(None).cast("timestamp_ntz").alias("reviewed_at"), F.lit(None).cast("string").alias("review_notes"))
    decisions = s.table("events").filter("event_type IN ('purchase', 'error')").select(
        F.col("user_id").alias("record_id"), F.when(F.col("event_type") == "purchase", "manual_verified").otherwise("rejected").alias("review_status"),
        F.concat(F.lit("user_"), (F.col("event_id") % 9).cast("string")).alias("reviewed_by"), F.col("ts").alias("reviewed_at"),
        F.lit("note").alias("review_notes"))
    return base, decisions


@query("k11_apply_reviews", oracle("""
    SELECT r.record_id, coalesce(d.review_status, r.review_status) AS review_status, d.reviewed_by FROM f_processed AS r LEFT JOIN (
      SELECT * FROM decisions QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY reviewed_at DESC, review_status DESC) = 1) AS d
      ON d.record_id = r.record_id""", "f_processed", decisions=_DECISIONS))
def k11(s: Source):
    reviewed, _ = results.review_records(*_review_frames(s), ASOF)
    return reviewed.select("record_id", "review_status", "reviewed_by")


@query("k11_review_audit", oracle("""
    SELECT r.record_id, r.review_status AS old_value, d.review_status AS new_value, 'manual_override' AS processing_method, d.reviewed_by AS user_id
    FROM f_processed AS r JOIN (SELECT * FROM decisions QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY reviewed_at DESC, review_status DESC) = 1) AS d
      ON d.record_id = r.record_id WHERE d.review_status <> r.review_status""", "f_processed", decisions=_DECISIONS))
def k11_audit(s: Source):
    _, trail = results.review_records(*_review_frames(s), ASOF)
    return trail.select("record_id", "old_value", "new_value", "processing_method", "user_id")


@query("k6_changed_fields", oracle(" UNION ALL ".join(f"""
    SELECT record_id, '{f}' AS field_name, b_{f} AS old_value, a_{f} AS new_value, CASE WHEN b_{f} IS NULL THEN 'hierarchy_enrichment' ELSE 'spell_correction' END AS processing_method,
           overall AS confidence FROM f_processed WHERE b_{f} IS DISTINCT FROM a_{f}""" for f in _SIDE_FIELDS), "f_processed"))
def k6(s: Source):
    changes = [audit.change(f, F.col(f"before.{f}"), F.col(f"after.{f}"),
                            F.when(F.col(f"before.{f}").isNull(), "hierarchy_enrichment").otherwise("spell_correction"),
                            F.col("overall"), "census") for f in _SIDE_FIELDS]
    return audit.changed_fields(s.processed, changes, created_at=F.lit(ASOF)).select(
        "record_id", "field_name", "old_value", "new_value", "processing_method", "confidence")


# What the report says before a job, what it subtracts for the value after it, and what the job changed.
_COUNTED = {"complete_addresses": None, "missing_pincode": "pincodes_added", "missing_locality": "cities_added", "missing_city": "cities_added",
            "missing_district": "districts_added", "missing_state": "states_added", "invalid_addresses": "improved_records"}
_CHANGED = ("pincodes_added", "cities_added", "districts_added", "states_added", "spell_corrections", "improved_records", "manual_review_records")
_TIERS = ("high", "medium", "low", "unverified")


def _report_sql() -> str:
    """SQL for all columns of the report."""
    after = {m: f"greatest(0, {m}_before - {by})" for m, by in _COUNTED.items() if by}
    after |= {"complete_addresses": "complete_addresses_before + improved_records", "duplicate_addresses": "duplicate_addresses_before"}
    columns = ["job_id", "total_records", "overall_quality_before AS before_overall_quality_pct", "final_quality_score AS after_overall_quality_pct",
               "improvement_percentage AS delta_quality_improvement_pct",
               "CAST(pincodes_added + cities_added + districts_added + states_added AS DOUBLE) / CASE total_records WHEN 0 THEN 1 ELSE total_records END * 100 AS delta_fill_rate"]
    columns += [f"{m}_before AS before_{m}" for m in after] + [f"{v} AS after_{m}" for m, v in after.items()]
    columns += [f"{c} AS delta_{c}" for c in _CHANGED] + [f"confidence_{c}" for c in _TIERS]
    return f"SELECT {', '.join(columns)} FROM f_stats"


@query("d16_report_from_stats", oracle(_report_sql(), "f_stats"))
def d16(s: Source):
    return quality.report_from_stats(s.view("f_stats"))


def _report_rows_sql() -> str:
    measured = [*_COUNTED, "duplicate_addresses", "overall_quality_pct"]
    rows = ["SELECT job_id, 'total_records' AS metric, total_records::DOUBLE AS before, total_records::DOUBLE AS after, NULL::DOUBLE AS delta FROM r"]
    rows += [f"SELECT job_id, '{m}', before_{m}::DOUBLE, after_{m}::DOUBLE, NULL FROM r" for m in measured]
    rows += [f"SELECT job_id, '{c}', NULL, NULL, delta_{c}::DOUBLE FROM r" for c in (*_CHANGED, "quality_improvement_pct", "fill_rate")]
    return " UNION ALL ".join(rows)


@query("a13_report_rows", oracle(_report_rows_sql(), "f_stats", r=_report_sql()))
def a13(s: Source):
    return quality.report_rows(quality.report_from_stats(s.view("f_stats")))


# Section and field of the JSON report, the column of the report it holds, and its type.
_JSON = [("before", "total_records", "total_records", "bigint"), ("before", "overall_quality_pct", "before_overall_quality_pct", "double"),
         *[("before", m, f"before_{m}", "bigint") for m in (*_COUNTED, "duplicate_addresses")],
         *[("after", c, f"delta_{c}", "bigint") for c in _CHANGED], ("after", "final_quality_pct", "after_overall_quality_pct", "double"),
         *[("delta", c, f"delta_{c}", "double") for c in ("quality_improvement_pct", "fill_rate")],
         *[("confidence_distribution", c, f"confidence_{c}", "bigint") for c in _TIERS]]


@query("a13_report_json", oracle(
    f"SELECT job_id, {', '.join(f'{c} AS {section}_{field}' for section, field, c, _ in _JSON)} FROM r JOIN f_job USING (job_id) WHERE status = 'completed'",
    "f_stats", "f_job", r=_report_sql()))
def a13_json(s: Source):
    doc = quality.report_json(results.job_report(s.view("f_stats"), s.view("f_job")))
    return doc.select("job_id", *[F.get_json_object("report", f"$.{section}.{field}").cast(kind).alias(f"{section}_{field}") for section, field, _, kind in _JSON])


# -- batch twins of the streams -------------------------------------------------------------

_EVENTS = """SELECT CAST(l_orderkey AS VARCHAR) AS job_id, l_linenumber AS chunk_index, CAST(l_quantity AS BIGINT) AS row_count, CAST(500 AS BIGINT) AS total_rows,
    CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END AS status, CAST(l_shipdate AS TIMESTAMP) AS event_time FROM lineitem"""


def chunk_events(s: Source):
    """Chunk events of all line items; a chunk that occurs again is a retry."""
    return s.table("lineitem").select(
        F.col("l_orderkey").cast("string").alias("job_id"), F.col("l_linenumber").alias("chunk_index"),
        F.col("l_quantity").cast("bigint").alias("row_count"), F.lit(500).cast("bigint").alias("total_rows"),
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("completed").alias("status"),
        F.col("l_shipdate").cast("timestamp").alias("event_time"))


@query("i1_progress_snapshot", oracle("""
    SELECT job_id, CAST(sum(row_count) AS BIGINT) AS processed, max(total_rows) AS total_rows, count(*) AS completed_chunks,
           round(sum(row_count) * 100.0::DOUBLE / max(total_rows), 2) AS progress_pct
    FROM (SELECT * FROM e WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY job_id, chunk_index ORDER BY event_time, row_count) = 1)
    GROUP BY job_id""", e=_EVENTS))
def i1(s: Source):
    return progress.progress_snapshot(chunk_events(s)).select("job_id", "processed", "total_rows", "completed_chunks", "progress_pct")


@query("i1_failed_attempts", oracle("SELECT job_id, count(*) AS failed_attempts FROM e WHERE status = 'failed' GROUP BY 1", e=_EVENTS))
def i1_failed(s: Source):
    return progress.failed_attempts(chunk_events(s))


@query("i2_incremental_enrichment", oracle(
    "SELECT record_id, job_id, record_id % 3 AS chunk_index, replace(upper(typed), 'ẞ', 'SS') AS enriched FROM f_record", "f_record"))
def i2(s: Source):
    """A stream over files that each hold a part of every chunk, one file per micro-batch."""
    root = s.scratch()
    rows = s.view("f_record").select("record_id", "job_id", (F.col("record_id") % 3).alias("chunk_index"), "typed")
    for part in range(3):
        rows.filter(F.col("record_id") % 7 % 3 == part).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = s.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    progress.enrich_incrementally(stream, lambda b: b.withColumn("enriched", F.upper("typed")).drop("typed"), f"{root}/out", f"{root}/log").awaitTermination()
    return s.spark.read.parquet(f"{root}/out").select("record_id", F.col("job_id").cast("string").alias("job_id"), F.col("chunk_index").cast("bigint").alias("chunk_index"), "enriched")


@query("i3_events_per_day", """
    SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type, count(*) AS event_count FROM events GROUP BY 1, 2""")
def i3(s: Source):
    e = s.table("events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return progress.events_per_bucket(e).select(F.date_format("bucket_start", "yyyy-MM-dd").alias("day"), "event_type", "event_count")


@query("i4_stalled_jobs", oracle("""
    SELECT job_id, CAST(date_diff('second', max(event_time), TIMESTAMP '2001-08-01') AS BIGINT) AS idle_seconds FROM e GROUP BY 1
    HAVING date_diff('second', max(event_time), TIMESTAMP '2001-08-01') > 86400""", e=_EVENTS))
def i4(s: Source):
    return jobs.stalled_jobs(chunk_events(s), F.lit(ASOF), 86_400).select("job_id", "idle_seconds")


@query("i4_job_states", oracle("""
    SELECT job_id, CASE WHEN processed >= 100 THEN 'finished' WHEN last_event + INTERVAL 60 SECOND < newest - INTERVAL 1 HOUR THEN 'stalled' ELSE 'running' END AS state
    FROM (SELECT job_id, max(event_time) AS last_event FROM e GROUP BY 1)
    LEFT JOIN (SELECT job_id, sum(row_count) AS processed
               FROM (SELECT * FROM e WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY job_id, chunk_index ORDER BY event_time, row_count) = 1)
               GROUP BY 1) USING (job_id), (SELECT max(event_time) AS newest FROM e)""", e=_EVENTS))
def i4_states(s: Source):
    """A stream over the events in order of time, with jobs of 100 rows; the newest state of every job."""
    root, files = s.scratch(), 4
    events = chunk_events(s).withColumn("total_rows", F.lit(100).cast("bigint"))
    low, high = events.agg(F.min("event_time"), F.max("event_time")).first()
    half = F.lit(low + (high - low) / 2)
    for part in (F.col("event_time") < half, F.col("event_time") >= half):
        events.filter(part).repartition(files).write.mode("append").parquet(f"{root}/in")
    stream = s.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    progress.follow_job_states(stream, f"{root}/out", f"{root}/log", forget_seconds=10 * 366 * 86_400, watermark="1 hour").awaitTermination()
    return progress.newest_states(s.spark.read.parquet(f"{root}/out")).select("job_id", "state")


_OF_USER = "job_id IN (SELECT job_id FROM f_job WHERE user_id = 7)"
_PACK = {
    "overview": _KPI, "quality": _COMPARISON, "confidence": _TIER_TOTALS,
    "states": _SHARES.format(k="state", n=36, g="SELECT coalesce(nullif(state, ''), 'Unknown') AS state, count(*) AS record_count FROM shown GROUP BY 1"),
    "districts": _SHARES.format(k="district, state", n=50, g="SELECT coalesce(nullif(district, ''), 'Unknown') AS district, "
                                "coalesce(nullif(state, ''), 'Unknown') AS state, count(*) AS record_count FROM shown GROUP BY 1, 2"),
    "performance": _THROUGHPUT, "errors": _FAILURES,
    "recent_jobs": "SELECT job_id, status, filename FROM j ORDER BY created_at DESC, job_id DESC LIMIT 10",
    "reports": "SELECT job_id, status, filename FROM j WHERE status = 'completed' ORDER BY created_at DESC, job_id DESC LIMIT 10",
}


def _pack_twin(body: str, where: str) -> str:
    tables = {
        "j": f"SELECT * FROM f_job WHERE {where}", "st": f"SELECT * FROM f_stats WHERE {where}", "ch": f"SELECT * FROM f_chunk WHERE {where}",
        "shown": f"SELECT state, district FROM (SELECT a_state AS state, a_district AS district, CAST(record_id AS VARCHAR) AS job_id FROM f_processed) AS p WHERE {where}",
        "js": "SELECT j.*, st.* EXCLUDE (job_id) FROM j LEFT JOIN st ON st.job_id = j.job_id"}
    return oracle(body.replace("f_stats", "st").replace("f_chunk", "ch"), "f_job", "f_stats", "f_chunk", "f_processed", **tables)


def _pack_frame(s: Source, frame: str, of_user: bool):
    all_jobs = s.view("f_job")
    shown = s.view("f_processed").select(F.col("a_state").alias("state"), F.col("a_district").alias("district"), F.col("record_id").cast("string").alias("job_id"))
    pack = results.dashboard_pack(all_jobs, s.view("f_stats"), shown, s.view("f_chunk"), ASOF,
                                  only=all_jobs.filter("user_id = 7") if of_user else None, days=365)
    return pack[frame].select("job_id", "status", "filename") if frame in ("recent_jobs", "reports") else pack[frame]


for _frame, _body in _PACK.items():
    query(f"k13_dashboard_{_frame}", _pack_twin(_body, "true"))(lambda s, f=_frame: _pack_frame(s, f, False))
    query(f"k13_dashboard_{_frame}_of_jobs", _pack_twin(_body, _OF_USER))(lambda s, f=_frame: _pack_frame(s, f, True))


# -- whole flow -----------------------------------------------------------------------------

@query("k4_enrich_addresses")
def k4(s: Source):
    parsed = plans.add_parsed(plans.normalize_addresses(s.records.drop("patient_id")), s.references)
    return plans.enrich_addresses(parsed, s.references).select(
        "record_id", *[F.col(f"enriched.{c}").alias(c) for c in ("line1", "locality", "city", "district", "state", "pincode", "formatted")],
        "pin_resolved", "pin_inferred", F.round("locality_score", 6).alias("locality_score"), F.size("errors").alias("error_count"))


@query("k7_process_records")
def k7(s: Source):
    done = plans.process_records(s.records, s.references, salt="a secret salt")
    return done.select("record_id", "job_id", "patient_id_hash", "confidence.*", "review_status")


@query("k7_audit_rows")
def k7_audit(s: Source):
    done = plans.process_records(s.records, s.references, salt="a secret salt")
    return plans.record_changes(done, ASOF)


@query("k8_job_quality_report")
def k8(s: Source):
    stats = results.job_quality_stats(plans.process_records(s.records, s.references, salt="a secret salt"))
    return quality.report_rows(quality.report_from_stats(stats))


_STATES = f"""
    SELECT state, record_count, round(record_count * 100.0::DOUBLE / sum(record_count) OVER (), 2) AS percentage,
           round(record_count * 100.0::DOUBLE / sum(record_count) OVER (), 2) AS pct_of_all
    FROM (SELECT coalesce(nullif(coalesce({_duck_clean('r.state')}, p.state), ''), 'Unknown') AS state, count(*) AS record_count
          FROM f_record AS r LEFT JOIN f_pin AS p ON p.pincode = r.pincode GROUP BY 1) ORDER BY record_count DESC, state LIMIT 36"""


@query("flagship_records_per_state", oracle(_STATES, "f_record", "f_pin"))
def flagship(s: Source):
    """Records per state with share: normalise, resolve the PIN, merge the context, count."""
    rows = plans.normalize_addresses(s.records).select(
        "record_id", F.col("normalized.state").alias("state"),
        F.coalesce("normalized.pincode", text.last_pin(plans.full_text())).alias("pincode"))
    merged = pincode.resolve_pins(rows, s.pins).select(first_non_empty(F.col("state"), F.col("pin_state")).alias("state"))
    return dashboard.state_distribution(merged)
