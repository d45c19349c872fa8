"""Queries over scalar functions, sources and sinks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pataspark.functions import geo, privacy, scoring, similarity as sim, text
from pataspark.operators import chunking, profile
from pataspark.plans import address as plans, results
from pataspark.schemas import ColumnMapping
from pataspark.sources import readers, versions, writers
from pataspark.workload.base import Source, duck_token_parts, duck_token_set, oracle, query


def _duck_expand(expr: str, rules) -> str:
    # Neighbours share the character between them, so a second pass takes every other one.
    for short, full in [r for r in rules for _ in range(2)]:
        expr = f"regexp_replace({expr}, '(^|[^\\p{{L}}\\p{{N}}_]){short}($|[^\\p{{L}}\\p{{N}}_])', '\\1{full}\\2', 'gi')"
    return expr


def _duck_clean(expr: str) -> str:
    return f"nullif(trim(regexp_replace({expr}, '\\s+', ' ', 'g')), '')"


def _one_byte(expr: str) -> str:
    """Small letters beyond ASCII as capitals, for SQL functions that compare bytes."""
    return f"translate({expr}, 'áàâäãéèêëíìîïóòôöõúùûüñçß', 'ABCDEFGHIJKLMNOPQRSTUVWXY')"


def _half_up(expr: str) -> str:
    """Round the shortest decimal form of a double half-up to two places, as the library does."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 12)), 2) AS DOUBLE)"


PIN_LIST = "regexp_extract_all({0}, '\\b[1-8][0-9]{{5}}\\b')"


def _duck_last_pin(expr: str) -> str:
    return f"list_extract({PIN_LIST.format(expr)}, -1)"


# -- sources and sinks ----------------------------------------------------------------------

@query("a1_csv_source", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, "
       "CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) AS c_cents, c_mktsegment FROM customer")
def a1(s: Source):
    path = s.scratch()
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    writers.write_table(s.table("customer").select("c_custkey", "c_name", "c_nationkey", cents.alias("c_cents"), "c_mktsegment"), path, "csv")
    return readers.read_csv(s.spark, path)


@query("a1_inferred_types", "SELECT * FROM (VALUES ('c_custkey', 'bigint'), ('c_name', 'string'), ('c_nationkey', 'bigint'), "
       "('c_acctbal', 'double'), ('c_mktsegment', 'string')) AS t(column_name, dtype)")
def a1_types(s: Source):
    return readers.infer_types(s.table("customer").select([F.col(c).cast("string") for c in s.table("customer").columns]))


@query("a2_many_files", "SELECT 'customer' AS origin, c_name AS name FROM customer UNION ALL SELECT 'orders', o_orderpriority FROM orders")
def a2(s: Source):
    parts = {"customer": ("c_name", s.scratch()), "orders": ("o_orderpriority", s.scratch())}
    for table, (column, folder) in parts.items():
        writers.write_table(s.table(table).select(F.col(column).alias("name")), folder, "csv")
    both = readers.read_csv(s.spark, [folder for _, folder in parts.values()], file_column="file")
    origin = [F.when(F.col("file").contains(folder.rsplit("/", 1)[1]), table) for table, (_, folder) in parts.items()]
    return both.select(F.coalesce(*origin).alias("origin"), "name")


@query("a3_upload_violations", """
    SELECT 'batch' AS subject, rule, actual, allowed FROM (
      SELECT 'rows' AS rule, count(*) AS actual, CAST(1000 AS BIGINT) AS allowed FROM lineitem
      UNION ALL SELECT 'columns', 11, CAST(5 AS BIGINT)) WHERE actual > allowed""")
def a3(s: Source):
    return readers.upload_violations(s.table("lineitem"), max_rows=1000, max_columns=5)


@query("a4_parquet_source", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7")
def a4(s: Source):
    return readers.read_parquet(s.spark, s.path("customer")).filter("c_nationkey = 7").select("c_custkey", "c_name")


@query("a5_csv_to_parquet", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def a5(s: Source):
    path = s.scratch()
    writers.write_table(s.table("supplier").select("s_suppkey", "s_name"), f"{path}/csv", "csv")
    writers.csv_to_parquet(readers.read_csv(s.spark, f"{path}/csv"), f"{path}/parquet")
    return readers.read_parquet(s.spark, f"{path}/parquet")


@query("a6_pincode_directory_load", oracle("""
    SELECT pincode, office_name, office_type, delivery_status, 'Nation_' || substr(district, 8) AS district, taluk,
           CAST(latitude AS DOUBLE) AS latitude, 'v1' AS source_version, l.locality AS locality
    FROM f_pin, (VALUES ('First ' ), ('Second Nagar')) AS v(raw), LATERAL (SELECT trim(raw) AS locality) AS l
    WHERE pincode SIMILAR TO '[1-8][0-9]{5}'""", "f_pin"))
def a6(s: Source):
    raw = s.view("f_pin").drop("s_suppkey", "s_nationkey").select(
        F.concat(F.lit(" "), "pincode").alias("pincode"), "office_name", F.upper("office_type").alias("office_type"),
        F.upper("delivery_status").alias("delivery_status"), F.lower("district").alias("district"), "state", "taluk",
        "circle", "region", "division", F.col("latitude").cast("string"), F.col("longitude").cast("string"),
        F.lit("first , second nagar").alias("localities"))
    loaded = readers.load_pincode_directory(raw, "v1")
    return loaded.select("pincode", "office_name", "office_type", "delivery_status", "district", "taluk", "latitude",
                         "source_version", F.explode("localities").alias("locality"))


@query("a7_locality_dictionary_load", oracle("""
    SELECT id, canonical_name, pincode, city, source, 'v2' AS source_version, CAST(alias IS NOT NULL AS INT) AS alias_count
    FROM f_locality""", "f_locality"))
def a7(s: Source):
    return readers.load_locality_dictionary(s.dictionary, "v2").select(
        "id", "canonical_name", "pincode", "city", "source", "source_version", F.size("aliases").alias("alias_count"))


@query("a8_census_load", oracle("""
    SELECT state_code, district_code, village_code, village_name, level, population, CAST(NULL AS DOUBLE) AS latitude
    FROM f_census""", "f_census"))
def a8(s: Source):
    text_rows = s.census.select([F.col(c).cast("string").alias(c) for c in s.census.columns])
    return readers.load_census(text_rows).select(
        "state_code", "district_code", "village_code", "village_name", "level", "population", "latitude")


@query("a9_boundary_load", oracle("""
    SELECT osm_id, admin_level, name, name_en, CAST(CASE WHEN hx0 IS NULL THEN 1 ELSE 2 END AS INT) AS ring_count,
           x0 AS first_x, y0 AS first_y FROM f_rect WHERE admin_level <> 8""", "f_rect"))
def a9(s: Source):
    rings = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    geometry = F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json(rings), F.lit("}"))
    tags = F.create_map(
        F.lit("boundary"), F.when(F.col("admin_level") == 8, "postal_code").otherwise("administrative"),
        F.lit("admin_level"), F.col("admin_level").cast("string"), F.lit("name"), F.col("name"),
        F.lit("name:en"), F.col("name_en"))
    raw = s.raw_boundaries.select("osm_id", tags.alias("tags"), geometry.alias("geometry"))
    b = readers.load_boundaries(raw)
    return b.select("osm_id", "admin_level", "name", "name_en", F.size("rings").alias("ring_count"),
                    F.col("rings")[0][0]["x"].alias("first_x"), F.col("rings")[0][0]["y"].alias("first_y"))


@query("a9_place_points_load", oracle("""
    SELECT s_suppkey AS osm_id, office_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'suburb' ELSE 'village' END AS place_type,
           longitude AS x, latitude AS y FROM f_pin WHERE office_type <> 'head'""", "f_pin"))
def a9_places(s: Source):
    place = F.when(F.col("s_suppkey") % 2 == 0, "suburb").otherwise("village")
    tags = F.when(F.col("office_type") != "head", F.create_map(F.lit("place"), place, F.lit("name"), "office_name")).otherwise(
        F.create_map(F.lit("name"), "office_name"))
    raw = s.view("f_pin").select(F.col("s_suppkey").alias("osm_id"), tags.alias("tags"), F.col("longitude").alias("x"),
                                 F.col("latitude").alias("y"))
    return readers.load_places(raw).select("osm_id", "name", "place_type", "x", "y")


def _export_frame(s: Source):
    enriched = F.struct(
        F.col("a_line1").alias("line1"), F.lit(None).cast("string").alias("line2"), F.col("a_locality").alias("locality"),
        F.col("a_city").alias("city"), F.col("a_district").alias("district"), F.col("a_state").alias("state"),
        F.col("a_pincode").alias("pincode"), F.lit("India").alias("country"))
    original = F.struct(
        F.col("b_line1").alias("line1"), F.lit(None).cast("string").alias("line2"), F.lit(None).cast("string").alias("landmark"),
        F.col("b_pincode").alias("pincode"), F.col("b_city").alias("city"), F.col("b_district").alias("district"),
        F.col("b_state").alias("state"), F.lit("India").alias("country"))
    confidence = F.struct("overall", F.col("confidence_tier").alias("tier"), F.col("match_method").alias("method"))
    return s.processed.select(
        "record_id", "job_id", "row_index", F.lit(None).cast("string").alias("patient_id_hash"), enriched.alias("enriched"),
        original.alias("original"), confidence.alias("confidence"), "confidence_tier", "review_status")


_RESULT_SQL = """record_id, row_index, '' AS patient_id_hash, a_line1 AS enriched_line1, '' AS enriched_line2,
    a_locality AS enriched_locality, coalesce(a_city, '') AS enriched_city, coalesce(a_district, '') AS enriched_district,
    coalesce(a_state, '') AS enriched_state, coalesce(a_pincode, '') AS enriched_pincode, 'India' AS enriched_country,
    overall AS confidence_overall, confidence_tier, match_method, review_status"""
_ORIGINAL_SQL = """, b_line1 AS original_line1, '' AS original_line2, '' AS original_landmark,
    coalesce(b_pincode, '') AS original_pincode, coalesce(b_city, '') AS original_city,
    coalesce(b_district, '') AS original_district, coalesce(b_state, '') AS original_state, 'India' AS original_country"""


@query("a10_csv_export", oracle(f"SELECT {_RESULT_SQL} FROM f_processed", "f_processed").replace(
    "record_id, row_index,", "CAST(record_id AS VARCHAR) AS record_id, CAST(row_index AS VARCHAR) AS row_index,").replace(
    "overall AS confidence_overall", "CAST(overall AS VARCHAR) AS confidence_overall"))
def a10(s: Source):
    path = s.scratch()
    writers.write_table(results.export_results(_export_frame(s), include_original=False), path, "csv")
    return readers.read_csv(s.spark, path).na.fill("")


@query("a11_parquet_export", oracle(f"SELECT {_RESULT_SQL}{_ORIGINAL_SQL} FROM f_processed", "f_processed"))
def a11(s: Source):
    path = s.scratch()
    writers.write_table(results.export_results(_export_frame(s)), path, "parquet")
    return readers.read_parquet(s.spark, path)


@query("k9_high_confidence_export", oracle(
    f"SELECT {_RESULT_SQL}{_ORIGINAL_SQL} FROM f_processed WHERE confidence_tier = 'high'", "f_processed"))
def k9_high(s: Source):
    return results.export_results(_export_frame(s), tiers=["high"])


@query("k9_review_queue_export", oracle(
    f"SELECT {_RESULT_SQL} FROM f_processed WHERE confidence_tier IN ('low', 'unverified')", "f_processed"))
def k9_review(s: Source):
    return results.export_results(_export_frame(s), tiers=["low", "unverified"], include_original=False)


@query("a12_audit_export", oracle("""
    SELECT id, record_id, job_id, field_name, coalesce(old_value, '') AS old_value, new_value, processing_method, confidence,
           source_dataset, coalesce(user_id, '') AS user_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS "timestamp"
    FROM f_audit""", "f_audit"))
def a12(s: Source):
    out = writers.audit_export_columns(s.view("f_audit"))
    return out.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


@query("a14_records_by_job", oracle("SELECT job_id, chunk_index, count(*) AS n FROM f_processed GROUP BY job_id, chunk_index",
                                    "f_processed"))
def a14(s: Source):
    path = s.scratch()
    rows = s.view("f_processed").select("job_id", "chunk_index", "record_id", "overall")
    writers.write_records(rows, path)
    # Writing one chunk again replaces it and leaves the others alone.
    writers.write_records(rows.filter("chunk_index = 0"), path)
    return s.spark.read.parquet(path).groupBy("job_id", "chunk_index").agg(F.count("*").alias("n"))


@query("a15_audit_append", oracle("""
    SELECT strftime(created_at, '%Y-%m') AS year_month, count(*) AS n FROM f_audit GROUP BY 1""", "f_audit"))
def a15(s: Source):
    path = s.scratch()
    for _ in range(2):
        writers.append_audit(s.view("f_audit"), path)
    return s.spark.read.parquet(path).groupBy(F.col("year_month").cast("string")).agg(F.count("*").alias("n"))


@query("a16_a17_versions", oracle("""
    SELECT 'pincode' AS dataset_name, 'v2' AS version, count(*) AS row_count FROM f_pin
    UNION ALL SELECT 'census', 'v1', count(*) FROM f_census""", "f_pin", "f_census"))
def a17(s: Source):
    root = s.scratch()
    registry = s.spark.createDataFrame([], "dataset_name string, version string, checksum_sha256 string, status string, "
                                       "row_count bigint, loaded_at timestamp, activated_at timestamp, archived_at timestamp")
    pins = s.view("f_pin").withColumn("localities", F.lit("a,b"))
    _, registry = results.refresh(pins, "pincode", "v1", root, registry, datetime(2024, 1, 1))
    _, registry = results.refresh(pins, "pincode", "v2", root, registry, datetime(2024, 2, 1))
    _, registry = results.refresh(s.census, "census", "v1", root, registry, datetime(2024, 1, 5))
    return versions.active_versions(registry).select("dataset_name", "version", "row_count")


@query("k10_refresh_and_rollback", oracle("SELECT 'v1' AS version, count(*) AS row_count FROM f_pin", "f_pin"))
def k10(s: Source):
    root = s.scratch()
    registry = s.spark.createDataFrame([], "dataset_name string, version string, checksum_sha256 string, status string, "
                                       "row_count bigint, loaded_at timestamp, activated_at timestamp, archived_at timestamp")
    pins = s.view("f_pin").withColumn("localities", F.lit("a,b"))
    _, registry = results.refresh(pins, "pincode", "v1", root, registry, datetime(2024, 1, 1))
    _, registry = results.refresh(pins, "pincode", "v2", root, registry, datetime(2024, 2, 1))
    back = versions.activate(registry, "pincode", "v1", datetime(2024, 3, 1))
    return versions.active_versions(back).select("version", "row_count")


@query("a18_file_checksums")
def a18(s: Source):
    return readers.file_checksums(s.spark, s.path("customer")).select("bytes", "sha256")


@query("a19_ordered_scan", oracle("SELECT record_id, row_index, confidence_tier FROM f_processed WHERE job_id = 'job_7'", "f_processed"))
def a19(s: Source):
    from pataspark.operators.lookups import job_scan
    return job_scan(s.view("f_processed"), "job_7", ["row_index"]).select("record_id", "row_index", "confidence_tier")


@query("e1_file_row_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, "
       "CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS INT) AS chunk_index FROM orders")
def e1(s: Source):
    rows = chunking.read_indexed_parquet(s.spark, s.path("orders"))
    return chunking.with_chunks(rows, 500).select("o_orderkey", "row_index", "chunk_index")


@query("e1_chunk_table", "SELECT 'job' AS job_id, CAST((o_orderkey) // 500 AS INT) AS chunk_index, count(*) AS row_count, "
       "'pending' AS status FROM orders GROUP BY 1, 2")
def e1_chunks(s: Source):
    rows = chunking.with_chunks(chunking.read_indexed_parquet(s.spark, s.path("orders")), 500)
    return chunking.chunk_table(rows, F.lit("job"))


@query("e4_surrogate_id", "SELECT c_name, row_number() OVER (ORDER BY substr(md5(c_name), 1, 3), c_name) AS id FROM customer")
def e4(s: Source):
    return chunking.dense_index(s.table("customer").select("c_name"), ["c_name"], "id", start=1)


@query("b1_map_columns", "SELECT c_custkey, c_name AS line1, CAST(NULL AS VARCHAR) AS line2, c_mktsegment AS landmark, "
       "CAST(c_nationkey AS VARCHAR) AS city, 'India' AS country FROM customer")
def b1(s: Source):
    mapping = ColumnMapping.from_dict({"address_line_1": "c_name", "landmark": "c_mktsegment", "city": "c_nationkey"})
    return chunking.map_columns(s.table("customer"), mapping, ["c_custkey"]).select(
        "c_custkey", "line1", "line2", "landmark", "city", "country")


# -- text functions over whole documents, records and conversations --------------------------

@query("h1_clean_whitespace", f"SELECT doc_id, md5({_duck_clean('text')}) AS digest FROM documents")
def h1(s: Source):
    return s.table("documents").select("doc_id", F.md5(text.clean_whitespace(F.col("text"))).alias("digest"))


@query("h2_normalize_abbreviations", oracle(
    f"SELECT record_id, {_duck_expand(_duck_clean('line1'), text.NORMALIZE_ABBREVIATIONS)} AS line1 FROM f_record", "f_record"))
def h2(s: Source):
    return s.records.select("record_id", text.normalize_text(F.col("line1")).alias("line1"))


_ADDRESS_SQL = "concat_ws(', ', nullif(line1, ''), nullif(line2, ''), nullif(landmark, ''), nullif(city, ''), nullif(district, ''), " \
               "nullif(state, ''), nullif(pincode, ''), nullif(country, ''))"


@query("h3_parse_abbreviations", oracle(
    f"SELECT record_id, {_duck_expand(_ADDRESS_SQL, text.PARSE_ABBREVIATIONS)} AS expanded FROM f_record", "f_record"))
def h3(s: Source):
    whole = text.concat_parts(*[F.col(c) for c in ("line1", "line2", "landmark", "city", "district", "state", "pincode", "country")])
    return s.records.select("record_id", text.expand_abbreviations(whole, text.PARSE_ABBREVIATIONS).alias("expanded"))


@query("h4_unicode_nfc", "SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents")
def h4(s: Source):
    return s.table("documents").select("doc_id", F.md5(sim.nfc(F.col("text"))).alias("digest"))


@query("h5_title_case", oracle("""
    SELECT id, array_to_string(list_transform(string_split(lower(canonical_name), ' '),
           lambda w: replace(upper(substr(w, 1, 1)), 'ẞ', 'Ss') || substr(w, 2)), ' ') || ' PIN' AS title FROM f_locality""", "f_locality"))
def h5(s: Source):
    return s.dictionary.select("id", text.title_case(F.concat("canonical_name", F.lit(" pin"))).alias("title"))


@query("h6_drop_noise_words", oracle(f"""
    SELECT record_id, {_duck_clean("regexp_replace(landmark || ' near to X', '\\b(Near to|Opposite|Behind|Beside|Near|Opp)\\b', '', 'gi')")} AS landmark
    FROM f_record""", "f_record"))
def h6(s: Source):
    return s.records.select("record_id", text.drop_noise_words(F.concat("landmark", F.lit(" near to X"))).alias("landmark"))


@query("h7_last_pin_in_text", oracle(f"""
    SELECT record_id, {_duck_last_pin("line1 || ' 512345 ' || coalesce(pincode, '') || ' x'")} AS pin FROM f_record""", "f_record"))
def h7(s: Source):
    t = F.concat("line1", F.lit(" 512345 "), F.coalesce("pincode", F.lit("")), F.lit(" x"))
    return s.records.select("record_id", text.last_pin(t).alias("pin"))


@query("h7_pins_in_documents", f"SELECT doc_id, {_duck_last_pin('text')} AS pin FROM documents")
def h7_documents(s: Source):
    return s.table("documents").select("doc_id", text.last_pin(F.col("text")).alias("pin"))


@query("h8_pin_format", oracle("SELECT record_id, coalesce(regexp_full_match(pincode, '[1-8][0-9]{5}'), false) AS valid FROM f_record",
                               "f_record"))
def h8(s: Source):
    return s.records.select("record_id", text.is_pin(F.col("pincode")).alias("valid"))


@query("h9_concatenate_parts", oracle(f"SELECT record_id, {_ADDRESS_SQL} AS address FROM f_record", "f_record"))
def h9(s: Source):
    return s.records.select("record_id", text.concat_parts(*[F.col(c) for c in (
        "line1", "line2", "landmark", "city", "district", "state", "pincode", "country")]).alias("address"))


@query("h10_formatted_address", oracle("""
    SELECT record_id, concat_ws(', ', a_line1, nullif(a_locality, ''), nullif(a_city, ''), nullif(a_district, ''),
           nullif(a_state, ''), nullif(a_pincode, ''), 'India') AS formatted FROM f_processed""", "f_processed"))
def h10(s: Source):
    parts = [F.col(f"a_{c}") for c in ("locality", "city", "district", "state", "pincode")]
    return s.view("f_processed").select("record_id", text.formatted_address(
        F.col("a_line1"), *parts, country=F.lit("India")).alias("formatted"))


_FILLED = " + ".join(f"CAST(coalesce(b_{c}, '') <> '' AS INT)" for c in ("line1", "pincode", "locality", "city", "district", "state"))


@query("h11_completeness", oracle(f"SELECT record_id, CAST((({_FILLED}) * 100) // 7 AS INT) AS completeness FROM f_processed", "f_processed"))
def h11(s: Source):
    fields = [F.col(f"b_{c}") for c in ("line1", "pincode", "locality", "city", "district", "state")] + [F.lit(None).cast("string")]
    return s.view("f_processed").select("record_id", scoring.completeness(*fields).alias("completeness"))


_SCORE_INPUT = """SELECT record_id, CASE hh % 3 WHEN 0 THEN 100 WHEN 1 THEN 50 ELSE 0 END AS pin, CAST(hh % 101 AS DOUBLE) AS loc,
    greatest(0, 100 - 20 * CAST(hh % 7 AS INT)) AS hier, CAST((hh % 8) * 100 // 7 AS INT) AS par FROM f_processed"""


def _score_frame(s: Source):
    hh = F.col("hh")
    return s.view("f_processed").select(
        "record_id", scoring.pin_score(hh % 3 == 0, hh % 3 == 1).alias("pin"), (hh % 101).cast("double").alias("loc"),
        scoring.hierarchy_score(hh % 7).alias("hier"), F.floor((hh % 8) * 100 / 7).cast("int").alias("par"))


@query("k5_confidence_score", oracle("""
    SELECT record_id, overall, pin AS pincode_validity, CAST(trunc(loc) AS INT) AS locality_match, hier AS hierarchy_consistency,
           par AS parsing_completeness, CASE WHEN pin = 100 AND loc = 100 THEN 'exact' WHEN loc > 0 THEN 'fuzzy'
           WHEN pin = 50 THEN 'inferred' ELSE 'manual' END AS method,
           CASE WHEN overall >= 85 THEN 'high' WHEN overall >= 60 THEN 'medium' WHEN overall >= 40 THEN 'low' ELSE 'unverified' END AS tier
    FROM (SELECT *, CAST(trunc(0.25::DOUBLE * pin + 0.25::DOUBLE * loc + 0.2::DOUBLE * hier + 0.15::DOUBLE * par + 0.15::DOUBLE * loc) AS INT)
          AS overall FROM scores)""", "f_processed", scores=_SCORE_INPUT))
def k5(s: Source):
    scored = _score_frame(s).select("record_id", scoring.confidence(
        F.col("pin"), F.col("loc"), F.col("hier"), F.col("par"), F.col("loc")).alias("c"))
    return scored.select("record_id", "c.*").drop("fuzzy_quality")


@query("h15_review_flags", oracle("""
    SELECT record_id, confidence_tier = 'high' AS auto_approved, confidence_tier IN ('medium', 'low') AS needs_review,
           confidence_tier = 'unverified' AS manual, CASE WHEN confidence_tier = 'high' THEN 'auto' ELSE 'needs_review' END AS status
    FROM f_processed""", "f_processed"))
def h15(s: Source):
    t = F.col("confidence_tier")
    return s.view("f_processed").select(
        "record_id", scoring.auto_approved(t).alias("auto_approved"), scoring.needs_review(t).alias("needs_review"),
        scoring.requires_manual_verification(t).alias("manual"), scoring.review_status(t).alias("status"))


_TYPO = f"levenshtein({_one_byte('lower(typed)')}, {_one_byte('lower(true_name)')})"


@query("h18_edit_distance", oracle(f"""
    SELECT record_id, {_TYPO} AS distance,
           CASE WHEN {_TYPO} <= 2 THEN {_TYPO} ELSE -1 END AS within_2
    FROM f_record""", "f_record"))
def h18(s: Source):
    a, b = F.lower("typed"), F.lower("true_name")
    return s.view("f_record").select("record_id", sim.edit_distance(a, b).alias("distance"), sim.edit_distance(a, b, 2).alias("within_2"))


@query("h19_token_set_ratio", oracle(f"SELECT record_id, round({duck_token_set('a', 'b')}, 6) AS score FROM ({duck_token_parts('SELECT record_id, lower(typed) AS a, lower(true_name) AS b FROM f_record', 'record_id, a, b')})", "f_record"))
def h19(s: Source):
    return s.view("f_record").select(
        "record_id", F.round(sim.token_set_ratio(F.lower("typed"), F.lower("true_name")), 6).alias("score"))


@query("h20_context_boost", oracle("""
    SELECT record_id, CASE WHEN population > 100000 THEN least(100.0::DOUBLE, s3 + 3) ELSE s3 END AS score
    FROM (SELECT *, CASE WHEN hh % 5 = 0 THEN least(100.0::DOUBLE, s2 + 5) ELSE s2 END AS s3
    FROM (SELECT *, CASE WHEN hh % 3 = 0 THEN least(100.0::DOUBLE, s1 + 10) ELSE s1 END AS s2
    FROM (SELECT record_id, hh, hh % 200000 AS population,
                 CASE WHEN hh % 2 = 0 THEN least(100.0::DOUBLE, overall + 15) ELSE overall::DOUBLE END AS s1 FROM f_processed)))""",
    "f_processed"))
def h20(s: Source):
    hh = F.col("hh")
    return s.view("f_processed").select("record_id", scoring.context_boost(
        F.col("overall").cast("double"), same_pin=hh % 2 == 0, same_district=hh % 3 == 0, same_state=hh % 5 == 0,
        population=hh % 200000).alias("score"))


@query("h21_match_kind", oracle("""
    SELECT record_id, CASE WHEN q = n THEN 'exact' WHEN record_id % 10 = 4 THEN 'exact_alias' WHEN starts_with(n, q) THEN 'prefix'
           ELSE 'fuzzy' END AS kind FROM (SELECT record_id, lower(typed) AS q, lower(true_name) AS n FROM f_record)""", "f_record"))
def h21(s: Source):
    return s.view("f_record").select("record_id", scoring.match_kind(
        F.lower("typed"), F.lower("true_name"), F.col("record_id") % 10 == 4).alias("kind"))


def _duck_hmac(expr: str, key: str) -> str:
    raw = key.encode().ljust(64, b"\0")
    blob = {x: "".join(f"\\x{b ^ x:02X}" for b in raw) for x in (0x36, 0x5C)}
    return f"sha256('{blob[0x5C]}'::BLOB || unhex(sha256('{blob[0x36]}'::BLOB || {expr}::BLOB)))"


@query("h22_patient_id_hash", f"SELECT c_custkey, {_duck_hmac('c_name', 'a secret salt')} AS patient_id_hash FROM customer")
def h22(s: Source):
    return s.table("customer").select("c_custkey", privacy.hmac_sha256(F.col("c_name"), "a secret salt").alias("patient_id_hash"))


@query("h23_encrypt_round_trip", "SELECT c_custkey, c_name AS back, true AS hidden FROM customer")
def h23(s: Source):
    key = F.lit("0123456789abcdef0123456789abcdef").cast("binary")
    cipher = s.table("customer").select("c_custkey", "c_name", privacy.encrypt(F.col("c_name"), key).alias("cipher"))
    return cipher.select("c_custkey", privacy.decrypt(F.col("cipher"), key).alias("back"),
                         (F.col("cipher") != F.col("c_name")).alias("hidden"))


_OLD_NAMES = [old for old, _ in text.CITY_RENAMES]


@query("h24_current_city_names", "SELECT c_custkey, CASE c_custkey % 17 " + " ".join(
    f"WHEN {i} THEN '{new}'" for i, (_, new) in enumerate(text.CITY_RENAMES)) + " ELSE c_name END AS city FROM customer")
def h24(s: Source):
    names = F.array(*[F.lit(n.title()) for n in _OLD_NAMES])
    slot = (F.col("c_custkey") % 17).cast("int")
    typed = F.coalesce(F.try_element_at(names, slot + 1), F.col("c_name"))
    return s.table("customer").select("c_custkey", text.current_city_name(typed).alias("city"))


@query("h25_ordinals", oracle("SELECT id, canonical_name || ' 4th Block' AS arabic, canonical_name || ' IX Phase' AS roman FROM f_locality",
                              "f_locality"))
def h25(s: Source):
    return s.dictionary.select(
        "id", text.roman_to_ordinal(F.concat("canonical_name", F.lit(" IV Block"))).alias("arabic"),
        text.ordinal_to_roman(F.concat("canonical_name", F.lit(" 9th Phase"))).alias("roman"))


@query("h26_value_shape", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\\p{L}+', 'A', 'g'), '[0-9]+', '9', 'g')) AS shape FROM documents")
def h26(s: Source):
    return s.table("documents").select("doc_id", F.md5(text.value_shape(F.col("text"))).alias("shape"))


@query("h27_split_list", "SELECT doc_id, len(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ')), lambda x: x <> '')) AS items "
       "FROM documents")
def h27(s: Source):
    return s.table("documents").select("doc_id", F.size(text.split_list(F.col("text"))).alias("items"))


@query("h28_percentage", oracle("""
    SELECT job_id, round(CASE WHEN total_rows = 0 THEN 0.0::DOUBLE ELSE processed_rows * 100.0::DOUBLE / total_rows END, 2) AS pct
    FROM f_job""", "f_job"))
def h28(s: Source):
    return s.view("f_job").select("job_id", text.percentage(F.col("processed_rows"), F.col("total_rows")).alias("pct"))


@query("h30_rate_and_eta", oracle(f"""
    SELECT job_id, CASE WHEN total_rows > 0 THEN {_half_up('processed_rows * 100.0::DOUBLE / total_rows')} ELSE 0.0::DOUBLE END AS pct,
           CASE WHEN manual_review_rows = 0 THEN 0.0::DOUBLE ELSE {_half_up('processed_rows * 1.0::DOUBLE / manual_review_rows')} END AS rate,
           CASE WHEN processed_rows > 0 THEN {_half_up('(total_rows - processed_rows) * 1.0::DOUBLE * manual_review_rows / processed_rows')} END AS eta
    FROM f_job""", "f_job"))
def h30(s: Source):
    p, t, sec = F.col("processed_rows"), F.col("total_rows"), F.col("manual_review_rows")
    return s.view("f_job").select("job_id", scoring.progress_pct(p, t).alias("pct"), scoring.rate_per_second(p, sec).alias("rate"),
                                  scoring.eta_seconds(p, t, sec).alias("eta"))


@query("h31_point_wkt", oracle("""
    SELECT pincode, 'POINT(' || CAST(longitude AS VARCHAR) || ' ' || CAST(latitude AS VARCHAR) || ')' AS wkt, true AS has_point
    FROM f_pin""", "f_pin"))
def h31(s: Source):
    lat, lon = F.col("latitude"), F.col("longitude")
    return s.view("f_pin").select("pincode", geo.point_wkt(lat, lon).alias("wkt"), geo.has_coordinates(lat, lon).alias("has_point"))


@query("h32_polygon_area", oracle("""
    SELECT osm_id, round((x1 - x0) * (y1 - y0) - coalesce((hx1 - hx0) * (hy1 - hy0), 0), 6) AS area FROM f_rect""", "f_rect"))
def h32(s: Source):
    return s.boundaries.select("osm_id", F.round("area", 6).alias("area"))


def _duck_soundex(expr: str) -> str:
    """Code of the first letter kept as it is, h and w passed over, equal neighbours once, vowels dropped."""
    codes = f"replace(translate(regexp_replace(lower({expr}), '[^a-z]', '_', 'g'), 'abcdefghijklmnopqrstuvwxyz', '01230127022455012623017202'), '_', '0')"
    once = f"substr({codes}, 1, 1) || replace(substr({codes}, 2), '7', '')"
    for digit in "1234567":
        once = f"regexp_replace({once}, '{digit}+', '{digit}', 'g')"
    tail = f"rpad(substr(replace(substr({once}, 2), '0', ''), 1, 3), 3, '0')"
    return f"CASE WHEN regexp_matches({expr}, '^[A-Za-z]') THEN upper(substr({expr}, 1, 1)) || {tail} ELSE {expr} END"


@query("h33_sounds_alike", oracle(f"""
    SELECT record_id, {_duck_soundex('typed')} = {_duck_soundex('true_name')} AS alike FROM f_record""", "f_record"))
def h33(s: Source):
    return s.view("f_record").select("record_id", sim.sounds_alike(F.col("typed"), F.col("true_name")).alias("alike"))


@query("h34_jaro_winkler", oracle(f"""
    SELECT record_id, round(jaro_winkler_similarity({_one_byte('lower(typed)')}, {_one_byte('lower(true_name)')}), 6) AS similarity FROM f_record""", "f_record"))
def h34(s: Source):
    return s.view("f_record").select("record_id", F.round(sim.jaro_winkler(F.lower("typed"), F.lower("true_name")), 6).alias("similarity"))


@query("h35_devanagari", "SELECT doc_id, regexp_matches(CASE WHEN doc_id % 2 = 0 THEN text || ' नगर' ELSE text END, '[\\x{0900}-\\x{097F}]') AS devanagari "
       "FROM documents")
def h35(s: Source):
    mixed = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" नगर"))).otherwise(F.col("text"))
    return s.table("documents").select("doc_id", text.has_devanagari(mixed).alias("devanagari"))


@query("h36_address_variants", oracle(f"""
    SELECT DISTINCT record_id, variant FROM (
      SELECT record_id, unnest([line1, {_duck_expand('line1', text.PARSE_ABBREVIATIONS)}]) AS variant FROM f_record)""", "f_record"))
def h36(s: Source):
    return s.records.select("record_id", F.explode(text.address_variants(F.col("line1"))).alias("variant"))


@query("h37_canonical_line1", oracle("""
    SELECT record_id, concat_ws(' ', nullif(b_line1, ''), nullif(b_city, '')) AS line1 FROM f_processed""", "f_processed"))
def h37(s: Source):
    return s.view("f_processed").select("record_id", text.canonical_line1(F.col("b_line1"), F.col("b_city")).alias("line1"))


@query("k2_normalize_addresses", oracle("SELECT record_id, " + ", ".join(
    f"{_duck_expand(_duck_clean(c), text.NORMALIZE_ABBREVIATIONS)} AS {c}" for c in ("line1", "line2", "landmark", "city", "district", "state", "pincode"))
    + " FROM f_record", "f_record"))
def k2(s: Source):
    done = plans.normalize_addresses(s.records)
    return done.select("record_id", *[F.col(f"normalized.{c}").alias(c) for c in (
        "line1", "line2", "landmark", "city", "district", "state", "pincode")])


# -- profiles -------------------------------------------------------------------------------

_CUSTOMER_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({e} AS VARCHAR) AS value, c_custkey AS row_index FROM customer"
    for c, e in (("patient_id", "c_name"), ("address_line_1", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment || ' Nagar' END"),
                 ("pincode", "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 500000 + c_nationkey END"),
                 ("amount", "c_nationkey")))


def _profile_frame(s: Source):
    key = F.col("c_custkey")
    return s.table("customer").select(
        key.alias("row_index"), F.col("c_name").alias("patient_id"),
        F.when(key % 3 != 0, F.concat("c_mktsegment", F.lit(" Nagar"))).alias("address_line_1"),
        F.when(key % 4 != 0, 500000 + F.col("c_nationkey")).alias("pincode"), F.col("c_nationkey").alias("amount"))


_PROFILE_COLUMNS = ["patient_id", "address_line_1", "pincode", "amount"]


@query("d1_column_profile", f"""
    SELECT column_name, round(CAST(count(*) - count(value) AS DOUBLE) * 100.0::DOUBLE / count(*), 2) AS null_pct,
           count(DISTINCT value) + CAST(count(*) > count(value) AS INT) AS distinct_count,
           coalesce(min(length(value)), 0) AS min_length, coalesce(max(length(value)), 0) AS max_length, count(*) AS row_count
    FROM ({_CUSTOMER_LONG}) GROUP BY column_name""")
def d1(s: Source):
    return profile.profile_columns(_profile_frame(s), _PROFILE_COLUMNS).drop("dtype")


_LINEITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("d1_lineitem_profile", " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, round(CAST(count(*) - count({c}) AS DOUBLE) * 100.0::DOUBLE / count(*), 2) AS null_pct,
           count(DISTINCT {c}) + CAST(count(*) > count({c}) AS INT) AS distinct_count, count(*) AS row_count FROM lineitem"""
    for c in _LINEITEM))
def d1_lineitem(s: Source):
    p = profile.profile_columns(s.table("lineitem"), _LINEITEM)
    return p.select("column_name", "null_pct", "distinct_count", "row_count")


@query("f9_first_values", f"""
    SELECT column_name, value, CAST(position AS INT) AS position FROM (
      SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY row_index) AS position
      FROM ({_CUSTOMER_LONG}) WHERE value IS NOT NULL) WHERE position <= 5""")
def f9(s: Source):
    return profile.first_values(_profile_frame(s), _PROFILE_COLUMNS, "row_index", 5)


_POINTS = """CAST(contains(v, 'pincode') OR contains(v, 'pin') OR contains(v, 'zip') OR contains(v, 'postal') AS INT) * 2
    + CAST(regexp_matches(v, '(nagar|colony|sector|extension|layout|vihar|pura|ganj)$') AS INT)
    + CAST(regexp_matches(v, '\\b[1-8][0-9]{5}\\b') AS INT) * 2"""


@query("d2_detect_address_columns", f"""
    SELECT n.column_name, name_score, CAST(coalesce(content, 0) AS INT) AS content_score,
           name_score >= 2 OR coalesce(content, 0) >= 2 AS detected
    FROM (VALUES {', '.join(f"('{c}', {sum(k in c for k in profile.NAME_KEYWORDS)})" for c in _PROFILE_COLUMNS)}) AS n(column_name, name_score)
    LEFT JOIN (SELECT column_name, sum({_POINTS}) AS content FROM (
        SELECT column_name, lower(value) AS v, row_number() OVER (PARTITION BY column_name ORDER BY row_index) AS position
        FROM ({_CUSTOMER_LONG}) WHERE value IS NOT NULL) WHERE position <= 20 GROUP BY column_name) AS c USING (column_name)""")
def d2(s: Source):
    return profile.detect_address_columns(_profile_frame(s), "row_index", _PROFILE_COLUMNS)


@query("d3_detect_any_hit", "SELECT * FROM (VALUES ('patient_id', false), ('address_line_1', true), ('pincode', true), ('amount', false)) "
       "AS t(column_name, detected)")
def d3(s: Source):
    return profile.detect_any_hit(_profile_frame(s), "row_index", _PROFILE_COLUMNS)


@query("k1_profile_dataset", f"""
    SELECT column_name, round(CAST(count(*) - count(value) AS DOUBLE) * 100.0::DOUBLE / count(*), 2) AS null_pct,
           count(DISTINCT value) + CAST(count(*) > count(value) AS INT) AS distinct_count,
           column_name IN ('patient_id', 'address_line_1', 'pincode') AND column_name <> 'patient_id' AS detected,
           (SELECT string_agg(value, '|' ORDER BY row_index) FROM (SELECT value, row_index FROM ({_CUSTOMER_LONG}) AS i
              WHERE i.column_name = o.column_name AND value IS NOT NULL ORDER BY row_index LIMIT 5)) AS samples
    FROM ({_CUSTOMER_LONG}) AS o GROUP BY column_name""")
def k1(s: Source):
    done = results.profile_dataset(_profile_frame(s), "row_index", _PROFILE_COLUMNS)
    return done.select("column_name", "null_pct", "distinct_count", "detected", F.array_join("sample_values", "|").alias("samples"))


@query("d27_dominant_shapes", f"""
    SELECT column_name, arg_max(shape, (n, shape)) AS dominant_shape, round(max(n) * 100.0::DOUBLE / sum(n), 2) AS format_share,
           count(*) AS shape_count
    FROM (SELECT column_name, regexp_replace(regexp_replace(value, '\\p{{L}}+', 'A', 'g'), '[0-9]+', '9', 'g') AS shape, count(*) AS n
          FROM ({_CUSTOMER_LONG}) WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY column_name""")
def d27(s: Source):
    return profile.dominant_shapes(_profile_frame(s), _PROFILE_COLUMNS)


@query("d27_column_validity", oracle("""
    SELECT 'b_pincode' AS column_name, count(b_pincode) AS filled, count(*) FILTER (b_pincode SIMILAR TO '[1-8][0-9]{5}') AS valid,
           round(count(*) FILTER (b_pincode SIMILAR TO '[1-8][0-9]{5}') * 100.0::DOUBLE / count(b_pincode), 2) AS validity FROM f_processed""",
    "f_processed"))
def d27_validity(s: Source):
    return profile.column_validity(s.view("f_processed"), {"b_pincode": text.is_pin(F.col("b_pincode"))})
