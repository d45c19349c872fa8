from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from pataspark.operators import audit, chunking, jobs, profile, spatial
from pataspark.schemas import ColumnMapping
from pataspark.sources import readers, writers
from pataspark.streaming import progress
from pataspark.workload.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_profile_edges(spark):
    df = spark.createDataFrame([(i, None, "MG Rd 560034" if i == 3 else None) for i in range(5)], "row_index long, empty string, patient_id string")
    got = {r.column_name: r for r in profile.profile_columns(df, ["empty", "patient_id"]).collect()}
    assert (got["empty"].null_pct, got["empty"].distinct_count, got["empty"].max_length) == (100.0, 1, 0)
    assert (got["patient_id"].null_pct, got["patient_id"].distinct_count) == (80.0, 2)
    verdict = {r.column_name: r for r in profile.detect_address_columns(df.withColumnRenamed("empty", "state"), "row_index").collect()}
    assert verdict["state"].name_score == 2 and verdict["state"].detected
    assert verdict["patient_id"].name_score == 0 and verdict["patient_id"].content_score == 2 and verdict["patient_id"].detected


def test_sources_and_sinks(spark, tmp_path):
    raw = spark.createDataFrame([("007", "a,b"), ("012", None)], "code string, note string")
    writers.write_table(raw, f"{tmp_path}/csv", "csv")
    back = readers.read_csv(spark, f"{tmp_path}/csv")
    assert {r.code for r in back.collect()} == {"007", "012"}
    with pytest.raises(ValueError):
        readers.load_pincode_directory(raw, "v1")
    with pytest.raises(ValueError):
        readers.check_upload("a.exe", "text/csv")
    broken = readers.rejects(raw, {"has_note": F.col("note").isNotNull()}).collect()
    assert [r.code for r in broken] == ["012"] and broken[0].broken_rules == ["has_note"]
    mapped = chunking.map_columns(raw, ColumnMapping(address_line_1="note", patient_id="code")).first()
    assert (mapped.country, mapped.city) == ("India", None)
    spark.range(25).repartition(3).write.parquet(f"{tmp_path}/rows")
    index = [r.row_index for r in chunking.read_indexed_parquet(spark, f"{tmp_path}/rows").collect()]
    assert sorted(index) == list(range(25))
    ids = chunking.dense_index(spark.range(500).select(F.col("id").alias("k")), ["k"], "n", 1)
    assert sorted(r.n for r in ids.collect()) == list(range(1, 501))


def test_nested_boundaries_and_errors(spark):
    def box(a, b):
        return [[(a, a), (b, a), (b, b), (a, b)]]
    rows = [(1, 4, "S", "S", box(0.0, 10.0)), (2, 6, "D", "D", box(0.0, 5.0)), (3, 8, "C", "C", box(1.0, 3.0)), (4, 8, "Big", "Big", box(0.5, 4.0))]
    b = spatial.prepare_boundaries(spark.createDataFrame(rows, "osm_id long, admin_level int, name string, name_en string, rings array<array<struct<x:double,y:double>>>"))
    df = spark.createDataFrame([(1, 2.0, 2.0, "c", "d", "s"), (2, 2.0, 2.0, "c", "X", "s"), (3, 9.0, 9.0, "c", None, None), (4, None, None, "c", "d", "s")],
                               "id int, latitude double, longitude double, city string, district string, state string")
    got = {r.id: r.errors for r in spatial.validate_hierarchy(df, b).collect()}
    assert got == {1: [], 2: ["District mismatch: expected 'X', found 'D'"], 3: [spatial.NOT_FOUND], 4: []}


def test_audit_rows_are_repeatable(spark):
    df = spark.createDataFrame([(1, "j", None, "x"), (2, "j", "a", "a"), (3, "j", "a", None)], "record_id long, job_id string, old string, new string")
    rows = audit.changed_fields(df, [audit.change("city", F.col("old"), F.col("new"), "parsing", 50, "manual")], created_at=F.lit(datetime(2024, 1, 1)))
    first, second = ({tuple(r) for r in rows.collect()} for _ in range(2))
    assert first == second and {r[1] for r in first} == {1, 3}


def test_live_progress_counts_a_retried_chunk_once(spark, tmp_path):
    at = datetime(2024, 1, 1)
    events = [("j", 0, 10, 40, "failed", at), ("j", 0, 10, 40, "completed", at.replace(minute=1)), ("j", 1, 10, 40, "completed", at.replace(minute=2)),
              ("j", 1, 10, 40, "completed", at.replace(minute=3))]
    for i, e in enumerate(events):
        spark.createDataFrame([e], progress.CHUNK_EVENTS).write.mode("append").parquet(f"{tmp_path}/in")
    stream = progress.live_progress(progress.read_chunk_events(spark, f"{tmp_path}/in", 1))
    q = (stream.writeStream.format("memory").queryName("live").outputMode("update")
         .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
    q.awaitTermination(120)
    last = spark.sql("SELECT max(processed) AS p, max(completed_chunks) AS c FROM live").first()
    batch = progress.progress_snapshot(spark.createDataFrame(events, progress.CHUNK_EVENTS)).first()
    assert (last.p, last.c) == (batch.processed, batch.completed_chunks) == (20, 2)
    assert batch.progress_pct == 50.0 and progress.failed_attempts(spark.read.parquet(f"{tmp_path}/in")).first().failed_attempts == 1


def test_job_states_are_released(spark, tmp_path):
    at = datetime(2024, 1, 1)
    days = [  # "a" finishes with a retried chunk, "b" falls silent, comes back and falls silent, "c" keeps the clock going
        [("a", 0, 10, 20, "completed", at), ("b", 0, 5, 20, "completed", at), ("c", 0, 1, 99, "completed", at), ("c", None, 1, 99, "completed", at)],
        [("a", 0, 10, 20, "completed", at.replace(minute=1)), ("a", 1, 10, 20, "completed", at.replace(minute=1)), ("c", 1, 1, 99, "failed", at.replace(minute=1))],
        [("a", 1, 10, 20, "completed", at.replace(minute=1, second=30)), ("c", 1, 1, 99, "completed", at.replace(hour=1))],
        [("c", 2, 1, 99, "completed", at.replace(hour=1, minute=1))],
        [("b", 1, 5, 20, "completed", at.replace(hour=1, minute=2)), ("c", 3, 1, 99, "completed", at.replace(hour=2))],
        [("c", 4, 1, 99, "completed", at.replace(hour=3))]]
    for day in days:
        spark.createDataFrame(day, progress.CHUNK_EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = progress.follow_job_states(progress.read_chunk_events(spark, f"{tmp_path}/in", 1), f"{tmp_path}/out", f"{tmp_path}/log", forget_seconds=7200)
    query.awaitTermination(180)
    written = spark.read.parquet(f"{tmp_path}/out")
    rows = [(r.job_id, r.state, r.processed, r.completed_chunks) for r in written.orderBy("batch_id").collect()]
    assert [r[1:] for r in rows if r[0] == "a"] == [("running", 10, 1), ("finished", 20, 2)]  # the repeat after the end is no new job
    assert [r[1:] for r in rows if r[0] == "b"] == [("running", 5, 1), ("stalled", 5, 1), ("running", 10, 2), ("stalled", 10, 2)]
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < 3  # "a" has left
    events = spark.createDataFrame([e for day in days for e in day], progress.CHUNK_EVENTS)
    asof = F.lit(at.replace(hour=2, minute=59, second=50)).cast("timestamp")
    columns = ["job_id", "state", "processed", "total_rows", "completed_chunks"]
    twin = {tuple(r) for r in progress.job_states_snapshot(events, asof).select(*columns).collect()}
    assert twin == {tuple(r) for r in progress.newest_states(written).select(*columns).collect()}


def test_audit_runs_again_after_a_crash_half_way(spark, tmp_path):
    rows = [(f"{m}-{i}", datetime(2024, m, 1)) for m in (1, 2) for i in range(4)]
    audit_rows = spark.createDataFrame(rows, "id string, created_at timestamp")
    writers.append_audit(audit_rows.filter("id IN ('1-0', '1-1', '2-3')"), f"{tmp_path}/audit")  # what a crash left
    for _ in range(2):
        writers.append_audit(audit_rows, f"{tmp_path}/audit")
    writers.append_audit(spark.createDataFrame([("1-0", datetime(2024, 3, 1))], audit_rows.schema), f"{tmp_path}/audit")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/audit").collect()) == sorted([r[0] for r in rows] + ["1-0"])


def test_incremental_enrichment_resumes(spark, tmp_path):
    rows = [("j", 0, 1), ("j", 0, 2)]
    schema = "job_id string, chunk_index int, v int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")

    def run():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        progress.enrich_incrementally(source, lambda d: d.withColumn("w", F.col("v") * 2), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)

    run()
    spark.createDataFrame([("j", 1, 3)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    run()
    assert sorted(r.w for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [2, 4, 6]


def test_reviews_take_the_last_decision(spark):
    r = spark.createDataFrame([(1, "needs_review", None, None, None), (2, "auto", None, None, None)],
                              "record_id int, review_status string, reviewed_by string, reviewed_at timestamp, review_notes string")
    d = spark.createDataFrame([(1, "rejected", "u", datetime(2024, 1, 2), None), (1, "manual_verified", "u", datetime(2024, 1, 1), None)],
                              "record_id int, review_status string, reviewed_by string, reviewed_at timestamp, review_notes string")
    assert {x.record_id: x.review_status for x in jobs.apply_reviews(r, d).collect()} == {1: "rejected", 2: "auto"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    from pathlib import Path
    for f in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", ["flagship_records_per_state", "d15_quality_baseline", "c1_pin_lookup", "k6_changed_fields", "e1_file_row_index"])
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SMALL)
    cur = db.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str(tuple(dict(zip(columns, r)).items())) for r in cur.fetchall())
    got = sorted(str(tuple((c, r[c]) for c in columns)) for r in df.collect())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 120


def test_job_states_share_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(progress, "JOB_BUCKETS", 2)
    at = datetime(2024, 1, 1)
    batches = [  # odd jobs finish, even ones fall silent when the clock of "z" goes on
        [(f"j{i}", 0, 10, 20, "completed", at) for i in range(20)],
        [(f"j{i}", 1, 10, 20, "completed", at.replace(minute=1)) for i in range(1, 20, 2)] + [("z", 0, 1, 99, "completed", at.replace(minute=1))],
        [("z", 1, 1, 99, "completed", at.replace(hour=1))], [("z", 2, 1, 99, "completed", at.replace(hour=1, second=5))]]
    for batch in batches:
        spark.createDataFrame(batch, progress.CHUNK_EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = progress.follow_job_states(progress.read_chunk_events(spark, f"{tmp_path}/in", 1), f"{tmp_path}/out", f"{tmp_path}/log")
    query.awaitTermination(180)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 2
    got = {(r.job_id, r.state, r.processed) for r in progress.newest_states(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert got == {(f"j{i}", "finished", 20) if i % 2 else (f"j{i}", "stalled", 10) for i in range(20)} | {("z", "running", 3)}


def test_documents_are_split_into_words_once(spark):
    from pataspark.workload.base import Source
    assert "documents" not in Source(spark, SMALL)._text("f_word")


def test_towns_of_a_pin_are_spread_over_all_cores(spark):
    from pataspark.operators import census
    pins = spark.createDataFrame([(f"{100000 + i}", "D", "S", "T") for i in range(50)], "pincode string, district string, state string, taluk string")
    rows = [("d", "s", f"town {i}", "Town") for i in range(400)] + [("e", "s", "far", "City"), ("d", "s", "village", "Village")]
    found = census.hierarchy_from_pin(pins, spark.createDataFrame(rows, "district_name string, state_name string, village_name string, level string"))
    counts = found.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in counts) == 50 * 400 and len(counts) == 4


def test_the_audit_query_returns_every_row_whole(spark, monkeypatch):
    from types import SimpleNamespace

    from pataspark.plans import address
    from pataspark.schemas import AUDIT_COLUMNS, INPUT_FIELDS
    from pataspark.workload import queries_data

    typed = ", ".join(f"{f} string" for f in INPUT_FIELDS)
    places = "line1 string, locality string, pincode string, city string, district string, state string"
    schema = (f"record_id long, job_id string, original struct<{typed}>, normalized struct<{typed}>, parsed struct<locality string>, enriched struct<{places}>, "
              "confidence struct<overall int, parsing_completeness int, locality_match int, pincode_validity int>, pin_resolved boolean")
    raw = {f: f" {f} " for f in INPUT_FIELDS}
    clean = {f: f for f in INPUT_FIELDS}
    whole = clean | {"locality": "here", "city": "elsewhere"}
    done = spark.createDataFrame([(i, "j", raw, clean, {"locality": None}, {k: whole[k] for k in ("line1", "locality", "pincode", "city", "district", "state")},
                                   {"overall": 70, "parsing_completeness": 60, "locality_match": 90, "pincode_validity": 100}, True) for i in range(3)], schema)
    monkeypatch.setattr(address, "process_records", lambda *_, **__: done)
    rows = queries_data.k7_audit(SimpleNamespace(records=done, references=None))
    assert rows.columns == list(AUDIT_COLUMNS)
    got = rows.collect()
    assert len({r.id for r in got}) == len(got) == 3 * (len(INPUT_FIELDS) + 2)
    assert {(r.old_value, r.new_value, r.confidence, r.source_dataset) for r in got if r.processing_method in ("locality_match", "spell_correction")} == {
        (None, "here", 90, "rapidfuzz"), ("city", "elsewhere", 70, "rapidfuzz")}
