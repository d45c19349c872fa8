"""The pipeline on a small folder, stage by stage."""

import random

from texts import prose

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(17)
    item = prose(rng, 40)
    rows = [(i, prose(rng, 80), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, prose(rng, 30) + " you vexlor. " + prose(rng, 30), "en", "s0", 1) for i in range(20)]
    rows += [(200 + i, rows[i][1], "en", "s1", 1) for i in range(10)] + [(300, prose(rng, 20) + " " + item, "en", "s2", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 200)) for i, *_ in rows if i is not None and i < 300], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept, at = docs, []
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        at.append({r.doc_id for r in kept.collect()})
    assert at[0] == {i for i, *_ in rows} - set(range(100, 120))
    assert at[1] == at[0] - set(range(200, 210))
    assert at[2] == at[1] - {300}
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*docs.columns, "shard", "slot"]
    assert {r.doc_id for r in got.collect()} <= at[2]


def test_one_of_each_tells_texts_of_one_id_apart(spark, tmp_path):
    rng = random.Random(18)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    rows = [(1, a, "z"), (1, b, "y"), (2, b, "x"), (2, b, "w"), (3, c, "v"), (3, c, "u"), (None, a, "t"), (None, d, "s"), (None, d + " end", "r"), (None, None, "q"), (None, " ", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for n in (1, 7):
        got = corpus_pipeline.one_of_each(spark, docs.repartition(n), str(tmp_path)).collect()
        unnamed = [r.source for r in got if r.doc_id is None]
        assert sorted((r.doc_id, r.source) for r in got if r.doc_id is not None) == [(1, "y"), (1, "z"), (3, "u")]
        assert len(unnamed) == 3 and {"p", "q"} < set(unnamed) and set(unnamed) & {"r", "s"}


def test_stages_take_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
