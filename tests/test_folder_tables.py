"""Queries over tables that are folders of several files, as larger tables are."""

import pytest

from kinetable.plans.registry import QUERIES, load_all

load_all()

TEXTS = ["a  Basementé there", None, "", "therouou then, thinly", "no such word", "hein\nthe heention", "xKy"]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The same rows as single files' worth of partitions and as folders of several files."""
    root = tmp_path_factory.mktemp("folders")
    docs = [(i, TEXTS[i % len(TEXTS)]) for i in range(35)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(f"{root}/documents.parquet")
    words = [(f"b{i}", t) for i, t in enumerate(["therouou heention basement", "nothing there"])]
    spark.createDataFrame(words, "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
    events = [(i, f"2024-01-01 0{i % 3}:10:00", i % 4, "ab"[i % 2], float(i)) for i in range(40)]
    made = spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, value double")
    made.withColumn("ts", made.ts.cast("timestamp")).repartition(3).write.parquet(f"{root}/events.parquet")
    return str(root)


@pytest.mark.parametrize(("stream", "batch"), [
    ("t4_screen_lists_stream", "x22_screen"), ("t4_screen_many_terms_stream", "x22_screen_many_terms"), ("t1_telemetry_stream", "t1_telemetry_windows"),
])
def test_a_stream_of_a_folder_equals_its_batch_twin(spark, folders, stream, batch):
    rows = lambda name: sorted(map(repr, QUERIES[name](spark, folders).collect()))
    assert rows(stream) == rows(batch) != []


def test_streams_read_every_file_of_a_folder_once(spark, folders):
    seen = QUERIES["t4_screen_stream"](spark, folders).collect()
    assert sorted(r.doc_id for r in seen) == list(range(35))
    assert {r.doc_id % len(TEXTS) for r in seen if r.message.startswith("PATTERN")} == {0}
    assert {r.op: r.n for r in QUERIES["t3_refresh_partials_stream"](spark, folders).collect()} == {"a": 20, "b": 20}
