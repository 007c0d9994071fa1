"""Files on disk: lake layout, sidecars, captions and plans."""

import json

from pyspark.sql import functions as F

from kinetable.sources import lake as L, manifests as M


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_lake_round_trip_and_pruning(spark, tmp_path):
    frames = spark.range(5000).select(F.lit(3).alias("dataset_id"), (F.floor(F.col("id") / 250) * 130).alias("episode_index"), (F.col("id") % 250).alias("frame_index"), F.array(F.rand(1)).alias("state"))
    L.write_lake(frames, str(tmp_path / "lake"))
    data = tmp_path / "lake" / "3" / "data"
    assert sorted(p.name for p in data.iterdir()) == ["chunk-000", "chunk-001", "chunk-002"]
    assert (data / "chunk-001" / "episode_001300.parquet").exists() and not (tmp_path / "lake" / "_writing").exists()
    back = L.read_frames(spark, str(tmp_path / "lake" / "3"))
    assert back.where("file_episode = episode_index").count() == 5000
    assert "state" not in _plan(back.select("episode_index")).split("ReadSchema")[-1]
    meta = spark.read.schema(L.EPISODE_SCHEMA).json(str(tmp_path / "lake" / "3" / "meta" / "episodes.jsonl"))
    assert meta.count() == 20 and meta.where("length <> 250").count() == 0
    found = L.discover(L.list_files(spark, str(tmp_path / "lake")), str(tmp_path / "lake")).collect()
    assert len(found) == 1 and found[0][0].endswith("/lake/3")


def test_lake_writing_is_taken_up_again(spark, tmp_path, monkeypatch):
    """A finish that breaks off half way can be repeated; files in the way are found before any is moved."""
    import pyarrow.fs
    import pytest

    frames = spark.range(60).select(F.concat(F.lit("a b+c%"), (F.col("id") % 3).cast("string")).alias("dataset_id"), (F.col("id") / 6).cast("long").alias("episode_index"), F.col("id").alias("frame_index"))
    root = tmp_path / "lake"
    monkeypatch.setattr(L, "finish_lake", lambda *a: None)
    L.write_lake(frames, str(root))
    monkeypatch.undo()
    manifest = spark.read.parquet(str(root / "_writing" / "manifest")).collect()
    assert len(manifest) == 33
    store = pyarrow.fs.LocalFileSystem()
    for source, target in manifest[:10]:
        (root / target.split("/lake/")[1]).parent.mkdir(parents=True, exist_ok=True)
        store.move(source.removeprefix("file:"), target)
    assert L.finish_lake(spark, str(root)) == 33
    assert sorted(p.name for p in root.iterdir()) == ["a b+c%0", "a b+c%1", "a b+c%2"]
    assert len(list(root.glob("*/data/chunk-000/episode_00000*.parquet"))) == 30 and len(list(root.glob("*/meta/episodes.jsonl"))) == 3
    with pytest.raises(Exception, match="cannot write"):
        L.write_lake(frames, str(root))


def test_read_frames_takes_the_episode_from_the_file_name(spark, tmp_path):
    d = tmp_path / "ds" / "data" / "chunk-000"
    d.mkdir(parents=True)
    import pandas as pd

    for ep in (0, 42):
        pd.DataFrame({"frame_index": range(ep + 1)}).to_parquet(d / f"episode_{ep:06d}.parquet")
    got = {r.file_episode: r["count"] for r in L.read_frames(spark, str(tmp_path / "ds")).groupBy("file_episode").count().collect()}
    assert got == {0: 1, 42: 43}
    lengths = L.read_frames(spark, str(tmp_path / "ds")).groupBy("file_episode").agg(F.count("frame_index"))
    assert lengths.count() == 2


def test_discover_prefers_the_root_itself(spark, tmp_path):
    for ds in (tmp_path / "a", tmp_path / "a" / "child", tmp_path / "b"):
        (ds / "data" / "c").mkdir(parents=True)
        (ds / "meta").mkdir()
        (ds / "data" / "c" / "episode_0.parquet").write_bytes(b"x")
        (ds / "meta" / "info.json").write_text("{}")
    (tmp_path / "c" / "data" / "c").mkdir(parents=True)
    (tmp_path / "c" / "data" / "c" / "episode_0.parquet").write_bytes(b"x")
    names = lambda root: sorted(r.dataset_path.rsplit("/", 1)[1] for r in L.discover(L.list_files(spark, str(root)), str(root)).collect())
    assert names(tmp_path) == ["a", "b"]
    assert names(tmp_path / "a") == ["a"]


def test_info_sidecar_with_fallbacks(spark, tmp_path):
    meta = tmp_path / "meta"
    meta.mkdir()
    info = {"fps": 10, "splits": {"train": "0:7"}, "features": {
        "cam": {"dtype": "video", "shape": [480, 640, 3], "names": ["height", "width", "channel"], "video_info": {"video.fps": 25}},
        "wrist": {"dtype": "video", "shape": [3, 240, 320], "names": None}}}
    (meta / "info.json").write_text(json.dumps(info, indent=2))
    df = L.read_meta(spark, str(tmp_path), ["info"])["info"]
    rows = {r.key: (r.height, r.width, r.channels, r.resolved_fps) for r in L.video_features(L.feature_rows(df), F.col("default_fps")).collect()}
    assert rows == {"cam": (480, 640, 3, 25.0), "wrist": (240, 320, 3, 10.0)}
    assert [tuple(r)[1:] for r in L.split_specs(df).collect()] == [("train", "0:7")]


def test_caption_folders(spark, tmp_path):
    (tmp_path / "captions").mkdir()
    (tmp_path / "captions" / "a.json").write_text('{"m": {"short": "s", "long": "l"}}')
    (tmp_path / "captions" / "b.json").write_text('"m": {"short": "only"}')
    (tmp_path / "captions" / "c.json").write_text("broken")
    got = {r.stem: r.caption for r in M.load_captions(spark, str(tmp_path), "long").collect()}
    assert got == {"a": "l", "b": "only", "c": ""}
    (tmp_path / "t" / "metas").mkdir(parents=True)
    (tmp_path / "t" / "metas" / "x.txt").write_text("  hi there\n")
    assert [(r.stem, r.caption) for r in M.load_captions(spark, str(tmp_path / "t")).collect()] == [("x", "hi there")]


def test_prompt_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text('video,prompt\na/1.mp4,pick, then place\nb/2.mp4,"quoted, text"\n')
    got = {r.clip: r.prompt for r in M.prompts_from_csv(spark, str(tmp_path / "m.csv"), "P: ").collect()}
    assert got == {"1.mp4": "P: pick, then place", "2.mp4": "P: quoted, text"}


def test_shared_folder_follows_the_session(spark):
    from kinetable.session import scratch_path, shared_folder

    assert scratch_path(spark, "x").startswith(shared_folder(spark).rstrip("/"))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_listing_a_lake_takes_no_task_for_each_episode(spark, tmp_path):
    sc, root = spark.sparkContext, str(tmp_path / "lake")
    rows = [(d, e, f, [float(e), float(f)]) for d in (0, 1) for e in range(60) for f in range(2)]
    frames = spark.createDataFrame(rows, "dataset_id long, episode_index long, frame_index long, vec array<double>")
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    sc.setJobGroup("lake-listing", "lake")
    try:
        L.write_lake(frames, root)
        back = L.read_frames(spark, [f"{root}/0", f"{root}/1"])
        assert back.count() == len(rows)
        jobs = sc.statusTracker().getJobIdsForGroup("lake-listing")
        stages = [sc.statusTracker().getStageInfo(s) for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    # Two datasets of 60 episodes: Spark would plan 60 tasks for the folders of each, and 120 for the files.
    assert 0 < max(s.numTasks for s in stages if s) < 60
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before


def test_lake_files_take_no_folder_each_and_frames_are_made_once(spark, tmp_path, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    frames = spark.range(400).selectExpr("id % 2 AS dataset_id", "id div 4 AS episode_index", "id AS frame_index")
    monkeypatch.setattr(L, "finish_lake", lambda *a: None)
    L.write_lake(frames.mapInPandas(seen, frames.schema), str(tmp_path / "lake"))
    # 200 files of 100 episodes in two datasets, each written once from rows made once.
    assert made.value == 400
    assert len(list((tmp_path / "lake" / "_writing" / "data").glob("**/*.parquet"))) == 200
    assert sum(p.is_dir() for p in (tmp_path / "lake").rglob("*")) < 60
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        listed = L.list_files(spark, str(tmp_path / "lake" / "_writing" / "data"), "*.parquet")
        assert listed.rdd.getNumPartitions() <= 2 and listed.count() == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lake_files_keep_types_values_and_lengths(spark, tmp_path):
    """Episodes longer than a batch, odd names, nulls and types of Spark's own come back as they went."""
    import pytest

    frames = spark.range(90).select(
        F.when(F.col("id") < 30, F.lit("")).when(F.col("id") >= 60, F.lit("b/c d")).alias("dataset_id"),
        F.when(F.col("id") % 30 < 25, 1_234_567).otherwise(-3).alias("episode_index"), (F.col("id") % 7).alias("frame_index"),
        F.expr("CASE WHEN id % 3 > 0 THEN array(id, NULL) END").alias("vec"), F.expr("map('k', named_struct('a', id))").alias("m"),
        F.expr("timestamp_micros(id - 9999999999999999)").alias("ts"), F.expr("timestamp_ntz '2020-01-02 03:04:05'").alias("ntz"),
        F.expr("date '1500-01-01' + CAST(id AS INT)").alias("day"), F.expr("CAST(id AS DECIMAL(25, 3))").alias("dec"),
        F.expr("make_dt_interval(0, 0, 0, id)").alias("span"), F.expr("encode(CAST(id AS STRING), 'utf-8')").alias("raw"), F.lit(2).cast("byte").alias("b"),
    )
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, root = spark.conf.get(size), str(tmp_path / "lake")
    try:
        spark.conf.set(size, "7")
        L.write_lake(frames, root)
    finally:
        spark.conf.set(size, before)
    null = f"{root}/__HIVE_DEFAULT_PARTITION__"
    names = sorted(str(p.relative_to(root)) for p in (tmp_path / "lake").rglob("*.parquet"))
    assert names == [f"{d}/data/{e}.parquet" for d in ("__HIVE_DEFAULT_PARTITION__", "b/c d") for e in ("chunk--01/episode_-00003", "chunk-1234/episode_1234567")]
    back = L.read_frames(spark, [null, f"{root}/b/c d"]).drop("dataset_path", "file_episode")
    assert back.schema.simpleString() == frames.schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, frames.collect()))
    lengths = spark.read.schema(L.EPISODE_SCHEMA).json(f"{null}/meta/episodes.jsonl").select("episode_index", "length").collect()
    assert [tuple(x) for x in lengths] == [(-3, 10), (1_234_567, 50)]
    L.write_lake(frames.limit(0), str(tmp_path / "none"))
    assert not list((tmp_path / "none").rglob("*.parquet"))
    with pytest.raises(Exception, match="no episode number"):
        L.write_lake(frames.withColumn("episode_index", F.lit(None).cast("long")), str(tmp_path / "unnumbered"))


def test_read_frames_takes_only_files_of_chunk_folders(spark, tmp_path):
    one = spark.createDataFrame([(1,)], "frame_index long").coalesce(1)
    for place in ("chunk-000/episode_000001.parquet", "chunk=7/episode_000002.parquet", "deep/er/episode_000003.parquet"):
        one.write.parquet(str(tmp_path / "ds" / "data" / place))
    (tmp_path / "ds" / "data" / "chunk-000" / "notes.txt").write_text("no table")
    back = L.read_frames(spark, str(tmp_path / "ds"))
    assert back.columns == ["frame_index", "dataset_path", "file_episode"]
    assert back.count() == 2
