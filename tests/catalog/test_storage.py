import pathlib

import pytest

from shutterloom import storage


def test_scratch_is_deleted_and_nothing_else(spark):
    kept = storage.written(spark.range(5))
    with storage.scratch(spark) as folder:
        inside = storage.written(spark.range(7))
        assert all(folder in f for f in inside.inputFiles()) and inside.count() == 7
        with storage.scratch(spark) as deeper:
            assert all(deeper in f for f in storage.written(spark.range(1)).inputFiles())
        assert all(folder in f for f in storage.written(spark.range(1)).inputFiles())
        assert not pathlib.Path(deeper).exists() and pathlib.Path(folder).exists()
    assert not pathlib.Path(folder).exists() and kept.count() == 5
    with pytest.raises(ZeroDivisionError):
        with storage.scratch(spark) as folder:
            storage.written(spark.range(1))
            1 / 0
    assert not pathlib.Path(folder).exists() and storage.open_scratch() is None


def test_folder_of_small_files_is_read_by_few_tasks(spark, tmp_path):
    """A thousand files are a task for each core, not one for every thirty; the settings are as before afterwards."""
    for n in range(1000):
        (tmp_path / f"{n}.png").write_bytes(b"x")
    read = lambda: spark.read.format("binaryFile").load(str(tmp_path)).rdd.getNumPartitions()
    usual, name = read(), "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    with storage.settings(spark, storage.small_files(spark)):
        assert read() <= spark.sparkContext.defaultParallelism + 1 < usual
        assert int(spark.conf.get(name)) == 8 * spark.sparkContext.defaultParallelism
    assert read() == usual and spark.conf.get(name) == before


def test_watched_folder_lists_in_few_tasks(spark, tmp_path):
    """What the stream has seen is listed by a bounded number of tasks, however many files came."""
    from shutterloom.plans import live

    rows = [(n, "some text") for n in range(300)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    store, first = spark.sparkContext._jsc.sc().statusStore(), scheduler.nextJobId()
    assert live.w1_watched_folder(spark, str(tmp_path)).count() == 300
    tasks = [store.job(n).numTasks() for n in range(first, scheduler.nextJobId())]
    assert max(tasks) <= 8 * spark.sparkContext.defaultParallelism


def test_small_table_is_spread_over_all_cores(spark):
    rows = storage.written(storage.spread(spark.range(1000).coalesce(1), "id"))
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and rows.count() == 1000


def test_frames_are_measured_in_small_batches(spark, sf_dir, monkeypatch):
    from shutterloom.plans import coverage

    seen, name = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    monkeypatch.setattr(coverage, "written", lambda df: seen.append(spark.conf.get(name)) or df)
    coverage.p_frames(spark, sf_dir)
    coverage.p_measures(spark, sf_dir)
    assert seen == ["64", "64"] and spark.conf.get(name) == before


def test_images_are_read_a_few_folders_at_once(spark, tmp_path, monkeypatch):
    """The driver never has the files of all folders; all of them are read once."""
    from shutterloom.plans import live
    from shutterloom.sources import catalog

    spark.createDataFrame([(n, "some text") for n in range(90)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    seen, load = [], catalog.load_images
    monkeypatch.setattr(catalog, "load_images", lambda spark, path: seen.append(load(spark, path)) or seen[-1])
    monkeypatch.setattr(live, "FOLDER_FILES", 10)
    got = {r.doc_id: (r.height, r.width, r.bytes) for r in live.s2_images(spark, str(tmp_path)).collect()}
    assert got == {n: (None, None, None) if n % 50 == 7 else (1, 64, 64) for n in range(90)}
    assert len(seen) == 3 and max(len(df.inputFiles()) for df in seen) <= 40


def test_images_beside_folders_are_read(spark, tmp_path):
    from shutterloom.plans import live
    from shutterloom.sources import catalog

    for name in ("a.png", "x/b.png", "y/c.png", "x/deeper/d.png", "_aside/e.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(live._bitmap(b"abc"))
    origins = [r[0] for df in catalog.load_image_folders(spark, str(tmp_path), 1) for r in df.select("image.origin").collect()]
    assert sorted(x.rsplit("/", 1)[1] for x in origins) == ["a.png", "b.png", "c.png"]


def test_dropped_tables_are_gone(spark):
    kept, gone = storage.written(spark.range(5)), storage.written(spark.range(5))
    files = [pathlib.Path(f.removeprefix("file:").replace("///", "/")) for f in gone.inputFiles()]
    storage.dropped(gone)
    assert files and not any(f.exists() or f.parent.exists() for f in files) and kept.count() == 5
