import datetime
import itertools
import json
import pathlib
import random
import time

import pytest
from pyspark.sql import functions as F

from shutterloom.config import FEATURES
from shutterloom.operators import dashboard, decide, learn
from shutterloom.plans import views
from shutterloom.sources import catalog
from shutterloom.storage import written
from shutterloom.streaming import watch


def test_listing(spark, tmp_path):
    for name in ("a.JPG", "b.txt", "sub/c.raf", "sub/_Keeps/d.nef", "other/e.png", "_Trash/f.jpg"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_bytes(b"x")
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.select("path").collect())
    assert names(catalog.scan_photos(spark, str(tmp_path))) == ["a.JPG", "c.raf", "e.png"]
    assert names(catalog.scan_photos(spark, str(tmp_path), False)) == ["a.JPG"]
    files = spark.createDataFrame([(f"/r/{x}",) for x in ("a.jpg", "s/b.jpg", "s/t/c.jpg", "u/d.txt", "_Keeps/e.jpg", "v/f.nef")], "path string")
    assert catalog.subfolder_photo_counts(files, "/r/").first()[0] == 2


def test_listing_below_a_decision_folder(spark, tmp_path):
    """What the root itself lies in hides nothing."""
    root = tmp_path / "_Keeps" / "shoot"
    for name in ("a.jpg", "sub/b.jpg", "_Trash/c.jpg"):
        path = root / name
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_bytes(b"x")
    (tmp_path / "_Keeps" / "beside.jpg").write_bytes(b"x")
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.select("path").collect())
    assert names(catalog.scan_photos(spark, str(root))) == ["a.jpg", "b.jpg"]
    assert names(catalog.scan_photos(spark, f"{root}/", False)) == ["a.jpg"]


def test_unfinished_of_a_root(spark):
    files = spark.createDataFrame([("/r/a.jpg",), ("/r/b.JPG",), ("/r/s/c.nef",), ("/r/_Keeps/d.jpg",), ("/r/e.txt",), ("/rr/f.jpg",)], "path string")
    rows = [("/r/a.jpg", "done", "/r"), ("/r/b.JPG", "error", "/r"), ("/r/s/c.nef", "done", "/r/s"), ("/r/gone.jpg", "done", "/r")]
    images = spark.createDataFrame(rows, "file_path string, analysis_status string, source_folder string")
    assert tuple(catalog.unfinished(files, images, "/r/").first()) == ("/r", 3, 1, 2)
    assert tuple(catalog.unfinished(files, images, "/r", False).first()) == ("/r", 2, 1, 1)
    assert tuple(catalog.unfinished(files, images, "/none").first()) == ("/none", 0, 0, 0)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "/a", "u1", "/f", 5.0, "done"), (2, "/b", None, "/f", 5.0, "done"), (3, "/c", "u3", "/f", 5.0, "done")], "id long, file_path string, uuid string, source_folder string, sharpness_score double, analysis_status string")
    new = spark.createDataFrame([("/b", "n2", "/g", 6.0, 1), ("/b", "n2", "/g", 7.0, 2), ("/d", "n4", "/g", 8.0, 1), ("/c", "n3", "/g", None, 1)], "file_path string, uuid string, source_folder string, sharpness_score double, seq int")
    got = {r.file_path: (r.uuid, r.source_folder, r.sharpness_score, r.analysis_status) for r in catalog.upsert_images(old, new).collect()}
    assert got == {"/a": ("u1", "/f", 5.0, "done"), "/b": ("n2", "/f", 7.0, "done"), "/c": ("u3", "/f", None, "done"), "/d": ("n4", "/g", 8.0, "done")}
    failed = catalog.error_rows(old, spark.createDataFrame([("/a",), ("/z",)], "file_path string"))
    assert {r.file_path: r.analysis_status for r in failed.collect()} == {"/a": "error", "/b": "done", "/c": "done", "/z": "error"}


def test_latest_wins_and_manual_only(spark):
    table = spark.createDataFrame([("a", "keep"), ("b", "keep")], "sample_uuid string, decision string")
    batch = spark.createDataFrame([("a", "maybe", 1, False), ("a", "reject", 2, None), ("b", "reject", 1, True), (None, "keep", 1, False), ("c", "burn", 1, False)], "sample_uuid string, decision string, seq int, is_auto boolean")
    got = {r.sample_uuid: r.decision for r in catalog.upsert_training_samples(table, batch).collect()}
    assert got == {"a": "reject", "b": "keep"}
    log = catalog.upsert_shooting_log(table, spark.createDataFrame([("", "x", 1), ("d", "y", 1)], "sample_uuid string, decision string, seq int"))
    assert {r.sample_uuid for r in log.collect()} == {"a", "b", "d"}


def test_undo_delete_and_backfills(spark):
    images = spark.createDataFrame([(1, "u1", "/f/a.jpg", None), (2, None, "/f/b.jpg", "/x")], "id long, uuid string, file_path string, source_folder string")
    decided = spark.createDataFrame([(1, "keep"), (2, "keep")], "image_id long, decision string")
    samples = spark.createDataFrame([("u1", "keep"), ("u9", "keep")], "sample_uuid string, decision string")
    ids = spark.createDataFrame([(1,)], "id long")
    d, s = catalog.undo_decisions(decided, samples, images, ids)
    assert [r.image_id for r in d.collect()] == [2] and [r.sample_uuid for r in s.collect()] == ["u9"]
    bursts = spark.createDataFrame([(7, 1), (8, 2)], "id long, hero_image_id long")
    members = spark.createDataFrame([(7, 1), (7, 3), (8, 2), (8, 4), (9, 1)], "burst_id long, image_id long")
    left = catalog.delete_images({"images": images, "decisions": decided, "bursts": bursts, "burst_members": members, "training_samples": samples}, ids)
    assert left["images"].count() == left["decisions"].count() == 1 and left["training_samples"].count() == 2
    assert [r.id for r in left["bursts"].collect()] == [8] and sorted(r.image_id for r in left["burst_members"].collect()) == [2, 4]
    gone, left = decide.trash_rejects({"images": images, "decisions": decided.withColumn("decision", F.when(F.col("image_id") == 2, "reject").otherwise("keep"))})
    assert [r.file_path for r in gone.collect()] == ["/f/b.jpg"] and [r.id for r in left["images"].collect()] == [1] and left["decisions"].count() == 1
    assert [r.source_folder for r in catalog.backfill_source_folder(images).orderBy("id").collect()] == ["/f", "/x"]
    log = spark.createDataFrame([("u0", "L")], "sample_uuid string, lens_model string")
    once = catalog.backfill_shooting_log(images, log)
    assert {r.sample_uuid: r.lens_model for r in once.collect()} == {"u0": "L", "u1": None}
    assert catalog.backfill_shooting_log(images, once).count() == 2
    tables = {"images": images, "decisions": decided, "shooting_log": log, "training_samples": samples}
    for what, empty in (("log", {"shooting_log"}), ("model", {"training_samples"}), ("all", {"images", "decisions"})):
        after = catalog.reset(tables, what)
        assert {n for n, df in after.items() if df.count() == 0} == empty and all(df.schema == tables[n].schema for n, df in after.items())


def test_stale_features(spark):
    rows = spark.createDataFrame([('{"iso": 1.0, "aperture": 2.0}', 5), ('{"aperture": 2.0}', 5), ("junk", 5), (None, 5)], "features_json string, schema_version int")
    got = [(r.features_json, r.schema_version) for r in catalog.null_stale_features(rows, ["iso"], 6).collect()]
    assert json.loads(got[0][0]) == {"iso": None, "aperture": 2.0} and got[0][1] == 6
    assert got[1:] == [('{"aperture": 2.0}', 5), ("junk", 5), (None, 5)]


def test_move_plan_numbers_collisions(spark):
    images = spark.createDataFrame([(1, "/a/x.jpg", "/a"), (2, "/b/x.jpg", "/b"), (3, "/k/y.jpg", "/c"), (4, "/d/n", "/d")], "id long, file_path string, source_folder string")
    decided = spark.createDataFrame([(i, "keep") for i in (1, 2, 3, 4)], "image_id long, decision string")
    settings = spark.createDataFrame([("/a", "keep", "/k"), ("/b", "keep", "/k"), ("/c", "keep", "/k"), ("/d", "keep", "")], "source_folder string, decision string, dest_folder string")
    there = spark.createDataFrame([("/k/x.jpg",), ("/k/x_1.jpg",), ("/k/y.jpg",)], "path string")
    got = {r.id: r.dest_path for r in catalog.move_plan(images, decided, settings, there).collect()}
    assert got == {1: "/k/x_2.jpg", 2: "/k/x_3.jpg", 4: "/d/_Keeps/n"}


def test_move_plan_writes_no_more_for_more_collisions(spark, monkeypatch):
    """A name behind a number behind a number: as many tables are written however many names collide."""
    counts = []
    for n in (2, 60):
        rows = [(10 * k + j, f"/s{k}/IMG{'_1' * j}.jpg", f"/s{k}") for k in range(n) for j in range(3)]
        images = spark.createDataFrame(rows, "id long, file_path string, source_folder string")
        decided = images.select(F.col("id").alias("image_id"), F.lit("keep").alias("decision"))
        settings = images.select("source_folder").distinct().select("source_folder", F.lit("keep").alias("decision"), F.lit("/k").alias("dest_folder"))
        made = []
        monkeypatch.setattr(catalog, "written", lambda df, made=made: made.append(1) or written(df))
        got = {r.id: r.dest_path for r in catalog.move_plan(images, decided, settings, spark.createDataFrame([("/k/IMG_1_1.jpg",), ("/k/other.jpg",)], "path string")).collect()}
        taken = {"IMG_1_1"}
        for id, path, _ in sorted(rows):
            stem = path.rsplit("/", 1)[1][:-4]
            own = next(x for x in itertools.chain([stem], (f"{stem}_{k}" for k in itertools.count(1))) if x not in taken)
            taken.add(own)
            assert got[id] == f"/k/{own}.jpg"
        counts.append(len(made))
    assert counts[0] == counts[1]


def test_move_plan_equals_moving_one_by_one(spark):
    """Names that meet a numbered name of another photo, free numbers below taken ones, names that look numbered; a file is never written over."""
    rng = random.Random(6)
    names = ["IMG.jpg", "IMG_1.jpg", "IMG_1_1.jpg", "IMG_2.jpg", "IMG_01.jpg", "IMG", "a.tar.gz", "a_1.tar.gz", ".hidden", "x_1"]
    rows = [(i, f"/s{i}/{rng.choice(names)}", f"/s{i}") for i in range(1, 121)]
    images = spark.createDataFrame(rows, "id long, file_path string, source_folder string")
    decided = images.select(F.col("id").alias("image_id"), F.lit("keep").alias("decision"))
    dest = {i: f"/k{i % 3}" for i, _, _ in rows}
    settings = spark.createDataFrame([(f"/s{i}", "keep", d) for i, d in dest.items()], "source_folder string, decision string, dest_folder string")
    there = ["/k0/IMG.jpg", "/k0/IMG_5.jpg", "/k1/IMG_2.jpg", "/k2/IMG_1.jpg", "/k2/x_1_1", "/k0/IMG_01.jpg"]
    got = {r.id: r.dest_path for r in catalog.move_plan(images, decided, settings, spark.createDataFrame([(p,) for p in there], "path string")).collect()}
    taken, want = set(there), {}
    for i, path, _ in rows:
        name = pathlib.PurePosixPath(path.rsplit("/", 1)[1])
        tries = (f"{dest[i]}/{name.stem}{'_' + str(n) if n else ''}{name.suffix}" for n in itertools.count())
        want[i] = next(t for t in tries if t not in taken)
        taken.add(want[i])
    assert got == want


def test_sharpness_report(spark, tmp_path):
    one = spark.range(1).select(*(F.lit(n).alias(name) for n, name in enumerate(reversed(catalog.SHARPNESS_REPORT))), F.lit(0).alias("other"))
    catalog.export_sharpness_csv(one, str(tmp_path / "report"))
    files = [f.read_text().splitlines() for f in (tmp_path / "report").glob("*.csv")]
    assert {f[0] for f in files} == {"filename,normalized_score,p90_laplacian_variance,p90_tenengrad,p90_modified_laplacian,raw_score,width,height,classification,camera,path"}
    assert [row for f in files for row in f[1:]] == ["10,9,8,7,6,5,4,3,2,1,0"]


def test_features_round_trip(spark, sf_dir):
    photos = views.photos(spark, sf_dir)
    back = photos.select("id", learn.features_to_json(photos.columns).alias("j")).select("id", *learn.features_from_json(F.col("j")))
    direct = photos.select("id", *learn.features(photos.columns))
    assert len(FEATURES) == 31 and back.exceptAll(direct).count() == 0
    assert set(json.loads(photos.select(learn.features_to_json(photos.columns).alias("j")).first().j)) == set(FEATURES)


def test_corpus_floor_and_weights(spark):
    sample = lambda n: spark.createDataFrame([("keep", 50.0, datetime.datetime(2024, 1, 1), '{"iso": 100.0, "odd": 1.0}')] * n, "decision string, overall_score double, decided_at timestamp, features_json string")
    assert learn.training_corpus(sample(29)).count() == 0
    corpus = learn.training_corpus(sample(30))
    assert corpus.count() == 30 and corpus.first().iso == 100.0
    late = corpus.unionByName(corpus.withColumn("decided_at", F.lit("2024-06-29").cast("timestamp"))).unionByName(corpus.withColumn("decided_at", F.lit(None).cast("timestamp")))
    rows = learn.sample_weights(late, "2024-06-29 00:00:00").groupBy("decided_at").agg(F.first("weight").alias("w"), F.count("*").alias("n")).collect()
    w = {r.decided_at: r.w for r in rows}
    assert sum(r.w * r.n for r in rows) == pytest.approx(90)
    assert w[datetime.datetime(2024, 1, 1)] / w[None] == pytest.approx(0.5) and w[datetime.datetime(2024, 6, 29)] == pytest.approx(w[None])


def test_personal_model(spark, tmp_path):
    rows = [("keep" if i % 2 else "reject", 50.0, 1.0, datetime.datetime(2024, 1, 1), float(i % 2) * 80 + i % 7) for i in range(120)]
    corpus = spark.createDataFrame(rows, "decision string, overall_score double, weight double, decided_at timestamp, sharpness double")
    corpus = corpus.select("decision", "overall_score", "weight", "decided_at", *[(F.col("sharpness") if f == "sharpness_score" else F.lit(float("nan"))).alias(f) for f in FEATURES])
    model = learn.train_personal(corpus, trees=5)
    images = spark.createDataFrame([(1, 50.0, 85.0), (2, 50.0, 3.0), (3, None, 85.0), (4, 95.0, 85.0), (5, 50.0, None)], "id long, overall_score double, sharpness_score double")
    got = {r.id: r.personal_score for r in learn.predict_personal(model, images).collect()}
    assert got[1] > 55 > 45 > got[2] and got[3] is None and 95 <= got[4] <= 100 and 25 <= got[5] <= 75
    assert learn.importances(spark, model).orderBy(F.desc("importance")).first().feature == "sharpness_score"
    assert {r.id: r.personal_std for r in learn.predict_with_uncertainty(model, None, images).collect()}[1] == 0.0
    learn.save_model(model, str(tmp_path / "m"), spark)
    again = {r.id: r.personal_score for r in learn.predict_personal(learn.load_model(str(tmp_path / "m"), spark), images).collect()}
    assert again == got
    spark.createDataFrame([('{"schema_version": 5, "n_features": 31}',)], "value string").coalesce(1).write.mode("overwrite").text(str(tmp_path / "m/meta"))
    with pytest.raises(ValueError):
        learn.load_model(str(tmp_path / "m"), spark)
    result = learn.validate(corpus.limit(40), trees=3).first()
    assert 0 <= result.accuracy <= 1 and result.splits == 8
    assert tuple(learn.validate(corpus.limit(4)).first()) == (0.0, 0.0, False, 0.0, 0)


def test_deltas_list_every_feature_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "decision string, decided_at timestamp, features_json string")
    got = dashboard.signal_flags(dashboard.feature_deltas(empty)).collect()
    assert len(got) == 31 and all(r.weak and r.low_sample and r.keep_median is None for r in got)
    rows = [("keep", None, '{"iso": 200.0}')] * 2 + [("reject", None, '{"iso": 6400.0}')] * 2 + [("keep", None, "junk")]
    some = dashboard.feature_deltas(spark.createDataFrame(rows, "decision string, decided_at timestamp, features_json string")).where("feature = 'iso'").first()
    assert tuple(some)[1:] == (200.0, 6400.0, 2, 2)


def test_watch_routes_failures(spark):
    batch = spark.createDataFrame([("/a", (1.0,)), ("/b", None), ("/c", None)], "file_path string, pixels struct<mean:double>")
    ok, failed = watch.route_failures(batch, spark.createDataFrame([("/a",), ("/b",)], "path string"))
    assert [r.file_path for r in ok.collect()] == ["/a"] and [r.file_path for r in failed.collect()] == ["/b"]
    images = spark.createDataFrame([("/a",), ("/b",)], "file_path string")
    assert watch.apply_deletes(images, spark.createDataFrame([("deleted", "/a"), ("created", "/b")], "kind string, path string")).count() == 1


def test_training_is_due_on_one_grid():
    fired, seen = [], 0
    for size in (29, 1, 0, 5, 20, 4, 100, 1):
        fired += watch.due_between(seen, seen + size, 30, 10).tolist()
        seen += size
    assert fired == list(range(30, seen + 1, 10))


def test_late_rows_are_counted(spark, tmp_path):
    rows = [("00:00:00", "00:00:01", "00:10:00"), ("00:20:00", "00:20:01"), ("00:00:02", "00:30:00")]
    for n, times in enumerate(rows):
        frame = spark.createDataFrame([("o", f"2024-01-01 {t}") for t in times], "owner string, t string")
        frame.select("owner", F.col("t").cast("timestamp").alias("shot_at")).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    late = watch.LateRows()
    spark.streams.addListener(late)
    try:
        for n in range(3):
            stream = spark.readStream.schema("owner string, shot_at timestamp").parquet(str(tmp_path / f"in/[0-{n}]"))
            query = watch.stream_bursts(stream, "owner").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
        name, deadline = str(query.id), time.time() + 20
        while late.dropped[name] < 1 and time.time() < deadline:
            time.sleep(0.2)
        assert late.dropped[name] == 1
    finally:
        spark.streams.removeListener(late)


def test_retrain_trigger(spark, tmp_path):
    for n, size in enumerate((29, 5, 20)):
        spark.createDataFrame([("o", i) for i in range(size)], "owner string, image_id long").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema("owner string, image_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = watch.retrain_trigger(stream).writeStream.format("memory").queryName("due").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    fired = sorted(r.samples for r in spark.sql("SELECT * FROM due").collect())
    assert fired[0] >= 30 and len(fired) == 3 and all(b - a >= 10 for a, b in zip(fired, fired[1:], strict=False))
