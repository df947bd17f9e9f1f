"""Indexes built in batches, and streams over repeated and late files."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from lodestone import streaming
from lodestone.sources.batches import IndexBuild

ROWS = [(i, [float(i), 1.0, 0.0] if i % 7 else [0.0, 0.0, 0.0], f"t{i}") for i in range(60)] + [(3, [3.0, 1.0, 0.0], "t3"), (None, [1.0, 1.0, 1.0], None)]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "vec_id long, embedding array<float>, text string")


def bag(df):
    return sorted((tuple(map(repr, r)) for r in df.select("vec_id", "embedding", "text").collect()))


def test_a_killed_build_goes_on(spark, rows, tmp_path):
    whole = IndexBuild(spark, str(tmp_path / "whole"), 5)
    whole.stage(rows)
    whole.run()
    path = f"file://{tmp_path}/killed"
    build = IndexBuild(spark, path, 5)
    build.stage(rows)
    build.run([1, 3])
    build.attempt(2)  # killed before its manifest
    assert build.pending() == [0, 2, 4] and not build.metadata().first().complete
    with pytest.raises(ValueError, match="3 of 5"):
        build.read()
    build.stage(rows.limit(1))  # staged already
    again = IndexBuild(spark, path, 5)
    late = again.attempt(4)
    again.run()
    assert not again.commit(late) and not again.commit(again.attempt(1))  # each batch once
    assert bag(again.read()) == bag(whole.read()) and len(bag(whole.read())) == len(ROWS)
    assert again.metadata().first().asDict() == {"n_vectors": 62, "dim": 3, "n_batches": 5, "complete": True}
    assert not [f for f in os.listdir(tmp_path / "killed/manifests") if f.startswith("_")]


def test_lost_files_are_found(spark, rows, tmp_path):
    build = IndexBuild(spark, str(tmp_path / "x"), 3)
    build.stage(rows)
    build.run()
    assert build.damaged() == []
    folders = [r.folder for r in build.manifests().orderBy("batch").collect()]
    shutil.rmtree(folders[1])
    spark.read.parquet(folders[2]).limit(1).write.parquet(folders[2] + "x")
    shutil.rmtree(folders[2])
    os.rename(folders[2] + "x", folders[2])
    assert build.damaged() == [1, 2]


def test_an_index_of_nothing_and_its_order(spark, rows, tmp_path):
    none = IndexBuild(spark, str(tmp_path / "none"), 2)
    assert none.pending() == [0, 1] and none.metadata().first().n_vectors == 0
    with pytest.raises(ValueError, match="no batch"):
        none.read(partial=True)
    none.stage(rows.where("false"))
    none.run()
    assert none.read().count() == 0 and none.metadata().first().complete
    build = IndexBuild(spark, str(tmp_path / "y"), 3, encode=lambda df: df.withColumn("text", F.upper("text")))
    build.stage(rows.where("vec_id IS NOT NULL"))
    build.run()
    out = build.publish(str(tmp_path / "out"))
    assert [r.text for r in out.orderBy("pos").collect()] == ["T0", "T1", "T2", "T3", "T3", *[f"T{i}" for i in range(4, 60)]]


SCHEMA = "id long, ts timestamp_ntz, event_type string, value double, k string"
T0 = dt.datetime(2024, 1, 1)


def event(i, minute, k="u"):
    return (i, T0 + dt.timedelta(minutes=minute), "click", 1.0, k)


def deliver(spark, folder, *rows):
    """One file, later than those before."""
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def test_a_file_counts_once_by_path_or_name(spark, tmp_path):
    deliver(spark, tmp_path / "in", event(1, 0))
    deliver(spark, tmp_path / "in", event(2, 1))
    run = lambda by_name: streaming.drain(streaming.read(spark, str(tmp_path / "in"), by_name), str(tmp_path / f"checkpoint{by_name}"), str(tmp_path / f"out{by_name}")).count()
    assert run(True) == run(False) == 2
    (tmp_path / "in/again").mkdir()
    name = next(f for f in os.listdir(tmp_path / "in") if f.endswith(".parquet"))
    shutil.copy(tmp_path / "in" / name, tmp_path / "in/again" / name)
    assert (run(True), run(False)) == (2, 3)
    deliver(spark, tmp_path / "in", event(3, 2))
    assert (run(True), run(False)) == (3, 4)


def test_keys_are_known_across_files_until_the_watermark_passes(spark, tmp_path):
    folder = tmp_path / "in"
    deliver(spark, folder, event(1, 0), event(1, 0), event(2, 5))
    deliver(spark, folder, event(1, 0), event(3, 300))
    deliver(spark, folder, event(4, 290), event(3, 300))
    deliver(spark, folder, event(5, 1), event(6, 310))  # the first is hours late
    seen = []
    got = streaming.files_once(spark, str(folder), ["id"], seen=seen, files=1)
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 4, 6] and streaming.late_rows(seen) == 1
    # Keys whose time the watermark has passed are no longer held.
    assert seen[-1]["stateOperators"][0]["numRowsTotal"] <= 3


def test_windows_and_sessions_are_closed_at_the_end(spark, tmp_path):
    folder = tmp_path / "in"
    deliver(spark, folder, event(1, 0), event(2, 10), event(3, 25, "v"))
    deliver(spark, folder, event(4, 35), event(5, 100))
    minute = lambda t: int((t - T0).total_seconds() // 60)
    read = lambda: streaming.read(spark, str(folder))
    tumbling = streaming.to_the_end(read(), lambda s: streaming.windows(s, "30 minutes"))
    assert sorted((minute(r.window_start), r.n) for r in tumbling.collect()) == [(0, 3), (30, 1), (90, 1)]
    sliding = streaming.to_the_end(read(), lambda s: streaming.windows(s, "30 minutes", "15 minutes"))
    assert sorted((minute(r.window_start), r.n) for r in sliding.collect()) == [(-15, 2), (0, 3), (15, 2), (30, 1), (75, 1), (90, 1)]
    sessions = streaming.to_the_end(read(), lambda s: streaming.sessions(s, "k", "20 minutes"))
    assert sorted((r.k, minute(r.session_start), minute(r.session_end), r.n) for r in sessions.collect()) == [("u", 0, 10, 2), ("u", 35, 35, 1), ("u", 100, 100, 1), ("v", 25, 25, 1)]


def test_dumps_of_articles_are_written_by_many_tasks(spark, tmp_path):
    """Batches are folders of any number of files."""
    import inspect

    from lodestone import sources
    from lodestone.plans import formats

    assert "coalesce(1)" not in inspect.getsource(formats.article_dumps)
    rows = spark.range(8).selectExpr("concat('d', id) AS id", "'t' AS title", "'u' AS url", "array(array('x')) AS text")
    for name in ("AA", "AB"):
        rows.repartition(3).write.option("compression", "bzip2").json(f"{tmp_path}/{name}")
    assert {r.file: r["count"] for r in sources.read_articles(spark, str(tmp_path), batch="folder").groupBy("file").count().collect()} == {0: 8, 1: 8}
