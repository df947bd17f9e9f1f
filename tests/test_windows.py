"""Interval joins, windows over whole tables, and the JSON array sink against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import intervals, ranks, rows, skew
from lodestone.sources import read_json, write_json

SPANS = "id int, k string, start long, end long"


def spans(n, seed, first):
    """Points, short intervals, a few that cover nearly everything, empty ones and nulls."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        start = r.randint(-200, 200)
        out.append((first + i, r.choice("ab"), start, start + r.choice([0, 0, 3, 10, 40, 2000 if i % 20 == 0 else 5])))
    return [*out, (first + n, "a", 5, 1), (first + n + 1, "a", None, 9), (first + n + 2, None, 0, 9), (first + n + 3, "a", 0, None)]


@pytest.mark.parametrize("by, width", [(["k"], None), ([], None), (["k"], 1), ([], 100_000)])
def test_overlaps_equal_all_pairs(spark, by, width):
    left, right = spans(80, 1, 0), spans(80, 2, 1000)
    pairs = intervals.overlap_join(spark.createDataFrame(left, SPANS), spark.createDataFrame(right, SPANS), by, width)
    got = sorted((r.l.id, r.r.id) for r in pairs.collect())
    fits = lambda x: None not in x[2:] and x[2] <= x[3]
    want = sorted((a[0], b[0]) for a in left for b in right if fits(a) and fits(b) and (not by or a[1] == b[1] is not None) and a[2] <= b[3] and b[2] <= a[3])
    assert got == want != []


def test_near_pairs_and_empty_sides(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([0, 1, 5, 6, 6, 20, -3, None])], "id int, at long")
    got = {(r.l.id, r.r.id) for r in intervals.within(df, df, 4, "at", []).collect()}
    values = {i: x for i, x in enumerate([0, 1, 5, 6, 6, 20, -3])}
    assert got == {(a, b) for a in values for b in values if abs(values[a] - values[b]) <= 4}
    assert intervals.within(df, df.where("false"), 4, "at", []).count() == 0


@pytest.mark.parametrize("hot", [4, 1000])
def test_ranks_with_ties_nulls_and_a_frequent_value(spark, monkeypatch, hot):
    monkeypatch.setattr(skew, "HOT", hot)
    monkeypatch.setattr(ranks, "HOT", hot)
    r = random.Random(3)
    values = [r.choice([1.5, 2.5, None, 7.0, 7.0, 7.0, r.random()]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double").repartition(6)
    df.createOrReplaceTempView("ranked")
    want = spark.sql("SELECT id, v, rank() OVER o, dense_rank() OVER o, percent_rank() OVER o, cume_dist() OVER o FROM ranked WINDOW o AS (ORDER BY v)")
    assert sorted(map(tuple, ranks.ranks(df, "v").collect())) == sorted(map(tuple, want.collect()))
    for n in (1, 7, 299, 300, 400):
        want = spark.sql(f"SELECT id, v, ntile({n}) OVER (ORDER BY v, id) FROM ranked")
        assert sorted(map(tuple, ranks.ntile(df, n, "v", "id").collect())) == sorted(map(tuple, want.collect()))
    sums = ranks.running_sums(df.withColumn("one", F.lit(1)), {"before": "one"}, "v", "id").select("id", "before")
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, spark.sql("SELECT id, row_number() OVER (ORDER BY v, id) - 1 FROM ranked").collect()))
    none = df.where("false")
    assert ranks.ranks(none, "v").count() == ranks.ntile(none, 3, "v").count() == 0


@pytest.mark.parametrize("reach", [0, 3, 50, 1000])
def test_range_frames(spark, reach):
    r = random.Random(reach)
    df = spark.createDataFrame([(i, r.choice([r.randint(-60, 60), 5, 5, None]), r.choice([None, r.randint(0, 9)])) for i in range(250)], "id int, at long, v long").repartition(5)
    df.createOrReplaceTempView("framed")
    w = f"OVER (ORDER BY at RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING)"
    want = spark.sql(f"SELECT id, at, v, count(v) {w}, sum(v) {w}, min(v) {w}, max(v) {w} FROM framed")
    assert sorted(map(tuple, ranks.range_frame(df, "at", reach, "v").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_json_array_is_one_file_in_order(spark, tmp_path):
    data = [(i, None if i % 5 == 0 else f'"quote\\ \n{i} é,]') for i in range(200)]
    df = spark.createDataFrame(data, "id int, text string").repartition(7)
    path = str(tmp_path / "x.json")
    for _ in range(2):  # the second overwrites
        assert write_json(df, path, "id") == 200
    with open(path, encoding="utf-8") as f:
        assert [(x["id"], x["text"]) for x in json.load(f)] == data
    assert sorted(map(tuple, read_json(spark, path, "id int, text string").collect())) == data
    for n in (0, 1):
        assert write_json(df.where(f"id < {n}"), path, "id") == n
        with open(path, encoding="utf-8") as f:
            assert len(json.load(f)) == n


def test_first_rows(spark):
    assert [r.id for r in rows.first(spark.range(100).repartition(5), 3, F.desc("id")).collect()] == [99, 98, 97]
