"""The pipeline over the smallest tables: each stage's result is the rows its operator decides to keep."""

import corpus_pipeline
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, near_dedup, queries, quality_lm
from lodestone.tables import materialize, table

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    docs = table(spark, SF, "documents")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(materialize(stage(spark, kept[-1], SF), name))
        assert kept[-1].columns == docs.columns
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in kept]
    assert all(len(set(x)) == len(x) and set(y) <= set(x) and len(y) < len(x) for x, y in zip(ids, ids[1:]))
    assert set(ids[1]) == {r.doc_id for r in quality_lm.classify(docs, table(spark, SF, "labels")).where("good").collect()}
    assert set(ids[2]) == {r.doc_id for r in exact_dedup.decide(kept[1]).where("kept").collect()}
    assert set(ids[3]) == {r.doc_id for r in near_dedup.classes(kept[2]).where("kept").collect()}
    last = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in last) == sorted(ids[4])
    texts = {r.doc_id: r.sha for r in docs.select("doc_id", F.sha2("text", 256).alias("sha")).collect()}
    assert all(r.decoded_sha256 == texts[r.doc_id] for r in last)


EDGE = "doc_id long, text string, lang string, source string, n_chars long, n string, _own string, _k1 string, gram string, good string"


def test_stages_meet_nulls_repeats_and_clashing_columns(spark):
    """Each stage gives whole rows of its input back, one of each text and class, whatever the columns hold."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "a b c d e f", "en", "src1"), (1, "a b c d e f", "en", "src1"), (1, "other words are here now", None, None), (2, None, None, None), (3, "", "en", "src2"), (None, "no id at all here", "de", "srcX"), (None, "no id at all here", "de", "srcX"), (None, None, None, None), (7, long, "en", "src1"), (8, long + " end", "en", "src1"), (9, "\n \t", "en", "src1")]
    rows = [(*r, None, "n", "own", "k", "g", "yes") for r in rows]
    docs = spark.createDataFrame(rows, EDGE)
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and out.subtract(docs).count() == 0, name
        counts.append(out.count())
        docs = out
    assert counts[0] == len(rows)
    assert counts[1] == len({" ".join((r[1] or "").split()) if (r[1] or "").strip() else ("" if not r[1] else " ") for r in rows})
    assert counts[2] == counts[1] - 1 and 0 < counts[3] <= counts[2]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == counts[3]


NAMES = "_row _others _own _id _text _norm _h _trusted _lang _k1 _k2 _copies _copy _epochs _cut _domain _source _place place cut epochs domain budget rest prefix _words ids _mean _limit _n h key node rows bits good threshold".split()


def test_stages_keep_columns_of_any_name_and_kind(spark):
    """Each stage gives columns of the names that operators use inside back as they were, and a map."""
    text = "some words that are here and now in {} plain order of their own"
    docs = spark.createDataFrame([(i, text.format(" ".join(f"w{i}x{k}" for k in range(20))), "en", f"src{i}", 5) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({n: F.concat(F.lit(f"{n} of "), "doc_id") for n in NAMES}).withColumn("m", F.create_map(F.lit("k"), "doc_id"))
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        kept = docs.collect()
        assert kept and all(r == before[r.doc_id] for r in kept), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(kept)


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], EDGE)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_held_out_accuracy(spark):
    """Labels that the model has not seen: nearly all good documents stay, most junk goes."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    judged = quality_lm.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    rates = {r.quality: r.rate for r in judged.groupBy("quality").agg(F.avg(F.col("good").cast("int")).alias("rate")).collect()}
    assert rates[1] >= 0.97 and rates[0] <= 0.25


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
