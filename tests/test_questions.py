"""The question loop: batch and stream give one answer, every way to end is met, repeated events change nothing."""

import re

from pyspark.sql import functions as F

from lodestone.operators import questions
from lodestone.streaming import drain

DOCS = {"a": ["a to b", None], "b": ["b to c", "bad", "b to d"], "c": ["c to e"], "x": [], "loop": ["loop to loop"]}


def extract(text):
    return "(oops)" if text == "bad" else "(S> {}| P> leads| O> {})".format(*text.split(" to "))


def prompt(question, path):
    return "\n".join([*(f"{s}: {t}" for s, t in path), f"Question: {question}"])


def plan(text):
    question, objects, asked = text.rpartition("Question: ")[2], re.findall(r"O> (\w+)", text), re.findall(r"^(\w+): ", text, re.MULTILINE)
    if not question:
        return "[No_Retrieval]"
    if "e" in objects:
        return "It is Sufficient."
    return (objects or [question])[-1] if question == "loop" else next((x for x in [question, *objects] if x not in asked), "NO_RETRIEVAL")


MODELS = questions.Models(extract, prompt, plan, lambda text: (["none", *re.findall(r"O> (\w+)", text)])[-1])


def plain(question, max_hops):
    path, sub_query = [], None
    while True:
        sub_query, reason, answer = questions.decide(question or "", path, MODELS, max_hops)
        if sub_query is None:
            return len(path), reason, answer
        path = questions.extended(question or "", path, sub_query, DOCS.get(sub_query), MODELS)


def retrieve(spark):
    table = spark.createDataFrame(list(DOCS.items()), "sub_query string, docs array<string>")
    return lambda asked: asked.join(table, "sub_query").select("id", "docs")


def test_batch_and_stream_give_one_answer(spark):
    asked = [(1, "a"), (2, "c"), (3, "x"), (4, "loop"), (5, "unknown"), (6, None), (7, ""), (8, "b")]
    df = spark.createDataFrame(asked, "id long, question string")
    batch = questions.answer_in_rounds(df, retrieve(spark), MODELS, 3)
    got = {r.id: (r.hops, r.reason, r.answer) for r in batch.collect()}
    assert got == {i: plain(q, 3) for i, q in asked}
    assert {r for _, r, _ in got.values()} == {"sufficient", "maximum", "no_retrieval"} and got[4][0] == 3
    assert {r.id: [tuple(x) for x in r.path] for r in batch.collect()}[2] == [("c", "(S> c| P> leads| O> e)")]
    online = questions.answer_online(df, retrieve(spark), MODELS, 3)
    assert sorted(map(tuple, online.collect())) == sorted((i, *x) for i, x in got.items())


def test_extraction_can_see_the_question(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, question string")
    seen = questions.Models(lambda text: f"(S> {text}| P> leads| O> e)", prompt, plan, MODELS.answer, lambda question, document: f"{question} of {document.split()[0]}")
    got = questions.answer_in_rounds(df, retrieve(spark), seen, 3)
    assert {r.id: r.path[0].triples.split("|")[0] for r in got.collect()} == {1: "(S> a of a", 2: "(S> b of b"}
    assert sorted((r.id, r.answer) for r in questions.answer_online(df, retrieve(spark), seen, 3).collect()) == [(1, "e"), (2, "e")]


def test_no_questions(spark):
    df = spark.createDataFrame([], "id long, question string")
    assert questions.answer_in_rounds(df, retrieve(spark), MODELS).count() == 0
    assert questions.answer_online(df, retrieve(spark), MODELS).count() == 0


def test_repeated_and_early_events_change_nothing(spark, tmp_path):
    setting = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "id long, hop int, question string, docs array<string>"
    rounds = [[(1, 2, None, ["early"]), (1, 0, "a", None)], [(1, 0, "a", None), (1, 1, None, ["a to b"]), (1, 1, None, ["a to b"])], [(1, 1, None, ["a to z"]), (1, 2, None, ["b to e"])], [(1, 3, None, ["e to f"]), (1, 0, "a", None)]]
    try:
        for rows in rounds:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
            out = drain(questions.steps(spark.readStream.schema(schema).parquet(str(tmp_path / "events")), MODELS), str(tmp_path / "checkpoint"), str(tmp_path / "out"))
    finally:
        spark.conf.unset(setting)
    assert out.orderBy("hop").collect() == [(1, 0, "a", None, None), (1, 1, "b", None, None), (1, 2, None, "sufficient", "e")]


def test_the_index_of_words_holds_no_passages(spark, tmp_path):
    """A passage goes with no word: only ids do, and a hop fetches what it asks for."""
    from lodestone.plans import models as plans

    docs = [(i, " ".join(["common", f"w{chr(97 + i)}"] + ["long"] * 50) + ". more") for i in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    written, keep = {}, plans.materialize
    plans.materialize = lambda df, name: written.setdefault(name, keep(df, name))
    try:
        retrieve = plans._retrieval(spark, str(tmp_path))
    finally:
        plans.materialize = keep
    assert "passage" not in str(written["index"].schema) and "docs" not in written["index"].columns
    got = {r.id: r.docs for r in retrieve(spark.createDataFrame([(1, "Ask: common"), (2, "Ask: none")], "id long, sub_query string")).collect()}
    assert got == {1: [t.split(". ")[0] for _, t in docs[:2]]}
