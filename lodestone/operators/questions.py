"""The question loop: plan, retrieve, extract triples, extend the graph, decide, answer.

A question's state is its path: each sub-query with the triples that its documents gave. Models are functions of
texts; `decide` and `extended` are one step of one question. `answer_in_rounds` runs all open questions hop
by hop as tables, each hop written once; `answer_online` keeps the path in the state store of a stream, which takes
a hop's documents as events. Both ask the same steps, so both give one answer.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lodestone.functions.extraction import parse_reply
from lodestone.streaming import drain
from lodestone.tables import materialize, scratch

#: What a planner's reply holds when it wants no more documents.
STOPS = re.compile("sufficient|no_retrieval", re.IGNORECASE)

Path = list[tuple[str, str]]
Retrieve = Callable[[DataFrame], DataFrame]


def document_alone(question: str, document: str) -> str:
    return document


@dataclass(frozen=True)
class Models:
    """extract: triples as text; prompt: question and path as text; plan: a prompt's next sub-query or a stop;
    answer: a prompt's answer; reading: what extract is given of a question and a document."""

    extract: Callable[[str], str]
    prompt: Callable[[str, Path], str]
    plan: Callable[[str], str]
    answer: Callable[[str], str]
    reading: Callable[[str, str], str] = document_alone


def decide(question: str, path: Path, models: Models, max_hops: int) -> tuple[str | None, str | None, str | None]:
    """sub_query, or else reason and answer. After `max_hops` hops the reason is 'maximum'."""
    prompt, reason = models.prompt(question, path), "maximum"
    if len(path) < max_hops:
        reply = models.plan(prompt)
        stop = STOPS.search(reply)
        if stop is None:
            return reply, None, None
        reason = stop[0].lower()
    return None, reason, models.answer(prompt)


def extended(question: str, path: Path, sub_query: str, docs: Iterable[str | None] | None, models: Models) -> Path:
    """The path with one hop more; what is no triple is left out."""
    found = [f"(S> {s}| P> {p}| O> {o})" for d in (docs if docs is not None else []) if d is not None for s, p, o, ok, _ in parse_reply(models.extract(models.reading(question, d))) if ok]
    return [*path, (sub_query, ", ".join(found))]


def answer_in_rounds(questions: DataFrame, retrieve: Retrieve, models: Models, max_hops: int = 5) -> DataFrame:
    """id, hops, reason, answer and path of questions(id, question), ids unique. `retrieve` turns (id, sub_query) into (id, docs);
    a question that it leaves out has no documents. A null question is empty. Open questions are spread over
    tasks in each hop, and those that have ended are not touched again."""
    kind = questions.schema["id"].dataType.simpleString()
    state = f"id {kind}, question string, path array<struct<sub_query: string, triples: string>>, sub_query string, reason string, answer string"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                path = [(x["sub_query"], x["triples"]) for x in row["path"]]
                path = path if row["sub_query"] is None else extended(row["question"] or "", path, row["sub_query"], row["docs"], models)
                sub_query, reason, answer = decide(row["question"] or "", path, models, max_hops)
                out.append({"id": row["id"], "question": row["question"], "path": [{"sub_query": s, "triples": t} for s, t in path], "sub_query": sub_query, "reason": reason, "answer": answer})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(state))
    nothing = F.lit(None).cast("string")
    current = questions.select("id", "question", F.array().cast("array<struct<sub_query: string, triples: string>>").alias("path"), nothing.alias("sub_query"), F.lit(None).cast("array<string>").alias("docs"))
    parts = []
    for _ in range(max_hops + 1):
        after = materialize(current.mapInArrow(step, state), "hop")
        parts.append(after.where("sub_query IS NULL"))
        going = after.where("sub_query IS NOT NULL")
        if going.isEmpty():
            break
        current = going.join(retrieve(going.select("id", "sub_query")).select("id", "docs"), "id", "left").select("id", "question", "path", "sub_query", "docs")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("id", F.size("path").alias("hops"), "reason", "answer", "path")


STEP = "id {kind}, hop int, sub_query string, reason string, answer string"


class Loop(StatefulProcessor):
    """One question's loop: an event is a hop's documents. Events that are not of the hop it waits for, such as
    repeated ones, change nothing."""

    def __init__(self, models: Models, max_hops: int):
        self.models, self.max_hops = models, max_hops

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("loop", "question string, sub_query string, asked array<string>, triples array<string>, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("hop", kind="stable")
        out = []
        for event in events.itertuples():
            held = self.state.get() if self.state.exists() else None
            if event.hop != (len(held[2]) + 1 if held else 0) or held and held[4]:
                continue
            question = held[0] if held else event.question or ""
            path = extended(question, list(zip(held[2], held[3])), held[1], event.docs, self.models) if held else []
            sub_query, reason, answer = decide(question, path, self.models, self.max_hops)
            # What has ended keeps its place only, not its path.
            kept = path if sub_query is not None else []
            self.state.update((question if kept or sub_query else "", sub_query, [s for s, _ in kept], [t for _, t in kept], sub_query is None))
            out.append((key[0], int(event.hop), sub_query, reason, answer))
        yield pd.DataFrame(out, columns=["id", "hop", "sub_query", "reason", "answer"])

    def close(self) -> None:
        pass


def steps(events: DataFrame, models: Models, max_hops: int = 5) -> DataFrame:
    """The stream of what questions do next, of a stream of events(id, hop, question, docs): hop 0 brings the question, and
    hop n the documents for its n-th sub-query. Rows (id, hop, sub_query, reason, answer): a sub-query to retrieve for,
    or the answer after `hop` hops and the reason to end."""
    kind = events.schema["id"].dataType.simpleString()
    return events.groupBy("id").transformWithStateInPandas(statefulProcessor=Loop(models, max_hops), outputStructType=STEP.format(kind=kind), outputMode="append", timeMode="none")


def answer_online(questions: DataFrame, retrieve: Retrieve, models: Models, max_hops: int = 5) -> DataFrame:
    """id, hops, reason and answer of questions(id, question), by a stream that goes on from its checkpoint whenever
    documents for its sub-queries have come. As `answer_in_rounds` in all cases."""
    spark, base = questions.sparkSession, scratch(questions.sparkSession, "loop")
    kind = questions.schema["id"].dataType.simpleString()
    schema = f"id {kind}, hop int, question string, docs array<string>"
    setting, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, rocks)
    try:
        events = questions.select("id", F.lit(0).alias("hop"), "question", F.lit(None).cast("array<string>").alias("docs"))
        for hop in range(max_hops + 1):
            events.write.mode("append").parquet(f"{base}/events")
            out = drain(steps(spark.readStream.schema(schema).parquet(f"{base}/events"), models, max_hops), f"{base}/checkpoint", f"{base}/out")
            asked = out.where((F.col("hop") == hop) & F.col("sub_query").isNotNull()).select("id", "sub_query")
            if asked.isEmpty():
                break
            found = asked.join(retrieve(asked).select("id", "docs"), "id", "left")
            events = found.select("id", F.lit(hop + 1).alias("hop"), F.lit(None).cast("string").alias("question"), "docs")
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    return out.where("answer IS NOT NULL").select("id", F.col("hop").alias("hops"), "reason", "answer")
