"""Text to triples as a table function: SELECT .. FROM documents, LATERAL text_to_triples(text).

A hook stands for the model: it turns a text into a reply of triples '(S> s| P> p| O> o), ..'. The function gives a
row for each triple of the reply, one for each object of a triple with several, and marks what is no triple.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

ROW = "s string, p string, o string, ok boolean, raw string"
_MARK = re.compile(r"([A-Z])>")


def parse_reply(reply: str | None) -> Iterator[tuple]:
    """s, p, o, ok, raw of a reply's triples. One is well-formed if its parts are a subject, a predicate and objects,
    none empty; a malformed one is a single row with its text alone. An empty reply has no rows."""
    for raw in filter(None, (x.strip() for x in (reply or "").split("), "))):
        parts = [x.strip() for x in raw.removeprefix("(").removesuffix(")").split("|")]
        marks = [_MARK.match(x) for x in parts]
        values = [x[m.end() :].strip() if m else "" for x, m in zip(parts, marks)]
        kinds = "".join(m[1] if m else "?" for m in marks)
        if re.fullmatch("SPO+", kinds) and all(values):
            yield from ((values[0], values[1], o, True, raw) for o in values[2:])
        else:
            yield None, None, None, False, raw


def register(spark: SparkSession, hook: Callable[[str], str], name: str = "text_to_triples", tries: int = 3) -> None:
    """Make the table function `name` known to the session's SQL. A hook that fails is asked again; after `tries`
    failures its text is one malformed row. A null text has no rows."""

    class Triples:
        def eval(self, text: str):
            if text is None:
                return
            for _ in range(tries):
                try:
                    reply = hook(text)
                    break
                except Exception:
                    continue
            else:
                reply = "(failed)"
            yield from parse_reply(reply)

    spark.udtf.register(name, udtf(Triples, returnType=ROW, useArrow=True))


def stub_reply(text: str) -> str:
    """A triple a sentence: its first word mentions its last ones; sentences of two words leave the object out, and
    shorter ones say nothing."""
    out = []
    for sentence in text.split(". "):
        words = re.findall("[a-z]+", sentence)
        if len(words) > 3:
            out.append(f"(S> {words[0]}| P> mentions| O> {words[-2]}| O> {words[-1]})")
        elif len(words) > 1:
            out.append(f"(S> {words[0]}| P> mentions)" if len(words) == 2 else f"(S> {words[0]}| P> mentions| O> {words[-1]})")
    return ", ".join(out)
