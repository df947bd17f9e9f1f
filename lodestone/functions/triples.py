"""Triples written as '(S> s| P> p| O> o)', and their graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import bind


def triple(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("(S> "), s, F.lit("| P> "), p, F.lit("| O> "), o, F.lit(")"))


def split(text: Column) -> Column:
    """The triples of a text that joins them with '), '."""
    return F.transform(F.split(text, r"\), "), lambda t: F.when(F.endswith(t, F.lit(")")), t).otherwise(F.concat(t, F.lit(")"))))


def join(triples: Column) -> Column:
    return F.concat(F.array_join(F.transform(triples, lambda t: F.regexp_replace(t, r"\)+$", "")), "), "), F.lit(")"))


def parse(t: Column) -> Column:
    """struct(subject, predicate, object); null where there are fewer than three parts."""
    part = lambda parts, i: F.trim(F.regexp_replace(F.get(parts, F.lit(i)), "S>|P>|O>", ""))
    whole = lambda p: F.when(F.size(p) >= 3, F.struct(part(p, 0).alias("subject"), part(p, 1).alias("predicate"), part(p, 2).alias("object")))
    return bind(F.split(F.regexp_replace(t, r"^[()]+|[()]+$", ""), r"\|"), whole)


def extract(text: Column) -> Column:
    """Contents of parentheses; an object is cut at its first closing one."""
    return F.regexp_extract_all(text, F.lit(r"\((.*?)\)"), F.lit(1))


def is_valid(t: Column) -> Column:
    """Exactly one each of the prefixes S>, P> and O>, and no other."""
    marks = F.regexp_extract_all(t, F.lit("[A-Z]>"), F.lit(0))
    return (F.size(marks) == 3) & (F.array_sort(F.array_distinct(marks)) == F.array(F.lit("O>"), F.lit("P>"), F.lit("S>")))


def expand_objects(t: Column) -> Column:
    """One triple for each object part, with the first subject and the first predicate."""
    parts = F.transform(F.split(F.regexp_replace(t, r"^\(|\)$", ""), r"\|"), lambda x: F.trim(x))
    first = lambda mark: F.get(F.filter(parts, lambda x: F.startswith(x, F.lit(mark))), F.lit(0))
    return F.transform(F.filter(parts, lambda x: F.startswith(x, F.lit("O>"))), lambda o: F.concat(F.lit("("), first("S>"), F.lit("| "), first("P>"), F.lit("| "), o, F.lit(")")))


def both_directions(s: Column, p: Column, o: Column) -> Column:
    """The edge and its inverse."""
    return F.array(F.struct(s.alias("src"), p.alias("predicate"), o.alias("dst")), F.struct(o.alias("src"), F.concat(F.lit("inverse_"), p).alias("predicate"), s.alias("dst")))


def tasks(rows: int) -> int:
    """Into how many tasks so many triples are dealt by key: 2^16 each, or 2^21 where that would be more than 200, so
    that what a task sorts stays bounded. (Up to 200, tasks that deal rows out hold none of them.)"""
    return max(1, min(200, -(-rows // 2**16)), -(-rows // 2**21))


def graphs(triples: DataFrame, key: str, triple_col: str, rows: int | None = None) -> DataFrame:
    """key, names (a graph's nodes in order) and facts of the triples of each key; a key with a triple that
    does not parse has no graph. A graph is the few triples of one text, so it is one row. `rows`: how many
    triples there are, or a bound; they are counted if it is not given."""
    n = tasks(triples.count() if rows is None else rows)
    facts = triples.select(key, F.struct(parse(F.col(triple_col)).alias("x")).alias("fact")).repartition(n, key)
    parsed = facts.groupBy(key).agg(F.collect_list("fact").alias("facts"))
    facts = F.transform("facts", lambda f: f["x"])
    whole = parsed.where(F.forall("facts", lambda f: f["x"].isNotNull())).select(key, facts.alias("facts"))
    return whole.select(key, "facts", F.array_sort(F.array_distinct(F.concat(F.col("facts.subject"), F.col("facts.object")))).alias("names"))


def edges(graph: DataFrame, key: str) -> DataFrame:
    """key, src, dst, predicate: both directions of each fact, between node numbers from 0."""
    every = F.flatten(F.transform("facts", lambda x: both_directions(x["subject"], x["predicate"], x["object"])))
    e = graph.select(key, "names", F.explode(every).alias("e"))
    node = lambda c: F.array_position("names", F.col(c)) - 1
    return e.select(key, node("e.src").alias("src"), node("e.dst").alias("dst"), "e.predicate")


def neighbor_means(graph: DataFrame, key: str) -> DataFrame:
    """key, node_idx, mean (of the node numbers at the other ends of a node's edges, both directions of each fact) and n,
    their count. Each graph is one row, so nothing is grouped."""
    node = lambda name: F.array_position("names", name) - 1
    ends = graph.select(key, F.size("names").alias("nodes"), F.transform("facts", lambda x: F.struct(node(x["subject"]).alias("s"), node(x["object"]).alias("o"))).alias("ends"))
    each = ends.select(key, "ends", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nodes").cast("long") - 1)).alias("node_idx"))
    other = lambda at, to: F.transform(F.filter("ends", lambda e: e[at] == F.col("node_idx")), lambda e: e[to])
    met = each.select(key, "node_idx", F.concat(other("o", "s"), other("s", "o")).alias("met"))
    total = F.aggregate("met", F.lit(0).cast("long"), lambda a, x: a + x)
    return met.select(key, "node_idx", (total / F.size("met")).alias("mean"), F.size("met").cast("long").alias("n"))
