"""The question loop: each hop retrieves for the open questions and asks again from what it found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import retrieval as rt
from lodestone.tables import materialize


def hops(vecs: DataFrame, queries: DataFrame, max_hops: int = 3, k: int = 10, enough: float = 2.0) -> DataFrame:
    """query_id, hop, vec_id: in every hop a query moves to the best vector that it has not seen, until
    that scores `enough` or the hops are used. State is a table that each hop writes anew."""
    asked = queries.select("query_id", "q")
    path = asked.select("query_id", F.lit(0).alias("hop"), F.col("query_id").alias("vec_id"))
    for hop in range(1, max_hops + 1):
        found = rt.topk(vecs, asked, k + hop).drop("rank").join(path.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti")
        step = materialize(rt.best(found, 1, "query_id").select("query_id", F.lit(hop).alias("hop"), "vec_id", "score"), "hop")
        path = materialize(path.unionByName(step.drop("score")), "path")
        asked = step.where(F.col("score") < enough).join(vecs.select("vec_id", F.col("v").alias("q")), "vec_id").select("query_id", "q")
        if asked.isEmpty():
            break
    return path.where("hop > 0")
