"""Parts of a bipartite graph that nothing connects, found in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import checkpointed


def components(pairs: DataFrame) -> DataFrame:
    """s and label, the smallest s that is connected with it, of pairs (s, p): all s with a common p are connected.

    In a round each s takes the least label of those it shares a p with, and then that label's own label, so labels travel
    twice as far each time. Minima are partly aggregated before they are shuffled and no neighbourhood is gathered; a round
    is checkpointed, which keeps plans short and survives lost executors.
    """
    pairs = checkpointed(pairs.distinct())
    at = pairs.select("s").distinct().withColumn("label", F.col("s"))
    while True:
        of_p = pairs.join(at, "s").groupBy("p").agg(F.min("label").alias("m"))
        near = pairs.join(of_p, "p").groupBy("s").agg(F.min("m").alias("label"))
        jump = near.select(F.col("s").alias("label"), F.col("label").alias("next"))
        new = checkpointed(near.join(jump, "label").select("s", F.col("next").alias("label")))
        if new.join(at.withColumnRenamed("label", "before"), "s").where("label <> before").isEmpty():
            return new
        at = new
