"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwatch.llm.common import sized


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b), the component being its smallest id.

    Every id takes the smallest label among its neighbours and then the label of that label, until nothing changes;
    paths halve in each round. Minima are combined before they are shuffled, so a hub is no hot key, and each round is
    written, so that plans stay short. Null ends are ignored.
    """
    links = links.where("a is not null and b is not null and a != b")
    both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    edges = sized(sized(both.select("e.a", "e.b"), "links").distinct(), "edges")
    labels = sized(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        heard = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("heard"))
        step = labels.join(heard, "id").select("id", F.col("component").alias("old"), F.least("component", "heard").alias("via"))
        jump = labels.select(F.col("id").alias("via"), F.col("component").alias("beyond"))
        step = step.join(jump, "via", "left").select("id", "old", F.least("via", F.coalesce("beyond", "via")).alias("component"))
        step = sized(step, "labels")
        changed = not step.where("component != old").isEmpty()
        labels = step.select("id", "component")
        if not changed:
            return labels
