"""Connected components of a table of links, by label propagation with jumps; of few links, in the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandscan.llm.common import removed, stored

#: Links that the driver may join by itself: each round of a shuffled join takes longer than all of these.
FEW_LINKS = 10_000


def _joined_here(links: DataFrame) -> DataFrame:
    top: dict = {}

    def root(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for a, b in links.select("a", "b").collect():
        x, y = (root(top.setdefault(v, v)) for v in (a, b))
        top[max(x, y)] = min(x, y)
    kind = links.schema["a"].dataType.simpleString()
    return links.sparkSession.createDataFrame([(x, root(x)) for x in top], f"id {kind}, comp {kind}")


def components(links: DataFrame, folder: str) -> DataFrame:
    """(id, comp): for every id in links (a, b), the smallest id reachable.

    Each round takes the smallest label among neighbours, then that label's
    own label; rounds end when none changes. Labels are written to the shared
    folder after each, so lineage stays short and joins read plain tables,
    whose skew Spark can split. Minima are pre-aggregated before shuffles.
    Up to FEW_LINKS links take no rounds.
    """
    if links.count() <= FEW_LINKS:
        return stored(_joined_here(links), folder, "labels-0")
    both = stored(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), folder, "both")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("comp")), folder, "labels-0")
    k = 0
    while True:
        k += 1
        near = both.join(labels.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("comp").alias("near"))
        own = labels.unionByName(near.withColumnRenamed("near", "comp")).groupBy("id").agg(F.min("comp").alias("comp"), F.max("comp").alias("was"))
        step = stored(own, folder, f"step-{k}")
        jump = step.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        new = stored(step.join(jump, "comp", "left").select("id", F.least("comp", F.coalesce("up", "comp")).alias("comp"), (F.col("was") > F.col("comp")).alias("moved")), folder, f"labels-{k}")
        removed(links.sparkSession, f"{folder}/step-{k}", f"{folder}/labels-{k - 1}")
        changed = new.agg(F.bool_or(F.col("moved"))).first()[0]
        labels = new.select("id", "comp")
        if not changed:
            removed(links.sparkSession, f"{folder}/both")
            return labels
