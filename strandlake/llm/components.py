"""Connected components of an edge table by smallest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.lineage import stash


#: Labels that are broadcast at most.
MOVES = 200_000


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Where the labels of an edge's ends differ, the larger one's node and the
    end itself take the smaller one, a map-side combined minimum; then a node
    takes the label of its label, those that differ being broadcast where few,
    so that the nodes of a large component never meet in one task. Hooking
    labels as well as ends makes the rounds logarithmic, on long chains too.
    The labels are written after each round, so lineage stays short. Raises
    RuntimeError where ``rounds`` do not suffice, rather than return labels
    that are not final. Edges with a null end count for nothing; one that comes
    twice or both ways is met once a round.
    """
    pairs = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pairs = stash(pairs.distinct(), "edges")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("label")), F.struct(F.col("b").alias("node"), F.col("a").alias("label")))).alias("end"))
    labels = stash(ends.groupBy("end.node").agg(F.min("end.label").alias("label")), "labels")
    for _ in range(rounds):
        met = pairs.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la != lb")
        met = met.select(F.when(F.col("la") > F.col("lb"), F.col("a")).otherwise(F.col("b")).alias("end"), F.greatest("la", "lb").alias("was"), F.least("la", "lb").alias("low"))
        heard = met.select(F.explode(F.array("end", "was")).alias("node"), "low").groupBy("node").agg(F.min("low").alias("heard"))
        lower = stash(labels.join(heard, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label")), "labels")
        # labels in use whose own node has a smaller one; most are none's, so hardly any are looked up
        moves = lower.where("label < node").join(lower.select(F.col("label").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("label"), F.col("label").alias("jumped"))
        n = moves.limit(MOVES + 1).count()
        labels = lower.select("node", "label")
        if n:
            labels = stash(lower.join(F.broadcast(moves) if n <= MOVES else moves, "label", "left").select("node", F.least("label", "jumped").alias("label")), "labels")
        elif not lower.where("label < was").limit(1).count():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"labels still move after {rounds} rounds")
