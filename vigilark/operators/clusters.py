"""Attack clusters: rows linked, directly or through others, by similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.session import checkpoint


def connected_components(edges: DataFrame, source: str = "a", target: str = "b") -> DataFrame:
    """(id, cluster): the smallest id reachable over the edges, in either direction.

    Each round takes the smallest label among the neighbours and then follows
    the label's own label, so the number of rounds grows with the logarithm
    of the longest chain. Labels are written to the checkpoint folder every
    round; the loop ends when a round changes nothing.
    """
    both = checkpoint(
        edges.select(F.col(source).alias("id"), F.col(target).alias("other"))
        .unionByName(edges.select(F.col(target).alias("id"), F.col(source).alias("other")))
        .distinct())
    labels = checkpoint(both.groupBy("id").agg(
        F.least(F.col("id"), F.min("other")).alias("cluster")))
    while True:
        # The hop aggregates map-side, so a hub's many neighbours combine before the shuffle.
        hop = (
            both.join(labels.select(F.col("id").alias("other"), "cluster"), "other")
            .groupBy("id").agg(F.min("cluster").alias("near"))
        )
        moved = labels.join(hop, "id", "left").select(
            "id", F.col("cluster").alias("was"),
            F.least(F.col("cluster"), F.col("near")).alias("cluster"))
        jump = moved.select(F.col("id").alias("cluster"), F.col("cluster").alias("root"))
        after = checkpoint(
            moved.join(jump, "cluster", "left")
            .select("id", "was", F.least(F.col("cluster"), F.col("root")).alias("cluster")))
        if after.filter(F.col("was") != F.col("cluster")).isEmpty():
            return after.select("id", "cluster")
        labels = after.select("id", "cluster")


def attack_clusters(pairs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """(id, cluster, cluster_size) of the rows behind linked classes (``similarity.similar_classes``).

    Rows of a serious class are all linked with each other, so the class is one node. Rows of another class are
    linked by what reaches them: a class before it reaches those up to a time, one behind it those from a
    time on. The farthest reach of either side covers all others, so such a class is two nodes and a row belongs
    to one, the other, both or none. The graph has an edge for each pair of classes, however many copies they have.
    """
    ends = classes.select("class_id", "first", "last", "window_s", "bucket")
    a = ends.select(*(F.col(c).alias("trigger_id" if c == "class_id" else f"a_{c}") for c in ends.columns))
    b = ends.select(*(F.col(c).alias("id" if c == "class_id" else f"b_{c}") for c in ends.columns))
    met = pairs.join(a, "trigger_id").join(b, "id")
    after = F.col("b_bucket") >= F.col("a_bucket")
    node = F.when(F.col("b_window_s").isNotNull(), F.col("id")).otherwise(F.concat(F.when(after, "<").otherwise(">"), "id"))
    upto = F.when(F.col("b_bucket") == F.col("a_bucket"), F.col("b_last")).when(after, F.col("a_last") + F.col("a_window_s"))
    linked = checkpoint(met.select(
        F.col("trigger_id").alias("a"), node.alias("b"), "id", F.col("b_window_s").isNull().alias("loose"),
        upto.alias("upto"), F.when(~after, F.col("a_first") - F.col("a_window_s")).alias("since")))
    reach = linked.filter("loose").groupBy(F.col("id").alias("class_id")).agg(F.max("upto").alias("upto"), F.min("since").alias("since"))
    rows = checkpoint(members.join(reach, "class_id", "left"))
    at = F.col("event_epoch")
    # A row that both sides reach makes the two nodes of its class one.
    both = rows.filter((at <= F.col("upto")) & (at >= F.col("since"))).select(
        F.concat(F.lit("<"), "class_id").alias("a"), F.concat(F.lit(">"), "class_id").alias("b")).distinct()
    component = connected_components(linked.select("a", "b").unionByName(both))
    own = F.when(F.col("upto").isNull() & F.col("since").isNull(), F.col("class_id")).when(
        at <= F.col("upto"), F.concat(F.lit("<"), "class_id")).when(at >= F.col("since"), F.concat(F.lit(">"), "class_id"))
    placed = rows.select(F.col("id").alias("row"), own.alias("id")).join(component, "id")
    # The smallest row of a cluster names it.
    names = placed.groupBy("cluster").agg(F.min("row").alias("name"), F.count("*").alias("cluster_size"))
    return placed.join(names, "cluster").select(F.col("row").alias("id"), F.col("name").alias("cluster"), "cluster_size")
