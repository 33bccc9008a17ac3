"""Connected components by minimum labels and pointer jumping, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswright.llm._common import materialize
from glosswright.sources.storage import scratch


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of links (a, b); label is its component's smallest node.

    A round takes the smallest label among a node's neighbours and then the label's own
    label, so paths halve from round to round. Labels only ever fall; their sum tells
    when nothing changes any more. Each round is written to the shared folder, and the
    one before it is deleted. Only the few nodes that are labels of others take part in
    the second step as its right side, so it's broadcast or split where a label is hot.
    """
    with scratch(links.sparkSession) as tables:
        edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        edges = materialize(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
        labels = materialize(
            edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select("node", F.least("node", "low").alias("label")),
            "labels",
        )
        total = _total(labels)
        while total is not None:
            near = (
                edges.join(labels.select(F.col("node").alias("v"), "label"), "v")
                .groupBy(F.col("u").alias("node"))
                .agg(F.min("label").alias("low"))
            )
            step = materialize(labels.join(near, "node").select("node", F.least("label", "low").alias("label")), "labels-step")
            onward = step.join(step.select(F.col("label").alias("node")).distinct(), "node", "left_semi")
            onward = materialize(onward.select(F.col("node").alias("label"), F.col("label").alias("next")), "labels-onward")
            following = materialize(step.join(onward, "label").select("node", F.col("next").alias("label")), "labels")
            tables.drop(labels, step, onward)
            labels = following
            before, total = total, _total(labels)
            if before == total:
                break
        return tables.keep(labels)


def _total(labels: DataFrame):
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
