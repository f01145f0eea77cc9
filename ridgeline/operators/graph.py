"""Forests, cycles and components in joins and partial aggregates, with paths halved each round.

A round is a few jobs, whatever the graph.  So a graph whose written table is at most SMALL_BYTES goes through the same rounds as
arrays in one task; a larger one never does.  Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import written

#: Bytes of files up to which a graph is solved in one task.
SMALL_BYTES = 4 << 20


def is_small(table: DataFrame) -> bool:
    """Whether a written table is small, by the size of its files."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES


def shuffled(table: DataFrame) -> DataFrame:
    """table, to be joined by a shuffle: the rounds' tables grow with the graph, and each broadcast would bring one to the driver."""
    return table.hint("merge")


def in_one_task(table: DataFrame, solve: Callable[[pd.DataFrame], pd.DataFrame], ddl: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            yield solve(pd.concat(parts, ignore_index=True))

    return table.coalesce(1).mapInPandas(run, ddl)


def places(node: np.ndarray, asked: pd.Series) -> np.ndarray:
    """Where each asked node stands among distinct nodes in order; -1 for null and for what is not there."""
    there = asked.notna().to_numpy()
    value = asked.fillna(0).to_numpy().astype(np.int64)
    at = np.minimum(np.searchsorted(node, value), len(node) - 1)
    return np.where(there & (node[at] == value), at, -1)


def subtree_sizes(edges: DataFrame) -> DataFrame:
    """node, size: how many nodes flow through each, itself included, in a forest of node -> dst (null at a root).

    After round k, size counts the nodes less than 2**k steps upstream and dst is 2**k steps downstream, so the rounds are the
    logarithm of the deepest path, not its length.  No node, no rows.
    """
    state = written(edges.select("node", "dst", F.lit(1).cast("bigint").alias("size")), "sizes")
    if is_small(state):
        return in_one_task(state, sizes_of, "node bigint, size bigint")
    while state.where("dst IS NOT NULL").limit(1).count():
        gain = state.where("dst IS NOT NULL").groupBy(F.col("dst").alias("node")).agg(F.sum("size").alias("gain"))
        jump = state.select(F.col("node").alias("dst"), F.col("dst").alias("next"))
        state = state.join(shuffled(gain), "node", "left").join(shuffled(jump), "dst", "left").select("node", F.col("next").alias("dst"), (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"))
        state = written(state, "sizes")
    return state.select("node", "size")


def sizes_of(t: pd.DataFrame) -> pd.DataFrame:
    t = t.sort_values("node")
    node, size = t["node"].to_numpy(), np.ones(len(t), dtype=np.int64)
    dst = places(node, t["dst"])
    while (on := dst >= 0).any():
        gain = np.zeros_like(size)
        np.add.at(gain, dst[on], size[on])
        size += gain
        dst[on] = dst[dst[on]]
    return pd.DataFrame({"node": node, "size": size})


def reaches(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, dist: the nodes whose path along node -> dst meets a seed, and the steps to the first one (0 at seeds)."""
    state = edges.join(shuffled(seeds.select(F.col("node"), F.lit(True).alias("seed"))), "node", "left")
    seed = F.coalesce(F.col("seed"), F.lit(False))
    state = state.select("node", F.when(~seed, F.col("dst")).alias("dst"), seed.alias("met"), F.when(seed | F.col("dst").isNull(), 0).otherwise(1).alias("dist"))
    state = written(state, "reach")
    if is_small(state):
        return in_one_task(state, reach_of, "node bigint, dist int")
    while state.where("dst IS NOT NULL").limit(1).count():
        jump = state.select(F.col("node").alias("dst"), F.col("dst").alias("next"), F.col("met").alias("met_on"), F.col("dist").alias("more"))
        state = state.join(shuffled(jump), "dst", "left")
        state = written(state.select("node", F.col("next").alias("dst"), F.coalesce(F.when(F.col("dst").isNotNull(), F.col("met_on")), F.col("met")).alias("met"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist")), "reach")
    return state.where("met").select("node", "dist")


def reach_of(t: pd.DataFrame) -> pd.DataFrame:
    t = t.sort_values("node")
    node, met, dist = t["node"].to_numpy(), t["met"].to_numpy(dtype=bool), t["dist"].to_numpy(dtype=np.int64)
    dst = places(node, t["dst"])
    while (on := dst >= 0).any():
        to = dst[on]
        met[on], dist[on], dst[on] = met[to], dist[on] + dist[to], dst[to]
    return pd.DataFrame({"node": node[met], "dist": dist[met].astype(np.int32)})


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, label for every node: the least node that links (a, b) reach."""
    return nodes.select("node").join(shuffled(connected(links)), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def connected(links: DataFrame) -> DataFrame:
    """node, label of every end of the links (a, b): the least node that links reach; no links give no rows.

    Each round takes the least label of the neighbours and then that label's own label, so that paths halve; rounds are written
    tables, and go on until nothing changes.
    """
    links = written(links.select("a", "b").where("a <> b").distinct(), "links")
    kind = links.schema["a"].dataType.simpleString()
    if is_small(links):
        return in_one_task(links, labels_of, f"node {kind}, label {kind}")
    edges = written(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = edges.join(shuffled(labels.withColumnsRenamed({"node": "b", "label": "of_b"})), "b").groupBy("a").agg(F.min("of_b").alias("m")).withColumnRenamed("a", "node")
        lower = written(labels.join(shuffled(near), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")), "labels")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = written(lower.join(shuffled(jump), "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.where("old <> label").limit(1).count():
            return labels


def labels_of(t: pd.DataFrame) -> pd.DataFrame:
    """Nodes of any kind that has an order that Python and Spark share: numbers, and text by its UTF-8 bytes."""
    ends = pd.concat([t["a"], t["b"]], ignore_index=True)
    text = ends.dtype == object
    node, at = np.unique(ends.str.encode("utf-8").to_numpy() if text else ends.to_numpy(), return_inverse=True)
    a, b = np.split(at, 2)
    label = np.arange(len(node))
    while True:
        old = label.copy()
        np.minimum.at(label, a, old[b])
        np.minimum.at(label, b, old[a])
        label = label[label]
        if (label == old).all():
            break
    names = [x.decode("utf-8") for x in node] if text else node
    return pd.DataFrame({"node": names, "label": np.array(names, dtype=object)[label] if text else node[label]})


def cycles(links: DataFrame) -> DataFrame:
    """node, ring, rank of a permutation node -> next (bigint): the least node of its cycle, and the steps from that.

    After round k each node knows the least of the 2**k nodes from it on and the steps to that one; rounds end when no
    node learns more, after the logarithm of the longest cycle.  The steps to the least node, taken from the cycle's
    length, are the rank.
    """
    state = written(links.select("node", "next", F.col("node").alias("least"), F.lit(0).cast("bigint").alias("steps"), F.lit(True).alias("news")), "cycles")
    if is_small(state):
        return in_one_task(state, ranks_of, "node bigint, ring bigint, rank bigint")
    width = 1
    while state.where("news").limit(1).count():
        on = state.select(F.col("node").alias("next"), F.col("next").alias("then"), F.col("least").alias("least_on"), F.col("steps").alias("steps_on"))
        news = F.col("least_on") < F.col("least")
        both = state.join(shuffled(on), "next")
        state = written(both.select("node", F.col("then").alias("next"), F.least("least", "least_on").alias("least"), F.when(news, F.col("steps_on") + width).otherwise(F.col("steps")).alias("steps"), news.alias("news")), "cycles")
        width *= 2
    length = state.groupBy("least").agg(F.count(F.lit(1)).alias("length"))
    return state.join(shuffled(length), "least").select("node", F.col("least").alias("ring"), ((F.col("length") - F.col("steps")) % F.col("length")).alias("rank"))


def ranks_of(t: pd.DataFrame) -> pd.DataFrame:
    t = t.sort_values("node")
    node = t["node"].to_numpy()
    next_ = places(node, t["next"])
    least, steps, width = np.arange(len(node)), np.zeros(len(node), dtype=np.int64), 1
    while (news := least[next_] < least).any():
        steps, least, next_ = np.where(news, steps[next_] + width, steps), np.minimum(least, least[next_]), next_[next_]
        width *= 2
    length = np.bincount(least, minlength=len(node))[least]
    return pd.DataFrame({"node": node, "ring": node[least], "rank": (length - steps) % length})


def chains(up: DataFrame) -> DataFrame:
    """node, depth of a forest node -> up (null at a root): the steps to its root."""
    state = written(up.select("node", "up", F.col("up").isNotNull().cast("bigint").alias("depth")), "depths")
    if is_small(state):
        return in_one_task(state, depths_of, "node bigint, depth bigint")
    while state.where("up IS NOT NULL").limit(1).count():
        on = state.select(F.col("node").alias("up"), F.col("up").alias("then"), F.col("depth").alias("more"))
        state = written(state.join(shuffled(on), "up", "left").select("node", F.col("then").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "depths")
    return state.select("node", "depth")


def depths_of(t: pd.DataFrame) -> pd.DataFrame:
    t = t.sort_values("node")
    node, depth = t["node"].to_numpy(), t["depth"].to_numpy(dtype=np.int64)
    up = places(node, t["up"])
    while (on := up >= 0).any():
        to = up[on]
        depth[on], up[on] = depth[on] + depth[to], up[to]
    return pd.DataFrame({"node": node, "depth": depth})
