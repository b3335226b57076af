"""Measures of lexical networks: centralities, density, components, communities.

A network is that of a top-N vocabulary: its edges are counted, and up to MOST_EDGES of them are sent to all executors as compressed adjacency lists. Shortest paths are dealt out by source:
each task goes through the paths from some of the nodes and adds up what every node lies between, and the partial scores are summed. Weights must be positive: they are distances.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import durable, partitions_of

#: Edges of all networks together: 50 MB of adjacency lists.
MOST_EDGES = 2_000_000


class Network:
    """Adjacency lists: the neighbours of node i are ends[starts[i] : starts[i + 1]]; names in order."""

    def __init__(self, key: tuple, a: Sequence[str], b: Sequence[str], weights: np.ndarray):
        self.key = key
        self.names, nodes = np.unique(np.concatenate([np.asarray(a, object), np.asarray(b, object)]).astype(str), return_inverse=True)
        n, x, y = len(self.names), nodes[: len(a)], nodes[len(a) :]
        pair, last = np.unique((np.minimum(x, y) * n + np.maximum(x, y))[::-1], return_index=True)  # of repeated edges the last counts
        x, y, w = pair // n, pair % n, np.asarray(weights, float)[::-1][last]
        x, y, w = x[x != y], y[x != y], w[x != y]
        order = np.lexsort((np.concatenate([y, x]), np.concatenate([x, y])))
        begin = np.concatenate([x, y])[order]
        self.ends, self.weights = np.concatenate([y, x])[order], np.concatenate([w, w])[order]
        self.starts = np.searchsorted(begin, np.arange(n + 1))

    def near(self) -> list[dict[int, float]]:
        return [dict(zip(self.ends[a:b].tolist(), self.weights[a:b].tolist())) for a, b in zip(self.starts, self.starts[1:])]


def passed(near: Sequence[dict[int, float]], source: int) -> dict[int, float]:
    """For each node, its share of the shortest paths from `source` to the others that go through it."""
    dist, paths, before, order = {source: 0.0}, {source: 1.0}, {source: []}, []
    queue, done = [(0.0, source)], set()
    while queue:
        d, u = heapq.heappop(queue)
        if u in done:
            continue
        done.add(u)
        order.append(u)
        for v, w in near[u].items():
            step = d + w
            if v not in dist or step < dist[v] - 1e-12:
                dist[v], paths[v], before[v] = step, paths[u], [u]
                heapq.heappush(queue, (step, v))
            elif abs(step - dist[v]) <= 1e-12 and v not in done:
                paths[v] += paths[u]
                before[v].append(u)
    share = dict.fromkeys(order, 0.0)
    for v in reversed(order):
        for u in before[v]:
            share[u] += paths[u] / paths[v] * (1 + share[v])
    del share[source]
    return share


def closeness(near: Sequence[dict[int, float]], source: int) -> float:
    """Unweighted closeness, scaled by the reachable share."""
    dist, todo = {source: 0}, [source]
    for u in todo:
        for v in near[u]:
            if v not in dist:
                dist[v] = dist[u] + 1
                todo.append(v)
    total, n = sum(dist.values()), len(near)
    return (len(dist) - 1) / total * (len(dist) - 1) / (n - 1) if total and n > 1 else 0.0


def eigenvector(network: Network, rounds: int = 20_000) -> np.ndarray:
    """The leading eigenvector of the weighted adjacency matrix, of unit length and non-negative, by power iteration. The matrix is shifted, so that networks of two
    sides converge; zeros if it does not."""
    n = len(network.names)
    rows = np.repeat(np.arange(n), np.diff(network.starts))
    shift = 0.5 * np.bincount(rows, weights=network.weights, minlength=n).max(initial=0.0)
    x = np.full(n, 1 / np.sqrt(n))
    for _ in range(rounds):
        y = np.bincount(rows, weights=network.weights * x[network.ends], minlength=n) + shift * x
        y /= np.linalg.norm(y)
        if np.abs(y - x).max() < 1e-12:
            return y
        x = y
    return x if np.abs(y - x).max() < 1e-6 else np.zeros(n)


def components(near: Sequence[dict[int, float]]) -> list[int]:
    label = [-1] * len(near)
    for start in range(len(near)):
        if label[start] < 0:
            label[start], todo = max(label) + 1, [start]
            for u in todo:
                for v in near[u]:
                    if label[v] < 0:
                        label[v] = label[start]
                        todo.append(v)
    return label


def _moved(graph: Sequence[dict[int, float]], loops: Sequence[float], own: list[int]) -> bool:
    """Move nodes, in order, to the neighbouring community of largest gain (of equals the least), until none gains; own is each node's community."""
    degree = [sum(row.values()) + 2 * loop for row, loop in zip(graph, loops)]
    double, total, moved, again = sum(degree), {}, False, True
    for u, c in enumerate(own):
        total[c] = total.get(c, 0.0) + degree[u]
    while again and double:
        again = False
        for u, row in enumerate(graph):
            links: dict[int, float] = {}
            for v, w in row.items():
                links[own[v]] = links.get(own[v], 0.0) + w
            total[own[u]] -= degree[u]
            gain = lambda c: links.get(c, 0.0) - total[c] * degree[u] / double  # noqa: B023, E731
            best = min(sorted({*links, own[u]}), key=lambda c: (-round(gain(c), 12), c != own[u], c))  # noqa: B023
            if best != own[u]:
                own[u], again, moved = best, True, True
            total[own[u]] += degree[u]
    return moved


def _merged(graph: Sequence[dict[int, float]], own: Sequence[int], n: int) -> tuple[list[dict[int, float]], list[float]]:
    """The network of the communities 0 to n - 1 of single nodes, and the weights within each."""
    merged: list[dict[int, float]] = [{} for _ in range(n)]
    inner = [0.0] * n
    for u, row in enumerate(graph):
        for v, w in row.items():
            a, b = own[u], own[v]
            if a == b:
                inner[a] += w / 2
            else:
                merged[a][b] = merged[a].get(b, 0.0) + w
    return merged, inner


def _numbered(own: Sequence[int]) -> list[int]:
    names = {c: i for i, c in enumerate(dict.fromkeys(own))}
    return [names[c] for c in own]


def communities(near: Sequence[dict[int, float]]) -> list[int]:
    """Modularity communities: single nodes move, then whole communities, in turn until neither a node's move nor one of a community makes the modularity larger."""
    member, alone = list(range(len(near))), [0.0] * len(near)
    while True:
        moved = _moved(near, alone, member)
        member = _numbered(member)
        while True:
            n = max(member, default=-1) + 1
            joined = list(range(n))
            if not _moved(*_merged(near, member, n), joined):
                break
            moved, member = True, _numbered([joined[m] for m in member])
        if not moved:
            return member


def modularity(network: Network, member: Sequence[int]) -> float:
    """Of a division of the network's nodes."""
    member, rows = np.asarray(member), np.repeat(np.arange(len(network.names)), np.diff(network.starts))
    double = network.weights.sum()
    degree = np.bincount(member, weights=np.bincount(rows, weights=network.weights, minlength=len(member)))
    inner = network.weights[member[rows] == member[network.ends]].sum()
    return float(inner / double - ((degree / double) ** 2).sum())


def networks_of(edges: DataFrame, by: Sequence[str] = (), inverse: bool = False) -> list[Network]:
    """The networks of `edges` (by.., a, b, pmi), whose number is checked. An edge without a positive weight is an error."""
    own = durable(edges.select(*by, "a", "b", F.col("pmi").cast("double").alias("pmi")).where("a is not null and b is not null"))
    count, wrong = own.agg(F.count("*"), F.count_if(~(F.coalesce("pmi", F.lit(0.0)) > 0))).first()
    if wrong:
        raise ValueError(f"{wrong} edges have no positive weight: shortest paths need distances, raise the threshold")
    if count > MOST_EDGES:
        raise ValueError(f"{count} edges are more than {MOST_EDGES}: take a smaller vocabulary or a higher threshold")
    frame = own.orderBy(*by, "a", "b").toPandas()
    parts = frame.groupby(list(by), dropna=False) if by else [((), frame)]
    return [Network(key if isinstance(key, tuple) else (key,), x["a"], x["b"], 1 / x["pmi"] if inverse else x["pmi"]) for key, x in parts if len(x)]


def centralities(edges: DataFrame, by: Sequence[str] = (), inverse: bool = False) -> DataFrame:
    """(by.., lemma, degree, weighted_degree, betweenness, eigenvector, closeness, community, component) of the networks of `edges` (by.., a, b, pmi). Betweenness takes PMI as a
    distance, as it was defined; inverse=True takes 1 / PMI."""
    by, spark = list(by), edges.sparkSession
    found = networks_of(edges, by)
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    firsts = np.cumsum([0, *(len(x.names) for x in found)])
    shared = spark.sparkContext.broadcast((found, firsts))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        networks, firsts = shared.value
        scores, reach, near, current = {}, {}, None, -1
        for batch in batches:
            for node in batch.column(0).to_pylist():
                which = int(np.searchsorted(firsts, node, side="right")) - 1
                if which != current:
                    current, near = which, networks[which].near()
                    far = [{v: 1 / w for v, w in row.items()} for row in near] if inverse else near
                first = int(firsts[which])
                reach[node] = closeness(near, node - first)
                for v, share in passed(far, node - first).items():
                    scores[first + v] = scores.get(first + v, 0.0) + share
        nodes = list({*scores, *reach})
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([scores.get(v, 0.0) for v in nodes], pa.float64()), pa.array([reach.get(v) for v in nodes], pa.float64())], ["node", "share", "closeness"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        networks, firsts = shared.value
        for batch in batches:
            for which in batch.column(0).to_pylist():
                own = networks[which]
                near = own.near()
                weights = [round(sum(r.values()), 3) for r in near]
                columns = [int(firsts[which]) + np.arange(len(near)), [which] * len(near), [len(near)] * len(near), own.names.tolist(), [len(r) for r in near], weights, eigenvector(own).round(6), communities(near), components(near)]
                types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in schema.split(", ")])

    schema = "node long, which long, size long, lemma string, degree long, weighted_degree double, eigenvector double, community int, component int"
    total = int(firsts[-1])
    parts = max(1, min(partitions_of(edges) * 4, total))
    sums = spark.range(0, total, 1, parts).mapInArrow(paths, "node long, share double, closeness double")
    sums = sums.groupBy("node").agg(F.sum("share").alias("share"), F.max("closeness").alias("closeness"))
    nodes = spark.range(0, len(found), 1, max(1, len(found))).mapInArrow(whole, schema)
    keys = spark.createDataFrame([(i, *x.key) for i, x in enumerate(found)], ", ".join(["which long", *(f"{c} {kinds[c]}" for c in by)]))  # a row for each network
    pairs = (F.col("size") - 1) * (F.col("size") - 2)
    between = F.round(F.when(F.col("size") > 2, F.col("share") / pairs).otherwise(0.0), 6)
    measured = nodes.join(sums, "node").join(F.broadcast(keys), "which")
    return measured.select(*by, "lemma", "degree", "weighted_degree", between.alias("betweenness"), "eigenvector", F.round("closeness", 6).alias("closeness"), "community", "component")


def degrees(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Degree and weighted degree without leaving SQL."""
    ends = edges.select(*by, F.explode(F.array("a", "b")).alias("lemma"), "pmi")
    # weights have four decimals: their sum is exact as a decimal
    weight = F.round(F.sum(F.col("pmi").cast("decimal(20,4)")), 3).cast("double")
    return ends.groupBy(*by, "lemma").agg(F.count("*").alias("degree"), weight.alias("weighted_degree"))


def density(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Nodes, edges and density of each network."""
    nodes = edges.select(*by, F.explode(F.array("a", "b")).alias("lemma")).groupBy(*by).agg(F.countDistinct("lemma").alias("nodes"))
    n = edges.groupBy(*by).agg(F.count("*").alias("edges"))
    joined = nodes.join(n, list(by)) if by else nodes.crossJoin(n)
    return joined.select(*by, "nodes", "edges", F.round(2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 6).alias("density"))


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes (lemma)."""
    return edges.join(nodes.select(F.col("lemma").alias("a")), "a", "left_semi").join(nodes.select(F.col("lemma").alias("b")), "b", "left_semi")
