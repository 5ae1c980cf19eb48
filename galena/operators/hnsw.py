"""Approximate neighbours by navigable small-world graphs (Malkov and Yashunin, 2016), one graph per shard of slots.

Inserting is sequential within a graph, so a store is cut into shards of slots whose graphs are built side by side; a
query walks all shards and the best of their answers are merged. Levels come from a counter-based generator, so a graph
depends on seed, slots and vectors alone. Graphs are tables: nodes (shard, node, level) and edges (shard, node, layer,
neighbours).
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CorruptionError
from ..functions.metrics import Metric
from ..plans.options import HnswConfig, QueryOptions
from ..sources.dataset import splitmix64
from .search import BROADCAST_QUERY_BYTES, _matching, attach, ranked

#: Slots of one shard: its vectors and graph fit into a worker, and building it is the longest task.
SHARD_SLOTS = 20_000
#: A walk that keeps ef_search nodes meets nearly all near ones in a shard of so many times ef_search slots, whatever the data.
SLOTS_PER_EF = 10
MOST_LEVEL = 254

NODES = "shard long, node long, level int"
EDGES = "shard long, node long, layer int, neighbours array<long>"


def covered_slots(config: HnswConfig) -> int:
    """Slots of a shard, if each query must find its neighbours: the larger a shard, the more a walk of ef_search nodes misses."""
    return min(SHARD_SLOTS, SLOTS_PER_EF * config.ef_search)


def draw_levels(slots: np.ndarray, config: HnswConfig) -> np.ndarray:
    """floor(-ln(u) / ln(M)) for a u in (0, 1) of 24 bits that belongs to the slot."""
    u = (splitmix64(config.seed, slots.astype(np.uint64)) >> np.uint64(40)).astype(float) / (1 << 24)
    u = np.where(u > 0, u, np.finfo(np.float32).tiny)
    return np.minimum(-np.log(u) * config.level_multiplier, MOST_LEVEL).astype(int)


class Graph:
    """A graph over the rows of a matrix, which are in the order of their slots."""

    def __init__(self, vectors: np.ndarray, metric: Metric, config: HnswConfig):
        self.v, self.metric, self.config = vectors.astype(np.float32), metric, config
        self.norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        self.levels = np.zeros(len(vectors), int)
        self.links: list[list[list[int]]] = [[] for _ in range(len(vectors))]
        self.entry = -1

    def keys(self, q: np.ndarray, q_norm: float, rows: list[int]) -> np.ndarray:
        base = self.v[rows]
        if self.metric is Metric.L2:
            d = base - q
            return np.einsum("ij,ij->i", d, d)
        product = base @ q
        if self.metric is Metric.DOT:
            return -product
        scale = self.norms[rows] * q_norm
        return np.where(scale > 0, 1 - product / np.where(scale > 0, scale, 1), 1.0)

    def build(self, levels: np.ndarray) -> None:
        for row, level in enumerate(levels.tolist()):
            self.add(row, level)

    def add(self, row: int, level: int) -> None:
        self.levels[row] = level
        self.links[row] = [[] for _ in range(level + 1)]
        if self.entry < 0:
            self.entry = row
            return
        q, q_norm = self.v[row], float(self.norms[row])
        top = int(self.levels[self.entry])
        near = self.descend(q, q_norm, self.entry, top, level)
        starts = [near]
        for layer in range(min(level, top), -1, -1):
            found = self.search_layer(q, q_norm, starts, self.config.ef_construction, layer)
            chosen = self.choose(found, self.config.m)
            self.links[row][layer] = chosen
            for other in chosen:
                self.connect(other, row, layer)
            starts = [x for _, x in found]
        if level > top:
            self.entry = row

    def choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of (key, row) in rising order, rows that are nearer to the target than to any chosen one; the nearest of the
        others fill up what is left."""
        out: list[int] = []
        passed: list[int] = []
        for key, row in found:
            if len(out) == most:
                return out
            if out and float(self.keys(self.v[row], float(self.norms[row]), out).min()) <= key:
                passed.append(row)
            else:
                out.append(row)
        return out + passed[: most - len(out)]

    def connect(self, row: int, new: int, layer: int) -> None:
        held = self.links[row][layer]
        if new in held:
            return
        held.append(new)
        most = self.config.budget(layer)
        if len(held) > most:
            keys = self.keys(self.v[row], float(self.norms[row]), held)
            self.links[row][layer] = self.choose(sorted(zip(keys.tolist(), held, strict=True)), most)

    def descend(self, q: np.ndarray, q_norm: float, start: int, top: int, level: int) -> int:
        """Walk to the nearest node on each layer above level."""
        best = start
        key = float(self.keys(q, q_norm, [best])[0])
        for layer in range(top, level, -1):
            while links := self.links[best][layer]:
                keys = self.keys(q, q_norm, links)
                i = int(keys.argmin())
                if keys[i] >= key:
                    break
                best, key = links[i], float(keys[i])
        return best

    def search_layer(self, q: np.ndarray, q_norm: float, starts: list[int], ef: int, layer: int) -> list[tuple[float, int]]:
        """Best-first search that keeps ef nodes and ends when the nearest open one is farther than all of them."""
        seen = set(starts)
        keys = self.keys(q, q_norm, starts).tolist()
        todo = sorted(zip(keys, starts, strict=True))
        kept = [(-k, -r) for k, r in todo]
        heapq.heapify(kept)
        while len(kept) > ef:
            heapq.heappop(kept)
        while todo:
            key, row = heapq.heappop(todo)
            if len(kept) >= ef and key > -kept[0][0]:
                break
            fresh = [x for x in self.links[row][layer] if x not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for k, x in zip(self.keys(q, q_norm, fresh).tolist(), fresh, strict=True):
                if len(kept) < ef:
                    heapq.heappush(kept, (-k, -x))
                    heapq.heappush(todo, (k, x))
                elif k < -kept[0][0]:
                    heapq.heapreplace(kept, (-k, -x))
                    heapq.heappush(todo, (k, x))
        return sorted((-k, -x) for k, x in kept)

    def search(self, q: np.ndarray, ef: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        q = q.astype(np.float32)
        q_norm = float(np.sqrt((q.astype(float) ** 2).sum()))
        near = self.descend(q, q_norm, self.entry, int(self.levels[self.entry]), 0)
        return self.search_layer(q, q_norm, [near], ef, 0)


def _sorted(t: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    t = t.sort_by("slot")
    n = t.num_rows
    flat = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return t.column("slot").to_numpy(), flat.reshape(n, -1) if n else flat.reshape(0, 1), t


def build(vectors: DataFrame, metric: Metric, config: HnswConfig = HnswConfig(), shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The edges of all shards' graphs, over all slots including tombstones: shard, node, layer, neighbours, with an empty
    list where a node has none. A node's level is its highest layer."""
    rows = vectors.select(F.floor(F.col("slot") / shard_slots).alias("shard"), "slot", "embedding")

    def run(t: pa.Table) -> pa.Table:
        slots, matrix, t = _sorted(t)
        g = Graph(matrix, metric, config)
        g.build(draw_levels(slots, config))
        return _table(g, t.column("shard")[0].as_py(), slots)

    return rows.groupBy("shard").applyInArrow(run, EDGES)


def _table(g: Graph, shard: int, slots: np.ndarray) -> pa.Table:
    """The edges of a shard's graph as rows of EDGES."""
    out = [(shard, int(slots[r]), layer, slots[links].tolist() if links else []) for r, layers in enumerate(g.links) for layer, links in enumerate(layers)]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], ["shard", "node", "layer", "neighbours"])


def restored(slots: np.ndarray, matrix: np.ndarray, edges: pa.Table, metric: Metric, config: HnswConfig) -> Graph:
    """The graph of a shard from its edges, whose nodes are the first of its slots; raises CorruptionError if an edge leads
    nowhere, to its own node or below its layer, stands twice, or if nodes or layers are missing or have too many links."""
    g = Graph(matrix, metric, config)
    row_of = {int(s): i for i, s in enumerate(slots)}
    held = sorted(zip(edges.column("node").to_pylist(), edges.column("layer").to_pylist(), edges.column("neighbours").to_pylist(), strict=True))

    def broken(node: int, layer: int, why: str) -> CorruptionError:
        return CorruptionError(f"graph: node {node} on layer {layer} {why}")

    for node, layer, links in held:
        r = row_of.get(node)
        if r is None:
            raise broken(node, layer, "is no slot of its shard")
        if layer != len(g.links[r]):
            raise broken(node, layer, "has a layer missing or twice")
        if len(links) > config.budget(layer):
            raise broken(node, layer, f"has {len(links)} links")
        if node in links or len(set(links)) < len(links):
            raise broken(node, layer, "links to itself or twice to another")
        if unknown := [x for x in links if x not in row_of]:
            raise broken(node, layer, f"links to {unknown[0]}, which is no slot of its shard")
        g.links[r].append([row_of[x] for x in links])
        g.levels[r] = layer
    n = next((r for r, layers in enumerate(g.links) if not layers), len(g.links))
    if any(g.links[n:]):
        raise broken(int(slots[n]), 0, "is missing")
    for r, layers in enumerate(g.links):
        for layer, links in enumerate(layers):
            if any(len(g.links[x]) <= layer for x in links):
                raise broken(int(slots[r]), layer, "links to a node that is not on this layer")
    g.entry = int(g.levels[:n].argmax()) if n else -1
    return g


def extend(vectors: DataFrame, edges: DataFrame, built_slots: int, metric: Metric, config: HnswConfig = HnswConfig(), shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The edges of the shards that hold slots from built_slots on, where edges are those of a graph over the slots before.

    Only these shards are read: the last one that was begun gets its new slots added, later ones are built. As a graph is
    built slot by slot, the edges equal those of build() over all vectors.
    """
    first = built_slots // shard_slots
    rows = vectors.where(F.col("slot") >= first * shard_slots).select(F.floor(F.col("slot") / shard_slots).alias("shard"), "slot", "embedding")
    old = edges.where(F.col("shard") >= first)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        slots, matrix, left = _sorted(left)
        g = restored(slots, matrix, right, metric, config)
        levels = draw_levels(slots, config)
        if [len(x) for x in g.links] != [int(n) + 1 if s < built_slots else 0 for s, n in zip(slots, levels, strict=True)]:
            raise CorruptionError(f"graph: shard {key[0].as_py()} is not that of its slots below {built_slots}")
        for row in range(int((slots < built_slots).sum()), len(slots)):
            g.add(row, int(levels[row]))
        return _table(g, key[0].as_py(), slots)

    return rows.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(run, EDGES)


def nodes(edges: DataFrame) -> DataFrame:
    """shard, node, level."""
    return edges.groupBy("shard", "node").agg(F.max("layer").alias("level"))


def entry_points(edges: DataFrame) -> DataFrame:
    """shard, entry, level: the first node of the highest level of each shard."""
    return nodes(edges).groupBy("shard").agg(F.max_by(F.struct(F.col("node").alias("entry"), "level"), F.struct("level", -F.col("node"))).alias("x")).select("shard", "x.*")


def neighbours(edges: DataFrame, node: int, layer: int) -> DataFrame:
    return edges.where((F.col("node") == node) & (F.col("layer") == layer)).select(F.explode("neighbours").alias("neighbour"))


def search(store: DataFrame, edges: DataFrame, queries: DataFrame, metric: Metric, options: QueryOptions = QueryOptions(), config: HnswConfig = HnswConfig(), shard_slots: int = SHARD_SLOTS, parts: int | None = None) -> DataFrame:
    """Approximate neighbours of queries (qid, query): qid, rank, id, slot, score (and metadata).

    Each shard is walked with the same ef. Tombstones route but are dropped from answers, so there may be fewer than k. With
    a filter, options.fetch neighbours are fetched and filtered then. Queries are gathered up to BROADCAST_QUERY_BYTES; more
    are dealt by a hash into parts of that size, which are searched one after the other.
    """
    if parts is None:
        size = queries.agg(F.sum(F.size("query").cast("long") * 4)).first()[0] or 0
        parts = -(-size * 2 // BROADCAST_QUERY_BYTES) if size > BROADCAST_QUERY_BYTES else 1
    if parts > 1:
        part = F.pmod(F.xxhash64("qid"), F.lit(parts))
        found = [search(store, edges, queries.where(part == i), metric, options, config, shard_slots, 1) for i in range(parts)]
        return functools.reduce(DataFrame.unionByName, found)
    fetch = options.fetch
    ef = max(fetch, options.ef_search or config.ef_search)
    table = queries.select("qid", "query").toArrow()
    qids, matrix = table.column("qid").to_pylist(), [np.array(q, np.float32) for q in table.column("query").to_pylist()]
    shared = store.sparkSession.sparkContext.broadcast((qids, matrix))
    rows = store.select(F.floor(F.col("slot") / shard_slots).alias("shard"), "slot", "id", "embedding", "live")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        slots, base, left = _sorted(left)
        ids, alive = left.column("id").to_numpy(), left.column("live").to_numpy()
        g = restored(slots, base, right, metric, config)
        out = [(qid, int(slots[r]), int(ids[r]), float(key)) for qid, q in zip(*shared.value, strict=True) for key, r in [x for x in g.search(q, ef) if alive[x[1]]][:fetch]]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["qid", "slot", "id", "rank_key"])

    found = rows.groupBy("shard").cogroup(edges.groupBy("shard")).applyInArrow(run, "qid long, slot long, id long, rank_key double")
    best = ranked(found, fetch)
    if options.filter:
        kept = _matching(store, options).select("slot")
        best = ranked(best.drop("rank").join(kept, "slot", "left_semi"), options.k)
    return attach(best, store, metric, options)


def integrity(edges: DataFrame, config: HnswConfig = HnswConfig()) -> DataFrame:
    """check, violations: counts of what a graph must not have; all are 0 for a sound one."""
    levels = nodes(edges).select(F.col("shard").alias("_s"), F.col("node").alias("_n"), "level")
    links = edges.select("shard", "node", "layer", F.explode("neighbours").alias("to"))
    target = links.join(levels, (F.col("shard") == F.col("_s")) & (F.col("to") == F.col("_n")), "left")
    budget = F.when(F.col("layer") == 0, 2 * config.m).otherwise(config.m)

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")

    tops = edges.groupBy("shard", "node").agg(F.max("layer").alias("top"), F.count("*").alias("layers"))
    return (
        count(edges.where(F.size("neighbours") > budget), "too many neighbours")
        .union(count(links.where("to = node"), "links to itself"))
        .union(count(target.where("_n IS NULL"), "unknown neighbour"))
        .union(count(target.where("level < layer"), "neighbour below the layer"))
        .union(count(tops.where("layers <> top + 1"), "missing layer"))
        .union(count(edges.where(F.size(F.array_distinct("neighbours")) < F.size("neighbours")), "repeated neighbour"))
    )


