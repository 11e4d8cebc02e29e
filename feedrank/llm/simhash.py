"""Near-duplicate documents by SimHash fingerprints, searched with vantage-point trees.

Fingerprints are partitioned by a vantage-point tree: at each node, those within the node's radius of
its vantage fingerprint (Hamming distance) go inside, the others outside. By the triangle
inequality an outside fingerprint can be linked to an inside one only if it is at most radius +
`max_bits` away from the vantage point, so those, and only those, are also sent inside; all other
branches are pruned. Each leaf is a shard that finds its links exactly, and every link is found in
some shard: follow the two ends from the root; as long as they go the same way both stay together, and
at the first node that parts them the outer one lies in the band and is sent inside as well.

The tree is fitted on a small, bounded sample of fingerprints (`per_leaf`, `sample`), which only decides how even the
shards are: every fingerprint is routed and every shard is searched, whatever the sample. A shard
searches with a local tree of the same kind and returns, instead of all its pairs, one link from
each member to the least member that it reaches there, so a group of copies costs links in
proportion to its size. Equal fingerprints are merged before the search.

Defined results: null and blank texts have fingerprint zero and are linked like any other; repeated
rows have equal fingerprints and so one component; a row with a null doc_id is linked like any other but
names no component, and its own component_id is null; a very long text is hashed in blocks, whole; other
columns are neither read nor returned, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedrank.llm.common import rows_of, stored
from feedrank.operators.components import components

SEED = 42


@dataclass(frozen=True)
class SimHash:
    """`leaf`: fingerprints that a shard should hold; `per_leaf`: how many of them, by a hash, the tree is fitted
    on, and `sample` the most in all; `local`: below how many a shard compares directly."""

    shingle: int = 3
    max_bits: int = 2
    leaf: int = 8192
    per_leaf: int = 64
    sample: int = 1 << 20
    local: int = 384


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a whole text over its word shingles, repeats included."""
    words = (text or "").encode().lower().split()  # of bytes: folds A-Z, cuts at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(len(words) - shingle, 0)
    spans = zip(starts[: last + 1].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, last + 1)
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # long texts some shingles at a time
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text",
                 marks: Sequence[Column] = ()) -> DataFrame:
    """Rows (doc_id, bits, m0, m1, ...): the fingerprint as a signed long with the same bits, and for each of `marks`
    its value, a long that tells rows of one id apart."""
    extra = [f"m{i}" for i in range(len(marks))]

    def run(batches):
        for rows in rows_of(batches):
            bits = np.array([fingerprint(r[1], shingle) for r in rows], np.uint64).view(np.int64)
            kept = [pa.array([r[i] for r in rows], pa.int64()) for i in (0, *range(2, len(extra) + 2))]
            yield pa.RecordBatch.from_arrays([kept[0], pa.array(bits), *kept[1:]], ["doc_id", "bits", *extra])

    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"),
                         *(mark.cast("long").alias(name) for mark, name in zip(marks, extra)))
    return narrow.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "bits", *extra)))


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _vantage(points: np.ndarray, rng: np.random.Generator, tries: int = 8) -> tuple[np.uint64, int]:
    """A point and a radius that part `points` into two shares of similar size with a thin band outside."""
    best = (2.0, points[0], 64)
    for point in rng.choice(points, size=min(tries, len(points)), replace=False):
        shares = np.cumsum(np.bincount(distance(points, point), minlength=68)[:68]) / len(points)
        radii = np.arange(0, 64)
        inside, reached = shares[radii], shares[radii + 2]
        cost = np.maximum(reached, 1 - inside) + (reached - inside)
        i = int(cost.argmin())
        if cost[i] < best[0]:
            best = (float(cost[i]), point, int(radii[i]))
    return best[1], best[2]


class VantageTree:
    """Nodes in arrays: the vantage fingerprint, its radius, the nodes inside and outside; a negative
    node is the leaf ~node."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7):
        self.vantage, self.radius, self.inside, self.outside = [], [], [], []
        self.leaves, rng = 0, np.random.default_rng(seed)
        limit = max(16, len(sample) // max(leaves, 1))
        self.root = self._grow(np.unique(sample), limit, rng)
        self.vantage = np.array(self.vantage, np.uint64)
        self.radius = np.array(self.radius, np.int64)
        self.inside, self.outside = np.array(self.inside, np.int64), np.array(self.outside, np.int64)

    def _grow(self, points: np.ndarray, limit: int, rng: np.random.Generator) -> int:
        if len(points) > limit:
            vantage, radius = _vantage(points, rng)
            near = distance(points, vantage) <= radius
            if 0 < near.sum() < len(points):
                node = len(self.vantage)
                self.vantage.append(vantage)
                self.radius.append(radius)
                self.inside.append(0)
                self.outside.append(0)
                self.inside[node] = self._grow(points[near], limit, rng)
                self.outside[node] = self._grow(points[~near], limit, rng)
                return node
        self.leaves += 1
        return -self.leaves

    def route(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place that a point is sent to, the index of the point and the leaf (from 1)."""
        index, node = np.arange(len(points)), np.full(len(points), self.root, np.int64)
        done_index, done_leaf = [], []
        while len(index):
            leaf = node < 0
            done_index.append(index[leaf])
            done_leaf.append(-node[leaf])
            index, node = index[~leaf], node[~leaf]
            away = distance(points[index], self.vantage[node]).astype(np.int64)
            near, outer = away <= self.radius[node] + reach, away > self.radius[node]
            index, node = (
                np.concatenate([index[near], index[outer]]),
                np.concatenate([self.inside[node[near]], self.outside[node[outer]]]))
        return np.concatenate(done_index), np.concatenate(done_leaf)


def local_links(points: np.ndarray, reach: int, local: int) -> np.ndarray:
    """For each of the distinct `points` the index of the least point that it reaches by links among
    them. Shards are searched with a tree of their own; its leaves compare directly."""
    root = np.arange(len(points))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    tree = VantageTree(points, max(1, len(points) // local))
    index, leaf = tree.route(points, reach)
    order = np.argsort(leaf, kind="stable")
    index = index[order]
    for members in np.split(index, np.flatnonzero(np.diff(leaf[order])) + 1):
        rest = members
        while len(rest):  # one component of the leaf after the other, breadth first
            frontier, rest = [rest[0]], rest[1:]
            start = frontier[0]
            while frontier and len(rest):
                near = distance(points[rest], points[frontier.pop()]) <= reach
                for i in rest[near].tolist():
                    frontier.append(i)
                    a, b = find(start), find(i)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                rest = rest[~near]
    return np.array([find(i) for i in range(len(points))], np.int64) if len(points) else root


def linked(nodes: DataFrame, settings: SimHash = SimHash()) -> DataFrame:
    """Links (a, b) that join what `nodes` (node, bits; both distinct) links within `max_bits` bits: in
    every shard from each member to the least it reaches there. `nodes` should be a stored table."""
    total = nodes.count()
    share = min(1.0, settings.per_leaf / settings.leaf, settings.sample / max(total, 1))
    chosen = F.pmod(F.xxhash64("bits"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0)
    rows = nodes.where(chosen).select("bits").limit(2 * settings.sample).toPandas()
    sample = rows["bits"].to_numpy(np.int64).view(np.uint64)
    if not len(sample):
        sample = np.zeros(1, np.uint64)
    tree = nodes.sparkSession.sparkContext.broadcast(VantageTree(np.sort(sample), -(-total // settings.leaf)))
    reach, local = settings.max_bits, settings.local

    def route(batches):
        for batch in batches:
            points = batch.column("bits").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            index, leaf = tree.value.route(points, reach)
            taken = batch.take(pa.array(index))
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf, pa.int64()), taken.column("node"), taken.column("bits")], ["leaf", "node", "bits"])

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("node")
        node = shard["node"].to_numpy(np.int64)
        root = local_links(shard["bits"].to_numpy(np.int64).view(np.uint64), reach, local)
        moved = root != np.arange(len(root))
        return pd.DataFrame({"a": node[moved], "b": node[root[moved]]})

    routed = nodes.select("node", "bits").mapInArrow(route, "leaf long, node long, bits long")
    return routed.groupBy("leaf").applyInPandas(search, "a long, b long")


def groups(prints: DataFrame, settings: SimHash = SimHash()) -> DataFrame:
    """Rows (bits, component, component_id) for the distinct fingerprints of `prints` (doc_id, bits), which should be
    a stored table: the least fingerprint, as a signed long, and the smallest doc_id of all that are reachable
    over links. Fingerprints are the nodes, so rows that repeat a doc_id with other texts are not mixed up."""
    nodes = stored(prints.groupBy("bits").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(linked(nodes.select(F.col("bits").alias("node"), "bits"), settings))
    members = stored(found.join(nodes, found["node"] == nodes["bits"]).select("node", "component", "least"), "members")
    names = members.groupBy("component").agg(F.min("least").alias("component_id"))
    named = members.select("node", "component").join(names, "component")
    single = F.col("component").isNull()
    return nodes.join(named, nodes["bits"] == named["node"], "left").select(
        "bits", F.when(single, F.col("bits")).otherwise(F.col("component")).alias("component"),
        F.when(single, F.col("least")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(prints: DataFrame, settings: SimHash = SimHash()) -> DataFrame:
    """Rows (doc_id, bits, component_id) for `prints` (doc_id, bits), which should be a stored table. The
    component is named by the smallest doc_id that is reachable over links, the document itself included."""
    found = groups(prints, settings).select(F.col("bits").alias("__bits"), "component_id")
    return prints.join(found, prints["bits"] == found["__bits"], "left").select(
        "doc_id", "bits", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def hexadecimal(bits):
    """The 16 lower-case hex digits of a fingerprint held as a long."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
