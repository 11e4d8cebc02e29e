"""Hard negatives for anchors: the most similar rows of other labels within a window of scores.

Vectors are scaled and cut to whole numbers; the score of a row is its inner product with the anchor. All rows are
indexed by a multiway tree in the manner of GNAT: a node has some split points, rows go to the child of the
nearest one, and so down to leaves. For every split point and every child the least and the greatest distance between
the point and the rows below the child are kept, those of its own child and of all siblings. As a score s means the distance
sqrt(|x|^2 + |q|^2 - 2 s), a window of scores is an annulus around the anchor, given the norms below a child. A child
is left out when, for some split point, its range of distances, moved by the anchor's own distance to the point, can't meet
the annulus. Leaves that remain are searched exactly, so no row is missed and recall is 1.

The windows are narrowed first by the rows that the tree was fitted on: the `positives`-th best score among them, or the
`negatives`-th best in a window, is a lower bound for the result, since these rows are rows of the table. The fit takes at most
twice `sample` rows, chosen by a hash of the id, and only decides how the rest is dealt: every row is routed, every range covers
every row. The tree, its ranges and the sample are broadcast; their size depends on the settings and the vectors' length
alone, not on the number of rows.

Anchors travel to the leaves that remain. A task gets a leaf's rows first, `leaf` of them at most, since larger leaves are cut,
and then its anchors batch by batch, so it never holds more than these. It passes on the first few rows of each window, and the
same first few of all leaves are the result.

Defined results: rows with a null id, a null label, a null vector, or a null or non-finite component take no part; a shorter vector
counts as if it went on with zeros; of rows that repeat an id only that with the least label, then vector, takes part; equal scores
are ordered by id; an anchor without other rows of its label has no positives and gives no rows, nor does a positive without rows in
its window; an empty table gives no rows; components so large that scores may not
fit in 64 bits raise; other columns are neither read nor returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedrank.llm.common import stored
from feedrank.operators.rank import first_of_each

_VERY = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Mining:
    """`low`, `high`: the window, in percent of the positive's score; `scale`: of the components; `leaf`: rows of a leaf;
    `arity`: split points of a node; `sample`: rows that the tree is fitted on; `fitted`: the fewest of them in a leaf; `streams`:
    anchors that one task is sent for a leaf, at most."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    leaf: int = 8192
    arity: int = 12
    sample: int = 8192
    fitted: int = 8
    streams: int = 1 << 20


def squared(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all points."""
    return np.maximum((x * x).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * (x @ points.T), 0.0)


class SplitTree:
    """`points` and `children` of each node; a negative child is the leaf ~child. `ranges` hold, once they are known, for
    each node and child the least and greatest distance to every point, and the least and greatest squared norm."""

    def __init__(self, sample: np.ndarray, limit: int, arity: int, seed: int = 11):
        self.points, self.children, self.leaves, self.ranges = [], [], 0, {}
        self._rng, self._limit, self._arity = np.random.default_rng(seed), max(limit, 1), arity
        self.root = self._grow(sample)

    def _split_points(self, x: np.ndarray) -> np.ndarray:
        """Points far from each other, one after the other the farthest from all before, out of some candidates."""
        some = x[self._rng.choice(len(x), min(len(x), 3 * self._arity), replace=False)]
        chosen, away = [0], squared(some, some[:1])[:, 0]
        while len(chosen) < self._arity and away.max() > 0:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, squared(some, some[chosen[-1:]])[:, 0])
        return some[chosen]

    def _grow(self, x: np.ndarray) -> int:
        if len(x) > self._limit:
            points = self._split_points(x)
            if len(points) > 1:
                node, near = len(self.points), squared(x, points).argmin(1)
                self.points.append(points)
                self.children.append([])
                self.children[node] = [self._grow(x[near == j]) for j in range(len(points))]
                return node
        self.leaves += 1
        return -self.leaves

    def visits(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(node, rows that come there, their squared distances to its points, their children), from the root down."""
        waiting = [(self.root, np.arange(len(x)))] if self.root >= 0 and len(x) else []
        while waiting:
            node, rows = waiting.pop()
            away = squared(x[rows], self.points[node])
            near = away.argmin(1)
            yield node, rows, away, near
            for j in np.unique(near).tolist():
                if self.children[node][j] >= 0:
                    waiting.append((self.children[node][j], rows[near == j]))

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        leaf = np.zeros(len(x), np.int32)
        for node, rows, _, near in self.visits(x):
            child = np.array(self.children[node])[near]
            leaf[rows[child < 0]] = ~child[child < 0]
        return leaf

    def reached(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) for the leaves that may hold a row whose score with the query lies in [low, high]."""
        if self.root < 0:
            return np.arange(len(q)), np.zeros(len(q), np.int32)
        norm, found, waiting = (q * q).sum(1), [], [(self.root, np.arange(len(q)))]
        while waiting:
            node, rows = waiting.pop()
            if not len(rows):
                continue
            away = np.sqrt(squared(q[rows], self.points[node]))
            for j, child in enumerate(self.children[node]):
                if (node, j) not in self.ranges:
                    continue  # no row is there
                least, most, norm_least, norm_most = self.ranges[node, j]
                slack = np.sqrt(1e-12 * (norm_most + norm[rows]) + 1e-9)
                closest = np.maximum(np.maximum(away - most, least - away).max(1), 0.0)
                farthest = (away + most).min(1)
                outer = norm_most + norm[rows] - 2.0 * low[rows]
                inner = np.sqrt(np.maximum(norm_least + norm[rows] - 2.0 * high[rows], 0.0))
                alive = (outer >= -slack) & (closest <= np.sqrt(np.maximum(outer, 0.0)) + slack) & (farthest >= inner - slack)
                if child >= 0:
                    waiting.append((child, rows[alive]))
                else:
                    found.append((rows[alive], np.full(int(alive.sum()), ~child, np.int32)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return tuple(np.concatenate(part) for part in zip(*found))


@dataclass(frozen=True)
class _Kind:
    """How vectors are held: their length, the type of stored components, and the type products are exact in."""

    dims: int
    held: str
    exact: str

    def matrix(self, vectors: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(vectors), self.held).reshape(len(vectors), self.dims)


def _kind(dims: int, largest: float) -> _Kind:
    held = "<i2" if largest < 2**15 else "<i4" if largest < 2**31 else "<i8"
    most = dims * largest**2
    return _Kind(max(dims, 1), held, "f4" if most < 2**24 else "f8" if most < 2**53 else "O")


def _taking_part(rows: DataFrame, anchors: Column, id_column: str, label_column: str, vector_column: str) -> DataFrame:
    """Rows (id, label, vector, anchor) that take part, each id once."""
    finite = F.forall(vector := rows[vector_column].cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = rows.select(rows[id_column].cast("long").alias("id"), rows[label_column].cast("long").alias("label"), vector.alias("vector"),
                      F.coalesce(anchors, F.lit(False)).alias("anchor"), F.coalesce(finite, F.lit(False)).alias("finite"))
    own = own.where("finite AND id IS NOT NULL AND label IS NOT NULL").drop("finite")
    repeated = stored(own.groupBy("id").count().where("count > 1").select("id"), "repeated")
    if repeated.isEmpty():
        return own
    least = own.join(repeated, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("row"))
    return own.join(repeated, "id", "left_anti").unionByName(least.select("id", "row.*"))


_ROUTED = "id long, label long, vector binary, anchor boolean, leaf int"


def _routed(rows: DataFrame, kind: _Kind, tree, scale: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = np.zeros((batch.num_rows, kind.dims))
            column = batch.column("vector")
            sizes = np.diff(column.offsets.to_numpy())
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            x[np.repeat(np.arange(len(sizes)), sizes), place] = np.floor(float(scale) * column.flatten().to_numpy())
            held = x.astype(kind.held)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("label"), pa.array([v.tobytes() for v in held], pa.binary()), batch.column("anchor"),
                pa.array(tree.value.route(x), pa.int32())], ["id", "label", "vector", "anchor", "leaf"])

    return rows.select("id", "label", "vector", "anchor").mapInArrow(run, _ROUTED)


def _ranges(routed: DataFrame, kind: _Kind, tree) -> dict:
    """The ranges of all rows below each node and child: a row per child and point on the driver."""

    def run(batches):
        for batch in batches:
            x, out = kind.matrix(batch.column("vector").to_pylist()).astype(float), []
            norm = (x * x).sum(1)
            for node, rows, away, near in tree.value.visits(x):
                for j in np.unique(near).tolist():
                    mine = near == j
                    out.append((node, j, -1, norm[rows[mine]].min(), norm[rows[mine]].max()))
                    least, most = np.sqrt(away[mine].min(0)), np.sqrt(away[mine].max(0))
                    out += [(node, j, i, a, b) for i, (a, b) in enumerate(zip(least.tolist(), most.tolist()))]
            columns = list(zip(*out)) if out else [()] * 5
            types = [pa.int32()] * 3 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["node", "child", "point", "least", "most"])

    each = routed.select("vector").mapInArrow(run, "node int, child int, point int, least double, most double")
    found = each.groupBy("node", "child", "point").agg(F.min("least"), F.max("most")).collect()
    parts = {}
    for node, child, point, least, most in found:
        parts.setdefault((node, child), {})[point] = least, most
    out = {}
    for key, own in parts.items():
        norm = own.pop(-1)
        out[key] = (*(np.array([own[i][k] for i in range(len(own))]) for k in (0, 1)), *norm)
    return out


_WINDOW = "array<struct<key: long, value: long, low: long, high: long>>"
_SENT = f"leaf int, part int, later int, id long, label long, vector binary, windows {_WINDOW}"


class _Index:
    """What every task knows: the tree with its ranges, the sample, and in how many parts each leaf and the anchors are cut."""

    def __init__(self, tree: SplitTree, ids: np.ndarray, labels: np.ndarray, sample: np.ndarray, parts: dict[int, int], streams: int):
        self.tree, self.ids, self.labels, self.sample, self.parts, self.streams = tree, ids, labels, sample, parts, streams


def _first(scores: np.ndarray, ids: np.ndarray, chosen: np.ndarray, n: int) -> np.ndarray:
    """The indices of the best `n` of the chosen rows, by score, then id."""
    if len(chosen) > n:
        own = scores[chosen]
        chosen = chosen[own >= np.partition(own, len(own) - n)[len(own) - n]]
    return chosen[np.lexsort((ids[chosen], -scores[chosen]))[:n]]


def _in_window(scores, same: np.ndarray, low: int, high: int) -> np.ndarray:
    return np.flatnonzero(same & (scores >= low) & (scores <= high))


def _sent(anchors: DataFrame, index, kind: _Kind, n: int, same: bool) -> DataFrame:
    """Anchors (id, label, vector, windows) sent to the leaves that their windows, narrowed by the sample, may meet."""

    def run(batches):
        known = index.value
        sample = known.sample.astype(kind.exact).T
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256).to_pylist()
                q = kind.matrix([r["vector"] for r in rows])
                scores, of, bounds, windows = q.astype(kind.exact) @ sample, [], [], []
                for i, r in enumerate(rows):
                    fits = ((known.labels == r["label"]) == same) & (known.ids != r["id"])
                    for w in r["windows"]:
                        inside = _in_window(scores[i], fits, w["low"], w["high"])
                        if len(inside) >= n:
                            own = scores[i][inside]
                            w["low"] = max(w["low"], int(np.partition(own, len(own) - n)[len(own) - n]))
                        if w["low"] <= w["high"]:
                            of.append(i)
                            windows.append(w)
                if not of:
                    continue
                bounds = np.array([[w["low"], w["high"]] for w in windows], float)
                bounds[bounds >= _VERY], bounds[bounds <= -_VERY] = np.inf, -np.inf
                query, leaf = known.tree.reached(q[of].astype(float), bounds[:, 0], bounds[:, 1])
                sent = {}
                for k, at in zip(query.tolist(), leaf.tolist()):
                    sent.setdefault((of[k], at), []).append(windows[k])
                out = [
                    (at, part * known.streams + rows[i]["id"] % known.streams, 1, rows[i]["id"], rows[i]["label"], rows[i]["vector"], own)
                    for (i, at), own in sent.items() for part in range(known.parts.get(at, 0))]
                if out:
                    yield _arrow(out)

    return anchors.select("id", "label", "vector", "windows").mapInArrow(run, _SENT)


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    window = pa.struct([(name, pa.int64()) for name in ("key", "value", "low", "high")])
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(window)]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), types)], ["leaf", "part", "later", "id", "label", "vector", "windows"])


def _searched(routed: DataFrame, sent: DataFrame, index, kind: _Kind, n: int, same: bool) -> DataFrame:
    """Rows (anchor, key, value, id, score): the best `n` of each window in each part of each leaf."""
    streams = index.value.streams
    parts = F.create_map(*(F.lit(x) for leaf, cut in index.value.parts.items() for x in (leaf, cut)))
    part = F.pmod(F.xxhash64("id"), F.try_element_at(parts, F.col("leaf"))).cast("int")
    data = routed.select(
        "leaf", F.explode(F.sequence(part * streams, part * streams + (streams - 1))).alias("part"), F.lit(0).alias("later"),
        "id", "label", "vector", F.lit(None).cast(_WINDOW).alias("windows"))

    def run(batches):
        group, ids, labels, vectors, x = None, [], [], [], None
        for batch in batches:
            found = []
            columns = [batch.column(c) for c in ("leaf", "part", "later", "id", "label", "vector", "windows")]
            for at, own_part, later, own, label, vector, windows in zip(*(c.to_pylist() for c in columns)):
                if (at, own_part) != group:
                    group, ids, labels, vectors, x = (at, own_part), [], [], [], None
                if not later:
                    ids.append(own)
                    labels.append(label)
                    vectors.append(vector)
                    continue
                if not ids:
                    continue
                if x is None:
                    x, all_ids, all_labels = kind.matrix(vectors).astype(kind.exact), np.array(ids), np.array(labels)
                    vectors = []
                scores = x @ kind.matrix([vector])[0].astype(kind.exact)
                fits = ((all_labels == label) == same) & (all_ids != own)
                for w in windows:
                    chosen = _first(scores, all_ids, _in_window(scores, fits, w["low"], w["high"]), n)
                    found += [(own, w["key"], w["value"], i, int(s)) for i, s in zip(all_ids[chosen].tolist(), scores[chosen].tolist())]
            columns = list(zip(*found)) if found else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "key", "value", "id", "score"])

    both = data.unionByName(sent).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "later")
    return both.mapInArrow(run, "anchor long, key long, value long, id long, score long")


def hard_negatives(rows: DataFrame, anchors: Column, settings: Mining = Mining(), id_column: str = "vec_id", label_column: str = "label",
                   vector_column: str = "embedding") -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row for which `anchors` holds
    and each of its positives the best rows of other labels in the window."""
    s = settings
    own = _taking_part(rows, anchors, id_column, label_column, vector_column)
    sizes = own.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x) * s.scale + 1))),
                    F.count_if("anchor")).first()
    total, kind = sizes[0], _kind(sizes[1] or 1, sizes[2] or 1.0)
    if kind.dims * (sizes[2] or 0) ** 2 >= 2**63:
        raise ValueError("scores may not fit in 64 bits")
    spark = rows.sparkSession
    share = min(1.0, s.sample / max(total, 1))
    chosen = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1.0)
    some = own.where(chosen).limit(2 * s.sample).select("id", "label", "vector").toArrow().sort_by("id")
    sample = np.zeros((some.num_rows, kind.dims))
    for i, v in enumerate(some.column("vector").to_pylist()):
        sample[i, : len(v)] = np.floor(float(s.scale) * np.array(v, float))
    tree = SplitTree(sample, max(s.fitted, some.num_rows * s.leaf // max(total, 1)), s.arity)
    shared = spark.sparkContext.broadcast(tree)
    routed = stored(_routed(own, kind, shared, s.scale), "routed")
    tree.ranges = _ranges(routed, kind, shared)
    parts = {leaf: -(-n // s.leaf) for leaf, n in routed.groupBy("leaf").count().collect()}
    index = spark.sparkContext.broadcast(_Index(
        tree, some.column("id").to_numpy(), some.column("label").to_numpy(), sample.astype(kind.held), parts, -(-max(sizes[3], 1) // s.streams)))

    def best(windows: DataFrame, n: int, same: bool) -> DataFrame:
        found = _searched(routed, _sent(windows, index, kind, n, same), index, kind, n, same)
        return first_of_each(found, ["anchor", "key"], [F.col("score").desc(), F.col("id").asc()], n)

    def window(key: Column, value: Column, low: Column, high: Column) -> Column:
        return F.struct(*(c.cast("long").alias(name) for c, name in zip((key, value, low, high), ("key", "value", "low", "high"))))

    queries = routed.where("anchor").select("id", "label", "vector")
    everything = window(F.lit(0), F.lit(0), F.lit(-_VERY), F.lit(_VERY))
    positives = stored(best(queries.withColumn("windows", F.array(everything)), s.positives, True).select("anchor", "id", "score"), "positives")
    wide = F.col("score").cast("decimal(22,0)")
    windows = positives.groupBy("anchor").agg(F.collect_list(window(  # at most so many as there are positives
        F.col("id"), F.col("score"), F.ceil(wide * s.low / 100), F.floor(wide * s.high / 100))).alias("windows"))
    negatives = best(queries.join(windows, queries["id"] == windows["anchor"]).drop("anchor"), s.negatives, False)
    return negatives.select(
        F.col("anchor").alias("anchor_id"), F.col("key").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("value").alias("positive_score"), F.col("score").alias("negative_score"))
