"""Random forest of deep trees as Spark jobs.

Features are cut into at most `BINS` ranges.  Of a table with more than `smallRows` distinct rows of ranges, nodes of more than `smallRows` rows are split level by level: each task adds
up one histogram per node, and the sums choose the splits.  Rows of equal ranges are alike to a tree, so each task adds them up first.  Below them the rows are moved by (tree, node), packed
by the thousands, and each subtree is finished inside one task, which holds about `smallRows` rows.  Every tree sees each row a
Poisson number of times, by a hash of row, tree and seed, so a lost task is repeated alike.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.base import _FitMultipleIterator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerogrid.session import DEALT_ROWS, part_sizes, settle, uneven

BINS = 32
SMALL_ROWS = 200_000
BUFFER_ROWS = 500_000  # that a task deals out at once
SCORED = 500_000  # rows of bins whose scores a task keeps
HISTOGRAMS = 20_000  # nodes whose histograms one pass over the rows adds up
POISSON = np.cumsum(np.exp(-1.0) / np.array([1.0, 1, 2, 6, 24, 120, 720, 5040, 40320]))
CHUNK = 1 << 15  # rows whose draws stay in a core's cache


def _least_above(share: float) -> int:
    """The smallest of 64 bits that, as a share of 2 ** 64, exceeds `share`."""
    x = share * 2.0**64
    middle = int(x) + int(np.spacing(x)) // 2
    return middle if float(middle) > x else middle + 1


DRAWS = np.array([_least_above(x) for x in POISSON], np.uint64)


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """64 well mixed bits of each number."""
    h = values.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _times(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree sees each row: the number of `POISSON` below the row's hash as a share."""
    out = np.zeros(len(rows), np.uint8)
    for at in range(0, len(rows), CHUNK):
        part, h = out[at : at + CHUNK], _mixed(rows[at : at + CHUNK], seed * 100_003 + tree)
        for least in DRAWS:
            part += h >= least
    return out


def _choice(tree: int, node: int, seed: int, features: int, tried: int) -> np.ndarray:
    """The features that a node tries."""
    return np.random.default_rng((seed, tree, node)).permutation(features)[:tried]


def _keys(bins: np.ndarray) -> np.ndarray:
    """One sortable key per row of bins."""
    width = bins.shape[1]
    if width > 8:
        return np.ascontiguousarray(bins).view(np.dtype((np.void, width))).ravel()
    padded = np.zeros((len(bins), 8), np.uint8)
    padded[:, :width] = bins
    return padded.view(np.uint64).ravel()


def _alike(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of bins, and the number of the one that each row equals."""
    _, first, cell = np.unique(_keys(bins), return_index=True, return_inverse=True)
    return bins[first], cell.ravel()


def _impurity(w: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weight times the Gini impurity, of weights and weights of the positive rows."""
    return 2.0 * y * (w - y) / np.maximum(w, 1e-300)


def best_splits(hist: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tried feature, last bin that goes left, gain) of each node, from sums [node, feature, bin, (times, weight, positive)]."""
    left = np.cumsum(hist, axis=2)
    total = left[:, :, -1:, :]
    left = left[:, :, :-1, :]
    right = total - left
    gain = _impurity(total[..., 1], total[..., 2]) - _impurity(left[..., 1], left[..., 2]) - _impurity(right[..., 1], right[..., 2])
    gain = np.where((left[..., 0] >= least) & (right[..., 0] >= least), gain, -1.0).reshape(len(hist), -1)
    best = gain.argmax(axis=1)
    return best // (hist.shape[2] - 1), best % (hist.shape[2] - 1), gain[np.arange(len(hist)), best]


def _sums(bins: np.ndarray, tries: np.ndarray, place: np.ndarray, times: np.ndarray, weight: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Sums [node, tried feature, bin, (times, weight, positive)] of rows that stand at node `place`."""
    nodes, tried = tries.shape
    out = np.empty((nodes, tried, BINS, 3))
    rows = np.arange(len(bins))
    for j in range(tried):
        at = place * BINS + bins[rows, tries[place, j]]
        for i, values in enumerate((times, weight, positive)):
            out[:, j, :, i] = np.bincount(at, values, nodes * BINS).reshape(nodes, BINS)
    return out


def grow(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, times: np.ndarray, depth: int, least: int, least_split: int, tried: int, rng) -> dict[str, np.ndarray]:
    """The tree of single rows, which a tree sees `times` times."""
    return grow_cells(bins, times, weight * times, weight * times * y, depth, least, least_split, tried, rng)


def grow_cells(bins: np.ndarray, times: np.ndarray, weight: np.ndarray, positive: np.ndarray, depth: int, least: int, least_split: int, tried: int, rng) -> dict[str, np.ndarray]:
    """A whole tree of these sums over equal rows, all nodes of a level at once: feature (-1: leaf), bin, left (right is next to it), value, gain."""
    rows, place = np.arange(len(bins)), np.zeros(len(bins), np.int64)
    found: dict[str, list[np.ndarray]] = {k: [] for k in ("feature", "bin", "left", "value", "gain")}
    nodes, known = 1, 1
    while nodes:
        n, w, p = (np.bincount(place, x[rows], nodes) for x in (times, weight, positive))
        feature, cut, left, gain = np.full(nodes, -1, np.int16), np.zeros(nodes, np.uint8), np.zeros(nodes, np.int32), np.zeros(nodes, np.float32)
        found["value"].append((p / np.maximum(w, 1e-300)).astype(np.float32))
        open_ = np.flatnonzero((n >= least_split) & (p > 0) & (p < w)) if depth else np.zeros(0, np.int64)
        split = open_
        if len(open_):
            rank = np.full(nodes, -1)
            rank[open_] = np.arange(len(open_))
            here = rank[place] >= 0
            rows, place = rows[here], rank[place[here]]
            tries = rng.random((len(open_), bins.shape[1])).argsort(axis=1)[:, :tried]
            j, at, best = best_splits(_sums(bins[rows], tries, place, times[rows], weight[rows], positive[rows]), least)
            good = best > 1e-12
            split = open_[good]
            feature[split], cut[split], gain[split] = tries[np.arange(len(j)), j][good], at[good], best[good]
            left[split] = known + 2 * np.arange(len(split))
            here = good[place]
            rows, place = rows[here], (np.cumsum(good) - 1)[place[here]]
            place = 2 * place + (bins[rows, feature[split][place]] > cut[split][place])
        for k, v in (("feature", feature), ("bin", cut), ("left", left), ("gain", gain)):
            found[k].append(v)
        nodes = 2 * len(split)
        known += nodes
        depth -= 1
    return {k: np.concatenate(v) for k, v in found.items()}


class Trees:
    """All trees as flat arrays; tree t has the nodes from first[t] on, `left` counts from there."""

    NAMES = {"feature": np.int16, "bin": np.uint8, "left": np.int32, "value": np.float32}

    def __init__(self, trees: list[dict[str, np.ndarray]]):
        sizes = [len(t["feature"]) for t in trees]
        self.first = np.cumsum([0, *sizes])[:-1]
        self.parts = {k: np.concatenate([t[k] for t in trees]).astype(kind) for k, kind in self.NAMES.items()}

    def score(self, bins: np.ndarray) -> np.ndarray:
        """Mean over the trees of the positive share of each row's leaf."""
        feature, cut, left, value = (self.parts[k] for k in self.NAMES)
        out = np.zeros(len(bins))
        for first in self.first:
            node = np.full(len(bins), first, np.int64)
            rows = np.arange(len(bins))
            while len(rows):
                tested = feature[node[rows]]
                rows, tested = rows[tested >= 0], tested[tested >= 0]
                at = node[rows]
                node[rows] = first + left[at] + (bins[rows, tested] > cut[at])
            out += value[node]
        return out / len(self.first)


class _Scored:
    """Scores of rows of bins; those that a task has met before are not walked again, up to `SCORED` of them."""

    def __init__(self, trees: Trees):
        self.trees = trees
        self.keys = self.scores = None

    def of(self, bins: np.ndarray) -> np.ndarray:
        cells, cell = _alike(bins)
        keys = _keys(cells)
        if self.keys is None or not 0 < len(self.keys) <= SCORED or keys.dtype != np.uint64:
            self.keys, self.scores = keys, self.trees.score(cells)
            return self.scores[cell]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        new = self.keys[at] != keys
        out = self.scores[at]
        out[new] = self.trees.score(cells[new])
        self.keys, order = np.unique(np.concatenate([self.keys, keys[new]]), return_index=True)
        self.scores = np.concatenate([self.scores, out[new]])[order]
        return out[cell]


def binned(values: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Bin of each value; the first also has the missing ones."""
    out = np.empty(values.shape, np.uint8)
    for i, cuts in enumerate(edges):
        out[:, i] = np.where(np.isnan(values[:, i]), 0, np.searchsorted(np.asarray(cuts), values[:, i], "left"))
    return out


def _with_bins(columns: list[str], edges: list[list[float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.column_stack([batch[c].to_numpy(zero_copy_only=False) for c in columns])
            yield pa.RecordBatch.from_arrays([batch["row"], _packed_rows(binned(values, edges)), batch["y"], batch["w"]], ["row", "bins", "y", "w"])

    return run


def _packed_rows(bins: np.ndarray) -> pa.Array:
    offsets = np.arange(len(bins) + 1, dtype=np.int32) * bins.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(bins))])


def _buffers(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bins, y, w) of many rows at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= BUFFER_ROWS:
            yield _arrays(held, features)
            held = []
    if sum(map(len, held)):
        yield _arrays(held, features)


def _arrays(held: list[pa.RecordBatch], features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(held).combine_chunks()
    row, y, w = (table[c].to_numpy() for c in ("row", "y", "w"))
    return row, np.frombuffer(b"".join(table["bins"].to_pylist()), np.uint8).reshape(-1, features), y, w


Splits = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # of a tree: node, feature, bin, by node


def _walk(bins: np.ndarray, splits: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> np.ndarray:
    """The node of the upper levels that each row comes to; a node's children are 2 n and 2 n + 1, the root is 1."""
    node = np.ones(len(bins), np.int64)
    if splits is None:
        return node
    nodes, feature, cut = splits
    rows = np.arange(len(bins))
    while len(rows):
        at = np.minimum(np.searchsorted(nodes, node[rows]), len(nodes) - 1)
        inner = nodes[at] == node[rows]
        rows, at = rows[inner], at[inner]
        node[rows] = 2 * node[rows] + (bins[rows, feature[at]] > cut[at])
    return node


class _Kinds:
    """Rows sorted by cell, label and weight, so that a tree's draws are added up before they are weighed."""

    def __init__(self, row: np.ndarray, cell: np.ndarray, cells: int, y: np.ndarray, w: np.ndarray):
        order = np.lexsort((w, y, cell))
        cell, y, w = cell[order], y[order], w[order]
        self.first = np.flatnonzero(np.append(True, (np.diff(cell) != 0) | (y[1:] != y[:-1]) | (w[1:] != w[:-1])))
        self.row, self.cells = row[order], cells
        self.cell, self.y, self.w = cell[self.first], y[self.first], w[self.first]

    def seen(self, tree: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(times, weight, positive weight) of each cell in a tree."""
        times = np.add.reduceat(_times(self.row, tree, seed), self.first, dtype=np.int64)
        weight = self.w * times
        return tuple(np.bincount(self.cell, x, self.cells) for x in (times, weight, weight * self.y))


def _histograms(splits: Splits, open_: dict[int, np.ndarray], features: int, tried: int, seed: int):
    """(tree, node, sums) of a task's rows at the open nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = {t: np.array([_choice(t, int(n), seed, features, tried) for n in nodes]) for t, nodes in open_.items()}
        sums: dict[int, np.ndarray] = {}
        for row, rows, y, w in _buffers(batches, features):
            bins, cell = _alike(rows)
            kinds = _Kinds(row, cell, len(bins), y, w)
            for tree, nodes in open_.items():
                times, weight, positive = kinds.seen(tree, seed)
                node = _walk(bins, splits.get(tree))
                at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
                here = np.flatnonzero((nodes[at] == node) & (times > 0))
                more = _sums(bins[here], tries[tree], at[here], times[here], weight[here], positive[here])
                sums[tree] = sums[tree] + more if tree in sums else more
        for tree, found in sums.items():
            columns = [pa.array(np.full(len(found), tree), pa.int32()), pa.array(open_[tree], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "node", "sums"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[dict]]]:
    """(tree, node, rows) from rows sorted by tree and node."""
    key, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if key != (r["tree"], r["node"]):
                if held:
                    yield *key, held
                key, held = (r["tree"], r["node"]), []
            held.append(r)
    if held:
        yield *key, held


_SPLITS = "tree int, node long, feature int, bin int, gain double, n_left long, n_right long, value double"


def _chosen(features: int, tried: int, least: int, seed: int):
    """The best split of each node, from its histograms; feature -1 if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for tree, node, rows in _groups(batches):
            hist = sum(np.frombuffer(r["sums"]).reshape(1, tried, BINS, 3) for r in rows)
            (j,), (cut,), (gain,) = best_splits(hist, least)
            n, w, p = hist[0, 0].sum(axis=0)
            left = int(hist[0, j, : cut + 1, 0].sum())
            feature = int(_choice(tree, node, seed, features, tried)[j]) if gain > 1e-12 else -1
            out.append((tree, node, feature, int(cut), float(gain), left, int(n) - left, p / w if w else 0.0))
        if out:
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in _SPLITS.split(", ")])

    return run


_SUMS = ("times", "weight", "positive")
_MOVED = "tree int, node long, bins binary, times binary, weight binary, positive binary"


def _moved(splits: Splits, leaves: dict[int, np.ndarray], trees: range, features: int, seed: int):
    """Packed sums over equal rows of each (tree, node) below the upper levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, rows, y, w in _buffers(batches, features):
            y, w = (x.astype(np.float32).astype(np.float64) for x in (y, w))
            bins, cell = _alike(rows)
            rows_of = _Kinds(row, cell, len(bins), y, w)
            for tree in trees:
                times, weight, positive = rows_of.seen(tree, seed)
                node = _walk(bins, splits.get(tree))
                here = np.flatnonzero((times > 0) & ~np.isin(node, leaves.get(tree, np.zeros(0, np.int64))))
                here = here[np.argsort(node[here], kind="stable")]
                ends = np.append(np.flatnonzero(np.diff(node[here])) + 1, len(here)) if len(here) else []
                out, begin = [], 0
                for end in ends:
                    own = here[begin:end]
                    out.append((tree, int(node[own[0]]), bins[own].tobytes(), *(x[own].tobytes() for x in (times, weight, positive))))
                    begin = end
                if out:
                    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["tree", "node", "bins", *_SUMS])

    return run


def _grown(features: int, tried: int, depth: int, least: int, least_split: int, seed: int):
    """The finished subtree of each (tree, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, node, rows in _groups(batches):
            bins, cell = _alike(np.concatenate([np.frombuffer(r["bins"], np.uint8) for r in rows]).reshape(-1, features))
            sums = [np.bincount(cell, np.concatenate([np.frombuffer(r[k]) for r in rows]), len(bins)) for k in _SUMS]
            made = grow_cells(
                bins, *sums, depth - node.bit_length() + 1, least, least_split, tried, np.random.default_rng((seed, tree, node)),
            )
            columns = [pa.array([tree], pa.int32()), pa.array([node], pa.int64()), *(pa.array([made[k].tobytes()], pa.binary()) for k in ("feature", "bin", "left", "value", "gain"))]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "node", "feature", "bin", "left", "value", "gain"])

    return run


def _whole_tree(upper: dict[int, tuple], below: dict[int, dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """One tree of its upper nodes {node: (feature, bin, value, gain)} and the subtrees under them."""
    kinds = {"feature": np.int16, "bin": np.uint8, "left": np.int32, "value": np.float32, "gain": np.float32}
    out: dict[str, list] = {k: [0] for k in kinds}
    parts: list[dict[str, np.ndarray]] = []
    todo, known = [(1, 0)], 1  # (node, place)
    places: list[tuple[int, int]] = []
    for node, place in todo:
        if node not in upper:
            places.append((node, place))
            continue
        feature, cut, value, gain = upper[node]
        for k, v in (("feature", feature), ("bin", cut), ("left", known if feature >= 0 else 0), ("value", value), ("gain", gain)):
            out[k][place] = v
        if feature >= 0:
            todo += [(2 * node, known), (2 * node + 1, known + 1)]
            known += 2
            for v in out.values():
                v += [0, 0]
    for node, place in places:
        sub = {k: v.copy() for k, v in below[node].items()}
        sub["left"] = np.where(sub["feature"] >= 0, sub["left"] + known - 1, 0)  # node i of it comes to known - 1 + i, its root to `place`
        for k in out:
            out[k][place] = sub[k][0]
        parts.append({k: v[1:] for k, v in sub.items()})
        known += len(sub["feature"]) - 1
    return {k: np.concatenate([np.array(out[k]), *[p[k] for p in parts]]).astype(kind) for k, kind in kinds.items()}


def _grow_upper(rows: DataFrame, cells: int, features: int, tried: int, s: dict) -> tuple[Splits, dict[int, dict[int, tuple]]]:
    """Splits of all nodes of more than `small` rows, and the upper nodes of each tree, leaves included; none if there are no more than `small` distinct rows."""
    upper: dict[int, dict[int, tuple]] = {t: {} for t in range(s["trees"])}
    open_ = [(t, 1) for t in range(s["trees"])] if cells > s["small"] else []
    splits: Splits = {}
    while open_:
        more = []
        for at in range(0, len(open_), HISTOGRAMS):
            asked: dict[int, list[int]] = {}
            for tree, node in open_[at : at + HISTOGRAMS]:
                asked.setdefault(tree, []).append(node)
            sums = rows.mapInArrow(_histograms(splits, {t: np.sort(v) for t, v in asked.items()}, features, tried, s["seed"]), "tree int, node long, sums binary")
            dealt = sums.repartition("tree", "node").sortWithinPartitions("tree", "node")
            for r in dealt.mapInArrow(_chosen(features, tried, s["least"], s["seed"]), _SPLITS).collect():  # one row per large node
                upper[r.tree][r.node] = (r.feature, r.bin, r.value, r.gain)
                if r.feature >= 0 and r.node.bit_length() < s["depth"]:
                    more += [(r.tree, 2 * r.node + side) for side, size in enumerate((r.n_left, r.n_right)) if size > s["small"]]
        for tree, nodes in upper.items():
            inner = sorted((k, v[0], v[1]) for k, v in nodes.items() if v[0] >= 0)
            if inner:
                splits[tree] = tuple(np.array(c, np.int64) for c in zip(*inner, strict=True))
        open_ = more
    return splits, upper


def _count(name: str, about: str) -> Param:
    return Param(Params._dummy(), name, about, TypeConverters.toInt)


class _Settings(Params):
    columns = Param(Params._dummy(), "columns", "feature columns", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "0 or 1", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "row weights; empty for none", TypeConverters.toString)
    numTrees = _count("numTrees", "trees")
    maxDepth = _count("maxDepth", "levels below the root")
    minInstancesPerNode = _count("minInstancesPerNode", "least rows of a child")
    minInstancesSplit = _count("minInstancesSplit", "least rows of a node that is split")
    smallRows = _count("smallRows", "rows, or distinct rows of the table, of a subtree that one task finishes")
    seed = _count("seed", "of the rows and features that trees see")


class Forest(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Trees of at most `maxDepth` levels, each node trying the square root of the features; rows without a label are left out."""

    @keyword_only
    def __init__(self, *, columns=(), labelCol="label", weightCol="", numTrees=300, maxDepth=20, minInstancesPerNode=2, minInstancesSplit=5, smallRows=SMALL_ROWS, seed=42):
        super().__init__()
        self._setDefault(weightCol="", numTrees=300, maxDepth=20, minInstancesPerNode=2, minInstancesSplit=5, smallRows=SMALL_ROWS, seed=42)
        self._set(**{k: list(v) if k == "columns" else v for k, v in self._input_kwargs.items()})

    def _fit(self, dataset: DataFrame) -> ForestModel:
        return self._grow(dataset, *self._rows(dataset))

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence[dict[Param, object]]) -> Iterator[tuple[int, ForestModel]]:
        """As one fit for each map, but the ranges of the rows are worked out once, unless a map changes what they rest on."""
        if any({self.columns, self.labelCol, self.weightCol, self.smallRows} & set(m) for m in paramMaps):
            return super().fitMultiple(dataset, paramMaps)
        rows = self._rows(dataset)
        return _FitMultipleIterator(lambda i: self.copy(paramMaps[i])._grow(dataset, *rows), len(paramMaps))

    def _rows(self, dataset: DataFrame) -> tuple[DataFrame, list[list[float]], int, int]:
        """Rows as ranges, with the cuts between these, the number of rows and of distinct rows of ranges."""
        names, small = self.getOrDefault(self.columns), self.getOrDefault(self.smallRows)
        weight = F.col(self.getOrDefault(self.weightCol)).cast("double") if self.getOrDefault(self.weightCol) else F.lit(1.0)
        values = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]
        known = dataset.select(*values, F.col(self.getOrDefault(self.labelCol)).cast("double").alias("y"), weight.alias("w")).where("y IS NOT NULL")
        numbered = settle(known.withColumn("row", F.monotonically_increasing_id()))
        cores, sizes = dataset.sparkSession.sparkContext.defaultParallelism, part_sizes(numbered)
        n = cells = sum(sizes)  # cells: distinct rows of bins, which are all that a task holds of a node
        if n >= DEALT_ROWS and uneven(sizes, cores):
            numbered = settle(numbered.repartition(cores, "row"))
        plain = [f"c{i}" for i in range(len(names))]
        cuts = numbered.approxQuantile(plain, [i / BINS for i in range(1, BINS)], 0.25 / BINS)
        edges = [sorted({float(x) for x in c}) for c in cuts]
        rows = settle(numbered.mapInArrow(_with_bins(plain, edges), "row long, bins binary, y double, w double"))
        if n > small:
            rows = settle(rows.repartitionByRange("bins", "row"))  # equal rows meet in a task, a hot one in several
            cells = rows.select("bins").distinct().count()
        return rows, edges, n, cells

    def _grow(self, dataset: DataFrame, rows: DataFrame, edges: list[list[float]], n: int, cells: int) -> ForestModel:
        s = {"trees": self.numTrees, "depth": self.maxDepth, "least": self.minInstancesPerNode, "split": self.minInstancesSplit, "small": self.smallRows, "seed": self.seed}
        s = {k: self.getOrDefault(v) for k, v in s.items()}
        features = len(edges)
        tried = int(np.ceil(np.sqrt(features)))
        splits, upper = _grow_upper(rows, cells, features, tried, s)
        leaves = {t: np.array([k for k, v in nodes.items() if v[0] < 0], np.int64) for t, nodes in upper.items()}
        parts = rows.mapInArrow(_moved(splits, leaves, range(s["trees"]), features, s["seed"]), _MOVED)
        dealt_to = self._parts(dataset, s, n if upper[0] else 0)
        dealt = parts.repartition(dealt_to, "tree", "node").sortWithinPartitions("tree", "node")
        grown = dealt.mapInArrow(_grown(features, tried, s["depth"], s["least"], s["split"], s["seed"]), "tree int, node long, feature binary, bin binary, left binary, value binary, gain binary")
        below: dict[int, dict[int, dict]] = {t: {} for t in range(s["trees"])}
        kinds = {**Trees.NAMES, "gain": np.float32}
        for r in settle(grown).coalesce(max(1, dealt_to // 16)).toLocalIterator(prefetchPartitions=True):  # one job per partition
            below[r["tree"]][r["node"]] = {k: np.frombuffer(r[k], kind) for k, kind in kinds.items()}
        empty = {"feature": np.array([-1], np.int16), "bin": np.zeros(1, np.uint8), "left": np.zeros(1, np.int32), "value": np.zeros(1, np.float32), "gain": np.zeros(1, np.float32)}
        trees = [_whole_tree(upper[t], below[t] if below[t] or upper[t] else {1: empty}) for t in range(s["trees"])]
        model = ForestModel()
        model.trees, model.edges = Trees(trees), edges
        gains = np.array([np.bincount(t["feature"][t["feature"] >= 0], t["gain"][t["feature"] >= 0], features) for t in trees])
        shares = gains / np.maximum(gains.sum(axis=1, keepdims=True), 1e-300)
        model.featureImportances = shares.mean(axis=0) / max(shares.mean(axis=0).sum(), 1e-300)
        return self._copyValues(model)

    @staticmethod
    def _parts(dataset: DataFrame, s: dict, n: int) -> int:
        """A task gets a few trees, or a few large subtrees."""
        spark = dataset.sparkSession
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), min(s["trees"] * (n // s["small"] + 1), 100_000) // 8)


class ForestModel(Model, _Settings, MLWritable, MLReadable):
    """Adds `rawPrediction`, `probability` and `prediction`.  As with other Spark ML models, the trees are on the driver and broadcast."""

    trees: Trees
    edges: list[list[float]]
    featureImportances: np.ndarray

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast((self.trees, self.edges))

        @F.pandas_udf("double")
        def positive(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            trees, edges = shared.value
            scored = _Scored(trees)
            for columns in batches:
                columns = columns if isinstance(columns, tuple) else (columns,)  # of one column Spark gives the series itself
                yield pd.Series(scored.of(binned(np.column_stack([c.to_numpy(np.float64) for c in columns]), edges)))

        p = positive(*[F.col(c).cast("double") for c in self.getOrDefault(self.columns)])
        scored = dataset.withColumn("_p", p).withColumn("probability", array_to_vector(F.array(1.0 - F.col("_p"), F.col("_p"))))
        return scored.withColumn("rawPrediction", F.col("probability")).withColumn("prediction", (F.col("_p") > 0.5).cast("double")).drop("_p")

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader(cls)


class _ForestWriter(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"edges": self.model.edges, "importances": self.model.featureImportances.tolist()})
        trees = self.model.trees
        ends = [*trees.first[1:], len(trees.parts["feature"])]
        rows = [(i, *(bytearray(trees.parts[k][a:b].tobytes()) for k in Trees.NAMES)) for i, (a, b) in enumerate(zip(trees.first, ends, strict=True))]
        self.sparkSession.createDataFrame(rows, "tree int, feature binary, bin binary, left binary, value binary").write.parquet(f"{path}/trees")


class _ForestReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        DefaultParamsReader.getAndSetParams(model, metadata)
        model._resetUid(metadata["uid"])
        rows = sorted(self.sparkSession.read.parquet(f"{path}/trees").collect(), key=lambda r: r["tree"])
        model.trees = Trees([{k: np.frombuffer(r[k], kind) for k, kind in Trees.NAMES.items()} for r in rows])
        model.edges, model.featureImportances = metadata["edges"], np.array(metadata["importances"])
        return model
