"""Array kernels of the trees: descent to leaves, cell counts of a level, split tests.

Trees travel to the tasks as flat arrays inside the function, not as a column, so a row does not carry
its model's trees and costs a few array steps a level. Rows come in Arrow batches.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import arrow_udf

from ..functions.hashing import GRAIN, INCREMENT, MODULUS, MULTIPLIER, STRIDE, poisson_cuts
from .split_stats import BINS, OWN

# Kernels travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that a task counts at a time; cells of a block of leaves that it judges at a time.
BUNDLE, BLOCK = 1 << 18, 1 << 19
CELLS = "leaf int, pos int, bin int, label string, n double, sy double, syy double, sg double, rows double"
VERDICTS = "leaf int, seen double, pos int, bin int, split boolean, left double, right double"


def matrix(x: pa.Array, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as a matrix of at least ``width`` columns, and where they have no value."""
    lengths = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    held = x.flatten()
    values, null = held.to_numpy(zero_copy_only=False).astype(float), held.is_null().to_numpy(zero_copy_only=False)
    own = int(lengths.max(initial=0))
    if own >= width and (lengths == own).all():
        return values.reshape(len(lengths), own), null.reshape(len(lengths), own)
    made, missing = np.full((len(lengths), max(width, own)), np.nan), np.ones((len(lengths), max(width, own)), bool)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    made[row, at], missing[row, at] = values, null
    return made, missing


def draw(number: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """The draw of :func:`voxmill.functions.hashing.lcg_sql`."""
    first = np.mod(np.mod(number.astype(np.int64), MODULUS) * MULTIPLIER + INCREMENT + np.asarray(seed, np.int64) * STRIDE, MODULUS)
    return np.mod(np.mod(first * MULTIPLIER + INCREMENT, MODULUS) // 64, GRAIN)


def poisson_weights(seq: Column, tree_id: Column, rate: float = 6.0) -> Column:
    """:func:`voxmill.functions.hashing.poisson_weight` by arrays."""
    steps = np.array(poisson_cuts(rate))

    @arrow_udf("int")
    def weight(seq: pa.Array, tree: pa.Array) -> pa.Array:
        u = (draw(seq.to_numpy(zero_copy_only=False), tree.to_numpy(zero_copy_only=False)) + 0.5) / float(GRAIN)
        return pa.array(np.searchsorted(steps, u, side="left").astype(np.int32))

    return weight(seq, tree_id)


class Flat:
    """Compiled trees as flat arrays: node ``root[t] + i`` is node i of tree t; ``child`` is -1 or the left child's place."""

    def __init__(self, trees: Sequence):
        sizes = [len(t["feature"]) for t in trees]
        self.root = np.cumsum([0, *sizes])[:-1].astype(np.int64)
        self.size = int(sum(sizes))
        every = lambda name: [v for t in trees for v in t[name]]
        number = lambda name: np.array([np.nan if v is None else v for v in every(name)], float)
        self.feature, self.threshold, self.mean = np.array(every("feature"), np.int64), number("threshold"), number("mean")
        child = np.array(every("child"), np.int64)
        self.child = np.where(child < 0, -1, child + np.repeat(self.root, sizes))
        votes = every("vote")
        self.labels = sorted({v for v in votes if v is not None})
        code = {v: i for i, v in enumerate(self.labels)}
        self.vote = np.array([-1 if v is None else code[v] for v in votes], np.int64)
        self.width = int(self.feature.max(initial=0)) + 1
        linear = every("linear")
        self.weights = None
        if any(w is not None for w in linear):
            self.weights = np.zeros((self.size, max(len(w) for w in linear if w is not None)))
            for i, w in enumerate(linear):
                if w is not None:
                    self.weights[i, : len(w)] = [0.0 if v is None else v for v in w]
        self.quality = np.array([t["quality"] for t in trees], float)

    def descend(self, tree: np.ndarray, x: np.ndarray, missing: np.ndarray, meet: np.ndarray | None = None) -> np.ndarray:
        """Leaf of each row; with ``meet`` (a node each) whether the row passes that node."""
        at = self.root[tree]
        met = None if meet is None else at == meet
        live = np.flatnonzero(self.child[at] >= 0)
        while len(live):
            node = at[live]
            f, t = self.feature[node], self.threshold[node]
            # As in SQL: a missing value goes left, NaN is the largest number.
            left = missing[live, f] | (x[live, f] <= t) | np.isnan(t)
            node = self.child[node] + ~left
            at[live] = node
            if met is not None:
                met[live] |= node == meet[live]
            live = live[self.child[node] >= 0]
        return at if met is None else met

    def values(self, at: np.ndarray, z: np.ndarray | None) -> np.ndarray:
        """Centred prediction at the leaves ``at``."""
        value = self.mean[at]
        if self.weights is not None and z is not None:
            slope = np.zeros(len(at))
            for f in range(min(z.shape[1], self.weights.shape[1])):
                step = z[:, f] * self.weights[at, f]
                slope += np.where(np.isnan(step), 0.0, step)
            value = value + slope
        return value

    def _votes(self, codes: np.ndarray) -> pa.Array:
        return pa.array(self.labels, pa.string()).take(pa.array(codes, mask=codes < 0))

    def land(self, tree: Column, x: Column, z: Column) -> Column:
        """Place, number, vote and centred value of the leaf in the numbered tree."""

        @arrow_udf("struct<at:int,node_id:int,vote:string,value:double>")
        def land(tree: pa.Array, x: pa.Array, z: pa.Array) -> pa.Array:
            tree = tree.to_numpy(zero_copy_only=False)
            at = self.descend(tree, *matrix(x, self.width))
            value = self.values(at, None if self.weights is None else matrix(z)[0])
            parts = [pa.array(at.astype(np.int32)), pa.array((at - self.root[tree]).astype(np.int32)), self._votes(self.vote[at]), pa.array(value, mask=np.isnan(value))]
            return pa.StructArray.from_arrays(parts, ["at", "node_id", "vote", "value"])

        return land(tree, x, z)

    def passes(self, tree: Column, node: Column, x: Column) -> Column:
        """Whether a row passes a node of the numbered tree."""

        @arrow_udf("boolean")
        def passes(tree: pa.Array, node: pa.Array, x: pa.Array) -> pa.Array:
            tree = tree.to_numpy(zero_copy_only=False)
            return pa.array(self.descend(tree, *matrix(x, self.width), self.root[tree] + node.to_numpy(zero_copy_only=False)))

        return passes(tree, node, x)

    def answer(self, forests: Sequence[Sequence[int]], model: Column, x: Column, z: Column) -> Column:
        """Weighted vote and mean centred value of the numbered forest (numbers of its trees, in order)."""

        @arrow_udf("struct<vote:string,value:double>")
        def answer(model: pa.Array, x: pa.Array, z: pa.Array) -> pa.Array:
            model = model.to_numpy(zero_copy_only=False)
            x, missing = matrix(x, self.width)
            z = None if self.weights is None else matrix(z)[0]
            votes, means = np.full(len(model), -1), np.full(len(model), np.nan)
            for m in np.unique(model):
                rows = np.flatnonzero(model == m)
                given, weight, total, count = [], [], np.zeros(len(rows)), np.zeros(len(rows))
                for t in forests[m]:
                    at = self.descend(np.full(len(rows), t), x[rows], missing[rows])
                    given.append(np.where(self.vote[at] >= 0, self.vote[at], -1))
                    weight.append(max(self.quality[t], 1e-6))
                    known = given[-1] >= 0
                    total += np.where(known, self.values(at, None if z is None else z[rows]), 0.0)
                    count += known
                best, top = np.full(len(rows), -1), np.full(len(rows), -np.inf)
                for mine in given:
                    score = np.zeros(len(rows))
                    for theirs, w in zip(given, weight):
                        score += np.where(theirs == mine, w, 0.0)
                    # Equal scores go to the first label.
                    wins = (mine >= 0) & ((score > top) | ((score == top) & (mine < best)))
                    best, top = np.where(wins, mine, best), np.where(wins, score, top)
                votes[rows] = best
                with np.errstate(invalid="ignore", divide="ignore"):
                    means[rows] = total / count
            return pa.StructArray.from_arrays([self._votes(votes), pa.array(means, mask=np.isnan(means))], ["vote", "value"])

        return answer(model, x, z)


def _bundles(batches: Iterable[pa.RecordBatch], rows: int = BUNDLE) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    held = table.column(name)
    return held.chunk(0) if held.num_chunks == 1 else pa.concat_arrays(held.chunks)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return _column(table, name).to_numpy(zero_copy_only=False)


def _labels(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    coded = _column(table, "label").fill_null("").dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def tally(rows: DataFrame, ids: np.ndarray, cuts: Sequence[Sequence[Sequence[float] | None]]) -> DataFrame:
    """Cells (``CELLS``) of the rows of the leaves ``ids`` (ascending) with their ``cuts``; a task adds up its own rows.

    ``rows`` has leaf, x, label, yc, w and, for the gradient of leaf models, z and g.
    """
    width = np.array([len(c) for c in cuts], np.int64)
    most = int(width.max(initial=1))
    # Beyond a feature's cuts there is nothing to pass.
    edges = np.full((len(ids), most, BINS - 1), np.nan)
    for i, leaf in enumerate(cuts):
        for f, c in enumerate(leaf):
            if c:
                edges[i, f, : len(c)] = c
    steps = [1 << k for k in reversed(range(BINS.bit_length() - 1))]
    graded = "g" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _bundles(batches):
            leaf = _numbers(part, "leaf")
            place = np.minimum(np.searchsorted(ids, leaf), len(ids) - 1)
            keep = (ids[place] == leaf) & (_numbers(part, "w") > 0)
            if not keep.all():
                part, place = part.filter(pa.array(keep)), place[keep]
            if not len(place):
                continue
            x, missing = matrix(_column(part, "x"), most)
            label, names = _labels(part)
            w, yc = _numbers(part, "w").astype(float), _numbers(part, "yc")
            z, g = (matrix(_column(part, "z"), most)[0], _numbers(part, "g")) if graded else (None, None)
            held, near = np.unique(place, return_inverse=True)
            group, groups = near * len(names) + label, len(held) * len(names)
            plain = not yc.any()
            found = []
            for f in range(-1, most):
                if f < 0:
                    key, size, mine, fw, fy, fg = group, 1, slice(None), w, yc, None
                else:
                    mine = width[place] > f if (width < most).any() else slice(None)
                    v, base = np.where(missing[mine, f], -np.inf, x[mine, f]), place[mine] * (BINS - 1) - 1
                    flat, odd = np.ascontiguousarray(edges[:, f]).ravel(), np.isnan(v).any()
                    at = np.zeros(len(v), np.int64)
                    for step in steps:
                        c = flat[base + at + step]
                        above = v > c
                        if odd:  # NaN is the largest number
                            above |= np.isnan(v) & ~np.isnan(c)
                        at += np.where(above, step, 0)
                    key, size, fw, fy = group[mine] * BINS + at, BINS, w[mine], yc[mine]
                    fg = np.nan_to_num(g[mine]) * z[mine, f] if graded else None
                if not len(key):
                    continue
                if groups * size > 4 * len(key) + BLOCK:
                    cell, key = np.unique(key, return_inverse=True)
                else:
                    cell = np.arange(groups * size)
                add = lambda v: np.bincount(key, v, len(cell))
                rows_ = np.bincount(key, minlength=len(cell)).astype(float)
                none = np.zeros(len(cell))
                sums = [add(fw), none if plain else add(fw * fy), none if plain else add(fw * fy * fy), none if fg is None else add(fw * fg), rows_]
                hit = np.flatnonzero(rows_)
                cell = cell[hit]
                one = cell // size
                found.append((ids[held[one // len(names)]], np.full(len(hit), f if f >= 0 else OWN), cell % size, one % len(names), *[s[hit] for s in sums]))
            columns = [np.concatenate(c) for c in zip(*found)]
            made = [pa.array(c.astype(np.int32)) for c in columns[:3]] + [names.take(pa.array(columns[3]))] + [pa.array(c) for c in columns[4:]]
            yield pa.RecordBatch.from_arrays(made, ["leaf", "pos", "bin", "label", "n", "sy", "syy", "sg", "rows"])

    return rows.select("leaf", "x", "label", "yc", "w", *(["z", "g"] if graded else [])).mapInArrow(run, CELLS)


def _deviation(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.nan_to_num(q / n - (s / n) * (s / n)), 0.0))


def _plogp(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n * np.log2(np.where(n > 0, n, 1.0)), 0.0)


def judge(cells: DataFrame, about: dict[str, np.ndarray]) -> DataFrame:
    """Verdicts (``VERDICTS``) on the leaves that are due: the test of :func:`split_stats.decide`, by arrays.

    ``cells`` has all cells of a leaf in one partition; ``about`` has, for the leaves ``ids`` (ascending), ``tree``,
    ``node``, ``last_n``, ``grace``, ``delta``, ``tau``, ``regression``, ``algorithm`` and ``m_features``. ``left`` and
    ``right`` are the chunk's rows on both sides of the split.
    """

    def block(one, seen, classes, bounds, pos, bin_, label, n, sy, syy, rows, labels):
        """Best splits of the leaves ``one`` (places in ``about``)."""
        size, features = len(one), int(pos.max(initial=-1)) + 1
        verdict = {"pos": np.full(size, -1), "bin": np.full(size, -1), "split": np.zeros(size, bool), "left": np.zeros(size), "right": np.zeros(size)}
        if not features:
            return verdict
        shape = (size, features, BINS, labels)
        key = ((bounds * features + pos) * BINS + bin_) * labels + label
        a = {name: np.bincount(key, v, int(np.prod(shape))).reshape(shape) for name, v in (("n", n), ("s", sy), ("q", syy))}
        per = {name: v.sum(axis=2, keepdims=True) for name, v in a.items()}
        left = {name: np.cumsum(v, axis=2)[:, :, :-1] for name, v in a.items()}
        ln, total = left["n"].sum(axis=3), per["n"].sum(axis=3)
        rn = total - ln
        open_ = (ln > 0) & (rn > 0)
        with np.errstate(all="ignore"):
            pl, pr, pt = (_plogp(v).sum(axis=3) for v in (left["n"], per["n"] - left["n"], per["n"]))
            gain = (np.log2(total) - pt / total) - (ln * (np.log2(ln) - pl / ln) + rn * (np.log2(rn) - pr / rn)) / total
            ls, lq, s, q = left["s"].sum(axis=3), left["q"].sum(axis=3), per["s"].sum(axis=3), per["q"].sum(axis=3)
            sdr = _deviation(total, s, q) - (ln * _deviation(ln, ls, lq) + rn * _deviation(rn, s - ls, q - lq)) / total
        regression = about["regression"][one]
        merit = np.where(regression[:, None, None], sdr, gain)
        merit = np.where(open_ & ~np.isnan(merit), merit, -np.inf)
        edge = merit.argmax(axis=2)
        best = np.take_along_axis(merit, edge[:, :, None], axis=2)[:, :, 0]
        usable = np.isfinite(best)
        width = np.zeros(size, np.int64)
        np.maximum.at(width, bounds, pos + 1)
        forest = np.isin(about["algorithm"][one], (4, 10))
        m = np.where(forest, np.where(about["m_features"][one] > 0, about["m_features"][one], np.floor(np.sqrt(width)).astype(int) + 1), 0)
        lot = draw(about["node"][one][:, None] * 101 + np.arange(features), about["tree"][one][:, None] + 1)
        order = np.argsort(np.where(usable, lot, GRAIN + 1), axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(features)[None, :], axis=1)
        best = np.where(usable & ((m[:, None] <= 0) | (rank < m[:, None])), best, -np.inf)
        first = np.argsort(-best, axis=1, kind="stable")
        sorted_ = np.take_along_axis(best, first, axis=1)
        g1 = np.where(np.isfinite(sorted_[:, 0]), sorted_[:, 0], 0.0)
        second = sorted_[:, 1] if features > 1 else np.full(size, -np.inf)
        g2 = np.maximum(np.where(np.isfinite(second), second, 0.0), 0.0)
        span = np.where(regression, 1.0, np.log2(np.maximum(classes, 2).astype(float)))
        with np.errstate(all="ignore"):
            eps = np.sqrt(span * span * np.log(1.0 / about["delta"][one]) / (2 * seen))
            clear = np.where(regression, (g1 != 0) & (g2 / g1 + eps < 1), g1 - g2 > eps)
        where = np.arange(size)
        verdict["split"] = (g1 > 1e-12) & (clear | (eps < about["tau"][one]))
        verdict["pos"], verdict["bin"] = first[:, 0], edge[where, first[:, 0]]
        seen_rows = np.bincount((bounds * features + pos) * BINS + bin_, rows, size * features * BINS).reshape(size, features, BINS)
        mine = np.cumsum(seen_rows[where, first[:, 0]], axis=1)
        verdict["left"] = mine[where, verdict["bin"]]
        verdict["right"] = mine[:, -1] - verdict["left"]
        return verdict

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _bundles(batches, 1 << 62):
            leaf, pos, bin_ = (_numbers(part, c).astype(np.int64) for c in ("leaf", "pos", "bin"))
            n, sy, syy, rows = (_numbers(part, c) for c in ("n", "sy", "syy", "rows"))
            label, names = _labels(part)
            held, place = np.unique(leaf, return_inverse=True)
            at = np.searchsorted(about["ids"], held)
            own = pos == OWN
            seen = np.bincount(place[own], n[own], len(held))
            classes = np.bincount(np.unique(place[own] * len(names) + label[own]) // len(names), minlength=len(held))
            due = (classes > 0) & (seen - about["last_n"][at] >= about["grace"][at]) & (about["regression"][at] | (classes >= 2))
            asked = np.flatnonzero(due)
            order = np.flatnonzero((pos >= 0) & due[place])
            order = order[np.argsort(place[order], kind="stable")]
            many = max(1, BLOCK // (max(1, int(pos.max(initial=0)) + 1) * BINS * len(names)))
            for lo in range(0, len(asked), many):
                one = asked[lo : lo + many]
                cells_ = order[np.searchsorted(place[order], one[0]) : np.searchsorted(place[order], one[-1], side="right")]
                near = np.searchsorted(one, place[cells_])
                v = block(at[one], seen[one], classes[one], near, *(c[cells_] for c in (pos, bin_, label, n, sy, syy, rows)), len(names))
                made = [held[one].astype(np.int32), seen[one], v["pos"].astype(np.int32), v["bin"].astype(np.int32), v["split"], v["left"], v["right"]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], ["leaf", "seen", "pos", "bin", "split", "left", "right"])

    return cells.select("leaf", "pos", "bin", "label", "n", "sy", "syy", "rows").mapInArrow(run, VERDICTS)
