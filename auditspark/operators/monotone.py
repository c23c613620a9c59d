"""Boosted trees whose score never falls as a constrained feature rises, and what follows from them.

Histograms of gradients are grouped sums in Spark; splits are chosen on the driver from
``nodes * features * bins`` sums, a number set by parameters and not by the data. A
split on a constrained feature whose children are out of order is not taken, and its
children are kept on their sides of the middle, so the ordering is exact on raw values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.config import CONFIG


@dataclass
class Tree:
    """Inner nodes: feature, threshold, children; leaves: feature -1 and a value. Nulls go left."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for column, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, value), (self.cover, cover)):
            column.append(v)
        return len(self.feature) - 1

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, threshold, left, right = map(np.array, (self.feature, self.threshold, self.left, self.right))
        while (inner := feature[at] >= 0).any():
            i = np.flatnonzero(inner)
            v = x[i, feature[at[i]]]
            at[i] = np.where(v > threshold[at[i]], right[at[i]], left[at[i]])
        return at


@dataclass
class MonotoneModel:
    features: list[str]
    base: float
    trees: list[Tree]
    rate: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += self.rate * np.array(t.value)[t.leaf(x)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``score``; the trees travel with a vectorised function."""

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            return pd.Series(self.score(np.column_stack([c.to_numpy(float) for c in columns])))

        return df.withColumn("score", score(*(F.col(c).cast("double") for c in self.features)))

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Each feature's Shapley value in every row's raw score, given the trees' covers.

        A set of known features sends a row down its own side at their splits and down both
        sides, by cover, at the others. A leaf is reached by the product over its path's
        features of "on the path" (0 or 1) where known and of the share of the cover where not,
        so its value is shared out over the subsets of those few features.
        """
        out = np.zeros((len(x), len(self.features)))
        for t in self.trees:
            for value, path in _paths(t):
                inside = {f: np.all([(x[:, f] > at) == right for at, right, _ in steps], axis=0).astype(float) for f, steps in path.items()}
                share = {f: float(np.prod([s for *_, s in steps])) for f, steps in path.items()}
                for f in path:
                    others = [g for g in path if g != f]
                    reach = np.zeros(len(x))
                    for size in range(len(others) + 1):
                        weight = 1 / (len(path) * comb(len(others), size))
                        for known in combinations(others, size):
                            part = np.full(len(x), weight * float(np.prod([share[g] for g in others if g not in known])))
                            for g in known:
                                part *= inside[g]
                            reach += part
                    out[:, f] += self.rate * value * (inside[f] - share[f]) * reach
        return out


def _paths(t: Tree) -> Iterator[tuple[float, dict[int, list[tuple[float, bool, float]]]]]:
    """Every leaf's value, and by feature the (threshold, to the right?, share of the cover) of the splits on its path."""
    waiting: list[tuple[int, list[tuple[int, float, bool, float]]]] = [(0, [])]
    while waiting:
        n, steps = waiting.pop()
        if t.feature[n] < 0:
            path: dict[int, list[tuple[float, bool, float]]] = {}
            for f, *rest in steps:
                path.setdefault(f, []).append(tuple(rest))
            yield t.value[n], path
            continue
        for child, right in ((t.left[n], False), (t.right[n], True)):
            whole = t.cover[t.left[n]] + t.cover[t.right[n]]
            waiting.append((child, [*steps, (t.feature[n], t.threshold[n], right, t.cover[child] / max(whole, 1e-12))]))


def fit(df: DataFrame, features: Sequence[str], rising: Sequence[str] = (), rounds: int = 20, depth: int = 3, bins: int = 32, rate: float = 0.3, l2: float = 3.0, least: float = 20.0, miss_cost: float = CONFIG.miss_cost) -> MonotoneModel:
    """A boosted ensemble on (features, y); positives weigh ``miss_cost``."""
    features = list(features)
    cuts = df.select(*(F.percentile_approx(F.col(c).cast("double"), [i / bins for i in range(1, bins)], 10_000).alias(c) for c in features)).first()
    edges = [sorted(set(cuts[c] or [])) for c in features]
    rows = df.select(F.col("y").cast("double").alias("y"), F.when(F.col("y") == 1, float(miss_cost)).otherwise(1.0).alias("w"), *(F.col(c).cast("double").alias(c) for c in features)).persist()
    total = rows.agg(F.sum("w"), F.sum(F.col("w") * F.col("y"))).first()
    p = min(max((total[1] or 0.0) / max(total[0] or 1.0, 1e-9), 1e-6), 1 - 1e-6)
    model = MonotoneModel(features, float(np.log(p / (1 - p))), [], rate)
    up = {features.index(c) for c in rising if c in features}
    try:
        for _ in range(rounds):
            tree = Tree()
            tree.add(0.0, 0.0)
            bound, open_ = {0: (-np.inf, np.inf)}, [0]
            for level in range(depth + 1):
                open_ = _split(tree, _histogram(rows, model, tree, open_, edges), open_, bound, edges, up, l2, least, level < depth)
                if not open_:
                    break
            model.trees.append(tree)
    finally:
        rows.unpersist()
    return model


def _histogram(rows: DataFrame, model: MonotoneModel, tree: Tree, nodes: list[int], edges: list[list[float]]) -> pd.DataFrame:
    """(node, f, b, g, h): sums of gradients by node, feature and bin; every task sends its own sums only.

    Bin k of a feature holds the values above k of its edges; nulls are in bin 0.
    """
    width = max(map(len, edges), default=0) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, len(nodes) * len(edges) * width))
        number = {n: i for i, n in enumerate(nodes)}
        for b in batches:
            x, y, w = b[model.features].to_numpy(float), b["y"].to_numpy(), b["w"].to_numpy()
            p = model.score(x)
            g, h = w * (p - y), w * p * (1 - p)
            own = np.array([number.get(n, -1) for n in tree.leaf(x)])
            keep = own >= 0
            for f, e in enumerate(edges):
                v = x[keep, f]
                bin_ = np.where(np.isnan(v), 0, np.searchsorted(e, v, "left"))
                at = (own[keep] * len(edges) + f) * width + bin_
                for k, z in enumerate((g, h)):
                    sums[k] += np.bincount(at, weights=z[keep], minlength=sums.shape[1])
        met = np.flatnonzero(sums.any(0))
        yield pd.DataFrame({"node": np.array(nodes)[met // (len(edges) * width)], "f": met // width % len(edges), "b": met % width, "g": sums[0, met], "h": sums[1, met]})

    cells = rows.mapInPandas(run, "node long, f long, b long, g double, h double")
    return cells.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()


def _split(tree: Tree, cells: pd.DataFrame, nodes: list[int], bound: dict, edges: list[list[float]], up: set[int], l2: float, least: float, deeper: bool) -> list[int]:
    """Sets the values of ``nodes`` and splits those that gain by it; returns the children."""
    out: list[int] = []
    for node in nodes:
        own = cells[cells["node"] == node]
        if own.empty:
            continue
        one = own[own["f"] == own["f"].iloc[0]]
        g, h = float(one["g"].sum()), float(one["h"].sum())
        low, high = bound[node]
        tree.value[node], tree.cover[node] = float(np.clip(-g / (h + l2), low, high)), h
        if not deeper:
            continue
        best = (1e-6, None)
        for f, part in own.groupby("f"):
            part = part.sort_values("b")
            gl, hl = part["g"].cumsum().to_numpy()[:-1], part["h"].cumsum().to_numpy()[:-1]
            gr, hr = g - gl, h - hl
            vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            gain = -(gl * vl + 0.5 * (hl + l2) * vl**2) - (gr * vr + 0.5 * (hr + l2) * vr**2) + (g * tree.value[node] + 0.5 * (h + l2) * tree.value[node] ** 2)
            bad = (hl < least) | (hr < least)
            if f in up:
                bad |= vl > vr
            gain = np.where(bad, -np.inf, gain)
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                # The bins to the right start above the edge before the next bin met.
                best = (float(gain[k]), (int(f), edges[int(f)][int(part["b"].to_numpy()[k + 1]) - 1], vl[k], vr[k], hl[k], hr[k]))
        if best[1] is None:
            continue
        f, threshold, vl, vr, hl, hr = best[1]
        middle = (vl + vr) / 2
        tree.feature[node], tree.threshold[node] = f, threshold
        tree.left[node], tree.right[node] = tree.add(vl, hl), tree.add(vr, hr)
        bound[tree.left[node]] = (low, min(high, middle)) if f in up else (low, high)
        bound[tree.right[node]] = (max(low, middle), high) if f in up else (low, high)
        out += [tree.left[node], tree.right[node]]
    return out


def violations(model: MonotoneModel, df: DataFrame, rising: Sequence[str], steps: int = 12, tolerance: float = 1e-3) -> pd.DataFrame:
    """(feature, worst_drop, violated): sweeps of each constrained feature over its range, at every row."""
    rising = list(rising)
    if not rising:
        return pd.DataFrame(columns=["feature", "worst_drop", "violated"])
    limits = df.agg(*(f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in rising for n, f in (("lo", F.min), ("hi", F.max)))).first()
    ranges = {c: (limits[f"lo_{c}"], limits[f"hi_{c}"]) for c in rising if limits[f"lo_{c}"] is not None}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worst = dict.fromkeys(ranges, 0.0)
        for b in batches:
            x = b.to_numpy(float)
            for c, (low, high) in ranges.items():
                i, last = model.features.index(c), None
                for v in np.linspace(low, high, steps):
                    swept = x.copy()
                    swept[:, i] = v
                    now = model.score(swept)
                    worst[c] = max(worst[c], float((last - now).max())) if last is not None and len(x) else worst[c]
                    last = now
        yield pd.DataFrame({"feature": list(worst), "worst_drop": list(worst.values())})

    chosen = df.select(*(F.col(c).cast("double").alias(c) for c in model.features))
    found = chosen.mapInPandas(run, "feature string, worst_drop double").groupBy("feature").agg(F.max("worst_drop").alias("worst_drop")).toPandas()
    found = found.sort_values("feature").reset_index(drop=True)
    return found.assign(violated=found["worst_drop"] > tolerance)


def reason_codes(model: MonotoneModel, alerts: DataFrame, rising: Sequence[str], threshold: float, id_col: str = "row_id") -> DataFrame:
    """(id, feature, value, clearing, relative_change): the constrained feature whose smallest relative lowering clears the alert.

    Scores change only at split thresholds, so the clearing value is the highest
    threshold below the value at which the score is under ``threshold``: exact, no search.
    """
    cuts = {c: sorted({t.threshold[n] for t in model.trees for n in range(len(t.feature)) if t.feature[n] == model.features.index(c)}) for c in rising}
    sent = alerts.sparkSession.sparkContext.broadcast((model, cuts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, cuts = sent.value
        for b in batches:
            x, out = b[m.features].to_numpy(float), []
            for r in range(len(b)):
                best = (np.inf, None, np.nan, np.nan)
                for c, levels in cuts.items():
                    i = m.features.index(c)
                    value = x[r, i]
                    below = [v for v in levels if v < value]
                    if not below:
                        continue
                    tried = np.repeat(x[r : r + 1], len(below), 0)
                    tried[:, i] = below
                    clear = np.flatnonzero(m.score(tried) < threshold)
                    if len(clear):
                        v = below[clear[-1]]
                        change = abs(value - v) / max(abs(value), 1e-9)
                        if change < best[0]:
                            best = (change, c, value, v)
                out.append((b[id_col].iloc[r], best[1], best[2], best[3], best[0] if best[1] else np.nan))
            yield pd.DataFrame(out, columns=["row_id", "feature", "value", "clearing", "relative_change"])

    chosen = alerts.select(id_col, *(F.col(c).cast("double").alias(c) for c in model.features))
    return chosen.mapInPandas(run, "row_id long, feature string, value double, clearing double, relative_change double")


def mass(model: MonotoneModel, df: DataFrame) -> pd.DataFrame:
    """(feature, share) of the mean absolute contributions over all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(model.features))
        for b in batches:
            if len(b):
                total += np.abs(model.contributions(b.to_numpy(float))).sum(0)
        yield pd.DataFrame({"feature": model.features, "total": total})

    chosen = df.select(*(F.col(c).cast("double").alias(c) for c in model.features))
    found = dict(chosen.mapInPandas(run, "feature string, total double").groupBy("feature").agg(F.sum("total")).collect())
    m = np.array([found.get(c) or 0.0 for c in model.features])
    return pd.DataFrame({"feature": model.features, "share": m / max(m.sum(), 1e-12)})
