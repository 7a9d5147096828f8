"""Threshold sweeps of probability maps against masks: every threshold of every mode in one pass over a map.

Thresholds turn a map into levels (how many of them a pixel reaches).  Regions of all thresholds come from one component
tree over the levels: runs of equal level are nodes, touching runs are edges, and edges are united from the highest level
down, with areas and boxes carried along; no threshold floods the map again.  Opening commutes with thresholds, so it is
done once on the levels.  The watershed floods once from the top and is read off whenever a threshold is reached.

A map is one row and one image; what leaves a task is three counts for each map, mode and threshold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import raster
from .metrics import pixel_metrics

MODES = ("raw", "region", "watershed")


@dataclass(frozen=True)
class RegionRule:
    """Regions: components that are large enough, cut at empty bands while they fill too little of their box."""

    least_area: int = 200
    connectivity: int = 4
    opening: int = 3
    split: bool = True
    fill: float = 0.45
    least_gap: int = 2


@dataclass(frozen=True)
class BasinRule:
    """Basins: sigma and least_area are shares of the diagonal and of the area, with lower bounds."""

    height: float = 0.15
    sigma_share: float = 0.003
    least_sigma: float = 0.5
    area_share: float = 1e-4
    least_area: int = 8
    shallow: float = 0.85

    def sigma(self, h: int, w: int) -> float:
        return max(self.least_sigma, self.sigma_share * float(np.hypot(h, w)))

    def area(self, h: int, w: int) -> int:
        return max(self.least_area, int(self.area_share * h * w))


def levels_of(prob: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """How many of the ascending thresholds each pixel reaches; NaN reaches none."""
    return np.searchsorted(thresholds, np.where(np.isnan(prob), -np.inf, prob), side="right").astype(np.int32)


def opened_levels(levels: np.ndarray, size: int) -> np.ndarray:
    """The opening of every threshold's set at once: least, then greatest level under a disc; beyond the border is neutral."""
    if size < 2:
        return levels
    r = size // 2
    spots = [(y, x) for y in range(-r, size - r) for x in range(-r, size - r) if x * x + y * y <= r * r]
    h, w = levels.shape

    def under(m: np.ndarray, outside: int, join: np.ufunc) -> np.ndarray:
        wide = np.pad(m, size, constant_values=outside)
        out = wide[size : size + h, size : size + w].copy()
        for y, x in spots:
            join(out, wide[size + y : size + y + h, size + x : size + x + w], out=out)
        return out

    return under(under(levels, np.iinfo(np.int32).max, np.minimum), 0, np.maximum)


@dataclass
class ComponentTree:
    """Groups of runs of equal level, united from the highest level down; `at(level)` gives the components that reach it."""

    levels: np.ndarray
    connectivity: int = 4
    group: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        h, w = self.levels.shape
        fresh = np.ones((h, w), bool)
        fresh[:, 1:] = self.levels[:, 1:] != self.levels[:, :-1]
        self.run = np.cumsum(fresh.ravel()).reshape(h, w) - 1
        y, x = np.nonzero(fresh)
        self.level = self.levels[y, x]
        self.area = np.bincount(self.run.ravel()).astype(np.int64)
        self.box = np.stack([x, y, x + self.area, y + 1])
        self.group = np.arange(len(self.level))
        touching = [(self.run[:, :-1], self.run[:, 1:]), (self.run[:-1], self.run[1:])]
        if self.connectivity == 8:
            touching += [(self.run[:-1, :-1], self.run[1:, 1:]), (self.run[:-1, 1:], self.run[1:, :-1])]
        n = np.int64(len(self.level))
        code = np.unique(np.concatenate([np.ravel(a).astype(np.int64) * n + np.ravel(b) for a, b in touching]))
        a, b = code // n, code % n
        weight = np.minimum(self.level[a], self.level[b])
        keep = (a != b) & (weight > 0)
        order = np.argsort(-weight[keep], kind="stable")
        self.a, self.b, self.weight = a[keep][order], b[keep][order], weight[keep][order]
        self.used = 0

    def _unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """The smallest group of each connected set takes the others, with their area and box."""
        a, b = self.group[a], self.group[b]
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = at[: len(a)], at[len(a) :]
        root = np.arange(len(nodes))
        while True:
            new = root.copy()
            np.minimum.at(new, a, root[b])
            np.minimum.at(new, b, root[a])
            new = new[new]
            if (new == root).all():
                break
            root = new
        gone = root != np.arange(len(nodes))
        child, head = nodes[gone], nodes[root[gone]]
        np.add.at(self.area, head, self.area[child])
        for k, join in enumerate((np.minimum, np.minimum, np.maximum, np.maximum)):
            join.at(self.box[k], head, self.box[k][child])
        to = np.arange(len(self.group))
        to[child] = head
        self.group = to[self.group]

    def down_to(self, level: int) -> np.ndarray:
        """Unites what touches at `level` or higher; the groups that reach it, each once.  Levels must descend."""
        end = int(np.searchsorted(-self.weight, -level, side="right"))
        if end > self.used:
            self._unite(self.a[self.used : end], self.b[self.used : end])
            self.used = end
        return np.unique(self.group[self.level >= level])

    def mask(self, group: int) -> tuple[np.ndarray, int, int]:
        """The pixels of a group inside its box, and the box's corner."""
        x1, y1, x2, y2 = (int(v) for v in self.box[:, group])
        return self.group[self.run[y1:y2, x1:x2]] == group, x1, y1


def region_boxes(levels: np.ndarray, n: int, rule: RegionRule) -> dict[int, list[list[int]]]:
    """For each level n..1 the regions' boxes, by top and left; pixels are looked at for sparse components only."""
    tree = ComponentTree(opened_levels(levels, rule.opening), rule.connectivity)
    out = {}
    for level in range(n, 0, -1):
        boxes = []
        for g in tree.down_to(level):
            if tree.area[g] < rule.least_area:
                continue
            x1, y1, x2, y2 = (int(v) for v in tree.box[:, g])
            if not rule.split or tree.area[g] / ((x2 - x1) * (y2 - y1)) >= rule.fill:
                boxes.append([x1, y1, x2, y2])
            else:
                boxes += raster.sparse_boxes(*tree.mask(int(g)), least_area=rule.least_area, least_gap=rule.least_gap, fill=rule.fill)
        out[level] = sorted(boxes, key=lambda b: (b[1], b[0], b[3], b[2]))
    return out


def basins(top: np.ndarray, thresholds: Sequence[float], height: float) -> Iterator[tuple[float, np.ndarray]]:
    """(threshold, labels) from the highest threshold down: one flood, read off as each threshold is reached.

    A pixel joins the highest basin beside it; a basin that rises less than `height` over the meeting place joins the other.
    """
    h, w = top.shape
    wide = w + 2
    labels = [0] * ((h + 2) * wide)
    parent, peak = [0], [0.0]
    flat = np.argsort(-top, axis=None, kind="stable")
    heights = top.ravel()[flat]
    places = ((flat // w + 1) * wide + flat % w + 1).tolist()
    values = heights.tolist()
    done = 0

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for t in sorted(thresholds, reverse=True):
        end = int(np.searchsorted(-heights, -t, side="right"))
        for k in range(done, end):
            p, v = places[k], values[k]
            around = {root(labels[q]) for q in (p - wide, p + wide, p - 1, p + 1) if labels[q]}
            if not around:
                parent.append(len(parent))
                peak.append(v)
                labels[p] = len(parent) - 1
                continue
            best = max(around, key=lambda i: (peak[i], -i))
            labels[p] = best
            for i in around:
                if i != best and peak[i] - v < height:
                    parent[i] = best
        done = max(done, end)
        roots = np.array([root(i) for i in range(len(parent))])
        yield t, roots[np.array(labels).reshape(h + 2, wide)[1:-1, 1:-1]]


def label_boxes(labels: np.ndarray, least_area: int) -> list[list[int]]:
    """Boxes of labels with enough pixels: extremes of all labels in one pass."""
    ys, xs = np.nonzero(labels)
    names, at = np.unique(labels[ys, xs], return_inverse=True)
    low, high = np.full((2, len(names)), np.iinfo(np.int64).max), np.zeros((2, len(names)), np.int64)
    for k, v in enumerate((xs, ys)):
        np.minimum.at(low[k], at, v)
        np.maximum.at(high[k], at, v + 1)
    big = np.bincount(at, minlength=len(names)) >= least_area
    return np.concatenate([low, high])[:, big].T.tolist()


def basin_boxes(prob: np.ndarray, thresholds: Sequence[float], rule: BasinRule) -> dict[float, list[list[int]]]:
    """For each threshold the boxes of its basins, after the merge over shallow borders.

    Maps that leave the unit interval are scaled by their maximum; components that are too small are no basins.
    """
    h, w = prob.shape
    prob = np.nan_to_num(prob, nan=0.0)
    top = raster.blur(prob / prob.max() if prob.max(initial=0) > 1 else prob, rule.sigma(h, w))
    least = rule.area(h, w)
    out = {}
    for t, labels in basins(top, thresholds, rule.height):
        labels = np.where(raster.without_small(labels > 0, least), labels, 0)
        if rule.shallow < 1:
            labels = raster.merge_shallow(labels, top, rule.shallow)
        out[t] = label_boxes(labels, least)
    return out


def painted(shape: tuple[int, int], boxes: list[list[int]]) -> np.ndarray:
    out = np.zeros(shape, bool)
    for x1, y1, x2, y2 in boxes:
        out[y1:y2, x1:x2] = True
    return out


def map_counts(prob: np.ndarray, truth: np.ndarray, thresholds: Sequence[float], modes: Sequence[str], regions: RegionRule, basin: BasinRule) -> list[tuple]:
    """(mode, place of the threshold, tp, fp, fn) of one map."""
    order = np.argsort(thresholds, kind="stable")
    ascending = np.asarray(thresholds, float)[order]
    levels, n, real = levels_of(prob, ascending), len(ascending), int(truth.sum())
    out = []

    def add(mode: str, level: int, found: int, hits: int) -> None:
        out.append((mode, int(order[level - 1]), hits, found - hits, real - hits))

    if "raw" in modes:
        found, hits = (np.bincount(part, minlength=n + 1)[::-1].cumsum()[::-1] for part in (levels.ravel(), levels[truth]))
        for level in range(1, n + 1):
            add("raw", level, int(found[level]), int(hits[level]))
    by_mode = {}
    if "region" in modes:
        by_mode["region"] = region_boxes(levels, n, regions)
    if "watershed" in modes:
        cut = basin_boxes(prob, ascending.tolist(), basin)
        by_mode["watershed"] = {level: cut[t] for level, t in enumerate(ascending.tolist(), 1)}
    for mode, boxes in by_mode.items():
        for level, found in boxes.items():
            m = painted(prob.shape, found)
            add(mode, level, int(m.sum()), int((m & truth).sum()))
    return out


def counts(pairs: DataFrame, thresholds: Sequence[float], modes: Sequence[str] = MODES, regions: RegionRule | None = None, basin: BasinRule | None = None) -> DataFrame:
    """doc, mode, place, threshold, tp, fp, fn of maps (doc, h, w, data) with masks (mask_h, mask_w, mask).

    A null mask is one without forged pixels; a mask of another size is taken at the nearest pixels.  place numbers the
    thresholds as given.  Maps without pixels give zeros; an unknown mode is an error.
    """
    if unknown := set(modes) - set(MODES):
        raise ValueError(f"unknown modes: {sorted(unknown)}")
    thresholds, regions, basin = list(map(float, thresholds)), regions or RegionRule(), basin or BasinRule()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                prob = np.asarray(r.data, float).reshape(int(r.h), int(r.w))
                if r.mask is None or not prob.size:
                    truth = np.zeros(prob.shape, bool)
                else:
                    truth = np.asarray(r.mask).reshape(int(r.mask_h), int(r.mask_w)) > 0
                    truth = truth if truth.shape == prob.shape else raster.nearest_resize(truth, *prob.shape)
                got = map_counts(prob, truth, thresholds, modes, regions, basin) if prob.size else [(m, k, 0, 0, 0) for m in modes for k in range(len(thresholds))]
                rows += [(r.doc, *g) for g in got]
            yield pd.DataFrame(rows, columns=["doc", "mode", "place", "tp", "fp", "fn"])

    found = pairs.select(F.col("doc").cast("string").alias("doc"), "h", "w", "data", "mask_h", "mask_w", "mask").mapInPandas(run, "doc string, mode string, place int, tp bigint, fp bigint, fn bigint")
    return found.withColumn("threshold", F.get(F.array(*[F.lit(t) for t in thresholds]), F.col("place")))


def summary(found: DataFrame) -> DataFrame:
    """A row for each mode and threshold: means of IoU and F1 and of their no-false-alarm forms, scores, sums and means of counts."""
    m = pixel_metrics(F.col("tp"), F.col("fp"), F.col("fn"))
    means = [F.avg(m["iou"]).alias("miou"), F.avg(m["f1"]).alias("mf1"), F.avg(m["iou_no_fp"]).alias("miou_no_fp"), F.avg(m["f1_no_fp"]).alias("mf1_no_fp")]
    totals = [f(c).alias(p + c) for c in ("tp", "fp", "fn") for p, f in (("", F.sum), ("mean_", F.avg))]
    out = found.groupBy("mode", "place", "threshold").agg(F.count(F.lit(1)).alias("n"), *means, *totals)
    half = lambda a, b: (F.col(a) + F.col(b)) / 2
    return out.withColumns({"score": half("miou", "mf1"), "score_no_fp": half("miou_no_fp", "mf1_no_fp")})


def best(summaries: DataFrame, metrics: Sequence[str] = ("miou", "mf1", "score", "miou_no_fp", "mf1_no_fp", "score_no_fp")) -> DataFrame:
    """mode, metric, threshold, value: the highest value's threshold, the first given of equals."""
    def pair(name: str) -> Column:
        return F.struct(F.lit(name).alias("metric"), F.col(name).alias("value"))

    long = summaries.select("mode", "place", "threshold", F.explode(F.array(*[pair(m) for m in metrics])).alias("m"))
    top = F.max_by(F.struct("threshold", F.col("m.value").alias("value")), F.struct(F.col("m.value"), -F.col("place")))
    return long.groupBy("mode", F.col("m.metric").alias("metric")).agg(top.alias("t")).select("mode", "metric", "t.threshold", "t.value")
