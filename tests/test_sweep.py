"""One-pass sweeps against flooding at each threshold, on 256 x 256 maps."""

import numpy as np
import pytest

from veridoc.operators import raster, sweep

THRESHOLDS = [0.5, 0.2, 0.35, 0.65, 0.9]


def smooth_map(seed, size=256):
    rng = np.random.default_rng(seed)
    out = np.kron(rng.random((size // 8, size // 8)), np.ones((8, 8))) * 0.7 + rng.random((size, size)) * 0.3
    return raster.blur(out, 2.0) * 1.2


@pytest.mark.parametrize("connectivity", [4, 8])
def test_tree_gives_the_components_of_every_level(connectivity):
    levels = sweep.levels_of(smooth_map(1), np.sort(THRESHOLDS))
    tree = sweep.ComponentTree(levels, connectivity)
    for level in range(len(THRESHOLDS), 0, -1):
        labels = raster.components(levels >= level, connectivity)
        want = set()
        for k in range(1, labels.max() + 1):
            ys, xs = np.nonzero(labels == k)
            want.add((len(ys), xs.min(), ys.min(), xs.max() + 1, ys.max() + 1))
        groups = tree.down_to(level)
        assert {(tree.area[g], *tree.box[:, g]) for g in groups} == want
        assert sum(tree.mask(int(g))[0].sum() for g in groups) == (levels >= level).sum()


@pytest.mark.parametrize("seed", [2, 3])
def test_regions_equal_flooding_at_each_threshold(seed):
    prob = smooth_map(seed)
    ascending = np.sort(THRESHOLDS)
    rule = sweep.RegionRule(least_area=20)
    got = sweep.region_boxes(sweep.levels_of(prob, ascending), len(ascending), rule)
    for level, t in enumerate(ascending, 1):
        assert sorted(got[level]) == sorted(raster.detector_regions(prob, t, 20, opening=3))
    assert sum(map(len, got.values())) > 20


def test_basins_equal_a_flood_for_each_threshold():
    prob = smooth_map(4, 64)
    top = raster.blur(prob, 1.0)
    for t, labels in sweep.basins(top, THRESHOLDS, 0.05):
        want = raster.watershed(prob, t, 1.0, 0.05, 0)
        pairs = set(zip(labels.ravel().tolist(), want.ravel().tolist(), strict=True))
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_opening_of_levels():
    levels = sweep.levels_of(smooth_map(5, 64), np.sort(THRESHOLDS))
    for size in (1, 3, 5):
        for level in range(1, 6):
            assert ((sweep.opened_levels(levels, size) >= level) == raster.opened(levels >= level, size)).all()


def test_counts_of_all_modes(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for doc in range(4):
        prob = smooth_map(10 + doc, 64)
        truth = None if doc == 3 else rng.random((32, 32)) < 0.3
        rows.append((str(doc), 64, 64, prob.ravel().tolist(), 32, 32, None if truth is None else truth.astype(int).ravel().tolist()))
        real = np.zeros((64, 64), bool) if truth is None else np.kron(truth, np.ones((2, 2), bool))
        for place, t in enumerate(THRESHOLDS):
            boxes = {"region": raster.detector_regions(prob, t, 20), "watershed": sweep.basin_boxes(prob, [t], sweep.BasinRule())[t]}
            for mode, m in {"raw": prob >= t, **{k: sweep.painted((64, 64), b) for k, b in boxes.items()}}.items():
                want[str(doc), mode, place] = (int((m & real).sum()), int((m & ~real).sum()), int((~m & real).sum()))
    df = spark.createDataFrame(rows, "doc string, h int, w int, data array<double>, mask_h int, mask_w int, mask array<int>")
    found = sweep.counts(df, THRESHOLDS, regions=sweep.RegionRule(least_area=20)).cache()
    assert {(r.doc, r.mode, r.place): (r.tp, r.fp, r.fn) for r in found.collect()} == want
    s = sweep.summary(found)
    raw = {r.threshold: r for r in s.where("mode = 'raw'").collect()}
    assert set(raw) == set(THRESHOLDS) and raw[0.2].n == 4 and raw[0.2].tp == sum(v[0] for k, v in want.items() if k[1:] == ("raw", 1))
    top = sweep.best(s).where("mode = 'raw' AND metric = 'miou'").first()
    assert top.value == max(r.miou for r in raw.values()) and raw[top.threshold].miou == top.value


def test_edges(spark):
    schema = "doc string, h int, w int, data array<double>, mask_h int, mask_w int, mask array<int>"
    assert sweep.counts(spark.createDataFrame([], schema), [0.5]).count() == 0
    odd = spark.createDataFrame([("empty", 0, 0, [], 0, 0, []), ("nan", 2, 2, [float("nan"), 1.0, 0.5, 0.0], None, None, None), (None, 1, 1, [0.5], 1, 1, [1])], schema)
    got = {(r.doc, r.mode): (r.tp, r.fp, r.fn) for r in sweep.counts(odd, [0.5], regions=sweep.RegionRule(least_area=1, opening=1)).collect()}
    assert got["empty", "raw"] == (0, 0, 0) and got["nan", "raw"] == (0, 2, 0) and got[None, "raw"] == (1, 0, 0) and got[None, "region"] == (1, 0, 0)
    tied = spark.createDataFrame([("m", 0, 0.9, 0.5), ("m", 1, 0.4, 0.5)], "mode string, place int, threshold double, miou double")
    assert sweep.best(tied, ["miou"]).first().threshold == 0.9
    with pytest.raises(ValueError):
        sweep.counts(odd, [0.5], ["naive"])
