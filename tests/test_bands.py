"""Enhancement in bands of height equals that of whole maps."""

import numpy as np
import pytest

from fieldstat.operators.bands import band_tree, enhance_large
from fieldstat.operators.clusters import Graph, enhance, exact_enhancement, exact_positive, grid_edges


def maps_of(shape, seed=1):
    """Smooth noise, whole numbers with many ties, one value alone, nothing, and gaps."""
    rng, n = np.random.default_rng(seed), int(np.prod(shape))
    noise = rng.standard_normal(n)
    for _ in range(3):
        noise = (noise + np.roll(noise, 1) + np.roll(noise, shape[-1])) / 3
    return {"noise": noise * 4, "ties": rng.integers(-3, 4, n).astype(float), "one": np.full(n, 2.0), "none": np.zeros(n), "gaps": np.where(rng.random(n) < 0.3, np.nan, noise * 9)}


def frame(spark, maps):
    rows = [(k, i, None if np.isnan(v) and i % 2 else float(v), 0.5 + i % 3) for k, x in maps.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "k string, feature int, x double, area double").repartition(5)


@pytest.mark.parametrize("bands", [1, 2, 5])
def test_bands_equal_whole_maps(spark, bands):
    shape = (14, 17)
    maps, graph = maps_of(shape), Graph.grid(shape)
    area = np.array([0.5 + i % 3 for i in range(graph.n)])
    for unit in (None, "area"):
        got = {}
        for r in enhance_large(frame(spark, maps), ["k"], grid_edges(spark, shape), bands=bands, unit=unit).collect():
            got.setdefault(r["k"], {})[r["feature"]] = r["tfce"]
        for k, x in maps.items():
            want = exact_enhancement(x, graph, unit=area if unit else 1.0)
            assert len(got[k]) == graph.n
            assert np.allclose([got[k][i] for i in range(graph.n)], want, rtol=1e-9, atol=1e-12), (k, unit)
    assert enhance_large(frame(spark, maps).limit(0), ["k"], grid_edges(spark, shape), bands=bands).count() == 0


def test_other_exponents_and_a_graph_without_edges(spark):
    shape = (6, 5)
    maps, graph = {"a": maps_of(shape, 3)["noise"]}, Graph.grid(shape)
    one = enhance_large(frame(spark, maps), ["k"], grid_edges(spark, shape), bands=3, e=0.5, h=1.0).orderBy("feature").collect()
    assert np.allclose([r["tfce"] for r in one], exact_enhancement(maps["a"], graph, 0.5, 1.0))
    bare = enhance_large(frame(spark, maps), ["k"], grid_edges(spark, shape).limit(0), bands=3).orderBy("feature").collect()
    assert np.allclose([r["tfce"] for r in bare], np.sign(maps["a"]) * np.abs(maps["a"]) ** 3 / 3)


def test_a_task_holds_a_band_of_a_map(spark, monkeypatch):
    """No group that is solved at once has much more than its share of the features, and what touches them."""
    from fieldstat.operators import bands as module

    shape, sizes = (40, 40), spark.sparkContext.accumulator(0)
    most = spark.sparkContext.accumulator(0.0)
    plain = module.band_tree

    def watched(top, *rest):
        sizes.add(1)
        most.add(float(len(top)) ** 4)
        return plain(top, *rest)

    monkeypatch.setattr(module, "band_tree", watched)
    x = np.abs(maps_of(shape, 5)["noise"])
    got = enhance_large(frame(spark, {"a": x}), ["k"], grid_edges(spark, shape), bands=8).orderBy("feature").collect()
    assert np.allclose([r["tfce"] for r in got], exact_positive(x, Graph.grid(shape), 2 / 3, 2.0), rtol=1e-9)
    whole = enhance(frame(spark, {"a": x}), ["k"], Graph.grid(shape)).orderBy("feature").collect()
    assert np.allclose([r["tfce"] for r in whole], [r["tfce"] for r in got], rtol=1e-9)
    if sizes.value:  # counted where the workers see the patch
        assert most.value ** 0.25 < x.size / 2


def test_band_tree_by_hand():
    # two peaks of 5 and 4 meet at 3; the band ends at 1
    root, share, extent = band_tree(np.array([5.0, 4.0, 3.0]), np.ones(3), np.array([0, 1]), np.array([2, 2]), np.array([3.0, 3.0]), 1.0, 1.0, 0.0)
    assert len(set(root)) == 1 and extent.tolist() == [3.0] * 3
    assert share.tolist() == [1 * 2 + 3 * 2, 1 * 1 + 3 * 2, 3 * 2]
