"""Kernels, jobs, decoding, resuming: invariants and given examples."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumenspark.functions import kernels as k
from lumenspark.functions.params import Config, Quality
from lumenspark.operators import colour_mode, manifest, quality, scoring, stencils, tiling
from lumenspark.sources import images as im


def payloads(spark, arrays, magnification=100):
    rows = [{"filename": f"a-C-{i}X.PNG", "magnification": magnification, **im.payload_of(a)} for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "filename string, magnification int, " + im.PAYLOAD)


def test_border():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (400, 500)).astype(np.uint8)
    assert k.border_crop(a, 0.05, 0.15) == (0, 0, 0, 0, False)
    a[:30] = 12
    assert k.border_crop(a, 0.05, 0.15)[0] == 30
    a[:200] = 5
    assert k.border_crop(a, 0.05, 0.15)[::4] == (60, True)


def test_metrics():
    board = ((np.indices((256, 256)) // 8).sum(axis=0) % 2).astype(float)  # squares of 8 px; the kernel cannot see single pixels
    assert k.focus(board) > k.focus(k.gaussian(board, 2))
    flat = np.full((400, 400), 0.5)
    assert k.range_fraction(k.gaussian(flat, 20), 0) == 0 and k.contrast(flat) == 0 and k.entropy(flat) == 0
    noisy = flat + np.random.default_rng(1).normal(0, 0.02, flat.shape)
    assert abs(k.noise_sigma(noisy, 1.0) - 0.02) < 0.005
    assert np.allclose(k.gaussian(noisy, 12.0), k._smooth_axis(k._smooth_axis(noisy, k.gaussian_taps(12.0), 0), k.gaussian_taps(12.0), 1))


def test_enhancement_flattens_and_keeps_a_line():
    rng = np.random.default_rng(2)
    a = (0.5 + 0.05 * rng.random((96, 96))) * np.linspace(0.6, 1.0, 96)[:, None]
    a[:, 48:50] *= 0.5
    flat = k.flat_field(a, 20, 5)
    means = lambda x: x.mean(axis=1)
    assert means(flat).std() / means(flat).mean() < means(a).std() / means(a).mean()
    calm = k.denoise(flat, 3, 3, 0.8 * k.noise_sigma(flat, 1.0))
    even = k.clahe(calm, 24, 0.01)
    assert even.min() >= 0 and even.max() <= 1 and even[:, 48:50].mean() < even[:, 40:46].mean() - 0.1
    assert (k.denoise(a, 3, 2, 0.0) == a).all()


def test_boundaries_and_scorers():
    labels = np.ones((40, 100), np.int32)
    labels[:, 50:] = 2
    found = k.boundary_probability(labels)
    assert found.max() == 1 and found.min() >= 0 and abs(int(found[20].argmax()) - 50) <= 1
    a = np.where(np.arange(64)[None, :] < 32, 0.2, 0.8) * np.ones((64, 1))
    for scorer in (scoring.WatershedScorer(100), scoring.CannyScorer(100)):
        scoring.check_map(a, scorer.predict(a))
    for bad in (np.zeros((2, 2), np.float32), np.zeros((64, 64)), np.full((64, 64), 1.5, np.float32)):
        with pytest.raises(ValueError):
            scoring.check_map(a, bad)
    mask = np.array([[1, 0, 1], [1, 0, 1], [0, 0, 1]], bool)
    assert k.connected(mask).tolist() == [[1, 0, 2], [1, 0, 2], [0, 0, 2]]
    assert k.connected(np.eye(3, dtype=bool)[:, ::-1]).tolist() == [[0, 0, 1], [0, 1, 0], [1, 0, 0]]
    assert not k.connected(np.zeros((2, 3), bool)).any()


def test_watershed_takes_pixels_in_order():
    """Against the definition, with heights that often tie."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        h, w = rng.integers(1, 16, 2)
        image = rng.integers(0, rng.integers(2, 60), (h, w)) / 7
        label = np.where(rng.random((h, w)) < 0.08, rng.integers(1, 9, (h, w)), 0)
        want, reached = label.copy(), [(image[y, x], i, y, x) for i, (y, x) in enumerate(np.argwhere(label))]
        age = len(reached)
        while reached:
            _, _, y, x = reached.pop(reached.index(min(reached)))
            for v, u in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
                if 0 <= v < h and 0 <= u < w and not want[v, u]:
                    want[v, u] = want[y, x]
                    reached.append((max(image[v, u], image[y, x]), age, v, u))
                    age += 1
        assert (k.watershed(image, label) == want).all()


def test_watershed_by_pointers_equals_the_flood_in_order():
    rng = np.random.default_rng(6)
    for size in (8, 20, 90):
        for scale in (1e9, 50):
            image = np.rint(k.gaussian(rng.random((size, size + 3)), 1.5) * scale)
            label = np.where(rng.random(image.shape) < 0.01, rng.integers(1, 9, image.shape), 0)
            assert (k.watershed(image, label) == k.flood_in_order(image, label)).all()


def test_canny_finds_edges():
    step = np.where(np.arange(40)[None, :] < 20, 0.2, 0.8) * np.ones((40, 1))
    edges = k.canny(step, 1.0, *np.percentile(step, [60, 90]))
    assert edges.any() and not edges[:, :18].any() and not edges[:, 22:].any() and not edges[0].any()
    stripes = (np.arange(64)[None, :] // 8 % 2) * np.ones((64, 1))
    assert k.canny(stripes, 1.0, 0.5, 1.0)[1:-1].any(axis=0).sum() >= 7
    assert k.score_canny(step, 1.0).max() == 1 and not k.canny(np.full((9, 9), 0.4), 1.0, 0.4, 0.4).any()


def test_background_of_a_reduced_copy_keeps_the_nearest_size():
    seen = []
    original, k.rolling_ball = k.rolling_ball, lambda image, radius: seen.append((image.shape, radius)) or image
    try:
        k.background(np.ones((36, 25)), 10.0, 1.0)
        k.background(np.ones((36, 25)), 2.0, 4.0)
        k.background(np.ones((36, 25)), 3.0, 4.0)
    finally:
        k.rolling_ball = original
    assert seen == [((4, 2), 1.0), ((36, 25), 2.0), ((36, 25), 3.0)]


def test_flat_field_stretches_each_channel():
    rng = np.random.default_rng(2)
    flat = k.flat_field(rng.random((20, 20, 3)) * [0.2, 0.5, 1.0], 5, 5)
    assert np.allclose(flat.min(axis=(0, 1)), 0) and np.allclose(flat.max(axis=(0, 1)), 1)


def test_quality_tiles_cover_the_image(spark):
    a = np.random.default_rng(3).random((50, 65)).astype(np.float32)
    rows = quality.quality(payloads(spark, [a]), Quality(tile_size_px=25, illumination_sigma_px=3.0)).collect()
    tiles = [r for r in rows if r.scope == "tile"]
    assert len(rows) == 7 and sum(r.tile_height_px * r.tile_width_px for r in tiles) == a.size


def test_gate_ratios(spark):
    inf = float("inf")
    row = spark.range(1).select(*[f(F.lit(b), F.lit(a)).alias(n) for n, f, b, a in (("a", quality.illumination_decrease, 2.0, 1.0), ("b", quality.illumination_decrease, 0.0, 0.0), ("c", quality.illumination_decrease, 0.0, 1.0), ("d", quality.noise_increase, 0.0, 1.0), ("e", quality.noise_increase, 2.0, 1.0), ("f", quality.focus_decrease, 0.0, 1.0), ("g", quality.focus_decrease, 0.0, -1.0))]).first()
    assert tuple(row) == (0.5, 0.0, -inf, inf, -0.5, 0.0, inf)


# Image-scope metrics before and after of four photographs, with their verdicts.
GOLDEN = [("C-100X", 0.217365, 0.115201, 0.470012), ("C-200X", 0.111099, 0.115598, -0.040487), ("R-100X", 0.232034, 0.210451, 0.093018), ("R-200X", 0.123475, 0.141375, -0.144971)]


def test_gate_golden(spark):
    make = lambda i: spark.createDataFrame([(n, 100, r[i], 1.0, 1.0) for n, *r in GOLDEN], "filename string, magnification int, illumination_range_frac double, noise_mad_sigma double, focus_variance_of_laplacian double")
    out = {r.filename: r for r in quality.verdicts(quality.gate_join(make(0), make(1))).collect()}
    for n, _, _, change in GOLDEN:
        assert abs(out[n].illumination_relative_decrease - change) < 1e-4 and not out[n].gate_pass
    with pytest.raises(PySparkException):
        quality.gate_join(make(0).limit(1), make(1)).collect()


def test_origins_and_reassembly(spark):
    dims = spark.createDataFrame([(2304,), (3456,), (300,)], "n int")
    got = {r.n: r.o for r in dims.where("n > 512").select("n", tiling.origins(F.col("n"), 512, 256).alias("o")).collect()}
    assert len(got[2304]) == 8 and got[3456][-1] == 2944
    with pytest.raises(PySparkException):
        dims.select(tiling.origins(F.col("n"), 512, 256)).collect()
    a = np.random.default_rng(4).random((50, 67, 3)).astype(np.float32)
    tiles = tiling.cut_tiles(payloads(spark, [a]), 16, 0.5).withColumns({"source_height_px": F.lit(50), "source_width_px": F.lit(67)})
    assert (im.array_of(tiling.reassemble(tiles).first()) == a).all()


def test_otsu_of_one_value_and_circular_wrap(spark):
    one = spark.createDataFrame([(100, 0.25)] * 3 + [(200, 0.1), (200, 0.9)], "magnification int, v double")
    got = dict(map(tuple, colour_mode.otsu(one).collect()))
    assert got[100] == 0.25 and 0.1 <= got[200] < 0.9
    row = spark.range(1).select(colour_mode.wrapped_difference(F.lit(359.0), F.lit(1.0)).alias("a"), colour_mode.circular_spread(F.lit(0.0), F.lit(0.0)).alias("b")).first()
    assert abs(row.a - 2) < 1e-9 and row.b == float("inf")


def test_holdout_guard_and_unknown_names(spark):
    table = spark.createDataFrame([("a", "dev"), ("b", "test")], "filename string, split string")
    ask = lambda n: spark.createDataFrame([(n,)], "filename string")
    assert manifest.look_up(ask("a"), table).first().split == "dev"
    assert manifest.look_up(ask("b"), table, allow_test=True).first().split == "test"
    for name in ("b", "c"):
        with pytest.raises(PySparkException):
            manifest.look_up(ask(name), table).collect()


class Flaky:
    def __init__(self, magnification):
        if magnification == 200:
            raise RuntimeError("no weights")

    def predict(self, tile):
        if tile[0, 0] > 0.5:
            raise ValueError("bad tile")
        return np.zeros(tile.shape, np.float32)


def test_resume_and_failures(spark, tmp_path):
    arrays = [np.full((8, 8), v, np.float32) for v in (0.1, 0.2, 0.9)]
    tiles = payloads(spark, arrays).union(payloads(spark, arrays[:1], 200)).withColumnRenamed("filename", "source_filename").withColumn("tile_filename", F.concat("source_filename", F.lit("_"), "magnification"))
    where = str(tmp_path / "scored")
    registry = {"flaky": Flaky}
    first = scoring.run_scoring(tiles, ["flaky"], where, registry).first()
    assert (first.total, first.already_done) == (4, 2)
    log = scoring.scoring_log(spark, where)
    assert {r.detail for r in log.where("status = 'failed'").collect()} == {"ValueError: bad tile", "RuntimeError: no weights"}
    rows, more = scoring.failures(log, 1)
    assert rows.count() == 1 and more == 1 and scoring.failures(log, 5)[1] == 0
    scoring.run_scoring(tiles, ["flaky"], where, registry)
    assert scoring.predictions(spark, where).count() == 2 and scoring.scoring_log(spark, where).count() == 6
    with pytest.raises(ValueError):
        scoring.pairs(tiles, ["unheard"], registry)
    statuses = {r.status for r in scoring.timing(scoring.score(scoring.pairs(tiles, ["flaky"], registry), registry)).collect()}
    assert statuses == {"ok", "load_failed", "predict_failed"}


def test_config_fingerprint():
    assert len(Config().fingerprint()) == 12 and Config().fingerprint() == Config().fingerprint() != Config(split_seed=1).fingerprint()


def test_restart_makes_only_what_is_missing(spark, tmp_path):
    from lumenspark.operators import stages

    made = []
    keys = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")

    def build(name):
        return lambda left: made.append((name, sorted(r.k for r in left.collect()))) or left

    chain = [stages.Stage(n, str(tmp_path / n), ("k",), lambda s: keys, build(n)) for n in ("one", "two")]
    keys.where("k = 'a'").write.parquet(chain[0].path)
    summary = stages.restart(spark, chain)
    assert [tuple(r) for r in summary.collect()] == [(1, "one", "regenerated", 2, 1), (2, "two", "regenerated", 2, 2)]
    assert made == [("one", ["b"]), ("two", ["a", "b"])]
    again = stages.restart(spark, [*chain, stages.Stage("none", str(tmp_path / "none"), ("k",), lambda s: keys.limit(0), build("none"))])
    assert [r.status for r in again.collect()] == ["found", "found", "empty"] and len(made) == 2
    assert [tuple(r) for r in stages.status_counts(again).orderBy("status").collect()] == [("empty", 1, 0), ("found", 2, 0)]


def test_stencils_equal_the_kernels(spark):
    image = np.random.default_rng(4).random((6, 9))
    rows = [("a", i, j, 6, 9, float(image[i, j])) for i in range(6) for j in range(9)]
    pixels = spark.createDataFrame(rows, "id string, row int, col int, height int, width int, v double")
    for made, want in ((stencils.gaussian(pixels, ["id"], F.lit(0.8)), k.gaussian(image, 0.8)), (stencils.laplacian(pixels, ["id"]), k.laplacian(image))):
        got = np.zeros(image.shape)
        for r in made.collect():
            got[r.row, r.col] = r.v
        np.testing.assert_allclose(got, want, atol=1e-12)
    with pytest.raises(ValueError, match="mode"):
        stencils.along(pixels, ["id"], "row", F.array(F.lit(1.0)), "v", "wrap")
    assert stencils.laplacian(pixels.limit(0), ["id"]).count() == 0


def test_colour_decision_of_grey_and_empty_images(spark):
    rows = [("a", 100, i, j, 0.5, 0.5, 0.5) for i in range(3) for j in range(4)]
    pixels = spark.createDataFrame(rows, "filename string, magnification int, row int, col int, r double, g double, b double")
    payloads = im.to_payload(pixels, ["filename", "magnification"], ["r", "g", "b"])
    threshold = colour_mode.otsu_of_images(payloads)
    assert threshold.first().threshold == 0.5
    decided = colour_mode.decisions(colour_mode.moments_of_images(payloads, threshold))
    assert [(r.n_pixels, r.decision, r.degenerate) for r in decided.collect()] == [(12, "grayscale", True)]
    assert colour_mode.decision_table(decided).first().decision == "grayscale"
    mixed = decided.union(decided.withColumn("decision", F.lit("colour")))
    assert colour_mode.decision_table(mixed).count() == 0
    none = payloads.limit(0)
    assert colour_mode.moments_of_images(none, colour_mode.otsu_of_images(none)).count() == 0


def test_refused_rows(spark):
    sized = spark.createDataFrame([("a", 24, 24), ("b", 23, 99), ("c", None, 24)], "filename string, height int, width int")
    assert {r.filename for r in tiling.too_small(sized, 24).collect()} == {"b", "c"}
    log = spark.createDataFrame([("x",), ("y",), (None,)], "model string")
    assert {r.model for r in scoring.unknown_models(log, ["x"]).collect()} == {"y", None}
    split = spark.createDataFrame([("a", "test"), ("b", "dev")], "filename string, split string")
    assert [r.filename for r in manifest.held_out(sized, split).collect()] == ["a"]
