"""Plans of queries that failed on large tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rasterloom import queries
from rasterloom.llm import substring_dedup
from rasterloom.functions.scalars import scaled_side
from rasterloom.kernels import clusters, lines, masks, render
from rasterloom.operators import svg
from rasterloom.plans.options import build_options
from rasterloom.plans.vectorize import vectorize, vectorize_layers
from rasterloom.sources.fixtures import pictures


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_small_fragments_join_nothing(spark, data_dir):
    assert "Join" not in plan(queries.small_fragments(spark, data_dir))


def test_small_fragments_of_odd_rows(spark):
    rows = [(1, "details", 0, 0), (1, "details", 1, 5), (1, "shadow", 2, 5), (2, "logo", 0, None), (2, "logo", 1, 7), (2, "laces", 2, 1), (3, "logo", 0, None), (None, "logo", 0, 1)]
    rows += [(4, "logo", k, k + 1) for k in range(20)] + [(4, "logo", 20 + k, None) for k in range(20)]
    items = spark.createDataFrame(rows, "image_id long, layer string, ord int, area long")
    found = svg.small_fragments(items)
    assert found.columns == ["image_id", "layer", "ord", "area", "cutoff"]
    assert sorted(map(tuple, found.collect())) == [(2, "logo", 1, 7, 7), (4, "logo", 0, 1, 2), (4, "logo", 1, 2, 2)]


def test_layer_stats_join_nothing(spark, data_dir):
    assert "Join" not in plan(queries.layer_stats(spark, data_dir))


def test_layer_stats_of_odd_rows(spark):
    rows = [(1, "logo", "M 0,0 L 1,2"), (1, "logo", None), (1, "other", "M 0,0"), (1, None, "M 0,0"), (2, "logo", "M 0,0"), (None, "logo", "M 0,0")]
    items = spark.createDataFrame(rows, "image_id long, layer string, d string")
    found = svg.layer_stats(items, spark.createDataFrame([(1,), (1,), (3,), (None,)], "image_id long"))
    assert found.dtypes == [("image_id", "bigint"), ("layer", "string"), ("paths", "bigint"), ("anchors", "bigint")]
    got = {(r.image_id, r.layer): (r.paths, r.anchors) for r in found.collect()}
    assert got == {(i, layer): (2, 2) if i == 1 and layer in ("logo", None) else (0, 0) for i in (1, 3, None) for layer in (*svg.LAYERS, None)}
    assert found.count() == 27


def test_places_of_chunks_shuffle_in_halves_of_longs(spark):
    text = "é " + " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " x")], "doc_id long, text string")
    packed = substring_dedup._packed(docs, True)
    assert len(packed.columns) == 4 + len(substring_dedup.PLACES) and {kind for _, kind in packed.dtypes} == {"bigint"}
    rows = sorted(substring_dedup.chunks(docs, True).where("doc_id = 1").collect(), key=lambda r: r.word)
    words, data = text.split(), text.encode()
    at = 0
    for r in rows:
        assert r.word == at and data[r.byte : r.byte + r.bytes].decode() == " ".join(words[at : at + r.words])
        at += r.words
        for k in substring_dedup.BESIDE:
            assert (r[f"l{k}"] != 0) == (r.word >= k) and (r[f"r{k}"] != 0) == (at + k <= len(words))
    assert at == len(words) and any(r.l5 < 0 for r in rows) and any(r.r5 < 0 for r in rows) and len(rows) > 3


def test_pictures_are_drawn_in_batches(spark, data_dir):
    drawn = plan(queries.svg_png(spark, data_dir))
    assert "MapInArrow" in drawn and "CoGroup" not in drawn and "Join" not in drawn


def test_pngs_of_odd_rows(spark):
    rows = [(1, "logo", 1, "fill", "#00ff00", None, None, "M 0,0 L 4,0 L 4,4 L 0,4 Z"), (1, "shadow", 5, "fill", "#ff0000", None, None, "M 0,0 L 4,0 L 4,4 L 0,4 Z"), (1, "logo", 0, "fill", "#0000ff", None, None, ""), (9, "logo", 0, "fill", "#0000ff", None, None, "M 0,0 L 4,4")]
    items = spark.createDataFrame(rows, "image_id long, layer string, ord int, mode string, color string, stroke_width double, opacity double, d string")
    made = {r.image_id: bytes(r.png) for r in svg.render_png(items, spark.createDataFrame([(1, 4, 4), (2, 4, 4)], "image_id long, w int, h int"), 1.0).collect()}
    painted = np.zeros((4, 4, 4), np.uint8)
    painted[:] = (0, 255, 0, 255)
    assert made == {1: render.png(painted), 2: render.png(np.zeros((4, 4, 4), np.uint8))}


def test_masks_of_a_window_are_cut_from_the_whole():
    rng = np.random.default_rng(5)
    for k in range(60):
        parts = [(rng.normal(15, 12, (int(rng.integers(1, 6)), 2)).round(k % 3), bool(k & 1)) for _ in range(2)]
        for mask in (render.fill_mask, lambda p, *window: render.stroke_mask(p, 1.0 + k % 7, *window)):
            assert np.array_equal(mask(parts, 11, 9, 6, 8), mask(parts, 30, 30)[6:17, 8:17])


def test_merging_looks_only_at_labels_with_small_regions(monkeypatch):
    looked = []
    monkeypatch.setattr(clusters, "regions", lambda values: looked.append(1) or masks.regions(values))
    labels = np.repeat(np.arange(12), 40)[:, None] * np.ones(40, int)
    labels[5, 5] = 7
    centers = np.arange(12)[:, None] * np.ones(3)
    merged = clusters.merge_small(labels, centers, 0.0)
    labels[5, 5] = 0
    # Each pass looks at all labels at once, the first also at 7, which has a small region, and at 0, into which it is folded.
    assert np.array_equal(merged, np.repeat(np.arange(12), 40)[:, None] * np.ones(40, int)) and len(looked) <= 4


def test_the_conversion_keeps_a_picture_in_its_row(spark, data_dir):
    drawn = plan(queries.vectorize_svg(spark, data_dir))
    assert not any(word in drawn for word in ("Join", "Aggregate", "Window", "Sort")) and drawn.count("Repartition") == 1


def test_svgs_in_rows_are_those_of_the_items(spark, data_dir):
    few, blank = pictures(spark, data_dir).limit(12), spark.createDataFrame([(-1, 5, 4, bytearray(60))], "image_id long, w int, h int, rgb binary")
    few = few.unionByName(blank)
    sizes = few.select("image_id", *(scaled_side(F.col(c), F.col("w"), F.col("h"), F.lit(None).cast("double")).alias(c) for c in "wh"))
    for css in (True, False):
        options = build_options("illustration", use_css_classes=css)
        got = {r.image_id: r.svg for r in vectorize(few, options).collect()}
        assert len(got) == 13 and got == {r.image_id: r.svg for r in svg.assemble_svg(vectorize_layers(few, options), sizes, css).collect()}


def test_outlines_of_all_labels_are_those_of_each():
    rng = np.random.default_rng(3)
    for k in range(40):
        labels = rng.integers(-1, 1 + k % 5, rng.integers(1, 20, 2)).repeat(1 + k % 3, 0).repeat(1 + k % 2, 1)
        found = lines.label_outlines(labels, 1 + k % 3)
        assert {c: found.get(c, []) for c in range(6)} == {c: lines.outlines(labels == c, 1 + k % 3) for c in range(6)}


def test_clusters_of_distinct_colours_are_those_of_all_points():
    rng = np.random.default_rng(4)
    for k in range(20):
        colors, which = rng.random((1 + 3 * k, 3)).astype(np.float32), rng.integers(0, 1 + 3 * k, 500)
        for got, want in zip(clusters.kmeans(colors, 6, cap=400, which=which), clusters.kmeans(colors[which], 6, cap=400)):
            assert np.array_equal(got, want)


def test_merging_finds_regions_once(monkeypatch):
    looked = []
    monkeypatch.setattr(clusters, "regions", lambda values: looked.append(1) or masks.regions(values))
    labels = np.random.default_rng(2).integers(0, 5, (40, 40)).repeat(2, 0)
    merged = clusters.merge_small(labels, np.arange(5)[:, None] * np.ones(3), 0.0)
    assert len(looked) == 1 and (masks.regions(merged).n >= 24).mean() > (masks.regions(labels).n >= 24).mean()


def test_curves_between_parallel_tangents_stay_near():
    """A three-point stretch whose tangents are parallel has no single best curve; any that is taken stays within the error."""
    for points in ([(0, 0), (1, 2), (2, 4)], [(42, 15), (43, 19), (44, 30), (45, 41)], [(0, 0), (3, 0), (6, 0), (6, 0), (9, 0)]):
        curves = lines.fit_curves(points, 1.0)
        on = np.concatenate([lines._bezier(c, np.linspace(0, 1, 400)) for c in curves])
        assert all(np.hypot(*(on - p).T).min() < 1 for p in points)
