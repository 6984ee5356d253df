from __future__ import annotations

import io
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.functions import color, names, scalars
from rasterloom.kernels import clusters, filters, lines, masks, prepare, render, white
from rasterloom.kernels.color import lab as lab_of
from rasterloom.operators import svg
from rasterloom.operators.order import with_position
from rasterloom.operators.pictures import per_picture, pixels
from rasterloom.plans.options import PRESETS, Options, build_options, preset_table, resolve
from rasterloom.plans.vectorize import layer_items, smoothed, vectorize
from rasterloom.sources import fixtures, images


def grid(text: str) -> np.ndarray:
    return np.array([[int(c) for c in row] for row in text.split("/")], np.uint8)


def text(mask: np.ndarray) -> str:
    return "/".join("".join(map(str, row)) for row in mask.astype(int).tolist())


small_masks = st.integers(3, 9).flatmap(lambda w: st.lists(st.lists(st.integers(0, 1), min_size=w, max_size=w), min_size=3, max_size=9)).map(lambda m: np.array(m, np.uint8))


def test_draws_of_seed_42():
    assert clusters.Draws(42).take(3).tolist() == [0.6011037519201636, 0.44829055899754167, 0.8524657934904099]


@pytest.mark.parametrize(
    ("rgb", "lab"),
    [((255, 255, 255), (100.0, 0.00526, -0.010408)), ((200, 200, 200), (80.604083, 0.004381, -0.008668)), ((12, 12, 12), (3.32096, 0.000452, -0.000894)), ((255, 0, 0), (53.232882, 80.10931, 67.220068))],
)
def test_lab_goldens(spark, rgb, lab):
    row = spark.createDataFrame([rgb], "r int, g int, b int").select(*color.lab("r", "g", "b")).first()
    assert tuple(round(v, 6) for v in row) == pytest.approx(lab, abs=2e-6)
    assert lab_of(np.array(rgb, np.uint8)).tolist() == pytest.approx(lab, abs=1e-5)


def test_thinning_stops_by_its_second_step():
    start = grid("10100/11111/11110/11011/11011")
    assert text(lines.thin(start)) == "10100/11111/11110/10011/11011"
    assert text(lines.thin(start, canonical=True)) == "10100/11111/10010/10011/11011"


@pytest.mark.parametrize(
    ("mask", "sizes"),
    [
        ("11111", [(5, False)]),
        ("000/010/000", []),
        ("010/101/010", [(5, True)]),
        ("01110/10001/10001/10001/01110", [(13, True)]),
        ("10001/01010/00100/00100/00100", [(3, False)] * 3),
        ("10001/01010/00100/01010/10001", [(3, False)] * 4),
        ("00000/11111/00100/00100/00100", [(2, False)] * 7 + [(3, False)]),
        ("111/101/111", [(2, False)] * 4 + [(3, False)] * 4),
    ],
)
def test_centre_lines(mask, sizes):
    assert sorted((len(p), closed) for p, closed in lines.centre_lines(grid(mask))) == sorted(sizes)


def test_the_first_ring_starts_and_ends_alike():
    assert lines.centre_lines(grid("010/101/010")) == [([(1, 0), (0, 1), (1, 2), (2, 1), (1, 0)], True)]


def test_simplify_golden():
    points = [(0, 0), (1, 0.1), (2, -0.1), (3, 5), (4, 6), (5, 7), (6, 8.1), (7, 9), (8, 9), (9, 9)]
    assert lines.simplify(points, 1.0) == [(0, 0), (2, -0.1), (3, 5), (7, 9), (9, 9)]


def test_outlines_of_a_square_with_a_hole_and_an_island():
    mask = np.zeros((9, 9), np.uint8)
    mask[1:8, 1:8] = 1
    mask[2:7, 2:7] = 0
    mask[3:6, 3:6] = 1
    found = sorted(lines.outlines(mask), key=lambda s: -lines.area(s["outer"]))
    assert [(lines.area(s["outer"]), len(s["holes"])) for s in found] == [(36.0, 1), (4.0, 0)]


def test_outlines_drop_single_pixels_and_pairs():
    assert lines.outlines(grid("00000/01000/00000/00110/00000")) == []


@given(small_masks)
@settings(max_examples=60, deadline=None)
def test_outlines_are_as_many_as_8_connected_parts(mask):
    seen, parts = np.zeros(mask.shape, bool), 0
    for y, x in zip(*np.nonzero(mask)):
        if not seen[y, x]:
            parts += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not seen[a, b]:
                    seen[a, b] = True
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert len(lines.outlines(mask, least=1)) == parts


@given(small_masks)
@settings(max_examples=100, deadline=None)
def test_outlines_enclose_the_cells_of_the_mask(mask):
    """The area between outer borders and holes is that of unit cells with all corners in the mask, and half of those with three."""
    found = lines.outlines(mask, least=1)
    cells = mask[:-1, :-1].astype(int) + mask[1:, :-1] + mask[:-1, 1:] + mask[1:, 1:]
    net = sum(lines.area(s["outer"]) - sum(map(lines.area, s["holes"])) for s in found)
    assert net == (cells == 4).sum() + (cells == 3).sum() / 2
    wide = np.pad(mask, 1)
    assert sum(len(s["holes"]) for s in found) == len(masks.regions(wide == 0).first) - 1


@given(small_masks, st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_opening_lies_within_and_is_idempotent(mask, radius):
    mask = mask.astype(bool)
    low, once = masks.box(mask, radius, True), masks.opened(mask, radius)
    assert (low <= mask).all() and (mask <= masks.box(mask, radius, False)).all() and (once <= mask).all()
    assert (masks.opened(once, radius) == once).all()


@given(small_masks)
@settings(max_examples=60, deadline=None)
def test_distance_and_regions_against_brute_force(mask):
    mask = mask.astype(bool)
    zero = np.argwhere(~mask)
    want = np.array([[np.abs(zero - (y, x)).sum(axis=1).min() if len(zero) else -1 for x in range(mask.shape[1])] for y in range(mask.shape[0])])
    assert (masks.distance(mask) == want).all()


def plain_regions(values: np.ndarray) -> list[list[int]]:
    """Flat indices of the 4-connected regions of equal values from 0 on, by flood fill."""
    h, w = values.shape
    seen, out = set(), []
    for start in range(h * w):
        if start in seen or values.flat[start] < 0:
            continue
        todo, found = [start], []
        seen.add(start)
        while todo:
            i = todo.pop()
            found.append(i)
            y, x = divmod(i, w)
            for a, b in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if 0 <= a < h and 0 <= b < w and a * w + b not in seen and values[a, b] == values[y, x]:
                    seen.add(a * w + b)
                    todo.append(a * w + b)
        out.append(sorted(found))
    return out


label_pictures = st.tuples(st.integers(1, 9), st.integers(1, 9)).flatmap(
    lambda s: st.lists(st.integers(-1, 2), min_size=s[0] * s[1], max_size=s[0] * s[1]).map(lambda v: np.array(v).reshape(s))
)


@given(label_pictures)
@settings(max_examples=100, deadline=None)
def test_regions_against_flood_fill(values):
    parts, want = masks.regions(values), plain_regions(values)
    assert [p.tolist() for p in parts.members()] == want
    assert parts.first.tolist() == [p[0] for p in want] and parts.n.tolist() == [len(p) for p in want]
    h, w = values.shape
    ys, xs = ([np.array(p) // w for p in want], [np.array(p) % w for p in want])
    assert parts.boxes().T.tolist() == [[x.min(), y.min(), x.max(), y.max()] for x, y in zip(xs, ys)]
    assert parts.touching().tolist() == [bool((x == 0).any() or (y == 0).any() or (x == w - 1).any() or (y == h - 1).any()) for x, y in zip(xs, ys)]
    assert parts.paint(np.arange(len(want)) + 5).ravel().tolist() == [next((k + 5 for k, p in enumerate(want) if i in p), -1) for i in range(h * w)]


def test_regions_of_a_spiral_are_one():
    mask = np.zeros((101, 101), bool)
    for k in range(0, 50, 2):
        mask[k, k : 101 - k] = mask[k : 101 - k, 100 - k] = mask[100 - k, k : 101 - k] = mask[k + 2 : 101 - k, k] = True
        mask[k + 2, k : k + 3] = True
    assert len(masks.regions(mask).first) == 1


@given(label_pictures)
@settings(max_examples=100, deadline=None)
def test_merging_against_a_plain_version(values):
    """Region by region, in the order of labels and then of first pixels, for two passes."""
    centers = np.array([[0.0, 0, 0], [9.0, 0, 0], [20.0, 0, 0]])
    h, w = values.shape
    got, want, least = clusters.merge_small(values, centers, 0.0), values.copy(), 24
    for _ in range(2):
        for own in range(3):
            for region in [p for p in plain_regions(np.where(want == own, own, -1))]:
                met: dict[int, int] = {}
                order, todo, seen = [], [region[0]], {region[0]}
                while todo:
                    i = todo.pop()
                    order.append(i)
                    for j in sides(i, h, w):
                        if j in region and j not in seen:
                            seen.add(j)
                            todo.append(j)
                for i in order:
                    for j in sides(i, h, w):
                        if want.flat[j] not in (-1, own):
                            met[int(want.flat[j])] = met.get(int(want.flat[j]), 0) + 1
                if met and len(region) < least and abs(centers[own] - centers[best := max(met, key=met.get)]).max() <= 14:
                    want.flat[region] = best
    assert (got == want).all()


def sides(i: int, h: int, w: int) -> list[int]:
    y, x = divmod(i, w)
    return [a * w + b for a, b in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)) if 0 <= a < h and 0 <= b < w]


@given(small_masks)
@settings(max_examples=60, deadline=None)
def test_thinning_against_the_published_rule(mask):
    want = mask.copy()
    while True:
        second = False
        for step in (0, 1):
            gone = []
            for y in range(1, want.shape[0] - 1):
                for x in range(1, want.shape[1] - 1):
                    p = [int(want[y + dy, x + dx]) for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
                    turns = sum(a == 0 and b == 1 for a, b in zip(p, p[1:] + p[:1]))
                    one, two = (p[0] * p[2] * p[4], p[2] * p[4] * p[6]) if step == 0 else (p[0] * p[2] * p[6], p[0] * p[4] * p[6])
                    if want[y, x] and 2 <= sum(p) <= 6 and turns == 1 and not one and not two:
                        gone.append((y, x))
            for at in gone:
                want[at] = 0
            second = bool(gone)
        if not second:
            break
    assert (lines.thin(mask) == want).all()


@given(small_masks)
@settings(max_examples=100, deadline=None)
def test_centre_lines_cover_each_edge_once(mask):
    """Chains run between ends and junctions, use every pair of neighbours just once, and come in scan order."""
    skeleton = lines.thin(mask)
    at = set(zip(*np.nonzero(skeleton)))
    around = {p: [q for q in at if q != p and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1] for p in at}
    found = [([(y, x) for x, y in points], closed) for points, closed in lines.centre_lines(skeleton)]
    edges = [frozenset(e) for points, _ in found for e in zip(points, points[1:])]
    assert sorted(map(sorted, edges)) == sorted(sorted(e) for e in {frozenset((p, q)) for p in at for q in around[p]})
    for points, closed in found:
        assert all(len(around[p]) == 2 for p in points[1:-1])
        assert (points[0] == points[-1] and len(around[points[0]]) == 2) if closed else all(len(around[p]) != 2 for p in (points[0], points[-1]))
    starts = [(closed, points[:2]) for points, closed in found]
    assert starts == sorted(starts)


def test_strokes_of_a_region_do_not_depend_on_the_canvas():
    mask = np.zeros((40, 50), np.uint8)
    mask[0:9, 3:6] = mask[7:10, 0:20] = mask[20:30, 44:50] = 1
    for region in masks.regions(mask.astype(bool)).members():
        alone = np.zeros(mask.size, np.uint8)
        alone[region] = 1
        assert lines.thin_lines(mask.shape, region) == lines.centre_lines(lines.thin(alone.reshape(mask.shape)))


def test_boxes_of_paths():
    assert lines.path_box("M 1,2 L 4,-3") == (1, -3, 4, 2)
    assert lines.path_box("M 0,0 C 0,10 10,10 10,0 Z") == pytest.approx((0, 0, 10, 7.5))
    assert lines.path_box("M 0,0 C 0,4 4,4 4,0 C 4,-4 0,-4 0,0 Z M 9,9 L 10,10") == pytest.approx((0, -3, 10, 10))
    t, rng = np.linspace(0, 1, 2001), np.random.default_rng(1)
    for _ in range(50):
        c = np.round(rng.normal(size=(4, 2)) * 10, 2)
        on = lines._bezier(c, t)
        path = "M {},{} C {},{} {},{} {},{}".format(*c.ravel().tolist())
        assert lines.path_box(path) == pytest.approx((*on.min(axis=0), *on.max(axis=0)), abs=1e-3)


def test_fills_and_strokes_against_plain_loops():
    rng = np.random.default_rng(4)
    for _ in range(30):
        rings = [rng.uniform(-3, 15, (rng.integers(3, 7), 2)) for _ in range(2)]
        got = render.fill_mask([(r, True) for r in rings], 12, 10)
        lines_ = [(rng.uniform(0, 12, (3, 2)), bool(rng.integers(2)))]
        drawn = render.stroke_mask(lines_, 2.5, 12, 10)
        for y in range(12):
            for x in range(10):
                p, inside, near = np.array([x + 0.5, y + 0.5]), False, np.inf
                for ring in rings:
                    for a, b in zip(ring, np.roll(ring, -1, axis=0)):
                        if (a[1] <= p[1]) != (b[1] <= p[1]) and a[0] + (p[1] - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) <= p[0]:
                            inside = not inside
                for points, closed in lines_:
                    for a, b in list(zip(points, points[1:])) + [(points[-1], points[0])] * closed:
                        t = np.clip((p - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1)
                        near = min(near, np.hypot(*(p - a - t * (b - a))))
                assert got[y, x] == inside and drawn[y, x] == (near <= 1.25)


def test_a_drawn_picture_is_read_back_by_another_reader(spark, tmp_path):
    square, hole = "M 1,1 L 7,1 L 7,5 L 1,5 Z", "M 3,2 L 5,2 L 5,4 L 3,4 Z"
    rows = [(1, "outline", 0, "stroke", "#000000", 1.0, None, "M 0,0 L 8,0"), (1, "shadow", 0, "fill", "#ff0000", None, 0.5, "M 0,0 L 8,0 L 8,6 L 0,6 Z"), (1, "base-colors", 0, "fill", "#0000ff", None, None, f"{square} {hole}"), (1, "base-colors", 1, "fill", "#ffffff", None, None, "")]
    items = spark.createDataFrame(rows, "image_id long, layer string, ord int, mode string, color string, stroke_width double, opacity double, d string")
    sizes = spark.createDataFrame([(1, 8, 6), (2, 3, 3)], "image_id long, w int, h int")
    made = {r.image_id: bytes(r.png) for r in svg.render_png(items, sizes).collect()}
    rgba = render.render([r[3:] for r in (rows[1], rows[2], rows[0])], 8, 6)
    assert rgba[6, 8].tolist() == [255, 0, 0, 128] and rgba[3, 3].tolist() == [0, 0, 255, 255] and rgba[0, 5].tolist() == [0, 0, 0, 255]
    for k, data in made.items():
        (tmp_path / f"{k}.png").write_bytes(data)
    found, bad = images.read_images(spark, str(tmp_path))
    got = {r.image_id: np.frombuffer(r.rgb, np.uint8).reshape(r.h, r.w, 3) for r in found.collect()}
    assert (got[0] == rgba[..., :3]).all() and got[1].shape == (6, 6, 3) and bad.count() == 0


def test_area_means_and_cubic_weights():
    rgb = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3) * 3
    want = rgb.reshape(2, 2, 3, 2, 3).astype(float).mean(axis=(1, 3))
    assert (filters.resized(rgb, 0.5) == np.floor(want + 0.5)).all()
    for n, m in ((7, 3), (9, 4), (10, 10)):
        assert filters.area_weights(n, m).sum(axis=1) == pytest.approx(np.ones(m)) and filters.area_weights(n, m).sum(axis=0) == pytest.approx(np.full(n, m / n))
    # Golden: Keys' kernel with slope -0.75 a quarter past a cell.
    assert filters.cubic_weights(8, 16)[7][2:6].tolist() == pytest.approx([-0.10546875, 0.87890625, 0.26171875, -0.03515625])
    assert filters.cubic_weights(5, 11).sum(axis=1) == pytest.approx(np.ones(11))
    flat = np.full((5, 4, 3), 77, np.uint8)
    assert (filters.resized(flat, 2.0) == 77).all() and filters.resized(flat, 2.0).shape == (10, 8, 3) and filters.resized(flat, 1.005) is flat
    assert [filters.scale_factor(*a) for a in ((48, 60, None), (1200, 10, None), (3000, 10, None), (1000, 10, 3.0))] == [2.0, 1.0, 2200 / 3000, 2.2]


def test_median_and_bilateral_against_plain_loops():
    rng = np.random.default_rng(2)
    for h, w in ((1, 1), (2, 5), (6, 7)):
        rgb = rng.integers(0, 256, (h, w, 3)).astype(np.uint8)
        inside = lambda v, n: min(max(v, 0), n - 1)
        mirror = lambda v, n: inside(-v if v < 0 else 2 * (n - 1) - v if v >= n else v, n)
        for y in range(h):
            for x in range(w):
                around = [rgb[inside(y + dy, h), inside(x + dx, w)] for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
                assert filters.median3(rgb)[y, x].tolist() == np.median(around, axis=0).astype(int).tolist()
                if min(h, w) > 2:
                    total, mass = np.zeros(3), 0.0
                    for dy in range(-2, 3):
                        for dx in range(-2, 3):
                            if dy * dy + dx * dx <= 4:
                                there = rgb[mirror(y + dy, h), mirror(x + dx, w)].astype(int)
                                apart = np.abs(there - rgb[y, x].astype(int)).sum()
                                weight = np.exp(-0.5 * (dy * dy + dx * dx) / 1600) * np.exp(-0.5 * apart * apart / 1600)
                                total, mass = total + weight * there, mass + weight
                    assert np.abs(filters.bilateral(rgb)[y, x] - total / mass).max() <= 0.51
    edge = np.zeros((8, 8, 3), np.uint8)
    edge[:, 4:] = 255
    assert (filters.bilateral(edge) == edge).all()


def test_merge_folds_a_small_close_region_and_leaves_a_far_one():
    labels = np.zeros((12, 12), int)
    labels[2:4, 2:4], labels[8:10, 8:10] = 1, 2
    centers = np.array([[50.0, 0, 0], [55.0, 0, 0], [90.0, 0, 0]])
    merged = clusters.merge_small(labels, centers, 0.01)
    assert (merged[2:4, 2:4] == 0).all() and (merged[8:10, 8:10] == 2).all()


def test_kmeans_of_few_colours_is_exact():
    points = np.repeat(np.array([[0, 0, 0], [50, 10, 0], [90, 0, 40]], float), 20, axis=0)
    own, centers = clusters.kmeans(points, 5)
    assert len(set(own[:20])) == len(set(own[20:40])) == len(set(own[40:])) == 1 and len(set(own)) == 3
    assert clusters.kmeans(points[:0], 5)[1].shape == (0, 3)


def test_curves_stay_close_to_a_circle():
    t = np.linspace(0, 2 * np.pi, 60)
    points = list(zip(50 + 40 * np.cos(t), 50 + 40 * np.sin(t)))
    curves = lines.fit_curves(points, 1.0)
    on = np.concatenate([lines._bezier(c, np.linspace(0, 1, 30)) for c in curves])
    assert len(curves) < 12 and np.abs(np.hypot(on[:, 0] - 50, on[:, 1] - 50) - 40).max() < 1.5


def test_path_texts():
    assert lines.path_text([(0, 0)], False, 1) == ""
    assert lines.path_text([(0, 0), (1.005, 2)], False, 1) == "M 0,0 L 1,2"
    assert lines.path_text([(0, 0), (10, 0), (10, 10)], True, 1).endswith(" Z")


def test_sizes_and_names(spark):
    sizes = spark.createDataFrame([(1023,), (1024,), (1048576,)], "n long").select(scalars.file_size(F.col("n"))).collect()
    assert [r[0] for r in sizes] == ["1023 B", "1.0 KB", "1.00 MB"]
    made = spark.createDataFrame([("a.b.png",), (".png",), ("noext",)], "n string").select(scalars.vector_name(F.col("n"))).collect()
    assert [r[0] for r in made] == ["a.b_vector.svg", ".png_vector.svg", "noext_vector.svg"]


@pytest.mark.parametrize(("given_names", "want"), [(["a.svg"] * 3, ["a.svg", "a(2).svg", "a(3).svg"]), (["a(2).svg", "a.svg", "a.svg"], ["a(2).svg", "a.svg", "a(3).svg"])])
def test_unique_names(spark, given_names, want):
    rows = spark.createDataFrame([(0, i, n) for i, n in enumerate(given_names)], "batch long, ord long, name string")
    assert [r["unique_name"] for r in names.unique_names(rows).orderBy("ord").collect()] == want


@pytest.mark.parametrize(("smoothing", "diagonal", "want"), [(48, 67.882251, (0.6, 1.32)), (48, 1414.213562, (2.71529, 5.973638)), (75, 3111.269837, (9.33381, 20.534381)), (0, 100, (0.6, 1.32))])
def test_tolerances(spark, smoothing, diagonal, want):
    row = spark.range(1).select(*scalars.tolerances(F.lit(float(smoothing)), F.lit(float(diagonal)))).first()
    assert tuple(row) == pytest.approx(want, abs=1e-5)


def test_picture_goldens(spark, data_dir):
    def work(image_id, rgb):
        m = prepare.prepare(rgb)
        yield image_id, *(int(v.sum()) for v in (m.background, m.product, m.shadow))

    pictures = fixtures.pictures(spark, data_dir).where("image_id in (0, 20)")
    got = {r[0]: tuple(r)[1:] for r in per_picture(pictures, work, "image_id long, b long, p long, s long").collect()}
    # The second picture is 12 columns of background wider than 48 x 48.
    assert got == {0: (1530, 693, 81), 20: (1362 + 12 * 48, 922, 20)}
    assert pixels(pictures).count() == 48 * 48 + 60 * 48


def test_tiny_and_empty_pictures():
    for h, w in ((1, 1), (1, 4), (2, 2), (3, 1)):
        for value in (0, 255):
            rgb = np.full((h, w, 3), value, np.uint8)
            m = prepare.prepare(rgb)
            assert (m.background.astype(int) + m.product + m.shadow == 1).all()
            assert isinstance(layer_items(smoothed(rgb, Options()), Options()), list)
    assert white.thickness(np.zeros((3, 3), bool)) == [] and white.extent(np.zeros((3, 3), bool)) == (0, 3)


def test_distance_of_a_full_mask_is_minus_one():
    assert (masks.distance(np.ones((4, 4), bool)) == -1).all()


def test_positions_in_many_ranges(spark):
    rows = [(k * 7919 % 1000, f"s{k % 10}") for k in range(1000)]
    df = spark.createDataFrame([*rows, (None, "n")], "v long, s string").repartition(7)
    got = with_position(df, F.col("v").asc_nulls_last()).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1001)) and [r.v for r in got] == [*range(1000), None]


def test_layers_of_a_plain_picture():
    rgb = np.full((40, 40, 3), 255, np.uint8)
    rgb[5:35, 5:35] = (180, 90, 80)
    items = layer_items(rgb, PRESETS["illustration"])
    assert {i[0] for i in items} == {"base-colors", "outline"}


def test_working_size_is_in_the_svg(spark):
    rgb = np.full((30, 40, 3), 255, np.uint8)
    rgb[5:25, 5:35] = (180, 90, 80)
    pictures = spark.createDataFrame([(1, 40, 30, bytearray(rgb.tobytes()))], images.PICTURE)
    twice, once = (vectorize(pictures, build_options("icon", upscale=u)).first()["svg"] for u in (None, 1.0))
    assert 'width="80" height="60"' in twice and 'width="40" height="30"' in once


def test_options_of_requests(spark):
    asked = spark.createDataFrame([("icon", None, None), ("poster", 9, None), (None, None, 2.5)], "preset string, num_colors int, thick_line_radius_px double")
    got = {r.preset: (r.num_colors, r.smoothing, r.thick_line_radius_px, r.denoise) for r in resolve(asked, preset_table(spark)).collect()}
    assert got == {"icon": (5, 75.0, None, True), "poster": (9, 48.0, None, True), None: (14, 48.0, 2.5, True)}


def test_options():
    assert build_options("nothing") == PRESETS["illustration"]
    assert build_options("icon", num_colors=7, smoothing=None).num_colors == 7


def test_images_round_trip_and_bad_files(spark, tmp_path):
    width, height = 3, 2
    body = b"".join(bytes((30 * x, 20, 200 + y)) for y in reversed(range(height)) for x in range(width) if True)
    lines_ = [body[i * 9 : i * 9 + 9] + b"\0" * 3 for i in range(height)]
    data = b"".join(lines_)
    head = b"BM" + (54 + len(data)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + width.to_bytes(4, "little") + height.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    (tmp_path / "a.bmp").write_bytes(head + info + data)
    (tmp_path / "b.png").write_bytes(b"no picture")
    (tmp_path / "c d+e%.bmp").write_bytes(head + info + data)
    found, bad = images.read_images(spark, str(tmp_path))
    rows = found.orderBy("image_id").collect()
    assert [(r.image_id, r.path.split("/")[-1]) for r in rows] == [(0, "a.bmp"), (2, "c d+e%.bmp")]
    got = {(r.x, r.y): (r.r, r.g, r.b) for r in pixels(found.where("image_id = 0")).collect()}
    assert got == {(x, y): (200 + y, 20, 30 * x) for x in range(width) for y in range(height)}
    assert [r.path.endswith("b.png") for r in bad.collect()] == [True]


def test_intake_rejects_file_by_file_and_writes_svgs(spark, tmp_path):
    files = spark.createDataFrame([("a.png", ""), ("b.txt", ""), ("c.JPG", "image/jpeg"), ("d.png", "text/html"), ("e.png", None)], "name string, mime string")
    good, bad = images.split_supported(files)
    assert {r.name for r in good.collect()} == {"a.png", "c.JPG"} and {r.name for r in bad.collect()} == {"b.txt", "d.png", "e.png"}
    numbered = {r.name: (r.job_id, r.status) for r in images.jobs(good, F.col("name"), 17).collect()}
    assert numbered == {"a.png": ("job-1-17", "pending"), "c.JPG": ("job-2-17", "pending")}
    images.write_svgs(spark.createDataFrame([("a_vector.svg", "<svg/>"), ("c_vector.svg", "<svg></svg>")], "name string, svg string"), f"{tmp_path}/out")
    back = spark.read.text(f"{tmp_path}/out").collect()
    assert {(r.name, r.value) for r in back} == {("a_vector.svg", "<svg/>"), ("c_vector.svg", "<svg></svg>")}
    assert [r.name for r in images.list_files(spark, f"{tmp_path}/out").where("length > 9").collect()][0].startswith("part-")


def test_zip_archives(spark):
    rows = spark.createDataFrame([(1, "a.svg", "<svg/>"), (1, "b.svg", "<svg></svg>")], "batch long, name string, svg string")
    archive = images.zip_archives(rows).first()["archive"]
    assert zipfile.ZipFile(io.BytesIO(bytes(archive))).namelist() == ["a.svg", "b.svg"]


def test_stream_of_files(spark, tmp_path):
    from rasterloom.streaming.queue import convert, watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(b"1")
    (tmp_path / "in/b.txt").write_bytes(b"2")
    query = convert(watch(spark, str(tmp_path / "in")), lambda b: b.select("name", "length"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert [r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a.png"]
