"""One query for each operator over pictures, with DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import color as C
from .functions import names
from .functions import scalars as S
from .kernels import clusters as K
from .kernels import lines as L
from .kernels import masks as M
from .kernels import prepare as P
from .kernels import white as W
from .kernels.color import lab as lab_of
from .kernels.filters import bilateral, median3 as median_of, resized
from .operators import segment as G
from .operators import svg as V
from .operators.pictures import per_picture
from .plans.options import Options, build_options, preset_table, resolve
from .plans.vectorize import vectorize, vectorize_layers
from .sources.fixtures import pictures
from .sources.images import jobs, split_supported
from .streaming.queue import job_status

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Trial centres in Lab, two of them of one hue family, with white and black ones.
CENTERS = ((96.5, 0.0, 0.0), (3.3, 0.0, 0.0), (34.0, 40.0, 22.0), (22.0, 34.0, 15.0), (60.0, -30.0, 40.0), (80.6, 0.0, 0.0))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c) -> Column:
    c = F.round(c, 6)
    return F.when(c == 0, F.lit(0.0)).otherwise(c)


R_SQL = """
img AS (SELECT p_partkey AS image_id, p_partkey // 6 % 2 AS odd, CAST(p_size AS BIGINT) AS sz, 10 + p_size % 6 AS hw, CAST(48 + 6 * (p_partkey % 3) AS INT) AS w, CAST(48 + 6 * (p_partkey % 2) AS INT) AS h FROM part),
grid AS (SELECT img.*, x.i AS x, y.i AS y, abs(x.i - 24) AS dx FROM img, range(60) x(i), range(54) y(i) WHERE x.i < w AND y.i < h),
rule AS (SELECT *, CASE WHEN y BETWEEN 42 AND 44 AND dx <= hw + 3 AND odd = 0 THEN 200 WHEN y BETWEEN 38 AND 39 AND dx <= hw + 6 AND odd = 1 THEN 200
  WHEN NOT (dx <= hw AND y BETWEEN 6 AND 38) THEN 255 WHEN dx = hw OR y = 6 OR y = 38 THEN 12 WHEN y BETWEEN 33 AND 37 THEN 245 WHEN x BETWEEN 16 AND 20 AND y BETWEEN 10 AND 14 THEN 245
  WHEN y = 22 AND x BETWEEN 26 AND 29 THEN 245 WHEN x = 18 AND y BETWEEN 18 AND 28 THEN 245 WHEN x = 31 AND y = 12 THEN -1 WHEN x > 24 THEN -2 ELSE -1 END AS c FROM grid),
px AS (SELECT image_id, w, h, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(w * y + x AS BIGINT) AS idx,
  CAST(CASE c WHEN -1 THEN 120 + sz % 50 WHEN -2 THEN 60 + sz % 50 ELSE c END AS INT) AS r, CAST(CASE c WHEN -1 THEN 20 + sz WHEN -2 THEN 10 ELSE c END AS INT) AS g,
  CAST(CASE c WHEN -1 THEN 30 WHEN -2 THEN 15 ELSE c END AS INT) AS b FROM rule)"""
SAT = "CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / CAST(greatest(r, g, b) AS DOUBLE) END"
BORDER = "(x = 0 OR y = 0 OR x = w - 1 OR y = h - 1)"


def comp_sql(name: str, mark: str, source: str, corner: int = 0) -> str:
    """CTEs that give {name}: the marked pixels of source with comp, the least idx of their region; with corner 1, pixels that meet at a corner are one region.

    Runs of rows are walked from those without a run above; a region's first run is one of them.
    """
    return f"""
{name}_g AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS grp FROM {source} WHERE {mark}),
{name}_r AS (SELECT image_id, y, grp, min(x) AS xs, max(x) AS xe, min(idx) AS rid FROM {name}_g GROUP BY ALL),
{name}_d AS (SELECT a.image_id, a.rid AS u, b.rid AS v FROM {name}_r a JOIN {name}_r b ON a.image_id = b.image_id AND b.y = a.y + 1 AND a.xs <= b.xe + {corner} AND b.xs <= a.xe + {corner}),
{name}_e AS (SELECT * FROM {name}_d UNION ALL SELECT image_id, v, u FROM {name}_d),
{name}_c(image_id, rid, root) AS (SELECT image_id, rid, rid FROM {name}_r r WHERE NOT EXISTS (SELECT 1 FROM {name}_d d WHERE d.image_id = r.image_id AND d.v = r.rid)
  UNION SELECT c.image_id, e.v, c.root FROM {name}_c c JOIN {name}_e e ON e.image_id = c.image_id AND e.u = c.rid),
{name}_m AS (SELECT image_id, rid, min(root) AS comp FROM {name}_c GROUP BY ALL),
{name} AS (SELECT p.*, m.comp FROM {name}_g p JOIN {name}_r r USING (image_id, y, grp) JOIN {name}_m m ON m.image_id = r.image_id AND m.rid = r.rid)"""


BG_SQL = f"""{R_SQL},
bg AS (SELECT image_id, avg(r) AS br, avg(g) AS bgr, avg(b) AS bb FROM px WHERE (x IN (1, w - 2) AND y IN (1, h - 2)) OR (x = w // 2 AND y = 1) OR (x = 1 AND y = h // 2) GROUP BY image_id),
near AS (SELECT px.* FROM px JOIN bg USING (image_id) WHERE sqrt((r - br) ** 2 + (g - bgr) ** 2 + (b - bb) ** 2) < 15), {comp_sql("bc", "true", "near")},
edge AS (SELECT image_id, comp FROM bc GROUP BY ALL HAVING bool_or{BORDER}),
bgpx AS (SELECT image_id, idx FROM bc JOIN edge USING (image_id, comp)),
fgpx AS (SELECT * FROM px ANTI JOIN bgpx USING (image_id, idx)), {comp_sql("fc", "true", "fgpx")},
fstat AS (SELECT image_id, comp, any_value(w) AS w, any_value(h) AS h, count(*) AS n, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, bool_or{BORDER} AS touches_border, avg({SAT}) AS sat,
  row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, comp) AS rk, row_number() OVER (PARTITION BY image_id ORDER BY comp) - 1 AS number FROM fc GROUP BY image_id, comp),
kind AS (SELECT *, CASE WHEN rk = 1 THEN 'product' WHEN n < w * h * 0.0006::DOUBLE THEN 'speck' WHEN sat < 0.18 AND (min_y + max_y) / 2.0 > h / 2.0::DOUBLE * 0.7::DOUBLE THEN 'shadow' ELSE 'product' END AS kind FROM fstat),
split AS (SELECT fc.*, kind FROM fc JOIN kind USING (image_id, comp)),
rows_ AS (SELECT image_id, h, y, min(x) AS row_min, max(x) AS row_max FROM split WHERE kind = 'product' GROUP BY ALL),
wid AS (SELECT image_id, row_max - row_min AS wd, row_number() OVER (PARTITION BY image_id ORDER BY row_max - row_min) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS c FROM rows_ WHERE y >= floor(h * 0.15::DOUBLE) AND y < floor(h * 0.7::DOUBLE)),
med AS (SELECT image_id, max(wd) FILTER (WHERE i = c // 2) AS median_width FROM wid GROUP BY image_id),
last_ AS (SELECT image_id, max(y) AS last_row FROM rows_ GROUP BY image_id),
wide AS (SELECT r.image_id, y, row_min, row_max, (row_max - row_min - median_width * CAST(1.1 AS DOUBLE)) / 2 AS excess FROM rows_ r JOIN med USING (image_id)
  WHERE median_width > 0 AND y >= floor(h * 0.55::DOUBLE) AND row_max - row_min > median_width * CAST(1.1 AS DOUBLE)),
carved AS (SELECT px.image_id, px.idx FROM px JOIN wide USING (image_id, y) WHERE x BETWEEN row_min AND row_max AND least(x - row_min, row_max - x) <= excess AND {SAT} < 0.18),
masks AS (SELECT px.*, b.idx IS NOT NULL AS is_background, coalesce(s.kind = 'product', false) AND c.idx IS NULL AS is_product, coalesce(s.kind = 'shadow', false) OR c.idx IS NOT NULL AS is_shadow
  FROM px LEFT JOIN bgpx b ON b.image_id = px.image_id AND b.idx = px.idx LEFT JOIN split s ON s.image_id = px.image_id AND s.idx = px.idx LEFT JOIN carved c ON c.image_id = px.image_id AND c.idx = px.idx)"""


def _at(mask: np.ndarray) -> tuple[int, int]:
    """Number and sum of the flat indices of marked pixels."""
    at = np.flatnonzero(mask)
    return len(at), int(at.sum())


@query(f"WITH {R_SQL} SELECT image_id, count(*) AS pixels, CAST(sum(CAST(r AS BIGINT) * 65536 + g * 256 + b) AS BIGINT) AS rgb_sum, CAST(sum((CAST(r AS BIGINT) * 65536 + g * 256 + b) * (idx + 1)) AS BIGINT) AS rgb_mark FROM px GROUP BY image_id")
def raster_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(image_id, rgb):
        v = rgb.reshape(-1, 3).astype(np.int64) @ (65536, 256, 1)
        yield image_id, len(v), int(v.sum()), int(v @ np.arange(1, len(v) + 1))

    return per_picture(pictures(spark, sf_dir), work, "image_id long, pixels long, rgb_sum long, rgb_mark long")


@query(f"WITH RECURSIVE {BG_SQL} SELECT image_id, br AS bg_r, bgr AS bg_g, bb AS bg_b FROM bg")
def bg_color(spark, sf_dir):
    return per_picture(pictures(spark, sf_dir), lambda i, rgb: [(i, *P.background_color(rgb).tolist())], "image_id long, bg_r double, bg_g double, bg_b double")


@query(f"WITH RECURSIVE {BG_SQL} SELECT image_id, count(*) AS n, CAST(sum(idx) AS BIGINT) AS idx_sum FROM bgpx GROUP BY image_id")
def bg_mask(spark, sf_dir):
    return per_picture(pictures(spark, sf_dir), lambda i, rgb: [(i, *_at(P.background(rgb)))], "image_id long, n long, idx_sum long")


@query(f"WITH RECURSIVE {BG_SQL} SELECT image_id, comp AS min_idx, n, min_x, min_y, max_x, max_y, touches_border, CAST(number AS INT) AS number FROM fstat")
def components(spark, sf_dir):
    def work(image_id, rgb):
        parts = M.regions(~P.background(rgb))
        for k, (first, n, box, edge) in enumerate(zip(parts.first.tolist(), parts.n.tolist(), parts.boxes().T.tolist(), parts.touching().tolist())):
            yield image_id, first, n, *box, edge, k

    return per_picture(pictures(spark, sf_dir), work, "image_id long, min_idx long, n long, min_x int, min_y int, max_x int, max_y int, touches_border boolean, number int")


@query(f"WITH RECURSIVE {BG_SQL} SELECT image_id, comp AS min_idx, n, round(sat, 6) AS mean_saturation, kind FROM kind")
def product_shadow_split(spark, sf_dir):
    def work(image_id, rgb):
        found = P.foreground(rgb, P.background(rgb))
        yield from zip([image_id] * len(found.kind), found.regions.first.tolist(), found.regions.n.tolist(), found.saturation.tolist(), found.kind)

    out = per_picture(pictures(spark, sf_dir), work, "image_id long, min_idx long, n long, mean_saturation double, kind string")
    return out.withColumn("mean_saturation", r6("mean_saturation"))


@query(f"WITH RECURSIVE {BG_SQL} SELECT image_id, median_width, last_row, y, row_min, row_max FROM rows_ JOIN med USING (image_id) JOIN last_ USING (image_id)")
def row_extents_median(spark, sf_dir):
    def work(image_id, rgb):
        found = P.foreground(rgb, P.background(rgb))
        product = found.regions.paint(found.kind == "product", False)
        rows = P.extents(product)
        for y, low, high in zip(*(v.tolist() for v in rows)):
            yield image_id, P.median_width(product), int(rows[0][-1]), y, low, high

    return per_picture(pictures(spark, sf_dir), work, "image_id long, median_width int, last_row int, y int, row_min int, row_max int")


@query(f"""WITH RECURSIVE {BG_SQL} SELECT image_id, CAST(sum(is_background::INT) AS BIGINT) AS background_px, CAST(sum(is_product::INT) AS BIGINT) AS product_px, CAST(sum(is_shadow::INT) AS BIGINT) AS shadow_px,
CAST(coalesce(sum(idx) FILTER (WHERE is_shadow), 0) AS BIGINT) AS shadow_idx FROM masks GROUP BY image_id""")
def carve_shadow(spark, sf_dir):
    def work(image_id, rgb):
        m = P.prepare(rgb)
        yield image_id, int(m.background.sum()), int(m.product.sum()), *_at(m.shadow)

    return per_picture(pictures(spark, sf_dir), work, "image_id long, background_px long, product_px long, shadow_px long, shadow_idx long")


LAB_SQL = """
lin AS (SELECT *, CASE WHEN r / 255.0::DOUBLE > 0.04045 THEN ((r / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE) ** 2.4::DOUBLE ELSE r / 255.0::DOUBLE / 12.92::DOUBLE END AS lr,
  CASE WHEN g / 255.0::DOUBLE > 0.04045 THEN ((g / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE) ** 2.4::DOUBLE ELSE g / 255.0::DOUBLE / 12.92::DOUBLE END AS lg,
  CASE WHEN b / 255.0::DOUBLE > 0.04045 THEN ((b / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE) ** 2.4::DOUBLE ELSE b / 255.0::DOUBLE / 12.92::DOUBLE END AS lb FROM {src}),
xyz AS (SELECT *, (lr * 0.4124::DOUBLE + lg * 0.3576::DOUBLE + lb * 0.1805::DOUBLE) / 0.95047::DOUBLE AS cx, lr * 0.2126::DOUBLE + lg * 0.7152::DOUBLE + lb * 0.0722::DOUBLE AS cy,
  (lr * 0.0193::DOUBLE + lg * 0.1192::DOUBLE + lb * 0.9505::DOUBLE) / 1.08883::DOUBLE AS cz FROM lin),
fxyz AS (SELECT *, CASE WHEN cx > 0.008856 THEN cbrt(cx) ELSE 7.787::DOUBLE * cx + 16.0::DOUBLE / 116 END AS fx, CASE WHEN cy > 0.008856 THEN cbrt(cy) ELSE 7.787::DOUBLE * cy + 16.0::DOUBLE / 116 END AS fy,
  CASE WHEN cz > 0.008856 THEN cbrt(cz) ELSE 7.787::DOUBLE * cz + 16.0::DOUBLE / 116 END AS fz FROM xyz),
lab AS (SELECT *, 116 * fy - 16 AS dl, 500 * (fx - fy) AS da, 200 * (fy - fz) AS db FROM fxyz)"""
HEX_SQL = """
h1 AS (SELECT *, (l + 16) / 116.0::DOUBLE AS hy, (l + 16) / 116.0::DOUBLE + a / 500.0::DOUBLE AS hx, (l + 16) / 116.0::DOUBLE - b / 200.0::DOUBLE AS hz FROM {src}),
h2 AS (SELECT *, CASE WHEN hx ** 3 > 0.008856 THEN hx ** 3 ELSE (hx - 16.0::DOUBLE / 116) / 7.787::DOUBLE END * 0.95047::DOUBLE AS vx, CASE WHEN hy ** 3 > 0.008856 THEN hy ** 3 ELSE (hy - 16.0::DOUBLE / 116) / 7.787::DOUBLE END AS vy,
  CASE WHEN hz ** 3 > 0.008856 THEN hz ** 3 ELSE (hz - 16.0::DOUBLE / 116) / 7.787::DOUBLE END * 1.08883::DOUBLE AS vz FROM h1),
h3 AS (SELECT *, [vx * 3.2406::DOUBLE - vy * 1.5372::DOUBLE - vz * 0.4986::DOUBLE, vy * 1.8758::DOUBLE - vx * 0.9689::DOUBLE + vz * 0.0415::DOUBLE, vx * 0.0557::DOUBLE - vy * 0.204::DOUBLE + vz * 1.057::DOUBLE] AS v FROM h2),
h4 AS (SELECT *, '#' || array_to_string([printf('%02x', CAST(greatest(0, least(255, floor(CASE WHEN c > 0.0031308 THEN 1.055::DOUBLE * c ** (1 / 2.4::DOUBLE) - 0.055::DOUBLE ELSE 12.92::DOUBLE * c END * 255 + 0.5))) AS INT)) for c in v], '') AS hex FROM h3)"""


def _colors(spark, sf_dir):
    """The distinct colours of all pictures; each picture sends its own once."""

    def work(_, rgb):
        found = np.unique(rgb.reshape(-1, 3).astype(np.int64) @ (65536, 256, 1))
        yield from zip((found >> 16).tolist(), (found >> 8 & 255).tolist(), (found & 255).tolist())

    return per_picture(pictures(spark, sf_dir), work, "r int, g int, b int").distinct()


@query(f"WITH {R_SQL}, col AS (SELECT DISTINCT r, g, b FROM px), {LAB_SQL.format(src='col')} SELECT r, g, b, round(dl, 6) AS l, round(da, 6) AS a_, round(db, 6) AS b_, round(CAST(CAST(dl AS FLOAT) AS DOUBLE), 4) AS l32, round({SAT}, 6) AS saturation, round(sqrt(da * da + db * db), 6) AS chroma FROM lab")
def lab_colors(spark, sf_dir):
    l, a, b = C.lab("r", "g", "b")
    rows = _colors(spark, sf_dir)
    return rows.select("r", "g", "b", r6(l).alias("l"), r6(a).alias("a_"), r6(b).alias("b_"), F.round(l.cast("float").cast("double"), 4).alias("l32"), r6(C.saturation()).alias("saturation"), r6(F.hypot(a, b)).alias("chroma"))


@query(f"WITH {R_SQL}, col AS (SELECT DISTINCT r, g, b FROM px), {LAB_SQL.format(src='col')}, lb2 AS (SELECT r AS r0, g AS g0, b AS b0, dl AS l, da AS a, db AS b FROM lab), {HEX_SQL.format(src='lb2')} SELECT r0 AS r, g0 AS g, b0 AS b, hex FROM h4")
def lab_hex(spark, sf_dir):
    l, a, b = C.lab("r", "g", "b")
    return _colors(spark, sf_dir).select("r", "g", "b", l.alias("_l"), a.alias("_a"), b.alias("_b")).select("r", "g", "b", C.hex_of_lab("_l", "_a", "_b").alias("hex"))


@query("""WITH d AS (SELECT s.s AS seed, i.i AS i, (s.s + (i.i + 1) * 1831565813) & 4294967295 AS a FROM (VALUES (0), (42), (4294967295)) s(s), range(1000) i(i)),
m AS (SELECT *, xor(a, a >> 15) AS p, a | 1 AS q FROM d), t1 AS (SELECT *, (p * (q & 65535) + (((p * (q >> 16)) & 65535) * 65536)) & 4294967295 AS t FROM m),
m2 AS (SELECT *, xor(t, t >> 7) AS p2, t | 61 AS q2 FROM t1), t2 AS (SELECT *, xor(t, (t + ((p2 * (q2 & 65535) + (((p2 * (q2 >> 16)) & 65535) * 65536)) & 4294967295)) & 4294967295) AS u FROM m2)
SELECT seed, i, xor(u, u >> 14) / 4294967296.0::DOUBLE AS draw FROM t2""")
def rng_draws(spark, sf_dir):
    seeds = spark.createDataFrame([(0,), (42,), (4294967295,)], "seed long")
    rows = seeds.select("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(999).cast("long"))).alias("i"))
    return rows.select("seed", "i", S.draw(F.col("seed"), F.col("i")).alias("draw"))


CENTER_SQL = "cen(cluster, l, a, b) AS (VALUES " + ", ".join(f"({i}, {l}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE)" for i, (l, a, b) in enumerate(CENTERS)) + ")"
GAPS = [f"((fl::DOUBLE - {l}::DOUBLE) * (fl::DOUBLE - {l}::DOUBLE) + (fa::DOUBLE - {a}::DOUBLE) * (fa::DOUBLE - {a}::DOUBLE) + (fb::DOUBLE - {b}::DOUBLE) * (fb::DOUBLE - {b}::DOUBLE))" for l, a, b in CENTERS]
ASSIGN_SQL = f"""{R_SQL}, {CENTER_SQL}, {LAB_SQL.format(src="px")},
lab32 AS (SELECT image_id, w, h, idx, x, y, CAST(dl AS FLOAT) AS fl, CAST(da AS FLOAT) AS fa, CAST(db AS FLOAT) AS fb FROM lab WHERE r NOT IN (255, 200)),
gap AS (SELECT *, [{", ".join(GAPS)}] AS d FROM lab32),
own AS (SELECT image_id, w, h, idx, x, y, fl, fa, fb, CAST(list_position(d, list_min(d)) - 1 AS INT) AS cluster FROM gap)"""


def _assigned(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label picture, Lab): the nearest trial centre of pixels that are neither white nor gray, -1 for those."""
    colors, labels = lab_of(rgb), np.full(rgb.shape[:2], -1)
    mask = ~np.isin(rgb[..., 0], (255, 200))
    labels[mask] = K.nearest(colors[mask].astype(float), np.array(CENTERS))
    return labels, colors


@query(f"WITH {ASSIGN_SQL} SELECT image_id, cluster, count(*) AS n, CAST(sum(idx) AS BIGINT) AS idx_sum FROM own GROUP BY image_id, cluster")
def kmeans_assign(spark, sf_dir):
    def work(image_id, rgb):
        labels, _ = _assigned(rgb)
        for c in np.unique(labels[labels >= 0]).tolist():
            yield image_id, c, *_at(labels == c)

    return per_picture(pictures(spark, sf_dir), work, "image_id long, cluster int, n long, idx_sum long")


@query(f"WITH {ASSIGN_SQL} SELECT image_id, cluster, count(*) AS n, round(avg(fl::DOUBLE), 6) AS l, round(avg(fa::DOUBLE), 6) AS a, round(avg(fb::DOUBLE), 6) AS b FROM own GROUP BY image_id, cluster")
def kmeans_step(spark, sf_dir):
    def work(image_id, rgb):
        labels, colors = _assigned(rgb)
        for c in np.unique(labels[labels >= 0]).tolist():
            own = colors[labels == c].astype(float)
            yield image_id, c, len(own), *own.mean(axis=0).tolist()

    out = per_picture(pictures(spark, sf_dir), work, "image_id long, cluster int, n long, l double, a double, b double")
    return out.select("image_id", "cluster", "n", *(r6(k).alias(k) for k in "lab"))


def _areas(spark, sf_dir) -> DataFrame:
    """Trial clusters (image_id, cluster, l, a, b, area) of every picture, also those without pixels."""

    def work(image_id, rgb):
        labels, _ = _assigned(rgb)
        count = np.bincount(labels[labels >= 0], minlength=len(CENTERS)).tolist()
        yield from ((image_id, c, *center, n) for c, (center, n) in enumerate(zip(CENTERS, count)))

    return per_picture(pictures(spark, sf_dir), work, "image_id long, cluster int, l double, a double, b double, area long")


@query(f"WITH {ASSIGN_SQL}, n AS (SELECT image_id, cluster, count(*) AS area FROM own GROUP BY ALL) SELECT i.image_id, CAST(c.cluster AS INT) AS cluster, CAST(coalesce(area, 0) AS BIGINT) AS area FROM img i CROSS JOIN cen c LEFT JOIN n ON n.image_id = i.image_id AND n.cluster = c.cluster")
def cluster_area(spark, sf_dir):
    return _areas(spark, sf_dir).select("image_id", "cluster", "area")


@query(f"""WITH RECURSIVE {ASSIGN_SQL}, n AS (SELECT image_id, cluster, count(*) AS area FROM own GROUP BY ALL),
cl AS (SELECT i.image_id, CAST(c.cluster AS INT) AS cluster, l, a, b, coalesce(area, 0) AS area, sqrt(a * a + b * b) AS chroma, l > 62 AND sqrt(a * a + b * b) < 24 AS wh, l < 38 AND sqrt(a * a + b * b) < 22 AS bl
  FROM img i CROSS JOIN cen c LEFT JOIN n ON n.image_id = i.image_id AND n.cluster = c.cluster),
reach(image_id, cluster, root) AS (SELECT image_id, cluster, cluster FROM cl WHERE NOT wh AND NOT bl UNION SELECT q.image_id, q.cluster, r.root FROM reach r JOIN cl p ON p.image_id = r.image_id AND p.cluster = r.cluster
  JOIN cl q ON q.image_id = p.image_id AND NOT q.wh AND NOT q.bl AND sqrt((p.a - q.a) ** 2 + (p.b - q.b) ** 2) < 18),
fam AS (SELECT image_id, cluster, min(root) AS family FROM reach GROUP BY ALL)
SELECT cl.image_id, cl.cluster, CAST(area AS BIGINT) AS area, round(chroma, 6) AS chroma, wh AS is_near_white, bl AS is_near_black, family,
  CASE WHEN wh THEN 'neutral-light' WHEN row_number() OVER (PARTITION BY cl.image_id, wh, bl, family ORDER BY area DESC, cl.cluster) = 1 THEN 'base' ELSE 'shading' END AS role
FROM cl LEFT JOIN fam USING (image_id, cluster)""")
def cluster_roles(spark, sf_dir):
    out = G.cluster_roles(_areas(spark, sf_dir))
    return out.select("image_id", "cluster", "area", r6("chroma").alias("chroma"), "is_near_white", "is_near_black", "family", "role")


def _seed_sql(k: int) -> str:
    """Start centre k: the first point whose share of the squared gaps to the centres before reaches the draw."""
    gaps = ", ".join(f"(l - l{j}) ** 2 + (a - a{j}) ** 2 + (b - b{j}) ** 2" for j in range(k))
    keep = ", ".join(f"l{j}, a{j}, b{j}" for j in range(k))
    return f"""g{k} AS (SELECT *, least({gaps}) AS gap FROM pt JOIN s{k - 1} USING (image_id)), m{k} AS (SELECT *, sum(gap) OVER (PARTITION BY image_id ORDER BY i) AS mass, sum(gap) OVER (PARTITION BY image_id) AS whole FROM g{k}),
s{k} AS (SELECT image_id, {", ".join(f"any_value({c}) AS {c}" for c in keep.split(", "))}, arg_min(l, i) AS l{k}, arg_min(a, i) AS a{k}, arg_min(b, i) AS b{k} FROM m{k} WHERE mass >= whole * {DRAWS[k]!r}::DOUBLE GROUP BY image_id)"""


#: Draws of the seeded generator, held against SQL by rng_draws.
DRAWS = K.Draws(42).take(3).tolist()
_C = [f"{c}{j}" for j in range(3) for c in "lab"]
_OWN = "list_position([{0}], list_min([{0}])) - 1".format(", ".join(f"(l - l{j}) ** 2 + (a - a{j}) ** 2 + (b - b{j}) ** 2" for j in range(3)))
FIT_SQL = f"""WITH RECURSIVE {ASSIGN_SQL},
pt AS (SELECT image_id, fl::DOUBLE AS l, fa::DOUBLE AS a, fb::DOUBLE AS b, row_number() OVER (PARTITION BY image_id ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM lab32),
s0 AS (SELECT image_id, l AS l0, a AS a0, b AS b0 FROM pt WHERE i = CAST(floor(n * {DRAWS[0]!r}::DOUBLE) AS BIGINT)), {_seed_sql(1)}, {_seed_sql(2)},
col AS (SELECT image_id, l, a, b, count(*) AS n FROM pt GROUP BY ALL),
lloyd(image_id, turn, moved, {", ".join(_C)}) AS (SELECT image_id, 0, 1e9::DOUBLE, {", ".join(_C)} FROM s2 UNION ALL
  SELECT image_id, turn + 1, {" + ".join(f"coalesce(sqrt((n{c[0]} - l{c[1]}) ** 2 + (na{c[1]} - a{c[1]}) ** 2 + (nb{c[1]} - b{c[1]}) ** 2), 0)".replace(f"n{c[0]} ", f"nl{c[1]} ") for c in _C[::3])}, {", ".join(f"coalesce(n{c}, {c})" for c in _C)}
  FROM (SELECT image_id, turn, {", ".join(_C)}, {", ".join(f"sum({c[0]} * n) FILTER (WHERE own = {c[1]}) / sum(n) FILTER (WHERE own = {c[1]}) AS n{c}" for c in _C)}
    FROM (SELECT t.*, c.l, c.a, c.b, c.n, {_OWN} AS own FROM lloyd t JOIN col c USING (image_id) WHERE t.turn < 12 AND t.moved >= 0.05) GROUP BY image_id, turn, {", ".join(_C)})),
done AS (SELECT * FROM lloyd QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY turn DESC) = 1),
fin AS (SELECT d.*, c.n, {_OWN} AS own FROM done d JOIN col c USING (image_id))
SELECT image_id, CAST(own AS INT) AS cluster, CAST(sum(n) AS BIGINT) AS area, {", ".join(f"round(any_value(CASE own WHEN 0 THEN {c}0 WHEN 1 THEN {c}1 ELSE {c}2 END), 4) AS {c}" for c in "lab")} FROM fin GROUP BY image_id, own"""


@query(FIT_SQL)
def kmeans_fit(spark, sf_dir):
    """Three clusters of pictures with up to six colours: seeded starts and Lloyd steps until they move less than 0.05."""

    def work(image_id, rgb):
        own, centers = K.kmeans(lab_of(rgb[~np.isin(rgb[..., 0], (255, 200))]), 3)
        for c in np.unique(own).tolist():
            yield image_id, c, int((own == c).sum()), *centers[c].tolist()

    out = per_picture(pictures(spark, sf_dir), work, "image_id long, cluster int, area long, l double, a double, b double")
    tidy = lambda c: F.when(F.round(c, 4) == 0, F.lit(0.0)).otherwise(F.round(c, 4)).alias(c)
    return out.select("image_id", "cluster", "area", *(tidy(c) for c in "lab"))


REGION_SQL = f"WITH RECURSIVE {ASSIGN_SQL}, spx AS (SELECT image_id * 10 + cluster AS image_id, idx, x, y, cluster FROM own), {comp_sql('oc', 'true', 'spx')}, reg AS (SELECT image_id // 10 AS image_id, idx, x, y, cluster, comp AS region FROM oc)"
TALLY_SQL = """tal AS (SELECT a.image_id, a.region, a.cluster, b.cluster AS neighbour, count(*) AS n FROM (SELECT reg.*, x + dx AS nx, y + dy AS ny FROM reg, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy)) a
  JOIN reg b ON b.image_id = a.image_id AND b.x = a.nx AND b.y = a.ny WHERE a.cluster <> b.cluster GROUP BY ALL)"""


def _tallies(spark, sf_dir) -> DataFrame:
    def work(image_id, rgb):
        labels, _ = _assigned(rgb)
        parts = M.regions(labels)
        own = labels.ravel()[parts.first]
        for r, other, n in zip(*(v.tolist() for v in K.tally(labels, parts))):
            yield image_id, int(parts.first[r]), int(own[r]), other, n

    return per_picture(pictures(spark, sf_dir), work, "image_id long, region long, cluster int, neighbour int, n long")


@query(f"{REGION_SQL}, {TALLY_SQL} SELECT image_id, region, cluster, neighbour, n FROM tal")
def border_tally(spark, sf_dir):
    return _tallies(spark, sf_dir)


@query(f"{REGION_SQL}, {TALLY_SQL} SELECT image_id, region, cluster, neighbour, n FROM (SELECT *, row_number() OVER (PARTITION BY image_id, region, cluster ORDER BY n DESC, neighbour) AS rk FROM tal) WHERE rk = 1")
def argmax_neighbour(spark, sf_dir):
    return G.argmax_neighbour(_tallies(spark, sf_dir))


@query()
def merge_small_regions(spark, sf_dir):
    def work(image_id, rgb):
        merged = K.merge_small(_assigned(rgb)[0], np.array(CENTERS), 0.02)
        for c in np.unique(merged[merged >= 0]).tolist():
            yield image_id, c, *_at(merged == c)

    return per_picture(pictures(spark, sf_dir), work, "image_id long, cluster int, area long, idx_sum long")


WHITE = "r = 245"
DARK = "r = 12"


def _stencil_sql(pick: str, radius: int, mark: str) -> str:
    return f"""a AS (SELECT image_id, idx, x, y, ({mark})::INT AS m FROM px), a1 AS (SELECT image_id, idx, x, y, {pick}(m) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS m FROM a),
a2 AS (SELECT image_id, idx, x, y, {pick}(m) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS m FROM a1)"""


def _marked(spark, sf_dir, work) -> DataFrame:
    """(image_id, n, idx_sum) of the pixels that work(rgb) marks; pictures without any have no row."""
    rows = lambda i, rgb: [(i, *found)] if (found := _at(work(rgb)))[0] else []
    return per_picture(pictures(spark, sf_dir), rows, "image_id long, n long, idx_sum long")


def _white(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., 0] == 245


COUNT_SQL = "SELECT image_id, count(*) AS n, CAST(sum(idx) AS BIGINT) AS idx_sum FROM {src} WHERE {mark} GROUP BY image_id"


@query(f"WITH {R_SQL}, {_stencil_sql('min', 1, WHITE)} {COUNT_SQL.format(src='a2', mark='m = 1')}")
def erode(spark, sf_dir):
    return _marked(spark, sf_dir, lambda rgb: M.box(_white(rgb), 1, True))


@query(f"WITH {R_SQL}, {_stencil_sql('max', 2, WHITE)} {COUNT_SQL.format(src='a2', mark='m = 1')}")
def dilate(spark, sf_dir):
    return _marked(spark, sf_dir, lambda rgb: M.box(_white(rgb), 2, False))


OPEN_SQL = _stencil_sql("min", 1, "{mark}") + """, a3 AS (SELECT image_id, idx, x, y, max(m) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM a2),
a4 AS (SELECT image_id, idx, max(m) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM a3)"""


@query(f"WITH {R_SQL}, {OPEN_SQL.format(mark=WHITE)} {COUNT_SQL.format(src='a4', mark='m = 1')}")
def opened(spark, sf_dir):
    return _marked(spark, sf_dir, lambda rgb: M.opened(_white(rgb), 1))


@query(f"WITH {R_SQL}, {OPEN_SQL.format(mark=DARK)}, hl AS (SELECT px.image_id, px.idx FROM px JOIN a4 USING (image_id, idx) WHERE {DARK} AND m = 0) {COUNT_SQL.format(src='hl', mark='true')}")
def hairline_mask(spark, sf_dir):
    return _marked(spark, sf_dir, lambda rgb: (rgb[..., 0] == 12) & ~M.opened(rgb[..., 0] == 12, 1))


DIST_SQL = f"""d1 AS (SELECT *, least(x - coalesce(max(CASE WHEN NOT ({WHITE}) THEN x END) OVER (PARTITION BY image_id, y ORDER BY x), -9999), coalesce(min(CASE WHEN NOT ({WHITE}) THEN x END) OVER (PARTITION BY image_id, y ORDER BY x DESC), 9999) - x) AS dr FROM px),
d2 AS (SELECT image_id, x, y, idx, CAST(least(y + min(dr - y) OVER (PARTITION BY image_id, x ORDER BY y), min(dr + y) OVER (PARTITION BY image_id, x ORDER BY y DESC) - y) AS INT) AS dist FROM d1)"""


@query(f"WITH {R_SQL}, {DIST_SQL} SELECT image_id, dist, count(*) AS n, CAST(sum(idx) AS BIGINT) AS idx_sum FROM d2 GROUP BY image_id, dist")
def distance_l1(spark, sf_dir):
    def work(image_id, rgb):
        far = M.distance(_white(rgb))
        for k in np.unique(far).tolist():
            yield image_id, k, *_at(far == k)

    return per_picture(pictures(spark, sf_dir), work, "image_id long, dist int, n long, idx_sum long")


def _median_sql(source: str, value: str) -> str:
    """CTE med9: the median of 3 x 3 neighbourhoods of a value, the border repeated."""
    row, column = "OVER (PARTITION BY image_id, y ORDER BY x)", "OVER (PARTITION BY image_id, x ORDER BY y)"
    cells = ", ".join(f"coalesce({f}({c}) {row}, {c})" if f else c for c in ("n_", "v", "s_") for f in ("lag", "", "lead"))
    return f"""ns AS (SELECT *, {value} AS v, coalesce(lag({value}) {column}, {value}) AS n_, coalesce(lead({value}) {column}, {value}) AS s_ FROM {source}),
med9 AS (SELECT image_id, idx, CAST(list_sort([{cells}])[5] AS BIGINT) AS m FROM ns)"""


@query(f"WITH {R_SQL}, {_median_sql('px', 'r')} SELECT image_id, CAST(sum(m) AS BIGINT) AS total, CAST(sum(m * (idx + 1)) AS BIGINT) AS mark FROM med9 GROUP BY image_id")
def median3(spark, sf_dir):
    def work(image_id, rgb):
        m = median_of(rgb[..., 0]).ravel().astype(np.int64)
        yield image_id, int(m.sum()), int(m @ np.arange(1, len(m) + 1))

    return per_picture(pictures(spark, sf_dir), work, "image_id long, total long, mark long")


@query(f"""WITH {R_SQL}, half AS (SELECT image_id, w // 2 AS w, x // 2 AS x, y // 2 AS y, CAST(w // 2 * (y // 2) + x // 2 AS BIGINT) AS idx, CAST(floor(avg(r) + 0.5) AS INT) AS r, CAST(floor(avg(g) + 0.5) AS INT) AS g FROM px GROUP BY ALL),
{_median_sql('half', 'r * 256 + g')} SELECT image_id, CAST(sum(m) AS BIGINT) AS total, CAST(sum(m * (idx + 1)) AS BIGINT) AS mark FROM (SELECT image_id, idx, m // 256 AS m FROM med9) GROUP BY image_id""")
def scaled_median(spark, sf_dir):
    """Pictures scaled down by area means, then the median of their red channel."""

    def work(image_id, rgb):
        m = median_of(resized(rgb, 0.5))[..., 0].ravel().astype(np.int64)
        yield image_id, int(m.sum()), int(m @ np.arange(1, len(m) + 1))

    return per_picture(pictures(spark, sf_dir), work, "image_id long, total long, mark long")


@query()
def smoothed(spark, sf_dir):
    """Pictures scaled up by cubic convolution, without specks, smoothed but for their edges."""

    def work(image_id, rgb):
        m = bilateral(median_of(resized(rgb, 2.0)))
        yield image_id, m.shape[1], m.shape[0], int(m.sum(dtype=np.int64)), int(m.ravel().astype(np.int64) @ np.arange(1, m.size + 1))

    return per_picture(pictures(spark, sf_dir), work, "image_id long, w int, h int, total long, mark long")


THICK_SQL = f"""{comp_sql("wc", WHITE, "px")}, {DIST_SQL},
ord AS (SELECT wc.image_id, wc.comp, wc.w, wc.h, dist, wc.x, wc.y, row_number() OVER (PARTITION BY wc.image_id, wc.comp ORDER BY dist) - 1 AS i, count(*) OVER (PARTITION BY wc.image_id, wc.comp) AS n FROM wc JOIN (SELECT image_id, idx, dist FROM d2) d2 USING (image_id, idx)),
thick AS (SELECT image_id, comp, n, w, h, max(dist) FILTER (WHERE i = CAST(floor(n * 0.7::DOUBLE) AS BIGINT)) AS p70, max(dist) AS max_dist, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh, max(y) AS max_y FROM ord GROUP BY ALL)"""


@query(f"WITH RECURSIVE {R_SQL}, {THICK_SQL} SELECT image_id, comp, n, p70, max_dist FROM thick")
def thickness_p70(spark, sf_dir):
    rows = lambda i, rgb: ((i, int(t.pixels[0]), len(t.pixels), t.p70, t.most) for t in W.thickness(_white(rgb)))
    return per_picture(pictures(spark, sf_dir), rows, "image_id long, comp long, n long, p70 int, max_dist int")


EXTENT_SQL = "ext AS (SELECT image_id, coalesce(min(y) FILTER (WHERE is_product), 0) AS lo, coalesce(max(y) FILTER (WHERE is_product), any_value(h)) AS hi FROM masks GROUP BY image_id)"


@query(f"WITH RECURSIVE {BG_SQL}, {EXTENT_SQL} SELECT image_id, lo AS product_min_y, hi AS product_max_y FROM ext")
def product_extent(spark, sf_dir):
    return per_picture(pictures(spark, sf_dir), lambda i, rgb: [(i, *W.extent(P.prepare(rgb).product))], "image_id long, product_min_y int, product_max_y int")


@query(f"""WITH RECURSIVE {BG_SQL}, {EXTENT_SQL}, {THICK_SQL} SELECT image_id, comp, n, p70, max_dist, greatest(2, least(max_dist, p70 * 1.6::DOUBLE) * 2) AS stroke_width,
CASE WHEN p70 * 2 >= greatest(3, h * 0.018::DOUBLE) THEN CASE WHEN max_y >= hi - greatest(1, hi - lo) * 0.16::DOUBLE AND n > w * h * 0.04::DOUBLE THEN 'sole' ELSE 'logo' END
WHEN n < w * h * 0.0018::DOUBLE AND greatest(bw, bh) / greatest(1, least(bw, bh))::DOUBLE > 1.8 THEN 'stitching' ELSE 'laces' END AS kind FROM thick JOIN ext USING (image_id) WHERE n >= 4""")
def white_classes(spark, sf_dir):
    def work(image_id, rgb):
        for t, kind, width in W.classes(_white(rgb), P.prepare(rgb).product, 0.018, 0.0018):
            yield image_id, int(t.pixels[0]), len(t.pixels), t.p70, t.most, width, kind

    return per_picture(pictures(spark, sf_dir), work, "image_id long, comp long, n long, p70 int, max_dist int, stroke_width double, kind string")


_ROW, _COLUMN = "OVER (PARTITION BY image_id, y ORDER BY x)", "OVER (PARTITION BY image_id, x ORDER BY y)"


@query(f"""WITH {R_SQL}, m AS (SELECT image_id, w, h, x, y, idx, (r < 130)::INT AS m FROM px),
v AS (SELECT *, coalesce(lag(m) {_COLUMN}, 0) AS n, coalesce(lead(m) {_COLUMN}, 0) AS s FROM m),
n AS (SELECT *, [n, coalesce(lead(n) {_ROW}, 0), coalesce(lead(m) {_ROW}, 0), coalesce(lead(s) {_ROW}, 0), s, coalesce(lag(s) {_ROW}, 0), coalesce(lag(m) {_ROW}, 0), coalesce(lag(n) {_ROW}, 0)] AS p FROM v),
k AS (SELECT *, m = 1 AND NOT (x BETWEEN 1 AND w - 2 AND y BETWEEN 1 AND h - 2 AND list_sum(p) BETWEEN 2 AND 6 AND list_sum([(p[i] = 0 AND p[i % 8 + 1] = 1)::INT for i in range(1, 9)]) = 1 AND p[1] * p[3] * p[5] = 0 AND p[3] * p[5] * p[7] = 0) AS keep FROM n)
{COUNT_SQL.format(src='k', mark='keep')}""")
def thin_pass(spark, sf_dir):
    return _marked(spark, sf_dir, lambda rgb: L.thin_once(rgb[..., 0] < 130, 0)[0])


def _thin_sql(mark: str) -> str:
    """CTEs that give sk: the marked pixels that full thinning leaves. Each pass tells every pixel its neighbours as bits."""
    return f"""off(o, dx, dy) AS (VALUES (0, 0, 1), (1, -1, 1), (2, -1, 0), (3, -1, -1), (4, 0, -1), (5, 1, -1), (6, 1, 0), (7, 1, 1), (8, 0, 0)),
th(image_id, w, h, x, y, pass, go) AS (SELECT image_id, w, h, x, y, 0, true FROM px WHERE {mark} UNION ALL
  SELECT image_id, w, h, x, y, pass + 1, pass % 2 = 0 OR hit FROM (SELECT *, bool_or(gone) OVER (PARTITION BY image_id) AS hit FROM (
    SELECT *, x BETWEEN 1 AND w - 2 AND y BETWEEN 1 AND h - 2 AND bit_count(b) BETWEEN 2 AND 6 AND bit_count(xor(b, 255) & ((b >> 1) | ((b & 1) << 7))) = 1
      AND CASE WHEN pass % 2 = 0 THEN (b & 21) <> 21 AND (b & 84) <> 84 ELSE (b & 69) <> 69 AND (b & 81) <> 81 END AS gone
    FROM (SELECT image_id, w, h, pass, x + dx AS x, y + dy AS y, CAST(sum(1 << o) AS INT) & 255 AS b, bool_or(o = 8) AS self FROM th, off WHERE go GROUP BY image_id, w, h, pass, x + dx, y + dy) WHERE self)) WHERE NOT gone),
sk AS (SELECT * FROM th WHERE NOT go)"""


@query(f"WITH RECURSIVE {R_SQL}, {_thin_sql('r < 130')} SELECT image_id, count(*) AS n, CAST(sum(w * y + x) AS BIGINT) AS idx_sum FROM sk GROUP BY image_id")
def thin_full(spark, sf_dir):
    return _marked(spark, sf_dir, lambda rgb: L.thin(rgb[..., 0] < 130))


@query()
def skeleton_lines(spark, sf_dir):
    def work(image_id, rgb):
        for k, (points, closed) in enumerate(L.centre_lines(L.thin(rgb[..., 0] == 12))):
            yield image_id, k, closed, len(points), L.length(points)

    return per_picture(pictures(spark, sf_dir), work, "image_id long, line_id int, closed boolean, points int, length double")


@query(f"""WITH RECURSIVE {R_SQL}, {_thin_sql(DARK)}, deg AS (SELECT a.image_id, a.x, a.y, count(*) AS d, sum(sqrt(dx * dx + dy * dy)) AS len FROM (SELECT sk.*, dx, dy, x + dx AS nx, y + dy AS ny FROM sk, off WHERE o < 8) a
  JOIN sk b ON b.image_id = a.image_id AND b.x = a.nx AND b.y = a.ny GROUP BY ALL)
SELECT image_id, CAST(sum(CASE WHEN d <> 2 THEN d ELSE 0 END) // 2 AS BIGINT) AS open_lines, round(sum(len) / 2, 6) AS total_length FROM deg GROUP BY image_id""")
def skeleton_totals(spark, sf_dir):
    """How many open centre lines a picture's outline has, and how long all of its lines are."""

    def work(image_id, rgb):
        found = L.centre_lines(L.thin(rgb[..., 0] == 12))
        yield image_id, sum(not closed for _, closed in found), sum(L.length(points) for points, _ in found)

    return per_picture(pictures(spark, sf_dir), work, "image_id long, open_lines long, total_length double").withColumn("total_length", r6("total_length"))


@query()
def contours(spark, sf_dir):
    def work(image_id, rgb):
        for k, s in enumerate(L.outlines(~np.isin(rgb[..., 0], (255, 200)))):
            yield image_id, k, len(s["outer"]), len(s["holes"]), L.area(s["outer"])

    return per_picture(pictures(spark, sf_dir), work, "image_id long, shape_id int, points int, holes int, area double")


@query(f"""WITH RECURSIVE {R_SQL}, {comp_sql('dk', 'r < 130', 'px', 1)}, {comp_sql('zc', 'NOT (r < 130)', 'px')},
shp AS (SELECT image_id, comp FROM dk GROUP BY ALL HAVING count(*) > greatest(max(x) - min(x), max(y) - min(y)) + 1), hol AS (SELECT image_id, comp FROM zc GROUP BY ALL HAVING NOT bool_or{BORDER}),
two AS (SELECT image_id, y, x, (r < 130)::INT AS m, lead((r < 130)::INT) OVER (PARTITION BY image_id, y ORDER BY x) AS e FROM px), four AS (SELECT image_id, m + e + lead(m + e) OVER (PARTITION BY image_id, x ORDER BY y) AS c FROM two),
area AS (SELECT image_id, count(*) FILTER (WHERE c = 4) + count(*) FILTER (WHERE c = 3) / 2.0::DOUBLE AS area FROM four GROUP BY image_id)
SELECT image_id, (SELECT count(*) FROM shp WHERE shp.image_id = area.image_id) AS shapes, (SELECT count(*) FROM hol WHERE hol.image_id = area.image_id) AS holes, area FROM area""")
def contour_totals(spark, sf_dir):
    """Shapes and holes of a picture's dark part, and the area between them: unit cells with four corners inside, and half of those with three."""

    def work(image_id, rgb):
        found = L.outlines(rgb[..., 0] < 130)
        holes = [h for s in found for h in s["holes"]]
        yield image_id, len(found), len(holes), sum(L.area(s["outer"]) for s in found) - sum(map(L.area, holes))

    return per_picture(pictures(spark, sf_dir), work, "image_id long, shapes long, holes long, area double")


POLY_SQL = "pt AS (SELECT vec_id, CAST(i AS INT) AS i, CAST(i AS DOUBLE) AS x, embedding[i + 1]::DOUBLE * 100 AS y, len(embedding) AS n FROM embeddings, range(64) r(i))"


def _polylines(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return rows.select("vec_id", F.transform("embedding", lambda v, i: F.struct(i.cast("double").alias("x"), (v.cast("double") * 100).alias("y"))).alias("points"))


@query(f"WITH {POLY_SQL}, nx AS (SELECT a.*, b.x AS x2, b.y AS y2 FROM pt a JOIN pt b ON a.vec_id = b.vec_id AND b.i = (a.i + 1) % 64) SELECT vec_id, round(abs(sum(x * y2 - x2 * y)) / 2, 6) AS area FROM nx GROUP BY vec_id")
def polygon_area(spark, sf_dir):
    return _polylines(spark, sf_dir).select("vec_id", r6(S.polygon_area("points")).alias("area"))


@query(f"WITH {POLY_SQL}, nx AS (SELECT a.*, b.x AS x2, b.y AS y2 FROM pt a JOIN pt b ON a.vec_id = b.vec_id AND b.i = (a.i + 1) % 64) SELECT vec_id, round(sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)) FILTER (WHERE i < 63), 6) AS open_length, round(sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)), 6) AS closed_length FROM nx GROUP BY vec_id")
def path_length(spark, sf_dir):
    rows = _polylines(spark, sf_dir)
    return rows.select("vec_id", r6(S.path_length("points", F.lit(False))).alias("open_length"), r6(S.path_length("points", F.lit(True))).alias("closed_length"))


def _line_rows(spark, sf_dir, work, schema: str) -> DataFrame:
    def each(batches):
        for pdf in batches:
            yield pd.DataFrame([(v, *work([(p["x"], p["y"]) for p in points])) for v, points in zip(pdf["vec_id"], pdf["points"])], columns=[c.split()[0] for c in schema.split(", ")])

    return _polylines(spark, sf_dir).mapInPandas(each, schema)


@query(f"""WITH RECURSIVE {POLY_SQL}, seg(vec_id, a, b) AS (SELECT vec_id, 0, 63 FROM embeddings UNION ALL SELECT vec_id, n.a, n.b FROM (SELECT vec_id, a, b, k FROM (
  SELECT s.vec_id, s.a, s.b, p.i AS k, row_number() OVER (PARTITION BY s.vec_id, s.a, s.b ORDER BY d.d DESC, p.i) AS rk, d.d AS far
  FROM seg s JOIN pt p ON p.vec_id = s.vec_id AND p.i > s.a AND p.i < s.b JOIN pt u ON u.vec_id = s.vec_id AND u.i = s.a JOIN pt v ON v.vec_id = s.vec_id AND v.i = s.b,
  LATERAL (SELECT greatest(0, least(1, ((p.x - u.x) * (v.x - u.x) + (p.y - u.y) * (v.y - u.y)) / ((v.x - u.x) ** 2 + (v.y - u.y) ** 2))) AS t) t,
  LATERAL (SELECT sqrt((p.x - u.x - t.t * (v.x - u.x)) ** 2 + (p.y - u.y - t.t * (v.y - u.y)) ** 2) AS d) d) WHERE rk = 1 AND far > 10) c, LATERAL (VALUES (c.a, c.k), (c.k, c.b)) n(a, b))
SELECT vec_id, count(DISTINCT i) AS kept, CAST(sum(DISTINCT i) AS BIGINT) AS index_sum FROM (SELECT vec_id, a AS i FROM seg UNION SELECT vec_id, b FROM seg) GROUP BY vec_id""")
def rdp(spark, sf_dir):
    def work(points):
        kept = L.simplify(points, 10.0)
        return len(kept), int(sum(p[0] for p in kept))

    return _line_rows(spark, sf_dir, work, "vec_id long, kept long, index_sum long")


@query()
def bezier_paths(spark, sf_dir):
    return _line_rows(spark, sf_dir, lambda p: (L.path_text(L.simplify(p, 1.0), False, 2.2), L.path_text(L.simplify(p, 1.0), True, 2.2)), "vec_id long, open_path string, closed_path string")


LAYER_LIST = ", ".join(f"'{x}'" for x in V.LAYERS)
ITEM_SQL = f"""it AS (SELECT p_partkey AS image_id, j, [{LAYER_LIST}][(p_size + j * 3) % 8 + 1] AS layer, CAST((p_size + j * 3) % 8 AS INT) AS z, CAST(j AS INT) AS ord, p_size, CAST(p_size AS BIGINT) * (j + 1) % 37 AS area FROM part, range(7) r(j)),
items AS (SELECT *, CASE WHEN layer IN ('stitching', 'laces', 'outline') THEN 'stroke' ELSE 'fill' END AS mode, '#' || printf('%06x', CAST(p_size * 4099 + (j % 3) * 257 AS INT)) AS color, CASE WHEN j % 2 = 0 THEN 1.5 + j END AS stroke_width,
 CASE WHEN layer = 'shadow' THEN 0.22 END AS opacity, 'M 0,0 L ' || p_size || ',' || j || CASE WHEN j % 3 = 0 THEN ' C 1,-1 2,2 -3.5,' || j ELSE '' END || ' Z' AS d FROM it)"""


def _items(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("image_id"), F.col("p_size"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("j"))
    rows = rows.withColumn("z", (F.col("p_size") + F.col("j") * 3) % 8).withColumn("layer", F.get(F.array(*[F.lit(x) for x in V.LAYERS]), F.col("z")))
    curve = F.when(F.col("j") % 3 == 0, F.concat(F.lit(" C 1,-1 2,2 -3.5,"), "j")).otherwise("")
    return rows.select(
        "image_id", "layer", F.col("j").alias("ord"), F.when(F.col("layer").isin(*V.LINES), "stroke").otherwise("fill").alias("mode"),
        F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("p_size") * 4099 + F.col("j") % 3 * 257), 6, "0"))).alias("color"), F.when(F.col("j") % 2 == 0, F.col("j") + 1.5).cast("double").alias("stroke_width"),
        F.when(F.col("layer") == "shadow", F.lit(0.22)).alias("opacity"), F.concat(F.lit("M 0,0 L "), "p_size", F.lit(","), "j", curve, F.lit(" Z")).alias("d"), (F.col("p_size").cast("long") * (F.col("j") + 1) % 37).alias("area"),
    )


ANCHOR_SQL = r"len(regexp_extract_all(d, 'M\s*-?\d')) + len(regexp_extract_all(d, 'C\s*-?\d')) + len(regexp_extract_all(d, 'L\s*-?\d'))"


@query(f"WITH {ITEM_SQL} SELECT image_id, layer, ord, CAST({ANCHOR_SQL} AS INT) AS anchors FROM items")
def anchor_counts(spark, sf_dir):
    return _items(spark, sf_dir).select("image_id", "layer", "ord", S.anchors(F.col("d")).alias("anchors"))


@query(f"""WITH {ITEM_SQL}, lay AS (SELECT unnest([{LAYER_LIST}]) AS layer), f AS (SELECT i.image_id, lay.layer, CAST(count(d) AS BIGINT) AS paths, CAST(coalesce(sum({ANCHOR_SQL}), 0) AS BIGINT) AS anchors
 FROM (SELECT DISTINCT image_id FROM items) i CROSS JOIN lay LEFT JOIN items t ON t.image_id = i.image_id AND t.layer = lay.layer GROUP BY ALL)
SELECT * FROM f UNION ALL SELECT image_id, NULL, CAST(sum(paths) AS BIGINT), CAST(sum(anchors) AS BIGINT) FROM f GROUP BY image_id""")
def layer_stats(spark, sf_dir):
    items = _items(spark, sf_dir)
    return V.layer_stats(items, items)


@query(f"""WITH {ITEM_SQL}, u AS (SELECT *, min(z * 100 + ord) OVER (PARTITION BY image_id, mode, color) AS fu FROM items), c AS (SELECT *, 'c' || (dense_rank() OVER (PARTITION BY image_id ORDER BY fu) - 1) AS cls FROM u),
num AS (SELECT *, regexp_replace(CAST(coalesce(stroke_width, 2.0) AS VARCHAR), '\\.0$', '') AS sw FROM c),
p AS (SELECT *, CASE WHEN mode = 'stroke' THEN '<path class="' || cls || '" fill="none" stroke-width="' || sw || '" stroke-linecap="round" stroke-linejoin="round" d="' || d || '"/>'
 ELSE '<path class="' || cls || '" fill-rule="evenodd"' || CASE WHEN opacity IS NULL THEN '' ELSE ' opacity="0.22"' END || ' d="' || d || '"/>' END AS path FROM num),
l AS (SELECT i.image_id, v.z, v.layer, string_agg(path, '' ORDER BY ord) AS inner_ FROM (SELECT DISTINCT image_id FROM items) i CROSS JOIN (SELECT unnest(range(8)) AS z, unnest([{LAYER_LIST}]) AS layer) v LEFT JOIN p ON p.image_id = i.image_id AND p.layer = v.layer GROUP BY ALL),
b AS (SELECT image_id, string_agg(CASE WHEN inner_ IS NULL THEN '<g id="' || layer || '"/>' ELSE '<g id="' || layer || '">' || inner_ || '</g>' END, '' ORDER BY z) AS body FROM l GROUP BY image_id),
r AS (SELECT image_id, string_agg('.' || cls || '{{' || mode || ':' || color || ';' || CASE WHEN mode = 'stroke' THEN 'fill:none;' ELSE '' END || '}}', '' ORDER BY fu) AS rules FROM (SELECT DISTINCT image_id, cls, mode, color, fu FROM c) GROUP BY image_id)
SELECT image_id, sha256('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 48 48" width="48" height="48"><style>' || rules || '</style>' || body || '</svg>') AS svg_sha256 FROM b JOIN r USING (image_id)""".replace("{{", "{").replace("}}", "}"))
def svg_assemble(spark, sf_dir):
    items = _items(spark, sf_dir)
    sizes = items.select("image_id").distinct().select("image_id", F.lit(48).alias("w"), F.lit(48).alias("h"))
    return V.assemble_svg(items, sizes).select("image_id", F.sha2("svg", 256).alias("svg_sha256"))


@query(f"""WITH {ITEM_SQL}, num AS (SELECT *, regexp_replace(CAST(coalesce(stroke_width, 2.0) AS VARCHAR), '\\.0$', '') AS sw FROM items),
p AS (SELECT *, CASE WHEN mode = 'stroke' THEN '<path stroke="' || color || '" fill="none" stroke-width="' || sw || '" stroke-linecap="round" stroke-linejoin="round" d="' || d || '"/>'
 ELSE '<path fill="' || color || '" fill-rule="evenodd"' || CASE WHEN opacity IS NULL THEN '' ELSE ' opacity="0.22"' END || ' d="' || d || '"/>' END AS path FROM num),
l AS (SELECT i.image_id, v.z, v.layer, string_agg(path, '' ORDER BY ord) AS inner_ FROM (SELECT DISTINCT image_id FROM items) i CROSS JOIN (SELECT unnest(range(8)) AS z, unnest([{LAYER_LIST}]) AS layer) v LEFT JOIN p ON p.image_id = i.image_id AND p.layer = v.layer GROUP BY ALL),
b AS (SELECT image_id, string_agg(CASE WHEN inner_ IS NULL THEN '<g id="' || layer || '"/>' ELSE '<g id="' || layer || '">' || inner_ || '</g>' END, '' ORDER BY z) AS body FROM l GROUP BY image_id)
SELECT image_id, sha256('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 48 48" width="48" height="48">' || body || '</svg>') AS svg_sha256 FROM b""")
def svg_attributes(spark, sf_dir):
    items = _items(spark, sf_dir)
    sizes = items.select("image_id").distinct().select("image_id", F.lit(48).alias("w"), F.lit(48).alias("h"))
    return V.assemble_svg(items, sizes, False).select("image_id", F.sha2("svg", 256).alias("svg_sha256"))


@query()
def svg_png(spark, sf_dir):
    """Layers drawn at twice their size: bytes of the file and its digest."""
    items = _items(spark, sf_dir)
    sizes = items.select("image_id").distinct().select("image_id", F.lit(48).alias("w"), F.lit(48).alias("h"))
    return V.render_png(items, sizes).select("image_id", F.length("png").alias("n_bytes"), F.sha2("png", 256).alias("png_sha256"))


@query(f"WITH {ITEM_SQL}, v AS (SELECT 'all' AS view, * FROM items UNION ALL SELECT 'outline', * FROM items WHERE layer = 'outline' UNION ALL SELECT 'colors', * FROM items WHERE mode = 'fill' UNION ALL SELECT 'small', * FROM items) SELECT view, layer, count(*) AS n FROM v GROUP BY view, layer")
def view_filter(spark, sf_dir):
    items = _items(spark, sf_dir)
    shown = [V.view(items, v).groupBy("layer").agg(F.count("*").alias("n")).select(F.lit(v).alias("view"), "layer", "n") for v in ("all", "outline", "colors", "small")]
    return shown[0].unionByName(shown[1]).unionByName(shown[2]).unionByName(shown[3])


@query(f"""WITH {ITEM_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM items WHERE mode = 'fill'),
c AS (SELECT image_id, max(area) FILTER (WHERE i = greatest(0, CAST(floor(n * 0.1::DOUBLE) AS BIGINT) - 1)) AS cut FROM f GROUP BY image_id) SELECT image_id, layer, ord, area FROM f JOIN c USING (image_id) WHERE area > 0 AND area <= cut""")
def small_fragments(spark, sf_dir):
    return V.small_fragments(_items(spark, sf_dir)).select("image_id", "layer", "ord", "area")


@query("SELECT p_partkey, round(e, 6) AS epsilon, round(greatest(0.8, 2.2::DOUBLE * e), 6) AS error FROM (SELECT p_partkey, greatest(0.6::DOUBLE, least(greatest(p_size * 3 - 20, 0), 100) / 100.0::DOUBLE * p_retailprice * 0.004::DOUBLE) AS e FROM part)")
def tolerances(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    epsilon, error = S.tolerances((F.col("p_size") * 3 - 20).cast("double"), F.col("p_retailprice"))
    return part.select("p_partkey", r6(epsilon).alias("epsilon"), r6(error).alias("error"))


@query("SELECT p_partkey, round(greatest(6, p_size * p_size * 100 * 0.0016::DOUBLE), 6) AS min_area, coalesce(CASE WHEN p_partkey % 3 = 0 THEN 4.5::DOUBLE END, greatest(2, floor(p_size * 20 * 0.006::DOUBLE + 0.5))) AS radius FROM part")
def thresholds(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    option = F.when(F.col("p_partkey") % 3 == 0, F.lit(4.5))
    return part.select("p_partkey", r6(S.min_area(F.col("p_size") * F.col("p_size") * 100, C.d(0.0016))).alias("min_area"), S.line_radius(option, F.col("p_size") * 20).alias("radius"))


@query("""SELECT p_partkey, round(CASE WHEN s * f > 2200 THEN 2200 / s ELSE f END, 6) AS scale FROM (SELECT p_partkey, CAST(greatest(p_size * 60, p_size * 45 + 7) AS DOUBLE) AS s,
CASE WHEN p_partkey % 4 = 0 THEN 1.5::DOUBLE WHEN greatest(p_size * 60, p_size * 45 + 7) < 1100 THEN 2 ELSE 1 END AS f FROM part)""")
def scale_factor(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    mode = F.when(F.col("p_partkey") % 4 == 0, F.lit(1.5))
    return part.select("p_partkey", r6(S.scale_factor(F.col("p_size") * 60, F.col("p_size") * 45 + 7, mode)).alias("scale"))


@query("""WITH p(preset, num_colors, smoothing, detect_lines) AS (VALUES ('icon', 5, 75.0::DOUBLE, false), ('illustration', 14, 48.0::DOUBLE, true), ('product', 26, 28.0::DOUBLE, true)),
q AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'icon' WHEN 1 THEN 'product' WHEN 2 THEN 'illustration' ELSE 'poster' END AS preset, CASE WHEN p_partkey % 5 = 0 THEN 8 END AS num_colors FROM part)
SELECT p_partkey, q.preset, CAST(coalesce(q.num_colors, p.num_colors) AS INT) AS num_colors, p.smoothing, p.detect_lines FROM q JOIN p ON p.preset = CASE WHEN q.preset = 'poster' THEN 'illustration' ELSE q.preset END""")
def preset_options(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    preset = F.get(F.array(*[F.lit(x) for x in ("icon", "product", "illustration", "poster")]), F.col("p_size") % 4)
    asked = part.select("p_partkey", preset.alias("preset"), F.when(F.col("p_partkey") % 5 == 0, F.lit(8)).alias("num_colors"))
    return resolve(asked, preset_table(spark)).select("p_partkey", "preset", "num_colors", "smoothing", "detect_lines")


@query(f"WITH {POLY_SQL} SELECT vec_id, round((max(x) - min(x)) * (max(floor(y * 100 + 0.5) / 100) - min(floor(y * 100 + 0.5) / 100)), 6) AS area FROM pt GROUP BY vec_id")
def path_boxes(spark, sf_dir):
    """Areas of the boxes around polylines as path text."""

    def work(points):
        text = " L ".join(f"{L.number(x)},{L.number(y)}" for x, y in points)
        return (L.box_area(f"M {text}"),)

    return _line_rows(spark, sf_dir, work, "vec_id long, area double").select("vec_id", r6("area").alias("area"))


@query("""SELECT p_partkey, CAST(CASE WHEN abs(f - 1) <= 0.01 THEN p_size * 60 ELSE floor(p_size * 60 * f + 0.5) END AS INT) AS w, round(floor(p_retailprice * f * 100 + 0.5) / 100, 6) AS fixed FROM (
SELECT *, CASE WHEN s * f0 > 2200 THEN 2200 / s ELSE f0 END AS f FROM (SELECT *, CAST(p_size * 60 AS DOUBLE) AS s, CASE WHEN p_size * 60 < 1100 THEN 2::DOUBLE ELSE 1::DOUBLE END AS f0 FROM part))""")
def scaled_sides(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    side = F.col("p_size") * 60
    factor = S.scale_factor(side, side, F.lit(None).cast("double"))
    return part.select("p_partkey", S.scaled_side(side, side, side, F.lit(None).cast("double")).alias("w"), r6(S.fixed2(F.col("p_retailprice") * factor)).alias("fixed"))


FILE_SQL = "f AS (SELECT page_id, CASE page_id % 7 WHEN 6 THEN '.png' WHEN 5 THEN 'noext' ELSE url || ['', '.PNG', '.jpeg', '.gif', '.webp'][page_id % 7 + 1] END AS name, ['', 'image/png', 'image/jpeg', 'text/html'][page_id % 4 + 1] AS mime FROM pages)"
EXT_SQL = "CASE WHEN contains(name, '.') THEN translate(regexp_extract(name, '[^.]*$'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"


def _files(spark, sf_dir) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    k = F.col("page_id") % 7
    tail = F.get(F.array(*[F.lit(x) for x in ("", ".PNG", ".jpeg", ".gif", ".webp")]), k.cast("int"))
    mime = F.get(F.array(*[F.lit(x) for x in ("", "image/png", "image/jpeg", "text/html")]), (F.col("page_id") % 4).cast("int"))
    return pages.select("page_id", F.when(k == 6, ".png").when(k == 5, "noext").otherwise(F.concat("url", tail)).alias("name"), mime.alias("mime"))


@query(f"WITH {FILE_SQL} SELECT page_id, name, {EXT_SQL} AS extension, {EXT_SQL} IN ('png', 'jpg', 'jpeg', 'webp') AND mime IN ('', 'image/png', 'image/jpeg', 'image/webp') AS supported FROM f")
def supported_files(spark, sf_dir):
    return _files(spark, sf_dir).select("page_id", "name", S.extension(F.col("name")).alias("extension"), S.supported(F.col("name"), F.col("mime")).alias("supported"))


@query(f"WITH {FILE_SQL} SELECT page_id, regexp_replace(name, '^(.+)\\.[^.]*$', '\\1', 's') || '_vector.svg' AS svg_name, regexp_replace(name, '^(.+)\\.[^.]*$', '\\1', 's') || '_vector.png' AS png_name FROM f")
def svg_names(spark, sf_dir):
    return _files(spark, sf_dir).select("page_id", S.vector_name(F.col("name")).alias("svg_name"), S.vector_name(F.col("name"), "_vector.png").alias("png_name"))


@query(r"""WITH RECURSIVE f AS (SELECT page_id % 8 AS batch, page_id AS ord, 'a' || CASE WHEN page_id % 5 = 0 THEN '(2)' ELSE '' END || '.svg' AS name, row_number() OVER (PARTITION BY page_id % 8 ORDER BY page_id) AS k FROM pages),
r(batch, k, ord, name, unique_name, used) AS (SELECT DISTINCT batch, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, []::VARCHAR[] FROM f UNION ALL
  SELECT batch, k, ord, name, u, list_append(used, u) FROM (SELECT f.*, r.used, CASE WHEN NOT list_contains(r.used, f.name) THEN f.name
    ELSE list_filter([regexp_replace(f.name, '\.svg$', '') || '(' || i || ').svg' for i in range(2, len(r.used) + 3)], lambda c: NOT list_contains(r.used, c))[1] END AS u FROM r JOIN f ON f.batch = r.batch AND f.k = r.k + 1))
SELECT batch, ord, name, unique_name FROM r WHERE k > 0""".replace("\\\\", "\\"))
def unique_names(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    name = F.concat(F.lit("a"), F.when(F.col("page_id") % 5 == 0, "(2)").otherwise(""), F.lit(".svg"))
    return names.unique_names(rows.select((F.col("page_id") % 8).alias("batch"), F.col("page_id").alias("ord"), name.alias("name")))


@query(f"WITH {FILE_SQL}, s AS (SELECT f.*, {EXT_SQL} IN ('png', 'jpg', 'jpeg', 'webp') AND mime IN ('', 'image/png', 'image/jpeg', 'image/webp') AS ok FROM f) SELECT page_id, name, 'job-' || row_number() OVER (ORDER BY page_id DESC) || '-1700000000000' AS job_id, 'pending' AS status FROM s WHERE ok")
def intake_jobs(spark, sf_dir):
    """Supported files as numbered jobs, latest page first; the others are left out of the batch."""
    good, _ = split_supported(_files(spark, sf_dir))
    return jobs(good, F.col("page_id").desc(), 1_700_000_000_000).select("page_id", "name", "job_id", "status")


@query("""SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN (n * 20 + 1024) // 2048 // 10 || '.' || (n * 20 + 1024) // 2048 % 10 || ' KB'
ELSE (n * 200 + 1048576) // 2097152 // 100 || '.' || printf('%02d', (n * 200 + 1048576) // 2097152 % 100) || ' MB' END AS size FROM (SELECT doc_id, n_chars * (doc_id % 7 + 1) * (doc_id % 31 + 1) AS n FROM documents)""")
def file_sizes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", S.file_size(F.col("n_chars") * (F.col("doc_id") % 7 + 1) * (F.col("doc_id") % 31 + 1)).alias("size"))


STATUS_SQL = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'error' ELSE 'done' END"


@query(f"SELECT {STATUS_SQL} AS status, count(*) AS jobs FROM events GROUP BY 1")
def batch_status(spark, sf_dir):
    return job_status(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(STATUS_SQL).alias("status")))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'InvalidStateError' ELSE 'Error' END AS name, ['', 'OpenCV not loaded', 'cannot decode', 'other'][event_id % 4 + 1] AS message FROM events)
SELECT event_id, CASE WHEN name = 'InvalidStateError' THEN '이미지 파일을 읽을 수 없습니다. 파일이 손상되었을 수 있습니다.' WHEN contains(message, 'OpenCV') THEN message WHEN contains(message, 'decode') THEN '이미지를 디코딩할 수 없습니다. 파일 형식을 확인해주세요.'
WHEN message <> '' THEN '변환 중 오류가 발생했습니다: ' || message ELSE '알 수 없는 오류로 변환에 실패했습니다.' END AS text FROM e""")
def error_messages(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    message = F.get(F.array(*[F.lit(x) for x in ("", "OpenCV not loaded", "cannot decode", "other")]), (F.col("event_id") % 4).cast("int"))
    return events.select("event_id", S.error_message(F.when(F.col("event_id") % 5 == 0, "InvalidStateError").otherwise("Error"), message).alias("text"))


@query()
def vectorize_items(spark, sf_dir):
    return vectorize_layers(pictures(spark, sf_dir), Options())


@query()
def vectorize_svg(spark, sf_dir):
    return vectorize(pictures(spark, sf_dir), build_options("illustration"))
