"""Queries over voxels, components, boxes and run lengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.operators import masks as M
from maskloom.operators import regions as Rg
from maskloom.operators import runs as Rn
from maskloom.operators.distances import hd95 as hd95_of
from maskloom.plans.base import ORACLE_SQL, query, rounded
from maskloom.plans.views import VOXELS, table, voxels

SHAPE = {"z": 8, "y": 64, "x": 64}


@query(f"WITH {VOXELS} SELECT label, count(*) AS voxels, count(DISTINCT case_id) AS cases FROM voxels GROUP BY 1")
def split_labels(spark, sf):
    return voxels(spark, sf).groupBy("label").agg(F.count("*").alias("voxels"), F.countDistinct("case_id").alias("cases"))


def _moves(axes: str) -> str:
    """All steps to the same or a touching place, a column for each axis."""
    return "SELECT * FROM " + " CROSS JOIN ".join(f"(SELECT unnest([-1, 0, 1]) AS d{a})" for a in axes)


def components_sql(name: str, source: str, keys: str, axes: str) -> str:
    """SQL of the components of `source` by `keys`: pairs that touch meet on equal places, and what can be reached from a voxel has one smallest place.

    Voxels that touch no other are components of their own and stay out of the recursion."""
    place = {"zyx": "(z * 64 + y) * 64 + x", "yx": "y * 64 + x"}[axes]
    step = " AND ".join(f"w.{a} = v.{a} + m.d{a}" for a in axes)
    same = " AND ".join(f"w.{k.strip()} = v.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"r.{k.strip()}" for k in keys.split(","))
    to = " AND ".join(f"r.{k.strip()} = e.{k.strip()}" for k in keys.split(","))
    return f"""{name}_v AS MATERIALIZED (SELECT DISTINCT {keys}, {", ".join(axes)}, {place} AS p FROM {source}),
  {name}_e AS MATERIALIZED (SELECT {", ".join("v." + k.strip() for k in keys.split(","))}, v.p AS p, w.p AS q FROM {name}_v v CROSS JOIN ({_moves(axes)}) m JOIN {name}_v w ON {same} AND {step} WHERE v.p <> w.p),
  {name}_r AS (SELECT {keys}, p, q FROM {name}_e UNION SELECT {own}, r.p, e.q FROM {name}_r r JOIN {name}_e e ON {to} AND r.q = e.p),
  {name}_root AS (SELECT {keys}, p, min(least(p, q)) AS root FROM {name}_r GROUP BY {keys}, p),
  {name}_all AS MATERIALIZED (SELECT v.*, coalesce(t.root, v.p) AS root FROM {name}_v v LEFT JOIN {name}_root t USING ({keys}, p)),
  {name}_n AS (SELECT {keys}, root, count(*) AS voxels, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, root) AS component FROM {name}_all GROUP BY {keys}, root),
  {name} AS (SELECT {keys}, {", ".join(axes)}, CAST(component AS INT) AS component FROM {name}_all JOIN {name}_n USING ({keys}, root))"""


_PARTS = components_sql("parts", "voxels", "case_id, label", "zyx")
_RP = f"WITH RECURSIVE {VOXELS}, {_PARTS}"


def _all_parts(spark, sf):
    return M.connected_components(voxels(spark, sf), ["case_id", "label"])


@query(f"{_RP} SELECT * FROM parts")
def connected_components(spark, sf):
    return _all_parts(spark, sf)


@query(f"{_RP} SELECT case_id, label, component, count(*) AS voxels FROM parts GROUP BY 1, 2, 3")
def component_sizes(spark, sf):
    return M.component_sizes(_all_parts(spark, sf), ["case_id", "label"])


@query(f"WITH {VOXELS} SELECT case_id, z AS slice, count(*) AS area FROM voxels GROUP BY 1, 2")
def slice_areas(spark, sf):
    return M.slice_areas(voxels(spark, sf), ["case_id"], "z")


_V2 = f"{VOXELS}, v AS (SELECT * FROM voxels WHERE z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0)"
_PER = ", ".join(f"a{i} AS (SELECT case_id, count(*) AS slices_{i}, max(n) AS m{i} FROM (SELECT case_id, {a}, count(*) AS n FROM v GROUP BY 1, 2) GROUP BY 1)" for i, a in enumerate("zyx"))


@query(f"WITH {_V2}, {_PER} SELECT case_id, 8 * (SELECT count(*) FROM v w WHERE w.case_id = a0.case_id) AS voxels_est, slices_0, slices_1, slices_2, greatest(m0, m1, m2) * 4 AS max_area FROM a0 JOIN a1 USING (case_id) JOIN a2 USING (case_id)")
def mask_stats(spark, sf):
    return M.mask_stats(voxels(spark, sf), 2)


@query("SELECT p_partkey, CAST(CASE WHEN b * c >= a * c AND b * c >= a * b THEN 0 WHEN a * c >= a * b THEN 1 ELSE 2 END AS INT) AS hi_axis FROM (SELECT p_partkey, p_size AS a, p_partkey % 40 + 1 AS b, p_partkey % 23 + 1 AS c FROM part)")
def hi_axis(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", M.hi_axis([F.col("p_size"), F.col("p_partkey") % 40 + 1, F.col("p_partkey") % 23 + 1]).alias("hi_axis"))


# A row for each of the labels 1 to 3 of each case, and for each slice; those without foreground have the full extent.
_ENDS = "min(z) AS z0, max(z) + 1 AS z1, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1"
_FULL = "coalesce(z0, 0) AS z0, coalesce(z1, 8) AS z1, coalesce(y0, 0) AS y0, coalesce(y1, 64) AS y1, coalesce(x0, 0) AS x0, coalesce(x1, 64) AS x1"
_ALL = f"{VOXELS}, own AS (SELECT case_id, label, {_ENDS} FROM voxels GROUP BY 1, 2), b AS (SELECT case_id, label, {_FULL} FROM (SELECT DISTINCT case_id FROM voxels) CROSS JOIN (SELECT unnest([1, 2, 3]) AS label) LEFT JOIN own USING (case_id, label))"


def _boxes(spark, sf):
    v = voxels(spark, sf)
    images = v.select("case_id").distinct().crossJoin(F.broadcast(spark.range(1, 4).select(F.col("id").cast("int").alias("label"))))
    return M.bbox(v, ["case_id", "label"], SHAPE, images)


@query(f"WITH {_ALL} SELECT *, (z1 - z0) * (y1 - y0) * (x1 - x0) <= 0.75 * 32768 AS is_significant_crop FROM b")
def bbox_3d(spark, sf):
    return _boxes(spark, sf)


@query(f"WITH {_ALL} SELECT case_id, label, greatest(0, z0 - 3) AS z0, least(8, z1 + 3) AS z1, greatest(0, y0 - 3) AS y0, least(64, y1 + 3) AS y1, greatest(0, x0 - 3) AS x0, least(64, x1 + 3) AS x1 FROM b")
def bbox_padded(spark, sf):
    return M.padded(_boxes(spark, sf).drop("is_significant_crop"), SHAPE, 3)


@query(f"""WITH {VOXELS}, own AS (SELECT case_id, z, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM voxels WHERE label = 1 GROUP BY 1, 2),
  b AS (SELECT case_id, CAST(z AS INT) AS z, coalesce(y0, 0) AS y0, coalesce(y1, 64) AS y1, coalesce(x0, 0) AS x0, coalesce(x1, 64) AS x1 FROM (SELECT DISTINCT case_id FROM voxels) CROSS JOIN range(0, 8) r(z) LEFT JOIN own USING (case_id, z))
  SELECT *, (y1 - y0) * (x1 - x0) <= 0.75 * 4096 AS is_significant_crop FROM b""")
def bbox_2d(spark, sf):
    v = voxels(spark, sf)
    images = v.select("case_id").distinct().crossJoin(F.broadcast(spark.range(8).select(F.col("id").cast("int").alias("z"))))
    return M.bbox(v.where("label = 1").withColumn("z", F.col("z").cast("int")), ["case_id", "z"], {"y": 64, "x": 64}, images)


@query(f"WITH {VOXELS}, own AS (SELECT case_id, {_ENDS} FROM voxels WHERE label IN (1, 2) GROUP BY 1) SELECT case_id, {_FULL} FROM (SELECT DISTINCT case_id FROM voxels) LEFT JOIN own USING (case_id)")
def union_crop(spark, sf):
    v = voxels(spark, sf)
    return M.bbox(v.where("label in (1, 2)"), ["case_id"], SHAPE, v.select("case_id").distinct()).drop("is_significant_crop")


@query(f"WITH {VOXELS} SELECT case_id % 3 AS tile_row, case_id % 5 AS tile_col, min(y + 512 * (case_id % 3)) AS y0, max(y + 512 * (case_id % 3)) + 1 AS y1, min(x + 512 * (case_id % 5)) AS x0, max(x + 512 * (case_id % 5)) + 1 AS x1 FROM voxels GROUP BY 1, 2")
def bbox_tiles(spark, sf):
    v = voxels(spark, sf).withColumns({"tile_row": F.col("case_id") % 3, "tile_col": F.col("case_id") % 5})
    v = v.withColumns({"y": F.col("y") + 512 * F.col("tile_row"), "x": F.col("x") + 512 * F.col("tile_col")})
    return M.bbox(v, ["tile_row", "tile_col"], {"y": 1536, "x": 2560}).drop("is_significant_crop")


@query(f"WITH {VOXELS} SELECT case_id, z - 2 AS z, y - 10 AS y, x - 8 AS x, label FROM voxels WHERE z >= 2 AND z < 6 AND y >= 10 AND y < 40 AND x >= 8 AND x < 56")
def crop(spark, sf):
    return M.crop(voxels(spark, sf), {"z": 2, "y": 10, "x": 8}, {"z": 6, "y": 40, "x": 56})


@query(f"WITH {VOXELS} SELECT case_id, z, 63 - x AS y, y AS x, label FROM voxels")
def reorient(spark, sf):
    return M.reorient(voxels(spark, sf), SHAPE)


@query(f"WITH {VOXELS}, gy AS (SELECT CAST(floor(i * 64 / 40.0) AS INT) AS y, CAST(i AS INT) AS ty FROM range(0, 40) r(i)), gx AS (SELECT CAST(floor(i * 64 / 96.0) AS INT) AS x, CAST(i AS INT) AS tx FROM range(0, 96) r(i)) SELECT case_id, z, ty AS y, tx AS x, label FROM voxels JOIN gy USING (y) JOIN gx USING (x)")
def resize_nearest(spark, sf):
    return M.resize_nearest(voxels(spark, sf), {"y": (64, 40), "x": (64, 96)})


@query(f"WITH {VOXELS} SELECT DISTINCT case_id, y, x FROM voxels WHERE label = 1 EXCEPT SELECT case_id, y, x FROM voxels WHERE label = 2")
def mask_algebra(spark, sf):
    return M.mask_algebra(voxels(spark, sf), 1, 2)


@query(f"WITH {VOXELS} SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY z, y, x) AS INT) AS k, z, y, x FROM voxels")
def stack_slices(spark, sf):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("case_id").orderBy("z", "y", "x"))
    return voxels(spark, sf).select("case_id", k.alias("k"), "z", "y", "x")


@query(f"WITH {VOXELS} SELECT DISTINCT case_id, z FROM voxels WHERE label = 3")
def has_foreground_2d(spark, sf):
    v = voxels(spark, sf)
    return v.select("case_id", "z").distinct().join(v.where("label = 3").select("case_id", "z").distinct(), ["case_id", "z"], "left_semi")


_SIDE = "(SELECT 0 AS dy, 1 AS dx UNION ALL SELECT 0, -1 UNION ALL SELECT 1, 0 UNION ALL SELECT -1, 0)"
_FLAT = f"{VOXELS}, f AS MATERIALIZED (SELECT DISTINCT case_id, label, y, x FROM voxels), g AS MATERIALIZED (SELECT case_id, label, y + dy AS y, x + dx AS x, count(*) AS n FROM f CROSS JOIN {_SIDE} m GROUP BY ALL)"


def _flat(spark, sf, label):
    return voxels(spark, sf).where(F.col("label") == label).select("case_id", "y", "x").distinct()


def _flats(spark, sf):
    """The masks of all labels, seen along z."""
    return voxels(spark, sf).select("case_id", "label", "y", "x").distinct()


@query(f"WITH {_FLAT} SELECT f.case_id, f.label, f.y, f.x FROM f ANTI JOIN (SELECT * FROM g WHERE n = 4) g USING (case_id, label, y, x)")
def mask_border(spark, sf):
    return M.border(_flats(spark, sf), ["case_id", "label"], ("y", "x"))


# A place stays if it and its four sides are in the widened mask: five rows that fall on it.
_FIVE = ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))


@query(f"""WITH {VOXELS}, f AS (SELECT DISTINCT case_id, label, y, x FROM voxels), w AS ({" UNION ".join(f"SELECT case_id, label, y + {dy} AS y, x + {dx} AS x FROM f" for dy, dx in _FIVE)})
  SELECT case_id, label, y, x FROM ({" UNION ALL ".join(f"SELECT case_id, label, y + {dy} AS y, x + {dx} AS x FROM w" for dy, dx in _FIVE)}) GROUP BY case_id, label, y, x HAVING count(*) = 5""")
def morph_close(spark, sf):
    return M.morph_close(_flats(spark, sf), ["case_id", "label"], ("y", "x"))


# An elliptic kernel of 5 x 5 in the image of 64 x 64.
_KERNEL = "(VALUES " + ", ".join(f"({y}, {x})" for y, x in M.ellipse(5)) + ")"


@query(f"""WITH {VOXELS}, f AS MATERIALIZED (SELECT DISTINCT case_id, label, y, x FROM voxels), w AS MATERIALIZED (SELECT DISTINCT case_id, label, y + dy AS y, x + dx AS x FROM f CROSS JOIN {_KERNEL} k(dy, dx) WHERE y + dy BETWEEN 0 AND 63 AND x + dx BETWEEN 0 AND 63),
  g AS MATERIALIZED (SELECT case_id, label, y - dy AS y, x - dx AS x, count(*) AS n FROM w CROSS JOIN {_KERNEL} k(dy, dx) GROUP BY ALL),
  need AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, count(*) AS n FROM range(0, 64) a(y) CROSS JOIN range(0, 64) b(x) CROSS JOIN {_KERNEL} k(dy, dx) WHERE y + dy BETWEEN 0 AND 63 AND x + dx BETWEEN 0 AND 63 GROUP BY 1, 2)
  SELECT g.case_id, g.label, g.y, g.x FROM g JOIN need USING (y, x) WHERE g.n = need.n""")
def morph_close_ellipse(spark, sf):
    return M.morph_close(_flats(spark, sf), ["case_id", "label"], ("y", "x"), M.ellipse(5), {"y": 64, "x": 64})


_EDGES = "e{l} AS (SELECT case_id, y, x FROM f{l} ANTI JOIN (SELECT case_id, y + dy AS y, x + dx AS x FROM f{l} CROSS JOIN " + _SIDE + " m GROUP BY ALL HAVING count(*) = 4) g USING (case_id, y, x))"


def _hd95_sql(dy: float, dx: float) -> str:
    d = f"sqrt((a.y - b.y) * (a.y - b.y) * {dy * dy} + (a.x - b.x) * (a.x - b.x) * {dx * dx})"
    return f"""WITH {VOXELS}, f1 AS (SELECT DISTINCT case_id, y, x FROM voxels WHERE label = 1), f2 AS (SELECT DISTINCT case_id, y, x FROM voxels WHERE label = 2 AND case_id % 5 > 0), {_EDGES.format(l=1)}, {_EDGES.format(l=2)},
  p AS (SELECT a.case_id, a.y, a.x, b.y AS v, b.x AS u, {d} AS d FROM e1 a JOIN e2 b USING (case_id)),
  n AS (SELECT case_id, min(d) AS d FROM p GROUP BY case_id, y, x UNION ALL SELECT case_id, min(d) FROM p GROUP BY case_id, v, u), q AS (SELECT case_id, round(quantile_cont(d, 0.95), 6) AS hd95 FROM n GROUP BY 1)
  SELECT case_id, CASE WHEN case_id IN (SELECT case_id FROM f1) OR case_id IN (SELECT case_id FROM f2) THEN hd95 ELSE 0 END AS hd95 FROM (SELECT s_suppkey AS case_id FROM supplier UNION SELECT -1) c LEFT JOIN q USING (case_id)"""


def _hd95(spark, sf, spacing):
    """Labels 1 and 2 of each case, seen along z; every fifth case lacks the second mask, and case -1 both."""
    cases = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("case_id")).union(spark.range(-1, 0))
    return rounded(hd95_of(_flat(spark, sf, 1), _flat(spark, sf, 2).where("case_id % 5 > 0"), "case_id", ("y", "x"), spacing, cases))


@query(_hd95_sql(1, 1))
def hd95(spark, sf):
    return _hd95(spark, sf, None)


@query(_hd95_sql(2.5, 0.5))
def hd95_spaced(spark, sf):
    return _hd95(spark, sf, (2.5, 0.5))


_RLE = f"{VOXELS}, f AS (SELECT DISTINCT case_id, label, z, x * 64 + y AS p FROM voxels)"


@query(f"WITH {_RLE} SELECT * FROM f")
def rle_decode(spark, sf):
    return M.rle_decode(_runs(spark, sf), ["case_id", "label", "z"]).withColumn("p", F.col("p").cast("int"))


@query(f"""WITH {_RLE}, r AS (SELECT case_id, label, z, p - row_number() OVER (PARTITION BY case_id, label, z ORDER BY p) AS g, p FROM f), s AS (SELECT case_id, label, z, min(p) AS a, count(*) AS n FROM r GROUP BY case_id, label, z, g),
  t AS (SELECT *, a - coalesce(lag(a + n) OVER (PARTITION BY case_id, label, z ORDER BY a), 0) AS gap FROM s), u AS (SELECT case_id, label, z, flatten(list([CAST(gap AS BIGINT), n] ORDER BY a)) AS c FROM t GROUP BY 1, 2, 3)
  SELECT case_id, label, z, CASE WHEN list_sum(c) < 4096 THEN list_append(c, CAST(4096 - list_sum(c) AS BIGINT)) ELSE c END AS counts FROM u""")
def rle_encode(spark, sf):
    return _runs(spark, sf)


@query(f"WITH {_RLE} SELECT case_id, label, z, count(*) AS area FROM f GROUP BY 1, 2, 3")
def rle_area(spark, sf):
    return _runs(spark, sf).select("case_id", "label", "z", M.rle_area("counts").alias("area"))


# The run lengths of every slice.
def _runs(spark, sf):
    return M.rle_encode(voxels(spark, sf), ["case_id", "label", "z"], F.col("x") * 64 + F.col("y"), 4096)


_S = f"{VOXELS}, s AS (SELECT case_id, label, y AS slice, count(*) AS area FROM voxels GROUP BY 1, 2, 3)"
_AXIS = "ax AS (SELECT case_id, label, unnest(range(min(slice), max(slice) + 1)) AS slice FROM s GROUP BY 1, 2), full_axis AS (SELECT ax.case_id, ax.label, ax.slice, s.area FROM ax LEFT JOIN s USING (case_id, label, slice))"


def _slices(spark, sf):
    return M.slice_areas(voxels(spark, sf), ["case_id", "label"], "y")


@query(f"WITH {_S}, {_AXIS}, r AS (SELECT *, sum(CASE WHEN coalesce(area, 0) >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY case_id, label ORDER BY slice ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS run FROM full_axis) SELECT case_id, label, max(run) = 8 AS has_window FROM r GROUP BY 1, 2")
def contiguous_window_check(spark, sf):
    return M.contiguous_window(_slices(spark, sf), ["case_id", "label"], 8, 3)


# The rule over the whole axis of 64 slices, windows of 8 with 4 foreground slices at least where none is full; pixels of a plane: 8 * 64.
@query(f"""WITH {_S}, ax AS (SELECT DISTINCT case_id, label, unnest(range(0, 64)) AS slice FROM s), a AS (SELECT ax.*, coalesce(area, 0) AS area FROM ax LEFT JOIN s USING (case_id, label, slice)),
  r AS (SELECT *, CASE WHEN max(area) OVER g >= 2 THEN area >= 2 ELSE area > 0 END AS fg, first_value(slice) OVER (PARTITION BY case_id, label ORDER BY area DESC, slice) AS top FROM a WINDOW g AS (PARTITION BY case_id, label)),
  w AS (SELECT *, count(*) FILTER (fg) OVER k AS f, sum(area) OVER k AS t FROM r WINDOW k AS (PARTITION BY case_id, label ORDER BY slice ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)), o AS (SELECT *, max(f) OVER (PARTITION BY case_id, label) AS most FROM w WHERE slice <= 56),
  v AS (SELECT * FROM o WHERE f >= CASE WHEN most = 8 THEN 8 ELSE greatest(1, least(4, most)) END), p AS (SELECT *, 'peak' AS policy, row_number() OVER (PARTITION BY case_id, label ORDER BY abs(slice - greatest(0, least(56, top - 4))), t DESC, slice) AS k FROM v UNION ALL SELECT *, 'area', row_number() OVER (PARTITION BY case_id, label ORDER BY t DESC, slice) FROM v)
  SELECT case_id, label, policy, CAST(slice AS INT) AS start, f AS foreground_slices, CAST(t AS BIGINT) AS area FROM p WHERE k = 1""")
def window_select(spark, sf):
    each = [M.window_select(_slices(spark, sf), ["case_id", "label"], 8, 64, 8 * 64, policy, 4).withColumn("policy", F.lit(policy)) for policy in ("peak", "area")]
    return each[0].unionByName(each[1])


_QUALITY = """s AS (SELECT case_id, label, component, y AS slice, count(*) AS area FROM parts GROUP BY 1, 2, 3, 4), big AS (SELECT *, slice - row_number() OVER (PARTITION BY case_id, label, component ORDER BY slice) AS run FROM s WHERE area >= 2),
  l AS (SELECT case_id, label, component, max(n) AS longest FROM (SELECT case_id, label, component, run, count(*) AS n FROM big GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3), t AS (SELECT case_id, label, component, CAST(sum(area) AS BIGINT) AS voxels, count(*) FILTER (area >= 2) AS q FROM s GROUP BY 1, 2, 3)"""


@query(f"""{_RP}, {_QUALITY} SELECT case_id, label, component, voxels, CASE WHEN voxels < 3 THEN 'component_below_minimum_voxels_3d' WHEN q = 0 THEN 'component_below_minimum_slice_area_3d' WHEN q < 2 THEN 'component_below_minimum_slices_3d'
  WHEN coalesce(longest, 0) < 2 THEN 'component_below_minimum_contiguous_slices_3d' END AS reason FROM t LEFT JOIN l USING (case_id, label, component)""")
def component_quality_3d(spark, sf):
    return M.component_quality_3d(_all_parts(spark, sf), ["case_id", "label"], "y", 3, 2, 2, True)


@query(f"WITH RECURSIVE {VOXELS}, {components_sql('flat', 'voxels', 'case_id, label, z', 'yx')} SELECT case_id, label, z, component, CAST(sum(label) AS BIGINT) AS size FROM flat GROUP BY 1, 2, 3, 4 HAVING sum(label) >= 4")
def filter_small_2d(spark, sf):
    """A component's size is the sum of its voxels' label, as its mask has them."""
    flat = M.connected_components(voxels(spark, sf), ["case_id", "label", "z"], ("y", "x"))
    return M.filter_small_2d(flat, ["case_id", "label", "z"], 4, "label")


_REASON = """CASE WHEN voxels < 3 THEN 'component_below_minimum_voxels_3d' WHEN q = 0 THEN 'component_below_minimum_slice_area_3d' WHEN q < 2 THEN 'component_below_minimum_slices_3d' WHEN coalesce(longest, 0) < 2 THEN 'component_below_minimum_contiguous_slices_3d' END"""


@query(f"""{_RP}, {_QUALITY}, o AS (SELECT case_id, {_REASON} AS reason FROM t LEFT JOIN l USING (case_id, label, component)), g AS (SELECT case_id, reason, count(*) AS n FROM o GROUP BY 1, 2)
  SELECT case_id, CAST(sum(n) AS BIGINT) AS components_3d_found, CAST(coalesce(sum(n) FILTER (reason IS NOT NULL), 0) AS BIGINT) AS components_3d_rejected,
  '{{' || coalesce(string_agg('"' || reason || '":' || n, ',' ORDER BY reason) FILTER (reason IS NOT NULL), '') || '}}' AS rejected_by_reason FROM g GROUP BY 1""")
def qc_counters(spark, sf):
    q = M.component_quality_3d(_all_parts(spark, sf), ["case_id", "label"], "y", 3, 2, 2, True)
    by = q.groupBy("case_id", "reason").agg(F.count("*").alias("n"))
    return by.groupBy("case_id").agg(F.sum("n").alias("components_3d_found"), F.sum(F.when(F.col("reason").isNotNull(), F.col("n")).otherwise(0)).alias("components_3d_rejected"), F.to_json(F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.struct(F.col("reason").alias("key"), F.col("n").alias("value"))), lambda e: e["key"].isNotNull())))).alias("rejected_by_reason"))


# Cleaning on a coarse grid of 17 x 16, where masks are dense enough to have holes. Background places of few free neighbours are held together; such a
# group is a region if none of its places touches another free place, and small if it has fewer than 5. Islands are those of the filled mask.
_NEAR = "(SELECT * FROM " + " CROSS JOIN ".join(f"(SELECT unnest([-1, 0, 1]) AS d{a})" for a in "yx") + " WHERE dy <> 0 OR dx <> 0)"
_CLEAN = f"""{VOXELS}, f AS MATERIALIZED (SELECT DISTINCT case_id, label, CAST(y // 3 AS INT) AS y, CAST(x // 4 AS INT) AS x FROM voxels), m AS (SELECT DISTINCT case_id, label FROM f),
  free AS MATERIALIZED (SELECT case_id, label, CAST(p // 16 AS INT) AS y, CAST(p % 16 AS INT) AS x FROM m CROSS JOIN range(0, 272) r(p) ANTI JOIN (SELECT case_id, label, y * 16 + x AS p FROM f) USING (case_id, label, p)),
  pair AS MATERIALIZED (SELECT a.case_id, a.label, a.y, a.x, b.y AS v, b.x AS u FROM free a CROSS JOIN {_NEAR} d JOIN free b ON b.case_id = a.case_id AND b.label = a.label AND b.y = a.y + dy AND b.x = a.x + dx),
  few AS MATERIALIZED (SELECT case_id, label, y, x FROM free LEFT JOIN (SELECT case_id, label, y, x, count(*) AS n FROM pair GROUP BY ALL) USING (case_id, label, y, x) WHERE coalesce(n, 0) <= 3),
  {components_sql("hole", "few", "case_id, label", "yx")},
  open AS (SELECT DISTINCT h.case_id, h.label, h.component FROM hole h JOIN pair p USING (case_id, label, y, x) ANTI JOIN few w ON w.case_id = p.case_id AND w.label = p.label AND w.y = p.v AND w.x = p.u),
  small AS (SELECT case_id, label, component FROM hole ANTI JOIN open USING (case_id, label, component) GROUP BY ALL HAVING count(*) < 5),
  filled AS (SELECT case_id, label, y, x FROM hole SEMI JOIN small USING (case_id, label, component)), g AS MATERIALIZED (SELECT * FROM f UNION ALL SELECT * FROM filled),
  {components_sql("parts", "g", "case_id, label", "yx")},
  size AS (SELECT case_id, label, component, count(*) AS n, max(count(*)) OVER (PARTITION BY case_id, label) AS most FROM parts GROUP BY 1, 2, 3),
  clean AS MATERIALIZED (SELECT case_id, label, y, x FROM parts JOIN size USING (case_id, label, component) WHERE n >= 5 OR (most < 5 AND component = 1)),
  touched AS (SELECT case_id, label FROM small UNION SELECT case_id, label FROM size WHERE n < 5),
  box AS MATERIALIZED (SELECT case_id, label, (case_id, label) IN (SELECT (case_id, label) FROM touched) AS changed, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM clean GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_CLEAN} SELECT case_id, label, y, x, changed FROM clean JOIN box USING (case_id, label)")
def remove_small_regions(spark, sf):
    return Rg.small_regions(_coarse(spark, sf), ["case_id", "label"], 17, 16, 5)


def _coarse(spark, sf):
    return voxels(spark, sf).select("case_id", "label", F.floor(F.col("y") / 3).alias("y"), F.floor(F.col("x") / 4).alias("x"))


@query(f"""WITH RECURSIVE {_CLEAN}, k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY changed, label) AS r FROM box),
  o AS (SELECT j.case_id, j.r, list(i.r) AS over_ FROM k i JOIN k j ON i.case_id = j.case_id AND i.r < j.r
    WHERE greatest(0, least(i.x1, j.x1) - greatest(i.x0, j.x0)) * greatest(0, least(i.y1, j.y1) - greatest(i.y0, j.y0)) > 0.9 * ((i.x1 - i.x0) * (i.y1 - i.y0) + (j.x1 - j.x0) * (j.y1 - j.y0) - greatest(0, least(i.x1, j.x1) - greatest(i.x0, j.x0)) * greatest(0, least(i.y1, j.y1) - greatest(i.y0, j.y0))) GROUP BY 1, 2),
  c AS MATERIALIZED (SELECT k.case_id, k.r, coalesce(o.over_, []) AS over_ FROM k LEFT JOIN o USING (case_id, r)),
  t AS (SELECT case_id, 1::BIGINT AS r, [1::BIGINT] AS kept FROM c WHERE r = 1 UNION ALL SELECT t.case_id, c.r, CASE WHEN list_has_any(t.kept, c.over_) THEN t.kept ELSE list_append(t.kept, c.r) END FROM t JOIN c ON c.case_id = t.case_id AND c.r = t.r + 1),
  stay AS (SELECT k.* FROM k SEMI JOIN (SELECT case_id, unnest(kept) AS r FROM (SELECT case_id, arg_max(kept, r) AS kept FROM t GROUP BY 1)) USING (case_id, r)),
  q AS (SELECT case_id, label, x * 17 + y AS p FROM clean), rr AS (SELECT case_id, label, p - row_number() OVER (PARTITION BY case_id, label ORDER BY p) AS g, p FROM q), ss AS (SELECT case_id, label, min(p) AS a, count(*) AS n FROM rr GROUP BY case_id, label, g),
  tt AS (SELECT *, a - coalesce(lag(a + n) OVER (PARTITION BY case_id, label ORDER BY a), 0) AS gap FROM ss), uu AS (SELECT case_id, label, flatten(list([CAST(gap AS BIGINT), n] ORDER BY a)) AS c FROM tt GROUP BY 1, 2)
  SELECT case_id, label, changed, x0, y0, x1, y1, CASE WHEN list_sum(uu.c) < 272 THEN list_append(uu.c, CAST(272 - list_sum(uu.c) AS BIGINT)) ELSE uu.c END AS counts FROM stay JOIN uu USING (case_id, label)""")
def clean_masks(spark, sf):
    return Rg.cleaned_masks(_coarse(spark, sf), "case_id", "label", 17, 16, 5, 0.9)


# Run lengths of labels 1 and 2 of each slice, put together as runs; the SQL has voxels.
def _label_runs(spark, sf, label):
    return Rn.of_counts(_runs(spark, sf).where(F.col("label") == label), ["case_id", "z"])


_SETS = {"difference": "a AND NOT b", "union": "a OR b", "intersection": "a AND b"}


@query("WITH " + _RLE + ", v AS (SELECT case_id, z, p, bool_or(label = 1) AS a, bool_or(label = 2) AS b FROM f WHERE label IN (1, 2) GROUP BY 1, 2, 3), " + ", ".join(
    f"by_{n} AS (SELECT '{n}' AS rule, case_id, z, count(*) AS area, min(p // 64) AS line0, max(p // 64) + 1 AS line1, min(p % 64) AS offset0, max(p % 64) + 1 AS offset1 FROM v WHERE {w} GROUP BY 2, 3)" for n, w in _SETS.items())
    + " " + " UNION ALL ".join(f"SELECT * FROM by_{n}" for n in _SETS))
def run_algebra(spark, sf):
    """Area and box of the difference, union and intersection of two labels' runs."""
    a, b = _label_runs(spark, sf, 1), _label_runs(spark, sf, 2)
    keys, parts = ["case_id", "z"], []
    for name in _SETS:
        runs = getattr(Rn, name)(a, b, keys)
        parts.append(Rn.area(runs, keys).join(Rn.box(runs, keys, 64), keys).select(F.lit(name).alias("rule"), *keys, "area", "line0", "line1", "offset0", "offset1"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
