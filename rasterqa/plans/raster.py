"""Raster measurement queries: masks, boxes, colour, neighbourhoods, transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterqa import dims
from rasterqa.functions.numbers import count_where, finite, half_even, luminance
from rasterqa.operators import colour, components as cc, kernels, masks, metrics, transforms
from rasterqa.plans.registry import query
from rasterqa.plans.sqlparts import (
    BOTH, CORNER, CORNERS, FRAME_W, LUM, MASK_COMPARE, MASK_GEOMETRY, MASK_QA, NLUM, RING, RX, RXO,
    border, component_stats, reach,
)
from rasterqa.sources.rasters import rasters_from_embeddings


def rx(t):
    return rasters_from_embeddings(t("embeddings"))


def rxo(t):
    return rasters_from_embeddings(t("embeddings"), opaque=True)


def both(t):
    """Even ids transparent rasters, odd ids their opaque forms."""
    return rx(t).withColumn("image_id", F.col("image_id") * 2).unionByName(
        rxo(t).withColumn("image_id", F.col("image_id") * 2 + 1))


def r4(*cols):
    return [half_even(F.col(c), 4).alias(c) for c in cols]


# ---- scans -------------------------------------------------------------------------

@query("s2_pixels", f"WITH {RX} SELECT * FROM px")
def s2_pixels(t):
    return rx(t)


# ---- masks, backgrounds ------------------------------------------------------------

@query("r1_luminance", f"""WITH {RX} SELECT image_id, round_even(min({LUM}), 3) AS lum_min,
 round_even(max({LUM}), 3) AS lum_max, round_even(sum({LUM}), 3) AS lum_sum FROM px GROUP BY image_id""")
def r1_luminance(t):
    lum = masks.with_lum(rx(t))
    return lum.groupBy("image_id").agg(
        half_even(F.min("lum"), 3).alias("lum_min"), half_even(F.max("lum"), 3).alias("lum_max"),
        half_even(F.sum("lum"), 3).alias("lum_sum"))


@query("r2_has_alpha", f"""WITH {BOTH} SELECT image_id, bool_or(a < 255) AS any_below_255,
 bool_or(a < 250) AS any_below_250, avg(CAST(a < 250 AS INT)) > 0.01 AS share_below_250
 FROM px GROUP BY image_id""")
def r2_has_alpha(t):
    return masks.has_alpha(both(t))


@query("r3_border_pixels", f"""WITH {RX} SELECT image_id, CAST(sum({border()}) AS BIGINT) AS ring_n,
 CAST(sum(r * {border()}) AS BIGINT) AS ring_r, CAST(sum({border(FRAME_W)}) AS BIGINT) AS frame_n,
 CAST(sum(b * {border(FRAME_W)}) AS BIGINT) AS frame_b FROM px GROUP BY image_id""")
def r3_border_pixels(t):
    px = rx(t)
    ring = masks.border_pixels(px).groupBy("image_id").agg(
        F.sum("weight").alias("ring_n"), F.sum(F.col("r") * F.col("weight")).alias("ring_r"))
    frame = masks.border_pixels(px, dims.BORDER_FRAC).groupBy("image_id").agg(
        F.sum("weight").alias("frame_n"), F.sum(F.col("b") * F.col("weight")).alias("frame_b"))
    return ring.join(frame, "image_id")


_BG = ", ".join(f"{{0}}({c}{{1}}) AS bg_{c}" for c in "rgb")


def _bg_sql(sample, fn, tail):
    return ", ".join(f"round_even({fn}({c}{tail}), 4) AS bg_{c}" for c in "rgb") + f" FROM {sample} GROUP BY image_id"


@query("r4_background_colour", f"""WITH {RXO}, {RING}, {CORNERS},
 med AS (SELECT image_id, quantile_cont(r, 0.5) AS m_r, quantile_cont(g, 0.5) AS m_g,
  quantile_cont(b, 0.5) AS m_b FROM ring GROUP BY image_id),
 near AS (SELECT image_id, m_r, m_g, m_b, avg(CAST(sqrt((r - m_r) * (r - m_r) + (g - m_g) * (g - m_g)
  + (b - m_b) * (b - m_b)) <= 48 AS INT)) AS share FROM ring JOIN med USING (image_id)
  GROUP BY image_id, m_r, m_g, m_b)
 SELECT 'corners' AS mode, image_id, {_bg_sql('corners', 'quantile_cont', ', 0.5')}
 UNION ALL SELECT 'ring', image_id, {_bg_sql('ring', 'quantile_cont', ', 0.5')}
 UNION ALL SELECT 'frame', image_id, {_bg_sql('ring', 'avg', '')}
 UNION ALL SELECT 'flat', image_id, CASE WHEN share >= 0.7 THEN round_even(m_r, 0) END,
  CASE WHEN share >= 0.7 THEN round_even(m_g, 0) END, CASE WHEN share >= 0.7 THEN round_even(m_b, 0) END FROM near""")
def r4_background_colour(t):
    px = rxo(t)
    out = None
    for mode in ("corners", "ring", "frame", "flat"):
        part = masks.background_colour(px, mode).select(
            F.lit(mode).alias("mode"), "image_id", *r4("bg_r", "bg_g", "bg_b"))
        out = part if out is None else out.unionByName(part)
    return out


@query("r5_background_type", f"""WITH {BOTH}, {RING}, st AS (SELECT image_id, sum(r + g + b) / (3 * count(*)) AS m,
 (stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3 AS sd, bool_or(a < 255) AS alpha
 FROM ring JOIN (SELECT image_id AS i2, bool_or(a < 255) AS al FROM px GROUP BY 1) ON i2 = image_id GROUP BY image_id),
 al AS (SELECT image_id, bool_or(a < 255) AS al FROM px GROUP BY image_id)
 SELECT image_id, CASE WHEN al THEN 'Transparent' WHEN sd > 10 THEN 'Complex' WHEN m >= 245 THEN 'White'
 ELSE 'Solid colour' END AS background_type, round_even(m, 2) AS border_mean, round_even(sd, 3) AS border_spread
 FROM st JOIN al USING (image_id)""")
def r5_background_type(t):
    return masks.background_type(both(t)).select(
        "image_id", "background_type", half_even(F.col("border_mean"), 2).alias("border_mean"),
        half_even(F.col("border_spread"), 3).alias("border_spread"))


_MASK_SUM = """SELECT image_id, has_alpha, CAST(count(*) FILTER (content) AS BIGINT) AS n_content,
 CAST(coalesce(sum(y * 8 + x) FILTER (content), 0) AS BIGINT) AS at FROM cm GROUP BY image_id, has_alpha"""


def _mask_summary(df):
    return df.groupBy("image_id", "has_alpha").agg(
        count_where(F.col("content")).alias("n_content"),
        F.sum(F.when(F.col("content"), F.col("y") * 8 + F.col("x")).otherwise(0)).cast("bigint").alias("at"))


for _profile, _cte in (("compare", MASK_COMPARE), ("qa", MASK_QA), ("geometry", MASK_GEOMETRY)):
    @query(f"r6_content_mask_{_profile}", f"WITH {BOTH}, {_cte} {_MASK_SUM}")
    def _r6(t, profile=_profile):
        return _mask_summary(masks.content_mask(both(t), profile))


_NEAR_CTE = (
    f"{CORNERS}, bg AS (SELECT image_id, quantile_cont(r, 0.5) AS bg_r, quantile_cont(g, 0.5) AS bg_g, "
    "quantile_cont(b, 0.5) AS bg_b FROM corners GROUP BY image_id), "
    "al AS (SELECT image_id, bool_or(a < 255) AS has_alpha FROM px GROUP BY image_id), "
    "near AS MATERIALIZED (SELECT image_id, x, y FROM px JOIN bg USING (image_id) JOIN al USING (image_id) "
    "WHERE NOT has_alpha AND sqrt((r - bg_r) * (r - bg_r) + (g - bg_g) * (g - bg_g) + (b - bg_b) * (b - bg_b)) <= 40), "
    + reach("near", 4)
    + ", bgpx AS (SELECT image_id, x, y FROM comp WHERE (image_id, comp) IN (SELECT (image_id, comp) FROM comp "
    "WHERE x = 0 OR y = 0 OR x = 7 OR y = 7)), "
    "cm AS MATERIALIZED (SELECT px.*, has_alpha, CASE WHEN has_alpha THEN a > 128 ELSE bgpx.x IS NULL END AS content "
    "FROM px JOIN al USING (image_id) LEFT JOIN bgpx ON bgpx.image_id = px.image_id AND bgpx.x = px.x AND bgpx.y = px.y)"
)


@query("r7_content_mask_connected", f"WITH RECURSIVE {BOTH}, {_NEAR_CTE} {_MASK_SUM}")
def r7_content_mask_connected(t):
    return _mask_summary(transforms.content_mask_connected(both(t)))


_FLOOD = """SELECT image_id, CAST(count(*) FILTER (bgpx.x IS NOT NULL) AS BIGINT) AS removed,
 CAST(sum(CASE WHEN bgpx.x IS NULL THEN a ELSE 0 END) AS BIGINT) AS alpha_left
 FROM px LEFT JOIN bgpx USING (image_id, x, y) GROUP BY image_id"""
_BGPX = ("bgpx AS (SELECT image_id, x, y FROM comp WHERE (image_id, comp) IN (SELECT (image_id, comp) FROM comp "
         "WHERE x = 0 OR y = 0 OR x = 7 OR y = 7))")


def _flood_summary(before, after):
    old = before.select("image_id", "x", "y", F.col("a").alias("a0"))
    return after.join(old, ["image_id", "x", "y"]).groupBy("image_id").agg(
        count_where((F.col("a0") != 0) & (F.col("a") == 0)).alias("removed"),
        F.sum("a").cast("bigint").alias("alpha_left"))


@query("r8_remove_white", f"""WITH RECURSIVE {RXO},
 near AS MATERIALIZED (SELECT image_id, x, y FROM px WHERE least(r, g, b) >= 115),
 {reach('near', 4)}, {_BGPX} {_FLOOD}""")
def r8_remove_white(t):
    # These rasters are mid-grey, so the white test is widened to channels >= 115.
    px = rxo(t)
    return _flood_summary(px, transforms.remove_background(px, "white", tolerance=140))


@query("r8_remove_flat_background", f"""WITH RECURSIVE {RXO}, {RING},
 med AS (SELECT image_id, quantile_cont(r, 0.5) AS m_r, quantile_cont(g, 0.5) AS m_g, quantile_cont(b, 0.5) AS m_b
  FROM ring GROUP BY image_id),
 flat AS (SELECT image_id, round_even(any_value(m_r), 0) AS m_r, round_even(any_value(m_g), 0) AS m_g,
  round_even(any_value(m_b), 0) AS m_b FROM ring JOIN med USING (image_id) GROUP BY image_id
  HAVING avg(CAST(sqrt((r - m_r) * (r - m_r) + (g - m_g) * (g - m_g) + (b - m_b) * (b - m_b)) <= 48 AS INT)) >= 0.7),
 near AS MATERIALIZED (SELECT image_id, x, y FROM px JOIN flat USING (image_id)
  WHERE sqrt((r - m_r) * (r - m_r) + (g - m_g) * (g - m_g) + (b - m_b) * (b - m_b)) <= 48),
 {reach('near', 4)}, {_BGPX} {_FLOOD}""")
def r8_remove_flat_background(t):
    px = rxo(t)
    return _flood_summary(px, transforms.remove_background(px, "flat"))


@query("r9_opaque_white", f"""WITH {BOTH} SELECT image_id, bool_and(a = 255 AND least(r, g, b) >= 100)
 AS opaque_white FROM px WHERE {CORNER} > 0 GROUP BY image_id""")
def r9_opaque_white(t):
    # The widened tolerance keeps both answers present on mid-grey rasters.
    return masks.is_opaque_white(both(t), tolerance=155)


# ---- figures -----------------------------------------------------------------------

_BOX = ("bb AS (SELECT image_id, any_value(w) AS w, any_value(h) AS h, min(x) FILTER (content) AS bx, "
        "min(y) FILTER (content) AS by, max(x) FILTER (content) - min(x) FILTER (content) + 1 AS bw, "
        "max(y) FILTER (content) - min(y) FILTER (content) + 1 AS bh, "
        "CAST(count(*) FILTER (content) AS BIGINT) AS n_content FROM cm GROUP BY image_id)")


@query("r10_bbox", f"WITH {BOTH}, {MASK_QA}, {_BOX} SELECT * FROM bb")
def r10_bbox(t):
    return metrics.bbox(masks.content_mask(both(t), "qa"))


@query("r11_layout", f"""WITH {BOTH}, {MASK_GEOMETRY}, {_BOX} SELECT image_id, bx AS pad_left,
 w - (bx + bw) AS pad_right, "by" AS pad_top, h - ("by" + bh) AS pad_bottom,
 round_even((bx + bw / 2.0) * 100.0 / w, 2) AS center_x_pct, round_even(("by" + bh / 2.0) * 100.0 / h, 2) AS center_y_pct,
 CASE WHEN w = h THEN 'Square' WHEN w > h THEN 'Landscape' ELSE 'Portrait' END AS orientation,
 round_even(w / h, 4) AS aspect_ratio, round_even(w / 300.0, 2) AS inches_w, round_even(h / 300.0, 2) AS inches_h,
 round_even(coalesce(bx / w, 0), 3) AS margin_left, round_even(coalesce((w - bx - bw) / w, 0), 3) AS margin_right,
 round_even(coalesce("by" / h, 0), 3) AS margin_top, round_even(coalesce((h - "by" - bh) / h, 0), 3) AS margin_bottom,
 coalesce(CASE WHEN bx IS NOT NULL THEN least(bx, "by", w - bx - bw, h - "by" - bh) END * 100.0 / least(w, h), 100.0) AS margin_pct FROM bb""")
def r11_layout(t):
    box = metrics.bbox(masks.content_mask(both(t), "geometry"))
    return metrics.layout_metrics(box).drop("w", "h", "n_content", "bx", "by", "bw", "bh")


_SHAPE = ("sf AS (SELECT image_id, count(*) FILTER (content) AS n_content, "
          "coalesce((max(x) FILTER (content) - min(x) FILTER (content) + 1) / (max(y) FILTER (content) - min(y) FILTER (content) + 1), 0) AS aspect, "
          "(max(x) FILTER (content) - min(x) FILTER (content) + 1) * (max(y) FILTER (content) - min(y) FILTER (content) + 1) AS area, "
          "(avg(x) FILTER (content) - min(x) FILTER (content)) / (max(x) FILTER (content) - min(x) FILTER (content) + 1) AS cx, "
          "(avg(y) FILTER (content) - min(y) FILTER (content)) / (max(y) FILTER (content) - min(y) FILTER (content) + 1) AS cy "
          "FROM cm GROUP BY image_id)")


@query("r12_shape_features", f"""WITH {BOTH}, {MASK_COMPARE}, {_SHAPE} SELECT image_id,
 CAST(n_content AS BIGINT) AS n_content, round_even(aspect, 4) AS aspect,
 round_even(coalesce(least(1.0, n_content / area), 0.0), 4) AS fill, round_even(coalesce(cx, 0.5), 4) AS cx,
 round_even(coalesce(cy, 0.5), 4) AS cy FROM sf""")
def r12_shape_features(t):
    out = metrics.shape_features(masks.content_mask(both(t), "compare"))
    return out.select("image_id", "n_content", *r4("aspect", "fill", "cx", "cy"))


_CONTENT = "content_px AS MATERIALIZED (SELECT image_id, x, y FROM cm WHERE content)"


# A component is outer if it holds a border pixel or is next to background that reaches the border.
_OUTER = f"""bk AS MATERIALIZED (SELECT image_id, x, y FROM cm WHERE NOT content), {reach('bk', 4, 'bgc')},
 outside AS MATERIALIZED (SELECT image_id, comp FROM bgc GROUP BY image_id, comp HAVING min(x) = 0 OR min(y) = 0 OR max(x) = 7 OR max(y) = 7),
 sky AS MATERIALIZED (SELECT image_id, x, y FROM bgc JOIN outside USING (image_id, comp)),
 outer_comp AS MATERIALIZED (SELECT DISTINCT image_id, comp FROM comp WHERE x IN (0, 7) OR y IN (0, 7)
  UNION SELECT c.image_id, c.comp FROM comp c JOIN sky s ON s.image_id = c.image_id AND abs(s.x - c.x) + abs(s.y - c.y) = 1)"""


@query("r13_contours", f"""WITH RECURSIVE {RX}, {MASK_COMPARE}, {_CONTENT}, {reach('content_px', 8)}, {component_stats()}, {_OUTER},
 tot AS (SELECT image_id, sum(area) AS total, max(area) FILTER (oc.comp IS NOT NULL) AS largest,
  (max(x1) - min(x0) + 1) * (max(y1) - min(y0) + 1) AS box FROM cs LEFT JOIN outer_comp oc USING (image_id, comp) GROUP BY image_id)
 SELECT image_id, CAST(count(*) FILTER (area > 0.005 * total AND oc.comp IS NOT NULL) AS BIGINT) AS n_contours,
 round_even(any_value(largest) / any_value(box), 3) AS largest_contour_share
 FROM cs LEFT JOIN outer_comp oc USING (image_id, comp) JOIN tot USING (image_id) GROUP BY image_id""")
def r13_contours(t):
    return metrics.contour_features(cc.nesting(masks.content_mask(rx(t), "compare")))


@query("r13_nesting", f"""WITH RECURSIVE {RX}, {MASK_COMPARE}, {_CONTENT}, {reach('content_px', 8)}, {component_stats()}, {_OUTER}
 SELECT image_id, comp AS comp_id, CAST(area AS BIGINT) AS area, oc.comp IS NULL AS nested FROM cs LEFT JOIN outer_comp oc USING (image_id, comp)""")
def r13_nesting(t):
    out = cc.nesting(masks.content_mask(rx(t), "compare"))
    return out.select("image_id", "comp_id", "area", F.col("hole").isNotNull().alias("nested"))


_DOM = """dc AS (SELECT image_id, CAST(r // {s} * {s} AS INT) AS r, CAST(g // {s} * {s} AS INT) AS g,
 CAST(b // {s} * {s} AS INT) AS b, count(*) AS n FROM cm WHERE content GROUP BY 1, 2, 3, 4),
 dr AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r DESC, g DESC, b DESC) AS rank,
 sum(n) OVER (PARTITION BY image_id) AS total FROM dc)"""


@query("r14_dominant_colours", f"""WITH {BOTH}, {MASK_COMPARE}, {_DOM.format(s=24)} SELECT image_id, rank, r, g, b, n,
 round_even(n / total, 3) AS share FROM dr WHERE rank <= 5""")
def r14_dominant_colours(t):
    return colour.dominant_colours(masks.content_mask(both(t), "compare"))


@query("r15_alpha_colour_stats", f"""WITH {BOTH}, {MASK_COMPARE} SELECT image_id,
 coalesce(CAST(round_even(avg(r) FILTER (content), 0) AS INT), 0) AS mean_r,
 coalesce(CAST(round_even(avg(g) FILTER (content), 0) AS INT), 0) AS mean_g,
 coalesce(CAST(round_even(avg(b) FILTER (content), 0) AS INT), 0) AS mean_b,
 round_even(avg(CAST(a < 128 AS INT)) * 100.0, 1) AS transparent_pct,
 round_even(avg(CAST(a = 0 AS INT)) * 100.0, 1) AS clear_pct,
 round_even(avg(CAST(a BETWEEN 10 AND 245 AS INT)) * 100.0, 2) AS semi_pct FROM cm GROUP BY image_id""")
def r15_alpha_colour_stats(t):
    return metrics.alpha_colour_stats(masks.content_mask(both(t), "compare"))


@query("r16_components", f"""WITH RECURSIVE {RX}, {MASK_GEOMETRY}, {_CONTENT}, {reach('content_px', 8)}, {component_stats()}
 SELECT image_id, CAST(count(*) AS BIGINT) AS n_components, CAST(count(*) FILTER (area >= 50) AS BIGINT) AS n_objects,
 CAST(count(*) FILTER (area <= 50) AS BIGINT) AS n_isolated, CAST(count(*) FILTER (area < 10) AS BIGINT) AS n_micro,
 CAST(min(area) AS BIGINT) AS smallest_area FROM cs GROUP BY image_id""")
def r16_components(t):
    px = masks.content_mask(rx(t), "geometry").filter("content").select("image_id", "x", "y")
    return cc.objects_summary(cc.components(px, 8), dims.COMPONENT_MIN_AREA,
                              dims.ISOLATED_COMPONENT_AREA, dims.MICRO_COMPONENT_AREA)


@query("r16_components_4", f"""WITH RECURSIVE {RX}, {MASK_GEOMETRY}, solid AS MATERIALIZED (SELECT image_id, x, y FROM px WHERE a = 255),
 {reach('solid', 4)}, {component_stats()} SELECT image_id, CAST(comp AS BIGINT) AS comp_id, CAST(area AS BIGINT) AS area,
 x0, y0, x1, y1 FROM cs""")
def r16_components_4(t):
    return cc.components(rx(t).filter("a = 255").select("image_id", "x", "y"), 4)


@query("r17_min_hole", f"""WITH RECURSIVE {RX}, hole AS MATERIALIZED (SELECT image_id, x, y FROM px WHERE a = 0),
 {reach('hole', 8)}, {component_stats()} SELECT image_id, CAST(min(area) AS BIGINT) AS min_hole_px FROM cs
 WHERE x0 > 0 AND y0 > 0 AND x1 < 7 AND y1 < 7 GROUP BY image_id""")
def r17_min_hole(t):
    return cc.min_hole(masks.content_mask(rx(t), "geometry"))


@query("r18_colour_groups")
def r18_colour_groups(t):
    return colour.colour_groups(rx(t))


_NAME_SQL = """CASE WHEN greatest(r, g, b) - least(r, g, b) < 25 THEN
 CASE WHEN greatest(r, g, b) > 220 THEN 'White / light grey' WHEN greatest(r, g, b) < 45 THEN 'Black'
 WHEN greatest(r, g, b) < 110 THEN 'Dark grey' ELSE 'Grey' END
 ELSE upper(tone_hue[1]) || tone_hue[2:] END"""
_HUE_SQL = """CASE WHEN greatest(r, g, b) < 110 THEN 'dark ' WHEN least(r, g, b) > 150 THEN 'light ' ELSE '' END ||
 CASE WHEN r >= g AND r >= b THEN CASE WHEN g > 150 AND b < 120 THEN CASE WHEN g > 200 THEN 'yellow' ELSE 'orange' END
 WHEN g > 60 AND b < g THEN 'brown' ELSE 'red' END
 WHEN g >= r AND g >= b THEN CASE WHEN r > 150 THEN 'yellow-green' ELSE 'green' END
 ELSE CASE WHEN b > g THEN 'blue' ELSE 'purple' END END"""


@query("r19_colour_names", f"""WITH {RX}, named AS (SELECT r, g, b, {_HUE_SQL} AS tone_hue FROM px)
 SELECT {_NAME_SQL} AS name, CAST(count(*) AS BIGINT) AS n FROM named GROUP BY 1""")
def r19_colour_names(t):
    named = colour.colour_name(F.col("r"), F.col("g"), F.col("b")).alias("name")
    return rx(t).groupBy(named).agg(F.count("*").alias("n"))


@query("r20_palette_profile", f"""WITH {BOTH}, {MASK_QA}, {_DOM.format(s=32)} SELECT image_id,
 CAST(count(*) AS BIGINT) AS colour_count, string_agg(printf('#%02X%02X%02X %.1f%%', r, g, b,
 round_even(n * 100.0 / total, 1)), ', ' ORDER BY rank) FILTER (rank <= 8) AS top_colours FROM dr GROUP BY image_id""")
def r20_palette_profile(t):
    return colour.palette_profile(masks.content_mask(both(t), "qa"))


_BLACK = f"""bl AS (SELECT image_id, coalesce(avg(CAST(round({LUM}, 3) < 80 AS INT)) FILTER (content),
 avg(CAST(round({LUM}, 3) < 80 AS INT))) * 100.0 AS dark,
 coalesce(quantile_cont(round({LUM}, 3), 0.01) FILTER (content), quantile_cont(round({LUM}, 3), 0.01)) AS lvl
 FROM cm GROUP BY image_id)"""


@query("r21_black_level", f"""WITH {BOTH}, {MASK_QA}, {_BLACK} SELECT image_id, round_even(dark, 3) AS dark_pct,
 CASE WHEN dark >= 2 THEN round_even(lvl, 5) END AS black_level FROM bl""")
def r21_black_level(t):
    out = metrics.black_level(masks.content_mask(both(t), "qa"))
    return out.select("image_id", half_even(F.col("dark_pct"), 3).alias("dark_pct"),
                      half_even(F.col("black_level"), 5).alias("black_level"))


@query("r22_alpha_histogram", f"""WITH {BOTH} SELECT image_id, count(*) FILTER (a = 0) AS alpha_0,
 count(*) FILTER (a BETWEEN 1 AND 10) AS alpha_1_10, count(*) FILTER (a BETWEEN 11 AND 50) AS alpha_11_50,
 count(*) FILTER (a BETWEEN 51 AND 200) AS alpha_51_200, count(*) FILTER (a BETWEEN 201 AND 254) AS alpha_201_254,
 count(*) FILTER (a = 255) AS alpha_255 FROM px GROUP BY image_id""")
def r22_alpha_histogram(t):
    return metrics.alpha_histogram(both(t))


@query("r23_target_geometry", f"""WITH {BOTH}, {MASK_GEOMETRY}, {_BOX}, tg AS (SELECT *, 12.5 * bh / bw AS th FROM bb),
 tp AS (SELECT image_id, w, h, round_even(th, 2) AS target_height_in,
 CASE WHEN th IS NOT NULL THEN 3750 END AS target_width_px, CAST(round_even(th * 300, 0) AS BIGINT) AS target_height_px FROM tg)
 SELECT image_id, 12.5 AS target_width_in, target_height_in, CAST(target_width_px AS BIGINT) AS target_width_px, target_height_px,
 round_even(target_width_px / nullif(target_height_px, 0), 4) AS target_aspect_ratio,
 round_even(w / 12.5, 1) AS effective_dpi_x, round_even(h / nullif(target_height_in, 0), 1) AS effective_dpi_y FROM tp""")
def r23_target_geometry(t):
    box = metrics.bbox(masks.content_mask(both(t), "geometry"))
    out = metrics.target_geometry(box, F.lit(12.5), F.lit(300))
    return out.drop("w", "h", "n_content", "bx", "by", "bw", "bh")


_PLACE = ", ".join(f"({i}, {s}, '{l}')" for i, (s, l) in enumerate(dims.PLACEMENTS))


@query("r24_ratio_info", f"""WITH sz AS (SELECT p_partkey, p_size * 8 AS w, CAST(p_partkey % 50 + 1 AS INT) * 6 AS h FROM part),
 near AS (SELECT p_partkey, arg_min(label, (abs(ln(w / h / s)), pos)) AS nearest_placement
  FROM sz, (VALUES {_PLACE}) pl(pos, s, label) GROUP BY p_partkey)
 SELECT p_partkey, w, h, (w // gcd(w, h))::VARCHAR || ':' || (h // gcd(w, h))::VARCHAR AS ratio,
 w::VARCHAR || ':' || h::VARCHAR || CASE WHEN w <= h THEN printf(' (1 : %.2f)', greatest(w, h) / least(w, h)::DOUBLE)
 ELSE printf(' (%.2f : 1)', greatest(w, h) / least(w, h)::DOUBLE) END AS ratio_normalised,
 CASE WHEN greatest(w, h) // gcd(w, h) <= 50 THEN (w // gcd(w, h))::VARCHAR || ':' || (h // gcd(w, h))::VARCHAR
 ELSE printf('%.2f:1', w / h::DOUBLE) END AS aspect_text, nearest_placement FROM sz JOIN near USING (p_partkey)""")
def r24_ratio_info(t):
    sizes = t("part").select(
        "p_partkey", (F.col("p_size") * 8).alias("w"),
        ((F.col("p_partkey") % 50 + 1).cast("int") * 6).alias("h"))
    return metrics.ratio_info(sizes)


# ---- neighbourhoods ----------------------------------------------------------------

def _kernel_rows(kernel):
    return ", ".join(f"({dx}, {dy})" for dy, half in kernel.items() for dx in range(-half, half + 1))


def _nb(name, kernel, expr, alias, source="px"):
    """SQL: fold ``expr`` of the neighbours (n) of each pixel over a kernel."""
    return (
        f"{name} AS MATERIALIZED (SELECT c.image_id, c.x, c.y, {expr} AS {alias} FROM {source} c, "
        f"(VALUES {_kernel_rows(kernel)}) k(dx, dy), {source} n WHERE n.image_id = c.image_id "
        f"AND n.x = c.x + k.dx AND n.y = c.y + k.dy GROUP BY c.image_id, c.x, c.y)"
    )


@query("n1_morphology", f"""WITH {RX}, {_nb('d2', kernels.ellipse(2), 'max(CAST(n.a = 255 AS INT))', 'v')},
 {_nb('d3', kernels.ellipse(3), 'max(CAST(n.a = 255 AS INT))', 'v')},
 {_nb('ec', kernels.CROSS, 'min(CAST(n.a > 0 AS INT))', 'v')}, {_nb('eb', kernels.box(4), 'min(CAST(n.a > 0 AS INT))', 'v')}
 SELECT image_id, CAST(sum(d2.v) AS BIGINT) AS ellipse2, CAST(sum(d3.v) AS BIGINT) AS ellipse3,
 CAST(sum(ec.v) AS BIGINT) AS cross_min, CAST(sum(eb.v) AS BIGINT) AS box9_min
 FROM d2 JOIN d3 USING (image_id, x, y) JOIN ec USING (image_id, x, y) JOIN eb USING (image_id, x, y) GROUP BY image_id""")
def n1_morphology(t):
    px = rx(t).withColumn("solid", (F.col("a") == 255).cast("int")).withColumn("seen", (F.col("a") > 0).cast("int"))
    out = kernels.morph(px, {
        "e2": ("solid", kernels.ellipse(2), "max"), "e3": ("solid", kernels.ellipse(3), "max"),
        "c": ("seen", kernels.CROSS, "min"), "b9": ("seen", kernels.box(4), "min")})
    return out.groupBy("image_id").agg(
        F.sum("e2").alias("ellipse2"), F.sum("e3").alias("ellipse3"),
        F.sum("c").alias("cross_min"), F.sum("b9").alias("box9_min"))


@query("n2_grey_dilation", f"""WITH {RX}, {_nb('g', kernels.ellipse(2), f'max({NLUM})', 'v')}
 SELECT image_id, round_even(sum(v), 3) AS sum_max, round_even(min(v), 4) AS least_max FROM g GROUP BY image_id""")
def n2_grey_dilation(t):
    out = kernels.morph(masks.with_lum(rx(t)), {"v": ("lum", kernels.ellipse(2), "max")})
    return out.groupBy("image_id").agg(half_even(F.sum("v"), 3).alias("sum_max"), half_even(F.min("v"), 4).alias("least_max"))


def _taps(name, source, value, taps, axis):
    """SQL: one reflect-101 separable pass along an axis of an 8-px raster."""
    other = "y" if axis == "x" else "x"
    mid = len(taps) // 2
    rows = ", ".join(f"({i - mid}, {float(v)!r}::DOUBLE)" for i, v in enumerate(taps))
    pos = f"(c.{axis} + k.d + 28) % 14"
    return (
        f"{name} AS MATERIALIZED (SELECT c.image_id, c.x, c.y, sum(k.wt * n.{value}) AS {value} FROM {source} c, "
        f"(VALUES {rows}) k(d, wt), {source} n WHERE n.image_id = c.image_id AND n.{other} = c.{other} "
        f"AND n.{axis} = least({pos}, 14 - {pos}) GROUP BY c.image_id, c.x, c.y)"
    )


_LEVEL = f"lv AS MATERIALIZED (SELECT image_id, x, y, floor(least(255.0, greatest(0.0, {LUM}))) AS v FROM px)"
_SOBEL = ", ".join([
    _LEVEL, _taps("dx1", "lv", "v", kernels.DIFF, "x"), _taps("gx", "dx1", "v", kernels.SMOOTH, "y"),
    _taps("sx1", "lv", "v", kernels.SMOOTH, "x"), _taps("gy", "sx1", "v", kernels.DIFF, "y"),
    "sob AS (SELECT gx.image_id, gx.x, gx.y, gx.v AS gx, gy.v AS gy, sqrt(gx.v * gx.v + gy.v * gy.v) AS mag "
    "FROM gx JOIN gy USING (image_id, x, y))",
])


@query("n3_sobel", f"""WITH {RX}, {_SOBEL} SELECT image_id, round_even(avg(mag), 4) AS mean_mag,
 round_even(max(mag), 4) AS max_mag, round_even(sum(gx), 4) AS sum_gx, round_even(sum(gy), 4) AS sum_gy FROM sob GROUP BY image_id""")
def n3_sobel(t):
    out = kernels.gradient(rx(t).withColumn("level", kernels.level8(luminance())))
    return out.groupBy("image_id").agg(
        half_even(F.avg("mag"), 4).alias("mean_mag"), half_even(F.max("mag"), 4).alias("max_mag"),
        half_even(F.sum("gx"), 4).alias("sum_gx"), half_even(F.sum("gy"), 4).alias("sum_gy"))


_G3, _G11 = kernels.gaussian_taps(3, 0), kernels.gaussian_taps(11, 1.5)


@query("n4_gaussian", f"""WITH {RX}, {_LEVEL}, {_taps('a1', 'lv', 'v', _G3, 'x')}, {_taps('a2', 'a1', 'v', _G3, 'y')},
 {_taps('b1', 'lv', 'v', _G11, 'x')}, {_taps('b2', 'b1', 'v', _G11, 'y')}
 SELECT image_id, round_even(max(a2.v), 4) AS blur3_max, round_even(min(a2.v), 4) AS blur3_min,
 round_even(max(b2.v), 4) AS blur11_max, round_even(min(b2.v), 4) AS blur11_min
 FROM a2 JOIN b2 USING (image_id, x, y) GROUP BY image_id""")
def n4_gaussian(t):
    px = rx(t).withColumn("level", kernels.level8(luminance()))
    small = kernels.separable(px, {"v3": ("level", _G3, _G3)})
    out = kernels.separable(small, {"v11": ("level", _G11, _G11)})
    return out.groupBy("image_id").agg(
        half_even(F.max("v3"), 4).alias("blur3_max"), half_even(F.min("v3"), 4).alias("blur3_min"),
        half_even(F.max("v11"), 4).alias("blur11_max"), half_even(F.min("v11"), 4).alias("blur11_min"))


_HALO = ", ".join([
    _nb("hg", kernels.ellipse(2), "max(CAST(n.a >= 250 AS INT))", "grown"),
    _nb("hn", kernels.ellipse(2), f"max(CASE WHEN n.a >= 250 THEN {NLUM} ELSE 0 END)", "near"),
    f"hf AS (SELECT px.image_id, grown = 1 AND a < 250 AS ring, grown = 1 AND a < 250 AND a >= 32 AND {LUM} > 140 "
    f"AND {LUM} < 250 AND {LUM} > near + 25 AS pale FROM px JOIN hg USING (image_id, x, y) JOIN hn USING (image_id, x, y))",
    "halo AS (SELECT image_id, count(*) FILTER (ring) AS ring_px, count(*) FILTER (pale) AS pale_px FROM hf GROUP BY image_id)",
])


@query("n5_halo", f"""WITH {RX}, {_HALO} SELECT image_id, ring_px, pale_px,
 round_even(CASE WHEN ring_px = 0 THEN 0 ELSE pale_px * 100.0 / ring_px END, 4) AS halo_pct FROM halo""")
def n5_halo(t):
    out = kernels.halo_pct(rx(t))
    return out.withColumn("halo_pct", half_even(F.col("halo_pct"), 4))


_EDGE = ", ".join([
    _nb("eo", kernels.ellipse(2), "max(CAST(n.a >= 200 AS INT))", "outer_"),
    _nb("ei", kernels.ellipse(2), "min(CAST(n.a >= 200 AS INT))", "inner_"),
    "band AS (SELECT px.*, outer_ = 1 AND inner_ = 0 AS band FROM px JOIN eo USING (image_id, x, y) JOIN ei USING (image_id, x, y))",
    "edge AS (SELECT image_id, count(*) FILTER (band) AS edge_pixel_count, "
    "count(*) FILTER (band AND a BETWEEN 1 AND 254) AS edge_contamination_count, "
    "count(*) FILTER (band AND a > 0 AND least(r, g, b) >= 200) AS halo_white_px, "
    "count(*) FILTER (band AND a > 0 AND greatest(r, g, b) <= 55) AS halo_dark_px FROM band GROUP BY image_id)",
])


@query("n6_edge_contamination", f"""WITH {RX}, {_EDGE} SELECT *, CASE WHEN edge_pixel_count = 0 THEN 0.0
 ELSE round_even(edge_contamination_count * 100.0 / edge_pixel_count, 2) END AS edge_contamination_pct FROM edge""")
def n6_edge_contamination(t):
    return kernels.edge_contamination(rx(t))


@query("n7_stray_pixels", f"""WITH {RX}, {_nb('it', kernels.ellipse(3), 'max(CAST(n.a >= 200 AS INT))', 'intent')}
 SELECT image_id, count(*) FILTER (a BETWEEN 1 AND 50 AND intent = 0) AS low_alpha_outside_intent_count,
 count(*) FILTER (a BETWEEN 1 AND 254 AND intent = 1) AS semi_transparent_inside_effects_count
 FROM px JOIN it USING (image_id, x, y) GROUP BY image_id""")
def n7_stray_pixels(t):
    return kernels.stray_pixels(rx(t))


def _dist(name, flag, source="px"):
    return (
        f"{name} AS MATERIALIZED (SELECT c.image_id, c.x, c.y, sqrt(min((c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y))) AS d "
        f"FROM {source} c JOIN {source} n ON n.image_id = c.image_id WHERE {flag} GROUP BY c.image_id, c.x, c.y)"
    )


@query("n8_distance", f"""WITH {RX}, {_dist('dd', 'n.a = 0')} SELECT image_id, CAST(count(d) AS BIGINT) AS n,
 round_even(max(d), 4) AS farthest, round_even(sum(d), 4) AS total FROM px LEFT JOIN dd USING (image_id, x, y) GROUP BY image_id""")
def n8_distance(t):
    out = kernels.distance_to(rx(t).withColumn("hit", F.col("a") == 0), {"d": "hit"})
    return out.groupBy("image_id").agg(
        F.count("d").alias("n"), half_even(F.max("d"), 4).alias("farthest"), half_even(F.sum("d"), 4).alias("total"))


_SOFT = ", ".join([
    _nb("sc", kernels.CROSS, "min(CAST(n.a >= 128 AS INT))", "er"), _dist("dc", "n.a <= 10"), _dist("dq", "n.a >= 245"),
    "sf AS (SELECT px.image_id, a >= 128 AND er = 0 AND dq.d <= 16 AS usable, "
    "a >= 128 AND er = 0 AND dq.d <= 16 AND (dc.d IS NULL OR dc.d + dq.d - 1 > 3) AS soft FROM px "
    "JOIN sc USING (image_id, x, y) LEFT JOIN dc USING (image_id, x, y) LEFT JOIN dq USING (image_id, x, y))",
    "soft AS (SELECT image_id, count(*) FILTER (usable) AS boundary_px, count(*) FILTER (soft) AS soft_px FROM sf GROUP BY image_id)",
])


@query("n9_soft_edges", f"""WITH {RX}, {_SOFT} SELECT image_id, boundary_px, soft_px,
 round_even(CASE WHEN boundary_px = 0 THEN 0 ELSE soft_px * 100.0 / boundary_px END, 4) AS soft_edge_pct FROM soft""")
def n9_soft_edges(t):
    return kernels.soft_edge_pct(rx(t)).withColumn("soft_edge_pct", half_even(F.col("soft_edge_pct"), 4))


@query("n9_soft_edges_opaque")
def n9_soft_edges_opaque(t):
    pseudo = kernels.with_pseudo_alpha(masks.content_mask(rxo(t), "qa"))
    return kernels.soft_edge_pct(pseudo, "pseudo_a").withColumn("soft_edge_pct", half_even(F.col("soft_edge_pct"), 4))


@query("n10_gradients", f"""WITH {RX}, {MASK_QA}, {_SOBEL} SELECT image_id,
 round_even(coalesce(avg(CAST(mag > 3 AND mag < 25 AS INT)) FILTER (content) * 100.0, 0.0), 4) AS gradient_pct
 FROM cm JOIN sob USING (image_id, x, y) GROUP BY image_id""")
def n10_gradients(t):
    out = kernels.gradient_pct(masks.content_mask(rx(t), "qa"))
    return out.withColumn("gradient_pct", half_even(F.col("gradient_pct"), 4))


@query("n11_min_stroke")
def n11_min_stroke(t):
    out = kernels.min_stroke(masks.content_mask(rx(t), "qa"))
    return out.select("image_id", *r4("min_stroke_px"))


@query("n12_min_line_width", f"""WITH {RX}, {_dist('dd', 'n.a = 0')} SELECT image_id,
 round_even(quantile_cont(d, 0.05) * 2, 4) AS min_line_px FROM px LEFT JOIN dd USING (image_id, x, y) WHERE a > 0 GROUP BY image_id""")
def n12_min_line_width(t):
    out = kernels.min_line_width(masks.content_mask(rx(t), "geometry"))
    return out.select("image_id", *r4("min_line_px"))


@query("n13_min_feature", f"""WITH RECURSIVE {RX}, {MASK_QA}, {_CONTENT}, {reach('content_px', 8)}, {component_stats()}
 SELECT image_id, round_even(quantile_cont(y1 - y0 + 1, 0.1), 4) AS min_feature_px FROM cs
 WHERE y1 - y0 + 1 >= 3 AND x1 - x0 + 1 >= 3 AND area >= 12
 AND (y1 - y0 + 1 >= 75 / 25.4 OR x1 - x0 + 1 >= 75 / 25.4) GROUP BY image_id""")
def n13_min_feature(t):
    # At 75 dpi one millimetre is about 3 px, so 8-px rasters exercise every filter.
    px = masks.content_mask(rx(t), "qa").filter("content").select("image_id", "x", "y")
    out = kernels.min_feature(cc.components(px, 8), F.lit(75.0))
    return out.select("image_id", *r4("min_feature_px"))


_CANNY = ", ".join([
    "mg AS MATERIALIZED (SELECT image_id, x, y, gx, gy, abs(gx) + abs(gy) AS m FROM sob)",
    "nm AS (SELECT c.*, " + ", ".join(
        f"coalesce({n}.m, 0) AS {n}" for n in ("wl", "wr", "nu", "sd", "nw", "se", "ne", "sw")) + " FROM mg c "
    + " ".join(
        f"LEFT JOIN mg {n} ON {n}.image_id = c.image_id AND {n}.x = c.x + {dx} AND {n}.y = c.y + {dy}"
        for n, dx, dy in (("wl", -1, 0), ("wr", 1, 0), ("nu", 0, -1), ("sd", 0, 1), ("nw", -1, -1), ("se", 1, 1),
                          ("ne", 1, -1), ("sw", -1, 1))) + ")",
    "weak AS MATERIALIZED (SELECT image_id, x, y, m > 200 AS strong FROM nm WHERE m > 80 AND CASE "
    "WHEN abs(gy) < abs(gx) * tan(pi() / 8) THEN m > wl AND m >= wr "
    "WHEN abs(gy) > abs(gx) * tan(3 * pi() / 8) THEN m > nu AND m >= sd "
    "WHEN (gx < 0) = (gy < 0) THEN m > nw AND m > se ELSE m > ne AND m > sw END)",
    reach("weak", 8),
])


@query("n14_edge_map", f"""WITH RECURSIVE {RX}, {_SOBEL}, {_CANNY},
 alive AS (SELECT DISTINCT c.image_id, c.comp FROM comp c JOIN weak w USING (image_id, x, y) WHERE w.strong)
 SELECT image_id, CAST(count(*) AS BIGINT) AS edge_px, CAST(sum(y * 8 + x) AS BIGINT) AS at
 FROM comp JOIN alive USING (image_id, comp) GROUP BY image_id""")
def n14_edge_map(t):
    px = rx(t).withColumn("level", kernels.level8(luminance())).select("image_id", "w", "h", "x", "y", "level")
    edges = kernels.edge_map(px, "level", 80.0, 200.0).filter("edge")
    return edges.groupBy("image_id").agg(
        F.count("*").alias("edge_px"), F.sum(F.col("y") * 8 + F.col("x")).alias("at"))


def _area_sql(src, value, side_from, side_to, name):
    ov = lambda p, q: (f"(least((s.{p} + 1) * {side_to}, (t.{q} + 1) * {side_from}) - greatest(s.{p} * {side_to}, t.{q} * {side_from}))")
    return (
        f"{name} AS MATERIALIZED (SELECT s.image_id, t.x, t.y, sum(s.{value} * {ov('x', 'x')} * {ov('y', 'y')}) / "
        f"sum({ov('x', 'x')} * {ov('y', 'y')}) AS v FROM {src} s JOIN (SELECT i % {side_to} AS x, i // {side_to} AS y "
        f"FROM range({side_to * side_to}) g(i)) t ON {ov('x', 'x')} > 0 AND {ov('y', 'y')} > 0 GROUP BY s.image_id, t.x, t.y)"
    )


@query("n15_resample", f"""WITH {RX}, {_area_sql('px', 'r', 8, 5, 'small')}, {_area_sql('px', 'r', 8, 12, 'large')},
 nn AS (SELECT image_id, CAST(sum(r) AS BIGINT) AS nearest_sum FROM px, range(5) tx(i), range(5) ty(j)
  WHERE x = i * 8 // 5 AND y = j * 8 // 5 GROUP BY image_id)
 SELECT image_id, round_even(max(small.v), 4) AS small_max, round_even(min(small.v), 4) AS small_min,
 any_value(lg) AS large_max, any_value(nearest_sum) AS nearest_sum FROM small
 JOIN (SELECT image_id, round_even(max(v), 4) AS lg FROM large GROUP BY image_id) USING (image_id)
 JOIN nn USING (image_id) GROUP BY image_id""")
def n15_resample(t):
    px = rx(t)
    small = kernels.resample(px, ["r"], F.lit(5), F.lit(5)).groupBy("image_id").agg(
        half_even(F.max("r"), 4).alias("small_max"), half_even(F.min("r"), 4).alias("small_min"))
    large = kernels.resample(px, ["r"], F.lit(12), F.lit(12)).groupBy("image_id").agg(
        half_even(F.max("r"), 4).alias("large_max"))
    near = kernels.resample_nearest(px, ["r"], F.lit(5), F.lit(5)).groupBy("image_id").agg(
        F.sum("r").alias("nearest_sum"))
    return small.join(large, "image_id").join(near, "image_id")


# ---- transforms --------------------------------------------------------------------

@query("t1_fit_to_ratio", f"""WITH {RX}, sz AS (SELECT *, CASE WHEN image_id % 3 = 0 THEN 1.5 WHEN image_id % 3 = 1 THEN 1.0
 ELSE 0.4 END AS ratio FROM px), nw AS (SELECT *, CASE WHEN ratio > 1 THEN CAST(round_even(8 * ratio, 0) AS INT) ELSE 8 END AS cw,
 CASE WHEN ratio < 1 THEN CAST(round_even(8 / ratio, 0) AS INT) ELSE 8 END AS ch FROM sz)
 SELECT image_id, cw AS w, ch AS h, x + (cw - 8) // 2 AS x, y + (ch - 8) // 2 AS y, a FROM nw""")
def t1_fit_to_ratio(t):
    ratio = F.when(F.col("image_id") % 3 == 0, 1.5).when(F.col("image_id") % 3 == 1, 1.0).otherwise(0.4)
    return transforms.fit_to_ratio(rx(t), ratio).select("image_id", "w", "h", "x", "y", "a")


def _boxes(t):
    """Three boxes per image derived from its id, some reaching past the canvas."""
    e = t("embeddings").select(F.col("vec_id").alias("image_id"))
    i = F.col("image_id")
    return e.select("image_id", F.explode(F.array(*[
        F.struct(F.lit(n).alias("n"), ((i + n) % 7).cast("int").alias("x"), ((i * 3 + n) % 6).cast("int").alias("y"),
                 ((i + 2 * n) % 4).cast("int").alias("w"), ((i % 5) + 1).cast("int").alias("h")) for n in (1, 2, 3)
    ])).alias("s")).select("image_id", "s.*")


_BOXES = ("bx AS (SELECT vec_id AS image_id, n, CAST((vec_id + n) % 7 AS INT) AS x, CAST((vec_id * 3 + n) % 6 AS INT) AS y, "
          "CAST((vec_id + 2 * n) % 4 AS INT) AS w, CAST(vec_id % 5 + 1 AS INT) AS h FROM embeddings, (VALUES (1), (2), (3)) v(n)), "
          "ed AS (SELECT image_id, n, greatest(0, x - {p}) AS x0, greatest(0, y - {p}) AS y0, least(8, x + w + {p}) AS x1, "
          "least(8, y + h + {p}) AS y1 FROM bx)")
_CROPS = (_BOXES.format(p=1) + ", cr AS (SELECT px.image_id, n, x1 - x0 AS w, y1 - y0 AS h, x - x0 AS x, y - y0 AS y, r, g, b, a "
          "FROM px JOIN ed USING (image_id) WHERE x1 > x0 AND y1 > y0 AND x >= x0 AND x < x1 AND y >= y0 AND y < y1)")


@query("t2_crop_boxes", f"WITH {RX}, {_CROPS} SELECT image_id, n, w, h, count(*) AS px, CAST(sum(r * (x + 1) + a * (y + 1)) AS BIGINT) AS chk FROM cr GROUP BY ALL")
def t2_crop_boxes(t):
    crops = transforms.crop_boxes(rx(t), _boxes(t), pad=1)
    return crops.groupBy("image_id", "n", "w", "h").agg(
        F.count("*").alias("px"), F.sum(F.col("r") * (F.col("x") + 1) + F.col("a") * (F.col("y") + 1)).alias("chk"))


@query("j9_range_join_boxes", f"WITH {RX}, {_BOXES.format(p=0)} SELECT image_id, n, count(*) AS px, CAST(sum(g) AS BIGINT) AS g FROM px JOIN ed USING (image_id) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL")
def j9_range_join_boxes(t):
    crops = transforms.crop_boxes(rx(t), _boxes(t), pad=0)
    return crops.groupBy("image_id", "n").agg(F.count("*").alias("px"), F.sum("g").alias("g"))


@query("t3_grid_split", f"""WITH {RX} SELECT image_id, CAST(y // 4 * 3 + x // 2 AS INT) AS n, 2 AS w, 4 AS h, CAST(sum(r * (x % 2 + 1) + b * (y % 4 + 1)) AS BIGINT) AS chk
 FROM px WHERE x < 6 AND y < 8 GROUP BY ALL""")
def t3_grid_split(t):
    cells = transforms.grid_split(rx(t), 3, 2)
    return cells.groupBy("image_id", "n", "w", "h").agg(
        F.sum(F.col("r") * (F.col("x") + 1) + F.col("b") * (F.col("y") + 1)).alias("chk"))


@query("t4_validate_crops", f"""WITH {RX}, {_CROPS}, inf AS (SELECT image_id, n, w, h, bool_or(a < 250) AS clear,
 count(*) FILTER (a > 128) AS opq, count(*) FILTER (a > 128 AND y = 0) / w AS t, count(*) FILTER (a > 128 AND y = h - 1) / w AS bt,
 count(*) FILTER (a > 128 AND x = 0) / h AS l, count(*) FILTER (a > 128 AND x = w - 1) / h AS r FROM cr GROUP BY image_id, n, w, h),
 fl AS (SELECT image_id, n, clear AND (CAST(t > 0 AS INT) + CAST(bt > 0 AS INT) + CAST(l > 0 AS INT) + CAST(r > 0 AS INT) > 2
 OR greatest(t, bt, l, r) > 0.6) AS touches, CASE WHEN clear THEN opq ELSE w * h END AS area, w / h AS aspect FROM inf),
 md AS (SELECT image_id, quantile_cont(area, 0.5) AS ma, quantile_cont(aspect, 0.5) AS mp FROM fl GROUP BY image_id)
 SELECT image_id, n, CAST(area AS BIGINT) AS area, touches, nullif(concat_ws('; ', CASE WHEN touches THEN 'Content touches edge (may be cut off)' END,
 CASE WHEN ma > 0 AND abs(area - ma) > ma * 0.6 THEN 'Unusual size' END,
 CASE WHEN mp > 0 AND abs(aspect - mp) > mp * 0.5 THEN 'Unusual shape' END), '') AS warning FROM fl JOIN md USING (image_id)""")
def t4_validate_crops(t):
    return transforms.validate_crops(transforms.crop_boxes(rx(t), _boxes(t), pad=1))


@query("t5_black_out", f"""WITH {RX} SELECT image_id, CAST(count(*) FILTER (greatest(r, g, b) < 120 AND a > 0) AS BIGINT) AS knocked,
 CAST(sum(CASE WHEN greatest(r, g, b) < 120 AND a > 0 THEN 0 ELSE a END) AS BIGINT) AS alpha_left FROM px GROUP BY image_id""")
def t5_black_out(t):
    # Mid-grey rasters: the black threshold is raised so that some pixels drop out.
    px = rx(t)
    out = transforms.black_out(px, threshold=120, feather=0)
    return _flood_summary(px, out).withColumnRenamed("removed", "knocked")


@query("t5_black_out_feathered", f"""WITH {RX}, bm AS MATERIALIZED (SELECT image_id, x, y, CASE WHEN greatest(r, g, b) < 120 AND a > 0 THEN 255.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM px),
 {_taps('f1', 'bm', 'v', kernels.gaussian_taps(7, 1.0), 'x')}, {_taps('f2', 'f1', 'v', kernels.gaussian_taps(7, 1.0), 'y')}
 SELECT image_id, CAST(sum(greatest(0, floor(a * (1 - round_even(f2.v, 0) / 255.0)))) AS BIGINT) AS alpha_left FROM px JOIN f2 USING (image_id, x, y) GROUP BY image_id""")
def t5_black_out_feathered(t):
    out = transforms.black_out(rx(t), threshold=120, feather=1)
    return out.groupBy("image_id").agg(F.sum("a").cast("bigint").alias("alpha_left"))


@query("t6_halftone_cells", f"""WITH {RX}, par AS (SELECT radians(22.5) AS th, 2.5::DOUBLE AS cell),
 gr AS (SELECT i AS gi, j AS gj, CAST(round_even(4 + i * cell * cos(th) - j * cell * sin(th), 0) AS INT) AS px,
 CAST(round_even(4 + i * cell * sin(th) + j * cell * cos(th), 0) AS INT) AS py FROM par, range(-8, 9) a(i), range(-8, 9) b(j)),
 ce AS (SELECT image_id, gi, gj, gr.px, gr.py, avg(a / 255.0) AS cov, sum(a / 255.0) AS sc, sum((1 - {LUM} / 255.0) * a / 255.0) AS si
 FROM px JOIN gr ON gr.px >= 0 AND gr.px < 8 AND gr.py >= 0 AND gr.py < 8 AND abs(x - gr.px) <= 2 AND abs(y - gr.py) <= 2 GROUP BY ALL)
 SELECT image_id, CAST(count(*) AS BIGINT) AS dots, round_even(sum(sqrt(greatest(0, least(1, si / greatest(sc, 1e-6)))) * 1.25), 4) AS radius_sum
 FROM ce WHERE cov >= 0.5 AND sqrt(greatest(0, least(1, si / greatest(sc, 1e-6)))) * 1.25 >= 0.6 GROUP BY image_id""")
def t6_halftone_cells(t):
    dots = transforms.halftone_cells(rx(t), lpi=40.0, dpi=100.0)
    return dots.groupBy("image_id").agg(F.count("*").alias("dots"), half_even(F.sum("radius"), 4).alias("radius_sum"))


@query("t6_halftone_pixels", f"""WITH {RX}, par AS (SELECT radians(22.5) AS th, 2.5::DOUBLE AS cell),
 gr AS (SELECT i AS gi, j AS gj, CAST(round_even(4 + i * cell * cos(th) - j * cell * sin(th), 0) AS INT) AS px,
 CAST(round_even(4 + i * cell * sin(th) + j * cell * cos(th), 0) AS INT) AS py FROM par, range(-8, 9) a(i), range(-8, 9) b(j)),
 ce AS (SELECT image_id, gi, gj, gr.px, gr.py, avg(a / 255.0) AS cov, sum(a / 255.0) AS sc, sum((1 - {LUM} / 255.0) * a / 255.0) AS si
 FROM px JOIN gr ON gr.px >= 0 AND gr.px < 8 AND gr.py >= 0 AND gr.py < 8 AND abs(x - gr.px) <= 2 AND abs(y - gr.py) <= 2 GROUP BY ALL),
 ra AS (SELECT image_id, px AS dx, py AS dy, sqrt(greatest(0, least(1, si / greatest(sc, 1e-6)))) * 1.25 AS radius FROM ce WHERE cov >= 0.5)
 SELECT image_id, count(*) AS ink_px FROM px p WHERE a / 255.0 >= 0.5 AND EXISTS (
 SELECT 1 FROM ra WHERE ra.image_id = p.image_id AND radius >= 0.6 AND (x - dx) * (x - dx) + (y - dy) * (y - dy) <= radius * radius) GROUP BY image_id""")
def t6_halftone_pixels(t):
    px = rx(t)
    inked = transforms.halftone_pixels(px, transforms.halftone_cells(px, lpi=40.0, dpi=100.0))
    return inked.groupBy("image_id").agg(F.count("*").alias("ink_px"))


@query("t7_make_print_ready", f"""WITH {RX}, bb AS (SELECT image_id, min(x) FILTER (a > 0) AS tx, min(y) FILTER (a > 0) AS ty,
 max(x) FILTER (a > 0) - min(x) FILTER (a > 0) + 1 AS fw, max(y) FILTER (a > 0) - min(y) FILTER (a > 0) + 1 AS fh FROM px GROUP BY image_id),
 pl AS (SELECT image_id, coalesce(tx, 0) AS tx, coalesce(ty, 0) AS ty, coalesce(fw, 8) AS fw, coalesce(fh, 8) AS fh FROM bb),
 sz AS (SELECT *, fw <> 8 OR fh <> 8 AS trimmed, abs(fw - 12) > 2 OR abs(fh - 15) > 2 AS off, least(12 / fw, 15 / fh) AS sc FROM pl),
 ft AS (SELECT *, CASE WHEN off THEN greatest(1, CAST(round_even(fw * sc, 0) AS INT)) ELSE fw END AS fit_w,
 CASE WHEN off THEN greatest(1, CAST(round_even(fh * sc, 0) AS INT)) ELSE fh END AS fit_h FROM sz),
 cells AS (SELECT image_id, u.i AS ox, v.i AS oy, sum(a * (least((x - tx + 1) * fit_w, (u.i + 1) * fw) - greatest((x - tx) * fit_w, u.i * fw))
 * (least((y - ty + 1) * fit_h, (v.i + 1) * fh) - greatest((y - ty) * fit_h, v.i * fh))) / any_value(fw * fh) AS av
 FROM px JOIN ft USING (image_id), range(15) u(i), range(15) v(i)
 WHERE u.i < fit_w AND v.i < fit_h AND x >= tx AND x < tx + fw AND y >= ty AND y < ty + fh
 AND least((x - tx + 1) * fit_w, (u.i + 1) * fw) > greatest((x - tx) * fit_w, u.i * fw)
 AND least((y - ty + 1) * fit_h, (v.i + 1) * fh) > greatest((y - ty) * fit_h, v.i * fh) GROUP BY image_id, ox, oy),
 al AS (SELECT image_id, round_even(round(av, 6), 0) AS lv FROM cells)
 SELECT image_id, any_value(trimmed) AS trimmed, any_value(fw) AS fw, any_value(fh) AS fh, any_value(fit_w) AS fit_w, any_value(fit_h) AS fit_h,
 any_value(CASE WHEN off THEN 12 ELSE fw END) AS out_w, any_value(CASE WHEN off THEN 15 ELSE fh END) AS out_h,
 CAST(count(*) FILTER (lv > 0 AND lv < 255) AS BIGINT) AS changed_px, CAST(count(*) FILTER (lv > 0 AND lv < 120) AS BIGINT) AS became_clear,
 CAST(count(*) FILTER (lv >= 120 AND lv < 255) AS BIGINT) AS became_opaque FROM al JOIN ft USING (image_id) GROUP BY image_id""")
def t7_make_print_ready(t):
    out = transforms.make_print_ready(rx(t), 12, 15)
    return out.select("image_id", "trimmed", "fw", "fh", "fit_w", "fit_h", "out_w", "out_h",
                      "changed_px", "became_clear", "became_opaque")


@query("t8_swatch_preview", f"""WITH {RX}, {', '.join(_area_sql('px', c, 8, 12, 's_' + c) for c in 'rgba')},
 bl AS (SELECT image_id, x, y, round_even(round(s_r.v * s_a.v / 255.0 + 31 * (1 - s_a.v / 255.0), 6), 0) AS r,
 round_even(round(s_g.v * s_a.v / 255.0 + 42 * (1 - s_a.v / 255.0), 6), 0) AS g, round_even(round(s_b.v * s_a.v / 255.0 + 68 * (1 - s_a.v / 255.0), 6), 0) AS b
 FROM s_r JOIN s_g USING (image_id, x, y) JOIN s_b USING (image_id, x, y) JOIN s_a USING (image_id, x, y))
 SELECT image_id, CAST(count(*) AS BIGINT) AS px, CAST(min(x) + 2 AS INT) AS x0, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b FROM bl GROUP BY image_id""")
def t8_swatch_preview(t):
    px = rx(t)
    navy = px.select("image_id").distinct().select(
        "image_id", F.lit(31).alias("sr"), F.lit(42).alias("sg"), F.lit(68).alias("sb"))
    out = transforms.composite_on_swatch(px, navy, size=16)
    return out.groupBy("image_id").agg(
        F.count("*").alias("px"), F.min("x").alias("x0"), F.sum("r").cast("bigint").alias("r"),
        F.sum("g").cast("bigint").alias("g"), F.sum("b").cast("bigint").alias("b"))


_FLAT = lambda c: f"floor(CASE WHEN content THEN {c} * a / 255.0 + 128 * (1 - a / 255.0) ELSE 128.0 END)"
_GREY = (f"gv AS MATERIALIZED (SELECT image_id, x, y, content, round_even(({_FLAT('r')} * 299 + {_FLAT('g')} * 587 + {_FLAT('b')} * 114) / 1000, 0) AS grey FROM cm)")


@query("t9_neutral_grey", f"""WITH {RX}, {MASK_COMPARE}, {_GREY}, {_BOX},
 cp AS (SELECT gv.image_id, coalesce(bw, 8) AS cw, coalesce(bh, 8) AS ch, gv.x - coalesce(bx, 0) AS x, gv.y - coalesce("by", 0) AS y, grey, content FROM gv JOIN bb USING (image_id)
 WHERE gv.x >= coalesce(bx, 0) AND gv.x < coalesce(bx, 0) + coalesce(bw, 8) AND gv.y >= coalesce("by", 0) AND gv.y < coalesce("by", 0) + coalesce(bh, 8)),
 sz AS (SELECT *, greatest(1, CAST(round_even(cw * (12.0 / greatest(cw, ch)), 0) AS INT)) AS nw, greatest(1, CAST(round_even(ch * (12.0 / greatest(cw, ch)), 0) AS INT)) AS nh FROM cp),
 ar AS (SELECT image_id, nw, nh, u.i AS tx, v.i AS ty, round_even(round(sum(grey * (least((x + 1) * nw, (u.i + 1) * cw) - greatest(x * nw, u.i * cw))
 * (least((y + 1) * nh, (v.i + 1) * ch) - greatest(y * nh, v.i * ch))) / any_value(cw * ch), 6), 0) AS grey FROM sz, range(12) u(i), range(12) v(i)
 WHERE u.i < nw AND v.i < nh AND least((x + 1) * nw, (u.i + 1) * cw) > greatest(x * nw, u.i * cw) AND least((y + 1) * nh, (v.i + 1) * ch) > greatest(y * nh, v.i * ch)
 GROUP BY image_id, nw, nh, tx, ty),
 mk AS (SELECT image_id, CAST(sum(CAST(content AS INT)) AS BIGINT) AS content_px FROM sz, range(12) u(i), range(12) v(i)
 WHERE u.i < nw AND v.i < nh AND x = u.i * cw // nw AND y = v.i * ch // nh GROUP BY image_id)
 SELECT image_id, nw + 4 AS w, nh + 4 AS h, CAST(sum(grey) + 128 * ((nw + 4) * (nh + 4) - nw * nh) AS BIGINT) AS grey_sum, any_value(content_px) AS content_px
 FROM ar JOIN mk USING (image_id) GROUP BY image_id, nw, nh""")
def t9_neutral_grey(t):
    view = transforms.neutral_grey(masks.content_mask(rx(t), "compare"), long_side=12, pad=2)
    return view.groupBy("image_id", "w", "h").agg(
        F.sum("grey").cast("bigint").alias("grey_sum"), F.sum("content").alias("content_px"))


@query("g23_finite", f"""WITH {RX} SELECT image_id, CASE WHEN count(*) FILTER (a = 0) = 0 THEN NULL
 ELSE round_even(sum(r) / nullif(count(*) FILTER (a = 0), 0), 4) END AS ratio FROM px GROUP BY image_id""")
def g23_finite(t):
    zero = F.sum(F.when(F.col("a") == 0, 1.0).otherwise(0.0))
    agg = rx(t).groupBy("image_id").agg(F.sum("r").cast("double").alias("s"), zero.alias("z"))
    ratio = F.when(F.col("z") == 0, F.lit(float("inf"))).otherwise(F.try_divide("s", "z"))
    return agg.select("image_id", half_even(finite(ratio), 4).alias("ratio"))


@query("g24_prefer_transparent", f"""WITH {BOTH}, ow AS (SELECT image_id, bool_and(a = 255 AND least(r, g, b) >= 100) AS opq
 FROM px WHERE {CORNER} > 0 GROUP BY image_id), gr AS (SELECT image_id, image_id // 4 AS grp, opq FROM ow)
 SELECT grp, image_id, opq AS opaque_white FROM gr WHERE NOT opq OR grp NOT IN (SELECT grp FROM gr WHERE NOT opq)""")
def g24_prefer_transparent(t):
    flags = masks.is_opaque_white(both(t), tolerance=155).withColumn("grp", F.floor(F.col("image_id") / 4))
    return transforms.prefer_transparent(flags, "grp", "opaque_white").select("grp", "image_id", "opaque_white")
