"""Pair comparison, geometry and print-readiness queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rasterqa import dims
from rasterqa.functions.numbers import half_even, luminance, px_to_mm
from rasterqa.operators import compare, components as cc, geometry, hashjoin, kernels, masks, metrics, objects, qa, transforms
from rasterqa.plans import raster
from rasterqa.plans.raster import (
    _BLACK, _BOX, _CONTENT, _DOM, _EDGE, _HALO, _PLACE, _SOBEL, _SOFT, _dist, _nb, _taps, both, rx,
)
from rasterqa.plans.registry import query
from rasterqa.plans.sqlparts import (
    BOTH, LUM, MASK_COMPARE, MASK_GEOMETRY, MASK_QA, RING, RX, component_stats, reach, stamped,
)

def pairs_of(t):
    """(2k, 2k+1) under the even id 2k, and every image i with itself under the odd id 2i+1."""
    ids = t("embeddings").select(F.col("vec_id").alias("i"))
    near = ids.filter("i % 2 = 0").select(
        F.col("i").alias("pair_id"), F.col("i").alias("original_id"), (F.col("i") + 1).alias("generated_id"))
    same = ids.select((F.col("i") * 2 + 1).alias("pair_id"), F.col("i").alias("original_id"),
                      F.col("i").alias("generated_id"))
    return near.unionByName(same)


PAIRS = (
    "pairs AS MATERIALIZED (SELECT vec_id AS pair_id, vec_id AS original_id, vec_id + 1 AS generated_id FROM embeddings "
    "WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id * 2 + 1, vec_id, vec_id FROM embeddings)"
)
GREY = f"gr AS MATERIALIZED (SELECT image_id, x, y, a, round_even({LUM}, 0) AS v FROM px)"


def _dct(size, low, ortho):
    block = size // 8
    wave = lambda k: f"(SELECT sum(cos((2 * ({block} * p + z.z) + 1) * pi() * {k} / {2 * size})) FROM range({block}) z(z))"
    scale = lambda k: f"(CASE WHEN {k} = 0 THEN sqrt(0.5::DOUBLE) ELSE 1 END)" if ortho else "1"
    return (
        f"basis AS MATERIALIZED (SELECT p, k, {scale('k')} * s AS wt FROM (SELECT p, k, sum(cos((2 * ({block} * p + z) + 1) * pi() * k / {2 * size})) AS s "
        f"FROM range(8) a(p), range({low}) b(k), range({block}) c(z) GROUP BY p, k)), "
        "dr AS MATERIALIZED (SELECT image_id, y, k AS u, sum(v * wt) AS c FROM gr JOIN basis ON p = x GROUP BY image_id, y, u), "
        "dc AS MATERIALIZED (SELECT image_id, u, k AS v, round(sum(c * wt), 6) AS c FROM dr JOIN basis ON p = y GROUP BY image_id, u, v), "
        f"md AS (SELECT image_id, round(quantile_cont(c, 0.5), 6) AS m FROM dc {'WHERE v > 0' if ortho else ''} GROUP BY image_id), "
        "hb AS MATERIALIZED (SELECT image_id, string_agg(CASE WHEN c > m THEN '1' ELSE '0' END, '' ORDER BY v, u) AS hash_bits "
        "FROM dc JOIN md USING (image_id) GROUP BY image_id)"
    )


DCT256, DCT64 = _dct(64, 16, False), _dct(32, 8, True)


def grey_of(t):
    return rx(t).withColumn("grey", half_even(luminance()))


@query("c1_phash256", f"WITH {RX}, {GREY}, {DCT256} SELECT image_id, hash_bits FROM hb")
def c1_phash256(t):
    return compare.phash256(grey_of(t)).select("image_id", "hash_bits")


@query("c2_phash64", f"WITH {RX}, {GREY}, {DCT64} SELECT image_id, hash_bits FROM hb")
def c2_phash64(t):
    return compare.phash64(rx(t)).select("image_id", "hash_bits")


_HAM = ("hm AS (SELECT pair_id, length(o.hash_bits) AS bits, len(list_filter(range(1, length(o.hash_bits) + 1), "
        "lambda i: o.hash_bits[i] <> g.hash_bits[i])) AS d FROM pairs JOIN hb o ON o.image_id = original_id JOIN hb g ON g.image_id = generated_id)")


@query("c3_hash_similarity", f"WITH {RX}, {PAIRS}, {GREY}, {DCT64}, {_HAM} SELECT pair_id, CAST(d AS INT) AS distance, (1 - d / bits) * 100.0::DOUBLE AS similarity_pct FROM hm")
def c3_hash_similarity(t):
    hashes = compare.phash64(rx(t)).select("image_id", "words")
    both_sides = compare.pair_up(pairs_of(t), hashes)
    o, g = F.col("o_words"), F.col("g_words")
    return both_sides.select("pair_id", compare.hamming(o, g).alias("distance"),
                             compare.hash_similarity(o, g, 64).alias("similarity_pct"))


FEATURES = (
    f"{_CONTENT}, {reach('content_px', 8)}, {component_stats()}, {raster._OUTER}, "
    "nc AS (SELECT image_id, count(*) FILTER (area > 0.005 * total AND oc.comp IS NOT NULL) AS n_contours FROM cs LEFT JOIN outer_comp oc USING (image_id, comp) JOIN (SELECT image_id, sum(area) AS total FROM cs GROUP BY image_id) USING (image_id) GROUP BY image_id), "
    "ft AS MATERIALIZED (SELECT image_id, coalesce(any_value(n_contours), 0) AS n_contours, "
    "coalesce((max(x) FILTER (content) - min(x) FILTER (content) + 1) / (max(y) FILTER (content) - min(y) FILTER (content) + 1), 1.0) AS asp, "
    "coalesce(least(1.0, count(*) FILTER (content) / ((max(x) FILTER (content) - min(x) FILTER (content) + 1) * (max(y) FILTER (content) - min(y) FILTER (content) + 1))), 0.0) AS fill, "
    "coalesce((avg(x) FILTER (content) - min(x) FILTER (content)) / (max(x) FILTER (content) - min(x) FILTER (content) + 1), 0.5) AS cx, "
    "coalesce((avg(y) FILTER (content) - min(y) FILTER (content)) / (max(y) FILTER (content) - min(y) FILTER (content) + 1), 0.5) AS cy, "
    "coalesce(round_even(avg(r) FILTER (content), 0), 0) AS mr, coalesce(round_even(avg(g) FILTER (content), 0), 0) AS mg, coalesce(round_even(avg(b) FILTER (content), 0), 0) AS mb "
    "FROM cm LEFT JOIN nc USING (image_id) GROUP BY image_id)"
)
SHAPE = (
    "shp AS (SELECT pair_id, CAST(round_even(greatest(0, least(1, 0.35::DOUBLE * CASE WHEN o.asp <= 0 OR g.asp <= 0 THEN 0 ELSE 1 - least(1, abs(o.asp - g.asp) / greatest(o.asp, g.asp)) END "
    "+ 0.30::DOUBLE * (1 - least(1, abs(o.fill - g.fill))) + 0.20::DOUBLE * (1 - least(1, sqrt(pow(o.cx - g.cx, 2) + pow(o.cy - g.cy, 2)) / 0.5)) "
    "+ 0.15::DOUBLE * CASE WHEN o.n_contours = 0 AND g.n_contours = 0 THEN 1 ELSE 1 - least(1, abs(o.n_contours - g.n_contours) / greatest(o.n_contours, g.n_contours, 1)) END)) * 100, 0) AS INT) AS shape_pct "
    "FROM pairs JOIN ft o ON o.image_id = original_id JOIN ft g ON g.image_id = generated_id)"
)
COLOUR = (
    _DOM.format(s=24).replace("dc AS", "dmc AS").replace("dr AS", "dmr AS").replace("FROM dc", "FROM dmc")
    + ", top AS MATERIALIZED (SELECT image_id, rank, r, g, b FROM dmr WHERE rank <= 5), "
    "mt AS (SELECT pair_id, count(*) AS total, count(*) FILTER (EXISTS (SELECT 1 FROM top q WHERE q.image_id = generated_id "
    "AND abs(q.r - p.r) <= 32 AND abs(q.g - p.g) <= 32 AND abs(q.b - p.b) <= 32)) AS hits FROM pairs JOIN top p ON p.image_id = original_id GROUP BY pair_id), "
    "col AS (SELECT pair_id, coalesce(CAST(hits AS INT), 0) AS colour_matches, CAST(round_even(greatest(0, least(1, 0.6::DOUBLE * coalesce(hits / total, 0) "
    "+ 0.4::DOUBLE * (1 - least(1, sqrt(pow(o.mr - g.mr, 2) + pow(o.mg - g.mg, 2) + pow(o.mb - g.mb, 2)) / 441.67::DOUBLE)))) * 100, 0) AS INT) AS colour_pct "
    "FROM pairs JOIN ft o ON o.image_id = original_id JOIN ft g ON g.image_id = generated_id LEFT JOIN mt USING (pair_id))"
)


@query("c5_shape_similarity", f"WITH RECURSIVE {RX}, {PAIRS}, {MASK_COMPARE}, {FEATURES}, {SHAPE} SELECT pair_id, shape_pct FROM shp")
def c5_shape_similarity(t):
    both_sides = compare.pair_up(pairs_of(t), compare.image_features(rx(t)))
    return both_sides.select("pair_id", compare.shape_similarity().alias("shape_pct"))


@query("c6_colour_similarity", f"WITH RECURSIVE {RX}, {PAIRS}, {MASK_COMPARE}, {FEATURES}, {COLOUR} SELECT pair_id, colour_pct, colour_matches FROM col")
def c6_colour_similarity(t):
    both_sides = compare.pair_up(pairs_of(t), compare.image_features(rx(t)))
    return both_sides.select("pair_id", compare.colour_similarity().alias("colour_pct"),
                             compare.colour_matches().alias("colour_matches"))


@query("j11_colour_band_join", f"""WITH {RX}, {PAIRS}, {MASK_COMPARE}, {_DOM.format(s=24)}, top AS MATERIALIZED (SELECT image_id, rank, r, g, b FROM dr WHERE rank <= 5)
 SELECT pair_id, p.rank AS o_rank, q.rank AS g_rank FROM pairs JOIN top p ON p.image_id = original_id JOIN top q ON q.image_id = generated_id
 WHERE abs(q.r - p.r) <= 32 AND abs(q.g - p.g) <= 32 AND abs(q.b - p.b) <= 32""")
def j11_colour_band_join(t):
    from rasterqa.operators import colour
    from rasterqa.operators.joins import band_join

    top = colour.dominant_colours(masks.content_mask(rx(t), "compare"))
    left = pairs_of(t).join(top.withColumnRenamed("image_id", "original_id"), "original_id").select(
        "pair_id", F.col("rank").alias("o_rank"), "r", "g", "b")
    right = pairs_of(t).join(top.withColumnRenamed("image_id", "generated_id"), "generated_id").select(
        "pair_id", F.col("rank").alias("g_rank"), "r", "g", "b")
    hit = band_join(left, right, ["pair_id"], ["r", "g", "b"], dims.COLOUR_TOLERANCE)
    return hit.select("pair_id", "o_rank", "g_rank")


def native_frames(t):
    """Both rasters of each pair on their own 8x8 grid, no crop or resize."""
    grey = masks.content_mask(grey_of(t), "compare").select(
        "image_id", "w", "h", "x", "y", "grey", F.col("content").cast("int").alias("c"))
    pairs = pairs_of(t)
    left = pairs.join(grey.withColumnRenamed("image_id", "original_id"), "original_id").select(
        "pair_id", "w", "h", "x", "y", F.col("grey").alias("grey_o"), F.col("c").alias("co"))
    right = pairs.join(grey.withColumnRenamed("image_id", "generated_id"), "generated_id").select(
        "pair_id", "x", "y", F.col("grey").alias("grey_g"), F.col("c").alias("cg"))
    return left.join(right, ["pair_id", "x", "y"]).select(
        "pair_id", "w", "h", "x", "y", "grey_o", "grey_g", F.greatest("co", "cg").alias("region"))


_CANNY_LOW = raster._CANNY.replace("m > 200", "m > 110").replace("m > 80", "m > 40")
EDGES = ", ".join([
    _taps("eb1", "gr", "v", [0.25, 0.5, 0.25], "x"), _taps("eb2", "eb1", "v", [0.25, 0.5, 0.25], "y"),
    "lv AS MATERIALIZED (SELECT image_id, x, y, round_even(v, 0) AS v FROM eb2)",
    _SOBEL[_SOBEL.index("dx1 AS"):],
    _CANNY_LOW.replace("comp_seen", "ec_seen").replace("comp AS", "ecomp AS").replace("AS comp FROM", "AS comp FROM"),
    "ed AS MATERIALIZED (SELECT image_id, x, y FROM ecomp WHERE (image_id, comp) IN (SELECT (c.image_id, c.comp) FROM ecomp c JOIN weak w USING (image_id, x, y) WHERE w.strong))",
    "eo AS MATERIALIZED (SELECT pair_id, x, y FROM pairs JOIN ed ON image_id = original_id)",
    "eg AS MATERIALIZED (SELECT pair_id, x, y FROM pairs JOIN ed ON image_id = generated_id)",
    "no_ AS (SELECT pair_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM eg q WHERE q.pair_id = p.pair_id AND (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) <= 9)) AS hit FROM eo p GROUP BY pair_id)",
    "ng_ AS (SELECT pair_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM eo q WHERE q.pair_id = p.pair_id AND (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) <= 9)) AS hit FROM eg p GROUP BY pair_id)",
    "ef AS (SELECT pair_id, coalesce(o.n, 0) AS n_o, coalesce(g.n, 0) AS n_g, CASE WHEN o.n IS NULL AND g.n IS NULL THEN 1.0 WHEN o.n IS NULL OR g.n IS NULL THEN 0.0 "
    "WHEN o.hit + g.hit = 0 THEN 0.0 ELSE 2 * (o.hit / o.n) * (g.hit / g.n) / (o.hit / o.n + g.hit / g.n) END AS f1 FROM pairs LEFT JOIN no_ o USING (pair_id) LEFT JOIN ng_ g USING (pair_id))",
])


@query("c7_edge_f1", f"WITH RECURSIVE {RX}, {PAIRS}, {GREY}, {EDGES} SELECT pair_id, n_o, n_g, round_even(f1, 4) AS edge_f1 FROM ef")
def c7_edge_f1(t):
    out = compare.edge_f1(compare.frame_edges(native_frames(t)))
    return out.withColumn("edge_f1", half_even(F.col("edge_f1"), 4))


_S11 = kernels.gaussian_taps(11, 1.5)
_fr = ("fr AS MATERIALIZED (SELECT pair_id AS image_id, o.x, o.y, o.v AS p, g.v AS q, o.v * o.v AS pp, g.v * g.v AS qq, o.v * g.v AS pq, "
       "CAST(o.a > 128 OR g.a > 128 AS INT) AS a FROM pairs JOIN gr o ON o.image_id = original_id JOIN gr g ON g.image_id = generated_id AND g.x = o.x AND g.y = o.y)")
SSIM = ", ".join(
    [_fr] + [x for c in ("p", "q", "pp", "qq", "pq")
             for x in (_taps(f"s1{c}", "fr", c, _S11, "x"), _taps(f"s2{c}", f"s1{c}", c, _S11, "y"))]
    + [_nb("rg", kernels.box(4), "max(n.a)", "near", source="fr"),
       "sl AS (SELECT image_id, near, ((2 * a.p * b.q + 6.5025::DOUBLE) * (2 * (e.pq - a.p * b.q) + 58.5225::DOUBLE)) / ((a.p * a.p + b.q * b.q + 6.5025::DOUBLE) "
       "* ((c.pp - a.p * a.p) + (d.qq - b.q * b.q) + 58.5225::DOUBLE)) AS s FROM s2p a JOIN s2q b USING (image_id, x, y) JOIN s2pp c USING (image_id, x, y) "
       "JOIN s2qq d USING (image_id, x, y) JOIN s2pq e USING (image_id, x, y) JOIN rg USING (image_id, x, y))",
       "ss AS MATERIALIZED (SELECT image_id AS pair_id, greatest(0, least(1, coalesce(avg(s) FILTER (near = 1), avg(s)))) AS ssim FROM sl GROUP BY image_id)"])


@query("c8_ssim", f"WITH {RX}, {PAIRS}, {GREY}, {SSIM} SELECT pair_id, round_even(ssim, 4) AS ssim FROM ss")
def c8_ssim(t):
    return compare.ssim(native_frames(t)).withColumn("ssim", half_even(F.col("ssim"), 4))


def variants(t):
    """Each raster under id 4k, its opaque form (an equal hash) under 4k + 1, and under 4k + 2 and 4k + 3
    copies with one and two corners inverted, which move few or no bits of the hash."""
    base = rx(t)
    flip = lambda on: [F.when(on, 255 - F.col(c)).otherwise(F.col(c)).alias(c) for c in "rgb"]
    first = (F.col("x") == 0) & (F.col("y") == 0)
    last = (F.col("x") == 7) & (F.col("y") == 7)
    forms = [base, base.withColumn("a", F.lit(255)),
             base.select("image_id", "w", "h", "x", "y", *flip(first), "a"), base.select("image_id", "w", "h", "x", "y", *flip(first | last), "a")]
    named = [f.withColumn("image_id", F.col("image_id") * 4 + k) for k, f in enumerate(forms)]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])


_VARIANTS = f"{stamped()}, {GREY}, {DCT64}"
_CLASSES = "cl AS MATERIALIZED (SELECT hash_bits, min(image_id) AS rep, count(*) AS members FROM hb GROUP BY hash_bits)"


@query("c4_near_duplicates", f"""WITH {_VARIANTS}, {_CLASSES}, p AS (SELECT least(a.rep, b.rep) AS rep_a, greatest(a.rep, b.rep) AS rep_b,
CASE WHEN a.rep < b.rep THEN a.members ELSE b.members END AS members_a, CASE WHEN a.rep < b.rep THEN b.members ELSE a.members END AS members_b,
CAST(bit_count(xor(CAST(a.hash_bits AS BIT), CAST(b.hash_bits AS BIT))) AS INT) AS distance FROM cl a JOIN cl b ON a.hash_bits < b.hash_bits)
SELECT *, (1 - distance / 64) * 100.0::DOUBLE AS similarity_pct FROM p WHERE distance <= 3""")
def c4_near_duplicates(t):
    words = compare.phash64(variants(t)).select("image_id", F.col("words")[0].alias("hash"))
    return hashjoin.near_pairs(words, max_bits=3).withColumn("similarity_pct", (1 - F.col("distance") / 64) * 100.0)


@query("c4_hash_classes", f"WITH {_VARIANTS}, {_CLASSES} SELECT image_id, rep AS rep_id FROM hb JOIN cl USING (hash_bits)")
def c4_hash_classes(t):
    return hashjoin.hash_classes(compare.phash64(variants(t)).select("image_id", F.col("words")[0].alias("hash")))


_DET = "det AS (SELECT pair_id, (1 - d / bits) * 100.0 AS phash_pct, CAST(round_even(round(greatest((1 - d / bits) * 100.0, ssim * 100), 9), 0) AS INT) AS detail_pct FROM hm JOIN ss USING (pair_id))"


@query("c9_detail_similarity", f"WITH {RX}, {PAIRS}, {GREY}, {DCT256}, {_HAM}, {SSIM}, {_DET} SELECT pair_id, round_even(phash_pct, 3) AS phash_pct, detail_pct FROM det")
def c9_detail_similarity(t):
    out = compare.detail_scores(native_frames(t))
    return out.select("pair_id", half_even(F.col("phash_pct"), 3).alias("phash_pct"), "detail_pct")


@query("c10_overall_native", f"""WITH RECURSIVE {RX}, {PAIRS}, {MASK_COMPARE}, {FEATURES}, {SHAPE}, {COLOUR}, {GREY}, {EDGES}, {DCT256}, {_HAM}, {SSIM}, {_DET},
 ax AS (SELECT pair_id, shape_pct, colour_pct, detail_pct, CAST(round_even(round(f1 * 100, 9), 0) AS INT) AS edges_pct FROM shp JOIN col USING (pair_id) JOIN ef USING (pair_id) JOIN det USING (pair_id))
 SELECT *, CAST(round_even(round(detail_pct * 0.4::DOUBLE + shape_pct * 0.2::DOUBLE + edges_pct * 0.2::DOUBLE + colour_pct * 0.2::DOUBLE, 9), 0) AS INT) AS overall_pct FROM ax""")
def c10_overall_native(t):
    frames = native_frames(t)
    axes = compare.pair_up(pairs_of(t), compare.image_features(rx(t))).select(
        "pair_id", compare.shape_similarity().alias("shape_pct"), compare.colour_similarity().alias("colour_pct"))
    edges = compare.edge_f1(compare.frame_edges(frames)).select(
        "pair_id", half_even(F.round(F.col("edge_f1") * 100, 9)).cast("int").alias("edges_pct"))
    detail = compare.detail_scores(frames).select("pair_id", "detail_pct")
    return axes.join(edges, "pair_id").join(detail, "pair_id").withColumn("overall_pct", compare.overall_score())


@query("c10_pair_score")
def c10_pair_score(t):
    return compare.pair_score(pairs_of(t), rx(t), long_side=16).drop("phash_pct", "ssim_pct")


def _sized(t):
    """Canvas sizes derived from the parts table, one image per part."""
    return t("part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 40).alias("w"),
                            ((F.col("p_partkey") % 37 + 5) * 30).cast("int").alias("h"))


@query("c11_prepare_pairs", """WITH sz AS (SELECT p_partkey AS image_id, p_size * 40 AS w, CAST((p_partkey % 37 + 5) * 30 AS INT) AS h FROM part),
 pr AS (SELECT o.image_id AS pair_id, o.w AS ow, o.h AS oh, g.w AS gw, g.h AS gh FROM sz o JOIN sz g ON g.image_id = o.image_id + 1),
 pd AS (SELECT *, abs(ow / oh - gw / gh) > 1e-3 AS padded FROM pr),
 cv AS (SELECT pair_id, padded, CASE WHEN padded AND abs(ow / oh - gw / gh) >= 1e-6 AND ow / oh <= gw / gh THEN greatest(CAST(round_even(oh * (gw / gh), 0) AS INT), ow) ELSE ow END AS ow,
 CASE WHEN padded AND abs(ow / oh - gw / gh) >= 1e-6 AND ow / oh > gw / gh THEN greatest(CAST(round_even(ow / (gw / gh), 0) AS INT), oh) ELSE oh END AS oh, gw, gh FROM pd)
 SELECT pair_id, padded, CAST(CASE WHEN greatest(ow, oh) > 1024 THEN greatest(1, round_even(ow * 1024.0::DOUBLE / greatest(ow, oh), 0)) ELSE ow END AS INT) AS ow,
 CAST(CASE WHEN greatest(ow, oh) > 1024 THEN greatest(1, round_even(oh * 1024.0::DOUBLE / greatest(ow, oh), 0)) ELSE oh END AS INT) AS oh,
 CAST(CASE WHEN greatest(gw, gh) > 1024 THEN greatest(1, round_even(gw * 1024.0::DOUBLE / greatest(gw, gh), 0)) ELSE gw END AS INT) AS gw,
 CAST(CASE WHEN greatest(gw, gh) > 1024 THEN greatest(1, round_even(gh * 1024.0::DOUBLE / greatest(gw, gh), 0)) ELSE gh END AS INT) AS gh FROM cv""")
def c11_prepare_pairs(t):
    sizes = _sized(t)
    pairs = sizes.select(F.col("image_id").alias("pair_id"), F.col("image_id").alias("original_id"),
                         (F.col("image_id") + 1).alias("generated_id"))
    return compare.prepare_pairs(pairs, sizes).select("pair_id", "padded", "ow", "oh", "gw", "gh")


@query("c12_mask_iou", f"""WITH {RX}, {PAIRS} SELECT pair_id, round_even(CASE WHEN count(*) FILTER (o.a > 0 OR g.a > 0) = 0 THEN 0 ELSE count(*) FILTER (o.a > 0 AND g.a > 0) / count(*) FILTER (o.a > 0 OR g.a > 0) END, 4) AS mask_iou
 FROM pairs JOIN px o ON o.image_id = original_id JOIN px g ON g.image_id = generated_id AND g.x = o.x AND g.y = o.y GROUP BY pair_id""")
def c12_mask_iou(t):
    masked = masks.content_mask(rx(t), "geometry").select("image_id", "x", "y", "content")
    o = masked.withColumnsRenamed({"image_id": "original_id", "content": "on_o"})
    g = masked.withColumnsRenamed({"image_id": "generated_id", "content": "on_g"})
    frames = pairs_of(t).join(o, "original_id").join(g, ["generated_id", "x", "y"])
    return geometry.mask_iou(frames).withColumn("mask_iou", half_even(F.col("mask_iou"), 4))


_NB = ("nb AS MATERIALIZED (SELECT pair_id, o.w AS ow, o.bx / o.w AS ax0, o.\"by\" / o.h AS ay0, (o.bx + o.bw) / o.w AS ax1, (o.\"by\" + o.bh) / o.h AS ay1, "
       "g.bx / g.w AS cx0, g.\"by\" / g.h AS cy0, (g.bx + g.bw) / g.w AS cx1, (g.\"by\" + g.bh) / g.h AS cy1 FROM pairs JOIN bb o ON o.image_id = original_id JOIN bb g ON g.image_id = generated_id)")
_IOU = ("io AS (SELECT *, greatest(0, least(ax1, cx1) - greatest(ax0, cx0)) * greatest(0, least(ay1, cy1) - greatest(ay0, cy0)) AS inter, "
        "(ax1 - ax0) * (ay1 - ay0) AS sa, (cx1 - cx0) * (cy1 - cy0) AS sb FROM nb), "
        "gd AS MATERIALIZED (SELECT pair_id, CASE WHEN ax0 IS NOT NULL AND cx0 IS NOT NULL THEN round_even(CASE WHEN sa + sb - inter > 0 THEN inter / (sa + sb - inter) ELSE 0 END * 100.0, 2) END AS bbox_sim, "
        "round_even((1 - sqrt(pow((cx0 + cx1) / 2 - (ax0 + ax1) / 2, 2) + pow((cy0 + cy1) / 2 - (ay0 + ay1) / 2, 2)) / sqrt(2.0::DOUBLE)) * 100.0, 2) AS position_sim, "
        "round_even(CASE WHEN sa > 0 AND sb > 0 THEN least(sa, sb) / greatest(sa, sb) * 100.0 END, 2) AS scale_sim FROM io), "
        "gw AS MATERIALIZED (SELECT *, round_even((coalesce(bbox_sim * 0.4::DOUBLE, 0) + coalesce(position_sim * 0.25::DOUBLE, 0) + coalesce(scale_sim * 0.25::DOUBLE, 0) + 100 * 0.1::DOUBLE) "
        "/ (CASE WHEN bbox_sim IS NULL THEN 0 ELSE 0.4::DOUBLE END + CASE WHEN position_sim IS NULL THEN 0 ELSE 0.25::DOUBLE END + CASE WHEN scale_sim IS NULL THEN 0 ELSE 0.25::DOUBLE END + 0.1::DOUBLE), 2) AS overall_sim FROM gd)")
_GEO = f"{RX}, {PAIRS}, {MASK_GEOMETRY}, {_BOX}, {_NB}, {_IOU}"


def _boxes_of(t):
    return compare.pair_up(pairs_of(t), metrics.bbox(masks.content_mask(rx(t), "geometry")))


def _norm_pair():
    side = lambda p: geometry.normalised_box(f"{p}bx", f"{p}by", f"{p}bw", f"{p}bh", f"{p}w", f"{p}h")
    return side("o_"), side("g_")


@query("c13_bbox_iou", f"WITH {_GEO} SELECT pair_id, bbox_sim FROM gd")
def c13_bbox_iou(t):
    o, g = _norm_pair()
    return _boxes_of(t).select("pair_id", half_even(geometry.bbox_iou(o, g) * 100.0, 2).alias("bbox_sim"))


@query("c14_geometry_deltas", f"WITH {_GEO} SELECT pair_id, position_sim, scale_sim FROM gd")
def c14_geometry_deltas(t):
    o, g = _norm_pair()
    return _boxes_of(t).select(
        "pair_id", half_even(geometry.position_similarity(o, g), 2).alias("position_sim"),
        half_even(geometry.scale_similarity(o, g), 2).alias("scale_sim"))


@query("c15_weighted_geometry", f"WITH {_GEO} SELECT pair_id, overall_sim FROM gw")
def c15_weighted_geometry(t):
    o, g = _norm_pair()
    parts = [half_even(geometry.bbox_iou(o, g) * 100.0, 2), half_even(geometry.position_similarity(o, g), 2),
             half_even(geometry.scale_similarity(o, g), 2), F.lit(100.0)]
    score = geometry.weighted_mean_nulls(parts, list(dims.GEOMETRY_WEIGHTS.values()))
    return _boxes_of(t).select("pair_id", half_even(score, 2).alias("overall_sim"))


_INPUT_SQL = "(SELECT vec_id AS image_id, CASE WHEN vec_id % 3 = 0 THEN '10' WHEN vec_id % 3 = 1 THEN ' ' END AS tw, CASE WHEN vec_id % 4 = 0 THEN 'REDESIGN' END AS mode, CASE WHEN vec_id % 5 = 0 THEN 'White' ELSE '' END AS bgreq FROM embeddings)"


def inputs_of(t):
    """Operator entries derived from the vector id: some given, some blank, some missing."""
    i = F.col("vec_id")
    none = F.lit(None).cast("string")
    return t("embeddings").select(
        i.alias("image_id"), F.concat(F.lit("art_"), i, F.lit(".png")).alias("source_filename"),
        F.when(i % 3 == 0, "10").when(i % 3 == 1, " ").alias("target_print_width_in"), none.alias("target_dpi"),
        F.when(i % 4 == 0, "REDESIGN").alias("reconstruction_mode"), none.alias("print_location"),
        none.alias("garment_style"), F.lit(" Navy ").alias("garment_color"), none.alias("aspect_ratio_policy"),
        F.when(i % 5 == 0, "White").otherwise("").alias("background_requirement"),
        none.alias("white_elements_policy"), none.alias("black_elements_policy"),
        none.alias("semi_transparency_allowed"), none.alias("distress_policy"))


_BEFORE = (
    f"inp AS {_INPUT_SQL}, bf AS MATERIALIZED (SELECT image_id, w, h, bx, \"by\" AS b_y, bw, bh, coalesce(CAST(nullif(trim(tw), '') AS DOUBLE), 12.5) AS width_in, "
    "coalesce(mode, 'EXACT_RECONSTRUCTION') AS mode, coalesce(nullif(bgreq, ''), 'Transparent') AS bgreq FROM bb JOIN inp USING (image_id))"
)


@query("c18_before_block", f"""WITH RECURSIVE {RX}, {MASK_GEOMETRY}, {_BOX}, {_BEFORE}, {_CONTENT}, {reach('content_px', 8)}, {component_stats()},
 ob AS (SELECT image_id, count(*) FILTER (area >= 50) AS n FROM cs GROUP BY image_id), alp AS (SELECT image_id, bool_or(a < 255) AS al FROM px GROUP BY image_id)
 SELECT CAST(image_id AS VARCHAR) AS artwork_id, al AS source_has_alpha, CASE WHEN al THEN 'Transparent' END AS source_background_type, bx AS source_bbox_x, b_y AS source_bbox_y,
 round_even((bx + bw / 2.0) * 100.0 / w, 2) AS source_center_x_pct, mode AS reconstruction_mode, 'Navy' AS garment_color, width_in AS target_print_width_in,
 round_even(width_in * bh / bw, 2) AS target_print_height_in, CAST(round_even(width_in * bh / bw * 300, 0) AS BIGINT) AS target_height_px, mode <> 'EXACT_RECONSTRUCTION' AS crop_allowed,
 mode = 'EXACT_RECONSTRUCTION' AS text_must_match_exactly, bgreq AS background_requirement, CAST(coalesce(n, CASE WHEN al THEN 0 END) AS BIGINT) AS object_count
 FROM bf JOIN alp USING (image_id) LEFT JOIN ob USING (image_id)""")
def c18_before_block(t):
    out = geometry.measure_before(rx(t), inputs_of(t))
    return out.select(
        "artwork_id", "source_has_alpha", "source_background_type", "source_bbox_x", "source_bbox_y", "source_center_x_pct",
        "reconstruction_mode", "garment_color", "target_print_width_in", "target_print_height_in", "target_height_px",
        "crop_allowed", "text_must_match_exactly", "background_requirement", "object_count")


def after_of(t):
    before = geometry.measure_before(rx(t), inputs_of(t))
    return geometry.measure_after(rx(t), before, pairs_of(t))


_AFTER = ", ".join([
    _GEO, _BEFORE, _CONTENT, reach("content_px", 8), component_stats(), _EDGE,
    _nb("it", kernels.ellipse(3), "max(CAST(n.a >= 200 AS INT))", "intent"),
    "sy AS (SELECT image_id, count(*) FILTER (a BETWEEN 1 AND 50 AND intent = 0) AS stray FROM px JOIN it USING (image_id, x, y) GROUP BY image_id)",
    _dist("dd", "n.a = 0"),
    "ln AS (SELECT image_id, round_even(quantile_cont(d, 0.05) * 2, 2) AS line FROM px LEFT JOIN dd USING (image_id, x, y) WHERE a > 0 GROUP BY image_id)",
    "co AS (SELECT image_id, count(*) AS n_comp, min(area) AS smallest FROM cs GROUP BY image_id)",
    "af AS MATERIALIZED (SELECT pair_id, generated_id, round_even(g.w / o.width_in, 1) AS eff_x, CASE WHEN edge_pixel_count = 0 THEN 0.0 ELSE round_even(edge_contamination_count * 100.0 / edge_pixel_count, 2) END AS contam, "
    "stray, line, coalesce(n_comp, 0) AS n_comp, smallest, overall_sim, least(g.bx, g.b_y, g.w - g.bx - g.bw, g.h - g.b_y - g.bh) <= 0 AS clip_raw, g.bx AS gbx, o.bgreq AS req FROM pairs "
    "JOIN bf o ON o.image_id = original_id JOIN bf g ON g.image_id = generated_id JOIN edge ON edge.image_id = generated_id JOIN sy ON sy.image_id = generated_id "
    "LEFT JOIN ln ON ln.image_id = generated_id LEFT JOIN co ON co.image_id = generated_id JOIN gw USING (pair_id))",
    "st AS MATERIALIZED (SELECT pair_id, CASE WHEN lower(req) = 'transparent' THEN CASE WHEN al THEN 'PASS' ELSE 'FAIL' END ELSE 'PASS' END AS background_transparency_status, "
    "CASE WHEN eff_x / 300 < 0.75 THEN 'FAIL' WHEN eff_x / 300 < 0.9 THEN 'WARN' ELSE 'PASS' END AS resolution_status, "
    "CASE WHEN overall_sim IS NULL THEN 'N/A' WHEN overall_sim < 75 THEN 'FAIL' WHEN overall_sim < 90 THEN 'WARN' ELSE 'PASS' END AS geometry_status, "
    "CASE WHEN NOT al THEN 'N/A' WHEN contam >= 5 THEN 'FAIL' WHEN contam >= 2 THEN 'WARN' ELSE 'PASS' END AS halo_status, "
    "CASE WHEN NOT al THEN 'N/A' WHEN stray = 0 THEN 'PASS' WHEN stray < 500 THEN 'WARN' ELSE 'FAIL' END AS stray_pixel_status, "
    "CASE WHEN line IS NULL THEN 'N/A' WHEN line < 1.5 THEN 'FAIL' WHEN line < 3 THEN 'WARN' ELSE 'PASS' END AS fine_detail_status, "
    "CASE WHEN gbx IS NULL THEN 'N/A' WHEN clip_raw THEN 'FAIL' ELSE 'PASS' END AS clipping_status FROM af JOIN (SELECT image_id, bool_or(a < 255) AS al FROM px GROUP BY image_id) ON image_id = generated_id)",
])
_STATUS_COLS = ["background_transparency_status", "resolution_status", "geometry_status", "halo_status",
                "stray_pixel_status", "fine_detail_status", "clipping_status"]
_ANY = lambda s: " OR ".join(f"{c} = '{s}'" for c in _STATUS_COLS)
_WORST = f"CASE WHEN {_ANY('FAIL')} THEN 'FAIL' WHEN {_ANY('WARN')} THEN 'WARN' WHEN {_ANY('PASS')} THEN 'PASS' ELSE 'N/A' END"


@query("c16_geometry_statuses", f"WITH RECURSIVE {_AFTER} SELECT * FROM st")
def c16_geometry_statuses(t):
    return after_of(t).select("pair_id", *_STATUS_COLS)


@query("c17_worst_status", f"WITH RECURSIVE {_AFTER} SELECT overall_qa_status, CAST(count(*) AS BIGINT) AS n FROM (SELECT {_WORST} AS overall_qa_status FROM st) GROUP BY 1")
def c17_worst_status(t):
    return after_of(t).groupBy("overall_qa_status").agg(F.count("*").alias("n"))


@query("c19_after_block", f"""WITH RECURSIVE {_AFTER} SELECT pair_id, eff_x AS effective_dpi_x, contam AS edge_contamination_pct, stray AS low_alpha_outside_intent_count,
 line AS minimum_line_width_px, CAST(n_comp AS BIGINT) AS connected_component_count, CAST(smallest AS BIGINT) AS smallest_component_area_px, overall_sim AS overall_geometry_similarity_pct,
 CASE WHEN gbx IS NOT NULL THEN clip_raw END AS clipping_detected, {_WORST} AS overall_qa_status FROM af JOIN st USING (pair_id)""")
def c19_after_block(t):
    return after_of(t).select(
        "pair_id", "effective_dpi_x", "edge_contamination_pct", "low_alpha_outside_intent_count", "minimum_line_width_px",
        "connected_component_count", "smallest_component_area_px", "overall_geometry_similarity_pct", "clipping_detected",
        "overall_qa_status")


@query("c20_approval", f"""WITH {RX}, {MASK_GEOMETRY}, {_BOX}, {_BEFORE}, {PAIRS} SELECT pair_id, sha256(vec_text) AS approved_file_hash, width_in AS approved_print_width_in,
 round_even(width_in * bh / bw, 2) AS approved_print_height_in FROM pairs JOIN bf ON bf.image_id = original_id
 JOIN (SELECT image_id, string_agg(r || ',' || g || ',' || b || ',' || a, ';' ORDER BY y, x) AS vec_text FROM px GROUP BY image_id) v ON v.image_id = generated_id""")
def c20_approval(t):
    return geometry.approval(outputs_of(t)).select(
        "pair_id", "approved_file_hash", "approved_print_width_in", "approved_print_height_in")


def outputs_of(t):
    """Output files: the raster's pixel values as text stand in for encoded bytes."""
    body = rx(t).groupBy("image_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("y", "x", F.concat_ws(",", "r", "g", "b", "a").alias("t")))),
        lambda s: s["t"]), ";").alias("content"))
    before = geometry.measure_before(rx(t), inputs_of(t)).select(
        F.col("image_id").alias("original_id"), "target_print_width_in", "target_print_height_in")
    return pairs_of(t).join(body.withColumnRenamed("image_id", "generated_id"), "generated_id").join(before, "original_id")


@query("s15_master_json")
def s15_master_json(t):
    before = geometry.measure_before(rx(t), inputs_of(t))
    after = geometry.measure_after(rx(t), before, pairs_of(t))
    return geometry.master_json(before, after, geometry.approval(outputs_of(t)))


# ---- print readiness ---------------------------------------------------------------

@query("q1_status", f"""WITH {BOTH}, {MASK_QA}, sp AS (SELECT image_id, avg(CAST(a BETWEEN 10 AND 245 AS INT)) * 100.0 AS v FROM cm GROUP BY image_id),
 lo AS (SELECT image_id, CAST(min(r) AS DOUBLE) AS v FROM cm GROUP BY image_id)
 SELECT image_id, CASE WHEN sp.v >= 12 THEN 'fail' WHEN sp.v >= 4 THEN 'warn' ELSE 'pass' END AS high_is_bad,
 CASE WHEN lo.v < 50 THEN 'fail' WHEN lo.v < 70 THEN 'warn' ELSE 'pass' END AS low_is_bad FROM sp JOIN lo USING (image_id)""")
def q1_status(t):
    agg = both(t).groupBy("image_id").agg(
        (F.avg(F.when(F.col("a").between(10, 245), 1.0).otherwise(0.0)) * 100.0).alias("semi"),
        F.min("r").cast("double").alias("low"))
    return agg.select(
        "image_id", qa.status(F.col("semi"), F.lit(4.0), F.lit(12.0), F.lit("high")).alias("high_is_bad"),
        qa.status(F.col("low"), F.lit(70.0), F.lit(50.0), F.lit("low")).alias("low_is_bad"))


@query("q2_px_to_mm", "SELECT p_partkey, round_even(p_size / CAST(p_partkey % 4 * 75 AS DOUBLE) * 25.4::DOUBLE, 4) AS mm FROM part WHERE p_partkey % 4 > 0 UNION ALL SELECT p_partkey, 0.0 FROM part WHERE p_partkey % 4 = 0")
def q2_px_to_mm(t):
    dpi = (F.col("p_partkey") % 4 * 75).cast("double")
    return t("part").select("p_partkey", half_even(px_to_mm(F.col("p_size"), dpi), 4).alias("mm"))


def stroke_sql(dpi: float = 300.0) -> str:
    """The stroke definition spelled out by brute force over all pixel pairs of an image."""
    area = max(4.0, (0.5 / 25.4 * dpi) ** 2)
    ladder, r = [], 1.0
    while r < 64:
        ladder.append(r)
        r = max(r + 0.5, r * 1.3)
    levels = ", ".join(f"({v!r}::DOUBLE)" for v in ladder)
    return (
        f"big AS (SELECT image_id, comp FROM cs WHERE area >= {area!r}), "
        "sk AS MATERIALIZED (SELECT px.image_id, px.x, px.y, comp.comp IS NOT NULL AND (big.comp IS NOT NULL OR px.image_id NOT IN (SELECT image_id FROM big)) AS stroke "
        "FROM px LEFT JOIN comp ON comp.image_id = px.image_id AND comp.x = px.x AND comp.y = px.y LEFT JOIN big ON big.image_id = comp.image_id AND big.comp = comp.comp), "
        + _dist("so", "NOT n.stroke", source="sk") + ", "
        "sd AS MATERIALIZED (SELECT sk.*, CASE WHEN stroke THEN coalesce(d, 8.0) ELSE 0.0 END AS d FROM sk LEFT JOIN so USING (image_id, x, y)), "
        + _nb("pk", kernels.box(1), "max(n.d)", "peak", source="sd") + ", "
        "mx AS (SELECT image_id, max(d) AS dmax FROM sd GROUP BY image_id HAVING max(d) > 0), "
        f"lvl AS (SELECT image_id, level FROM mx, (VALUES {levels}) l(level) WHERE level < dmax UNION ALL SELECT image_id, dmax FROM mx), "
        "tk AS (SELECT s.image_id, s.x, s.y, max(level) AS thick FROM sd s JOIN pk USING (image_id, x, y) JOIN lvl ON lvl.image_id = s.image_id JOIN sd q ON q.image_id = s.image_id "
        "AND q.d >= level - 1e-3 AND sqrt((q.x - s.x) * (q.x - s.x) + (q.y - s.y) * (q.y - s.y)) <= level + 0.5 WHERE s.stroke AND s.d >= peak GROUP BY s.image_id, s.x, s.y), "
        "ms AS MATERIALIZED (SELECT image_id, greatest(quantile_cont(2 * thick - 1, 0.05), 1.0) AS stroke_px FROM tk GROUP BY image_id)"
    )


from rasterqa.plans.registry import ORACLES, exact_rounding  # noqa: E402

ORACLES["n11_min_stroke"] = exact_rounding(
    f"WITH RECURSIVE {RX}, {MASK_QA}, {_CONTENT}, {reach('content_px', 8)}, {component_stats()}, {stroke_sql()} "
    "SELECT image_id, round_even(stroke_px, 4) AS min_stroke_px FROM ms")

_QA_M = ", ".join([
    RX, MASK_QA, _BOX, _CONTENT, reach("content_px", 8), component_stats(), stroke_sql(), _HALO, _SOFT, _SOBEL,
    _BLACK, _DOM.format(s=32).replace("dc AS", "dmc AS").replace("dr AS", "dmr AS").replace("FROM dc", "FROM dmc"),
    "pal AS (SELECT image_id, count(*) AS colours FROM dmr GROUP BY image_id)",
    "gp AS (SELECT image_id, coalesce(avg(CAST(mag > 3 AND mag < 25 AS INT)) FILTER (content) * 100.0, 0.0) AS grad FROM cm JOIN sob USING (image_id, x, y) GROUP BY image_id)",
    "pc AS (SELECT image_id, avg(CAST(a = 0 AS INT)) * 100.0 AS clear_pct, avg(CAST(a BETWEEN 10 AND 245 AS INT)) * 100.0 AS semi_v, bool_or(a < 250) AS al FROM px GROUP BY image_id)",
    "qm AS MATERIALIZED (SELECT image_id, clear_pct, semi_v, al, CASE WHEN al THEN CASE WHEN ring_px = 0 THEN 0.0 ELSE pale_px * 100.0 / ring_px END END AS halo, "
    "CASE WHEN boundary_px = 0 THEN 0.0 ELSE soft_px * 100.0 / boundary_px END AS soft, coalesce(colours, 0) AS colours, CASE WHEN dark >= 2 THEN lvl END AS black, "
    "coalesce(stroke_px, 0.0) / 300 * 25.4::DOUBLE AS stroke_mm, 0.0 AS feature_mm, grad, "
    "CASE WHEN n_content = 0 THEN 100.0 ELSE least(bx, \"by\", 8 - bx - bw, 8 - \"by\" - bh) * 100.0 / 8 END AS margin, 8 / 300.0::DOUBLE AS size_in "
    "FROM pc JOIN halo USING (image_id) JOIN soft USING (image_id) JOIN bl USING (image_id) JOIN gp USING (image_id) JOIN bb USING (image_id) LEFT JOIN pal USING (image_id) LEFT JOIN ms USING (image_id))",
])


def _row(cid, value, digits, warn, fail, weight, high):
    judge = (f"CASE WHEN {value} IS NULL THEN 'na' WHEN {value} >= {fail} THEN 'fail' WHEN {value} >= {warn} THEN 'warn' ELSE 'pass' END" if high
             else f"CASE WHEN {value} IS NULL THEN 'na' WHEN {value} < {fail} THEN 'fail' WHEN {value} < {warn} THEN 'warn' ELSE 'pass' END")
    return f"SELECT image_id, '{cid}' AS id, round_even({value}, {digits}) AS value, {judge} AS status, CASE WHEN {value} IS NULL THEN 0 ELSE {weight} END AS weight FROM qm"


_QA_ROWS = " UNION ALL ".join([
    "SELECT image_id, 'dpi' AS id, 300.0::DOUBLE AS value, 'pass' AS status, 8 AS weight FROM qm",
    "SELECT image_id, 'transparency', round_even(clear_pct, 1), CASE WHEN al THEN 'pass' ELSE 'warn' END, 2 FROM qm",
    _row("semi_alpha", "semi_v", 2, 4.0, 12.0, 10, True), _row("halo", "halo", 2, 1.5, 5.0, 9, True),
    _row("soft_edges", "soft", 1, 35.0, 60.0, 6, True), _row("colours", "colours", 0, 64, 200, 3, True),
    _row("black", "black", 1, 40.0, 70.0, 5, True), _row("min_stroke", "stroke_mm", 2, 0.8, 0.4, 10, False),
    _row("min_feature", "feature_mm", 2, 3.0, 2.0, 7, False), _row("gradients", "grad", 1, 25.0, 50.0, 4, True),
    _row("margins", "margin", 2, 2.0, 0.5, 4, False), "SELECT image_id, 'aspect', 0.0, 'pass', 1 FROM qm",
    _row("print_size", "size_in", 2, 22.0, 24.0, 6, True),
])
_QA_CHECKS = f"{_QA_M}, qc AS MATERIALIZED ({_QA_ROWS})"
_QA_SCORE = (
    "qs AS MATERIALIZED (SELECT image_id, CAST(coalesce(round_even(sum(CASE status WHEN 'pass' THEN 1.0 WHEN 'warn' THEN 0.5 ELSE 0.0 END * weight) * 100.0::DOUBLE / nullif(sum(weight), 0), 0), 0) AS INT) AS score, "
    "count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'warn') AS n_warn, count(*) FILTER (status = 'fail') AS n_fail, count(*) FILTER (status = 'na') AS n_na FROM qc GROUP BY image_id), "
    "qr AS MATERIALIZED (SELECT *, CASE WHEN score >= 90 THEN 'ready' WHEN score >= 70 THEN 'fixable' ELSE 'not_ready' END AS band FROM qs)"
)


def measured(t):
    return qa.qa_measurements(rx(t))


@query("q3_qa_checks", f"WITH RECURSIVE {_QA_CHECKS} SELECT * FROM qc")
def q3_qa_checks(t):
    return qa.qa_checks(measured(t)).select("image_id", "id", "value", "status", "weight")


@query("q4_qa_report", f"WITH RECURSIVE {_QA_CHECKS}, {_QA_SCORE} SELECT * FROM qr")
def q4_qa_report(t):
    return qa.qa_report(qa.qa_checks(measured(t)))


@query("q5_qa_summary")
def q5_qa_summary(t):
    checks = qa.qa_checks(measured(t))
    return qa.qa_summary(checks, qa.qa_report(checks))


@query("q7_qa_pairs", f"WITH RECURSIVE {_QA_CHECKS}, {_QA_SCORE}, {PAIRS} SELECT pair_id, 'original' AS role, score, band FROM pairs JOIN qr ON image_id = original_id UNION ALL SELECT pair_id, 'generated', score, band FROM pairs JOIN qr ON image_id = generated_id")
def q7_qa_pairs(t):
    report = qa.qa_report(qa.qa_checks(measured(t)))
    return qa.qa_pairs(pairs_of(t), report).select("pair_id", "role", "score", "band")


@query("a3_weighted_score", "SELECT l_returnflag, CAST(round_even(sum(CASE l_linestatus WHEN 'F' THEN 1.0 ELSE 0.5 END * l_linenumber) * 100.0::DOUBLE / sum(l_linenumber), 0) AS INT) AS score FROM lineitem GROUP BY 1")
def a3_weighted_score(t):
    credit = F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.5)
    return t("lineitem").groupBy("l_returnflag").agg(qa.score_of(credit, F.col("l_linenumber")).alias("score"))


@query("q9_ready_jobs", "SELECT vec_id AS pair_id FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 3 > 0 AND vec_id % 10 < 8")
def q9_ready_jobs(t):
    return objects.ready_jobs(*_drift_inputs(t)).select("pair_id")


def _drift_inputs(t):
    """Adjacent rasters as jobs; every third is scored already, some results are not in yet."""
    i = F.col("pair_id")
    jobs = pairs_of(t).filter(i % 2 == 0).withColumn("score", F.when(i % 3 == 0, 50)).withColumn(
        "ratio", F.when(i % 4 == 0, 1.5).when(i % 4 == 2, 0.0))
    files = t("embeddings").select(F.col("vec_id").alias("image_id")).filter("image_id % 10 <> 9")
    return jobs, files


@query("q9_drift_scores")
def q9_drift_scores(t):
    jobs, files = _drift_inputs(t)
    return objects.drift_scores(jobs, files, rx(t), long_side=16)


@query("q8_object_pairs")
def q8_object_pairs(t):
    i = F.col("pair_id")
    spot = lambda off: F.concat(F.substring(F.lit("ABCDEFGHIJ"), ((i + off) % 5 + 1).cast("int"), 1), ((i + off) % 4 + 1).cast("string"), F.lit("-J"), ((i + off) % 3 + 7).cast("string"))
    none = F.lit(None).cast("array<string>")
    listed = pairs_of(t).filter(i % 2 == 0).select("pair_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("id")).select(
        "pair_id", "id", F.concat(F.lit("object "), "id").alias("name"), F.when((i + F.col("id")) % 13 == 0, "background").otherwise("art").alias("type"),
        F.when((i + F.col("id")) % 5 == 1, none).otherwise(F.array(spot(0))).alias("cells_1"),
        F.when((i + F.col("id")) % 5 == 2, none).otherwise(F.array(spot(1))).alias("cells_2"))
    return objects.object_pairs(listed, pairs_of(t), rx(t), long_side=12)
