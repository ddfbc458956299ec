"""Shared SQL fragments of the comparison queries (DuckDB dialect)."""

from __future__ import annotations


def _q(shift: int) -> str:
    v = f"CAST(embedding[(i + {shift}) % 64 + 1] AS DOUBLE)"
    return f"CAST(least(255, greatest(0, floor(({v} + 0.5) * 255))) AS INT)"


_V = "CAST(embedding[i + 1] AS DOUBLE)"
_ALPHA = f"CASE WHEN {_V} < -0.15 THEN 0 WHEN {_V} < -0.05 THEN 128 ELSE 255 END"


def _raster(image_id: str, alpha: str) -> str:
    return (
        f"SELECT {image_id} AS image_id, 8 AS w, 8 AS h, CAST(i % 8 AS INT) AS x, "
        f"CAST(i // 8 AS INT) AS y, {_q(0)} AS r, {_q(21)} AS g, {_q(42)} AS b, "
        f"CAST({alpha} AS INT) AS a FROM embeddings, range(64) t(i)"
    )


# px: RX rasters; RXO: the opaque form; BOTH: even ids RX, odd ids opaque.
RX = f"px AS MATERIALIZED ({_raster('vec_id', _ALPHA)})"
RXO = f"px AS MATERIALIZED ({_raster('vec_id', '255')})"
BOTH = (
    f"px AS MATERIALIZED ({_raster('vec_id * 2', _ALPHA)} UNION ALL "
    f"{_raster('vec_id * 2 + 1', '255')})"
)



def stamped() -> str:
    """px: a raster, its opaque form, and copies with one and two corners inverted, under ids 4k to 4k + 3."""
    first, both = "(x = 0 AND y = 0)", "((x = 0 AND y = 0) OR (x = 7 AND y = 7))"
    flip = lambda on: ", ".join(f"CASE WHEN {on} THEN 255 - {c} ELSE {c} END AS {c}" for c in "rgb")
    return (
        f"base AS MATERIALIZED ({_raster('vec_id * 4', _ALPHA)}), px AS MATERIALIZED (SELECT * FROM base "
        "UNION ALL SELECT image_id + 1, w, h, x, y, r, g, b, 255 FROM base "
        f"UNION ALL SELECT image_id + 2, w, h, x, y, {flip(first)}, a FROM base "
        f"UNION ALL SELECT image_id + 3, w, h, x, y, {flip(both)}, a FROM base)")


LUM = "((r * 299 + g * 587 + b * 114) / 1000)"
NLUM = "((n.r * 299 + n.g * 587 + n.b * 114) / 1000)"


def border(width: str = "1") -> str:
    """Strips holding the pixel."""
    return (
        f"(CAST(x < {width} AS INT) + CAST(x >= w - {width} AS INT) "
        f"+ CAST(y < {width} AS INT) + CAST(y >= h - {width} AS INT))"
    )


CORNER = (
    "((CAST(x = 0 AS INT) + CAST(x = w - 1 AS INT)) * (CAST(y = 0 AS INT) + CAST(y = h - 1 AS INT)))"
)
FRAME_W = "greatest(1, CAST(round_even(least(w, h) * 0.03, 0) AS INT))"

# The border sample written out strip by strip, so medians count corners twice.
RING = (
    "ring AS (SELECT * FROM px WHERE x = 0 UNION ALL SELECT * FROM px WHERE x = w - 1 "
    "UNION ALL SELECT * FROM px WHERE y = 0 UNION ALL SELECT * FROM px WHERE y = h - 1)"
)
CORNERS = "corners AS (SELECT * FROM px WHERE (x = 0 OR x = w - 1) AND (y = 0 OR y = h - 1))"


def _mask(see_through: int, alpha: int, sample: str, pick: str, dist: int) -> str:
    d = "sqrt((r - bg_r) * (r - bg_r) + (g - bg_g) * (g - bg_g) + (b - bg_b) * (b - bg_b))"
    return (
        f"bg AS (SELECT image_id, {pick.format('r')} AS bg_r, {pick.format('g')} AS bg_g, "
        f"{pick.format('b')} AS bg_b FROM {sample} GROUP BY image_id), "
        f"al AS (SELECT image_id, bool_or(a < {see_through}) AS has_alpha FROM px GROUP BY image_id), "
        f"cm AS MATERIALIZED (SELECT px.*, has_alpha, CASE WHEN has_alpha THEN a > {alpha} "
        f"ELSE {d} > {dist} END AS content FROM px JOIN bg USING (image_id) JOIN al USING (image_id))"
    )


MASK_QA = RING + ", " + _mask(250, 20, "ring", "quantile_cont({}, 0.5)", 32)
MASK_GEOMETRY = RING + ", " + _mask(255, 0, "ring", "avg({})", 40)
MASK_COMPARE = CORNERS + ", " + _mask(255, 128, "corners", "quantile_cont({}, 0.5)", 40)


def reach(source: str, conn: int, name: str = "comp") -> str:
    """Recursive reachability over a pixel set; ``name`` gives (image_id, x, y, comp)."""
    offsets = "(0, 1), (0, -1), (1, 0), (-1, 0)"
    if conn == 8:
        offsets += ", (1, 1), (1, -1), (-1, 1), (-1, -1)"
    return (
        f"{name}_seen AS (SELECT image_id, x, y, y * 1048576 + x AS src FROM {source} "
        f"UNION SELECT n.image_id, n.x, n.y, c.src FROM {name}_seen c, "
        f"(VALUES {offsets}) nb(dx, dy), {source} n WHERE n.image_id = c.image_id "
        f"AND n.x = c.x + nb.dx AND n.y = c.y + nb.dy AND n.y * 1048576 + n.x > c.src), "
        f"{name} AS MATERIALIZED (SELECT image_id, x, y, min(src) AS comp FROM {name}_seen "
        f"GROUP BY image_id, x, y)"
    )


def component_stats(comp: str = "comp", name: str = "cs") -> str:
    return (
        f"{name} AS (SELECT image_id, comp, count(*) AS area, min(x) AS x0, max(x) AS x1, "
        f"min(y) AS y0, max(y) AS y1 FROM {comp} GROUP BY image_id, comp)"
    )
