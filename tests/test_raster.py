import random

from pyspark.sql import functions as F

from conftest import canvas, pixels, png
from rasterqa.operators import colour, components as cc, geometry, kernels, masks, metrics, qa, transforms
from rasterqa.sources import catalog
from rasterqa.sources.rasters import read_pixels

CLEAR, INK = (255, 255, 255, 0), (220, 30, 40, 255)


def test_known_box_transparent(spark):
    px = pixels(spark, {1: canvas(40, 30, CLEAR, (5, 4, 12, 9), INK)})
    box = metrics.bbox(masks.content_mask(px, "geometry"))
    row = metrics.layout_metrics(box).first()
    assert (row.bx, row["by"], row.bw, row.bh) == (5, 4, 12, 9)
    assert row.pad_left + row.bw + row.pad_right == 40 and row.pad_top + row.bh + row.pad_bottom == 30
    assert row.orientation == "Landscape"
    target = metrics.target_geometry(box, F.lit(12.5), F.lit(300)).first()
    assert target.target_width_px == 3750


def test_opaque_art_uses_border_colour(spark):
    px = pixels(spark, {1: canvas(24, 18, (255, 255, 255, 255), (3, 2, 14, 10), (15, 30, 190, 255))})
    for profile in ("compare", "qa", "geometry"):
        box = metrics.bbox(masks.content_mask(px, profile)).first()
        assert (box.bx, box["by"], box.bw, box.bh) == (3, 2, 14, 10)
    assert masks.background_type(px).first().background_type == "White"


def test_enclosed_background_colour_is_content(spark):
    rows = canvas(12, 12, (255, 255, 255, 255), (3, 3, 6, 6), (0, 0, 0, 255))
    for y in (5, 6):
        rows[y][5:7] = [(255, 255, 255, 255)] * 2
    px = pixels(spark, {1: rows})
    assert transforms.content_mask_connected(px).filter("content").count() == 36
    cleared = transforms.remove_background(px, "white")
    assert cleared.filter("a = 0").count() == 144 - 36
    assert cc.min_hole(masks.content_mask(px, "qa")).first().min_hole_px == 4


def flood(points, reach8):
    near = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (reach8 or not (dx and dy))]
    left, sizes = set(points), []
    while left:
        stack, n = [left.pop()], 0
        while stack:
            x, y = stack.pop()
            n += 1
            for dx, dy in near:
                if (x + dx, y + dy) in left:
                    left.remove((x + dx, y + dy))
                    stack.append((x + dx, y + dy))
        sizes.append(n)
    return sorted(sizes)


def test_components_match_flood_fill_across_strips(spark, monkeypatch):
    monkeypatch.setattr(cc, "STRIP", 3)
    monkeypatch.setattr(cc, "BUCKET", 4)
    rnd = random.Random(7)
    data, want = [], {}
    for image in range(6):
        pts = [(x, y) for x in range(17) for y in range(14) if rnd.random() < 0.35 + image * 0.06]
        data += [(image, x, y) for x, y in pts]
        want[image] = pts
    mask = spark.createDataFrame(data, "image_id long, x int, y int")
    for conn in (4, 8):
        got = {}
        for r in cc.components(mask, conn).collect():
            got.setdefault(r.image_id, []).append(r.area)
        assert {i: sorted(a) for i, a in got.items()} == {i: flood(p, conn == 8) for i, p in want.items()}


def test_distance_is_exact(spark):
    rnd = random.Random(3)
    pts = {(x, y) for x in range(15) for y in range(11) if rnd.random() < 0.05}
    data = [(1, 15, 11, x, y, (x, y) in pts) for x in range(15) for y in range(11)]
    px = spark.createDataFrame(data, "image_id long, w int, h int, x int, y int, hit boolean")
    for r in kernels.distance_to(px, {"d": "hit"}).collect():
        want = min((r.x - x) ** 2 + (r.y - y) ** 2 for x, y in pts) ** 0.5
        assert abs(r.d - want) < 1e-9


def mask_of(spark, w, h, boxes):
    on = lambda x, y: any(bx <= x < bx + bw and by <= y < by + bh for bx, by, bw, bh in boxes)
    data = [(1, w, h, x, y, on(x, y)) for x in range(w) for y in range(h)]
    return spark.createDataFrame(data, "image_id long, w int, h int, x int, y int, content boolean")


def test_stroke_width(spark):
    at_100 = lambda mask: kernels.min_stroke(mask, kernels.image_dpi(mask, 100))
    stroke = lambda boxes: at_100(mask_of(spark, 60, 50, boxes)).first().min_stroke_px
    assert 10 <= stroke([(5, 10, 50, 12)]) <= 14
    assert 10 <= stroke([(5, 10, 50, 12), (2, 40, 1, 1)]) <= 14  # a speck is ignored
    assert stroke([(10, 5, 40, 40)]) > 30


def test_print_ready_counts_and_sizes(spark):
    rows = canvas(10, 10, (9, 9, 9, 255))
    for y, a in enumerate((10, 255, 50, 200)):
        rows[y] = [(9, 9, 9, a)] * 10
    out = transforms.make_print_ready(pixels(spark, {1: rows}), 10, 10).first()
    assert (out.changed_px, out.became_clear, out.became_opaque) == (30, 20, 10)
    sizes = spark.createDataFrame([(1122, 1402)], "w int, h int").select(
        *transforms.fitted_size(F.col("w"), F.col("h"), F.lit(3225), F.lit(4030))).first()
    assert sizes[0] == 3225 and abs(sizes[1] - 4030) <= 2


def test_halo_ignores_clear_white_and_finds_fringe(spark):
    clean = canvas(16, 16, CLEAR, (4, 4, 8, 8), (20, 20, 20, 255))
    fringe = canvas(16, 16, CLEAR, (3, 3, 10, 10), (235, 235, 235, 120))
    for y in range(4, 12):
        fringe[y][4:12] = [(20, 20, 20, 255)] * 8
    got = {r.image_id: r.halo_pct for r in kernels.halo_pct(pixels(spark, {1: clean, 2: fringe})).collect()}
    assert got[1] == 0 and got[2] > 5


def test_qa_weights_and_na(spark):
    px = pixels(spark, {1: canvas(16, 16, (255, 255, 255, 255), (4, 4, 8, 8), (20, 20, 20, 255))})
    checks = qa.qa_checks(qa.qa_measurements(px))
    rows = {r.id: r for r in checks.collect()}
    assert len(rows) == 13
    assert rows["halo"].status == "na" and rows["halo"].weight == 0
    assert sum(r.weight for r in rows.values()) == 75 - 9
    assert rows["dpi"].status == "pass"
    report = qa.qa_report(checks).first()
    assert 0 <= report.score <= 100 and report.n_na >= 1
    text = qa.qa_summary(checks, qa.qa_report(checks)).first().summary
    assert text.startswith("PRINT READY QA") and text.count("\n") == 14


def test_status_edges(spark):
    df = spark.createDataFrame([(300.0,), (299.0,), (150.0,), (149.9,)], "v double")
    low = [r[0] for r in df.select(qa.status(F.col("v"), F.lit(300.0), F.lit(150.0), F.lit("low"))).collect()]
    assert low == ["pass", "warn", "warn", "fail"]
    high = [r[0] for r in df.select(qa.status(F.col("v"), F.lit(150.0), F.lit(300.0), F.lit("high"))).collect()]
    assert high == ["fail", "warn", "warn", "pass"]


def test_worst_and_weighted_mean(spark):
    df = spark.createDataFrame([("PASS", "N/A", "WARN"), ("N/A", "N/A", "N/A")], "a string, b string, c string")
    got = [r[0] for r in df.select(geometry.worst_status(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["WARN", "N/A"]
    m = spark.createDataFrame([(80.0, None)], "p double, q double").select(
        geometry.weighted_mean_nulls([F.col("p"), F.col("q")], [0.4, 0.6])).first()[0]
    assert abs(m - 80) < 1e-9


def test_png_source_dpi_and_validation(spark, tmp_path):
    rows = canvas(3, 2, (1, 2, 3, 4))
    rows[1][2] = (9, 8, 7, 255)
    (tmp_path / "a.png").write_bytes(png(rows, 11811))
    (tmp_path / "b.png").write_bytes(b"not an image")
    got = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in read_pixels(spark, str(tmp_path)).collect()}
    assert got[(0, 0)] == (1, 2, 3, 4) and got[(2, 1)] == (9, 8, 7, 255) and len(got) == 6
    files = spark.read.format("binaryFile").load(str(tmp_path))
    ok = catalog.validate_images(catalog.with_dpi(files)).orderBy("path").collect()
    assert (ok[0].dpi, ok[0].width, ok[0].height, ok[0].reason) == (300, 3, 2, None)
    assert ok[1].reason.startswith("Unsupported")
    assert [r.name for r in catalog.scan_catalog(spark, str(tmp_path)).orderBy("name").collect()] == ["a.png", "b.png"]


def test_colour_groups_find_flat_colours(spark):
    rows = canvas(12, 12, (250, 250, 250, 255), (0, 0, 6, 12), (200, 20, 20, 255))
    rows[0][0] = (10, 10, 200, 255)
    groups = colour.colour_groups(pixels(spark, {1: rows})).orderBy("group_id").collect()
    assert [g.name for g in groups] == ["White / light grey", "Red", "Blue"]
    assert [g.pct for g in groups] == [50.0, 49.3, 0.7]
