import struct
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from rasterqa.session import get_spark  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", master="local[8]", spark__sql__shuffle__partitions="8",
                  spark__driver__memory="8g", spark__ui__enabled="false",
                  spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    return s


def png(rows, dpi_ppm=None):
    """PNG bytes of a list of rows of (r, g, b, a)."""
    h, w = len(rows), len(rows[0])
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    raw = b"".join(b"\0" + bytes(v for px in row for v in px) for row in rows)
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0))
    if dpi_ppm:
        out += chunk(b"pHYs", struct.pack(">IIB", dpi_ppm, dpi_ppm, 1))
    return out + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def pixels(spark, images):
    """Dense pixel relation from {image_id: rows of (r, g, b, a)}."""
    data = [
        (i, len(rows[0]), len(rows), x, y, *px)
        for i, rows in images.items() for y, row in enumerate(rows) for x, px in enumerate(row)
    ]
    return spark.createDataFrame(data, "image_id long, w int, h int, x int, y int, r int, g int, b int, a int")


def canvas(w, h, colour, box=None, fill=None):
    rows = [[colour] * w for _ in range(h)]
    if box:
        bx, by, bw, bh = box
        for y in range(by, by + bh):
            rows[y][bx:bx + bw] = [fill] * bw
    return rows
