"""File catalogue sources: listings, validation, encoded payloads, JSON stores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterqa import dims, schemas
from rasterqa.functions.numbers import half_even
from rasterqa.functions.text import display_name, extension


def scan_catalog(spark, path: str) -> DataFrame:
    """Images below a folder with size in KB; file contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return list_images(files.select("path", "length"))


def list_images(files: DataFrame) -> DataFrame:
    ext = F.ltrim(extension(F.col("path")), F.lit("."))
    kept = files.filter(ext.isin(dims.IMAGE_EXTENSIONS))
    return kept.select("path", F.substring_index("path", "/", -1).alias("name"),
                       half_even(F.col("length") / 1024, 1).alias("size_kb"))


def _facts(raw: bytes | None) -> tuple[int | None, int | None, float | None]:
    """Width, height and dots per inch that an image file states, None where it doesn't.

    PNG chunks and JPEG segments are walked by their lengths up to the picture data.
    """
    if not raw:
        return None, None, None
    number = lambda at, n: int.from_bytes(raw[at:at + n], "big")
    little = lambda at, n: int.from_bytes(raw[at:at + n], "little")
    width = height = dpi = None
    if raw[:4] == b"\x89PNG":
        at = 8
        while at + 8 <= len(raw):
            size, kind = number(at, 4), raw[at + 4:at + 8]
            if kind == b"IHDR":
                width, height = number(at + 8, 4), number(at + 12, 4)
            elif kind == b"pHYs" and raw[at + 16:at + 17] == b"\x01" and number(at + 8, 4):
                dpi = number(at + 8, 4) * 0.0254
            elif kind in (b"IDAT", b"IEND"):
                break
            at += 12 + size
    elif raw[:3] == b"\xff\xd8\xff":
        at = 2
        while at + 4 <= len(raw) and raw[at] == 0xFF:
            mark, size = raw[at + 1], number(at + 2, 2)
            if mark == 0xFF:  # fill byte
                at += 1
                continue
            if mark == 0xE0 and raw[at + 4:at + 9] == b"JFIF\x00" and number(at + 12, 2):
                dpi = {1: 1.0, 2: 2.54}.get(raw[at + 11], 0.0) * number(at + 12, 2) or dpi
            elif mark == 0xE1 and raw[at + 4:at + 10] == b"Exif\x00\x00" and dpi is None:
                dpi = _exif_density(raw[at + 10:at + 2 + size])
            elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                height, width = number(at + 5, 2), number(at + 7, 2)
                break
            elif mark in (0xD9, 0xDA):
                break
            at += 2 + size
    elif raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
        if raw[12:16] == b"VP8X":
            width, height = little(24, 3) + 1, little(27, 3) + 1
        elif raw[12:16] == b"VP8L":
            bits = little(21, 4)
            width, height = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        elif raw[12:16] == b"VP8 ":
            width, height = little(26, 2) & 0x3FFF, little(28, 2) & 0x3FFF
    return width or None, height or None, dpi or None


def _exif_density(tiff: bytes) -> float | None:
    """Dots per inch of the first directory of an Exif block."""
    order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
    if order is None:
        return None
    number = lambda at, n: int.from_bytes(tiff[at:at + n], order)
    first, unit, density = number(4, 4), 2, None
    for at in range(first + 2, min(first + 2 + 12 * number(first, 2), len(tiff) - 11), 12):
        tag, kind = number(at, 2), number(at + 2, 2)
        if tag == 0x011A and kind == 5 and number(number(at + 8, 4) + 4, 4):
            density = number(number(at + 8, 4), 4) / number(number(at + 8, 4) + 4, 4)
        elif tag == 0x0128:
            unit = number(at + 8, 2)
    return density * {2: 1.0, 3: 2.54}.get(unit, 0.0) or None if density else None


@F.pandas_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("dpi", T.DoubleType())]))
def image_facts(content: pd.Series) -> pd.DataFrame:
    facts = pd.DataFrame([_facts(c) for c in content], columns=["width", "height", "dpi"], dtype=object)
    return facts.astype({"width": "Int64", "height": "Int64", "dpi": "Float64"})


def with_dpi(files: DataFrame, override: Column | None = None, keep: bool = False) -> DataFrame:
    """DPI that PNG and JPEG files state (JPEG: JFIF before Exif), else 300; an override wins."""
    read = files.withColumn("_facts", image_facts("content"))
    stated = F.rint(F.col("_facts.dpi")).cast("int")
    found = F.when(stated > 0, stated)
    given = F.lit(None).cast("int") if override is None else F.when(override > 0, override.cast("int"))
    return read.withColumn("dpi", F.coalesce(given, found, F.lit(dims.DEFAULT_DPI))).withColumn(
        "dpi_from_file", given.isNull() & found.isNotNull()).drop(*[] if keep else ["_facts"])


def reject_reason(length: Column, head: Column, width: Column, height: Column) -> Column:
    """First reason to refuse an upload; NULL if it is fine. ``head``: hex of the first bytes."""
    png, jpg = head.startswith("89504E47"), head.startswith("FFD8FF")
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    side = dims.IMAGE_MAX_SIDE
    return (
        F.when(length == 0, "Empty image.").when(length > dims.IMAGE_MAX_BYTES, "Image exceeds the 25 MB limit.")
        .when(~(png | jpg | webp), "Unsupported or corrupt image. Use PNG, JPG or WEBP.")
        .when((width > side) | (height > side), F.concat(
            F.lit("Image too large ("), width, F.lit("x"), height, F.lit(f"px). Max {side}px per side."))))


def validate_images(files: DataFrame) -> DataFrame:
    """Add ``width``, ``height`` (PNG, JPEG, WEBP) and ``reason`` to ``(path, length, content)``."""
    head = F.hex(F.substring("content", 1, 32))
    w, h = F.col("_facts.width"), F.col("_facts.height")
    read = files.withColumn("_facts", image_facts("content"))
    return read.select(*files.columns, w.alias("width"), h.alias("height"), reject_reason(F.col("length"), head, w, h).alias("reason"))


def inspect_files(files: DataFrame, override: Column | None = None) -> DataFrame:
    """``path, length, width, height, dpi, dpi_from_file, reason`` of ``(path, length, content)``.

    Each header is read once and the bytes go no further; ``validate_images`` and ``with_dpi`` say
    what the columns hold.
    """
    checked = with_dpi(files.withColumn("_head", F.hex(F.substring("content", 1, 32))), override, keep=True)
    w, h = F.col("_facts.width"), F.col("_facts.height")
    return checked.select("path", "length", w.alias("width"), h.alias("height"), "dpi", "dpi_from_file",
                          reject_reason(F.col("length"), F.col("_head"), w, h).alias("reason"))


def inspect_folder(spark, path: str) -> DataFrame:
    """``inspect_files`` of the images below a folder. Spark's file sources list no empty files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.ltrim(extension(F.col("path")), F.lit("."))
    return inspect_files(found.filter(ext.isin(dims.IMAGE_EXTENSIONS)).select("path", "length", "content"))


def read_base64(payloads: DataFrame) -> DataFrame:
    """Payload text, with or without a ``data:`` prefix, to bytes; NULL where it is not base64."""
    body = F.when(F.col("payload").startswith("data:"), F.substring_index("payload", ",", -1)).otherwise(F.col("payload"))
    return payloads.select("*", F.try_to_binary(F.trim(body), F.lit("base64")).alias("content"))


def diag_entries(lines: DataFrame) -> DataFrame:
    """Diagnostics entries from JSON text lines; unreadable lines are dropped."""
    parsed = lines.select(F.from_json("value", schemas.DIAG_ENTRY + ", _corrupt string", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    return parsed.select("e.*").filter("_corrupt is null").drop("_corrupt")


def json_map(text: DataFrame, value_schema: str) -> DataFrame:
    """A JSON object of records ``(value)`` to rows ``(key, record fields)``."""
    return text.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias("key", "rec")).select("key", "rec.*")


def browse(entries: DataFrame, root: str, path: str) -> DataFrame:
    """Children of a folder, folders by name then files newest first."""
    parent = F.regexp_replace("path", "/[^/]*$", "")
    kids = entries.filter((parent == path) & (F.col("path") != path))
    return kids.orderBy(F.desc("is_dir"), F.when(F.col("is_dir"), F.lower("name")), F.desc("modified_ms"), "name")


def breadcrumbs(path: Column, root: str) -> Column:
    """``label>path`` steps from the root down, customer folders by display name."""
    parts = F.filter(F.split(F.regexp_replace(path, f"^{root}/?", ""), "/"), lambda p: p != "")
    step = lambda p, i: F.concat(
        F.when(i == 0, display_name(p)).otherwise(p), F.lit(">"), F.lit(root + "/"), F.array_join(F.slice(parts, 1, i + 1), "/"))
    return F.array_join(F.concat(F.array(F.lit(f"{root}>{root}")), F.transform(parts, step)), " | ")


def scan_modified_since(entries: DataFrame, cursor_ms, limit: int) -> DataFrame:
    """Files changed after the cursor, oldest first, at most ``limit`` (1..2000)."""
    n = max(1, min(2000, limit))
    return entries.filter(~F.col("is_dir") & (F.col("modified_ms") > cursor_ms)).orderBy("modified_ms", "path").limit(n)


def _tag(name: str) -> Column:
    raw = F.regexp_extract("block", rf"(?is)<[^>]*{name}[^>]*>(.*?)</[^>]*{name}>", 1)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(entity), F.lit(char))
    return F.trim(raw)


def parse_listing(documents: DataFrame) -> DataFrame:
    """Directory listing documents ``(doc_id, body)`` to entry rows."""
    blocks = F.regexp_extract_all("body", F.lit(r"(?is)<[^>]*:response[\s>].*?</[^>]*:response>"), F.lit(0))
    rows = documents.select("doc_id", F.explode(blocks).alias("block"))
    path = F.regexp_replace(F.regexp_replace(F.url_decode(F.replace(_tag("href"), F.lit("+"), F.lit("%2B"))), r"^.*?/dav/files/[^/]+/", ""), "^/+|/+$", "")
    when = F.try_to_timestamp(F.substring(_tag("getlastmodified"), 6, 40), F.lit("dd MMM yyyy HH:mm:ss z"))
    return rows.select(
        "doc_id", path.alias("path"), F.substring_index(path, "/", -1).alias("name"),
        F.col("block").rlike(r"(?i)<[^>]*:collection\s*/?>").alias("is_dir"),
        F.coalesce(_tag("getcontentlength").try_cast("bigint"), F.lit(0)).alias("size"),
        F.replace(_tag("getetag"), F.lit('"'), F.lit("")).alias("etag"), _tag("getcontenttype").alias("mime_type"),
        F.coalesce(F.unix_millis(when), F.lit(0)).alias("modified_ms"), _tag("fileid").alias("fileid"),
    ).filter("path <> ''")
