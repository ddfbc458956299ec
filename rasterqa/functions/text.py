"""Text rules as column expressions: redaction, names, paths, addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterqa import dims

MASK = "***REDACTED***"

# --- Fixed values: secret patterns; $1 keeps the label, patterns without one mask all ---
SECRET_PATTERNS = [
    r"(?i)(authorization\s*[:=]\s*)(?:bearer\s+)?\S+",
    r"""(?i)(password["']?\s*[:=]\s*)(?:"[^"]*"|'[^']*'|\S+)""",
    r"""(?i)(passwd["']?\s*[:=]\s*)(?:"[^"]*"|'[^']*'|\S+)""",
    r"""(?i)(token["']?\s*[:=]\s*)(?:"[^"]*"|'[^']*'|\S+)""",
    r"""(?i)(secret["']?\s*[:=]\s*)(?:"[^"]*"|'[^']*'|\S+)""",
    r"""(?i)(api[_-]?key["']?\s*[:=]\s*)(?:"[^"]*"|'[^']*'|\S+)""",
    r"()\bagt_[A-Za-z0-9_\-]{8,}",
    r"()\bBearer\s+[A-Za-z0-9._\-]{8,}",
]
SECRET_ENV_KEYS = ["APP_PASSWORD_HASH", "APP_SECRET_KEY", "AGENT_TOKEN", "PASSWORD",
                   "PASSWORD_OBF", "API_KEY", "SECRET"]
COOKIE_PATTERN = r"(?i)((?:set-)?cookie\s*[:=]\s*).+"
DROP_KEYS = ["authorization", "password", "password_obf", "token", "agent_token", "secret", "api_key"]

# Every pattern above needs one of these, in any case; texts without any are left alone.
ANCHORS = ["authorization", "passw", "token", "secret", "api", "agt_", "bearer", "cookie"]

ENV_PATTERNS = [rf"(?im)^(\s*{key}\s*[:=]\s*).+$" for key in SECRET_ENV_KEYS]


def redact(col: Column, cookies: bool = True, keys: tuple[str, ...] = ()) -> Column:
    """Mask secrets, ``KEY=value`` lines of known keys and of your own ``keys``, and cookies."""
    own = [rf"(?im)^(\s*{re.escape(key)}\s*[:=]\s*).+$" for key in keys]
    patterns = SECRET_PATTERNS + ENV_PATTERNS + own + ([COOKIE_PATTERN] if cookies else [])
    low, clean = F.lower(col), col
    for pattern in patterns:
        clean = F.regexp_replace(clean, pattern, "$1" + MASK)
    suspect = F.contains(low, F.lit(ANCHORS[0]))
    for word in [*ANCHORS[1:], *(k.lower() for k in keys)]:
        suspect = suspect | F.contains(low, F.lit(word))
    return F.when(suspect, clean).otherwise(col)


def drop_secret_keys(record: Column) -> Column:
    return F.map_filter(record, lambda k, v: ~F.lower(k).isin(DROP_KEYS))


def slug(name: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"[^A-Za-z0-9]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(s == "", "colour").otherwise(s)


def safe_file_name(name: Column) -> Column:
    """Letters, digits and ``- _ @ .`` stay, the rest becomes ``_``; at most 120 characters."""
    s = F.substring(F.regexp_replace(
        F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(name), r"[^\p{L}\p{N}\-_@.]", "_"), 1, 120)
    return F.when(s == "", "unknown").otherwise(s)


def hex_to_rgb(hexv: Column) -> Column:
    """``[r, g, b]`` of a 3- or 6-digit colour; mid grey if it is not one."""
    h = F.regexp_replace(F.coalesce(hexv, F.lit("")), "^#+", "")
    full = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    part = lambda i: F.conv(F.substring(full, i, 2), 16, 10).cast("int")
    return F.when(full.rlike("^[0-9A-Fa-f]{6}$"), F.array(part(1), part(3), part(5))).otherwise(
        F.array(F.lit(128), F.lit(128), F.lit(128)))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


def valid_email(col: Column) -> Column:
    return F.trim(F.coalesce(col, F.lit(""))).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def user_key(col: Column) -> Column:
    return F.lower(F.trim(F.coalesce(col, F.lit(""))))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1)


def url_identity(url: Column) -> Column:
    """A file token if the URL carries one, else the URL without its query."""
    by_id = F.regexp_extract(url, r"id=(file[-_][A-Za-z0-9]+)", 1)
    anywhere = F.regexp_extract(url, r"(file[-_][A-Za-z0-9]{6,})", 1)
    plain = F.substring_index(url, "?", 1)
    return F.when(url == "", None).when(url.startswith("blob:"), url).when(by_id != "", by_id).when(
        anywhere != "", anywhere).when(plain != "", plain).otherwise(url)


def ipv4_number(host: Column) -> Column:
    """Dotted address as a number; NULL if it is not one."""
    parts = F.split(host, r"\.")
    octet = lambda i: F.get(parts, F.lit(i)).try_cast("bigint")
    number = ((octet(0) * 256 + octet(1)) * 256 + octet(2)) * 256 + octet(3)
    ok = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.greatest(*[octet(i) for i in range(4)]) <= 255)
    return F.when(ok, number)


def _range(cidr: str) -> tuple[int, int]:
    base, bits = cidr.split("/")
    low = sum(int(p) << (24 - 8 * i) for i, p in enumerate(base.split(".")))
    return low, low + (1 << (32 - int(bits))) - 1


def blocked_host(host: Column) -> Column:
    """True for an address outside the public ranges. Names resolve elsewhere: NULL."""
    number = ipv4_number(host)
    inside = F.lit(False)
    for cidr in dims.BLOCKED_RANGES:
        low, high = _range(cidr)
        inside = inside | number.between(low, high)
    looks_v6 = F.contains(host, F.lit(":"))
    public_v6 = F.lower(host).rlike("^[23][0-9a-f]{3}:") & ~F.lower(host).startswith("2001:db8")
    digits = host.rlike(r"^[\d.]+$")
    return F.when(looks_v6, ~public_v6).when(number.isNotNull(), inside).when(digits, True)


def display_name(folder: Column) -> Column:
    """Customer name of a filing folder: date prefix dropped, underscores to spaces."""
    raw = F.trim(F.coalesce(folder, F.lit("")))
    name = F.trim(F.replace(F.regexp_replace(raw, r"^\d{6}_", ""), F.lit("_"), F.lit(" ")))
    return F.when(name == "", raw).otherwise(name)


def customer_folder(path: Column, root: str) -> Column:
    rest = F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 20)).otherwise(path)
    return F.substring_index(F.regexp_replace(rest, "^/+|/+$", ""), "/", 1)


def is_sent_file(path: Column) -> Column:
    """A mockup that was sent out: in a sent folder, or named ``...-OUT.ext``."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    named = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return F.exists(folders, lambda p: F.lower(p).isin("sent", "outgoing")) | named.rlike(r"(?i)-OUT\d*\.[A-Za-z0-9]+$")


def safe_path(path: Column, root: str) -> Column:
    """Path confined to the root; NULL where it tries to climb out."""
    parts = F.filter(F.split(F.trim(F.replace(path, F.lit("\\"), F.lit("/"))), "/"), lambda p: (p != "") & (p != "."))
    clean = F.array_join(parts, "/")
    inside = F.when(clean == "", root).when((clean == root) | clean.startswith(root + "/"), clean).otherwise(
        F.concat(F.lit(root + "/"), clean))
    return F.when(~F.exists(parts, lambda p: p == ".."), inside)


def artwork_code(name: Column) -> Column:
    return F.upper(F.regexp_extract(name, r"(?i)(AW-[A-Za-z0-9]+-\d{4})", 1))
