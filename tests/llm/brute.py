"""Plain versions of the operators' results, row by row in memory."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return SPACE.findall(text)


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def base_scores(docs):
    tokens = [(i, [*words(t, True), None]) for i, t in docs]
    c = Counter(w for i, x in tokens if fold(i, 10) for w in x)
    n, v = sum(c.values()), len(c)
    return [(i, fold(i, 10) == 0, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in x))
            for i, x in tokens]


def _spans(kind, pattern, text, ok):
    return [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if ok(m)]


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(text):
    text, d = text or "", lambda m: re.sub("[^0-9]", "", m[0])
    return [
        *_spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text, lambda m: True),
        *_spans("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text, lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        *_spans("card", r"[0-9]([\x20-]?[0-9])+", text, lambda m: 13 <= len(d(m)) <= 19 and _luhn(d(m))),
        *_spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", text, lambda m: 9 <= len(d(m)) <= 15),
    ]


def secrets(text):
    text = text or ""
    found = [
        _spans("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, lambda m: len(m[2]) >= 6),
        _spans("access", r"AKIA[A-Z0-9]+", text, lambda m: len(m[0]) >= 20),
        _spans("hex", r"[0-9a-f]+", text, lambda m: len(m[0]) >= 24),
    ]
    rows = sorted((a, n, k, e) for n, group in enumerate(found) for k, a, e in group)
    return [(k, a, e) for a, _, k, e in rows]


def joined(spans):
    return ",".join(f"{k}:{a}:{e}" for k, a, e in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def targets(sizes):
    """Word targets of ``{source: size}`` by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    live, left, out = set(names), float(sum(sizes.values())), {}
    while live:
        total = sum(weight[s] for s in live)
        over = [s for s in live if left * weight[s] / total > 3 * sizes[s] + 1e-9]
        if not over:
            out |= {s: left * weight[s] / total for s in live}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            live.discard(s)
    return out


def quality(text):
    text = text or ""
    w = words(text)
    n = len(w)
    c = Counter(zip(w, w[1:], w[2:]))
    twice = [False] * n
    for p in range(n - 2):
        if c[w[p], w[p + 1], w[p + 2]] > 1:
            twice[p:p + 3] = [True] * 3
    lines = [x for x in text.split("\n") if words(x)]
    repeat = sum(twice)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, n < 50 or 100 * repeat > 50 * n)


def without_repeats(texts, depth):
    """(words, words removed, kept text) of each text."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[p:p + depth]) for w in split for p in range(len(w) - depth + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for p in range(len(w) - depth + 1):
            if seen[tuple(w[p:p + depth])] > 1:
                gone[p:p + depth] = [True] * depth
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def near_classes(docs, size, percent):
    """``{id: (shingles, smallest linked id)}``."""
    sets = {}
    for i, t in docs:
        w = words(t, True)
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < size else zip(*(w[k:] for k in range(size))))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def check_packing(rows, docs, encode, size=4096):
    """Every id of every document in exactly one piece, sequences gapless; returns the share of padding."""
    want = defaultdict(list)
    for i, t in docs:
        want[i].append(b"".join(x.to_bytes(4, "little") for x in [*encode(t or ""), 2]))
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        fits = [b for b in want[r["doc_id"]] if r["doc_tokens"] == len(b) // 4 and zlib.crc32(b[4 * r["start"]:4 * (r["start"] + r["length"])]) == r["ids_crc32"]]
        assert fits and r["length"] > 0
        got[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, bodies in want.items():
        assert sum(n for _, n in got[i]) == sum(len(b) // 4 for b in bodies)
        if len(bodies) == 1:
            at = 0
            for start, n in sorted(got[i]):
                assert start == at
                at += n
    filled = padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= size
        filled += at
        padding += size - at if at & (at - 1) else 0
    return padding / (padding + filled)


def planted(doc_id, text):
    """Words of a document, with repeats planted into every tenth."""
    w = words(text)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def periodic(w, exponent=4, least=6):
    """(start, end, period) of the runs, by start and period: each shift on its own."""
    found = set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q) and not any((i, j + q, d) in found for d in range(1, q)):
                found.add((i, j + q, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def run_row(doc_id, text):
    w = planted(doc_id, text)
    found = periodic(w)
    top = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *best, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
