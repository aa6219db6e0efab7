"""Plain versions of what the operators compute, written from their definitions."""

import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    t = text or ""
    return WORD.findall(t.translate(AZ) if lower else t)


def crc(text):
    return zlib.crc32(str(text).encode()) if text is not None else None


def fingerprint(text):
    w = words(text, True)
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def clusters(prints, distance=2):
    """Smallest fingerprint reachable from each."""
    out = {}
    left = set(prints)
    while left:
        start = left.pop()
        group, todo = {start}, [start]
        while todo:
            x = todo.pop()
            near = [y for y in left if (x ^ y).bit_count() <= distance]
            left.difference_update(near)
            group.update(near)
            todo += near
        for x in group:
            out[x] = min(group)
    return out


def quality_counts(text):
    t = text or ""
    w = words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(inside)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_pii(text):
    t, out = text or "", []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                           r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True,
                  16 <= len(digits) <= 19 and luhn(digits), 8 <= len(digits) <= 15)[k]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Water filling by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if cap * sizes[s] <= left * w[s] / total + 1e-9]
        if not full:
            out.update({s: left * w[s] / total for s in open_})
            break
        for s in full:
            out[s] = cap * sizes[s]
            open_.remove(s)
        left -= sum(out[s] for s in full)
    return out
