"""Plain Python versions of the operators, for small fixtures."""

import re
import zlib


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or ""))


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def shingles(t, width):
    w = words(t)
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0
