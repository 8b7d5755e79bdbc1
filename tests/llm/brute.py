"""Plain Python statements of what the operators must give."""

import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def words(text):
    return WORD.findall(text or "")


def fingerprint(text, width):
    found = words((text or "").translate(LOWER))
    if not found:
        return 0
    shingles = [" ".join(found[i:i + width]) for i in range(len(found) - width + 1)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(prints, bits=3):
    """Lists of positions joined by chains of near fingerprints."""
    prints = np.array(prints, np.uint64)
    left, out = set(range(len(prints))), []
    while left:
        waiting, group = [left.pop()], []
        while waiting:
            at = waiting.pop()
            group.append(at)
            near = {int(i) for i in np.flatnonzero(np.bitwise_count(prints ^ prints[at]) <= bits)} & left
            left -= near
            waiting.extend(near)
        out.append(sorted(group))
    return out


def without_repeats(rows, width):
    """(id, kept words, n_words) of (id, text) rows in the order of ids."""
    seen, out = {}, []
    for i, text in rows:
        found = words(text)
        gone = [False] * len(found)
        for s in range(len(found) - width + 1):
            window = tuple(found[s:s + width])
            if seen.setdefault(window, (i, s)) != (i, s):
                gone[s:s + width] = [True] * width
        out.append((i, [w for w, g in zip(found, gone) if not g], len(found)))
    return out


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated(docs, items, size=10):
    """id -> (n_words, n_hit, sorted item ids as text)."""
    cut = {}
    for item, text in items:
        found = ITEM_WORD.findall((text or "").translate(LOWER))
        for s in range(max(len(found) - size, 0) + 1 if found else 0):
            cut.setdefault(tuple(found[s:s + size]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in cut}
    out = []
    for i, text in docs:
        found = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, held = set(), set()
        for n in sizes:
            for s in range(len(found) - n + 1):
                window = tuple(found[s:s + n])
                if window in cut:
                    hit.update(range(s, s + n))
                    held |= cut[window]
        out.append((i, len(found), len(hit), sorted(held)))
    return out
