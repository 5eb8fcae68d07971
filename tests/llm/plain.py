"""Plain Python versions of the operators, slow and direct, for comparison."""

import hashlib
import re

import numpy as np
import xxhash


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def repeats(rows, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)} of rows with different ids."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            part = data[s : s + length]
            if part in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen.add(part)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def fingerprint(text, width=4):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text))
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    ones = [0] * 64
    for gram in grams:
        h = xxhash.xxh64_intdigest(gram.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def near_components(prints, within=4):
    """Smallest index reachable over links of at most ``within`` bits, for a list of fingerprints."""
    f = np.array(prints, np.uint64)
    label = np.arange(len(f))
    near = [np.flatnonzero(np.bitwise_count(f ^ x) <= within) for x in f]
    while True:
        new = np.array([label[n].min() for n in near]) if len(f) else label
        if (new == label).all():
            return label.tolist()
        label = new


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall(lower(text))


def contamination(text, items, width=10):
    w = words(text)
    hit, found = set(), set()
    for item, body in items:
        iw = words(body)
        for i in range(max(1, len(iw) - width + 1) if iw else 0):
            window = iw[i : i + width]
            for s in range(len(w) - len(window) + 1):
                if w[s : s + len(window)] == window:
                    hit.update(range(s, s + len(window)))
                    if item is not None:
                        found.add(str(item))
    listed = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)
