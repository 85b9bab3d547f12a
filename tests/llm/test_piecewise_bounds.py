"""Signatures are bounded, hold every byte, and their likeness is that of the definition."""

import random
import time
import zlib

import numpy as np
import pytest

from rivertrack.llm import piecewise_hash as P


def _plain(data):
    """The fingerprint by the definition, byte by byte."""

    def rolling(i):
        h = 0
        for k in range(min(P.WINDOW, i + 1)):
            h = (h + (data[i - k] + 1) * pow(0x01000193, k, 1 << 32)) & 0xFFFFFFFF
        h = h * 0x9E3779B1 & 0xFFFFFFFF
        h ^= h >> 15
        return (h * 0x85EBCA77 & 0xFFFFFFFF) >> 8

    found = [rolling(i) for i in range(len(data))]
    block = 1
    while block * P.CHUNKS < len(data):
        block *= 2

    def ends(size):
        return [i + 1 for i, h in enumerate(found) if h & size - 1 == size - 1]

    while len(ends(block)) >= P.MOST_CHUNKS:
        block *= 2

    def signature(size):
        cuts = sorted({0, *ends(size), len(data)})
        return "".join(P._LETTERS[zlib.crc32(data[a:b]) & 63] for a, b in zip(cuts, cuts[1:]))

    return f"{block}:{signature(block)}:{signature(2 * block)}"


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _near(a, b):
    """The likeness by the definition."""
    if a == b:
        return 1.0
    (n, *x), (m, *y) = a.split(":"), b.split(":")
    out = 0.0
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            if int(n) << i == int(m) << j and (i, j) != (1, 1) or (int(n) == int(m) and i == j):
                run = min(P.RUN, len(p), len(q))
                if p == q:
                    out = max(out, 1.0)
                elif run and any(p[k : k + run] in q for k in range(len(p) - run + 1)):
                    out = max(out, 1 - _distance(p, q) / max(len(p), len(q)))
    return out


def _texts():
    rng = random.Random(4)
    words = [f"word{i}" for i in range(50)]
    out = [b"", b"a", b"ab" * 40, b"\0" * 200]
    for n in (5, 40, 200, 900):
        base = [rng.choice(words) for _ in range(n)]
        out.append(" ".join(base).encode())
        base[n // 2] = "edited"
        out.append(" ".join(base).encode())
        out.append(" ".join(base[n // 3 :] + base[: n // 3]).encode())
    return out


def test_fingerprints_and_likeness_are_the_definition():
    texts = _texts()
    marks = [P.fingerprint(t) for t in texts]
    assert marks == [_plain(t) for t in texts]
    for a in marks:
        for b in marks:
            assert P.likeness(a, b) == pytest.approx(_near(a, b))


def test_bounded_however_a_text_repeats_itself(monkeypatch):
    unit = next(u for i in range(9999) if len(P._ends((u := f"row {i:04} x ".encode()) * 300)[1]) > 250)
    for text in (unit * 40_000, b"a" * 400_000, b"xy" * 200_000, bytes(np.random.default_rng(1).integers(0, 2, 300_000, np.uint8))):
        began = time.perf_counter()
        mark = P.fingerprint(text)
        assert all(len(s) <= P.MOST_CHUNKS for s in mark.split(":")[1:])
        other = P.fingerprint(text[: len(text) // 2] + text[: len(text) // 3])
        assert 0 <= P.likeness(mark, other) <= 1 and P.likeness(mark, mark) == 1
        assert time.perf_counter() - began < 3
    monkeypatch.setattr(P, "MOST_CHUNKS", 8)
    small = unit * 40
    assert P.fingerprint(small) == _plain(small)
