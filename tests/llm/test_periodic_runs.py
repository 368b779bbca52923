"""Periodic runs against brute force over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from texts import SPACED, prose, sample

from pulsegrid.llm import periodic_runs as P


def brute_runs(w):
    """(start, length, period) of all runs, by trying each period."""
    found = {}
    n = len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= 12:
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = j + 1
    return sorted((a, n, q) for (a, n), q in found.items())


def brute(doc_id, text):
    w = re.findall(SPACED, text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    milli = 1000 * best[1] // best[2] if runs else None
    return (len(runs), *best, milli, sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def texts():
    rng = random.Random(5)
    rows = sample() + [(None, "null id " * 30), (7, "same " * 40)]
    for i in range(60):  # few different words: many runs that overlap
        rows.append((1000 + i, " ".join(rng.choice("ab" if i % 2 else "abc") for _ in range(rng.randint(0, 90)))))
    for i in range(20):
        unit = prose(i, rng.randint(1, 40))
        rows.append((2000 + i, f"{prose(i + 50, 20)} {' '.join([unit] * rng.randint(1, 5))} {unit[: len(unit) // 2]} {prose(i + 90, 9)}"))
    rows += [(3000 + i, prose(i, 80)) for i in range(40)]  # some are rewritten
    rows += [(2000, rows[-1][1])]  # a doc_id twice
    return rows


@pytest.fixture
def small(monkeypatch):
    """Tiles so small that a few hundred words make many of them in several octaves."""
    for name, value in (("BASE", 40), ("SHORT", 8), ("OVERLAP", 16)):
        monkeypatch.setattr(P, name, value)


def solve(w):
    ids = {x: i for i, x in enumerate(dict.fromkeys(w))}
    s = P.mix(np.array([ids[x] for x in w], np.uint64) + np.uint64(1))
    found = [P.fragments(s[lo:hi], least, beyond) + np.array([0, lo, lo]) for lo, hi, least, beyond in P.tiles(len(w))]
    return sorted((a, b - a, q) for q, a, b in P.stitched(np.concatenate(found)).tolist()) if found else []


def test_z_function():
    rng = random.Random(1)
    for _ in range(50):
        s = [rng.choice("ab") for _ in range(rng.randint(1, 30))]
        want = [0] + [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s))]
        assert P.z_function(s) == want


@pytest.mark.parametrize("seed", range(12))
def test_tiles_equal_brute_force(small, seed):
    rng = random.Random(seed)
    w = [rng.choice("ab") for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 6)):
        unit = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 70))]
        w += unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))]
    assert solve(w) == brute_runs(w)


def test_overlap_holds_twice_the_longest_period():
    for n in (P.BASE + 1, 30_000, 200_001):
        by_range = {}
        for lo, hi, least, beyond in P.tiles(n):
            by_range.setdefault((least, beyond), []).append((lo, hi))
        edges = sorted(by_range)
        assert edges[0][0] == 1 and edges[-1][1] > n // 2 and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))
        for (_, beyond), spans in by_range.items():
            assert spans[0][0] == 0 and spans[-1][1] == n
            assert all(a[1] - b[0] >= max(2 * (beyond - 1), P.MIN_WORDS) for a, b in zip(spans, spans[1:]))


def test_documents_equal_brute_force(docs):
    rows = texts()
    got = sorted(((r.doc_id, *tuple(r)[1:]) for r in P.periodic_runs(docs(rows)).collect()), key=str)
    assert got == sorted(((i, *brute(i, t)) for i, t in rows), key=str)
    assert P.periodic_runs(docs(rows).filter("false")).count() == 0


def test_long_documents_equal_brute_force(docs):
    """Texts of several tiles: runs within one, over several, and with periods of several octaves."""
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    unit = words(700)
    long = {
        1: words(3000) + ["x"] * 5000 + words(100),
        2: words(10) + unit * 9 + unit[:33] + words(2000),
        3: words(4000) + words(3) * 100 + words(1500) + unit + unit + words(5),
        4: words(6000),
        6: words(9000),
    }
    rows = [(i, " ".join(w)) for i, w in long.items()] + [(9, "short " * 13), (None, " ".join(long[2]))]
    rows += [(i, " ".join(long[6])) for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    got = {}
    for r in P.periodic_runs(docs(rows)).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    for i, t in rows:
        n = len(t.split())
        w = t.split()
        places = P.rewriting(zlib.crc32(str(i).encode()) if i is not None else None, n)
        w = w if places is None else [w[k] for k in places.tolist()]
        assert len(w) == n
        want = fast_brute(w)
        assert (want, got[i][0][0]) == (want, len(want))
        told = "".join(f"{a},{m},{q}\n" for a, m, q in want)
        assert got[i][0][5] == hashlib.sha256(told.encode()).hexdigest()


def fast_brute(w):
    """As brute_runs, with arrays."""
    ids = {x: k for k, x in enumerate(dict.fromkeys(w))}
    s = np.array([ids[x] for x in w])
    found = {}
    for q in range(1, len(s) // 2 + 1):
        same = np.concatenate([[0], s[q:] == s[:-q], [0]]).astype(np.int8)
        steps = np.diff(same)
        for a, b in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist()):
            if b - a >= q and b - a + q >= 12:
                found.setdefault((a, b - a + q), q)
    return sorted((a, m, q) for (a, m), q in found.items())
