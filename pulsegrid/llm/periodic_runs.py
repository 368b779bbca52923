"""Periodic run detection: maximal stretches of words that repeat with a period, found in tiles for each octave of periods.

A document is cut into overlapping tiles. Periods below ``SHORT`` share tiles of ``BASE`` words; each octave above it (periods ``p`` to
``2p``) has tiles of ``12p`` words. Neighbouring tiles share at least twice the longest period, so any two periods of a run lie whole in some
tile. A tile is solved alone: boundaries stand ``p`` words apart, and a run of the octave holds one of them together with its image a
period later. Hashes of half an octave's words tell at which boundaries anything repeats that is not known yet; there, Z-functions of the words after and before the
boundary give for every period how far the repetition reaches, within a window around the boundary, and direct comparison carries it on to the tile's ends. What also
has a smaller period is left out by a sieve over multiples. This gives fragments (period, start, end), which are stitched by document and period: two fragments of one run share at least
a period, two different runs of equal period less.

A document that fits one tile needs no stitching, so its result is made where it is read. The tiles of longer documents are
dealt over tasks by a shuffle, and their fragments meet by document and period. A tile holds numbers for words, a task a bounded number of words; one
text must fit a task. Words are compared by 64-bit hashes within a document.

Null, empty and white text has no words: no run, four nulls, and digests of the empty text. A null doc_id is judged as it stands (its words are not rewritten);
repeated rows come out one by one; runs of equal length are decided by start, then period; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.shared import written
from pulsegrid.llm.textops import SPACED, _powers, mix, pack, slices, unpack, word_hashes, words

MIN_WORDS = 12
#: Words of a tile for periods below SHORT, and of the part shared by neighbours (twice SHORT).
BASE, SHORT, OVERLAP = 4096, 512, 1024

RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def octaves(least: int, beyond: int):
    """(least period, beyond, step of boundaries) of each octave that periods of a range need."""
    if least < 4:
        yield least, min(4, beyond), 8
        least = 4
    while least < beyond:
        yield least, min(2 * least, beyond), least
        least *= 2


def tiles(n: int):
    """(first word, beyond, least period, beyond) of the tiles of a document of ``n`` words."""
    if n <= BASE:
        yield 0, n, 1, n // 2 + 1
        return
    shapes = [(BASE - OVERLAP, BASE, 1, SHORT)]
    p = SHORT
    while 2 * p <= n:
        shapes.append((8 * p, 12 * p, p, 2 * p))
        p *= 2
    for step, size, least, beyond in shapes:
        lo = 0
        while True:
            yield lo, min(n, lo + size), least, beyond
            if lo + size >= n:
                break
            lo += step


def z_function(s: list) -> list[int]:
    """For each place of ``s`` how long it goes on as ``s`` begins; 0 for the first."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def _at_boundary(s: np.ndarray, c: int, step: int, least: int, beyond: int) -> np.ndarray:
    """Rows (period, start, end) of repetitions through boundary ``c`` without a smaller period, within a window around it."""
    lo, hi = max(0, c - 2 * step), min(len(s), c + 4 * step)
    most = min(beyond - 1, hi - c)
    if most < least:
        return np.zeros((0, 3), np.int64)
    after, before, image = s[c:hi].tolist(), s[lo:c][::-1].tolist(), s[lo : c + most][::-1].tolist()
    right = np.array([*z_function(after), 0])[1 : most + 1]
    left = np.array(z_function([*before, None, *image]))[len(before) + 1 :][:most][::-1]
    p = np.arange(1, most + 1)
    start, end = c - left, c + p + right
    repeats = end - start >= 2 * p
    for q in (np.flatnonzero(repeats[: most // 2]) + 1).tolist():
        if repeats[q - 1]:
            several = slice(2 * q - 1, most, q)
            repeats[several] &= ~((start[several] >= start[q - 1]) & (end[several] <= end[q - 1]))
    good = repeats & (p >= least) & (end - start >= MIN_WORDS)
    return np.stack([p[good], start[good], end[good]], axis=1)


def _never(n: int) -> np.ndarray:
    return mix(np.arange(n, dtype=np.uint64) + np.uint64(1 << 40))


def _same(s: np.ndarray, a: int, b: int) -> int:
    """How many words from ``a`` on equal those from ``b`` on, a later place."""
    n, done, size = len(s) - b, 0, 64
    while done < n:
        part = min(size, n - done)
        differs = s[a + done : a + done + part] != s[b + done : b + done + part]
        if differs.any():
            return done + int(differs.argmax())
        done, size = done + part, 2 * size
    return done


def _whole(s: np.ndarray, back: np.ndarray, period: int, start: int, end: int) -> tuple[int, int, int]:
    """A repetition with all words before and after it that keep its period; ``back`` is ``s`` reversed."""
    n = len(s)
    return period, start - _same(back, n - start - period, n - start), end + _same(s, end - period, end)


def fragments(s: np.ndarray, least: int, beyond: int) -> np.ndarray:
    """Rows (period, start, end) of the runs of an array of word hashes, cut at its ends; periods from ``least`` to below ``beyond``.

    A run that is found at one boundary is known whole; where it, or a run whose period divides the one in question, covers a period from another
    boundary on, nothing new can come of that.
    """
    n, back = len(s), s[::-1]
    known = np.zeros((0, 3), np.int64)
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(s * up[:n], dtype=np.uint64)])
    for first, past, step in octaves(least, min(beyond, n // 2 + 1)):
        # of what a repetition shares with its image, at least half lies on one side of the boundary
        shared = max(1, (max(first, MIN_WORDS - past + 1) + 1) // 2)
        if n < shared + first:
            continue
        blocks = -(-n // step)
        ahead, behind = _never((blocks + 2) * step), _never((blocks + 2) * step)
        with np.errstate(over="ignore"):
            grams = mix((sums[shared:] - sums[:-shared]) * down[: n - shared + 1])
        ahead[: len(grams)], behind[shared : n + 1] = grams, grams
        hit = np.zeros((blocks, past - first), bool)
        for x in (ahead, behind):
            own = x[: blocks * step : step, None]
            if first == step:
                hit |= x[step : step + blocks * step].reshape(blocks, step)[:, : past - first] == own
            else:
                hit |= np.stack([x[q : q + blocks * step : step] for q in range(first, past)], axis=1) == own
        block, period = np.nonzero(hit)
        edges = np.flatnonzero(np.diff(block, prepend=-1, append=blocks))
        for i, j in zip(edges.tolist(), edges[1:].tolist()):
            c, periods = int(block[i]) * step, period[i:j] + first
            for p, _, end in known[(known[:, 1] <= c) & (known[:, 2] > c)].tolist():
                periods = periods[(periods % p != 0) | (c + periods > end)]
            if len(periods):
                rows = [_whole(s, back, *row) for row in _at_boundary(s, c, step, first, past).tolist()]
                if rows:
                    known = np.unique(np.concatenate([known, np.array(rows, np.int64)]), axis=0)
    return stitched(known)


def stitched(rows: np.ndarray) -> np.ndarray:
    """Fragments (period, start, end) of one text joined where they share a period's words at least."""
    if not len(rows):
        return rows
    period, start, end = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))].T
    span = int(end.max()) + 1
    furthest = np.maximum.accumulate(end + period * span) - period * span
    new = np.ones(len(period), bool)
    new[1:] = (period[1:] != period[:-1]) | (start[1:] > furthest[:-1] - period[1:])
    at = np.flatnonzero(new)
    return np.stack([period[at], start[at], np.maximum.reduceat(end, at)], axis=1)


def digest(parts: list[bytes], runs: np.ndarray) -> tuple:
    """The result of a text of these words from its runs (period, start, end)."""
    if not len(runs):
        return 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b" ".join(parts)).hexdigest()
    period, start, end = runs[np.lexsort((runs[:, 0], runs[:, 1]))].T
    length = end - start
    best = np.lexsort((period, start, -length))[0]
    told = "".join(f"{a},{n},{q}\n" for a, n, q in zip(start.tolist(), length.tolist(), period.tolist()))
    edges = np.zeros(len(parts) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, end, -1)
    kept = [parts[i] for i in np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()]
    n, q = int(length[best]), int(period[best])
    return len(runs), int(start[best]), n, q, 1000 * n // q, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def rewriting(h: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place, where the doc_id's hash asks for a periodic end."""
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return places


def _parts(text: str | None, h: int | None) -> list[bytes]:
    parts = (text or "").encode("utf-8", "surrogatepass").split()
    places = rewriting(h, len(parts))
    return parts if places is None else [parts[i] for i in places.tolist()]


def _texts(batch: pa.RecordBatch):
    """(row, hashes of its words as they are judged) of each row of a batch."""
    ids = batch.column("h").to_pylist()
    for s in slices(batch.column("text")):
        starts, _, bounds = words(s, SPACED)
        hashes = word_hashes(s, starts, SPACED, lower=False)
        for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
            places = rewriting(ids[s.first + i], b - a)
            yield s.first + i, hashes[a:b] if places is None else hashes[a:b][places]


def _solved(pending: list[tuple[int, np.ndarray]]):
    """(row, runs) of texts of one tile each, solved side by side with words between them that equal no other."""
    sizes = np.array([len(x) + 1 for _, x in pending])
    begins = np.cumsum(sizes) - sizes
    apart = _never(len(pending))
    joined = np.concatenate([y for k, (_, x) in enumerate(pending) for y in (x, apart[k : k + 1])])
    runs = fragments(joined, 1, int(sizes.max()) // 2 + 1)
    owner = np.searchsorted(begins, runs[:, 1], "right") - 1
    runs[:, 1:] -= begins[owner][:, None]
    order = np.argsort(owner, kind="stable")
    edges = np.searchsorted(owner[order], np.arange(len(pending) + 1))
    for k, (row, _) in enumerate(pending):
        yield row, runs[order[edges[k] : edges[k + 1]]]


def _read(batches):
    """Results of short documents; for each longer one its text and its tiles."""
    task = TaskContext.get()
    key = (task.partitionId() if task else 0) << 33
    names = ["doc_id", *[x.split()[0] for x in RESULT.split(", ")], "key", "h", "text", "least", "beyond", "lo", "tile"]
    for batch in batches:
        doc_ids, h, text = batch.column("doc_id"), batch.column("h"), batch.column("text")
        results: list[tuple] = [None] * batch.num_rows
        pending, held = [], 0

        def settle():
            for row, runs in _solved(pending):
                results[row] = digest(_parts(text[row].as_py(), h[row].as_py()), runs)
            pending.clear()

        extra = []
        for row, hashes in _texts(batch):
            if len(hashes) <= BASE:
                pending.append((row, hashes))
                held += len(hashes) + 1
                if held > 1 << 16:
                    settle()
                    held = 0
                continue
            extra.append((row, key, None))
            _, numbers = np.unique(hashes, return_inverse=True)
            extra += [(row, key, (least, beyond, lo, pack(numbers[lo:hi].astype(np.uint32)))) for lo, hi, least, beyond in tiles(len(hashes))]
            key += 1
        if pending:
            settle()
        rows = [(row, *r, None, None, None, None, None, None, None) for row, r in enumerate(results) if r is not None]
        for row, k, tile in extra:
            whole = (h[row].as_py(), text[row].as_py()) if tile is None else (None, None)
            rows.append((row, *[None] * 7, k, *whole, *(tile or [None] * 4)))
        columns = list(zip(*rows)) or [[]] * 15
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()] + [pa.int64()] * 3 + [pa.binary()]
        yield pa.record_batch([doc_ids.take(pa.array(columns[0], pa.int64())), *[pa.array(x, k) for x, k in zip(columns[1:], kinds)]], names)


def _solve(batches):
    for batch in batches:
        for row in batch.to_pylist():
            runs = fragments(mix(unpack(row["tile"], np.uint32).astype(np.uint64)), row["least"], row["beyond"])
            period, start, end = (runs + np.array([0, row["lo"], row["lo"]])).T
            yield pa.record_batch([pa.array(np.full(len(runs), row["key"]), pa.int64()), pa.array(period, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["key", "period", "start", "end"])


def _finish(batches):
    for batch in batches:
        rows = []
        for text, h, runs in zip(*[batch.column(c).to_pylist() for c in ("text", "h", "runs")]):
            found = np.array([(r["period"], r["start"], r["end"]) for r in runs or []], np.int64).reshape(-1, 3)
            rows.append(digest(_parts(text, h), found))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.record_batch([batch.column("doc_id"), *[pa.array(x, k) for x, k in zip(zip(*rows), kinds)]], ["doc_id", *[x.split()[0] for x in RESULT.split(", ")]])


def stitched_runs(found: DataFrame) -> DataFrame:
    """key, period, start, end of runs from fragments, by windows over each document and period."""
    order = Window.partitionBy("key", "period").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start") > before - F.col("period")), 1).otherwise(0)
    return (
        found.withColumn("new", new)
        .withColumn("run", F.sum("new").over(order))
        .groupBy("key", "period", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("run")
    )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, number of runs, the longest run and digests of all runs and of the text without repetitions."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    read = written(docs.select("doc_id", "text", h.alias("h")).mapInArrow(_read, f"doc_id {kind}, {RESULT}, key long, h long, text string, least long, beyond long, lo long, tile binary"))
    short = read.filter("key is null").select("doc_id", *[x.split()[0] for x in RESULT.split(", ")])
    dealt = read.filter("tile is not null").select("key", "least", "beyond", "lo", "tile")
    dealt = dealt.repartition("key", "least", "lo")
    runs = stitched_runs(dealt.mapInArrow(_solve, "key long, period long, start long, end long"))
    lists = runs.groupBy("key").agg(F.collect_list(F.struct("period", "start", "end")).alias("runs"))
    long = read.filter("key is not null and tile is null").select("doc_id", "key", "h", "text").join(lists, "key", "left")
    return short.unionByName(long.select("doc_id", "h", "text", "runs").mapInArrow(_finish, f"doc_id {kind}, {RESULT}"))
