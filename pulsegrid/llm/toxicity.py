"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, trained in numpy.

A text becomes words; windows of ``WINDOW`` words begin every ``STRIDE`` words, so that any ``WINDOW - STRIDE`` consecutive words stand in one
window whole. A word enters by two embeddings: its own, and the largest over those of its 4-grams of bytes, marked at both ends, so
that an unseen form of a known stem is recognised. Two gated recurrent layers read a window in both directions; attention weights its places, and their
weighted sum gives the window's logit. A text's score is that of its highest window: all windows of all texts are scored.

Training uses a bounded sample of labelled documents, ``POSITIVES`` and ``NEGATIVES`` of at most ``TRAIN_CHARS`` characters, those with the least hashes of doc_id. Only
texts are labelled, not windows: each round trains on the window of each text that the network rates highest (first, that with the most telling
word or 4-gram by document frequency). Words' own embeddings are dropped at random, so that the characters have to tell too.

Null, empty and wordless texts are one empty window, whose logit is the bias. A null doc_id is not held out; repeated rows are scored one by one; several
labels of one doc_id count as toxic if one is; a row is judged by its text alone, so ties do not arise. Without
labelled texts of both kinds every score is the share of toxic ones among them, 0 if there are none. Very long texts are scored slice by slice of windows.
Extra columns are ignored, an empty table gives no row.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.textops import ALNUM, Slice, mix, slices, word_hashes, words

WINDOW, STRIDE = 64, 48
THRESHOLD = 0.7
POSITIVES, NEGATIVES, TRAIN_CHARS = 1500, 2500, 8_000
WORD_BUCKETS, GRAM_BUCKETS = 1 << 14, 1 << 15
EMBEDDING, HIDDEN = 8, 8
ROUNDS, PASSES, BATCH, RATE, DROPPED = 4, 3, 128, 0.01, 0.3
#: Windows that one pass of the network holds.
CHUNK = 2048
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] = _LOWER[0x61:0x7B]


class Words(NamedTuple):
    """Distinct words: their buckets, the buckets of their 4-grams, and where each word's 4-grams begin."""

    bucket: np.ndarray
    grams: np.ndarray
    begins: np.ndarray


def read_words(s: Slice) -> tuple[Words, np.ndarray, np.ndarray]:
    """Distinct words of a slice, which of them stands at each place, and where each row's words begin."""
    starts, ends, bounds = words(s, ALNUM)
    hashes = word_hashes(s, starts, ALNUM)
    distinct, first, places = np.unique(hashes, return_index=True, return_inverse=True)
    a, size = starts[first], (ends - starts)[first]
    # ^word$, at least four bytes each
    room = np.maximum(size + 2, 4)
    begins = np.cumsum(room) - room
    total = int(room.sum())
    text = np.zeros(total + 3, np.uint8)
    text[begins] = 0x5E
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(begins + 1, size) + at] = _LOWER[s.data[np.repeat(a, size) + at]]
    text[begins + size + 1] = 0x24
    four = text[:total].astype(np.uint32) | text[1 : total + 1].astype(np.uint32) << 8 | text[2 : total + 2].astype(np.uint32) << 16 | text[3 : total + 3].astype(np.uint32) << 24
    inside = np.ones(total, bool)
    for k in (1, 2, 3):
        inside[begins + room - k] = False
    grams = (mix(four[inside].astype(np.uint64)) & np.uint64(GRAM_BUCKETS - 1)).astype(np.int64)
    counts = room - 3
    return Words((distinct & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), grams, np.cumsum(counts) - counts), places, bounds


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and row of each window; a row without words has one empty window."""
    sizes = np.diff(bounds)
    count = np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE))
    row = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return bounds[:-1][row] + STRIDE * number, np.minimum(WINDOW, sizes[row] - STRIDE * number), row


def _places(places: np.ndarray, first: np.ndarray, size: np.ndarray, steps: int) -> np.ndarray:
    """Words of windows for each step, in both directions (2, steps, windows); what lies beyond a window is never used."""
    step = np.arange(steps)[:, None]
    most = max(0, len(places) - 1)
    both = np.stack([np.minimum(first + step, most), np.clip(first + size - 1 - step, 0, most)])
    return places[both] if len(places) else np.zeros(both.shape, np.int64)


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Weights by name; both directions stand along the first axis."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        e, h = EMBEDDING, HIDDEN
        draw = lambda size, *shape: (rng.normal(size=shape) * size).astype(np.float32)
        self.p = {
            "word": draw(0.05, WORD_BUCKETS, e),
            "gram": draw(0.05, GRAM_BUCKETS, e),
            "input": draw((2 * e) ** -0.5, 2 * e, 6 * h),
            "bias": np.zeros(6 * h, np.float32),
            "state": draw(h**-0.5, 2, h, 3 * h),
            "pool": draw(h**-0.5, 2, h, 2),
            "out": np.zeros(1, np.float32),
        }

    def vectors(self, w: Words) -> np.ndarray:
        gram = np.maximum.reduceat(self.p["gram"][w.grams], w.begins, axis=0) if len(w.begins) else np.zeros((0, EMBEDDING), np.float32)
        return np.concatenate([self.p["word"][w.bucket], gram], axis=1)

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        """What each word gives to the gates, (2, words, gates); a last row stands for no word."""
        flat = vectors @ self.p["input"] + self.p["bias"]
        flat = np.concatenate([flat, self.p["bias"][None]])
        return np.ascontiguousarray(flat.reshape(len(flat), 2, 3 * HIDDEN).transpose(1, 0, 2))

    def logits(self, projected: np.ndarray, places: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A logit for each window."""
        out = np.empty(len(first), np.float32)
        for a in range(0, len(first), CHUNK):
            part = slice(a, a + CHUNK)
            out[part] = self._logits(projected, places, first[part], size[part])
        return out

    def _logits(self, projected, places, first, size):
        h2, order = 2 * HIDDEN, np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        steps = int(size[0])
        attention, gain = np.full((len(size), max(1, steps)), -np.inf, np.float32), np.zeros((len(size), max(1, steps)), np.float32)
        index = _places(places, first, size, steps)
        active = np.searchsorted(-size, -np.arange(steps), "left")  # windows longer than a step come first
        state = np.zeros((2, len(size), HIDDEN), np.float32)
        rows = np.arange(len(size))
        told = np.zeros((2, steps, len(size), 2), np.float32)
        for t in range(steps):
            n = active[t]
            x = np.stack([projected[0][index[0, t, :n]], projected[1][index[1, t, :n]]])
            h = state[:, :n]
            own = h @ self.p["state"]
            gates = np.tanh((x[..., :h2] + own[..., :h2]) * np.float32(0.5))
            reset = gates[..., HIDDEN:] * np.float32(0.5) + np.float32(0.5)
            new = np.tanh(x[..., h2:] + reset * own[..., h2:])
            keep = gates[..., :HIDDEN] * np.float32(0.5) + np.float32(0.5)
            h = new + keep * (h - new)
            state[:, :n] = h
            told[:, t, :n] = h @ self.p["pool"]
        for t in range(steps):
            n = active[t]
            back = size[:n] - 1 - t
            both = told[0, t, :n] + told[1, back, rows[:n]]
            attention[:n, t], gain[:n, t] = both[:, 0], both[:, 1]
        attention[size == 0] = 0
        weight = np.exp(attention - attention.max(axis=1, keepdims=True))
        out = np.empty(len(size), np.float32)
        out[order] = (weight * gain).sum(axis=1) / weight.sum(axis=1) + self.p["out"][0]
        return out

    def text_logits(self, s: Slice) -> np.ndarray:
        """The highest logit of each row's windows."""
        w, places, bounds = read_words(s)
        first, size, row = windows(bounds)
        found = self.logits(self.projected(self.vectors(w)), places, first, size)
        return np.maximum.reduceat(found, np.searchsorted(row, np.arange(len(bounds) - 1)))

    def gradients(self, w: Words, places, first, size, label, rng) -> dict:
        """Gradients of the mean log loss over windows; words' own embeddings are dropped at random."""
        p, h1, h2 = self.p, HIDDEN, 2 * HIDDEN
        steps, n = max(1, int(size.max())), len(size)
        gram_rows = p["gram"][w.grams]
        gram = np.maximum.reduceat(gram_rows, w.begins, axis=0)
        held = (rng.random(len(w.bucket)) >= DROPPED).astype(np.float32)[:, None]
        vectors = np.concatenate([p["word"][w.bucket] * held, gram], axis=1)
        projected = self.projected(vectors)
        index = _places(places, first, size, steps)
        x = np.stack([projected[0][index[0]], projected[1][index[1]]], axis=1)  # steps first
        kept = []
        state = np.zeros((2, n, h1), np.float32)
        told = np.zeros((2, steps, n, 2), np.float32)
        for t in range(steps):
            own = state @ p["state"]
            gates = _sigmoid(x[t][..., :h2] + own[..., :h2])
            keep, reset = gates[..., :h1], gates[..., h1:]
            new = np.tanh(x[t][..., h2:] + reset * own[..., h2:])
            kept.append((state, keep, reset, new, own[..., h2:]))
            state = new + keep * (state - new)
            told[:, t] = state @ p["pool"]
        step = np.arange(steps)[:, None]
        inside = step < size
        back = np.clip(size - 1 - step, 0, steps - 1)
        both = told[0] + np.take_along_axis(told[1], back[..., None], axis=0)
        attention = np.where(inside, both[..., 0], -np.inf)
        attention[:, size == 0] = 0
        weight = np.exp(attention - attention.max(axis=0))
        weight /= weight.sum(axis=0)
        gain = np.where(inside, both[..., 1], 0)
        total = (weight * gain).sum(axis=0)
        slope = ((_sigmoid(total + p["out"][0]) - label) / n).astype(np.float32)
        dtold = np.stack([weight * (gain - total) * slope, weight * slope], axis=-1) * inside[..., None]
        dtold = np.stack([dtold, np.take_along_axis(dtold, back[..., None], axis=0) * inside[..., None]]).astype(np.float32)
        g = {"out": np.array([slope.sum()], np.float32), "state": np.zeros_like(p["state"]), "pool": np.zeros_like(p["pool"])}
        dx = np.zeros_like(x)
        dh = np.zeros((2, n, h1), np.float32)
        turned, pool = p["state"].transpose(0, 2, 1), p["pool"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            before, keep, reset, new, own = kept[t]
            now = new + keep * (before - new)
            g["pool"] += now.transpose(0, 2, 1) @ dtold[:, t]
            dh = dh + dtold[:, t] @ pool
            dnew = dh * (1 - keep) * (1 - new * new)
            dgates = np.concatenate([dh * (before - new) * keep * (1 - keep), dnew * own * reset * (1 - reset)], axis=-1)
            dx[t] = np.concatenate([dgates, dnew], axis=-1)
            down = np.concatenate([dgates, dnew * reset], axis=-1)
            g["state"] += before.transpose(0, 2, 1) @ down
            dh = dh * keep + down @ turned
        dprojected = np.zeros((len(w.bucket) + 1, 2, 3 * h1), np.float32)
        for way in (0, 1):
            flat, rows = index[way].reshape(-1), dx[:, way].reshape(-1, 3 * h1)
            order = np.argsort(flat, kind="stable")
            at = np.flatnonzero(np.diff(flat[order], prepend=-1))
            dprojected[flat[order][at], way] = np.add.reduceat(rows[order], at, axis=0)
        flat = dprojected.reshape(len(dprojected), -1)
        g["bias"], flat = flat.sum(axis=0), flat[:-1]
        g["input"] = vectors.T @ flat
        dvectors = flat @ p["input"].T
        g["word"] = _scattered(w.bucket, dvectors[:, :EMBEDDING] * held, WORD_BUCKETS)
        owner = np.repeat(np.arange(len(w.begins)), np.diff(w.begins, append=len(w.grams)))
        largest = (gram_rows == gram[owner]).astype(np.float32)  # a 4-gram that a word has twice shares
        largest /= np.add.reduceat(largest, w.begins, axis=0)[owner]
        g["gram"] = _scattered(w.grams, largest * dvectors[owner, EMBEDDING:], GRAM_BUCKETS)
        return g


def _scattered(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(at, rows[:, k], size) for k in range(rows.shape[1])], axis=1).astype(np.float32)


def _of_windows(w: Words, places: np.ndarray, first: np.ndarray, size: np.ndarray):
    """The distinct words of some windows and their places among these."""
    length = np.maximum(size, 0)
    begin = np.cumsum(length) - length
    spots = np.repeat(first - begin, length) + np.arange(int(length.sum()))
    used, again = np.unique(places[spots], return_inverse=True)
    if not len(used):  # a word to stand for none
        used, again = np.zeros(1, np.int64), np.zeros(1, np.int64)
    counts = np.diff(w.begins, append=len(w.grams))[used]
    begins = np.cumsum(counts) - counts
    grams = w.grams[np.repeat(w.begins[used] - begins, counts) + np.arange(int(counts.sum()))]
    return Words(w.bucket[used], grams, begins), again, begin


class Sample:
    """Texts to train on, slice by slice, so that no array holds the words of all of them at length."""

    def __init__(self, texts: list[str], label: np.ndarray):
        self.label, self.parts = np.asarray(label, np.float32), []
        for s in slices(pa.array(texts, pa.large_string())):
            w, places, bounds = read_words(s)
            w = Words(*[x.astype(np.int32) for x in w])
            first, size, row = windows(bounds)
            self.parts.append((w, places.astype(np.int32), bounds, first, size, row + s.first))

    def odds(self) -> tuple[np.ndarray, np.ndarray]:
        """For buckets of words and of 4-grams: logarithm of how much more often toxic texts have them than others."""
        counts = [np.zeros((2, size)) for size in (WORD_BUCKETS, GRAM_BUCKETS)]
        for w, places, bounds, _, _, row in self.parts:
            texts = self.label[row[0] : row[-1] + 1].astype(int)
            text = np.repeat(np.arange(len(texts)), np.diff(bounds))
            own = np.unique(text * max(1, len(w.bucket)) + places)
            text, word = own // max(1, len(w.bucket)), own % max(1, len(w.bucket))
            each = np.diff(w.begins, append=len(w.grams))[word]
            spots = np.repeat(w.begins[word] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            for total, owner, bucket in ((counts[0], text, w.bucket[word]), (counts[1], np.repeat(text, each), w.grams[spots])):
                pairs = np.unique(owner * total.shape[1] + bucket)
                np.add.at(total, (texts[pairs // total.shape[1]], pairs % total.shape[1]), 1)
        toxic = self.label.sum()
        return tuple(np.log((c[1] + 1) / (toxic + 2)) - np.log((c[0] + 1) / (len(self.label) - toxic + 2)) for c in counts)

    def chosen(self, rate) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The window of each text that ``rate(words, places, first, size)`` puts highest: words, places, first places, sizes and texts."""
        found, n_words, n_grams, n_places = [], 0, 0, 0
        for w, places, _, first, size, row in self.parts:
            rated = rate(w, places, first, size)
            order = np.lexsort((-rated, row))
            best = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
            own, at, begin = _of_windows(w, places, first[best], size[best])
            found.append((own.bucket, own.grams, own.begins + n_grams, at + n_words, begin + n_places, size[best], row[best]))
            n_words, n_grams, n_places = n_words + len(own.bucket), n_grams + len(own.grams), n_places + len(at)
        bucket, grams, begins, at, begin, size, row = [np.concatenate(x) for x in zip(*found)]
        return Words(bucket, grams, begins), at, begin, size, row


def _of_windows(w: Words, places: np.ndarray, first: np.ndarray, size: np.ndarray):
    """The distinct words of some windows, where each window's stand among these, and where each window begins."""
    begin = np.cumsum(size) - size
    spots = np.repeat(first - begin, size) + np.arange(int(size.sum()))
    used, again = np.unique(places[spots], return_inverse=True)
    if not len(used):  # empty windows only: a word that no place holds
        return Words(np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(1, np.int32)), np.zeros(1, np.int64), begin
    counts = np.diff(w.begins, append=len(w.grams))[used]
    begins = np.cumsum(counts) - counts
    grams = w.grams[np.repeat(w.begins[used] - begins, counts) + np.arange(int(counts.sum()))]
    return Words(w.bucket[used], grams, begins), again, begin


def trained(texts: list[str], label: np.ndarray, seed: int = 0) -> Network:
    """A network fitted to texts and their labels (0 or 1)."""
    rng, net, sample = np.random.default_rng(seed), Network(seed), Sample(texts, label)
    by_word, by_gram = sample.odds()
    # the first number of each embedding begins with these
    net.p["word"][:, 0], net.p["gram"][:, 0] = by_word / 2, by_gram / 2

    def telling(w, places, first, size):
        if not len(w.bucket):
            return np.zeros(len(first))
        most = np.maximum(by_word[w.bucket], np.maximum.reduceat(by_gram[w.grams], w.begins))
        return np.array([most[places[a : a + n]].max(initial=-np.inf) for a, n in zip(first.tolist(), size.tolist())])

    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for turn in range(ROUNDS):
        rate = (lambda w, places, first, size: net.logits(net.projected(net.vectors(w)), places, first, size)) if turn else telling
        w, places, first, size, row = sample.chosen(rate)
        for _ in range(PASSES):
            order = rng.permutation(len(row))
            for a in range(0, len(order), BATCH):
                some = order[a : a + BATCH]
                own, at, begin = _of_windows(w, places, first[some], size[some])
                step += 1
                for k, g in net.gradients(own, at, begin, size[some], sample.label[row[some]], rng).items():
                    m, v = moments[k]
                    m += np.float32(0.1) * (g - m)
                    v += np.float32(0.01) * (g * g - v)
                    rate_now = RATE * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
                    net.p[k] -= np.float32(rate_now) * m / (np.sqrt(v) + np.float32(1e-7))
    return net


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of the bounded sample, and the share of toxic ones among the labelled rows that may be learned from."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    share = known.agg(F.avg("label").alias("s")).first()["s"]
    text = docs.select("doc_id", "text").filter(F.length("text") <= TRAIN_CHARS)
    rows = []
    for kind, most in ((1, POSITIVES), (0, NEGATIVES)):
        chosen = known.filter(F.col("label") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        # at most that many ids and, a text for each id, at most as many texts
        rows += text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], np.array([r["label"] for r in rows], np.float32), float(share or 0.0)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts, label, share = training_sample(docs, labels)
    net = trained(texts, label) if 0 < label.sum() < len(label) else None
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some 1.6 MB, whatever the input

    def run(batches):
        net = shared.value
        for batch in batches:
            scores = []
            for s in slices(batch.column("text"), 1 << 19):
                n = len(s.offsets) - 1
                scores.append(np.full(n, share) if net is None else 1 / (1 + np.exp(-net.text_logits(s).astype(float))))
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", _held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
