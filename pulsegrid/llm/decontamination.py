"""Benchmark decontamination over a positional inverted index of the training documents.

The index is partitioned by document and knows nothing of the benchmark: each block of documents has its own posting lists, for every
token, sorted, where it stands (word places within the block). It is written once as a table, a row for each block, and texts are
not read again.

A window is matched from its globally rarest term on. Windows are filed under this term; the terms of a block pick
those that can occur there. The term's list, shifted by its offset in the window, gives the candidate starts, and the lists of the other
terms, rarest first and shifted alike, are intersected with them. Windows are sent to the tasks in groups of at most ``GROUP_WORDS`` words of
benchmark text (an item is never parted), so what is broadcast has a bound; each group meets all blocks and tells of matches alone, and
the documents, listed once by the index, take in what the groups found by block and row.

A proximity match of an item means that its ``NEAR_TERMS`` rarest terms stand in one document within ``NEAR_SPAN`` words.

Null texts, on either side, have no words; an item without words has no window; equal items match alike, an item_id that
occurs twice counts once and a null item_id not at all, so that nothing is hit that cannot be named; of windows or terms that are equally
rare the order of their hashes decides where they are filed, not what they match; repeated documents are judged row by row; very long texts are blocks of their
own; empty tables give no match or no row; other columns are ignored. Words are told apart by 64-bit hashes, windows by
64-bit hashes of these.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import written
from pulsegrid.llm.textops import ALNUM, grams, pack, pack_steps, slices, unpack, unpack_steps, word_hashes, words

WINDOW = 10
GROUP_WORDS = 1_000_000
BLOCK_BYTES = 1 << 20
NEAR_TERMS = 3
NEAR_SPAN = 30


def item_words(benchmark: DataFrame) -> DataFrame:
    """item_id (text), n_words and hashed words of each item that has words."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("item_id"), []
            for s in slices(batch.column("text")):
                starts, _, bounds = words(s, ALNUM)
                h = word_hashes(s, starts, ALNUM).view(np.int64)
                texts += [h[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
            yield pa.record_batch([ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(texts, pa.list_(pa.int64()))], ["item_id", "n_words", "words"])

    found = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null")
    return found.mapInArrow(run, "item_id string, n_words long, words array<long>").filter("n_words > 0").distinct()


def groups(items: DataFrame) -> list[tuple[list[str], list[np.ndarray]]]:
    """The items in groups of bounded size, one at a time through the driver."""
    items = written(items)
    n = items.agg(F.sum("n_words")).first()[0] or 0
    parts = max(1, -(-n // GROUP_WORDS))
    for k in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).orderBy("item_id").collect()
        if rows:
            yield [r["item_id"] for r in rows], [np.array(r["words"], np.int64).view(np.uint64) for r in rows]


def _filed(lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers in order of their lead term, the distinct lead terms, and where each one's numbers begin."""
    order = np.argsort(lead, kind="stable")
    terms, heads = np.unique(lead[order], return_index=True)
    return order, terms, np.append(heads, len(order))


def _picked(filed, terms: np.ndarray) -> np.ndarray:
    """The numbers filed under any of ``terms``."""
    order, leads, heads = filed
    if not len(leads):
        return order
    at = np.minimum(np.searchsorted(leads, terms), len(leads) - 1)
    at = at[leads[at] == terms]
    sizes = heads[at + 1] - heads[at]
    step = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return order[np.repeat(heads[at] - step, sizes) + np.arange(sizes.sum())]


class Windows:
    """Distinct windows of a group of items, by length, with the items that each belongs to, and rare terms of items."""

    def __init__(self, ids: list[str], texts: list[np.ndarray]):
        self.ids, self.text = ids, np.concatenate(texts)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        sizes = np.minimum(np.diff(bounds), WINDOW)
        self.terms = np.unique(self.text)
        self.items = [np.unique(t) for t in texts]
        #: by length: where windows start in ``text``, their items, and where each window's items begin
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            counts = np.diff(bounds)[own] - n + 1
            step = np.concatenate([[0], np.cumsum(counts)[:-1]])
            start = np.repeat(bounds[own] - step, counts) + np.arange(counts.sum())
            key, item = grams(self.text, n)[start], np.repeat(own, counts)
            order = np.lexsort((item, key))
            key, item, start = key[order], item[order], start[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            fresh = new.copy()
            fresh[1:] |= item[1:] != item[:-1]
            self.by_length[n] = (start[new], item[fresh], np.append(np.flatnonzero(new[fresh]), fresh.sum()))

    def order(self, counts: dict[int, int]) -> None:
        """Fix each window's order of terms, and each item's rare terms, by the counts in the index."""
        number = np.array([counts.get(t, 0) for t in self.terms.view(np.int64).tolist()], np.int64)
        of = lambda x: number[np.searchsorted(self.terms, x)]
        self.orders, self.filed = {}, {}
        for n, (start, _, _) in self.by_length.items():
            w = self.text[start[:, None] + np.arange(n)]
            self.orders[n] = np.argsort(of(w), axis=1, kind="stable").astype(np.uint8)
            self.filed[n] = _filed(w[np.arange(len(w)), self.orders[n][:, 0]])
        self.rare = np.zeros((len(self.items), NEAR_TERMS), np.uint64)
        for i, terms in enumerate(self.items):
            rare = terms[np.lexsort((terms, of(terms)))][:NEAR_TERMS]
            self.rare[i] = np.resize(rare, NEAR_TERMS)  # items of fewer terms name one twice
        self.filed_items = _filed(self.rare[:, 0])


def _in(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)] == x


INDEX = "block long, docs array<long>, bounds array<long>, terms binary, sizes binary, places binary"


def index(docs: DataFrame) -> DataFrame:
    """The positional inverted index of all tokens: for each block its documents, terms and posting lists."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for s in slices(batch.column("text"), BLOCK_BYTES):
                starts, _, bounds = words(s, ALNUM)
                h = word_hashes(s, starts, ALNUM)
                order = np.argsort(h, kind="stable")
                terms, sizes = np.unique(h[order], return_counts=True)
                rows = ids.slice(s.first, len(bounds) - 1).to_pylist()
                yield pa.record_batch(
                    [
                        pa.array([number], pa.int64()),
                        pa.array([rows], pa.list_(pa.int64())),
                        pa.array([bounds], pa.list_(pa.int64())),
                        *(pa.array([x], pa.binary()) for x in (pack_steps(terms), pack(sizes.astype(np.uint32)), pack_steps(order.astype(np.uint32)))),
                    ],
                    ["block", "docs", "bounds", "terms", "sizes", "places"],
                )
                number += 1

    return docs.select("doc_id", "text").mapInArrow(run, INDEX)


def term_counts(blocks: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """How often each benchmark term of a group is posted in the index."""
    shared = blocks.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        wanted = shared.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, sizes in zip(batch.column("terms"), batch.column("sizes")):
                known, n = unpack_steps(terms.as_py(), np.uint64), unpack(sizes.as_py(), np.uint32)
                at = np.minimum(np.searchsorted(wanted, known), len(wanted) - 1)
                hit = wanted[at] == known
                total[at[hit]] += n[hit]
        yield pa.record_batch([pa.array(wanted[total > 0].view(np.int64)), pa.array(total[total > 0])], ["term", "n"])

    rows = blocks.select("terms", "sizes").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    table = rows.toArrow()  # at most the terms of one group
    return dict(zip(table["term"].to_pylist(), table["n"].to_pylist()))


class Block:
    """One block of the index."""

    def __init__(self, bounds, terms: bytes, sizes: bytes, places: bytes):
        self.bounds = np.asarray(bounds, np.int64)
        self.terms = unpack_steps(terms, np.uint64)
        sizes = unpack(sizes, np.uint32).astype(np.int64)
        self.heads = np.concatenate([[0], np.cumsum(sizes)])
        self.places = unpack_steps(places, np.uint32).astype(np.int64)
        # places of all lists in one sorted sequence, list by list
        self.width = int(self.bounds[-1]) + 1
        self.keys = np.repeat(np.arange(len(self.terms)), sizes) * self.width + self.places

    def phrases(self, group: Windows, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows of ``n`` words and the places where they start."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        some = _picked(group.filed[n], self.terms)
        if not len(some):
            return nothing
        windows = group.text[group.by_length[n][0][some][:, None] + np.arange(n)]
        orders = group.orders[n][some].astype(np.int64)
        term = np.minimum(np.searchsorted(self.terms, windows), len(self.terms) - 1)
        live = np.flatnonzero((self.terms[term] == windows).all(1))
        if not len(live):
            return nothing
        first = orders[live, 0]
        t = term[live, first]
        sizes = self.heads[t + 1] - self.heads[t]
        which = np.repeat(live, sizes)
        step = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        start = self.places[np.repeat(self.heads[t] - step, sizes) + np.arange(sizes.sum())] - np.repeat(first, sizes)
        for k in range(1, n):  # the other lists, rarest first
            offset = orders[which, k]
            ok = (start >= 0) & (start + offset < self.width - 1)
            which, start, offset = which[ok], start[ok], offset[ok]
            key = term[which, offset] * self.width + start + offset
            ok = _in(self.keys, key)
            which, start = which[ok], start[ok]
        row = np.searchsorted(self.bounds, start, "right")
        ok = (start >= 0) & (start + n <= self.bounds[np.minimum(row, len(self.bounds) - 1)])
        return some[which[ok]], start[ok]

    def near_items(self, group: Windows) -> np.ndarray:
        """Items whose rare terms all stand in the block."""
        some = _picked(group.filed_items, self.terms)
        if not len(some):
            return some
        rare = group.rare[some]
        return some[_in(self.terms, rare.reshape(-1)).reshape(rare.shape).all(1)]

    def near(self, rare: np.ndarray) -> list[int]:
        """Rows in which all these terms stand within NEAR_SPAN words."""
        at = np.searchsorted(self.terms, np.unique(rare))
        lists = [self.places[self.heads[t] : self.heads[t + 1]] for t in at]
        places = np.concatenate(lists)
        kind = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(places, kind="stable")
        places, kind = places[order], kind[order]
        row = np.searchsorted(self.bounds, places, "right") - 1
        latest = [np.maximum.accumulate(np.where(kind == k, np.arange(len(places)), -1)) for k in range(len(lists))]
        oldest = np.minimum.reduce(latest)
        ok = (oldest >= 0) & (places - places[oldest] < NEAR_SPAN) & (row == row[oldest])
        return np.unique(row[ok]).tolist()


MATCHES = "block long, row long, spans array<long>, items array<string>, near array<string>"


def matches(blocks: DataFrame, windows: Windows) -> DataFrame:
    """For each document with a match its words in matched windows (pairs of first and end), the items, and items near by."""
    shared = blocks.sparkSession.sparkContext.broadcast(windows)

    def run(batches):
        group = shared.value
        ids = group.ids
        for batch in batches:
            for block, bounds, *lists in zip(*(batch.column(c) for c in ("block", "bounds", "terms", "sizes", "places"))):
                index = Block(np.asarray(bounds.values), *(x.as_py() for x in lists))
                hit = np.zeros(index.width + 1, np.int64)
                n_docs = len(index.bounds) - 1
                items: list[set[int]] = [set() for _ in range(n_docs)]
                near: list[list[str]] = [[] for _ in range(n_docs)]
                for n, (_, owners, heads) in group.by_length.items():
                    which, start = index.phrases(group, n)
                    np.add.at(hit, start, 1)
                    np.add.at(hit, start + n, -1)
                    row = np.searchsorted(index.bounds, start, "right") - 1
                    for r, w in set(zip(row.tolist(), which.tolist())):
                        items[r].update(owners[heads[w] : heads[w + 1]].tolist())
                for i in index.near_items(group).tolist():
                    for r in index.near(group.rare[i]):
                        near[r].append(ids[i])
                edge = np.diff(np.concatenate([[0], (np.cumsum(hit[: index.width - 1]) > 0).astype(np.int8), [0]]))
                first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                spans: list[list[int]] = [[] for _ in range(n_docs)]
                for a, b in zip(first.tolist(), end.tolist()):
                    r = int(np.searchsorted(index.bounds, a, "right")) - 1
                    while a < b:  # a run may go on in the next row
                        stop = min(b, int(index.bounds[r + 1]))
                        if stop > a:
                            spans[r] += [a - int(index.bounds[r]), stop - int(index.bounds[r])]
                        a, r = max(a, stop), r + 1
                told = [r for r in range(n_docs) if spans[r] or near[r]]
                yield pa.record_batch(
                    [
                        pa.array([block.as_py()] * len(told), pa.int64()),
                        pa.array(told, pa.int64()),
                        pa.array([spans[r] for r in told], pa.list_(pa.int64())),
                        pa.array([sorted({ids[i] for i in items[r]}) for r in told], pa.list_(pa.string())),
                        pa.array([sorted(set(near[r])) for r in told], pa.list_(pa.string())),
                    ],
                    ["block", "row", "spans", "items", "near"],
                )

    return blocks.drop("docs").mapInArrow(run, MATCHES)


def listed(blocks: DataFrame) -> DataFrame:
    """(block, row, doc_id, n_words) of each document of the index."""
    rows = F.transform("docs", lambda d, i: F.struct(d.alias("doc_id"), (F.element_at("bounds", i + 2) - F.element_at("bounds", i + 1)).alias("n_words")))
    return blocks.select("block", F.posexplode(rows).alias("row", "d")).select("block", F.col("row").cast("long").alias("row"), "d.doc_id", "d.n_words")


def decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts of matched words and items for each document."""
    blocks: DataFrame | None = None
    found: DataFrame | None = None
    parts = 0
    for ids, texts in groups(item_words(benchmark)):
        if blocks is None:
            blocks = written(index(docs))
        windows = Windows(ids, texts)
        windows.order(term_counts(blocks, windows.terms))
        own = matches(blocks, windows)
        found = own if found is None else found.unionByName(own)
        parts += 1
    if found is None:
        return _digest(_counted(docs))
    # written, so that no task holds two Python workers
    found = written(found)
    if parts > 1:
        found = found.groupBy("block", "row").agg(
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"),
        )
    return _digest(listed(blocks).join(found, ["block", "row"], "left"))


def _counted(docs: DataFrame) -> DataFrame:
    """Rows without any match, for an empty benchmark."""

    def run(batches):
        for batch in batches:
            n = [x for s in slices(batch.column("text")) for x in np.diff(words(s, ALNUM)[2]).tolist()]
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_words"])

    none = {"spans": "array<long>", "items": "array<string>", "near": "array<string>"}
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long").select("*", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))


def _digest(found: DataFrame) -> DataFrame:
    """What documents show, from their matches; null where there are none."""
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long, hit_spans array<long>"

    def run(batches):
        for batch in batches:
            hits, spans_out = [], []
            for spans in batch.column("spans").to_pylist():
                spans = spans or []
                total, last, union = 0, 0, []
                for a, b in sorted(zip(spans[::2], spans[1::2])):
                    a = max(a, last)
                    if b > a:
                        total += b - a
                        last = b
                        union += [a, b]
                hits.append(total)
                spans_out.append(union)
            items, near = ([x or [] for x in batch.column(c).to_pylist()] for c in ("items", "near"))
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("n_words"),
                    pa.array(hits, pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                    pa.array([h > 0 for h in hits], pa.bool_()),
                    pa.array([len(x) for x in near], pa.int64()),
                    pa.array(spans_out, pa.list_(pa.int64())),
                ],
                schema.replace(",", "").split()[::2],
            )

    return found.select("doc_id", "n_words", "spans", "items", "near").mapInArrow(run, schema)
