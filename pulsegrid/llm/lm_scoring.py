"""LM scoring: an interpolated model of word pairs in Elias-Fano tries, and exact unigram statistics of the whole corpus.

Texts become blocks: for each slice of documents the sorted hashes of its distinct words and the text as places in
that list, both compressed; the block table is written once. Each block sends its words with their training counts,
and the successors of each word with theirs, to shards by the word's hash. A shard adds up what all blocks sent, builds its
part of the trie and answers each block from it, so no vocabulary or model stands in any one place, and no block sends a word or a pair twice.
A word whose successors would crowd its shard is dealt over several by its successors' hashes; the number of such words is
bounded by the number of shards.

The trie holds all words and pairs counted, so the model grows with the input and nothing is cut. It is one memory-mapped buffer: words, and
monotone pointers to the successors of each; the successors, made monotone by their context's rank, all three as Elias-Fano
sequences; and for each pair its smoothed probability in ``CODE`` steps of a logarithmic scale, never rounded upwards. A query stays within these
forms: the context's rank by successor search, its range by two pointers, the pair by successor search inside this range.

A pair's probability is absolute-discounted by ``DISCOUNT``; what the discount takes goes to the unigram level, so that probabilities
add up to one but for the rounding. Scores depend on counts alone, not on how texts are dealt over blocks and shards.

Null text counts as empty: one token, its end. The end of a text is also the context of a first word. A null doc_id is learned
from and not held out; repeated rows are counted and scored one by one; very long texts are blocks of their own; ties do not arise; an
empty table gives an empty result; other columns are ignored. Words are told apart by 64-bit hashes, successors of one word by ``CHILD_BITS`` bits of these.
"""

from __future__ import annotations

import mmap

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import written
from pulsegrid.llm.textops import SPACED, pack, pack_steps, slices, unpack, unpack_steps, word_hashes, words

FOLDS = 10
ALPHA = 0.1
DISCOUNT = 0.75
SHARD_WORDS = 400_000
BLOCK_BYTES = 4 << 20
CHILD_BITS = 42
#: A block reports how many successors a word has from so many on.
REPORTED = 64
#: Stands for the end of a text among word hashes.
END = np.uint64(0x0E4D0F7E87000001)
#: Steps of the probability scale down to its floor; the last code says that a pair is unknown.
CODE, FLOOR = 65_534, 1e-13
_SPREAD = 40503  # an odd step from one part of a word to the next


BLOCKS = "block long, docs array<long>, held array<boolean>, sizes array<long>, n_words long, wide array<struct<word:long,n:long>>, vocab binary, places binary"


def blocks(docs: DataFrame) -> DataFrame:
    """One row for each slice of documents."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, held = batch.column("doc_id").cast(pa.int64()), batch.column("held_out")
            for s in slices(batch.column("text"), BLOCK_BYTES):
                starts, _, bounds = words(s, SPACED)
                h = np.insert(word_hashes(s, starts, SPACED), bounds[1:], END)
                vocab, places = np.unique(h, return_inverse=True)
                sizes = np.diff(bounds) + 1
                context, *_ = _successors(vocab, places)
                kinds = np.bincount(context, minlength=len(vocab))
                wide = np.flatnonzero(kinds >= REPORTED)
                one = lambda x, kind: pa.array([x], kind)
                yield pa.record_batch(
                    [
                        one(number, pa.int64()),
                        one(ids.slice(s.first, len(sizes)).to_pylist(), pa.list_(pa.int64())),
                        one(held.slice(s.first, len(sizes)).to_pylist(), pa.list_(pa.bool_())),
                        one(sizes.tolist(), pa.list_(pa.int64())),
                        one(len(vocab), pa.int64()),
                        one([{"word": w, "n": n} for w, n in zip(vocab[wide].view(np.int64).tolist(), kinds[wide].tolist())], pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))),
                        one(pack_steps(vocab), pa.binary()),
                        one(pack(places.astype(np.uint32)), pa.binary()),
                    ],
                    ["block", "docs", "held", "sizes", "n_words", "wide", "vocab", "places"],
                )
                number += 1

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, BLOCKS)


def _training(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all tokens, which of them are training tokens, and which begin a text."""
    places = unpack(row["places"], np.uint32).astype(np.int64)
    sizes = np.array(row["sizes"], np.int64)
    learned = np.repeat(~np.array(row["held"], bool), sizes)
    begins = np.zeros(len(places), bool)
    begins[np.cumsum(sizes) - sizes] = True
    return places, learned, begins


def _successors(vocab: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order of context and successor: the context's place and the successor's bits; and for each token its pair and context.

    The text before ends where a text begins, so the end is the context of each first word.
    """
    before = np.empty_like(places)
    before[1:] = places[:-1]
    before[:1] = places[-1:]
    child, rank = np.unique((vocab >> np.uint64(64 - CHILD_BITS)).astype(np.int64), return_inverse=True)
    keys, back = np.unique(before * len(child) + rank[places], return_inverse=True)
    return keys // len(child), child[keys % len(child)], back, before


class Dealing:
    """Which shards hold a word: the one of its first bits, and others for the successors of crowded words."""

    def __init__(self, shards: int, crowded: dict[int, int]):
        self.shards = shards
        names = np.array(list(crowded), np.int64).view(np.uint64)
        order = np.argsort(names)
        self.names, self.parts = names[order], np.array(list(crowded.values()), np.int64)[order]

    def home(self, vocab: np.ndarray) -> np.ndarray:
        bits = self.shards.bit_length() - 1
        return (vocab >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(vocab), np.int64)

    def asks(self, vocab: np.ndarray, context: np.ndarray, child: np.ndarray):
        """For words: shards and places in the vocabulary, in order of shards; for pairs: their order by shard, and pairs of each word there."""
        home, parts = self.home(vocab), np.ones(len(vocab), np.int64)
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, vocab), len(self.names) - 1)
            parts = np.where(self.names[at] == vocab, self.parts[at], 1)
        place = lambda word, part: (home[word] + part * _SPREAD) & self.shards - 1
        shard = place(context, child & parts[context] - 1)
        order = np.argsort(shard, kind="stable")
        n = len(vocab)
        # every part of a word counts all of its tokens
        several = np.repeat(np.arange(n), parts)
        number = np.arange(len(several)) - np.repeat(np.cumsum(parts) - parts, parts)
        found = np.unique(np.concatenate([shard * n + context, place(several, number) * n + several]))
        sizes = np.bincount(np.searchsorted(found, shard * n + context), minlength=len(found))
        return found // n, found % n, order, sizes, home


ANSWERS = "block long, shard long, counts binary, kinds binary, pairs binary, n long, distinct long"


def answers_of(table: DataFrame, dealing: Dealing) -> DataFrame:
    """For each block and shard: counts of the block's words and of their successors, and codes of its pairs; and each shard's totals."""
    shared = table.sparkSession.sparkContext.broadcast(dealing)

    def ask(batches):
        dealing = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                vocab = unpack_steps(row["vocab"], np.uint64)
                places, learned, _ = _training(row)
                counts = np.bincount(places[learned], minlength=len(vocab)).astype(np.uint32)
                context, child, back, _ = _successors(vocab, places)
                pairs = np.bincount(back[learned], minlength=len(context)).astype(np.uint32)
                shard, word, order, sizes, home = dealing.asks(vocab, context, child)
                heads = np.concatenate([[0], np.cumsum(sizes)])
                edges = np.searchsorted(shard, np.arange(dealing.shards + 1))
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    part = slice(edges[k], edges[k + 1])
                    own, w = order[heads[edges[k]] : heads[edges[k + 1]]], word[part]
                    packed = [pack_steps(vocab[w]), pack(counts[w]), pack((home[w] == k).astype(np.uint8)), pack(sizes[part].astype(np.uint32)), pack(child[own]), pack(pairs[own])]
                    yield pa.record_batch(
                        [pa.array([k], pa.int64()), pa.array([row["block"]], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)],
                        ["shard", "block", "words", "counts", "home", "sizes", "children", "pairs"],
                    )

    def answer(group: pa.Table) -> pa.Table:
        column = lambda name, f, kind: [f(x.as_py(), kind) for x in group.column(name)]
        asked = column("words", unpack_steps, np.uint64)
        known, first, back = np.unique(np.concatenate(asked), return_index=True, return_inverse=True)
        total = np.bincount(back, np.concatenate(column("counts", unpack, np.uint32)).astype(float)).astype(np.uint64)
        own = total[np.concatenate(column("home", unpack, np.uint8))[first] > 0]
        context = np.repeat(back, np.concatenate(column("sizes", unpack, np.uint32)))
        children = column("children", unpack, np.int64)
        child, sent = np.concatenate(children), np.concatenate(column("pairs", unpack, np.uint32))
        trie = Trie.of(known, total, context[sent > 0], child[sent > 0], sent[sent > 0])
        kinds = trie.kinds()
        codes = trie.codes(np.concatenate(asked).repeat(np.concatenate(column("sizes", unpack, np.uint32))), child)
        ends, pair_ends = np.cumsum([len(a) for a in asked]), np.cumsum([len(c) for c in children])
        n = len(asked)
        return pa.table(
            {
                "block": pa.array(group.column("block").to_pylist() + [None], pa.int64()),
                "shard": pa.array([group.column("shard")[0].as_py()] * (n + 1), pa.int64()),
                "counts": pa.array([pack(total[back[e - len(a) : e]]) for e, a in zip(ends, asked)] + [None], pa.binary()),
                "kinds": pa.array([pack(kinds[back[e - len(a) : e]]) for e, a in zip(ends, asked)] + [None], pa.binary()),
                "pairs": pa.array([pack(codes[e - len(c) : e]) for e, c in zip(pair_ends, children)] + [None], pa.binary()),
                "n": pa.array([None] * n + [int(own.sum())], pa.int64()),
                "distinct": pa.array([None] * n + [int((own > 0).sum())], pa.int64()),
            }
        )

    asks = "shard long, block long, words binary, counts binary, home binary, sizes binary, children binary, pairs binary"
    return table.select("block", "held", "sizes", "vocab", "places").mapInArrow(ask, asks).groupBy("shard").applyInArrow(answer, ANSWERS)


_STEP = 8  # words of a bit vector for each entry of its directory


class Bits:
    """A bit vector of 64-bit words with a directory of how many ones stand before each ``_STEP`` words."""

    def __init__(self, words: np.ndarray, ones: np.ndarray):
        self.words, self.ones = words, ones

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-size // (64 * _STEP)) * 64 * _STEP + 64 * _STEP, bool)
        flags[places] = True
        words = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words).reshape(-1, _STEP).sum(1, dtype=np.int64))])
        return cls(words, ones)

    def select(self, number: np.ndarray, bit: int) -> np.ndarray:
        """The place of the ones (or zeros) of these numbers, counted from 0."""
        before = self.ones if bit else np.arange(len(self.ones)) * 64 * _STEP - self.ones
        step = np.searchsorted(before, number, "right") - 1
        left = number - before[step]
        block = self.words[step[:, None] * _STEP + np.arange(_STEP)]
        if not bit:
            block = ~block
        sums = np.cumsum(np.bitwise_count(block), axis=1, dtype=np.int64)
        at = (sums <= left[:, None]).sum(1)
        rows = np.arange(len(number))
        left = left - np.where(at > 0, sums[rows, np.maximum(at - 1, 0)], 0)
        word, place = block[rows, at], (step * _STEP + at) * 64
        for half in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= count
            left = left - np.where(up, count, 0)
            word = np.where(up, word >> np.uint64(half), word)
            place = place + np.where(up, half, 0)
        return place


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary; read and searched in this form."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: Bits):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.int64)
        n = len(values)
        low_bits = max(0, int(np.log2(max(1, (int(values[-1]) + 1) / n)))) if n else 0
        packed = []
        for a in range(0, n if low_bits else 0, 1 << 16):  # in parts that fill whole bytes
            part = values[a : a + (1 << 16)]
            packed.append(np.packbits((part[:, None] >> np.arange(low_bits) & 1).astype(bool).reshape(-1), bitorder="little"))
        raw = np.concatenate([*packed, np.zeros(16, np.uint8)])
        low = np.concatenate([raw, np.zeros(-len(raw) % 8, np.uint8)]).view(np.uint64)
        return cls(n, low_bits, low, Bits.of((values >> low_bits) + np.arange(n), n + (int(values[-1]) >> low_bits if n else 0) + 1))

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        above = np.where(shift > 0, self.low[word + 1] << (np.uint64(63) - shift + np.uint64(1) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift | above) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def values(self, i: np.ndarray) -> np.ndarray:
        """The elements of these numbers."""
        return self.high.select(i, 1) - i << self.low_bits | self._low(i)

    def successor(self, wanted: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of the first element not below ``wanted`` among those from ``begin`` to before ``end``, else ``end``."""
        high, low = wanted >> self.low_bits, wanted & (1 << self.low_bits) - 1
        last = len(self.high.words) * 64 - self.n - 1
        below, upto = np.clip(high - 1, 0, last), np.minimum(high, last)
        from_ = np.where(high > 0, self.high.select(below, 0) - below, 0)
        to = self.high.select(upto, 0) - upto
        a, b = np.clip(from_, begin, end), np.clip(to, begin, end)
        while True:
            going = np.flatnonzero(a < b)
            if not len(going):
                return a
            middle = a[going] + b[going] >> 1
            less = self._low(middle) < low[going]
            a[going] = np.where(less, middle + 1, a[going])
            b[going] = np.where(less, b[going], middle)


class Trie:
    """The words and pairs of one shard in one memory-mapped buffer."""

    def __init__(self, words: EliasFano, pointers: EliasFano, successors: EliasFano, code: np.ndarray):
        buffers = [x for level in (words, pointers, successors) for x in (level.low, level.high.words, level.high.ones)] + [code]
        mapped = np.frombuffer(mmap.mmap(-1, sum(x.nbytes for x in buffers) + 8), np.uint8)
        views, at = [], 0
        for x in buffers:
            view = mapped[at : at + x.nbytes].view(x.dtype)
            view[:] = x
            views.append(view)
            at += x.nbytes
        levels = [EliasFano(e.n, e.low_bits, views[3 * k], Bits(views[3 * k + 1], views[3 * k + 2])) for k, e in enumerate((words, pointers, successors))]
        self.words, self.pointers, self.successors = levels
        self.code = views[9]

    @classmethod
    def of(cls, known: np.ndarray, totals: np.ndarray, context: np.ndarray, child: np.ndarray, counts: np.ndarray) -> Trie:
        """From sorted words with their counts as contexts, and pairs (rank of the context, successor), which may repeat, with counts."""
        if len(known) << CHILD_BITS >= 1 << 63:
            raise ValueError("too many words in a shard")
        kept, back = np.unique(context << CHILD_BITS | child, return_inverse=True)
        n = np.bincount(back, counts.astype(float), minlength=len(kept))
        own = kept >> CHILD_BITS
        heads = np.searchsorted(own, np.arange(len(known) + 1))
        code = coded((n - DISCOUNT) / totals[own].astype(float)) if len(kept) else np.zeros(0, np.uint16)
        return cls(EliasFano.of(known >> np.uint64(1)), EliasFano.of(heads), EliasFano.of(kept), code)

    def kinds(self) -> np.ndarray:
        """The number of successors of each context."""
        return np.diff(self.pointers.values(np.arange(self.pointers.n))).astype(np.uint32)

    def codes(self, word: np.ndarray, child: np.ndarray) -> np.ndarray:
        """The code of each pair; the last one where the context or the pair is unknown."""
        out = np.full(len(word), CODE + 1, np.uint16)
        for a in range(0, len(word), 1 << 17):
            part = slice(a, a + (1 << 17))
            w, back = np.unique((word[part] >> np.uint64(1)).astype(np.int64), return_inverse=True)
            none = np.zeros(len(w), np.int64)
            rank = self.words.successor(w, none, none + self.words.n)
            known = rank < self.words.n
            known[known] = self.words.values(rank[known]) == w[known]
            rank = np.where(known, rank, 0)
            begin, end = self.pointers.values(rank), self.pointers.values(rank + 1)
            rank, begin, end = rank[back], begin[back], np.where(known, end, begin)[back]
            wanted = rank << CHILD_BITS | child[part]
            at = self.successors.successor(wanted, begin, end)
            hit = np.flatnonzero(at < end)
            hit = hit[self.successors.values(at[hit]) == wanted[hit]]
            out[a + hit] = self.code[at[hit]]
        return out


def coded(p: np.ndarray) -> np.ndarray:
    """Probabilities on a log scale, never upwards."""
    steps = np.log(np.maximum(p, FLOOR)) / np.log(FLOOR) * CODE
    return np.ceil(np.clip(steps, 0, CODE) - 1e-9).astype(np.uint16)


def decoded(code: np.ndarray) -> np.ndarray:
    """The probabilities of codes, 0 of unknown pairs."""
    return np.where(code > CODE, 0.0, np.exp(code.astype(float) / CODE * np.log(FLOOR)))


def mixed(pairs: np.ndarray, totals: np.ndarray, kinds: np.ndarray, p1: np.ndarray) -> np.ndarray:
    """Probabilities from those of pairs, counts of their contexts and of the contexts' successors; unigram ones after unknown contexts."""
    return np.where(totals > 0, pairs + DISCOUNT * kinds / np.maximum(totals, 1) * p1, p1)


def scored(table: DataFrame, answers: DataFrame, dealing: Dealing, tokens: int, distinct: int) -> DataFrame:
    """Scores of all documents of all blocks."""
    bottom = tokens + ALPHA * (distinct + 1)
    shared = table.sparkSession.sparkContext.broadcast(dealing)

    def run(batches):
        dealing = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                whole = lambda name, kind: np.concatenate([unpack(x[name], kind) for x in row["found"]])  # noqa: B023, E731
                vocab = unpack_steps(row["vocab"], np.uint64)
                places, _, begins = _training(row)
                context, child, back, before = _successors(vocab, places)
                shard, word, order, _, home = dealing.asks(vocab, context, child)
                at_home = home[word] == shard
                counts, kinds, pairs = np.zeros(len(vocab)), np.bincount(word, whole("kinds", np.uint32)), np.empty(len(context))
                counts[word[at_home]] = whole("counts", np.uint64)[at_home]
                pairs[order] = decoded(whole("pairs", np.uint16))
                p1 = ((counts + ALPHA) / bottom)[places]
                p = mixed(pairs[back], counts[before], kinds[before], p1)
                heads = np.flatnonzero(begins)
                per = lambda x: np.add.reduceat(x, heads)  # noqa: B023, E731
                yield pa.record_batch(
                    [
                        pa.array(row["docs"], pa.int64()),
                        pa.array(row["held"], pa.bool_()),
                        pa.array(row["sizes"], pa.int64()),
                        pa.array(per((counts[places] > 0).astype(np.int64)), pa.int64()),
                        pa.array([tokens] * len(heads), pa.int64()),
                        pa.array(per(np.log10(p1))),
                        pa.array(per(np.log10(np.maximum(p, 1e-300)))),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    found = answers.filter("block is not null").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("shard", "counts", "kinds", "pairs"))).alias("found"))
    joined = table.select("block", "docs", "held", "sizes", "vocab", "places").join(found, "block")
    return joined.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def dealing_of(table: DataFrame) -> Dealing:
    """Shards for all words of all blocks, and the words whose successors take more than one."""
    size = table.agg(F.sum("n_words")).first()[0] or 0
    shards = 1 << max(4, (size // SHARD_WORDS).bit_length())
    wide = table.select(F.explode("wide").alias("w")).groupBy("w.word").agg(F.sum("w.n").alias("n")).filter(F.col("n") > SHARD_WORDS)
    # each has SHARD_WORDS pairs sent at least, so there are fewer than pairs / SHARD_WORDS
    return Dealing(shards, {r["word"]: 1 << int(r["n"] // SHARD_WORDS).bit_length() for r in wide.collect()})


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    table = written(blocks(docs.select("doc_id", "text", held.alias("held_out"))))
    dealing = dealing_of(table)
    answers = written(answers_of(table, dealing))
    totals = answers.filter("distinct is not null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "distinct")]).first()
    return scored(table, answers, dealing, totals["n"], totals["distinct"])
