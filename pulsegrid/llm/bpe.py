"""Byte-pair encoding and decoding with a public tokenizer file.

Texts are cut into pieces by character class over whole Arrow buffers. Each distinct short piece is a row
of a contiguous array of token ids beside an array of the ranks of neighbouring pairs; all rows advance
together: find the least rank, merge there, delete the boundary, refresh the two ranks beside it, until no
pair has a rank. Pieces over ``SHORT`` bytes, where repeated scans would be slow, take the same merges from a
heap. Merged pieces are kept per worker by a 64-bit hash, at most ``KEPT_PIECES`` of them; decoded bytes are
compared with the text, so a clash of hashes is found and the text encoded anew without them.

Null text counts as empty and has no tokens; a null doc_id stays null; repeated rows are encoded one by one; an empty table gives an empty
result; other columns of the input are ignored. Of pairs of equal rank the first is merged first. A very long text is a slice of its own and is encoded whole. The tokenizer's special token in a text is one id.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulsegrid.llm.textops import _powers, mix, slices

SHORT = 96
KEPT_PIECES = 400_000
NONE = np.int32(2**31 - 1)
LETTER, NUMBER, OTHER, SPACE = range(4)
# White space of the pattern.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Endings after an apostrophe.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[SPACES] = SPACE
    return table


def _byte_alphabet() -> dict[str, int]:
    """The printable sign that stands for each byte: its own where printable in Latin-1, else from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """Tables of a tokenizer file, and the pieces that this worker has encoded."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, signs = spec["model"]["vocab"], _byte_alphabet()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(*vocab.values(), *self.special.values()) + 1
        token = [b""] * size
        for sign, i in vocab.items():
            token[i] = bytes(signs[c] for c in sign)
        for content, i in self.special.items():
            token[i] = content.encode()
        self.token_bytes = np.frombuffer(b"".join(token), np.uint8)
        self.token_size = np.array([len(t) for t in token], np.int64)
        self.token_start = np.concatenate([[0], np.cumsum(self.token_size)[:-1]])
        self.byte_id = np.zeros(256, np.int32)
        for sign, b in signs.items():
            self.byte_id[b] = vocab[sign]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.classes = _classes()
        self.byte_values = mix(np.arange(1, 257, dtype=np.uint64))
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.spans = np.zeros((0, 2), np.int64)
        self.flat = np.zeros(0, np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; NONE where they do not merge or either is -1."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions where pieces start."""
        if not len(data):
            return np.zeros(0, np.int64)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        code = data[at].astype(np.uint32)
        wide = np.flatnonzero(code >= 0xC0)
        if len(wide):
            lead, p = code[wide], at[wide]
            size = 2 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
            value = lead & (0x7F >> size).astype(np.uint32)
            for k in (1, 2, 3):
                more = size > k
                value[more] = value[more] << 6 | (data[p[more] + k] & 0x3F)
            code[wide] = value
        kind = self.classes[code]
        n = len(kind)
        first = np.zeros(n + 1, bool)  # of a row; the end counts too
        first[np.searchsorted(at, offsets)] = True
        start = first[:-1].copy()
        start[1:] |= kind[1:] != kind[:-1]
        run = np.flatnonzero(start)
        # the last of several spaces stands apart where something follows; a blank joins what follows
        follows = run[(kind[run] != SPACE) & ~first[run]]
        follows = follows[kind[follows - 1] == SPACE]
        start[follows - 1] = True
        start[follows[code[follows - 1] == 0x20]] = False
        self._endings(code, kind, first, start)
        return at[start]

    @staticmethod
    def _endings(code, kind, first, start) -> None:
        mark = np.flatnonzero((code == 0x27) & start)
        for ending in ENDINGS:
            k = len(ending)
            hit = mark[mark + k < len(code)]
            for i, c in enumerate(ending, 1):
                hit = hit[(code[hit + i] == ord(c)) & ~first[hit + i]]
            start[hit + 1] = False
            after = hit[(hit + k + 1 < len(code))] + k + 1
            start[after[~first[after] & (kind[after] == LETTER)]] = True

    def encode_pieces(self, raw: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(raw)
        order = sorted((i for i in range(len(raw)) if len(raw[i]) <= SHORT), key=lambda i: len(raw[i]))
        for a in range(0, len(order), 4096):
            part = order[a : a + 4096]
            for i, ids in zip(part, self._short([raw[i] for i in part])):
                out[i] = ids
        for i, x in enumerate(raw):
            if len(x) > SHORT:
                out[i] = self._long(x)
        return out

    def _short(self, raw: list[bytes]) -> list[np.ndarray]:
        width = len(raw[-1]) + 1
        sizes = np.array([len(x) for x in raw])
        ids = np.full((len(raw), width), -1, np.int32)
        inside = np.arange(width) < sizes[:, None]
        ids[inside] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        rank = np.full((len(raw), width), NONE)
        rank[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        live, done = np.arange(len(raw)), ids.copy()
        column = np.arange(width)
        while True:
            j = rank.argmin(1)
            least = rank[np.arange(len(j)), j]
            going = least < NONE
            if not going.all():
                done[live[~going]] = -1
                done[live[~going], : ids.shape[1]] = ids[~going]
                live, ids, rank, j, least = live[going], ids[going], rank[going], j[going], least[going]
            if not len(live):
                return [row[row >= 0] for row in done]
            row = np.arange(len(j))
            ids[row, j] = self.merged[least]
            width -= 1  # every row loses one boundary
            source = column[:width] + (column[:width] > j[:, None])
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, np.minimum(source, rank.shape[1] - 1), 1)
            right = np.where(j + 1 < width, ids[row, np.minimum(j + 1, width - 1)], -1)
            rank[row, j] = self.rank(ids[row, j], right)
            left = np.maximum(j - 1, 0)
            rank[row, left] = np.where(j > 0, self.rank(ids[row, left], ids[row, j]), rank[row, left])

    def _pair(self, a: int, b: int) -> int:
        key = a << 20 | b
        at = int(np.searchsorted(self.keys, key))
        return int(self.ranks[at]) if at < len(self.keys) and self.keys[at] == key else -1

    def _long(self, raw: bytes) -> np.ndarray:
        ids = self.byte_id[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i in range(n - 1) if (r := self._pair(ids[i], ids[i + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or self._pair(ids[i], ids[j]) != r:
                continue
            ids[i], ids[j], after[i] = int(self.merged[r]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := self._pair(ids[i], ids[after[i]])) >= 0:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := self._pair(ids[before[i]], ids[i])) >= 0:
                heapq.heappush(heap, (r, before[i]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _learn(self, hashes: np.ndarray, raw: list[bytes]) -> None:
        if len(self.known) + len(hashes) > KEPT_PIECES:
            self.forget()
        ids = self.encode_pieces(raw)
        sizes = np.array([len(x) for x in ids], np.int64)
        ends = len(self.flat) + np.cumsum(sizes)
        self.flat = np.concatenate([self.flat, *ids])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.spans = known[order], np.concatenate([self.spans, np.stack([ends - sizes, ends], 1)])[order]

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and where each row's ids begin; special tokens count as text."""
        starts = self.pieces(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        up, down = _powers(len(data))
        with np.errstate(over="ignore"):
            hashes = mix(np.add.reduceat(self.byte_values[data] * up, starts) * down[starts])
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = (at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != distinct) if len(self.known) else np.ones(len(distinct), bool)
        if len(self.known) + new.sum() > KEPT_PIECES:  # begin anew with what this slice needs
            self.forget()
            new[:] = True
        if new.any():
            whole = data.tobytes()
            self._learn(distinct[new], [whole[a:b] for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist())])
            at = np.searchsorted(self.known, distinct)
        span = self.spans[at][back]
        sizes = span[:, 1] - span[:, 0]
        total = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.flat[np.repeat(span[:, 0] - total[:-1], sizes) + np.arange(total[-1])]
        return flat, total[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's bytes begin."""
        sizes = self.token_size[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.token_bytes[np.repeat(self.token_start[ids] - total[:-1], sizes) + np.arange(total[-1])], total

    def encode_one(self, text: str) -> np.ndarray:
        """One text, special tokens included, without remembered pieces."""
        for content, i in self.special.items():
            if content in text:
                parts = [self.encode_one(x) for x in text.split(content)]
                return np.concatenate([y for x in parts for y in (np.array([i], np.int32), x)][1:])
        data = np.frombuffer(text.encode(), np.uint8)
        starts = self.pieces(data, np.array([0, len(data)]))
        raw = [data[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(data)])]
        return np.concatenate([np.zeros(0, np.int32), *self.encode_pieces(raw)])

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and bytes of each row of a string column."""
        marks = [x.encode() for x in self.special]
        for s in slices(column):
            flat, bounds = self._plain(s.data, s.offsets)
            text, total = self.decode(flat)
            source = s.data
            special = any(m in source.tobytes() for m in marks)
            same = len(text) == len(source) and bool((text == source).all())
            for i in range(len(s.offsets) - 1):
                ids = flat[bounds[i] : bounds[i + 1]]
                out = text[total[bounds[i]] : total[bounds[i + 1]]]
                if not same or special:
                    own = source[s.offsets[i] : s.offsets[i + 1]]
                    if not np.array_equal(out, own) or any(m in own.tobytes() for m in marks):
                        ids = self.encode_one(own.tobytes().decode())
                        out, _ = self.decode(ids)
                yield ids, out


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (string) of each document."""

    def run(batches):
        bpe = tokenizer(path or _default_path())
        for batch in batches:
            rows = list(bpe.encode(batch.column("text")))
            ids = pa.array([x.tolist() for x, _ in rows], pa.list_(pa.int32()))
            text = pa.array([x.tobytes().decode("utf-8", "replace") for _, x in rows], pa.string())
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), ids, text], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def token_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """n_tokens of each document."""

    def run(batches):
        bpe = tokenizer(path or _default_path())
        for batch in batches:
            yield pa.record_batch([pa.array([len(ids) for ids, _ in bpe.encode(batch.column("text"))], pa.int64())], ["n_tokens"])

    return docs.select("text").mapInArrow(run, "n_tokens long")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the decoded text of each document."""

    def run(batches):
        bpe = tokenizer(path or _default_path())
        for batch in batches:
            counts, ids_hash, text_hash = [], [], []
            for ids, out in bpe.encode(batch.column("text")):
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(out.tobytes()).hexdigest())
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
