"""Language identification by interpolated Kneser-Ney character models.

Each language has counts of letter triples in sorted arrays of packed keys, from which modified counts of pairs and single
letters follow; their discounted probabilities are interpolated. Texts go to the language of the lowest cross-entropy
for each letter.

Rejection is calibrated on one in ``CALIBRATION`` of the training texts, which are left out of the counts: for each language and length
class, else for the language, else for all, the limit lies as far above the entropy that all but ``FALSE_REJECTIONS`` of the rightly recognised
texts keep as this lies above their median. No language or length goes without a limit if there is any such text. Letters that a
model does not know have the least probability in it, so text in strange letters lies beyond the limit.

Letters are lower-cased one by one, and any run of other signs is one blank. Training triples are summed in each task
before the shuffle; the models hold every label and every triple counted, and go through the driver, so they
grow with the distinct triples of the labels. Whole texts are counted and scored.

Null text and text without a letter are ``und`` with score 0 and rejected; repeated rows are judged one by one; an empty
table gives an empty result; without labelled training texts all are ``und``. Ties go to the first label by name. Very long texts are slices of their
own and are scored whole; only doc_id, text and lang are read, so extra columns, of clashing names too, do not matter.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import written
from pulsegrid.llm.textops import slices

FOLDS = 5
CALIBRATION = 8
FALSE_REJECTIONS = 0.002
#: Texts that a limit rests on at least, where a wider class has more.
LEAST_TEXTS = 20
#: Nats that a limit lies above the median at least, where texts hardly differ.
LEAST_MARGIN = 0.3
DENSE = 160
_BITS = 21
_LOW = (1 << _BITS) - 1
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """The lower-case letter for each code point, 0 for what is no letter."""
    if not _TABLE:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] == "L":
                table[c] = ord(chr(c).lower()[0])
        _TABLE.append(table)
    return _TABLE[0]


def symbols(s) -> tuple[np.ndarray, np.ndarray]:
    """Letters and blanks of all rows, each row with a blank at its start and end; and where rows begin."""
    at = np.flatnonzero((s.data & 0xC0) != 0x80)
    code = s.data[at].astype(np.uint32)
    wide = np.flatnonzero(code >= 0xC0)
    if len(wide):
        lead, p = code[wide], at[wide]
        size = 2 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        value = lead & (0x7F >> size).astype(np.uint32)
        for k in (1, 2, 3):
            more = size > k
            value[more] = value[more] << 6 | (s.data[p[more] + k] & 0x3F)
        code[wide] = value
    code = _letters()[code]
    rows = np.searchsorted(at, s.offsets)
    n = len(rows) - 1
    # a blank before each row, and one after the last
    spread = np.zeros(len(code) + n + 1, np.uint32)
    spread[np.arange(len(code)) + np.repeat(np.arange(1, n + 1), np.diff(rows))] = code
    begins = rows + np.arange(n + 1)
    keep = np.ones(len(spread), bool)
    keep[1:] = (spread[1:] != 0) | (spread[:-1] != 0)
    keep[begins] = True
    # a blank that ends a row is the next row's first
    last = begins[1:] - 1
    drop = last[(last > begins[:-1]) & (spread[last] == 0)]
    keep[drop] = False
    return spread[keep], (np.cumsum(keep) - 1)[begins]


def _triples(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed triples, and for each triple its place among these."""
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.unique(code)
    if len(seen) > DENSE:
        x = code.astype(np.int64)
        return np.unique(x[:-2] << 2 * _BITS | x[1:-1] << _BITS | x[2:], return_inverse=True)
    place = np.zeros(int(seen[-1]) + 1, np.int32)
    place[seen] = np.arange(len(seen))
    x, m = place[code], len(seen)
    dense = (x[:-2] * m + x[1:-1]) * m + x[2:]
    used = np.flatnonzero(np.bincount(dense, minlength=m**3))
    back = np.zeros(m**3, np.int32)
    back[used] = np.arange(len(used))
    a, b, c = (seen[i].astype(np.int64) for i in (used // (m * m), used // m % m, used % m))
    return a << 2 * _BITS | b << _BITS | c, back[dense]


def triple_counts(docs: DataFrame) -> DataFrame:
    """lang, triple and count over all labelled training documents."""

    def run(batches):
        total: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for s in slices(batch.column("text")):
                code, begins = symbols(s)
                keys, place = _triples(code)
                if not len(keys):
                    continue
                own = langs[s.first : s.first + len(begins) - 1]
                names, index = np.unique(own.astype(str), return_inverse=True)
                row = np.repeat(index, np.diff(begins))
                row = row[: len(place)]
                inside = np.ones(len(place), bool)  # triples over the blank between rows tell nothing
                inside[begins[1:-1] - 1] = False
                counts = np.bincount(row[inside] * len(keys) + place[inside], minlength=len(names) * len(keys)).reshape(len(names), -1)
                for name, n in zip(names.tolist(), counts):
                    total.setdefault(name, []).append((keys[n > 0], n[n > 0]))
                    if len(total[name]) > 32:
                        total[name] = [_summed(total[name])]
        for name, parts in total.items():
            keys, n = _summed(parts)
            for a in range(0, len(keys), 50_000):
                part = slice(a, a + 50_000)
                yield pa.record_batch([pa.array([name] * len(keys[part]), pa.string()), pa.array(keys[part]), pa.array(n[part])], ["lang", "triple", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, triple long, n long").groupBy("lang", "triple").agg(F.sum("n").alias("n"))


def _summed(parts):
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def _grouped(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    found, back = np.unique(keys, return_inverse=True)
    return found, np.bincount(back, weights).astype(float)


def _discount(counts: np.ndarray) -> float:
    one, two = (counts == 1).sum(), (counts == 2).sum()
    return float(np.clip(one / (one + 2 * two), 0.1, 0.9)) if one else 0.5


class Model:
    """One language: sorted keys with counts at each order, and what their contexts hold."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int):
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(float)
        pairs, pair_kinds = _grouped(keys & (1 << 2 * _BITS) - 1)  # distinct letters before a pair
        singles, single_kinds = _grouped(pairs & _LOW)
        self.tri = (keys, counts, _discount(counts), _grouped(keys >> _BITS, counts), _grouped(keys >> _BITS))
        self.bi = (pairs, pair_kinds, _discount(pair_kinds), _grouped(pairs >> _BITS, pair_kinds), _grouped(pairs >> _BITS))
        self.uni = (singles, single_kinds, _discount(single_kinds), single_kinds.sum())
        self.alphabet = alphabet

    def log_prob(self, keys: np.ndarray) -> np.ndarray:
        singles, kinds, d, total = self.uni
        p = (np.maximum(_find(singles, kinds, keys & _LOW) - d, 0) + d * len(singles) / self.alphabet) / total
        for (found, counts, d, totals, distinct), key in ((self.bi, keys & (1 << 2 * _BITS) - 1), (self.tri, keys)):
            whole, several = _find(*totals, key >> _BITS), _find(*distinct, key >> _BITS)
            upper = (np.maximum(_find(found, counts, key) - d, 0) + d * several * p) / np.maximum(whole, 1)
            p = np.where(whole > 0, upper, p)
        return np.log(p)


def trained(docs: DataFrame) -> dict[str, Model]:
    """A model for each label."""
    found = written(triple_counts(docs)).toArrow()
    if not len(found):
        return {}
    triples, langs = np.asarray(found["triple"]), found["lang"].combine_chunks().dictionary_encode()
    counts, which, names = np.asarray(found["n"]), np.asarray(langs.indices), langs.dictionary.to_pylist()
    alphabet = len(np.unique(np.concatenate([triples >> 2 * _BITS, triples >> _BITS & _LOW, triples & _LOW]))) + 1
    return {lang: Model(triples[which == k], counts[which == k], alphabet) for k, lang in sorted(enumerate(names), key=lambda x: x[1])}


def scored(docs: DataFrame, models: dict[str, Model]) -> DataFrame:
    """doc_id, lang, held_out, n_symbols, entropy, lang_pred and score."""
    names = sorted(models)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        known = shared.value
        for batch in batches:
            preds, scores, entropies, lengths = [], [], [], []
            for s in slices(batch.column("text")):
                code, begins = symbols(s)
                rows = len(begins) - 1
                letters = np.add.reduceat(np.append(code != 0, False).astype(np.int64), begins[:-1]) if rows else []
                keys, place = _triples(code)
                # the triples of a row begin at its own blank and end with the next row's
                size = np.maximum(np.diff(begins) - 1, 0)
                sums = np.zeros((len(names), rows))
                for k, name in enumerate(names if len(keys) else []):
                    part = known[name].log_prob(keys)[place]
                    part = np.append(part, [0.0, 0.0])
                    total = np.concatenate([[0.0], np.cumsum(part)])
                    sums[k] = total[begins[:-1] + size] - total[begins[:-1]]
                for i in range(rows):
                    if not letters[i] or not names:
                        preds.append("und"), scores.append(0.0), entropies.append(None), lengths.append(0)
                        continue
                    h = -sums[:, i] / size[i]
                    best = int(h.argmin())
                    preds.append(names[best])
                    scores.append(float(1 / np.exp(-(h - h[best]) * min(int(size[i]), 20)).sum()))
                    entropies.append(float(h[best]))
                    lengths.append(int(size[i]))
            yield pa.record_batch(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("lang").cast(pa.string()),
                    batch.column("held_out"),
                    pa.array(preds, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(entropies, pa.float64()),
                    pa.array(lengths, pa.int64()),
                ],
                ["doc_id", "lang", "held_out", "lang_pred", "score", "entropy", "n_symbols"],
            )

    return docs.select("doc_id", "lang", "text", "held_out").mapInArrow(
        run, "doc_id long, lang string, held_out boolean, lang_pred string, score double, entropy double, n_symbols long"
    )


def _limits(found: DataFrame, *by: str) -> DataFrame:
    """Entropy limits of recognised calibration texts by length class and language, by language, or of all."""
    known = found.filter(F.col("calibrates") & (F.col("lang") == F.col("lang_pred")))
    cuts = F.percentile_approx("entropy", [0.5, 1 - FALSE_REJECTIONS], 10_000)
    rows = known.groupBy(*by).agg(cuts.alias("cut"), F.count("*").alias("n"))
    margin = F.greatest(2 * (F.col("cut")[1] - F.col("cut")[0]), F.lit(LEAST_MARGIN))
    return written(rows.filter(F.col("n") >= (LEAST_TEXTS if by else 1)).select(*by, (F.col("cut")[0] + margin).alias("limit")))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy and ``rejected`` of each document."""
    draw = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(draw % FOLDS == 0, F.lit(False)))
    learns = ~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()
    calibrates = F.coalesce(F.floor(draw / FOLDS) % CALIBRATION == 0, F.lit(False))
    models = trained(docs.filter(learns & ~calibrates))
    # labels with calibration texts alone are learned from these
    rest = docs.filter(learns & calibrates & ~F.col("lang").isin(list(models)))
    models |= trained(rest) if not rest.isEmpty() else {}
    found = written(scored(docs, models)).withColumn("size", F.floor(F.log2(F.greatest("n_symbols", F.lit(1)))))
    found = found.withColumn("calibrates", ~F.col("held_out") & (F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / FOLDS) % CALIBRATION == 0))
    # a row for each language and power of two, for each language, and one
    whole = found.join(_limits(found, "lang_pred", "size").withColumnRenamed("limit", "of_class"), ["lang_pred", "size"], "left")
    whole = whole.join(_limits(found, "lang_pred").withColumnRenamed("limit", "of_lang"), "lang_pred", "left")
    whole = whole.join(F.broadcast(_limits(found).withColumnRenamed("limit", "of_all")), F.lit(True), "left")
    beyond = F.greatest(F.col("entropy") - F.coalesce("of_class", "of_lang", "of_all"), F.lit(0.0))
    return whole.select(
        "doc_id",
        "held_out",
        "lang_pred",
        (F.col("score") * F.exp(-F.coalesce(beyond, F.lit(0.0)))).alias("score"),
        "entropy",
        ((F.col("lang_pred") == "und") | F.coalesce(beyond > 0, F.lit(False))).alias("rejected"),
    )
