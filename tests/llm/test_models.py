"""Tokenizer, language models, language identification and token counts."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from texts import ODD, prose, sample, words

from pulsegrid.llm import bpe, language_id, lm_scoring, token_counts

try:
    import public_tokenizers
except ImportError:
    public_tokenizers = None
with_files = pytest.mark.skipif(public_tokenizers is None, reason="no tokenizer files")
SIGNS = ["it's we're I'll 's 'sabc x's't \"'s ''s", "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>", "don't'S 'llama", "1a2b 12,3!! ..", "x" * 500 + " " * 40 + "!" * 300, "\t\tx \ty\r\n z", "\x1c a\x1c", "ⅷ²x½", "😀 a😀'd"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@with_files
def test_ids_equal_the_library(docs, library):
    rows = [(i, t) for i, t in enumerate(ODD + SIGNS + [prose(1, 300)])]
    want = {}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in bpe.encoded(docs(rows)).collect()} == want
    full = {r.doc_id: r for r in bpe.encode_ids(docs(rows)).collect()}
    assert all(full[i].decoded == (t or "") for i, t in rows)


@with_files
def test_long_pieces_take_the_same_merges():
    t = bpe.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for raw in (b"abcabcabc" * 9, b"the" * 20, b"\xc3\xa9" * 30):
        assert t._long(raw).tolist() == t._short([raw])[0].tolist()


@with_files
def test_token_histogram(docs):
    rows = sample()
    lengths = [r.n_tokens for r in bpe.encoded(docs(rows)).collect()]
    found = {r.n_tokens: r for r in token_counts.token_counts(docs(rows)).collect()}
    assert set(found) == set(lengths)
    for limit, r in found.items():
        assert (r.n_docs, r.docs_over, r.tokens_over) == (lengths.count(limit), sum(n > limit for n in lengths), sum(n for n in lengths if n > limit))
        assert r.tokens_truncated == sum(min(n, limit) for n in lengths)
    q = token_counts.quantiles(token_counts.token_counts(docs(rows)), [0.5, 1.0]).first()
    assert (q["q0.5"], q["q1"]) == (sorted(lengths)[math.ceil(len(lengths) / 2) - 1], max(lengths))
    shares = {r.n_tokens: r.quantiles for r in found.values() if r.quantiles}
    for share in token_counts.QUANTILES:
        assert str(share) in shares[sorted(lengths)[math.ceil(len(lengths) * share - 1e-9) - 1]].split(",")
    asked = {r.n_tokens: r for r in token_counts.token_counts(docs(rows), limits=(0, 77, 10**6)).collect()}
    assert {n: r for n, r in asked.items() if n in found} == found
    assert (asked[77].n_docs == lengths.count(77), asked[77].docs_over, asked[77].tokens_truncated) == (True, sum(n > 77 for n in lengths), sum(min(n, 77) for n in lengths))
    assert asked[10**6].docs_over == 0
    assert token_counts.token_counts(docs(rows).filter("false")).count() == 0


def test_elias_fano_round_trip_and_search():
    rng = np.random.default_rng(0)
    for values in ([], [0], [5, 5, 9], sorted(rng.integers(0, 10**9, 500)), sorted(rng.integers(0, 1 << 60, 3000)), sorted(rng.integers(0, 40, 700))):
        values = np.array(values, np.int64)
        found = lm_scoring.EliasFano.of(values)
        assert found.values(np.arange(len(values))).tolist() == values.tolist()
        wanted = np.concatenate([values, values + 1, np.maximum(values - 1, 0), rng.integers(0, 1 << 61, 50), [0]])
        begin = rng.integers(0, len(values) + 1, len(wanted))
        end = np.maximum(begin, rng.integers(0, len(values) + 1, len(wanted)))
        want = [a + int(np.searchsorted(values[a:b], w)) for w, a, b in zip(wanted, begin, end)]
        assert found.successor(wanted, begin, end).tolist() == want


def test_base_scores_equal_brute_force_and_the_model_is_better(spark, docs):
    rows = sample() + [(i, "the cat sat on the mat and the dog sat on the rug " * (1 + i % 3)) for i in range(500, 700)]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    tokens = {i: words(t) + [None] for i, t in rows}
    counts = Counter(w for i, t in tokens.items() if not held(i) for w in t)
    total, kinds = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in lm_scoring.lm_scores(docs(rows)).collect()}
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(t), sum(counts[w] > 0 for w in t), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t))
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm_scoring.lm_scores(docs(rows).filter("false")).count() == 0


def test_model_probabilities_add_up():
    known = np.array([3, 9, 1 << 63], np.uint64)
    context, child, counts = np.array([0, 0, 2, 0]), np.array([7, 5, 7, 7]), np.array([2, 1, 4, 3])
    totals = np.array([6, 0, 4], np.uint64)
    trie = lm_scoring.Trie.of(known, totals, context, child, counts)
    assert trie.kinds().tolist() == [2, 0, 1]
    p = lm_scoring.decoded(trie.codes(known[[0, 0, 2, 1, 0]], np.array([7, 5, 7, 7, 6])))
    assert p == pytest.approx([(5 - 0.75) / 6, (1 - 0.75) / 6, (4 - 0.75) / 4, 0, 0], rel=1e-3)
    assert lm_scoring.decoded(trie.codes(np.array([100], np.uint64), np.array([7]))).tolist() == [0]
    assert p[0] + p[1] + 0.75 * 2 / 6 == pytest.approx(1, rel=1e-3) and p[0] + p[1] + 0.75 * 2 / 6 <= 1
    assert p[2] + 0.75 / 4 == pytest.approx(1, rel=1e-3)


@pytest.mark.parametrize("shard_words", [400_000, 50])
def test_scores_use_every_pair_of_the_corpus(docs, monkeypatch, shard_words):
    monkeypatch.setattr(lm_scoring, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(lm_scoring, "REPORTED", 2)
    rows = sample() + [(500 + i, "the cat sat on the " + prose(i, 20)) for i in range(60)]
    rows += [(None, "the cat"), (900, prose(7, 3000))]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = {i: words(t) + [None] for i, t in rows}
    learned = [t for i, t in tokens.items() if not held(i)]
    ones = Counter(w for t in learned for w in t)
    twos = Counter(pair for t in learned for pair in zip([None] + t, t))
    after = Counter(a for a, _ in twos)
    d = lm_scoring.DISCOUNT
    bottom = ones.total() + 0.1 * (len(ones) + 1)

    def p(a, w):
        low = (ones[w] + 0.1) / bottom
        return (max(twos[a, w] - d, 0) + d * after[a] * low) / ones[a] if ones[a] else low

    got = {r.doc_id: r.score for r in lm_scoring.lm_scores(docs(rows)).collect()}
    # a step of the probability scale is 0.0002 in log10
    assert got == {i: pytest.approx(sum(math.log10(p(a, w)) for a, w in zip([None] + t, t)), abs=2e-4 * len(t)) for i, t in tokens.items()}
    for parts in (1, 7):
        again = {r.doc_id: r.score for r in lm_scoring.lm_scores(docs(rows).repartition(parts)).collect()}
        assert again == {i: pytest.approx(x, rel=1e-9) for i, x in got.items()}


def test_language_of_held_out_texts(spark):
    spoken = {"en": "the and of with this that", "de": "der und die nicht mit schön", "fr": "le les et dans où être"}
    rows = []
    for i in range(300):
        lang = list(spoken)[i % 3]
        rng = np.random.default_rng(i)
        rows.append((i, " ".join(rng.choice(spoken[lang].split(), 30)), lang))
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None), (1003, "the of and", None)]
    found = {r.doc_id: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang in rows[:300])
    assert [found[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "en"]
    assert [found[i].score for i in (1000, 1001)] == [0.0, 0.0]
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= found[i].score <= 1 for i, *_ in rows)
    assert not any(found[i].rejected for i in range(300))
    unlabelled = spark.createDataFrame([(1, "the of", None)], "doc_id long, text string, lang string")
    assert language_id.language_id(unlabelled).first().lang_pred == "und"
    assert language_id.language_id(unlabelled.filter("false")).count() == 0


def test_models_keep_all_labels_and_triples(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_TRIPLES", 3, raising=False)
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 1, raising=False)
    rows = [("abcab", "x"), ("abcab", "x"), ("dedf", "y")]
    models = language_id.trained(spark.createDataFrame([(t, lang) for t, lang in rows], "text string, lang string"))
    want = {lang: {p[i : i + 3] for t, own in rows if own == lang for p in [f" {t} "] for i in range(len(p) - 2)} for lang in "xy"}
    assert {lang: len(m.tri[0]) for lang, m in models.items()} == {lang: len(w) for lang, w in want.items()}


def test_probabilities_equal_brute_force(spark):
    rows = [("abcab dé", "x"), ("abba cab", "x"), ("dedf é", "y"), ("fed", "y")]
    models = language_id.trained(spark.createDataFrame(rows, "text string, lang string"))
    letters = {c for t, _ in rows for c in t} | {" "}
    for lang, model in models.items():
        tri = Counter(p[i : i + 3] for t, own in rows if own == lang for p in [f" {t} "] for i in range(len(p) - 2))
        bi = Counter(t[1:] for t in tri)
        uni = Counter(t[1:] for t in bi)

        def discount(counts):
            one, two = (sum(n == k for n in counts.values()) for k in (1, 2))
            return min(0.9, max(0.1, one / (one + 2 * two))) if one else 0.5

        def p(t):
            d = discount(uni)
            out = (max(uni[t[2]] - d, 0) + d * len(uni) / (len(letters) + 1)) / uni.total()
            for counts, key in ((bi, t[1:]), (tri, t)):
                of = {k: n for k, n in counts.items() if k[:-1] == key[:-1]}
                if of:
                    out = (max(counts[key] - discount(counts), 0) + discount(counts) * len(of) * out) / sum(of.values())
            return math.log(out)

        asked = [a + b + c for a in sorted(letters) for b in sorted(letters) for c in sorted(letters)] + ["abz", "zzz"]
        code = lambda c: 0 if c == " " else ord(c)
        keys = np.array([code(t[0]) << 42 | code(t[1]) << 21 | code(t[2]) for t in asked])
        assert model.log_prob(keys) == pytest.approx([p(t) for t in asked])


def test_strange_texts_are_rejected_and_clean_ones_stay(spark):
    spoken = {"en": "the and of with this that have from they will would there their", "de": "der und die nicht mit schön sich auch werden haben eine durch", "es": "que los del las una por con para como pero sus"}
    rows = []
    for i in range(1500):
        lang = list(spoken)[i % 3]
        rng = np.random.default_rng(i)
        size = int(rng.choice([3, 8, 30, 100])) if i % 50 else 900  # few long texts
        rows.append((i, " ".join(rng.choice(spoken[lang].split(), size)), lang))
    strange = [(5000 + i, "これは日本語の文章です 言語が違います" * (1 + 9 * i), None) for i in range(10)]
    strange += [(6000 + i, prose(i, 10 + 60 * i).translate(str.maketrans("abcdefgh", "qxjzkvwy")), None) for i in range(20)]
    df = spark.createDataFrame(rows + strange + [(None, "the and of", "en"), (1, "the and of", "en")], "doc_id long, text string, lang string").withColumn("size", __import__("pyspark").sql.functions.lit(1))
    found = language_id.language_id(df).collect()
    assert all(r.rejected for r in found if r.doc_id is not None and r.doc_id >= 5000)
    clean = [r for r in found if r.doc_id is not None and r.doc_id < 5000]
    kept = [not r.rejected for r in clean if r.held_out]
    assert len(clean) == 1501 and sum(kept) >= 0.99 * len(kept)
    assert sum(r.rejected for r in clean) <= 0.01 * len(clean)


def test_symbols_of_rows():
    from pulsegrid.llm.textops import slices

    (s,) = slices(pa.array(["Ab  c!d", "", None, "é"], pa.string()))
    code, begins = language_id.symbols(s)
    assert [chr(c) for c in code if c] == list("abcdé")
    assert begins.tolist() == sorted(begins.tolist()) and len(begins) == 5
