"""The network against a plain forward pass, its gradients against differences, and held-out accuracy."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from texts import ALNUM, ODD, words

from pulsegrid.llm import toxicity as T
from pulsegrid.llm.textops import slices

STEMS = ["grubbo", "vilnak", "snorf"]


def clean(rng, n):
    return " ".join("".join(rng.choice(["ta", "mi", "ro", "ne", "lu", "shi"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def made(seed, n):
    """Texts of 5 to 400 words; every third one holds one to three forms of a bad stem somewhere."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        w = clean(rng, rng.randint(5, 400)).split()
        if i % 3 == 0:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(STEMS).capitalize() + rng.choice(["", "ta", "lune", "shi", "rota"]))
        rows.append((" ".join(w), int(i % 3 == 0)))
    return rows


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_logit(net, text):
    """The highest window's logit, word by word."""
    (s,) = slices(pa.array([text or ""], pa.large_string()))
    w, places, bounds = T.read_words(s)
    vectors = net.vectors(w)
    seen = words(text, ALNUM)
    assert len(places) == len(seen)
    p, h, best = net.p, T.HIDDEN, -np.inf
    begin = 0
    while True:
        part = places[begin : begin + T.WINDOW]
        states = []
        for way in (0, 1):
            state, out = np.zeros(h), []
            for k in part if way == 0 else part[::-1]:
                x = (vectors[k] @ p["input"] + p["bias"]).reshape(2, 3 * h)[way]
                own = state @ p["state"][way]
                keep, reset = sigmoid(x[:h] + own[:h]), sigmoid(x[h : 2 * h] + own[h : 2 * h])
                new = np.tanh(x[2 * h :] + reset * own[2 * h :])
                state = (1 - keep) * new + keep * state
                out.append(state)
            states.append(out if way == 0 else out[::-1])
        told = np.array([a @ p["pool"][0] + b @ p["pool"][1] for a, b in zip(*states)]).reshape(-1, 2)
        weight = np.exp(told[:, 0] - told[:, 0].max(initial=0))
        best = max(best, (weight * told[:, 1]).sum() / max(weight.sum(), 1e-30) + p["out"][0])
        if begin + T.WINDOW >= len(places):
            return best
        begin += T.STRIDE


def test_windows_overlap():
    for n in range(0, 400):
        first, size, _ = T.windows(np.array([0, n]))
        spans = list(zip(first.tolist(), (first + size).tolist()))
        assert spans[0][0] == 0 and spans[-1][1] == n
        assert all(b - a == T.WINDOW for a, b in spans[:-1]) and all(x[1] - y[0] == T.WINDOW - T.STRIDE for x, y in zip(spans, spans[1:]))


def test_logits_equal_plain_pass(monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 7)
    net = T.Network(3)
    net.p["out"][0] = 0.3
    net.p["bias"] += np.random.default_rng(0).normal(size=net.p["bias"].shape).astype(np.float32)
    texts = [x for x in ODD] + [t for t, _ in made(1, 12)] + ["loser, LOSER! ü-é 3"]
    for limit in (1 << 10, 1 << 18):
        got = np.concatenate([net.text_logits(s) for s in slices(pa.array(texts, pa.large_string()), limit)])
        assert np.allclose(got, [plain_logit(net, t) for t in texts], atol=1e-4)


@pytest.mark.parametrize("words_", [2, 9])
def test_gradients_equal_differences(monkeypatch, words_):
    monkeypatch.setattr(T, "DROPPED", 0.0)
    rng, net = np.random.default_rng(1), T.Network(1)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    net.p["gram"] = rng.normal(size=net.p["gram"].shape)
    texts = [clean(random.Random(i), words_) for i in range(4)] + [""]
    (s,) = slices(pa.array(texts, pa.large_string()))
    w, places, bounds = T.read_words(s)
    first, size, _ = T.windows(bounds)
    label = np.array([0.0, 1, 1, 0, 1])

    def loss():
        x = np.array([plain_logit(net, t) for t in texts])
        return np.mean(np.log1p(np.exp(x)) - label * x)

    found = net.gradients(w, places, first, size, label, rng)
    for name, g in found.items():
        flat = net.p[name].reshape(-1)
        likely = np.argsort(-np.abs(g.reshape(-1)))[:6].tolist() + rng.integers(0, len(flat), 3).tolist()
        for k in likely:
            old, step = flat[k], 1e-5
            flat[k] = old + step
            up = loss()
            flat[k] = old - step
            down = loss()
            flat[k] = old
            assert np.isclose(g.reshape(-1)[k], (up - down) / (2 * step), atol=1e-5, rtol=1e-3), name


def test_held_out_accuracy_and_edges(spark, docs):
    rows = [(i, t) for i, (t, _) in enumerate(made(2, 900))]
    label = {i: y for i, (_, y) in enumerate(made(2, 900))}
    odd = [(5000 + i, t) for i, t in enumerate(ODD)] + [(None, rows[0][1]), (7, rows[7][1]), (6000, clean(random.Random(1), 9000) + " snorfshi " + clean(random.Random(2), 9000)), (6001, clean(random.Random(3), 18000))]
    labels = spark.createDataFrame([(i, 1, y, "x") for i, y in label.items()] + [(None, 1, 1, "x"), (3, 0, None, "x"), (99999, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    got = T.toxicity(docs(rows + odd), labels).collect()
    assert len(got) == len(rows + odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.doc_id in label and r.held_out]
    assert {r.doc_id for r in held} == {i for i in label if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert by_id[6000].predicted == 1 and by_id[6001].predicted == 0  # the bad word stands deep in a long text
    assert not by_id[None].held_out
    assert len({by_id[5000 + i].score for i in (0, 1, 2)}) == 1
    assert T.toxicity(docs(rows).filter("false"), labels).count() == 0
    none = T.toxicity(docs(rows[:5]), labels.filter("false")).collect()
    assert {r.score for r in none} == {0.0}
    single = T.toxicity(docs(rows[:5]), labels.filter("toxic = 1")).collect()
    assert {r.score for r in single} == {1.0}


def test_sample_is_bounded_and_keeps_held_out_rows_out(spark, docs, monkeypatch):
    monkeypatch.setattr(T, "POSITIVES", 10)
    monkeypatch.setattr(T, "NEGATIVES", 20)
    rows = [(i, t) for i, (t, _) in enumerate(made(4, 200))]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    texts, label, share = T.training_sample(docs(rows + rows), labels)
    assert (len(texts), label.sum()) == (30, 10) and 0.2 < share < 0.5
    held = {t for i, t in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert not held & set(texts)
