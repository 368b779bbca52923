"""The n-gram join and decontamination against brute force."""

import hashlib
import random

import numpy as np
import pytest
from texts import ALNUM, prose, sample, words

from pulsegrid.llm import decontamination, ngram_join


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    parent[max(find(i), find(j), key=lambda k: (rows[k][0], k))] = min(find(i), find(j), key=lambda k: (rows[k][0], k))
    return sorted(((i, len(s), rows[find(k)][0]) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("small", [32, 2])
def test_components_equal_brute_force(docs, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    rows = sample() + [(None, "one"), (3, "one")]
    got = sorted((tuple(r)[:3] for r in ngram_join.ngram_join(docs(rows)).collect()), key=str)
    assert got == brute_components(rows)


@pytest.mark.parametrize("small", [32, 2])
def test_all_links_equal_brute_force(docs, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 600)
    rows = sample() + [(None, "one")]
    sets = [(i, shingles(t)) for i, t in rows]
    near = lambda x, y: x and y and 100 * len(x & y) >= 80 * len(x | y)
    least = {frozenset(x): min(i for i, y in sets if y == x and i is not None) for _, x in sets if x}
    links = {(a, b) for x, a in least.items() for y, b in least.items() if a > b and near(x, y)}
    assert len(links) > len({a for a, _ in links})  # more than what makes the components
    assert sorted(tuple(r) for r in ngram_join.ngram_links(docs(rows)).collect()) == sorted(links)
    counts = {i: sum(j not in (i, None) and bool(near(x, y)) for j, y in sets) if i is not None else 0 for i, x in sets}
    found = ngram_join.ngram_join(docs(rows)).collect()
    assert {r.doc_id: r.n_links for r in found} == counts
    assert sorted((tuple(r)[:3] for r in found), key=str) == brute_components(rows)


@pytest.mark.parametrize("limits", [dict(SMALL=3, PIVOTS=2, LEAF_ROWS=4, STUCK=0.95, BLOCK_SHINGLES=300), dict(LIGHT_ROWS=20, SMALL=8, PIVOTS=3, LEAF_ROWS=10, STUCK=0.9, BLOCK_SHINGLES=2000)])
def test_regions_of_many_levels_lose_no_link(docs, monkeypatch, limits):
    """One passage in all texts opens one region of many groups, some mutually far."""
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = []
    for k in range(12):
        base = prose(k, 50).split()
        for i in range(9):
            text = list(base)
            for j in range(i % 4):
                text[(7 * i + 13 * j) % len(text)] = f"y{i}"
            rows.append((len(rows), "all of these share one and the same passage " + " ".join(text[: 50 - i % 3])))
    sets = [(i, shingles(t)) for i, t in rows]
    near = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    counts = {i: sum(j != i and near(x, y) for j, y in sets) for i, x in sets}
    # all hashes alike in front of the order: the shared passage is in each prefix
    monkeypatch.setattr(ngram_join, "prefix", lambda x, hot: x)
    found = ngram_join.ngram_join(docs(rows)).collect()
    assert {r.doc_id: r.n_links for r in found} == counts
    assert sorted((tuple(r)[:3] for r in found), key=str) == brute_components(rows)


def test_frequent_shingles_stand_last_by_count():
    hot = ngram_join.Hot(np.array([2, 4, 6, 8, 9], np.uint64), np.array([7, 3, 9, 3, 2]))
    order = ngram_join.prefix(np.arange(1, 21, dtype=np.uint64), hot)
    assert order.tolist() == [1, 3, 5, 7, 10]
    # one rare shingle, then the frequent ones by count, and by hash where counts are equal
    assert ngram_join.prefix(np.array([2, 4, 6, 7, 8, 9], np.uint64), hot).tolist() == [7, 9]
    assert ngram_join.prefix(np.array([2, 4, 6, 8, 9], np.uint64), hot).tolist() == [9, 4]


def test_texts_of_a_stock_of_sentences(docs, monkeypatch):
    """Texts of the same few sentences meet by what follows what, and lose no link."""
    monkeypatch.setattr(ngram_join, "SAMPLE", 1)
    stock = [prose(400 + k, 12) for k in range(40)]
    draw = random.Random(3)
    rows = [(k, " ".join(draw.sample(stock, 10))) for k in range(300)]
    rows += [(300 + k, rows[k][1] + " and more") for k in range(0, 60, 7)]
    table = docs(rows)
    signed = ngram_join.signatures(table)
    members, _ = ngram_join.first_regions(signed, ngram_join._classes(signed))
    # a sentence stands in some 75 texts, a pair of them that follow one another in fewer than 2
    assert max(r["count"] for r in members.groupBy("g").count().collect()) < 40
    assert sorted((tuple(r)[:3] for r in ngram_join.ngram_join(table).collect()), key=str) == brute_components(rows)


def test_rows_of_one_id_are_one_node(docs):
    a, b = prose(1, 40), prose(2, 40)
    found = ngram_join.ngram_join(docs([(1, a), (7, a), (7, b), (9, b), (11, prose(3, 40)), (11, prose(4, 40))])).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in found) == [(1, 1, 1), (7, 1, 1), (7, 1, 1), (9, 1, 1), (11, 11, 0), (11, 11, 0)]


def test_join_of_nothing(docs):
    assert ngram_join.ngram_join(docs(sample()).filter("false")).count() == 0


def brute_hits(rows, items):
    windows = {}
    for i, t in items:
        w = words(t, ALNUM) if i is not None else []
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = words(t, ALNUM), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [2_000_000, 30])
def test_hits_equal_brute_force(spark, docs, monkeypatch, group):
    monkeypatch.setattr(decontamination, "GROUP_WORDS", group)
    long = prose(50, 40)
    items = [(1, long), (2, "zork blip"), (3, "zork BLIP!"), (10, prose(51, 12)), (4, None), (5, "..."), (None, long)]
    rows = sample() + [(900, "x " + long + " y " + long), (901, "Zork, blip zork"), (902, prose(51, 12)[:-3]), (903, " ".join(long.split()[5:20])), (None, "zork blip"), (901, "Zork, blip zork")]
    found = decontamination.decontamination(docs(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r)[:6] for r in found.collect()), key=str) == brute_hits(rows, items)


def test_groups_of_items_keep_repeated_rows(spark, monkeypatch):
    """Rows of equal id and length in several files, met by several groups of items."""
    monkeypatch.setattr(decontamination, "GROUP_WORDS", 12)
    texts = [prose(70, 15), prose(71, 15), prose(72, 15)]
    rows = [(5, t, "c") for t in texts] + [(None, texts[0], "c"), (None, texts[0], "c"), (6, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string").repartition(6)
    items = [(k, t) for k, t in enumerate(texts[:2])] + [(9, prose(73, 15))]
    found = decontamination.decontamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((tuple(r)[:6] for r in found), key=str) == brute_hits([r[:2] for r in rows], items)


def test_near_items_equal_brute_force(spark, docs, monkeypatch):
    items = [(k, prose(80 + k, 9)) for k in range(5)]
    terms = [words(t, ALNUM) for _, t in items]
    rows = [(k, " ".join(prose(200 + k, 3 * k).split() + terms[k % 5][:9:2] + prose(300 + k, 12).split() + terms[k % 5][1::2])) for k in range(20)]
    found = decontamination.decontamination(docs(rows), spark.createDataFrame(items, "item_id long, text string"))
    texts = {i: words(t, ALNUM) for i, t in rows}
    seen = [w for t in texts.values() for w in t]

    def near(text, item):
        # ties in rarity go by hash, so an item counts if its choice of rarest terms is not a tie
        rare = sorted(set(item), key=lambda w: seen.count(w))[:3]
        places = [[p for p, w in enumerate(text) if w == r] for r in rare]
        return all(places) and any(max(x) - min(x) < 30 for x in __import__("itertools").product(*places))

    got = {r.doc_id: r.n_near for r in found.collect()}
    for i, t in texts.items():
        clear = [x for x in terms if len({seen.count(w) for w in sorted(set(x), key=seen.count)[:4]}) == 4 or len(set(x)) <= 3]
        assert got[i] >= sum(near(t, x) for x in clear)
    assert any(got.values())


def test_no_benchmark_hits_nothing(spark, docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontamination.decontamination(docs(sample()), empty).collect()} == {0}
    assert decontamination.decontamination(docs(sample()).filter("false"), empty).count() == 0
