"""Quality rules, license scan, URL filters, WARC archives and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest
from texts import ALNUM, prose, sample, words

from pulsegrid.llm import license_scan, quality_rules, url_filters, warc


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(w, w[1:], w[2:]))
    twice = Counter(windows)
    covered = {k + j for k, t in enumerate(windows) if twice[t] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_quality_counts_equal_brute_force(docs):
    rows = sample() + [(500, "a b c a b c a b"), (501, "x y z " * 40), (502, "q#1 $ <|> \x0b\x0c z")]
    got = {r.doc_id: tuple(r)[1:7] for r in quality_rules.quality_rules(docs(rows)).collect()}
    assert got == {i: brute_counts(t) for i, t in rows}


def test_quality_verdicts(spark):
    clean = [(i, "The cat sat on the mat and it was a good day for all of them. " * 2 + prose(i, 40), "en") for i in range(60)]
    junk = [(1000, "###".join(prose(99, 80).upper().split()) + " " + " ".join(["A###!!"] * 5 + [f"Z{i}###$$$" for i in range(80)]), "en")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i, *_ in clean)
    assert not got[1000].kept and not got[1000].base_failed
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality_rules.quality_rules(empty).count() == 0


def test_rare_labels_have_a_reference(spark):
    rare = [(2000 + i, "кот сидел на ковре и день был хорош для всех " * 20 + " ".join(f"д{i}о{k}м" for k in range(200)), "ru") for i in range(5)]
    clean = [(i, "The cat sat on the mat and it was a good day for all of them. " * 2 + prose(i, 40), "en") for i in range(60)]
    common = spark.createDataFrame(clean + rare, "doc_id long, text string, lang string")
    known = quality_rules.vocabularies(common)
    assert {"кот", "сидел", "всех"} <= set(known["ru"]) and all(len(w) <= quality_rules.COMMON for w in known.values())
    counted = quality_rules.features(common, sorted({w for words in known.values() for w in words}))
    refs = quality_rules.references(counted, known)
    assert set(refs) == {"en", "ru"} and all(abs(sum(x) - 1) < 1e-9 for chars, _, words in refs.values() for x in (chars, words))
    alone = {r.doc_id: r for r in quality_rules.quality_rules(common.filter("lang = 'ru'")).collect()}
    beside = {r.doc_id: r for r in quality_rules.quality_rules(common).collect()}
    assert {i for i, r in beside.items() if r.kept} >= {i for i, r in alone.items() if r.kept}


def brute_verdicts(rows):
    """kept and both distances of (doc_id, text, lang) rows, from the definitions."""
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    failed = {i: brute_counts(t)[5] for i, t, _ in rows}
    labels = sorted({x for *_, x in rows if x is not None})
    own = {}
    for label in labels:
        first = sorted(zlib.crc32(str(i).encode()) for i, _, x in rows if x == label)[: quality_rules.SAMPLE]
        count = Counter(w.lower() for i, t, x in rows if x == label and not failed[i] and zlib.crc32(str(i).encode()) <= first[-1] for w in tokens(t) if w.isalpha())
        own[label] = [w for w, _ in sorted(count.items(), key=lambda kv: (-kv[1], kv[0]))[: quality_rules.COMMON]]
    words = lambda t, known: [sum(x in (w, w[:1].upper() + w[1:], w.upper()) for x in tokens(t)) for w in known]

    def characters(t):
        kinds = [sum(c.isupper() for c in t), sum(c.isdecimal() for c in t), *[sum(c in k for c in t) for k in (".,;:'\"()-", "!?", "#*$%&|<>", " \t\n\x0b\x0c\r")]]
        return [*kinds, len(t) - sum(kinds)]

    def distance(counts, q):
        p = [x / sum(counts) for x in counts]
        part = lambda a, m: a * math.log2(a / m) if a else 0.0
        return math.sqrt(max(0.0, sum(part(x, (x + y) / 2) + part(y, (x + y) / 2) for x, y in zip(p, q)) / 2))

    shares = lambda x: [v / sum(x) for v in x]
    refs = {}
    passing = [(t, x) for i, t, x in rows if x is not None and not failed[i]]
    for label in labels:
        full = lambda texts: [*(c := [sum(v) for v in zip(*[words(t, own[label]) for t in texts])]), sum(len(tokens(t)) for t in texts) - sum(c)]  # noqa: E731, B023
        mine, every = [t for t, x in passing if x == label], [t for t, _ in passing]
        if mine:
            mix = lambda a, b: [len(mine) / (len(mine) + 1) * x + y / (len(mine) + 1) for x, y in zip(shares(a), shares(b))]  # noqa: E731, B023
            chars = lambda texts: [sum(v) for v in zip(*map(characters, texts))]
            refs[label] = mix(chars(mine), chars(every)), mix(full(mine), full(every))
    out = {}
    for i, t, x in rows:
        best, n = None, len(tokens(t))
        limit = quality_rules.WORD_LIMIT + quality_rules.WORD_NOISE / math.sqrt(max(1, n))
        for label, (c, w) in refs.items():
            if n and (distance([0] * (len(w) - 1) + [1], w) > limit or label == x):
                counts = words(t, own[label])
                found = (distance(characters(t), c), distance([*counts, n - sum(counts)], w))
                worst = max(found[0] / (quality_rules.CHAR_LIMIT + quality_rules.CHAR_NOISE / math.sqrt(max(1, len(t)))), found[1] / limit)
                best = min(best or (9, label, found), (worst, label, found))
        out[i] = (not failed[i] and best is not None and best[0] <= 1, *(best[2] if best else (None, None)))
    return out


def labelled(n=40):
    rng = random.Random(2)
    common = {"en": "the of and to in is for".split(), "xx": "zum der eine bei nach".split()}
    rows = []
    for i in range(n):
        lang = ["en", "en", "xx", None][i % 4]
        text = [w for k in range(rng.randint(30, 200)) for w in (rng.choice(common[lang or "en"]).capitalize() if k % 9 == 0 else rng.choice(common[lang or "en"]), prose(1000 * i + k, 1) + ("." if k % 7 == 0 else ""))]
        rows.append((i, " ".join(text), lang))
    return rows + [(900 + i, prose(i, 300), None) for i in range(8)] + [(950, "AB#1 " * 80, "en"), (951, None, "en"), (952, "", None)]


def test_verdicts_equal_brute_force(spark):
    rows = labelled()
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    for i, (kept, chars, words_) in brute_verdicts(rows).items():
        assert got[i].kept == kept, i
        if kept:
            assert (got[i].char_distance, got[i].word_distance) == (pytest.approx(chars, abs=2e-6), pytest.approx(words_, abs=2e-6))
    assert not any(got[900 + i].kept for i in range(8)) and sum(r.kept for r in got.values()) > 30


def test_a_further_label_changes_no_verdict(spark):
    """Texts of one more label, be they all of different words, let nothing through that was rejected and reject nothing that was kept."""
    schema = "doc_id long, text string, lang string"
    rows = labelled()
    alone = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, schema)).collect()}
    for kind in (lambda i: prose(5000 + i, 300), lambda i: "кот и дом на горе " * 20 + prose(6000 + i, 200)):
        more = rows + [(2000 + i, kind(i), "ru") for i in range(25)]
        beside = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(more, schema)).collect()}
        assert {i: beside[i] for i in alone} == alone


def test_license_places(docs):
    rows = sample() + [(600, "All rights RESERVED. x all rights\nreserved"), (601, "Licensed under CC BY-NC 4.0."), (602, "GNU General Public License"), (603, prose(1, 30) + "\nReleased under the MIT License.\n" + prose(2, 30))]
    got = {r.doc_id: r for r in license_scan.license_scan(docs(rows)).collect()}
    for i, t in rows:
        w = words(t, ALNUM)
        hits = [(p, label) for phrase, label in license_scan.PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), min((p for p, _ in hits), default=None), max((p for p, _ in hits), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits}))
        # every line that holds enough of a template is found
        best = 0.0
        for line in (t or "").split("\n"):
            have = set(words(line, ALNUM))
            for _, template in license_scan.TEMPLATES:
                want = set(words(template, ALNUM))
                share = len(have & want) / len(want)
                best = max(best, share if share >= license_scan.THRESHOLD else 0.0)
        assert r.score == (1.0 if hits else best)
    assert got[601].labels == "cc-by,cc-by-nc" and got[603].labels == "mit"
    assert license_scan.license_scan(docs(rows).filter("false")).count() == 0


def test_wrapped_and_several_licenses(docs):
    rows = [
        (1, "x\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files\ny"),
        (2, "# Redistribution and use in source and binary forms,\n# with or without modification, are permitted\n# provided that the following conditions are met:"),
        (3, "Licensed under CC BY-NC 4.0. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation"),
        (4, "Permission is hereby granted, free of charge, to any person obtaining a copy\n\nof this software and associated documentation files"),
    ]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.license_scan(docs(rows)).collect()}
    assert got == {1: ("mit", 1.0), 2: ("bsd", 1.0), 3: ("cc-by,cc-by-nc,mit", 1.0), 4: ("", 0.0)}


def brute_blocks(text):
    """All runs of words against all templates: labels of those that no better one covers, and the best score."""
    found = []
    sets = [(set(words(t, ALNUM)), len(words(t, ALNUM)), label) for label, t in license_scan.TEMPLATES]
    for paragraph in re.split(r"\n(?:[^a-zA-Z0-9\x80-\U0010ffff\n]*\n)+", text):
        w = words(paragraph, ALNUM)
        for k, (want, length, label) in enumerate(sets):
            for a in range(len(w)):
                for b in range(a + 1, min(len(w), a + int(length / 0.8 + 1e-9)) + 1):
                    common = want & set(w[a:b])
                    if 10 * len(common) >= 8 * len(want):
                        found.append((paragraph, a, b, k, common, len(common) / len(want)))
    kept = [x for x in found if not any(y[0] == x[0] and y[1] < x[2] and y[2] > x[1] and y[3] != x[3] and y[5] > x[5] and y[4] >= x[4] for y in found)]
    return ",".join(sorted({sets[x[3]][2] for x in kept})), max((x[5] for x in kept), default=0.0)


def test_blocks_equal_brute_force(docs):
    import random

    rows = []
    for i in range(60):
        rng = random.Random(i)
        w = words(license_scan.TEMPLATES[i % len(license_scan.TEMPLATES)][1], ALNUM)
        for _ in range(rng.randrange(4)):  # lost words, strange ones, changed places
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["qqq"], ["qqq", w[k]]])
        if i % 5 == 0:
            w = [x for y in w for x in ([y] + prose(i, rng.choice([0, 1, 3])).split())]
        text = "".join(x + rng.choice([" ", " ", " ", "\n", ", "]) for x in w)
        rows.append((i, prose(i, 5) + rng.choice(["\n", " ", "\n\n"]) + text + rng.choice(["\n", "\n--\n"]) + prose(i + 100, 4)))
    strewn = "Licensed {} under {} CC {} BY {} 4 {} 0".format(*[prose(k, 90) for k in range(5)])
    rows += [(900, strewn), (901, "x\nReleased\nunder the\nMIT License.")]
    got = {r.doc_id: r for r in license_scan.license_scan(docs(rows)).collect()}
    want = {i: brute_blocks(t) for i, t in rows}
    for i, _ in rows:
        more = set(got[i].labels.split(",")) - set(got[i].base_labels.split(","))
        assert more <= set(want[i][0].split(",")) and set(want[i][0].split(",")) <= set(got[i].labels.split(",")), i
        assert got[i].score == (1.0 if got[i].n_base else want[i][1])
    assert want[900][1] == 0 and want[901][0] == "mit" and sum(bool(x) for x, _ in want.values()) > 20


def brute_url(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), raw)
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(h + p), h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/7x?q#f", "https://a.example.com/en/8", "x://net/de/1", "http://example.net/de/8", "http://b.org/es/", "http://morg/es/", "no scheme", None, "", "http://é.com?x=1&y", "http://h#f"]
    pages = [(i, u, "h") for i, u in enumerate(urls * 2)] + [(100 + i, f"http://bad.site/offer/{i}", "h") for i in range(60)] + [(200 + i, f"http://fine.site/news/{i}", "h") for i in range(60)]
    labels = [(i, 0 if i < 200 else 1, 0, "clash") for i in range(100, 260)] + [(None, 1, 0, ""), (201, None, None, "")]
    df = spark.createDataFrame(pages, "page_id long, url string, key string")
    found = url_filters.url_filters(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, words string"))
    got = sorted((tuple(r)[:5] for r in found.collect()), key=str)
    assert len(got) == len(pages)
    for page_id, host, path, rule, verdict in got:
        want = brute_url(pages[[p for p, *_ in pages].index(page_id)][1])
        assert (host, path, rule) == want[:3]
        assert verdict == (want[3] or ("block" if host == "bad.site" else "allow"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert url_filters.url_filters(df.filter("false"), none).count() == 0


def test_mined_rules_equal_brute_force(spark):
    """Words that always occur together make no rules of their subsets, and each of them alone matches."""
    crowd = "/".join("w" + chr(97 + i % 26) * (1 + i // 26) for i in range(40))
    urls = [f"http://bad.site/{crowd}/{'odd' if i % 3 else 'even'}" for i in range(60)] + [f"http://fine.site/news/{'odd' if i % 2 else 'even'}" for i in range(90)]
    urls += [f"http://mixed.site/{'a/b' if i % 4 else 'a/c'}" for i in range(80)]
    bad = [i < 60 or (i >= 150 and i % 4 != 0) for i in range(len(urls))]
    asked = ["http://x.y/" + crowd.split("/")[7], "http://bad.z/", "http://other.site/b/a", "http://q.r/c", "http://fine.q/news/odd", "http://q.r/nothing"]
    pages = spark.createDataFrame(list(enumerate(urls + asked)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not b), 0) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    split = url_filters.parts(pages).select("page_id", url_filters._words().alias("words"))
    sets = {r.page_id: set(r.words) for r in split.collect()}
    base = sum(bad) / len(bad)
    held = {}  # confidence of the sets of one or two words that make rules
    for size in (1, 2):
        for few in {c for i in range(len(urls)) for c in combinations(sorted(sets[i]), size)}:
            on = [i for i in range(len(urls)) if sets[i] >= set(few)]
            sure = sum(bad[i] for i in on) / len(on)
            if sum(bad[i] for i in on) >= url_filters.MIN_PAGES and sure >= url_filters.MIN_CONFIDENCE and sure / base >= url_filters.MIN_LIFT:
                held[few] = sure
    best = {i: max((c for few, c in held.items() if set(few) <= s), default=None) for i, s in sets.items()}
    got = {r.page_id: r.confidence for r in url_filters.url_filters(pages, labels).collect()}
    assert got == pytest.approx(best)
    assert best[len(urls)] == 1.0 and best[len(urls) + 5] is None


def test_words_that_occur_together_almost_always(spark):
    """Twenty words, each absent from one page of its own: each is a rule by itself, and none of their million sets is mined."""
    words_ = [f"w{chr(97 + i)}" for i in range(20)]
    urls = ["http://bad.site/" + "/".join(w for k, w in enumerate(words_) if k != i) for i in range(300)] + [f"http://fine.site/{'news' if i % 2 else 'home'}/x" for i in range(300)]
    asked = [f"http://q.r/{w}" for w in words_] + ["http://q.r/news"]
    pages = spark.createDataFrame(list(enumerate(urls + asked)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 300), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    rules = url_filters.mined_rules(url_filters.parts(pages).withColumn("words", url_filters._words()), labels).collect()
    assert {tuple(r.words) for r in rules} == {(f"path:{w}",) for w in words_} | {("host:bad",)} and {r.confidence for r in rules} == {1.0}
    assert {r.lift for r in rules} == {2.0} and {round(r.support * 600) for r in rules} == {299, 300}
    got = {r.page_id: r.verdict for r in url_filters.url_filters(pages, labels).collect()}
    assert all((got[i] == "block") == (i < 300 or 600 <= i < 620) for i in got)


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize("split", ["128m", "4000"])
def test_archive_round_trip(spark, split):
    big, shared = "z" * 1200, "é" * 600
    rows = [(1, "http://a/\r\nb", "abc\r\n\r\n" + FAKE + "tail"), (2, None, None), (3, "u", ""), (None, "u", shared), (4, "u", shared), (5, "u", shared), (6, "u", big), (7, "u", big), (7, "u", big)]
    rows += [(8, "u", "\r\n\r\n" + FAKE + "\r\n\r\n" + FAKE + "x"), (9, "u", "\r\n\r\nWARC/1.0\r\n"), (10, "u", "s"), (11, "u", "s"), (12, "é", "\r\n\r\n")] + [(20 + i, "u", prose(i, 300)) for i in range(30)]
    most = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 1000:
            most[h] = max(p, most.get(h, p))
    want = []
    for p, _, h in rows:
        body = (h or "").encode()
        again = h in most and most[h] != p
        want.append((p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", most[h] if again else None))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
        found = warc.round_trip(pages).collect()
        assert warc.round_trip(pages.filter("false")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(want, key=str)
    assert all(r.verified for r in found)


def test_archives_split_anew_between_scans(spark):
    """Files are cut in another way when executors come or go."""
    rows = [(i, "u", f"{i}\r\n\r\n" + FAKE * (1 + i % 3) + "x" * (37 * i)) for i in range(24)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    path = warc.shared_dir(spark)
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        found = warc.written(warc.candidates(spark, path))
        records = warc.reachable(found)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        whole = warc._joined_payloads(spark, path, records, found).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r.whole for r in whole) == sorted(hashlib.sha1(h.encode()).hexdigest() for _, _, h in rows)


def test_sql_equals_the_queries(spark, sf_dir):
    import duckdb

    from pulsegrid.llm import queries

    db = duckdb.connect()
    for name in ("documents", "pages"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, sf_dir)
        want = db.execute(sql)
        names = [c[0] for c in want.description]
        order = [names.index(c) for c in got.columns]
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str), name


def test_pipeline_keeps_what_plain_stages_keep(spark, sf_dir):
    import corpus_pipeline
    from test_similarity import brute_components, brute_hits

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()}
    texts = [(r.doc_id, r.text) for r in docs.collect() if judged[r.doc_id]]
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in texts)
    from pulsegrid.llm.language_id import language_id
    from pulsegrid.llm.shared import written

    kept = written(kept)
    gone = {r.doc_id for r in language_id(kept).collect() if r.rejected}
    texts = sorted((i, t) for i, t in texts if i not in gone)
    alone = {i for i, _, c in brute_components(texts) if i == c}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {i for i, *_, hit in brute_hits([x for x in texts if x[0] in alone], items) if not hit}
    final = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in final.collect()} == clean


def test_pipeline_of_odd_repeated_and_clashing_rows(spark, sf_dir):
    """Nulls in every column, repeats, a long text and columns of the operators' own names: each stage keeps what it should, and an empty table stays empty."""
    import corpus_pipeline

    good = {i: t for i, t, lang in labelled(24) if lang and i < 100}
    long = " ".join(t for i, t, lang in labelled(800) if lang == "en" and i < 900)
    assert len(long) > 1 << 18  # more than one slice of a worker
    rows = [(i, t, "en" if i % 4 < 2 else "xx") for i, t in good.items()]
    rows += [(None, good[0], "en"), (0, good[0], "en"), (500, good[1], None), (501, None, "en"), (502, "", "en"), (503, " \n", None), (504, "one", "en"), (505, long, "en")]
    full = [(i, t, x, None if k % 3 else "s", k, "clash", k, 0.5, True) for k, (i, t, x) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, n_words long, score double, kept boolean"
    docs = spark.createDataFrame(full, schema).repartition(3)
    for table_ in (docs, docs.filter("false")):
        kept, sizes = table_, []
        for name, stage in corpus_pipeline.STAGES:
            kept = corpus_pipeline.written(stage(spark, kept, sf_dir))
            sizes.append(kept.count())
            if name != corpus_pipeline.STAGES[-1][0]:
                assert kept.columns == docs.columns
        if table_ is docs:
            ids = [r.doc_id for r in kept.collect()]
            assert sizes == sorted(sizes, reverse=True) and sizes[0] >= len(good)
            assert not {501, 502, 503, 504} & set(ids) and {505, 1, 2, 4} <= set(ids)
            assert ids.count(0) <= 1 and 500 not in ids  # copies of other texts
        else:
            assert sizes == [0] * 5


def test_common_words_come_from_all_texts(spark):
    """Words that only the texts beyond the first 300 (by CRC-32 of doc_id) have count like others."""
    ids = sorted(range(420), key=lambda i: zlib.crc32(str(i).encode()))
    rows = [(i, prose(i, 60) + (" später" * 9 if k >= 320 else "") + f" {prose(i + 1, 40)}", "xx") for k, i in enumerate(ids)]
    known = quality_rules.vocabularies(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    failed = {i: brute_counts(t)[5] for i, t, _ in rows}
    count = Counter(w.lower() for i, t, _ in rows if not failed[i] for w in t.split() if w.isalpha())
    assert known["xx"] == [w for w, _ in sorted(count.items(), key=lambda kv: (-kv[1], kv[0]))[: quality_rules.COMMON]]
    assert "später" in known["xx"]


def test_each_stage_sets_its_workers_up_first(spark, sf_dir, monkeypatch):
    """Else the workers of the first stages have other settings than those of later ones and stay beside them."""
    import corpus_pipeline

    class Called(Exception):
        pass

    def seen(*_):
        raise Called(spark.sparkContext.environment["PYTHONPATH"])

    for name in ("kept_documents", "language_id", "ngram_join", "decontamination", "encoded"):
        monkeypatch.setattr(corpus_pipeline, name, seen)
    for _, stage in corpus_pipeline.STAGES:
        monkeypatch.setitem(spark.sparkContext.environment, "PYTHONPATH", "")
        with pytest.raises(Called) as told:
            stage(spark, None, sf_dir)
        assert str(told.value)
