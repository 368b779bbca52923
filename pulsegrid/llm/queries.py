"""Queries of the training-data operators, by name: each applies one operator to its whole table."""

from __future__ import annotations

from pulsegrid.llm.shared import table


def op1_warc(spark, sf_dir):
    from pulsegrid.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op2_ngram_join(spark, sf_dir):
    from pulsegrid.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    from pulsegrid.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark, sf_dir):
    from pulsegrid.llm.lm_scoring import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op5_license_scan(spark, sf_dir):
    from pulsegrid.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op6_url_filters(spark, sf_dir):
    from pulsegrid.llm.url_filters import url_filters

    return url_filters(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_bpe(spark, sf_dir):
    from pulsegrid.llm.bpe import encoded

    return encoded(table(spark, sf_dir, "documents"))


def op8_language_id(spark, sf_dir):
    from pulsegrid.llm.language_id import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    from pulsegrid.llm.token_counts import LIMITS, token_counts

    return token_counts(table(spark, sf_dir, "documents"), limits=LIMITS)


def op10_decontamination(spark, sf_dir):
    from pulsegrid.llm.decontamination import decontamination

    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_spans")


def op11_periodic_runs(spark, sf_dir):
    from pulsegrid.llm.periodic_runs import periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents"))


def op12_toxicity(spark, sf_dir):
    from pulsegrid.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_whitening(spark, sf_dir):
    from pulsegrid.llm.whitening import whitening

    return whitening(table(spark, sf_dir, "embeddings"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Pages as records: equal payloads of 1000 bytes and more are stored once, with the largest page_id.
OP1 = """WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS most FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> most THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> most THEN most END AS refers_to, url, TRUE AS verified FROM m"""

#: All pairs of documents by their shared shingles, and what each document reaches.
OP2 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT p.a, p.b, c = x.n AND c = y.n AS equal FROM pairs p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, (SELECT min(b) FROM reached r WHERE r.a = d.doc_id)) AS component_id,
  least(d.doc_id, (SELECT min(b) FROM links l WHERE l.a = d.doc_id AND l.equal)) AS class_id, (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""

#: Words that equal the word q places on make runs where enough of them follow one another; the smallest q of equal stretches counts.
OP11 = r"""WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: list_concat([ascii(ch)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
    lambda x, v: CASE WHEN v >= 0 THEN xor(x, v) ELSE xor(x >> 1, 3988292384 * (x & 1)) END)) AS h FROM documents),
d AS (SELECT doc_id, ws AS original, len(ws) AS n, coalesce(h % 10 = 0 AND len(ws) > 0, FALSE) AS planted, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a, h // 10 AS g FROM c),
e AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM d),
t AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(0, n), lambda i: original[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE original END AS ws FROM e),
u AS (SELECT doc_id, n, unnest(ws) AS w, unnest(range(0, n)) AS i FROM t),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, s, m + q AS len, min(q) AS q FROM stretches WHERE m >= q AND m + q >= 12 GROUP BY doc_id, s, m + q),
r AS (SELECT doc_id, count(*) AS k, list({'s': s, 'len': len, 'q': q} ORDER BY s, q) AS rs, list({'s': s, 'len': len, 'q': q} ORDER BY len DESC, s, q)[1] AS best,
  string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS told FROM runs GROUP BY doc_id)
SELECT t.doc_id, coalesce(r.k, 0) AS n_runs, r.best.s AS start, r.best.len AS length, r.best.q AS period, 1000 * r.best.len // r.best.q AS exponent_milli, sha256(coalesce(r.told, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN r.rs IS NULL THEN t.ws ELSE list_transform(list_filter(range(0, t.n), lambda i: len(list_filter(r.rs, lambda x: i >= x.s + x.q AND i < x.s + x.len)) = 0), lambda i: t.ws[i + 1]) END, ' ')) AS collapsed_sha256
FROM t LEFT JOIN r USING (doc_id)"""


def oracle_sql():
    """SQL of the operators that it can express: the others learn models, or use a tokenizer or a sample."""
    return {"op1_warc": OP1, "op2_ngram_join": OP2, "op11_periodic_runs": OP11}
