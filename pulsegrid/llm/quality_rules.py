"""Quality rules: divergence of character classes and common words from language references.

``vocabularies`` finds the ``COMMON`` most frequent words of each language label in all of its texts. ``features`` counts character classes and these words in each text, ``references`` sums the counts of all texts by label, and
``judged`` compares each text with every reference by Jensen-Shannon distance (base 2, so 0 to 1): characters, and the label's own
words and the rest. A text is kept if some language is near in both histograms. Distances of short texts are noisy:
each limit is raised by ``NOISE / sqrt(length)`` and no text below ``MIN_WORDS`` is compared. A reference so poor in common words that a text of the same length without
any would be near it too says nothing, except of texts of its own label; so a further language changes no verdict of others, however its texts look.

A reference of n texts has n / (n + 1) of its own shares and the rest of those of all labels. Everything is built of SQL expressions; the only rows that
reach the driver are common words and references, some for each language label; the plan holds them as constants of one array.

Null text counts as empty and is not kept; very long texts count like others (words beyond 2^20 only take the slower way of ``_repeated``); repeated rows are
judged one by one; of words and hashes that tie the lesser comes first; an empty table gives an empty result; only doc_id, text and lang are read, so extra
columns do not matter. Without any label there is no reference and the base rules alone decide.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.shared import let, written

MIN_WORDS = 50
COMMON = 24
#: How many texts of a label the words are counted in: all of them.
SAMPLE = None
CHAR_LIMIT = 0.19
WORD_LIMIT = 0.10
CHAR_NOISE = 1.0
WORD_NOISE = 2.2

# Character classes; what is in none of them is a letter in lower case or another sign.
CLASSES = {
    "upper": r"\p{Lu}",
    "digit": r"\p{Nd}",
    "stop": r"[.,;:'\"()\-]",
    "call": r"[!?]",
    "symbol": r"[#*$%&|<>]",
}
# Letters in lower case and spaces, which need no further look.
PLAIN = r"[a-zß-öø-ÿ \x09-\x0D]+"
POSITION_BITS = 20
CHAR_BINS = len(CLASSES) + 2


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.split(text, pattern, -1)) - 1


def _twice(keys: Column, key) -> Column:
    """The elements of a sorted array whose key a neighbour shares."""
    return F.filter(keys, lambda x, i: (key(F.get(keys, i + 1)) == key(x)) | (key(F.get(keys, i - 1)) == key(x)))


def _repeated(words: Column) -> Column:
    """Words inside a window of three that occurs twice or more.

    Windows are hashed and sorted. The upper bits of the hash with the position below them sort as plain
    longs and leave few candidates; whole 64-bit hashes decide on these. Texts of more words than
    positions have bits go to the second step whole.
    """
    window = lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
    packed = F.transform(
        F.slice(words, 1, F.size(words) - 2),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(-(1 << POSITION_BITS)).bitwiseOR(i),
    )
    candidates = F.when(
        F.size(words) > 1 << POSITION_BITS, F.sequence(F.lit(0).cast("long"), F.size(words) - 3)
    ).otherwise(
        F.transform(
            let(F.sort_array(packed), lambda s: _twice(s, lambda x: F.shiftright(x, POSITION_BITS))),
            lambda x: x.bitwiseAND((1 << POSITION_BITS) - 1),
        )
    )
    positions = F.transform(candidates, lambda p: p.cast("int"))
    keyed = F.transform(positions, lambda p: F.struct(window(p).alias("h"), p.alias("p")))
    hit = let(F.sort_array(keyed), lambda s: F.transform(_twice(s, lambda x: x.h), lambda x: x.p))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(
        F.size(F.array_distinct(F.flatten(F.transform(hit, lambda p: F.array(p, p + 1, p + 2)))))
    )


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[ \x09-\x0D]+", -1), "")


def _common(words: Column, common: list[str]) -> Column:
    """How often each common word occurs: as it stands, capitalised or in capitals."""
    forms = sorted({f for w in common for f in (w, w[:1].upper() + w[1:], w.upper())})
    found = F.filter(words, lambda w: w.isin(forms)) if forms else F.filter(words, lambda w: F.lit(False))
    spaced = F.lower(F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" ")))
    known = F.from_json(F.lit(json.dumps([f" {w} " for w in common])), "array<string>")
    count = lambda t, w: ((F.octet_length(t) - F.octet_length(F.replace(t, w, F.lit("")))) / F.octet_length(w)).cast("long")
    return let(spaced, lambda t: F.transform(known, lambda w: count(t, w)))


def vocabularies(docs: DataFrame) -> dict[str, list[str]]:
    """The most frequent words of each label in all of its texts that pass the base rules, in order."""
    labelled = docs.filter("lang is not null").select("lang", "text")
    labels = [r["lang"] for r in labelled.select("lang").distinct().collect()]
    counts = lambda w: F.struct(w.alias("w"), F.size(w).alias("n_words"), _repeated(w).alias("n_repeat_words"))
    # words are bound once for each text; short texts are left out before their windows are looked at
    bound = lambda w: F.when(F.size(w) >= MIN_WORDS, let(w, counts))
    judged_texts = labelled.select("lang", let(_words(F.coalesce(F.col("text"), F.lit(""))), bound).alias("x")).select("lang", F.explode(F.array("x")).alias("x"))
    passing = judged_texts.filter("x is not null").select("lang", "x.*").filter(~_base_failed())
    forms = passing.select("lang", F.explode("w").alias("word")).groupBy("lang", "word").count()
    each = forms.filter(F.col("word").rlike(r"^\p{L}+$")).groupBy("lang", F.lower("word").alias("word")).agg(F.sum("count").alias("count"))
    best = each.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))).filter(F.col("n") <= COMMON)
    out: dict[str, list[str]] = {lang: [] for lang in sorted(labels)}
    for r in best.orderBy("lang", "n").collect():
        out[r["lang"]].append(r["word"])
    return out


def features(docs: DataFrame, common: list[str], carry: bool = False) -> DataFrame:
    """Counts for each document: those of the base rules, character classes and common words, in order of these.

    With ``carry``, the document's own columns come along as the struct ``row``.
    """
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^ \x09-\x0D]"))
    one = docs.select(
        *row,
        "doc_id",
        "lang",
        let(
            _words(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _repeated(w).cast("long").alias("n_repeat_words"),
                _common(w, common).alias("common"),
            ),
        ).alias("w"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.char_length(text).cast("long").alias("n_chars"),
        let(
            F.regexp_replace(text, PLAIN, ""),
            lambda t: F.array(*[_count(t, p).cast("long") for p in CLASSES.values()]),
        ).alias("classes"),
    )
    symbols = list(CLASSES).index("symbol")
    return one.select(
        *(["row"] if carry else []),
        "doc_id",
        "lang",
        "w.n_words",
        "w.word_chars",
        F.col("classes")[symbols].alias("n_symbols"),
        "n_dup_lines",
        "w.n_repeat_words",
        "n_chars",
        # spaces, and in the last bins the rest
        let(
            F.array_append("classes", F.col("n_chars") - F.col("w.word_chars")),
            lambda c: F.array_append(c, F.col("n_chars") - F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)),
        ).alias("char_bins"),
        F.col("w.common").alias("word_counts"),
    )


def _union(known: dict[str, list[str]]) -> list[str]:
    return sorted({w for words in known.values() for w in words})


def _with_rest(counts: Column, total: Column) -> Column:
    return let(counts, lambda c: F.array_append(c, total - F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)))


def references(counted: DataFrame, known: dict[str, list[str]]) -> dict[str, tuple[list[float], list[int], list[float]]]:
    """For each label: shares of character classes, the places of its common words in ``word_counts``, and shares of these and of other words."""
    if not known:
        return {}
    place = {w: i for i, w in enumerate(_union(known))}
    places = {lang: [place[w] for w in words] for lang, words in known.items()}
    passing = counted.filter(F.col("lang").isNotNull() & ~_base_failed())
    own = F.element_at(F.from_json(F.lit(json.dumps(places)), "map<string,array<int>>"), F.col("lang"))
    sums = [F.sum(F.get("char_bins", F.lit(i))).alias(f"c{i}") for i in range(CHAR_BINS)]
    sums += [F.sum(F.get("own", F.lit(i))).alias(f"w{i}") for i in range(COMMON)]
    own_counts = F.transform(own, lambda p: F.get("word_counts", p)).alias("own")
    rows = passing.select("lang", "char_bins", "n_words", own_counts).groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_words").alias("words"), *sums).orderBy("lang").collect()
    each = passing.select(F.posexplode("word_counts").alias("place", "n")).filter("n > 0").groupBy("place").agg(F.sum("n").alias("n"))
    pooled = {r["place"]: r["n"] for r in each.collect()}  # a row for each common word
    all_words, all_chars = sum(r["words"] for r in rows), [float(sum(r[f"c{i}"] for r in rows)) for i in range(CHAR_BINS)]
    out = {}
    for r in rows:
        chars, mine = [r[f"c{i}"] for i in range(CHAR_BINS)], places[r["lang"]]
        words = [r[f"w{i}"] for i in range(len(mine))]
        words.append(r["words"] - sum(words))
        of_all = [pooled.get(p, 0) for p in mine]
        of_all.append(all_words - sum(of_all))
        share = r["docs"] / (r["docs"] + 1)
        smooth = lambda a, b: [share * x / sum(a) + (1 - share) * y / sum(b) for x, y in zip(a, b)]  # noqa: E731, B023
        out[r["lang"]] = smooth(chars, all_chars), mine, smooth(words, of_all)
    return out


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def distance(bins: Column, total: Column, q: Column) -> Column:
    """Jensen-Shannon distance of counts to shares, 1 for no counts."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(bins, q, lambda n, x: let(n / total, lambda p: part(p, (p + x) / 2) + part(x, (p + x) / 2)))
    sum_ = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), sum_ / 2))).otherwise(1.0)


def _wordless(common: list[float]) -> float:
    """Distance of a text without common words from these shares."""
    part = lambda a, m: a * math.log2(a / m) if a > 0 else 0.0
    p = [0.0] * (len(common) - 1) + [1.0]
    return math.sqrt(max(0.0, sum(part(x, (x + y) / 2) + part(y, (x + y) / 2) for x, y in zip(p, common)) / 2))


def judged(counted: DataFrame, refs: dict[str, tuple[list[float], list[int], list[float]]]) -> DataFrame:
    """Each document with its distances to the nearest language and the verdict; null distances where no reference says anything."""
    base = counted.withColumn("base_failed", _base_failed())
    kept_columns = [c for c in counted.columns if c == "row"] + KEPT
    if not refs:
        return base.select(*kept_columns, F.lit(None).cast("double").alias("char_distance"), F.lit(None).cast("double").alias("word_distance"), (~F.col("base_failed")).alias("kept"))
    char_limit = CHAR_LIMIT + CHAR_NOISE / F.sqrt(F.greatest(F.col("n_chars"), F.lit(1)))
    word_limit = WORD_LIMIT + WORD_NOISE / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    # one constant, so that the plan does not grow with the labels
    shares = json.dumps([{"lang": lang, "chars": chars, "places": places, "common": common, "wordless": _wordless(common)} for lang, (chars, places, common) in sorted(refs.items())])
    known = F.from_json(F.lit(shares), "array<struct<lang:string,chars:array<double>,places:array<int>,common:array<double>,wordless:double>>")
    telling = F.filter(known, lambda r: (r["wordless"] > word_limit) | (r["lang"].eqNullSafe(F.col("lang"))))
    own = lambda r: _with_rest(F.transform(r["places"], lambda p: F.get("word_counts", p)), F.col("n_words"))
    both = lambda r: F.struct(
        distance(F.col("char_bins"), F.col("n_chars"), r["chars"]).alias("c"), distance(own(r), F.col("n_words"), r["common"]).alias("w")
    )
    near = F.transform(
        telling, lambda r: let(both(r), lambda x: F.struct(F.greatest(x["c"] / char_limit, x["w"] / word_limit).alias("worst"), r["lang"].alias("lang"), x["c"].alias("c"), x["w"].alias("w")))
    )
    return base.withColumn("near", F.array_min(near)).select(
        *kept_columns,
        F.round("near.c", 6).alias("char_distance"),
        F.round("near.w", 6).alias("word_distance"),
        (~F.col("base_failed") & F.coalesce(F.col("near.worst") <= 1, F.lit(False))).alias("kept"),
    )


KEPT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _counted(docs: DataFrame, carry: bool = False) -> tuple[DataFrame, dict]:
    known = vocabularies(docs)
    counted = written(features(docs, _union(known), carry))
    return counted, references(counted, known)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text and lang are read) with counts, distances and ``kept``."""
    return judged(*_counted(docs))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns; written once, nothing is shuffled."""
    return judged(*_counted(docs, carry=True)).filter("kept").select("row.*")
