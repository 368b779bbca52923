"""A corpus pipeline of five stages; each takes the documents that its predecessor kept.

Decisions go by doc_id: rows with the same doc_id stay or go together, except that of equal rows the third stage
keeps one. A null doc_id is judged like any other by the first two stages and stays in the others. Extra columns of
the input are carried through all but the last stage. Null, empty and short texts go in the first stage, which asks for 50 words; very
long texts are judged and encoded whole; of a group of near duplicates the least doc_id stays, so ties do not arise; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.bpe import encoded
from pulsegrid.llm.decontamination import decontamination
from pulsegrid.llm.language_id import language_id
from pulsegrid.llm.ngram_join import ngram_join
from pulsegrid.llm.quality_rules import kept_documents
from pulsegrid.llm.shared import importable, table, written

# The operators' results depend on all of the text, so no SQL states the rows; tests hold run() against brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose doc_id is not in ``ids``, a written table, so that Spark knows whether it is small."""
    gone = written(ids.select(F.col("doc_id").alias("gone_id")).distinct())
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")


def quality(spark, docs, sf_dir):
    return kept_documents(docs)


def language(spark, docs, sf_dir):
    return _without(docs, language_id(docs).filter("rejected"))


def near_duplicates(spark, docs, sf_dir):
    found = written(ngram_join(docs))
    kept = _without(docs, found.filter("doc_id <> component_id"))
    twice = found.groupBy("doc_id").count().filter("count > 1")
    return kept if twice.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def benchmark(spark, docs, sf_dir):
    return _without(docs, decontamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated and doc_id is not null"))


def tokens(spark, docs, sf_dir):
    return encoded(docs)


def _ready(stage):
    """A stage with the workers' settings made before its first job: workers of other settings would stay idle beside those of later stages and hold their memory."""

    def ready(spark, docs, sf_dir):
        importable(spark)
        return stage(spark, docs, sf_dir)

    return ready


STAGES = [
    ("quality rules", _ready(quality)),
    ("language identification", _ready(language)),
    ("n-gram Jaccard join", _ready(near_duplicates)),
    ("benchmark decontamination", _ready(benchmark)),
    ("byte-pair encoding", _ready(tokens)),
]


def run(spark, sf_dir):
    """All stages in turn; each result is written as Parquet and read again as the next stage's documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
