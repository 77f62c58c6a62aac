"""Pipes by name: each makes a transform of a DataFrame of documents (doc_id, text), for df.transform(...).

A pipe adds a column to the documents, so that pipes chain; tokens come first, then sentences, then abbreviations, then labels.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators import abbrs, clusters, labels, phrases, sents, titles

Transform = Callable[[DataFrame], DataFrame]


def _gathered(docs: DataFrame, spans: DataFrame, to: str) -> DataFrame:
    """docs with the rows of spans (doc_id, ...) as a sorted array."""
    fields = [c for c in spans.columns if c != "doc_id"]
    arrays = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(to))
    joined = docs.join(arrays, "doc_id", "left")
    return joined.withColumn(to, F.coalesce(to, F.array().cast(dict(arrays.dtypes)[to])))


def _tokens() -> Transform:
    return tokenize


def _sentences() -> Transform:
    return sents.with_sentences


def _abbreviations() -> Transform:
    return abbrs.with_abbreviations


def _phrases(name: str = "phrases", patterns: list[list[dict]] | None = None) -> Transform:
    return lambda docs: _gathered(docs, phrases.phrases(docs, patterns or [], name), name)


def _noun_phrases() -> Transform:
    return _phrases("noun_phrases", [phrases.NOUN_PHRASE])


def _verb_phrases() -> Transform:
    return _phrases("verb_phrases", [phrases.VERB_PHRASE])


def _labels(labelings: list[tuple[str, list[list[dict]]]] | None = None, only_longest: bool = False, validate: bool = False) -> Transform:
    rules = labels.label_rules(labelings or [], validate)

    def run(docs: DataFrame) -> DataFrame:
        found = abbrs.abbreviations(docs) if "abbrs" in docs.columns else None
        return _gathered(docs, labels.labelings(docs, rules, found, only_longest), "labelings")

    return run


def _title_spans(index: DataFrame | None = None, submatches: bool = True) -> Transform:
    def run(docs: DataFrame) -> DataFrame:
        asked = titles.lookup_words(docs) if {"tag", "lemma"} <= set(docs.columns) else docs
        return _gathered(docs, (titles.sub_matches if submatches else titles.scan)(asked, index), "title_spans")

    return run


def _clusters(vectors: DataFrame | None = None, min_score: float | None = None) -> Transform:
    """docs with chunks (array of start, end); vectors (token, vec)."""

    def run(docs: DataFrame) -> DataFrame:
        chunks = docs.select("doc_id", "words", F.posexplode("chunks").alias("ord", "c")).select("doc_id", "ord", F.transform(F.slice("words", F.col("c.start") + 1, F.col("c.end") - F.col("c.start")), F.lower).alias("words"))
        vec = clusters.chunk_vectors(chunks, vectors, ["doc_id", "ord"])
        named = chunks.join(vec, ["doc_id", "ord"]).select("doc_id", "ord", F.array_join("words", " ").alias("text"), "vec")
        found = clusters.cluster(clusters.first_by_key(named).select("doc_id", "key", "vec"), "doc_id", min_score)
        return _gathered(docs, found.select("doc_id", "members"), "cluster_chunks")

    return run


PIPES: dict[str, Callable[..., Transform]] = {
    "tokens": _tokens,
    "sentences": _sentences,
    "abbreviations": _abbreviations,
    "labels": _labels,
    "phrases": _phrases,
    "noun_phrases": _noun_phrases,
    "verb_phrases": _verb_phrases,
    "title_spans": _title_spans,
    "clusters": _clusters,
}


def pipe(name: str, **options: Any) -> Transform:
    if name not in PIPES:
        raise ValueError(f"no pipe {name!r}; there are {', '.join(PIPES)}")
    return PIPES[name](**options)


def chain(docs: DataFrame, *pipes: str | tuple[str, dict[str, Any]]) -> DataFrame:
    """docs through pipes in turn; each a name, or a name and its options."""
    for p in pipes:
        name, options = (p, {}) if isinstance(p, str) else p
        docs = docs.transform(pipe(name, **options))
    return docs
