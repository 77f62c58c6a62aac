"""Labels: named rules over tokens, labels that pass between an abbreviation and its long form, and overlaps resolved.

Results for odd input: documents without words have no labels; rows that repeat an id are labelled each, with their own texts; a null doc_id's labels stay, but pass nothing on;
columns that aren't named here aren't read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spans
from .matcher import match
from .rules import RuleSet


def label_rules(labels: list[tuple[str, list[list[dict]]]], validate: bool = False) -> RuleSet:
    out = RuleSet(validate)
    for label, patterns in labels:
        out.add(label, patterns)
    return out


def labelled(docs: DataFrame, rules: RuleSet, key: str = "doc_id") -> DataFrame:
    """key, start, end, label, text of all matches."""
    return match(docs, rules, key, text=True).select(key, "start", "end", F.col("rule").alias("label"), "text")


def pass_through_abbreviations(labels: DataFrame, abbrs: DataFrame) -> DataFrame:
    """labels (doc_id, start, end, label, text) and a span for each pair of abbrs of which only one side's text is labelled; a text with several labels passes on
    the one that is last in the order (start, longest first, label)."""
    last = Window.partitionBy("doc_id", "text").orderBy(F.col("start").desc(), "end", F.col("label").desc())
    by_text = labels.select("doc_id", "text", "label", F.row_number().over(last).alias("k")).where("k = 1")
    side = lambda s: by_text.select("doc_id", F.col("text").alias(f"{s}_text"), F.col("label").alias(f"{s}_label"))
    both = abbrs.join(side("short"), ["doc_id", "short_text"], "left").join(side("long"), ["doc_id", "long_text"], "left")
    # Both directions of one join: a pair passes its label on one way at most.
    passed = lambda to, of: F.when(F.col(f"{to}_label").isNull() & F.col(f"{of}_label").isNotNull(), F.struct(F.col(f"{to}_start").alias("start"), F.col(f"{to}_end").alias("end"), F.col(f"{of}_label").alias("label"), F.col(f"{to}_text").alias("text")))
    new = both.select("doc_id", F.coalesce(passed("short", "long"), passed("long", "short")).alias("new")).where("new is not null")
    return labels.unionByName(new.select("doc_id", "new.start", "new.end", "new.label", "new.text"))


def labelings(docs: DataFrame, rules: RuleSet, abbrs: DataFrame | None = None, longest: bool = False) -> DataFrame:
    """doc_id, start, end, label."""
    found = labelled(docs, rules)
    if abbrs is not None:
        found = pass_through_abbreviations(found, abbrs)
    found = found.select("doc_id", "start", "end", "label")
    return spans.only_longest(found) if longest else found
