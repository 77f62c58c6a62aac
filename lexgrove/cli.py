"""Jobs: build a graph from local dumps, and time the matcher, graph loading and the title scan.

    python -m lexgrove.cli create-graph DUMPS WIKI OUT [--version latest]
    python -m lexgrove.cli profile-matcher TEXTS PATTERNS
    python -m lexgrove.cli profile-graph-load GRAPH
    python -m lexgrove.cli profile-graph-exec GRAPH TEXTS
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import tokenize
from .operators import titles
from .operators.matcher import match
from .sources import dumps, store


def _timed(df: DataFrame) -> dict:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return {"seconds": round(time.time() - began, 3)}


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return tokenize(store.read_texts(spark, path).withColumnRenamed("path", "doc_id"))


def main(args: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="job", required=True)
    for job, names in (("create-graph", ("dumps", "wiki", "out")), ("profile-matcher", ("texts", "patterns")), ("profile-graph-load", ("graph",)), ("profile-graph-exec", ("graph", "texts"))):
        one = sub.add_parser(job)
        for name in names:
            one.add_argument(name)
        if job == "create-graph":
            one.add_argument("--version", default="latest")
    o = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if o.job == "create-graph":
        graph = dumps.build_graph(spark, o.dumps, o.wiki, o.version)
        store.save_graph(graph, o.out)
        saved = store.load_graph(spark, o.out)
        out = store.make_meta(o.wiki, dumps.resolve_version(dumps.local_versions(o.dumps, o.wiki), o.version), saved)
        store.save_meta(spark, o.out, out)
    elif o.job == "profile-matcher":
        out = _timed(match(_documents(spark, o.texts), store.read_patterns(spark, o.patterns)))
    elif o.job == "profile-graph-load":
        graph = store.load_graph(spark, o.graph)
        out = {"seconds": round(sum(_timed(getattr(graph, t))["seconds"] for t in ("pages", "redirects", "disambiguations", "categories", "edges")), 3)}
    else:
        graph = store.load_graph(spark, o.graph)
        index = titles.title_index(graph.pages.select("title", F.col("id").alias("ord")))
        out = _timed(titles.scan(_documents(spark, o.texts), index))
    print(json.dumps(out))
    return out


if __name__ == "__main__":
    main()
