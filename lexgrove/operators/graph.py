"""The page and category graph: built from tables of dump rows, and asked for pages, redirects, categories and neighbours.

A graph is five tables, kept together in a PageGraph: pages, redirects, disambiguations and categories by title, and edges (src, dst) from pages and subcategories to their categories. Building is joins and
first-wins aggregations; questions are joins too, each for a whole table of titles or ids at once. ``ord`` columns say in which order the rows were in the dump.

Results for odd input: rows with a null id or title match nothing; repeated rows count once; titles asked for twice are answered twice; empty tables give empty answers. Names that begin with an underscore are the
operators' own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import cut

PAGE, CATEGORY = "0", "14"


@dataclass
class PageGraph:
    pages: DataFrame  # title, id
    redirects: DataFrame  # title, target_id
    disambiguations: DataFrame  # title, id
    categories: DataFrame  # title, id; titles begin with "Category:"
    edges: DataFrame  # src, dst


def props_by_page(props: DataFrame) -> DataFrame:
    """(id, prop, value): of several values of a property the first one."""
    return props.groupBy("id", "prop").agg(F.min_by("value", "ord").alias("value"))


def hidden(props: DataFrame) -> DataFrame:
    return props.where(F.col("prop").isin("hiddencat", "noindex")).select("id").distinct()


def kept_pages(page: DataFrame, props: DataFrame) -> DataFrame:
    """page (ns, id, title, ord) of the two namespaces, without hidden pages."""
    return page.where(F.col("ns").isin(PAGE, CATEGORY)).join(hidden(props), "id", "left_anti")


def disambiguation_pages(kept: DataFrame, props: DataFrame) -> DataFrame:
    """(title, id): the first of each title."""
    marked = props.where("prop = 'disambiguation'").select("id").distinct()
    return kept.join(marked, "id", "left_semi").groupBy("title").agg(F.min_by("id", "ord").alias("id"))


def article_pages(kept: DataFrame) -> DataFrame:
    """(title, id): the last of each title."""
    return kept.where(F.col("ns") == PAGE).groupBy("title").agg(F.max_by("id", "ord").alias("id"))


def category_pages(kept: DataFrame) -> DataFrame:
    return kept.where(F.col("ns") == CATEGORY).groupBy(F.concat(F.lit("Category:"), F.col("title")).alias("title")).agg(F.max_by("id", "ord").alias("id"))


def resolved_redirects(redirect: DataFrame, kept: DataFrame, articles: DataFrame) -> DataFrame:
    """redirect (source_id, target_title, ord) as (title, target_id), where the source is a kept article and the target an article; the first of each title."""
    source = kept.where(F.col("ns") == PAGE).select(F.col("id").alias("source_id"), "title")
    target = articles.select(F.col("title").alias("target_title"), F.col("id").alias("target_id"))
    return redirect.join(source, "source_id").join(target, "target_title").groupBy("title").agg(F.min_by("target_id", "ord").alias("target_id"))


def collapse_redirects(redirects: DataFrame, articles: DataFrame, rounds: int = 32) -> DataFrame:
    """Redirects to the end of their chains, by pointer jumping: each round doubles the reach, and is checkpointed. A redirect in a cycle stays as it was.

    2^rounds is the longest chain that is followed to its end."""
    names = articles.select("id", F.col("title").alias("_title"))
    # Pointers between titles; an end of a chain points nowhere.
    jump = cut(redirects.join(names, redirects["target_id"] == names["id"], "left").select("title", "target_id", F.col("_title").alias("to")))
    first, left = jump, None
    for _ in range(rounds):
        on = jump.select(F.col("title").alias("to"), F.col("target_id").alias("_target"), F.col("to").alias("_to"))
        moved = jump.join(on, "to", "left")
        jump = cut(moved.select("title", F.coalesce("_target", "target_id").alias("target_id"), F.when(F.col("_target").isNotNull(), F.col("_to")).alias("to"), F.col("_target").isNotNull().alias("moved")))
        moving = jump.where("moved").count()
        jump = jump.drop("moved")
        if not moving:
            break
        if moving == left:  # only cycles go on; once all that is left is cycles, the count stands still
            still = jump.join(jump.select(F.col("title").alias("to")), "to", "left_semi").select("title")
            stuck = cut(still)
            if stuck.count() == moving and _all_in_cycles(stuck, first):
                return jump.join(stuck, "title", "left_anti").select("title", "target_id").unionByName(first.join(stuck, "title", "left_semi").select("title", "target_id"))
        left = moving
    return jump.select("title", "target_id")


def _all_in_cycles(stuck: DataFrame, first: DataFrame) -> bool:
    """Whether every stuck title's own target is stuck too: then none of them ever reaches an end."""
    own = first.join(stuck, "title", "left_semi")
    return own.join(stuck.select(F.col("title").alias("to")), "to", "left_anti").isEmpty()


def category_edges(links: DataFrame, kept: DataFrame, articles: DataFrame, categories: DataFrame) -> DataFrame:
    """links (type, source_id, target_title) as edges (src, dst): the target title has to be an article's and a kept category's; a page has to be a kept article."""
    target = categories.select(F.expr("substring(title, 10)").alias("target_title"), F.col("id").alias("dst")).join(articles.select(F.col("title").alias("target_title")), "target_title", "left_semi")
    sources = kept.where(F.col("ns") == PAGE).select(F.col("id").alias("source_id"), F.lit(True).alias("_page"))
    got = links.where(F.col("type").isin("page", "subcat")).join(target, "target_title").join(sources, "source_id", "left")
    return got.where((F.col("type") == "subcat") | F.col("_page")).select(F.col("source_id").alias("src"), "dst").distinct()


def build(page: DataFrame, props: DataFrame, redirect: DataFrame, links: DataFrame, intended: bool = True) -> PageGraph:
    """The graph of four dump tables. Redirect titles leave the pages only in the intended mode; disambiguation titles leave them always."""
    # Each table is used by several others: it is made once, and kept where lost executors can't take it.
    kept = cut(kept_pages(page, props))
    articles, categories = cut(article_pages(kept)), cut(category_pages(kept))
    redirects = collapse_redirects(resolved_redirects(redirect, kept, articles), articles)
    disambiguations = cut(disambiguation_pages(kept, props))
    pages = articles.join(disambiguations.select("title"), "title", "left_anti")
    if intended:
        pages = pages.join(redirects.select("title"), "title", "left_anti")
    return PageGraph(cut(pages), redirects, disambiguations, categories, cut(category_edges(links, kept, articles, categories)))


# Questions: titles is a table with a column title, ids one with a column id; the answers keep their other columns.


def page_of_id(graph: PageGraph, ids: DataFrame) -> DataFrame:
    """ids with ``title``: of a page, else a category, else a disambiguation, else null."""
    out = ids
    for k, t in enumerate((graph.pages, graph.categories, graph.disambiguations)):
        one = t.groupBy(F.col("id").alias(f"_id{k}")).agg(F.min("title").alias(f"_t{k}"))
        out = out.join(one, out["id"] == one[f"_id{k}"], "left").drop(f"_id{k}")
    return out.withColumn("title", F.coalesce("_t0", "_t1", "_t2")).drop("_t0", "_t1", "_t2")


def id_of_page(graph: PageGraph, titles: DataFrame) -> DataFrame:
    """titles with ``id``: of a page, else the target of a redirect, else a category, else a disambiguation, else null."""
    out = titles
    for k, t in enumerate((graph.pages, graph.redirects.withColumnRenamed("target_id", "id"), graph.categories, graph.disambiguations)):
        out = out.join(t.select("title", F.col("id").alias(f"_i{k}")), "title", "left")
    return out.withColumn("id", F.coalesce(*(f"_i{k}" for k in range(4)))).drop(*(f"_i{k}" for k in range(4)))


def redirect(graph: PageGraph, titles: DataFrame) -> DataFrame:
    """titles with ``target``: the page that a redirect leads to, or the title itself."""
    joined = titles.join(graph.redirects.select("title", F.col("target_id").alias("id")), "title", "left").withColumnRenamed("title", "_asked")
    named = page_of_id(graph, joined).withColumnRenamed("title", "_named")
    return named.withColumn("target", F.when(F.col("id").isNull(), F.col("_asked")).otherwise(F.col("_named"))).withColumnRenamed("_asked", "title").drop("id", "_named")


def kinds(graph: PageGraph, titles: DataFrame) -> DataFrame:
    """titles with is_redirect, is_disambiguation (of what a redirect leads to) and is_category."""
    out = redirect(graph, titles)
    for name, t, on in (("is_redirect", graph.redirects, "title"), ("is_disambiguation", graph.disambiguations, "target"), ("is_category", graph.categories, "title")):
        out = out.join(t.select(F.col("title").alias(on), F.lit(True).alias(name)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.drop("target")


def all_pages(graph: PageGraph, redirects: bool = False, disambiguations: bool = False) -> DataFrame:
    """(title) of the pages, and of the others where asked; all rows."""
    out = graph.pages.select("title")
    out = out.unionByName(graph.redirects.select("title")) if redirects else out
    return out.unionByName(graph.disambiguations.select("title")) if disambiguations else out


def reachable(edges: DataFrame, starts: DataFrame, distance: int = 1) -> DataFrame:
    """(start, id): all nodes within 1 to distance steps of each start; a start is among them if a way leads back. starts: column start.

    Every step is a join with the edges and a distinct over what is new."""
    step = edges.select(F.col("src").alias("id"), F.col("dst").alias("to"))
    front = starts.select("start", F.col("start").alias("id")).distinct()
    seen = None
    for _ in range(distance):
        front = front.join(step, "id").select("start", F.col("to").alias("id")).distinct()
        if seen is not None:
            front = front.join(seen, ["start", "id"], "left_anti")
        seen = front if seen is None else seen.unionByName(front)
    return seen if seen is not None else front.limit(0)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def _around(graph: PageGraph, titles: DataFrame, edges: DataFrame, distance: int) -> DataFrame:
    asked = id_of_page(graph, redirect(graph, titles.select("title").distinct()).select(F.col("title").alias("_asked"), F.col("target").alias("title"))).select(F.col("_asked").alias("title"), F.col("id").alias("start"))
    if distance < 2:
        found = reachable(edges, asked.where("start is not null").select("start"), distance)
        named = page_of_id(graph, found).select("start", "id", F.col("title").alias("reached"))
        return asked.join(named, "start").select("title", "id", "reached")
    # Starts with the same neighbours reach the same nodes: one of them is followed for all, and no pair of a start and a node is made before the last join.
    members = cut(_alike(edges, asked.where("start is not null").select("start").distinct()))
    found = reachable(edges, members.select(F.col("like").alias("start")).distinct(), distance)
    named = cut(page_of_id(graph, found).select(F.col("start").alias("like"), "id", F.col("title").alias("reached")))
    return _spread_join(cut(asked.join(members, "start").select("title", "like")), named, "like").select("title", "id", "reached")


def _alike(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, like): the least of the starts whose neighbours are the same ones, told by their number and two 64-bit hashes of them; starts without neighbours are left out."""
    near = edges.join(starts, edges["src"] == starts["start"]).select("start", "dst").distinct()
    by = ["n", "h1", "h2"]
    marks = near.groupBy("start").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("dst")).alias("h1"), F.bit_xor(F.xxhash64("dst", F.lit(1))).alias("h2"))
    return marks.join(marks.groupBy(*by).agg(F.min("start").alias("like")), by).select("start", "like")


#: Rows that one part of a group of a join makes, about.
_PART = 1 << 22


def _spread_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """The join of tables of many rows each with one key: rows of left are dealt to the parts of their group, and those of right come to each of its parts, so that none has many more results than another."""
    size = left.groupBy(on).agg(F.count("*").alias("_n")).join(right.groupBy(on).agg(F.count("*").alias("_m")), on).select(on, F.ceil(F.col("_n") * F.col("_m") / _PART).cast("int").alias("_parts"))
    parts = 4 * left.sparkSession.sparkContext.defaultParallelism
    dealt = left.join(size, on).withColumn("_part", F.pmod(F.xxhash64(*left.columns), F.col("_parts")).cast("int")).drop("_parts")
    copied = right.join(size, on).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.repartition(parts, on, "_part").join(copied.repartition(parts, on, "_part"), [on, "_part"]).drop("_part")


def categories_of(graph: PageGraph, titles: DataFrame, distance: int = 1) -> DataFrame:
    """(title, id, reached): categories within the distance, along the edges; reached is null for an id that no page has."""
    return _around(graph, titles, graph.edges, distance)


def neighbours_of(graph: PageGraph, titles: DataFrame, distance: int = 1) -> DataFrame:
    """The same, along the edges both ways."""
    return _around(graph, titles, both_ways(graph.edges), distance)
