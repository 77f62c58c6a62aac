"""Wiki SQL dumps: INSERT lines as rows of strings, and the tables that a graph is built from.

The lines are cut into tuples and fields by regular expressions in the JVM that take a quoted string with its escapes as a whole. NULL stays text. Files are read as UTF-8; gzip files can't be split, so
their lines are spread before they are parsed. Null lines, and lines that aren't INSERTs, have no rows; a repeated line gives its rows again; fields that a row lacks are null.
"""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("page", "page_props", "redirect", "pagelinks", "categorylinks")

_QUOTED = r"'(?:[^'\\]++|\\.)*+'"
_TUPLE = rf"\(((?:[^()'\\]++|{_QUOTED})*+)\)"
_FIELD = rf"(?:^|,)({_QUOTED}|[^,']*+)"


def resolve_version(versions: Iterable[str], version: str = "latest") -> str:
    """The version itself where there is one, the last one for "latest"; ValueError that names the choices otherwise."""
    found = sorted(versions)
    if version in found:
        return version
    if version == "latest" and found:
        return found[-1]
    raise ValueError(f"version {version!r} not found; pick one of these: {', '.join(found)}")


def dump_path(folder: str, wiki: str, version: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{wiki}wiki-{version}-{name}.sql.gz"


def local_versions(folder: str, wiki: str) -> list[str]:
    return sorted({p.name.split("-")[1] for p in Path(folder).glob(f"{wiki}wiki-*-*.sql.gz")})


def read_dump(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(line, ord): INSERT lines of a dump in their order. FileNotFoundError for an empty local file."""
    local = Path(path.removeprefix("file://"))
    if local.is_file() and not local.stat().st_size:
        raise FileNotFoundError(f"{path} is empty")
    lines = spark.read.text(path).where(F.col("value").startswith("INSERT INTO")).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("ord"))
    return lines.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))


def fields_of(inner: Column) -> Column:
    """array<string> of the fields of a tuple's inside, without their quotes; escapes stay."""
    # The leading comma of all but the first field is outside the group.
    return F.transform(F.regexp_extract_all(inner, F.lit(_FIELD), F.lit(1)), lambda f: F.when(f.startswith("'"), f.substr(F.lit(2), F.length(f) - 2)).otherwise(f))


def parse_lines(lines: DataFrame) -> DataFrame:
    """(fields, ord): the tuples of INSERT lines; other lines have none. ord: by line and place."""
    inserts = lines.where(F.col("line").startswith("INSERT INTO"))
    values = F.regexp_extract("line", r"^INSERT INTO [^(]*?VALUES\s*(.*)$", 1)
    values = F.when(values == "", F.regexp_extract("line", r"^INSERT INTO [^(]*(.*)$", 1)).otherwise(values)
    tuples = inserts.select(F.posexplode(F.regexp_extract_all(values, F.lit(_TUPLE), F.lit(1))).alias("k", "inner"), "ord")
    return tuples.select(fields_of(F.col("inner")).alias("fields"), F.struct("ord", "k").alias("ord"))


def unescape_title(title: Column) -> Column:
    return F.replace(F.replace(title, F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"'))


def _field(k: int) -> Column:
    return F.get("fields", F.lit(k))


def page_rows(rows: DataFrame) -> DataFrame:
    """(ns, id, title, ord) of articles and categories."""
    return rows.select(_field(1).alias("ns"), _field(0).cast("long").alias("id"), unescape_title(_field(2)).alias("title"), "ord").where(F.col("ns").isin("0", "14"))


def props_rows(rows: DataFrame) -> DataFrame:
    """(id, prop, value, ord)."""
    return rows.select(_field(0).cast("long").alias("id"), _field(1).alias("prop"), _field(2).alias("value"), "ord")


def redirect_rows(rows: DataFrame) -> DataFrame:
    """(source_id, target_title, ord)."""
    return rows.where(_field(1).isin("0", "14")).select(_field(0).cast("long").alias("source_id"), unescape_title(_field(2)).alias("target_title"), "ord")


def pagelinks_rows(rows: DataFrame) -> DataFrame:
    """(source_id, target_title, ord) between articles."""
    return rows.where((_field(1) == "0") & (_field(3) == "0")).select(_field(0).cast("long").alias("source_id"), unescape_title(_field(2)).alias("target_title"), "ord")


def categorylinks_rows(rows: DataFrame) -> DataFrame:
    """(type, source_id, target_title, ord) of pages and subcategories."""
    return rows.select(_field(6).alias("type"), _field(0).cast("long").alias("source_id"), unescape_title(_field(1)).alias("target_title"), "ord").where(F.col("type").isin("page", "subcat"))


ROWS = {"page": page_rows, "page_props": props_rows, "redirect": redirect_rows, "pagelinks": pagelinks_rows, "categorylinks": categorylinks_rows}


def read_table(spark: SparkSession, folder: str, wiki: str, name: str, version: str = "latest") -> DataFrame:
    """One of TABLES of a dump in a folder."""
    chosen = resolve_version(local_versions(folder, wiki), version)
    return ROWS[name](parse_lines(read_dump(spark, dump_path(folder, wiki, chosen, name))))


def build_graph(spark: SparkSession, folder: str, wiki: str, version: str = "latest", intended: bool = True):  # noqa: ANN201
    """The graph of a dump."""
    from ..operators.graph import build

    page, props, redirect, links = (read_table(spark, folder, wiki, name, version) for name in ("page", "page_props", "redirect", "categorylinks"))
    return build(page, props, redirect, links, intended)
