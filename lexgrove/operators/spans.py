"""Span algebra over tables of (doc_id, start, end, ...): half-open token ranges.

Containment and running maxima are windows over a document's spans, linear but for the sort. Overlaps are equi-joins on bins of ``BIN`` tokens, so
that a document with many spans is spread over its bins and never compared all with all.

Matches of a document that come packed, one row of arrays for each (``match(packed=pack)``), are never made rows before the answer is known: rows of one id meet in one exchange of those
arrays, and are worked on in pieces of many documents, each put behind the one before on one line.

Results for odd input: null bounds overlap and contain nothing, and null ids are a document of their own in windows and of none in joins; repeated rows count as one where the docstring says
distinct; empty tables give empty ones. Other columns come along whatever their names: helpers take names that aren't there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 64


def _free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with signs put after it until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
        taken.add(n.lower())
    return out


def suppress_same_end(spans: DataFrame, by: list[str]) -> DataFrame:
    """Drops a span that starts later than the one before it (of the same ``by``) and ends where it does."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    (same,) = _free(spans, "same")
    repeats = F.coalesce((F.lag("end").over(order) == F.col("end")) & (F.lag("start").over(order) < F.col("start")), F.lit(False))
    return spans.withColumn(same, repeats).where(~F.col(same)).drop(same)


def running_end(spans: DataFrame, by: list[str]) -> DataFrame:
    """Keeps the spans, in the order of their starts, that end beyond all before them."""
    order = Window.partitionBy(*by).orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    (most,) = _free(spans, "most")
    return spans.withColumn(most, F.coalesce(F.max("end").over(order), F.lit(0))).where(F.col("end") > F.col(most)).drop(most)


def drop_contained(spans: DataFrame, by: list[str]) -> DataFrame:
    """Distinct spans that lie in no larger one; those that overlap in part stay."""
    bounds = spans.dropDuplicates([*by, "start", "end"])
    earlier = Window.partitionBy(*by).orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    same_start = Window.partitionBy(*by, "start")
    inside = (F.coalesce(F.max("end").over(earlier), F.lit(-1)) >= F.col("end")) | (F.max("end").over(same_start) > F.col("end"))
    (name,) = _free(bounds, "inside")
    return bounds.withColumn(name, inside).where(~F.col(name)).drop(name)


def _binned(spans: DataFrame, name: str) -> DataFrame:
    return spans.withColumn(name, F.explode(F.expr(f"sequence(start div {BIN}, (end - 1) div {BIN})")))


def overlapping_pairs(left: DataFrame, right: DataFrame, by: str = "doc_id") -> DataFrame:
    """Pairs of rows whose ranges share a token: columns of left, and those of right with ``other_`` before them. Each pair comes once."""
    (name,) = _free(left.select("*", *[F.lit(0).alias(f"other_{c}") for c in right.columns if c != by]), "bin")
    other = _binned(right, name).select(by, name, *[F.col(c).alias(f"other_{c}") for c in right.columns if c != by])
    joined = _binned(left, name).join(other, [by, name])
    # The first bin that both are in makes the pair.
    shared = F.expr(f"greatest(start, other_start) div {BIN}") == F.col(name)
    return joined.where((F.col("start") < F.col("other_end")) & (F.col("other_start") < F.col("end")) & shared).drop(name)


def only_longest(spans: DataFrame) -> DataFrame:
    """(doc_id, start, end, label): a span that lies in a larger one goes; one that overlaps another in part is merged with the first such, under the label of the
    one that starts later; the first conflict in the order (start, longest first, label) decides. Distinct rows; spans with a null id or bound, or without a token, are left out."""
    rows = spans.select("doc_id", "start", "end", "label").distinct()
    # Every row meets itself, so that one aggregation over the pairs has all rows, with the first conflict or without.
    pairs = overlapping_pairs(rows, rows)
    contained = ((F.col("start") > F.col("other_start")) & (F.col("end") <= F.col("other_end"))) | ((F.col("start") >= F.col("other_start")) & (F.col("end") < F.col("other_end")))
    head = (F.col("start") < F.col("other_start")) & (F.col("end") < F.col("other_end"))
    tail = (F.col("start") > F.col("other_start")) & (F.col("end") > F.col("other_end"))
    does = F.when(contained, "drop").when(head, "head").when(tail, "tail")
    conflict = F.when(does.isNotNull(), F.struct("other_start", F.negative("other_end").alias("back"), "other_label", does.alias("does")))
    first = pairs.groupBy("doc_id", "start", "end", "label").agg(F.min(conflict).alias("first"))
    does = F.col("first.does")
    merged = [
        F.when(does == "tail", F.col("first.other_start")).otherwise(F.col("start")).alias("start"),
        F.when(does == "head", -F.col("first.back")).otherwise(F.col("end")).alias("end"),
        F.when(does == "head", F.col("first.other_label")).otherwise(F.col("label")).alias("label"),
    ]
    return first.where(does.isNull() | (does != "drop")).select("doc_id", *merged).distinct()


def token_labels(spans: DataFrame) -> DataFrame:
    """(doc_id, i, labels): the distinct labels of the spans over each token, sorted."""
    return spans.select("doc_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("i"), "label").groupBy("doc_id", "i").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def as_of(hits: DataFrame, definitions: DataFrame, by: list[str], at: str, since: str, value: Column) -> DataFrame:
    """Each hit with the value of the latest definition (of the same ``by``) that starts no later than it; hits without one are left out.

    One sort of both sides together; no range join."""
    kind, has = _free(hits, "kind", "_value")
    both = (
        definitions.select(*by, F.col(since).alias(at), F.lit(0).alias(kind), value.alias(has), *[F.lit(None).cast(t).alias(c) for c, t in hits.dtypes if c not in by and c != at])
        .unionByName(hits.withColumn(kind, F.lit(1)).withColumn(has, F.lit(None)))
    )
    order = Window.partitionBy(*by).orderBy(at, kind).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(has, F.last(has, ignorenulls=True).over(order)).where((F.col(kind) == 1) & F.col(has).isNotNull()).drop(kind)


# Packed spans: (key, start, end, rule), arrays of int in the order (start, longest first, rule)


def _outer(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers of the distinct spans that lie in no other, which are those that end beyond all before them in the order (start, longest first)."""
    order = np.lexsort((-end, start))
    most = np.concatenate([[-1], np.maximum.accumulate(end[order])[:-1]]) if len(order) else np.zeros(0, np.int64)
    return order[end[order] > most]


def pack(keys: pa.Array, doc: np.ndarray, start: np.ndarray, end: np.ndarray, rule: np.ndarray) -> pa.RecordBatch:
    """A row for each document that has spans."""
    order = np.lexsort((rule, -end, start, doc))
    owner, first = np.unique(doc[order], return_index=True)
    first = pa.array([*first, len(order)], pa.int32())
    arrays = [pa.ListArray.from_arrays(first, pa.array(x[order], pa.int32())) for x in (start, end, rule)]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), *arrays], ["key", "start", "end", "rule"])


def pack_outer(keys: pa.Array, doc: np.ndarray, start: np.ndarray, end: np.ndarray, rule: np.ndarray) -> pa.RecordBatch:
    """The same of the outermost spans alone; what lies in another span of its row lies in it still when rows of one id meet."""
    _, at = np.unique(doc, return_inverse=True)
    shift = np.concatenate([[0], np.cumsum(_furthest(at, end))])[at]
    some = _outer(start + shift, end + shift)
    return pack(keys, doc[some], start[some], end[some], rule[some])


def _furthest(owner: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The largest end of each owner, numbered from 0 on."""
    most = np.zeros(int(owner.max()) + 1 if len(owner) else 0, np.int64)
    np.maximum.at(most, owner, end)
    return most


#: Spans that are worked on at a time, but for a document that has more.
PIECE = 1 << 18


def by_document(packed: DataFrame, key: str, make: Callable, columns: str) -> DataFrame:
    """(key, columns): what make tells of all spans of an id. make gets, of a piece of many ids, for each span the number of its id, start, end and rule, and the places of the ids on the line that
    start and end are on; it gives the numbers of the ids and the columns."""
    kind, piece = dict(packed.dtypes)[key], PIECE

    def told(keys: list[pa.Array], bounds: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """Rows of one key stand together."""
        every = pa.concat_arrays(keys)
        size, start, end, rule = (np.concatenate([b[k] for b in bounds]) for k in range(4))
        one = np.zeros(len(every), bool)
        one[:1] = True
        one[1:] = ~np.array(pc.fill_null(pc.equal(every[1:], every[:-1]), False)) & ~(np.array(every[1:].is_null()) & np.array(every[:-1].is_null()))
        owner = np.repeat(np.cumsum(one) - 1, size)
        base = np.concatenate([[0], np.cumsum(_furthest(owner, end))]).astype(np.int64)
        which, *made = make(owner, start + base[owner], end + base[owner], rule, base)
        return pa.RecordBatch.from_arrays([every.filter(pa.array(one)).take(pa.array(which)), *made], [f"c{k}" for k in range(len(made) + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[pa.Array] = []
        bounds: list[tuple[np.ndarray, ...]] = []
        held, last = 0, None
        for batch in batches:
            size = np.diff(batch[1].offsets.to_numpy().astype(np.int64))
            at = 0
            while at < len(batch):
                if held >= piece and batch[0][at].as_py() != last:
                    yield told(keys, bounds)
                    keys, bounds, held = [], [], 0
                # Until the piece is full; a full one goes on with rows of its last id alone.
                n = 1 if held >= piece else max(1, int(np.searchsorted(np.cumsum(size[at:]), piece - held, "right")))
                keys.append(batch[0].slice(at, n))
                bounds.append((size[at : at + n], *(c.slice(at, n).flatten().to_numpy().astype(np.int64) for c in batch.columns[1:])))
                held += int(size[at : at + n].sum())
                at += n
                last = batch[0][at - 1].as_py()
        if keys:
            yield told(keys, bounds)

    names = [c.split()[0] for c in columns.split(", ")]
    together = packed.select(key, "start", "end", "rule").repartition(key).sortWithinPartitions(key)
    return together.mapInArrow(_renamed(run, [key, *names]), f"`{key}` {kind}, {columns}")


def _renamed(run: Callable, names: list[str]) -> Callable:
    return lambda batches: (pa.RecordBatch.from_arrays(b.columns, names) for b in run(batches))


def _ints(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.int32())


def outermost(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end): the distinct spans that lie in no other of their document."""

    def make(owner: np.ndarray, start: np.ndarray, end: np.ndarray, rule: np.ndarray, base: np.ndarray) -> tuple:
        some = _outer(start, end)
        owner = owner[some]
        return owner, _ints(start[some] - base[owner]), _ints(end[some] - base[owner])

    return by_document(packed, key, make, "start int, end int")


def _first_conflicts(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For spans in the order (start, longest first): the first span, in that order, that each conflicts with, or -1; whether it lies in that one."""
    n = len(start)
    most = np.maximum.accumulate(end) if n else end
    # The first one that reaches beyond a span's start: it starts earlier, or is the longest from the same start.
    first = np.searchsorted(most, start, "right")
    earlier = start[first] < start
    inside = np.where(earlier, end[first] >= end, end[first] > end)
    out = np.where(earlier | inside, first, -1)
    # The first one after it that ends later is one that it runs into.
    later = np.full(n, -1, np.int64)
    stack: list[int] = []
    ends = end.tolist()
    for k, e in enumerate(ends):
        while stack and ends[stack[-1]] < e:
            later[stack.pop()] = k
        stack.append(k)
    runs = (out < 0) & (later >= 0)
    runs[runs] = start[later[runs]] < end[runs]
    return np.where(runs, later, out), inside


def only_longest_packed(packed: DataFrame, labels: list[str], key: str = "doc_id") -> DataFrame:
    """only_longest() of packed spans; labels: the name of each rule."""
    names = sorted(set(labels))
    rank = np.array([names.index(x) for x in labels], np.int64)

    def make(owner: np.ndarray, start: np.ndarray, end: np.ndarray, rule: np.ndarray, base: np.ndarray) -> tuple:
        label = rank[rule]
        order = np.lexsort((label, -end, start))
        owner, start, end, label = (x[order] for x in (owner, start, end, label))
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1]) | (label[1:] != label[:-1])
        owner, start, end, label = (x[new] for x in (owner, start, end, label))
        other, inside = _first_conflicts(start, end)
        tail = (other >= 0) & ~inside & (start[other] < start)
        head = (other >= 0) & ~inside & ~tail
        rows = np.stack([owner, np.where(tail, start[other], start), np.where(head, end[other], end), np.where(head, label[other], label)], 1)[(other < 0) | ~inside]
        owner, start, end, label = np.unique(rows, axis=0).reshape(-1, 4).T
        return owner, _ints(start - base[owner]), _ints(end - base[owner]), pa.array(names, pa.string()).take(pa.array(label))

    return by_document(packed, key, make, "start int, end int, label string")


def token_labels_packed(packed: DataFrame, labels: list[str], key: str = "doc_id", joined: str | None = None) -> DataFrame:
    """token_labels() of packed spans; labels: the name of each rule, of at most 62 names; joined: the sign between the labels of one string, in place of arrays."""
    names = sorted(set(labels))
    if len(names) > 62:
        raise ValueError("more than 62 labels")
    rank = np.array([names.index(x) for x in labels], np.int64)

    def make(owner: np.ndarray, start: np.ndarray, end: np.ndarray, rule: np.ndarray, base: np.ndarray) -> tuple:
        mask = np.zeros(base[-1], np.int64)
        for k in np.unique(rank[rule]).tolist():
            some = rank[rule] == k
            over = np.cumsum(np.bincount(start[some], minlength=len(mask) + 1) - np.bincount(end[some], minlength=len(mask) + 1))[:-1]
            mask |= (over > 0).astype(np.int64) << k
        at = np.flatnonzero(mask)
        sets, which = np.unique(mask[at], return_inverse=True)
        lists = [[x for k, x in enumerate(names) if m >> k & 1] for m in sets.tolist()]
        said = pa.array(lists, pa.list_(pa.string())) if joined is None else pa.array([joined.join(x) for x in lists], pa.string())
        owner = np.searchsorted(base, at, "right") - 1
        return owner, _ints(at - base[owner]), said.take(pa.array(which))

    return by_document(packed, key, make, f"i int, labels {'array<string>' if joined is None else 'string'}")


def as_of_packed(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, at, since): each span of rule 0 with the start of the latest one of rule 1 that starts no later than it; those without one are left out."""

    def make(owner: np.ndarray, start: np.ndarray, end: np.ndarray, rule: np.ndarray, base: np.ndarray) -> tuple:
        since = np.sort(start[rule == 1])
        owner, at = owner[rule == 0], start[rule == 0]
        latest = np.searchsorted(since, at, "right") - 1
        some = latest >= 0
        some[some] = since[latest[some]] >= base[owner[some]]
        owner = owner[some]
        return owner, _ints(at[some] - base[owner]), _ints(since[latest[some]] - base[owner])

    return by_document(packed, key, make, "at int, since int")
