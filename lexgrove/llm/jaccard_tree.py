"""Join of documents on the Jaccard similarity of their word n-gram sets, by signature trees.

1. Texts with the same n-gram set form a class; its lowest doc_id stands for it.
2. The representatives meet in blocks: a block holds the texts that agree in a pair of minhash values (``BANDS`` pairs a text).
   Only (key, id) rows are counted for this, and only texts that meet another one are sent on with their sets. Of blocks that hold the same texts,
   as those of near copies mostly do, the first is used. A block of more than ``BLOCK`` texts is cut into parts, and each two of these meet in a task of their own.
3. In a block, a signature tree is built over the texts in the order of their sizes: a node has the OR of the token bitmaps
   below it and the range of their sizes. A traversal of two nodes at a time goes down where the largest possible overlap
   can still reach the threshold; texts of the leaf pairs that are left are compared by their whole sets.

A pair of similarity s meets with probability 1 - (1 - s^2)^BANDS: 0.9992 at 0.6, over 0.99998 at 0.7; a pair that
meets is never missed and its similarity is exact (of 32-bit hashes).

4. A block gives each of its texts the number of documents that it is linked to there (a class counts with all its members; a pair counts in the first
   band that both share), its highest similarity, and one link towards the lowest of the texts that it hangs together with. So what leaves a block is as
   large as the block, however many pairs there are in it. Connected components of these links and of the classes are the groups.

The result of the query has a row for each document: doc_id, class_id (the lowest doc_id of its group), n_links (documents that are similar to
it, copies too) and best_jaccard (null without a link). ``representative_pairs`` has the links themselves: pairs of representatives, and each member with its representative.

Results for odd input: a row with a null doc_id has no row in the result; a text without a word is in no pair; a text of fewer than ``N`` words is one
n-gram; rows that repeat a doc_id are one document: its links are those of its distinct texts added up, and it isn't linked with itself;
an empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import mix, ngram_hashes, text_slices, words
from .tables import cut, documents

N = 3
THRESHOLD = 0.6
BANDS = 16
BITS = 1024
LEAF, FANOUT = 16, 4
BLOCK = 2000

_SEEDS = mix(np.arange(1, 2 * BANDS + 1, dtype=np.uint64))


def gram_sets(text: pa.Array, n: int = N) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of the rows: the distinct 32-bit n-gram hashes, ascending within each row, and the first of each row (with a last entry)."""
    for a, b, data, offsets in text_slices(text):
        _, _, rows, h = words(data, offsets)
        count = np.diff(rows)
        row = np.repeat(np.arange(b - a), count)
        grams = ngram_hashes(h, n)
        whole = row[: len(grams)] == row[n - 1 :] if len(grams) else np.zeros(0, bool)
        key = (row[: len(grams)][whole].astype(np.uint64) << np.uint64(32)) | (grams[whole] >> np.uint64(32))
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            folded = np.array([int(mix(_chain(h[rows[i] : rows[i + 1]]))[0]) >> 32 for i in short], np.uint64)
            key = np.concatenate([key, (short.astype(np.uint64) << np.uint64(32)) | folded])
        key = np.unique(key)
        yield (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(key, np.arange(b - a + 1, dtype=np.uint64) << np.uint64(32))


def _chain(h: np.ndarray) -> np.ndarray:
    out = np.full(1, len(h), np.uint64)
    for x in h:
        out = out * np.uint64(0x9E3779B97F4A7C15) + x
    return out


def band_keys(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One key for each row and band; rows have at least one n-gram. A key joins two minhash values and the band's number."""
    least = []
    for seed in _SEEDS:
        h = grams.astype(np.uint64) * (seed | np.uint64(1))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        least.append(np.minimum.reduceat(h >> np.uint64(16), first[:-1]))
    return np.stack([mix(mix(least[2 * k]) + least[2 * k + 1] + np.uint64(k)) for k in range(BANDS)], 1).view(np.int64)


def set_hashes(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of the mixed hashes of each row's set; rows have at least one n-gram."""
    return mix(np.add.reduceat(mix(grams.astype(np.uint64)), first[:-1])).view(np.int64)


def _with_grams(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have n-grams, and their firsts."""
    has = np.flatnonzero(np.diff(first) > 0)
    return has, np.concatenate([first[has], [len(grams)]])


_LIGHT = "id long, set_hash long, size int, keys array<long>"


def _light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for grams, first in gram_sets(batch["text"]):
            ids = batch["doc_id"].slice(at, len(first) - 1)
            at += len(first) - 1
            has, first = _with_grams(grams, first)
            if not len(has):
                continue
            keys = band_keys(grams, first)
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(has)).cast(pa.int64()), pa.array(set_hashes(grams, first)), pa.array(np.diff(first), pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1) * BANDS, pa.int32()), pa.array(keys.ravel())),
            ], ["id", "set_hash", "size", "keys"])


_FULL = "id long, set_hash long, members long, keys binary, grams binary, bands array<struct<band: int, parts: int>>"


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for grams, first in gram_sets(batch["text"]):
            n = len(first) - 1
            ids, bands, members, wanted = (batch[c].slice(at, n) for c in ("doc_id", "bands", "members", "set_hash"))
            at += n
            has, first = _with_grams(grams, first)
            if not len(has):
                continue
            keys, hashes = band_keys(grams, first), set_hashes(grams, first)
            own = pa.array(hashes == wanted.to_numpy()[has])  # else it is another text of the id
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(has)).cast(pa.int64()), pa.array(hashes), members.take(pa.array(has)), pa.array([k.tobytes() for k in keys], pa.binary()),
                pa.array([grams[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary()), bands.take(pa.array(has)),
            ], ["id", "set_hash", "members", "keys", "grams", "bands"]).filter(own)


class SignatureTree:
    """Levels of nodes over sets that ascend in size; a node has an OR bitmap, the range of sizes and the largest excess of a size over its bits."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets])
        bitmap = np.zeros((len(sets), BITS), bool)
        for k, s in enumerate(sets):
            bitmap[k, s % BITS] = True
        self.levels = [(np.packbits(bitmap, axis=1).view(np.uint64), sizes, sizes, sizes - bitmap.sum(1))]
        width = LEAF
        while len(self.levels[-1][1]) > 1:
            bits, low, high, over = self.levels[-1]
            at = np.arange(0, len(low), width)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(over, at)))
            width = FANOUT

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
        """Whether some set below node a can be as similar as the threshold to some set below node b."""
        bits, low, high, over = self.levels[level]
        most = np.bitwise_count(bits[a] & bits[b]).sum(1) + np.minimum(over[a], over[b])
        most = np.minimum(most, np.minimum(high[a], high[b]))
        return (most * (1 + threshold) >= threshold * (low[a] + low[b]) - 1e-9) & (high[a] >= threshold * low[b] - 1e-9) & (high[b] >= threshold * low[a] - 1e-9)

    def leaf_pairs(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of sets (a < b) that the traversal of two nodes at a time can't rule out."""
        a = b = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 2, -1, -1):
            width = LEAF if level == 0 else FANOUT
            n = len(self.levels[level][1])
            i, j = np.divmod(np.arange(width * width), width)
            a, b = (a[:, None] * width + i).ravel(), (b[:, None] * width + j).ravel()
            keep = (a < n) & (b < n) & ((a < b) if level == 0 else (a <= b))
            a, b = a[keep], b[keep]
            parts = [self.possible(level, a[k : k + 65536], b[k : k + 65536], threshold) for k in range(0, len(a), 65536)]
            keep = np.concatenate([*parts, np.zeros(0, bool)])
            a, b = a[keep], b[keep]
        return a, b


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections, tile by tile of LEAF sets."""
    out = np.zeros(len(a), np.int64)
    tile = (a // LEAF) * (len(sets) // LEAF + 1) + b // LEAF
    order = np.argsort(tile, kind="stable")
    cuts = np.flatnonzero(np.diff(tile[order])) + 1
    for at in np.split(order, cuts):
        left, li = np.unique(a[at], return_inverse=True)
        right, ri = np.unique(b[at], return_inverse=True)
        if len(at) <= 2:
            for k in at:
                out[k] = len(np.intersect1d(sets[a[k]], sets[b[k]], assume_unique=True))
            continue
        x, y = (np.concatenate([sets[i] for i in side]) for side in (left, right))
        shared = np.intersect1d(x, y)
        planes = []
        for side, values in ((left, x), (right, y)):
            place = np.searchsorted(shared, values)
            ok = place < len(shared)
            ok[ok] &= shared[place[ok]] == values[ok]
            plane = np.zeros((len(side), len(shared)), np.float32)
            plane[np.repeat(np.arange(len(side)), [len(sets[i]) for i in side])[ok], place[ok]] = 1
            planes.append(plane)
        out[at] = np.rint((planes[0] @ planes[1].T)[li, ri]).astype(np.int64)
    return out


def similar_pairs(sets: list[np.ndarray], threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of the given sets of Jaccard similarity threshold or more, and the similarities."""
    order = np.array(sorted(range(len(sets)), key=lambda k: (len(sets[k]), int(sets[k][0]) if len(sets[k]) else 0)), np.int64)
    ordered = [sets[k] for k in order]
    a, b = SignatureTree(ordered).leaf_pairs(threshold) if len(sets) > 1 else (np.zeros(0, np.int64),) * 2
    sizes = np.array([len(s) for s in ordered], np.int64)
    shared = overlaps(ordered, a, b) if len(a) else np.zeros(0, np.int64)
    union = sizes[a] + sizes[b] - shared
    found = (shared >= threshold * union - 1e-9) & (shared > 0)
    return order[a[found]], order[b[found]], shared[found] / union[found]


def lowest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes, the lowest node of its connected component."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label != label[label]).any():
            label = label[label]


#: Links of a text in one block: the text of the block that stands for those it hangs together with, the linked documents, and the highest similarity.
_LINKS = "id long, set_hash long, root long, links long, best double"
_PAIRS = "doc_id long, other_id long, jaccard double"


def _joiner(threshold: float, pairs: bool):  # noqa: ANN202
    kinds = [(c.split()[0], np.float64 if " double" in c else np.int64) for c in (_PAIRS if pairs else _LINKS).split(", ")]

    def block(held: list[tuple]) -> tuple[np.ndarray, ...]:
        ids, members = (np.array([r[k] for r in held], np.int64) for k in (1, 4))
        keys = np.frombuffer(b"".join(r[2] for r in held), np.int64).reshape(-1, BANDS)
        band = held[0][0][0]
        a, b, s = similar_pairs([np.frombuffer(r[3], np.uint32) for r in held], threshold)
        if held[0][0][2] != held[0][0][3]:  # two parts of a block: pairs within one are another task's
            part = np.array([r[6] for r in held], np.int64)
            cross = part[a] != part[b]
            a, b, s = a[cross], b[cross], s[cross]
        new = (ids[a] != ids[b]) & ~(keys[a, :band] == keys[b, :band]).any(1)  # else an earlier band has the pair
        a, b, s = a[new], b[new], s[new]
        if pairs:
            return np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), s
        links, best = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        np.add.at(links, a, members[b])
        np.add.at(links, b, members[a])
        np.maximum.at(best, a, s)
        np.maximum.at(best, b, s)
        some = np.flatnonzero(links)
        return ids[some], np.array([r[5] for r in held], np.int64)[some], ids[lowest_labels(len(ids), a, b)][some], links[some], best[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of (band, key, low, high); a block may go on in the next batch."""
        held: list[tuple] = []
        once: set[tuple[int, int]] = set()
        out: list[tuple] = []

        def close() -> None:
            if len(held) > 1:
                out.append(block(held))
            held.clear()
            once.clear()

        def made() -> pa.RecordBatch:
            columns = (np.concatenate([*(o[k] for o in out), np.zeros(0, kind)]) for k, (_, kind) in enumerate(kinds))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [n for n, _ in kinds])

        for batch in batches:
            for band, key, low, high, i, keys, grams, members, text, part in zip(*(batch[c].to_pylist() for c in ("band", "key", "low", "high", "id", "keys", "grams", "members", "set_hash", "part")), strict=True):
                if held and held[0][0] != (band, key, low, high):
                    close()
                if (i, text) not in once:  # a row may be there again
                    once.add((i, text))
                    held.append(((band, key, low, high), i, keys, grams, members, text, part))
            if out:
                yield made()
                out.clear()
        close()
        yield made()

    return run


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts that count, (id, set_hash, size, keys) of each, and the classes of equal sets: set_hash, size, rep, keys, members."""
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    # A class is keyed by the sum of the mixed hashes of its set and by the set's size.
    light = cut(texts.mapInArrow(_light, _LIGHT))
    classes = light.groupBy("set_hash", "size").agg(F.min("id").alias("rep"), F.first("keys").alias("keys"), F.count_distinct("id").alias("members"))
    return texts, light.select("id", "set_hash", "size"), classes


def _blocks(texts: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """Rows of the blocks, by (band, key, low, high): id, set_hash, members, keys, grams and part. low and high are the parts that meet."""
    spread = classes.select("rep", "set_hash", "members", F.posexplode("keys").alias("band", "key"))
    own = [F.bit_xor(F.xxhash64("rep", "set_hash", F.lit(k))).alias(f"h{k}") for k in (0, 1)]
    meeting = spread.groupBy("band", "key").agg(F.count("*").alias("n"), *own).where("n > 1")
    # The first of the blocks with the same texts. Each two texts have a first band that they share, and its block is the first of its kind.
    meeting = meeting.groupBy("n", "h0", "h1").agg(F.min(F.struct("band", "key")).alias("first")).select("first.band", "first.key", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    bands = spread.join(meeting, ["band", "key"]).groupBy("rep", "set_hash").agg(F.collect_set(F.struct("band", "parts")).alias("bands"), F.max("members").alias("members"))
    full = texts.join(bands, texts["doc_id"] == bands["rep"]).select("doc_id", "text", "bands", "members", "set_hash").mapInArrow(_full, _FULL)
    # The key of a band is 8 bytes of keys at 8 * band.
    each = full.withColumn("b", F.explode("bands")).select(F.col("b.band").alias("band"), F.col("b.parts").alias("parts"), F.expr("substring(keys, 8 * b.band + 1, 8)").alias("key"), "id", "set_hash", "members", "keys", "grams")
    each = each.withColumn("part", F.pmod(F.xxhash64("id", "set_hash"), "parts"))
    each = each.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = each.select("band", "key", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "part", "id", "set_hash", "members", "keys", "grams")
    return blocks.repartition("band", "key", "low", "high").sortWithinPartitions("band", "key", "low", "high")


def _members(light: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, rep) of the members of classes of several documents."""
    several = classes.where("members > 1").select("set_hash", "size", "rep")
    return light.join(several, ["set_hash", "size"]).where("id != rep").select("id", "rep").distinct()


def representative_pairs(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, other_id, jaccard): the similar pairs of representatives, and each member of a class with its representative."""
    texts, light, classes = _classes(docs)
    near = _blocks(texts, classes, block).mapInArrow(_joiner(threshold, True), _PAIRS)
    same = _members(light, classes).select(F.col("rep").alias("doc_id"), F.col("id").alias("other_id"), F.lit(1.0).alias("jaccard"))
    return near.unionByName(same).groupBy("doc_id", "other_id").agg(F.max("jaccard").alias("jaccard"))


def _linked(docs: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """light and classes as above, the links of representatives, and (doc_id, root) of all documents in groups."""
    texts, light, classes = _classes(docs)
    near = cut(_blocks(texts, classes, block).mapInArrow(_joiner(threshold, False), _LINKS))
    edges = near.where("id != root").select("id", "root").unionByName(_members(light, classes).select("id", F.col("rep").alias("root")))
    return light, classes, near, components(edges.select(F.col("id").alias("doc_id"), F.col("root").alias("other_id")))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links, best_jaccard) of every document."""
    light, classes, near, roots = _linked(docs, threshold, block)
    of_rep = near.groupBy(F.col("id").alias("rep"), "set_hash").agg(F.sum("links").alias("links"), F.max("best").alias("best"))
    each = (
        light.distinct().join(classes.select("set_hash", "size", "rep", "members"), ["set_hash", "size"]).join(of_rep, ["rep", "set_hash"], "left")
        .groupBy("id").agg(F.sum(F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.max(F.when(F.col("members") > 1, 1.0).otherwise(F.col("best"))).alias("best_jaccard"))
    )
    every = docs.select("doc_id").where("doc_id is not null").distinct()
    joined = every.join(each, every["doc_id"] == each["id"], "left").drop("id").join(roots, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "best_jaccard")


def components(pairs: DataFrame) -> DataFrame:
    """(doc_id, root) of every document in a pair: root is the lowest id of its connected component.

    Rounds of large-star and small-star over the edges, each checkpointed, until a round leaves every edge where it is."""
    edges = cut(pairs.select(F.greatest("doc_id", "other_id").alias("u"), F.least("doc_id", "other_id").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large-star: every larger neighbour is tied to the least of the neighbourhood.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small-star: the smaller neighbours, and the node itself, are tied to the least of them.
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        now = cut(small.select(F.col("u"), F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u != v").distinct())
        # Both have distinct rows: if all of the one are among the others and there are as many, they are the same.
        same = now.count() == edges.count() and now.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = now
        if same:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("root")).distinct())


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """docs with one document of each group (connected component of similar documents), the one of the lowest id.

    Of rows that repeat a doc_id within a group one stays; rows that are in no group all stay, but for those that repeat an id and a text."""
    *_, found = _linked(docs, threshold, block)
    lose = found.where("doc_id != root").select(F.col("doc_id").alias("_lost"))
    # Both kinds of rows are read from one exchange of the texts: all of it has the same filter.
    some = docs.where("doc_id is not null")
    kept = some.join(lose, some["doc_id"] == lose["_lost"], "left_anti")
    # Ids on several rows are rare; only their rows are looked at again.
    again = some.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again"))
    unique = kept.join(again, kept["doc_id"] == again["_again"], "left_anti")
    repeated = kept.join(again, kept["doc_id"] == again["_again"], "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.where("doc_id is null").unionByName(unique).unionByName(repeated)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))
