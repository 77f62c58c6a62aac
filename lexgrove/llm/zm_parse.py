"""Language-model scoring by Ziv-Merhav cross-parsing.

Symbols are words (without case) and single signs. A document is factored greedily from the left against reference text: each phrase is the longest
match that starts where the last one ended; a symbol that the reference lacks is a phrase of its own. With c phrases, n symbols, a reference of N
symbols and s phrases of the document's own incremental (LZ78) parse,

    cross_entropy    = c log2(N) / n                         bits a symbol, pointers into the reference
    relative_entropy = (c log2(N) - s log2(s)) / n           what the reference costs beyond the document's own complexity

The reference of a document is the whole corpus of its language, every other row of it, however large. One automaton of that doesn't fit a task, and
one a part would be walked by every document, which is quadratic. So what the automaton would answer, the longest string at each place that another
row has too, is found over the cluster, for any length, with no string put together from several rows (strings are compared by 64-bit hashes, symbols beside them by 24 bits).

* Strings of 2, 3 and 4 symbols: a chunk asks whether another row has them.
* Of shared strings of k symbols (k = 4, then each of ``ORDERS``) it asks as well whether all their occurrences have the same symbol before, and after.
  Where the next string has one symbol before it, always, a match from here and one from the next place end together. Where a string has one symbol after it, always, a match goes on.
  So only places before a string of several predecessors are to be looked at, and from there only ends after a string of several followers:
  of these strings, up to the next order's length, the chunk asks whether another row has them. They are the branches of the automaton. Then the same is done from the next order on, up to the longest text.

Plan. Texts become chunks of about ``CHUNK`` symbols, once, and one checkpoint of these serves all rounds. What chunks have heard is a checkpoint too; once it is
written, the files of the round's exchanges and the checkpoint before go, so that the disk holds one round and not all (a chunk that doesn't fit its answers is an error). In a round each chunk sends its distinct strings as sorted 40-bit
hashes to buckets of about ``BUCKET`` of them, and each bucket answers with a bit for each: whether another chunk has it too. As strings are
distinct before they are sent, a hot one costs a row a chunk at most. Later rounds ask only where shorter strings all occur. The number of rounds grows with
the logarithm of the longest text. Time and moved bytes are in proportion to the corpus, but for a run of one symbol, whose places branch everywhere: that costs the square of its length in time.

Results for odd input: a null or empty text, or one of white space only, has 0 symbols and null scores; a document whose language has no other
text has null scores; null and empty languages are one language; a null doc_id is scored and stays null; repeated rows are scored each and are references to one
another, as any copies are; an empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import fold, mix, powers, span_hashes, text_slices, word_bounds
from .tables import cut_and_free, documents, uncut

#: Orders: lengths from which on matches are followed to the next order. After the last they are 64 times as large each, as far as texts go.
ORDERS = (4, 16, 64, 256, 512, 1024)
CHUNK = 1 << 21
BUCKET = 1 << 22
#: Tests that are made at once.
BLOCK = 1 << 21

Round = tuple[tuple[str, int], ...]


def _after(k: int) -> int:
    return next((n for n in ORDERS if n > k), 64 * k)


def _before(k: int) -> int:
    return max(n for n in ORDERS if n < k) if k <= ORDERS[-1] else k // 64


def rounds(most: int) -> list[Round]:
    """What is asked in each round, for texts of up to so many symbols: n-grams up to the first order; then tests of one order, and which strings of the next have several symbols beside them."""
    out, k = [(("gram", 2), ("gram", 3)), (("branch", ORDERS[0]),)], ORDERS[0]
    while k < most:
        out.append((("test", k), ("branch", _after(k))) if _after(k) < most else (("test", k),))
        k = _after(k)
    return out


def _known_below(heard: Round) -> int:
    """Matches of fewer symbols are known once this round is heard."""
    kind, k = heard[0]
    return _after(k) if kind == "test" else k


_powers_inverse = np.ones(1, np.uint64)


def _inverses(n: int) -> np.ndarray:
    """1, 1 / m, 1 / m^2, ... modulo 2^64, of the m of ``powers``."""
    global _powers_inverse
    if len(_powers_inverse) < n:
        grown = np.full(max(n, 2 * len(_powers_inverse)), pow(int(powers(2)[1]), -1, 1 << 64), np.uint64)
        grown[0] = 1
        _powers_inverse = np.multiply.accumulate(grown)
    return _powers_inverse


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (61-bit hashes) of the rows, and the first of each row (with a last entry)."""
    low = fold(data)
    inside = _WORD[data]
    starts, ends, _ = word_bounds(data, offsets, inside)
    signs = np.flatnonzero(~inside & ~_BLANK[data])
    at = np.concatenate([starts, signs])
    h = np.concatenate([span_hashes(low, starts, ends), low[signs].astype(np.uint64)]) >> np.uint64(3 if len(starts) else 0)
    h[len(starts) :] = low[signs]
    order = np.argsort(at, kind="stable")
    return h[order].view(np.int64), np.searchsorted(at[order], offsets)


def own_phrases(text: list[int]) -> int:
    """Number of phrases of the incremental parse of a text by itself."""
    root: dict = {}
    here, count = root, 0
    for c in text:
        to = here.get(c)
        if to is None:
            here[c] = {}
            here = root
            count += 1
        else:
            here = to
    return count + (here is not root)


def jumps(longest: list[int]) -> int:
    """Number of phrases of the greedy parse, from the longest match at each place."""
    at = count = 0
    while at < len(longest):
        at += longest[at] or 1
        count += 1
    return count


class Chunk:
    """Documents of a chunk: ids, languages, first symbol of each (with a last entry), codes of the symbols, and the hash of each code.

    ``longest`` is the longest match at each place, as far as it is known: exact where it is below the order that was heard last, else a bound from above.
    Once a chunk is restored its places are those of the rows whose parse is open alone."""

    def __init__(self, ids: list[int | None], langs: list[str], first: np.ndarray, codes: np.ndarray, hashes: np.ndarray):
        self.ids, self.langs, self.hashes = ids, langs, hashes
        self.phrases = np.full(len(ids), -1, np.int32)  # of the rows whose parse is known
        self.lay(first, codes)
        self.longest = self.left.copy()
        self.heads = self.ends = np.zeros(len(codes), bool)

    def lay(self, first: np.ndarray, codes: np.ndarray) -> None:
        """The places: those of the rows whose parse is open."""
        self.first, self.codes, self.open = first, codes, np.flatnonzero(self.phrases < 0)
        self.row = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
        self.left = np.repeat(first[1:], np.diff(first)) - np.arange(len(codes))  # symbols from here to the row's end
        self.sums: np.ndarray | None = None

    def spans(self, begin: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of strings of any lengths."""
        if self.sums is None:
            self.sums = np.zeros(len(self.codes) + 1, np.uint64)
            np.cumsum(self.hashes[self.codes] * powers(len(self.codes))[: len(self.codes)], dtype=np.uint64, out=self.sums[1:])
        return mix((self.sums[begin + size] - self.sums[begin]) * _inverses(len(self.codes) + 1)[begin] + np.asarray(size).astype(np.uint64))

    @staticmethod
    def dump(ids: list[int | None], langs: list[str], first: np.ndarray, h: np.ndarray) -> bytes:
        hashes, codes, count = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")  # frequent symbols have small codes: their high bytes are 0
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        planes = np.ascontiguousarray(rank[codes].view(np.uint8).reshape(-1, 4).T)
        raw = pickle.dumps((ids, langs, first, planes.tobytes(), hashes[order]), 5)
        sizes: dict[str, int] = {}
        for lang, n in zip(langs, np.diff(first).tolist(), strict=True):
            sizes[lang] = sizes.get(lang, 0) + n
        head = pickle.dumps(sizes, 5)
        return b"".join([len(head).to_bytes(8, "little"), head, len(raw).to_bytes(8, "little"), pa.Codec("zstd", 6).compress(raw, asbytes=True)])

    @staticmethod
    def sizes(blob: bytes) -> dict[str, int]:
        """Symbols by language."""
        return pickle.loads(blob[8 : 8 + int.from_bytes(blob[:8], "little")])

    @classmethod
    def load(cls, blob: bytes) -> Chunk:
        at = 16 + int.from_bytes(blob[:8], "little")
        ids, langs, first, planes, hashes = pickle.loads(pa.Codec("zstd").decompress(blob[at:], int.from_bytes(blob[at - 8 : at], "little"), asbytes=True))
        codes = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
        return cls(ids, langs, first, codes, hashes)

    def save(self, k: int) -> bytes:
        """What is known of the places once matches of fewer than k symbols are: rows without longer ones are parsed, and of the others it is the matches and branches."""
        left = np.zeros(len(self.open), bool)
        left[self.row[self.longest >= k]] = True
        for r in np.flatnonzero(~left).tolist():
            self.phrases[self.open[r]] = jumps(self.longest[self.first[r] : self.first[r + 1]].tolist())
        some = left[self.row]
        longest = self.longest[some]
        far = np.diff(np.append(longest + np.arange(len(longest)), 0)).astype(np.int32)  # ends of matches: equal over long stretches
        raw = self.phrases.tobytes() + far.view(np.uint8).reshape(-1, 4).T.tobytes() + np.packbits(self.heads[some]).tobytes() + np.packbits(self.ends[some]).tobytes()
        return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True)

    def restore(self, blob: bytes) -> None:
        raw = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True), np.uint8)
        self.phrases = raw[: 4 * len(self.ids)].view(np.int32).copy()
        sizes = np.diff(self.first)
        self.lay(np.append(0, np.cumsum(sizes[self.phrases < 0])), self.codes[np.repeat(self.phrases < 0, sizes)])
        n, raw = len(self.codes), raw[4 * len(self.ids) :]
        far = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view(np.int32).ravel()
        self.longest = -np.cumsum(far[::-1], dtype=np.int64)[::-1] - np.arange(n)
        self.heads, self.ends = (np.unpackbits(bits, count=n).astype(bool) for bits in (raw[4 * n : 4 * n + -(-n // 8)], raw[4 * n + -(-n // 8) :]))

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places with a match of k symbols, and for each the first place after it without one."""
        at = np.flatnonzero(self.longest >= k)
        last = np.flatnonzero(np.append(at[1:] != at[:-1] + 1, True)[: len(at)])
        return at, np.repeat(at[last] + 1, np.diff(np.append(-1, last)))

    def branching(self, k: int) -> np.ndarray:
        """Places whose matches of k symbols may have several symbols before or after them. Those of a longer string are among those of its first and last symbols."""
        at = np.flatnonzero(self.longest >= k)
        return at[self.heads[at] | self.ends[at + (k - _before(k))]] if k > ORDERS[0] else at

    def starts(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places before a head, in the order of their strings up to where tests end; the first of each string in that order; a row that has it, and whether several do."""
        none = np.zeros(0, np.int64)
        at, stop = self.runs(k)
        some = np.flatnonzero(at + 1 < stop)
        some = some[self.heads[at[some] + 1]]
        if not len(some):
            return none, none, none, none.astype(bool)
        begin = at[some]
        string = self.spans(begin, np.minimum(stop[some] - 1 + k - begin, _after(k)))
        order = np.argsort(string)
        begin, string = begin[order], string[order]
        new = np.append(True, string[1:] != string[:-1])
        heads, row = np.flatnonzero(new), self.row[begin]
        return begin, heads, row[heads], _several(row, new, len(heads))

    def tests(self, k: int, begin: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(which of the given places, they, number of tests of each, ends of the tests): at a place before a head, a match goes on to each place of several followers, if its string up to there and one symbol more is shared.
        In blocks, as a text of one symbol has very many."""
        if not len(begin):
            return
        at, stop = self.runs(k)
        stop = stop[np.searchsorted(at, begin)]
        at = at[:-1][self.ends[at[:-1]] & (at[1:] == at[:-1] + 1)]
        i = np.searchsorted(at, begin)
        count = np.searchsorted(at, np.minimum(stop - 1, begin + _after(k) - k)) - i
        total = np.cumsum(count)
        a = 0
        while a < len(begin):
            b = max(a + 1, int(np.searchsorted(total, total[a] - count[a] + BLOCK, "right")))
            n = count[a:b]
            yield slice(a, b), begin[a:b], n, at[np.arange(int(n.sum())) + np.repeat(i[a:b] - (np.cumsum(n) - n), n)] + k + 1
            a = b

    def ask(self, kind: str, k: int, buckets: int, hearing: bool) -> Asked:
        """What a round asks for; to send it, or (hearing) to read the answers."""
        if kind == "test":
            asked = Asked(0, buckets, hearing)
            begin, heads, row, several = self.starts(k)
            for some, first, n, end in self.tests(k, begin[heads]):
                first = np.repeat(first, n)
                asked.add(self.spans(first, end - first), np.repeat(row[some], n), np.repeat(several[some], n))
            return asked
        asked = Asked(2 * (kind == "branch"), buckets, hearing)
        at = np.flatnonzero(self.longest >= k) if kind == "gram" else self.branching(k)
        asked.at = at
        more = []
        if kind == "branch" and not hearing:
            mark = np.maximum(self.hashes >> np.uint64(40), np.uint64(2)).astype(np.int32)  # 0: several, 1: the row's begin or end
            more = [np.where(at == self.first[self.row[at]], 1, mark[self.codes[at - 1]]), np.where(self.left[at] == k, 1, mark[self.codes[np.minimum(at + k, len(self.codes) - 1)]])] if len(at) else [at, at]
        asked.add(self.spans(at, k), self.row[at], np.zeros(len(at), bool), *more)
        return asked

    def told(self, kind: str, k: int, asked: Asked, answers: dict[int, bytes]) -> None:
        bits = asked.hear(answers)
        size = len(self.codes)
        if kind == "test":
            self.tested(k, asked, bits[0])
            return
        if kind == "gram" or k == ORDERS[0]:
            # n-grams at these places occur in another row, those elsewhere don't: matches get shorter.
            stop = np.ones(size + 1, bool)
            stop[asked.at[bits[0][asked.which]]] = False
            none = np.flatnonzero(stop)
            run = np.repeat(none, np.diff(np.append(-1, none)))[:size] - np.arange(size)  # consecutive n-grams that occur
            self.longest = np.minimum(self.longest, run + (k - 1))
        if kind == "branch":
            self.heads, self.ends = np.zeros(size, bool), np.zeros(size, bool)
            self.heads[asked.at[bits[1][asked.which]]] = True
            self.ends[asked.at[bits[2][asked.which]]] = True

    def tested(self, k: int, asked: Asked, shared: np.ndarray) -> None:
        """A string that is always preceded by the same symbol is shared with it: the place before has a match of the same end. So only places before heads were asked about."""
        at, stop = self.runs(k)
        if not len(at):
            return
        far = stop + (k - 1)
        fixed = at + 1 == stop
        begin, heads, *_ = self.starts(k)
        place = np.searchsorted(at, begin)
        fixed[place] = True
        reach = np.full(len(heads), 1 << 62)  # of the string's first test that isn't shared
        for which, first, n, end in self.tests(k, begin[heads]):
            some = n > 0
            if some.any():
                key = asked.which if len(asked.which) == len(end) else asked.find(self.spans(np.repeat(first, n), end - np.repeat(first, n)))
                reach[which][some] = np.minimum.reduceat(np.where(shared[key], 1 << 62, end - 1 - np.repeat(first, n)), (np.cumsum(n) - n)[some])
        far[place] = np.minimum(far[place], begin + np.repeat(reach, np.diff(np.append(heads, len(begin)))))
        ends = np.flatnonzero(fixed)
        known = np.repeat(far[ends], np.diff(np.append(-1, ends))) - at
        self.longest[at] = np.minimum(known, self.longest[at])


class Asked:
    """Distinct keys in the order of (bucket, 40 bits within it). To be sent: marks of the symbols beside them (0: several). For hearing: whether several rows of the chunk have each, and which key each place has."""

    def __init__(self, kinds: int, buckets: int, hearing: bool):
        self.count, self.kinds, self.hearing = buckets, kinds, hearing
        self.marks = [np.zeros(0, np.int32) for _ in range(kinds)]
        self.key, self.row, self.several = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, bool)
        self.at = self.which = np.zeros(0, np.int64)

    def order(self, g: np.ndarray) -> np.ndarray:
        return (((g & np.uint64(0xFFFFFF)) * np.uint64(self.count) >> np.uint64(24)) << np.uint64(40)) | (g >> np.uint64(24))

    def add(self, g: np.ndarray, row: np.ndarray, several: np.ndarray, *marks: np.ndarray) -> None:
        key = np.concatenate([self.key, self.order(g)])
        if not self.hearing and not self.kinds:
            key.sort()
            self.key = key[_new(key)]
            return
        order = np.argsort(key)
        key = key[order]
        new = _new(key)
        heads = np.flatnonzero(new)
        if not self.hearing:  # marks come in one part
            self.key, self.marks = key[heads], [_one_mark(x[order], heads) for x in marks] if len(heads) else self.marks
            return
        row, several = np.concatenate([self.row, row])[order], np.concatenate([self.several, several])[order]
        group = np.cumsum(new) - 1
        self.which = np.zeros(0, np.int64)
        if not len(self.key):  # the first part; with a second one it is void
            self.which = np.empty(len(key), np.int64)
            self.which[order] = group
        self.key, self.row, self.several = key[heads], row[heads], _several(row, new, len(heads))
        self.several[group[several]] = True

    def find(self, g: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.key, self.order(g))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        buckets, begin = np.unique((self.key >> np.uint64(40)).astype(np.int64), return_index=True)
        return buckets, np.append(begin, len(self.key))

    def blobs(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, its keys and three bytes of each mark)."""
        marks = [np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4)[:, :3]) for x in self.marks]
        buckets, edges = self.edges()
        for b, i, j in zip(buckets.tolist(), edges[:-1], edges[1:], strict=True):
            yield b, b"".join([_squeeze(self.key[i:j]), *(x[i:j].tobytes() for x in marks)])

    def hear(self, answers: dict[int, bytes]) -> list[np.ndarray]:
        """For each key: whether another row has it, and whether it has several symbols before and after."""
        buckets, edges = self.edges()
        kinds = 1 + self.kinds
        if [(b, -(-int(n) // 8) * kinds) for b, n in zip(buckets.tolist(), np.diff(edges), strict=True)] != [(b, len(answers[b])) for b in sorted(answers)]:
            raise ValueError("a chunk isn't what it was when it asked: docs change from one reading to the next")
        out = [np.zeros(len(self.key), bool) for _ in range(kinds)]
        for b, i, j in zip(buckets.tolist(), edges[:-1], edges[1:], strict=True):
            for x, bits in zip(out, np.frombuffer(answers[b], np.uint8).reshape(kinds, -1), strict=True):
                x[i:j] = np.unpackbits(bits, count=j - i)
        out[0] |= self.several
        return out


def _squeeze(key: np.ndarray) -> bytes:
    """Ascending keys of 40 bits: their number, their low bits, and a bit string in which the high bits count up (Elias-Fano)."""
    n = len(key)
    low = 3 if n >= 1 << 13 else 4
    up = np.zeros(n + (1 << (40 - 8 * low)), bool)
    up[((key & np.uint64((1 << 40) - 1)) >> np.uint64(8 * low)).astype(np.int64) + np.arange(n)] = True
    return n.to_bytes(4, "little") + key.astype(np.uint32).view(np.uint8).reshape(-1, 4)[:, :low].tobytes() + np.packbits(up).tobytes()


def _stretch(blob: bytes) -> tuple[np.ndarray, int]:
    """The keys, and the bytes that they took."""
    n = int.from_bytes(blob[:4], "little")
    low = 3 if n >= 1 << 13 else 4
    bits = n + (1 << (40 - 8 * low))
    end = 4 + low * n + -(-bits // 8)
    key = np.zeros((n, 8), np.uint8)
    key[:, :low] = np.frombuffer(blob, np.uint8, low * n, 4).reshape(n, low)
    up = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, end - 4 - low * n, 4 + low * n), count=bits)) - np.arange(n)
    return key.view(np.uint64).ravel() | up.astype(np.uint64) << np.uint64(8 * low), end


def _new(ordered: np.ndarray) -> np.ndarray:
    """Whether each value isn't the one before it."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return new


def _several(value: np.ndarray, new: np.ndarray, groups: int) -> np.ndarray:
    """Whether each group has several values."""
    out = np.zeros(groups, bool)
    out[np.cumsum(new)[1:][(value[1:] != value[:-1]) & ~new[1:]] - 1] = True
    return out


def _one_mark(mark: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The mark of each group, 0 if it has several."""
    least = np.minimum.reduceat(mark, heads)
    return np.where(least == np.maximum.reduceat(mark, heads), least, 0)


_CHUNKS = "chunk long, payload binary"
_MESSAGES = "to long, chunk long, level int, blob binary"


def _pack(most: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        langs: list[str] = []
        parts: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        number = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal number
            h, count = np.concatenate([*parts, np.zeros(0, np.uint64)]), np.concatenate(counts)
            first = np.concatenate([[0], np.cumsum(count)])
            out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([Chunk.dump(ids, langs, first, h)], pa.binary())], ["chunk", "payload"])
            number += 1
            for x in (ids, langs, parts, counts):
                x.clear()
            return out

        held = 0
        for batch in batches:
            for a, b, data, offsets in text_slices(batch["text"]):
                h, first = symbols(data, offsets)
                count = np.diff(first)
                named = batch["lang"].slice(a, b - a).to_pylist()
                # Texts of different languages have no symbol in common.
                seed = {x: np.uint64(int.from_bytes(x.encode()[:256], "little") % ((1 << 61) - 1)) for x in set(named)}
                parts.append(mix(h.view(np.uint64) + mix(np.repeat(np.array([seed[x] for x in named], np.uint64), count))))
                counts.append(count)
                ids.extend(batch["doc_id"].slice(a, b - a).to_pylist())
                langs.extend(named)
                held += len(h)
                if held >= most:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    return run


def _known(batch: pa.RecordBatch, k: int) -> tuple[Chunk, dict[int, bytes], dict[int, dict[int, bytes]]]:
    """The chunk of a row, what it has kept of each level, and the buckets' answers."""
    kept: dict[int, bytes] = {}
    answers: dict[int, dict[int, bytes]] = {}
    for m in batch["messages"][k].as_py() or []:
        if m["to"] < 0:
            kept[m["level"]] = m["blob"]
        else:
            answers.setdefault(m["level"], {})[m["to"]] = m["blob"]
    return Chunk.load(batch["payload"][k].as_py()), kept, answers


def _hear(chunk: Chunk, kept: dict[int, bytes], answers: dict[int, dict[int, bytes]], asked: Round, buckets: int) -> None:
    """Applies the answers to a round."""
    if 0 in kept:
        chunk.restore(kept[0])
    all_asked = [chunk.ask(kind, k, buckets, True) for kind, k in asked]  # all are asked for before any is heard
    for level, ((kind, k), one) in enumerate(zip(asked, all_asked, strict=True)):
        chunk.told(kind, k, one, answers.get(level, {}))


def _ask(before: Round, now: Round, buckets: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The messages of a round: strings to the buckets, and what is known so far to the chunk itself (by a negative address)."""
        for batch in batches:
            for k in range(batch.num_rows):
                i = batch["chunk"][k].as_py()
                chunk, kept, answers = _known(batch, k)
                _hear(chunk, kept, answers, before, buckets)
                out = [(-1 - i, 0, chunk.save(_known_below(before)))] if before else []
                for level, (kind, n) in enumerate(now):
                    out.extend((b, level, blob) for b, blob in chunk.ask(kind, n, buckets, False).blobs())
                for a in range(0, len(out), 1024):
                    to, level, blob = zip(*out[a : a + 1024], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array([i] * len(to), pa.int64()), pa.array(level, pa.int32()), pa.array(blob, pa.binary())], ["to", "chunk", "level", "blob"])

    return run


def _shared_bits(blobs: list[bytes], marks: int) -> list[bytes]:
    """For each chunk's keys of a bucket, a bit a key: whether another chunk has it; and one for each mark: whether there are several."""
    keys, begin = zip(*map(_stretch, blobs), strict=True)
    sizes = [len(x) for x in keys]
    key = np.concatenate(keys)
    order = np.argsort(key)
    ordered = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    heads = np.flatnonzero(~same[:-1])
    out = [same[1:] | same[:-1]]
    for m in range(marks):
        mark = np.concatenate([np.frombuffer(b, np.uint8, 3 * n, a + 3 * m * n) for b, n, a in zip(blobs, sizes, begin, strict=True)]).reshape(-1, 3).astype(np.int32)
        out.append(np.repeat(_one_mark((mark[:, 0] | mark[:, 1] << 8 | mark[:, 2] << 16)[order], heads) == 0, np.diff(np.append(heads, len(key)))))
    bits = []
    for x in out:
        has = np.empty(len(key), bool)
        has[order] = x
        bits.append(np.split(has, np.cumsum(sizes)[:-1]))
    return [b"".join(np.packbits(x).tobytes() for x in one) for one in zip(*bits, strict=True)]


def _answer(asked: Round):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of (to, level). A chunk's own messages go on as they are."""
        at, chunks, blobs = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            bits = _shared_bits(blobs, 2 * (asked[at[1]][0] == "branch")) if blobs else []
            for a in range(0, len(bits), 1024):
                some, n = bits[a : a + 1024], len(bits[a : a + 1024])
                yield pa.RecordBatch.from_arrays([pa.array([at[0]] * n, pa.int64()), pa.array(chunks[a : a + n], pa.int64()), pa.array([at[1]] * n, pa.int32()), pa.array(some, pa.binary())], ["to", "chunk", "level", "blob"])
            chunks.clear()
            blobs.clear()

        for batch in batches:
            own = batch.filter(pa.array(batch["to"].to_numpy() < 0))
            if own.num_rows:
                yield own
            for to, chunk, level, blob in zip(batch["to"].to_pylist(), batch["chunk"].to_pylist(), batch["level"].to_pylist(), batch["blob"], strict=True):
                if to < 0:
                    continue
                if (to, level) != at:
                    yield from close()
                    at = (to, level)
                chunks.append(chunk)
                blobs.append(blob.as_py())
        yield from close()

    return run


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch["payload"]:
            sizes = Chunk.sizes(blob.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(list(sizes), pa.string()), pa.array(list(sizes.values()), pa.int64())], ["lang", "size"])


_COUNTS = "doc_id long, lang string, n_symbols int, phrases int, own_phrases int"


def _count(before: Round, buckets: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, kept, answers = _known(batch, k)
                codes, first = chunk.codes.tolist(), chunk.first
                spans = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                _hear(chunk, kept, answers, before, buckets)
                phrases = chunk.phrases.copy()
                phrases[chunk.open] = [jumps(chunk.longest[a:b].tolist()) for a, b in zip(chunk.first[:-1], chunk.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(chunk.ids, pa.int64()), pa.array(chunk.langs, pa.string()), pa.array(np.diff(first), pa.int32()),
                    pa.array(phrases, pa.int32()), pa.array([own_phrases(codes[a:b]) for a, b in spans], pa.int32()),
                ], ["doc_id", "lang", "n_symbols", "phrases", "own_phrases"])

    return run


def cross_parse(docs: DataFrame, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, the counts and the two scores, for every row of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    # A symbol has about five bytes. Those of long texts are counted: words, and what is neither of a word nor white space.
    length = F.when(F.octet_length("text") <= 64 * ORDERS[-1], F.octet_length("text")).otherwise(F.length(F.regexp_replace(F.regexp_replace("text", r"[0-9A-Za-z\x{80}-\x{10FFFF}]+", "w"), r"[\t-\r ]+", "")))
    size, most = texts.agg(F.sum(F.octet_length("text")), F.max(length)).first()
    size, most = size or 0, most or 0
    buckets = min(1 << 24, max(1, -(-size // (5 * bucket))))
    # A fixed number of partitions, so that chunks don't move again to meet their messages.
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = cut_and_free(spark, lambda: texts.mapInArrow(_pack(chunk), _CHUNKS).repartition(places, "chunk"))
    totals = chunks.mapInArrow(_sizes, "lang string, size long").groupBy("lang").agg(F.sum("size").alias("total"))
    state = chunks.withColumn("messages", F.lit(None).cast("array<struct<to: long, level: int, blob: binary>>"))
    before: Round = ()
    last = None

    def hear() -> DataFrame:
        answers = state.mapInArrow(_ask(before, asked, buckets), _MESSAGES).repartition("to").sortWithinPartitions("to", "level").mapInArrow(_answer(asked), _MESSAGES)
        return answers.repartition(places, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("to", "level", "blob")).alias("messages"))

    for asked in rounds(most):
        heard = cut_and_free(spark, hear)
        if last is not None:
            uncut(last)
        state, before, last = chunks.join(heard, "chunk", "left"), asked, heard
    counts = state.mapInArrow(_count(before, buckets), _COUNTS)
    n, c, s = F.col("n_symbols"), F.col("phrases"), F.col("own_phrases")
    size = F.col("total") - n
    cost = F.when((n > 0) & (size > 0), c * F.log2(F.greatest(size, F.lit(2)).cast("double")))
    return counts.join(totals, "lang").select(
        "doc_id", "n_symbols", size.alias("reference_symbols"), "phrases", "own_phrases",
        (cost / n).alias("cross_entropy"), ((cost - s * F.log2(F.greatest(s, F.lit(1)).cast("double"))) / n).alias("relative_entropy"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_parse(documents(spark, sf_dir))
