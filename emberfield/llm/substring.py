"""Exact substring de-duplication with one FM-index per shard.

A window is ``window`` consecutive words of one document.  Words are removed that lie in a window
whose word sequence also starts earlier (smaller doc_id, or same document and earlier start).

1. Every window contains an anchor: the run of ``anchor`` words with the least hash in it.  Equal
   windows have equal anchors, so only anchors that occur twice in the corpus need a closer look
   (one count per anchor hash, combined before the shuffle).  Neighbouring windows that share an
   anchor form a segment.  Of documents with equal texts only the first is looked at; the others are
   repeats as a whole.
2. Segments are dealt out by anchor and sorted.  Later copies of a whole segment are repeats; anchors
   left with several different segments are gathered into shards of bounded size.  A shard's
   segments become one text.  Its suffixes are sorted by their first ``window`` words, the
   Burrows-Wheeler transform goes into a wavelet matrix of packed bits, and the segments are streamed
   through backward search from their ends: every step extends the match by one word to the left,
   and a match that has reached the window length is first cut to ``window`` - 1 words (the interval
   widens to its group).  These matching statistics, capped at the window length, give for each
   window its suffix interval; the window is reported if the interval holds an earlier place.
3. An anchor with more than ``hot`` places (a passage in a large share of all documents) would
   overfill one shard.  Its segments are compared by the hash of their content instead, and what is
   left by the hash of single windows: the earliest place of each hash is found by a grouped minimum,
   combined before the shuffle.
4. Reported intervals are merged per document and their words removed.

Word and window hashes have 64 bits; words within a shard are told apart by 32 of them, beside the
anchor's 64.

Defined results: a null text has no words; a document shorter than the window keeps all its words;
rows with the same doc_id and text count as one place; texts that share a doc_id are judged one by one,
in the order of a hash of the text (which also tells their rows apart); rows without doc_id are kept whole and take no
part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, materialize

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words: a polynomial of their hashes, mixed."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for k in range(n):
            out = out * _ODD + h[k : len(h) - n + 1 + k]
        return _mix(out)


def _anchors(h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each anchor-sized run, and for each window the place of its anchor (the first of the least)."""
    runs = _rolling(h, anchor)
    places = np.arange(len(runs))
    width = window - anchor + 1
    # Least (hash, place) within a sliding width, by doubling.
    span, best = 1, places
    while span < width:
        step = min(span, width - span)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(runs[b] < runs[a], b, a)
        span += step
    return runs, best


def _stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch of equal values."""
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(at) - 1]])


class WaveletMatrix:
    """Rank queries over a sequence of small numbers, bits packed into 64-bit words."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.n, self.levels = len(values), []
        for bit in reversed(range(max(1, int(sigma - 1).bit_length()))):
            on = (values >> bit) & 1
            padded = np.zeros(-(-(self.n + 1) // 64) * 64, np.uint8)
            padded[: self.n] = on
            packed = np.packbits(padded, bitorder="little").view("<u8")
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))])[:-1]
            zeros = self.n - int(on.sum())
            self.levels.append((bit, packed, counts, zeros))
            values = np.concatenate([values[on == 0], values[on == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        lo, hi = np.zeros_like(at), at
        for bit, packed, counts, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            a, b = self._ones(packed, counts, lo), self._ones(packed, counts, hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    @staticmethod
    def _ones(packed: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return counts[block] + np.bitwise_count(packed[block] & mask).astype(np.int64)


class FMIndex:
    """FM-index of a shard for patterns of at most ``depth`` words; symbol 0 separates its segments."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        self.depth, n = depth, len(text)
        ranks, length, by_depth = text.astype(np.int64), 1, {}
        # Prefix doubling up to the depth; ranks for depth - 1 and depth are kept.
        while length * 2 < depth:
            ranks, length = self._joined(ranks, length), length * 2
        for d in (depth - 1, depth):
            by_depth[d] = self._joined(ranks, d - length)
        full = by_depth[depth]
        self.suffixes = np.argsort(full, kind="stable")
        self.first = np.searchsorted(np.sort(text), np.arange(sigma + 1))
        self.bwt = WaveletMatrix(text[self.suffixes - 1].astype(np.int64), sigma)
        wide = by_depth[depth - 1][self.suffixes]
        self.wide_lo, self.wide_hi = np.searchsorted(wide, wide, "left"), np.searchsorted(wide, wide, "right")
        order = full[self.suffixes]
        starts = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]])) if n else np.zeros(0, int)
        self.earliest = np.repeat(
            np.minimum.reduceat(self.suffixes, starts) if n else starts, np.diff(np.concatenate([starts, [n]]))
        )

    @staticmethod
    def _joined(ranks: np.ndarray, shift: int) -> np.ndarray:
        """Ranks by the pair of a place's rank and the rank ``shift`` further on (none beyond the end)."""
        n = len(ranks)
        later = np.zeros(n, np.int64)
        later[: n - shift] = ranks[shift:] + 1
        return np.unique(ranks * (n + int(ranks.max(initial=0)) + 2) + later, return_inverse=True)[1]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward-search step for many intervals at once."""
        first = self.first[symbol]
        return first + self.bwt.rank(symbol, lo), first + self.bwt.rank(symbol, hi)

    def match(self, segments: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows of the segments (all of which are in the index), from their ends to their starts.

        Yields (segment, start, earliest place in the index) for windows of ``depth`` words.
        """
        sizes = np.array([len(s) for s in segments])
        order = np.argsort(-sizes, kind="stable")
        sizes, ends = sizes[order], np.cumsum(sizes)[order]
        flat = np.concatenate(segments)
        lo = np.zeros(len(order), np.int64)
        hi = np.full(len(order), len(self.suffixes), np.int64)
        for step in range(int(sizes[0])):
            on = int(np.searchsorted(-sizes, -step, "left"))
            lo, hi = lo[:on], hi[:on]
            if step >= self.depth:
                lo, hi = self.wide_lo[lo], self.wide_hi[hi - 1]
            lo, hi = self.extend(flat[ends[:on] - 1 - step], lo, hi)
            if step >= self.depth - 1:
                yield order[:on], sizes[:on] - 1 - step, self.earliest[lo]


def repeated_in_shard(segments: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, start) of the windows that also start earlier; segments are in order and hold word codes."""
    codes, flat = np.unique(np.concatenate(segments), return_inverse=True)
    flat = flat + 1
    sizes = np.array([len(s) for s in segments])
    starts = np.cumsum(sizes + 1) - sizes  # a separator stands before each segment
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    inside = np.ones(len(text), bool)
    inside[starts - 1] = False
    text[inside] = flat
    index = FMIndex(text, len(codes) + 1, window)
    cut = np.cumsum(sizes)[:-1]
    found = [
        (seg[hit], at[hit])
        for seg, at, earliest in index.match(np.split(flat, cut))
        if (hit := earliest < starts[seg] + at).any()
    ]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _anchor_counts(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc_id, part, anchor): one row per stretch of windows that share an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, parts, found = [], [], []
            for doc, part, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = _word_hashes((text or "").encode().split())
                if len(h) >= window:
                    runs, at = _anchors(h, window, anchor)
                    own = runs[at[_stretches(at)[0]]]
                    ids.append(np.full(len(own), doc, np.int64))
                    parts.append(np.full(len(own), part, np.int64))
                    found.append(own.view(np.int64))
            empty = np.zeros(0, np.int64)
            columns = [pa.array(np.concatenate(c or [empty])) for c in (ids, parts, found)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "anchor"])

    return docs.select("doc_id", "part", "text").mapInArrow(run, "doc_id long, part long, anchor long")


PLACES = "hot boolean, key long, doc_id long, part long, start int, words binary"
ROW = ["doc_id", "part"]


def _places(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Segments of repeated anchors; docs has doc_id, part, text, cold and hot.

    A cold segment is keyed by its anchor and holds its word codes; a hot one is keyed by its content
    and holds its window hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hot_, key, doc_, part_, start, words = [], [], [], [], [], []
            for i, (doc, part, text) in enumerate(zip(*(c.to_pylist() for c in b.columns[:3]), strict=True)):
                h = _word_hashes((text or "").encode().split())
                if len(h) < window:
                    continue
                runs, at = _anchors(h, window, anchor)
                first, last = _stretches(at)
                own = runs[at[first]]
                sets = [np.array(c[i].as_py() or [], np.int64).view(np.uint64) for c in (b.column(3), b.column(4))]
                cold, hot = (np.isin(own, s) if len(s) else np.zeros(len(own), bool) for s in sets)
                codes = (h >> np.uint64(32)).astype("<u4")
                for k in np.flatnonzero(cold):
                    hot_.append(False)
                    key.append(int(own[k].view(np.int64)))
                    doc_.append(doc)
                    part_.append(part)
                    start.append(int(first[k]))
                    words.append(codes[first[k] : last[k] + window].tobytes())
                if hot.any():
                    w = _rolling(h, window)
                    for k in np.flatnonzero(hot):
                        own_windows = w[first[k] : last[k] + 1].tobytes()
                        hot_.append(True)
                        key.append(xxhash.xxh64_intdigest(own_windows) - (1 << 63))
                        doc_.append(doc)
                        part_.append(part)
                        start.append(int(first[k]))
                        words.append(own_windows)
            types = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip((hot_, key, doc_, part_, start, words), types, strict=True)],
                ["hot", "key", "doc_id", "part", "start", "words"],
            )

    return docs.select("doc_id", "part", "text", "cold", "hot").mapInArrow(run, PLACES)


def _by_index(segments: DataFrame, window: int, shard_words: int) -> DataFrame:
    """(doc_id, part, start, end) of repeated word intervals, by the FM-indexes of all shards."""
    names = ["doc_id", "part", "start", "end"]

    def search(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[:3])
        seg, at = repeated_in_shard([np.frombuffer(r[3], "<u4") for r in rows], window)
        order = np.lexsort([at, seg])
        seg, at = seg[order], at[order]
        # Neighbouring windows of a segment make one interval.
        new = np.ones(len(seg), bool)
        if len(seg):
            new[1:] = (seg[1:] != seg[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(seg)]])[: len(first)] - 1
        doc, part, base = (np.array([r[k] for r in rows], np.int64)[seg[first]] for k in range(3))
        return pa.RecordBatch.from_arrays(
            [pa.array(doc), pa.array(part), pa.array(base + at[first]), pa.array(base + at[last] + window)], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[int, int, int, bytes]] = []
        group: list[tuple[int, int, int, bytes]] = []  # segments of one anchor
        size, previous = 0, None
        later: list[tuple[int, int, int, int]] = []

        def close_group() -> int:
            """Later copies of a segment are repeats as a whole; different segments of an anchor go to the shard."""
            group.sort(key=lambda r: r[:3])
            first: dict[bytes, tuple[int, int, int, bytes]] = {}
            for row in group:
                *place, codes = row
                if first.setdefault(codes, row)[:3] < row[:3]:
                    later.append((*place, row[2] + len(codes) // 4))
            group.clear()
            if len(first) < 2:
                return 0
            shard.extend(first.values())
            return sum(map(len, first)) // 4

        def copies() -> pa.RecordBatch:
            columns = zip(*later, strict=True) if later else [[]] * 4
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
            later.clear()
            return batch

        for b in batches:
            for key, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != previous:
                    size += close_group()
                    if size >= shard_words:
                        yield search(shard)
                        shard.clear()
                        size = 0
                    previous = key
                group.append(tuple(row))
            yield copies()
        close_group()
        if shard:
            yield search(shard)
        yield copies()

    dealt = segments.select("key", *ROW, "start", "words").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "doc_id long, part long, start long, end long")


def _later(rows: DataFrame, *carried: str) -> tuple[DataFrame, DataFrame]:
    """(earliest place of each key with the carried columns, rows at later places).

    Later rows are those that are not the first of their key, found by their own place, so that a key
    with very many rows is spread over all tasks.
    """
    place = [*ROW, "start"]
    first = rows.groupBy("key").agg(F.min(F.struct(*place, *carried)).alias("first")).select("key", "first.*")
    return first, rows.join(first.select("key", *place).hint("merge"), [*place, "key"], "left_anti")


def _by_minimum(segments: DataFrame, window: int) -> DataFrame:
    """The same for hot segments: later copies of a content as a whole, then later copies of single windows."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.frombuffer(w, "<i8") for w in b.column(3).to_pylist()]
            n = np.array([len(w) for w in own], np.int64)
            doc, part = (np.repeat(b.column(k).to_numpy(), n) for k in range(2))
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(b.column(2).to_numpy(), n)
            key = np.concatenate([*own, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, doc, part, at)], ["key", *ROW, "start"])

    first, copies = _later(segments.select("key", *ROW, "start", "words"), "words")
    single = first.select(*ROW, F.col("start").cast("long"), "words").mapInArrow(windows, "key long, doc_id long, part long, start long")
    _, again = _later(single)
    end = F.col("start") + F.octet_length("words") / 8 + (window - 1)
    return copies.select(*ROW, F.col("start").cast("long").alias("start"), end.cast("long").alias("end")).unionByName(
        again.select(*ROW, "start", (F.col("start") + window).alias("end"))
    )


def with_part(docs: DataFrame) -> DataFrame:
    """Adds ``part``, a hash of the text: doc_id and part tell rows apart, and order rows of one id."""
    return docs.withColumn("part", F.xxhash64(F.coalesce("text", F.lit(""))))


def intervals(docs: DataFrame, window: int = 20, anchor: int = 6, hot: int = 2000, shard_words: int = 400_000) -> DataFrame:
    """Per row (doc_id, part): ``intervals`` (array of start, end in words), and ``whole`` if its text is a later copy."""
    bounded_batches(docs.sparkSession)
    docs = docs.filter("doc_id is not null").select(*ROW, F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.select(*ROW, F.xxhash64(F.lit(11), "text").alias("again"))
    # The first of each text; any other row with an equal text has another id and is a later copy.
    firsts = keyed.groupBy("part", "again").agg(F.min("doc_id").alias("doc_id"))
    copies = keyed.join(firsts.hint("merge"), ["doc_id", "part", "again"], "left_anti").select(*ROW).distinct()
    copies = materialize(copies.withColumn("whole", F.lit(True)), "copies")

    placed = _anchor_counts(docs, window, anchor)
    counts = placed.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    counts = materialize(counts.select("anchor", (F.col("n") > hot).alias("is_hot")), "anchors")
    flagged = placed.join(counts.hint("merge"), "anchor").groupBy(*ROW).agg(
        F.collect_set(F.when(~F.col("is_hot"), F.col("anchor"))).alias("cold"),
        F.collect_set(F.when(F.col("is_hot"), F.col("anchor"))).alias("hot"),
    )
    todo = flagged.join(copies.hint("merge"), ROW, "left_anti")
    places = materialize(_places(docs.join(todo.hint("merge"), ROW), window, anchor), "places")
    found = _by_index(places.filter("not hot"), window, shard_words).unionByName(_by_minimum(places.filter("hot"), window))
    merged = found.groupBy(*ROW).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("intervals"))
    return merged.join(copies.hint("merge"), ROW, "full_outer")


def _kept(words: list[bytes], found: list[dict] | None, whole: bool | None, window: int) -> list[bytes]:
    if whole and len(words) >= window:
        return []
    kept, upto = [], 0
    for interval in found or []:
        if interval["start"] > upto:
            kept += words[upto : interval["start"]]
        upto = max(upto, interval["end"])
    return kept + words[upto:]


def remove_repeats(docs: DataFrame, window: int = 20, carry: str | None = None, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and text of every document.

    The text stays as it is where nothing is removed; otherwise it is the kept words joined by one
    space.  Each row gives one row, also where ids repeat; the column ``carry`` stays as it was.
    """
    carried = [carry] if carry else []
    own = with_part(docs.select("doc_id", "text", *carried))
    found = intervals(own, window, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, digest, texts = [], [], [], []
            for text, own, whole in zip(*(c.to_pylist() for c in b.columns[1:4]), strict=True):
                words = (text or "").encode().split()
                kept = _kept(words, own, whole, window)
                joined = b" ".join(kept)
                n.append(len(words))
                removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(joined).hexdigest())
                texts.append(text if len(kept) == len(words) else joined.decode())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(texts, pa.string()), *b.columns[4:]],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "text", *carried],
            )

    rows = own.join(found.hint("merge"), ROW, "left")
    shape = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, text string")
    for c in carried:
        shape = shape.add(c, docs.schema[c].dataType)
    return rows.select("doc_id", "text", "intervals", "whole", *carried).mapInArrow(run, shape)
