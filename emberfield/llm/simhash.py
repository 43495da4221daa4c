"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has a bit set where over half of the text's shingle hashes have it (XXH64, seed 42, of
word shingles in lower case; repeats count).  Fingerprints with at most ``distance`` differing bits
share at least 8 - ``distance`` of their 8 bytes at the same positions.  For the usual distance of 4
these are 4 of 8, and among any 4 positions one of 20 fixed position triples is contained, so the
index posts each distinct fingerprint under its 20 byte triples.  A posting list holds a triple, so
its pairs share three positional bytes; within the list the equal bytes of each pair are tallied over
all positions.  Pairs below the guaranteed minimum are dropped by their count alone; only the rest
are verified bit by bit.  Lists longer than
``list_rows`` are dealt out as pairs of blocks.
A list yields a spanning forest of its verified links, never all pairs.

Defined results: a text without words (or null) has fingerprint zero and is linked like any other;
exact copies share one index entry; a row without doc_id gets a fingerprint but no component; rows
with the same doc_id share the smallest component of their texts only through that id; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize
from .graph import components

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def position_sets(shared: int, positions: int = 8) -> list[tuple[int, ...]]:
    """Position sets of which each ``shared`` positions contain one, as few as are simple to state.

    With 8 positions and 4 shared: 20 triples over the groups 012, 345 and 67 (all of one group, or two
    of a group and one of the next).  Other values: all sets of ``shared`` - 1 positions, or of one.
    """
    if (positions, shared) != (8, 4):
        return list(itertools.combinations(range(positions), max(1, shared - 1)))
    found = []
    for triple in itertools.combinations(range(8), 3):
        thirds = [sum(p // 3 == g if p < 6 else g == 2 for p in triple) for g in range(3)]
        # Groups {0,1,2} {3,4,5} {6,7}: all of one group, or two of a group and one of the next.
        if 3 in thirds or any(thirds[g] == 2 and thirds[(g + 1) % 3] == 1 for g in range(3)):
            found.append(triple)
    return found


def fingerprint(text: str | None, n: int = 4) -> int:
    data = (text or "").encode().translate(_LOWER).split()
    if not data:
        return 0
    joined = b" ".join(data)
    ends = np.cumsum([len(w) + 1 for w in data]).tolist()
    if len(data) <= n:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : z - 1], 42) for a, z in zip([0, *ends], ends[n - 1 :], strict=False)]
    h = np.array(hashes, "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        bits = np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 4) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit number."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, n) for t in b.column(1).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _bytes(fp: np.ndarray, positions: int = 8) -> np.ndarray:
    return np.ascontiguousarray(fp).view(np.uint8).reshape(-1, positions)


def _tallies(left: np.ndarray, right: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of two sets of fingerprints that share at least so many positional bytes.

    A pair counts one for every position at which both are posted under the same byte.
    """
    a, b = _bytes(left), _bytes(right)
    tally = np.zeros((len(a), len(b)), np.uint8)
    for x, y in zip(a.T.copy(), b.T.copy(), strict=True):
        tally += x[:, None] == y[None, :]
    return np.nonzero(tally >= shared)


def _paired(left: np.ndarray, right: np.ndarray, shared: int) -> np.ndarray:
    """The same for pairs that stand side by side: which of them share so many positional bytes."""
    return np.count_nonzero(_bytes(left) == _bytes(right), axis=1) >= shared


def _forest(fp: np.ndarray, shared: int, distance: int, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links of one posting list: each member to a smaller-placed one, no more than its members."""
    n = len(fp)
    label = np.arange(n)
    links_a, links_b = [], []
    for lo in range(0, n, block):
        left = fp[lo : lo + block]
        for at in range(lo, n, block):
            i, j = _tallies(left, fp[at : at + block], shared)
            i, j = i + lo, j + at
            keep = i < j
            i, j = i[keep], j[keep]
            near = np.bitwise_count(fp[i] ^ fp[j]) <= distance
            i, j = i[near], j[near]
            while len(i):
                a, b = label[i], label[j]
                open_ = a != b
                i, j, a, b = i[open_], j[open_], a[open_], b[open_]
                if not len(i):
                    break
                # One link per upper label joins it to a lower one; then labels are brought up to date.
                upper, lower = np.maximum(a, b), np.minimum(a, b)
                _, first = np.unique(upper, return_index=True)
                links_a.append(i[first])
                links_b.append(j[first])
                label[upper[first]] = lower[first]
                while True:
                    up = label[label]
                    if (up == label).all():
                        break
                    label = up
    if links_a:
        yield np.concatenate(links_a), np.concatenate(links_b)


def links(fps: DataFrame, distance: int = 4, list_rows: int = 4096) -> DataFrame:
    """Links (u, v) that connect all pairs of distinct fingerprints within the distance."""
    shared = 8 - distance
    fps = fps.select("fp").distinct()
    keys = []
    for k, positions in enumerate(position_sets(shared)):
        key = F.lit(k).cast("long")
        for p in positions:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)))
        keys.append(key)
    posted = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    lengths = posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    lengths = lengths.withColumn("blocks", F.ceil(F.col("n") / list_rows).cast("int")).drop("n")
    in_lists = posted.join(lengths.hint("merge"), "key")
    # A list of several blocks: each member goes to the pairs of blocks that its own block is in.
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = in_lists.withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select(
        "key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "fp"
    )
    dealt = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: np.ndarray | None = None

        def linked(rows: np.ndarray) -> pa.RecordBatch:
            ids, fp = rows[:, :3], np.ascontiguousarray(rows[:, 3]).view(np.uint64)
            same = (ids[1:] == ids[:-1]).all(axis=1)
            starts = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(rows)]])
            size = np.diff(starts)
            us, vs = [], []
            # Lists of two, by far the most, in one go.
            two = starts[:-1][size == 2]
            two = two[_paired(fp[two], fp[two + 1], shared)]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
            us.append(fp[two])
            vs.append(fp[two + 1])
            for k in np.flatnonzero(size > 2):
                own = fp[starts[k] : starts[k + 1]]
                for i, j in _forest(own, shared, distance):
                    us.append(own[i])
                    vs.append(own[j])
            u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            rows = np.stack([np.asarray(c).astype(np.int64) for c in b.columns], axis=1)
            rows = rows if rest is None else np.concatenate([rest, rows])
            if not len(rows):
                continue
            # The last list may go on in the next batch.
            last = int((rows[:, :3] == rows[-1, :3]).all(axis=1).argmax())
            rest = rows[last:]
            if last:
                yield linked(rows[:last])
        if rest is not None and len(rest):
            yield linked(rest)

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, n: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of documents."""
    marked = materialize(fingerprints(docs, n), "fingerprints")
    first = marked.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = links(marked, distance)
    grouped = components(found)
    # Smallest document of each fingerprint, then of each component of fingerprints.
    named = first.join(grouped.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_fp = named.select("fp", "component").join(smallest.hint("merge"), "component").select("fp", "component_id")
    return marked.join(of_fp.hint("merge"), "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
