"""Vector codes: 16 codebooks of integer parts, refined by ball k-means with exact ties.

Every vector becomes integers floor(256 * x) and is cut into 16 equal consecutive parts; each part is
named by the nearest entry of its position's codebook.  Assignment follows ball k-means.  The parts
that an entry held before form its ball around the entry's present place:

* a ball's neighbours are the entries no farther from its own than twice its radius; others can't be
  nearest to any of its parts;
* a ball whose entry and neighbours did not move since its parts were assigned keeps all of them;
* parts nearer to their entry than half the way to the nearest other entry are its stable core and
  stay without further distances;
* the others lie in annular rings between the halves of the ordered neighbour distances: a part at
  distance d meets only the entries within 2 * d of its own.

Squared distances are integers throughout, and entries at exactly twice the distance take part, so
ties go to the lower index as with all distances computed.  A ball is taken per block of rows, whose
radius is at most that of the whole ball, so no pass over the table is needed for radii.  The first
assignment starts from the entry nearest in the part's first number.  Each round is written to the
shared folder; sums of parts are combined per task, and what reaches the driver is codebooks alone
(16 x 64 entries) and their sums.

Defined results: vectors that are null or hold a null or non-finite component take no part; with
fewer than 64 kept rows the codebooks are as short; of equal ids the smaller vector comes first, rows
without an id come last and are coded too; repeated rows are each coded; of vectors of another length
than the first kept one none is coded; a length that 16 does not divide, or an integer of 2**26 or
more, raises; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gathered, materialize

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Codes that are not assigned yet.
_NONE = 255


def _nearest(x: np.ndarray, held: np.ndarray, book: np.ndarray, still: np.ndarray, pairs: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part, starting from the entry that held it.

    x: (n, d), book: (k, d), still: (k) entries that have not moved since ``held`` was found.
    """
    between = ((book[:, None] - book[None]) ** 2).sum(-1)
    order = np.argsort(between, axis=1, kind="stable")
    away = np.take_along_axis(between, order, axis=1)
    own = ((x - book[held]) ** 2).sum(-1)
    by_ball = np.argsort(held, kind="stable")
    ends = np.searchsorted(held[by_ball], np.arange(len(book) + 1))
    meets = np.zeros(len(x), np.int64)
    for i in np.flatnonzero(np.diff(ends)):
        ball = by_ball[ends[i] : ends[i + 1]]
        reach = np.searchsorted(away[i], 4 * own[ball].max(), "right")
        if still[order[i, :reach]].all():
            continue
        if len(book) > 1:
            ball = ball[4 * own[ball] >= away[i, 1]]
        meets[ball] = np.searchsorted(away[i, :reach], 4 * own[ball], "right")
    code, best = held.copy(), own
    active = np.flatnonzero(meets)
    upto = np.cumsum(meets[active])
    at = 0
    while at < len(active):
        # Blocks of rows with a bounded number of pairs.
        done = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + pairs, "right")))
        rows = active[at:to]
        n = meets[rows]
        start = np.cumsum(n) - n
        ring = np.arange(int(n.sum())) - np.repeat(start, n)
        other = order[np.repeat(held[rows], n), ring]
        km = ((np.repeat(x[rows], n, axis=0) - book[other]) ** 2).sum(-1)
        least = np.minimum.reduceat(km * len(book) + other, start)
        code[rows], best[rows] = least % len(book), least // len(book)
        at = to
    return code, best


def assign(ints: np.ndarray, held: np.ndarray, books: np.ndarray, still: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, error) of rows of integers (n, 16 * d), from their codes before, under books (16, k, d)."""
    x = ints.reshape(len(ints), PARTS, -1)
    codes, error = np.empty((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
    for p in range(PARTS):
        own = held[:, p].astype(np.int64)
        if (own == _NONE).any():
            own = np.abs(x[:, p, :1] - books[p, :, 0]).argmin(axis=1) if x.shape[2] else np.zeros(len(x), np.int64)
        codes[:, p], squared = _nearest(x[:, p], own, books[p], still[p])
        error += squared
    return codes, error


def _numbers(column: pa.ListArray, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), length)


def _coded(rows: DataFrame, books: np.ndarray, still: np.ndarray) -> DataFrame:
    """Rows (vec_id, label, ints, code) with new codes and their error."""
    length = books.shape[0] * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, 8192):
            held = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, PARTS)
            codes, error = assign(_numbers(b.column(2), length), held, books, still)
            codes = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], codes, pa.array(error)], ["vec_id", "label", "ints", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, ints array<int>, code binary, error long"
    return rows.select("vec_id", "label", "ints", "code").mapInArrow(run, schema)


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Books of the floors of the entries' means; entries without parts stay."""
    parts, entries, d = books.shape
    slots = parts * entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(slots, np.int64), np.zeros((slots, d), np.int64)
        for b in gathered(batches, 8192):
            held = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            slot = (held + np.arange(parts) * entries).ravel()
            counts += np.bincount(slot, minlength=slots)
            np.add.at(sums, slot, _numbers(b.column(0), parts * d).reshape(-1, d))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["slot", "n", "sums"]
        )

    per_task = rows.select("ints", "code").mapInArrow(run, "slot long, n long, sums array<bigint>")
    # At most one row per entry.
    total = per_task.groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(d)))
    after = books.reshape(slots, d).copy()
    for slot, n, *sums in total.collect():
        after[slot] = [s // n for s in sums]
    return after.reshape(books.shape)


def kept_integers(rows: DataFrame) -> DataFrame:
    """(vec_id, label, ints) of the vectors that take part."""
    v = F.col("embedding")
    odd: Column = F.exists(v, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * 256))
    return rows.filter(v.isNotNull() & ~odd).select("vec_id", "label", ints.alias("ints"))


def compress(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row (vec_id, embedding, label) that takes part."""
    kept = kept_integers(rows)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select("ints").limit(ENTRIES).collect()
    length = len(first[0]["ints"]) if first else 0
    if length % PARTS:
        raise ValueError(f"{PARTS} parts can't be cut from {length} numbers")
    first = [r["ints"] for r in first if len(r["ints"]) == length]
    first = np.array(first, np.int64).reshape(len(first), PARTS, length // PARTS)
    books = np.ascontiguousarray(first.transpose(1, 0, 2))
    fits = F.when(F.forall("ints", lambda x: F.abs(x) < 1 << 26), F.col("ints").cast("array<int>"))
    fits = F.coalesce(fits, F.raise_error(F.lit("a component times 256 is 2**26 or more")).cast("array<int>"))
    state = kept.filter(F.size("ints") == length).select("vec_id", "label", fits.alias("ints"), F.lit(bytes([_NONE] * PARTS)).alias("code"))
    still = np.zeros(books.shape[:2], bool)
    for _ in range(rounds):
        state = materialize(_coded(state, books, still), "codes")
        after = _moved(state, books)
        still = (after == books).all(axis=2)
        books = after
    done = materialize(_coded(state, books, still).select("vec_id", "label", "code", "error"), "codes")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = done.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    # Labels may be as many as rows: merged, and a frequent one may be split.
    met = done.join(by_label.hint("merge"), F.col("label").eqNullSafe(F.col("of")))
    return met.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
