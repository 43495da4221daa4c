"""Vector best-fit packing of documents into token sequences.

Every document is encoded, closed with an end id, and cut into pieces of at most ``size`` tokens
only if it is longer; its first piece takes the remainder.  Pieces are items with three demands:
tokens, one document, and attention cost (length squared).  A bin offers ``size`` tokens,
``max_docs`` documents and ``max_cost`` attention cost.  Items are placed longest first into the open
bin that fits under every constraint and scores best, by weighted dot-product of demand and residual
or by least residual norm; where none fits, a new bin opens.  The defaults weigh the three residuals
alike.  A whole piece of ``size`` tokens costs size squared, so the default attention capacity can't
be lower than that and only shapes the choice; the documents of a sequence are held to ``max_docs``.

Items of one length are alike, so the choice is made on the histogram of lengths (at most ``size``
numbers, whatever the corpus size).  Bins with the same history stand together as one run of bins.
The resulting table says, for each length and range of ranks, which run of bins and offset it goes
to; Spark ranks the pieces within their length (in salted groups, whose sizes are summed up) and
looks the place up.

Defined results: a null text is empty and gives one piece with the end id; repeated rows are packed
each; documents of equal length are ranked by hash group and id; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@functools.lru_cache(maxsize=2)
def _fast_encoder(path: str):
    """The file's vocabulary in a compiled encoder; gives the same ids as the tokenizers library."""
    import json

    import tiktoken

    from .bpe import _byte_alphabet

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = _byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: encoding.encode(text, allowed_special="all")


def pieces(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: document, number, first token, length, CRC-32 of its ids."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _fast_encoder(path)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                first = len(ids) % size or size
                cuts = [0, *range(first, len(ids) + 1, size)]
                rows += [
                    (doc, k, a, z - a, zlib.crc32(ids[a:z].tobytes()))
                    for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))
                ]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


#: Production capacities and weights: see ``best_fit``.
MAX_DOCS = 128
WEIGHTS = (1.0, 1.0, 1.0)


def best_fit(
    counts: dict[int, int],
    size: int = 1024,
    max_docs: int = MAX_DOCS,
    max_cost: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
) -> list[tuple[int, int, int, int, int]]:
    """Places for all items of a length histogram: rows (length, rank_from, rank_to, bin_from, offset).

    ``weights`` are those of tokens, documents and attention cost, each as a share of its capacity.
    ``rule`` is 'dot' (largest weighted dot-product of demand and residual) or 'norm' (least weighted
    norm of what would be left).  Ties go to the run of bins that opened first.  ``max_cost`` is
    size squared unless given: a whole piece of ``size`` tokens needs that much.
    """
    capacity = np.array([size, max_docs, size * size if max_cost is None else max_cost], np.int64)
    weigh = np.asarray(weights, float)
    first, bins = np.zeros(64, np.int64), np.zeros(64, np.int64)  # runs of bins with the same history
    residual = np.zeros((64, 3), np.int64)
    used, opened = 0, 0
    out: list[tuple[int, int, int, int, int]] = []

    def add(at: int, n: int, left: np.ndarray) -> None:
        nonlocal used, first, bins, residual
        if used == len(first):
            first, bins, residual = (np.concatenate([x, np.zeros_like(x)]) for x in (first, bins, residual))
        first[used], bins[used], residual[used] = at, n, left
        used += 1

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        demand = np.array([length, 1, length * length], np.int64)
        if (demand > capacity).any():
            raise ValueError(f"an item of {length} tokens exceeds the capacities {capacity.tolist()}")
        while left > 0:
            fits = np.flatnonzero((residual[:used] >= demand).all(axis=1))
            if not len(fits):
                n = -(-left // int((capacity // demand).min()))
                add(opened, n, capacity)
                opened += n
                continue
            if rule == "dot":
                score = (residual[fits] / capacity * (demand / capacity)) @ weigh
            else:
                score = -(((residual[fits] - demand) / capacity) ** 2 @ weigh)
            i = int(fits[np.argmax(score)])
            take, after = min(int(bins[i]), left), residual[i] - demand
            out.append((length, rank, rank + take, int(first[i]), int(size - residual[i, 0])))
            if take < bins[i]:
                add(int(first[i]) + take, int(bins[i]) - take, residual[i].copy())
            bins[i], residual[i] = take, after
            left, rank = left - take, rank + take
    return out


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, group_rows: int = 20_000, **fit) -> DataFrame:
    """Pieces of all documents with their sequence and the place in it."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, path, size, end_id), "pieces")
    by_length = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(by_length.values())
    # A length may hold a large share of all rows: ranks are taken within salted groups of a length.
    salts = max(256, -(-total // group_rows))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("own", F.row_number().over(own) - 1)
        .join(firsts.hint("shuffle_hash"), ["length", "salt"])
        .withColumn("rank", F.col("first") + F.col("own"))
        .drop("salt", "first", "own")
    )
    # At most a few runs of bins per length, and at most `size` lengths: bounded for any corpus.
    places = spark.createDataFrame(
        best_fit(by_length, size, **fit), "length long, rank_from long, rank_to long, bin_from long, offset long"
    )
    inside = (ranked["rank"] >= places["rank_from"]) & (ranked["rank"] < places["rank_to"])
    return ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & inside).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("bin_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset",
    )
