"""Nearest neighbours by several Hilbert orderings of projected vectors.

Equal vectors form a class, which is indexed once with its ``k`` + 1 smallest ids; so a vector that a
third of all rows share costs no more than any other.  A bounded sample of the classes gives the
principal directions; each ordering rotates the vectors within them at random, shifts and quantises a
few coordinates, and places every class by its key on a Hilbert curve.  Spark range-partitions all
classes by ordering, key and id; counts per partition give each its rank, and ranks are cut into
windows.  A query meets the window that holds its key and the neighbour window on its nearer side, in
every ordering and never beyond it.

Windows hold vectors in bytes (one scale per vector).  The error of a product on them is bounded, so a
window passes on every pair that may belong to the best ``k`` + 1 it holds.  An eighth of the orderings
come first; what a query reaches in them is its lower bound in the others.  Merged over all windows,
the pairs that may still belong to the best are scored exactly in double precision on the original vectors and ranked.

``share`` is the part of an ordering that a query meets.  Vectors without low-dimensional structure need
windows in proportion to the table for a given recall; for others a smaller share will do.

Defined results: rows whose vector is null, empty, zero, or holds null or non-finite components take
no part, nor do rows without id, nor vectors of another length than most rows'; rows with the same id
count as one, with the vector of least hash; ties go to the smaller id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, gathered, materialize


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of cells (integers below 2**bits) on the Hilbert curve of its dimension."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    # Skilling's transform: undo the excess work from the top bit down, then Gray-encode.
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _block(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def _packed(rows: np.ndarray) -> pa.Array:
    """One binary value per row of an array."""
    step = rows.shape[1] * rows.itemsize
    offsets = np.arange(0, len(rows) * step + 1, step, dtype=np.int32) if step else np.zeros(len(rows) + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _unpacked(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _valid(vectors: DataFrame, is_query) -> DataFrame:
    """vec_id, vector as array of double, its two hashes and whether it is a query, for rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.filter("vec_id is not null and embedding is not null").select("vec_id", v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0))
    one = rows.groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    is_query = F.expr(is_query) if isinstance(is_query, str) else is_query
    return one.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(5), "v").alias("h2"), is_query.alias("is_query"))


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """(cls, ids, v, asked): classes of equal vectors, their smallest ids, and whether a query has that vector."""
    first = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    few = rows.withColumn("n", first).filter(F.col("n") <= k + 1)
    asked = rows.filter("is_query").select("h1", "h2").distinct().withColumn("asked", F.lit(True))
    grouped = few.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("cls"), F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min_by("v", "vec_id").alias("v")
    )
    return grouped.join(asked.hint("merge"), ["h1", "h2"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))


def search(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    orderings: int = 64,
    share: float = 0.014,
    least: int = 14,
    dims: int = 8,
    bits: int = 7,
    sample: int = 4000,
    range_rows: int = 250_000,
    seed: int = 7,
    met: list | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products found for each query row.

    ``is_query`` is a condition on vec_id.  ``sample`` bounds the rows from which directions are
    taken; every row is indexed.  A window has ``share`` / 2 of the classes, ``least`` at
    least.  To ``met``, if given, the number of products computed in windows is added.
    """
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    rows = materialize(_valid(vectors, is_query), "vectors")
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).first()
    if sizes is None:
        return spark.createDataFrame([], empty)
    width = sizes["n"]
    rows = rows.filter(F.size("v") == width)
    classes = materialize(_classes(rows, k), "classes")
    total = classes.count()
    some = classes.orderBy(F.xxhash64("cls"), "cls").limit(sample).select("v").collect()
    fitted = np.array([r["v"] for r in some])
    centre = fitted.mean(0)
    _, spread, axes = np.linalg.svd(fitted - centre, full_matrices=False)
    window = max(least, int(np.ceil(share * total / 2)))
    last_window = -(-total // window) - 1
    dims = min(dims, width, len(spread))
    rng = np.random.default_rng(seed)
    planes, lows, scales = [], [], []
    for _ in range(orderings):
        rotation = np.linalg.qr(rng.normal(size=(len(spread), len(spread))))[0]
        plane = (rotation @ axes)[:dims].T
        at = (fitted - centre) @ plane
        low, high = np.quantile(at, [0.001, 0.999], axis=0)
        wide = np.maximum(high - low, 1e-9)
        shift = rng.uniform(0, 0.5, dims) * wide
        planes.append(plane)
        lows.append(low - shift)
        scales.append((1 << bits) / (1.5 * wide))
    bounded_batches(spark)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, 4000):
            x = _block(b.column(1), width)
            scale = np.abs(x).max(1) / 127
            code = _packed(np.rint(x / scale[:, None]).astype(np.int8))
            for c in range(orderings):
                cells = np.clip(((x - centre) @ planes[c] - lows[c]) * scales[c], 0, (1 << bits) - 1)
                key = hilbert_keys(cells.astype(np.int64), bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), c, np.int32)), pa.array(key), b.column(0), pa.array(scale), code, b.column(2)],
                    ["ordering", "key", "cls", "scale", "code", "asked"],
                )

    keyed = classes.select("cls", "v", "asked").mapInArrow(
        placed, "ordering int, key long, cls long, scale double, code binary, asked boolean"
    )
    order = ["ordering", "key", "cls"]
    ranges = max(1, -(-total * orderings // range_rows))
    ranged = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    index = materialize(ranged.withColumn("at", F.monotonically_increasing_id()), "index").drop("key")
    # One row per range and ordering: the first place in it, and how many of the ordering come before.
    part = F.shiftright("at", 33)
    starts = index.groupBy("ordering", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("ordering").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialize(starts.withColumn("before", F.coalesce(before, F.lit(0))).drop("n"), "starts")
    starts = F.broadcast(starts) if ranges <= 20_000 else starts.hint("merge")
    ranked = index.withColumn("part", part).join(starts, ["ordering", "part"])
    rank = F.col("before") + F.col("at") - F.col("first")
    ranked = ranked.withColumn("window", F.floor(rank / window)).withColumn("inside", rank % window).drop("at", "part", "first", "before")
    # The neighbour on the nearer side; at an end of the ordering, the one that exists.
    side = F.when(F.col("inside") * 2 < window, -1).otherwise(1)
    beside = F.col("window") + F.when((F.col("window") + side).between(0, last_window), side).otherwise(-side)
    asked = ranked.filter("asked").withColumn("window", F.explode(F.array("window", beside)))
    asked = asked.filter(F.col("window").between(0, last_window))
    columns = ["ordering", "window", "asked", "cls", "scale", "code", "bound"]

    def grouped(some, bounds: DataFrame | None) -> DataFrame:
        """Windows of some orderings: their classes, then the queries that meet them, with what these have reached."""
        asking = asked.filter(some).select(*columns[:-1])
        if bounds is None:
            asking = asking.withColumn("bound", F.lit(None).cast("double"))
        else:
            asking = asking.join(bounds.hint("merge"), "cls", "left")
        own = ranked.filter(some).withColumn("asked", F.lit(False)).withColumn("bound", F.lit(None).cast("double"))
        both = own.select(*columns).unionByName(asking.select(*columns))
        return both.repartition("ordering", "window").sortWithinPartitions("ordering", "window", "asked", "cls")

    slack = np.sqrt(width) / 2

    def pairs(group: np.ndarray, cls: np.ndarray, scale: np.ndarray, code: np.ndarray, bound: np.ndarray):
        """(query, class, lower, upper bound of the product, products) of one window; queries come last."""
        n = int(np.searchsorted(group, True))
        q_scale, norm = scale[n:], np.empty(0)
        x = code[:n].astype(np.float32) * scale[:n, None].astype(np.float32)
        norms = np.sqrt((x * x).sum(1)) + slack * scale[:n]
        for at in range(n, len(cls), 512):
            to = min(at + 512, len(cls))
            q = code[at:to].astype(np.float32) * scale[at:to, None].astype(np.float32)
            norm = np.sqrt((q * q).sum(1)) + slack * scale[at:to]
            s = q @ x.T
            # |q x - q' x'| <= |q| |x - x'| + |x'| |q - q'|, and single precision's own error.
            err = norm[:, None] * (slack * scale[None, :n]) + norms[None, :] * (slack * q_scale[at - n : to - n, None])
            err += 1e-5 * norm[:, None] * norms[None, :]
            low = s - err
            floor = np.partition(low, -(k + 1), axis=1)[:, -(k + 1)] if n > k else np.full(len(q), -np.inf)
            i, j = np.nonzero(s + err >= np.maximum(floor, bound[at:to])[:, None])
            yield cls[at:to][i], cls[j], low[i, j], (s + err)[i, j], s.size

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def found(c: list[np.ndarray]) -> pa.RecordBatch:
            cut = np.flatnonzero((np.diff(c[0]) != 0) | (np.diff(c[1]) != 0)) + 1
            out = [p for own in zip(*(np.split(x, cut) for x in c), strict=True) for p in pairs(*own[2:])]
            columns = [np.concatenate([np.asarray(p[k]) for p in out]) if out else np.zeros(0, np.int64 if k < 2 else float) for k in range(4)]
            n = np.zeros(len(columns[0]), np.int64)
            if len(n):
                n[0] = sum(p[4] for p in out)
            return pa.RecordBatch.from_arrays(
                [*map(pa.array, columns[:2]), *(pa.array(x.astype(float)) for x in columns[2:]), pa.array(n)],
                ["query", "cls", "low", "high", "products"],
            )

        for b in batches:
            c = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)] + [_unpacked(b.column(5), "i1", width), b.column(6).fill_null(-np.inf).to_numpy()]
            c = c if held is None else [np.concatenate(x) for x in zip(held, c, strict=True)]
            if not len(c[0]):
                continue
            # The last window may go on in the next batch.
            last = int(((c[0] == c[0][-1]) & (c[1] == c[1][-1])).argmax())
            held = [x[last:] for x in c]
            if last:
                yield found([x[:last] for x in c])
        if held is not None:
            yield found(held)

    shape = "query long, cls long, low double, high double, products long"
    of_query = Window.partitionBy("query")

    def with_floor(found: DataFrame) -> DataFrame:
        """Pairs once each, and the query's k + 1-th lower bound: pairs whose upper bound is below it can't count."""
        once = found.groupBy("query", "cls").agg(
            F.max("low").alias("low"), F.max("high").alias("high"), F.sum("products").alias("products")
        )
        once = once.withColumn("n", F.row_number().over(of_query.orderBy(F.desc("low"), "cls")))
        return once.withColumn("floor", F.max(F.when(F.col("n") == k + 1, F.col("low"))).over(of_query)).drop("n")

    # A few orderings first; what a query reaches there bounds what it takes from the others.
    early = F.col("ordering") < max(1, orderings // 8)
    pairs_shape = ["query", "cls", "low", "high", "products"]
    first = materialize(with_floor(grouped(early, None).mapInArrow(meet, shape)), "pairs")
    bounds = first.groupBy(F.col("query").alias("cls")).agg(F.max("floor").alias("bound"))
    later = grouped(~early, bounds).mapInArrow(meet, shape)
    merged = materialize(with_floor(first.select(*pairs_shape).unionByName(later)), "pairs")
    if met is not None:
        met.append(merged.agg(F.sum("products")).first()[0] or 0)
    close = merged.filter("floor is null or high >= floor").select("query", "cls")
    vector = classes.select("cls", "v", "ids")
    both = close.join(vector.hint("merge"), "cls").join(
        classes.filter("asked").select(F.col("cls").alias("query"), F.col("v").alias("q")).hint("merge"), "query"
    )
    product = F.aggregate(F.zip_with("v", "q", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    scored = both.select("query", "ids", product.alias("score"))
    own_score = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("minus"), i.alias("id")))
    best = F.row_number().over(of_query.orderBy(F.desc("score"), F.get("ids", 0)))
    top = scored.select("query", "score", "ids", own_score.alias("own")).withColumn("n", best).filter(F.col("n") <= k + 1)
    lists = top.groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list("own"))), 1, k + 1).alias("found"))
    # Each query row takes its class's list, without itself.
    of_class = classes.filter("asked").select(F.col("cls").alias("query"), "h1", "h2").join(lists.hint("merge"), "query")
    answers = rows.filter("is_query").select(F.col("vec_id").alias("query_id"), "h1", "h2").join(of_class.hint("merge"), ["h1", "h2"])
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = answers.select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.minus")).alias("score"))
