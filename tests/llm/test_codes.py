"""Vector codes against all distances, and against their SQL."""

import hashlib
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

from emberfield.llm import codes, queries

DATA = Path("/root/testdata/sf0.01")
SCHEMA = "vec_id long, embedding array<float>, label int, code string, ints string, slot long"


def by_all_distances(rows, rounds=2):
    """(vec_id, label, code, error) of each kept row and the digest of the codebooks."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [np.floor(256 * np.float64(np.float32(x))) for x in r[1]]))
    x = np.array([np.floor(256 * np.float32(r[1]).astype(float)) for r in kept], np.int64).reshape(len(kept), 16, -1)
    books = x[:64].copy()

    def assigned():
        squared = np.stack([((x - b) ** 2).sum(-1) for b in books])
        return squared.argmin(0), squared.min(0).sum(1)

    for _ in range(rounds):
        code, _error = assigned()
        for e in range(len(books)):
            for p in range(16):
                if (code[:, p] == e).any():
                    books[e, p] = x[code[:, p] == e, p].sum(0) // (code[:, p] == e).sum()
    code, error = assigned()
    digest = hashlib.sha256(",".join(str(v) for p in range(16) for b in books for v in b[p]).encode()).hexdigest()
    return [(r[0], r[2], "".join("%02x" % c for c in cs), int(e)) for r, cs, e in zip(kept, code, error, strict=True)], digest


def compressed(spark, rows):
    df = spark.createDataFrame([(*r, "c", "i", 3) for r in rows], SCHEMA)
    return codes.compress(df).collect()


def holds(spark, rows):
    got = compressed(spark, rows)
    want, digest = by_all_distances(rows)
    total = {}
    for _, label, _, e in want:
        total[label] = total.get(label, 0) + e
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in got) == sorted((str(i), c, e, total[l]) for i, l, c, e in want)
    assert {r["codebooks_sha256"] for r in got} <= {digest}


def test_codes_match_all_distances(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.15) for _ in range(64)], rng.choice([0, 1, None])) for i in range(400)]
    rows += [(1000 + i, rows[i % 3][1], 2) for i in range(300)]  # equal vectors
    rows += [(2000, None, 1), (2001, [None, *[0.1] * 63], 1), (2002, [float("nan")] * 64, 1), (2003, [float("inf"), *[0.0] * 63], 1)]
    rows += [(7, [0.25] * 64, 0), (None, [-0.25] * 64, None)]  # a repeated and a missing id
    rng.shuffle(rows)
    holds(spark, rows)


def test_ties_go_to_the_lower_index(spark):
    # Small whole numbers: most parts are as near to several entries, and entries are equal.
    rng = random.Random(2)
    rows = [(i, [rng.randrange(-1, 2) / 256 for _ in range(32)], 0) for i in range(500)]
    holds(spark, rows)
    holds(spark, [(i, [1.0] * 16, None) for i in range(200)])


def test_short_tables(spark):
    rng = random.Random(3)
    holds(spark, [(i, [rng.gauss(0, 1) for _ in range(16)], i) for i in range(5)])
    holds(spark, [(3, [0.5] * 16, None)])
    assert compressed(spark, []) == []
    assert compressed(spark, [(1, None, 1)]) == []
    # Of another length than the first kept one.
    assert [r["vec_id"] for r in compressed(spark, [(1, [0.5] * 32, 1), (2, [0.5] * 16, 1)])] == [1]
    with pytest.raises(ValueError, match="parts"):
        compressed(spark, [(1, [0.5] * 17, 1)])
    with pytest.raises(Exception, match=r"2\*\*26"):
        compressed(spark, [(1, [1e30] * 16, 1)])


def test_cores_rings_and_unmoved_balls_change_nothing():
    rng = np.random.default_rng(4)
    for spread in (1, 4, 300):
        x, book = rng.integers(-spread, spread + 1, (3000, 3)), rng.integers(-spread, spread + 1, (40, 3))
        squared = ((x[:, None] - book[None]) ** 2).sum(-1)
        for held in (np.zeros(3000, np.int64), rng.integers(0, 40, 3000), squared.argmin(1)):
            code, best = codes._nearest(x, held, book, np.zeros(40, bool), pairs=1000)
            assert (code == squared.argmin(1)).all() and (best == squared.min(1)).all()
        # With the entries of before, nothing is searched again; a moved one is seen.
        code, best = codes._nearest(x, squared.argmin(1), book, np.ones(40, bool))
        assert (code == squared.argmin(1)).all() and (best == squared.min(1)).all()
        after, still = book.copy(), np.ones(40, bool)
        after[5] += 1
        still[5] = False
        moved = ((x[:, None] - after[None]) ** 2).sum(-1)
        code, best = codes._nearest(x, squared.argmin(1), after, still)
        assert (code == moved.argmin(1)).all() and (best == moved.min(1)).all()


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")
def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    got = queries.op12_codes(spark, str(DATA)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    want = con.execute(queries.oracle_sql()["op12_codes"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
