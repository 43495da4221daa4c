"""Phrase mining against plain counting and its SQL; summaries against exact counts."""

import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from emberfield.llm import phrases, queries

DATA = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, phrase string, n long, f long, bucket int"


def by_plain_counts(rows, least=10, share=50, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    f = Counter({k: v for k, v in f.items() if v >= least})
    found = {}
    for (lang, w), a in f.items():
        if len(w) > 1:
            cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found[lang, w] = (lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score)
    longest = Counter()
    for (lang, w), row in found.items():
        for part in (w[:2], w[1:]) if len(w) == 3 else ():
            longest[lang, part] = max(longest[lang, part], row[2])
    out = []
    for lang in n:
        own = [r for (of, w), r in found.items() if of == lang and 100 * longest[of, w] < share * r[2]]
        own.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return sorted(out)


def mined(spark, rows, **parameters):
    df = spark.createDataFrame([(*r, "p", 1, 2, 3) for r in rows], SCHEMA)
    got = phrases.collocations(df, **parameters).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(map(tuple, got.collect()))


def odd_rows():
    rng = random.Random(7)
    words = ["The", "the", "É", "é", "x\x00y", "\x1f", "naïve", "　", "a-b", "ß", "😀", "q"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\r\n", "\x0b", " ! "]) for _ in range(n))
    rows = [(i, text(rng.randrange(0, 120)), rng.choice(["en", "de", None, "und", "", "zh"])) for i in range(150)]
    rows += [(200, None, "en"), (201, "", None), (202, " ., \n", "de"), (None, "no id no id no id", "en")]
    rows += [(300, "new york times " * 5000, "en"), (301, "u " * 3000, "fr")]  # long, and one hot phrase
    return rows + rows[:20]


def test_phrases_match_plain_counts(spark):
    rows = odd_rows()
    want = by_plain_counts(rows)
    assert len(want) > 100 and mined(spark, rows) == want
    assert mined(spark, rows, least=3, share=90, top=7) == by_plain_counts(rows, 3, 90, 7)


def test_tables_without_phrases(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, None, None), (2, "a b", "en")]) == []


def test_large_products_stay_exact(spark):
    f = [("en", "a", 1, 3_000_000_000_000), ("en", "b", 1, 2_999_999_999_999), ("en", "a b", 2, 1_000_000_000_000)]
    found = spark.createDataFrame(f, "lang string, phrase string, size int, f long")
    row = phrases.scored(found).first()
    assert row["score"] == 10**6 * 10**24 // (f[0][3] * f[1][3]) and (row["l"], row["r"]) == (f[0][3], f[1][3])
    # Just below a whole number.
    a, l, r = 999_999_999_999, 10**12, 10**12
    found = spark.createDataFrame([("en", "a", 1, l), ("en", "b", 1, r), ("en", "a b", 2, a)], "lang string, phrase string, size int, f long")
    assert phrases.scored(found).first()["score"] == 999_999


def test_summaries_keep_what_is_frequent():
    rng = np.random.default_rng(8)
    for least in (2, 10, 40):
        items = np.concatenate([rng.integers(0, 2**48, 20_000), np.repeat(rng.integers(0, 2**48, 60), least), np.full(9_000, 5)]).astype(np.uint64)
        rng.shuffle(items)
        exact = Counter(items.tolist())
        parts = [phrases.Summary(len(items) // least) for _ in range(2)]
        for i, block in enumerate(np.array_split(items, 50)):
            own = parts[i % 2]
            own.add(*np.unique(block, return_counts=True))
            own.settle()
            assert len(own.prints) <= own.counters
        # One summary merges into the other.
        parts[1].settle()
        parts[0].add(parts[1].prints, parts[1].counts)
        parts[0].dropped += parts[1].dropped
        kept = set(parts[0].candidates(least).tolist())
        assert parts[0].dropped < least and {x for x, n in exact.items() if n >= least} <= kept
        held = dict(zip(parts[0].prints.tolist(), parts[0].counts.tolist(), strict=True))
        assert all(c <= exact[x] <= c + parts[0].dropped for x, c in held.items())


def test_blocks_pack_and_unpack():
    prints = np.array([0, 1, 2**48 - 1, 12345678901234], np.uint64)
    assert (phrases._unpacked(phrases._packed(prints)) == prints).all()


def test_phrases_of_one_fingerprint_are_told_apart():
    rng = np.random.default_rng(9)
    own = rng.integers(0, 3, (500, 4)).astype(np.int32)
    for keys in (rng.integers(0, 4, 500), np.zeros(500), own.sum(axis=1), own @ np.array([27, 9, 3, 1])):
        prints, rows, n = phrases._together(keys.astype(np.uint64), own, np.ones(500, np.int64))
        got = dict(zip(map(tuple, rows.tolist()), n.tolist(), strict=True))
        assert len(got) == len(prints) == len(rows) and got == Counter(map(tuple, own.tolist()))


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")
def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = queries.op11_phrases(spark, str(DATA)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    want = con.execute(queries.oracle_sql()["op11_phrases"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
