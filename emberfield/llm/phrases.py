"""Phrase collocations: words that stand together far more often than they would by chance.

Texts are put in lower case (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at
spaces and tabs.  A phrase of two or three words with f >= ``least`` occurrences in its language scores
floor(10**6 * f**2 / (f(first part) * f(rest))) under its weakest cut.

Counting every n-gram needs a table of all of them; most occur once.  Three passes over the texts avoid it:

1. Masses.  N-grams have 48-bit fingerprints, whose upper bits name one of ``buckets`` hash partitions.
   Counts of n-grams per bucket and of words per language are summed.
2. Summaries.  Each task adds up blocks of its fingerprints; the blocks of a bucket meet in one task and
   are merged into a Misra-Gries summary of mass // ``least`` counters: whenever there are more, the
   largest one beyond is subtracted from all.  What is subtracted in total, D, is at most
   mass / (counters + 1) < ``least``, so an n-gram with ``least`` occurrences keeps a counter, and
   counter + D >= ``least`` holds for it.  Fingerprints that meet this go on, perhaps with others.
3. Exact counts.  A bitmap of fixed size (16 MB) over the fingerprints that went on tells which
   occurrences matter; these are counted by their words and added up by language and words.

A summary's memory follows its bucket's mass, and the number of buckets follows the size of the texts,
so both hold at any size.  Frequent n-grams come from their tasks already counted: none is a hot key.

Defined results: a null text is empty, a null language is ``und`` (as is that name itself); words may be
any other characters; repeated rows count each; a table without words gives an empty result; of other
columns and of ids nothing is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

#: Bits of a fingerprint, of the bitmap's places, and bytes that a fingerprint takes in a block.
BITS, PLACES, WIDTH = 48, 27, 6
#: Two bytes that UTF-8 never has stand for the end of a piece and of a text.
_PIECE, _TEXT = b"\xff", b"\xfe"
_TABLE = bytes(
    {**{c: c + 32 for c in range(65, 91)}, **dict.fromkeys(b".,;:!?\n\x0b\x0c\r", 255)}.get(c, c) for c in range(256)
)
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD))


class Words(dict):
    """Numbers of words, from 2 on, and their hashes; 0 is the end of a piece, 1 that of a text."""

    def __init__(self) -> None:
        super().__init__({_PIECE: 0, _TEXT: 1})
        self.names: list[bytes] = [b"", b""]
        self.hashes = np.zeros(1 << 12, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.names)
        self.names.append(word)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[n] = xxhash.xxh64_intdigest(word, 11)
        return n


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _D
    return (x ^ (x >> np.uint64(29))) >> np.uint64(64 - BITS)


def grams(texts: list[bytes], langs: list[str], words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For sizes 1 to 3: (fingerprints, first places, numbers of all words, size) of the n-grams of some texts.

    The numbers hold the texts one after the other, each ended by 1.
    """
    data = b"".join(t + _TEXT for t in texts).translate(_TABLE)
    ids = [words[w] for w in data.replace(_PIECE, b" \xff ").replace(_TEXT, b" \xfe ").split()]
    ids = np.array([*ids, 0, 0], np.int64)
    seed = np.array([xxhash.xxh64_intdigest(lang.encode(), 12) for lang in langs], np.uint64)
    # The text of each word; the last places are ends.
    text = np.minimum(np.cumsum(ids == 1), len(texts) - 1)
    seed, h, word = seed[text], words.hashes[ids], ids > 1
    x = h * _A
    for size in (1, 2, 3):
        n = len(ids) - 2
        if size > 1:
            x = (x[:-1] + h[size - 1 :]) * (_B if size == 2 else _C)
            word = word[:-1] & (ids[size - 1 :] > 1)
        at = np.flatnonzero(word[:n])
        yield _mixed(x[at] ^ seed[at]), at, ids, size


def _texts(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[tuple[list[bytes], list[str]]]:
    """Texts with their languages, in blocks of about ``most`` bytes."""
    texts, langs, size = [], [], 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            texts.append(text)
            langs.append(lang)
            size += len(text)
            if size >= most:
                yield texts, langs
                texts, langs, size = [], [], 0
    if texts:
        yield texts, langs


def _masses(rows: DataFrame, bits: int) -> DataFrame:
    """(lang, words) per language and (bucket, mass) per bucket of n-grams."""
    shift = np.uint64(BITS - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, words, counts = np.zeros(1 << bits, np.int64), Words(), {}
        for texts, langs in _texts(batches):
            for prints, at, ids, size in grams(texts, langs, words):
                mass += np.bincount((prints >> shift).astype(np.int64), minlength=1 << bits)
                if size == 1:
                    per_text = np.bincount(np.cumsum(ids == 1)[at], minlength=len(texts))
                    for lang, n in zip(langs, per_text.tolist(), strict=False):
                        counts[lang] = counts.get(lang, 0) + n
            if len(words) > 1 << 19:
                words = Words()
        used = np.flatnonzero(mass)
        columns = [
            pa.array([*counts, *[None] * len(used)], pa.string()), pa.array([*counts.values(), *[None] * len(used)], pa.int64()),
            pa.array([*[None] * len(counts), *used.tolist()], pa.int32()), pa.array([*[None] * len(counts), *mass[used].tolist()], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "words", "bucket", "mass"])

    per_task = rows.mapInArrow(run, "lang string, words long, bucket int, mass long")
    return per_task.groupBy("lang", "bucket").agg(F.sum("words").alias("words"), F.sum("mass").alias("mass"))


def _packed(prints: np.ndarray) -> bytes:
    return prints.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return out.view("<u8").ravel()


def _blocks(rows: DataFrame, bits: int, most: int = 2_000_000) -> DataFrame:
    """(bucket, prints, counts): distinct fingerprints of a task's texts with how often they come, in blocks."""
    shift = np.uint64(BITS - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = Words(), []

        def block() -> pa.RecordBatch:
            prints, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            buckets, first = np.unique(prints >> shift, return_index=True)
            ends = [*first[1:].tolist(), len(prints)]
            parts = list(zip(first.tolist(), ends, strict=True))
            kind = np.min_scalar_type(int(counts.max()))
            columns = [
                pa.array(buckets.astype(np.int32)), pa.array([_packed(prints[a:z]) for a, z in parts], pa.binary()),
                pa.array([counts[a:z].astype(kind).tobytes() for a, z in parts], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "prints", "counts"])

        for texts, langs in _texts(batches):
            held += [prints for prints, *_ in grams(texts, langs, words) if len(prints)]
            if sum(map(len, held)) >= most:
                yield block()
            if len(words) > 1 << 19:
                words = Words()
        if held:
            yield block()

    return rows.mapInArrow(run, "bucket int, prints binary, counts binary")


class Summary:
    """A Misra-Gries summary; summaries and blocks of counts are merged into it."""

    def __init__(self, counters: int):
        self.counters, self.dropped = counters, 0
        self.prints, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._more = 0

    def add(self, prints: np.ndarray, counts: np.ndarray) -> None:
        self._waiting.append((prints, counts))
        self._more += len(prints)
        # Rarely, so that what is held is sorted a few times only.
        if self._more > max(self.counters, 1 << 16):
            self.settle()

    def settle(self) -> None:
        if not self._waiting:
            return
        prints = np.concatenate([self.prints, *(p for p, _ in self._waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self._waiting)])
        self._waiting, self._more = [], 0
        order = np.argsort(prints, kind="stable")
        prints, counts = prints[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
        prints, counts = prints[first], np.add.reduceat(counts, first)
        beyond = len(prints) - self.counters
        if beyond > 0:
            # The largest count that has no counter goes from all.
            less = int(np.partition(counts, beyond - 1)[beyond - 1])
            self.dropped += less
            stay = counts > less
            prints, counts = prints[stay], counts[stay] - less
        self.prints, self.counts = prints, counts

    def candidates(self, least: int) -> np.ndarray:
        """Fingerprints of all that may come ``least`` times, no counter being off by more than ``dropped``."""
        self.settle()
        return self.prints[self.counts + self.dropped >= least]


def _survivors(blocks: DataFrame, masses: dict[int, int], least: int, partitions: int) -> DataFrame:
    """(bucket, prints): what the summary of each bucket lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Summary] = {}
        for b in batches:
            for bucket, prints, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = len(prints) // WIDTH
                own = found.get(bucket) or found.setdefault(bucket, Summary(masses[bucket] // least))
                own.add(_unpacked(prints), np.frombuffer(counts, f"u{len(counts) // n}").astype(np.int64))
        for bucket, own in found.items():
            prints = pa.array([_packed(own.candidates(least))], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), prints], ["bucket", "prints"])

    return blocks.repartition(partitions, "bucket").mapInArrow(run, "bucket int, prints binary")


def _bitmap(survivors: DataFrame, bits: int) -> np.ndarray:
    """Which places, by upper bits of a fingerprint, have a survivor: 2**27 bits, whatever the table's size."""
    size = (1 << PLACES - 3) >> bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for data in b.column(1).to_pylist():
                place = (_unpacked(data) >> np.uint64(BITS - PLACES)).astype(np.int64) & (size * 8 - 1)
                own = np.zeros(size * 8, bool)
                own[place] = True
                parts.append(np.packbits(own, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.binary())], ["bucket", "bits"])

    whole = np.zeros((1 << bits, size), np.uint8)
    for bucket, part in survivors.mapInArrow(run, "bucket int, bits binary").toLocalIterator():
        whole[bucket] |= np.frombuffer(part, np.uint8)
    return whole.ravel()


def _together(keys: np.ndarray, own: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows (language, words) with their fingerprints and sums of n."""
    order = np.argsort(keys, kind="stable")
    keys, own, n = keys[order], own[order], n[order]
    differ = (own[1:] != own[:-1]).any(axis=1)
    if (differ & (keys[1:] == keys[:-1])).any():
        # A fingerprint of two n-grams: only equal languages and words are one phrase.
        order = np.lexsort(own.T[::-1])
        keys, own, n = keys[order], own[order], n[order]
        differ = (own[1:] != own[:-1]).any(axis=1)
    first = np.flatnonzero(np.concatenate([[True], differ]))
    return keys[first], own[first], np.add.reduceat(n, first)


def _exact(rows: DataFrame, bitmap: np.ndarray, least: int, most: int = 1_000_000) -> DataFrame:
    """(lang, phrase, size, f) of every n-gram with ``least`` occurrences, counted by its words."""
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, words, tongues = sent.value, Words(), {}
        held, waiting = [], 0

        def told(own: np.ndarray, n: np.ndarray, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
            names, langs = words.names, list(tongues)
            for at in range(0, len(own), rows):
                part = own[at : at + rows].tolist()
                columns = [
                    pa.array([langs[r[0]] for r in part], pa.string()),
                    pa.array([b" ".join([names[i] for i in r[1:] if i]).decode("utf-8", "replace") for r in part], pa.string()),
                    pa.array([3 - r[1:].count(0) for r in part], pa.int32()), pa.array(n[at : at + rows]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "size", "f"])

        for texts, langs in _texts(batches):
            tongue = np.array([tongues.setdefault(lang, len(tongues)) for lang in langs], np.int32)
            for prints, at, ids, size in grams(texts, langs, words):
                place = (prints >> np.uint64(BITS - PLACES)).astype(np.int64)
                hit = np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                at, prints = at[hit], prints[hit]
                own = np.zeros((len(at), 4), np.int32)
                own[:, 0] = tongue[np.cumsum(ids == 1)[at]]
                for k in range(size):
                    own[:, k + 1] = ids[at + k]
                held.append((prints, own, np.ones(len(at), np.int64)))
                waiting += len(at)
            # What a task has counted stays with it as long as it is no more than a block.
            full = len(words) > 1 << 19
            if held and (full or waiting >= most):
                held, waiting = [_together(*map(np.concatenate, zip(*held, strict=True)))], 0
                if full or len(held[0][0]) > most:
                    yield from told(*held[0][1:])
                    held = []
            if full:
                words = Words()
        if sum(len(k) for k, *_ in held):
            yield from told(*_together(*map(np.concatenate, zip(*held, strict=True)))[1:])

    per_task = rows.mapInArrow(run, "lang string, phrase string, size int, f long")
    return per_task.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def counts(docs: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, f) of the n-grams of up to three words with f >= least, (lang, n) words per language)."""
    bounded_batches(docs.sparkSession)
    text, lang = F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("und"))
    rows = docs.select(lang.alias("lang"), text.cast("binary").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # About four megabytes of text a bucket.
    bits = min(18, max(4, (size >> 22).bit_length()))
    masses = materialize(_masses(rows, bits), "masses")
    per_lang = masses.filter("bucket is null").select("lang", F.col("words").alias("n"))
    # One number per bucket.
    mass = {r["bucket"]: r["mass"] for r in masses.filter("bucket is not null").select("bucket", "mass").collect()}
    survivors = materialize(_survivors(_blocks(rows, bits), mass, least, 1 << bits), "survivors")
    return materialize(_exact(rows, _bitmap(survivors, bits), least), "counts"), per_lang


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two and three words, each under its weakest cut."""
    phrases = found.filter("size > 1").select("lang", "phrase", F.split("phrase", " ").alias("w"), F.col("f").alias("a"))
    cut = phrases.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    join = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cut = cut.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("first"), join(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    # Both parts are at least as frequent as the phrase, so they are there.
    of = lambda part, f: found.select("lang", F.col("phrase").alias(part), F.col("f").alias(f)).hint("merge")
    cut = cut.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    # Whole-number division of 38 digits: exact up to 10**15 occurrences.
    score = F.expr("(cast(a as decimal(16, 0)) * cast(a as decimal(16, 0)) * 1000000bd) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases.

    A phrase goes if a longer one that holds it has at least ``share`` percent of its occurrences.
    """
    found, per_lang = counts(docs, least)
    phrases = materialize(scored(found), "phrases")
    w = F.split("phrase", " ")
    longer = phrases.filter(F.size(w) == 3).select("lang", "a", F.explode(F.array(*(F.array_join(F.slice(w, i, 2), " ") for i in (1, 2)))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    open_ = phrases.join(longer.hint("merge"), ["lang", "phrase"], "left")
    open_ = open_.filter(F.coalesce(100 * F.col("longest") < share * F.col("a"), F.lit(True)))
    order = (F.desc("score"), F.desc("a"), "phrase")
    # The limit holds within parts of a language first, so that at most 64 times as many rows of one meet.
    parts = open_.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return first.join(per_lang.hint("merge"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
