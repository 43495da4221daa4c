"""Personal data by weak supervision, in DataFrame functions only.

Base spans (email, ip, card, phone) come from strict patterns and checks.  Looser candidates are
found beside them: addresses spelt with "at" and "dot", phone numbers without a plus sign, card
numbers that fail the checksum or stand beside another number.  Labelers vote on every span, yes, no or not at all: the strict pattern,
the shape of the number, a gazetteer of cue words before the span, its borders, and a gazetteer of
domain endings.  Votes are counted per combination (a bounded number of combinations, whatever the
corpus size), expectation-maximisation on these counts estimates each labeler's reliability per
kind and the probability of each combination, and a logistic span classifier is trained on these
probabilities.  Its weights go back into the plan as an expression.

Base spans always stay; candidates that overlap one are dropped; the others are added if the
classifier accepts them.  Positions are code points, ends exclusive.

Defined results: a null text is empty and has no spans; spans of several kinds may overlap; repeated
rows give repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import REST, materialize, rest_packed

#: Kinds in the order in which spans at one place are listed.
KINDS = ("email", "ip", "card", "phone")
#: A match begins where a run of its characters begins, or where the match before it ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_VALID = rf"^{_PART}(?:\.{_PART}){{3}}$"
SPELT = (
    r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[a-z0-9-]{1,63}+"
    r"(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[a-z0-9-]{2,63}+){1,4}+"
)
NUMBER = r"(?:(?<![0-9A-Za-z+.,:/_=#-])|\G)[0-9(](?:[\x20().-]{0,2}+[0-9]){6,19}+(?![0-9A-Za-z_/=])"
#: Runs of 13 to 19 digits, or four groups of four, also where another number stands beside them.
CARD_LIKE = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])"

#: Cue words of the gazetteer by kind, in the languages at hand.
CUES = {
    "email": "e-?mail|mail|contact|write to|reply|kontakt|correo|courriel|adresse",
    "ip": "ip|host|server|address|client|login|adresse|direcci[oó]n",
    "card": "card|visa|mastercard|amex|credit|debit|karte|kreditkarte|tarjeta|carte",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|dial|telefon|handy|anruf|tel[eé]fono|llame|t[eé]l[eé]phone|appel(?:ez)?",
}
AGAINST = "order|invoice|ref|reference|isbn|issn|id|version|page|year|figure|table|no|nr|serial|score|rate|total"
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "de", "fr", "es", "uk", "eu", "ch", "at", "us")
LABELERS = ("strict", "shape", "cue", "border", "ending")


SPANS = "array<struct<start:int,end:int,match:string>>"


def _walked(n: Column, state: Column, step, kind: str, block: int = 256) -> Column:
    """What ``step(state, i) -> (state, wanted or None, element)`` gives for i = 0 ... n - 1, in an array of ``kind``.

    Elements are gathered in blocks, as every addition to an array copies it.
    """

    def one(acc: Column, i: Column) -> Column:
        moved, wanted, element = step(acc["state"], i)
        out = F.array_append(acc["out"], element)
        return F.struct(moved.alias("state"), (out if wanted is None else F.when(wanted, out).otherwise(acc["out"])).alias("out"))

    def many(acc: Column, g: Column) -> Column:
        start = F.struct(acc["state"].alias("state"), F.array().cast(kind).alias("out"))
        done = F.aggregate(F.sequence(g * block, F.least((g + 1) * block, n) - 1), start, one)
        # One-element array to name the block's result.
        joined = F.transform(
            F.array(done), lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out"))
        )
        return F.get(joined, 0)

    blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.flatten(F.aggregate(blocks, start, many)["out"])


def _found(text: Column, pattern: str) -> Column:
    """All matches, left to right, as array of (start, end, match): pieces between them give the places."""
    parts = F.struct(F.split(text, pattern).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def placed(s: Column) -> Column:
        def step(at: Column, i: Column) -> tuple:
            start = at + F.length(F.get(s["p"], i))
            end = start + F.length(F.get(s["m"], i))
            return end, None, F.struct(start.alias("start"), end.alias("end"), F.get(s["m"], i).alias("match"))

        return _walked(F.size(s["m"]), F.lit(0), step, SPANS)

    return F.get(F.transform(F.array(parts), placed), 0)


CHUNK = 1000


def _chunks(text: Column, wanted: Column) -> Column:
    """The text in chunks of so many characters, where they are wanted."""
    return F.when(wanted, F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0)))


def _part(chunks: Column, at: Column, n: Column) -> Column:
    """The n characters from a place on, without a walk from the text's beginning."""
    first = F.floor(at / CHUNK).cast("int")
    last = F.floor((at + F.greatest(n, F.lit(1)) - 1) / CHUNK).cast("int")
    joined = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
    return F.substring(joined, at - first * CHUNK + 1, n)


def _only(holds: Column, spans: Column) -> Column:
    return F.when(holds, spans).otherwise(F.array().cast(SPANS))


def _free(base: Column, spans: Column) -> Column:
    """The spans that overlap no base span: one walk from the left, one from the right, over both by start."""
    kind = "array<struct<start:int,own:int,k:int,end:int,match:string>>"

    def tagged(x: Column, own: int) -> Column:
        return F.transform(
            x, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["k"].alias("k"), s["end"].alias("end"), s["match"].alias("match"))
        )

    def walk(x: Column, mark: Column, moved, fits) -> Column:
        # ``mark`` is what base spans met so far reach; spans within that reach are left out.
        def step(m: Column, i: Column, own: Column) -> tuple:
            s = F.get(own, i)
            return F.when(s["own"] == 0, moved(m, s)).otherwise(m), (s["own"] == 1) & fits(m, s), s

        return F.get(F.transform(F.array(x), lambda own: _walked(F.size(own), mark, lambda m, i: step(m, i, own), kind)), 0)

    walls = tagged(base, 0)
    left = walk(
        F.sort_array(F.concat(walls, tagged(spans, 1))), F.lit(0), lambda m, s: F.greatest(m, s["end"]), lambda m, s: m <= s["start"]
    )
    # A wall that starts within a span stands right of its start.
    right = walk(
        F.reverse(F.sort_array(F.concat(walls, left))), F.lit((1 << 31) - 1), lambda m, s: s["start"], lambda m, s: s["end"] <= m
    )
    return F.transform(
        F.reverse(right), lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), s["match"].alias("match"))
    )


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _named(spans: Column, k: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), s["match"].alias("match")),
    )


def find(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, (more columns,) base spans, and candidates with the labelers' votes."""
    digit = F.col("text").rlike("[0-9]")
    df = docs.select("doc_id", *more, F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", *more, "text", digit.alias("digit")
    )
    card = lambda s: F.length(_digits(s["match"])).between(14, 19) & F.call_function("luhn_check", _digits(s["match"]))
    phone = lambda s: F.length(_digits(s["match"])).between(10, 15)
    text = F.col("text")
    base = [
        _only(text.contains("@"), _found(text, EMAIL)),
        F.filter(_only(F.col("digit") & text.rlike(r"[0-9]\.[0-9]"), _found(text, IP)), lambda s: s["match"].rlike(IP_VALID)),
        F.filter(_only(F.col("digit") & text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), _found(text, CARD)), card),
        F.filter(_only(F.col("digit") & text.rlike(r"\+[0-9]"), _found(text, PHONE)), phone),
    ]
    lower = F.lower(text)
    spelt = lower.contains("dot") & lower.rlike(r"(?:\(at\)|\[at\]|\x20at\x20)")
    df = df.select(
        "doc_id", *more, "text",
        F.sort_array(F.concat(*(_named(b, k) for k, b in enumerate(base)))).alias("base"),
        _only(spelt, _found(text, SPELT)).alias("spelt"),
        _only(F.col("digit") & text.rlike(r"[0-9](?:[\x20().-]{0,2}[0-9]){6}"), _found(text, NUMBER)).alias("numbers"),
        _only(F.col("digit") & text.rlike(CARD_LIKE), _found(text, CARD_LIKE)).alias("cards"),
    )
    numbers = F.filter("numbers", lambda s: F.length(_digits(s["match"])).between(7, 12))
    candidates = F.concat(_named(F.col("spelt"), 0), _named(F.col("cards"), 2), _named(numbers, 3))
    loose = F.when(F.size("base") > 0, _free(F.col("base"), candidates)).otherwise(candidates)
    df = df.select("doc_id", *more, "text", "base", F.sort_array(loose).alias("loose"))
    df = df.withColumn("chunks", _chunks(F.col("text"), F.size("base") + F.size("loose") > 0))
    return df.select(
        "doc_id", *more, "text",
        F.transform("base", lambda s: _voted(s, True)).alias("base"),
        F.transform("loose", lambda s: _voted(s, False)).alias("loose"),
    )


def _by_kind(k: Column, values: list[Column]) -> Column:
    return functools.reduce(lambda c, i: c.when(k == i, values[i]), range(1, len(values)), F.when(k == 0, values[0]))


def _voted(s: Column, strict: bool) -> Column:
    """A span with the votes of the labelers: 1 yes, 0 no, -1 none."""
    chunks, start, end, k, match = F.col("chunks"), s["start"], s["end"], s["k"], s["match"]
    before = F.lower(_part(chunks, F.greatest(start - 32, F.lit(0)), F.least(start, F.lit(32))))
    after = _part(chunks, end, F.lit(1))
    no, yes, none = F.lit(0), F.lit(1), F.lit(-1)
    digits = _digits(match)
    dated = digits.rlike("^(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])$")
    monotone = digits.rlike(r"^(.)\1+$")
    grouped = match.rlike(r"^\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){0,4}$")
    shape = _by_kind(k, [
        none,
        F.when(match.rlike(r"^(?:0|127|255)\."), no).otherwise(yes),
        F.when(monotone, no).when(F.call_function("luhn_check", digits), yes).otherwise(no),
        F.when(dated | monotone, no).when(grouped & F.length(digits).between(9, 12), yes).when(F.length(digits) >= 10, none).otherwise(no),
    ])
    cue = _by_kind(k, [before.rlike(rf"\b(?:{c})\b[\x20:.]*(?:\w+\x20)?[\x20:(]*$") for c in CUES.values()])
    against = before.rlike(rf"(?:\b(?:{AGAINST})\b[\x20:.#]*|[#=$€£]\x20?)$")
    tight = before.rlike(r"[a-z0-9_=/\\]$") | after.rlike(r"[A-Za-z0-9_=/\\%]")
    ending = F.lower(F.regexp_extract(match, r"([A-Za-z]+)\)?$", 1)).isin(*ENDINGS)
    votes = (
        yes if strict else none,
        shape,
        F.when(cue, yes).when(against, no).otherwise(none),
        F.when(tight, no).otherwise(none),
        F.when(k == 0, F.when(ending, yes).otherwise(no)).otherwise(none),
    )
    named = [v.cast("tinyint").alias(n) for v, n in zip(votes, LABELERS, strict=True)]
    return F.struct(start.alias("start"), k.alias("k"), end.alias("end"), *named)


def vote_counts(found: DataFrame) -> list[tuple]:
    """(kind, votes..., count): at most kinds x 3^labelers rows for any corpus."""
    spans = found.select(F.explode(F.concat("base", "loose")).alias("s"))
    counted = spans.groupBy("s.k", *(f"s.{n}" for n in LABELERS)).agg(F.count("*").alias("n"))
    return [tuple(r) for r in counted.collect()]


def reliabilities(counts: list[tuple], rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote combinations.

    Returns each labeler's table (kind, class, vote none/no/yes) and the probability of personal data per
    combination.  Counts of a prior, in which labelers are right three times of four, keep all positive.
    """
    rows = np.array(counts, float).reshape(-1, len(LABELERS) + 2)
    kind, votes, n = rows[:, 0].astype(int), rows[:, 1:-1].astype(int) + 1, rows[:, -1]
    prior = np.array([[2.0, 6.0, 2.0], [2.0, 2.0, 6.0]])
    table = np.tile(prior / prior.sum(1, keepdims=True), (len(LABELERS), len(KINDS), 1, 1))
    share = np.full(len(KINDS), 0.5)
    p = np.full(len(rows), 0.5)
    for _ in range(rounds):
        logs = np.stack([np.log(1 - share[kind]), np.log(share[kind])], 1)
        for j in range(len(LABELERS)):
            # A missing vote says nothing: only votes given are weighed.
            given = votes[:, j] > 0
            told = table[j, kind][np.arange(len(rows)), :, votes[:, j]]
            spoken = 1 - table[j, kind][:, :, 0]
            logs += np.where(given[:, None], np.log(told / spoken), 0)
        p = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -30, 30)))
        for k in range(len(KINDS)):
            own = kind == k
            share[k] = (2 + (n * p)[own].sum()) / (4 + n[own].sum())
            for j in range(len(LABELERS)):
                for c, weight in enumerate((1 - p, p)):
                    seen = np.bincount(votes[own, j], weights=(n * weight)[own], minlength=3) + prior[c]
                    table[j, k, c] = seen / seen.sum()
    return table, p


def features(kind: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """One column per kind, and per labeler one for a yes and one for a no."""
    return np.concatenate([np.eye(len(KINDS))[kind], votes == 1, votes == 0], axis=1).astype(float)


def train(counts: list[tuple], rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Weights of the span classifier: ridge logistic regression on EM's probabilities, by Newton steps."""
    width = len(KINDS) + 2 * len(LABELERS)
    if not counts:
        return np.zeros(width)
    _, p = reliabilities(counts)
    rows = np.array(counts, float)
    x, n = features(rows[:, 0].astype(int), rows[:, 1:-1].astype(int)), rows[:, -1]
    w = np.zeros(width)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (q - p)) + ridge * w
        hessian = (x * (n * q * (1 - q))[:, None]).T @ x + ridge * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    return w


def _score(s: Column, w: np.ndarray) -> Column:
    terms = [F.when(s["k"] == k, F.lit(float(w[k]))).otherwise(F.lit(0.0)) for k in range(len(KINDS))]
    for j, n in enumerate(LABELERS):
        yes, no = float(w[len(KINDS) + j]), float(w[len(KINDS) + len(LABELERS) + j])
        terms.append(F.when(s[n] == 1, F.lit(yes)).when(s[n] == 0, F.lit(no)).otherwise(F.lit(0.0)))
    return functools.reduce(operator.add, terms)


def _accepted(w: np.ndarray) -> Column:
    return F.filter("loose", lambda s: _score(s, w) > 0)


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end")))


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: numbers and digest of the base spans, and all spans."""
    found = materialize(find(docs).drop("text"), "spans")
    w = train(vote_counts(found))
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{n}") for k, n in enumerate(KINDS)),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.sort_array(F.concat(_plain(F.col("base")), _plain(_accepted(w))))).alias("spans"),
    )


def mask(docs: DataFrame) -> DataFrame:
    """Documents with every span replaced by its kind in brackets; other columns stay."""
    found = materialize(find(rest_packed(docs, "doc_id", "text"), REST), "spans")
    w = train(vote_counts(found))
    marked = found.withColumn("all", F.sort_array(F.concat(_plain(F.col("base")), _plain(_accepted(w)))))
    kinds = F.array(*map(F.lit, KINDS))

    def step(at: Column, i: Column, own: Column) -> tuple:
        s = F.get(own["all"], i)
        gap = F.when(s["start"] > at, _part(own["chunks"], at, s["start"] - at)).otherwise(F.lit(""))
        return F.greatest(at, s["end"]), s["start"] >= at, F.concat(gap, F.lit("["), F.upper(F.get(kinds, s["k"])), F.lit("]"))

    # One-element array to name spans and chunks, lest they are made anew for every span.
    named = F.array(F.struct("all", _chunks(F.col("text"), F.size("all") > 0).alias("chunks")))
    put = F.get(F.transform(named, lambda own: _walked(F.size(own["all"]), F.lit(0), lambda at, i: step(at, i, own), "array<string>")), 0)
    behind = F.substring(F.col("text"), F.array_max(F.transform("all", lambda s: s["end"])) + 1, F.length("text"))
    masked = F.concat(F.array_join(put, ""), behind)
    text = F.when(F.size("all") > 0, masked).otherwise(F.col("text"))
    own = {"doc_id": F.col("doc_id"), "text": text.alias("text")}
    return marked.select(*(own.get(c, F.col(REST).getField(c).alias(c)) for c in docs.columns))
