"""Word-piece token counts by a linear longest-match automaton.

Greedy longest-match-first pieces of a word are counted without building them.  The vocabulary
trie holds word-initial pieces from its root and continuation pieces from a second root.  A node's
failure link leads to the node reached after the longest initial piece(s) of its string have been
cut off, and ``popped`` says how many pieces that cut off, so each character is read once.

The vocabulary is taken from a byte-pair file: tokens that start with its space mark are initial
pieces, those without are continuations.  A word that no sequence of pieces covers counts as one
unknown token, as word-piece tokenizers do.

Defined results: null and blank texts have no words and no tokens; case is kept; repeated rows give
repeated rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches


class Automaton:
    def __init__(self, initial: set[str], continuing: set[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # 0: word start, 1: continuation
        ends = [False, False]
        for root, tokens in ((0, initial), (1, continuing)):
            for token in tokens:
                if not token:
                    continue
                at = root
                for c in token:
                    to = self.next[at].get(c)
                    if to is None:
                        to = self.next[at][c] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                    at = to
                ends[at] = True
        self.link = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        level = [(0, c, to) for c, to in self.next[0].items()] + [(1, c, to) for c, to in self.next[1].items()]
        while level:
            below = []
            for parent, c, node in level:
                if ends[node]:
                    self.link[node], self.popped[node] = 1, 1
                else:
                    # Cut pieces from the parent's string until what is left can be followed by c.
                    at, cut = self.link[parent], self.popped[parent]
                    while at >= 0 and c not in self.next[at]:
                        cut += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[node], self.popped[node] = self.next[at][c], cut
                below += [(node, x, to) for x, to in self.next[node].items()]
            level = below

    def count(self, word: str) -> int:
        """Number of pieces, or -1 where no pieces cover the word."""
        next_, link, popped = self.next, self.link, self.popped
        at = n = 0
        for c in word:
            while (to := next_[at].get(c)) is None:
                n += popped[at]
                at = link[at]
                if at < 0:
                    return -1
            at = to
        while at != 1:
            n += popped[at]
            at = link[at]
            if at < 0:
                return -1
        return n


def split_vocabulary(path: str) -> tuple[set[str], set[str]]:
    """Initial and continuation pieces of a byte-pair file; pieces that aren't whole UTF-8 are left out."""
    from .bpe import _byte_alphabet

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = _byte_alphabet()
    initial, continuing = set(), set()
    for token in spec["model"]["vocab"]:
        if not all(c in alphabet for c in token):
            continue
        try:
            text = bytes(alphabet[c] for c in token).decode()
        except UnicodeDecodeError:
            continue
        if text.startswith(" "):
            initial.add(text[1:])
        else:
            continuing.add(text)
            if len(text) == 1:
                initial.add(text)
    return initial, continuing


class _Counts(dict):
    def __init__(self, automaton: Automaton, most: int = 400_000):
        self.automaton, self.most = automaton, most

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word.decode())
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n


@functools.lru_cache(maxsize=2)
def _counts(path: str) -> _Counts:
    return _Counts(Automaton(*split_vocabulary(path)))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """Per document: words, word-piece tokens, and words that no pieces cover (one token each)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _counts(path).__getitem__
        for b in batches:
            words, tokens, unknown = [], [], []
            for text in b.column(1).to_pylist():
                # bytes.split() cuts at space and \t \n \v \f \r only.
                n = [get(w) for w in (text or "").encode().split()]
                bad = n.count(-1)
                words.append(len(n))
                tokens.append(sum(n) + 2 * bad)
                unknown.append(bad)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))],
                ["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
