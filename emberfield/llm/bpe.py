"""Byte-level BPE encoding and decoding for whole texts.

Encoding: an Aho-Corasick automaton over the vocabulary's byte strings yields the longest token
that starts at each byte of a piece.  A left-to-right walk takes the longest one that is
*compatible* with its predecessor (the merge rules would not have merged across that border),
falls back to the next shorter prefix token, and steps back where none fits; a bit per position
makes sure that no dead end is entered twice.  The result equals applying the merges in rank order.

Decoding: one table with the bytes of all tokens and their offsets; ids are expanded by gathering.

Defined results: a null text is the empty text (no ids, empty decoding); the literal string of a
special token in a text becomes that token, as the tokenizers library does by default; repeated
rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded_batches

#: The pre-tokenisation pattern of this family of vocabularies.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNKS = re.compile(rf" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
BESIDE = re.compile(rf" [{_WHITE}]|[{_WHITE}] ")


def _byte_alphabet() -> dict[str, int]:
    """Printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tables of one byte-level BPE file: automaton, merges, offsets."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # Nodes are numbered by rank: the 256 bytes, then the merges in their order.
        self.text: list[str] = [chr(b) for b in range(256)]  # byte strings as latin-1 text
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        node = self.node = {t: i for i, t in enumerate(self.text)}
        self.merged: dict[tuple[int, int], int] = {}
        self.pairs: dict[int, bool] = {}  # compatibility of pairs met so far
        for merge in spec["model"]["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = (node[as_bytes(x).decode("latin-1")] for x in (left, right))
            self.merged[a, b] = node[self.text[a] + self.text[b]] = len(self.text)
            self.text.append(self.text[a] + self.text[b])
            self.halves.append((a, b))
        ids = {as_bytes(t).decode("latin-1"): i for t, i in vocab.items() if t not in self.special}
        self.id_of = [ids[t] for t in self.text]
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.text):
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.size = [len(t) for t in self.text]
        self.most = max(self.size)
        self.shorter = [self._shorter(t, node) for t in self.text]
        # The longest token that begins each prefix of a token (each path of the automaton's trie).
        self.begins = {t[:n]: -1 for t in self.text for n in range(1, len(t) + 1)}
        for prefix in sorted(self.begins, key=len):
            self.begins[prefix] = node[prefix] if prefix in node else self.begins[prefix[:-1]]
        size = 1 + max([*self.id_of, *self.special.values()])
        raw = [b""] * size
        for i, t in zip(self.id_of, self.text, strict=True):
            raw[i] = t.encode("latin-1")
        for t, i in self.special.items():
            raw[i] = t.encode()
        self.lengths = np.array([len(r) for r in raw], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.decimal = [str(i) for i in range(size)]

    @staticmethod
    def _shorter(text: str, node: dict[str, int]) -> int:
        for n in range(len(text) - 1, 0, -1):
            if (i := node.get(text[:n])) is not None:
                return i
        return -1

    def compatible(self, left: int, right: int, most: int = 1_000_000) -> bool:
        """Whether merging in rank order keeps a border between these two neighbours, by the pair table."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= most:
                self.pairs.clear()
            known = self.pairs[key] = self._border_stays(left, right)
        return known

    def _border_stays(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are not merged across their border.

        This is the test of the published backtracking encoder (the bpe crate, described by its authors in 2024).
        """
        merged, halves = self.merged, self.halves
        bound = 1 << 62
        while True:
            if merged.get((left, right), bound) < bound:
                return False
            # Undo the later of the two last merges and look at what stood at the border before.
            if left > right:
                bound, left = left, halves[left][1]
                if left != bound:
                    continue
                bound, right = right + 1, halves[right][0]
                if right + 1 == bound:
                    return True
            else:
                bound, right = right + 1, halves[right][0]
                if right + 1 != bound:
                    continue
                bound, left = left, halves[left][1]
                if left == bound:
                    return True

    def longest(self, s: str, pos: int) -> int:
        """The longest token that starts at a position, from the automaton's trie."""
        return self.begins[s[pos : pos + self.automaton.longest_prefix(s[pos : pos + self.most])]]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        s = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        compatible, id_of, known = self.compatible, self.id_of, self.pairs.get
        # Longest matches end to end; where all neighbours are compatible they are the answer.
        out = [i for _, i in self.automaton.iter_long(s)]
        left = out[0] if out else -1
        for k in range(1, len(out)):
            right = out[k]
            stays = known(left << 32 | right)
            if not (compatible(left, right) if stays is None else stays):
                break
            left = right
        else:
            return [id_of[i] for i in out]
        # Up to that border the walk would take the same tokens.
        size, shorter, longest = self.size, self.shorter, self.longest
        total = len(s)
        open_ = bytearray(b"\1") * (total + 1)
        token = out[k]
        del out[k:]
        pos = sum(map(size.__getitem__, out))
        while pos < total:
            left = out[-1] if out else -1
            while token >= 0:
                end = pos + size[token]
                if open_[end]:
                    if left < 0:
                        break
                    stays = known(left << 32 | token)
                    if compatible(left, token) if stays is None else stays:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos = end
                token = longest(s, pos) if pos < total else -1
            else:
                open_[pos] = 0
                token = out.pop()
                pos -= size[token]
        return [id_of[i] for i in out]

    def decode(self, ids: np.ndarray) -> str:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return self.bytes[at].tobytes().decode("utf-8", "replace")


class _Kept(dict):
    """Results by key, made when missing; emptied when full, so that memory stays bounded."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        made = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = made
        return made


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned numbers of 32 bits."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Encodes whole texts; keeps the ids of at most ``most`` pre-tokens and of as many chunks.

    A chunk is a run without white space, with the space before it: no pre-token crosses its ends.
    """

    def __init__(self, path: str, most: int = 300_000):
        v = self.vocabulary = Vocabulary(path)
        self.pieces = _Kept(lambda piece: packed(v.encode_piece(piece)), most)
        self.chunks = _Kept(lambda chunk: b"".join(map(self.pieces.__getitem__, PIECES.findall(chunk))), most)
        self.spaced = _Kept(self._spaced, most)
        special = sorted(v.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def encode(self, text: str) -> np.ndarray:
        special, parts = self.vocabulary.special, [text]
        if self.split and any(s in text for s in special):
            parts = self.split.split(text)
        ids = b"".join(np.array([special[p]], "<u4").tobytes() if p in special else self._plain(p) for p in parts)
        return np.frombuffer(ids, "<u4")

    def _spaced(self, chunk: str) -> bytes:
        # Letters alone are one pre-token with their space (beyond Latin, the pattern's own tables decide).
        if chunk.isalpha() and (chunk.isascii() or max(chunk) < "\u0250"):
            return self.pieces[" " + chunk]
        return self.chunks.make(" " + chunk)

    def _plain(self, text: str) -> bytes:
        if text[:1] in ("", " ") or text[-1] == " " or BESIDE.search(text):
            return b"".join(map(self.chunks.__getitem__, CHUNKS.findall(text)))
        # Every space stands between two other characters.
        first, *rest = text.split(" ")
        return b"".join([*map(self.chunks.__getitem__, CHUNKS.findall(first)), *map(self.spaced.__getitem__, rest)])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the text decoded from them."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        v = e.vocabulary
        for b in batches:
            counts, digests, decoded = [], [], []
            for text in b.column(1).to_pylist():
                ids = e.encode(text or "")
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(v.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                decoded.append(hashlib.sha256(v.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Per document: its ids as an array."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            ids = [e.encode(t or "").astype(np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
