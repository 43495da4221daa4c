"""The walk that settles pieces whose longest tokens don't go together."""

import public_tokenizers
import pytest

from emberfield.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_the_walk_begins_at_the_first_border_that_goes(vocabulary, monkeypatch):
    v = vocabulary
    piece = next(p for n in range(2, 40) for p in [" " + "deseauaielleauxtionelleerebendoanmentauxen" * n] if not _all_stay(v, p))
    kept = _kept(v, piece)
    assert kept > 0
    looked = []
    longest = v.longest
    monkeypatch.setattr(v, "longest", lambda s, pos: looked.append(pos) or longest(s, pos))
    v.encode_piece(piece)
    # What stands before that border is not looked up again.
    assert looked and min(looked) >= kept


def test_longest_tokens_are_found_in_one_lookup(vocabulary):
    v = vocabulary
    s = " whenèréquentlyñ".encode().decode("latin-1")
    for pos in range(len(s)):
        want = max((s[pos:end] for end in range(pos + 1, len(s) + 1) if s[pos:end] in v.node), key=len)
        assert v.text[v.longest(s, pos)] == want == v.text[v.begins[want]]


def _longest(v, piece):
    return [i for _, i in v.automaton.iter_long(piece.encode().decode("latin-1"))]


def _all_stay(v, piece):
    out = _longest(v, piece)
    return all(map(v.compatible, out, out[1:]))


def _kept(v, piece):
    """Bytes before the last token ahead of the first border that doesn't stay."""
    out = _longest(v, piece)
    k = next(k for k, pair in enumerate(zip(out, out[1:], strict=False)) if not v.compatible(*pair))
    return sum(v.size[i] for i in out[:k])
