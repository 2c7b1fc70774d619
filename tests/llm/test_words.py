"""Word spans, hashes and slots against plain Python."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from slotloom.llm import words as W

TEXTS = st.lists(st.text("aAbB \t\n\x0b\x0c\r\x1c\xa0éÉ日", max_size=40).map(str.encode), max_size=6)


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_split(all_texts):
    for fold in (True, False):
        found = W.Words(all_texts, fold)
        plain = [[w.lower() if fold else w for w in t.split()] for t in all_texts]
        spelled = [found.data[a:b].tobytes() for a, b in zip(found.begins, found.ends)]
        assert [w.lower() if fold else w for w in spelled] == [w for own in plain for w in own]
        assert found.counts.tolist() == list(map(len, plain))
        by_word = dict(zip([w for own in plain for w in own], found.hashes.tolist()))
        assert [by_word[w] for own in plain for w in own] == found.hashes.tolist()
        assert len(set(by_word.values())) == len(by_word)


def test_hashes_do_not_depend_on_place_or_stretch():
    rng = np.random.default_rng(3)
    own = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (1, 5, 127, 128, 129, 200, 3000, 2_000_000)]
    want = [int(W.Words([w]).hashes[0]) for w in own]
    many = W.Words([b"x " * 300_000, b" ".join(own), b"", b"  ".join(own[::-1])])
    assert many.hashes[-16:].tolist() == want + want[::-1] and many.counts.tolist() == [300_000, 8, 0, 8]
    assert len(set(want)) == 8 and min(want) >= 16


def test_distinct_words_have_distinct_hashes():
    own = [f"{a}{b}".encode() for a in ("", "x", "word", "é") for b in range(60_000)]
    assert len(np.unique(W.Words([b" ".join(own)]).hashes)) == len(own)


def test_slots():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(16, 2**63, 200_000).astype(np.uint64))
    rng.shuffle(keys)
    slots = W.Slots(8)
    for a in range(0, len(keys), 30_000):
        assert (slots.find(keys[a : a + 30_000]) == -1).all()
        slots.add(keys[a : a + 30_000])
    assert (slots.find(keys) == np.arange(len(keys))).all() and (slots.find(np.array([1], np.uint64)) == -1).all()


def test_spread_and_first_places():
    assert W.spread(np.array([5, 9, 0]), np.array([2, 0, 3])).tolist() == [5, 6, 0, 1, 2]
    assert W.first_places(np.array([2, 0, 2, 1, 0]), 3).tolist() == [1, 3, 0]
