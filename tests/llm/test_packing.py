import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm import packing, tokens
from pathloom.llm.tokens import END_ID, PATTERN, Encoder, default_path

TEXTS = ["Hello world's end", "", "  two  spaces\n\n\ttab ", "<|endoftext|>", "a<|endoftext|> b <|endoftext", "naïve café Straße 12.5%", "日本語 и русский", "\x1c\x85\u00a0x\u200b", "a" * 5000, "don't  'll 're"]


def test_pattern_is_the_files():
    import public_tokenizers

    assert PATTERN == public_tokenizers.PATTERN


def test_encoder_equals_tokenizers(sample):
    encoder = Encoder(default_path())
    texts = TEXTS + [r["text"] for r in sample.select("text").collect()]
    assert [encoder.ids(t) for t in texts] == [encoder.exact.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=60) | st.text(max_size=40) | st.text(alphabet=" \t\n'sSdlvertm0\xa0\x85\u00b2\u00bdé.,-", max_size=80))
def test_encoder_equals_tokenizers_on_any_text(text):
    encoder = tokens.encoder(default_path())
    assert encoder.ids(text) == encoder.exact.encode(text, add_special_tokens=False).ids


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


@pytest.mark.parametrize("low,high,n", [(1, 1023, 3000), (300, 700, 2000), (200, 400, 1500), (1000, 1024, 50), (1, 2, 1)])
def test_pack(low, high, n):
    lengths = np.random.default_rng(n).integers(low, high, n)
    where, offset = packing.pack(lengths, 1024)
    fill = np.bincount(where, weights=lengths)
    assert fill.max() <= 1024 and (fill > 0).all() and len(fill) >= packing.lower_bound(lengths, 1024)
    assert len(fill) <= len(packing.best_fit(lengths, 1024))
    for b in range(len(fill)):
        at = np.argsort(offset[where == b])
        assert (offset[where == b][at] == np.concatenate(([0], np.cumsum(lengths[where == b][at])[:-1]))).all()


@pytest.mark.parametrize("low,high,n,share", [(200, 400, 1500, 0.96), (150, 500, 3000, 0.97), (250, 520, 3000, 0.97)])
def test_search_saves_sequences(low, high, n, share):
    """Mixes without short pieces, where best fit wastes several per cent."""
    lengths = np.random.default_rng(n).integers(low, high, n)
    before, after = len(packing.best_fit(lengths, 1024)), packing.pack(lengths, 1024)[0].max() + 1
    assert packing.lower_bound(lengths, 1024) <= after <= share * before


def least_bins(lengths, capacity):
    """The fewest bins, by trying all places."""
    best = len(lengths)

    def place(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(lengths):
            best = len(room)
            return
        for i, r in enumerate(room):
            if r >= lengths[k] and r not in room[:i]:
                place(k + 1, room[:i] + [r - lengths[k]] + room[i + 1 :])
        place(k + 1, room + [capacity - lengths[k]])

    place(0, [])
    return best


def test_small_mixes_are_packed_as_tightly_as_can_be():
    rng = np.random.default_rng(4)
    over = 0
    for _ in range(60):
        lengths = np.sort(rng.integers(1, 21, 9))[::-1].copy()
        found, least = packing.pack(lengths, 20)[0].max() + 1, least_bins(lengths.tolist(), 20)
        assert packing.lower_bound(lengths, 20) <= least <= found
        over += found - least
    assert over <= 1


def test_search_empties_a_bin():
    # Two exchanges of 4 for 3 fill the first bins; then the third has room for the last item.
    lengths, bins = np.array([6, 6, 3, 3, 4, 4, 3]), [[0, 2], [1, 3], [4, 5], [6]]
    packing.Search(lengths, bins, 10).run(3)
    assert sum(1 for b in bins if b) == 3 and sorted(i for b in bins for i in b) == list(range(7)) and all(sum(lengths[b]) <= 10 for b in bins)


def test_search_gives_two_for_one():
    # 3 and 2 for the 4 fills the first bin.
    lengths, bins = np.array([5, 4, 3, 2]), [[0, 1], [2, 3]]
    packing.Search(lengths, bins, 10).run(1)
    assert sorted(sum(lengths[b]) for b in bins if b) == [4, 10]


def test_documents(edge, edge_rows, none):
    path = default_path()
    encoder = Encoder(path)
    rows = packing.pack_documents(edge, path, 64).collect()
    want = []
    for i, text, *_ in edge_rows:
        ids = np.array(encoder.ids(text or "") + [END_ID], "<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 64))]
    assert sorted(map(str, ((r["id"], r["piece"], r["start"], r["length"], r["crc"]) for r in rows))) == sorted(map(str, want))
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(none, path).count() == 0
