"""Words straight from Arrow buffers."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from hearthline.llm.words import Splitter, buffers, packed, slices, unpacked

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abAB é東\n\t \x0b.", max_size=30)), min_size=1, max_size=8)


def plain(text):
    return [re.sub(b"[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())]


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words(texts):
    w = Splitter()(*buffers(pa.array(texts, pa.string())))
    got = [[bytes(w.data[w.start[k] : w.end[k]]) for k in range(w.ptr[i], w.ptr[i + 1])] for i in range(len(texts))]
    assert got == [plain(t) for t in texts]
    assert w.row.tolist() == [i for i, t in enumerate(texts) for _ in plain(t)]
    flat = [x for t in texts for x in plain(t)]
    assert len(set(w.hash.tolist())) == len(set(flat)) and len(set(zip(flat, w.hash.tolist()))) == len(set(flat))


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * 50, None, "b" * 5, "c", "d" * 200])})
    parts = list(slices(batch, "text", 40))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column("text").to_pylist()) <= 40 for p in parts)
    assert list(slices(batch.slice(0, 0), "text")) == []


def test_packed_and_back():
    values = np.arange(7, dtype=np.uint64)
    back, at = unpacked(packed(values, [0, 2, 2, 7]), np.uint64)
    assert back.tolist() == values.tolist() and at.tolist() == [0, 2, 2, 7]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abAé0123456789\x00\n .", max_size=90).map(lambda x: x + x.replace(" ", "")), min_size=1, max_size=4))
def test_hashes_by_eights(texts):
    """The same words as the other way; hashes are equal where words are."""
    data, offsets = buffers(pa.array(texts, pa.string()))
    hashes, ptr = Splitter().hashes(data, offsets)
    words = [w for t in texts for w in plain(t)]
    assert np.diff(ptr).tolist() == [len(plain(t)) for t in texts]
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
