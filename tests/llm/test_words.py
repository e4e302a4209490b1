import re

import numpy as np
from glyspark.llm import _words as W
from hypothesis import given, settings, strategies as st

TEXT = st.text(alphabet=st.sampled_from("aAbZ \t\n\x0b\x0c\r.é中\x1c "), max_size=60)


def pack(texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@given(st.lists(TEXT, max_size=6))
@settings(max_examples=200, deadline=None)
def test_words_and_shingles(texts):
    raw, off = pack(texts)
    h, s, e, begin = W.word_hashes(raw, off)
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts]
    assert [lower(raw[a:b].tobytes().decode()) for a, b in zip(s, e)] == [w for ws in words for w in ws]
    seen = {}
    for w, x in zip([w for ws in words for w in ws], h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    for ws, got in zip(words, W.shingle_sets(raw, off)):
        want = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()
        assert len(got) == len(want)
