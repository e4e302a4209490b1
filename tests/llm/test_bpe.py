import hashlib
import random

import pytest
from glyspark.llm import bpe as B
from hypothesis import given, settings, strategies as st

from .helpers import AWKWARD, clashing, docs

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def mine():
    return B.WordBpe(PATH)


def test_segment_tree_against_a_list():
    rng = random.Random(1)
    values = [rng.randrange(9) for _ in range(37)]
    tree = B.SegmentTree(values)
    for _ in range(300):
        k, v = rng.randrange(37), rng.choice([rng.randrange(9), B._NONE])
        values[k] = v
        tree.set(k, v)
        low = min(values)
        assert tree.least() == (-1 if low == B._NONE else values.index(low))
    assert B.SegmentTree([]).least() == -1


@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from("中文Σςİſ́\U0001f600　  's'LL")), max_size=40))
@settings(max_examples=400, deadline=None)
def test_equals_the_library(library, mine, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == ids
    assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_special_tokens_and_long_words(library, mine):
    for text in ("a<|endoftext|>b <|startoftext|>", "<|endoftext|>", "a" * 5000, "ab" * 3000 + "!" * 3000, "<|endoftext|" * 3):
        assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_query_columns(spark, library):
    rows = AWKWARD + [(20, "It's the Cat’s <|endoftext|> hat")]
    got = B.encode_documents(clashing(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.ids): r for r in got}
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        joined = " ".join(map(str, ids))
        r = by[k, joined]
        text = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.decoded == text and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert B.encode_documents(docs(spark, [])).count() == 0


def test_bounded_cache_does_not_change_results(library, mine, monkeypatch):
    monkeypatch.setattr(B, "CACHE", 5)
    for k in range(20):
        text = " ".join(f"word{k}x{j}" for j in range(9))
        assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids
