import hashlib
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strokeline.llm import bpe
from strokeline.llm.queries import TOKENIZERS

PATH = f"{TOKENIZERS}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")


@pytest.fixture(scope="module")
def model():
    return bpe.PairIndexBpe(open(PATH, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def same(model, library, texts):
    ids, offsets = model.encode(texts)
    for n, found in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        mine = ids[offsets[n] : offsets[n + 1]]
        assert mine.tolist() == found.ids, texts[n][:80]
        assert model.decode(mine).decode("utf-8", "replace") == library.decode(found.ids, skip_special_tokens=False)


def test_equals_the_library_on_every_character(model, library):
    points = [chr(i) for i in range(0x30000) if not 0xD800 <= i <= 0xDFFF]
    same(model, library, ["".join(points[k : k + 997]) for k in range(0, len(points), 997)] + [" ".join(points[k : k + 997]) for k in range(0, 60_000, 997)])


def test_equals_the_library_on_odd_texts(model, library):
    same(model, library, ["", " ", "aaaa" * 999, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "\0special", "it's I'LL we've 'd's", "\n \n\t  x", "  a  b", "x\x85y z"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab s't1\n é<|endoftext|>\x1c"), max_size=40), max_size=5))
def test_equals_the_library_on_any_text(model, library, texts):
    same(model, library, texts)


def test_round_trip_over_odd_rows(spark, odd, odd_rows, library):
    rows = bpe.bpe_round_trip(odd, PATH, carry=("lang", "k")).collect()
    assert len(rows) == len(odd_rows)
    expected = sorted(((i, len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), t or "") for (i, t, _), e in ((r, library.encode(r[1] or "", add_special_tokens=False)) for r in odd_rows)), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, hashlib.sha256(bytes(r.ids_le)).hexdigest(), r.decoded) for r in rows), key=repr) == expected
    apart = bpe.bpe_decode(bpe.bpe_encode(odd, PATH), PATH)
    assert sorted((r.decoded for r in apart.collect())) == sorted(t or "" for _, t, _ in odd_rows)


def test_empty_table(empty):
    assert bpe.bpe_round_trip(empty, PATH).collect() == []
