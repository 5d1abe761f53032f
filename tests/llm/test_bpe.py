import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lagweave.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def same(theirs, got, text):
    want = theirs.encode(text or "", add_special_tokens=False).ids
    assert np.frombuffer(got.ids, "<u4").tolist() == want, text[:80]
    assert got.decoded == theirs.decode(want, skip_special_tokens=False)


def test_documents(documents, theirs):
    for r in bpe.bpe(documents, PATH).collect():
        same(theirs, r, r.text)


def test_odd_rows(odd, none, theirs):
    got = bpe.bpe(odd, PATH).collect()
    assert len(got) == 12
    for r in got:
        same(theirs, r, r.text)
        assert r.k == 7
    assert bpe.bpe(none, PATH).count() == 0


def test_every_character(theirs):
    v = bpe.vocabulary(PATH)
    for a in [*range(0, 0x3000, 64), *range(0xA000, 0xD800, 64), *range(0xE000, 0x20000, 64)]:
        text = " a".join(chr(c) for c in range(a, a + 64))
        assert np.frombuffer(v.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, hex(a)


def test_long_words_merge_alike():
    v, r = bpe.vocabulary(PATH), random.Random(1)
    for n in (2, 5, 40, 300):
        parts = [v.inner[r.choice(b"abetinos")] for _ in range(n)]
        assert v.merge(parts[:]) == v.merge_long(parts[:])


def test_other_steps_are_refused():
    import copy
    import json

    import public_tokenizers
    import pytest

    spec = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    bpe.check_steps(spec)
    for change in (lambda x: x["normalizer"]["normalizers"].pop(), lambda x: x["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex="x"), lambda x: x["model"].update(byte_fallback=True), lambda x: x.update(pre_tokenizer=None), lambda x: x.update(normalizer=None)):
        other = copy.deepcopy(spec)
        change(other)
        with pytest.raises(ValueError):
            bpe.check_steps(other)
