import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keelson.llm import bpe

PATH = public_tokenizers.path(bpe.WORD_BPE)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    return bpe.worker_codec(bpe.read_vocabulary(PATH))


def same(codec, library, texts):
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(t)
        assert codec.decode(ids).decode() == library.decode(want, skip_special_tokens=False), repr(t)


def test_equals_library_on_documents(codec, library, small_rows):
    same(codec, library, [t for _, t, _ in small_rows])


def test_equals_library_on_odd_texts(codec, library):
    r = random.Random(5)
    alphabet = "abcdefghij'sTΣςİ éèß中文字1234½² \t\n\x1c\x1f\x85\xa0́​ .,!?-_<|>😀한글ﬁǅ"
    same(codec, library, ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(3000)])
    parts = ["<|endoftext|>", "<|startoftext|>", "a", "B ", "'s", "'S ", "the", "ing"]
    same(codec, library, ["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(500)])


def test_backtracking_on_long_words(codec, library):
    r = random.Random(6)
    same(codec, library, ["".join(r.choice("aabcdeinthrs") for _ in range(r.randint(0, 300))) for _ in range(500)] + ["a" * 20_000, "ab" * 9_000])


def test_pair_table_agrees_with_merging(codec):
    """Two tokens are compatible exactly if merging their units by rank gives the two."""
    e, r = codec.encoder, random.Random(7)

    def merged(units):
        seq = [next(i for i, u in enumerate(e.left) if i == k) for k in units]
        while True:
            best = min(((e.pairs[p], i) for i, p in enumerate(zip(seq, seq[1:])) if p in e.pairs), default=None)
            if best is None:
                return seq
            seq[best[1]:best[1] + 2] = [best[0]]

    def units(t):
        return [t] if e.left[t] == t else units(e.left[t]) + units(e.right[t])

    for _ in range(400):
        a, b = r.randrange(512, 4000), r.randrange(512, 4000)
        assert e.fits(a, b) == (merged(units(a) + units(b)) == [a, b])


@pytest.mark.parametrize("name", ["small", "odd"])
def test_digests(request, library, name):
    docs = request.getfixturevalue(name)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digests(docs).collect())
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)


def test_decode_frame(small):
    both = bpe.bpe_encode(small, PATH, decode=True)
    back = {r.id: r.decoded for r in bpe.bpe_decode(both, PATH).collect()}
    assert back == {r.id: r.decoded for r in both.collect()}


def test_empty(none):
    assert bpe.bpe_digests(none).collect() == []
