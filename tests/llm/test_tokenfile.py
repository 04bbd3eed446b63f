import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keelson.llm import tokenfile

PATH = public_tokenizers.path(tokenfile.BYTE_BPE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return tokenfile.PieceEncoder(f.read())


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_pieces_equal_whole_texts(encoder, library, small_rows):
    r = random.Random(3)
    alphabet = "abcdefghij'sTΣςİ éèß中文字1234½² \t\n\x1c\x85\xa0́​.,!?-_<|>😀한글"
    parts = ["<|endoftext|>", "\n", "a", "B ", "'s", "the", "ing", " foo,", " bar!?", "é", "\n.", " 't", ".x", "12,", " é!", "\0"]
    texts = [t for _, t, _ in small_rows] + ["", " ", "\n", " a", "a ", "a\n", "\na", "\0", "a, b. c!\nd,"]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(5000)]
    for t, ids in zip(texts, encoder.encode(pa.array(texts))):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(library, t).tolist(), repr(t)


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    r = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 1000):
        ids = r.integers(0, 2 ** 32, n, dtype=np.uint32)
        planes = tokenfile.planes_of(ids, bits)
        assert len(planes) == (32 if bits else 4) and (tokenfile.ids_of(planes, n) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_file_round_trip(tmp_path, bits):
    r = np.random.default_rng(1)
    docs = [(None if i == 0 else i, r.integers(0, 50_000, n, dtype=np.uint32).tobytes()) for i, n in enumerate([0, 1, 999, 1000, 1001, 5000, 0, 3])]
    path = str(tmp_path / "x.kltok")
    writer = tokenfile.TokenWriter(path, bits, chunk=1000)
    for d in docs:
        writer.add(*d)
    writer.close()
    reader = tokenfile.TokenReader(path)
    flat = np.frombuffer(b"".join(d for _, d in docs), "<u4")
    assert list(reader.documents()) == docs
    assert len(reader.chunks) == -(-len(flat) // 1000)
    for a, b in ((0, len(flat)), (0, 0), (999, 1001), (2500, 2501), (len(flat) - 1, len(flat))):
        assert (reader.ids(a, b) == flat[a:b]).all()
    raw = bytearray(open(path, "rb").read())
    raw[int(reader.chunks[1][0]) + 12] ^= 1
    open(path, "wb").write(bytes(raw))
    with pytest.raises(Exception):
        tokenfile.TokenReader(path).ids(0, len(flat))


@pytest.mark.parametrize("name", ["small", "odd"])
def test_files_of_a_frame(request, library, name):
    docs = request.getfixturevalue(name)
    manifest = tokenfile.write_token_files(docs.repartition(5), PATH)
    back = tokenfile.read_token_files(manifest).collect()
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(back, key=lambda r: r.start)
    at = 0
    assert [r.id for r in got] == [i for i, _ in rows]
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(zlib.crc32(np.append(ids_of(library, t), np.uint32(0)).astype("<u4").tobytes()))
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
        want[r.id].remove(zlib.crc32(r.ids))
    assert manifest.agg(F.sum("n_ids")).first()[0] == at


def test_empty(none):
    manifest = tokenfile.write_token_files(none, PATH)
    assert manifest.collect() == [] and tokenfile.read_token_files(manifest).collect() == []
