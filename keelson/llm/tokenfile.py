"""Token ids in binary files with plane-shuffled, compressed chunks.

Texts are encoded by the tokenizers library in ascending id order (a range partitioning, sorted inside), one file per
partition. A file holds

    magic | chunks | document index | chunk index | footer

A chunk takes up to CHUNK ids. Its ids (little-endian 32 bit) are transposed into four byte planes or 32 bit planes,
each compressed with zstandard, so the nearly empty high planes cost next to nothing. The chunk index has, per chunk,
its place, number of ids, checksum and the planes' lengths; the document index has the documents' ids and lengths.
Any range of ids is read by decoding only the chunks that it touches.

Tasks write straight to the shared folder, under a name of their own per attempt, and return one manifest row per
file. The manifest is a Parquet table that Spark commits, so files of lost or repeated attempts are never read.

Pieces between single white-space characters are encoded once per worker (the library encodes the new pieces of a
batch in one call); a piece border is always a border of the vocabulary's pre-tokens, so the ids equal those of the
whole text. Texts with other white space, or with a special token in them, go to the library whole.

Defined results: a null text is empty and gets only the end id; a null document id orders first; equal ids keep some
order of their own and lie in one file; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _CACHES, byte_slices, keep_only, materialize, shared_path, ship, text_or_empty

BYTE_BPE = "byte_bpe_50k.json"
MAGIC = b"KLTOKEN1"
#: Ids per chunk.
CHUNK = 1 << 16
#: Pieces whose ids a worker keeps.
PIECES = 1_200_000
#: Text bytes that are cut into pieces together.
ENCODE_BYTES = 10 << 20
NO_ID = -(1 << 63)
MANIFEST = "path string, first_id bigint, n_docs bigint, n_ids bigint, file_bytes bigint"


def planes_of(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The byte planes (4) or bit planes (32) of 32-bit ids, lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() for k in range(4)]
    return [np.packbits((raw[:, k // 8] >> (k % 8)) & 1).tobytes() for k in range(32)]


def ids_of(planes: list[bytes], n: int) -> np.ndarray:
    """The inverse of :func:`planes_of`."""
    raw = np.zeros((n, 4), np.uint8)
    if len(planes) == 4:
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        for k, p in enumerate(planes):
            raw[:, k // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << (k % 8)
    return raw.reshape(-1).view("<u4")


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI of the shared folder (file:, hdfs:, s3: ...) or of a plain path."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class TokenWriter:
    """Writes one file; ``add`` takes the little-endian ids of one document."""

    def __init__(self, uri: str, bits: bool = False, chunk: int = CHUNK, level: int = 1):
        import zstandard

        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.path)
        self.bits, self.chunk, self.pack = bits, chunk, zstandard.ZstdCompressor(level=level)
        self.out.write(MAGIC)
        self.at, self.held, self.held_bytes = len(MAGIC), [], 0
        self.chunks, self.doc_ids, self.lengths, self.n_ids = [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(NO_ID if doc_id is None else doc_id)
        self.lengths.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= 4 * self.chunk:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data, step = b"".join(self.held), 4 * self.chunk
        end = len(data) if last else len(data) - len(data) % step
        for k in range(0, end, step):
            part = data[k:min(k + step, end)]
            planes = [self.pack.compress(p) for p in planes_of(np.frombuffer(part, "<u4"), self.bits)]
            self.chunks.append([self.at, len(part) // 4, zlib.crc32(part), *map(len, planes)])
            self._write(b"".join(planes))
        self.held, self.held_bytes = [data[end:]], len(data) - end

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> int:
        self._flush(True)
        docs_at = self.at
        docs = self.pack.compress(np.array(self.doc_ids, "<i8").tobytes() + np.array(self.lengths, "<i8").tobytes())
        self._write(docs)
        index_at = self.at
        self._write(self.pack.compress(np.array(self.chunks, "<i8").tobytes()))
        footer = json.dumps({"chunk": self.chunk, "planes": 32 if self.bits else 4, "n_ids": self.n_ids, "n_docs": len(self.doc_ids),
                             "n_chunks": len(self.chunks), "docs": [docs_at, len(docs)], "index": [index_at, self.at - index_at]}).encode()
        self._write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return self.at


class TokenReader:
    """Reads a file of :class:`TokenWriter`."""

    def __init__(self, uri: str):
        import zstandard

        self.unpack = zstandard.ZstdDecompressor()
        where, path = open_fs(uri)
        self.file = where.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        n = int.from_bytes(tail[:8], "little")
        self.meta = json.loads(self.file.read_at(n, size - 16 - n))
        docs = np.frombuffer(self.unpack.decompress(self._at(*self.meta["docs"])), "<i8") if self.meta["n_docs"] else np.zeros(0, "<i8")
        self.doc_ids, self.lengths = docs[: self.meta["n_docs"]], docs[self.meta["n_docs"]:]
        index = self.unpack.decompress(self._at(*self.meta["index"])) if self.meta["n_chunks"] else b""
        self.chunks = np.frombuffer(index, "<i8").reshape(-1, 3 + self.meta["planes"])
        self.begins = np.concatenate([[0], np.cumsum(self.chunks[:, 1])]) if len(self.chunks) else np.zeros(1, np.int64)

    def _at(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset)

    def chunk(self, k: int) -> bytes:
        """The little-endian ids of chunk k, checked against its checksum."""
        offset, n, crc, *sizes = map(int, self.chunks[k])
        data, planes = self._at(offset, sum(sizes)), []
        for size in sizes:
            planes.append(self.unpack.decompress(data[:size]))
            data = data[size:]
        ids = ids_of(planes, n).tobytes()
        if zlib.crc32(ids) != crc:
            raise ValueError(f"chunk {k} is damaged")
        return ids

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids begin .. end - 1; decodes only the chunks that hold them."""
        if end <= begin:
            return np.zeros(0, "<u4")
        first, last = np.searchsorted(self.begins, [begin, end - 1], "right") - 1
        data = b"".join(self.chunk(k) for k in range(first, last + 1))
        skip = begin - int(self.begins[first])
        return np.frombuffer(data, "<u4")[skip: skip + end - begin]

    def documents(self):
        """(document id or None, little-endian ids) in file order; holds one chunk and one document at a time."""
        held, at, k = b"", 0, 0
        for doc_id, n in zip(self.doc_ids.tolist(), self.lengths.tolist()):
            end = at + 4 * n
            if end > len(held):
                parts = [held[at:]]
                size = len(parts[0])
                while size < 4 * n:
                    parts.append(self.chunk(k))
                    size += len(parts[-1])
                    k += 1
                held, at, end = b"".join(parts), 0, 4 * n
            yield (None if doc_id == NO_ID else doc_id), held[at:end]
            at = end


#: A text with a run of white space, white space at an end, other white space than these, or "<|" is not cut up.
UNCUT = r"  |\n\n| \n|\n |<\||^[ \n]|[ \n]$|[\x00\t\x0b-\r\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Marks between a letter and a space are a pre-token: they are cut off, so a word's ids serve every ending.
ENDING, CUT_OFF = r"(\pL)([!-/:-@\[-`{-~]+)( |$)", "\\1 \0\\2\\3"
#: New pieces that the library encodes as the lines of one string.
LINES = 2000


class PieceEncoder:
    """Whole texts -> ids by the tokenizers library, remembering the ids of pieces."""

    def __init__(self, source: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[str, bytes] = {}
        self.newline = self._library(["\n"])[0]
        self.line_end = int(np.frombuffer(self.newline, "<u4")[0])

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Encode new pieces as lines; a line end is a pre-token of its own and stands in no other piece's ids."""
        out = []
        for k in range(0, len(pieces), LINES):
            part = pieces[k:k + LINES]
            lines = "\n".join([p[1:] if p[0] == "\0" else " " + p for p in part]) + "\n"
            ids = self._library([lines])[0]
            at = 4 * np.flatnonzero(np.frombuffer(ids, "<u4") == self.line_end)
            out += [ids[begin:end] for begin, end in zip([0, *(at[:-1] + 4).tolist()], at.tolist(), strict=True)]
        self.known.update(zip(pieces, out, strict=True))
        return out

    def _ids(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.known.get, pieces))
        new = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(new, self._learn([pieces[i] for i in new])):
            found[i] = ids
        return found

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """The little-endian ids of each text. A piece is what stands between spaces and line ends, marks at its end cut
        off; \\x00 marks one that has no space before it. The pieces of all texts are cut and numbered by Arrow, each distinct one is
        looked up once, and the ids are gathered by its number."""
        if len(self.known) > PIECES:
            self.known.clear()
        self.known.update({"\n": self.newline, "\0": b""})
        odd = pc.match_substring_regex(texts, UNCUT)
        cut = pc.if_else(odd, "", texts)
        cut = pc.replace_substring(pc.binary_join_element_wise("\0", cut, ""), "\n", " \n \0")
        lists = pc.split_pattern(pc.replace_substring_regex(cut, ENDING, CUT_OFF), " ")
        coded = lists.flatten().dictionary_encode()
        held = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(held), "<u4")
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        begins = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        n = sizes[codes]
        ends = np.cumsum(n)
        ids = flat[np.repeat(begins[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        bounds = 4 * np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        out = [ids[i:j] for i, j in zip(bounds.tolist(), bounds[1:].tolist())]
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        for i, ids in zip(whole, self._library([texts[i].as_py() for i in whole])):
            out[i] = ids
        return out


_ENCODERS: dict[int, PieceEncoder] = {}
_CACHES["tokenfile"] = _ENCODERS.clear


def worker_encoder(source: bytes) -> PieceEncoder:
    key = zlib.crc32(source)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(source)
    return _ENCODERS[key]


def write_token_files(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
                      bits: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Encode, append ``end_id`` and write the files; returns the manifest in id order with each file's ``start``."""
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as f:
        source = spark.sparkContext.broadcast(f.read())
    folder = shared_path(spark, "token-files")
    x = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("t"))
    x = x.repartitionByRange("id").sortWithinPartitions("id")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        keep_only("tokenfile")
        encoder, writer, path = worker_encoder(source.value), None, ""
        for batch in batches:
            for part in byte_slices(batch, 1, ENCODE_BYTES):
                if writer is None:
                    path = f"{folder}/ids-{uuid.uuid4().hex}.kltok"
                    writer = TokenWriter(path, bits, chunk)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1))):
                    writer.add(doc_id, ids + end)
        if writer is not None:
            size = writer.close()
            first = writer.doc_ids[0]
            yield pa.RecordBatch.from_pylist([{
                "path": path, "first_id": first, "n_docs": len(writer.doc_ids), "n_ids": writer.n_ids, "file_bytes": size}])

    manifest = materialize(x.mapInArrow(run, MANIFEST), "token-manifest")
    order = Window.orderBy("first_id").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0))), "token-files")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(id, start, ids binary) of every document, read back from the files of a manifest."""
    ship(manifest.sparkSession)
    files = manifest.select("path", F.col("start").cast("bigint").alias("start")).repartition(max(1, manifest.count()))

    def run(batches):
        keep_only("tokenfile")
        for batch in batches:
            for path, at in zip(*(c.to_pylist() for c in batch.columns)):
                rows, size = [], 0
                for doc_id, ids in TokenReader(path).documents():
                    rows.append({"id": doc_id, "start": at, "ids": ids})
                    at += len(ids) // 4
                    size += len(ids)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, FILE_ROWS)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, FILE_ROWS)

    return files.mapInArrow(run, "id bigint, start bigint, ids binary")


FILE_ROWS = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(BYTE_BPE))
    back = read_token_files(manifest)
    return back.select(F.col("id").alias("doc_id"), "start", F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))
