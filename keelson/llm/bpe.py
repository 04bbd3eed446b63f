"""BPE encoding by backtracking over longest token matches, decoding by an offset table.

Encoder: every base unit (a byte character, or its word-final variant) is one private character, so a token is a
string of units. An Aho-Corasick automaton over the tokens gives the longest token at each place of a word; the
encoder takes it if it is compatible with the token before, else a shorter prefix token, else steps back. Two tokens
are compatible if merging their joined units by rank would give exactly the two; the test walks both merge trees and
is kept in a pair table. Ends that cannot be completed are marked, so each place is left at most once: linear time,
and the result equals that of applying the merges in rank order.

Decoder: all token texts lie in one buffer; an offset table gives each id's place, and the ids of a text are gathered
in one vectorised step.

Texts are split at white space first; the ids of a piece are kept in a bounded table per worker. Whole texts are
encoded; output batches are bounded by bytes.

Defined results: a null text is an empty one (no ids, empty decoded text); repeated rows are encoded each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _CACHES, keep_only, ship, text_or_empty

WORD_BPE = "word_bpe_49k.json"
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACES = regex.compile(r"(?V1)[\s--[\x1c-\x1f]]+")
#: Pieces (white-space delimited) whose ids a worker keeps.
PIECES = 300_000
#: Words (what the vocabulary's split leaves) whose ids a worker keeps.
WORDS = 700_000
#: Text bytes after which a worker hands on what it has.
OUT_BYTES = 4 << 20


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [], 0
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class BacktrackingEncoder:
    """Units of a word -> token ids, equal to applying ``merges`` in rank order."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        import ahocorasick

        base = [t for t in vocab if len(t) == 1 or (suffix and len(t) == 1 + len(suffix) and t.endswith(suffix))]
        self.unit = {t: chr(0xE000 + i) if i < 0x1900 else chr(0xF0000 + i) for i, t in enumerate(base)}
        order = {t: i for i, t in enumerate(base)}  # place in merge order, base units first
        units = [self.unit[t] for t in base]
        self.ids = [vocab[t] for t in base]
        self.left, self.right = list(range(len(base))), list(range(len(base)))
        self.pairs: dict[tuple[int, int], int] = {}
        for merge in merges:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            whole = a + b
            if whole in order:  # a second way to form a token
                self.pairs.setdefault((order[a], order[b]), order[whole])
                continue
            order[whole] = len(units)
            self.pairs[order[a], order[b]] = len(units)
            self.left.append(order[a])
            self.right.append(order[b])
            units.append(units[order[a]] + units[order[b]])
            self.ids.append(vocab[whole])
        self.length = [len(u) for u in units]
        self.automaton = ahocorasick.Automaton()
        for i, u in enumerate(units):
            self.automaton.add_word(u, i)
        self.automaton.make_automaton()
        place = {u: i for i, u in enumerate(units)}
        #: longest proper prefix of each token that is a token
        self.shorter = [next((place[u[:n]] for n in range(len(u) - 1, 0, -1) if u[:n] in place), -1) for u in units]
        self.compatible: dict[tuple[int, int], bool] = {}

    def _compatible(self, a: int, b: int) -> bool:
        """Whether rank-order merging of the units of a and b never joins across their border."""
        limit = 1 << 62
        while True:
            joined = self.pairs.get((a, b))
            if joined is not None and joined < limit:
                return False
            if a > b:  # a was formed later: look at what stood at the border before
                limit, a = a, self.right[a]
                if a == limit:
                    limit, b = b + 1, self.left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.left[b]
                if b + 1 == limit:
                    limit, a = a, self.right[a]
                    if a == limit:
                        return True

    def fits(self, a: int, b: int) -> bool:
        known = self.compatible.get((a, b))
        if known is None:
            if len(self.compatible) > 1_000_000:
                self.compatible.clear()
            known = self.compatible[a, b] = self._compatible(a, b)
        return known

    def encode(self, word: str) -> list[int]:
        n = len(word)
        longest, length = [-1] * (n + 1), self.length
        for end, token in self.automaton.iter(word):
            start = end + 1 - length[token]
            if longest[start] < 0 or length[longest[start]] < length[token]:
                longest[start] = token
        open_end = bytearray(b"\1") * (n + 1)  # ends that may still be completed
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + length[token]
            if open_end[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                at, token = end, longest[end]
                continue
            if self.shorter[token] >= 0:
                token = self.shorter[token]
                continue
            open_end[at] = 0
            token = out.pop()
            at -= length[token]
        return [self.ids[t] for t in out]


class WordCodec:
    """Encoder and decoder of a vocabulary file with white space dropped and word-final units."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.encoder = BacktrackingEncoder(model["vocab"], model["merges"], self.suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"])
        self.chars = byte_characters()
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        texts = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.buffer = np.frombuffer(b"".join(texts), np.uint8)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """Ids (little-endian 32 bit) of a piece without white space."""
        # letters are lowered one by one, so a sigma has no final form
        text = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
        words = self.words
        ids = b"".join([self._word(w) if (out := words.get(w)) is None else out for w in self.split.findall(text)])
        if len(self.known) >= PIECES:
            self.known.clear()
        self.known[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        chars = [self.chars[b] for b in word.encode()]
        unit = self.encoder.unit
        units = "".join([unit[c] for c in chars[:-1]] + [unit[chars[-1] + self.suffix]])
        if len(self.words) >= WORDS:
            self.words.clear()
        ids = self.words[word] = np.array(self.encoder.encode(units), "<u4").tobytes()
        return ids

    def _plain(self, text: str) -> bytes:
        known = self.known.get
        # file, group, record and unit separators are white space to str.split only
        pieces = SPACES.split(text) if SEPARATORS.search(text) else text.split()
        return b"".join([self._piece(p) if (ids := known(p)) is None else ids for p in pieces])

    def encode(self, text: str) -> bytes:
        if "<" not in text:
            return self._plain(text)
        parts = self.at_special.split(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens' texts, joined by a space."""
        a = np.frombuffer(ids, "<u4")
        if not len(a):
            return b""
        parts = []
        for k in range(0, len(a), 1 << 17):
            part = a[k:k + (1 << 17)]
            n = self.lengths[part]
            ends = np.cumsum(n)
            place = np.repeat(self.offsets[part] - (ends - n), n) + np.arange(ends[-1])
            parts.append(self.buffer[place].tobytes())
        return b"".join(parts)[:-1]


_SOURCES: dict[str, bytes] = {}


@lru_cache(maxsize=2)
def _codec(digest: str) -> WordCodec:
    return WordCodec(_SOURCES[digest])


def worker_codec(source: bytes) -> WordCodec:
    """One codec per worker process and vocabulary."""
    digest = hashlib.sha256(source).hexdigest()
    _SOURCES[digest] = source
    return _codec(digest)


_CACHES["bpe"] = _codec.cache_clear


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(id, ids binary: little-endian 32-bit[, decoded string]) of every whole text.

    The vocabulary file (a few MB) is read once on the driver and broadcast."""
    spark = docs.sparkSession
    ship(spark)
    source = spark.sparkContext.broadcast(read_vocabulary(path))
    x = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    schema = f"id {x.schema['id'].dataType.simpleString()}, ids binary" + (", decoded string" if decode else "")

    def run(batches):
        keep_only("bpe")
        codec = worker_codec(source.value)
        for batch in batches:
            texts, rows, begin, size = batch.column(1), [], 0, 0
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                rows.append(codec.encode(text))
                size += len(text) * (4 if decode else 1)
                if size >= OUT_BYTES or i + 1 == batch.num_rows:
                    cols = [batch.column(0).slice(begin, len(rows)), pa.array(rows, pa.binary())]
                    if decode:
                        cols.append(pa.array([codec.decode(r) for r in rows], pa.binary()).cast(pa.string()))
                    yield pa.RecordBatch.from_arrays(cols, ["id", "ids", "decoded"][: len(cols)])
                    begin, rows, size = i + 1, [], 0

    return x.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, decoded) of (id, ids)."""
    spark = encoded.sparkSession
    ship(spark)
    source = spark.sparkContext.broadcast(read_vocabulary(path))
    x = encoded.select("id", F.coalesce("ids", F.lit(b"")).alias("ids"))

    def run(batches):
        keep_only("bpe")
        codec = worker_codec(source.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = pa.array([codec.decode(v.as_py()) for v in part.column(1)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts], ["id", "decoded"])

    return x.mapInArrow(run, f"id {x.schema['id'].dataType.simpleString()}, decoded string")


def bpe_digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    both = bpe_encode(docs, public_tokenizers.path(WORD_BPE), decode=True)
    return both.select(F.col("id").alias("doc_id"), F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_bpe(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's number of tokens and the digests of its ids and decoded text."""
    return bpe_digests(docs)
