"""Secret scans: base patterns, and the guess cost of values in credential contexts.

Base spans are matches of three patterns (assignments of a credential, access keys, long hex runs), leftmost and
non-overlapping per kind. The method adds spans of kind ``guess``: values that follow a credential word (in a wider
sense than the assignment pattern) and would take at least 10^GUESS_LOG10 guesses. The cost of a value is the least
over all its segmentations into words, dates, repeats, keyboard walks and sequences, and brute-force spans, found by
dynamic programming; base spans stay whatever their values cost.

Words are the common ones of passwords and the words of the corpus itself, ranked by how many texts have them: a Spark
grouping counts the words of all texts, the first WORDS of them are collected and broadcast (some 200 KB, whatever the
corpus). So ordinary prose behind a credential word ("the password is required") costs little in any language.

Offsets count code points, ends are exclusive. Whole texts are scanned.

Defined results: a null text is empty and has no spans; repeated rows are scanned each, and each counts for the words; a
very long text is scanned whole; words of equal counts are ranked in byte order; spans that start at one place are listed
by kind; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, keep_only, ship, text_or_empty

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ with 24 or more
KINDS = ("assign", "access", "hex", "guess")

#: Where a credential's value may stand: a credential word, a sign or "is", an optional quote, the value.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer|(?:api|access|private|signing)[_-]?key)"""
    r"""["']?(?:\x20{0,4}(?:=>|:=|[:=])\x20{0,4}|\x20is\x20)(?:bearer\x20|basic\x20)?["']?([^\s"'<>,;]{6,})""", re.I | re.A)
#: One of these, lower-cased, is in every assignment or context.
HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "bearer", "key")
#: log10 of the guesses from which a value counts as a secret.
GUESS_LOG10 = 8.0

# Common passwords and words in them, most common first.
COMMON = """password 123456 qwerty admin welcome letmein login user guest root test demo example sample changeme default
secret master dragon monkey football baseball iloveyou sunshine princess shadow superman trustno summer winter spring autumn
hello freedom whatever starwars computer internet service server system manager office company account access private public
token value string null none true false your here my the and key api pass word name date time month year day love god money
house family michael jennifer jordan daniel charlie thomas robert andrew joshua matthew ashley jessica pepper ginger cookie
banana orange apple cheese flower purple yellow green black white silver golden diamond hunter killer soccer hockey tennis
london paris berlin madrid america germany france england spain january february march april june july august september
october november december monday tuesday wednesday thursday friday saturday sunday""".split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(COMMON)))}
#: Groups of words that are ranked by themselves, level by level.
RANK_GROUPS = (1024, 32, 1)
#: Words of the corpus that count as words, those in fewer texts do not; letters of such a word.
WORDS, MIN_TEXTS, MIN_LETTERS, MAX_LETTERS = 20_000, 5, 3, 24
LEET = str.maketrans("4@301!$57", "aaeoiisst")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
YEAR = re.compile(r"(?:19|20)\d\d")


MARKS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
#: Row and place of each key; every row is shifted by half a key. Keys within one place of each other touch.
KEY = {c: (r, i + 0.5 * r) for r, row in enumerate(ROWS) for i, c in enumerate(row)}


def _step(a: str, b: str) -> tuple[float, float] | None:
    """The direction from key a to key b if they touch."""
    if a == b or a not in KEY or b not in KEY:
        return None
    down, across = KEY[b][0] - KEY[a][0], KEY[b][1] - KEY[a][1]
    return (down, across) if abs(down) <= 1 and abs(across) <= 1 else None


def char_cost(c: str) -> float:
    """log10 of the number of characters like this one."""
    if "0" <= c <= "9":
        return 1.0
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return math.log10(26)
    return math.log10(33) if c.isascii() else 2.0


def _run_starts(low: str, joined) -> list[int]:
    """For each place, where the longest run of joined neighbours that ends there starts."""
    out = [0] * len(low)
    for i in range(1, len(low)):
        out[i] = out[i - 1] if joined(low[i - 1], low[i], i) else i
    return out


class Words:
    """Ranks of words: the common ones of passwords first, then ``listed`` in their order."""

    def __init__(self, listed: list[str] = ()):
        self.rank = dict(RANK)
        for w in listed:
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank))


PLAIN = Words()


def guess_cost(value: str, words: Words = PLAIN) -> float:
    """log10 guesses of the cheapest segmentation of ``value``; time linear in its length."""
    n = len(value)
    if not n:
        return 0.0
    low = value.lower() if len(value.lower()) == n else value
    plain = low.translate(LEET)
    dates: dict[int, list[tuple[int, float]]] = {}
    for pattern, cost in ((DATE, math.log10(365 * 160)), (YEAR, math.log10(160))):
        for m in pattern.finditer(low):
            dates.setdefault(m.end(), []).append((m.start(), cost))
    same = _run_starts(value, lambda a, b, i: a == b)
    up = _run_starts(low, lambda a, b, i: ord(b) - ord(a) == 1)
    down = _run_starts(low, lambda a, b, i: ord(a) - ord(b) == 1)
    steps = [None, *map(_step, low, low[1:])]
    walk = _run_starts(low, lambda a, b, i: steps[i] is not None)
    turned = [0] * (n + 1)  # turns of direction before each place
    for i in range(1, n):
        turned[i + 1] = turned[i] + (steps[i] != steps[i - 1])
    period = {p: _run_starts(value, lambda a, b, i, p=p: i >= p and value[i] == value[i - p]) for p in (2, 3, 4)}
    best, span = [0.0] * (n + 1), math.log10(2)  # each further span doubles the ways to combine
    for end in range(1, n + 1):
        cost = best[end - 1] + char_cost(value[end - 1])
        i = end - 1
        for start, base in ((same[i], char_cost(value[i])), (up[i], 1.5), (down[i], 1.8)):
            if end - start >= 3:
                cost = min(cost, best[start] + base + math.log10(end - start) + span)
        if end - walk[i] >= 4:
            turns = turned[end] - turned[walk[i] + 2]
            cost = min(cost, best[walk[i]] + math.log10(len(KEY) * (end - walk[i])) + 0.5 * turns + span)
        for p, starts in period.items():
            start = starts[i] + 1 - p  # the first period is spelled out, the others repeat it
            if start >= 0 and end - start >= 2 * p + (p == 2):
                cost = min(cost, best[start] + sum(char_cost(c) for c in value[start:start + p]) + math.log10((end - start) // p + 1) + span)
        for start, c in dates.get(end, ()):
            cost = min(cost, best[start] + c + span)
        for start in range(max(0, end - words.longest), end - 1):
            rank = words.rank.get(low[start:end])
            extra = 0.0
            if rank is None:
                rank, extra = words.rank.get(plain[start:end]), 1.0  # letters written as signs
            if rank is not None:
                upper = sum(1 for c in value[start:end] if c.isupper())
                if upper:
                    extra += span if upper in (1, end - start) else 1.0
                cost = min(cost, best[start] + math.log10(rank + 1) + extra + span)
        best[end] = cost
    return best[n]


def scan(text: str, words: Words = PLAIN) -> list[tuple[int, int, int, float]]:
    """(start, kind number, end, log10 guesses or 0) of every span, by start and kind."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end(), 0.0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        for m in CONTEXT.finditer(text):
            cost = guess_cost(m[1], words)
            if cost >= GUESS_LOG10:
                found.append((m.start(1), 3, m.end(1), cost))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), 0.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), 0.0) for m in HEX.finditer(text)]
    return sorted(found)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())])


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = WORDS, min_texts: int = MIN_TEXTS) -> list[str]:
    """The ``most`` words (letters only, lower-cased, marks around them cut off) that the most texts have."""
    ship(docs.sparkSession)

    def run(batches):
        keep_only("secrets")
        for batch in batches:
            for part in byte_slices(batch, 0, 8 << 20):
                lists = pc.utf8_split_whitespace(pc.utf8_lower(part.column(0)))
                coded = pc.utf8_trim(lists.flatten(), characters=MARKS).dictionary_encode()
                bounds = lists.offsets.to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                code = coded.indices.to_numpy()
                once = np.unique(row * max(1, len(coded.dictionary)) + code) % max(1, len(coded.dictionary))
                letters = pc.utf8_length(coded.dictionary)
                word = pc.and_(pc.and_(pc.utf8_is_alpha(coded.dictionary), pc.greater_equal(letters, MIN_LETTERS)), pc.less_equal(letters, MAX_LETTERS))
                n = np.bincount(once, minlength=len(coded.dictionary)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([coded.dictionary.filter(word), pa.array(n).filter(word)], ["word", "n"])

    counts = docs.select(text_or_empty(text_col).alias("t")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    best = counts.filter(F.col("n") >= min_texts)
    for groups in RANK_GROUPS:  # each group keeps ``most`` at most, so neither a task nor the driver gets all tasks' lists
        place = F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("word"), F.lit(groups))).orderBy(F.col("n").desc(), "word"))
        best = best.select("word", "n", place.alias("place")).filter(F.col("place") <= most)
    return [r["word"] for r in sorted(best.collect(), key=lambda r: r["place"])]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: list[str] | None = None) -> DataFrame:
    """(id, spans array<struct(kind, start, end, log10_guesses)>) of every whole text. ``words``: ranked words; those of
    ``docs`` themselves if None."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(corpus_words(docs, text_col) if words is None else words)
    x = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))

    def run(batches):
        keep_only("secrets")
        ranked = Words(sent.value)
        for batch in batches:
            texts = batch.column(1)
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "log10_guesses": c if k == 3 else None} for s, k, e, c in scan(texts[i].as_py(), ranked)]
                    for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(SPAN))], ["id", "spans"])

    return x.mapInArrow(run, f"id {x.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint,log10_guesses:double>>")


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    counts = [F.size(F.filter(F.col("spans.kind"), F.lit(k).__eq__)).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
