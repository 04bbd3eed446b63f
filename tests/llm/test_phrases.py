import re
from collections import Counter, defaultdict

import pytest

from keelson.llm import phrases
from tests.llm import brute


def by_definition(rows, min_count=10, most=3, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    cands = {g: c for g, c in f.items() if len(g) > 2 and c >= min_count}
    covered = set()
    for g, c in cands.items():
        for i in range(1, len(g)):
            for j in range(i + 2, len(g) + 1):
                sub = (g[0], *g[i:j])
                if len(sub) < len(g) and 100 * c >= 50 * f[sub]:
                    covered.add(sub)
    out = defaultdict(list)
    for g, a in cands.items():
        if g not in covered:
            cuts = [(1_000_000 * a * a // (f[g[:k + 1]] * f[(g[0], *g[k + 1:])]), k) for k in range(1, len(g) - 1)]
            score, k = min(cuts)
            out[g[0]].append((-score, -a, " ".join(g[1:]).encode(), f[g[:k + 1]], f[(g[0], *g[k + 1:])]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:top]))


def mined(df):
    return sorted(tuple(r) for r in df.collect())


TEXTS = ["New York City is big. new york is not; New\tYork City!", "the cat, the cat the cat\nthe cat", "Ä ä Ä ä x\x0by x y", "a b c d a b c d e a b c"]


def rows_for_test():
    rows = [(t, lang) for t in TEXTS for lang in ("en", "de", None, "und") for _ in range(6)]
    return rows + [(None, "en"), ("", "en"), (" \t.,", None), ("the " * 3000, "en"), ("of the " * 500 + "end", "fr")]


@pytest.mark.parametrize("most,min_count,top", [(3, 10, 2000), (3, 3, 4), (4, 5, 2000), (2, 10, 2000)])
def test_by_definition(spark, most, min_count, top):
    rows = rows_for_test()
    docs = spark.createDataFrame([(t, lang, "?", "?") for t, lang in rows], "text string, lang string, w1 string, f string").repartition(3)
    assert mined(phrases.mine_phrases(docs, min_count=min_count, max_words=most, top=top)) == by_definition(rows, min_count, most, top)


def test_many_parts_small_filter_and_equal_numbers(spark, monkeypatch):
    """Streams cut within a word's phrases, a filter that lets nearly all pass, and numbers that collide at first."""
    monkeypatch.setattr(phrases, "PART_ROWS", 7)
    monkeypatch.setattr(phrases, "FAN", 2)
    rows = rows_for_test()
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    got = mined(phrases.mine_phrases(docs, min_count=4, max_words=4, filter_bits=1 << 15, number_bits=11, top=9))
    assert got == by_definition(rows, 4, 4, 9)


def test_real_texts(spark, small):
    rows = [(r.text, r.lang) for r in small.collect()]
    assert mined(phrases.mine_phrases(small)) == by_definition(rows)


def test_odd_and_empty(odd, none):
    assert mined(phrases.mine_phrases(odd)) == by_definition([(r.text, r.lang) for r in odd.collect()])
    assert phrases.mine_phrases(none).collect() == []
