"""Collocations against a plain count of all n-grams."""

import random
import re
from collections import Counter

import pytest

from tallyloom.llm import collocations

SCHEMA = "doc_id long, text string, lang string"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, max_words=3, least=10, share=50, top=2000):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for k in range(1, max_words + 1) for i in range(len(words) - k + 1))
    found = []
    candidates = {g: a for g, a in counts.items() if len(g) > 2 and a >= least}
    for (lang, *words), a in candidates.items():
        cuts = [(1_000_000 * a * a // (counts[lang, *words[:k]] * counts[lang, *words[k:]]), k) for k in range(1, len(words))]
        best, k = min(cuts)
        inside = lambda g: any(list(g[i : i + len(words)]) == words for i in range(1, len(g) - len(words) + 1))  # noqa: B023, E731
        if not any(g[0] == lang and len(g) > len(words) + 1 and 100 * f >= share * a and inside(g) for g, f in candidates.items()):
            found.append((lang, " ".join(words), a, counts[lang, *words[:k]], counts[lang, *words[k:]], totals[lang], best))
    ranked = []
    for lang in totals:
        own = sorted((f for f in found if f[0] == lang), key=lambda f: (-f[6], -f[2], f[1].encode()))[:top]
        ranked += [(lang, k + 1, *f[1:]) for k, f in enumerate(own)]
    return sorted(ranked)


def rows_of(seed, n=200):
    rng, rows = random.Random(seed), []
    words = ["New", "York", "City", "hall", "der", "über", "Éa", "éa", "a", "b", "\x1f", "x\x00y", "mid\u2003dle"]
    for k in range(n):
        text = "".join(rng.choice(words) + rng.choice((" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b")) for _ in range(rng.choice((0, 1, 5, 60))))
        rows.append((k, rng.choice((text, text, text, None, "New York City hall")), rng.choice(("en", "de\n", None, "und", "", "a b"))))
    return rows


@pytest.mark.parametrize("max_words,least,share,top,group", [(3, 10, 50, 2000, 3_000_000), (4, 5, 80, 7, 50), (2, 10, 50, 2000, 200), (5, 3, 50, 40, 1000)])
def test_whole(spark, max_words, least, share, top, group):
    rows = rows_of(max_words)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", n int, phrase string").repartition(5)
    got = collocations.collocations(docs, max_words, least, share, top, group=group)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == plain(rows, max_words, least, share, top)


def test_a_small_filter(spark, monkeypatch):
    """What a filter lets through by mistake doesn't show."""
    monkeypatch.setattr(collocations, "SLOTS", 1 << 16)
    rows = [(k, " ".join(f"w{(k * 7 + i * i) % 300}" for i in range(200)), "en") for k in range(300)]
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA), least=3)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == plain(rows, least=3)


def test_empty_and_one_frequent_pair(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, "", "en"), (3, " .,\n", "en")], SCHEMA)).count() == 0
    rows = [(k, "la la " * 40, "fr") for k in range(100)]
    got = [tuple(r[c] for c in COLUMNS) for r in collocations.collocations(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == plain(rows) == [("fr", 1, "la la la", 7800, 8000, 7900, 8000, 962658)]


def test_scores_are_exact(spark):
    """Products beyond 64 bits."""
    a, l, r = 999_999_999_999_937, 999_999_999_999_989, 999_999_999_999_947  # noqa: E741
    got = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(collocations.score("a", "l", "r")).first()[0]
    assert got == 1_000_000 * a * a // (l * r)
