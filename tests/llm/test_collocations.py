"""Collocations against plain counting."""

import random
import re
from collections import Counter

import pytest

from tessera.llm import collocations

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, phrase string, a long, `a.b` int"


def brute(rows, least, kept=2000):
    counts, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOW)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                counts.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    longer = Counter()
    for (lang, *ws), a in counts.items():
        if a >= least:
            for m in range(2, len(ws)):
                for i in range(len(ws) - m + 1):
                    key = (lang, *ws[i : i + m])
                    longer[key] = max(longer[key], a)
    found = []
    for (lang, *ws), a in counts.items():
        if a < least or len(ws) < 2 or 100 * longer[(lang, *ws)] >= 80 * a:
            continue
        cuts = [(2_000_000 * a // (counts[(lang, *ws[:k])] + counts[(lang, *ws[k:])]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        found.append((lang, -score, -a, " ".join(ws).encode(), counts[(lang, *ws[:k])], counts[(lang, *ws[k:])]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        rank[lang] += 1
        if rank[lang] <= kept:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def run(spark, rows, least, kept=2000):
    docs = spark.createDataFrame([(k, t, lang, "x", 1, 2) for k, (t, lang) in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in collocations.collocations(docs, least, kept).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_as_plain_counting(spark, seed):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(9)] + ["É", "é", "\x01", "a\x00b", "\x1f", "THE", "\xa0", "中"]
    marks = [" ", " ", " ", "  ", "\t", ". ", "\n", ",", "?!", "\r\n"]
    rows = [("".join(draw.choice(words) + draw.choice(marks) for _ in range(draw.randint(0, 90))), draw.choice(["en", "de", None, ""])) for _ in range(120)]
    rows += [(None, "en"), ("", "fr"), (" . ", "fr"), ("one of a kind phrase here. " * 3000, "en")] + [rows[0]] * 3
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")  # parts begin inside the phrases of a word
    try:
        got = run(spark, rows, 4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows, 4) and len(got) > 200
    assert run(spark, rows, 4, 5) == brute(rows, 4, 5)


def test_nothing_frequent_and_no_rows(spark):
    assert run(spark, [("once only", "en")], 30) == [] == run(spark, [], 30)
