import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm import op13_phrases as P


def mined(rows, least, top, longest=5):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i: i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    f = Counter({p: n for p, n in f.items() if n >= least})
    longer = Counter()
    for (lang, p), n in f.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    longer[lang, p[i:j]] = max(longer[lang, p[i:j]], n)
    by_lang = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or longer[lang, p] >= a:
            continue
        score, k = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, total[lang], -s)
                  for lang, found in by_lang.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(13)
    fixed = ["new york city hall", "as well as", "Der alte Mann und das Meer", "ad hoc", "is", "the", "a", "ad", "hoc", "é"]
    vocabulary = [f"w{k}" for k in range(60)]
    out = []
    for k in range(500):
        parts = []
        for _ in range(rng.randrange(30)):
            parts.append(rng.choice(fixed) if rng.random() < 0.4 else vocabulary[min(int(rng.expovariate(0.12)), 59)])
        out.append(("".join(p + rng.choice([" ", " ", " ", "\t", ", ", "\n", "; "]) for p in parts), rng.choice(["en", "en", "de", None, "und"])))
    return out


@pytest.mark.parametrize("least, top, share, longest", [(3, 2000, 1.0, 5), (3, 12, 1 / 32, 5), (5, 40, 0.2, 3)])
def test_against_counting_everything(docs, texts, least, top, share, longest):
    frame = docs([(k, t, lang) for k, (t, lang) in enumerate(texts)])
    got = found(P.collocations(frame, min_count=least, top=top, longest=longest, share=share))
    assert got == mined(texts, least, top, longest)


def test_full_bit_maps_change_nothing(docs, texts, monkeypatch):
    """With few places most bits are wrong, and the result is the same."""
    monkeypatch.setattr(P, "BITS", 15)
    frame = docs([(k, t, lang) for k, (t, lang) in enumerate(texts)])
    assert found(P.collocations(frame, min_count=3, top=9)) == mined(texts, 3, 9)


def test_not_all_words_are_expanded(docs, texts, monkeypatch):
    """The bound of the words left out is below the last score."""
    seen = []
    counting = P.phrase_counts
    monkeypatch.setattr(P, "phrase_counts", lambda d, sizes, *rest: seen.append(counting(d, sizes, *rest)) or seen[-1])
    frame = docs([(k, t, lang) for k, (t, lang) in enumerate(texts)])
    assert found(P.collocations(frame, min_count=3, top=3)) == mined(texts, 3, 3)
    every = found(P.collocations(frame, min_count=3, top=10**6))
    assert max(df.count() for df in seen[:2]) < max(df.count() for df in seen[-2:]) and len(every) > 12


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    rows = [("en", big, 2, 1, True, big // 3, False, [(1, big // 3, big // 2)]), ("en", big, 2, 2, True, 10**11 - 1, False, [(1, 3 * 10**11, 10**9 + 7)])]
    frame = spark.createDataFrame(
        rows, "lang string, total bigint, size int, phrase bigint, inner boolean, a bigint, dropped boolean, cuts array<struct<k:int,l:bigint,r:bigint>>")
    got = {r["phrase"]: r["score"] for r in P.scored(frame).collect()}
    assert got == {1: 1000 * (big // 3) * big // ((big // 3) * (big // 2)), 2: 1000 * (10**11 - 1) * big // (3 * 10**11 * (10**9 + 7))}


def test_edges(docs):
    assert P.collocations(docs([])).count() == 0
    assert P.collocations(docs([None, "", " \t.,\n"]), min_count=1).count() == 0
    rows = [(1, "one two " * 40_000, "en"), (2, "a b. a b, a b", None), (2, "a b. a b, a b", None), (None, None, "fr"), (3, "x", "es")]
    clash = docs(rows).withColumn("phrase", F.lit(1)).withColumn("rank", F.lit("own"))
    want = mined([(t, lang) for _, t, lang in rows], 2, 2000)
    assert found(P.collocations(clash, min_count=2)) == want and any(r[0] == "und" for r in want)
