import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lagweave.llm import substrings


def brute(docs, span=20):
    """index -> (n_words, kept words), every window in a dictionary."""
    split = [(t or "").encode().split() for _, t in docs]
    rank = lambda k: (docs[k][0] is None, docs[k][0] or 0, substrings.digest(split[k])[1:])
    order = sorted({rank(k): k for k in range(len(docs))}.items())
    seen, kept = set(), {}
    for key, k in order:
        w, gone = split[k], set()
        for i in range(len(w) - span + 1):
            win = tuple(w[i : i + span])
            if win in seen:
                gone.update(range(i, i + span))
            seen.add(win)
        kept[key] = [x for i, x in enumerate(w) if i not in gone]
    return [(len(split[k]), kept[rank(k)]) for k in range(len(docs))]


def check(spark, docs, span=20):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("d1", "key", "ranges", "raw", "first", "id")})
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.shown(substrings.repeats(df, span)).collect())
    want = brute(docs, span)
    assert got == sorted((str(d[0]), n, n - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for d, (n, k) in zip(docs, want))
    out = substrings.drop_repeats(df, span)
    assert out.columns == df.columns
    texts = sorted((str(r.doc_id), r.text or "") for r in out.collect())
    assert texts == sorted((str(d[0]), b" ".join(k).decode() if len(k) < n else d[1] or "") for d, (n, k) in zip(docs, want))
    return want


def test_covers():
    assert substrings.difference_cover(13) == (0, 1, 3, 9) and substrings.difference_cover(7) == (0, 1, 3) and substrings.difference_cover(1) == (0,)
    for p in range(1, 15):
        d = substrings.difference_cover(p)
        for i in range(p):
            for j in range(p):
                assert any((i + s) % p in d and (j + s) % p in d for s in range(p))


@pytest.mark.parametrize("span", [20, 5, 1, 27])
def test_made_texts(spark, span):
    r = random.Random(span)
    word = lambda: r.choice(["a", "A", "b", "É", "x1"]) if r.random() < 0.3 else f"w{r.randrange(10**6)}"
    shared = [[word() for _ in range(n)] for n in (19, 20, 21, 45, 200)]
    docs = []
    for i in range(60):
        w = []
        for _ in range(r.randrange(6)):
            w += r.choice(shared) if r.random() < 0.5 else [word() for _ in range(r.randrange(40))]
            if r.random() < 0.3 and w:
                w[r.randrange(len(w))] = "edit"
        docs.append((i, r.choice([" ", "  ", "\n", "\t"]).join(w)))
    docs += [(100 + i, docs[i][1]) for i in range(8)] + [(3, docs[3][1]), (None, docs[5][1]), (None, "z " * 30), (None, "z " * 31), (200, None), (201, ""), (202, "q " * 500), (203, "q " * 19), (7, "other text under one id")]
    want = check(spark, docs, span)
    assert any(0 < len(k) < n for n, k in want)


def test_documents(spark, rows):
    want = check(spark, rows)
    assert any(len(k) < n for n, k in want)


def test_odd_and_empty(spark, odd, none):
    assert substrings.shown(substrings.repeats(odd)).count() == 12 and substrings.drop_repeats(odd).count() == 12
    assert substrings.repeats(none).count() == 0 and substrings.drop_repeats(none).count() == 0


def test_one_long_text(spark):
    r = random.Random(1)
    w = [f"w{r.randrange(10**9)}" for _ in range(50_000)]
    check(spark, [(1, " ".join(w + w[100:40_000])), (2, " ".join(w[45_000:] + w[:30]))])
