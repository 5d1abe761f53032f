import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from lagweave.llm import winnow


def brute(docs, items, span=10):
    """doc index -> (n_words, n_hit, sorted item ids)."""
    windows = {}
    for i, t in items:
        w = winnow.split((t or "").encode())
        k = min(len(w), span)
        for a in range(len(w) - k + 1 if w else 0):
            windows.setdefault(k, {}).setdefault(tuple(w[a : a + k]), set()).add(str(i))
    out = []
    for _, t in docs:
        w = winnow.split((t or "").encode())
        hit, ids = set(), set()
        for k, known in windows.items():
            for a in range(len(w) - k + 1):
                if found := known.get(tuple(w[a : a + k])):
                    hit |= {*range(a, a + k)}
                    ids |= found
        out.append((len(w), len(hit), sorted(ids)))
    return out


def check(spark, docs, items):
    kind = "doc_id bigint, text string"
    got = winnow.decontaminate(spark.createDataFrame(docs, kind), spark.createDataFrame(items, kind.replace("doc", "item"))).collect()
    key = lambda d, x: (str(d), *map(str, x))
    assert sorted(key(r.doc_id, (r.n_words, r.n_hit, list(r["items"]))) for r in got) == sorted(key(d[0], x) for d, x in zip(docs, brute(docs, items)))


def test_documents(spark, sf_dir, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert any(x[1] for x in brute(rows, items))
    check(spark, rows, items)


def test_short_and_repeated_items(spark):
    r = random.Random(3)
    word = lambda: r.choice("abcd")
    text = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, text(r.randrange(60))) for i in range(60)] + [(None, None), (5, ""), (6, "q " * 300), (6, "q " * 300)]
    items = [(i, text(n)) for i, n in enumerate([1, 3, 4, 5, 6, 9, 10, 11, 14, 30])] + [(50, text(12)), (51, None), (52, ""), (53, "q " * 10), (54, "Q,q " * 10)]
    check(spark, docs, items)


def test_empty_tables_and_odd_rows(spark, odd, none):
    items = none.select(F.col("doc_id").alias("item_id"), "text")
    got = winnow.digests(winnow.decontaminate(odd, items)).collect()
    assert len(got) == 12 and not any(r.contaminated for r in got)
    assert got[0].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert winnow.decontaminate(none, items).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id bigint, text string")
    kept = winnow.drop_contaminated(odd, some)
    assert kept.columns == odd.columns and kept.count() == 10


def test_winnowing_guarantee():
    r = np.random.default_rng(0)
    g = r.integers(0, 6, 400).astype(np.uint64)
    at = winnow.winnow(g, 6)
    assert list(at) == sorted({s + 5 - int(np.argmin(g[s : s + 6][::-1])) for s in range(395)})
