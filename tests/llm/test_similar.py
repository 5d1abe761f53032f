import random

from lagweave.llm import similar


def brute(rows):
    """rows: [(doc_id, text)] -> doc_ids that stay, by five-word Jaccard of 0.8 or more between all pairs."""

    def cut(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets, up = [cut(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted(least.values())


def test_documents(documents, rows):
    """Documents 6 and 145 (similarity 0.83) and 1 and 177 are 7 and 11 bits of SimHash apart."""
    import corpus_pipeline as p

    got = sorted(r.doc_id for r in p.drop_near_copies(documents.sparkSession, documents.select(p.COLUMNS), None).collect())
    assert got == brute(rows) and not {145, 177} & set(got)


def test_edited_copies_and_large_buckets(spark, monkeypatch):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    texts = []
    for size in [1, 2, 3] * 10 + [60]:
        base = [word() for _ in range(120)]
        for _ in range(size):
            t = list(base)
            for i in r.sample(range(120), r.choice([0, 1, 1, 2, 3, 6, 8])):
                t[i] = word()
            texts.append(" ".join(t))
    rows = list(enumerate(texts + [None, "", "a b", "A  b", "a b c"]))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(x.doc_id for x in similar.keep_one(df).collect()) == brute(rows)
    monkeypatch.setattr(similar, "SMALL", 1)
    for references in (1, 3):
        monkeypatch.setattr(similar, "REFERENCES", references)
        assert sorted(x.doc_id for x in similar.keep_one(df).collect()) == brute(rows)


def test_odd_rows(odd, none, spark):
    kept = similar.keep_one(odd)
    assert kept.columns == odd.columns
    assert {(r["__h"], r["__n"]) for r in kept.collect()} == {(7, 7)}
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == [None, 1, 4, 5, 6, 8, 9, 10, 11]
    assert similar.keep_one(none).count() == 0
    rows = [(1, "x y"), (1, "p q"), (1, "x y"), (2, "x y"), (None, "x y")]
    got = similar.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == ["(1, 'p q')", "(1, 'x y')", "(None, 'x y')"]


def test_bitmaps_never_part_similar_sets():
    """Two bitmaps differ in at most as many bits as the sets in shingles, also where they are full."""
    import numpy as np

    r = random.Random(5)
    for size in (1, 7, 60, 500, 5000):
        a = {r.getrandbits(64) for _ in range(size)}
        for share in (0, 0.05, 0.2, 1):
            b = set(r.sample(sorted(a), size - int(size * share))) | {r.getrandbits(64) for _ in range(int(size * share))}
            x, y = (similar.parity(np.array(sorted(s), np.uint64)) for s in (a, b))
            differ = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
            assert differ <= len(a ^ b)


def test_fingerprints_are_simhash():
    """Their first word by the plain definition, over distinct five-word shingles."""
    import xxhash

    r = random.Random(7)
    for n in (1, 4, 5, 9, 700):
        w = [r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(n)]
        h = {xxhash.xxh64_intdigest(" ".join(w[i : i + 5]).encode(), 42) for i in range(max(1, n - 4))}
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert int(similar.fingerprint(similar.shingles(" ".join(w).encode()))[0]) % (1 << 64) == want


def test_pairs_at_the_least_similarity_share_a_bucket():
    """Of pairs at exactly 0.8, whose fingerprints are far more than op4's 3 bits apart, hardly one shares no bucket, and
    small ones always share a first shingle."""
    import numpy as np

    r = np.random.default_rng(11)
    for count in (200, 50_000):
        rows = similar.tables(count)
        word, mask = np.array([w for _, w, _ in rows]), np.array([m for *_, m in rows])
        lost = 0
        for _ in range(1500):
            h = r.integers(0, 1 << 63, 100, dtype=np.uint64)
            a, b = (similar.fingerprint(np.sort(x)) for x in (h[:90], h[10:]))
            x = a ^ b
            assert 3 < int(np.bitwise_count(x.view(np.uint64)).sum()) <= similar.REACH
            meets = (x[word] & mask) == 0
            close = np.bitwise_count(x[(word + similar.WORDS // 2) % similar.WORDS].view(np.uint64)) <= similar.CLOSE
            lost += not (meets & close).any()
        assert lost <= 2
    for n in range(5, similar.TINY + 1):
        for _ in range(50):
            h = r.integers(0, 1 << 63, n, dtype=np.uint64)
            a, b = np.sort(h), np.sort(h[: -(-4 * n // 5)])
            assert {*similar.first_shingles(a).tolist()} & {*similar.first_shingles(b).tolist()}


def test_texts_go_in_small_batches_and_are_kept_once(spark, monkeypatch):
    """What the largest Arrow batch of 20 MB of texts takes while texts are hashed and verified."""
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    wide = spark.range(0, 200, 1, 1).selectExpr("repeat('x', 100000) t")
    largest = lambda: max(r.n for r in wide.mapInArrow(sizes, "n bigint").collect())
    plain, seen, texts, keep = largest(), {}, [], similar.materialize

    def watched(df, what):
        if what in ("sketches", "similar"):
            seen[what] = max(seen.get(what, 0), largest())
        texts.extend([what] * ("text" in df.columns))
        return keep(df, what)

    monkeypatch.setattr(similar, "materialize", watched)
    assert similar.keep_one(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "b")], "doc_id bigint, text string")).count() == 2
    assert {*seen} == {"sketches", "similar"} and max(seen.values()) < 5 << 20
    assert texts == ["sketches"] and largest() == plain


def test_pairs_at_the_least_similarity_share_two_buckets():
    """Of pairs at exactly 0.8 hardly one is close in fewer than two buckets."""
    import numpy as np

    r = np.random.default_rng(13)
    for count in (200, 50_000):
        rows = similar.tables(count)
        word, mask = np.array([w for _, w, _ in rows]), np.array([m for *_, m in rows])
        lost = 0
        for _ in range(3000):
            h = r.integers(0, 1 << 63, 100, dtype=np.uint64)
            x = similar.fingerprint(np.sort(h[:90])) ^ similar.fingerprint(np.sort(h[10:]))
            close = np.bitwise_count(x[(word + similar.WORDS // 2) % similar.WORDS].view(np.uint64)) <= similar.CLOSE
            lost += (((x[word] & mask) == 0) & close).sum() < 2
        assert lost <= 3


def test_unlike_pairs_of_one_bucket_are_not_looked_at(spark, monkeypatch):
    """Texts that share a long passage but not enough of it: few of their pairs are left for fingerprints to be joined."""
    r = random.Random(17)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    passage = [word() for _ in range(40)]
    rows = [(i, " ".join(passage + [word() for _ in range(60)])) for i in range(300)]
    pairs, verify = [], similar.similar_pairs

    def watched(found, *rest):
        pairs.append(found.distinct().count())
        return verify(found, *rest)

    monkeypatch.setattr(similar, "similar_pairs", watched)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert similar.keep_one(df).count() == 300
    assert pairs[0] <= 5000  # of 44,850; 12,394 meet in one small bucket or more
