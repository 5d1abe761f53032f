import random

import xxhash

from lagweave.llm import simhash


def plain(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints):
    """prints: [(doc_id, fingerprint)] -> component_id of each."""
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(prints))]


def test_documents(spark, documents, rows):
    prints = [(d, plain(t)) for d, t in rows]
    want = sorted((d, f"{f:016x}", c) for (d, f), c in zip(prints, groups(prints)))
    got = sorted(map(tuple, simhash.shown(simhash.near_duplicates(documents)).collect()))
    assert got == want and any(d != c for d, _, c in want)


def test_links_and_dense_groups(spark, monkeypatch):
    """Made fingerprints: chains of 1, 2 and 3 bits, a dense cloud and far ones."""
    r = random.Random(5)
    prints, n = [], 0
    for _ in range(30):
        f = r.getrandbits(64)
        for _ in range(r.randrange(1, 7)):
            prints.append((n, f))
            n += 1
            for b in r.sample(range(64), r.choice([1, 2, 3, 3, 3, 4, 5])):
                f ^= 1 << b
    center = r.getrandbits(64)
    for _ in range(150):
        f = center
        for b in r.sample(range(64), r.randrange(0, 5)):
            f ^= 1 << b
        prints.append((n, f))
        n += 1
    r.shuffle(prints)
    prints += [(500, 0), (501, 1 << 63), (None, 1 << 62), (500, 0)]
    made = spark.createDataFrame([(d, simhash.signed(f)) for d, f in prints], "doc_id bigint, f bigint")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    got = simhash.near_duplicates(made).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(key((x.doc_id, x.f, x.component_id)) for x in got) == sorted(key((d, simhash.signed(f), c)) for (d, f), c in zip(prints, groups(prints)))


def test_split_buckets_keep_every_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 2)
    test_links_and_dense_groups(spark, monkeypatch)


def test_references_discard_pairs(spark):
    """A crowded bucket: unlike fingerprints that agree in half their bits, and some links of distance 3."""
    r = random.Random(8)
    prints = []
    for _ in range(300):
        f = r.getrandbits(32) << 32
        g = f
        for b in r.sample(range(32, 64), 3):
            g ^= 1 << b
        prints += [f, g]
    prints = sorted({simhash.signed(f) for f in prints})
    labelled = spark.createDataFrame([(f, f) for f in prints], "f bigint, star bigint")
    rows = simhash.pivoted(labelled, len(prints))
    pairs = lambda w: {(min(x.a, x.b), max(x.a, x.b)) for x in simhash.meetings(rows, w).collect()}
    some, all_ = pairs(True), pairs(False)
    linked = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) % (1 << 64)).bit_count() == 3}
    assert linked <= some <= all_ and len(linked) >= 300
    print(f"pairs met: {len(some)} of {len(all_)}")
    assert len(some) < 0.1 * len(all_)


def test_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 12
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert {(r["__h"], r["__n"]) for r in kept.collect()} == {(7, 7)}
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == [None, 1, 4, 5, 6, 8, 9, 10, 11]
    assert simhash.near_duplicates(none).count() == 0


def test_one_doc_id_with_different_texts(spark):
    """Each component keeps a row, whatever doc_ids its rows share; the choice doesn't depend on the order of rows."""
    far = ["alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue cyan pink grey"]
    rows = [(1, far[0]), (1, far[1]), (1, far[0]), (2, far[0]), (3, far[2]), (2, far[2]), (None, far[0])]
    want = sorted([(1, far[0]), (1, far[1]), (2, far[2])])
    for order in (rows, rows[::-1]):
        kept = simhash.keep_one(spark.createDataFrame(order, "doc_id bigint, text string").repartition(3))
        assert sorted(tuple(r) for r in kept.where("doc_id is not null").collect()) == want
        assert kept.where("doc_id is null").count() == 1


def test_key_masks_grow_with_the_count():
    for count in (1, 10**6, 10**9, 10**12):
        masks = simhash.key_masks(count)
        assert all(m.bit_count() >= min(20, count.bit_length()) for m in masks)
        for _ in range(50):
            diff = sum(1 << b for b in random.sample(range(64), 3))
            assert any(not diff & m for m in masks)
