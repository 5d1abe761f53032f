import collections
import zlib

from pyspark.sql import functions as F

from lagweave.llm import kd_shards


def check(docs, got, shards=40):
    want = sorted(str((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))) for d, t in docs)
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got) == want
    slots, sizes = collections.defaultdict(list), collections.Counter()
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_documents(documents, spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = kd_shards.shard(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sizes = check(rows, got)
    mean = sum(sizes.values()) / 40
    assert len(sizes) == 40 and max(abs(s - mean) for s in sizes.values()) < 0.08 * mean
    home = {r.doc_id: r.shard for r in got}
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[t].append(d)
    small = [g for t, g in groups.items() if len(g) > 1 and len(g) * (len((t or "").encode()) + 16) <= mean * kd_shards.PART]
    assert small and all(len({home[d] for d in g}) == 1 for g in small)


def tree(units, shards, first=0):
    """(h1, h2, sub) -> shard by plain recursion over units (key, weight, (d0, d1, d2), u)."""
    if shards == 1:
        return {k: first for k, *_ in units}
    total = sum(w for _, w, *_ in units)
    spread = []
    for i in range(3):
        mean = sum(w * d[i] for _, w, d, _ in units) / total
        spread.append(round(sum(w * (d[i] - mean) ** 2 for _, w, d, _ in units) / total, 6))
    dim = max(range(3), key=lambda i: (spread[i], -i))
    want, run, at = total * (shards // 2) / shards, 0.0, 0
    ordered = sorted(units, key=lambda x: (x[2][dim], x[3]))
    places = [(x[2][dim], x[3]) for x in ordered]
    for place in sorted(set(places)):
        here = sum(x[1] for x, p in zip(ordered, places) if p == place)
        if run + here >= want * (1 - 1e-12):
            cut = place if 2 * (want - run) < here else (place[0], place[1] + 1)
            break
        run += here
    left = [x for x, p in zip(ordered, places) if p < cut]
    right = [x for x, p in zip(ordered, places) if p >= cut]
    return tree(left, shards // 2, first) | tree(right, shards - shards // 2, first + shards // 2)


def test_tree_by_recursion(documents):
    rows = kd_shards.slim(documents)
    units = kd_shards.units(rows, 11)
    want = tree([((r.h1, r.h2, r.sub), r.weight, (r.d0, r.d1, r.d2), r.u) for r in units.collect()], 11)
    got = {(r.h1, r.h2, r.sub): r.node for r in kd_shards.grow(units, 11).collect()}
    assert got == want and len(set(want.values())) == 11


def test_names_keep_their_order(spark):
    names = sorted(["src_1", "src_10", "src_2", "src_", "src_zz", "src_é"], key=str.encode)
    df = spark.createDataFrame([(n,) for n in names], "n string")
    at = [r[0] for r in df.select(kd_shards.ordinal(F.col("n"), kd_shards.common_start(names[0], names[-1]))).collect()]
    assert at == sorted(at) and len(set(at)) == len(at)


def test_hot_group_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(kd_shards, "BUCKET_ROWS", 7)
    docs = [(i, "same text") for i in range(900)] + [(1000 + i, "t" * (i % 37)) for i in range(600)]
    df = spark.createDataFrame([(d, t, "en", "s") for d, t in docs], "doc_id bigint, text string, lang string, source string")
    sizes = check(docs, kd_shards.shard(df).collect())
    assert max(sizes.values()) < 1.1 * sum(sizes.values()) / 40


def test_odd_rows(odd, none):
    check([(r.doc_id, r.text) for r in odd.collect()], kd_shards.shard(odd).collect())
    assert kd_shards.shard(none).count() == 0
