import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lagweave.llm import elias_fano, lm_trie, tokens


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 1), (5, 1 << 64), (1000, 900), (5000, 1 << 64), (70_000, 1 << 45), (3000, 1 << 20)):
        v = np.sort(r.integers(0, top, n, np.uint64, endpoint=False)) if top < 1 << 64 else np.sort(r.integers(0, (1 << 64) - 1, n, np.uint64, endpoint=True))
        v = np.sort(np.concatenate([v[: n // 2], v[: n - n // 2]]))  # equal values too
        ef = elias_fano.EliasFano(elias_fano.encode(v, top))
        assert (ef.get(np.arange(n)) == v).all()
        x = np.concatenate([v, v + np.uint64(1), r.integers(0, min(top, (1 << 64) - 1), 500, np.uint64)])
        x = np.minimum(x, np.uint64(min(top, 1 << 64) - 1))
        i, equal = ef.successor(x)
        assert (i == np.searchsorted(v, x)).all() and (equal == np.isin(x, v)).all()


def brute(docs, order, cutoff=lm_trie.CUTOFF):
    """docs: (doc_id, text) -> the result's rows by dictionaries."""
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    toks = lambda t: [b" start", *(t or "").encode().lower().split(), b" end"]
    one, two, three, ctx = (collections.Counter() for _ in range(4))
    for d, t in docs:
        if not held(d):
            w = toks(t)
            one.update(w[1:])
            two.update(zip(w, w[1:]))
            three.update(zip(w, w[1:], w[2:]))
            ctx.update(w[:-1])
    kept = {g: n for g, n in three.items() if n >= cutoff} if order > 2 else {}
    sums = collections.Counter()
    for (a, b, _), n in kept.items():
        sums[a, b] += n
    n, v, mu = sum(one.values()), len(one), lm_trie.MU
    p = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    p2 = lambda a, b: (two[a, b] + mu * p(b)) / (ctx[a] + mu)
    p3 = lambda a, b, c: (kept.get((a, b, c), 0) + mu * p2(b, c)) / (sums[a, b] + mu)
    out = []
    for d, t in docs:
        w = toks(t)
        s = math.log10(p2(*w[:2])) + sum(math.log10(p3(*g)) for g in zip(w, w[1:], w[2:]))
        out.append((d, held(d), len(w) - 1, sum(one[x] > 0 for x in w[1:]), n, sum(math.log10(p(x)) for x in w[1:]), s))
    return out


def check(df, docs, order=lm_trie.ORDER, **limits):
    got = lm_trie.train_and_score(df, order, **limits).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 3))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute(docs, order, limits.get("cutoff", lm_trie.CUTOFF)), key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(a[6] - b[6]) <= 3e-4 * a[2]  # up to three quantised parts a token
    return got


@pytest.mark.parametrize("order", [2, 3])
def test_documents(documents, rows, order):
    """Many blocks, and contexts that are split."""
    got = check(documents, rows, order, block_bytes=30_000, split=40)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_all_triples(documents, rows):
    check(documents, rows, cutoff=1, block_bytes=100_000)


def test_higher_order_tells_more(documents, rows):
    two, three = (sum(r.score for r in lm_trie.train_and_score(documents, k).collect()) for k in (2, 3))
    assert three > two


def test_odd_rows(odd, none):
    check(odd, [(r.doc_id, r.text) for r in odd.collect()])
    assert lm_trie.train_and_score(none).count() == 0


def test_no_training_rows(spark):
    check(spark.createDataFrame([(i, "a b") for i in (13,) if zlib.crc32(str(i).encode()) % 10 == 0] or [(None, "a b")], "doc_id bigint, text string"), [(i, "a b") for i in (13,) if zlib.crc32(str(i).encode()) % 10 == 0] or [(None, "a b")])


def test_probabilities_add_up(spark):
    """Over the known words and one unknown word, the probabilities after one and after two words add up to 1."""
    docs = [(None, "a b a c"), (None, "b b a"), (None, "c"), (None, "a b a")]
    model = lm_trie.train(lm_trie.held_out(spark.createDataFrame(docs, "doc_id bigint, text string")))
    words = np.sort(np.array([lm_trie.hash_word(x) for x in (b"a", b"b", b"c", b" end", b"unknown")], np.uint64))
    number, count = lm_trie.Level1(model).find(words)
    p = model.base(count)
    assert math.isclose(p.sum(), 1) and model.tokens == 15 and model.words == 4
    level2, level3 = lm_trie.Level(model, 2), lm_trie.Level(model, 3)
    known = np.flatnonzero(number >= 0)
    pairs = 0
    for i in known[words[known] != np.uint64(lm_trie.END)]:
        q, back = np.full(5, np.nan), np.zeros(5)
        q[known], back[known] = level2.find(np.full(4, number[i], np.uint64), np.full(4, count[i]), number[known].astype(np.uint64))
        q = np.where(np.isnan(q), np.log10(lm_trie.MU * p / (count[i] + lm_trie.MU)), q)
        assert abs((10**q).sum() - 1) < 1e-3
        for j in known[back[known] < 0]:
            low, _ = level2.find(np.full(4, number[j], np.uint64), np.full(4, count[j]), number[known].astype(np.uint64))
            r = np.log10(lm_trie.MU * p / (count[j] + lm_trie.MU))
            r[known] = np.where(np.isnan(low), r[known], low)
            deep = np.full(5, np.nan)
            code = np.full(4, number[i] * model.size + number[j], np.uint64)
            deep[known], _ = level3.find(code, np.full(4, min(count[i], count[j])), number[known].astype(np.uint64))
            assert abs((10 ** np.where(np.isnan(deep), r + back[j], deep)).sum() - 1) < 1e-3 and not np.isnan(deep).all()
            pairs += 1
    assert pairs


def test_words_are_told_as_bytes_are_split():
    r = np.random.default_rng(4)
    texts = [None, b"", b"   ", b"A\x0bb\x00c\x1cd", "É é ".encode(), b"x" * (3 * tokens.PIECE + 5) + b" Y", *(bytes(r.choice(list(b"aB \n\x85\xc3."), 40).tolist()) for _ in range(300))]
    seen = {}
    for size in (1, 500, 1 << 20):
        for i, j, all_, starts in tokens.blocks(pa.array(texts, pa.binary()), size, 1, 2):
            for t, a, b in zip(texts[i:j], starts[:-1], starts[1:], strict=True):
                w = (t or b"").lower().split()
                assert all_[a] == 1 and all_[b - 1] == 2 and b - a == len(w) + 2
                assert all(seen.setdefault(x, h) == h == tokens.hash_word(x) for x, h in zip(w, all_[a + 1 : b - 1]))
    assert len(set(seen.values())) == len(seen)


def test_pages_read_like_the_file(tmp_path, monkeypatch):
    """On a file system that is not mounted, arrays are read by pages."""
    from pyarrow import fs as pafs

    from lagweave.llm import files

    v = np.sort(np.random.default_rng(6).integers(0, 1 << 50, 200_000, np.uint64))
    files.write_arrays(f"{tmp_path}/a", elias_fano.encode(v, 1 << 50), {})
    monkeypatch.setattr(files, "located", lambda uri: (pafs.SubTreeFileSystem("/", pafs.LocalFileSystem()), uri))
    monkeypatch.setattr(files, "KEPT", 2)
    arrays, _ = files.open_arrays(f"{tmp_path}/a")
    assert isinstance(arrays["low"], files.Paged)
    coded = elias_fano.EliasFano(arrays)
    assert (coded.get(np.arange(0, 200_000, 7)) == v[::7]).all() and coded.successor(v[:50])[1].all() and len(files._pages) <= 2


def test_places_of_bits_and_values():
    """Bits found in a word, and successors also where runs of ones are long or the value is beyond the last one."""
    import numpy as np

    from lagweave.llm import elias_fano as ef

    r = np.random.default_rng(2)
    words = np.concatenate([r.integers(0, 1 << 63, 200, dtype=np.uint64), np.array([1, 1 << 63, (1 << 64) - 1], np.uint64)])
    for w in words:
        places = [i for i in range(64) if int(w) >> i & 1]
        assert ef.select_in_word(np.full(len(places), w), np.arange(len(places))).tolist() == places
    for values in (np.sort(r.integers(0, 5000, 3000)), np.repeat([7, 4999], 700), np.arange(5000), np.array([3])):
        coded = ef.EliasFano(ef.encode(values.astype(np.uint64), 5000))
        for x in (np.arange(6000), np.array([0, 4999]), np.array([5900])):  # many places and few
            at, equal = coded.successor(x.astype(np.uint64))
            assert at.tolist() == np.searchsorted(values, x).tolist() and equal.tolist() == np.isin(x, values).tolist()
        assert coded.get(np.arange(len(values))).tolist() == values.tolist()
