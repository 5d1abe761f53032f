"""Language-model scores from an n-gram trie in Elias-Fano code.

Level 1 holds the training words in order of their 64-bit hashes, with counts; a word's place is its number. Levels 2
and 3 hold, for each context (a word, or two), its successors: contexts as a monotone sequence, monotone pointers to
where each context's successors begin, and the successors as numbers relative to their context, made one monotone
sequence by adding the last value of the context before. A query finds its context, reads the two pointers and that
last value, and searches the successor between the pointers. Each successor has a quantised smoothed log10
probability; level 2 also has a quantised weight for backing off from its pair. Levels are files, cut into shards,
that scoring maps into memory; on a file system that cannot be mapped, pages are read as they are needed and a
bounded number is kept.

p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)); p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU); p(w | u v) = (k(u v w) +
MU p(w | v)) / (k(u v) + MU), where k counts the triples that occur `cutoff` times or more, and k(u v) is their sum, so
every distribution adds up to 1. All triples are counted; those below the cut-off are not stored. A text starts in a
context of its own and closes with an end token.

A context's successors are spread over shards by as many bits of their numbers as its words' counts ask for, so a word
that a third of all texts have is no larger task than others. Null and empty texts score their end token alone. An
empty training set gives every token the base probability. Repeated rows count each and score alike. Extra columns
are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import materialize, new_path
from .elias_fano import EliasFano, U, encode
from .files import make_dir, open_arrays, remove, write_arrays
from .tokens import hash_word

MU, BASE, ORDER, CUTOFF = 8.0, 0.1, 3, 2
#: Text bytes counted or scored at once, text bytes per shard, and a quantisation step's log10.
BLOCK_BYTES, SHARD_BYTES, STEP = 4 << 20, 16 << 20, -12 / 65535
#: Occurrences of a context that one shard takes; beyond, it is split.
SPLIT = 1 << 17
#: Hashes of the start context and the end token: blanks are in no word.
START, END = hash_word(b" start"), hash_word(b" end")


@dataclass(frozen=True)
class Model:
    """Where the levels are, and the totals; small, so it goes to tasks by itself."""

    folder: str
    shards: int
    order: int
    first: tuple[int, ...] = ()  # the number of each level 1 shard's first word
    have: tuple[frozenset, ...] = ()  # which shards there are of levels 2, 3
    tokens: int = 0
    words: int = 0
    block_bytes: int = BLOCK_BYTES
    split: int = SPLIT
    cutoff: int = CUTOFF

    @property
    def size(self) -> int:
        """Words and the start context."""
        return self.first[-1]

    def base(self, count):
        return (count + BASE) / (self.tokens + BASE * (self.words + 1))


def counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts (or sums of n)."""
    order = np.argsort(keys) if n is not None else None
    s = keys[order] if n is not None else np.sort(keys)
    first = runs(s)
    if n is None:
        return s[first], np.diff(np.append(first, len(s)))
    return s[first], np.add.reduceat(n[order], first) if len(first) else n


def runs(s: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)


def sliced(at: np.ndarray, n: int):
    """(i, slice) of every value i < n in the sorted array at."""
    cuts = np.searchsorted(at, np.arange(n + 1))
    return ((i, slice(a, b)) for i, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if b > a)


# -- shards --------------------------------------------------------------------------------------------------
def word_shard(h: np.ndarray, shards: int) -> np.ndarray:
    """In order of hash, for level 1."""
    return ((h >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def gram_shard(context: np.ndarray, count: np.ndarray, w: np.ndarray, model: Model) -> np.ndarray:
    """count bounds how often the context occurs."""
    split = np.frexp((count // model.split).astype(float))[1].astype(U)
    x = tokens.mixed(context + U(0x9E3779B97F4A7C15) * (tokens.mixed(w) & ((U(1) << split) - U(1))))
    return ((x >> U(32)) * U(model.shards) >> U(32)).astype(np.int64)


# -- packing for the shuffle ---------------------------------------------------------------------------------
def planes(a: np.ndarray, size: int) -> bytes:
    """size bytes of each value, all first bytes first: sorted numbers and small counts then compress well."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def unplanes(raw: bytes, n: int, size: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
    return out.view("<u8").ravel()


def width(top: int) -> int:
    return max(1, -(-int(top).bit_length() // 8))


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of unsigned numbers, each as wide as its largest needs."""
    head = [len(columns)]
    for c in columns:
        head += [len(c), width(c.max()) if len(c) else 1]
    return np.array(head, "<u8").tobytes() + b"".join(planes(c, s) for c, s in zip(columns, head[2::2]))


def unpack(raw: bytes, first: int | None = None) -> list[np.ndarray]:
    """All columns, or the first ones."""
    k = int(np.frombuffer(raw, "<u8", 1)[0])
    head = np.frombuffer(raw, "<u8", 2 * k, 8).tolist()
    at, out = 8 + 16 * k, []
    for n, size in list(zip(head[::2], head[1::2]))[:first]:
        out.append(unplanes(raw, n, size, at))
        at += n * size
    return out


def pack_grams(context: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """context and w sorted together; runs of equal contexts once."""
    first = runs(context)
    return pack([context[first], np.diff(np.append(first, len(context))), w, n])


def merged_grams(raws: list[bytes], size: int):
    """Distinct (context, w) in order and sums of n, of packed tables; size: more than any w."""
    context = np.unique(np.concatenate([unpack(r, 1)[0] for r in raws]))
    keys, times = [], []
    for r in raws:
        before, length, w, n = unpack(r)
        keys.append(np.repeat(np.searchsorted(context, before).astype(U), length.astype(np.int64)) * U(size) + w)
        times.append(n.astype(np.uint32))
    keys = np.concatenate(keys)
    key, n = counted(keys, np.concatenate(times).astype(np.int64))
    return context[(key // U(size)).astype(np.int64)], key % U(size), n


# -- levels --------------------------------------------------------------------------------------------------
class Level1:
    """Numbers and counts of words by hash; -1 and 0 for unknown ones."""

    def __init__(self, model: Model):
        self.model, self.open = model, {}

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """h: sorted hashes."""
        number, count = np.full(len(h), -1), np.zeros(len(h), np.int64)
        for s, part in sliced(word_shard(h, self.model.shards), self.model.shards):
            if self.model.first[s] == self.model.first[s + 1]:
                continue
            if s not in self.open:
                arrays, _ = open_arrays(f"{self.model.folder}/1-{s}")
                self.open[s] = EliasFano(arrays), arrays["count"]
            coded, counts = self.open[s]
            i, equal = coded.successor(h[part])
            at = np.arange(part.start, part.stop)[equal]
            number[at], count[at] = self.model.first[s] + i[equal], counts[i[equal]]
        return number, count


def coded_grams(context: np.ndarray, w: np.ndarray, log_p: np.ndarray, top: int) -> dict[str, np.ndarray]:
    """A level's arrays from sorted (context, w); top: more than any context."""
    first = runs(context)
    w = w + U(1)  # so that a context's first value is above the last one before it
    last = np.cumsum(w[np.append(first[1:], len(w)) - 1], dtype=U)  # each context's last value, added up
    base = np.concatenate([np.zeros(1, U), last])[:-1]
    follow = w + np.repeat(base, np.diff(np.append(first, len(w))))
    parts = {"context": encode(context[first], top), "pointer": encode(np.append(first, len(w)).astype(U), len(w) + 1), "next": encode(follow, int(follow[-1]) + 1)}
    return {f"{name}_{k}": a for name, arrays in parts.items() for k, a in arrays.items()} | {"p": quantised(log_p)}


def quantised(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x / STEP), 0, 65535).astype("<u2")


class Level:
    """Level 2 or 3: successors of contexts."""

    def __init__(self, model: Model, order: int):
        self.model, self.order, self.open = model, order, {}

    def shard(self, s: int) -> dict:
        if s not in self.open:
            self.open.clear()  # queries go from shard to shard in order, so one is mapped at a time
            arrays, _ = open_arrays(f"{self.model.folder}/{self.order}-{s}")
            part = lambda name: EliasFano({k.split("_", 1)[1]: x for k, x in arrays.items() if k.startswith(name + "_")})
            self.open[s] = {k: part(k) for k in ("context", "pointer", "next")} | {"p": arrays["p"]}
            if self.order == 2 and self.model.order > 2 and s in self.model.have[2]:
                self.open[s]["back"] = open_arrays(f"{self.model.folder}/back-{s}")[0]["back"]
        return self.open[s]

    def places(self, s: int, context: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in shard s, and whether (context, w) is there; sorted by context."""
        part, first = self.shard(s), runs(context)
        rank, known = part["context"].successor(context[first])
        rank = np.where(known, rank, 0)
        begin, end = part["pointer"].get(rank).astype(np.int64), part["pointer"].get(rank + 1).astype(np.int64)
        base = np.where(begin > 0, part["next"].get(np.maximum(begin - 1, 0)), U(0))
        n = np.diff(np.append(first, len(context)))
        at, equal = part["next"].successor(np.repeat(base, n) + w + U(1))
        return at, equal & np.repeat(known, n) & (at >= np.repeat(begin, n)) & (at < np.repeat(end, n))

    def find(self, context: np.ndarray, count: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 p of w after each context, NaN if it was not stored, and (of level 2) the pair's weight for backing off."""
        log_p, back = np.full(len(w), np.nan), np.zeros(len(w))
        s = gram_shard(context, count, w, self.model)
        order = np.argsort(s, kind="stable")  # contexts stay sorted
        for shard, part in sliced(s[order], self.model.shards):
            if shard in self.model.have[self.order - 2]:
                rows = order[part]
                at, hit = self.places(shard, context[rows], w[rows])
                log_p[rows[hit]] = self.shard(shard)["p"][at[hit]] * STEP
                if "back" in self.shard(shard):
                    back[rows[hit]] = self.shard(shard)["back"][at[hit]] * STEP
        return log_p, back


# -- training ------------------------------------------------------------------------------------------------
def count_words(batches, shards: int, block_bytes: int):
    """Rows (shard, packed): a block's words and their counts."""
    for b in batches:
        for _, _, all_, _ in tokens.blocks(b.column(0), block_bytes, START, END):
            h, n = counted(all_)
            rows = [(s, pack([h[p], n[p]])) for s, p in sliced(word_shard(h, shards), shards)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "packed"])


def write_words(folder: str):
    def run(key, table):
        shard = key[0].as_py()
        h, n = map(np.concatenate, zip(*(unpack(x.as_py()) for x in table.column("packed"))))
        h, n = counted(h, n.astype(np.int64))
        write_arrays(f"{folder}/1-{shard}", encode(h, 1 << 64) | {"count": n.astype("<i8")}, {})
        real = h != U(START)
        return pa.table({"shard": pa.array([shard], pa.int32()), "rows": [len(h)], "words": [int(real.sum())], "tokens": [int(n[real].sum())]})

    return run


class Block:
    """A block's words by number and count, its tokens by pair, and the triples' ends and pairs before."""

    def __init__(self, all_: np.ndarray, starts: np.ndarray, level1: Level1):
        self.hash, self.word = np.unique(all_, return_inverse=True)
        self.number, self.count = level1.find(self.hash)
        self.n, token, third = len(self.hash), np.ones(len(all_), bool), np.ones(len(all_), bool)
        token[starts[:-1]] = third[starts[:-1]] = third[starts[:-1] + 1] = False
        at = np.flatnonzero(token)
        self.last = self.word[at]  # of every token
        self.code, self.pair, self.times = np.unique(self.word[at - 1] * self.n + self.last, return_inverse=True, return_counts=True)
        self.third = np.flatnonzero(third[at])  # tokens with two before them
        self.ahead = self.pair[self.third - 1]


def count_grams(batches, model: Model):
    """Rows (level, shard, packed): a block's pairs and triples with their counts."""
    level1, size = Level1(model), U(model.size)
    for b in batches:
        for _, _, all_, starts in tokens.blocks(b.column(0), model.block_bytes, START, END):
            x, rows = Block(all_, starts, level1), []
            u, v = x.code // x.n, x.code % x.n
            grams = [(2, u, v, x.times)]
            if model.order > 2:
                code, n = counted(x.ahead * x.n + x.last[x.third])
                grams.append((3, code // x.n, code % x.n, n))
            for level, before, w, n in grams:
                if level == 2:
                    context, bound = x.number[before].astype(U), x.count[before]
                else:
                    u2, v2 = u[before], v[before]
                    context, bound = x.number[u2].astype(U) * size + x.number[v2].astype(U), np.minimum(x.count[u2], x.count[v2])
                w = x.number[w].astype(U)
                s = gram_shard(context, bound, w, model)
                order = np.argsort(s, kind="stable")  # words of a block are numbered in order of hash, so all is sorted within
                context, w, n = context[order], w[order], n[order]
                rows += [(level, i, pack_grams(context[p], w[p], n[p])) for i, p in sliced(s[order], model.shards)]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["level", "shard", "packed"])


def write_grams(model: Model):
    """Level 2 shards are written ready; of level 3, sorted counts, and for level 2 shards the pairs' sums."""

    def run(key, table):
        level, shard = (x.as_py() for x in key)
        context, w, n = merged_grams([x.as_py() for x in table.column("packed")], model.size)
        rows = [(level, shard, None)]
        if level == 2:
            level1 = Numbers(model)
            first = runs(context)
            starts = np.repeat(level1.counts(context[first]), np.diff(np.append(first, len(context))))
            log_p = np.log10((n + MU * model.base(level1.counts(w))) / (starts + MU))
            write_arrays(f"{model.folder}/2-{shard}", coded_grams(context, w, log_p, model.size), {})
        else:
            kept = n >= model.cutoff
            context, w, n = context[kept], w[kept], n[kept]
            if not len(n):
                return pa.table({"level": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "packed": pa.array([], pa.binary())})
            write_arrays(f"{model.folder}/counts-{shard}", {"packed": np.frombuffer(pack_grams(context, w, n), np.uint8)}, {})
            first = runs(context)
            u, v, sums = context[first] // U(model.size), context[first] % U(model.size), np.add.reduceat(n, first)
            to = gram_shard(u, Numbers(model).counts(u), v, model)
            order = np.argsort(to, kind="stable")
            u, v, sums = u[order], v[order], sums[order]
            rows += [(2, i, pack_grams(u[p], v[p], sums[p])) for i, p in sliced(to[order], model.shards)]
        cols = list(zip(*rows))
        return pa.table({"level": pa.array(cols[0], pa.int32()), "shard": pa.array(cols[1], pa.int32()), "packed": pa.array(cols[2], pa.binary())})

    return run


class Numbers:
    """Counts of words by their numbers."""

    def __init__(self, model: Model):
        self.model, self.open = model, {}

    def counts(self, number: np.ndarray) -> np.ndarray:
        number = number.astype(np.int64)
        distinct, back = np.unique(number, return_inverse=True)
        out, first = np.zeros(len(distinct), np.int64), np.array(self.model.first)
        for s, part in sliced(np.searchsorted(first, distinct, "right") - 1, self.model.shards):
            if s not in self.open:
                self.open[s] = open_arrays(f"{self.model.folder}/1-{s}")[0]["count"]
            out[part] = self.open[s][distinct[part] - self.model.first[s]]
        return out[back]


def write_back(model: Model):
    """Weights for backing off from the pairs of a level 2 shard, from the sums of their stored triples."""

    def run(key, table):
        shard = key[0].as_py()
        u, v, sums = merged_grams([x.as_py() for x in table.column("packed")], model.size)
        level2 = Level(replace(model, order=2), 2)
        at, hit = level2.places(shard, u, v)
        back = np.zeros(len(level2.shard(shard)["p"]), "<u2")
        back[at[hit]] = quantised(np.log10(MU / (sums[hit] + MU)))
        write_arrays(f"{model.folder}/back-{shard}", {"back": back}, {})
        return pa.table({"shard": pa.array([shard], pa.int32())})

    return run


def write_triples(model: Model):
    """Turns a level 3 shard's counts into its coded form with smoothed probabilities."""

    def run(batches):
        level2, numbers = Level(model, 2), Numbers(model)
        for b in batches:
            for shard in b.column("shard").to_pylist():
                got, _ = open_arrays(f"{model.folder}/counts-{shard}")
                context, w, n = merged_grams([got["packed"][np.arange(len(got["packed"]))].tobytes()], model.size)
                u, v = context // U(model.size), context % U(model.size)
                first = runs(context)
                _, back = level2.find(u[first], numbers.counts(u[first]), v[first])
                back = np.repeat(back, np.diff(np.append(first, len(context))))
                code, inverse = np.unique(v * U(model.size) + w, return_inverse=True)
                low, _ = level2.find(code // U(model.size), numbers.counts(code // U(model.size)), code % U(model.size))
                # back is log10 of MU / (k(u v) + MU)
                log_p = np.log10(n / MU + 10 ** low[inverse]) + back
                size = write_arrays(f"{model.folder}/3-{shard}", coded_grams(context, w, log_p, model.size**2), {})
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([size], pa.int64())], names=["shard", "bytes"])

    return run


def train(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES, split: int = SPLIT, cutoff: int = CUTOFF) -> Model:
    """Counts the texts of docs and writes the trie to the shared folder. order: 2 or 3; cutoff: the least count of the
    triples that are stored, 1 for all of them."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(12, -(-size // SHARD_BYTES))
    folder = new_path(spark, "trie")
    make_dir(folder)
    raw = docs.select(F.col("text").cast("binary").alias("raw"))
    words = raw.mapInArrow(lambda b: count_words(b, shards, block_bytes), "shard int, packed binary").groupBy("shard").applyInArrow(write_words(folder), "shard int, rows long, words long, tokens long").collect()  # a row per shard
    held = {r["shard"]: r["rows"] for r in words}
    first = tuple(np.cumsum([0, *(held.get(s, 0) for s in range(shards))]).tolist())
    model = Model(folder, shards, order, first, (), sum(r["tokens"] for r in words), sum(r["words"] for r in words), block_bytes, split, cutoff)
    if model.size >= 1 << 32:
        raise ValueError("more than 2 ** 32 words: pairs no longer fit 64 bits")
    counts = raw.mapInArrow(lambda b: count_grams(b, model), "level int, shard int, packed binary")
    done = materialize(counts.groupBy("level", "shard").applyInArrow(write_grams(model), "level int, shard int, packed binary"), "grams")
    shards_of = lambda level, df: frozenset(r["shard"] for r in df.where(F.col("level") == level).select("shard").distinct().collect())
    have = [shards_of(level, done.where("packed is null")) for level in (2, 3)]
    if order > 2:
        sums = done.where("packed is not null").groupBy("shard").applyInArrow(write_back(replace(model, have=(have[0], have[1], frozenset()))), "shard int").collect()  # a row per shard
        model = replace(model, have=(have[0], have[1], frozenset(r["shard"] for r in sums)))
        todo = spark.createDataFrame([(s,) for s in sorted(have[1])], "shard int").repartition(max(1, len(have[1])))
        todo.mapInArrow(write_triples(model), "shard int, bytes long").collect()
        for s in have[1]:
            remove(f"{folder}/counts-{s}")
    return replace(model, have=(have[0], have[1], model.have[2] if order > 2 else frozenset()))


# -- scoring -------------------------------------------------------------------------------------------------
def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs needs doc_id, text and held_out; gives doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""

    def run(batches):
        level1, level2, level3, size = Level1(model), Level(model, 2), Level(model, 3), U(model.size)
        for b in batches:
            for i, j, all_, starts in tokens.blocks(b.column("raw"), model.block_bytes, START, END):
                x = Block(all_, starts, level1)
                base = np.log10(model.base(np.where(x.hash == U(START), 0, x.count)))
                v, w = x.code // x.n, x.code % x.n
                log_p, back = np.full(len(v), np.nan), np.zeros(len(v))
                seen = np.flatnonzero((x.number[v] >= 0) & (x.number[w] >= 0))
                log_p[seen], back[seen] = level2.find(x.number[v[seen]].astype(U), x.count[v[seen]], x.number[w[seen]].astype(U))
                new = np.isnan(log_p)
                log_p[new] = np.log10(MU / (x.count[v[new]] + MU)) + base[w[new]]
                each = log_p[x.pair]
                if model.order > 2:
                    third, ahead = x.third[keep := back[x.ahead] < 0], x.ahead[keep]
                    triple, inverse = np.unique(ahead * x.n + x.last[third], return_inverse=True)
                    z, u2, v2 = triple % x.n, v[triple // x.n], w[triple // x.n]
                    deep, known = np.full(len(triple), np.nan), x.number[z] >= 0
                    deep[known], _ = level3.find((x.number[u2].astype(U) * size + x.number[v2].astype(U))[known], np.minimum(x.count[u2], x.count[v2])[known], x.number[z[known]].astype(U))
                    deep = deep[inverse]
                    each[third] = np.where(np.isnan(deep), back[ahead] + each[third], deep)
                n = np.diff(starts) - 1
                total = lambda y, s=starts[:-1] - np.arange(j - i): np.add.reduceat(y, s)
                after, rows = x.last, b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("held_out"), pa.array(n, pa.int64()), pa.array(total((x.count[after] > 0).astype(np.int64)), pa.int64()), pa.array(np.full(len(n), model.tokens), pa.int64()), pa.array(total(base[after])), pa.array(total(each))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", F.col("text").cast("binary").alias("raw")).mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(docs: DataFrame) -> DataFrame:
    """docs with held_out: whether crc32 of doc_id as text leaves 0 by 10; a null doc_id trains."""
    return docs.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False)).alias("held_out"))


def train_and_score(docs: DataFrame, order: int = ORDER, **limits) -> DataFrame:
    marked = held_out(docs)
    return score(marked, train(marked.where(~F.col("held_out")), order, **limits))
