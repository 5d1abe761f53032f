"""Near copies by exact Jaccard similarity of word shingles, for the pipeline's near-dedup stage.

Two texts are linked if their sets of five-word shingles have a similarity of SIMILAR or more. Candidates come as in
op4, from SimHash fingerprints that meet in buckets of bits and are told apart by their distances to references of the
bucket, with a reach that such pairs need: at 0.8 a bit of theirs agrees with a chance of AGREE, so that they lie about
10 of 64 bits apart, and no choice of blocks leaves all of them out. Fingerprints have WORDS words of 64 bits, and a
bucket is where a choice of a word's bits agrees; there are so many choices that a pair at 0.8 shares two buckets with a
chance of 0.9998 or more (`tables`), so pairs that meet in one small bucket alone, as unlike sets do, are not looked at. Majorities among few shingles are rough, so sets of up to TINY shingles also meet
where they share one of their first shingles in the order of hashes, which loses no pair at all.

Texts of equal sets meet first, so copies cost one row. In buckets of up to SMALL sets all pairs are looked at: those
further than CLOSE apart in another word of their fingerprints are discarded, and those that are left in one bucket only. In larger ones the distances of each
fingerprint to REFERENCES of the bucket's own (the same for all buckets of a dense group, mostly) make a table; near
references link most of a dense group as stars, in rows that grow with its size and not with its pairs. What is left
there are sets of different components: by the triangle inequality pairs whose distances to some reference differ by
more than REACH are discarded, the first of them as rings that never meet. So are pairs whose parity bitmaps differ in
too many places: a bit is the parity of the shingles hashed to it, so two bitmaps differ in at most as many bits as the
sets do in shingles. Every survivor is verified on the texts, so no link is wrong.

Fewer than five words make one shingle of all of them; texts without words are alike. A null doc_id takes part in
its component but never names it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, small_batches, with_row_id
from .components import components
from .tokens import mixed

SHINGLE, SEED, SIMILAR = 5, 42, 0.8
#: 64-bit words of a fingerprint, and sets up to which first shingles are keys too.
WORDS, TINY = 16, 30
#: The chance that a fingerprint's bit agrees at SIMILAR, by the angle between such sets.
AGREE = 1 - math.acos(2 * SIMILAR / (1 + SIMILAR)) / math.pi
#: Bits that fingerprints of similar sets differ in at most: of one word and of all (expected are 10 and 155).
CLOSE, REACH = 22, 256
SMALL, REFERENCES, SALTS = 32, 3, 64
#: 64-bit words of a parity bitmap.
PARITY = 8
#: A number per word of the fingerprint; the first word takes the shingles' hashes as they are.
TURNS = np.array([xxhash.xxh64_intdigest(b"word %d" % i, SEED) for i in range(1, WORDS)], np.uint64)


def shingles(raw: bytes | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; never empty."""
    words = (raw or b"").lower().split()
    h64 = xxhash.xxh64_intdigest
    n = max(1, len(words) - SHINGLE + 1)
    return np.unique(np.array([h64(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(n)], np.uint64))


def fingerprint(h: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes, in WORDS words: a bit is 1 if set in over half of them."""
    counts = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(h), 255):  # bounded memory for long texts, and counts that fit a byte
        part = h[i : i + 255, None]
        words = np.hstack([part, mixed(part ^ TURNS)]).astype("<u8")
        counts += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h), bitorder="little").view("<i8")


def tables(count: int) -> list[tuple[int, int, int]]:
    """(number, word, mask) of every choice of bits: more bits for more sets, so that buckets stay small, and as many
    choices as a pair at SIMILAR then needs to share 14 of them on average."""
    bits = max(8, count.bit_length() - 2)
    out = []
    for i in range(math.ceil(14 / AGREE**bits)):
        chosen = sorted(range(64), key=lambda b: xxhash.xxh64_intdigest(b"table %d %d" % (i, b), SEED))[:bits]  # noqa: B023
        mask = sum(1 << b for b in chosen)
        out.append((i, i % WORDS, mask - (1 << 64) if mask >> 63 else mask))
    return out


def first_shingles(h: np.ndarray) -> np.ndarray:
    """Of sorted hashes so many that similar sets share one of them; none of large sets."""
    n = len(h)
    return h[: n - math.ceil(SIMILAR * n - 1e-9) + 1].view(np.int64) if n <= TINY else h[:0].view(np.int64)


def parity(h: np.ndarray) -> np.ndarray:
    odd = np.bincount((h % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text, s (a print of the shingle set), n (its size), f (its fingerprint), few (its first shingles, where
    it is small) and bits (its parity bitmap)."""

    def run(batches):
        longs = pa.list_(pa.int64())
        for b in batches:
            sets = [shingles(x) for x in b.column("text").to_pylist()]
            s = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
            n = pa.array([len(h) for h in sets], pa.int64())
            f, few, bits = (pa.array([g(h) for h in sets], longs) for g in (fingerprint, first_shingles, parity))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(s, pa.int64()), n, f, few, bits], names=["doc_id", "text", "s", "n", "f", "few", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, text binary, s bigint, n bigint, f array<bigint>, few array<bigint>, bits array<bigint>")


def alike(x, y):
    """Whether sets of these sizes can be similar enough."""
    return F.least(x, y) >= F.greatest(x, y) * SIMILAR


def differ(x: str, y: str, words: int):
    """In how many bits two arrays of so many words differ."""
    return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(words)), F.lit(0))


def may_be_alike(x: str, y: str):
    """Whether fingerprints and bitmaps of rows x and y leave room: sets of similarity SIMILAR differ in so many shingles
    at most."""
    room = (F.col(f"{x}.n") + F.col(f"{y}.n")) * ((1 - SIMILAR) / (1 + SIMILAR)) + 1e-9
    return (differ(f"{x}.f", f"{y}.f", WORDS) <= REACH) & (differ(f"{x}.bits", f"{y}.bits", PARITY) <= room)


def measured(pairs: DataFrame) -> DataFrame:
    """(a, b, j) of the pairs (a, b, ta, tb): the similarity of their texts."""

    def run(batches):
        last, t = None, None
        for batch in batches:
            j = []
            for b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("b", "ta", "tb"))):
                if b != last:
                    last, t = b, shingles(tb)
                h = shingles(ta)
                both = len(np.intersect1d(h, t, assume_unique=True))
                j.append(both / (len(h) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(j, pa.float64())], names=["a", "b", "j"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, j double")


def texts_of(texts: DataFrame, end: str) -> DataFrame:
    return texts.select(F.col("_row").alias(f"r{end}"), F.col("text").alias(f"t{end}"))


def keyed(sets: DataFrame, count: int) -> DataFrame:
    """Rows (key, s, n, g): the buckets of every set, with another word of its fingerprint (null for first shingles)."""
    choices = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(w).alias("w"), F.lit(m).alias("m")) for i, w, m in tables(count)))
    spread = sets.select("s", "n", "f", F.explode(choices).alias("t"))
    by_bits = spread.select(F.xxhash64("t.i", F.get("f", F.col("t.w")).bitwiseAND(F.col("t.m"))).alias("key"), "s", "n", F.get("f", (F.col("t.w") + WORDS // 2) % WORDS).alias("g"))
    by_first = sets.select("s", "n", F.explode("few").alias("h")).select(F.xxhash64(F.lit(-1), "h").alias("key"), "s", "n", F.lit(None).cast("long").alias("g"))
    return by_bits.union(by_first)


def links(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Similar pairs (a, b) of sets (s, _row, n, f, few, bits), s being unique; texts: (_row, text)."""
    size = F.count("*").over(Window.partitionBy("key"))
    rows = keyed(sets, sets.count()).withColumn("size", size).where("size > 1")
    few = rows.where(F.col("size") <= SMALL)
    x, y = few.alias("x"), few.alias("y")
    close = F.coalesce(F.bit_count(F.col("x.g").bitwiseXOR(F.col("y.g"))) <= CLOSE, F.lit(True))
    near = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.s") > F.col("y.s")) & alike(F.col("x.n"), F.col("y.n")) & close)
    # Pairs of small buckets and rows of large ones come from one shuffle, as they take the same columns of it.
    none = F.lit(None).cast("long")
    pairs = near.select(none.alias("key"), F.col("x.s").alias("a"), F.col("y.s").alias("b"), F.col("x.n").alias("n"), F.col("x.g").alias("g"))
    met = materialize(pairs.union(rows.where(F.col("size") > SMALL).select("key", F.col("s").alias("a"), none.alias("b"), "n", "g")), "met")
    # Two small buckets, or one first shingle (whose g is null); what meets in a large bucket needs no other.
    twice = met.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("all"), F.count("g").alias("by_bits")).where("all > 1 or by_bits = 0")
    found = similar_pairs(twice.select("a", "b"), sets, texts)
    large = pivoted(met.where("b is null").select("key", F.col("a").alias("s"), "n"), sets)
    stars = similar_pairs(large.where((F.col("d0") <= REACH) & (F.col("s") != F.col("r"))).select(F.col("s").alias("a"), F.col("r").alias("b")), sets, texts)
    linked = materialize(components(found.union(stars)), "linked")
    return materialize(found.union(stars).union(similar_pairs(left_over(large, linked), sets, texts)), "links")


def pivoted(crowded: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (key, s, n, f, bits, r, d0, d1, ...) of large buckets: distances to the bucket's references, and the first of
    these."""
    rows = materialize(crowded.join(sets.select("s", "f", "bits"), "s"), "crowded")
    # The same order in every bucket, so that a dense group has the same references in most of its buckets.
    least = [F.min(F.struct(F.xxhash64(F.lit(i), "s").alias("o"), "s", "f")).alias(f"r{i}") for i in range(REFERENCES)]
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    references = rows.groupBy("key").agg(*least).select("*", spread)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("s"), F.lit(SALTS)).cast("int"))
    table = [differ("f", f"r{i}.f", WORDS).alias(f"d{i}") for i in range(REFERENCES)]
    return materialize(salted.join(references, ["key", "salt"]).select("key", salted["s"], "n", salted["f"], "bits", F.col("r0.s").alias("r"), *table), "pivoted")


def similar_pairs(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The distinct similar ones of pairs (a, b). Texts, found by _row, join what is left to verify."""
    told = sets.select("s", "_row", "n", "f", "bits")
    pairs = pairs.distinct().join(told.alias("x"), F.col("a") == F.col("x.s")).join(told.alias("y"), F.col("b") == F.col("y.s"))
    pairs = materialize(pairs.where(may_be_alike("x", "y")).select("a", "b", F.col("x._row").alias("ra"), F.col("y._row").alias("rb")), "pairs")
    both = pairs.join(texts_of(texts, "a"), "ra").join(texts_of(texts, "b"), "rb")
    with small_batches(pairs.sparkSession):
        return materialize(measured(both).where(F.col("j") >= SIMILAR).select("a", "b"), "similar")


def left_over(large: DataFrame, linked: DataFrame) -> DataFrame:
    """Pairs (a, b) of one large bucket and different components that neither references nor bitmaps tell apart."""
    rows = materialize(large.join(linked, F.col("s") == F.col("node"), "left").withColumn("c", F.coalesce("component", "s")).drop("node", "component"), "labelled")
    sizes = rows.groupBy("key", "c").count()
    mixed_ones = sizes.groupBy("key").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key", "main")
    cell = F.floor(F.col("d0") / REACH)
    rows = rows.join(mixed_ones, "key")
    x = rows.where("c != main").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    y = rows.withColumn("cell", cell)
    on = (F.col("x.c") != F.col("y.c")) & alike(F.col("x.n"), F.col("y.n"))
    for i in range(REFERENCES):
        on = on & (F.abs(F.col(f"x.d{i}") - F.col(f"y.d{i}")) <= REACH)
    for k in ("key", "cell"):
        on = on & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    on = on & may_be_alike("x", "y")
    met = x.alias("x").join(y.alias("y"), on)
    return met.select(F.greatest("x.s", "y.s").alias("a"), F.least("x.s", "y.s").alias("b"))


def firsts(docs: DataFrame) -> DataFrame:
    """first: the least doc_id of each component of docs (doc_id, text) that has one."""
    with small_batches(docs.sparkSession):
        scanned = materialize(with_row_id(sketches(docs), "_row"), "sketches")
    nodes = materialize(scanned.groupBy("s").agg(F.min("doc_id").alias("first"), F.min("_row").alias("_row")), "nodes")
    sets = materialize(scanned.select("_row", "s", "n", "f", "few", "bits").join(nodes.select("_row"), "_row"), "sets")
    linked = components(links(sets, scanned.select("_row", "text")))
    named = nodes.join(linked, F.col("s") == F.col("node"), "left").select("first", F.coalesce("component", "s").alias("c"))
    return named.groupBy("c").agg(F.min("first").alias("first")).where("first is not null").select("first")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near copies: one row of each component stays, the least by doc_id and then by a hash of the text.

    Rows are told by doc_id and text, so different texts under one doc_id are judged apart, and of equal rows one
    stays. Rows without doc_id stay.
    """
    text = F.coalesce("text", F.lit(""))
    h, n = fresh(docs, "__h", "__n")
    parts = {"id": F.col("doc_id"), h: F.xxhash64(text), n: F.octet_length(text)}
    named = docs.where("doc_id is not null")
    # A null key takes part in a component but never names it.
    key = F.when(F.col("doc_id").isNotNull(), F.struct(*(c.alias(k) for k, c in parts.items())))
    kept = firsts(docs.select(key.alias("doc_id"), "text")).select(F.col("first.id").alias("doc_id"), f"first.{h}", f"first.{n}")
    marked = named.withColumns({k: parts[k] for k in (h, n)})
    one = marked.join(kept, ["doc_id", h, n], "left_semi").dropDuplicates(["doc_id", h, n])
    return one.select(docs.columns).union(docs.where("doc_id is null"))
