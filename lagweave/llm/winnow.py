"""Benchmark decontamination by winnowed k-gram fingerprints.

A window is `span` consecutive words of an item (a shorter, non-empty item is one window). Both sides keep the
least k-gram hash of every run of `span - k + 1` k-grams, so any shared window shares a kept fingerprint with its
position. Kept fingerprints are joined, and each match is extended word by word to both sides; a match of at least
`span` words covers shared windows only, and every shared window is inside such a match. Items of n < span words
use k = n and keep every n-gram.

Null texts have no words. Documents without words, or an empty benchmark, give n_hit = 0. Items of equal words
are joined once and expanded to their ids at the end. Repeated rows each get their own, equal, result. Extra
columns are not carried; null item_ids are not listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, fresh, materialize, with_row_id

#: Words a shared window has, and words of a k-gram.
SPAN, K = 10, 5
#: log2 of the bits in the fingerprint filter: 2 MiB, whatever the size of the benchmark.
FILTER_BITS = 24
REMEMBER = 300_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)

FOUND = "array<struct<k:int,h:bigint,at:bigint,gram:string,before:array<string>,after:array<string>>>"
PART = pa.struct([("k", pa.int32()), ("h", pa.int64()), ("at", pa.int64()), ("gram", pa.string()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def split(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(ALNUM).split()


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of every k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g *= FACTOR
        g += h[j : n + j]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    return g ^ (g >> np.uint64(32))


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least hash of every w consecutive ones, the last of equals; of all if there are fewer."""
    if w == 1:
        return np.arange(len(g))
    if len(g) < w:
        g_ = g[None, ::-1]
        return len(g) - 1 - np.argmin(g_, 1) if len(g) else np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(g[::-1], w)
    at = np.argmin(views, 1) + np.arange(len(views))
    keep = np.ones(len(at), bool)
    keep[1:] = at[1:] != at[:-1]  # the place of the least moves one way only
    return (len(g) - 1 - at[keep])[::-1]


def described(words: list[bytes], at: int, k: int, g: int, span: int) -> dict:
    """A fingerprint with its words and the words beside it, nearest first, as far as a window can reach."""
    more = max(0, span - k) if k == min(K, span) else 0
    show = lambda ws: [w.decode() for w in ws]
    return {"k": k, "h": int(np.int64(np.uint64(g))), "at": int(at), "gram": b" ".join(words[at : at + k]).decode(), "before": show(words[max(0, at - more) : at][::-1]), "after": show(words[at + k : at + k + more])}


def classes(lengths: set[int], span: int) -> list[tuple[int, int]]:
    """(k, w) for each kind of item: long ones, and each short length there is."""
    k = min(K, span)
    return ([(k, span - k + 1)] if max(lengths, default=0) >= span else []) + [(n, 1) for n in sorted(lengths) if 0 < n < span]


def benchmark_prints(items: DataFrame, span: int) -> DataFrame:
    """words (of an item, blank-joined), n_words and its kept fingerprints."""

    def run(batches):
        known, k_long = Hashes(), min(K, span)
        for b in batches:
            rows = []
            for raw in b.column(0).to_pylist():
                ws = split(raw)
                k, w = (k_long, span - k_long + 1) if len(ws) >= span else (len(ws), 1)
                prints = []
                if ws:
                    g = grams(np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws)), k)
                    # A key of its own for short items, should their length be that of long items' k-grams.
                    kk = k if w > 1 else -k
                    prints = [described(ws, i, k, g[i], span) | {"k": kk} for i in winnow(g, w).tolist()]
                rows.append((b" ".join(ws).decode(), len(ws), prints))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(PART))], names=["words", "n_words", "prints"])

    return items.mapInArrow(run, f"words string, n_words int, prints {FOUND}")


def document_prints(docs: DataFrame, kinds: list[tuple[int, int]], bits: bytes, span: int) -> DataFrame:
    """doc_id, n_words and the kept fingerprints that pass the filter of the benchmark's fingerprints."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        known, have, mask = Hashes(), np.frombuffer(shared.value, np.uint8), np.uint64((1 << FILTER_BITS) - 1)
        for b in batches:
            ids, counts, found = b.column("doc_id"), [], []
            for raw in b.column("raw").to_pylist():
                ws = split(raw)
                prints = []
                if len(ws):
                    h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
                    for k, w in kinds:
                        g = grams(h, k)
                        at = winnow(g, w)
                        slot = g[at] & mask
                        at = at[(have[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                        prints += [described(ws, i, k, g[i], span) | {"k": k if w > 1 else -k} for i in at.tolist()]
                counts.append(len(ws))
                found.append(prints)
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(found, pa.list_(PART))], names=["doc_id", "n_words", "prints"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(run, f"doc_id {kind}, n_words bigint, prints {FOUND}")


def filter_bits(prints: DataFrame) -> bytes:
    """The hashes' low bits as a bitmap of fixed size, put together from one bitmap per partition."""

    def run(batches):
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for b in batches:
            slot = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
            np.bitwise_or.at(bits, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    parts = prints.select("h").distinct().coalesce(4).mapInArrow(run, "bits binary")
    total = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in parts.toLocalIterator():  # four bitmaps of fixed size at most
        total |= np.frombuffer(row.bits, np.uint8)
    return total.tobytes()


def same(a: str, b: str):
    """How many leading elements of two arrays are equal."""
    equal = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(equal, False)
    return F.when(first == 0, F.size(equal)).otherwise(first - 1).cast("long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """Per row of docs (doc_id, text): _row, doc_id, n_words, n_hit, items (sorted array of item_id strings)."""
    told = materialize(benchmark_prints(benchmark.select(F.col("text").cast("binary").alias("raw")).distinct(), span), "items").dropDuplicates(["words"]).where("n_words > 0")
    kinds = classes({r[0] for r in told.select(F.least("n_words", F.lit(span))).distinct().collect()}, span)
    item_prints = told.select("words", F.explode("prints").alias("p")).select("words", "p.*")
    scanned = materialize(with_row_id(document_prints(docs, kinds, filter_bits(item_prints), span), "_row"), "scan")
    d = scanned.select("_row", F.explode("prints").alias("d"))
    i = item_prints.select(F.col("k").alias("ik"), F.col("h").alias("ih"), F.col("gram").alias("igram"), F.col("before").alias("ib"), F.col("after").alias("ia"), "words")
    met = (
        d.join(i, (F.col("d.k") == F.col("ik")) & (F.col("d.h") == F.col("ih")) & (F.col("d.gram") == F.col("igram")))
        .select("_row", "words", F.col("d.at").alias("at"), F.abs("ik").cast("long").alias("k"), (F.col("ik") < 0).alias("short"), same("d.before", "ib").alias("left"), same("d.after", "ia").alias("right"))
        .where(F.col("short") | (F.col("left") + F.col("k") + F.col("right") >= span))
        .select("_row", "words", (F.col("at") - F.when(~F.col("short"), F.col("left")).otherwise(0)).alias("start"), (F.col("at") + F.col("k") + F.when(~F.col("short"), F.col("right")).otherwise(0)).alias("end"))
    )
    met = materialize(met, "met")
    before = F.max("end").over(Window.partitionBy("_row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    n_hit = met.select("_row", "start", "end").distinct().withColumn("before", F.coalesce(before, F.lit(0))).groupBy("_row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before"))).alias("n_hit"))
    named = materialize(named_items(benchmark), "named")
    items = met.select("_row", "words").distinct().join(named, "words").groupBy("_row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return (
        scanned.select("_row", "doc_id", "n_words")
        .join(n_hit.join(items, "_row", "left"), "_row", "left")
        .select("_row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )


def named_items(benchmark: DataFrame) -> DataFrame:
    """item_id as a string beside its blank-joined words."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b" ".join(split(x)).decode() for x in b.column(1).to_pylist()], pa.string())], names=["item_id", "words"])

    return benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string"), F.col("text").cast("binary").alias("raw")).mapInArrow(run, "item_id string, words string")


def digests(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """docs without rows that share a window with an item; rows of equal doc_id stand or fall together.

    Rows without a doc_id are judged by their text: the anti-join is null-safe on doc_id and on a text hash.
    """
    key = [F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))), F.coalesce(F.octet_length("text"), F.lit(0))]
    keyed = docs.select(F.struct(*(k.alias(n) for k, n in zip(key, ("id", "h", "n")))).alias("doc_id"), "text")
    i, h, n = fresh(docs, "__id", "__h", "__n")
    bad = decontaminate(keyed, benchmark, span).where("n_hit > 0").select(*(F.col(f"doc_id.{k}").alias(c) for k, c in zip(("id", "h", "n"), (i, h, n)))).distinct()
    return docs.join(bad, key[0].eqNullSafe(F.col(i)) & (key[1] == F.col(h)) & (key[2] == F.col(n)), "left_anti").select(docs.columns)
