"""SimHash near-duplicates linked through pivot distance tables.

Equal fingerprints meet first, so copies cost one row. Distances to reference fingerprints then work both ways:

* near references: every fingerprint and its 64 one-bit neighbours are references. Two fingerprints whose
  distances to one reference add up to 3 or less are linked by the triangle inequality without a look at the pair,
  as a star around the reference, so a dense group costs a number of rows in proportion to its size. This finds
  every link of distance 1 or 2.
* bucket references: what is left are links of distance 3, between fingerprints of odd and even bit counts.
  Fingerprints meet where whole blocks agree (three differing bits leave all but three of the blocks untouched).
  Every such bucket has PIVOTS references among its own fingerprints, so distances to them spread as the bucket
  does. Linked fingerprints differ by 1 or 3 in each coordinate: the first is a key of the join, so rings around the
  reference that are too far apart never meet; the others discard pairs by the largest difference, and survivors are
  verified. Buckets of more than HOT rows are split by blocks of their other bits, which loses no link. Pairs that
  the stars have already joined are left out, so dense groups are not spelled out here either.

Fewer than three words make one shingle of all of them; no words (or null text) give fingerprint zero, which is
linked like any other. Repeated rows get equal results; a null doc_id takes part in its component but never names it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, with_row_id
from .components import components

SHINGLE, SEED, REACH, PIVOTS = 3, 42, 3, 8
#: Rows of a bucket beyond which it is split, and into how many blocks its other bits then fall.
HOT, FINER = 2000, 6


def fingerprint(raw: bytes | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of lower-cased, white-space separated words."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    n = max(1, len(words) - size + 1)
    if len(words) < size:
        h = [h64(b" ".join(words), SEED)]
    else:
        h = [h64(b" ".join(words[i : i + size]), SEED) for i in range(n)]
    counts = np.zeros(64, np.int64)
    h = np.array(h, "<u8")
    for i in range(0, n, 1 << 16):  # bounded memory for long texts
        counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and f, the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            f = np.array([fingerprint(x) for x in b.column("raw").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(f, pa.int64())], names=["doc_id", "f"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(run, f"doc_id {kind}, f bigint")


def near_links(prints: DataFrame) -> DataFrame:
    """Links of distance 1 and 2: fingerprints at distance 0 or 1 of one reference, linked to the least of them."""
    table = prints.select("f", F.explode(F.array(F.col("f"), *(F.col("f").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))).alias("ref"))
    least = table.groupBy("ref").agg(F.min("f").alias("m"), F.max("f").alias("most")).where("m != most").select("ref", "m")
    return table.join(least, "ref").where("f != m").select(F.col("f").alias("a"), F.col("m").alias("b")).distinct()


def blocks(n: int) -> list[tuple[int, int]]:
    """(first bit, bits) of n blocks that make up 64 bits."""
    cuts = [round(i * 64 / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def key_masks(count: int) -> list[int]:
    """Masks of every choice of all but REACH blocks; more blocks for more fingerprints, so that keys stay rare."""
    n = next(n for n in range(REACH + 2, 13) if n == 12 or min(sum(w for _, w in c) for c in combinations(blocks(n), n - REACH)) >= max(20, count.bit_length() + 2))
    return [sum(((1 << w) - 1) << a for a, w in c) for c in combinations(blocks(n), n - REACH)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def finer(mask: int) -> list[int]:
    """mask with all but REACH of FINER groups of its other bits; of three differing bits, one of these has none."""
    free = [b for b in range(64) if not mask >> b & 1]
    groups = [sum(1 << b for b in free[i::FINER]) for i in range(FINER)]
    return [mask | sum(c) for c in combinations(groups, FINER - REACH)]


def masked(masks: list[int]):
    return F.array(*(F.col("f").bitwiseAND(F.lit(signed(m))) for m in masks))


def pivoted(labelled: DataFrame, count: int) -> DataFrame:
    """Rows (k, j, v, f, star, is_main, d0, d1, ...): fingerprints by bucket, with distances to its references."""
    masks = key_masks(count)
    keys = labelled.select("f", "star", F.posexplode(masked(masks)).alias("k", "v"))
    # The references: the least fingerprints in PIVOTS orders, each of f with some of its bits turned.
    turns = [F.lit(signed(xxhash.xxh64_intdigest(b"order %d" % i, SEED))) for i in range(PIVOTS)]
    least = [F.min(F.col("f").bitwiseXOR(t)).alias(f"r{i}") for i, t in enumerate(turns)]
    by_star = keys.groupBy("k", "v", "star").agg(F.count("*").alias("n"), *least)
    merged = [F.min(f"r{i}").bitwiseXOR(t).alias(f"r{i}") for i, t in enumerate(turns)]
    found = by_star.groupBy("k", "v").agg(F.sum("n").alias("n"), F.max_by("star", F.struct("n", "star")).alias("main"), F.min("star").alias("lo"), F.max("star").alias("hi"), *merged)
    mixed = materialize(found.where("lo != hi").drop("lo", "hi"), "mixed")
    table = [F.bit_count(F.col("f").bitwiseXOR(F.col(f"r{i}"))).cast("byte").alias(f"d{i}") for i in range(PIVOTS)]
    rows = keys.join(mixed, ["k", "v"]).select("k", "v", "n", "f", "star", (F.col("star") == F.col("main")).alias("is_main"), *table)
    rest = ["f", "star", "is_main", *(f"d{i}" for i in range(PIVOTS))]
    plain = rows.where(F.col("n") <= HOT).select("k", F.lit(-1).alias("j"), "v", *rest)
    split = rows.where(F.col("n") > HOT).select("k", F.posexplode(F.get(F.array(*(masked(finer(m)) for m in masks)), F.col("k"))).alias("j", "v"), *rest)
    return materialize(plain.union(split), "pivoted")


def meetings(rows: DataFrame, with_pivots: bool = True) -> DataFrame:
    """Pairs (a, b) of rows that are compared: of one bucket and different stars, as far as the references let them."""
    x = rows.where("not is_main").withColumn("ring", F.explode(F.array(*(F.col("d0") + i for i in (-3, -1, 1, 3))))) if with_pivots else rows.where("not is_main").withColumn("ring", F.lit(0))
    y = rows.withColumn("ring", F.col("d0") if with_pivots else F.lit(0))
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("k", "j", "v", "ring")]
    near = [F.abs(F.col(f"x.d{i}") - F.col(f"y.d{i}")) <= REACH for i in range(1, PIVOTS if with_pivots else 1)]
    on = (F.col("x.star") != F.col("y.star")) & (F.bit_count("x.f") % 2 != F.bit_count("y.f") % 2)
    for c in [*same, *near]:
        on = on & c
    return x.alias("x").join(y.alias("y"), on).select(F.col("x.f").alias("a"), F.col("y.f").alias("b"))


def far_links(labelled: DataFrame, count: int) -> DataFrame:
    """Links of distance 3 between fingerprints (f) of different stars (star)."""
    return meetings(pivoted(labelled, count)).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= REACH).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): _row, doc_id, f and component_id, the least doc_id that links reach."""
    scanned = materialize(with_row_id(fingerprints(docs), "_row"), "prints")
    prints = materialize(scanned.groupBy("f").agg(F.min("doc_id").alias("first")), "distinct")
    near = materialize(near_links(prints.select("f")), "near")
    stars = materialize(components(near), "stars")
    labelled = materialize(prints.join(stars, F.col("f") == F.col("node"), "left").select("f", F.coalesce("component", "f").alias("star")), "labelled")
    far = far_links(labelled, labelled.count())
    linked = components(near.union(far))
    named = prints.join(linked, F.col("f") == F.col("node"), "left").select("f", "first", F.coalesce("component", "f").alias("c"))
    firsts = named.groupBy("c").agg(F.min("first").alias("component_id"))
    return scanned.join(named.join(firsts, "c").select("f", "component_id"), "f").select("_row", "doc_id", "f", "component_id")


def shown(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: one row of each component stays, the least by doc_id and then by a hash of the text.

    Rows are told by doc_id and text, so different texts under one doc_id are judged apart, and of equal rows one
    stays. Rows without doc_id stay.
    """
    text = F.coalesce("text", F.lit(""))
    h, n = fresh(docs, "__h", "__n")
    parts = {"id": F.col("doc_id"), h: F.xxhash64(text), n: F.octet_length(text)}
    named = docs.where("doc_id is not null")
    # A null key takes part in a component but never names it.
    key = F.when(F.col("doc_id").isNotNull(), F.struct(*(c.alias(k) for k, c in parts.items())))
    first = near_duplicates(docs.select(key.alias("doc_id"), "text")).where("doc_id = component_id")
    kept = first.select(F.col("doc_id.id").alias("doc_id"), f"doc_id.{h}", f"doc_id.{n}").distinct()
    marked = named.withColumns({k: parts[k] for k in (h, n)})
    one = marked.join(kept, ["doc_id", h, n], "left_semi").dropDuplicates(["doc_id", h, n])
    return one.select(docs.columns).union(docs.where("doc_id is null"))
