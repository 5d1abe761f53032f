"""Byte-balanced shards from a k-d tree over metadata, in DataFrame operations only.

A node that holds s shards is cut at the weighted quantile that gives its halves bytes as s // 2 to the rest, along
the dimension in which its bytes spread widest, until every leaf holds one shard (the target bytes). Dimensions are
the logarithm of the size, the source and the language in their order, each laid from its least to its largest value
onto GRID steps, so that spreads (weighted standard deviations) compare. A cut falls within a step by a uniform hash,
found by two histograms, so that a step that holds a third of all bytes is cut too. Histograms are aggregated and
walked in Spark; the driver sees one row per node. The tree is a table of cuts per level that rows join.

Equal texts are one unit, placed by the least source and language among them, and share a shard, unless together
they outgrow PART of a shard: then they are cut into parts of about that, which keeps the shards' bytes near equal.
Slots number the rows of a shard without a gap: rows are numbered within buckets of a shard, and the buckets' counts
give each its first slot.

Null text has no bytes; null source or language is an empty one; a null doc_id is a value like others. Repeated rows
get slots of their own; an empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, with_row_id

SHARDS, GRID, OVERHEAD = 40, 1024, 16
#: The share of a shard that equal texts may fill undivided.
PART = 1 / 16
#: Groups of equal texts with more than this share of all rows are broadcast, as divided ones are: there are few.
HOT = 1e-4
#: Rows that a task numbers at once, and the most buckets of a shard.
BUCKET_ROWS, BUCKETS = 50_000, 2048
#: Rows of a divided group that a task deals out at once.
DEALT = 2000
#: Bytes of a name, beyond what all names begin with, that order it.
ORDERED = 6


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as an inline one."""
    names = [x.split(" ") for x in schema.split(", ")]
    if not rows:
        return spark.range(0).select(*(F.lit(None).cast(t).alias(n) for n, t in names))
    listed = ", ".join("(" + ", ".join(map(repr, r)) + ")" for r in rows)
    got = spark.sql(f"SELECT * FROM VALUES {listed} AS t({', '.join(n for n, _ in names)})")
    return got.select(*(F.col(n).cast(t).alias(n) for n, t in names))


def slim(docs: DataFrame) -> DataFrame:
    text, name = F.coalesce("text", F.lit("")), lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit("#"), text).alias("h2"),
        name("source").alias("source"),
        name("lang").alias("lang"),
    )


def common_start(a: str, b: str) -> int:
    a, b = a.encode(), b.encode()
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def ordinal(name: Column, skip: int) -> Column:
    """A number in the order of names, from the bytes after those that all of them begin with."""
    part = F.hex(F.substring(name.cast("binary"), skip + 1, ORDERED))
    return F.conv(F.rpad(part, 2 * ORDERED, "0"), 16, 10).cast("double")


def step(value: Column, lo: Column, hi: Column) -> Column:
    """Where value lies between lo and hi, in GRID steps."""
    at = F.when(hi > lo, F.floor((value - lo) / (hi - lo) * GRID)).otherwise(F.lit(0))
    return F.least(F.greatest(at, F.lit(0)), F.lit(GRID - 1)).cast("int")


def units(rows: DataFrame, shards: int) -> DataFrame:
    """(h1, h2, n, sub, weight, d0, d1, d2, u): equal texts, or their parts, with coordinates and a uniform hash."""
    ends = rows.agg(F.sum("size").alias("bytes"), *(f(c).alias(f"{e}_{c}") for c in ("source", "lang", "size") for e, f in (("lo", F.min), ("hi", F.max)))).first()
    if ends.bytes is None:
        ends = {"bytes": 1, "lo_source": "", "hi_source": "", "lo_lang": "", "hi_lang": "", "lo_size": 1, "hi_size": 1}
    most = max(1.0, ends["bytes"] / shards * PART)
    groups = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("size"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    dims = [step(F.log2("size"), F.log2(F.lit(ends["lo_size"])), F.log2(F.lit(ends["hi_size"])))]
    for c in ("source", "lang"):
        skip = common_start(ends[f"lo_{c}"], ends[f"hi_{c}"])
        dims.append(step(ordinal(F.col(c), skip), *(ordinal(F.lit(ends[f"{e}_{c}"]), skip) for e in ("lo", "hi"))))
    parts = F.least(F.ceil(F.col("bytes") / most), F.col("n")).cast("int")
    cut = groups.select("h1", "h2", "n", (F.col("bytes") / parts).alias("weight"), *(d.alias(f"d{i}") for i, d in enumerate(dims)), F.explode(F.sequence(F.lit(0), parts - 1)).alias("sub"))
    return cut.withColumn("u", F.pmod(F.xxhash64("h1", "h2", "sub"), F.lit(GRID * GRID)).cast("int"))


def first_reaching(histogram: DataFrame, bin_: str, want: Column) -> DataFrame:
    """The bin of every node in which its running weight reaches want, with the weight before it (below)."""
    upto = F.sum("weight").over(Window.partitionBy("node").orderBy(bin_))  # GRID bins of a node at most
    return histogram.withColumn("want", want).withColumn("below", upto - F.col("weight")).where((F.col("below") < F.col("want")) & (F.col("want") <= F.col("below") + F.col("weight")))


def cuts(at: DataFrame, counts: DataFrame) -> DataFrame:
    """(node, dim, step, top, right): where each node of counts (node, count) is cut; at: units with their nodes.

    Units whose (step, hash) is below (step, top) go left, and stay with the node's number.
    """
    spark, whole = at.sparkSession, F.lit(1 + 1e-12)
    held = at.join(F.broadcast(counts), "node").select("node", "count", "weight", "u", F.array("d0", "d1", "d2").alias("d"))
    steps = held.select("node", "count", "weight", F.posexplode("d").alias("dim", "step")).groupBy("node", "count", "dim", "step").agg(F.sum("weight").alias("weight"))
    of = Window.partitionBy("node", "dim")
    mean = F.sum(F.col("weight") * F.col("step")).over(of) / F.sum("weight").over(of)
    around = steps.withColumn("total", F.sum("weight").over(of)).withColumn("off", F.col("step") - mean)
    spread = around.groupBy("node", "dim").agg((F.sum(F.col("weight") * F.col("off") ** 2) / F.sum("weight")).alias("spread"))
    widest = spread.groupBy("node").agg(F.max_by("dim", F.struct(F.round("spread", 6), -F.col("dim"))).alias("dim"))
    half = F.floor(F.col("count") / 2)
    picked = first_reaching(around.join(widest, ["node", "dim"]), "step", F.col("total") * half / F.col("count") / whole)
    schema = "node int, count int, dim int, step int, want double"
    rows = [(r.node, r.count_, r.dim, r.step, r.want - r.below) for r in picked.withColumnRenamed("count", "count_").collect()]  # a row per node
    chosen = F.broadcast(values(spark, rows, schema))
    inside = held.select("node", "weight", "u", "d").join(chosen, "node").where(F.get("d", F.col("dim")) == F.col("step"))
    found = []
    for size, near in ((GRID, None), (1, "top")):
        if near:
            inside = inside.drop("want").join(F.broadcast(values(spark, [(r.node, r.bin, r.want - r.below) for r in found], "node int, top int, want double")), "node").where((F.col("u") / GRID).cast("int") == F.col("top"))
        bins = inside.groupBy("node", "count", "dim", "step", "want", (F.col("u") / size).cast("int").alias("bin")).agg(F.sum("weight").alias("weight"))
        found = first_reaching(bins, "bin", F.col("want") / whole).collect()  # a row per node
    out = [(r.node, r.dim, r.step, r.bin + (2 * (r.want - r.below) >= r.weight), r.node + r["count"] // 2) for r in found]
    return values(spark, out, "node int, dim int, step int, top int, right int")


def descend(at: DataFrame, level: DataFrame) -> DataFrame:
    """at with its nodes one level deeper."""
    met = at.join(F.broadcast(level), "node", "left")  # fewer rows than shards
    d = F.get(F.array("d0", "d1", "d2"), F.col("dim"))
    left = (d < F.col("step")) | ((d == F.col("step")) & (F.col("u") < F.col("top")))
    return met.withColumn("node", F.when(F.col("right").isNull() | left, F.col("node")).otherwise(F.col("right"))).drop("dim", "step", "top", "right")


def grow(found: DataFrame, shards: int) -> DataFrame:
    """found (units) with node, the shard of the leaf that each falls into."""
    spark, at, nodes = found.sparkSession, found.withColumn("node", F.lit(0)), {0: shards}
    while any(n > 1 for n in nodes.values()):
        counts = values(spark, [(k, n) for k, n in nodes.items() if n > 1], "node int, count int")
        at = descend(at, cuts(at, counts))
        nodes = {m: c for k, n in nodes.items() for m, c in (((k, n // 2), (k + n // 2, n - n // 2)) if n > 1 else ((k, n),))}
    return at


def placed(rows: DataFrame, shards: int) -> DataFrame:
    """rows with shard."""
    leaves = grow(materialize(units(rows, shards), "units"), shards)
    homes = materialize(leaves.groupBy("h1", "h2").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("sub", "node"))), lambda x: x.node).alias("homes")), "homes")
    few = (F.size("homes") > 1) | (F.col("n") > rows.count() * HOT)
    hot = homes.where(few).select("h1", "h2", "n", F.col("homes").alias("near"))  # fewer than shards / PART + 1 / HOT rows
    marked = rows.join(F.broadcast(hot), ["h1", "h2"], "left")
    keep = ["_row", "doc_id", "size", "text_crc32"]
    # A group's parts are dealt out in turn: rows are numbered within buckets of the group.
    dealt = marked.where("near is not null").withColumn("b", F.pmod(F.xxhash64("_row"), F.ceil(F.col("n") / DEALT)))
    sizes = dealt.groupBy("h1", "h2", "b").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("h1", "h2").orderBy("b")) - F.col("m")
    turn = F.col("before") + F.row_number().over(Window.partitionBy("h1", "h2", "b").orderBy("_row"))
    dealt = dealt.join(sizes.select("h1", "h2", "b", before.alias("before")), ["h1", "h2", "b"])
    a = dealt.select(*keep, F.get("near", F.pmod(turn, F.size("near")).cast("int")).alias("shard"))
    b = marked.where("near is null").join(homes.where(~few), ["h1", "h2"]).select(*keep, F.get("homes", F.lit(0)).alias("shard"))
    return a.union(b)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null under this law)."""
    rows = materialize(with_row_id(slim(docs), "_row"), "slim")
    buckets = min(BUCKETS, max(1, -(-rows.count() // (shards * BUCKET_ROWS))))
    home = materialize(placed(rows, shards).withColumn("bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int")), "placed")
    counts = home.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    starts = counts.select("shard", "bucket", before.alias("before"))  # shards x BUCKETS rows at most
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("_row")) - 1
    return (
        home.withColumn("number", number)
        .join(F.broadcast(starts), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
