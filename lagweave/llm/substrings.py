"""Removal of repeated passages: every window of `span` words that stands somewhere earlier goes.

Texts are hashed only at anchors: runs of `span - PERIOD + 1` words that start at places whose remainder modulo PERIOD
lies in a difference cover. For any two places a shift below PERIOD brings both to cover places, so two equal windows
share an anchor at equal distance from their starts. Anchors that stand in one place alone are dropped by a count;
around the others texts are extended to whole windows, which meet by a 96-bit hash. The earliest of equal windows
stays, all others cover the words that go.

Earlier: of a smaller doc_id (nulls last; then by a digest of the words), or before it in one document. Windows are
judged on the input. Texts of equal words are one document up to the end: a copy goes whole if it has a window at all.
Rows of equal doc_id and words get equal results. Null texts have no words. Extra columns are not carried by
`repeats`; `drop_repeats` keeps all of them.

Hot anchors and windows are counted by sums of each task's own; groups are never gathered. What documents get back is
bounded by their own length.
"""

from __future__ import annotations

import hashlib
from itertools import combinations, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize
from .tokens import EXACT, U, blocks, mixed

SPAN, PERIOD = 20, 13
BLOCK_BYTES = 4 << 20
#: Odd multipliers of the rolling hashes.
FACTORS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
RANGES = "array<struct<start:int,end:int>>"
RANGE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def difference_cover(period: int) -> tuple[int, ...]:
    """The first of the smallest sets whose differences give every remainder."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            found = (0, *rest)
            if len({(a - b) % period for a in found for b in found}) == period:
                return found
    raise ValueError("period must be positive")


def rolled(h: np.ndarray, k: int, factor: np.uint64) -> np.ndarray:
    """A hash of every k consecutive words."""
    n = max(0, len(h) - k + 1)
    g = np.zeros(n, U)
    for j in range(k):
        g *= factor
        g += h[j : n + j]
    return mixed(g)


def documents(column: pa.Array, span: int):
    """(row, word hashes) of the texts with a window."""
    for i, j, tokens, starts in blocks(column, BLOCK_BYTES, 0, 0, EXACT):
        for r in range(i, j):
            h = tokens[starts[r - i] + 1 : starts[r - i + 1] - 1]
            if len(h) >= span:
                yield r, h


class Anchors:
    def __init__(self, span: int):
        self.period = min(PERIOD, span)
        self.words = span - self.period + 1
        self.cover = np.zeros(self.period, bool)
        self.cover[[*difference_cover(self.period)]] = True

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of a text's anchors."""
        g = rolled(h, self.words, FACTORS[0])
        at = np.flatnonzero(np.resize(self.cover, len(g)))
        return at, g[at].view(np.int64)

    def windows(self, h: np.ndarray, marked: np.ndarray, span: int) -> np.ndarray:
        """Starts of the windows around the anchors whose hashes are marked."""
        at, g = self.of(h)
        at = at[np.isin(g, marked)]
        n = len(h) - span + 1
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, np.minimum(np.maximum(at - self.period + 1, 0), n), 1)
        np.add.at(edge, np.minimum(at + 1, n), -1)
        return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def digest(words: list[bytes]) -> tuple[bytes, int, int]:
    """The SHA-256 of the words, and two longs of it."""
    full = hashlib.sha256(b" ".join(words)).digest()
    return full, *np.frombuffer(full[:16], "<i8").tolist()


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, id (a long, null for null) and raw."""
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    id_ = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    return docs.select("doc_id", id_.alias("id"), F.col("text").cast("binary").alias("raw"))


def summaries(docs: DataFrame) -> DataFrame:
    """(doc_id, id, d1, d2, n, sha): a row per row of docs."""

    def run(batches):
        for b in batches:
            rows = [(len(ws), *digest(ws)) for ws in ((x or b"").split() for x in b.column("raw").to_pylist())]
            n, sha, d1, d2 = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("id"), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.binary())], names=["doc_id", "id", "d1", "d2", "n", "sha"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return identified(docs).mapInArrow(run, f"doc_id {kind}, id bigint, d1 bigint, d2 bigint, n bigint, sha binary")


def placed(told: DataFrame, span: int) -> DataFrame:
    """(doc_id, d1, d2, key, first): texts with a window, each once; first: the place of its words in the order of all.

    A partition of the sorted texts counts from its number times 2 ** 40.
    """
    once = told.where(F.col("n") >= span).groupBy("d1", "d2").agg(F.min_by(F.struct("doc_id", "id"), F.struct(F.col("doc_id").isNull(), "doc_id")).alias("x"), F.min("n").alias("n"))
    sorted_ = once.select("x.doc_id", "d1", "d2", F.coalesce("x.id", "d1").alias("key"), "n").orderBy(F.col("doc_id").asc_nulls_last(), "d1", "d2")

    def run(batches):
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            n = b.column("n").to_numpy()
            first = at + np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
            at = int(first[-1])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(first[:-1])], names=["doc_id", "d1", "d2", "key", "first"])

    kind = told.schema["doc_id"].dataType.simpleString()
    return sorted_.mapInArrow(run, f"doc_id {kind}, d1 bigint, d2 bigint, key bigint, first bigint")


def anchors(docs: DataFrame, span: int) -> DataFrame:
    """(h, key, text, many): a text's distinct anchors; text: a digest of its words, many: there more than once."""

    def run(batches):
        kind = Anchors(span)
        for b in batches:
            raw, ids, out, size = b.column("raw"), b.column("id").to_pylist(), [], 0
            for r, h in documents(raw, span):
                g, n = np.unique(kind.of(h)[1], return_counts=True)
                d1 = digest(raw[r].as_py().split())[1]
                out.append((g, np.full(len(g), d1 if ids[r] is None else ids[r]), np.full(len(g), d1), n > 1))
                size += len(g)
                if size >= 1 << 18:
                    yield batch(out)
                    out, size = [], 0
            yield batch(out)

    def batch(out):
        kinds = np.int64, np.int64, np.int64, bool
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, k), *(x[i] for x in out)]).astype(k)) for i, k in enumerate(kinds)], names=["h", "key", "text", "many"])

    return identified(docs).select("id", "raw").mapInArrow(run, "h bigint, key bigint, text bigint, many boolean")


def marked(docs: DataFrame, span: int) -> DataFrame:
    """(key, marks): the anchors of a document that stand in more than one place."""
    found = anchors(docs, span)
    counts = found.groupBy("h").agg(F.min("text").alias("lo"), F.max("text").alias("hi"), F.max("many").alias("many"))
    again = materialize(counts.where(F.col("many") | (F.col("lo") != F.col("hi"))).select("h"), "anchors")
    return materialize(found.select("h", "key").join(again, "h").groupBy("key").agg(F.collect_set("h").alias("marks")), "marks")


def texts(docs: DataFrame, span: int) -> DataFrame:
    """(doc_id, d1, d2, key, raw) of the texts with a window."""

    def run(batches):
        for b in batches:
            rows = [(r, *digest(ws)[1:]) for r, ws in enumerate((x or b"").split() for x in b.column("raw").to_pylist()) if len(ws) >= span]
            at = pa.array([r for r, *_ in rows], pa.int64())
            d1, d2 = (pa.array([x[i] for x in rows], pa.int64()) for i in (1, 2))
            ids = b.column("id").take(at).to_pylist()
            key = pa.array([d if i is None else i for i, d in zip(ids, d1.to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), d1, d2, key, b.column("raw").take(at)], names=["doc_id", "d1", "d2", "key", "raw"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return identified(docs).mapInArrow(run, f"doc_id {kind}, d1 bigint, d2 bigint, key bigint, raw binary")


def met(words: DataFrame, places: DataFrame) -> DataFrame:
    """words with what places has for the same document."""
    p = places.select(F.col("doc_id").alias("pid"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("key").alias("pkey"), *(c for c in places.columns if c not in ("doc_id", "d1", "d2", "key")))
    on = (F.col("key") == F.col("pkey")) & (F.col("d1") == F.col("p1")) & (F.col("d2") == F.col("p2")) & F.col("doc_id").eqNullSafe(F.col("pid"))
    return words.join(p, on).drop("pid", "p1", "p2", "pkey")


def windows(pairs: DataFrame, span: int) -> DataFrame:
    """(a, b, first, at): hash, document and place of the windows around marked anchors, each once a document."""

    def run(batches):
        kind = Anchors(span)
        for batch in batches:
            first, marks = batch.column("first").to_numpy(), batch.column("marks")
            for r, h in documents(batch.column("raw"), span):
                starts = kind.windows(h, marks[r].values.to_numpy(), span)
                a = rolled(h, span, FACTORS[0])[starts]
                b = (rolled(h, span, FACTORS[1])[starts] >> U(32)).astype(np.uint32).view(np.int32)
                _, once = np.unique(a, return_index=True)
                once.sort()
                yield pa.RecordBatch.from_arrays([pa.array(a[once].view(np.int64)), pa.array(b[once]), pa.array(np.full(len(once), first[r])), pa.array(first[r] + starts[once])], names=["a", "b", "first", "at"])

    return pairs.select("first", "marks", "raw").mapInArrow(run, "a bigint, b int, first bigint, at bigint")


def removed(pairs: DataFrame, span: int) -> DataFrame:
    """(first, ranges, sha): the words that go, and the digest of those that stay. stay: the windows that are earliest."""

    def run(batches):
        kind = Anchors(span)
        for batch in batches:
            first, marks, stay, raw = batch.column("first"), batch.column("marks"), batch.column("stay"), batch.column("raw")
            out = []
            for r, h in documents(raw, span):
                starts = kind.windows(h, marks[r].values.to_numpy(), span)
                if stay[r].is_valid:
                    starts = np.setdiff1d(starts, stay[r].values.to_numpy(), assume_unique=True)
                if not len(starts):
                    continue
                cut = np.flatnonzero(np.diff(starts) > span)
                lo, hi = starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + span
                ranges = [{"start": a, "end": b} for a, b in zip(lo.tolist(), hi.tolist())]
                out.append((first[r].as_py(), ranges, hashlib.sha256(b" ".join(kept(raw[r].as_py().split(), ranges))).digest()))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), RANGE, pa.binary()))], names=["first", "ranges", "sha"])

    return pairs.select("first", "marks", "stay", "raw").mapInArrow(run, f"first bigint, ranges {RANGES}, sha binary")


def kept(words: list[bytes], ranges: list[dict]):
    stays = np.ones(len(words), bool)
    for x in ranges:
        stays[x["start"] : x["end"]] = False
    return compress(words, stays.tolist())


def repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, d1, d2 (a digest of the words), n_words, ranges of words that go
    ([start, end), apart from each other), and sha, the digest of the words that stay."""
    told = materialize(summaries(docs), "summaries")
    places = materialize(placed(told, span), "places")
    info = places.join(marked(docs, span), "key")
    words = texts(docs, span)
    least = windows(met(words, info), span).groupBy("a", "b").agg(F.min("first").alias("first"), F.min("at").alias("at"))
    stay = least.groupBy("first").agg(F.collect_list((F.col("at") - F.col("first")).cast("int")).alias("stay"))
    gone = materialize(removed(met(words, info.join(stay, "first", "left")), span), "removed").dropDuplicates(["first"])
    own = places.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("doc_id").alias("pid"), "first").join(gone.withColumnRenamed("sha", "left"), "first", "left")
    both = told.join(own, (F.col("d1") == F.col("p1")) & (F.col("d2") == F.col("p2")), "left")
    copy = F.col("first").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("pid"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("end")))
    return both.select(
        "doc_id", "d1", "d2", F.col("n").alias("n_words"),
        F.when(copy, whole).otherwise(F.coalesce("ranges", F.array().cast(RANGES))).alias("ranges"),
        F.when(copy, F.unhex(F.sha2(F.lit("").cast("binary"), 256))).otherwise(F.coalesce("left", "sha")).alias("sha"),
    )


def shown(found: DataFrame) -> DataFrame:
    gone = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.lower(F.hex("sha")).alias("kept_sha256"))


def drop_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """docs with the words that stay as text, joined by one blank; texts that lose none stay as they are."""
    found = repeats(docs, span).where(F.size("ranges") > 0).dropDuplicates(["doc_id", "d1", "d2"])
    d1, d2, pid, p1, p2, ranges = fresh(docs, "d1", "d2", "pid", "p1", "p2", "ranges")
    names, kinds = docs.columns, [*docs.schema.fields, T.StructField(d1, T.LongType()), T.StructField(d2, T.LongType())]

    def mark(batches):
        for b in batches:
            ds = [digest((x or "").encode().split())[1:] for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([d[i] for d in ds], pa.int64()) for i in (0, 1))], names=[*b.schema.names, d1, d2])

    def cut(batches):
        for b in batches:
            texts = [t if r is None else b" ".join(kept(t.encode().split(), r)).decode() for t, r in zip(b.column("text").to_pylist(), b.column(ranges).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names], names=names)

    other = found.select(F.col("doc_id").alias(pid), F.col("d1").alias(p1), F.col("d2").alias(p2), F.col("ranges").alias(ranges))
    on = F.col("doc_id").eqNullSafe(F.col(pid)) & (F.col(d1) == F.col(p1)) & (F.col(d2) == F.col(p2))
    return docs.mapInArrow(mark, T.StructType(kinds)).join(other, on, "left").select(*names, ranges).mapInArrow(cut, docs.schema)


def oracle_sql() -> str:
    """The same for DuckDB: every window in full."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
p AS (SELECT r, doc_id, i, x, concat_ws(' ', {", ".join(f"lead(x, {k}) OVER o" for k in range(SPAN))}) AS g, lead(i, {SPAN - 1}) OVER o IS NOT NULL AS full_ FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS nth FROM p WHERE full_),
c AS (SELECT DISTINCT r, unnest(range(i, i + {SPAN})) AS i FROM g WHERE nth > 1),
k AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS kept FROM x ANTI JOIN c USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""
