"""Media columns: payloads kept as WAV members of ZIP archives, written and read by a custom data source.

Format "media_archive":

* the writer gives each task its archives (8-bit mono WAV members, deflated), rolled over at `archive_bytes`; an
  archive counts only once the commit has listed it in an index of its own, so attempts of lost executors leave none
  behind, appending adds to what is there, and overwriting takes away the indexes and archives listed before;
* the reader plans byte ranges over the archives' central directories, of about `partition_bytes` of stored members
  each. Entries of our archives have one length, so ranges are cut by arithmetic from the index, and the driver opens
  no archive; a foreign ZIP, without index, is one range (ZIP64 records are refused);
* a task walks its range of directory entries and streams its members in Arrow batches of at most `batch_bytes`
  (or one member). Every member is read at its own offset, checked (local header, length, CRC) and tried again by
  itself from there; after `retries` tries the read fails, or with `on_error=null` gives the member without media.

Samples are the UTF-8 bytes of a text, padded with 0 to a positive multiple of 64; the WAV `fact` chunk keeps the
length before padding, so equal texts have equal members. Null text counts as empty; a null key is kept; repeated
rows are members of their own. An empty table gives archives of no members. Members without media have null features.
Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import new_path
from .files import located, make_dir

UNIT, RATE = 64, 8000
#: Start and end of the names of index files, one for each commit.
INDEX = "_index", ".json"
#: Bytes: of stored members per partition, of media per batch, of an archive; tries per member; deflate level.
PARTITION_BYTES, BATCH_BYTES, ARCHIVE_BYTES, RETRIES, LEVEL = 64 << 20, 8 << 20, 256 << 20, 3, 4
SCHEMA = "key long, archive string, offset long, media binary, error string"
# ---- fixed values: the ZIP format's records ----------------------------------------------------------
LOCAL, ENTRY, END = struct.Struct("<4s5H3I2H"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s4H2IH")
#: What 32-bit fields hold if the number is in a ZIP64 record.
LARGE = 0xFFFFFFFF
# ------------------------------------------------------------------------------------------------------


def wav(raw: bytes) -> bytes:
    """An 8-bit mono WAV of raw and its padding; `fact` holds len(raw)."""
    size = max(1, -(-len(raw) // UNIT)) * UNIT
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    fact = struct.pack("<4sII", b"fact", 4, len(raw))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(fact) + 8 + size, b"WAVE") + fmt + fact + struct.pack("<4sI", b"data", size) + raw.ljust(size, b"\0")


def wav_samples(media: bytes) -> tuple[bytes, int]:
    """The samples and the length before padding, from the chunks of a WAV."""
    at, samples, n = 12, b"", None
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fact":
            n = struct.unpack_from("<I", media, at + 8)[0]
        elif kind == b"data":
            samples = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return samples, len(samples) if n is None else n


def member_name(key: int | None) -> bytes:
    """20 bytes, so that directory entries have one length."""
    return (b"-" * 16 if key is None else b"%016x" % (key % (1 << 64))) + b".wav"


def member_key(name: bytes) -> int | None:
    try:
        k = int(name[:16], 16)
        return k - (1 << 64) if k >> 63 else k
    except ValueError:
        return None


class Archive:
    """A ZIP written front to back."""

    def __init__(self, fs: pafs.FileSystem, folder: str):
        self.name = f"part-{uuid.uuid4().hex}.zip"
        self.out, self.at, self.entries = fs.open_output_stream(f"{folder}/{self.name}"), 0, []

    def put(self, bytes_: bytes) -> None:
        self.out.write(bytes_)
        self.at += len(bytes_)

    def add(self, key: int | None, media: bytes) -> None:
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
        packed, name, crc = z.compress(media) + z.flush(), member_name(key), zlib.crc32(media)
        self.entries.append(ENTRY.pack(b"PK\1\2", 20, 20, 0, 8, 0, 33, crc, len(packed), len(media), len(name), 0, 0, 0, 0, 0, self.at) + name)
        self.put(LOCAL.pack(b"PK\3\4", 20, 0, 8, 0, 33, crc, len(packed), len(media), len(name), 0) + name)
        self.put(packed)

    def close(self) -> dict:
        start, n = self.at, len(self.entries)
        self.put(b"".join(self.entries))
        size = self.at - start
        self.put(END.pack(b"PK\5\6", 0, 0, min(n, 65535), min(n, 65535), size, start, 0))
        self.out.close()
        return {"name": self.name, "start": start, "size": size, "members": n}


@dataclass
class Written(WriterCommitMessage):
    archives: list


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, archive_bytes: int, overwrite: bool = False):
        self.uri, self.archive_bytes, self.overwrite = uri, archive_bytes, overwrite

    def write(self, iterator):
        fs, folder = located(self.uri)
        done, now = [], None
        for b in iterator:
            for key, raw in zip(b.column(0), b.column(1)):
                if now is not None and (now.at >= self.archive_bytes or len(now.entries) == 65535):
                    done.append(now.close())
                    now = None
                now = now or Archive(fs, folder)
                now.add(key.as_py(), wav(raw.as_py() or b""))
        if now is not None:
            done.append(now.close())
        return Written(done)

    def commit(self, messages):
        fs, folder = located(self.uri)
        before = indexes(fs, folder) if self.overwrite else {}
        with fs.open_output_stream(f"{folder}/{INDEX[0]}-{uuid.uuid4().hex}{INDEX[1]}") as f:
            f.write(json.dumps([a for m in messages if m for a in m.archives]).encode())
        for path, archives in before.items():
            fs.delete_file(path)
            for a in archives:
                fs.delete_file(f"{folder}/{a['name']}")

    def abort(self, messages):
        fs, folder = located(self.uri)
        for a in (a for m in messages if m for a in m.archives):
            fs.delete_file(f"{folder}/{a['name']}")


def indexes(fs: pafs.FileSystem, folder: str) -> dict[str, list[dict]]:
    """The archives that each index file of a folder lists, by its path."""
    out = {}
    for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if info.base_name.startswith(INDEX[0]) and info.base_name.endswith(INDEX[1]):
            with fs.open_input_stream(info.path) as f:
                out[info.path] = json.loads(f.read())
    return out


@dataclass
class Range(InputPartition):
    """Bytes start..end of the central directory of an archive."""

    archive: str
    start: int
    end: int


def directory(f, size: int) -> tuple[int, int]:
    """Where the central directory of a ZIP begins and ends, from its end record."""
    tail = min(size, 65557)
    f.seek(size - tail)
    raw = f.read(tail)
    at = raw.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no ZIP end record")
    _, _, _, _, n, length, start, _ = END.unpack_from(raw, at)
    if LARGE in (length, start) or (n == 0xFFFF and b"PK\6\7" in raw[:at]):
        raise ValueError("a ZIP64 archive")
    return start, start + length


class ArchiveReader(DataSourceReader):
    def __init__(self, uri: str, options: dict):
        self.uri = uri
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.batch_bytes = int(options.get("batch_bytes", BATCH_BYTES))
        self.retries = int(options.get("retries", RETRIES))
        self.null_errors = options.get("on_error", "fail") == "null"

    def partitions(self):
        fs, folder = located(self.uri)
        if found := indexes(fs, folder):
            out = []
            for a in (a for path in sorted(found) for a in found[path]):
                entry = a["size"] // max(1, a["members"])
                step = max(1, self.partition_bytes * a["members"] // max(1, a["start"])) * entry
                out += [Range(a["name"], s, min(s + step, a["start"] + a["size"])) for s in range(a["start"], a["start"] + a["size"], step or 1)]
            return out or [Range("", 0, 0)]
        out = []
        for info in fs.get_file_info(pafs.FileSelector(folder)):
            if info.base_name.lower().endswith(".zip"):
                with fs.open_input_file(info.path) as f:
                    out.append(Range(info.base_name, *directory(f, info.size)))
        return out or [Range("", 0, 0)]

    def read(self, partition):
        rows, size = [], 0
        for row in self.members(partition) if partition.archive else ():
            rows.append(row)
            size += len(row[3] or b"")
            if size >= self.batch_bytes:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    def members(self, part):
        fs, folder = located(self.uri)
        path = f"{folder}/{part.archive}"
        with fs.open_input_file(path) as f:
            f.seek(part.start)
            raw, at = f.read(part.end - part.start), 0
            while at < len(raw):
                _, _, _, _, method, _, _, crc, packed, length, n, extra, comment, _, _, _, offset = ENTRY.unpack_from(raw, at)
                name = raw[at + ENTRY.size : at + ENTRY.size + n]
                at += ENTRY.size + n + extra + comment
                if LARGE in (packed, length, offset):
                    raise ValueError(f"{part.archive}: a ZIP64 archive")
                media = error = None
                for attempt in range(self.retries):
                    try:
                        if attempt:
                            with fs.open_input_file(path) as again:
                                media = self.member(again, offset, method, packed, length, crc)
                        else:
                            media = self.member(f, offset, method, packed, length, crc)
                        break
                    except (OSError, ValueError, zlib.error, struct.error) as e:
                        error = f"{type(e).__name__}: {e}"
                if media is None and not self.null_errors:
                    raise OSError(f"{part.archive} at {offset}: {error}")
                yield member_key(name), part.archive, offset, media, None if media is not None else error

    @staticmethod
    def member(f, offset, method, packed, length, crc) -> bytes:
        f.seek(offset)
        head = LOCAL.unpack(f.read(LOCAL.size))
        if head[0] != b"PK\3\4":
            raise ValueError("no member here")
        f.seek(offset + LOCAL.size + head[9] + head[10])
        raw = f.read(packed)
        media = zlib.decompress(raw, -15) if method == 8 else raw
        if len(media) != length or zlib.crc32(media) != crc:
            raise ValueError("member is damaged")
        return media


def batch(rows) -> pa.RecordBatch:
    cols = list(zip(*rows))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "archive", "offset", "media", "error"])


class MediaArchive(DataSource):
    """Options: path (a URI); partition_bytes, batch_bytes, retries, on_error for reading; archive_bytes for writing."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options["path"], dict(self.options))

    def writer(self, schema, overwrite):
        make_dir(self.options["path"])
        return ArchiveWriter(self.options["path"], int(self.options.get("archive_bytes", ARCHIVE_BYTES)), overwrite)


def store(docs: DataFrame, uri: str | None = None, mode: str = "append") -> str:
    """Writes docs (doc_id long, text) as media; returns the folder, by default a new one in the shared folder.

    mode: append or overwrite, of what a folder holds already.
    """
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchive)
    uri = uri or new_path(spark, "media")
    docs.select(F.col("doc_id").cast("long").alias("key"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw")).write.format("media_archive").mode(mode).save(uri)
    return uri


def load(spark, uri: str, **options) -> DataFrame:
    """key, archive, offset, media and error of every member."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(uri)


def feature(samples: np.ndarray) -> str:
    """Length in seconds, mean, root mean square around the middle, crossings of it, and peak, of 8-bit samples."""
    x = samples.astype(np.float64) - 128
    cross = int((np.signbit(x[1:]) != np.signbit(x[:-1])).sum())
    return f"s={len(x) / RATE:.4f};mean={x.mean():.6f};rms={np.sqrt((x * x).mean()):.6f};cross={cross};peak={int(np.abs(x).max())}"


def features(media: DataFrame) -> DataFrame:
    """Per member: doc_id, lengths and digests of payload and media, and the feature string."""

    def run(batches):
        for b in batches:
            rows = []
            for m in b.column("media"):
                m = m.as_py()
                if m is None:
                    rows.append((None,) * 7)
                    continue
                payload, n = wav_samples(m)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature(np.frombuffer(payload, np.uint8))))
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", *names])

    return media.select("key", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
