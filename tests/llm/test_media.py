import hashlib
import io
import wave
import zipfile
import zlib

import numpy as np
import pytest

from lagweave.llm import media


def want(d, t):
    raw = (t or "").encode()
    payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
    m = media.wav(raw)
    return d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest()


def round_trip(spark, df, **options):
    uri = media.store(df)
    got = media.features(media.load(spark, uri, **options)).collect()
    assert sorted(map(str, (tuple(r)[:7] for r in got))) == sorted(str(want(r.doc_id, r.text)) for r in df.select("doc_id", "text").collect())
    return uri, got


def test_documents(spark, documents):
    _, got = round_trip(spark, documents, partition_bytes="9000", batch_bytes="20000")
    by = {}
    assert all(by.setdefault(r.payload_sha256, r.feature) == r.feature for r in got)
    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    for r in got:
        raw = texts[r.doc_id].ljust(r.payload_bytes, b"\0")
        x = [b - 128 for b in raw]
        cross = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        assert r.feature == f"s={len(x) / 8000:.4f};mean={sum(x) / len(x):.6f};rms={(sum(v * v for v in x) / len(x)) ** 0.5:.6f};cross={cross};peak={max(map(abs, x))}"
        if r.doc_id < 20:  # the stored form, by the standard library and the `fact` chunk
            out = io.BytesIO()
            with wave.open(out, "wb") as w:
                w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000), w.writeframes(raw)
            head, data = out.getvalue()[:36], out.getvalue()[36:]
            whole = head[:4] + (len(out.getvalue()) + 12 - 8).to_bytes(4, "little") + head[8:] + b"fact\4\0\0\0" + r.n_bytes.to_bytes(4, "little") + data
            assert (r.media_bytes, r.media_sha256) == (len(whole), hashlib.sha256(whole).hexdigest())


def test_partitions_hold_bytes_not_members(documents):
    path = media.store(documents.coalesce(1))
    count = lambda n: len(media.ArchiveReader(path, {"partition_bytes": n}).partitions())
    assert count(1 << 30) == 1 and 8 < count(20_000) < 80


def test_odd_rows(spark, odd, none):
    uri, _ = round_trip(spark, odd)
    assert media.features(media.load(spark, media.store(none))).count() == 0


def test_archives_are_plain_zips_of_wavs(spark, documents):
    path = media.store(documents.where("doc_id < 20").coalesce(1)).removeprefix("file://")
    import glob

    names = [n for f in glob.glob(f"{path}/*.zip") for n in zipfile.ZipFile(f).namelist()]
    assert len(names) == documents.where("doc_id < 20").count()
    z = zipfile.ZipFile(glob.glob(f"{path}/*.zip")[0])
    assert z.testzip() is None
    w = wave.open(io.BytesIO(z.read(names[0])))
    assert (w.getsampwidth(), w.getnchannels()) == (1, 1) and w.getnframes() % 64 == 0


def test_foreign_archives_and_damage(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(5):
            z.writestr(f"{i:016x}.wav", media.wav(b"%d" % i), zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
    got = media.load(spark, f"file://{tmp_path}").collect()
    assert sorted(r.key for r in got) == [*range(5)]
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    at = next(r.offset for r in got if r.key == 2)
    raw[at + 80] ^= 255
    (tmp_path / "a.zip").write_bytes(raw)
    got = {r.key: r.error for r in media.load(spark, f"file://{tmp_path}", on_error="null").collect()}
    assert [k for k, e in got.items() if e] == [2]
    shown = {r.doc_id: r for r in media.features(media.load(spark, f"file://{tmp_path}", on_error="null")).collect()}
    assert shown[2].feature is None and shown[2].n_bytes is None and shown[3].feature
    with pytest.raises(Exception, match="damaged"):
        media.load(spark, f"file://{tmp_path}").collect()


def test_member_is_tried_again_by_its_offset(tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(3):
            z.writestr(f"{i:016x}.wav", media.wav(b"%d" % i))
    reader = media.ArchiveReader(f"file://{tmp_path}", {})
    real, tries = media.ArchiveReader.member, []

    def shaky(f, offset, *a):
        tries.append(offset)
        if len(tries) == 2:
            raise OSError("lost")
        return real(f, offset, *a)

    monkeypatch.setattr(media.ArchiveReader, "member", staticmethod(shaky))
    rows = [r for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()]
    assert [r["key"] for r in rows] == [0, 1, 2] and len(tries) == 4 and tries[1] == tries[2]
    assert np.frombuffer(media.wav_samples(rows[1]["media"])[0], np.uint8)[0] == ord("1")


def test_append_and_overwrite(spark):
    rows = lambda *ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    held = lambda: sorted(r.key for r in media.load(spark, uri).collect())
    uri = media.store(rows(1, 2))
    assert held() == [1, 2]
    media.store(rows(3), uri)
    media.store(rows(), uri)
    assert held() == [1, 2, 3]
    media.store(rows(3, 4).repartition(2), uri, mode="overwrite")
    assert held() == [3, 4]
    fs, folder = media.located(uri)
    names = [i.base_name for i in fs.get_file_info(media.pafs.FileSelector(folder))]
    assert sum(n.endswith(".json") for n in names) == 1 and sum(n.endswith(".zip") for n in names) == sum(len(x) for x in media.indexes(fs, folder).values())
