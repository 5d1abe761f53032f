"""Byte-pair encoding and decoding with a contiguous rank array per word.

Null text counts as empty; an empty text has no ids and decodes to the empty string. Repeated rows and extra
columns pass through; the result columns replace columns of the same name.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

#: Words of more pieces than this merge through a heap: scanning an array is quadratic.
SHORT = 128
#: Distinct words remembered by a Python worker before it starts afresh.
REMEMBER = 300_000
NEVER = 1 << 60

# ---- fixed values: the vocabulary file's own pre-tokeniser pattern -------------------------------
NORMAL = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same, with room for the letters and numbers that the vocabulary's library knows.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|{L}+|{N}|[^\s{L}{N}]+"
#: Letters, numbers and lower-case pairs on which the Unicode tables of the vocabulary's library (16) differ from
#: those of the installed regex module and of Python.
NO_LETTERS = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 "
    "10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda "
    "18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 "
    "1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e "
    "2cea2-2cead 323b0-33479 3d000-3fc3f"
)
NO_NUMBERS = "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
# --------------------------------------------------------------------------------------------------


def words_pattern() -> str:
    def but(kind: str, spans: str) -> str:
        codes = "".join("-".join(f"\\U{int(x, 16):08x}" for x in span.split("-")) for span in spans.split())
        return f"[\\p{{{kind}}}--[{codes}]]"

    return "(?V1)" + WORDS.replace("{L}", but("L", NO_LETTERS)).replace("{N}", but("N", NO_NUMBERS))


NEWER = regex.compile("[" + "".join(map(chr, NEW_LOWER)) + "]")


def plain(text: str) -> str:
    """NFC and lower case, character by character: the capital sigma doesn't heed its place in the word."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    return text.translate(NEW_LOWER) if NEWER.search(text) else text


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies, from its rule."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def check_steps(spec: dict) -> None:
    """Raises unless the file asks for the steps that this module takes."""
    steps = (spec["normalizer"] or {}).get("normalizers", [spec["normalizer"] or {}])
    if [s.get("type") for s in steps] != NORMAL:
        raise ValueError(f"normalizer: {NORMAL} expected")
    pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if [p.get("type") for p in pre] != ["Split", "ByteLevel"] or pre[0]["pattern"].get("Regex") != SPLIT or pre[0]["behavior"] != "Removed" or not pre[0]["invert"] or pre[1]["add_prefix_space"]:
        raise ValueError("pre-tokeniser: the words of this module's pattern, then bytes, expected")
    model = spec["model"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
        raise ValueError("a plain BPE model with word ends is expected")


class WordBpe:
    """A word-level BPE vocabulary (word ends marked) read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        check_steps(spec)
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.last = [vocab[x + self.end] for x in letters]
        self.pattern = regex.compile(words_pattern())
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.seen: dict[str, bytes] = {}

    def merge(self, parts: list[int]) -> list[int]:
        """parts[i] spans bounds[i]..bounds[i+1]; ranks[i] belongs to the boundary between parts i and i+1.

        The least rank (the leftmost of equals) loses its boundary, and the ranks beside it are looked up again.
        """
        get = self.rank.get
        ranks = [get(p, NEVER) for p in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) != NEVER:
            i = ranks.index(low)
            parts[i] = self.merged[low]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), NEVER)
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), NEVER)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same result in n log n for long words: a heap of (rank, position) over linked parts."""
        n, get = len(parts), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get((parts[i], parts[i + 1]), NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if parts[i] >= 0 else n
            if j >= n or get((parts[i], parts[j])) != r:
                continue
            parts[i], parts[j], after[i] = self.merged[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := get((parts[i], parts[after[i]]), NEVER)) != NEVER:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := get((parts[before[i]], parts[i]), NEVER)) != NEVER:
                heapq.heappush(heap, (x, before[i]))
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> bytes:
        """The packed ids of a word."""
        if (found := self.seen.get(word)) is None:
            raw = word.encode()
            parts = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
            found = np.array((self.merge if len(parts) <= SHORT else self.merge_long)(parts), "<u4").tobytes()
            if len(raw) <= SHORT:
                if len(self.seen) >= REMEMBER:
                    self.seen.clear()
                self.seen[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.special:
                out.append(np.array([self.special[piece]], "<u4").tobytes())
            elif piece:
                out += map(self.word, self.pattern.findall(plain(piece)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


def bpe(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with `ids` (binary: little-endian unsigned 32-bit ids) and `decoded` (the text made back from ids).

    path: a vocabulary file that every executor can read, as installed packages are.
    """
    rest, (own,) = [c for c in docs.columns if c not in (ids, decoded)], fresh(docs, "__text")

    def run(batches):
        vocab = vocabulary(path)
        for b in batches:
            packed = [vocab.encode(t or "") for t in b.column(own).to_pylist()]
            keep = [b.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(packed, pa.binary()), pa.array(map(vocab.decode, packed), pa.string())],
                names=[*rest, ids, decoded],
            )

    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])
    return docs.select(*rest, F.col(text).alias(own)).mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """The per-document digest columns of an encoded table."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
