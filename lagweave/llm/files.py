"""Small binary files in the shared folder: written whole and renamed, so that a lost attempt leaves none behind.

A file system that is mounted is memory-mapped; of any other that pyarrow knows, large arrays are read by pages as they
are needed, of which a bounded number is kept per process.
"""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np
from pyarrow import fs as pafs


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


def write_arrays(uri: str, arrays: dict[str, np.ndarray], meta: dict) -> int:
    """One file of a JSON head and 64-byte aligned arrays; returns its size."""
    at, places = 0, {}
    for k, a in arrays.items():
        places[k] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    head = json.dumps({"arrays": places, "meta": meta}).encode()
    head = len(head).to_bytes(8, "little") + head
    head += b" " * (-len(head) % 64)
    fs, path = located(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(head)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).data)
            f.write(b"\0" * (-a.nbytes % 64))
    fs.move(part, path)
    return len(head) + at


#: Bytes of a page, pages kept by a process (64 MB), and the size up to which an array is read whole.
PAGE, KEPT, WHOLE = 1 << 18, 256, 1 << 18
_pages: OrderedDict = OrderedDict()


class Paged:
    """An array in a file that is read by pages; it takes integer indices and arrays of them."""

    def __init__(self, uri: str, begin: int, dtype: np.dtype, length: int):
        self.uri, self.begin, self.dtype, self.length, self.file = uri, begin, dtype, length, None

    def __len__(self):
        return self.length

    def page(self, k: int) -> np.ndarray:
        key = (self.uri, self.begin, k)
        if key not in _pages:
            if self.file is None:
                fs, path = located(self.uri)
                self.file = fs.open_input_file(path)
            size = min(PAGE, self.length * self.dtype.itemsize - k * PAGE)
            self.file.seek(self.begin + k * PAGE)
            _pages[key] = np.frombuffer(self.file.read(size), self.dtype)
            if len(_pages) > KEPT:
                _pages.popitem(last=False)
        _pages.move_to_end(key)
        return _pages[key]

    def __getitem__(self, i):
        per = PAGE // self.dtype.itemsize
        at = np.atleast_1d(np.asarray(i, np.int64))
        flat = at.ravel()
        flat = np.where(flat < 0, flat + self.length, flat)
        out, k = np.empty(len(flat), self.dtype), flat // per
        for page in np.unique(k).tolist():
            here = np.flatnonzero(k == page)
            out[here] = self.page(page)[flat[here] - page * per]
        return out.reshape(at.shape) if np.ndim(i) else out[0]


def open_arrays(uri: str) -> tuple[dict[str, np.ndarray], dict]:
    fs, path = located(uri)
    local = isinstance(fs, pafs.LocalFileSystem)
    if local:
        raw = np.asarray(np.memmap(path, np.uint8, "r"))
        n = int.from_bytes(raw[:8].tobytes(), "little")
        head = json.loads(raw[8 : 8 + n].tobytes())
    else:
        with fs.open_input_file(path) as f:
            n = int.from_bytes(f.read(8), "little")
            head = json.loads(f.read(n))
    begin, arrays = -(-(8 + n) // 64) * 64, {}
    for k, (kind, length, at) in head["arrays"].items():
        dtype = np.dtype(kind)
        if local:
            arrays[k] = raw[begin + at : begin + at + dtype.itemsize * length].view(kind)
        elif k.endswith("ones") or dtype.itemsize * length <= WHOLE:  # directories are searched as a whole
            with fs.open_input_file(path) as f:
                f.seek(begin + at)
                arrays[k] = np.frombuffer(f.read(dtype.itemsize * length), dtype)
        else:
            arrays[k] = Paged(uri, begin + at, dtype, length)
    return arrays, head["meta"]


def remove(uri: str) -> None:
    fs, path = located(uri)
    if fs.get_file_info(path).type == pafs.FileType.File:
        fs.delete_file(path)


def make_dir(uri: str) -> None:
    fs, path = located(uri)
    fs.create_dir(path, recursive=True)
