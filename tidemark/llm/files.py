"""Files in a shared folder, by plain paths where its URI is a mounted one and by Arrow's file systems elsewhere."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

import numpy as np


def local_path(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def open_output(uri: str):
    if (path := local_path(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


def mapped(uri: str, dtype, offset: int = 0, count: int = -1) -> np.ndarray:
    """A file's numbers: memory-mapped where it is mounted, else read."""
    if (path := local_path(uri)) is not None:
        if count == 0 or os.path.getsize(path) <= offset:
            return np.empty(0, dtype)
        return np.memmap(path, dtype, "r", offset, None if count < 0 else (count,))
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        f.seek(offset)
        data = f.read() if count < 0 else f.read(count * np.dtype(dtype).itemsize)
    return np.frombuffer(data, dtype)
