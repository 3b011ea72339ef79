"""Reading and writing plain files in the shared folder from the driver and from Python workers."""

from __future__ import annotations

import contextlib
import os
import uuid

import numpy as np


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or of a plain local path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def new_file(uri: str):
    """A stream to a file that appears under its name only when complete.

    Attempts of one task write under names of their own and the last to finish
    takes the name; what they write is equal, so a retry after a lost executor or
    a speculative copy does no harm.
    """
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with fs.open_output_stream(part, compression=None) as out:
            yield out
        fs.move(part, path)
    except BaseException:
        with contextlib.suppress(OSError):
            fs.delete_file(part)
        raise


def mapped(uri: str, dtype: str, offset: int = 0, count: int | None = None) -> np.ndarray:
    """An array over a file, memory-mapped where the file system is local, read otherwise."""
    from pyarrow import fs as pafs

    fs, path = filesystem(uri)
    size = fs.get_file_info(path).size
    n = (size - offset) // np.dtype(dtype).itemsize if count is None else count
    if n == 0:
        return np.empty(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r", offset, (n,))
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_at(n * np.dtype(dtype).itemsize, offset), dtype)
