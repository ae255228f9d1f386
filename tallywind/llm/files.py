"""Files in the shared folder, reached from tasks through its URI scheme."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs


def open_fs(path: str):
    """The file system of a URI or local path, and the path within it."""
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))


def fresh_name(folder: str, label: str, kind: str) -> str:
    """A name no other attempt of a task uses: what a lost attempt has written is never taken for the result."""
    return f"{folder}/{label}-{uuid.uuid4().hex}.{kind}"


def write_bytes(path: str, *parts: bytes) -> None:
    where, inner = open_fs(path)
    where.create_dir(os.path.dirname(inner), recursive=True)
    with where.open_output_stream(inner) as out:
        for part in parts:
            out.write(part)


def read_bytes(path: str) -> bytes:
    where, inner = open_fs(path)
    with where.open_input_stream(inner) as data:
        return data.read()


def memory_map(path: str, dtype) -> np.ndarray:
    """A mapped array. A file that is not local is copied to the task's temporary folder, mapped, and unlinked at once."""
    where, inner = open_fs(path)
    if isinstance(where, fs.LocalFileSystem):
        return np.memmap(inner, dtype, "r") if os.path.getsize(inner) else np.zeros(0, dtype)
    handle, local = tempfile.mkstemp()
    try:
        with os.fdopen(handle, "wb") as out, where.open_input_stream(inner) as data:
            while part := data.read(8 << 20):
                out.write(part)
        return np.memmap(local, dtype, "r") if os.path.getsize(local) else np.zeros(0, dtype)
    finally:
        os.unlink(local)
