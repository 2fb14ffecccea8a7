"""Binary files in the shared folder, from inside tasks: any store that pyarrow knows by its URI."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow.fs as pafs


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if urlparse(uri).scheme == "file":
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


def new_file(folder: str, stem: str, suffix: str):
    """(name, open stream) of a file that no other attempt of the task writes to."""
    fs, path = store(folder)
    fs.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"
    return name, fs.open_output_stream(f"{path}/{name}", compression=None)


def mapped(folder: str, name: str, dtype) -> np.ndarray:
    """The file as an array: memory-mapped where the store is a mounted folder, else read by one ranged request."""
    fs, path = store(folder)
    if fs.get_file_info(f"{path}/{name}").size == 0:
        return np.empty(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", dtype=dtype, mode="r")
    with fs.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read_buffer(), dtype=dtype)


