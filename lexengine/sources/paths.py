"""Files of shared stores, as tasks see them: by path or address, through Arrow's file systems."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatch

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """Names and sizes of the files at a path, itself or in the folder, in the order of names; those that begin with . or _ are left out.

    The last part of a path may be a pattern.
    """
    store, at = opened(path)
    folder, _, name = at.rpartition("/")
    if any(c in name for c in "*?["):
        return [f for f in listed(f"{path.rpartition('/')[0]}") if fnmatch(f[0].rpartition("/")[2], name)]
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        return []
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    found = store.get_file_info(fs.FileSelector(at, recursive=False))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and f.base_name.endswith(suffix))


def read_range(store: fs.FileSystem, name: str, start: int, size: int) -> bytes:
    with store.open_input_file(name) as f:
        f.seek(start)
        return f.read(size)


def read_text(path: str) -> str | None:
    """A small file whole; None where there is none."""
    store, at = opened(path)
    if store.get_file_info(at).type != fs.FileType.File:
        return None
    with store.open_input_stream(at) as f:
        return f.read().decode()


def write_bytes(path: str, chunks: Iterator[bytes] | list[bytes]) -> int:
    """Writes a file, and the folders above it, and gives its size."""
    store, at = opened(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    size = 0
    with store.open_output_stream(at) as f:
        for c in chunks:
            f.write(c)
            size += len(c)
    return size


def removed(path: str) -> None:
    """Removes a file or a folder, if it is there."""
    store, at = opened(path)
    kind = store.get_file_info(at).type
    if kind == fs.FileType.File:
        store.delete_file(at)
    elif kind == fs.FileType.Directory:
        store.delete_dir(at)
