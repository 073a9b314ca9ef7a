"""Single files and folders by address, opened in whatever process asks: a mounted path, or a store that pyarrow knows."""

from __future__ import annotations

import os

from pyarrow import fs


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path on it; file: addresses and plain paths are local."""
    if address.startswith("file:"):
        return fs.LocalFileSystem(), "/" + address[5:].lstrip("/")
    if "://" not in address:
        return fs.LocalFileSystem(), os.path.abspath(address)
    return fs.FileSystem.from_uri(address)


def exists(address: str) -> bool:
    store, path = opened(address)
    return store.get_file_info(path).type != fs.FileType.NotFound


def names(address: str) -> list[str]:
    """The names in a folder, in order; none if there is no such folder."""
    store, path = opened(address)
    return sorted(info.base_name for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True)))


def marked(address: str, mark: str = "_SUCCESS") -> list[str]:
    """The names of the folders in a folder that hold a file of that name: one listing, however many there are."""
    store, path = opened(address)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True))
    ends = [info.path.rsplit("/", 2) for info in found]
    return sorted(parts[1] for parts in ends if len(parts) == 3 and parts[2] == mark and parts[0].rstrip("/").endswith(path.rstrip("/")))


def write(address: str, data: bytes = b"") -> None:
    """A file with these bytes, in a folder that is made if need be."""
    store, path = opened(address)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(data)


def remove(address: str) -> None:
    """Delete a file or a folder with all that is in it; no error if there is none."""
    store, path = opened(address)
    kind = store.get_file_info(path).type
    if kind == fs.FileType.Directory:
        store.delete_dir(path)
    elif kind != fs.FileType.NotFound:
        store.delete_file(path)
