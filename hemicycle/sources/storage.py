"""Files and folders by path or URI, the same on the driver and in tasks.

Paths without a scheme and ``file:`` are local; ``hdfs:``, ``s3:``, ``gs:`` and ``abfs:`` go to
pyarrow's file systems.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

from pyarrow import fs


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """File system and the path inside it."""
    path = re.sub(r"^file:/*", "/", path)
    if not re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def exists(path: str) -> bool:
    system, inside = resolve(path)
    return system.get_file_info(inside).type != fs.FileType.NotFound


def names_in(path: str, pattern: str = "*") -> list[str]:
    """Sorted names directly in a folder; none if there is no folder."""
    system, inside = resolve(path)
    found = system.get_file_info(fs.FileSelector(inside, allow_not_found=True))
    return sorted(f.base_name for f in found if fnmatch.fnmatch(f.base_name, pattern))


def files_below(path: str, pattern: str = "*") -> Iterator[tuple[str, int]]:
    """(path, bytes) of the files at any depth below a folder, or of one file."""
    system, inside = resolve(path)
    info = system.get_file_info(inside)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inside, recursive=True))
    scheme = re.match(r"^(?!file:)[a-zA-Z0-9+.-]+://", path)
    for f in found:
        if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern):
            yield (scheme.group(0) if scheme else "") + f.path, f.size or 0


def open_file(path: str):
    """A readable, unbuffered stream of the bytes as they are."""
    system, inside = resolve(path)
    return system.open_input_stream(inside, compression=None)


def read_text(path: str) -> str:
    with open_file(path) as file:
        return file.read().decode()


def write_bytes(path: str, data: bytes) -> None:
    system, inside = resolve(path)
    system.create_dir(inside.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(inside, compression=None) as out:
        out.write(data)


def rename(old: str, new: str) -> None:
    system, inside = resolve(old)
    system.move(inside, resolve(new)[1])


def remove(path: str) -> None:
    """Remove a file or a folder with all it holds, if it is there."""
    system, inside = resolve(path)
    kind = system.get_file_info(inside).type
    if kind == fs.FileType.Directory:
        system.delete_dir(inside)
    elif kind == fs.FileType.File:
        system.delete_file(inside)
