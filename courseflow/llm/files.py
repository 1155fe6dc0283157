"""Small file helpers for tasks that write their own binary formats into the shared folder."""

from __future__ import annotations

import uuid

from pyarrow import fs


def write_whole(path: str, chunks) -> int:
    """Writes ``chunks`` under a name of its own and renames the finished file, so that a repeated task
    replaces a file by the same bytes and no reader sees half a file."""
    system, at = fs.FileSystem.from_uri(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    part, size = f"{at}.{uuid.uuid4().hex}", 0
    with system.open_output_stream(part, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    system.move(part, at)
    return size


def open_ranges(path: str):
    """A random-access reader: ``read_at(length, offset)``."""
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)
