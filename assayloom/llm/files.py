"""Files in the shared folder, written and read by executors: whole or not at all."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (file:, hdfs:, s3: and what else Arrow knows) and the path within it."""
    return pafs.FileSystem.from_uri(uri)


def write_whole(uri: str, data: bytes | bytearray | memoryview) -> None:
    """Write under another name, then move: a task that is run again replaces the file with an equal one."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def read_whole(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path) as f:
        return f.read()
