"""Binary files in the folder that the cluster shares, written and opened from tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def place(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the path there; Spark writes local ones as file:/..."""
    if folder.startswith("file:/") and not folder.startswith("file:///"):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def write(folder: str, suffix: str, parts: list[bytes]) -> str:
    """A new file with a name of its own. A repeated task writes another; the list of a job's files says which count."""
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    with system.open_output_stream(f"{path}/{name}", compression=None) as out:
        for part in parts:
            out.write(part)
    return name


def opened(folder: str, name: str):
    """A file that can be read at any place."""
    system, path = place(folder)
    return system.open_input_file(f"{path}/{name}")


def read(folder: str, name: str) -> bytes:
    system, path = place(folder)
    with system.open_input_stream(f"{path}/{name}", compression=None) as file:
        return file.read()
