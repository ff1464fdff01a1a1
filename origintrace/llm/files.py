"""Files of own formats in the shared folder, written and read by tasks through Arrow's file systems.

Every attempt of a task writes under a name of its own and reports it in its rows, so a lost or repeated
attempt leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import uuid


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def create(folder: str, name: str, suffix: str):
    """(path, open stream) of a new file below ``folder``, whose name starts with ``name``."""
    system, where = _place(folder)
    system.create_dir(where, recursive=True)
    file = f"{name}-{uuid.uuid4().hex}{suffix}"
    return f"{folder.rstrip('/')}/{file}", system.open_output_stream(f"{where.rstrip('/')}/{file}", compression=None)


def open_file(path: str):
    """A file to seek in."""
    system, where = _place(path)
    return system.open_input_file(where)


def open_stream(path: str):
    """A file to read from beginning to end."""
    system, where = _place(path)
    return system.open_input_stream(where, compression=None)
