"""Binary files in the shared folder, by any URI that Arrow's file systems know."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_fs(uri: str):
    where, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))
    return where, path


class Whole:
    """A file that appears whole or not at all: written under another name, then renamed.

    A task that is run again writes the same name, so the last one stays.
    """

    def __init__(self, folder: str, name: str):
        self.fs, base = open_fs(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.part = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """The place where ``data`` starts."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)
