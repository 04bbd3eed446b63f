"""Files of the shared folder as tasks see them: any file system that pyarrow can open."""

from __future__ import annotations

from pyarrow import fs


def open_shared(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI (file:, hdfs:, s3: ...) or of a plain path."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
