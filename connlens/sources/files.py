"""Files of a shared store, read by tasks themselves."""

from __future__ import annotations

import fnmatch
from urllib.parse import urlparse

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a location."""
    named = urlparse(uri)
    return (fs.LocalFileSystem(), named.path) if named.scheme in ("", "file") else fs.FileSystem.from_uri(uri)


def folders(uri: str) -> list[tuple[str, float]]:
    """Name and change time of each folder right below a location, hidden ones left out: a listing, no file is opened."""
    where, path = store(uri)
    found = where.get_file_info(fs.FileSelector(path.rstrip("/"), recursive=False))
    return [(f.base_name, f.mtime.timestamp() if f.mtime else 0.0) for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith(("_", "."))]


def listed(uri: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """Files of a folder (with those below it), a pattern or a single path, in order of their paths; hidden ones are left out."""
    where, path = store(uri)
    parts = path.split("/")
    first = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[")), None)
    if first is None:
        base, deep = path.rstrip("/"), None
    else:
        base, deep = "/".join(parts[:first]), parts[first:]
    top = where.get_file_info(base or "/")
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [top] if top.is_file else [f for f in where.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file]
    kept = []
    for f in found:
        below = f.path[len(base) :].strip("/").split("/") if f.path != base else []
        if any(p.startswith(("_", ".")) for p in below):
            continue
        # A pattern names the files or folders that hold them.
        if deep is None or len(below) >= len(deep) and all(fnmatch.fnmatchcase(b, p) for b, p in zip(below, deep, strict=False)):
            kept.append(f)
    return where, sorted(kept, key=lambda f: f.path)
