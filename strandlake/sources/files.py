"""Binary files by their address, on any file system that Arrow knows: local, HDFS, S3 and others."""

from __future__ import annotations

import re

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; an address without a scheme, or of ``file:``, is a local path."""
    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if "://" not in local else fs.FileSystem.from_uri(local)


def opened(path: str):
    """A file to read from any place in it."""
    where, name = located(path)
    return where.open_input_file(name)


def created(path: str):
    """A file to write, in place of one that is there; its folder is made."""
    where, name = located(path)
    where.create_dir(name.rpartition("/")[0], recursive=True)
    return where.open_output_stream(name)


def size(path: str) -> int | None:
    """Bytes of a file; None where there is none."""
    where, name = located(path)
    info = where.get_file_info(name)
    return info.size if info.type == fs.FileType.File else None


def members(path: str, ending: str) -> list[str]:
    """``path`` itself, or, of a folder, its files with an ending, in order of their names."""
    where, name = located(path)
    if where.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    names = sorted(i.base_name for i in where.get_file_info(fs.FileSelector(name)) if i.type == fs.FileType.File and i.base_name.endswith(ending))
    return [f"{path.rstrip('/')}/{n}" for n in names]
