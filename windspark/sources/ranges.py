"""Byte ranges of files, read inside tasks, so that files of any size are cut."""

from __future__ import annotations


class Ranges:
    """Reads ranges of the files that Spark lists; keeps the last file open.

    Paths may have any scheme that pyarrow opens (file, hdfs, s3, gs, abfs; s3a counts as s3).
    """

    def __init__(self):
        self._path, self._file = None, None

    def read(self, path: str, at: int, n: int) -> bytes:
        if path != self._path:
            self.close()
            self._file, self._path = _open(path), path
        self._file.seek(at)
        return self._file.read(n)

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
        self._path = self._file = None


def _located(path: str):
    """(file system, name) of a path."""
    from urllib.parse import unquote

    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:  # file:/x and file:///x alike
        return fs.LocalFileSystem(), unquote("/" + path.removeprefix("file:").lstrip("/"))
    scheme, rest = path.split("://", 1)
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def _open(path: str):
    system, name = _located(path)
    return system.open_input_file(name)


def open_output(path: str):
    """A new file, its folders made where needed."""
    system, name = _located(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(name)


class Lines:
    """Writes text files one after another, each under a hidden name until it is whole."""

    def __init__(self):
        import uuid

        self._made, self._path, self._end = set(), None, f".{uuid.uuid4().hex}"

    def write(self, path: str, head: str, lines: list[str]) -> None:
        """Adds ``lines`` to the open file, or to a new one that starts with ``head``."""
        if path != self._path:
            self.close()
            system, name = _located(path)
            folder, own = name.rsplit("/", 1)
            if folder not in self._made:
                system.create_dir(folder, recursive=True)
                self._made.add(folder)
            self._path, self._place = path, (system, f"{folder}/.{own}{self._end}", name)
            self._file = system.open_output_stream(self._place[1])
            self._file.write(head.encode() + b"\n")
        self._file.write("".join(f"{x}\n" for x in lines).encode())

    def close(self) -> None:
        if self._path is not None:
            self._file.close()
            system, hidden, name = self._place
            system.move(hidden, name)
        self._path = None
