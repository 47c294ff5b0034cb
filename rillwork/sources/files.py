"""Files in any store, by ranges of bytes; and the bounds that filters push down to sources of grids."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

#: Readers that take filters raise an error in Spark unless this is set.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def store(place: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a path or URI."""
    if place.startswith("file:"):
        return fs.LocalFileSystem(), "/" + place.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), place) if place.startswith("/") else fs.FileSystem.from_uri(place)


def listed(place: str, suffixes: Sequence[str] = ("",)) -> list[str]:
    """Paths of the files at ``place`` (a file, or a folder at any depth) that end so, sorted; hidden ones are left out."""
    files, path = store(place)
    info = files.get_file_info(path)
    if info.type == fs.FileType.File:
        return [place]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(place)
    root = place.rstrip("/")
    found = (i.path for i in files.get_file_info(fs.FileSelector(path, recursive=True)) if i.type == fs.FileType.File)
    inner = (p[len(path.rstrip("/")) + 1 :] for p in found)
    return sorted(f"{root}/{p}" for p in inner if p.endswith(tuple(suffixes)) and not any(part.startswith(("_", ".")) for part in p.split("/")))


class Ranges:
    """Bytes of an open file; counts what is read."""

    def __init__(self, file, size: int):
        self.file, self.size, self.taken = file, size, 0

    def __call__(self, start: int, n: int) -> bytes:
        n = max(0, min(n, self.size - start))
        self.taken += n
        return self.file.read_at(n, start) if n else b""


@contextmanager
def ranges(place: str) -> Iterator[Ranges]:
    files, path = store(place)
    with files.open_input_file(path) as file:
        yield Ranges(file, file.size())


def stage(folder: str, chunks: Iterable[bytes]) -> tuple[str, int]:
    """Writes a new hidden file in ``folder``: its path and size. A reader doesn't see it until it is published."""
    files, path = store(folder)
    files.create_dir(f"{path}/_staging", recursive=True)
    name, size = f"_staging/{uuid.uuid4().hex}", 0
    with files.open_output_stream(f"{path}/{name}") as out:
        for chunk in chunks:
            size += len(chunk)
            out.write(chunk)
    return f"{folder.rstrip('/')}/{name}", size


def publish(staged: str, place: str) -> None:
    """Moves a staged file to its name, in place of what was there."""
    files, path = store(place)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    files.move(store(staged)[1], path)


def remove(places: Iterable[str]) -> None:
    for place in places:
        files, path = store(place)
        if files.get_file_info(path).type == fs.FileType.File:
            files.delete_file(path)


class Bounds:
    """Closed ranges of columns, narrowed by options ``<column>_min`` and ``<column>_max`` and by pushed filters.

    A range may hold more than its filters do, so Spark still evaluates them.
    """

    def __init__(self, columns: Sequence[str], options: dict[str, str], parse=float):
        self.columns = tuple(columns)
        self.low = {c: parse(options[f"{c}_min"]) for c in columns if f"{c}_min" in options}
        self.high = {c: parse(options[f"{c}_max"]) for c in columns if f"{c}_max" in options}

    def narrow(self, f: Filter) -> None:
        column = getattr(f, "attribute", ("",))
        if len(column) != 1 or column[0] not in self.columns or getattr(f, "value", None) is None:
            return
        c, v = column[0], f.value
        if isinstance(f, In):
            v = [x for x in v if x is not None]
            if v:
                self._within(c, min(v), max(v))
        elif isinstance(f, EqualTo):
            self._within(c, v, v)
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self._within(c, v, None)
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self._within(c, None, v)

    def _within(self, c: str, low, high) -> None:
        if low is not None:
            self.low[c] = max(self.low.get(c, low), low)
        if high is not None:
            self.high[c] = min(self.high.get(c, high), high)

    def holds(self, c: str, least, most) -> bool:
        """Whether any value from ``least`` to ``most`` is within."""
        return not (c in self.low and most < self.low[c]) and not (c in self.high and least > self.high[c])
