"""Files written by many tasks at once: rows say which bytes go where.

A piece is (path, start, at, data, last). Tasks write pieces at their places,
in any order and as often as they are repeated: the bytes of a place are fixed
before the first one is written. `start` is the length of the file that is
changed; where it is 0, the file is new, is written beside its place and moved
there by the commit. Pieces marked `last` are kept back for the commit, which
writes them after all others: pointers that bring new parts to life. A last
piece without data ends the file at `at`.

If the job fails, new files vanish and extended ones get their old length; they
were never linked, so no reader saw them. What a task sends to the driver are
the paths that it touched and its last pieces.
"""

from __future__ import annotations

import contextlib
import glob
import os
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

PIECES = "path string, start bigint, at bigint, data binary, last boolean"
COLUMNS = ["path", "start", "at", "data", "last"]
#: Files that a task keeps open.
OPEN = 16


@dataclass
class Touched(WriterCommitMessage):
    """What one task wrote: path to old length, and the pieces left to the commit."""

    starts: dict[str, int]
    last: list[tuple[str, int, bytes | None]]


def put(fd: int, at: int, data: bytes) -> None:
    view = memoryview(data)
    while view:
        done = os.pwrite(fd, view, at)
        at, view = at + done, view[done:]


class PositionedWriter(DataSourceArrowWriter):
    """Writes pieces to files in `folder`; without `overwrite` no file is replaced, but files can be extended."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder.removeprefix("file:"), overwrite, uuid.uuid4().hex

    def target(self, path: str) -> str:
        return os.path.join(self.folder, path.removeprefix("file:"))

    def place(self, path: str, start: int) -> str:
        """Where the bytes go until the commit."""
        return self.target(path) if start else f"{self.target(path)}.{self.job}.part"

    def write(self, iterator) -> Touched:
        starts: dict[str, int] = {}
        last: list[tuple[str, int, bytes | None]] = []
        opened: dict[str, int] = {}
        try:
            for batch in iterator:
                for path, start, at, data, held in zip(*(batch.column(n) for n in COLUMNS), strict=True):
                    path, start = path.as_py(), start.as_py()
                    if path not in starts:
                        if not start:
                            if not self.overwrite and os.path.exists(self.target(path)):
                                raise FileExistsError(self.target(path))
                            os.makedirs(os.path.dirname(self.target(path)) or ".", exist_ok=True)
                        starts[path] = start
                    if held.as_py():
                        last.append((path, at.as_py(), data.as_py()))
                        continue
                    if path not in opened:
                        if len(opened) == OPEN:
                            self.close(opened, next(iter(opened)))
                        opened[path] = os.open(self.place(path, start), os.O_RDWR | (0 if start else os.O_CREAT), 0o666)
                    put(opened[path], at.as_py(), data.as_buffer())
        finally:
            for path in list(opened):
                self.close(opened, path)
        return Touched(starts, last)

    @staticmethod
    def close(opened: dict[str, int], path: str) -> None:
        fd = opened.pop(path)
        try:
            os.fsync(fd)
        finally:
            os.close(fd)

    def commit(self, messages) -> None:
        done = [m for m in messages if m is not None]
        starts = {p: s for m in done for p, s in m.starts.items()}
        for ends in (False, True):
            for path, at, data in (x for m in done for x in m.last):
                if (data is None) == ends:
                    with open(self.place(path, starts[path]), "r+b") as f:
                        if ends:
                            f.truncate(at)
                        else:
                            f.seek(at)
                            f.write(data)
        for path, start in starts.items():
            if not start:
                os.replace(self.place(path, start), self.target(path))

    def abort(self, messages) -> None:
        starts = {p: s for m in messages if m is not None for p, s in m.starts.items()}
        for path, start in starts.items():
            if start:
                with contextlib.suppress(OSError):
                    os.truncate(self.target(path), start)
        # parts of a task that failed lie beside those of others, or below the folder of the job
        below = self.folder.rstrip("/")
        patterns = [f"{glob.escape(os.path.dirname(self.target(p)))}/*" for p in starts] + ([f"{glob.escape(below)}/**/*"] if below else [])
        for left in {f for x in patterns for f in glob.glob(f"{x}.{self.job}.part", recursive=True)}:
            with contextlib.suppress(OSError):
                os.remove(left)
