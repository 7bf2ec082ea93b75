"""Growing log files as a stream: a Python data source with exact offsets.

``spark.readStream.format("log_tail").option("path", glob).load()`` gives
``log_id, file_path, generation, line_no, raw``. The offset of a file is its byte position, line count and
generation; a file that shrank was replaced and starts a new generation at line 1. An
unterminated last line waits for its line feed.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

_ARCHIVED = re.compile(r"\.\d{8}-\d{6}(?:-\d+)?$")
MAX_BYTES = 32 * 1024 * 1024
COUNTED = 1 << 20


def identity_of(path: str) -> str:
    """Same as :func:`skirmish.sources.logs.log_identity` for one path."""
    stem = _ARCHIVED.sub("", re.sub(r"(?i)\.txt$", "", os.path.basename(path)))
    return re.sub(r"(?i)^eqlog_(?=[^_])", "", stem)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.latest = options.get("startingoffset", options.get("startingOffset", "earliest")) == "latest"
        self.bytes = int(options.get("maxbytespertrigger", options.get("maxBytesPerTrigger", MAX_BYTES)))

    def _files(self) -> list[str]:
        return sorted(glob.glob(self.path))

    def initialOffset(self) -> dict:  # noqa: N802
        if not self.latest:
            return {}
        out = {}
        for f in self._files():
            pos = end = lines = 0
            with open(f, "rb") as h:
                while data := h.read(COUNTED):
                    lines += data.count(b"\n")
                    last = data.rfind(b"\n")
                    end = pos + last + 1 if last >= 0 else end
                    pos += len(data)
            out[f] = [end, lines, 0]
        return out

    def _lines(self, f: str, at: list, until: int | None) -> tuple[list[tuple], list]:
        pos, line, gen = at
        size = os.path.getsize(f)
        if until is None and size < pos:
            pos, line, gen = 0, 0, gen + 1
        with open(f, "rb") as h:
            h.seek(pos)
            data = h.read((until - pos) if until is not None else self.bytes)
            if until is None:
                end = data.rfind(b"\n") + 1
                if not end and len(data) == self.bytes:  # one line longer than a batch
                    data += h.readline()
                    end = len(data) if data.endswith(b"\n") else 0
                data = data[:end]
        rows, log_id = [], identity_of(f)
        for raw in data.split(b"\n")[:-1]:
            line += 1
            text = raw.decode("utf-8-sig" if line == 1 else "utf-8", "replace")
            rows.append((log_id, f, gen, line, text.rstrip("\r")))
        return rows, [pos + len(data), line, gen]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], dict(start)
        for f in self._files():
            try:
                new, end[f] = self._lines(f, start.get(f, [0, 0, 0]), None)
            except FileNotFoundError:
                continue
            rows += new
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        rows = []
        for f, stop in end.items():
            at = start.get(f, [0, 0, 0])
            if at[2] != stop[2]:
                at = [0, 0, stop[2]]
            rows += self._lines(f, at, stop[0])[0]
        return iter(rows)


class LogTail(DataSource):
    """Options: ``path`` (glob), ``startingOffset`` (earliest, latest), ``maxBytesPerTrigger``."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "log_id string, file_path string, generation int, line_no int, raw string"

    def simpleStreamReader(self, schema) -> _Reader:  # noqa: N802
        return _Reader(self.options)


def register(spark) -> None:
    """Make ``log_tail`` known to a session."""
    spark.dataSource.register(LogTail)
