"""A streaming source that follows one growing log file, as ``tail -F`` does.

Spark's file source sees new files, not appended bytes. The offset is (inode, byte, seq);
a replaced or truncated file is read from its start, a missing one is waited for, and an
unfinished last line stays for the next batch. Lines are split at line feeds only and cut
to ``max_line`` bytes; blank ones are skipped and take no sequence number. ``raw`` is binary, so that
bytes that are no UTF-8 reach the sanitiser.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class TailSource(DataSource):
    """``spark.dataSource.register(TailSource)``; options path, from_start, max_line, max_bytes (of one batch)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "seq bigint, raw binary"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return TailReader(self.options)


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.most = int(options.get("max_line", "8192"))
        self.batch = int(options.get("max_bytes", str(16 << 20)))
        self.from_start = options.get("from_start", "true").lower() == "true"

    def initialOffset(self) -> dict:
        if self.from_start or not os.path.exists(self.path):
            return {"inode": 0, "byte": 0, "seq": 0}
        st = os.stat(self.path)
        return {"inode": st.st_ino, "byte": st.st_size, "seq": 0}

    def _scan(self, start: dict, stop: dict | None) -> tuple[list[tuple[int, bytes]], dict]:
        try:
            f = open(self.path, "rb")
        except FileNotFoundError:
            return [], start
        with f:
            st = os.fstat(f.fileno())
            at, seq = start["byte"], start["seq"]
            if (start["inode"] and st.st_ino != start["inode"]) or st.st_size < at:
                at = 0
            f.seek(at)
            room = self.batch if stop is None or stop["byte"] < at else stop["byte"] - at
            data = f.read(room)
            end = data.rfind(b"\n") + 1
            if not end and len(data) == room == self.batch:
                # a line longer than a batch: its head counts, the rest is skipped to its end
                tail = f.readline()
                end, data = len(data) + len(tail), data + tail
            rows = []
            for line in data[:end].split(b"\n")[:-1]:
                line = line.rstrip(b"\r")
                if line.strip():
                    rows.append((seq, line[: self.most]))
                    seq += 1
            return rows, {"inode": st.st_ino, "byte": at + end, "seq": seq}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._scan(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._scan(start, end)[0])

    def commit(self, end: dict) -> None:
        pass
