"""Lines appended to files that grow in place, as a stream.

A Python streaming data source.  The offset holds, per file, the byte position
after the last complete line and a fingerprint of the file's head; each
micro-batch reads the bytes between two offsets, so a restart from the
checkpoint reads only new ones.  A range is cut into splits of ``SPLIT`` bytes, each
read in blocks by its own task: a split owns the lines that start in it.  Lines end in
``\\n``, ``\\r`` or ``\\r\\n``; a last line without an end waits for it (quirk
Q11: the reference emits it as it is), and so does one that ends in ``\\r`` at the
end of the file.  A file that is shorter than its offset, or whose head is another
than the fingerprint says (O08), was rewritten and is read again from 0.

A file is known by its identity on the file system, not by its name.  One that was renamed between the offset and the read
is read under its new name; one whose name is gone or was given to another file (rotation) is read to its end in the next
batch, wherever in the same folder it is now, and if the pattern matches its new name, on from its position.  Its lines keep the name
they were found under.  A file that was deleted is dropped from the offset with a warning, and doesn't stop the stream.

Each line comes with ``pos`` (its byte position), which is its order key.
The files must be on a file system that driver and executors mount.
"""

from __future__ import annotations

import glob
import hashlib
import logging
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("source", StringType()), StructField("pos", LongType()),
                     StructField("event_text", StringType())])
log = logging.getLogger("tidelog.growing")

HEAD = 1024
BLOCK = 1 << 20
SPLIT = 64 << 20


def _lines_end(path: str, size: int) -> int:
    """Position after the last complete line, reading backwards from the end."""
    with open(path, "rb") as fh:
        end = size
        while end > 0:
            start = max(0, end - BLOCK)
            fh.seek(start)
            buf = fh.read(end - start)
            if end == size:
                buf = buf.removesuffix(b"\r")      # may be the first half of a line end
            at = max(buf.rfind(b"\n"), buf.rfind(b"\r"))
            if at >= 0:
                return start + at + 1
            end = start
    return 0


def _head(path: str, length: int) -> str:
    with open(path, "rb") as fh:
        return hashlib.md5(fh.read(length)).hexdigest()


def _identity(path: str) -> str | None:
    try:
        st = os.stat(path)
    except OSError:
        return None
    return f"{st.st_dev}:{st.st_ino}"


def _where(path: str, identity: str | None) -> str | None:
    """Where the file that was found at ``path`` is now, in the same folder; None if it is gone."""
    if identity is None or _identity(path) == identity:
        return path if os.path.exists(path) else None
    try:
        with os.scandir(os.path.dirname(path) or ".") as entries:
            return next((e.path for e in entries if e.is_file() and _identity(e.path) == identity), None)
    except OSError:
        return None


def lines_between(path: str, start: int, end: int, whole_line: bool) -> Iterator[tuple[int, bytes]]:
    """``(position, line)`` of the lines that start in ``[start, end)``, read in blocks.

    Unless ``whole_line``, the first one may have begun before ``start`` and is left out."""
    with open(path, "rb") as fh:
        pos = start if whole_line else start - 1
        fh.seek(pos)
        skip, rest = not whole_line, b""
        while True:
            block = fh.read(BLOCK)
            parts = (rest + block).splitlines(keepends=True)
            rest = b""
            if parts and block and not parts[-1].endswith(b"\n"):
                rest = parts.pop()                 # not ended, or a line feed may follow
            for raw in parts:
                if pos >= end and not skip:
                    return
                if not skip:
                    yield pos, raw.removesuffix(b"\r\n") if raw.endswith(b"\r\n") else raw.removesuffix(b"\n").removesuffix(b"\r")
                skip = False
                pos += len(raw)
            if not block or (pos >= end and not skip):
                return


class _Range(InputPartition):
    def __init__(self, path: str, identity: str | None, start: int, end: int, whole_line: bool):
        self.path, self.identity, self.start, self.end, self.whole_line = path, identity, start, end, whole_line


class GrowingFilesReader(DataSourceStreamReader):
    """The offset: ``{path: [position, length of the head, its md5, identity]}`` (the identity is missing in old checkpoints)."""

    def __init__(self, pattern: str, split: int = SPLIT):
        self.pattern, self.split = pattern, split

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for p in sorted(glob.glob(self.pattern)):
            try:
                identity = _identity(p)
                end = _lines_end(p, os.path.getsize(p))
                head = _head(p, min(end, HEAD))
            except FileNotFoundError:
                continue
            if identity is not None and identity == _identity(p):   # else it was renamed meanwhile: in the next offset
                out[p] = [end, min(end, HEAD), head, identity]
        return out

    def partitions(self, start: dict, end: dict):
        before = {v[3]: (p, v) for p, v in start.items() if len(v) > 3}
        now = {v[3] for v in end.values() if len(v) > 3}
        wanted = []
        for p, (e, _, _, *identity) in sorted(end.items()):
            known = before.get(identity[0]) if identity else None
            known = known[1] if known else start.get(p) if len(start.get(p, [0] * 4)) == 3 else None
            wanted.append((p, identity[0] if identity else None, known, e))
        for identity, (p, v) in sorted(before.items()):
            if identity not in now:                                  # rotated away: to its end
                at = _where(p, identity)
                if at is None:
                    log.warning("%s is gone, read up to byte %d", p, v[0])
                else:
                    wanted.append((p, identity, v, _lines_end(at, os.path.getsize(at))))
        parts = []
        for p, identity, known, e in wanted:
            s, length, sign = known[:3] if known else (0, 0, "")
            at = _where(p, identity)
            if at is None:
                log.warning("%s is gone before it was read", p)
                continue
            if s and (e < s or _head(at, length) != sign):           # rewritten since
                s = 0
            parts += [_Range(p, identity, b, min(e, b + self.split), b == s) for b in range(s, e, self.split)]
        return parts

    def read(self, partition: _Range):
        at = _where(partition.path, partition.identity)
        if at is None:
            log.warning("%s is gone before it was read", partition.path)
            return
        for pos, raw in lines_between(at, partition.start, partition.end, partition.whole_line):
            yield (partition.path, pos, raw.decode("utf-8", "ignore"))

    def commit(self, end: dict) -> None:
        pass


class GrowingFilesSource(DataSource):
    """``spark.readStream.format("growing_lines").option("path", glob)``."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return GrowingFilesReader(self.options["path"], int(self.options.get("split", SPLIT)))


def register(spark) -> None:
    spark.dataSource.register(GrowingFilesSource)


def stream_growing_lines(spark, pattern: str, split: int = SPLIT):
    """Stream of ``(source, pos, event_text)`` for files matching ``pattern``."""
    register(spark)
    return spark.readStream.format("growing_lines").option("path", pattern).option("split", split).load()
