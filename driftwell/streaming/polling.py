"""A streaming source that looks at stored logs again and again.

A log is a small JSON file of the newest events that its owner replaces as a whole (``sources.json_files``), so offsets
cannot be places in a file: they are keys of events.  One source reads all logs that a pattern names; its offset has, for
each log, the key of the last event seen.  Register ``LogSource`` and read it with ``format("driftwell_log")``:

- ``path``: a pattern of files or folders; the files of a folder are one log, in order of their names.
- ``startingOffsets``: ``latest`` (as a watcher's first run, nothing old is shown) or ``earliest``.
- ``machine``: events of this machine are left out.

A log whose last key is gone was cut or replaced: all of it comes again, so no event is lost and some may come twice
(``feed.follow`` drops those).  A log that cannot be read at one look keeps its key and is read at a later one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "log string, ord bigint, user string, machine string, action string, ts timestamp_ntz, files array<string>, project string"
#: The key of a log that was seen without events: whatever it holds later is new.
EMPTY = "none"


def _glob(path: str) -> list[tuple[str, list[str]]]:
    """(log, its files) for each log that a pattern names, on any file system that pyarrow reaches."""
    import fnmatch

    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    parts = at.split("/")
    fixed = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[")), len(parts))
    level = ["/".join(parts[:fixed]) or "/"]
    for pattern in parts[fixed:]:
        level = [f.path for d in level for f in system.get_file_info(fs.FileSelector(d, allow_not_found=True)) if fnmatch.fnmatchcase(f.base_name, pattern)]
    out = []
    for f in system.get_file_info(sorted(level)):
        if f.type == fs.FileType.Directory:
            inner = [x.path for x in system.get_file_info(fs.FileSelector(f.path)) if x.type == fs.FileType.File and x.base_name[0] not in "._"]
            out.append((f.path, sorted(inner)))
        elif f.type == fs.FileType.File:
            out.append((f.path, [f.path]))
    return out


def _events(path: str, files: list[str]) -> list[dict]:
    """A log's events; raises where a file cannot be read or is no log."""
    from pyarrow import fs

    system, _ = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    found: list[dict] = []
    for name in files:
        with system.open_input_stream(name) as f:
            found += [e for e in json.loads(f.read().decode() or "{}").get("events", []) if isinstance(e, dict)]
    return found


def _time(value: object) -> datetime | None:
    try:
        return datetime.fromisoformat(str(value)).replace(tzinfo=None)
    except ValueError:
        return None


def key_of(event: dict) -> str:
    """What tells an event from others: time, user, machine and files, as a digest of fixed size."""
    cells = [event.get("timestamp"), event.get("user"), event.get("machine"), event.get("files")]
    return hashlib.sha256(json.dumps(cells, sort_keys=True).encode()).hexdigest()


class LogSource(DataSource):
    """See the module's text."""

    @classmethod
    def name(cls) -> str:
        return "driftwell_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(self.options)


class _Part(InputPartition):
    def __init__(self, log: str, files: list[str], after: str | None, until: str):
        self.log, self.files, self.after, self.until = log, files, after, until


def between(events: list[dict], after: str | None, until: str) -> list[tuple[int, dict]]:
    """(place, event) of what stands behind the first event of key ``after``, up to the last one of key ``until``; a key that is not there is no bound."""
    keys = [key_of(e) for e in events]
    first = keys.index(after) + 1 if after in keys else 0
    ends = [i for i, k in enumerate(keys) if k == until and i >= first]
    return [*enumerate(events)][first : ends[-1] + 1 if ends else len(events)]


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.machine = options["path"], options.get("machine")
        self.earliest = options.get("startingOffsets", "latest") == "earliest"
        self.known: dict[str, str] = {}

    def _look(self) -> dict[str, str]:
        """The last key of each log; one that cannot be read keeps the key it had."""
        found = {}
        for log, files in _glob(self.path):
            try:
                events = _events(self.path, files)
            except Exception:  # noqa: BLE001  whatever is wrong with one look may be right at the next
                if log in self.known:
                    found[log] = self.known[log]
                continue
            found[log] = key_of(events[-1]) if events else EMPTY
        return self.known | found

    def initialOffset(self) -> dict:  # noqa: N802
        return {} if self.earliest else self._look()

    def latestOffset(self) -> dict:  # noqa: N802
        self.known = self._look()
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = dict(_glob(self.path))
        self.known = start | end | self.known
        parts = [_Part(log, files[log], start.get(log), key) for log, key in end.items() if start.get(log) != key and log in files]
        return parts

    def read(self, partition: _Part) -> Iterator[tuple]:
        for place, e in between(_events(self.path, partition.files), partition.after, partition.until):
            if self.machine is None or e.get("machine") != self.machine:
                names = e.get("files")
                yield (
                    partition.log, place, e.get("user"), e.get("machine"), e.get("action"), _time(e.get("timestamp")),
                    [str(f) for f in names] if isinstance(names, list) else [], e.get("project"),
                )
