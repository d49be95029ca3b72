"""The activity log as a stream: following it, watching it once a run, and counting tries."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftwell.operators.log import after_cursor, others
from driftwell.operators.manifest import MOST_TRIES
from driftwell.sources.commits import Folder

#: What tells events apart for one who follows the log.
FOLLOW_KEY = ["ts", "user", "machine", "action"]
#: What tells events apart for one who watches it: a key of texts, the files joined.
WATCH_KEY = "struct(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") as ts, user, machine, array_join(files, '\\u001f') as files)"
EMPTY = ("", "", "", "")


def follow(log: DataFrame, late: str = "1 day") -> DataFrame:
    """A streaming log with each event once, though several looks at the log bring it again; keys are forgotten ``late`` behind the newest event."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(FOLLOW_KEY)


def tail_key(log: DataFrame) -> tuple[str, ...]:
    """The key of the last event by place, or ``EMPTY`` for an empty log."""
    last = log.agg(F.max_by(F.expr(WATCH_KEY), "ord").alias("k")).first()["k"]
    return tuple(x or "" for x in last) if last else EMPTY


def load_watermark(spark: SparkSession, path: str, name: str) -> tuple[str, ...] | None:
    """The stored key of a watcher; null on its first run, and where the newest mark cannot be read."""
    here = Folder(spark, path)
    try:
        key = json.loads(here.read(_marks(here, name)[-1]))
    except Exception:  # noqa: BLE001  a lost or damaged file starts the watcher anew
        return None
    return tuple(key) if isinstance(key, list) and len(key) == len(EMPTY) and all(isinstance(x, str) for x in key) else None


def save_watermark(spark: SparkSession, path: str, name: str, key: tuple[str, ...]) -> None:
    """Stores a key as a new mark and then deletes older ones, so that a crash leaves one of both."""
    here = Folder(spark, path)
    old = _marks(here, name)
    number = int(old[-1].rsplit(".", 1)[1]) + 1 if old else 0
    while not here.create(f"{_slug(name)}.{number:012d}", json.dumps(list(key))):
        number += 1
    for mark in old:
        here.delete(mark)


def _slug(name: str) -> str:
    return hashlib.sha256(name.encode()).hexdigest()[:32]


def _marks(here: Folder, name: str) -> list[str]:
    return [n for n in here.names() if re.fullmatch(rf"{_slug(name)}\.\d{{12}}", n)]


def watch_once(log: DataFrame, path: str, name: str, machine: str, handle: Callable[[DataFrame], None]) -> None:
    """Gives ``handle`` the events of other machines since the last run, which the stored key marks, and stores the new key last.

    If ``handle`` fails, or the run ends within it, the next run gives the events again.  The first run stores the log's end
    and gives nothing.  A run after one that found the log empty gives all of it, as does one whose key is no longer there
    (the log was cut): some events may come twice, none is lost.
    """
    spark, known = log.sparkSession, load_watermark(log.sparkSession, path, name)
    now = tail_key(log)  # before the events are read: what comes meanwhile is shown now and again, not lost
    if known is None:
        return save_watermark(spark, path, name, now)
    if now != known:
        handle(others(log if known == EMPTY else since_key(log, known), machine))
        if now != EMPTY:
            save_watermark(spark, path, name, now)
    return None


def since_key(log: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The events behind the first one with the key, or all."""
    k = F.expr(WATCH_KEY)
    keyed = log.select("*", *[F.coalesce(k[c], F.lit("")).alias(f"_{c}") for c in ("ts", "user", "machine", "files")])
    return after_cursor(keyed, **dict(zip(("_ts", "_user", "_machine", "_files"), key, strict=True))).select(*log.columns)


def attempts(outcomes: DataFrame, most: int = MOST_TRIES) -> DataFrame:
    """(rel_path, backend, ord, state, attempts): ``manifest.attempts`` over a stream of outcomes, by ``ord`` within a micro-batch.

    State is a count and a hash for each path and backend.  All of a key's rows of a batch are put in order together; rows
    out of order across batches count as they come (``attempts_in_order`` waits for them).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tries, content = state.get if state.exists else (0, "")
        rows = pd.concat(list(batches)).sort_values("ord", kind="stable")
        out, tries, content = _counted(key, rows[["ord", "state", "intended_hash"]].itertuples(index=False), tries, content, most)
        state.update((tries, content))
        yield out

    return outcomes.groupBy("rel_path", "backend").applyInPandasWithState(step, _TRIES, "attempts int, intended_hash string", "append", GroupStateTimeout.NoTimeout)


_TRIES = "rel_path string, backend string, ord bigint, state string, attempts bigint"


def _counted(key: tuple, rows: Iterable[tuple], tries: int, content: str, most: int) -> tuple[pd.DataFrame, int, str]:
    out = []
    for ord_, kind, hash_ in rows:
        hash_ = hash_ or ""
        tries = 0 if kind == "ok" else 1 if hash_ and hash_ != content else tries + 1
        content = hash_
        out.append((*key, ord_, "failed_perm" if kind == "pending_retry" and tries >= most else kind, tries))
    return pd.DataFrame(out, columns=[c.split(" ")[0] for c in _TRIES.split(", ")]), tries, content


class _InOrder(StatefulProcessor):
    """Holds a key's outcomes until the watermark has passed them, then counts them by time and ``ord``."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle) -> None:
        self.handle = handle
        self.tries = handle.getValueState("tries", "attempts int, content string")
        self.waiting = handle.getListState("waiting", "at bigint, ord bigint, state string, intended_hash string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        new = pd.concat(list(rows))
        at = (pd.to_datetime(new["ts"], utc=True).astype("int64") // 1000).tolist()
        names = [None if h is None or h != h else h for h in new["intended_hash"].tolist()]
        if not [*self.handle.listTimers()]:
            self.handle.registerTimer(min(at) // 1000 + 1)
        elif (first := min(at) // 1000 + 1) < (old := next(iter(self.handle.listTimers()))):
            self.handle.deleteTimer(old)
            self.handle.registerTimer(first)
        self.waiting.appendList(list(zip(at, new["ord"].tolist(), new["state"].tolist(), names)))
        yield pd.DataFrame(columns=[c.split(" ")[0] for c in _TRIES.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for r in self.waiting.get())
        due, later = [r for r in held if r[0] < passed], [r for r in held if r[0] >= passed]
        tries, content = self.tries.get() if self.tries.exists() else (0, "")
        out, tries, content = _counted(key, (r[1:] for r in due), tries, content, self.most)
        self.tries.update((tries, content))
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0] // 1000 + 1)
        yield out

    def close(self) -> None:
        return None


def attempts_in_order(outcomes: DataFrame, late: str = "10 minutes", most: int = MOST_TRIES) -> DataFrame:
    """``attempts`` for outcomes with a time (``ts``) that come in any order, within a batch and across batches.

    A key's outcomes wait in state until nothing older than ``late`` behind the newest can come, then count by time and
    ``ord``; the result is that of the batch operator over all of them, ``late`` behind.  Outcomes later than that are left
    out, as is one without a time.  Needs the RocksDB state store.
    """
    ordered = outcomes.where("ts is not null").withWatermark("ts", late).groupBy("rel_path", "backend")
    return ordered.transformWithStateInPandas(_InOrder(most), _TRIES, "Append", "EventTime")


def take_inbox(spark: SparkSession, path: str, handle: Callable[[DataFrame], None]) -> None:
    """Gives ``handle`` the lines (text) of an inbox that is a folder of JSON lines; once it has returned they are gone.

    The folder is moved to a name of its own first, so lines that come meanwhile stay for the next time.  What a run that
    failed had moved is given again by the next one, together with what came since.  One taker at a time: a second one would be
    given what the first is still reading.
    """
    above, _, name = path.rstrip("/").rpartition("/")
    here, moved = Folder(spark, above), f"{name}.taken-{uuid.uuid4().hex}"
    if here.exists(name):
        here.rename(name, moved)
    taken = [n for n in here.names() if n.startswith(f"{name}.taken-")]
    if taken:
        handle(spark.read.text([f"{above}/{n}" for n in taken]).select(F.col("value").alias("text")))
    for n in taken:
        here.delete(n)
