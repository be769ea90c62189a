"""Watching a tree: a streaming source of file events, and their flush after quiet time by keyed state.

:class:`FileEvents` is a streaming data source that compares listings of a
folder.  An offset names a listing that is kept in a shared folder, so a batch
can be read again after a restart: no event is lost or comes twice.

:func:`quiet_actions` keeps one small state a path, the action that its changes
come to so far, and a timer; the action is given out once the path has been
quiet for a while, by processing time and without a watermark.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor

from ..functions import schema as S
from . import debounce

EVENT = "path string, kind string, ts timestamp"
ACTION = "path string, kind string, last_seen timestamp"


def merged(so_far: str | None, kind: str) -> str | None:
    """What an action and a further change of its path come to, None for nothing; as :func:`debounce.coalesced`."""
    if so_far == "create" and kind in ("modify", "remove"):
        return "create" if kind == "modify" else None
    return "modify" if (so_far, kind) == ("remove", "create") else kind


class Listings(SimpleDataSourceStreamReader):
    """Differences of listings of ``root``; listings are kept in ``state``, one file an offset."""

    def __init__(self, root: str, state: str):
        self.root, self.state = root, state

    def _kept(self, number: int) -> str:
        return os.path.join(self.state, f"listing-{number}.json")

    def _load(self, number: int) -> dict:
        if number == 0:
            return {}
        with open(self._kept(number)) as f:
            return json.load(f)

    def _now(self) -> dict:
        """Size and time of every file below the root; excluded folders and links are not entered."""
        found = {}
        for folder, dirs, names in os.walk(self.root):
            dirs[:] = [d for d in dirs if d not in S.EXCLUDED_DIRS]
            for name in names:
                full = os.path.join(folder, name)
                if not os.path.islink(full):
                    try:
                        s = os.stat(full)
                    except FileNotFoundError:  # gone since it was listed
                        continue
                    found[os.path.relpath(full, self.root).replace(os.sep, "/")] = [s.st_size, s.st_mtime_ns]
        return found

    @staticmethod
    def _events(before: dict, after: dict, at: float):
        import datetime

        ts = datetime.datetime.fromtimestamp(at, datetime.UTC)
        kind = lambda path: "create" if path not in before else "remove" if path not in after else "modify"
        return iter([(path, kind(path), ts) for path in sorted(before.keys() | after.keys()) if before.get(path) != after.get(path)])  # Spark copies it

    def initialOffset(self) -> dict:
        return {"listing": 0, "at": 0}

    def read(self, start: dict):
        import time

        os.makedirs(self.state, exist_ok=True)
        before, after = self._load(start["listing"]), self._now()
        if before == after:
            return iter([]), start
        end = {"listing": start["listing"] + 1, "at": time.time()}
        with open(self._kept(end["listing"]) + ".new", "w") as f:
            json.dump(after, f)
        os.replace(self._kept(end["listing"]) + ".new", self._kept(end["listing"]))
        return self._events(before, after, end["at"]), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return self._events(self._load(start["listing"]), self._load(end["listing"]), end["at"])

    def commit(self, end: dict) -> None:
        """Listings before the committed one are not read again."""
        for number in range(end["listing"] - 1, 0, -1):
            if not os.path.exists(self._kept(number)):
                break
            os.remove(self._kept(number))


class FileEvents(DataSource):
    """``spark.readStream.format("file_events").option("root", ...).option("state", ...)``: (path, kind, ts)."""

    @classmethod
    def name(cls) -> str:
        return "file_events"

    def schema(self) -> str:
        return EVENT

    def simpleStreamReader(self, schema) -> Listings:
        return Listings(self.options["root"], self.options["state"])


def watched(spark: SparkSession, root: str, state: str) -> DataFrame:
    """Stream of (path, kind, ts) of a tree, without excluded paths (editors' and tools' files among them)."""
    spark.dataSource.register(FileEvents)
    events = spark.readStream.format("file_events").option("root", root).option("state", state).load()
    return events.where(~S.excluded(F.col("path")))


class Quiet(StatefulProcessor):
    """One path's pending action; its timer is set anew by every change."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "kind string, last_seen timestamp")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        kind, last = self.pending.get() if self.pending.exists() else (None, None)
        changes = pd.concat(list(rows)).sort_values("ts", kind="stable")
        for k, ts in zip(changes["kind"], changes["ts"], strict=True):
            kind, last = merged(kind, k), ts
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kind is None:
            self.pending.clear()
        else:
            self.pending.update((kind, last.to_pydatetime() if hasattr(last, "to_pydatetime") else last))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        if self.pending.exists():
            kind, last = self.pending.get()
            self.pending.clear()
            yield pd.DataFrame({"path": [key[0]], "kind": [kind], "last_seen": [last]})

    def close(self) -> None:
        pass


def quiet_actions(changes: DataFrame, quiet_ms: int = 100) -> DataFrame:
    """Stream of (path, kind, last_seen): what each path's changes (path, kind, ts) come to once it has been quiet.

    The session needs the RocksDB state store.  Pairs of renames are made of what
    one flush gives out (:func:`debounce.renames`), over all paths.
    """
    return changes.groupBy("path").transformWithStateInPandas(Quiet(quiet_ms), ACTION, "Update", "ProcessingTime")


def flushed(batch: DataFrame) -> DataFrame:
    """(kind, path, old_path) of one flush of :func:`quiet_actions`, for ``foreachBatch``."""
    return debounce.renames(batch)
