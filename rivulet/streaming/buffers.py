"""Window buffers of configured streams.

Micro-batches are staged as files beside the checkpoint until their window closes, by the clock or by the number of rows; the
window's files are then one batch. No row goes through the driver or a state store. After a restart what is staged is still
there, and a window that was being processed comes again: delivery is at least once.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rivulet.errors import ConfigError
from rivulet.operators.numbering import numbered
from rivulet.operators.windows import seconds, window_numbers

#: Buffers by type.
KINDS = ("memory", "session_window", "sliding_window", "tumbling_window")


@dataclass
class Staged:
    """One micro-batch's files."""

    path: str
    rows: int
    at: float


class Buffer:
    """Stages micro-batches and gives each window that closes to `work`.

    memory: a window closes at `capacity` rows, or `timeout` after its first ones came. tumbling_window: every `interval`.
    session_window: when no rows came for `gap`. sliding_window: at `window_size` rows, the next one begins `slide_size` rows on;
    rows come once for each window, with its number in window_no.
    """

    def __init__(self, spark: SparkSession, folder: str, config: dict, work: Callable[[DataFrame], None], now: Callable[[], float] = time.monotonic):
        check(config)
        self.spark, self.folder, self.config, self.work, self.now = spark, folder.rstrip("/"), config, work, now
        self.lock, self.begun, self.windows = threading.RLock(), now(), 0
        self.staged = [Staged(path, spark.read.parquet(path).count(), now()) for path in self._found()]

    def length(self, name: str) -> float | None:
        return seconds(str(self.config[name])) if self.config.get(name) is not None else None

    def step(self) -> float:
        """Seconds between looks at the clock."""
        spans = [x for x in map(self.length, ("interval", "gap", "timeout")) if x]
        return min([1.0, *(x / 4 for x in spans)])

    def add(self, batch: DataFrame, number: int) -> None:
        """Stage a micro-batch; one that comes again takes its own place."""
        with self.lock:
            path = f"{self.folder}/batch-{number:012d}"
            ordered = batch.withColumns({"_batch": F.lit(number).cast("bigint"), "_row": F.monotonically_increasing_id()})
            ordered.write.mode("overwrite").parquet(path)
            rows = self.spark.read.parquet(path).count()
            self.staged = [s for s in self.staged if s.path != path]
            if rows:
                self.staged.append(Staged(path, rows, self.now()))
            self.tick()

    def tick(self) -> None:
        """Close what is due."""
        with self.lock:
            kind, now = self.config.get("type", "memory"), self.now()
            if kind == "tumbling_window":
                interval = self.length("interval")
                due = now - self.begun >= interval
                if due:
                    self.begun += interval * int((now - self.begun) / interval)
            elif not self.staged:
                due = False
            elif kind == "session_window":
                due = now - self.staged[-1].at >= self.length("gap")
            elif kind == "sliding_window":
                due = sum(s.rows for s in self.staged) >= int(self.config["window_size"])
            else:
                full, late = self.config.get("capacity"), self.length("timeout")
                due = (full is not None and sum(s.rows for s in self.staged) >= int(full)) or (late is not None and now - self.staged[0].at >= late)
            if due and self.staged:
                self.close()

    def close(self) -> None:
        """Process the staged rows as a window, or, of a sliding one, as all full windows."""
        with self.lock:
            if not self.staged:
                return
            done, self.staged = self.staged, []
            rows = self.spark.read.parquet(*[s.path for s in done])
            if self.config.get("type") == "sliding_window":
                self._slide(rows, done)
            else:
                self.work(rows.drop("_batch", "_row"))
            for s in done:
                if s not in self.staged:
                    self._path(s.path)[0].delete(self._path(s.path)[1], True)

    def _slide(self, rows: DataFrame, done: list[Staged]) -> None:
        size, slide = int(self.config["window_size"]), int(self.config["slide_size"])
        rows, total = numbered(rows, ["_batch", "_row"], "_rn")
        full = max(0, (total - size) // slide + 1)
        if not full:
            self.staged = done
            return
        inside = window_numbers(rows, total, size, slide).withColumn("window_no", F.col("window_no") + self.windows)
        self.work(inside.drop("_batch", "_row", "_rn"))
        self.windows += full
        rest = f"{self.folder}/rest-{self.windows:012d}"
        rows.where(F.col("_rn") >= full * slide).drop("_rn").write.mode("overwrite").parquet(rest)
        if total > full * slide:
            self.staged = [Staged(rest, total - full * slide, done[-1].at)]

    def _path(self, path: str) -> tuple[object, object]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _found(self) -> list[str]:
        """Folders that were staged before: the rest of a sliding window, then micro-batches. Those that weren't finished come again."""
        store, folder = self._path(self.folder)
        if not store.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in store.listStatus(folder))
        rest = [n for n in names if n.startswith("rest-")][-1:]
        self.windows = int(rest[0].removeprefix("rest-")) if rest else 0
        names = rest + [n for n in names if n.startswith("batch-")]
        return [f"{self.folder}/{n}" for n in names if store.exists(self._path(f"{self.folder}/{n}/_SUCCESS")[1])]


def check(config: dict) -> None:
    """The configuration of a buffer."""
    kind = config.get("type", "memory")
    if kind not in KINDS:
        raise ConfigError(f"unknown buffer {kind!r}")
    needs = {"memory": (), "tumbling_window": ("interval",), "session_window": ("gap",), "sliding_window": ("window_size", "slide_size")}[kind]
    if missing := [n for n in needs if config.get(n) is None]:
        raise ConfigError(f"a {kind} needs {', '.join(missing)}")
    if config.get("join") and kind not in ("tumbling_window", "session_window"):
        raise ConfigError(f"a {kind} has no join")
    for name in ("interval", "gap", "timeout"):
        if config.get(name) is not None:
            seconds(str(config[name]))
    for name in ("capacity", "window_size", "slide_size"):
        if config.get(name) is not None and int(config[name]) <= 0:
            raise ConfigError(f"{name} must be over 0")
    if kind == "sliding_window" and int(config["window_size"]) < int(config["slide_size"]):
        raise ConfigError("window_size must be at least slide_size")


class BufferedQuery:
    """A running query with a buffer. Looks at the clock until the query ends; a bounded replay closes its last window then."""

    def __init__(self, query: StreamingQuery, buffer: Buffer, once: bool):
        self.query, self.buffer, self.once, self.error = query, buffer, once, None
        self.ended = threading.Event()
        self.clock = threading.Thread(target=self._run, daemon=True)
        self.clock.start()

    def _run(self) -> None:
        try:
            while not self.ended.wait(self.buffer.step()) and self.query.isActive:
                self.buffer.tick()
        except Exception as e:  # noqa: BLE001  it is raised to whoever waits for the query
            self.error = e
            self.query.stop()

    def __getattr__(self, name: str) -> object:
        return getattr(self.query, name)

    def _finish(self) -> None:
        self.ended.set()
        self.clock.join()
        if self.error:
            raise self.error

    def awaitTermination(self, timeout: int | None = None) -> bool | None:  # noqa: N802  the query's own name
        ended = self.query.awaitTermination(timeout) if timeout is not None else self.query.awaitTermination()
        if ended or timeout is None:
            self._finish()
            if self.once:
                self.buffer.close()
        return ended

    def stop(self) -> None:
        """What is staged stays for the next start."""
        self.query.stop()
        self._finish()
