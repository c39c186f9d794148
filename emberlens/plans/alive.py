"""Signs of life of what is being written, by which those who open a warehouse know what broke off."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Seconds between two signs, and without one until a run counts as broken off.
PERIOD, LEASE = 30.0, 600.0


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def touch(spark: SparkSession, path: str) -> int:
    """Writes an empty file and returns the milliseconds at which its store says that was."""
    place, fs = _store(spark, path)
    fs.create(place, True).close()
    return fs.getFileStatus(place).getModificationTime()


def listed(spark: SparkSession, path: str) -> dict[str, int]:
    """Names in a folder and when they were changed; none where there is no folder."""
    place, fs = _store(spark, path)
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(place)} if fs.exists(place) else {}


def delete(spark: SparkSession, path: str) -> None:
    place, fs = _store(spark, path)
    fs.delete(place, True)


@contextmanager
def alive(spark: SparkSession, warehouse: str, run: str, period: float = PERIOD) -> Iterator[None]:
    """While the block runs, ``_alive/<run>`` is written every ``period`` seconds; it goes with the block's end. A driver that is
    killed leaves its last sign, which grows old."""
    sign, ended = f"{warehouse}/_alive/{run}", threading.Event()
    touch(spark, sign)

    def beat() -> None:
        while not ended.wait(period):
            touch(spark, sign)

    thread = threading.Thread(target=beat, daemon=True)
    thread.start()
    try:
        yield
    finally:
        ended.set()
        thread.join()
        delete(spark, sign)


class Living:
    """The runs that have given a sign within ``lease`` seconds, and the store's time, against which folders' ages are told: clocks
    of other machines don't count."""

    def __init__(self, spark: SparkSession, warehouse: str, lease: float = LEASE):
        probe = f"{warehouse}/_alive/_{uuid.uuid4().hex}"
        now = touch(spark, probe)
        delete(spark, probe)
        self.since = now - int(lease * 1000)
        self.signs = {name: at for name, at in listed(spark, f"{warehouse}/_alive").items() if not name.startswith("_")}

    def has(self, run: str, changed: int = 0) -> bool:
        """Whether the run lives; one that has given no sign is judged by when its folder was ``changed``."""
        return max(self.signs.get(run, 0), changed) > self.since

    def gone(self) -> list[str]:
        return sorted(run for run, at in self.signs.items() if at <= self.since)
