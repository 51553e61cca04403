"""Live progress of a run: a line for each stage, its tasks counted by Spark's own status tracker while they run."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import SparkSession

from infotraj.plans import reports


class Progress:
    """A file of one line a stage: name, state, start, seconds a task, seconds so far, tasks done and known, percent, seconds left.

    Each stage is a job group; a thread looks every `interval` seconds at the tasks of the group's jobs and writes the file anew.
    Tasks become known as Spark submits their stages, so the number known grows while a stage runs.
    """

    def __init__(self, spark: SparkSession, path: str, stages: Sequence[str], interval: float = 1.0, overwrite: bool = False):
        self.spark, self.path, self.interval = spark, path, interval
        self.group = {name: f"{name}-{uuid4().hex}" for name in stages}
        self.began: dict[str, float] = {}
        self.ended: dict[str, float] = {}
        self.failed: set[str] = set()
        self.counts: dict[str, tuple[int, int]] = dict.fromkeys(stages, (0, 0))
        self.stop, self.lock = threading.Event(), threading.Lock()
        reports.write_file(spark, path, self.lines(), overwrite)

    def count(self) -> None:
        tracker = self.spark.sparkContext.statusTracker()
        for name, group in self.group.items():
            if name in self.began and name not in self.ended:
                done = known = 0
                for job in tracker.getJobIdsForGroup(group):
                    for stage in getattr(tracker.getJobInfo(job), "stageIds", None) or ():
                        if info := tracker.getStageInfo(stage):
                            done, known = done + info.numCompletedTasks, known + info.numTasks
                before = self.counts[name]  # what Spark has forgotten stays counted
                self.counts[name] = max(before[0], done), max(before[1], known)

    def lines(self) -> list[str]:
        out = []
        for name, (done, known) in self.counts.items():
            if name not in self.began:
                out.append(f"{name:<12}{'Waiting':>10}")
                continue
            took = self.ended.get(name, time.time()) - self.began[name]
            state = "Failed" if name in self.failed else "Completed" if name in self.ended else "Running"
            each = took / done if done else 0.0
            start = time.strftime("%Y-%m-%d %H:%M:%S", time.localtime(self.began[name]))
            left = 0.0 if name in self.ended else each * (known - done)
            out.append(f"{name:<12}{state:>10} {start}{each:12.3f} s{took:12.3f} s{done:12}{known:12}{100 * done / known if known else 100:8.2f}{left:12.0f} s")
        return out

    def write(self) -> None:
        with self.lock:
            self.count()
            reports.write_file(self.spark, self.path, self.lines(), True)

    def _watch(self) -> None:
        while not self.stop.wait(self.interval):
            self.write()

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        """Jobs of this thread inside belong to the stage."""
        context = self.spark.sparkContext
        self.began[name] = time.time()
        context.setJobGroup(self.group[name], name)
        self.stop.clear()
        watch = threading.Thread(target=self._watch, daemon=True)
        watch.start()
        try:
            yield
        except BaseException:
            self.failed.add(name)
            raise
        finally:
            self.stop.set()
            watch.join()
            self.count()
            if name not in self.failed:
                self.counts[name] = (self.counts[name][0],) * 2  # stages that Spark knew of and could skip count no more
            self.ended[name] = time.time()
            for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                context.setLocalProperty(key, None)
            self.write()
