"""Progress of a run: counts taken in the same pass, and a line with rate and time left."""

from __future__ import annotations

import contextlib
import sys
import threading
import time

from pyspark import SparkContext


class Progress:
    """A line at most every ``every`` items, and one at the end."""

    def __init__(self, total: int, label: str = "  ", every: int = 50, stream=None, clock=time.monotonic):
        self.total, self.label, self.every, self.stream, self.clock = total, label, every, stream or sys.stderr, clock
        self.done, self.told, self.begun = 0, 0, clock()

    def line(self) -> str:
        """Items done, rate and minutes left."""
        rate = self.done / max(1e-6, self.clock() - self.begun)
        left = (self.total - self.done) / rate if rate else 0.0
        return f"{self.label}{self.done}/{self.total}  ({rate:.1f}/s, eta {left / 60:.1f} min)"

    def advance_to(self, done: int) -> None:
        """So many items are done; tasks that ran twice don't count beyond the total."""
        self.done = max(self.done, min(done, self.total))
        if self.done >= self.told + self.every or (self.done == self.total and self.told < self.total):
            self.told = self.done
            print(self.line(), file=self.stream)


@contextlib.contextmanager
def followed(sc: SparkContext, progress: Progress | None, seconds: float = 1.0):
    """An accumulator for tasks to count items in; while the block runs, a thread tells the progress from it."""
    counter = sc.accumulator(0)
    ended = threading.Event()

    def follow() -> None:
        while not ended.wait(seconds):
            progress.advance_to(counter.value)

    thread = threading.Thread(target=follow, daemon=True) if progress else None
    if thread:
        thread.start()
    try:
        yield counter
    finally:
        ended.set()
        if thread:
            thread.join()
            progress.advance_to(counter.value)
