"""Calls of an outside service from within tasks: several at a time, at a bounded rate, with retries."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame


class Pace:
    """Lets at most so many calls begin in a second; None for any number."""

    def __init__(self, per_second: float | None):
        self.gap, self.free, self.lock = (1.0 / per_second if per_second else 0.0), 0.0, threading.Lock()

    def wait(self) -> None:
        if self.gap:
            with self.lock:
                at = max(time.monotonic(), self.free)
                self.free = at + self.gap
            time.sleep(max(0.0, at - time.monotonic()))


def attempt(call: Callable[..., str], args: tuple, retries: int, backoff: float, pace: Pace, growth: float | None = None) -> tuple[str | None, str | None]:
    """(document, error) of a call. An empty answer is a failure. After the n-th failure n times backoff seconds pass or, with growth, backoff times growth to the power n - 1."""
    error = None
    for n in range(retries + 1):
        if n:
            time.sleep(backoff * (n if growth is None else growth ** (n - 1)))
        pace.wait()
        try:
            out = call(*args)
            if out:
                return out, None
            error = "empty answer"
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
    return None, error

#: Results of calls that a task gathers before it hands them on: so many, or of so many characters.
TOGETHER, TOGETHER_CHARS = 1024, 1 << 22


def called(rows: DataFrame, call: Callable[..., str], args: tuple[str, ...], keep: tuple[str, ...], workers: int = 1, per_second: float | None = None, retries: int = 0, backoff: float = 0.0, growth: float | None = None) -> DataFrame:
    """Columns of keep, `doc` and `error`: call on the columns of args, a row each, in the order of the rows.

    Each task has up to `workers` calls under way and begins at most `per_second` of them in a second, so that
    a job's rate is that of its tasks together: tasks times per_second. retries, backoff and growth are those of attempt(). Twice the workers' rows are held,
    and TOGETHER results, as a frame for each of them takes longer than a quick call.
    """
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", doc string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace, waiting, done, size = Pace(per_second), deque(), [], 0
        with ThreadPoolExecutor(workers) as pool:

            def first() -> int:
                kept, job = waiting.popleft()
                done.append((*kept, *job.result()))
                return len(done[-1][-2] or "")

            for pdf in batches:
                for kept, own in zip(zip(*(pdf[c] for c in keep), strict=True), zip(*(pdf[c] for c in args), strict=True), strict=True):
                    waiting.append((kept, pool.submit(attempt, call, own, retries, backoff, pace, growth)))
                    if len(waiting) >= 2 * workers:
                        size += first()
                    if len(done) >= TOGETHER or size >= TOGETHER_CHARS:
                        yield pd.DataFrame(done, columns=[*keep, "doc", "error"])
                        done, size = [], 0
            while waiting:
                first()
            if done:
                yield pd.DataFrame(done, columns=[*keep, "doc", "error"])

    return rows.select(*dict.fromkeys((*keep, *args))).mapInPandas(run, schema)
