"""Remote recognisers as a column: the caller supplies submit and poll; nothing here knows a service."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def recognised(samples: DataFrame, submit: Callable[[str], str], poll: Callable[[str], dict], tries: int = 2, polls: int = 200, wait: float = 2.0) -> DataFrame:
    """(path, text, duration, proc, error) per sample. Each sample is submitted up to `tries` times and polled up to `polls` times; a
    failure is a row with its error."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b["path"]:
                error = None
                for _ in range(tries):
                    try:
                        job = submit(p)
                        for _ in range(polls):
                            s = poll(job)
                            if s.get("status") in ("COMPLETED", "FAILED", "CANCELLED", "TIMED_OUT"):
                                break
                            time.sleep(wait)
                        if s.get("status") == "COMPLETED":
                            rows.append((p, s.get("text"), s.get("duration"), s.get("proc"), None))
                            break
                        error = str(s.get("status"))
                    except Exception as e:  # noqa: BLE001
                        error = type(e).__name__
                else:
                    rows.append((p, None, None, None, error))
            yield pd.DataFrame(rows, columns=["path", "text", "duration", "proc", "error"])

    return samples.select("path").mapInPandas(work, "path string, text string, duration double, proc double, error string")
