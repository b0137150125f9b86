"""A search's time limit: its jobs are cancelled together and what they had is dropped.

A cancelled task ends where it next asks for rows: of a file (a batch), a cached table, a shuffle or a Python worker. That
frees its cores soon, as every search reads one of these. Rows made by ``spark.range`` alone ask nothing, and such a
task runs to its end.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame

from ..errors import RequestError


def collected_within(frame: DataFrame, seconds: float) -> list:
    """The rows of a frame, or ``search:timeout``."""
    sc = frame.sparkSession.sparkContext
    group, late = f"search-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    sc.setJobGroup(group, "search", True)
    timer.start()
    try:
        return frame.collect()
    except Exception as e:
        if late.is_set():
            raise RequestError("search:timeout", f"longer than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            sc.setLocalProperty(name, None)
