"""Bounds on the time of a Spark action."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

R = TypeVar("R")


def within(spark: SparkSession, seconds: float, action: Callable[[], R]) -> R:
    """What ``action`` returns; its jobs are cancelled and TimeoutError is raised if it takes longer."""
    sc, group = spark.sparkContext, f"within-{uuid.uuid4()}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    sc.setJobGroup(group, f"at most {seconds} s", interruptOnCancel=True)
    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"cancelled after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
