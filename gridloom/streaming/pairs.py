"""Pending labels and images as one stateful stream: a label waits for an image of its stem.

Both kinds of files arrive in any order. A label is paired at once with an image of the first extension in the priority; with one
of a later extension when its time is up, for a better one may still come. A label without an image by then has failed. Each stem
is told once; what it was told is kept in the state, which the checkpoint carries over restarts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PRIORITY = ("jpg", "jpeg", "png")


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (stem, ext) of the files that arrive in a folder and below. Empty files are not seen."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"))


def paired(labels: DataFrame, images: DataFrame, wait_ms: int, priority: Sequence[str] = PRIORITY) -> DataFrame:
    """A stream (stem, ext, status) for the streams ``labels`` (stem) and ``images`` (stem, ext): ``ingested``, or ``failed`` after ``wait_ms``.

    The same rows as ``keys.ingest`` gives for all files that arrive in time. Images of other extensions do not count; repeated
    files change nothing.
    """
    files = images.where(F.col("ext").isin(*priority)).select("stem", "ext").unionByName(labels.select("stem", F.lit(None).cast("string").alias("ext")))

    def told(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, until, best = state.get if state.exists else (False, None, len(priority))
        now = state.getCurrentProcessingTimeMs()
        for frame in [] if state.hasTimedOut else rows:
            known = frame["ext"].dropna()
            until = now + wait_ms if until is None and len(known) < len(frame) else until
            best = min([best, *map(priority.index, known)])
        if not done and until is not None and (state.hasTimedOut or best == 0):
            done = True
            yield pd.DataFrame({"stem": [key[0]], "ext": [priority[best] if best < len(priority) else None], "status": ["ingested" if best < len(priority) else "failed"]})
        state.update((done, until, best))
        if until is not None and not done:  # each call clears the timer
            state.setTimeoutDuration(max(1, until - now))

    kinds = "stem string, ext string, status string"
    return files.groupBy("stem").applyInPandasWithState(told, kinds, "done boolean, until long, best int", "append", GroupStateTimeout.ProcessingTimeTimeout)
