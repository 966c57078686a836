"""Streams over the event log (an extension): first events by id, the latest run of each model, windowed counts, model calls."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import wraps
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, schema: str = SCHEMA, glob: str = "events*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 8).parquet(folder)


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark, so that state stays bounded."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def latest(events: DataFrame) -> DataFrame:
    """The last event of each type, in update mode; state is one row for each type."""
    return events.groupBy("event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("x")).select("event_type", "x.*")


def windowed(events: DataFrame, width: str = "1 day", delay: str | None = "1 day") -> DataFrame:
    """Counts and sums of each type in windows of event time; later events than the delay are dropped. None: events have a watermark, as after deduplicated."""
    return (events if delay is None else events.withWatermark("ts", delay)).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


class Runner(Protocol):
    """A provider's adapter: what calls one model. It must pickle, to go to the executors."""

    provider: str
    model: str

    def run(self, prompt: str, *, system: str | None = None) -> dict: ...


class RunnerError(RuntimeError):
    """A runner that can't be used: no key, no such model. It isn't caught."""


def timed(call: Callable[..., dict]) -> Callable[..., dict]:
    """The call with latency_ms in what it returns, retries within it included."""

    @wraps(call)
    def run(*args, **named) -> dict:
        began = time.perf_counter()
        out = call(*args, **named)
        return out | {"latency_ms": int((time.perf_counter() - began) * 1000)}

    return run


def call_models(prompts: DataFrame, runner: Callable[[str], dict] | Runner, schema: str, system: str | None = None) -> DataFrame:
    """prompts (id, prompt) through a runner, or a function: prompt -> completion fields. Order within a batch is kept.

    A Runner's calls are timed; one that fails, but for RunnerError, gives a row with its error and no text.
    """

    def call(prompt: str) -> dict:
        if not hasattr(runner, "run"):
            return runner(prompt)
        begin = time.perf_counter()
        try:
            return timed(runner.run)(prompt, system=system)
        except RunnerError:
            raise
        except Exception as e:  # the run goes on; the row says what happened
            return {"text": "", "model": runner.model, "provider": runner.provider, "error": f"{type(e).__name__}: {e}", "latency_ms": int((time.perf_counter() - begin) * 1000)}

    names = [c.strip().split(" ")[0] for c in schema.split(",")][1:]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [call(p) for p in f["prompt"]]
            yield pd.DataFrame({"id": f["id"].to_numpy()} | {c: pd.Series([x.get(c) for x in got], dtype=object) for c in names})

    return prompts.select("id", "prompt").mapInPandas(run, schema)
