"""Paid calls made once: a table of completions by the digest of what was asked, and calls for what it lacks."""

from __future__ import annotations

import hashlib
import json
import random
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.sources.runfiles import content, names, put
from assaykit.streaming.runs import Runner, RunnerError, timed

#: What the table says of a call; extra holds all other fields of a completion, as JSON.
COMPLETION = "key string, text string, error string, latency_ms long, tokens_in long, tokens_out long, extra string"
_FIELDS = ("text", "error", "latency_ms", "tokens_in", "tokens_out")


def call_key(prompt: Column, runner: Runner, system: str | None = None, params: dict | None = None) -> Column:
    """SHA-256 of provider, model, system text, parameters and prompt: the same question has the same key."""
    head = json.dumps([runner.provider, runner.model, system, params or {}], sort_keys=True)
    return F.sha2(F.concat(F.lit(hashlib.sha256(head.encode()).hexdigest()), prompt).cast("binary"), 256)


def completions(spark: SparkSession, table: str) -> DataFrame:
    """The table's rows, one for each key: a call that worked, else one that failed. A table that isn't there is empty."""
    if not names(table):
        return spark.createDataFrame([], COMPLETION)
    rows = spark.read.schema(COMPLETION).option("recursiveFileLookup", "true").json(table)
    whole = F.struct(*(c.split()[0] for c in COMPLETION.split(", ")))
    return rows.groupBy(F.col("key").alias("_key")).agg(F.max_by(whole, F.struct(F.col("error").isNull(), "latency_ms", "text")).alias("x")).select("x.*")


def complete_once(prompts: DataFrame, runner: Runner, table: str, system: str | None = None, params: dict | None = None, together: int = 4, retries: int = 4, base: float = 1.0, most: float = 60.0, keep: int = 16, buckets: int = 256, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """prompts (id, prompt) with their completions: id, key and COMPLETION's columns. Only keys without a call that worked are asked.

    Equal prompts are one call. A task asks for the keys of its buckets, `together` at a time, and stores what it has
    after each `keep` calls, in the folder `table` that all executors share; tried again after its executor was
    lost, it reads what its buckets have there and asks for the rest alone. A call that raises is tried again
    after min(most, base 2^k) seconds and up to as much again; after `retries` tries its error is stored, and
    the next run asks again. RunnerError ends the run at once. A null prompt is an empty one.
    """
    spark = prompts.sparkSession
    asked = prompts.select("id", F.coalesce("prompt", F.lit("")).alias("prompt")).withColumn("key", call_key(F.col("prompt"), runner, system, params))
    done = completions(spark, table).where(F.col("error").isNull()).select("key")
    todo = asked.dropDuplicates(["key"]).join(done, "key", "left_anti").select("key", "prompt", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"))

    def call(prompt: str) -> dict:
        for k in range(retries):
            began = time.perf_counter()
            try:
                return timed(runner.run)(prompt, system=system)
            except RunnerError:
                raise
            except Exception as e:  # the row says what happened
                failed = {"text": "", "error": f"{type(e).__name__}: {e}", "latency_ms": int((time.perf_counter() - began) * 1000)}
                if k + 1 < retries:
                    wait = min(most, base * 2**k)
                    sleep(wait + random.uniform(0, wait))
        return failed

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, set[str]] = {}
        for frame in frames:
            for bucket, part in frame.groupby("bucket"):
                if bucket not in known:
                    known[bucket] = set()
                    for name in names(f"{table}/{bucket:04d}"):
                        known[bucket] |= {r["key"] for r in map(json.loads, (content(f"{table}/{bucket:04d}/{name}") or b"").splitlines()) if not r.get("error")}
                left = part[~part["key"].isin(known[bucket])]
                with ThreadPoolExecutor(together) as pool:
                    for lo in range(0, len(left), keep):
                        some = left.iloc[lo : lo + keep]
                        got = list(pool.map(call, some["prompt"]))
                        rows = [{"key": key} | {c: x.get(c) for c in _FIELDS} | {"extra": json.dumps({k: v for k, v in x.items() if k not in _FIELDS})} for key, x in zip(some["key"], got, strict=True)]
                        put(f"{table}/{bucket:04d}/{uuid.uuid4().hex}.json", "".join(json.dumps(r) + "\n" for r in rows).encode())
                        yield pd.DataFrame({"n": [len(rows)]})

    todo.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInPandas(run, "n long").agg(F.sum("n")).collect()
    return asked.drop("prompt").join(completions(spark, table), "key", "left")
