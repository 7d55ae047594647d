"""Model calls as a stage of the plan: distinct keys, a cache table, a rate limit, retries, checks and costs."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import tokens
from folioforge.session import materialize

#: Prices per 1,000 tokens, of prompts and of completions.
PRICES = {"default": (0.0015, 0.002), "large": (0.005, 0.025)}
TTL_SECONDS = 3600
CALLS_PER_MINUTE = 30


def cache_key(prompt: Column, model: Column, settings: Column | None = None) -> Column:
    """Equal for equal prompt, model and settings (a JSON string with sorted keys)."""
    parts = F.concat_ws("\x1f", prompt, model, settings if settings is not None else F.lit("{}"))
    return F.concat(F.lit("llm_cache:"), F.sha2(parts, 256))


def cost(prompt_tokens: Column, completion_tokens: Column, price: str = "default") -> Column:
    """The price of a call."""
    a, b = PRICES[price]
    return prompt_tokens / 1000.0 * a + completion_tokens / 1000.0 * b


def echo(prompt: Column) -> Column:
    """The offline model's answer."""
    return F.concat(F.lit("[echo] "), F.substring(prompt, 1, 200))


def echo_responses(df: DataFrame, prompt_col: str = "prompt", model: str = "echo") -> DataFrame:
    """Adds ``content, model, prompt_tokens, completion_tokens, cost`` without leaving the JVM."""
    out = df.withColumn("content", echo(F.col(prompt_col))).withColumn("model", F.lit(model))
    out = out.withColumn("prompt_tokens", tokens.count(F.col(prompt_col))).withColumn("completion_tokens", tokens.count(F.col("content")))
    return out.withColumn("cost", cost(F.col("prompt_tokens"), F.col("completion_tokens")))


@dataclass
class RateLimiter:
    """At most ``calls`` within any ``seconds``; one for each partition, so give it its share of the whole limit."""

    calls: int
    seconds: float = 60.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    made: deque[float] = field(default_factory=deque)

    def wait(self) -> None:
        now = self.clock()
        while self.made and self.made[0] <= now - self.seconds:
            self.made.popleft()
        if len(self.made) >= self.calls:
            self.sleep(max(0.0, self.made[0] + self.seconds - now))
            return self.wait()
        self.made.append(now)
        return None


def validate(response: dict[str, Any]) -> None:
    """Raises ValueError unless there is content and a model's name."""
    if not str(response.get("content") or "").strip() or not response.get("model"):
        raise ValueError("the model gave no content or no name")


def with_retries(call: Callable[[str], dict[str, Any]], prompt: str, attempts: int = 5, least: float = 4, most: float = 10, sleep: Callable[[float], None] = time.sleep, limiter: RateLimiter | None = None) -> dict[str, Any]:
    """Calls until an answer is valid; waits longer each time, and every attempt counts for the limit."""
    for attempt in range(attempts):
        try:
            if limiter:
                limiter.wait()
            response = call(prompt)
            validate(response)
            return response
        except Exception:
            if attempt == attempts - 1:
                raise
            sleep(min(most, max(least, 2.0**attempt)))
    raise AssertionError


def _call(model: Callable[[str], dict[str, Any]], calls: int | None, attempts: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limiter = RateLimiter(calls) if calls else None
        for b in batches:
            out: dict[str, list[Any]] = {"cache_key": [], "content": [], "model": [], "cost": [], "error": []}
            for key, prompt in zip(b.column("cache_key").to_pylist(), b.column("prompt").to_pylist(), strict=True):
                try:
                    r, error = with_retries(model, prompt, attempts, least, limiter=limiter), None
                except Exception as e:
                    r, error = {}, str(e)[:500]
                for name, value in (("cache_key", key), ("content", r.get("content")), ("model", r.get("model")), ("cost", r.get("cost")), ("error", error)):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("cache_key", pa.string()), ("content", pa.string()), ("model", pa.string()), ("cost", pa.float64()), ("error", pa.string())]))

    return run


def generate(df: DataFrame, model: Callable[[str], dict[str, Any]], model_name: str, cache: DataFrame | None = None, as_of: Column | None = None, partitions: int | None = None, calls_per_minute: int | None = CALLS_PER_MINUTE, attempts: int = 5, least: float = 4) -> tuple[DataFrame, DataFrame]:
    """Answers to ``prompt`` as ``content, model, cost, error, cached``; and the entries that are new to the cache.

    Equal prompts are asked once, and not at all if ``cache`` (cache_key, content, model, cost, created_at) has them
    within an hour before ``as_of``. ``calls_per_minute`` (None for no limit) is shared by the partitions. New answers are written down before they are joined, so that no call is repeated
    by a retried stage that reads them. Failures come out as rows with their error.
    """
    now = as_of if as_of is not None else F.current_timestamp()
    keyed = df.withColumn("cache_key", cache_key(F.col("prompt"), F.lit(model_name)))
    wanted = keyed.select("cache_key", "prompt").dropDuplicates(["cache_key"])
    known = None
    if cache is not None:
        fresh = cache.where((F.col("created_at") <= now) & (F.col("created_at") > now - F.make_interval(secs=F.lit(TTL_SECONDS))))
        known = fresh.groupBy("cache_key").agg(F.max_by(F.struct("content", "model", "cost"), "created_at").alias("r")).select("cache_key", "r.*", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
        wanted = wanted.join(known, "cache_key", "left_anti")
    if partitions is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, calls_per_minute // partitions) if calls_per_minute else None
    answers = wanted.repartition(partitions, "cache_key").mapInArrow(_call(model, share, attempts, least), "cache_key string, content string, model string, cost double, error string")
    new = materialize(answers.withColumn("cached", F.lit(False)), "answers")
    every = new if known is None else new.unionByName(known)
    return keyed.join(every, "cache_key", "left"), new.where("error is null").select("cache_key", "content", "model", "cost", now.alias("created_at"))
