"""Model-backed steps behind a small interface, with a deterministic stand-in, resumable through a cache.

A provider gets a prompt and gives text or None. Calls run in Arrow batches on executors; what was attempted is kept as a
table, so a retried job or task asks only for the rest.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_hash
from .decisions import LABELS, PER_CALL


class Provider(Protocol):
    def __call__(self, prompt: str) -> str | None: ...


class ProviderError(Exception):
    """A call failed in a way that another attempt may mend; delay: seconds that the server asks to wait."""

    def __init__(self, message: str = "", delay: float | None = None):
        super().__init__(message)
        self.delay = delay


def rule_provider(labels: tuple[str, ...] = LABELS) -> Provider:
    """Answers every `[idx] criterion` line of a prompt by a rule on shared words; stands in for a model."""

    def answer(prompt: str) -> str:
        narrative, _, items = prompt.partition("\n---\n")
        known = set(narrative.lower().split())
        out = []
        for line in items.splitlines():
            idx, _, text = line.partition("] ")
            words = [w for w in text.lower().split() if len(w) > 3]
            shared = [w for w in words if w in known]
            label = "unverifiable" if not shared else "violated" if text.lower().startswith("no ") else "satisfied"
            if label not in labels:
                label = labels[0] if int(hashlib.md5(text.encode()).hexdigest(), 16) % 2 else labels[1]
            out.append({"criterion_idx": int(idx.strip("[")), "label": label, "criterion_quote": text, "patient_evidence": shared[0] if shared else "", "reasoning": f"{len(shared)} shared words"})
        return json.dumps({"decisions": out})

    return answer


def rotating(providers: list[Provider]) -> Provider:
    """Providers in turn, one per access key: a call that one refuses goes to the next, and later calls stay with that one."""
    at = 0

    def call(prompt: str) -> str | None:
        nonlocal at
        for n in range(len(providers)):
            try:
                return providers[at](prompt)
            except ProviderError:
                at = (at + 1) % len(providers)
                if n == len(providers) - 1:
                    raise
        return None

    return call


def with_retries(provider: Provider, attempts: int = 3, wait: Callable[[int], float] = lambda n: 0.5 * 2**n, breaker: int = 5) -> Provider:
    """Repeats failed calls, after as long as the server asks for or else `wait` says; after `breaker` calls in a row that failed
    for good, it stops the task instead of going on."""
    failed = 0

    def call(prompt: str) -> str | None:
        nonlocal failed
        for n in range(attempts):
            try:
                out = provider(prompt)
            except ProviderError as e:
                time.sleep(wait(n) if e.delay is None else e.delay)
                continue
            failed = 0
            return out
        failed += 1
        if failed >= breaker:
            raise RuntimeError(f"{breaker} calls in a row failed")
        return None

    return call


def prompt_hash(template: str, schema: str) -> str:
    return hashlib.sha256((template + schema).encode()).hexdigest()[:12]


def prompts(pairs: DataFrame, criteria: DataFrame, narratives: DataFrame, per_call: int = PER_CALL) -> DataFrame:
    """topic_id, nct_id, piece, prompt: criteria of a pair in pieces of per_call, in order, under the narrative."""
    c = pairs.select("topic_id", "nct_id").join(criteria, "nct_id").withColumn("piece", F.floor(F.col("idx") / per_call).cast("int"))
    item = F.struct("idx", F.format_string("[%d] %s", "idx", "text").alias("line"))
    c = c.groupBy("topic_id", "nct_id", "piece").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return c.join(narratives, "topic_id").select("topic_id", "nct_id", "piece", F.concat("narrative", F.lit("\n---\n"), F.array_join(F.transform("items", lambda x: x["line"]), "\n")).alias("prompt"))


_ANSWER = "array<struct<criterion_idx:int,label:string,criterion_quote:string,patient_evidence:string,reasoning:string>>"


def ask(requests: DataFrame, provider: Provider) -> DataFrame:
    """Requests with `reply` (null if none came) and `prompt_hash` of the prompt itself."""
    keys = [f.name for f in requests.schema if f.name != "prompt"]
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([provider(p) for p in b.column(len(keys)).to_pylist()], pa.string())], names=[*keys, "prompt", "reply"])

    out = requests.select(*keys, "prompt").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", prompt string, reply string")
    return out.withColumn("prompt_hash", short_hash(F.col("prompt")))


def answers(replies: DataFrame) -> DataFrame:
    """A row per answer of readable replies, in order of arrival (`pos`), and `provider_status` per reply: ok, invalid or none."""
    body = F.from_json("reply", f"decisions {_ANSWER}")["decisions"]
    status = F.when(F.col("reply").isNull(), "none").when(body.isNull(), "invalid").otherwise("ok")
    r = replies.select("topic_id", "nct_id", "piece", status.alias("provider_status"), body.alias("_d"))
    return r.select("topic_id", "nct_id", "piece", "provider_status", F.posexplode_outer("_d").alias("_pos", "_a")).select("topic_id", "nct_id", "provider_status", (F.col("piece") * 10_000 + F.coalesce("_pos", F.lit(0))).alias("pos"), "_a.*")
