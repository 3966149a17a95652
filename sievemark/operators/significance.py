"""Paired bootstrap on per-topic values of two systems."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Draws that are held at once.
DRAWN = 1 << 22


def bootstrap(differences: np.ndarray, n_boot: int = 10_000, seed: int = 0) -> dict[str, float]:
    """n, diff, two-sided p by shifting the resampled means to 0, and the 95% interval of percentiles."""
    d = np.asarray(differences, float)
    if not len(d):
        return {"n": 0, "diff": 0.0, "p": 1.0, "ci_lo": 0.0, "ci_hi": 0.0}
    # draws in parts of a bounded size; the generator's stream is the same as in one piece
    draws, part = np.random.default_rng(seed), max(1, DRAWN // len(d))
    means = np.concatenate([d[draws.integers(0, len(d), (min(part, n_boot - k), len(d)))].mean(1) for k in range(0, n_boot, part)])
    low, high = np.percentile(means, [2.5, 97.5])
    return {"n": len(d), "diff": float(d.mean()), "p": float((np.abs(means - d.mean()) >= abs(d.mean())).mean()), "ci_lo": float(low), "ci_hi": float(high)}


def paired_bootstrap(a: Mapping[str, float], b: Mapping[str, float], n_boot: int = 10_000, seed: int = 0) -> dict[str, float]:
    """`bootstrap` of a - b on the topics that both have, in their order."""
    shared = sorted(a.keys() & b.keys())
    return bootstrap(np.array([a[t] - b[t] for t in shared]), n_boot, seed)


def compare(metrics: DataFrame, pairs: list[tuple[str, str]], topic: str = "topic_id", n_boot: int = 10_000, seed: int = 0) -> DataFrame:
    """system_a, system_b, metric, n, diff, p, ci_lo, ci_hi for each pair; metrics has (system, metric, topic, value).

    A group is the topics of one metric and pair: as many rows as there are topics, resampled in one task.
    """
    wanted = metrics.sparkSession.createDataFrame(pairs, "system_a string, system_b string")
    a = metrics.select(F.col("system").alias("system_a"), "metric", topic, F.col("value").alias("a"))
    b = metrics.select(F.col("system").alias("system_b"), "metric", topic, F.col("value").alias("b"))
    both = a.join(F.broadcast(wanted), "system_a").join(b, ["system_b", "metric", topic])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(topic)
        return pd.DataFrame([{"system_a": key[0], "system_b": key[1], "metric": key[2], **bootstrap((p["a"] - p["b"]).to_numpy(), n_boot, seed)}])

    return both.groupBy("system_a", "system_b", "metric").applyInPandas(run, "system_a string, system_b string, metric string, n long, diff double, p double, ci_lo double, ci_hi double")


def hash_bootstrap(metrics: DataFrame, a: str, b: str, n_boot: int = 10_000, topic: str = "topic_id") -> DataFrame:
    """metric, n, diff, p: the same test with draws from MD5 instead of a generator, so that any SQL engine repeats it."""
    d = metrics.where(F.col("system").isin(a, b)).groupBy("metric", topic).pivot("system", [a, b]).agg(F.first("value")).where(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull())
    d = d.select("metric", topic, (F.col(f"`{a}`") - F.col(f"`{b}`")).alias("d"))
    sample = d.groupBy("metric").agg(F.transform(F.sort_array(F.collect_list(F.struct(topic, "d"))), lambda x: x["d"]).alias("ds"))
    draws = sample.select("metric", "ds", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("nth"))
    place = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.col("nth").cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long") % F.size("ds")
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)
    draws = draws.withColumn("m", mean(F.transform(F.sequence(F.lit(0), F.size("ds") - 1), lambda i: F.element_at("ds", (place(i) + 1).cast("int"))))).withColumn("obs", mean(F.col("ds")))
    far = F.round(F.abs(F.col("m") - F.col("obs")), 9) >= F.round(F.abs("obs"), 9)
    return draws.groupBy("metric").agg(F.first(F.size("ds")).cast("long").alias("n"), F.round(F.first("obs"), 6).alias("diff"), F.round(F.count_if(far) / F.lit(float(n_boot)), 6).alias("p"))
