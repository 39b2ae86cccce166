"""A packed scorer: its checks, and scoring with it as column expressions."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import band
from matchloom.operators.vectors import dot


def fingerprint(config: object) -> str:
    """SHA-256 of a configuration as JSON with sorted keys and no blanks."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@dataclass(frozen=True)
class Scorer:
    """Standardisation, two rows of linear weights (no, yes), Platt's slope and offset, and the threshold."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[tuple[float, ...], tuple[float, ...]]
    bias: tuple[float, float]
    slope: float
    offset: float
    threshold: float
    labels: tuple[str, str] = ("No Fit", "Good Fit")

    def fingerprint(self) -> str:
        return fingerprint(asdict(self))

    def problems(self, expected: str | None = None) -> list[str]:
        """What is wrong with the model; nothing if it may be used."""
        wrong = []
        n = len(self.mean)
        if not (n and len(self.scale) == n and all(len(w) == n for w in self.weights)):
            wrong.append("dimensions differ")
        if any(s <= 0 for s in self.scale):
            wrong.append("a scale isn't positive")
        if len(set(self.labels)) != 2:
            wrong.append("labels must be two different ones")
        if not 0 <= self.threshold <= 1:
            wrong.append("the threshold lies outside 0 to 1")
        if not all(math.isfinite(x) for x in (*self.mean, *self.scale, *self.weights[0], *self.weights[1], *self.bias, self.slope, self.offset)):
            wrong.append("a value isn't finite")
        if expected is not None and expected != self.fingerprint():
            wrong.append("the fingerprint differs")
        return wrong


def scored(rows: DataFrame, model: Scorer, features: str = "vec", expected: str | None = None) -> DataFrame:
    """Adds margin, probability, label, score (0 to 100) and band; a model with a problem, or another number of features, is an error."""
    problems = model.problems(expected)
    if problems:
        raise ValueError("; ".join(problems))
    numbers = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    size = len(model.mean)
    vec = F.when(F.size(features) == size, F.col(features)).otherwise(F.raise_error(F.lit(f"{size} features are needed")).cast("array<double>"))
    scaled = F.zip_with(F.zip_with(vec, numbers(model.mean), lambda x, m: x - m), numbers(model.scale), lambda x, s: x / s)
    out = rows.withColumn("scaled", scaled)
    logits = [dot(F.col("scaled"), numbers(w)) + F.lit(float(b)) for w, b in zip(model.weights, model.bias, strict=True)]
    out = out.withColumn("margin", logits[1] - logits[0]).drop("scaled")
    out = out.withColumn("probability", 1 / (1 + F.exp(-(model.slope * F.col("margin") + model.offset))))
    label = F.when(F.col("probability") >= model.threshold, model.labels[1]).otherwise(model.labels[0])
    return out.withColumns({"label": label, "score": 100 * F.col("probability"), "band": band(100 * F.col("probability"))})


def payload_errors(rows: DataFrame) -> Column:
    """What is wrong with a request to score: a local path, an empty text, a description's hash or a fingerprint that doesn't agree.

    Reads resume_path, resume_text, job_description, job_description_hash, input_fingerprint and
    expected_fingerprint.
    """
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    differs = lambda text, digest: ~F.coalesce(F.sha2(text, 256) == F.col(digest), F.lit(False))
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("resume_path"), F.lit("")) != "", "a local path isn't allowed"),
            F.when(empty("resume_text"), "resume_text is required"),
            F.when(empty("job_description"), "job_description is required"),
            F.when(differs("job_description", "job_description_hash"), "job_description_hash differs"),
            F.when(~F.col("input_fingerprint").eqNullSafe(F.col("expected_fingerprint")), "input_fingerprint differs"),
        )
    )
