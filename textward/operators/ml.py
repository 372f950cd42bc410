"""Scoring by weighted features, alone or together with a model's probability."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward import catalog
from textward.config import Config
from textward.functions.text import any_match, clamp


def _weights(config: Config) -> dict[str, float]:
    """Name to weight, with overrides and without what is disabled; unknown names are ignored."""
    override = {k.lower(): max(0.0, min(1.0, v)) for k, v in config.ml.weights.items()}
    off = {d.lower() for d in config.ml.disabled}
    return {n: override.get(n.lower(), w) for n, w in catalog.WEIGHTS.items() if n.lower() not in off}


def feature_score(values: dict[str, Column], config: Config) -> Column:
    """Sigmoid of the weighted features that reach the least contribution. Features are single precision, sums double."""
    total = F.lit(0.0)
    for name, weight in _weights(config).items():
        value = values[name].cast("float").cast("double")
        total = total + F.when(value >= config.ml.min_contribution, value * F.lit(weight) * F.lit(config.ml.multiplier)).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(total * 2 - 2)))


def ensemble(model: Column, feature: Column, config: Config) -> Column:
    base = config.ml.model_weight
    weight = F.lit(base) + F.abs(model - 0.5) * 2 * F.lit((1.0 - base) * 0.3)
    return clamp(model * weight + feature * (F.lit(1.0) - weight))


def top_features(values: dict[str, Column], config: Config, k: int = 5) -> Column:
    """The k largest features above 0.3 as Name:0.00; equal ones stay in order."""
    off = {d.lower() for d in config.ml.disabled}
    known = {n.lower() for n in catalog.WEIGHTS}
    rows = [F.struct((-v.cast("float").cast("double")).alias("v"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, v) in enumerate(values.items()) if not (n.lower() in off and n.lower() in known)]
    large = F.filter(F.array(*rows), lambda x: x["v"] < -0.3)
    return F.transform(F.slice(F.sort_array(large), 1, k), lambda x: F.format_string("%s:%.2f", x["n"], -x["v"]))


def layer(text: Column, values: dict[str, Column], config: Config, model: Column | None = None, model_failed: Column | None = None) -> Column:
    """The layer's struct. `model` is a column of probabilities; null where there is none."""
    feature = feature_score(values, config)
    mode: Column = F.lit("FeatureBased")
    p = feature
    if model is not None:
        failed = model_failed if model_failed is not None else F.lit(False)
        mode = F.when(model.isNotNull(), "Ensemble").when(failed, "Degraded").otherwise("FeatureBased")
        p = F.when(model.isNotNull(), ensemble(model, feature, config)).otherwise(feature)
    free = any_match(text, config.ml.allowed) if config.ml.allowed else F.lit(False)
    c = F.when(free, 0.0).otherwise(p)
    return F.struct(
        F.lit("MLClassification").alias("layer"), F.lit(True).alias("was_executed"), F.when(free, "allowlisted").otherwise("analyzed").alias("status"), c.alias("confidence"), (~free & (c >= config.ml.threshold)).alias("is_threat"),
        mode.alias("mode"), F.lit(config.ml.threshold).alias("threshold"), c.alias("threat_probability"), (F.lit(1.0) - c).alias("safe_probability"), top_features(values, config).alias("top_features"),
        F.lit(len([d for d in config.ml.disabled if d.lower() in {n.lower() for n in catalog.WEIGHTS}])).alias("disabled_features_count"),
    )


def probability(logits: list[float]) -> float:
    """Two or more outputs: softmax of the second; one: sigmoid."""
    import math

    if not logits:
        raise ValueError("the model gave no output")
    if len(logits) == 1:
        return 1.0 / (1.0 + math.exp(-logits[0]))
    most = max(logits)
    parts = [math.exp(x - most) for x in logits]
    return parts[1] / sum(parts)


def model_udf(session_of: Callable[[], Callable[[list[list[int]], list[list[int]]], list[list[float]]]]):
    """Batch inference as an Arrow function of (ids, mask); session_of() is called once in each worker and gives a function from
    ids and masks to outputs, for example around an ONNX session. A row that fails gives a null."""

    @F.pandas_udf("double")
    def infer(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        run = session_of()
        for ids, mask in batches:
            some = [k for k, x in enumerate(ids) if x is not None]
            out: list[float | None] = [None] * len(ids)
            try:
                rows = run([list(ids[k]) for k in some], [list(mask[k]) for k in some]) if some else []
                for k, row in zip(some, rows, strict=True):
                    out[k] = probability(list(row))
            except Exception:  # noqa: BLE001  the model is the user's; the row that it fails on is found below
                for k in some:
                    try:
                        out[k] = probability(list(run([list(ids[k])], [list(mask[k])])[0]))
                    except Exception:  # noqa: BLE001
                        out[k] = None
            yield pd.Series(out, dtype="float64")

    return infer.asNondeterministic()  # so that the optimizer runs it once


def fitted(labelled: DataFrame, text: str, label: str, config: Config, max_rows: int = 2_000, steps: int = 300) -> Callable[[], Callable[[list[list[int]], list[list[int]]], list[list[float]]]]:
    """session_of() for model_udf() around a logistic regression over how often each token stands in a text. It is fitted on the driver, on the
    labelled rows with the smallest hashes, `max_rows` at most, each as counts of the vocabulary's tokens."""
    import numpy as np

    from textward.functions import tokenize

    size = len(tokenize.vocabulary()) + tokenize.FIRST
    rows = labelled.where(F.col(label).isNotNull()).select(F.xxhash64(text).alias("h"), tokenize.word_ids(F.col(text), config.ml.max_sequence).alias("ids"), F.col(label).cast("int").alias("y"))
    sample = rows.orderBy("h", "y").limit(max_rows).collect()

    def counts(ids: list[list[int]]) -> np.ndarray:
        x = np.zeros((len(ids), size))
        for k, own in enumerate(ids):
            np.add.at(x[k], [i for i in own if i != tokenize.PAD], 1.0)
        return x / np.maximum(x.sum(axis=1, keepdims=True), 1.0)

    x, y = counts([r["ids"] for r in sample]), np.array([r["y"] for r in sample], float)
    w, bias = np.zeros(size), 0.0
    for _ in range(steps if len(sample) else 0):
        g = 1.0 / (1.0 + np.exp(-(x @ w + bias))) - y
        w -= 5.0 * (x.T @ g / len(y) + 1e-4 * w)
        bias -= 5.0 * g.mean()

    def make() -> Callable[[list[list[int]], list[list[int]]], list[list[float]]]:
        return lambda ids, mask: [[0.0, float(z)] for z in counts(ids) @ w + bias]

    return make


def onnx_session(path: str, input_ids: str = "input_ids", attention_mask: str = "attention_mask"):
    """session_of() for model_udf() around an ONNX file that the workers can read."""

    def make():
        import numpy as np
        import onnxruntime

        session = onnxruntime.InferenceSession(path)
        names = {i.name for i in session.get_inputs()}

        def run(ids: list[list[int]], mask: list[list[int]]) -> list[list[float]]:
            feed = {input_ids: np.array(ids, np.int64)}
            if attention_mask in names:
                feed[attention_mask] = np.array(mask, np.int64)
            if "token_type_ids" in names:
                feed["token_type_ids"] = np.zeros_like(feed[input_ids])
            return session.run(None, feed)[0].tolist()

        return run

    return make
