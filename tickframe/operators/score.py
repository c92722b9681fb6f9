"""Model scores: a dilated causal convolution network's forward pass, and a logistic baseline."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


OUTCOMES = ("down_prob", "flat_prob", "up_prob")


def causal_convolution(x: np.ndarray, w: np.ndarray, b: np.ndarray, dilation: int) -> np.ndarray:
    """x: (n, channels, length); w: (out, channels, kernel); values before the start are 0."""
    n, _, length = x.shape
    kernel = w.shape[2]
    out = np.repeat(b[None, :, None], n, 0) + np.zeros((1, 1, length))
    for k in range(kernel):
        back = (kernel - 1 - k) * dilation
        if back < length:
            out[:, :, back:] += np.einsum("oc,ncl->nol", w[:, :, k], x[:, :, : length - back])
    return out


def forward(x: np.ndarray, model: dict) -> np.ndarray:
    """Class scores (n, classes) of windows (n, channels, length).

    Blocks of two convolutions with a residual, dilation doubling; the head sees 0.7 of the last step and
    0.3 of the mean.
    """
    for i, block in enumerate(model["blocks"]):
        d = model.get("base", 2) ** i
        y = np.maximum(causal_convolution(x, block["w1"], block["b1"], d), 0)
        y = np.maximum(causal_convolution(y, block["w2"], block["b2"], d), 0)
        rest = x if block.get("down") is None else causal_convolution(x, block["down"], block["down_b"], 1)
        x = np.maximum(y + rest, 0)
    return (0.7 * x[:, :, -1] + 0.3 * x.mean(2)) @ model["head"].T + model["head_b"]


def softmax_scores(x: np.ndarray, model: dict) -> np.ndarray:
    """Class probabilities (n, classes) of windows (n, channels, length)."""
    z = forward(x, model)
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def bundle(model: dict) -> bytes:
    """A model as one .npz: ``blocks.<i>.<name>``, ``head``, ``head_b`` and, if set, ``base``; arrays only, nothing that runs."""
    out = {f"blocks.{i}.{k}": v for i, b in enumerate(model["blocks"]) for k, v in b.items() if v is not None}
    buffer = io.BytesIO()
    np.savez(buffer, **out, **{k: np.asarray(v) for k, v in model.items() if k != "blocks"})
    return buffer.getvalue()


def load_model(spark: SparkSession, path: str) -> dict:
    """The model of a bundle anywhere that Spark reads; as large as the network, which is broadcast anyway."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()[0]
    model: dict = {"blocks": {}}
    with np.load(io.BytesIO(bytes(raw)), allow_pickle=False) as arrays:
        for name in arrays.files:
            first, *rest = name.split(".")
            if first == "blocks":
                model["blocks"].setdefault(int(rest[0]), {})[rest[1]] = arrays[name]
            else:
                model[name] = int(arrays[name]) if name == "base" else arrays[name]
    model["blocks"] = [model["blocks"][i] for i in sorted(model["blocks"])]
    if not model["blocks"] or "head" not in model:
        raise ValueError(f"{path} holds no model")
    return model


def scored(windows: DataFrame, model: dict, window: str = "window") -> DataFrame:
    """Adds down_prob, flat_prob and up_prob; ``model`` is broadcast (its size is the network's)."""
    shared = windows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def probabilities(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=object)
        return pd.Series(list(softmax_scores(np.stack([np.stack(v) for v in column]).astype(float), shared.value)))

    out = windows.withColumn("_p", probabilities(F.col(window)))
    return out.select(*windows.columns, *(F.col("_p")[i].alias(n) for i, n in enumerate(OUTCOMES)))


def logistic_baseline(train: DataFrame, columns: list[str], label: str, rounds: int = 50):
    """Move or flat from the last step's columns, classes weighted to equal sums; a fitted pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    counts = {r[0]: r[1] for r in train.groupBy((F.col(label) != 1).cast("double")).count().collect()}
    total = sum(counts.values())
    y = (F.col(label) != 1).cast("double")
    w = F.when(y == 1, total / (2.0 * max(counts.get(1.0, 0), 1))).otherwise(total / (2.0 * max(counts.get(0.0, 0), 1)))
    steps = [VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="skip"), LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=rounds)]
    return Pipeline(stages=steps).fit(train.withColumns({"_y": y, "_w": w}))
