"""Three-class network on the tabular features: weighted training by summed gradients, scoring by column expressions.

A network is a handful of matrices. Training reads the rows once per step: each task adds up the gradients of its rows,
weighted by class, and Spark sums them by parameter, so what reaches the driver is as large as the network, whatever the
data. Scoring is a projection without Python.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import require_columns, with_one_row
from ..sources.io import cut, discard
from .dataset import LABEL_VERSION, apply_scaler, fit_scaler
from .evidence import LABELS
from .indicators import FEATURE_VERSION, FEATURES
from .signals import suggested_action

DIRECTIONAL_BOOST = 1.25


@dataclass(frozen=True)
class Network:
    """Layers of a dense network: each a matrix (outputs x inputs + 1, the last column the bias) as a tuple of rows.

    Layers but the last are rectified; the last gives the classes of ``LABELS`` by softmax.
    """

    features: tuple[str, ...]
    layers: tuple[tuple[tuple[float, ...], ...], ...]

    @staticmethod
    def start(features: Sequence[str], hidden: Sequence[int], seed: int) -> Network:
        """Small random matrices; zeros where there is no hidden layer."""
        rng = np.random.default_rng(seed)
        sizes = [len(features), *hidden, len(LABELS)]
        scale = [np.sqrt(2 / a) if hidden else 0.0 for a in sizes[:-1]]
        layers = [np.hstack([rng.normal(size=(b, a)) * s, np.zeros((b, 1))]) for a, b, s in zip(sizes, sizes[1:], scale)]
        return Network.of(features, layers)

    @staticmethod
    def of(features: Sequence[str], layers: Sequence[np.ndarray]) -> Network:
        return Network(tuple(features), tuple(tuple(tuple(map(float, row)) for row in m) for m in layers))

    def matrices(self) -> list[np.ndarray]:
        return [np.array(m) for m in self.layers]

    def gradient(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], float]:
        """(sum of weight x gradient of the log loss for each layer, sum of weight x loss)."""
        matrices, inputs = self.matrices(), [x]
        for m in matrices[:-1]:
            inputs.append(np.maximum(inputs[-1] @ m[:, :-1].T + m[:, -1], 0))
        z = inputs[-1] @ matrices[-1][:, :-1].T + matrices[-1][:, -1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        loss = float(-(weight * np.log(np.maximum(p[np.arange(len(x)), target], 1e-300))).sum())
        delta = p.copy()
        delta[np.arange(len(x)), target] -= 1
        delta *= weight[:, None]
        out = []
        for m, a in zip(reversed(matrices), reversed(inputs)):
            out.append(np.hstack([delta.T @ a, delta.sum(axis=0)[:, None]]))
            delta = (delta @ m[:, :-1]) * (a > 0)
        return out[::-1], loss


def class_weights(train: DataFrame) -> DataFrame:
    """Balanced weight per label; directional labels weigh a quarter more."""
    counts = train.groupBy("label_class").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_classes"))
    boost = F.when(F.col("label_class") == "neutral", 1.0).otherwise(DIRECTIONAL_BOOST)
    return with_one_row(counts, total).select(
        "label_class", (F.col("_total") / (F.col("_classes") * F.col("_n")) * boost).alias("weight")
    )


def weighted_gradient(rows: DataFrame, network: Network) -> tuple[list[np.ndarray], float, float]:
    """(mean gradient of each layer, mean loss, sum of weights) over rows (x array<double>, target int, weight double)."""
    shapes = [(len(m), len(m[0])) for m in network.layers]
    size = sum(a * b for a, b in shapes)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2)
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
                weight = b.column("weight").to_numpy()
                parts, loss = network.gradient(x, b.column("target").to_numpy(), weight)
                total += np.concatenate([*[g.ravel() for g in parts], [loss, weight.sum()]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2)), pa.array(total)], names=["i", "v"])

    summed = rows.mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(size + 2)
    flat[summed.column("i").to_numpy()] = summed.column("v").to_numpy()
    weight = flat[-1] or 1.0
    parts = np.split(flat[:size] / weight, np.cumsum([a * b for a, b in shapes])[:-1])
    return [p.reshape(s) for p, s in zip(parts, shapes)], flat[-2] / weight, flat[-1]


def train_classifier(
    dataset: DataFrame, features: Sequence[str] = FEATURES, hidden: Sequence[int] = (16,), seed: int = 42, steps: int = 40,
    rate: float = 0.1, momentum: float = 0.9,
) -> tuple[Network, DataFrame]:
    """(network, scaler) fitted on the rows of the train split that have a label of ``LABELS``.

    Full-batch descent with momentum on the class-weighted log loss; without ``hidden`` layers it is a softmax
    regression. The scaled rows are stored for the steps and removed afterwards.
    """
    features = list(features)
    train = dataset.where("dataset_split = 'train'").where(F.col("label_class").isin(list(LABELS)))
    scaler = fit_scaler(train, features)
    target = F.array_position(F.array(*[F.lit(c) for c in LABELS]), F.col("label_class")).cast("int") - 1
    rows = apply_scaler(train.join(class_weights(train), "label_class"), scaler, features)
    rows = cut(rows.select(F.array(*features).alias("x"), target.alias("target"), "weight"), "train")
    network = Network.start(features, hidden, seed)
    speed = [np.zeros_like(m) for m in network.matrices()]
    for _ in range(steps):
        slope, _, _ = weighted_gradient(rows, network)
        speed = [momentum * v - rate * g for v, g in zip(speed, slope)]
        network = Network.of(features, [m + v for m, v in zip(network.matrices(), speed)])
    for folder in {f.rpartition("/")[0] for f in rows.inputFiles()}:
        discard(dataset.sparkSession, folder)
    return network, scaler


def class_probabilities(rows: DataFrame, network: Network) -> DataFrame:
    """``rows`` (scaled features) with ``prob_<label>`` for each label, clipped and summing to one."""
    held, inputs = rows, [F.col(f) for f in network.features]

    def weighted(row: tuple[float, ...]) -> Column:
        total = F.lit(row[-1])
        for w, x in zip(row, inputs):
            total = total + F.lit(w) * x
        return total

    for n, m in enumerate(network.layers[:-1]):
        held = held.select("*", *[F.greatest(F.lit(0.0), weighted(row)).alias(f"_h{n}_{i}") for i, row in enumerate(m)])
        inputs = [F.col(f"_h{n}_{i}") for i in range(len(m))]
    held = held.select("*", *[weighted(row).alias(f"_z{i}") for i, row in enumerate(network.layers[-1])])
    z = [F.col(f"_z{i}") for i in range(len(LABELS))]
    held = held.select("*", *[F.exp(x - F.greatest(*z)).alias(f"_e{i}") for i, x in enumerate(z)])
    e = [F.greatest(F.lit(0.0), F.col(f"_e{i}")) for i in range(len(LABELS))]
    total = e[0] + e[1] + e[2]
    checked = F.when(total > 0, total).otherwise(F.raise_error(F.lit("the network gave no probability to any class")).cast("double"))
    held = held.select("*", *[(x / checked).alias(f"prob_{name}") for x, name in zip(e, LABELS)])
    return held.drop(*[c for c in held.columns if c.startswith(("_h", "_z", "_e"))])


def feature_text(features: Sequence[str]) -> Column:
    """Canonical text of a row's ticker, date and features: millionths as whole numbers, nothing for NULL."""
    parts = [F.coalesce(F.floor(F.col(f).cast("double") * 1e6 + 0.5).cast("string"), F.lit("")) for f in features]
    return F.concat_ws("|", F.col("ticker"), F.col("reference_date").cast("string"), *parts)


@dataclass(frozen=True)
class ModelCard:
    """What a prediction row says about its model and run."""

    model_id: str
    model_version: str
    feature_version: str = FEATURE_VERSION
    label_version: str | None = LABEL_VERSION
    config_version: str = "inference_v1"
    threshold: float = 0.60
    run_id: str = ""
    created_at: dt.datetime | None = None


def score_predictions(network: Network, scaler: DataFrame, rows: DataFrame, card: ModelCard, valid_for: dt.date | None = None) -> DataFrame:
    """Prediction rows: probabilities, action and confidence by the card's threshold, versions and audit hashes.

    ``valid_for`` is the given day or the column of that name. ``feature_snapshot`` hashes a row's features as they were
    before scaling; ``source_snapshot`` hashes all rows of its date, whatever their order: the row hashes are added up in
    two lanes, so no day is gathered in one place. Rows of other feature versions are an error.
    """
    features = list(network.features)
    require_columns(rows, ["ticker", "reference_date", *features])
    if valid_for is None:
        require_columns(rows, ["valid_for"])
    else:
        rows = rows.withColumn("valid_for", F.lit(valid_for))
    kept = ["ticker", "reference_date", "valid_for", *[c for c in ("dataset_split", "label_class") if c in rows.columns]]
    number = lambda c: (F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double")).alias(f"_{c}")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in rows.columns else F.lit(False)
    history = F.col("history_days") if "history_days" in rows.columns else F.lit(None).cast("long")
    flags = F.struct(*[flag(c).alias(c) for c in ("has_missing_ohlcv", "has_zero_volume", "is_suspicious_candle")])
    same = F.col("feature_version") == card.feature_version if "feature_version" in rows.columns else F.lit(True)
    audited = rows.select(
        *kept, *features, number("close"), number("financial_volume"),
        F.when(same, F.sha2(feature_text(features), 256)).otherwise(F.raise_error(F.lit("rows of another feature version")).cast("string")).alias("feature_snapshot"),
        F.to_json(F.struct(flags.alias("flags"), history.alias("history_days")), {"ignoreNullFields": "false"}).alias("metadata_json"),
    )
    lane = lambda at: F.sum(F.conv(F.substring("feature_snapshot", at, 15), 16, 10).cast("decimal(38,0)"))
    days = audited.groupBy("reference_date").agg(F.count(F.lit(1)).alias("_n"), lane(1).alias("_a"), lane(16).alias("_b"))
    days = days.select("reference_date", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("_n", "_a", "_b")]), 256).alias("source_snapshot"))
    action, confidence = suggested_action(F.col("prob_up"), F.col("prob_down"), card.threshold)
    scored = class_probabilities(apply_scaler(audited, scaler, features), network).join(days, "reference_date")
    return scored.select(
        *kept,
        F.lit(card.model_id).alias("model_id"),
        F.lit(card.model_version).alias("model_version"),
        F.lit(card.feature_version).alias("feature_version"),
        F.lit(card.label_version).alias("label_version"),
        F.lit(card.config_version).alias("inference_config_version"),
        "prob_up", "prob_down", "prob_neutral",
        action.alias("suggested_action"), confidence.alias("confidence"),
        F.lit(card.threshold).alias("decision_threshold"),
        F.col("_close").alias("close"), F.col("_financial_volume").alias("financial_volume"),
        "feature_snapshot", "source_snapshot",
        F.lit(card.run_id).alias("job_run_id"),
        F.lit(card.created_at).cast("timestamp").alias("created_at"),
        "metadata_json",
    )
