"""Autoencoder trained by local steps on shards and averaging per epoch.

McMahan et al.: Communication-Efficient Learning of Deep Networks from
Decentralized Data, AISTATS 2017. Kingma, Ba: Adam, ICLR 2015.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.operators.matrix import SEED, vector_width
from siftlog.session import stage

# Training settings.
EPOCHS = 8
BATCH = 1024
LEARNING_RATE = 1e-3
WEIGHT_DECAY = 1e-5
MOMENTS = (0.9, 0.999)
EPSILON = 1e-8

# Fewest shards, the most rows of one (about 2 MB of numbers), and the rows of a step in it.
SHARDS = 4
SHARD_ROWS = 16_384
STEP_ROWS = BATCH // SHARDS
# Tasks of an epoch for each core, and the most shards of one: a task hands on one sum of its states.
EPOCH_TASKS, TASK_SHARDS = 2, 64
# Parts of the state are summed as decimals: the sum is the same in any order.
PART = "decimal(38,20)"
STATE_SCHEMA = "rows long, steps long, loss double, state array<double>"


def layer_sizes(features: int) -> list[int]:
    """Input, hidden, latent, hidden, output."""
    hidden = min(max(4 * features, 16), 64)
    latent = min(max(2 * features, 8), 32)
    return [features, hidden, latent, hidden, features]


def _unpack(weights: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of each layer's matrix and bias in the flat weights."""
    layers, at = [], 0
    for fan_in, fan_out in zip(sizes, sizes[1:]):
        matrix = weights[at : at + fan_in * fan_out].reshape(fan_in, fan_out)
        at += fan_in * fan_out
        layers.append((matrix, weights[at : at + fan_out]))
        at += fan_out
    return layers


def _initial(sizes: list[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for fan_in, fan_out in zip(sizes, sizes[1:]):
        parts.append(rng.uniform(-1, 1, fan_in * fan_out + fan_out) / np.sqrt(fan_in))
    return np.concatenate(parts)


def _forward(values: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    outputs = [values]
    for i, (matrix, bias) in enumerate(layers):
        result = outputs[-1] @ matrix + bias
        outputs.append(np.maximum(result, 0) if i < len(layers) - 1 else result)
    return outputs


def _gradient(batch: np.ndarray, weights: np.ndarray, sizes: list[int]) -> tuple[float, np.ndarray]:
    """Mean squared error of a batch and its gradient."""
    layers = _unpack(weights, sizes)
    outputs = _forward(batch, layers)
    error = outputs[-1] - batch
    gradient = np.empty_like(weights)
    slots = _unpack(gradient, sizes)
    back = 2.0 * error / error.size
    for i in reversed(range(len(layers))):
        slots[i][0][:] = outputs[i].T @ back
        slots[i][1][:] = back.sum(axis=0)
        if i:
            back = (back @ layers[i][0].T) * (outputs[i] > 0)
    return float((error**2).mean()), gradient


@dataclass
class State:
    """Weights and Adam moments between epochs."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0


def _local_epoch(values: np.ndarray, state: State, sizes: list[int], batch: int, rng: np.random.Generator) -> tuple[State, float]:
    """One pass of Adam steps over a shard."""
    weights, first, second, steps = state.weights.copy(), state.first.copy(), state.second.copy(), state.steps
    losses = []
    order = rng.permutation(len(values))
    for start in range(0, len(order), batch):
        rows = values[order[start : start + batch]]
        loss, gradient = _gradient(rows, weights, sizes)
        losses.append(loss * len(rows))
        gradient += WEIGHT_DECAY * weights
        steps += 1
        first += (1 - MOMENTS[0]) * (gradient - first)
        second += (1 - MOMENTS[1]) * (gradient**2 - second)
        scale = np.sqrt(second / (1 - MOMENTS[1] ** steps)) + EPSILON
        weights -= LEARNING_RATE * (first / (1 - MOMENTS[0] ** steps)) / scale
    return State(weights, first, second, steps), sum(losses) / len(values)


@dataclass(frozen=True)
class Autoencoder:
    sizes: list[int]
    weights: np.ndarray
    losses: list[float]

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Mean squared reconstruction error per row."""
        return ((_forward(values, _unpack(self.weights, self.sizes))[-1] - values) ** 2).mean(axis=1)


def _mean_state(parts: DataFrame) -> tuple[float, int, np.ndarray]:
    """Loss, steps and the mean of the states, weighted by rows; one row per number of a state, whatever the shards."""
    weighted = F.transform(F.concat(F.array("loss"), F.col("state")), lambda value: value * F.col("rows"))
    each = parts.select("rows", "steps", F.posexplode(weighted).alias("place", "part"))
    summed = each.groupBy("place").agg(
        F.sum(F.col("part").cast(PART)).cast("double").alias("total"), F.sum("rows").alias("rows"), F.max("steps").alias("steps")
    )
    found = sorted(summed.collect(), key=lambda row: row["place"])
    means = np.array([row["total"] / row["rows"] for row in found])
    return float(means[0]), found[0]["steps"], means[1:]


def fit_autoencoder(
    sample: DataFrame, epochs: int = EPOCHS, seed: int = SEED, shards: int = SHARDS, shard_rows: int = SHARD_ROWS
) -> Autoencoder:
    """Train on `event_id` and `features`; the result does not depend on the input's layout.

    Rows belong to a shard by hash. There are at least `shards` of them, and
    more once they would pass `shard_rows` rows on average, so a task holds
    about as many rows whatever the input. They are packed once, with the only
    shuffle of rows; their states are averaged in Spark after each epoch.
    """
    width, rows = vector_width(sample), sample.count()
    shards = max(shards, -(-rows // shard_rows))
    sizes = layer_sizes(width)
    weights = _initial(sizes, seed)
    state = State(weights, np.zeros_like(weights), np.zeros_like(weights))
    placed = sample.select(
        "event_id", "features", F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(shards)).cast("int").alias("shard")
    )

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        # Rows of one id go by their values, so that the order is the same in any layout.
        flat = rows["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
        values = flat.reshape(len(rows), width)
        values = values[np.lexsort((*values.T[::-1], rows["event_id"].to_numpy().astype(str)))]
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "values": [values.ravel()]})

    # Each shard is a row in a file of its own, which the epochs read where they run.
    packed = stage(placed.groupBy("shard").applyInArrow(pack, "shard int, values array<double>"), "shards", "shard")
    trained = packed.coalesce(max(EPOCH_TASKS * sample.sparkSession.sparkContext.defaultParallelism, -(-shards // TASK_SHARDS)))
    losses = []
    for epoch in range(epochs):
        start = state

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, flat in zip(batch.column("shard").to_pylist(), batch.column("values")):
                    values = flat.values.to_numpy(zero_copy_only=False).reshape(-1, width)
                    rng = np.random.default_rng([seed, epoch, shard])
                    done, loss = _local_epoch(values, start, sizes, STEP_ROWS, rng)
                    numbers = np.concatenate([done.weights, done.first, done.second])
                    row = {"rows": [len(values)], "steps": [done.steps], "loss": [loss], "state": [numbers]}
                    yield pa.RecordBatch.from_pydict(row)

        loss, steps, numbers = _mean_state(trained.mapInArrow(train, STATE_SCHEMA))
        state = State(*np.split(numbers, 3), steps=steps)
        losses.append(loss)
    return Autoencoder(sizes, state.weights, losses)
