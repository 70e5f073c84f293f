"""Probability calibrator: standardise -> ReLU network -> sigmoid.

Training is data parallel: every epoch each partition runs minibatch Adam on its
own rows inside one Arrow task, and the partition models are averaged weighted by
rows (iterative parameter mixing, McDonald et al. 2010). With one partition this
is plain minibatch training. Only the weights - some thousand numbers - travel
between driver and tasks. Scoring is one Arrow UDF.

``backend="sigmoid"`` swaps in ``MultilayerPerceptronClassifier`` (sigmoid hidden
units, L-BFGS), which trains entirely in the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrafdr.operators import scale
from spectrafdr.operators.filters import boolean_labels, labelled, require_rows
from spectrafdr.operators.split import sample_at_most

STD_FLOOR = 1e-8


# --- feature matrix ---------------------------------------------------------


def check_feature_columns(columns: list[str]) -> list[str]:
    columns = list(columns)
    if "confidence" in columns:
        raise ValueError("'confidence' is always the first input; do not list it as a feature")
    twice = sorted({c for c in columns if columns.count(c) > 1})
    if twice:
        raise ValueError(f"duplicate feature columns: {twice}")
    return columns


def numeric_feature_columns(df: DataFrame) -> list[str]:
    """Numeric and boolean columns in file order, without label, score and id."""
    kinds = (T.NumericType, T.BooleanType)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, kinds) and f.name not in ("correct", "confidence")
    ]


def feature_matrix(df: DataFrame, columns: list[str], label: str | None = "correct") -> DataFrame:
    """``[confidence, *columns, label?]`` as doubles, selected by name."""
    columns = check_feature_columns(columns)
    missing = [c for c in ["confidence", *columns] if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature column(s) {missing}; available: {sorted(df.columns)}")
    picked = [F.col(f"`{c}`").cast("double").alias(c) for c in ["confidence", *columns]]
    if label:
        picked.append(F.col(label).cast("boolean").cast("double").alias(label))
    return df.select(*picked)


def standardisation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and sample standard deviation (floored) per column, one pass."""
    stats = df.agg(
        *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(f"`{c}`").alias(f"s{i}") for i, c in enumerate(columns)],
    )
    return stats.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.col(f"m{i}").alias("mean"),
                        F.greatest(F.coalesce(f"s{i}", F.lit(0.0)), F.lit(STD_FLOOR)).alias("std"),
                    )
                    for i, c in enumerate(columns)
                ]
            )
        ).alias("s")
    ).select("s.*")


# --- network kernel ---------------------------------------------------------


def init_weights(dims: list[int], seed: int) -> list[np.ndarray]:
    """Uniform(-1/sqrt(fan_in), 1/sqrt(fan_in)) weights and biases, layer by layer."""
    rng = np.random.default_rng(seed)
    out = []
    for fan_in, fan_out in zip(dims[:-1], dims[1:]):
        bound = 1.0 / np.sqrt(fan_in)
        out.append(rng.uniform(-bound, bound, (fan_out, fan_in)))
        out.append(rng.uniform(-bound, bound, fan_out))
    return out


def forward(weights: list[np.ndarray], x: np.ndarray, drop=None) -> tuple[np.ndarray, list]:
    """Logits and the layer inputs; ``drop(shape)`` yields dropout multipliers."""
    inputs = [x]
    last = len(weights) // 2 - 1
    for layer in range(last + 1):
        z = inputs[-1] @ weights[2 * layer].T + weights[2 * layer + 1]
        if layer == last:
            return z[:, 0], inputs
        hidden = np.maximum(z, 0.0)
        inputs.append(hidden * drop(hidden.shape) if drop else hidden)
    raise ValueError("a network needs at least one layer")


def gradients(weights, inputs, delta, keep: float) -> list[np.ndarray]:
    """Back-propagate ``delta`` = d loss / d logit (already averaged over the batch)."""
    grads = [None] * len(weights)
    delta = delta[:, None]
    for layer in range(len(weights) // 2 - 1, -1, -1):
        grads[2 * layer] = delta.T @ inputs[layer]
        grads[2 * layer + 1] = delta.sum(axis=0)
        if layer:
            # A unit is active where its (scaled, not dropped) output is positive.
            delta = (delta @ weights[2 * layer]) * (inputs[layer] > 0) / keep
    return grads


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.where(z >= 0, 1.0 / (1.0 + np.exp(-np.abs(z))), 1.0 - 1.0 / (1.0 + np.exp(-np.abs(z))))


def logistic_loss(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0.0) - y * z


class _Adam:
    """Adam with L2 added to the gradient; state is a flat vector so it can be averaged."""

    def __init__(self, flat: np.ndarray, state: dict, rate: float, decay: float):
        self.flat, self.rate, self.decay = flat, rate, decay
        self.m, self.v, self.t = state["m"].copy(), state["v"].copy(), state["t"]

    def step(self, grad: np.ndarray) -> None:
        grad = grad + self.decay * self.flat
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        m_hat = self.m / (1 - 0.9**self.t)
        v_hat = self.v / (1 - 0.999**self.t)
        self.flat = self.flat - self.rate * m_hat / (np.sqrt(v_hat) + 1e-8)


def _unflatten(flat: np.ndarray, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    out, at = [], 0
    for shape in shapes:
        size = int(np.prod(shape))
        out.append(flat[at : at + size].reshape(shape))
        at += size
    return out


def _flatten(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in parts])


# Without a given number, one shard per so many rows.
ROWS_PER_SHARD = 200_000
LEAST_SHARDS = 4
# Rows of one matrix product, and sums that one task of the tree adds up.
ROWS_AT_ONCE = 8192
FAN_IN = 32
_SUM_SCHEMA = "n bigint, loss double, g array<double>"
_EPOCH_SCHEMA = (
    "n bigint, loss double, batches bigint, t bigint, w array<double>, m array<double>, v array<double>"
)


@dataclass
class TrainingHistory:
    train_losses: list[float] = field(default_factory=list)
    val_losses: list[float] | None = None
    val_accuracies: list[float] | None = None
    epochs_trained: int = 0
    best_epoch: int = -1
    final_val_loss: float | None = None
    final_val_accuracy: float | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per epoch."""
        n = len(self.train_losses)
        val = self.val_losses or [None] * n
        acc = self.val_accuracies or [None] * n
        return spark.createDataFrame(
            list(zip(range(n), self.train_losses, val, acc)),
            "epoch int, train_loss double, val_loss double, val_accuracy double",
        )


@dataclass
class ProbabilityCalibrator:
    feature_columns: list[str]
    hidden_dims: tuple[int, ...] = (128, 64)
    dropout: float = 0.1
    learning_rate: float = 1e-3
    weight_decay: float = 1e-4
    max_epochs: int = 100
    batch_size: int = 1024
    n_iter_no_change: int = 10
    tol: float = 1e-4
    seed: int = 42
    val_early_stopping_max_psms: int | None = None
    val_subsample_seed: int | None = None
    backend: str = "relu"
    shards: int | None = None
    synchronous: bool = False
    steps_per_epoch: int = 1
    mean: list[float] | None = field(default=None, init=False)
    std: list[float] | None = field(default=None, init=False)
    weights: list[np.ndarray] | None = field(default=None, init=False, repr=False)

    def __post_init__(self):
        self.feature_columns = check_feature_columns(self.feature_columns)
        if self.backend not in ("relu", "sigmoid"):
            raise ValueError(f"unknown backend {self.backend!r}")
        self._sigmoid_model = None

    @property
    def inputs(self) -> list[str]:
        return ["confidence", *self.feature_columns]

    @property
    def is_fitted(self) -> bool:
        return self.mean is not None

    # -- training --

    def fit(
        self,
        train: DataFrame,
        val: DataFrame | None = None,
        label: str = "correct",
        id_column: str | None = None,
        epoch_callback: Callable[[int, float], None] | None = None,
    ) -> TrainingHistory:
        """Fit on labelled rows that already carry the feature columns.

        The schema is frozen afterwards. ``id_column`` (unique) is only needed to
        subsample a validation set for early stopping.
        """
        if self.is_fitted:
            raise ValueError("the calibrator is fitted; its feature schema is frozen")
        rows = boolean_labels(labelled(train), label)
        # Stored once: every epoch reads the narrow matrix again.
        matrix = scale.materialise(feature_matrix(rows, self.feature_columns, label))
        n_rows = matrix.count()
        if n_rows == 0:
            raise ValueError("training requires at least one labelled row")
        if not self.synchronous:
            if self.shards is None:
                self.shards = max(LEAST_SHARDS, -(-n_rows // ROWS_PER_SHARD))
            matrix = self._spread(matrix)
        stats = {
            r["feature"]: (r["mean"], r["std"])
            for r in standardisation(matrix, self.inputs).collect()
        }
        mean, std = zip(*[stats[c] for c in self.inputs])
        full = early = None
        if val is not None:
            val_rows = boolean_labels(labelled(val), label)
            keep = val_rows
            if self.val_early_stopping_max_psms:
                if id_column is None:
                    raise ValueError("val_early_stopping_max_psms needs id_column")
                keep = sample_at_most(
                    val_rows,
                    id_column,
                    self.val_early_stopping_max_psms,
                    self.seed if self.val_subsample_seed is None else self.val_subsample_seed,
                )
            early = scale.materialise(feature_matrix(keep, self.feature_columns, label))
            full = feature_matrix(val_rows, self.feature_columns, label) if keep is not val_rows else None
        if self.backend == "sigmoid":
            history = self._fit_sigmoid(matrix, label)
        else:
            history = self._fit_relu(
                matrix, early, label, np.array(mean), np.array(std), epoch_callback
            )
        self.mean, self.std = list(mean), list(std)
        if full is not None:
            final = self._evaluate(full, label, self.weights, np.array(mean), np.array(std))
            history.final_val_loss, history.final_val_accuracy = final
        return history

    def _spread(self, matrix: DataFrame) -> DataFrame:
        """Deal rows to ``shards`` tasks in one seeded order.

        ``shards`` models are trained and averaged per epoch. The number is a parameter, or one
        per ``ROWS_PER_SHARD`` rows, and is saved with the model. Rows go to shards, and stand
        in them, by a seeded hash of their values, copies of a row to one shard after the
        other. So no session setting and no layout of files changes the fit, and a repeated
        row with a third of the table is spread like any other.
        """
        columns = [F.col(f"`{c}`") for c in matrix.columns]
        counted = matrix.groupBy(*columns).agg(F.count("*").alias("_n"))
        shards = F.lit(self.shards).cast("long")
        share = F.call_function("div", F.col("_n"), shards) + (F.col("_i") < F.col("_n") % shards).cast("long")
        dealt = counted.withColumn("_key", F.xxhash64(F.lit(self.seed), *columns)).withColumn(
            "_i", F.explode(F.sequence(F.lit(0).cast("long"), F.least("_n", shards) - 1))
        ).withColumn("_times", share)
        shard = F.pmod(F.pmod("_key", shards) + F.col("_i"), shards).cast("int")
        placed = dealt.repartitionById(self.shards, shard).sortWithinPartitions("_key")
        again = placed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
        return scale.materialise(again.select(*columns))

    def _fit_relu(self, matrix, early, label, mean, std, epoch_callback) -> TrainingHistory:
        weights = init_weights([len(self.inputs), *self.hidden_dims, 1], self.seed)
        shapes = [w.shape for w in weights]
        flat = _flatten(weights)
        state = {"m": np.zeros_like(flat), "v": np.zeros_like(flat), "t": 0}
        history = TrainingHistory()
        if early is not None:
            history.val_losses, history.val_accuracies = [], []
        best_loss, best_flat, misses = float("inf"), None, 0
        one_pass = self._synchronous_epoch if self.synchronous else self._epoch
        for epoch in range(self.max_epochs):
            flat, state, loss = one_pass(matrix, label, flat, shapes, state, mean, std, epoch)
            history.train_losses.append(loss)
            if early is None:
                history.best_epoch = epoch
                continue
            val_loss, val_acc = self._evaluate(early, label, _unflatten(flat, shapes), mean, std)
            history.val_losses.append(val_loss)
            history.val_accuracies.append(val_acc)
            if epoch_callback:
                epoch_callback(epoch, val_loss)
            # An epoch counts as progress only if it beats the best loss by ``tol``.
            if val_loss <= best_loss - self.tol:
                best_loss, best_flat, misses = val_loss, flat, 0
                history.best_epoch = epoch
            else:
                misses += 1
                if misses >= self.n_iter_no_change:
                    break
        history.epochs_trained = len(history.train_losses)
        self.weights = _unflatten(flat if best_flat is None else best_flat, shapes)
        return history

    def _epoch(self, matrix, label, flat, shapes, state, mean, std, epoch):
        """One pass of every partition from the same start, then a weighted average."""
        inputs, batch, dropout = self.inputs, self.batch_size, self.dropout
        rate, decay, seed = self.learning_rate, self.weight_decay, self.seed
        keep = 1.0 - dropout

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rng = np.random.default_rng([seed, epoch, _partition_id()])
            adam = _Adam(flat, state, rate, decay)
            n = batches = 0
            loss = 0.0
            drop = None
            if dropout > 0:
                drop = lambda shape: (rng.random(shape) < keep) / keep
            for frame in frames:
                x = (frame[inputs].to_numpy(np.float64) - mean) / std
                y = frame[label].to_numpy(np.float64)
                order = rng.permutation(len(y))
                for at in range(0, len(y), batch):
                    pick = order[at : at + batch]
                    weights = _unflatten(adam.flat, shapes)
                    z, layers = forward(weights, x[pick], drop)
                    grad = gradients(weights, layers, (sigmoid(z) - y[pick]) / len(pick), keep)
                    adam.step(_flatten(grad))
                    loss += float(logistic_loss(z, y[pick]).mean())
                    batches += 1
                n += len(y)
            if n:
                yield pd.DataFrame(
                    {
                        "n": [n], "loss": [loss], "batches": [batches], "t": [adam.t],
                        "w": [adam.flat], "m": [adam.m], "v": [adam.v],
                    }
                )

        parts = matrix.mapInPandas(run, _EPOCH_SCHEMA)
        merged = _average(parts)
        new_state = {"m": merged["m"], "v": merged["v"], "t": merged["t"]}
        return merged["w"], new_state, merged["loss"]

    def _synchronous_epoch(self, matrix, label, flat, shapes, state, mean, std, epoch):
        """``steps_per_epoch`` steps, each on the gradient of all its rows in all tasks.

        A row's step, and whether its units are dropped, follow from a seeded hash of its
        values. Tasks return sums, which are added up in a tree; so any number of tasks can
        work and the result does not depend on it, up to the rounding of sums.
        """
        inputs, keep, seed = self.inputs, 1.0 - self.dropout, self.seed
        adam = _Adam(flat, state, self.learning_rate, self.weight_decay)
        chosen = F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), *[F.col(f"`{c}`") for c in matrix.columns]), F.lit(2**62))
        losses = []
        for step in range(self.steps_per_epoch):
            rows = matrix.withColumn("_h", chosen).filter(F.col("_h") % self.steps_per_epoch == step)
            now = adam.flat

            def run(frames: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
                weights, total, loss, n = _unflatten(now, shapes), np.zeros_like(now), 0.0, 0
                for whole in frames:
                    for at in range(0, len(whole), ROWS_AT_ONCE):
                        frame = whole.iloc[at : at + ROWS_AT_ONCE]
                        x = (frame[inputs].to_numpy(np.float64) - mean) / std
                        y = frame[label].to_numpy(np.float64)
                        drop = _hashed_dropout(frame["_h"].to_numpy(np.uint64), keep) if keep < 1 else None
                        z, layers = forward(weights, x, drop)
                        total += _flatten(gradients(weights, layers, sigmoid(z) - y, keep))
                        loss += float(logistic_loss(z, y).sum())
                        n += len(y)
                if n:
                    yield pd.DataFrame({"n": [n], "loss": [loss], "g": [total]})

            found = _summed(rows.mapInPandas(run, _SUM_SCHEMA))
            if found is None:
                continue
            n, loss, gradient = found
            adam.step(gradient / n)
            losses.append(loss / n)
        return adam.flat, {"m": adam.m, "v": adam.v, "t": adam.t}, float(np.mean(losses)) if losses else float("nan")

    def _fit_sigmoid(self, matrix, label) -> TrainingHistory:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import MultilayerPerceptronClassifier
        from pyspark.ml.feature import StandardScaler, VectorAssembler

        stages = [
            VectorAssembler(inputCols=self.inputs, outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
            MultilayerPerceptronClassifier(
                featuresCol="_x", labelCol=label, layers=[len(self.inputs), *self.hidden_dims, 2],
                maxIter=self.max_epochs, tol=self.tol, seed=self.seed,
                probabilityCol="_prob", predictionCol="_pred", rawPredictionCol="_rawp",
            ),
        ]
        self._sigmoid_model = Pipeline(stages=stages).fit(matrix)
        trace = [float(x) for x in self._sigmoid_model.stages[-1].summary().objectiveHistory]
        return TrainingHistory(
            train_losses=trace, epochs_trained=len(trace), best_epoch=len(trace) - 1
        )

    # -- scoring --

    def _evaluate(self, matrix, label, weights, mean, std) -> tuple[float, float]:
        if self.backend == "sigmoid":
            p = self._score_sigmoid(matrix).select("calibrated_confidence", label)
            q = F.least(F.greatest("calibrated_confidence", F.lit(1e-12)), F.lit(1 - 1e-12))
            y = F.col(label)
            row = p.agg(
                F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))),
                F.avg(((q > 0.5).cast("double") == y).cast("double")),
            ).first()
            return row[0], row[1]
        from spectrafdr.operators.evaluation import classification_metrics

        scored = matrix.withColumn("_z", self._logit_udf(weights, mean, std)(*self._input_cols()))
        row = classification_metrics(scored, "_z", label).first()
        return row["loss"], row["accuracy"]

    def _input_cols(self):
        return [F.col(f"`{c}`").cast("double") for c in self.inputs]

    @staticmethod
    def _logit_udf(weights, mean, std, squash: bool = False):
        @F.pandas_udf(T.DoubleType())
        def logit(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(np.float64) for c in columns])
            z, _ = forward(weights, (x - mean) / std)
            return pd.Series(sigmoid(z) if squash else z)

        return logit

    def _score_sigmoid(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        scored = self._sigmoid_model.transform(df)
        return scored.withColumn(
            "calibrated_confidence", vector_to_array("_prob")[1]
        ).drop("_raw", "_x", "_prob", "_pred", "_rawp")

    def predict(self, df: DataFrame, check_empty: bool = True) -> DataFrame:
        """Add ``calibrated_confidence``; lazy and stateless apart from the emptiness check."""
        if not self.is_fitted:
            raise ValueError("the calibrator is not fitted")
        missing = [c for c in self.inputs if c not in df.columns]
        if missing:
            raise ValueError(f"missing feature column(s) {missing}; available: {sorted(df.columns)}")
        if check_empty and not df.isStreaming:
            require_rows(df, "nothing to score: the input is empty")
        if self.backend == "sigmoid":
            return self._score_sigmoid(df)
        score = self._logit_udf(self.weights, np.array(self.mean), np.array(self.std), squash=True)
        return df.withColumn("calibrated_confidence", score(*self._input_cols()))

    # -- persistence --

    def _config(self) -> dict:
        config = asdict(self)
        for transient in ("mean", "std", "weights"):
            config.pop(transient)
        return config

    def save(self, spark: SparkSession, path: str) -> None:
        """Config and standardisation as one JSON row, weights as a layer table."""
        if not self.is_fitted:
            raise ValueError("the calibrator is not fitted")
        meta = json.dumps({"config": self._config(), "mean": self.mean, "std": self.std})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/metadata")
        if self.backend == "sigmoid":
            self._sigmoid_model.write().overwrite().save(f"{path}/model")
            return
        layers = [
            (i, list(w.shape), w.ravel().tolist()) for i, w in enumerate(self.weights)
        ]
        spark.createDataFrame(
            layers, "position int, shape array<int>, data array<double>"
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ProbabilityCalibrator:
        meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        if not {"config", "mean", "std"} <= set(meta) or "feature_columns" not in meta["config"]:
            raise ValueError(f"{path} is not a calibrator of this version")
        config = meta["config"]
        config["hidden_dims"] = tuple(config["hidden_dims"])
        model = cls(**config)
        if len(meta["mean"]) != len(model.inputs) or len(meta["std"]) != len(model.inputs):
            raise ValueError("saved standardisation does not match the feature columns")
        if model.backend == "sigmoid":
            from pyspark.ml import PipelineModel

            model._sigmoid_model = PipelineModel.load(f"{path}/model")
        else:
            rows = spark.read.parquet(f"{path}/weights").orderBy("position").collect()
            model.weights = [np.array(r["data"]).reshape(r["shape"]) for r in rows]
            dims = [len(model.inputs), *model.hidden_dims, 1]
            wanted = [s for a, b in zip(dims[:-1], dims[1:]) for s in ((b, a), (b,))]
            if [w.shape for w in model.weights] != wanted:
                raise ValueError("saved weights do not match the configured layers")
        model.mean, model.std = meta["mean"], meta["std"]
        return model


def _hashed_dropout(hashes: np.ndarray, keep: float):
    """Dropout multipliers that depend on the row's hash, the unit and the layer alone."""
    layer = 0

    def drop(shape):
        nonlocal layer
        layer += 1
        unit = np.arange(1, shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(layer)
        mixed = (hashes[:, None] ^ unit[None, :]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return ((mixed >> np.uint64(11)) / float(1 << 53) < keep) / keep

    return drop


def _summed(parts: DataFrame) -> tuple[int, float, np.ndarray] | None:
    """Sums of ``n, loss, g`` over all rows: rounds of ``FAN_IN`` rows a task, one row to the driver."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, loss, g = 0, 0.0, None
        for frame in frames:
            n += int(frame["n"].sum())
            loss += float(frame["loss"].sum())
            own = np.sum(np.stack(frame["g"].to_list()), axis=0) if len(frame) else 0.0
            g = own if g is None else g + own
        if n:
            yield pd.DataFrame({"n": [n], "loss": [loss], "g": [g]})

    tasks = parts.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        parts = parts.repartition(tasks).mapInPandas(add, _SUM_SCHEMA)
    rows = parts.collect()
    return (rows[0]["n"], rows[0]["loss"], np.array(rows[0]["g"])) if rows else None


def _partition_id() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def _average(parts: DataFrame) -> dict:
    """Row-weighted mean of the partition models, summed element-wise in Spark."""
    spread = parts.select(
        "n", "loss", "batches", "t", F.posexplode(F.arrays_zip("w", "m", "v"))
    )
    summed = spread.groupBy("pos").agg(
        (F.sum(F.col("n") * F.col("col.w")) / F.sum("n")).alias("w"),
        (F.sum(F.col("n") * F.col("col.m")) / F.sum("n")).alias("m"),
        (F.sum(F.col("n") * F.col("col.v")) / F.sum("n")).alias("v"),
        F.max("t").alias("t"),
        (F.sum("loss") / F.sum("batches")).alias("loss"),
    )
    rows = summed.toPandas().sort_values("pos")  # one row per weight
    return {
        "w": rows["w"].to_numpy(),
        "m": rows["m"].to_numpy(),
        "v": rows["v"].to_numpy(),
        "t": int(rows["t"].iloc[0]),
        "loss": float(rows["loss"].iloc[0]),
    }
