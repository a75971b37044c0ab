"""Linear forecasters from cross products: one per series, chosen by penalty, with spread and future marks.

A task adds up the products of its own windows, per series or over all; only those sums
of fixed size are shuffled, and merged sixteen at a time. Everything else follows from
them without reading a window again: coefficients for any penalty, the error they make
on any split whose sums are known, and the spread of the residuals.

Models of many series are solved on the executors, a batch of series at once, and go
back to the windows chunk by chunk.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tsengine.operators.chunks import SIZE, join_facts
from tsengine.operators.instance_norm import EPS

# Task code travels with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 4096  # windows handled at once inside a task
LISTS = ArrayType(DoubleType())


@dataclass(frozen=True)
class Shape:
    """Lags, steps and marks of a model. Marks are those of the step ahead, so they need ``horizon`` 1.

    ``normalised`` windows are fitted after subtracting the context's mean and dividing
    by its deviation; ``original`` sums weigh them back to the series' own scale.
    """

    context: int
    horizon: int
    marks: int = 0
    normalised: bool = True

    def __post_init__(self):
        if self.marks and (self.horizon != 1 or self.normalised):
            raise ValueError("marks need a one-step model of values as they are")

    @property
    def inputs(self) -> int:
        return self.context + self.marks

    @property
    def packed(self) -> int:
        return 1 + (self.inputs + 1) * (self.inputs + 2) // 2 + (self.inputs + 1) * self.horizon + self.horizon


@dataclass
class Sums:
    """Windows, [X 1]'[X 1], [X 1]'Y and the squares of Y; any number of models at once."""

    n: np.ndarray
    gram: np.ndarray
    cross: np.ndarray
    square: np.ndarray

    @classmethod
    def of(cls, packed: np.ndarray, shape: Shape) -> Sums:
        """From packed rows [models, packed]."""
        width, models = shape.inputs + 1, len(packed)
        row, column = np.triu_indices(width)
        gram = np.zeros((models, width, width))
        gram[:, row, column] = gram[:, column, row] = packed[:, 1 : 1 + len(row)]
        cross = packed[:, 1 + len(row) : -shape.horizon].reshape(models, width, shape.horizon)
        return cls(packed[:, 0], gram, cross, packed[:, -shape.horizon :])

    def errors(self, weights: np.ndarray, intercept: np.ndarray) -> np.ndarray:
        """Sum of squared residuals per model and step, of any coefficients on these windows."""
        w = np.concatenate([weights, intercept[:, None, :]], axis=1)
        fitted = np.einsum("mij,mih,mjh->mh", self.gram, w, w)
        return np.maximum(self.square - 2 * np.einsum("mih,mih->mh", w, self.cross) + fitted, 0.0)


def _pack(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    design = x
    products = design.T @ design
    row, column = np.triu_indices(design.shape[1])
    return np.concatenate([[len(x)], products[row, column], (design.T @ y).ravel(), np.einsum("wh,wh->h", y, y)])


def _lists(values: np.ndarray) -> pa.ListArray:
    rows, width = values.shape
    return pa.ListArray.from_arrays(np.arange(0, (rows + 1) * width, width, dtype="int32"), np.ascontiguousarray(values, "float64").ravel())


def _flat(column: pa.ListArray, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def _matrix(column: pa.ListArray, i: int) -> np.ndarray:
    """A row's array of equally long arrays as a matrix."""
    rows = column[i].values
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def chunk_windows(batch: pa.RecordBatch, i: int, length: int, size: int, names: Sequence[str]) -> tuple[int, dict[str, np.ndarray]]:
    """First start of a chunk's own windows, and views [windows, length, ...] of its arrays."""
    chunk, base = batch.column("chunk")[i].as_py(), batch.column("base")[i].as_py()
    made: dict[str, np.ndarray] = {}
    low = max(chunk * size, base)
    for name in names:
        column = batch.column(name)
        values = _matrix(column, i) if pa.types.is_list(column.type.value_type) else _flat(column, i)
        high = min(chunk * size + size - 1, base + len(values) - length)
        if high < low:
            return low, {}
        view = np.lib.stride_tricks.sliding_window_view(values, length, axis=0)
        view = np.moveaxis(view, -1, 1)  # [windows, length, ...], no copy
        made[name] = view[low - base : high - base + 1]
    return low, made


def _inputs(values: np.ndarray, marks: np.ndarray | None, shape: Shape, original: bool) -> tuple[np.ndarray, np.ndarray]:
    x, y = values[:, : shape.context], values[:, shape.context :]
    one = np.ones((len(x), 1))
    if shape.normalised:
        mean = x.mean(axis=1, keepdims=True)
        scale = np.sqrt(x.var(axis=1, keepdims=True) + EPS)
        x, y = x - mean, y - mean
        if original:
            one = scale
        else:
            x, y = x / scale, y / scale
    if shape.marks:
        x = np.hstack([x, marks[:, shape.context, : shape.marks]])
    return np.hstack([x, one]), y


def sums(
    chunks: DataFrame,
    shape: Shape,
    by: Sequence[str] = (),
    value: str = "v",
    marks: str = "marks",
    original: bool = False,
    size: int = SIZE,
) -> DataFrame:
    """``by`` columns and ``sums``: packed products of all windows of a group, one row each.

    With ``original`` the residuals that the sums stand for are on the series' own
    scale, also for a model of normalised windows.
    """
    keys = list(by)
    schema = StructType([*chunks.select(*keys).schema.fields, StructField("sums", LISTS)])
    names = [value, *([marks] if shape.marks else [])]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooled = np.zeros(shape.packed)
        for batch in batches:
            order: dict[tuple, tuple[int, np.ndarray]] = {}
            labels = list(zip(*[batch.column(k).to_pylist() for k in keys])) if keys else [()] * batch.num_rows
            for i, key in enumerate(labels):
                _, views = chunk_windows(batch, i, shape.context + shape.horizon, size, names)
                if not views:
                    continue
                total = pooled if not keys else order.setdefault(key, (i, np.zeros(shape.packed)))[1]
                for at in range(0, len(views[value]), BLOCK):
                    part = {n: v[at : at + BLOCK] for n, v in views.items()}
                    total += _pack(*_inputs(part[value], part.get(marks), shape, original))
            if order:
                rows = pa.array([i for i, _ in order.values()])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(rows) for k in keys], _lists(np.stack([t for _, t in order.values()]))], names=[*keys, "sums"]
                )
        if not keys and pooled[0]:
            yield pa.RecordBatch.from_arrays([_lists(pooled[None, :])], names=["sums"])

    parts = chunks.select(*dict.fromkeys([*keys, "chunk", "base", *names])).mapInArrow(add, schema)
    return merged(parts, keys)


def _add_all(column: str) -> Column:
    """Sum of arrays, place by place."""
    held = F.collect_list(column)
    add = lambda total, part: F.zip_with(total, part, lambda a, b: a + b)
    return F.aggregate(F.slice(held, F.lit(2), F.greatest(F.size(held), F.lit(1))), F.get(held, F.lit(0)), add)


def merged(parts: DataFrame, keys: Sequence[str], fan_in: int = 16, levels: int = 3) -> DataFrame:
    """One row per group; a reducer holds about ``fan_in`` arrays, however many tasks made them."""
    made = parts.withColumn("_task", F.spark_partition_id().cast("long"))
    for _ in range(levels):
        made = made.withColumn("_task", F.expr(f"_task div {fan_in}")).groupBy(*keys, "_task").agg(_add_all("sums").alias("sums"))
    return made.groupBy(*keys).agg(_add_all("sums").alias("sums"))


# --- solving -------------------------------------------------------------------------


def _centred(s: Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Products about the means, for a free intercept; directions without spread are exactly 0."""
    weight = np.maximum(s.gram[:, -1:, -1:], 1e-300)
    x_mean, y_mean = s.gram[:, :-1, -1] / weight[:, :, 0], s.cross[:, -1] / weight[:, :, 0]
    gram = s.gram[:, :-1, :-1] - weight * x_mean[:, :, None] * x_mean[:, None, :]
    cross = s.cross[:, :-1] - weight * x_mean[:, :, None] * y_mean[:, None, :]
    return gram, cross, x_mean, y_mean


def solve(s: Sums, penalty: float, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Weights [models, inputs, horizon] and intercepts [models, horizon].

    Cholesky where the penalised products allow it for the whole batch, else by
    eigenvectors, leaving out directions that the windows don't spread in.
    """
    gram, cross, x_mean, y_mean = _centred(s)
    scale = np.einsum("mii->m", s.gram[:, :-1, :-1])[:, None]
    if penalty > 0:
        factor = np.linalg.cholesky(gram + penalty * np.eye(gram.shape[1]) + tolerance * scale[:, :, None] * np.eye(gram.shape[1]))
        half = np.linalg.solve(factor, cross)
        weights = np.linalg.solve(np.swapaxes(factor, 1, 2), half)
    else:
        weights = path(s, [0.0], tolerance)[0][:, 0]
    return weights, y_mean - np.einsum("mi,mih->mh", x_mean, weights)


def path(s: Sums, penalties: Sequence[float], tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients for all penalties from one decomposition: [models, penalties, inputs, horizon] and intercepts."""
    gram, cross, x_mean, y_mean = _centred(s)
    values, vectors = np.linalg.eigh(gram)
    scale = np.einsum("mii->m", s.gram[:, :-1, :-1])[:, None]
    turned = np.einsum("mij,mih->mjh", vectors, cross)
    spread = values > tolerance * np.maximum(scale, 1e-300)
    levels = np.asarray(penalties, float)[None, :, None] + values[:, None, :]
    shrunk = np.where(spread[:, None, :], 1.0 / np.where(spread[:, None, :], levels, 1.0), 0.0)
    weights = np.einsum("mij,mpj,mjh->mpih", vectors, shrunk, turned)
    return weights, y_mean[:, None, :] - np.einsum("mi,mpih->mph", x_mean, weights)


def fitted(group_sums: DataFrame, keys: Sequence[str], shape: Shape, penalty: float = 1.0, rows: int = 256) -> DataFrame:
    """A model per row of ``sums``: keys, ``windows``, ``weights``, ``intercept``, ``sigma``.

    Arrays go step by step. ``sigma`` is the root mean squared residual of each step, out
    of the same sums (normalised windows: in units of the context's deviation).
    """
    names = list(keys)
    fields = [*group_sums.select(*names).schema.fields, StructField("windows", LongType())]
    schema = StructType([*fields, *[StructField(c, LISTS) for c in ("weights", "intercept", "sigma")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                packed = batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, shape.packed)
                s = Sums.of(packed, shape)
                weights, intercept = solve(s, penalty)
                sigma = np.sqrt(s.errors(weights, intercept) / s.n[:, None])
                by_step = np.swapaxes(weights, 1, 2).reshape(len(packed), -1)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k) for k in names], pa.array(s.n.astype("int64")), _lists(by_step), _lists(intercept), _lists(sigma)],
                    names=[*names, "windows", "weights", "intercept", "sigma"],
                )

    return group_sums.select(*names, "sums").mapInArrow(run, schema)


# --- forecasting ---------------------------------------------------------------------


def impulse(weights: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """A one-step model rolled out: lags' part [lags, horizon], and what a step's own input adds later.

    Predict, append, repeat is linear, so it is done once on the coefficients: a step's
    input (intercept and marks) adds ``response[h - k]`` to the step h from step k on.
    """
    lags = len(weights)
    known = np.eye(lags)
    response = np.zeros(horizon)
    pulse = np.zeros(lags)
    pulse[-1] = 1.0
    for h in range(horizon):
        known = np.column_stack([known, known[:, -lags:] @ weights])
        response[h] = pulse[-1]
        pulse = np.append(pulse[1:], pulse @ weights)
    return known[:, lags:], response


def forecast(
    chunks: DataFrame,
    models: DataFrame,
    keys: Sequence[str],
    shape: Shape,
    horizon: int | None = None,
    context: int | None = None,
    keep: Sequence[str] = (),
    value: str = "v",
    marks: str = "marks",
    first: str = "first",
    size: int = SIZE,
) -> DataFrame:
    """Every window's forecast by its own series' model: ``window_id``, arrays ``pred``, ``true``, ``sd``.

    ``models`` has ``keys``, ``n`` and what ``fitted`` gives; it is joined chunk by chunk,
    never by series alone. ``context`` is that of the windows, of which the model sees
    the last lags. A one-step model is rolled out to ``horizon``; with marks, over
    the true marks of the steps ahead, as one matrix product per chunk. ``sd`` (direct
    models) is the step's sigma on the window's scale.
    """
    steps, seen = horizon or shape.horizon, context or shape.context
    rolled = steps != shape.horizon or shape.marks > 0
    if rolled and (shape.horizon != 1 or shape.normalised):
        raise ValueError("only a one-step model of values as they are can be rolled out")
    names = list(dict.fromkeys([*keys, *keep]))
    joined = join_facts(chunks, models.select(*keys, "n", "weights", "intercept", "sigma"), list(keys), size)
    arrays = [value, *([marks] if shape.marks else [])]
    schema = StructType(
        [*joined.select(*names).schema.fields, StructField("window_id", LongType()), *[StructField(c, LISTS) for c in ("pred", "true", "sd")]]
    )

    def made(values: np.ndarray, marked: np.ndarray | None, weights: np.ndarray, intercept: np.ndarray, sigma: np.ndarray):
        x, y = values[:, seen - shape.context : seen], values[:, seen:]
        if rolled:
            lags, response = impulse(weights[0, : shape.context], steps)
            toeplitz = np.array([[response[h - k] if h >= k else 0.0 for h in range(steps)] for k in range(steps)])
            inputs = np.full((len(x), steps), intercept[0])
            if shape.marks:
                inputs = inputs + marked[:, seen:, : shape.marks] @ weights[0, shape.context :]
            spread = sigma[0] * np.sqrt(np.cumsum(response**2))
            return x @ lags + inputs @ toeplitz, y, np.broadcast_to(spread, y.shape)
        mean, scale = np.zeros((len(x), 1)), np.ones((len(x), 1))
        if shape.normalised:
            mean, scale = x.mean(axis=1, keepdims=True), np.sqrt(x.var(axis=1, keepdims=True) + EPS)
        return ((x - mean) / scale @ weights.T + intercept) * scale + mean, y, sigma * scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                low, views = chunk_windows(batch, i, seen + steps, size, arrays)
                if not views:
                    continue
                weights = _flat(batch.column("weights"), i).reshape(shape.horizon, shape.inputs)
                intercept, sigma = _flat(batch.column("intercept"), i), _flat(batch.column("sigma"), i)
                origin = batch.column(first)[i].as_py()
                for at in range(0, len(views[value]), BLOCK):
                    part = {n: v[at : at + BLOCK] for n, v in views.items()}
                    out = made(part[value], part.get(marks), weights, intercept, sigma)
                    count = len(part[value])
                    rows = pa.array(np.full(count, i))
                    ids = pa.array(np.arange(low + at, low + at + count) - origin, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(k).take(rows) for k in names], ids, *map(_lists, out)], names=[*names, "window_id", "pred", "true", "sd"]
                    )

    columns = dict.fromkeys([*names, "chunk", "base", *arrays, first, "weights", "intercept", "sigma"])
    return joined.select(*columns).mapInArrow(run, schema)


def by_step(scored: DataFrame) -> DataFrame:
    """Scored arrays to one row per step."""
    rest = [c for c in scored.columns if c not in ("pred", "true", "sd")]
    each = scored.select(*rest, F.posexplode(F.arrays_zip("pred", "true", "sd")).alias("_i", "_s"))
    return each.select(*rest, (F.col("_i") + 1).alias("step"), *[F.col("_s")[c].alias(c) for c in ("pred", "true", "sd")])


# --- choosing ------------------------------------------------------------------------


@dataclass(frozen=True)
class Choice:
    """The penalty with the least validation loss, its loss, all losses, and the model."""

    penalty: float
    loss: float
    losses: tuple[float, ...]
    weights: np.ndarray
    intercept: np.ndarray


def choose(train: Sums, validation: Sums, penalties: Sequence[float]) -> Choice:
    """Pooled model: one decomposition gives every penalty, validation sums give every loss.

    Ties go to the larger penalty.
    """
    weights, intercept = path(train, penalties)
    losses = []
    for p in range(len(penalties)):
        errors = validation.errors(weights[:, p], intercept[:, p])
        losses.append(float(errors.sum() / (validation.n.sum() * errors.shape[1])))
    best = min(range(len(penalties)), key=lambda p: (losses[p], -penalties[p]))
    return Choice(penalties[best], losses[best], tuple(losses), weights[0, best], intercept[0, best])


def collected(pooled: DataFrame, shape: Shape) -> Sums:
    """Pooled sums, one row of fixed size, to the driver."""
    row = pooled.first()
    if row is None or row["sums"] is None:
        raise ValueError("no window to learn from")
    return Sums.of(np.array(row["sums"], dtype="float64")[None, :], shape)
