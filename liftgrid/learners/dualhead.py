"""Dual-head network: a shared representation with one output head per arm.

Training alternates between tasks and driver. Units are dealt to learners, and ordered in them, by a digest of
their key. In each epoch every learner starts from the current weights, runs minibatch steps over its rows
and returns its weights; these are averaged in proportion to rows, first among groups of learners on
executors and then on the driver, always in the same order. An epoch is therefore one scan of the training
rows, however many rows there are, a bounded number of weight vectors reaches the driver, and the result
follows from the rows alone, not from partitions or cores. With one learner it is a single minibatch sequence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftgrid.functions.hashing import draw
from liftgrid.learners.manifest import stored, storing
from liftgrid.session import keep
from liftgrid.spec import ExperimentSpec

_COMBINERS = 64  # most weight vectors that reach the driver
HISTORY = "epoch int, loss double, val_loss double, rate double"


@dataclass(frozen=True)
class NetParams:
    """Network and training settings.

    A learner trains on about ``learner_rows`` rows, whatever the cluster; ``learners`` states their number instead.
    """

    shared: int = 64
    head: int = 32
    dropout: float = 0.10
    epochs: int = 8
    batch: int = 4096
    rate: float = 1e-3
    decay: float = 1e-4
    clip: float = 1.0
    plateau: int = 1
    patience: int = 3
    learner_rows: int = 1 << 16
    learners: int | None = None
    seed: int = 42


def layout(features: int, p: NetParams) -> list[tuple[str, tuple[int, ...]]]:
    """Names and shapes of the weights inside the flat vector."""
    dims = [("w1", (features, p.shared)), ("b1", (p.shared,))]
    dims += [("w2", (p.shared, p.shared)), ("b2", (p.shared,))]
    for h in ("0", "1"):
        dims += [(f"u{h}", (p.shared, p.head)), (f"c{h}", (p.head,))]
        dims += [(f"v{h}", (p.head,)), (f"d{h}", ())]
    return dims


def unpack(flat: np.ndarray, dims: list[tuple[str, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    parts, at = {}, 0
    for name, shape in dims:
        size = math.prod(shape)
        parts[name] = flat[at : at + size].reshape(shape)
        at += size
    return parts


def initial_weights(features: int, p: NetParams, base_rate: float) -> np.ndarray:
    """Uniform weights scaled by fan-in; output biases start at the log-odds of the base rate."""
    rng = np.random.default_rng(p.seed)
    rate = min(max(base_rate, 1e-6), 1 - 1e-6)
    fan = {"w1": features, "b1": features, "w2": p.shared, "b2": p.shared}
    flat = []
    for name, shape in layout(features, p):
        if name.startswith("d"):
            flat.append(np.array([math.log(rate / (1 - rate))]))
            continue
        inputs = fan.get(name) or (p.shared if name[0] in "uc" else p.head)
        bound = 1 / math.sqrt(inputs)
        flat.append(rng.uniform(-bound, bound, math.prod(shape)))
    return np.concatenate(flat)


class Work:
    """Working arrays by name, used again for every batch: the system clears the pages of a new large array each time."""

    def __init__(self) -> None:
        self._own: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self._own or self._own[name].size < size:
            self._own[name] = np.empty(size)
        return self._own[name][:size].reshape(shape)


def _layer(x: np.ndarray, weights: np.ndarray, bias: np.ndarray, work: Work, name: str) -> np.ndarray:
    """``x`` times ``weights`` plus ``bias`` through exponential linear units, in the working array ``name``."""
    out = np.matmul(x, weights, out=work(name, len(x), weights.shape[1]))
    out += bias
    low = np.minimum(out, 0.0, out=work("low", *out.shape))
    np.expm1(low, out=low)
    np.maximum(out, 0.0, out=out)
    out += low
    return out


def _times_slope(d: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Multiply ``d`` by the slope of the units with output ``h``; both arrays are overwritten."""
    np.minimum(h, 0.0, out=h)
    h += 1.0
    d *= h
    return d


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * a))


def forward(w: dict[str, np.ndarray], x: np.ndarray, work: Work | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Both heads' log-odds, without dropout."""
    work = work or Work()
    phi = _layer(_layer(x, w["w1"], w["b1"], work, "h1"), w["w2"], w["b2"], work, "h2")
    heads = (_layer(phi, w[f"u{h}"], w[f"c{h}"], work, "hidden") @ w[f"v{h}"] + w[f"d{h}"] for h in "01")
    return tuple(heads)


def arm_losses(
    w: dict[str, np.ndarray], x: np.ndarray, t: np.ndarray, y: np.ndarray, work: Work | None = None
) -> np.ndarray:
    """Summed cross-entropy and rows of each arm: [loss0, n0, loss1, n1]."""
    z0, z1 = forward(w, x, work)
    out = []
    for arm, z in ((0, z0), (1, z1)):
        own = t == arm
        zz, yy = z[own], y[own]
        loss = np.maximum(zz, 0) - zz * yy + np.log1p(np.exp(-np.abs(zz)))
        out += [float(loss.sum()), float(own.sum())]
    return np.array(out)


def balanced(sums: np.ndarray) -> float:
    """Half the mean loss of each arm, so the larger arm does not dominate."""
    l0, n0, l1, n1 = sums
    return 0.5 * (l0 / n0 if n0 else 0.0) + 0.5 * (l1 / n1 if n1 else 0.0)


def loss_gradient(
    flat: np.ndarray,
    dims: list[tuple[str, tuple[int, ...]]],
    x: np.ndarray,
    t: np.ndarray,
    y: np.ndarray,
    dropout: float = 0.0,
    rng: np.random.Generator | None = None,
    work: Work | None = None,
) -> tuple[float, np.ndarray]:
    """Arm-balanced loss of a batch and its gradient."""
    w, work = unpack(flat, dims), work or Work()
    grad = np.zeros_like(flat)
    g = unpack(grad, dims)

    def dropped(h: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray | None]:
        if not dropout or rng is None:
            return h, None
        kept = rng.random(out=work(f"m{name}", *h.shape))
        np.greater_equal(kept, dropout, out=kept)
        kept /= 1 - dropout
        return np.multiply(h, kept, out=work(f"a{name}", *h.shape)), kept

    h1 = _layer(x, w["w1"], w["b1"], work, "h1")
    a1, m1 = dropped(h1, "1")
    h2 = _layer(a1, w["w2"], w["b2"], work, "h2")
    phi, m2 = dropped(h2, "2")
    loss, dphi = 0.0, work("dphi", *phi.shape)
    dphi.fill(0.0)
    for arm, h in ((0, "0"), (1, "1")):
        own = np.flatnonzero(t == arm)
        if not own.size:
            continue
        yy, p_own = y[own], np.take(phi, own, axis=0, out=work("p_own", own.size, phi.shape[1]), mode="clip")
        hidden = _layer(p_own, w[f"u{h}"], w[f"c{h}"], work, "hidden")
        z = hidden @ w[f"v{h}"] + w[f"d{h}"]
        scale = 0.5 / own.size
        loss += scale * float((np.maximum(z, 0) - z * yy + np.log1p(np.exp(-np.abs(z)))).sum())
        dz = (_sigmoid(z) - yy) * scale
        g[f"v{h}"] += hidden.T @ dz
        g[f"d{h}"] += dz.sum()
        da = _times_slope(np.outer(dz, w[f"v{h}"], out=work("da", *hidden.shape)), hidden)
        g[f"u{h}"] += p_own.T @ da
        g[f"c{h}"] += da.sum(axis=0)
        dphi[own] = np.matmul(da, w[f"u{h}"].T, out=p_own)
    if m2 is not None:
        dphi *= m2
    d2 = _times_slope(dphi, h2)
    g["w2"] += a1.T @ d2
    g["b2"] += d2.sum(axis=0)
    d1 = np.matmul(d2, w["w2"].T, out=work("d1", *h1.shape))
    if m1 is not None:
        d1 *= m1
    d1 = _times_slope(d1, h1)
    g["w1"] += x.T @ d1
    g["b1"] += d1.sum(axis=0)
    return loss, grad


def adam_step(
    flat: np.ndarray, m: np.ndarray, v: np.ndarray, step: int, grad: np.ndarray, rate: float, p: NetParams
) -> None:
    """One decoupled-decay Adam step in place, after clipping the gradient norm."""
    norm = float(np.sqrt(grad @ grad))
    if norm > p.clip:
        grad = grad * (p.clip / (norm + 1e-6))
    flat *= 1 - rate * p.decay
    m += 0.1 * (grad - m)
    v += 0.001 * (grad * grad - v)
    m_hat, v_hat = m / (1 - 0.9**step), v / (1 - 0.999**step)
    flat -= rate * m_hat / (np.sqrt(v_hat) + 1e-8)


@dataclass(frozen=True)
class DualHeadModel:
    """Fitted weights; scoring is a vectorized map over Arrow batches."""

    spec: ExperimentSpec
    params: NetParams
    weights: np.ndarray
    history: tuple[tuple[int, float, float, float], ...] = ()
    outcome: str | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``tau``, the difference of the two predicted probabilities."""
        dims = layout(len(self.spec.features), self.params)
        w, work = unpack(self.weights, dims), Work()

        @F.pandas_udf("double")
        def effect(*columns: pd.Series) -> pd.Series:
            z0, z1 = forward(w, np.column_stack(columns).astype(np.float64), work)
            return pd.Series(_sigmoid(z1) - _sigmoid(z0))

        return df.withColumn("tau", effect(*[F.col(c).cast("double") for c in self.spec.features]))

    def save(self, path: str) -> None:
        """Store weights, settings and the training history (epoch, training loss, validation loss, rate)."""
        spark, y = SparkSession.active(), self.outcome or self.spec.primary_outcome
        rows = [(i, float(v)) for i, v in enumerate(self.weights)]
        weights = spark.createDataFrame(rows, "position int, weight double").coalesce(1)
        history = spark.createDataFrame(list(self.history), HISTORY).coalesce(1)
        with storing(path, "dual_head", self.spec, y, asdict(self.params)):
            weights.write.mode("overwrite").parquet(f"{path}/weights")
            history.write.mode("overwrite").parquet(f"{path}/history")

    @staticmethod
    def load(path: str, spec: ExperimentSpec, outcome: str | None = None) -> DualHeadModel:
        known, read = stored(path, "dual_head", spec, outcome), SparkSession.active().read
        weights = read.parquet(f"{path}/weights").orderBy("position").toPandas()["weight"].to_numpy()
        history = read.parquet(f"{path}/history").orderBy("epoch").collect()
        params = NetParams(**known["settings"])
        return DualHeadModel(spec, params, weights, tuple(map(tuple, history)), known["outcome"])


def dealt(df: DataFrame, unit_id: str, columns: list[Column], parts: int, seed: int) -> DataFrame:
    """``_part`` and ``columns``, a partition per part; part and order follow from the unit's digest alone."""
    at = draw(unit_id, "learner", seed)
    part = (F.conv(F.substring(at, 1, 8), 16, 10).cast("bigint") % F.lit(parts)).cast("int")
    rows = df.select(part.alias("_part"), *columns, at.alias("_at"), F.col(unit_id).alias("_unit"))
    return rows.repartitionById(parts, "_part").sortWithinPartitions("_at", "_unit").drop("_at", "_unit")


def _examples(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t, y = (batch.column(features + i).to_numpy(zero_copy_only=False) for i in (1, 2))
    columns = [batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(features)]
    return np.column_stack(columns).astype(np.float64), t, y.astype(np.float64)


def _in_blocks(
    batches: Iterator[pa.RecordBatch], features: int, rows: int
) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The part and its examples in blocks of exactly ``rows``, the last one excepted, however Arrow cuts them."""
    part, rest = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        part, more = batch.column(0)[0].as_py(), _examples(batch, features)
        rest = more if rest is None else tuple(np.concatenate(pair) for pair in zip(rest, more))
        while len(rest[1]) >= rows:
            yield part, tuple(a[:rows] for a in rest)
            rest = tuple(a[rows:] for a in rest)
    if rest is not None and len(rest[1]):
        yield part, rest


def train_block(
    state: np.ndarray,
    step: int,
    block: tuple[np.ndarray, np.ndarray, np.ndarray],
    dims: list[tuple[str, tuple[int, ...]]],
    rng: np.random.Generator,
    rate: float,
    p: NetParams,
    work: Work | None = None,
) -> tuple[int, float]:
    """Minibatch steps over a shuffled block, in place; returns the step reached and the summed loss."""
    (x, t, y), (flat, m, v), total, work = block, state, 0.0, work or Work()
    order = rng.permutation(len(y))
    for at in range(0, len(y), p.batch):
        pick = order[at : at + p.batch]
        loss, grad = loss_gradient(flat, dims, x[pick], t[pick], y[pick], p.dropout, rng, work)
        step += 1
        adam_step(flat, m, v, step, grad, rate, p)
        total += loss
    return step, total


def _train_epoch(
    data: DataFrame, learners: int, features: int, state: np.ndarray, steps: int, epoch: int, rate: float, p: NetParams
) -> tuple[np.ndarray, int, float]:
    """Run one epoch of all learners; return the averaged (weights, moments), steps and loss.

    Vectors are added in the order of the learners, so the result depends neither on cores nor on finishing order.
    """
    dims = layout(features, p)
    shared = data.sparkSession.sparkContext.broadcast(state)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows, step, loss_sum, part, work = shared.value.copy(), 0, steps, 0.0, 0, Work()
        for part, block in _in_blocks(batches, features, 4 * p.batch):
            rng = np.random.default_rng([p.seed, epoch, part, rows])
            step, loss = train_block(own, step, block, dims, rng, rate, p, work)
            rows, loss_sum = rows + len(block[1]), loss_sum + loss
        if rows:
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "state": [(own.ravel() * rows).tobytes()], "rows": [rows],
                 "steps": [step - steps], "loss": [loss_sum / (step - steps) * rows]}
            )

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, taken, loss, first = None, 0, 0, 0.0, 0
        for batch in batches:
            for r in batch.to_pylist():
                vector = np.frombuffer(r["state"])
                first = r["part"] if total is None else first
                total = vector.copy() if total is None else total + vector
                rows, taken, loss = rows + r["rows"], max(taken, r["steps"]), loss + r["loss"]
        if total is not None:
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([first], pa.int32()), "state": [total.tobytes()], "rows": [rows],
                 "steps": [taken], "loss": [loss]}
            )

    schema = "part int, state binary, rows bigint, steps bigint, loss double"
    trained = data.mapInArrow(train, schema)
    combiners = min(math.isqrt(learners - 1) + 1, _COMBINERS)
    if combiners > 1:
        to = F.floor(F.col("part").cast("bigint") * combiners / learners).cast("int")
        trained = trained.repartitionById(combiners, to).sortWithinPartitions("part").mapInArrow(combine, schema)
    parts = sorted(trained.collect(), key=lambda r: r["part"])
    shared.unpersist()
    if not parts:
        raise ValueError("no training rows")
    rows = sum(r["rows"] for r in parts)
    mean = sum(np.frombuffer(r["state"]) for r in parts) / rows
    loss = sum(r["loss"] for r in parts) / rows
    return mean.reshape(3, -1), max(r["steps"] for r in parts), loss


def validation_loss(data: DataFrame, features: int, flat: np.ndarray, p: NetParams) -> float:
    """Arm-balanced loss over all rows of :func:`dealt`; parts are added as decimals, in any order alike."""
    dims = layout(features, p)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total, work = unpack(flat, dims), np.zeros(4), Work()
        for _, block in _in_blocks(batches, features, 4 * p.batch):
            total += arm_losses(w, *block, work)
        yield pa.RecordBatch.from_pydict({k: [s] for k, s in zip(("l0", "n0", "l1", "n1"), total)})

    sums = data.mapInArrow(losses, "l0 double, n0 double, l1 double, n1 double")
    row = sums.agg(*[F.sum(F.col(c).cast("decimal(28,12)")).alias(c) for c in ("l0", "n0", "l1", "n1")]).first()
    return balanced(np.array([float(row[c] or 0.0) for c in ("l0", "n0", "l1", "n1")]))


def fit_dual_head(
    train: DataFrame,
    val: DataFrame,
    spec: ExperimentSpec,
    outcome: str | None = None,
    params: NetParams = NetParams(),
) -> DualHeadModel:
    """Train with learning-rate halving on plateaus, early stopping and best-weights restore."""
    y = outcome or spec.primary_outcome
    columns = [F.col(c).cast("float") for c in spec.features]
    columns += [F.col(spec.treatment).cast("byte"), F.col(y).cast("byte")]
    sizes = [d.agg(F.avg(y).alias("base"), F.count(F.lit(1)).alias("n")).first() for d in (train, val)]
    base = float(sizes[0].base or 0.0)
    learners, blocks = (params.learners or max(1, math.ceil(s.n / params.learner_rows)) for s in sizes)
    rows = keep(dealt(train, spec.unit_id, columns, learners, params.seed))
    held = keep(dealt(val, spec.unit_id, columns, blocks, params.seed))
    features = len(spec.features)
    flat = initial_weights(features, params, base)
    state = np.stack([flat, np.zeros_like(flat), np.zeros_like(flat)])
    rate, steps, best, best_flat = params.rate, 0, math.inf, flat
    waited, stalled, history = 0, 0, []
    for epoch in range(1, params.epochs + 1):
        state, taken, loss = _train_epoch(rows, learners, features, state, steps, epoch, rate, params)
        steps += taken
        val_loss = validation_loss(held, features, state[0], params)
        history.append((epoch, float(loss), float(val_loss), rate))
        if val_loss < best:
            best, best_flat, waited, stalled = val_loss, state[0].copy(), 0, 0
            continue
        waited, stalled = waited + 1, stalled + 1
        if stalled > params.plateau:
            rate, stalled = rate / 2, 0
        if waited >= params.patience:
            break
    rows.unpersist()
    held.unpersist()
    return DualHeadModel(spec, params, best_flat, tuple(history), y)
