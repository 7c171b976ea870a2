"""Feed-forward nets trained on rows in small steps, by replicas whose weights are averaged.

Rows are dealt to a fixed number of replicas by a hash of their key. In a round
each replica starts from the same weights and takes Adam steps over batches of
its own rows, for a number of epochs; then the replicas' numbers are averaged,
weighted by rows. One replica alone is plain mini-batch training. Weights and
Adam's moments are rows of a stored table, cut into pieces: a task gets them with
its replica's rows, and the averages are a grouped aggregation of pieces. So
neither weights nor gradients pass through the driver, which sees one loss per
net and epoch, and any number of nets of any width can be trained side by side.

Order, noise and dropout are drawn from the net, the replica and the epoch, and
rows lie in the order of their hash, so results do not depend on how the table
was partitioned, nor on tasks that are run again.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admitflow.session import cut_lineage

PIECE = 65_536  # numbers per stored piece
SPAN = 16_384  # numbers that Adam moves at a time; they stay in the processor's cache
EPSILON, MOMENTUM = 1e-5, 0.1  # of batch norm, as usual
STATE = "net int, piece int, rows long, part array<double>"


@dataclass(frozen=True)
class Net:
    """The shape of a net. Outputs are sigmoids, the loss is cross-entropy.

    Hidden layers: linear, dropout, ``activation`` (``relu`` or ``elu``), batch norm
    if ``norm``. ``code`` names a hidden layer that stays linear, by its number from 1.
    """

    widths: tuple[int, ...]
    activation: str = "elu"
    dropout: float = 0.0
    norm: bool = True
    code: int | None = None

    def shapes(self) -> list[tuple[str, tuple[int, ...]]]:
        """Names and shapes of all trained numbers, then of the running moments."""
        trained, running = [], []
        for i, (a, b) in enumerate(zip(self.widths, self.widths[1:]), 1):
            trained += [(f"w{i}", (a, b)), (f"b{i}", (b,))]
            if self.norm and i < len(self.widths) - 1:
                trained += [(f"gain{i}", (b,)), (f"shift{i}", (b,))]
                running += [(f"mean{i}", (b,)), (f"var{i}", (b,))]
        return trained + running

    def trained(self) -> int:
        return sum(int(np.prod(s)) for n, s in self.shapes() if not n.startswith(("mean", "var")))

    def size(self) -> int:
        return sum(int(np.prod(s)) for _, s in self.shapes())


@dataclass(frozen=True)
class Training:
    """``keep``: the chance that an input x is fed as it is, else as 1 - x (None: no noise). ``balance``: rows of an
    epoch are drawn with replacement, each class of the first label as likely as the other. ``epochs_a_round``: epochs
    between averages; ``stop``: nets whose loss is below it at the end of a round are done."""

    epochs: int = 10
    batch: int = 128
    rate: float = 1e-3
    decay: float = 0.0
    keep: float | None = None
    stop: float | None = None
    balance: bool = False
    replicas: int = 8
    epochs_a_round: int = 1
    seed: int = 42


@dataclass
class Trained:
    """Nets, where their numbers are stored, and (net, epoch) -> loss."""

    nets: list[Net]
    state: DataFrame
    losses: dict[int, list[float]] = field(default_factory=dict)

    def numbers(self, net: int) -> dict[str, np.ndarray]:
        """One net's arrays, on the driver; their size is that of the net."""
        want = self.nets[net].size()
        parts = self.state.where((F.col("net") == net) & (F.col("piece") >= 0) & (F.col("piece") <= (want - 1) // PIECE))
        rows = sorted(parts.select("piece", "part").collect())
        return views(self.nets[net], np.concatenate([np.array(r.part) for r in rows])[:want])


def views(net: Net, flat: np.ndarray) -> dict[str, np.ndarray]:
    """A net's arrays by name, inside one vector of all its numbers."""
    out, at = {}, 0
    for name, shape in net.shapes():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def initial(net: Net, seed: Sequence[int]) -> np.ndarray:
    """Weights and biases evenly within 1 / sqrt(inputs); gains and variances 1."""
    rng, flat = np.random.default_rng(list(seed)), np.zeros(net.size())
    for name, view in views(net, flat).items():
        if name[0] in "wb":
            bound = 1.0 / np.sqrt(net.widths[int(name[1:]) - 1])
            view[...] = rng.uniform(-bound, bound, view.shape)
        elif name.startswith(("gain", "var")):
            view[...] = 1.0
    return flat


def forward(net: Net, p: dict[str, np.ndarray], x: np.ndarray, rng: np.random.Generator | None = None, stop: int | None = None):
    """Outputs and, for each hidden layer, what the way back needs. With ``rng`` as in training: dropout, and the batch's own moments."""
    kept, last = [], len(net.widths) - 1
    for i in range(1, (stop or last) + 1):
        z = x @ p[f"w{i}"] + p[f"b{i}"]
        if i == last:
            return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))), [*kept, (x,)]
        mask = None
        if rng is not None and net.dropout:
            mask = (rng.random(z.shape, np.float32) >= net.dropout) / np.float32(1 - net.dropout)
            z = z * mask
        linear = i == net.code
        a = z if linear else np.maximum(z, 0) if net.activation == "relu" else np.where(z > 0, z, np.expm1(np.minimum(z, 0)))
        out, norm = a, None
        if net.norm:
            mean, var = (a.mean(axis=0), a.var(axis=0)) if rng is not None else (p[f"mean{i}"], p[f"var{i}"])
            width = np.sqrt(var + EPSILON)
            hat = (a - mean) / width
            out, norm = hat * p[f"gain{i}"] + p[f"shift{i}"], (hat, width, mean, var)
        kept.append((x, z, a, mask, linear, norm))
        x = out
    return x, kept


def step(
    net: Net, p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, rng: np.random.Generator, into: dict[str, np.ndarray] | None = None
) -> tuple[float, dict[str, np.ndarray]]:
    """The batch's mean loss and its gradient, written to ``into`` if that is given; running moments move on."""
    out, kept = forward(net, p, x, rng)
    q = np.clip(out, 1e-7, 1 - 1e-7)
    loss = -float(np.mean(y * np.log(q) + (1 - y) * np.log(1 - q), dtype=np.float64))
    delta, grad, n = (out - y) / out.size, {} if into is None else into, len(x)

    def put(name: str, how, *of, **more) -> None:
        grad[name] = how(*of, **more) if into is None else how(*of, **more, out=into[name])

    for i in range(len(net.widths) - 1, 0, -1):
        before = kept[i - 1][0]
        if i < len(net.widths) - 1:
            _, z, a, mask, linear, norm = kept[i - 1]
            if norm is not None:
                hat, width, mean, var = norm
                put(f"gain{i}", np.sum, delta * hat, axis=0)
                put(f"shift{i}", np.sum, delta, axis=0)
                d = delta * p[f"gain{i}"]
                delta = (d - d.mean(axis=0) - hat * (d * hat).mean(axis=0)) / width
                p[f"mean{i}"] += MOMENTUM * (mean - p[f"mean{i}"])
                p[f"var{i}"] += MOMENTUM * (var * (n / max(n - 1, 1)) - p[f"var{i}"])
            if not linear:
                delta = delta * np.where(z > 0, 1, 0 if net.activation == "relu" else a + 1).astype(delta.dtype)
            if mask is not None:
                delta = delta * mask
        put(f"w{i}", np.matmul, before.T, delta)
        put(f"b{i}", np.sum, delta, axis=0)
        if i > 1:
            delta = delta @ p[f"w{i}"].T
    return loss, grad


class _Replica:
    """One net in training: its numbers, and Adam's first and second moments and step count, as one vector."""

    def __init__(self, net: Net, vector: np.ndarray):
        self.net, self.n, self.size = net, net.trained(), net.size()
        self.flat = vector[: self.size].astype(np.float32)
        rest = vector[self.size :] if len(vector) > self.size else np.zeros(2 * self.n + 1)
        self.first, self.second = rest[: self.n].astype(np.float32), rest[self.n : 2 * self.n].astype(np.float32)
        self.steps = float(rest[2 * self.n])
        self.p = views(net, self.flat)
        # The trained numbers come first, so a gradient has the places of a net's arrays; those of running moments stay unused.
        self.g = np.zeros(self.size, np.float32)
        self.grad = views(net, self.g)

    def vector(self) -> np.ndarray:
        return np.concatenate([self.flat, self.first, self.second, [self.steps]]).astype(np.float64)

    def epoch(self, rows: np.ndarray, order: np.ndarray, t: Training, rng: np.random.Generator) -> float:
        d, total = self.net.widths[0], 0.0
        for at in range(0, len(order), t.batch):
            part = rows[order[at : at + t.batch]]
            x, y = part[:, :d], part[:, d:]
            if t.keep is not None:
                x = np.where(rng.random(x.shape, np.float32) < t.keep, x, 1 - x)
            loss, _ = step(self.net, self.p, x, y, rng, self.grad)
            total += loss * len(part)
            self._adam(t)
        return total

    def _adam(self, t: Training) -> None:
        """One step along the gradient, span by span and in place: of wide nets this takes as long as the products."""
        self.steps += 1
        rate, rest, spare = t.rate / (1 - 0.9**self.steps), 1 - 0.999**self.steps, np.empty((2, SPAN), np.float32)
        for at in range(0, self.n, SPAN):
            w, g, first, second = (v[at : min(at + SPAN, self.n)] for v in (self.flat, self.g, self.first, self.second))
            a, b = spare[:, : len(w)]
            g += np.multiply(w, np.float32(t.decay), out=a)
            np.subtract(g, first, out=a)
            first += np.multiply(a, 0.1, out=a)
            np.subtract(np.multiply(g, g, out=a), second, out=a)
            second += np.multiply(a, 0.001, out=a)
            np.sqrt(np.divide(second, rest, out=a), out=a)
            a += 1e-8
            w -= np.divide(np.multiply(first, rate, out=b), a, out=b)


def pieces_of(net: int, rows: int, vector: np.ndarray) -> pd.DataFrame:
    """Rows of the stored state: a net's numbers in pieces."""
    at = range(0, len(vector), PIECE)
    return pd.DataFrame({"net": net, "piece": range(len(at)), "rows": rows, "part": [vector[i : i + PIECE] for i in at]})


def _averaged(group: pd.DataFrame) -> pd.DataFrame:
    """Replicas' parts of one piece: weighted by rows; losses (pieces below 0) are summed."""
    parts, rows = np.stack(group["part"].to_numpy()), group["rows"].to_numpy()
    first = group.iloc[0]
    part = parts.sum(axis=0) if first["piece"] < 0 else rows @ parts / rows.sum()
    return pd.DataFrame({"net": [first["net"]], "piece": [first["piece"]], "rows": [rows.sum()], "part": [part]})


def lanes_of(nets: Mapping[int, Net], lanes: int) -> dict[int, int]:
    """Which lane trains a net: nets go, largest first, to the lane with the least work so far."""
    work, found = [0] * lanes, {}
    for i in sorted(nets, key=lambda i: (-nets[i].size(), i)):
        found[i] = work.index(min(work))
        work[found[i]] += nets[i].size() + 200 * sum(nets[i].widths)
    return found


def _dealt(rows: DataFrame, state: DataFrame, lanes: int, replicas: int, nets: Mapping[int, Net]) -> DataFrame:
    """Rows and weights by unit (lane and replica), weights first.

    ``rows``: (replica, order, ...). Each unit is one partition, whatever its number of rows.
    """
    each = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    place = F.create_map(*(F.lit(v) for item in lanes_of(nets, lanes).items() for v in item))
    wanted = state.where((F.col("piece") >= 0) & F.col("net").isin(*nets)).withColumn("replica", F.explode(each(replicas)))
    weights = wanted.select(
        (place[F.col("net")] * replicas + F.col("replica")).alias("unit"), F.lit(0).alias("kind"), F.col("net").cast("long").alias("order"), "piece", "part",
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in ("replica", "order")),
    )
    copies = rows.withColumn("_lane", F.explode(each(lanes)))
    data = copies.select(
        (F.col("_lane") * replicas + F.col("replica")).alias("unit"), F.lit(1).alias("kind"), "order", F.lit(None).cast("int").alias("piece"),
        F.lit(None).cast("array<double>").alias("part"), *(c for c in rows.columns if c not in ("replica", "order")),
    )
    both = weights.unionByName(data).repartitionById(lanes * replicas, F.col("unit"))
    return both.sortWithinPartitions("unit", "kind", "order", "piece")


def _take_weights(held: dict[int, list[np.ndarray]], batch: pd.DataFrame) -> pd.DataFrame:
    """Keep the weights of a batch in ``held`` and return its rows."""
    for net, part in batch.loc[batch["kind"] == 0, ["order", "part"]].itertuples(index=False):
        held.setdefault(int(net), []).append(np.asarray(part))
    return batch[batch["kind"] == 1]


def _round(nets: Sequence[Net], t: Training, done: int, epochs: int, share: dict[float, float] | None):
    """What a task does in a round: spool the rows of its unit to a scratch file, then train its nets on it one after another."""
    specs = [asdict(n) for n in nets]

    def train_unit(unit: int, held: dict[int, list[np.ndarray]], spool, width: int) -> Iterator[pd.DataFrame]:
        n = spool.tell() // (4 * width)
        if not n:
            return
        spool.flush()
        rows = np.memmap(spool, np.float32, "r", shape=(n, width))
        weight = None
        if share is not None:
            weight = np.where(rows[:, -1] > 0.5, share[1.0], share[0.0])
            weight = weight / weight.sum()
        for net, parts in held.items():
            replica, losses = _Replica(Net(**specs[net]), np.concatenate(parts)), []
            for epoch in range(done, done + epochs):
                rng = np.random.default_rng([t.seed, net, unit % t.replicas, epoch])
                order = rng.permutation(n) if weight is None else rng.choice(n, n, p=weight)
                losses.append(replica.epoch(rows, order, t, rng))
            yield pieces_of(net, n, replica.vector())
            yield pd.DataFrame({"net": net, "piece": [-1 - done - i for i in range(epochs)], "rows": n, "part": [np.array([x, float(n)]) for x in losses]})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, held, width, spool = None, {}, 1, None
        for batch in batches:
            for number, part in batch.groupby("unit"):
                if number != unit:
                    if unit is not None:
                        yield from train_unit(unit, held, spool, width)
                        spool.close()
                    unit, held, spool = number, {}, tempfile.TemporaryFile()
                rows = _take_weights(held, part)
                if len(rows):
                    both = np.hstack([np.stack(rows["x"].to_numpy()), np.stack(rows["y"].to_numpy())]).astype(np.float32)
                    width = both.shape[1]
                    spool.write(both.tobytes())
        if unit is not None:
            yield from train_unit(unit, held, spool, width)
            spool.close()

    return work


def _by_replica(rows: DataFrame, key: Column, replicas: int, seed: int, *columns: Column) -> DataFrame:
    order = F.xxhash64(key, F.lit(seed))
    return rows.select(F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(replicas)).cast("int").alias("replica"), order.alias("order"), *columns)


def start(spark: SparkSession, nets: Sequence[Net], seed: int) -> DataFrame:
    """Stored first weights of nets, each drawn in a task."""
    specs = [(i, json.dumps(asdict(n))) for i, n in enumerate(nets)]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, spec in batch.itertuples(index=False):
                yield pieces_of(i, 1, initial(Net(**json.loads(spec)), [seed, i]))

    frame = spark.createDataFrame(specs, "net int, spec string").repartition(len(specs))
    return cut_lineage(frame.mapInPandas(work, STATE), "net-start")


def train(
    df: DataFrame, key: str | Sequence[str], x: str, y: str, nets: Sequence[Net], training: Training = Training(), lanes: int = 1, state: DataFrame | None = None
) -> Trained:
    """Train nets on array columns ``x`` (inputs) and ``y`` (labels, 0 to 1); without rows they stay as they begin.

    ``key`` is unique. Rows whose arrays are null are left out. ``lanes`` is how
    many groups of nets train at once, each on a copy of the rows; tasks are lanes
    times replicas. A task keeps its replica's rows in a scratch file, not in
    memory; if its executor is lost, it is run again and gives the same.
    """
    t, nets = training, [Net(**{**asdict(n), "widths": tuple(n.widths)}) for n in nets]
    columns = [F.col(c) for c in ([key] if isinstance(key, str) else key)]
    arrays = [F.col(c).cast("array<float>").alias(a) for c, a in ((x, "x"), (y, "y"))]
    rows = _by_replica(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), F.struct(*columns), t.replicas, t.seed, *arrays)
    rows = cut_lineage(rows, "net-rows")
    state = start(df.sparkSession, nets, t.seed) if state is None else state
    share = None
    if t.balance:
        counts = {float(r.c): r.n for r in rows.groupBy((F.element_at("y", -1) > 0.5).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
        share = {c: 1.0 / counts[c] if c in counts else 0.0 for c in (0.0, 1.0)}
    losses: dict[int, list[float]] = {i: [] for i in range(len(nets))}
    open_, done = list(range(len(nets))), 0
    lanes = min(lanes, max(len(nets), 1))
    while open_ and done < t.epochs:
        epochs = min(t.epochs_a_round, t.epochs - done)
        dealt = _dealt(rows, state, lanes, t.replicas, {i: nets[i] for i in open_})
        found = dealt.mapInPandas(_round(nets, t, done, epochs, share), STATE)
        fresh = cut_lineage(found.groupBy("net", "piece").applyInPandas(_averaged, STATE), "net-round")
        told = sorted(((r.net, -r.piece, r.part) for r in fresh.where("piece < 0").collect()))
        if not told:
            break
        for net, _, (loss, n) in told:
            losses[net].append(loss / n)
        others = [i for i in range(len(nets)) if i not in open_]
        state = fresh.where("piece >= 0")
        if others:  # what was done in earlier rounds is kept with the rest
            state = state.unionByName(finished)
        if t.stop is not None:
            open_ = [i for i in open_ if losses[i][-1] >= t.stop]
        finished = state.where(~F.col("net").isin(*open_)) if open_ else state
        done += epochs
    return Trained(nets, state, losses)


def score(trained: Trained, df: DataFrame, keep: Sequence[str], x: str, name: str = "scores", lanes: int = 1, parts: int = 8, code: bool = False) -> DataFrame:
    """(net, *keep, ``name`` array<double>): outputs of every net for every row, or, with ``code``, those of its code layer.

    Rows are dealt to ``parts`` times ``lanes`` tasks, which get the weights they
    need with them and hold one batch of rows at a time. Rows without inputs are
    left out.
    """
    nets = trained.nets
    specs, parts_of = [asdict(n) for n in nets], [(n.size() - 1) // PIECE for n in nets]
    spread = F.xxhash64(*keep, F.col(x))
    kept = [F.col(c).alias(f"_{i}") for i, c in enumerate(keep)]
    rows = df.where(F.col(x).isNotNull()).select(
        F.pmod(spread, F.lit(parts)).cast("int").alias("replica"), F.lit(0).cast("long").alias("order"), F.col(x).cast("array<float>").alias("x"), *kept
    )
    upto = F.create_map(*(F.lit(v) for i, n in enumerate(parts_of) for v in (i, n)))
    weights = trained.state.where(F.col("piece") <= upto[F.col("net")])
    dealt = _dealt(rows, weights, lanes, parts, dict(enumerate(nets)))
    fields = [T.StructField(f"_{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType([T.StructField("net", T.IntegerType()), *fields, T.StructField("scores", T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, held, ready = None, {}, {}
        for batch in batches:
            for number, part in batch.groupby("unit"):
                if number != unit:
                    unit, held, ready = number, {}, {}
                mine = _take_weights(held, part)
                if not len(mine):
                    continue
                if not ready:
                    for net, pieces in held.items():
                        shape = Net(**specs[net])
                        ready[net] = shape, views(shape, np.concatenate(pieces)[: shape.size()])
                inputs = np.stack(mine["x"].to_numpy()).astype(np.float64)
                for net, (shape, p) in ready.items():
                    out = mine[[f"_{i}" for i in range(len(keep))]].copy()
                    out.insert(0, "net", net)
                    out["scores"] = list(forward(shape, p, inputs, stop=shape.code if code else None)[0])
                    yield out

    scored = dealt.mapInPandas(work, schema)
    return scored.select("net", *(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), F.col("scores").alias(name))


def loss_table(trained: Trained, spark: SparkSession) -> DataFrame:
    """(net, epoch, loss), epochs from 1."""
    rows = [(i, e, float(v)) for i, found in trained.losses.items() for e, v in enumerate(found, 1)]
    return spark.createDataFrame(rows, "net int, epoch int, loss double")
