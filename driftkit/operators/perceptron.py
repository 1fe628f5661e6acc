"""Training of multilayer perceptrons on row blocks.

The loss is that of MLlib's perceptron: the mean over stacks of 128 rows (the last one of a
partition has the rest) of the stack's mean cross entropy; sigmoid hidden layers, softmax
output, MLlib's first weights for the seed.  Rows are kept as blocks in the shared checkpoint
folder.  Several networks, on the same rows or on others, are trained together: one job a step
evaluates every network that is not done, tasks add up losses and gradients over their blocks, a
merging task per part adds the tasks up, and the driver gets one gradient a network, whatever
the number of rows.  Steps are L-BFGS with a strong Wolfe search and MLlib's rules of ending.
Networks that differ in the most steps alone go the same way and are trained as one.
"""

from __future__ import annotations

from collections.abc import Generator, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftkit.session import cut_lineage

STACK = 128
ROWS_PER_BLOCK = 64 * STACK
ROWS_AT_ONCE = 2 * STACK  # a layer's values stay in the core's cache
ROWS_PER_PART = 4 * ROWS_PER_BLOCK
MERGERS = 8
CORRECTIONS = 10
TOLERANCE = 1e-6
BLOCKS = "part int, x binary, y binary"
SUMS = "network int, sums binary"


def layers_of(flat: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights by input and output, biases) per layer, as MLlib lays them out."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def loss_and_gradient(flat: np.ndarray, layers: Sequence[int], x: np.ndarray, y: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The loss and then the gradient, rows weighing ``share``."""
    net, seen = layers_of(flat, layers), [x]
    for w, b in net[:-1]:
        z = seen[-1] @ w
        z += b
        np.negative(z, out=z)
        with np.errstate(over="ignore"):
            np.exp(z, out=z)
        z += 1
        seen.append(np.reciprocal(z, out=z))
    z = seen[-1] @ net[-1][0] + net[-1][1]
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    total, rows = e.sum(axis=1), np.arange(len(y))
    loss = share @ (np.log(total) - z[rows, y])
    delta = e / total[:, None]
    delta[rows, y] -= 1
    delta *= share[:, None]
    parts = []
    for k in range(len(net) - 1, -1, -1):
        parts += [delta.sum(axis=0), (seen[k].T @ delta).ravel()]
        if k:
            delta = delta @ net[k][0].T
            delta *= seen[k]
            delta *= 1 - seen[k]
    return np.concatenate([[loss], *parts[::-1]])


class Stuck(ArithmeticError):
    """No step along this direction."""


def _between(a: tuple, b: tuple) -> float:
    """Least point of the cubic through two (step, value, slope), kept off both ends."""
    d1 = a[2] + b[2] - 3 * (a[1] - b[1]) / (a[0] - b[0])
    with np.errstate(all="ignore"):
        d2 = np.sqrt(d1 * d1 - a[2] * b[2])
        t = b[0] - (b[0] - a[0]) * (b[2] + d2 - d1) / (b[2] - a[2] + 2 * d2)
    low, high = a[0] + 0.1 * (b[0] - a[0]), a[0] + 0.9 * (b[0] - a[0])
    return low if t < low else high if t > high else t


def _search(x: np.ndarray, value: float, gradient: np.ndarray, way: np.ndarray, t: float) -> Generator:
    """Strong Wolfe search: yields points, takes their (value, gradient), returns the (step, point, value, gradient) it ends on."""
    slope = gradient @ way
    if slope > 0:
        raise Stuck("not a descent")
    low, high = (0.0, value, slope), None
    for i in range(10):
        point = x + way * t
        v, g = yield point
        c = (t, v, g @ way)
        if not np.isfinite(v):
            t /= 2
            continue
        if v > value + 1e-4 * t * slope or (v >= low[1] and i > 0):
            high = c
            break
        if abs(c[2]) <= 0.9 * abs(slope):
            return t, point, v, g
        if c[2] >= 0:
            low, high = c, low
            break
        low, t = c, t * 1.5
    if high is None:
        raise Stuck("no step")
    for _ in range(10):
        t = _between(high, low) if low[0] > high[0] else _between(low, high)
        point = x + way * t
        v, g = yield point
        c = (t, v, g @ way)
        if v > value + 1e-4 * t * slope or v >= low[1]:
            high = c
            continue
        if abs(c[2]) <= 0.9 * abs(slope):
            return t, point, v, g
        if c[2] * (high[0] - low[0]) >= 0:
            high = low
        low = c
    raise Stuck("zoom failed")


def _descent(history: list, gradient: np.ndarray) -> np.ndarray:
    way, used = gradient.copy(), []
    for step, change in history:
        rho = step @ change
        a = (step @ way) / rho
        if np.isnan(a):
            raise Stuck("NaN history")
        way -= a * change
        used.append((step, change, rho, a))
    if history:
        scale = (history[0][0] @ history[0][1]) / (history[0][1] @ history[0][1])
        if not scale >= 0:
            raise Stuck("NaN history")
        way *= scale
    for step, change, rho, a in reversed(used):
        way += (a - (change @ way) / rho) * step
    return -way


def minimize(x: np.ndarray, stops: Sequence[int]) -> Generator:
    """L-BFGS: yields points, takes their (value, gradient), returns the weights after each of
    ``stops`` steps (ascending), the last ones where it ends earlier."""
    kept: list[np.ndarray] = []
    value, gradient = yield x
    first, last, history, failed, done = value, [np.inf], [], False, 0
    while True:
        kept += [x] * sum(done >= stop for stop in stops[len(kept):])
        ended = len(last) >= 2 and abs(value - max(last)) <= TOLERANCE * abs(first)
        if len(kept) == len(stops) or ended or np.linalg.norm(gradient) <= max(TOLERANCE * abs(value), 1e-8):
            return kept + [x] * (len(stops) - len(kept))
        try:
            with np.errstate(all="ignore"):
                way = _descent(history, gradient)
            step, point, v, g = yield from _search(x, value, gradient, way, 1.0 if done else 1 / np.linalg.norm(way))
            if step * np.linalg.norm(gradient) < 1e-10:
                raise Stuck("step too small")
        except Stuck:
            if failed:
                return kept + [x] * (len(stops) - len(kept))
            failed, history = True, []
            continue
        failed = False
        history = [(point - x, g - gradient), *history][:CORRECTIONS]
        x, value, gradient, done = point, v, g, done + 1
        last = [*last, value][-20:]


def row_blocks(df: DataFrame, features: Sequence[str], label: str, part: int) -> DataFrame:
    """Blocks of whole stacks; only the last of a partition has a broken one."""

    def block(table: pa.Table) -> pa.RecordBatch:
        y, *columns = (c.to_numpy() for c in table.columns)
        blobs = np.column_stack(columns).astype(float).tobytes(), y.astype(np.uint8).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([x], pa.binary()) for x in blobs]], names=["part", "x", "y"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            while held.num_rows >= ROWS_PER_BLOCK:
                yield block(held.slice(0, ROWS_PER_BLOCK))
                held = held.slice(ROWS_PER_BLOCK)
        if held is not None and held.num_rows:
            yield block(held)

    return df.select(F.col(label).cast("int").alias("_y"), *[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(features)]).mapInArrow(pack, BLOCKS)


def spread(df: DataFrame, rows: int) -> DataFrame:
    """As many partitions as the rows fill, at most four a core; small frames stay as they are."""
    wanted = min(-(-rows // ROWS_PER_PART), 4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(wanted) if wanted > df.rdd.getNumPartitions() else df


def fit_perceptrons(parts: Sequence[tuple[DataFrame, Sequence[str]]], label: str, networks: Sequence[tuple[int, Sequence[int], np.ndarray, int]]) -> list[np.ndarray]:
    """The weights of each network: (its part, its layers, first weights, most steps).  ``parts``
    are rows with their feature columns."""
    blocks = None
    for i, (df, features) in enumerate(parts):
        own = row_blocks(df, features, label, i)
        blocks = own if blocks is None else blocks.unionByName(own)
    # blocks of all parts are dealt evenly over the tasks of a step
    blocks = cut_lineage(blocks)
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    if (made := blocks.rdd.getNumPartitions()) > cores:
        blocks = cut_lineage(blocks.repartition(cores * -(-made // (4 * cores))))
    stacks = dict(blocks.groupBy("part").agg(F.sum(F.ceil(F.octet_length("y") / STACK))).collect())
    tasks = blocks.rdd.getNumPartitions()
    widths = [len(features) for _, features in parts]

    ways: dict[tuple, list[int]] = {}  # networks that differ in the most steps alone
    for k, (part, layers, first, _) in enumerate(networks):
        ways.setdefault((part, tuple(layers), np.array(first, float).tobytes()), []).append(k)
    alike = [sorted(own, key=lambda k: networks[k][3]) for own in ways.values()]

    def evaluate(points: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        wanted = [(i, networks[alike[i][0]][0], tuple(networks[alike[i][0]][1]), flat) for i, flat in points.items()]

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for part, x, y in zip(*(batch.column(c) for c in ("part", "x", "y"))):
                    part, y = part.as_py(), np.frombuffer(y.as_buffer(), np.uint8)
                    x = np.frombuffer(x.as_buffer()).reshape(len(y), widths[part])
                    whole = len(y) // STACK * STACK
                    share = np.full(len(y), 1 / (STACK * stacks[part]))
                    share[whole:] = 1 / (max(len(y) - whole, 1) * stacks[part])
                    for k, at, layers, flat in wanted:
                        for i in range(0, len(y) if at == part else 0, ROWS_AT_ONCE):
                            own = slice(i, i + ROWS_AT_ONCE)
                            sums[k] = sums.get(k, 0.0) + loss_and_gradient(flat, layers, x[own], y[own], share[own])
            yield made(sums)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, blob in zip(batch.column("network").to_pylist(), batch.column("sums")):
                    sums[k] = sums.get(k, 0.0) + np.frombuffer(blob.as_buffer())
            yield made(sums)

        def made(sums: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["network", "sums"])

        found = blocks.mapInArrow(add_up, SUMS)
        if tasks > 1:
            found = found.repartition(min(MERGERS, len(wanted)), "network").mapInArrow(merge, SUMS)
        return {r.network: np.frombuffer(r.sums) for r in found.collect()}

    running = {i: minimize(np.array(networks[own[0]][2], float), [networks[k][3] for k in own]) for i, own in enumerate(alike)}
    points, out = {i: next(steps) for i, steps in running.items()}, {}
    while points:
        found, points = evaluate(points), {}
        for i, sums in found.items():
            try:
                points[i] = running[i].send((float(sums[0]), sums[1:]))
            except StopIteration as end:
                out |= dict(zip(alike[i], end.value))
    return [out[k] for k in range(len(networks))]
