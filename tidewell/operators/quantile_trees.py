"""Boosted regression trees under pinball loss, grown from grouped counts.

Features are cut into bins once.  A level of a round's trees needs, for every open node,
feature and bin, how many rows there are and how many lie below their present prediction:
that gives the gradient sums of all splits.  Leaves take the wanted quantile of their rows'
residuals, from residual counts in narrow bins.  All quantiles wanted are grown side by side
in the same passes.  Counts are integers, so the trees do not depend on how rows are dealt or
in which order they come.

Where the combinations of bins are few, rows of one combination have one prediction.  They are
dealt by it once and held as blocks of plain numbers; a round is three passes whose tasks
return a few numbers for each of their combinations and leaves, and nothing is shuffled.  With
more combinations rows carry their predictions, in a pass per level.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import quantiles as qt
from tidewell.session import scratch_path

#: Rounds after which the predictions so far are written, and residual bins per octave.
KEEP, RESIDUAL_BINS = 10, 256
#: Combinations of feature bins for which predictions are tables; with more, rows carry theirs.
CELLS = 1 << 18
#: Rows of a block and of a partition, where predictions are tables.
BLOCK, BLOCK_PART = 1 << 18, 500_000


def _leaf_of(x: np.ndarray, tree: Mapping, depth: int) -> np.ndarray:
    """Node (heap order) of every row after ``depth`` levels."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    feature, cut = np.asarray(tree["feature"]), np.asarray(tree["cut"])
    for _ in range(depth):
        f = feature[node]
        node = 2 * node + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > cut[node]))
    return node


def _total(x: np.ndarray, trees: Sequence[Mapping], depth: int) -> np.ndarray:
    out = np.zeros(len(x))
    for tree in trees:
        out += np.asarray(tree["value"])[_leaf_of(x, tree, depth) - (2**depth - 1)]
    return out


def _binned(values: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, values[:, i], "left") for i, e in enumerate(edges)]).astype(np.int64)


def _residual_bin(r: np.ndarray) -> np.ndarray:
    size = np.floor(np.log2(np.maximum(np.abs(r), 1e-300)) * RESIDUAL_BINS).astype(np.int64) + 1100 * RESIDUAL_BINS
    return np.where(r > 0, size, np.where(r < 0, -size, 0))


@dataclass
class QuantileTrees:
    """Fitted trees per quantile; small enough to travel with a job."""

    features: list[str]
    edges: list[list[float]]
    start: dict[str, float]
    trees: dict[str, list[dict]]
    depth: int

    def predict(self, df: DataFrame) -> DataFrame:
        """One column per quantile, NULL where a feature is missing; crossing quantiles are not reordered."""
        names, edges, start, trees, depth = list(self.trees), self.edges, self.start, self.trees, self.depth
        sizes = [len(e) + 1 for e in edges]
        tabled = int(np.prod(sizes, dtype=np.int64)) <= CELLS
        sides = np.cumprod([1, *sizes[:-1]])
        every = np.arange(np.prod(sizes))[:, None] // sides % sizes if tabled else None
        table = {n: start[n] + _total(every, trees[n], depth) for n in names} if tabled else {}

        @F.pandas_udf(", ".join(f"_{i} double" for i in range(len(names))))
        def score(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            for parts in columns:
                values = np.column_stack([c.to_numpy(float) for c in parts])
                whole = ~np.isnan(values).any(1)
                x = _binned(np.nan_to_num(values), edges)
                out = [table[n][x @ sides] if tabled else start[n] + _total(x, trees[n], depth) for n in names]
                yield pd.DataFrame({f"_{i}": np.where(whole, o, np.nan) for i, o in enumerate(out)})

        scored = df.withColumn("_q", score(*[F.col(f).cast("double") for f in self.features]))
        return scored.withColumns({n: F.col("_q")[f"_{i}"] for i, n in enumerate(names)}).drop("_q")

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, text: str) -> QuantileTrees:
        return cls(**json.loads(text))


def _best_splits(below: np.ndarray, n: np.ndarray, tau: float, least: int) -> list[tuple[int, int]]:
    """(feature, last bin of the left side) per node from counts of shape (nodes, features, bins); (-1, 0) without a split."""
    left_n, left_b = n.cumsum(2)[:, :, :-1], below.cumsum(2)[:, :, :-1]
    all_n, all_b = n.sum(2, keepdims=True), below.sum(2, keepdims=True)
    right_n = all_n - left_n
    pull, whole = tau * left_n - left_b, tau * all_n - all_b
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = pull**2 / left_n + (whole - pull) ** 2 / right_n - whole**2 / all_n
    gain = np.where((left_n >= least) & (right_n >= least), gain, -1.0)
    out = []
    for g in gain:
        place = int(np.argmax(np.round(g, 9))) if g.size else 0
        out.append((place // g.shape[1], place % g.shape[1]) if g.size and g.reshape(-1)[place] > 1e-9 else (-1, 0))
    return out


def fit_quantile_trees(df: DataFrame, features: Sequence[str], taus: Mapping[str, float], y: str = "y", rounds: int = 60, depth: int = 3, step: float = 0.1,
                       share: float = 0.8, bins: int = 64, least: int = 10, seed: int = 42, keys: Sequence[str] | None = None) -> QuantileTrees:
    """Trees for every quantile in ``taus``, on the complete rows of ``df``.

    ``share`` of the rows, drawn by a hash of ``keys`` (else of features and target), grows
    each round's splits; all rows set the leaves.  The number of passes does not grow with that
    of quantiles.
    """
    spark, names, k = df.sparkSession, list(taus), len(features)
    whole = df.na.drop(subset=[*features, y])
    cuts = {f"{j}": j / bins for j in range(1, bins)}
    long = whole.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features)])).alias("s"))
    found = qt.quantiles(long.select("s.i", "s.v"), "v", cuts, ["i"]).collect()
    edges = [sorted({r["value"] for r in found if r["i"] == i}) for i in range(k)]
    first = {r["label"]: r["value"] for r in qt.quantiles(whole, y, taus).collect()}
    if not first:
        raise ValueError("no complete rows to fit on")
    model = QuantileTrees(list(features), edges, {t: float(first[t]) for t in names}, {t: [] for t in names}, depth)
    start = np.array([first[t] for t in names])

    xs, ps = [f"x{i}" for i in range(k)], [f"p{i}" for i in range(len(names))]

    row = F.xxhash64(F.lit(seed), *(keys or [*features, y]))
    raw = whole.select(row.alias("h"), *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)], F.col(y).cast("double").alias("y"))

    def kept(rows: DataFrame) -> DataFrame:
        path = scratch_path(spark, "boosting")
        rows.write.parquet(path)
        return spark.read.parquet(path)

    if bins**k <= CELLS:
        _grow_on_cells(model, raw, kept, taus, rounds, step, share, bins, least)
        return model

    def encode(batches):
        for pdf in batches:
            x = _binned(pdf[[f"_f{i}" for i in range(k)]].to_numpy(float), edges).astype(np.int16)
            yield pd.DataFrame({"h": pdf["h"], "y": pdf["y"]} | {c: x[:, i] for i, c in enumerate(xs)} | {c: start[i] for i, c in enumerate(ps)})

    layout = "h long, y double, " + ", ".join([f"{c} short" for c in xs] + [f"{c} double" for c in ps])
    state = kept(raw.mapInPandas(encode, layout))
    recent: dict[str, list[dict]] = {t: [] for t in names}

    def seen(pdf: pd.DataFrame, trees: Mapping[str, list[dict]]):
        x, p = pdf[xs].to_numpy(np.int64), pdf[ps].to_numpy(float)
        return x, pdf["y"].to_numpy(float), p + np.column_stack([_total(x, trees[t], depth) for t in names])

    for turn in range(rounds):
        grown = {t: _stump(depth) for t in names}
        old = {t: list(v) for t, v in recent.items()}
        for level in range(depth):
            nodes, open_ = 2**level, {t: dict(g) for t, g in grown.items()}

            def count(batches, level=level, nodes=nodes, open_=open_, old=old, turn=turn):
                for pdf in batches:
                    pdf = pdf[_drawn(pdf["h"].to_numpy(), turn, share)]
                    x, target, p = seen(pdf, old)
                    for i, t in enumerate(names):
                        node = _leaf_of(x, open_[t], level) - (nodes - 1)
                        cell = ((node[:, None] * k + np.arange(k)) * bins + x).reshape(-1)
                        low = np.repeat(target < p[:, i], k)
                        n, below = np.bincount(cell, minlength=nodes * k * bins), np.bincount(cell[low], minlength=nodes * k * bins)
                        held = np.flatnonzero(n)
                        yield pd.DataFrame({"t": i, "cell": held, "n": n[held], "below": below[held]})

            table = state.mapInPandas(count, "t int, cell long, n long, below long").groupBy("t", "cell").agg(F.sum("n").alias("n"), F.sum("below").alias("below")).toPandas()
            for i, t in enumerate(names):
                own = table[table["t"] == i]
                n, below = np.zeros(nodes * k * bins), np.zeros(nodes * k * bins)
                n[own["cell"]], below[own["cell"]] = own["n"], own["below"]
                shape = (nodes, k, bins)
                for j, (f, b) in enumerate(_best_splits(below.reshape(shape), n.reshape(shape), taus[t], least)):
                    grown[t]["feature"][nodes - 1 + j], grown[t]["cut"][nodes - 1 + j] = f, b

        def residuals(batches, grown=grown, old=old):
            for pdf in batches:
                x, target, p = seen(pdf, old)
                for i, t in enumerate(names):
                    r = target - p[:, i]
                    part = pd.DataFrame({"leaf": _leaf_of(x, grown[t], depth) - (2**depth - 1), "bin": _residual_bin(r), "r": r})
                    part = part.groupby(["leaf", "bin"])["r"].agg(["size", "min", "max"]).reset_index()
                    yield pd.DataFrame({"t": i, "leaf": part["leaf"], "bin": part["bin"], "n": part["size"], "lo": part["min"], "hi": part["max"]})

        tau = F.element_at(F.array(*[F.lit(float(taus[t])) for t in names]), F.col("t") + 1)
        found = state.mapInPandas(residuals, "t int, leaf long, bin long, n long, lo double, hi double").groupBy("t", "leaf", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        group = Window.partitionBy("t", "leaf")
        found = found.withColumns({"cum": F.sum("n").over(group.orderBy("bin")), "rank": tau * (F.sum("n").over(group) - 1)})
        here = (F.col("rank") < F.col("cum")) & (F.col("rank") >= F.col("cum") - F.col("n"))
        inside = F.coalesce((F.col("rank") - F.col("cum") + F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0))
        for r in found.where(here).select("t", "leaf", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.least(inside, F.lit(1.0))).alias("v")).collect():
            grown[names[r["t"]]]["value"][r["leaf"]] = step * float(r["v"])
        for t in names:
            recent[t].append(grown[t])
            model.trees[t].append(grown[t])
        if (turn + 1) % KEEP == 0 and turn + 1 < rounds:
            old = {t: list(v) for t, v in recent.items()}

            def forward(batches, old=old):
                for pdf in batches:
                    _, _, p = seen(pdf, old)
                    yield pdf.assign(**{c: p[:, i] for i, c in enumerate(ps)})

            state = kept(state.mapInPandas(forward, layout))
            recent = {t: [] for t in names}
    return model


def _stump(depth: int) -> dict:
    return {"feature": [-1] * (2**depth - 1), "cut": [0] * (2**depth - 1), "value": [0.0] * 2**depth}


def _drawn(h: np.ndarray, turn: int, share: float) -> np.ndarray:
    """Does a row, by its hash, take part in the splits of a round?"""
    draw = (h.view(np.uint64) ^ np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    # a draw's first 53 bits as a fraction, below ``share``
    return (draw >> np.uint64(11)) < np.uint64(np.ceil(share * 2.0**53))


def _grow_on_cells(model: QuantileTrees, raw: DataFrame, kept, taus: Mapping[str, float], rounds: int, step: float, share: float, bins: int, least: int) -> None:
    """Grow the trees where a row needs no more than the number of its cell (a combination of bins).

    Rows are dealt by ranges of cell and hash, so a task knows few cells and a cell with many
    rows is cut.  A block has its rows by cell, as arrays.  Per round one pass counts rows of
    cells for all levels, one counts residuals of leaves per octave, and one takes the narrow
    bins of the octave that has the wanted rank.
    """
    names, edges, depth, k = list(taus), model.edges, model.depth, len(model.features)
    sc, cells, leaves = raw.sparkSession.sparkContext, bins**k, 2**depth
    sides = bins ** np.arange(k)

    def encode(batches):
        for pdf in batches:
            x = _binned(pdf[[f"_f{i}" for i in range(k)]].to_numpy(float), edges)
            yield pd.DataFrame({"h": pdf["h"], "y": pdf["y"], "cell": (x @ sides).astype(np.int32)})

    def pack(batches):
        held, n = [], 0

        def block():
            h, y, cell = (np.concatenate([b[i] for b in held]) for i in range(3))
            order = np.argsort(cell, kind="stable")
            some, size = np.unique(cell, return_counts=True)
            return pa.RecordBatch.from_pydict({name: pa.array([v.tobytes()], pa.binary()) for name, v in (("h", h[order]), ("y", y[order]), ("cell", some.astype(np.int32)), ("size", size.astype(np.int32)))})

        for b in batches:
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            n += b.num_rows
            if n >= BLOCK:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    rows = kept(raw.mapInPandas(encode, "h long, y double, cell int"))
    blocks = rows.repartitionByRange(max(1, -(-rows.count() // BLOCK_PART)), "cell", "h").mapInArrow(pack, "h binary, y binary, cell binary, size binary").persist()

    def arrays_of(batch, **types):
        for i in range(batch.num_rows):
            yield [np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in types.items()]

    def passed(columns: Sequence[str], work, schema: str, given):
        """Rows that tasks make of the blocks with a value given to all of them."""
        shared = sc.broadcast(given)
        try:
            return blocks.select(*columns).mapInArrow(lambda batches: work(batches, shared.value), schema).collect()
        finally:
            shared.destroy()

    def count(batches, given):
        turn, now = given
        for b in batches:
            for h, y, cell, size in arrays_of(b, h=np.int64, y=np.float64, cell=np.int32, size=np.int32):
                first, use = np.cumsum(size) - size, _drawn(h, turn, share)
                out = [np.add.reduceat(use, first, dtype=np.int64)]
                out += [np.add.reduceat(use & (y < np.repeat(p[cell], size)), first, dtype=np.int64) for p in now]
                yield pa.RecordBatch.from_pydict({"cell": pa.array([cell.tobytes()], pa.binary()), "n": pa.array([np.concatenate(out).tobytes()], pa.binary())})

    def octaves(batches, given):
        now, leaf = given
        for b in batches:
            for y, cell, size in arrays_of(b, y=np.float64, cell=np.int32, size=np.int32):
                for i, (p, f) in enumerate(zip(now, leaf)):
                    place = _residual_bin(y - np.repeat(p[cell], size)) // RESIDUAL_BINS
                    low = int(place.min())
                    key = np.repeat(f[cell].astype(np.int64), size) * (int(place.max()) - low + 1) + (place - low)
                    n = np.bincount(key)
                    some = np.flatnonzero(n)
                    width = int(place.max()) - low + 1
                    yield pa.RecordBatch.from_pydict({"t": pa.array(np.full(len(some), i)), "leaf": pa.array(some // width), "octave": pa.array(some % width + low), "n": pa.array(n[some])})

    def narrow(batches, given):
        now, leaf, wanted = given
        for b in batches:
            for y, cell, size in arrays_of(b, y=np.float64, cell=np.int32, size=np.int32):
                for i, (p, f, (low, high, octave)) in enumerate(zip(now, leaf, wanted)):
                    r, at = y - np.repeat(p[cell], size), f[cell]
                    # near the octave by value, then by the bin itself
                    near = np.flatnonzero((r >= np.repeat(low[at], size)) & (r <= np.repeat(high[at], size)))
                    r, at = r[near], np.repeat(at, size)[near].astype(np.int64)
                    place = _residual_bin(r)
                    own = place // RESIDUAL_BINS == octave[at]
                    r, key = r[own], at[own] * RESIDUAL_BINS + place[own] % RESIDUAL_BINS
                    n, lo, hi = np.bincount(key, minlength=leaves * RESIDUAL_BINS), np.full(leaves * RESIDUAL_BINS, np.inf), np.full(leaves * RESIDUAL_BINS, -np.inf)
                    np.minimum.at(lo, key, r)
                    np.maximum.at(hi, key, r)
                    some = np.flatnonzero(n)
                    yield pa.RecordBatch.from_pydict({"t": pa.array([i])} | {name: pa.array([v.tobytes()], pa.binary()) for name, v in (("key", some), ("n", n[some]), ("lo", lo[some]), ("hi", hi[some]))})

    every = np.arange(cells)[:, None] // sides % bins
    base = [np.full(cells, model.start[t]) for t in names]
    recent = [np.zeros(cells) for _ in names]
    for turn in range(rounds):
        grown, now = [_stump(depth) for _ in names], [b + r for b, r in zip(base, recent)]
        n, below = np.zeros(cells, np.int64), np.zeros((len(names), cells), np.int64)
        for r in passed(["h", "y", "cell", "size"], count, "cell binary, n binary", (turn, now)):
            cell, got = np.frombuffer(r["cell"], np.int32), np.frombuffer(r["n"], np.int64).reshape(len(names) + 1, -1)
            n[cell] += got[0]
            below[:, cell] += got[1:]
        held = np.flatnonzero(n)
        for i, t in enumerate(names):
            for level in range(depth):
                nodes = 2**level
                node = _leaf_of(every[held], grown[i], level) - (nodes - 1)
                place = ((node[:, None] * k + np.arange(k)) * bins + every[held]).reshape(-1)
                # counts stay below 2**53, where doubles are exact
                all_, low = (np.bincount(place, np.repeat(c[held], k), nodes * k * bins).reshape(nodes, k, bins) for c in (n, below[i]))
                for j, (f, b) in enumerate(_best_splits(low, all_, taus[t], least)):
                    grown[i]["feature"][nodes - 1 + j], grown[i]["cut"][nodes - 1 + j] = f, b
        leaf = [(_leaf_of(every, g, depth) - (leaves - 1)).astype(np.int16) for g in grown]
        coarse: dict[tuple[int, int], dict[int, int]] = {}
        for r in passed(["y", "cell", "size"], octaves, "t long, leaf long, octave long, n long", (now, leaf)):
            own = coarse.setdefault((r["t"], r["leaf"]), {})
            own[r["octave"]] = own.get(r["octave"], 0) + r["n"]
        wanted = [(np.full(leaves, np.inf), np.full(leaves, -np.inf), np.zeros(leaves, np.int64)) for _ in names]
        rank = {}
        for (i, at), own in coarse.items():
            place, cum = float(taus[names[i]]) * (sum(own.values()) - 1), 0
            for octave in sorted(own):
                cum += own[octave]
                if place < cum:
                    break
            rank[i, at] = place, cum - own[octave]
            wanted[i][0][at], wanted[i][1][at], wanted[i][2][at] = *_octave_range(octave), octave
        size, lo, hi = np.zeros((len(names), leaves * RESIDUAL_BINS), np.int64), np.full((len(names), leaves * RESIDUAL_BINS), np.inf), np.full((len(names), leaves * RESIDUAL_BINS), -np.inf)
        for r in passed(["y", "cell", "size"], narrow, "t long, key binary, n binary, lo binary, hi binary", (now, leaf, wanted)):
            i, key = r["t"], np.frombuffer(r["key"], np.int64)
            size[i, key] += np.frombuffer(r["n"], np.int64)
            lo[i, key], hi[i, key] = np.minimum(lo[i, key], np.frombuffer(r["lo"])), np.maximum(hi[i, key], np.frombuffer(r["hi"]))
        for (i, at), (place, before) in rank.items():
            own = slice(at * RESIDUAL_BINS, (at + 1) * RESIDUAL_BINS)
            cum = before + np.cumsum(size[i, own])
            nth = own.start + int(np.argmax(place < cum))
            n, low, high, upto = int(size[i, nth]), float(lo[i, nth]), float(hi[i, nth]), int(cum[nth - own.start])
            grown[i]["value"][at] = step * (low + (high - low) * min((place - upto + n) / (n - 1) if n > 1 else 0.0, 1.0))
        for i, t in enumerate(names):
            model.trees[t].append(grown[i])
            recent[i] = recent[i] + np.asarray(grown[i]["value"])[leaf[i]]
            if (turn + 1) % KEEP == 0:
                base[i], recent[i] = base[i] + recent[i], np.zeros(cells)
    blocks.unpersist()


def _octave_range(octave: int) -> tuple[float, float]:
    """Residuals between which all of an octave of bins lie, a little more on each side."""
    # the bin of a residual r > 0 is floor(log2(r) * RESIDUAL_BINS) + 1100 * RESIDUAL_BINS; those below 0 mirror it
    if octave == 0:
        return -1e-280, 1e-280
    if octave > 0:
        return float(np.exp2(octave - 1100.0)) * (1 - 1e-9), float(np.exp2(octave - 1099.0)) * (1 + 1e-9)
    # bins -b with octave * B <= -b < (octave + 1) * B
    return -float(np.exp2(-octave - 1100.0 + 1 / RESIDUAL_BINS)) * (1 + 1e-9), -float(np.exp2(-octave - 1101.0)) * (1 - 1e-9)


def pinball(y, yhat, tau: float):
    """Pinball loss of a quantile prediction, a column."""
    r = y - yhat
    return F.when(r >= 0, tau * r).otherwise((tau - 1) * r)
