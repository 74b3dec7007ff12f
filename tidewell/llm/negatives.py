"""Hard-negative mining with an exact matrix product in a residue number system.

Components are integers.  Modulo a small prime they and their products are small enough for
a float32 matrix product without rounding; several primes together determine every signed
score, which Chinese remaindering puts back.  How many primes a table needs follows from its
longest vector.  Anchors and rows are packed in blocks; every block of anchors meets every
block of rows in a task of its own, first for the positives, then for the negatives between
the bounds that the positives set.  A block pair passes on only its best rows per anchor, and
a window keeps the best of those.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.session import scratch_path

#: Rows of a block of the table and of a block of anchors, and bytes of either at most.
BLOCK, ANCHORS, BLOCK_BYTES = 4096, 1024, 1 << 23
#: Dimensions of one float32 product: 64 * 510^2 < 2^24, so its sums are exact.
SLICE = 64
#: Partitions in which blocks meet, at most.
MOST_TASKS = 20_000
#: Scores must stay below 2^62.
MOST_BITS = 62
_LEAST = np.iinfo(np.int64).min


def primes(bound: int) -> list[int]:
    """The largest primes below 1024, as many as tell all scores from -bound to bound apart."""
    sieve = np.ones(1024, bool)
    sieve[:2] = False
    for n in range(2, 32):
        if sieve[n]:
            sieve[n * n :: n] = False
    out, product = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if product > 2 * bound + 1:
            break
        out.append(p)
        product *= p
    return out


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Residue nearest to zero."""
    r = x % p
    return r - p * (r > p // 2)


class Residues:
    """Inner products of integer rows, each modulo several primes in float32."""

    def __init__(self, moduli: list[int]):
        self.moduli = moduli

    def split(self, values: np.ndarray) -> list[np.ndarray]:
        return [balanced(values, p).astype(np.float32) for p in self.moduli]

    def scores(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """Exact products of all rows of ``a`` with all rows of ``b``, by mixed radix digits."""
        total, weight, digits = None, 1, []
        for i, p in enumerate(self.moduli):
            rest = np.zeros((len(a[i]), len(b[i])), np.int32)
            for at in range(0, a[i].shape[1], SLICE):
                rest += (a[i][:, at : at + SLICE] @ b[i][:, at : at + SLICE].T).astype(np.int32) % p
            rest %= p
            for q, digit in digits:
                rest = (rest - digit) * pow(q, -1, p) % p
            digit = balanced(rest, p)
            digits.append((p, digit))
            total = digit.astype(np.int64) if total is None else total + digit.astype(np.int64) * weight
            weight *= p
        return np.zeros((len(a[0]) if a else 0, len(b[0]) if b else 0), np.int64) if total is None else total


def best(scores: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest fitting scores of every row; ties go to the lower column."""
    n = scores.shape[1]
    if scores.size == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if k < n:
        bits = max(1, int(n - 1).bit_length())
        if np.abs(scores).max() < 1 << (62 - bits):  # score and column fit one integer
            key = np.where(fits, (scores << bits) + (n - 1 - np.arange(n)), _LEAST)
            top = np.argpartition(key, n - k, axis=1)[:, n - k :]
        else:
            top = np.argsort(np.where(fits, -scores, -_LEAST - 1), axis=1, kind="stable")[:, :k]
    else:
        top = np.broadcast_to(np.arange(n), scores.shape)
    row = np.repeat(np.arange(len(scores)), top.shape[1])
    col = top.reshape(-1)
    ok = fits[row, col]
    return row[ok], col[ok]


def relabelled(vectors: DataFrame, vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """Every seventh row's label moves on by one of ten."""
    moved = F.when(F.col(vec_id) % 7 == 0, (F.col(label).cast("long") + 1) % 10).otherwise(F.col(label).cast("long"))
    return vectors.withColumn(label, moved)


_PACKED = "block long, ids binary, labels binary, vals binary, n int, width int, norm double"


def _pack(ids, labels, values, block: int):
    """One row with up to a block of rows, in order of id, in the narrowest integers that hold them."""
    order = np.argsort(ids, kind="stable")
    values = values[order]
    top = int(np.abs(values).max()) if values.size else 0
    kind = np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64
    return pa.RecordBatch.from_pydict({
        "block": pa.array([block], pa.int64()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "labels": pa.array([labels[order].tobytes()], pa.binary()),
        "vals": pa.array([values.astype(kind).tobytes()], pa.binary()), "n": pa.array([len(ids)], pa.int32()), "width": pa.array([values.shape[1]], pa.int32()),
        "norm": pa.array([float((values.astype(np.float64) ** 2).sum(1).max())], pa.float64()),
    })


def _unpack(ids: bytes, labels: bytes, vals: bytes, n: int, width: int, size: int):
    kind = {2: np.int16, 4: np.int32, 8: np.int64}.get(len(vals) // max(1, n * width), np.int16)
    values = np.zeros((n, size), np.int64)
    values[:, :width] = np.frombuffer(vals, kind, n * width).reshape(n, width)
    return np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), values


def _packer(most: int):
    """Packs the rows of a partition; blocks are numbered by partition and place."""

    def pack(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        kept: list = []
        held = 0

        def flush():
            width = max(v.shape[1] for _, _, v in kept)
            values = np.vstack([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for _, _, v in kept])
            return _pack(np.concatenate([x[0] for x in kept]), np.concatenate([x[1] for x in kept]), values, (part << 32) + made)

        for batch in batches:
            ids, labels = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False), np.int64) for i in (0, 1))
            column = batch.column(2)
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten()
            bad = flat.is_null().to_numpy(zero_copy_only=False)
            flat = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            ok = np.ones(len(sizes), bool)
            ok[row[bad | ~np.isfinite(flat)]] = False
            if ok[row].any() and np.abs(flat[ok[row]]).max() >= 2.0 ** (MOST_BITS - 8):
                raise OverflowError("components are too large for 64-bit scores")
            whole = np.floor(256.0 * np.where(ok[row], flat, 0)).astype(np.int64)
            first = np.cumsum(sizes) - sizes
            for width in np.unique(sizes[ok]):
                own = np.flatnonzero(ok & (sizes == width))
                while len(own):
                    room = max(1, min(most, BLOCK_BYTES // max(2, 2 * int(width))) - held)
                    some, own = own[:room], own[room:]
                    kept.append((ids[some], labels[some], whole[first[some][:, None] + np.arange(width)]))
                    held += len(some)
                    if held >= min(most, BLOCK_BYTES // max(2, 2 * int(width))):
                        yield flush()
                        kept, held, made = [], 0, made + 1
        if kept:
            yield flush()

    return pack


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, so block numbers are fixed."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _numbered(packed: DataFrame, name: str) -> DataFrame:
    """Blocks numbered from 0 without a gap; one small row per block is sorted."""
    numbers = packed.select("block").withColumn(name, F.row_number().over(W.orderBy("block")) - 1)
    return packed.join(numbers, "block")


_SIDE = ("ids", "labels", "vals", "n", "width")


def _meeting(anchors: DataFrame, rows: DataFrame, n_rows: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Every block of anchors beside every block of rows; a block of rows moves once."""
    tasks = min(4 * n_rows, MOST_TASKS)
    left = anchors.select("a", *[F.col(c).alias(f"a_{c}") for c in _SIDE], *more, F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("r"))
    right = rows.select("r", *[F.col(c).alias(f"r_{c}") for c in _SIDE])
    return left.repartition(tasks, "r").hint("merge").join(right.repartition(tasks, "r"), "r")


def hard_negatives(vectors: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
                   vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component x counts as floor(256 x); a row's score is its inner product with the anchor,
    higher first, equal ones by smaller id.  Anchors are the rows whose id is divisible by
    ``every``; their positives are the first ``n_positives`` other rows of the same label, and
    each positive gets the first ``n_negatives`` rows of another label whose score is between
    ``low`` and ``high`` per cent of its own.

    Rows with a null id, label or vector, or any null or non-finite component, take no part.
    Vectors of different length are compared as if the shorter one went on with zeros.  Rows
    that repeat are rows of their own, also as anchors and positives.  An anchor without
    positives, and a positive without negatives, gives no rows; so does an empty table.  Other
    columns are ignored.  Scores beyond 2^62 end the job with an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector")).dropna()
    none = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    size = rows.count()
    if not size:
        return none
    # few rows in many partitions would make many small blocks
    packed = _kept(rows.coalesce(-(-size // BLOCK)).mapInArrow(_packer(BLOCK), _PACKED), "vectors")
    shape = packed.agg(F.max("width"), F.max("norm")).first()
    # no product of two vectors is beyond the square of the longest one
    width, bound = int(shape[0] or 0), math.ceil((shape[1] or 0) * (1 + 1e-9))
    if bound >> MOST_BITS:
        raise OverflowError("components are too large for 64-bit scores")
    moduli = primes(bound)
    blocks = _kept(_numbered(packed, "r"), "blocks")
    n_rows = blocks.count()

    def choose(batches):
        for batch in batches:
            for r, ids, labels, vals, n, wide in zip(*(batch.column(i).to_pylist() for i in range(6))):
                ids, labels, values = _unpack(ids, labels, vals, n, wide, width)
                own = np.flatnonzero(ids % every == 0)
                if len(own):
                    yield pa.RecordBatch.from_pydict({
                        "home": pa.array([r] * len(own), pa.int32()), "place": pa.array(own, pa.int32()), "id": pa.array(ids[own]), "label": pa.array(labels[own]),
                        "vals": pa.array([v.tobytes() for v in values[own]], pa.binary()),
                    })

    def gather(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ANCHORS):
                home, place, ids, labels, vals = batch.slice(at, ANCHORS).columns
                n = len(ids)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([(part << 32) + made], pa.int64()), "home": pa.array([home.to_numpy().tobytes()], pa.binary()), "place": pa.array([place.to_numpy().tobytes()], pa.binary()),
                    "ids": pa.array([ids.to_numpy().tobytes()], pa.binary()), "labels": pa.array([labels.to_numpy().tobytes()], pa.binary()),
                    "vals": pa.array([b"".join(vals.to_pylist())], pa.binary()), "n": pa.array([n], pa.int32()), "width": pa.array([width], pa.int32()),
                })
                made += 1

    chosen = _kept(blocks.select("r", "ids", "labels", "vals", "n", "width").mapInArrow(choose, "home int, place int, id long, label long, vals binary"), "anchors")
    n_anchors = chosen.count()
    if not n_anchors:
        return none
    dealt = chosen.repartition(-(-n_anchors // ANCHORS), "home", "place")
    anchors = _kept(_numbered(dealt.mapInArrow(gather, "block long, home binary, place binary, ids binary, labels binary, vals binary, n int, width int"), "a"), "anchors")

    def tiles(batch):
        """Scores of each pair of blocks, in slices of rows."""
        system = Residues(moduli)
        for i in range(batch.num_rows):
            one = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            a_ids, a_labels, a = _unpack(*(one[f"a_{c}"] for c in _SIDE), width)
            r_ids, r_labels, r = _unpack(*(one[f"r_{c}"] for c in _SIDE), width)
            yield one, a_ids, a_labels, r_ids, r_labels, system.scores(system.split(a), system.split(r))

    def positives(batches):
        for batch in batches:
            for one, a_ids, a_labels, r_ids, r_labels, scores in tiles(batch):
                fits = a_labels[:, None] == r_labels[None, :]
                home, place = (np.frombuffer(one[c], np.int32) for c in ("home", "place"))
                here = home == one["r"]
                fits[np.flatnonzero(here), place[here]] = False
                row, col = best(scores, fits, n_positives)
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array(np.full(len(row), one["a"]), pa.int32()), "nth": pa.array(row, pa.int32()), "anchor_id": pa.array(a_ids[row]),
                    "id": pa.array(r_ids[col]), "score": pa.array(scores[row, col]),
                })

    met = _meeting(anchors, blocks, n_rows, ("home", "place"))
    found = met.mapInArrow(positives, "a int, nth int, anchor_id long, id long, score long")
    first = W.partitionBy("a", "nth").orderBy(F.desc("score"), "id")
    found = _kept(found.withColumn("p", F.row_number().over(first)).filter(F.col("p") <= n_positives), "positives")

    def bounds(key, table):
        table = table.sort_by([("nth", "ascending"), ("p", "ascending")])
        held = {c: pa.array([table.column(c).combine_chunks().to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in ("nth", "p", "score")}
        return pa.table({"a": pa.array([key[0].as_py()], pa.int32())} | held)

    # at most a block of anchors times n_positives rows in a group
    limits = found.groupBy("a").applyInArrow(bounds, "a int, nth binary, p binary, score binary")
    ready = _kept(anchors.join(limits, "a").select("a", *_SIDE, "nth", "p", "score"), "limits")

    def negatives(batches):
        for batch in batches:
            for one, a_ids, a_labels, r_ids, r_labels, scores in tiles(batch):
                nth, p, score = np.frombuffer(one["nth"], np.int32), np.frombuffer(one["p"], np.int32), np.frombuffer(one["score"], np.int64)
                other = a_labels[:, None] != r_labels[None, :]
                # per cent of the quotient and of the rest, which do not overflow
                hundreds, rest = np.divmod(score, 100)
                least, most = low * hundreds - (-low * rest // 100), high * hundreds + high * rest // 100
                for k in range(1, n_positives + 1):
                    own = np.flatnonzero(p == k)
                    who = nth[own]
                    own_scores = scores[who]
                    fits = other[who] & (own_scores >= least[own][:, None]) & (own_scores <= most[own][:, None])
                    row, col = best(own_scores, fits, n_negatives)
                    yield pa.RecordBatch.from_pydict({
                        "a": pa.array(np.full(len(row), one["a"]), pa.int32()), "nth": pa.array(who[row], pa.int32()), "p": pa.array(np.full(len(row), k), pa.int32()),
                        "id": pa.array(r_ids[col]), "score": pa.array(own_scores[row, col]),
                    })

    met = _meeting(ready, blocks, n_rows, ("nth", "p", "score"))
    hard = met.mapInArrow(negatives, "a int, nth int, p int, id long, score long")
    first = W.partitionBy("a", "nth", "p").orderBy(F.desc("score"), "id")
    hard = hard.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n_negatives)
    named = found.select("a", "nth", "p", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(named, ["a", "nth", "p"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
