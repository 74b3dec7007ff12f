"""Rounds of questions between blocks of documents and shards of keys.

Documents are dealt into blocks of a few megabytes.  In a round each block sends to every
shard one message with its distinct keys in that shard's range, sorted; the shard merges the
messages of all blocks and answers each with one value per key, in the order of the message.
A block looks its keys up in the answer by place, so positions never travel.  A key that
fills a third of the corpus comes once from each block, so there are no hot shards, and no
task holds more than a block or a shard.  Nothing is broadcast.

A message of an earlier round rides along with later ones (``forward``), so the last step has
all answers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = "_block int, _id long, _text string"
MAIL = "_block int, _shard int, _round int, _a binary, _b binary, _c binary"
#: Bytes of text in a block; a task needs about 40 times that.
BLOCK_BYTES = 4 << 20


def block_count(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    size = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16)).first()[0] or 0
    return max(1, -(-size // block_bytes))


def in_blocks(docs: DataFrame, blocks: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_block, _id, _text); rows of one id share a block, rows without id follow their text."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = F.col(doc_id).cast("long")
    where = F.pmod(F.xxhash64(F.coalesce(key, F.xxhash64(body))), F.lit(blocks)).cast("int")
    return docs.select(where.alias("_block"), key.alias("_id"), body.alias("_text"))


def key_widths(positions: int) -> tuple[int, type]:
    """Bits of a key's first hash and kind of its second: wide enough that fewer than one in a
    thousand corpora of so many positions has two different strings with one key."""
    total = 2 * max(positions, 2).bit_length() + 9
    second = np.uint16 if total <= 80 else np.uint32
    return min(64, max(32, total - 8 * np.dtype(second).itemsize)), second


def narrowed(h1: np.ndarray, h2: np.ndarray, widths: tuple[int, type]) -> tuple[np.ndarray, np.ndarray]:
    bits, second = widths
    low = np.uint64(64 - bits)
    return (h1 >> low) << low, (h2 >> np.uint64(64 - 8 * np.dtype(second).itemsize)).astype(second)


# --- messages -------------------------------------------------------------------------


def planes(values: np.ndarray) -> bytes:
    """An array of whole numbers bit by bit: all lowest bits, then all second ones, up to the
    highest in use, so that a number costs no more bits than the largest has."""
    values = np.ascontiguousarray(values)
    n, size = len(values), values.itemsize
    used = int(values.view(f"u{size}").max()).bit_length() if n else 0
    bits = np.unpackbits(values.view(np.uint8).reshape(n, size), axis=1, bitorder="little")[:, :used]
    return n.to_bytes(4, "little") + used.to_bytes(1, "little") + np.packbits(np.ascontiguousarray(bits.T), axis=1).tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    n, used = int.from_bytes(data[:4], "little"), data[4]
    whole = np.zeros((8 * size, n), np.uint8)
    if n and used:
        whole[:used] = np.unpackbits(np.frombuffer(data, np.uint8, offset=5).reshape(used, -1), axis=1, count=n)
    return np.packbits(whole.T, axis=1, bitorder="little").reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=keys.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, np.uint64), dtype=np.uint64)


def shard_edges(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range begins in sorted 64-bit keys, and the end."""
    firsts = np.array([(s << 64) // shards + (1 if (s << 64) % shards else 0) for s in range(1, shards)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, firsts), [len(keys)]])


class Mail:
    """Collects the rows of one task's messages."""

    def __init__(self, block: int):
        self.block = block
        self.rows: list[tuple] = []

    def add(self, shard: int, round_: int, a: bytes = b"", b: bytes = b"", c: bytes = b"", block: int | None = None):
        self.rows.append((self.block if block is None else block, shard, round_, a, b, c))

    def send(self, round_: int, keys: np.ndarray, shards: int, second: Callable = lambda lo, hi: b"", third: Callable = lambda lo, hi: b""):
        """Sorted keys to the shards of their ranges, with up to two more fields."""
        edges = shard_edges(keys, shards)
        for s in range(shards):
            lo, hi = int(edges[s]), int(edges[s + 1])
            if hi > lo:
                self.add(s, round_, pack_sorted(keys[lo:hi]), second(lo, hi), third(lo, hi))

    def table(self) -> pa.Table:
        columns = list(zip(*self.rows)) or [()] * 6
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        names = ["_block", "_shard", "_round", "_a", "_b", "_c"]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def answers(mail: pa.Table, round_: int) -> list[tuple[bytes, bytes, bytes]]:
    """What the shards answered in a round, by shard."""
    rows = [r for r in zip(*(mail.column(c).to_pylist() for c in ("_round", "_shard", "_a", "_b", "_c"))) if r[0] == round_]
    return [r[2:] for r in sorted(rows, key=lambda r: r[1])]


def answered(mail: pa.Table, round_: int, dtype) -> np.ndarray:
    """All answers of a round, one value per sorted key that was sent."""
    parts = [np.frombuffer(a, dtype) for a, _, _ in answers(mail, round_)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


# --- plans ----------------------------------------------------------------------------


def first_round(blocks: DataFrame, send: Callable[[pa.Table, Mail], None]) -> DataFrame:
    def run(key, table):
        mail = Mail(key[0].as_py())
        send(table, mail)
        return mail.table()

    return blocks.groupBy("_block").applyInArrow(run, MAIL)


def next_round(blocks: DataFrame, mail: DataFrame, send: Callable[[pa.Table, pa.Table, Mail], None], shards: int) -> DataFrame:
    """A step that sees its block and all answers so far, which it sends along."""

    def run(key, table, got):
        out = Mail(key[0].as_py())
        for at, row in enumerate(zip(*(got.column(c).to_pylist() for c in ("_round", "_shard", "_a", "_b", "_c")))):
            # an answer keeps its shard's number in ``_c`` while another shard carries it
            out.add((out.block + at) % shards, -row[0], row[2], row[3], row[1].to_bytes(4, "little"))
        send(table, got, out)
        return out.table()

    return blocks.groupBy("_block").cogroup(mail.groupBy("_block")).applyInArrow(run, MAIL)


def answer(mail: DataFrame, merge: Callable[[list, list, list], list[bytes]]) -> DataFrame:
    """Each shard's answers; ``merge`` gets three lists with a field of every message each, by block.

    A shard that is computed again gives the same answers.
    """

    def run(key, table):
        table = table.sort_by("_block")
        rounds = table.column("_round").to_pylist()
        blocks, fields = table.column("_block").to_pylist(), [table.column(c).to_pylist() for c in ("_a", "_b", "_c")]
        out = Mail(0)
        live = [i for i, r in enumerate(rounds) if r > 0]
        for i, r in enumerate(rounds):
            if r < 0:
                out.add(int.from_bytes(fields[2][i], "little"), -r, fields[0][i], fields[1][i], block=blocks[i])
        if live:
            replies = merge(*([f[i] for i in live] for f in fields))
            for i, reply in zip(live, replies):
                out.add(key[0].as_py(), rounds[i], reply, block=blocks[i])
        return out.table()

    return mail.groupBy("_shard").applyInArrow(run, MAIL)


def last_step(blocks: DataFrame, mail: DataFrame, finish: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    def run(key, table, got):
        return finish(table, got)

    return blocks.groupBy("_block").cogroup(mail.groupBy("_block")).applyInArrow(run, schema)


# --- merges ---------------------------------------------------------------------------


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal sorted keys, and the run of every key."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def split_like(values: np.ndarray, lengths: list[int]) -> list[bytes]:
    return [part.tobytes() for part in np.split(values, np.cumsum(lengths)[:-1])]


def merge_levels(keys: list[bytes], counts: list[bytes], _) -> list[bytes]:
    """For every key the bit length of its total count: 1 for one, 2 for two or three, and so on.

    A message without counts counts every key once.
    """
    parts = [unpack_sorted(k) for k in keys]
    lengths = [len(p) for p in parts]
    every = np.concatenate(parts)
    tallies = [unplanes(c, np.uint32) if c else np.ones(n, np.uint32) for c, n in zip(counts, lengths)]
    order = np.argsort(every, kind="stable")
    starts, run = runs_of(every[order])
    totals = np.add.reduceat(np.concatenate(tallies)[order].astype(np.int64), starts)
    level = (np.frexp(totals.astype(np.float64))[1]).astype(np.uint8)
    out = np.empty(len(every), np.uint8)
    out[order] = level[run]
    return split_like(out, lengths)


def distinct(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts keys of two hashes, the start of each run of equal ones, the run of every place."""
    order = np.argsort(h1, kind="stable")
    a, b = h1[order], h2[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    if len(a) and (~new[1:] & (b[1:] != b[:-1])).any():
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


#: Answers of ``merge_shared``.
ALONE, OWNER, SHARED = 0, 1, 2


def merge_shared(keys: list[bytes], seconds: list[bytes], _) -> list[bytes]:
    """For every key of two hashes, whether other blocks sent it too, and which block owns it then."""
    return _merge_shared(keys, seconds, np.uint16)


def merge_shared_wide(keys: list[bytes], seconds: list[bytes], _) -> list[bytes]:
    return _merge_shared(keys, seconds, np.uint32)


def _merge_shared(keys: list[bytes], seconds: list[bytes], kind: type) -> list[bytes]:
    parts = [unpack_sorted(k) for k in keys]
    lengths = [len(p) for p in parts]
    h1, h2 = np.concatenate(parts), np.concatenate([unplanes(s, kind) for s in seconds])
    order, starts, run = distinct(h1, h2)
    code = np.where(np.diff(np.append(starts, len(h1))) > 1, SHARED, ALONE).astype(np.uint8)[run]
    code[starts] = np.minimum(code[starts], OWNER)
    out = np.empty(len(h1), np.uint8)
    out[order] = code
    return split_like(out, lengths)
