"""Context-tree weighting over bytes, learned and applied in blocks.

A byte is eight binary decisions, each with its own tree of byte contexts from none to
``depth`` previous bytes.  A node holds the counts of both outcomes in the training texts and
estimates them after Krichevsky and Trofimov; its weighted probability is half its own
estimate and half the product of its children's.  A prediction mixes the estimates along the
path with the weights that this recursion gives, which is the average over all prunings of
the tree.  The texts are lower-cased (A-Z) UTF-8 bytes, closed by one zero byte; before the
start stand zero bytes.

Only distinct (context, byte) strings and tokens of a block travel.  Shards add up their
counts, trees are evaluated per pair of nearest context bytes, the two top levels from sums
of at most 256 x 255 nodes, and each block gets back the probabilities it asked for.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import rounds
from tidewell.llm.text import VALUES, Roller, arrow_bytes, mix, pieces, word_bounds

GRAMS, TOKENS = 1, 2
#: Key of the end token.
END = np.uint64(0x454E44)
#: Subtrees of one nearest context byte are spread over so many groups by the second byte.
SPREAD = 4
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def is_held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


#: Odd multipliers of the scrambling.
_STIR = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _stirred(context: np.ndarray, bits: int, multipliers: tuple[int, int]) -> np.ndarray:
    """A one-to-one scrambling of numbers of so many bits; inverse multipliers in reverse undo it."""
    half, mask = np.uint64(bits // 2 + bits % 2), np.uint64((1 << bits) - 1)
    c = context ^ (context >> half)
    for m in multipliers:
        c = (c * np.uint64(m & ((1 << bits) - 1))) & mask
        c ^= c >> half
    return c


def dealt_key(grams: np.ndarray, depth: int) -> np.ndarray:
    """Scrambled context on top, so that shards get equal shares; the byte below it, so that
    strings of one context stay neighbours and pack well."""
    bits = 8 * depth
    key = (_stirred(grams >> np.uint64(8), bits, _STIR) << np.uint64(8)) | (grams & np.uint64(255))
    return key << np.uint64(56 - bits)


def gram_of(keys: np.ndarray, depth: int) -> np.ndarray:
    """Inverse of ``dealt_key``."""
    bits = 8 * depth
    back = tuple(pow(m, -1, 1 << bits) for m in reversed(_STIR))
    keys = keys >> np.uint64(56 - bits)
    return (_stirred(keys >> np.uint64(8), bits, back) << np.uint64(8)) | (keys & np.uint64(255))


# --- what a block holds ---------------------------------------------------------------


class Texts:
    def __init__(self, table: pa.Table, depth: int):
        data, offsets = arrow_bytes(table.column("_text"))
        upper = (data >= 65) & (data <= 90)
        self.data, self.offsets, self.depth = np.where(upper, data + np.uint8(32), data).astype(np.uint8), offsets, depth
        self.ids = table.column("_id")
        self.held_out = np.array([is_held_out(i) for i in self.ids.to_pylist()], bool)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """For every byte and closing zero: nearest context byte first, the byte itself last."""
        ends = self.offsets + np.arange(len(self.offsets))
        x = np.zeros(len(self.data) + len(self.offsets) + 6, np.uint8)  # seven bytes before the first
        here = np.ones(len(x) - 7, bool)
        here[ends[1:] - 1] = False
        x[7:][here] = self.data
        # the eight bytes up to each place as one number, its own byte on top
        eight = np.ndarray(len(x) - 7, "<u8", x.data, strides=(1,))
        shift = 8 * (6 - self.depth)
        keys = eight >> np.uint64(shift) if shift >= 0 else eight << np.uint64(-shift)
        keys &= np.uint64(((1 << 8 * self.depth) - 1) << 8)
        starts, stops = ends[:-1], ends[1:]
        for j in range(self.depth):  # a text's first places see fewer bytes
            at = starts + j
            keys[at[at < stops]] &= np.uint64(((1 << 8 * j) - 1) << 8 * (self.depth + 1 - j))
        keys |= x[7:]
        return keys, ends

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and the number of words of each text."""
        roller, parts, counts = Roller(0), [], []
        for lo, hi in pieces(self.offsets):
            data = self.data[self.offsets[lo] : self.offsets[hi]]
            start, end, first = word_bounds(data, self.offsets[lo : hi + 1] - self.offsets[lo])
            parts.append(roller.slices(roller.prefix(VALUES[0][data]), start, end))
            counts.append(np.diff(first))
        join = lambda p, kind: np.concatenate(p) if p else np.zeros(0, kind)
        return join(parts, np.uint64), join(counts, np.int64)


def _tally(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs in training."""
    every = np.sort(keys)
    every = every[rounds.runs_of(every)[0]]
    own = np.sort(keys[train])
    starts = rounds.runs_of(own)[0]
    counts = np.zeros(len(every), np.uint32)
    counts[np.searchsorted(every, own[starts])] = np.diff(np.append(starts, len(own)))
    return every, counts


def looked_up(every: np.ndarray, values: np.ndarray, keys: np.ndarray, free: int) -> np.ndarray:
    """The value of each key, by its place in the sorted ``every``.

    Keys whose lowest ``free`` bits are empty carry their place there while a stretch of them is
    sorted: sorted keys are found in order, which is many times faster than keys as they come.
    """
    if free < 12:
        return values[np.searchsorted(every, keys)]
    out, step = np.empty(len(keys), values.dtype), 1 << min(free, 20)
    for lo in range(0, len(keys), step):
        part = np.sort(keys[lo : lo + step] | np.arange(min(step, len(keys) - lo), dtype=np.uint64))
        place = (part & np.uint64(step - 1)).astype(np.int64)
        out[lo + place] = values[np.searchsorted(every, part ^ place.astype(np.uint64))]
    return out


# --- trees ----------------------------------------------------------------------------

_LGAMMA = [math.lgamma(i / 2) for i in range(1, 4097)]


def lgamma_half(twice: np.ndarray) -> np.ndarray:
    """log Gamma(twice / 2) for whole numbers from 1 on."""
    table = np.array(_LGAMMA)
    x = twice / 2.0
    far = np.maximum(x, 1000.0)
    series = (far - 0.5) * np.log(far) - far + 0.5 * math.log(2 * math.pi) + 1 / (12 * far) - 1 / (360 * far**3)
    return np.where(twice <= 4096, table[np.minimum(twice, 4096) - 1], series)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    n0, n1 = np.asarray(n0, np.int64), np.asarray(n1, np.int64)
    return lgamma_half(2 * n0 + 1) + lgamma_half(2 * n1 + 1) - lgamma_half(2 * (n0 + n1) + 2) - math.log(math.pi)


class Trees:
    """Counts and weights of all nodes from ``top`` context bytes down, for sorted distinct keys."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int):
        self.keys, self.depth, self.top = keys, depth, top
        self.nodes: dict[tuple[int, int], tuple] = {}
        below: dict[int, tuple] = {}
        for d in range(depth, top - 1, -1):
            at_d = self.at_depth(keys, d)
            order = np.argsort(at_d, kind="stable")
            starts, _ = rounds.runs_of(at_d[order])
            sorted_keys, sums = at_d[order][starts], np.add.reduceat(counts[order], starts)
            now = {}
            for k in range(8):
                node = sorted_keys >> np.uint64(8 - k)
                first, _ = rounds.runs_of(node)
                ones = ((sorted_keys >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
                n1 = np.add.reduceat(sums * ones, first)
                n0 = np.add.reduceat(sums, first) - n1
                names, own = node[first], log_kt(n0, n1)
                if d == depth:
                    beta, weighted = None, own
                else:
                    child, child_weighted = below[k]
                    low = np.uint64((1 << k) - 1)
                    parent = ((child >> np.uint64(8 + k)) << np.uint64(k)) | (child & low)
                    children = np.bincount(np.searchsorted(names, parent), child_weighted, len(names))
                    beta, weighted = own - children, np.logaddexp(own, children) - math.log(2)
                self.nodes[d, k] = (names, n0, n1, beta)
                now[k] = (names, weighted)
            below = now
        self.weighted = below

    def at_depth(self, keys: np.ndarray, d: int) -> np.ndarray:
        """Key with its nearest d context bytes and the byte only."""
        context = keys >> np.uint64(8 * (self.depth - d + 1))
        return (context << np.uint64(8)) | (keys & np.uint64(255))

    def log10_probabilities(self, beta1, kt1, beta0, kt0) -> np.ndarray:
        """log10 of the probability of every key's byte; the two top levels are given by node number."""
        total = np.zeros(len(self.keys))
        byte = (self.keys & np.uint64(255)).astype(np.int64)
        for k in range(8):
            bit = ((byte >> (7 - k)) & 1).astype(bool)
            p = None
            for d in range(self.depth, self.top - 1, -1):
                names, n0, n1, beta = self.nodes[d, k]
                at = np.searchsorted(names, self.at_depth(self.keys, d) >> np.uint64(8 - k))
                kt = (np.where(bit, n1[at], n0[at]) + 0.5) / (n0[at] + n1[at] + 1)
                p = kt if p is None else _mixed(beta[at], kt, p)
            node = (1 << k) | (byte >> (8 - k))
            for beta, kt in ((beta1, kt1), (beta0, kt0)):
                p = _mixed(beta[node], np.where(bit, kt[node], 1 - kt[node]), p)
            total += np.log10(p)
        return total


def _mixed(beta: np.ndarray, own: np.ndarray, deeper: np.ndarray) -> np.ndarray:
    share = 1 / (1 + np.exp(-np.clip(beta, -700, 700)))
    return share * own + (1 - share) * deeper


def _top_levels(parts: list[tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Per nearest context byte: beta and P(1) at one context byte, then at none, by node number."""
    sums: dict[int, np.ndarray] = {}
    for byte, blob in parts:
        sums[byte] = sums.get(byte, 0) + blob
    one, root = {}, np.zeros((3, 256))
    for byte, (children, n0, n1) in sums.items():
        own = log_kt(n0, n1)
        one[byte] = (own - children, (n1 + 0.5) / (n0 + n1 + 1))
        root += np.stack([np.logaddexp(own, children) - math.log(2), n0, n1])
    beta0, kt0 = log_kt(root[1], root[2]) - root[0], (root[2] + 0.5) / (root[1] + root[2] + 1)
    return {byte: np.stack([beta1, kt1, beta0, kt0]) for byte, (beta1, kt1) in one.items()}


# --- plan -----------------------------------------------------------------------------


def score_documents(docs: DataFrame, depth: int = 5, blocks: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Documents with crc32(doc_id as text) mod 7 = 2 are held out of training (a null id counts
    as the empty text).  ``score`` is the log10 probability of the whole text under the trees,
    ``base_score`` that of its words and one end under smoothed word counts.  A null text is
    empty and has the end only.  Without training documents every bit has probability 1/2.
    ``bits_per_byte`` is the code length of the lower-cased bytes and the closing zero byte,
    over their number; probabilities travel as float32.  Rows that repeat an id or a text are
    documents of their own, and an empty table gives no rows.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth must be from 2 to 7")
    n = blocks or rounds.block_count(docs, text)
    dealt = rounds.in_blocks(docs, n, doc_id, text)

    def ask(table: pa.Table, mail: rounds.Mail) -> None:
        t = Texts(table, depth)
        keys, ends = t.grams()
        keys, counts = _tally(dealt_key(keys, depth), np.repeat(~t.held_out, np.diff(ends)))
        mail.send(GRAMS, keys, n, lambda lo, hi: rounds.planes(counts[lo:hi]))
        words, sizes = t.tokens()
        rows = len(sizes)
        words, train = np.append(words, np.full(rows, mix(np.array([END]))[0])), np.append(np.repeat(~t.held_out, sizes), ~t.held_out)
        keys, counts = _tally(words, train)
        part = rounds.Mail(mail.block)
        part.send(TOKENS, keys, n, lambda lo, hi, c=counts: rounds.planes(c[lo:hi]))
        mail.rows += [(b, n + s, *rest) for b, s, *rest in part.rows]

    def merged(table: pa.Table):
        parts = [rounds.unpack_sorted(k) for k in table.column("_a").to_pylist()]
        counts = np.concatenate([rounds.unplanes(c, np.uint32) for c in table.column("_b").to_pylist()]).astype(np.int64)
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")
        starts, run = rounds.runs_of(every[order])
        return [len(p) for p in parts], order, run, every[order][starts], np.add.reduceat(counts[order], starts)

    def totals(key, table):
        _, _, _, keys, counts = merged(table)
        shard = key[0].as_py()
        if shard >= n:
            return _rows([-1], [shard], [int((counts > 0).sum())], [int(counts.sum())])
        grams = gram_of(keys, depth)
        near, second = (grams >> np.uint64(8 * depth)).astype(np.int32), ((grams >> np.uint64(8 * depth - 8)) & np.uint64(255)).astype(np.int32)
        return _rows(near * SPREAD + second % SPREAD, np.full(len(keys), shard), grams.view(np.int64), counts)

    def subtrees(key, table):
        """What the levels above need of a group of subtrees, or the sums of the token counts."""
        group = key[0].as_py()
        if group < 0:
            blob = np.array([sum(table.column("_key").to_pylist()), sum(table.column("_n").to_pylist())], np.int64).tobytes()
        else:
            trees, sums = _grown(table, depth)[0], np.zeros((3, 256))
            for k in range(8):
                names, n0, n1, _ = trees.nodes[2, k]
                node = (1 << k) | (names & np.uint64((1 << k) - 1)).astype(np.int64)
                for i, v in enumerate((trees.weighted[k][1], n0, n1)):
                    sums[i] += np.bincount(node, v, 256)
            blob = sums.tobytes()
        return pa.table({"_cs": pa.array([group], pa.int32()), "_blob": pa.array([blob], pa.binary())})

    def crown(table):
        """At most 256 x SPREAD small rows: the top levels for every group."""
        groups, blobs = table.column("_cs").to_pylist(), table.column("_blob").to_pylist()
        tops = _top_levels([(g // SPREAD, np.frombuffer(b).reshape(3, 256)) for g, b in zip(groups, blobs) if g >= 0])
        out = [b if g < 0 else tops[g // SPREAD].tobytes() for g, b in zip(groups, blobs)]
        return pa.table({"_cs": pa.array(groups, pa.int32()), "_blob": pa.array(out, pa.binary())})

    def predictions(key, table, top):
        blob = top.column("_blob")[0].as_py()
        if key[0].as_py() < 0:
            distinct, total = np.frombuffer(blob, np.int64)
            return _model(range(n, 2 * n), [distinct] * n, [float(total)] * n)
        trees, order = _grown(table, depth)
        logs = trees.log10_probabilities(*np.frombuffer(blob).reshape(4, 256))
        return _model(table.column("_shard").to_numpy()[order], trees.keys.view(np.int64), logs)

    def reply(key, table, model):
        lengths, order, run, keys, counts = merged(table)
        shard, out = key[0].as_py(), rounds.Mail(0)
        if shard >= n:
            values, note = counts, model.column("_key")[0].as_py().to_bytes(8, "little") + int(model.column("_p")[0].as_py()).to_bytes(8, "little")
        else:
            known = dealt_key(model.column("_key").to_numpy().view(np.uint64), depth)
            values, note = model.column("_p").to_numpy()[np.argsort(known)].astype(np.float32), b""
        answers = np.empty(len(order), values.dtype)
        answers[order] = values[run]
        for block, part in zip(table.column("_block").to_pylist(), rounds.split_like(answers, lengths)):
            out.add(shard, TOKENS if shard >= n else GRAMS, part, note, block=block)
        return out.table()

    def finish(table: pa.Table, got: pa.Table) -> pa.Table:
        t = Texts(table, depth)
        keys, ends = t.grams()
        keys = dealt_key(keys, depth)
        every = np.sort(keys)
        every = every[rounds.runs_of(every)[0]]
        logs = looked_up(every, rounds.answered(got, GRAMS, np.float32).astype(np.float64), keys, 56 - 8 * depth)
        score = np.add.reduceat(logs, ends[:-1])
        del keys, every, logs
        words, sizes = t.tokens()
        end = mix(np.array([END]))
        every = np.unique(np.append(words, end))
        counts = rounds.answered(got, TOKENS, np.int64)
        note = rounds.answers(got, TOKENS)[0][1]
        distinct, total = int.from_bytes(note[:8], "little"), int.from_bytes(note[8:], "little")
        own = counts[np.searchsorted(every, words)]
        ended = counts[np.searchsorted(every, end)[0]]
        row = np.repeat(np.arange(len(sizes)), sizes)
        n_tokens = sizes + 1
        base = np.bincount(row, np.log10(own + 1.0), len(sizes)) + math.log10(ended + 1.0) - n_tokens * math.log10(total + distinct + 1.0)
        known = np.bincount(row, own > 0, len(sizes)).astype(np.int64) + int(ended > 0)
        return pa.table({
            "doc_id": t.ids, "held_out": pa.array(t.held_out), "n_tokens": pa.array(n_tokens.astype(np.int64)), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(len(sizes), total, np.int64)), "base_score": pa.array(base), "score": pa.array(score),
            "bits_per_byte": pa.array(-score * math.log2(10) / np.diff(ends)),
        })

    mail = rounds.first_round(dealt, ask)
    counted = mail.groupBy("_shard").applyInArrow(totals, "_cs int, _shard int, _key long, _n long")
    parts = counted.groupBy("_cs").applyInArrow(subtrees, "_cs int, _blob binary")
    tops = parts.groupBy(F.lit(0).alias("_all")).applyInArrow(crown, "_cs int, _blob binary")
    model = counted.groupBy("_cs").cogroup(tops.groupBy("_cs")).applyInArrow(predictions, "_shard int, _key long, _p double")
    replies = mail.groupBy("_shard").cogroup(model.groupBy("_shard")).applyInArrow(reply, rounds.MAIL)
    return rounds.last_step(dealt, replies, finish, RESULT)


def _rows(groups, shards, keys, counts) -> pa.Table:
    return pa.table({"_cs": pa.array(groups, pa.int32()), "_shard": pa.array(shards, pa.int32()), "_key": pa.array(keys, pa.int64()), "_n": pa.array(counts, pa.int64())})


def _model(shards, keys, logs) -> pa.Table:
    return pa.table({"_shard": pa.array(shards, pa.int32()), "_key": pa.array(keys, pa.int64()), "_p": pa.array(logs, pa.float64())})


def _grown(table: pa.Table, depth: int) -> tuple[Trees, np.ndarray]:
    keys = table.column("_key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return Trees(keys[order], table.column("_n").to_numpy()[order], depth, 2), order
