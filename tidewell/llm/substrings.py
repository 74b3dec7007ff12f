"""Substring deduplication over word windows, with a count-min prefilter.

First pass: every block counts its windows in a sketch, a few rows of cells addressed by
hash.  The blocks' sketches are merged cell by cell, each range of cells by its own task, so
the sketch may be as wide as the corpus asks for; only cells in use travel.  A window's
estimate is the least of its cells and never below the true count.  Second pass: windows
estimated repeated, and only these, are grouped exactly (by a hash as wide as the corpus
asks, see ``rounds.key_widths``) to find the earliest start of each.  A window that is not the earliest removes its words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm import rounds
from tidewell.llm.text import VALUES, Roller, arrow_bytes, mix, pieces, word_bounds

NO_ID = (1 << 63) - 1
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def in_order(ids: np.ndarray, texts) -> np.ndarray:
    """Rows by id; rows that repeat one by their text, so the order in which they came does not matter."""
    order = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.diff(ids[order], prepend=ids[order[0]] - 1 if len(ids) else 0))
    for a, b in zip(starts, np.append(starts[1:], len(order))):
        if b - a > 1:
            own = order[a:b]
            known = texts.take(pa.array(own)).to_pylist()
            order[a:b] = own[sorted(range(b - a), key=known.__getitem__)]
    return order


class Windows:
    """The word windows of a block, documents in order of their id."""

    def __init__(self, table: pa.Table, width: int, widths: tuple[int, type]):
        ids = table.column("_id").to_numpy(zero_copy_only=False) if table.column("_id").null_count == 0 else np.array([NO_ID if x is None else x for x in table.column("_id").to_pylist()], np.int64)
        self.order = in_order(ids, table.column("_text"))
        table = table.take(pa.array(self.order))
        self.table, self.width = table, width
        self.ids = ids[self.order].astype(np.int64)
        self.data, self.offsets = arrow_bytes(table.column("_text"))
        one, two = Roller(0), Roller(1)
        h1, h2, starts, ends, firsts, docs, places, base = [], [], [], [], [], [], [], 0
        for lo, hi in pieces(self.offsets):
            offsets = self.offsets[lo : hi + 1] - self.offsets[lo]
            data = self.data[self.offsets[lo] : self.offsets[hi]]
            begin, end, first = word_bounds(data, offsets)
            hashes = []
            for which, roller in ((0, one), (1, two)):
                words = roller.slices(roller.prefix(VALUES[which][data]), begin, end)
                hashes.append(roller.prefix(words))
            counts = np.diff(first)
            whole = np.maximum(counts - width + 1, 0)
            doc = np.repeat(np.arange(hi - lo), whole)
            at = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole) + first[:-1][doc]
            h1.append(one.slices(hashes[0], at, at + width))
            h2.append(two.slices(hashes[1], at, at + width))
            places.append(at + base)
            docs.append(doc + lo)
            starts.append(begin + self.offsets[lo])
            ends.append(end + self.offsets[lo])
            firsts.append(first[:-1] + base)
            base += len(begin)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.h1, self.h2 = rounds.narrowed(join(h1, np.uint64), join(h2, np.uint64), widths)
        self.place, self.doc = join(places, np.int64), join(docs, np.int64)
        self.word_start, self.word_end = join(starts, np.int64), join(ends, np.int64)
        self.first = np.append(join(firsts, np.int64), base).astype(np.int64)

    def distinct(self):
        """Sorted distinct windows: their order, the start of each one's run, the run of each place."""
        return rounds.distinct(self.h1, self.h2)


def _cells(h1: np.ndarray, h2: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cell of each window in a row of the sketch, in the top bits of a 64-bit number."""
    h = mix(h1 + h2.astype(np.uint64) * np.uint64(2 * row + 1))
    return (h >> np.uint64(64 - bits)) << np.uint64(64 - bits)


def _sketch(w: Windows, order, starts, depth: int, bits: int):
    """For each row: sorted cells in use, their counts, and the cell of each distinct window."""
    own = np.diff(np.append(starts, len(order))).astype(np.uint32)
    one = order[starts]
    for row in range(depth):
        cells = _cells(w.h1[one], w.h2[one], row, bits)
        used, place = np.unique(cells, return_inverse=True)
        yield used, np.bincount(place, own, len(used)).astype(np.uint32), place


def _estimated_repeated(w: Windows, order, starts, got: pa.Table, depth: int, bits: int) -> np.ndarray:
    """Of the distinct windows, those whose merged estimate is two or more."""
    levels = rounds.answered(got, 1, np.uint8)
    sure, at = np.ones(len(starts), bool), 0
    # answers come by shard, and shards count through the rows of the sketch
    for used, _, place in _sketch(w, order, starts, depth, bits):
        sure &= levels[at : at + len(used)][place] >= 2
        at += len(used)
    return sure


def removed_windows(docs: DataFrame, width: int = 20, depth: int = 2, slack_bits: int = 4, blocks: int | None = None,
                    doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, int, tuple[int, type]]:
    """Blocks, the shards' answers after both passes, the bits of a sketch cell, the widths of a key."""
    n = blocks or rounds.block_count(docs, text)
    dealt = rounds.in_blocks(docs, n, doc_id, text)
    # a word takes some six bytes: 2^slack_bits cells a window in each row
    widths = rounds.key_widths(n * rounds.BLOCK_BYTES // 6)
    bits = min(60, max(10, int(n * rounds.BLOCK_BYTES // 6).bit_length() + slack_bits))

    def count(table, mail):
        w = Windows(table, width, widths)
        order, starts, _ = w.distinct()
        for row, (used, counts, _) in enumerate(_sketch(w, order, starts, depth, bits)):
            part = rounds.Mail(mail.block)
            part.send(1, used, n, lambda lo, hi, c=counts: rounds.planes(c[lo:hi]))
            mail.rows += [(b, row * n + s, *rest) for b, s, *rest in part.rows]

    def group(table, got, mail):
        w = Windows(table, width, widths)
        order, starts, _ = w.distinct()
        ask = starts[_estimated_repeated(w, order, starts, got, depth, bits)]
        one = order[ask]
        mail.send(2, w.h1[one], n, lambda lo, hi: rounds.planes(w.h2[one[lo:hi]]), lambda lo, hi: rounds.planes(w.ids[w.doc[one[lo:hi]]]))

    def earliest(keys, seconds, owners):
        parts = [rounds.unpack_sorted(k) for k in keys]
        lengths = [len(p) for p in parts]
        h1 = np.concatenate(parts)
        h2 = np.concatenate([rounds.unplanes(s, widths[1]) for s in seconds])
        ids = np.concatenate([rounds.unplanes(o, np.int64) for o in owners])
        order = np.lexsort((ids, h2, h1))
        a, b = h1[order], h2[order]
        later = np.zeros(len(a), bool)
        later[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        out = np.zeros(len(a), np.uint8)
        out[order] = later
        return rounds.split_like(out, lengths)

    estimates = rounds.answer(rounds.first_round(dealt, count), rounds.merge_levels)
    return dealt, rounds.answer(rounds.next_round(dealt, estimates, group, n), earliest), bits, widths


def dedup_substrings(docs: DataFrame, width: int = 20, depth: int = 2, slack_bits: int = 4, blocks: int | None = None, texts: bool = False,
                     doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (with ``texts`` also kept_text).

    A word goes if a window of ``width`` words covers it whose sequence starts earlier, in a
    smaller doc_id or before in the same document.  A null text has no words; a text shorter
    than the window loses none.  Rows that repeat an id are
    ordered by their text.  Rows without id count as last, among themselves by the hash block
    of their text and then by text.  Kept words are joined by one space.  An empty table gives
    no rows; a block of documents meets in one task, a longer text alone.
    """
    dealt, replies, bits, widths = removed_windows(docs, width, depth, slack_bits, blocks, doc_id, text)

    def finish(table: pa.Table, got: pa.Table) -> pa.Table:
        w = Windows(table, width, widths)
        order, starts, run = w.distinct()
        later = np.zeros(len(starts), bool)
        asked = np.flatnonzero(_estimated_repeated(w, order, starts, got, depth, bits))
        later[asked] = rounds.answered(got, 2, np.uint8).astype(bool)
        bad = np.ones(len(order), bool)
        bad[starts] = later
        gone = np.zeros(len(order), bool)
        gone[order] = bad | later[run]
        edge = np.zeros(len(w.word_start) + 1, np.int64)
        np.add.at(edge, w.place[gone], 1)
        np.add.at(edge, w.place[gone] + width, -1)
        keep = np.cumsum(edge)[:-1] == 0
        data, words, removed, shas, kept = w.data.tobytes(), [], [], [], []
        for d in range(len(w.ids)):
            lo, hi = int(w.first[d]), int(w.first[d + 1])
            stay = np.flatnonzero(keep[lo:hi]) + lo
            out = b" ".join([data[s:e] for s, e in zip(w.word_start[stay].tolist(), w.word_end[stay].tolist())])
            words.append(hi - lo)
            removed.append(hi - lo - len(stay))
            shas.append(hashlib.sha256(out).hexdigest())
            if texts:
                kept.append(out.decode())
        columns = {"doc_id": w.table.column("_id"), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
        return pa.table(columns | ({"kept_text": pa.array(kept, pa.string())} if texts else {}))

    return rounds.last_step(dealt, replies, finish, RESULT + (", kept_text string" if texts else ""))
