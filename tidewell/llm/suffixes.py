"""Suffix deduplication with a difference cover, one bucket of suffixes at a time.

A suffix matters only up to ``length`` bytes: a position is repeated if its first ``length``
bytes start elsewhere too.  Sorting all positions would move many times the text, so a
difference cover does most of the work.  The cover is a set of residues modulo 73 such that
for any two positions some step below 73 takes both onto it.

1. Sample: the strings of ``length - 72`` bytes at cover positions are ranked.  Two equal
   suffixes have, within 72 steps, two equal sample strings, so a position without a tied
   sample ahead is unique and needs no sorting.
2. Long ties: strings of ``length + 72`` bytes at tied cover positions are ranked.  If one is
   tied again, all 73 suffixes that start along it are repeated; stretches of long matches
   are resolved from the cover alone.
3. The suffixes left, around the ends of matches, are dealt into buckets and sorted by their
   first ``length`` bytes, one bucket at a time.  Each long tie also puts the suffixes along
   one of its members into the buckets, since a suffix left may equal one of those.

Ranks and buckets go by hash, since only ties matter, not order; where it decides, the hash is
as wide as the corpus asks (see ``rounds.key_widths``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm import rounds
from tidewell.llm.text import VALUES, Roller, arrow_bytes, pieces

MODULUS = 73
#: The powers of 2 modulo 73: every difference occurs exactly once.
COVER = sorted({pow(2, k, MODULUS) for k in range(9)})
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cover_positions(most: int) -> np.ndarray:
    turns = np.arange(0, most + MODULUS, MODULUS)
    return (turns[:, None] + np.array(COVER)).reshape(-1)


def per_row(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and number within the row, for rows of the given lengths."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


class Suffixes:
    """The texts of a block as bytes, worked on in pieces of whole documents."""

    def __init__(self, table: pa.Table, length: int, bits: int, widths: tuple[int, type]):
        self.bits, self.widths = bits, widths
        self.data, self.offsets = arrow_bytes(table.column("_text"))
        self.length = length
        self.parts = list(pieces(self.offsets, 1 << 19))
        self.rollers = [Roller(0), Roller(1)]

    def cover(self, size: int):
        """Per piece: cover positions, in the block, at which ``size`` bytes of a document follow."""
        lengths = np.diff(self.offsets)
        positions = cover_positions(int(lengths.max(initial=0)))
        for lo, hi in self.parts:
            counts = np.searchsorted(positions, lengths[lo:hi] - size, "right")
            row, nth = per_row(counts)
            yield lo, hi, positions[nth] + self.offsets[lo:hi][row]

    def hashes(self, lo: int, hi: int, at: np.ndarray, size: int, both: bool):
        data, base = self.data[self.offsets[lo] : self.offsets[hi]], self.offsets[lo]
        out = []
        for which in range(1 + both):
            roller = self.rollers[which]
            prefix = roller.prefix(VALUES[which][data])
            out.append(roller.slices(prefix, at - base, at - base + size))
        return out

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        size = self.length - MODULUS + 1
        got = [(at, self.hashes(lo, hi, at, size, False)[0]) for lo, hi, at in self.cover(size)]
        at, h = _joined(got, (np.int64, np.uint64))
        return at, (h >> np.uint64(64 - self.bits)) << np.uint64(64 - self.bits)

    def keys(self, at: np.ndarray, size: int):
        """Two hashes of the ``size`` bytes from each of the sorted positions."""
        got = []
        for lo, hi in self.parts:
            a, b = np.searchsorted(at, (self.offsets[lo], self.offsets[hi]))
            if b > a:
                h1, h2 = self.hashes(lo, hi, at[a:b], size, True)
                got.append(rounds.narrowed(h1, h2, self.widths))
        return _joined(got, (np.uint64, self.widths[1]))

    def spread(self, at: np.ndarray, before: int, after: int) -> np.ndarray:
        """Mask of the bytes from ``before`` ahead of each position to ``after`` behind it."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, at - before, 1)
        np.add.at(edge, at + after, -1)
        return np.cumsum(edge, dtype=np.int32)[:-1] > 0


def _joined(parts, kinds):
    return tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds))


class Asked:
    """Keys of one round: what is sent, and how the answers go back to the positions."""

    def __init__(self, s: Suffixes, at: np.ndarray, size: int):
        self.at = at
        h1, h2 = s.keys(at, size)
        self.order, self.starts, self.run = rounds.distinct(h1, h2)
        one = self.order[self.starts]
        self.h1, self.h2 = h1[one], h2[one]
        self.here = np.diff(np.append(self.starts, len(h1))) > 1

    def send(self, mail: rounds.Mail, round_: int, shards: int) -> None:
        mail.send(round_, self.h1, shards, lambda lo, hi: rounds.planes(self.h2[lo:hi]))

    def repeated(self, got: pa.Table, round_: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose string starts elsewhere, in this block or another; and one position
        of every such string that no smaller block has."""
        code = rounds.answered(got, round_, np.uint8)
        mask = np.empty(len(self.at), bool)
        mask[self.order] = ((code != rounds.ALONE) | self.here)[self.run]
        owned = (code == rounds.OWNER) | ((code == rounds.ALONE) & self.here)
        return self.at[mask], self.at[self.order[self.starts[owned]]]


def _stretches(s: Suffixes, got: pa.Table) -> tuple[np.ndarray, Asked]:
    """Tied sample positions, and the long strings that start at them."""
    at, h = s.sample()
    _, place = np.unique(h, return_inverse=True)
    tied = at[rounds.answered(got, 1, np.uint8)[place] >= 2] if len(at) else at
    size = s.length + MODULUS - 1
    doc_end = s.offsets[np.searchsorted(s.offsets, tied, "right")] if len(tied) else tied
    return tied, Asked(s, tied[tied + size <= doc_end], size)


def _ends(s: Suffixes, got: pa.Table) -> tuple[np.ndarray, np.ndarray, Asked]:
    """Suffixes that long ties show to be repeated, those that do not, and all to be sorted."""
    tied, long = _stretches(s, got)
    starts, owned = long.repeated(got, 2)
    done, shown = s.spread(starts, 0, MODULUS), s.spread(owned, 0, MODULUS)
    maybe = np.zeros(len(s.data) + 1, np.int32)
    if len(tied):
        doc = np.searchsorted(s.offsets, tied, "right") - 1
        np.add.at(maybe, np.maximum(tied - MODULUS + 1, s.offsets[doc]), 1)
        np.add.at(maybe, tied + 1, -1)
    left = (np.cumsum(maybe, dtype=np.int32)[:-1] > 0) & ~done
    for lo, hi in zip(s.offsets[:-1], s.offsets[1:]):
        left[max(lo, hi - s.length + 1) : hi] = False
    return done, left, Asked(s, np.flatnonzero(left | shown), s.length)


def dedup_suffixes(docs: DataFrame, length: int = 200, blocks: int | None = None, texts: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (with ``texts`` also kept, its bytes).

    A byte goes if it lies in a string of ``length`` bytes of its text (UTF-8) that starts
    anywhere else too, in any document.  A null text is empty and a text shorter than
    ``length`` stays whole.  Repeated rows are each other's copies.  ``length`` is at least 137.
    """
    if length < MODULUS + 64:
        raise ValueError("length must be at least 137")
    n = blocks or rounds.block_count(docs, text)
    dealt = rounds.in_blocks(docs, n, doc_id, text)
    # the sample only proposes, so its ranks need few bits: a chance tie in some thousand
    bits = min(64, (n * rounds.BLOCK_BYTES // 8).bit_length() + 12)
    widths = rounds.key_widths(n * rounds.BLOCK_BYTES)
    merge = rounds.merge_shared if widths[1] is np.uint16 else rounds.merge_shared_wide

    def sample(table, mail):
        _, h = Suffixes(table, length, bits, widths).sample()
        keys, counts = np.unique(h, return_counts=True)
        mail.send(1, keys, n, lambda lo, hi: rounds.planes(counts[lo:hi].astype(np.uint32)))

    def long_ties(table, got, mail):
        _stretches(Suffixes(table, length, bits, widths), got)[1].send(mail, 2, n)

    def ends(table, got, mail):
        _ends(Suffixes(table, length, bits, widths), got)[2].send(mail, 3, n)

    def finish(table: pa.Table, got: pa.Table) -> pa.Table:
        s = Suffixes(table, length, bits, widths)
        done, left, asked = _ends(s, got)
        found = asked.repeated(got, 3)[0]
        gone = s.spread(np.concatenate([np.flatnonzero(done), found[left[found]]]), 0, length)
        sizes, removed, spans, shas, kept = np.diff(s.offsets), [], [], [], []
        for lo, hi in zip(s.offsets[:-1], s.offsets[1:]):
            mask = gone[lo:hi]
            rest = s.data[lo:hi][~mask].tobytes() if mask.any() else s.data[lo:hi].tobytes()
            removed.append(int(mask.sum()))
            spans.append(int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum()))
            shas.append(hashlib.sha256(rest).hexdigest())
            if texts:
                kept.append(rest)
        columns = {"doc_id": table.column("_id"), "n_bytes": pa.array(sizes.astype(np.int64)), "n_removed": pa.array(removed, pa.int64()),
                   "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
        return pa.table(columns | ({"kept": pa.array(kept, pa.binary())} if texts else {}))

    first = rounds.answer(rounds.first_round(dealt, sample), rounds.merge_levels)
    second = rounds.answer(rounds.next_round(dealt, first, long_ties, n), merge)
    third = rounds.answer(rounds.next_round(dealt, second, ends, n), merge)
    return rounds.last_step(dealt, third, finish, RESULT + (", kept binary" if texts else ""))
