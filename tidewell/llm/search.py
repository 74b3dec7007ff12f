"""Ranked lexical search for many items at once, with shared term sets evaluated once.

Items that share terms share their partial sums.  Per batch of items a query-sharing DAG is
mined: terms with the same list of items become one leaf, then the two nodes that most items
have in common become a node of their own, again and again while two items share a pair.  A
document's terms give its leaf accumulators, each inner node adds two others, and an item's
score is the sum of what is left of its list.  All of that is exact integer arithmetic.

Documents are read once per batch of items: the counts of the batch's terms are written as
compact lists, from which come document frequencies and then scores, block of documents by
block.  A task keeps the best of its documents per item and passes on only those.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.text import VALUES, Roller, arrow_bytes, whole
from tidewell.session import scratch_path

#: Runs of ASCII letters and digits and of all other characters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms, counted per item, that make a batch of items; what is broadcast has that bound, or
#: that of one item if it alone has more.
BATCH_TERMS = 1 << 16
#: Neighbours of a node, in an item's list by frequency, that mining pairs it with.
NEAR = 32
#: Bytes read at once, and cells of the accumulators of a block of documents.
STEP, CELLS = 1 << 20, 1 << 22
#: Parts in which an item's best documents are ranked before the last ranking.
PARTS = 32

_IS_TERM = np.zeros(256, bool)
_IS_TERM[128:] = True
_IS_TERM[[ord(c) for c in UPPER + LOWER + "0123456789"]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]


# --- terms -----------------------------------------------------------------------------


def term_hashes(data: np.ndarray, edges: np.ndarray):
    """Start and two hashes of every term; ``edges`` are the places where rows begin."""
    solid = np.concatenate([_IS_TERM[data], [False]])
    before = np.concatenate([[False], solid[:-1]])
    cut = np.zeros(len(solid), bool)
    cut[edges] = True
    starts = np.flatnonzero(solid & (~before | cut))
    ends = np.flatnonzero(before & (~solid | cut))
    low = _LOW[data]
    hashes = [r.slices(r.prefix(VALUES[i][low]), starts, ends) for i, r in ((0, Roller(0)), (1, Roller(1)))]
    return starts, hashes[0], hashes[1]


def stretches(data: np.ndarray, offsets: np.ndarray, step: int = STEP):
    """Byte ranges of about ``step`` that cut no term of a row."""
    lo = 0
    while lo < len(data):
        hi = min(lo + step, len(data))
        row_end = int(offsets[np.searchsorted(offsets, hi)])
        while hi < row_end:
            stop = np.flatnonzero(~_IS_TERM[data[hi : min(hi + step, row_end)]])
            if len(stop):
                hi += int(stop[0])
                break
            hi = min(hi + step, row_end)
        yield lo, hi
        lo = hi


def counted_terms(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, which: np.ndarray):
    """Terms per row, and (row, term, count) of the terms of a vocabulary, which is given by
    its sorted first hashes, their second ones and their numbers."""
    rows = len(offsets) - 1
    total = np.zeros(rows, np.int64)
    keys, width = [np.zeros(0, np.int64)], max(1, len(which))
    for lo, hi in stretches(data, offsets):
        inside = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")]
        starts, h1, h2 = term_hashes(data[lo:hi], inside - lo)
        row = np.searchsorted(offsets, starts + lo, "right") - 1
        total += np.bincount(row, minlength=rows)
        if len(first):
            at = np.minimum(np.searchsorted(first, h1), len(first) - 1)
            hit = (first[at] == h1) & (second[at] == h2)
            keys.append(row[hit] * width + which[at[hit]])
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return total, key // width, key % width, count


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, term): distinct terms of every item, JVM-side."""
    terms = F.transform(F.regexp_extract_all(whole(text), F.lit(TERM), F.lit(0)), lambda t: F.translate(t, UPPER, LOWER))
    return items.select(F.col(item_id).alias("item_id"), F.explode(terms).alias("term")).distinct()


# --- the query-sharing DAG --------------------------------------------------------------


def shared_plan(lists: list[np.ndarray], n_terms: int):
    """Plan of a batch: leaf of every term, pairs (left, right) of the inner nodes in order of
    evaluation with the size of each level, and the nodes that are left of every item."""
    owners: list[list[int]] = [[] for _ in range(n_terms)]
    for i, terms in enumerate(lists):
        for t in terms:
            owners[t].append(i)
    leaf_of: dict[tuple, int] = {}
    leaf = np.array([leaf_of.setdefault(tuple(o), len(leaf_of)) for o in owners], np.int32)
    count = np.array([len(o) for o in leaf_of], np.int64)
    nodes = [np.unique(leaf[terms]) for terms in lists]
    left, right, levels = [], [], []
    while True:
        pairs = []
        for own in nodes:
            own = own[count[own] > 1]
            own = own[np.lexsort((own, -count[own]))]
            for d in range(1, min(NEAR, len(own) - 1) + 1):
                pairs.append(np.column_stack([np.minimum(own[:-d], own[d:]), np.maximum(own[:-d], own[d:])]))
        if not pairs:
            break
        key, times = np.unique(np.concatenate(pairs).astype(np.int64) @ np.array([1 << 31, 1]), return_counts=True)
        order = np.lexsort((key, -times))
        order = order[times[order] > 1]
        taken, made = {}, 0
        for k in key[order].tolist():
            a, b = k >> 31, k & ((1 << 31) - 1)
            if a not in taken and b not in taken:
                taken[a] = taken[b] = (a, b, len(count) + made)
                left.append(a)
                right.append(b)
                made += 1
        if not made:
            break
        levels.append(made)
        count = np.concatenate([count, np.zeros(made, np.int64)])
        for i, own in enumerate(nodes):
            have, new = set(own.tolist()), []
            for a, b, node in {taken[x] for x in have if x in taken}:
                if a in have and b in have:
                    have -= {a, b}
                    new.append(node)
            count[new] += 1
            nodes[i] = np.array(sorted(have) + sorted(new), np.int64)
    return leaf, np.array(left, np.int32), np.array(right, np.int32), np.array(levels, np.int32), nodes


_PLAN = "batch int, terms array<string>, leaf array<int>, left array<int>, right array<int>, levels array<int>, sizes array<int>, edges array<int>"


def _plans(listed: DataFrame) -> DataFrame:
    """One plan per batch of items; a batch is one group of bounded size."""

    def mine(key, table):
        terms, code = np.unique(np.array(table.column("term").to_pylist(), object), return_inverse=True)
        nth = table.column("nth").to_numpy()
        lists = [code[nth == i] for i in range(int(nth.max()) + 1)]
        leaf, left, right, levels, nodes = shared_plan(lists, len(terms))
        row = {"terms": terms.tolist(), "leaf": leaf, "left": left, "right": right, "levels": levels, "sizes": [len(n) for n in nodes], "edges": np.concatenate(nodes)}
        held = {k: pa.array([list(v)], pa.list_(pa.string() if k == "terms" else pa.int32())) for k, v in row.items()}
        return pa.table({"batch": pa.array([key[0].as_py()], pa.int32())} | held)

    return listed.groupBy("batch").applyInArrow(mine, _PLAN)


def evaluate(plan: dict, contribution: np.ndarray, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
    """Scores of all items for a block of documents: leaves, inner nodes level by level, items."""
    n_leaves, inner = plan["n_leaves"], len(plan["left"])
    acc = np.zeros((n_leaves + inner, rows), np.int64)
    np.add.at(acc.reshape(-1), plan["leaf"][term].astype(np.int64) * rows + row, contribution)
    at = 0
    for size in plan["levels"]:
        some = slice(at, at + size)
        acc[n_leaves + at : n_leaves + at + size] = acc[plan["left"][some]] + acc[plan["right"][some]]
        at += size
    return np.add.reduceat(acc[plan["edges"]], plan["starts"], axis=0)


class Best:
    """The k best documents of every item so far: higher score, then smaller id, null ids last."""

    def __init__(self, items: int, k: int):
        self.items, self.k = items, k
        self.item, self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.least, self.last = np.zeros(items, np.int64), np.full(items, np.iinfo(np.int64).min)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        better = scores > self.least[:, None]
        better |= (scores == self.least[:, None]) & (ids[None, :] < self.last[:, None]) & (scores > 0)
        item, col = np.nonzero(better)
        if not len(item):
            return
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[item, col]])
        id_, empty = np.concatenate([self.id, ids[col]]), np.concatenate([self.null, null[col]])
        order = np.lexsort((empty, id_, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order, item = order[place < self.k], item[place < self.k]
        self.item, self.score, self.id, self.null = item, score[order], id_[order], empty[order]
        full = np.flatnonzero(np.bincount(item, minlength=self.items) == self.k)
        end = np.searchsorted(item, full, "right") - 1
        self.least[full], self.last[full] = self.score[end], self.id[end]


# --- the operator ---------------------------------------------------------------------


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _narrow(values: np.ndarray) -> bytes:
    """In the narrowest integers that hold them all; the size per value tells which."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32).tobytes()


def _widened(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // n] if n else np.uint8).astype(np.int64)


def _counts(docs: DataFrame, vocabulary, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, k, terms, tfs): all terms of a document, and counts of the k that a vocabulary has."""

    def count(batches):
        first, second, which = vocabulary.value
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(1))
            total, row, term, tf = counted_terms(data, offsets, first, second, which)
            cuts = np.searchsorted(row, np.arange(len(offsets)))
            ranges = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n": pa.array(total), "k": pa.array(np.diff(cuts), pa.int32()),
                "terms": pa.array([_narrow(term[a:b]) for a, b in ranges], pa.binary()), "tfs": pa.array([_narrow(tf[a:b]) for a, b in ranges], pa.binary()),
            })

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("_text"))
    return _kept(rows.mapInArrow(count, "doc_id long, n long, k int, terms binary, tfs binary"), "counts")


def _frequencies(counts: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term of the batch; one number per term reaches the driver."""

    def add(batches):
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[_widened(raw, n)] += 1
        held = np.flatnonzero(total)
        if len(held):
            yield pa.RecordBatch.from_pydict({"term": pa.array(held, pa.int32()), "df": pa.array(total[held])})

    out = np.zeros(n_terms, np.int64)
    for term, df in counts.filter("k > 0").select("k", "terms").mapInArrow(add, "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return out


def _best_per_task(counts: DataFrame, shared, k: int) -> DataFrame:
    """(nth, doc_id, score): the best documents of each task for every item of the batch."""

    def score(batches):
        plan = shared.value
        found = Best(len(plan["starts"]), k)
        size = max(1, CELLS // max(plan["n_leaves"] + len(plan["left"]), len(plan["edges"])))
        for batch in batches:
            ids = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            n, held = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            terms, tfs = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for lo in range(0, len(n), size):
                hi = min(lo + size, len(n))
                row = np.repeat(np.arange(hi - lo), held[lo:hi])
                term = np.concatenate([_widened(t, c) for t, c in zip(terms[lo:hi], held[lo:hi].tolist())])
                tf = np.concatenate([_widened(t, c) for t, c in zip(tfs[lo:hi], held[lo:hi].tolist())])
                m = 50 + 50 * n[lo:hi] * plan["docs"] // max(1, plan["terms"])
                worth = plan["weight"][term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
                found.add(evaluate(plan, worth, row, term, hi - lo), ids[lo:hi], null[lo:hi])
        if len(found.item):
            yield pa.RecordBatch.from_pydict({"nth": pa.array(found.item, pa.int32()), "doc_id": pa.array(found.id, mask=found.null), "score": pa.array(found.score)})

    return counts.filter("k > 0").select("doc_id", "n", "k", "terms", "tfs").mapInArrow(score, "nth int, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for every item.

    Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.  With N
    documents that have a term, L terms in all, n in this document, tf occurrences and df
    documents of the term, it adds floor(1000 ln((2N+2)/(2df+1))) times 10^9 tf div (1000 tf +
    20 m), where m = 50 + 50 n N div L.  An item's terms count once each.

    Equal scores are ordered by doc_id, null ids last; rows that share a doc_id are documents
    of their own.  Rows that share an item id (or have none) are one item with all their terms.
    A null or empty text has no terms; an item without terms, or whose terms no document has,
    gives no rows, and neither does an empty table of either kind.  Texts of any length are
    read in stretches.  Other columns are ignored.
    """
    spark = docs.sparkSession
    pairs = _kept(item_terms(items, item_id, item_text), "items")
    named = "item_id " + pairs.schema["item_id"].dataType.simpleString()
    none = spark.createDataFrame([], f"{named}, rank int, doc_id long, score long")
    batches = -(-pairs.count() // BATCH_TERMS)
    if not batches:
        return none
    batch = F.pmod(F.xxhash64("item_id"), F.lit(batches)).cast("int")
    names = pairs.select("item_id").distinct().withColumn("batch", batch)
    names = _kept(names.withColumn("nth", F.row_number().over(W.partitionBy("batch").orderBy("item_id")) - 1), "names")
    known = pairs.join(names.withColumnRenamed("item_id", "_item"), F.col("item_id").eqNullSafe(F.col("_item")))
    plans = _kept(_plans(known.select("batch", "nth", "term")), "plans")
    out = none
    for b in range(batches):
        row = plans.filter(F.col("batch") == b).first()
        if row is None:
            continue
        raw, cuts = arrow_bytes(pa.array(row["terms"], pa.string()))
        _, h1, h2 = term_hashes(raw, cuts[:-1])
        order = np.argsort(h1)
        if (np.diff(h1[order]) == 0).any():
            raise ValueError("two terms share a hash")
        counts = _counts(docs, spark.sparkContext.broadcast((h1[order], h2[order], order.astype(np.int64))), doc_id, text)
        n_docs, n_terms = counts.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = _frequencies(counts, len(row["terms"]))
        leaf = np.array(row["leaf"], np.int32)
        plan = {
            "leaf": leaf, "n_leaves": int(leaf.max()) + 1, "left": np.array(row["left"], np.int64), "right": np.array(row["right"], np.int64), "levels": list(row["levels"]),
            "edges": np.array(row["edges"], np.int64), "starts": np.cumsum([0, *row["sizes"][:-1]]), "docs": n_docs, "terms": n_terms,
            "weight": np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64),
        }
        best = _best_per_task(counts, spark.sparkContext.broadcast(plan), k)
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        # an item's finds are ranked in parts first, so no task gets those of all tasks
        best = best.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)))
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("nth", "part").orderBy(*order))).filter(F.col("rank") <= k)
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("nth").orderBy(*order))).filter(F.col("rank") <= k)
        out = out.union(best.join(names.filter(F.col("batch") == b), "nth").select("item_id", "rank", "doc_id", "score"))
    return out
