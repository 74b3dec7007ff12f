"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is its set of five-word shingles, each weighted by its count in the document and
an inverse document frequency between 1 and 2.  Document frequencies are counted over all
documents in a fixed number of hashed slots, so the table has a known size.  Every sample of
a signature picks one shingle such that two documents agree with the probability of their
weighted Jaccard similarity.  Signatures are banded; documents that share a band are compared
with the smallest document there, first by their signatures, then by the exact weighted
Jaccard of their texts.  Classes are the connected components of what holds.  In a bucket that
still has several classes and more than a block of members outside its largest, these are
compared with another member of that one, drawn anew each turn, as long as a turn joins one in
twenty of that bucket's.  Then every pair that shares a bucket and is of two classes is compared
by signature, block by block, and by text where the signatures agree enough, so the classes are
those of all pairs that share a band.  That work grows with the members outside the largest
class times all members of the bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.rows import text_key
from tidewell.llm.suffixes import per_row
from tidewell.llm.text import VALUES, Roller, arrow_bytes, mix, pieces, whole, word_bounds
from tidewell.session import scratch_path

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
#: Slots of document frequencies: 2^20, one byte each when broadcast.
SLOT_BITS = 20
#: Share of equal samples below which a pair is not compared by text; a pair of similarity
#: 0.8 falls below with probability 1e-7.
LEAST_AGREEMENT = 0.5
#: Documents and bytes of text a block of a bucket holds on average; a task compares two blocks.
BLOCK_DOCS, BLOCK_BYTES = 256, 1 << 21

_draw = np.random.Generator(np.random.PCG64(5))
#: Quantised draws of the sampling scheme, picked by bits of a shingle's hash.
STEP = _draw.gamma(2.0, 1.0, 1 << 16)
LOG_LEVEL = np.log(_draw.gamma(2.0, 1.0, 1 << 16))
SEEDS = _draw.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle; a shorter text is one shingle, one without words has none."""
    roller = Roller(0)
    starts, ends, first = word_bounds(data, offsets)
    words = roller.prefix(roller.slices(roller.prefix(VALUES[0][data]), starts, ends))
    counts = np.diff(first)
    row, nth = per_row(np.where(counts >= width, counts - width + 1, np.minimum(counts, 1)))
    at = first[row] + nth
    return roller.slices(words, at, np.minimum(at + width, first[row + 1])), row


def weighted(h: np.ndarray, row: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every row with their TF-IDF weights, in order of row and hash."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(new)
    count = np.diff(np.append(starts, len(h)))
    h, row = h[starts], row[starts]
    return h, row, count * idf[h >> np.uint64(64 - SLOT_BITS)]


def samples(h: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """Signature of every row: one 32-bit sample per seed; all zero for a row without shingles."""
    out = np.zeros((rows, len(SEEDS)), np.uint32)
    if not len(h):
        return out
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    segment = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
    log_weight, first = np.log(weight), np.empty(len(starts), np.int64)
    for m, seed in enumerate(SEEDS):
        z = (h ^ seed) * np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(32)
        z *= np.uint64(0xD6E8FEB86659FD93)
        z ^= z >> np.uint64(29)
        r, level = STEP[z & np.uint64(0xFFFF)], LOG_LEVEL[(z >> np.uint64(16)) & np.uint64(0xFFFF)]
        offset = (z >> np.uint64(32)).astype(np.float64) * 2.0**-32
        t = np.floor(log_weight / r + offset)
        score = level - r * (t - offset + 1)
        hit = np.flatnonzero(score == np.minimum.reduceat(score, starts)[segment])
        first[segment[hit[::-1]]] = hit[::-1]
        picked = mix(h[first] + t[first].astype(np.int64).view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
        out[row[starts], m] = (picked >> np.uint64(32)).astype(np.uint32)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band."""
    keys = np.empty((len(signature), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(signature), b + 1, np.uint64)
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, b * ROWS + r])
        keys[:, b] = key
    return keys.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sorted shingle arrays with their weights."""
    total = a[1].sum() + b[1].sum()
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    return float(common / (total - common)) if total > common else 1.0


def block_overlaps(data: np.ndarray, offsets: np.ndarray, idf: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Weighted Jaccard of every text in ``left`` with every one in ``right`` (row numbers)."""
    h, row = shingles(data, offsets)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(new)
    # the k-th occurrence of a shingle is a feature of its own, so the smaller count is a product
    nth = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    weight = idf[h >> np.uint64(64 - SLOT_BITS)].astype(np.float64)
    total = np.bincount(row, weight, len(offsets) - 1)
    order = np.lexsort((nth, h))
    h, nth, row, weight = h[order], nth[order], row[order], weight[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (nth[1:] != nth[:-1])
    starts = np.flatnonzero(new)
    count = np.diff(np.append(starts, len(h)))
    several = np.repeat(count > 1, count)
    row, weight, col = row[several], weight[starts[count > 1]], np.repeat(np.arange((count > 1).sum()), count[count > 1])
    common, step = np.zeros((len(left), len(right))), 2048
    for at in range(0, len(weight), step):
        lo, hi = np.searchsorted(col, (at, at + step))
        has = np.zeros((len(offsets) - 1, len(weight[at : at + step])))
        has[row[lo:hi], col[lo:hi] - at] = 1
        common += (has[left] * weight[at : at + step]) @ has[right].T
    both = total[left][:, None] + total[right][None, :] - common
    return np.divide(common, both, out=np.ones_like(common), where=both > 0)


def inverse_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Weight of every slot: 2 for a shingle of one document, down to 1 for one of all.

    The table of 2^20 levels is all that reaches the driver, whatever the corpus.
    """
    parts = 16
    size = (1 << SLOT_BITS) // parts

    def count(batches):
        slots = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(0))
            for lo, hi in pieces(offsets):
                h, row = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                h, _, _ = weighted(h, row, np.ones(1 << SLOT_BITS))
                slots += np.bincount((h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(slots))
        for p in range(parts):
            part = slots[p * size : (p + 1) * size]
            if part.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "counts": pa.array([part.tobytes()], pa.binary())})

    def add(key, table):
        total = sum(np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist())
        level = np.frexp(total.astype(np.float64))[1].astype(np.uint8)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([level.tobytes()], pa.binary())})

    counted = docs.select(whole(text).alias("_text")).mapInArrow(count, "part int, counts binary")
    levels = np.ones((parts, size))
    for row in counted.groupBy("part").applyInArrow(add, "part int, levels binary").collect():
        levels[row["part"]] = np.maximum(np.frombuffer(row["levels"], np.uint8), 1)
    n = max(2, docs.count())
    return np.clip(2 - (levels.reshape(-1) - 1) / np.log2(n), 1, 2).astype(np.float32)


def signed(docs: DataFrame, idf, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, words, sig, bands): hash of the word sequence, signature, band keys (null without words)."""

    def sign(batches):
        table = idf.value
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(1))
            for lo, hi in pieces(offsets, 1 << 18):
                own = data[offsets[lo] : offsets[hi]]
                cuts = offsets[lo : hi + 1] - offsets[lo]
                h, row, weight = weighted(*shingles(own, cuts), table)
                signature = samples(h, row, weight, hi - lo)
                has = np.zeros(hi - lo, bool)
                has[row] = True
                raw, keys = own.tobytes(), bands(signature)
                texts = [b" ".join(raw[a:b].split()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(lo, hi - lo), "text_key": batch.column(2).slice(lo, hi - lo),
                    "words": pa.array([hashlib.sha256(t).digest()[:16] for t in texts], pa.binary()),
                    "sig": pa.array([s.tobytes() for s in signature], pa.binary()),
                    "bands": pa.array([k if w else None for k, w in zip(keys.tolist(), has)], pa.list_(pa.int64())),
                })

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("_text"), text_key(text).alias("text_key"))
    return rows.mapInArrow(sign, "doc_id long, text_key long, words binary, sig binary, bands array<long>")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def similar_pairs(pairs: DataFrame, signatures: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """Of the pairs (a, b), those whose texts have the wanted weighted Jaccard similarity."""

    def agree(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, len(SEEDS)) for i in (2, 3))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array((a == b).mean(1) >= LEAST_AGREEMENT))

    def compare(batches):
        table = idf.value
        for batch in batches:
            ok = []
            for at in range(0, batch.num_rows, 32):
                sides = []
                for i in (2, 3):
                    data, offsets = arrow_bytes(batch.column(i).slice(at, 32))
                    h, row, weight = weighted(*shingles(data, offsets), table)
                    cuts = np.searchsorted(row, np.arange(len(offsets)))
                    sides.append([(h[s:e], weight[s:e]) for s, e in zip(cuts[:-1], cuts[1:])])
                ok += [weighted_jaccard(x, y) >= SIMILARITY for x, y in zip(*sides)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def beside(df: DataFrame, rows: DataFrame, value: str) -> DataFrame:
        for side in ("a", "b"):
            df = df.join(rows.select(F.col("node").alias(side), F.col(value).alias(f"{value}_{side}")), side)
        return df.select("a", "b", f"{value}_a", f"{value}_b")

    close = _kept(beside(pairs, signatures, "sig").mapInArrow(agree, "a long, b long"), "pairs")
    return _kept(beside(close, texts, "text").mapInArrow(compare, "a long, b long").distinct(), "links")


def texts_of(docs: DataFrame, nodes: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, text, size): the text that stands for each node and its bytes."""
    keys = ["_none", "_id", "text_key"]
    wanted = nodes.select("node", F.col("rep").isNull().alias("_none"), F.coalesce("rep", F.lit(0)).alias("_id"), "text_key")
    id_ = F.col(doc_id).cast("long")
    body = docs.select(id_.isNull().alias("_none"), F.coalesce(id_, F.lit(0)).alias("_id"), text_key(text).alias("text_key"), whole(text).alias("text"))
    return body.join(wanted, keys).dropDuplicates(["node"]).select("node", "text", F.octet_length("text").alias("size"))


def bucket_pairs(members: DataFrame, signatures: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """(a, b) of all similar pairs that share a bucket and have two labels.

    ``members`` has band, node, label and main, the largest label of the bucket.  A bucket's
    members outside main and those of main are dealt into blocks by hash; every block of the
    former meets every block, so a task holds two blocks whatever the bucket.  They meet with
    their signatures first; texts follow for those members only that have a pair which agrees
    enough, and a pair is compared in the first band that it shares.
    """
    outside = F.col("label") != F.col("main")
    block = ["band", "p", "r"]

    def blocks(of):
        docs, size = F.sum(F.when(of, 1)), F.sum(F.when(of, F.col("size")))
        return F.ceil(F.greatest(docs / BLOCK_DOCS, size / BLOCK_BYTES)).cast("int")

    def agree(key, table):
        table = table.combine_chunks()
        band, p, r = (x.as_py() for x in key)
        own, ids, label = (table.column(c).to_numpy() for c in ("own", "node", "label"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(own), -1)
        here = np.argmax(bands(sig) == band, axis=1)
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == r)
        differ = label[left][:, None] != label[right][None, :]
        if p == r:
            differ &= left[:, None] < right[None, :]
        i, j = np.nonzero(differ)
        i, j = left[i], right[j]
        kept = [np.zeros(0, np.int64)]
        for at in range(0, len(i), 1 << 14):
            x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            same = sig[x] == sig[y]
            first = np.argmax(same.reshape(len(x), BANDS, ROWS).all(2), axis=1)
            kept.append(at + np.flatnonzero((same.mean(1) >= LEAST_AGREEMENT) & (first == here[x])))
        kept = np.concatenate(kept)
        used, place = np.unique(np.concatenate([i[kept], j[kept]]), return_inverse=True)
        a, b = np.split(place.astype(np.int32), 2)
        row = {"band": [band], "p": [p], "r": [r], "nodes": [ids[used].tolist()], "a": [a.tobytes()], "b": [b.tobytes()]}
        types = {"band": pa.int64(), "p": pa.int32(), "r": pa.int32(), "nodes": pa.list_(pa.int64()), "a": pa.binary(), "b": pa.binary()}
        out = pa.table({k: pa.array(v, types[k]) for k, v in row.items()})
        return out if len(kept) else out.slice(0, 0)

    def compare(key, pairs, table):
        table = table.combine_chunks()
        ids = table.column("node").to_numpy()
        a, b = (np.frombuffer(pairs.column(c)[0].as_py(), np.int32) for c in ("a", "b"))
        at = np.argsort(ids)
        place = at[np.searchsorted(ids[at], np.array(pairs.column("nodes")[0].as_py(), np.int64))]
        left, right = np.unique(a), np.unique(b)
        data, offsets = arrow_bytes(table.column("text").chunk(0))
        like = block_overlaps(data, offsets, idf.value, place[left], place[right])
        ok = like[np.searchsorted(left, a), np.searchsorted(right, b)] >= SIMILARITY
        x, y = ids[place[a[ok]]], ids[place[b[ok]]]
        return pa.table({"a": pa.array(np.minimum(x, y), pa.int64()), "b": pa.array(np.maximum(x, y), pa.int64())})

    sized = members.join(texts.select("node", "size"), "node")
    dealt = members.join(sized.groupBy("band").agg(blocks(outside).alias("n_out"), blocks(~outside).alias("n_main")), "band")
    place = F.xxhash64("node")
    own = F.when(outside, F.pmod(place, "n_out")).otherwise(F.col("n_out") + F.pmod(place, "n_main")).cast("int")
    met = F.sequence(F.lit(0), F.when(outside, F.col("n_out") + F.col("n_main")).otherwise(F.col("n_out")) - 1)
    rows = dealt.select("band", "node", "label", own.alias("own"), met.alias("met")).join(signatures, "node")
    rows = rows.select("band", "node", "label", "own", "sig", F.explode("met").alias("other"))
    rows = rows.select("band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("r"), "own", "node", "label", "sig")
    close = _kept(rows.groupBy(*block).applyInArrow(agree, "band long, p int, r int, nodes array<long>, a binary, b binary"), "close")
    named = [f"_{c}" for c in block]
    bodies = close.select(*[F.col(c).alias(n) for c, n in zip(block, named)], F.explode("nodes").alias("node")).join(texts.select("node", "text"), "node")
    links = close.groupBy(*block).cogroup(bodies.groupBy(*named)).applyInArrow(compare, "a long, b long")
    return _kept(links, "links")


def components(links: DataFrame) -> DataFrame:
    """(node, label): smallest node of each connected component, for nodes in links.

    Large-star and small-star steps by joins and grouped minima, until the edges stay as they
    are; each round is written to the shared folder.
    """
    def stars(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            out = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            low = edges.groupBy("a").agg(F.min("b").alias("m"))
            out = edges.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        return out.filter(F.col("a") != F.col("b")).distinct()

    def mark(edges: DataFrame):
        return edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()

    edges = _kept(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct(), "edges")
    seen = mark(edges)
    while True:
        edges = _kept(stars(stars(edges, True), False), "edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    below = edges.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    return below.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def representatives(rows: DataFrame) -> DataFrame:
    """(node, words, rep, text_key, sig, bands): one row per distinct word sequence.

    ``node`` is a number of its own, made from the words' hash alone; ``rep`` is the smallest
    doc_id with these words (null if none has one) and ``text_key`` tells which of its texts.
    """
    one = rows.groupBy("words").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("rep"), "text_key")).alias("_r"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    )
    # 56 bits of the hash, and a place among the words that share them
    prefix = F.shiftleft(F.conv(F.substring(F.hex("words"), 1, 14), 16, 10).cast("long"), 8)
    place = F.row_number().over(W.partitionBy("_prefix").orderBy("words")) - 1
    one = one.withColumn("_prefix", prefix).withColumn("_place", place)
    node = F.when(F.col("_place") < 256, F.col("_prefix") + F.col("_place")).otherwise(F.raise_error(F.lit("too many word sequences share a hash")).cast("long"))
    return one.select(node.alias("node"), "words", "_r.rep", "_r.text_key", "sig", "bands")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_links, kept, text_key.

    ``class_id`` is the smallest doc_id of the class, and a row with that id is kept, one only
    even if several rows have it.  Equal word sequences are one class without comparison; the
    rest is compared by one text each, and ``n_links`` counts the verified links of a row's
    word sequence.  Texts without words are copies of each other.  Rows that repeat an id are
    documents of their own, each in the class of its text.  Rows without id take part like
    others; if no row of a class has an id, class_id is null and one of them stays.
    ``text_key`` tells rows of one id apart.  Texts of any length are compared whole; an empty
    table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    idf = spark.sparkContext.broadcast(inverse_frequencies(docs, text))
    rows = _kept(signed(docs, idf, doc_id, text), "signed")
    nodes = _kept(representatives(rows), "nodes")
    banded = _kept(nodes.filter(F.col("bands").isNotNull()).select("node", F.explode("bands").alias("band")), "bands")
    buckets = banded.groupBy("band").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = _kept(banded.join(buckets, "band").select("band", "leader", "node"), "shared")
    busy = _kept(nodes.join(shared.select("node").distinct(), "node", "left_semi"), "busy")
    signatures = busy.select("node", "sig")
    texts = _kept(texts_of(docs, busy, doc_id, text), "texts")

    to_leader = shared.filter(F.col("node") != F.col("leader")).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = similar_pairs(to_leader, signatures, texts, idf)
    active, turn = None, 0
    while True:
        label = components(links)
        placed = shared.join(label, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
        classes = placed.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
        mixed = classes.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("k")).filter("k > 1")
        members = _kept(placed.join(mixed.select("band", "main"), "band"), "mixed")
        others = members.filter(F.col("label") != F.col("main"))
        large = others.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_DOCS)
        if active is not None:
            large = large.join(active, "band", "left_semi")
        # another member of the main class leads, by a draw of its own each turn
        lead = members.filter(F.col("label") == F.col("main")).join(large, "band", "left_semi").groupBy("band").agg(F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("lead"))
        tries = _kept(others.join(lead, "band").select("band", F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")), "tries")
        if tries.isEmpty():
            break
        found = similar_pairs(tries.select("a", "b").distinct(), signatures, texts, idf)
        won = tries.join(found.withColumn("won", F.lit(1)), ["a", "b"], "left").groupBy("band").agg(F.count("won").alias("won"), F.count(F.lit(1)).alias("n"))
        active = _kept(won.filter("won * 20 > n").select("band"), "active")
        links = _kept(links.union(found).distinct(), "links")
        turn += 1
    links = links.union(bucket_pairs(members, signatures, texts, idf)).distinct()
    label = components(links)

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    known = nodes.select("node", "words", "rep").join(label, "node", "left").join(degree, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = known.withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    sizes = rows.groupBy("words").agg(F.count(F.lit(1)).alias("n"))
    classes = known.join(sizes, "words").groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("n").alias("class_size"))
    known = _kept(known.join(classes, "label").select("words", "label", "class_id", "class_size", "n_links"), "classes")
    out = rows.select("doc_id", "text_key", "words").join(known, "words")
    # of the rows that have their class's id, the first by text stays
    own = W.partitionBy("label", "doc_id").orderBy("text_key", "words")
    first = out.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).withColumn("nth", F.row_number().over(own))
    rest = out.filter(~F.col("doc_id").eqNullSafe(F.col("class_id"))).withColumn("nth", F.lit(0))
    return first.union(rest).select("doc_id", "class_id", "class_size", "n_links", (F.col("nth") == 1).alias("kept"), "text_key")
