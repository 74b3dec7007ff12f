"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model on shares of character kinds and on telling words gives every document its
own evidence.  It is fitted on a bounded sample of labelled rows (``per_class`` of each kind,
by a hash of their id).  All documents' evidence is then summed by host and by path; a host's
rate of bad documents is shrunk toward the global rate, a path's toward its host's, with
strengths estimated from how much the sites differ, so sparse sites stay near their prior.  A
document's final log-odds are its own plus what its path, without the document itself, adds
to the global rate.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.rows import text_key
from tidewell.llm.suffixes import per_row
from tidewell.llm.text import VALUES, Roller, arrow_bytes, pieces, whole, word_bounds
from tidewell.session import scratch_path

#: Letters: ASCII ones and all bytes of longer characters.
_LETTER = np.array([c >= 128 or chr(c).isalpha() for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Kinds of bytes whose shares are measures.
_KINDS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*", "|", "!", "<>{}[]", ".,;:?")
MOST_WORDS = 400
#: Sites whose sums may travel to the documents, some 100 bytes each; more of them are joined.
MOST_SITES = 100_000
#: Log-odds of every document where labels of one kind are missing.
KEEP = -8.0


class Features:
    """Measures and distinct words of the documents of a batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        row = np.repeat(np.arange(n), np.diff(offsets))
        size = np.maximum(np.diff(offsets), 1)
        masks = np.zeros(256, np.int64)
        for i, kind in enumerate(_KINDS):
            masks[[ord(c) for c in kind]] = i + 1
        kinds = np.bincount(row * (len(_KINDS) + 1) + masks[data], minlength=n * (len(_KINDS) + 1)).reshape(n, -1)[:, 1:]
        starts, ends, first = word_bounds(data, offsets)
        counts = np.diff(first)
        roller = Roller(0)
        words = roller.slices(roller.prefix(VALUES[0][data]), starts, ends)
        owner = per_row(counts)[0]
        order = np.lexsort((words, owner))
        fresh = np.ones(len(words), bool)
        fresh[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = np.bincount(owner[order][fresh], minlength=n)
        many = np.maximum(counts, 1)
        self.measures = np.column_stack([np.sqrt(kinds / size[:, None]), distinct / many, np.log1p(counts), np.log1p(size / many)])
        # telling words are runs of letters, in lower case
        low = _LOWER[data]
        letters = _LETTER[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begin, end = letters.copy(), letters.copy()
        if len(data):
            begin[1:] &= ~letters[:-1] | edge[1:-1]
            end[:-1] &= ~letters[1:] | edge[1:-1]
        begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.words = roller.slices(roller.prefix(VALUES[0][low]), begin, end)
        self.rows = np.searchsorted(offsets, begin, "right") - 1
        self.n = n

    def present(self, vocabulary: np.ndarray) -> np.ndarray:
        """Whether each row has each word of a sorted vocabulary."""
        out = np.zeros((self.n, len(vocabulary)))
        if len(vocabulary) and len(self.words):
            at = np.minimum(np.searchsorted(vocabulary, self.words), len(vocabulary) - 1)
            hit = vocabulary[at] == self.words
            out[self.rows[hit], at[hit]] = 1
        return out


def fit(texts: pa.ChunkedArray, bad: np.ndarray) -> dict:
    """Logistic weights by Newton steps with a ridge, on at most ``MOST_WORDS`` telling words.

    A word tells if its share differs between the kinds by five standard errors.
    """
    data, offsets = arrow_bytes(texts)
    n1, n0 = int(bad.sum()), int((~bad).sum())
    if not n1 or not n0:
        return {"constant": KEEP}
    measures, words, rows = [], [], []
    for lo, hi in pieces(offsets):
        f = Features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        order = np.lexsort((f.rows, f.words))
        w, r = f.words[order], f.rows[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (r[1:] != r[:-1])
        measures.append(f.measures)
        words.append(w[new])
        rows.append(r[new] + lo)
    measures, w, r = np.concatenate(measures), np.concatenate(words), np.concatenate(rows)
    names, place = np.unique(w, return_inverse=True)
    in_bad = np.bincount(place, bad[r], len(names))
    in_good = np.bincount(place, ~bad[r], len(names))
    share = (in_bad + in_good) / (n0 + n1)
    z = (in_bad / n1 - in_good / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    telling = np.flatnonzero(np.abs(z) >= 5)
    telling = np.sort(telling[np.argsort(-np.abs(z[telling]), kind="stable")[:MOST_WORDS]])
    column = np.full(len(names), -1)
    column[telling] = np.arange(len(telling))
    present = np.zeros((len(bad), len(telling)))
    has = column[place] >= 0
    present[r[has], column[place[has]]] = 1
    mean, scale = measures.mean(0), measures.std(0) + 1e-6
    x = np.column_stack([(measures - mean) / scale, present, np.ones(len(bad))])
    weights, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.05)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (bad - p) - ridge * weights)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return {"words": names[telling].view(np.int64).tolist(), "mean": mean.tolist(), "scale": scale.tolist(), "weights": weights[:-1].tolist(), "bias": float(weights[-1])}


def evidence(texts, model: dict) -> np.ndarray:
    """Log-odds of every text to be bad."""
    data, offsets = arrow_bytes(texts)
    if "constant" in model:
        return np.full(len(offsets) - 1, model["constant"])
    words, weights = np.array(model["words"], np.int64).view(np.uint64), np.array(model["weights"])
    out = []
    for lo, hi in pieces(offsets):
        f = Features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        x = np.column_stack([(f.measures - np.array(model["mean"])) / np.array(model["scale"]), f.present(words)])
        out.append(x @ weights + model["bias"])
    return np.clip(np.concatenate(out), -12, 12) if out else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, per_class: int, doc_id: str, text: str) -> dict:
    """Model fitted on at most ``per_class`` bad and ``2 * per_class`` good labelled documents.

    Bad is quality 0 or toxic 1; labels with a null id or both values null are ignored, and an
    id with several labels is bad if one of them is.
    """
    import json

    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    known = labels.filter(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(bad).alias("_bad")).withColumn("_draw", F.xxhash64(F.lit("sample"), "_id"))
    some = known.filter("_bad").orderBy("_draw", "_id").limit(per_class).union(known.filter("not _bad").orderBy("_draw", "_id").limit(2 * per_class))
    # at most 3 * per_class rows of three numbers
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), whole(text).alias("_text")).join(F.broadcast(some), "_id")

    def one(table):
        table = table.sort_by([("_draw", "ascending"), ("_id", "ascending"), ("_text", "ascending")])
        model = fit(table.column("_text"), np.array(table.column("_bad").to_pylist(), bool))
        return pa.table({"model": pa.array([json.dumps(model)])})

    found = rows.select("_id", "_text", "_bad", "_draw").groupBy(F.lit(0).alias("_all")).applyInArrow(one, "model string").first()
    return json.loads(found["model"]) if found else {"constant": KEEP}


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, mean: Column) -> float:
    """Pseudo-documents of the prior, by moments: few if sites differ, many if they do not."""
    row = sites.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("between"), F.sum("within").alias("within"),
    ).first()
    n, k = float(row["n"] or 0), int(row["k"] or 0)
    if k < 2 or n <= k:
        return 1e3
    within = max(float(row["within"]), 1e-9) / (n - k)
    variance = (float(row["between"]) - (k - 1) * within) / max(n - float(row["n2"]) / n, 1e-9)
    return float(min(max(within / variance if variance > 0 else 1e6, 1.0), 1e6))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = 2000, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """One row per document: doc_id, evidence, p_host, p_path, p_bad, kept, text_key.

    ``host`` and ``path`` are columns; null is a site of its own.  A null text counts as empty.
    Without labels of both kinds every document keeps the prior and stays.  Rows that repeat an
    id are judged one by one; ``text_key`` tells them apart.
    """
    spark = docs.sparkSession
    model = train(docs, labels, per_class, doc_id, text)

    def judge(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(evidence(batch.column(3), model)), batch.column(1), batch.column(2), batch.column(4)], ["doc_id", "evidence", "host", "path", "text_key"])

    place = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), place(host).alias("host"), place(path).alias("path"), whole(text).alias("_text"), text_key(text).alias("text_key"))
    where = scratch_path(spark, "evidence")
    rows.mapInArrow(judge, "doc_id long, evidence double, host string, path string, text_key long").write.parquet(where)
    scored = spark.read.parquet(where).withColumn("p", 1 / (1 + F.exp(-F.col("evidence"))))

    rate = lambda g: g.agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), (F.sum(F.col("p") * F.col("p")) - F.sum("p") * F.sum("p") / F.count(F.lit(1))).alias("within"))
    total = scored.agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")).first()
    mean = min(max((total["s"] or 0.0) / max(total["n"], 1), 1e-4), 1 - 1e-4)
    paths = rate(scored.groupBy("host", "path"))
    hosts = rate(scored.groupBy("host")).withColumnsRenamed({"n": "n_h", "s": "s_h"})
    host_strength = _strength(hosts.withColumnsRenamed({"n_h": "n", "s_h": "s"}), F.lit(mean))
    sites = paths.join(hosts.drop("within"), "host")
    path_strength = _strength(sites, F.col("s_h") / F.col("n_h"))
    kept_sites = sites.drop("within")

    # the document itself is left out of its sites
    few = kept_sites.count() <= MOST_SITES
    near = scored.join(F.broadcast(kept_sites) if few else kept_sites, ["host", "path"])
    p_host = (F.col("s_h") - F.col("p") + host_strength * mean) / (F.col("n_h") - 1 + host_strength)
    p_path = (F.col("s") - F.col("p") + path_strength * F.col("p_host")) / (F.col("n") - 1 + path_strength)
    inside = lambda p: F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    near = near.withColumn("p_host", inside(p_host)).withColumn("p_path", inside(p_path))
    odds = F.col("evidence") + _logit(F.col("p_path")) - math.log(mean / (1 - mean))
    out = near.withColumn("p_bad", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", "evidence", "p_host", "p_path", "p_bad", (F.col("p_bad") < threshold).alias("kept"), "text_key")
