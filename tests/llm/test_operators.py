"""Corpus operators against brute force, on small fixtures with every edge the docstrings name."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidewell.llm import bpe, classifier, exact_dedup, language_model, mixing, near_dedup, quality_rules, rounds, sharding, substrings, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Extra columns with the names that operators use inside.
CLASHING = ("_id", "_text", "_block", "_doc", "_sha", "_nth", "_copy", "size", "shard", "kept", "rows", "recipe", "copies", "words", "host", "path", "p", "band", "n_words")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def prose(rng, n, syllables=("the", "ti", "on", "ér", "she", "and", "of", "wh", "ble", "ß")):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def fixture_rows():
    rng = random.Random(3)
    passage, line = prose(rng, 60), prose(rng, 12)
    rows = []
    for i in range(60):
        body = prose(rng, rng.randint(1, 160))
        if i % 4 == 0:
            body += "\n" + passage + " " + prose(rng, 30)
        if i % 5 == 0:
            body = "\n".join([line, body, line, body[:40]])
        rows.append([i, body, ("en", "de", None)[i % 3], ("a", "b", None, "a", "a")[i % 5]])
    for i in (3, 8, 12):
        rows.append([100 + i, rows[i][1], "en", "a"])  # exact copies
        rows.append([200 + i, rows[i][1].replace(" ", "  "), "en", "c"])  # equal up to white space
        words = rows[i][1].split(" ")
        rows.append([300 + i, " ".join(words[:-1] + ["changed"]), "en", "b"])  # near copies
    rows.append([400, prose(rng, 6000), "fr", "a"])  # very long
    rows.append([401, "x" * 30000 + "<|endoftext|>" + "1a" * 9000 + "   " * 500, "fr", "a"])  # long without spaces
    rows += [[402, None, "en", "a"], [403, "", None, None], [404, " \t\n", "en", "a"], [405, "word", "en", "a"]]
    rows += [[None, rows[0][1], "en", "a"], [None, None, None, None], [None, "no id " + prose(rng, 70), "en", "b"]]
    rows += [rows[5], rows[5], rows[20]]  # repeated rows
    return [tuple(r) + (None,) + tuple("clash" for _ in CLASHING) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def plain():
    return [(r[0], r[1] or "") for r in fixture_rows()]


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 7 > 0), 0) for i in range(60)] + [(None, 1, 1), (7, None, None), (100000, 0, 0), (8, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def multiset(rows):
    return collections.Counter(tuple(r) for r in rows)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# --- quality rules ---------------------------------------------------------------------


def base(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def test_quality_rules_base(docs, labels, plain):
    got = quality_rules.quality_rules(docs, labels).collect()
    assert multiset(r[:7] for r in got) == multiset((i, *base(t)) for i, t in plain)
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_binomial_tail(spark):
    import math
    from fractions import Fraction

    cases = [(k, n) for n in (1, 5, 40, 3000) for k in {0, 1, n // 50, n // 3, n}]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p"))
    for k, n, p in df.collect():
        exact = float(sum(math.comb(n, j) * 49 ** (n - j) for j in range(k + 1)) / Fraction(50) ** n)
        assert p == pytest.approx(exact, rel=1e-9)


def test_quality_rules_certify_and_hold(spark):
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(3000):
        good = i % 3 > 0
        text = " ".join(f"w{rng.randint(0, 10**6)}" + ("" if good else "##$$%%") for _ in range(60))
        rows.append((i, text, "en"))
        marks.append((i, int(good), 0))
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    assert all(r["kept"] == (r["doc_id"] % 3 > 0) for r in got)
    few = quality_rules.quality_rules(spark.createDataFrame(rows[:60], "doc_id long, text string, lang string"), spark.createDataFrame(marks[:60], "doc_id long, quality int, toxic int")).collect()
    assert all(r["kept"] for r in few), "too few labels certify nothing"


def test_quality_rules_are_the_certified_ones(spark):
    """Cutoffs from exact tails over distinct texts, and every verdict that follows from them."""
    import math
    from fractions import Fraction

    rng = random.Random(21)
    rows, marks = [], []
    for i in range(6000):
        noise = rng.choice([0, 0, 0, 0, 1, 3]) if i % 4 else rng.choice([2, 6, 12])
        words = [f"w{rng.randint(0, 10**6)}" + "#" * (noise if rng.random() < 0.4 else 0) for _ in range(60)]
        lang = ("en", None)[i % 2]
        text = " ".join(words) + ("\nsame line here" * rng.randint(0, 2))
        rows += [(3 * i + c, text, lang) for c in range(1 if rng.random() < 0.9 else 3)]
    rows.append((rows[5][0], rows[6][1], "en"))  # a repeated id
    marks = [(i, int(i // 3 % 4 > 0), 0) for i, _, _ in rows if rng.random() < 0.9] + [(None, 1, 0), (7, None, 0)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()

    def values(text):
        n, chars, symbols, dup, rep, failed = base(text)
        lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
        return failed, {"symbol_share": symbols / chars, "dup_line_share": dup / lines, "repeat_share": rep / n, "mean_word": chars / n}

    good = {i for i, q, _ in marks if q == 1}
    held = collections.defaultdict(dict)
    for i, t, lang in rows:
        if i in good and not values(t)[0]:
            held[lang][t] = values(t)[1]
    rules, limits = quality_rules.CUTOFFS, {}
    risk, level = Fraction(2, 100) / len(rules), 0.05 / (len(held) * len(rules))
    for lang, texts in held.items():
        n = len(texts)
        for rule, cuts in rules.items():
            for cut in cuts:
                k = sum(v[rule] > cut for v in texts.values())
                tail = float(sum(math.comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(k + 1))) if k < 60 else 1.0
                if k >= n or tail > level:
                    break
                limits[lang, rule] = cut
    assert len(limits) > 4
    want = collections.Counter()
    for i, t, lang in rows:
        failed, v = values(t)
        broken = tuple(sorted(r for r in rules if (lang, r) in limits and v[r] > limits[lang, r]))
        want[(i, failed, not failed and not broken, broken)] += 1
    assert collections.Counter((r["doc_id"], r["base_failed"], r["kept"], tuple(r["rejected_by"])) for r in got) == want
    assert sum(not r["kept"] and not r["base_failed"] for r in got) > 50


# --- mixing ----------------------------------------------------------------------------


def water(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, capped = share * sum(sizes.values()), set()
    while True:
        left = budget - sum(2 * sizes[s] for s in capped)
        total = sum(weight[s] for s in names if s not in capped)
        out = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / total for s in names}
        above = [s for s in names if s not in capped and out[s] > 2 * sizes[s]]
        if not above:
            return out
        capped |= set(above)


def test_mixing(docs, plain):
    got = mixing.mix_documents(docs).collect()
    again = mixing.mix_documents(docs.repartition(3)).collect()
    assert multiset(got) == multiset(again)
    assert multiset((r["doc_id"], r["size"]) for r in got) == multiset((i, len(WORD.findall(t))) for i, t in plain)
    sizes = collections.Counter()
    for r in fixture_rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    goal = water({s: n for s, n in sizes.items()})
    assert sorted({round(r["target"], 6) for r in got}) == sorted({round(t, 6) for t in goal.values()})
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["taken"] <= 2 * r["size"] for r in got)
    taken = collections.Counter()
    for r in got:
        taken[r["target"]] += r["taken"]
    largest = max(r["size"] for r in got)
    assert all(abs(n - t) <= largest for t, n in taken.items())
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())


# --- exact copies ----------------------------------------------------------------------


def test_exact_duplicates(docs, plain):
    groups = collections.defaultdict(list)
    for i, t in plain:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    want = collections.Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        first = True
        for i in ids:
            want[(i, keep, len(ids), i == keep and first, sha(text))] += 1
            first = first and i != keep
    assert multiset(exact_dedup.exact_duplicates(docs).collect()) == want


def test_chunks_rebuild_the_text(docs):
    text = exact_dedup.normalised()
    assert docs.filter(F.concat_ws("", exact_dedup.chunks(text)) != text).count() == 0


# --- sharding --------------------------------------------------------------------------


def test_sharding(docs, plain):
    got = sharding.shard_documents(docs).collect()
    assert multiset((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == multiset((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in fixture_rows())
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)


def test_jump_hash_moves_little():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 100000).astype(np.uint64)
    for n in (1, 2, 7, 100):
        now, then = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        assert set(then[now != then]) <= {n} and abs((now != then).mean() - 1 / (n + 1)) < 0.01
        assert np.bincount(now, minlength=n).min() > 0.9 * len(keys) / n


# --- near copies -----------------------------------------------------------------------


def test_near_duplicates(docs, plain):
    got = near_dedup.near_duplicates(docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(plain)
    for i in (3, 8, 12):
        assert by[i]["class_id"] == by[100 + i]["class_id"] == by[200 + i]["class_id"]
        if len(WORD.findall(dict(plain)[i])) > 60:
            assert by[i]["class_id"] == by[300 + i]["class_id"]
    assert by[402]["class_id"] == by[403]["class_id"] == by[404]["class_id"] == 402
    assert sum(r["kept"] for r in got if r["doc_id"] is not None) >= len({r["class_id"] for r in got if r["class_id"] is not None})
    assert all(by[i]["class_id"] == i for i in range(60))


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    estimates, exact = [], []
    for _ in range(40):
        h = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
        w = rng.uniform(0.5, 4, len(h))
        v = w * np.where(rng.random(len(h)) < 0.3, rng.uniform(0.2, 3, len(h)), 1.0)
        row = np.repeat([0, 1], len(h))
        s = near_dedup.samples(np.concatenate([h, h]), row, np.concatenate([w, v]), 2)
        estimates.append((s[0] == s[1]).mean())
        exact.append(near_dedup.weighted_jaccard((h, w), (h, v)))
    assert abs(np.mean(estimates) - np.mean(exact)) < 0.03


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in links)}


def stars_and_decoys(decoys, stars=12, variants=12):
    """Sources with variants near them and not near each other, no source first, and pairs that only share bands."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))

    def changed(words, runs, at):
        # every run of five changed words spoils nine shingles
        words = list(words)
        for r in range(runs):
            words[(at + 37 * r) % 290 : (at + 37 * r) % 290 + 5] = [word() for _ in range(5)]
        return words

    rows = []
    for s in range(stars):
        source = [word() for _ in range(300)]
        texts = [changed(source, 2, 25 * v) for v in range(variants)]
        rows += [(1000 * s + i, " ".join(t)) for i, t in enumerate(texts + [source])]
    for d in range(decoys):
        source = [word() for _ in range(60)]
        rows += [(10**6 + 2 * d, " ".join(source)), (10**6 + 2 * d + 1, " ".join(source[:50] + [word() for _ in range(10)]))]
    return rows


def classes_by_all_pairs(spark, docs, rows):
    """Smallest id of each component over all pairs that share a band."""
    idf = near_dedup.inverse_frequencies(docs)
    bands = {r["doc_id"]: r["bands"] for r in near_dedup.signed(docs, spark.sparkContext.broadcast(idf)).collect()}
    sets = {}
    for i, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        h, _, w = near_dedup.weighted(*near_dedup.shingles(data, np.array([0, len(data)])), idf)
        sets[i] = (h, w)
    buckets = collections.defaultdict(list)
    for i, keys in bands.items():
        for k in keys:
            buckets[k].append(i)
    pairs = {(a, b) for ids in buckets.values() for a in ids for b in ids if a < b}
    parent = {i: i for i in bands}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if near_dedup.weighted_jaccard(sets[a], sets[b]) >= near_dedup.SIMILARITY:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: find(i) for i in bands}


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    """Texts of one id are documents of their own, in any order; rows without id take part."""
    rng = random.Random(8)
    a, b, c = (prose(rng, 200).split(" ") for _ in range(3))
    near = lambda words: " ".join(words[:-3] + ["changed"] * 3)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (None, near(a[:-1])), (None, " ".join(c)), (None, near(c)), (1, " ".join(a)), (5, "alone")]
    seen = set()
    for order in range(4):
        rng.shuffle(rows)
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(1 + order)).collect()
        by_text = {t: {r["class_size"] for r in got if r["text_key"] == k} for t, k in spark.createDataFrame(rows, "doc_id long, text string").select("text", near_dedup.text_key()).collect()}
        # a, a again, near a and the one without id; b and near b; c and near c, without ids
        assert [by_text[t] for t in (" ".join(a), near(a), near(a[:-1]), " ".join(b), near(b), " ".join(c), near(c), "alone")] == [{4}, {4}, {4}, {2}, {2}, {2}, {2}, {1}]
        assert {r["class_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1} and sum(r["class_id"] is None for r in got) == 2
        assert sum(r["kept"] for r in got if r["doc_id"] == 1) == 2 and sum(r["kept"] for r in got) == 4
        seen.add(tuple(sorted((str(tuple(r)) for r in got))))
    assert len(seen) == 1


def test_near_duplicates_compare_all_that_share_a_band(spark):
    rows = stars_and_decoys(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    want = classes_by_all_pairs(spark, docs, rows)
    assert sum(n > 5 for n in collections.Counter(want.values()).values()) == 12
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()} == want


@pytest.mark.parametrize("decoys, block", [(0, 256), (300, 2)])
def test_near_duplicates_do_not_depend_on_other_documents(spark, monkeypatch, decoys, block):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block, raising=False)
    docs = spark.createDataFrame(stars_and_decoys(decoys, 3), "doc_id long, text string").repartition(4).cache()
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert {i: c for i, c in got.items() if i < 10**6} == {1000 * s + i: 1000 * s for s in range(3) for i in range(13)}


def test_block_overlaps():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (300, 280, 5, 3, 0, 0)] + [" ".join(rng.choice("abcdefgh") for _ in range(4000)) for _ in range(2)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    idf = np.random.default_rng(3).uniform(1, 2, 1 << near_dedup.SLOT_BITS).astype(np.float32)
    h, row, w = near_dedup.weighted(*near_dedup.shingles(data, offsets), idf)
    sides = [(h[row == i], w[row == i]) for i in range(len(texts))]
    left, right = np.array([0, 2, 4, 6]), np.array([1, 3, 5, 7])
    want = [[near_dedup.weighted_jaccard(sides[i], sides[j]) for j in right] for i in left]
    np.testing.assert_allclose(near_dedup.block_overlaps(data, offsets, idf, left, right), want, atol=1e-9)


# --- language model --------------------------------------------------------------------


def tree_logs(texts, train, depth):
    """Context-tree weighting by its definition: recursive products over explicit trees."""
    import math

    counts = collections.defaultdict(lambda: [0, 0])
    children = collections.defaultdict(set)

    def steps(text):
        x = bytes(depth) + text + b"\0"
        for p in range(depth, len(x)):
            context = tuple(reversed(x[p - depth : p]))
            for k in range(8):
                yield context, (1 << k) | (x[p] >> (8 - k)), (x[p] >> (7 - k)) & 1

    for t, use in zip(texts, train):
        for context, node, bit in steps(t):
            for d in range(depth + 1):
                if d:
                    children[context[: d - 1], node].add(context[:d])
                counts[context[:d], node][bit] += use

    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(n[0] + n[1] + 1) - math.log(math.pi)

    memo = {}

    def weight(context, node):
        if (context, node) not in memo:
            own = kt(counts[context, node])
            below = sum(weight(c, node) for c in children[context, node])
            memo[context, node] = own if len(context) == depth else np.logaddexp(own, below) - math.log(2)
        return memo[context, node]

    def predict(context, node, bit, d):
        n = counts[context[:d], node]
        own = (n[bit] + 0.5) / (n[0] + n[1] + 1)
        if d == depth:
            return own
        beta = kt(n) - sum(weight(c, node) for c in children[context[:d], node])
        share = 1 / (1 + math.exp(-beta)) if beta > -700 else 0.0
        return share * own + (1 - share) * predict(context, node, bit, d + 1)

    return [sum(math.log10(predict(c, node, bit, 0)) for c, node, bit in steps(t)) for t in texts]


def test_language_model(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(1, 25)).title()) for i in range(25)] + [(50, None), (51, ""), (None, "No Id \x00 é")]
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for _, t in rows]
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in rows]
    counts = collections.Counter()
    for t, use in zip(lower, train):
        if use:
            counts.update([*WORD.findall(t), None])
    total, distinct = sum(counts.values()), len(counts)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for depth, blocks in ((3, 3), (2, 1)):
        want = dict(zip([r[0] for r in rows], tree_logs([t.encode() for t in lower], train, depth)))
        got = {r["doc_id"]: r for r in language_model.score_documents(df, depth, blocks).collect()}
        for (i, _), t, use in zip(rows, lower, train):
            tokens = [*WORD.findall(t), None]
            assert got[i]["held_out"] == (not use)
            assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
            assert got[i]["base_score"] == pytest.approx(sum(np.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens), rel=1e-9)
            assert got[i]["score"] == pytest.approx(want[i], rel=1e-5, abs=1e-6)
            assert got[i]["bits_per_byte"] == pytest.approx(-got[i]["score"] * np.log2(10) / (len(t.encode()) + 1), rel=1e-12)


def test_language_model_edges(docs, plain, nothing):
    got = language_model.score_documents(docs, blocks=3).collect()
    assert collections.Counter(r["doc_id"] for r in got) == multiset_ids(plain)
    assert language_model.score_documents(nothing).collect() == []


def multiset_ids(plain):
    return collections.Counter(i for i, _ in plain)


# --- classifier ------------------------------------------------------------------------


def test_classifier_rejects_bad_and_keeps_clean(spark):
    rng = random.Random(11)
    rows, marks = [], []
    for i in range(900):
        kind = i % 9
        words = prose(rng, rng.randint(30, 120)).split(" ")
        if kind == 0:
            words = [w + rng.choice(["###", "%%%", "$$$"]) for w in words]
        if kind == 1:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["Villain.", "rascal", "RASCAL!"]))
        rows.append((i, " ".join(words), f"s{i % 4}", ("x", None)[i % 2]))
        if i % 2:
            marks.append((i, int(kind != 0), int(kind == 1)))
    got = classifier.classify(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r["doc_id"] % 2 == 0]
    bad = [r for r in held if r["doc_id"] % 9 < 2]
    assert np.mean([not r["kept"] for r in bad]) > 0.95
    assert np.mean([r["kept"] for r in held if r["doc_id"] % 9 >= 2]) > 0.97


def test_sites_shrink_toward_priors(spark):
    # one site of many bad documents, one of a single document: its rate stays near the prior
    rng = random.Random(13)
    rows = [(i, prose(rng, 60) + (" rascal" if i % 2 or i < 200 else ""), "bad" if i < 200 else "mixed", "p") for i in range(600)]
    rows.append((1000, prose(rng, 60), "lonely", "p"))
    marks = [(i, 1, int("rascal" in t)) for i, t, _, _ in rows]
    got = {r["doc_id"]: r for r in classifier.classify(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    assert got[0]["p_host"] > 0.8 > got[300]["p_host"]
    assert got[1000]["p_host"] == pytest.approx(np.mean([1 / (1 + np.exp(-r["evidence"])) for r in got.values()]), abs=0.02)


def test_classifier_edges(spark, docs, labels, plain):
    got = classifier.classify(docs, labels).collect()
    assert collections.Counter(r["doc_id"] for r in got) == multiset_ids(plain)
    unlabelled = classifier.classify(docs, labels.limit(0)).collect()
    assert all(r["kept"] for r in unlabelled) and len(unlabelled) == len(plain)


def test_site_posteriors_follow_from_the_evidence(docs, labels):
    """Rates, prior strengths and verdicts again, in NumPy, from each document's own evidence."""
    got = classifier.classify(docs, labels).collect()
    key = {(r[0], r[1] or ""): (r[3], r[2]) for r in fixture_rows()}
    known = docs.select("doc_id", classifier.text_key().alias("k"), F.coalesce("text", F.lit("")).alias("t")).distinct().collect()
    text = {(r["doc_id"], r["k"]): r["t"] for r in known}
    sites = [key[(r["doc_id"], text[(r["doc_id"], r["text_key"])])] for r in got]
    e = np.array([r["evidence"] for r in got])
    p = 1 / (1 + np.exp(-e))
    mean = np.clip(p.mean(), 1e-4, 1 - 1e-4)

    def sums(names):
        _, code = np.unique([repr(n) for n in names], return_inverse=True)
        n, total = np.bincount(code), np.bincount(code, p)
        return code, n, total, np.bincount(code, p * p) - total**2 / n

    def strength(n, total, within, centre):
        k, whole = len(n), n.sum()
        if k < 2 or whole <= k:
            return 1e3
        inner = max(within.sum(), 1e-9) / (whole - k)
        outer = ((n * (total / n - centre) ** 2).sum() - (k - 1) * inner) / max(whole - (n * n).sum() / whole, 1e-9)
        return min(max(inner / outer if outer > 0 else 1e6, 1.0), 1e6)

    host, n_h, s_h, w_h = sums([h for h, _ in sites])
    path, n, s, w = sums(sites)
    of = np.zeros(len(n), int)
    of[path] = host
    a, b = strength(n_h, s_h, w_h, mean), strength(n, s, w, (s_h / n_h)[of])
    inside = lambda v: np.clip(v, 1e-4, 1 - 1e-4)
    p_host = inside((s_h[host] - p + a * mean) / (n_h[host] - 1 + a))
    p_path = inside((s[path] - p + b * p_host) / (n[path] - 1 + b))
    p_bad = 1 / (1 + np.exp(-(e + np.log(p_path / (1 - p_path)) - np.log(mean / (1 - mean)))))
    for name, want in (("p_host", p_host), ("p_path", p_path), ("p_bad", p_bad)):
        np.testing.assert_allclose([r[name] for r in got], want, rtol=1e-6, atol=1e-9)
    assert [r["kept"] for r in got] == (p_bad < 0.5).tolist() and len({round(x, 6) for x in p_path}) > 5


# --- tokens ----------------------------------------------------------------------------


def test_bpe_equals_library(docs, plain):
    library = Tokenizer.from_file(VOCABULARY)
    want = collections.Counter()
    for i, t in plain:
        ids = library.encode(t, add_special_tokens=False).ids
        want[(i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))] += 1
    assert multiset(bpe.encode_documents(docs, VOCABULARY, digests=True, leaf=700).collect()) == want
    encoded = bpe.encode_documents(docs, VOCABULARY)
    assert multiset(bpe.decode_documents(encoded, VOCABULARY).collect()) == multiset(plain)


def test_tree_concatenation_equals_direct_encoding():
    codec, library = bpe.Codec(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    rng = random.Random(17)
    alphabets = ["ab", "aé ", "x1'!s ", "  \n\t", "日本語", "the and of", "<|endoftext|>", "'re'll ve", "😀á", " 　 a"]
    for trial in range(300):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 300)))
        if trial % 5 == 0:
            text = text.replace("a", "<|endoftext|>", 2)
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text, leaf=rng.choice([3, 7, 20])) == want, repr(text)
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_engines_agree_on_every_kind_of_character():
    codec, library = bpe.Codec(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    points = [*range(0x3100), *range(0xA600, 0xAC10), *range(0xF900, 0x10000), *range(0x1F300, 0x1F700)]
    texts = [f"a{chr(x)}b {chr(x)}1{chr(x)} {chr(x)}{chr(x)} !{chr(x)}" for x in points]
    assert [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)] == [codec.encode_piece(t) for t in texts]


# --- substrings ------------------------------------------------------------------------


def test_substrings(docs, plain):
    width = 20
    rows = [(i, t) for i, t in plain]
    # rows that repeat an id have equal texts here, so any order of them gives the same multiset
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for blocks in (1, 4):
        ids = {r["doc_id"] for r in substrings.dedup_substrings(docs, blocks=blocks).select("doc_id").collect()}
        assert ids == {i for i, _ in rows}
    seen, want = set(), collections.Counter()
    for k in order:
        i, t = rows[k]
        if i is None:
            continue
        words = WORD.findall(t)
        gone = np.zeros(len(words), bool)
        for p in range(len(words) - width + 1):
            key = tuple(words[p : p + width])
            if key in seen:
                gone[p : p + width] = True
            seen.add(key)
        kept = [w for w, g in zip(words, gone) if not g]
        want[(i, len(words), int(gone.sum()), sha(" ".join(kept)))] += 1
    for depth, slack, blocks in ((2, 4, 4), (1, -12, 2)):
        got = substrings.dedup_substrings(docs, width, depth, slack, blocks).filter("doc_id is not null").collect()
        assert multiset(got) == want, "a narrow sketch only costs work"


def test_substrings_of_repeated_and_missing_ids(spark):
    """Rows of one id are ordered by text, rows without id come last: the same for any order of the rows."""
    rng = random.Random(3)
    shared = prose(rng, 30)
    rows = [(i, f"{prose(rng, 3)} {shared} {prose(rng, 2)}") for i in (5, 5, 5, 2, None, None)] + [(5, shared), (None, shared), (None, shared)]
    first = {t for i, t in rows if i == 2}
    seen = set()
    for turn in range(4):
        rng.shuffle(rows)
        got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(1 + turn), 10, blocks=1 + turn % 2, texts=True).collect()
        assert {r["kept_text"] for r in got if r["n_removed"] == 0} == first
        seen.add((turn % 2, tuple(sorted(str(tuple(r)) for r in got))))
    assert len(seen) == 2 or len({s for _, s in seen}) == 1
    # among the rows of one id, the one with the smallest text keeps what no smaller id has
    two = [(7, "b " + shared), (7, "a " + shared)]
    for order in (two, two[::-1]):
        got = substrings.dedup_substrings(spark.createDataFrame(order, "doc_id long, text string").coalesce(1), 10, texts=True).collect()
        assert {r["kept_text"] for r in got} == {"a " + shared, "b"}


def test_suffixes(docs, plain):
    texts = [t.encode() for _, t in plain]
    count = collections.Counter(t[p : p + 200] for t in texts for p in range(len(t) - 199))
    want = collections.Counter()
    for (i, _), t in zip(plain, texts):
        edge = np.zeros(len(t) + 1, int)
        for p in range(len(t) - 199):
            if count[t[p : p + 200]] > 1:
                edge[p] += 1
                edge[p + 200] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[(i, len(t), int(gone.sum()), spans, sha(np.frombuffer(t, np.uint8)[~gone].tobytes()))] += 1
    for blocks in (1, 6):
        assert multiset(suffixes.dedup_suffixes(docs, blocks=blocks).collect()) == want


def test_cover_meets_every_difference():
    residues = {(a - b) % suffixes.MODULUS for a in suffixes.COVER for b in suffixes.COVER}
    assert residues == set(range(suffixes.MODULUS))


def test_suffixes_with_many_partial_matches(spark):
    """Matches of all lengths around the cover's steps, shared by two, three and more texts."""
    rng = random.Random(23)
    source = prose(rng, 400)
    rows = []
    for i in range(60):
        a = rng.randrange(len(source) - 500)
        body = source[a : a + rng.randint(150, 460)]
        rows.append((i, prose(rng, rng.randint(1, 40)) + body + prose(rng, rng.randint(1, 20))))
    texts = [t.encode() for _, t in rows]
    count = collections.Counter(t[p : p + 200] for t in texts for p in range(len(t) - 199))
    want = {}
    for (i, _), t in zip(rows, texts):
        edge = np.zeros(len(t) + 1, int)
        for p in range(len(t) - 199):
            if count[t[p : p + 200]] > 1:
                edge[p] += 1
                edge[p + 200] -= 1
        want[i] = int((np.cumsum(edge)[:-1] > 0).sum())
    got = suffixes.dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string"), blocks=5).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == want


def test_messages_survive_packing():
    keys = np.sort(np.random.default_rng(3).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (rounds.unpack_sorted(rounds.pack_sorted(keys)) == keys).all()
    for values in (np.array([5, -3, 1 << 40, 0]), np.zeros(3, np.uint16), np.zeros(0, np.uint32), np.arange(300, dtype=np.uint32)):
        assert (rounds.unplanes(rounds.planes(values), values.dtype) == values).all()
    edges = rounds.shard_edges(keys, 7)
    for s in range(7):
        part = keys[edges[s] : edges[s + 1]]
        assert all(int(k) * 7 >> 64 == s for k in part)


# --- all of them -----------------------------------------------------------------------


def test_empty_tables(nothing, labels):
    assert quality_rules.quality_rules(nothing, labels).count() == 0
    assert mixing.mix_documents(nothing).count() == 0
    assert exact_dedup.exact_duplicates(nothing).count() == 0
    assert sharding.shard_documents(nothing).count() == 0
    assert near_dedup.near_duplicates(nothing).count() == 0
    assert classifier.classify(nothing, labels).count() == 0
    assert bpe.encode_documents(nothing, VOCABULARY).count() == 0
    assert substrings.dedup_substrings(nothing).count() == 0
    assert suffixes.dedup_suffixes(nothing).count() == 0


def test_pipeline_stages(spark, docs, nothing, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now, ids = docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), docs.schema)
        assert now.columns == docs.columns, name
        kept = {r["doc_id"] for r in now.collect()}
        assert ids is None or kept <= ids
        ids = kept
    mixed = now.collect()
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    library = Tokenizer.from_file(VOCABULARY)
    want = collections.Counter((r["doc_id"], sha(",".join(map(str, library.encode(r["text"] or "", add_special_tokens=False).ids)))) for r in mixed)
    assert collections.Counter((r["doc_id"], r["ids_sha256"]) for r in last) == want
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0, name


def test_pipeline_keeps_one_of_each_group(spark, docs, tmp_path, labels):
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality classifier"](spark, docs, str(tmp_path))
    assert one.count() == len({(r[0], r[1] or "") for r in fixture_rows()})
    exact = stages["exact dedup"](spark, docs, str(tmp_path))
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in exact.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in fixture_rows()})
