"""Search, negatives and chat formatting against brute force, with every edge the docstrings name."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import chat, negatives, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def multiset(rows):
    return collections.Counter(tuple(r) for r in rows)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- ranked search ---------------------------------------------------------------------


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def searched(docs, items, k):
    held = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t in docs]
    total, length = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = []
    for item, ts in wanted.items():
        found = []
        for i, c, n in held:
            m = 50 + 50 * n * total // length if length else 50
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        for rank, (score, null, i) in enumerate(sorted(found)[:k], 1):
            out.append((item, rank, None if null else i, -score))
    return out


def search_rows():
    rng = random.Random(7)
    words = ["Sun", "moon", "été", "tide", "well", "x9", "日本", "river", "stone", "a", "B", "cloud", "zebra", "Ünder"]
    docs = [(i, rng.choice(" ,.-\n_").join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for i in range(150)]
    docs += [(500 + i, "tide well river") for i in range(40)]  # ties
    docs += [(None, "tide river stone"), (None, None), (7, "moon moon"), (7, "moon moon"), (600, ""), (601, " .,;"), (602, "zebra_" * 3000), (603, "q" * 5000 + " sun")]
    items = [(i, " ".join(rng.sample(words, rng.randint(1, 9)))) for i in range(30)]
    items += [(40, None), (41, ""), (42, "nowhere unseen"), (3, "tide extra"), (3, "tide extra"), (None, "moon TIDE"), (43, "sun moon " * 50)]
    return docs, items


@pytest.mark.parametrize("batch,step,cells", [(1 << 16, 1 << 20, 1 << 22), (25, 13, 300)])
def test_search(spark, monkeypatch, batch, step, cells):
    monkeypatch.setattr(search, "BATCH_TERMS", batch)
    monkeypatch.setattr(search, "STEP", step)
    monkeypatch.setattr(search, "CELLS", cells)
    docs, items = search_rows()
    table = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], "doc_id long, text string, n string, score int, terms string").repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, batch int")
    got = search.ranked_search(table, asked, 10).collect()
    assert multiset(got) == multiset(searched(docs, items, 10))


def test_search_without_rows(spark):
    docs = spark.createDataFrame([(1, "sun")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "sun")], "item_id long, text string")
    assert search.ranked_search(docs.limit(0), items).count() == 0
    assert search.ranked_search(docs, items.limit(0)).count() == 0
    assert search.ranked_search(docs, items).count() == 1


def test_shared_plan_shares_and_is_exact():
    rng = random.Random(2)
    core = [rng.sample(range(40), 8) for _ in range(6)]
    lists = [np.unique(rng.choice(core) + rng.choice(core) + rng.sample(range(40, 60), 3)) for _ in range(80)]
    leaf, left, right, levels, nodes = search.shared_plan(lists, 60)
    inner = len(left)
    assert sum(levels) == inner and inner + sum(len(n) - 1 for n in nodes) < sum(len(x) - 1 for x in lists) / 2
    n_leaves = int(leaf.max()) + 1
    plan = {"leaf": leaf, "n_leaves": n_leaves, "left": left, "right": right, "levels": levels, "edges": np.concatenate(nodes), "starts": np.cumsum([0] + [len(n) for n in nodes[:-1]])}
    values = np.array([[rng.randint(-9, 9) for _ in range(5)] for _ in range(60)])
    term, row = np.divmod(np.arange(300), 5)
    scores = search.evaluate(plan, values.reshape(-1), row, term, 5)
    assert (scores == np.array([values[x].sum(0) for x in lists])).all()
    # equal terms of an item may not be counted twice: every node stands in the sum once
    parents = collections.Counter(left.tolist() + right.tolist())
    assert max(parents.values()) >= 1


def test_search_stretches_cut_no_term():
    data = np.frombuffer(b"ab cdefghij klm" + b"nop" + b"" + b"q rs", np.uint8)
    offsets = np.array([0, 15, 18, 18, 22])
    for step in range(1, 23):
        cuts = [lo for lo, _ in search.stretches(data, offsets, step)]
        whole = search.term_hashes(data, offsets[:-1])[0].tolist()
        found = [s + lo for lo, hi in search.stretches(data, offsets, step) for s in search.term_hashes(data[lo:hi], offsets[(offsets >= lo) & (offsets <= hi)] - lo)[0]]
        assert cuts[0] == 0 and found == whole


# --- hard negatives --------------------------------------------------------------------


def mined(rows, every=100, n_pos=5, n_neg=10):
    held = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((i, [math.floor(256.0 * x) for x in v], label))
    out = []
    for a, (i, v, label) in enumerate(held):
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, b) for b, (j, w, _) in enumerate(held) if b != a)
        for s, j, b in [x for x in scored if held[x[2]][2] == label][:n_pos]:
            fits = [(t, n) for t, n, c in scored if held[c][2] != label and 30 * -s <= 100 * -t <= 90 * -s][:n_neg]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n) in enumerate(fits, 1)]
    return out


SCHEMA = "vec_id long, embedding array<float>, label int, id string, a string, r int, score string"


def vector_rows(scale=1.0, dims=70):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, dims))
    rows = []
    for i in range(300):
        v = base[rng.integers(12)] if i % 3 == 0 else base[rng.integers(12)] + rng.normal(size=dims) * 0.6
        rows.append((i * 10, [float(np.float32(x * scale)) for x in v], int(rng.integers(0, 3))))
    rows += [rows[0], rows[0], rows[50], (100, rows[7][1], 1), (0, rows[8][1], 0)]  # repeated rows and ids
    rows += [(None, rows[1][1], 1), (4000, None, 1), (4100, rows[1][1], None), (4200, [None] + rows[1][1][1:], 1), (4300, [math.nan] + rows[1][1][1:], 1), (4400, rows[1][1][:-1] + [-math.inf], 0)]
    rows += [(4500, [], 1), (4600, rows[2][1][:20], 1), (4700, rows[2][1] + [1.0], 1), (-100, rows[9][1], 2)]
    return rows


@pytest.mark.parametrize("scale,block,anchors", [(0.2, 4096, 1024), (0.2, 9, 4), (2.5e5, 50, 1024)])
def test_negatives(spark, monkeypatch, scale, block, anchors):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    rows = vector_rows(scale)
    df = spark.createDataFrame([(*r, "c", "l", 1, "s") for r in rows], SCHEMA).repartition(4)
    got = negatives.hard_negatives(df).collect()
    want = mined(rows)
    assert len(want) > 500 and multiset(got) == multiset(want)


def test_negatives_of_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 16)
    rows = [(i, [1.0, 0.5], i % 2) for i in range(0, 400, 5)] + [(i, [0.5, 0.5], 2) for i in range(1, 90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = negatives.hard_negatives(df).collect()
    assert got and multiset(got) == multiset(mined(rows))


def test_negatives_without_rows(spark):
    df = spark.createDataFrame([(5, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(df.limit(0)).count() == 0
    assert negatives.hard_negatives(df).count() == 0  # no anchor
    assert negatives.hard_negatives(df.withColumn("vec_id", F.lit(100))).count() == 0  # an anchor alone
    with pytest.raises(OverflowError):
        negatives.hard_negatives(df.withColumn("embedding", F.array(F.lit(1e12))).withColumn("vec_id", F.lit(100))).count()


def test_residue_products_are_exact():
    rng = np.random.default_rng(1)
    for top, dims in ((100, 64), (1 << 15, 200), (1 << 27, 100), (0, 3)):
        a, b = (rng.integers(-top, top + 1, (9, dims)) for _ in range(2))
        system = negatives.Residues(negatives.primes(dims * top * top))
        assert (system.scores(system.split(a), system.split(b)) == a @ b.T).all()
    many = negatives.primes(1 << 61)
    assert len(set(many)) == len(many) and all(all(p % q for q in range(2, 32)) for p in many)


def test_labels_move_on(spark):
    df = spark.createDataFrame([(0, 9), (7, 3), (8, 3), (14, None)], "vec_id long, label int")
    assert [r["label"] for r in negatives.relabelled(df).orderBy("vec_id").collect()] == [0, 4, 3, None]


# --- chat formatting -------------------------------------------------------------------

CONTROL = re.compile(r"(</?s>|\[/?(?:INST|SYS|ROLE)\]|\[SAYS\])")
CLASHING = "_conv string, _turn int, _role string, _text string, _piece string, formatted string, turns string, nth int"


def read(formatted):
    """The turns of a formatted text, by a reader of its own."""
    parts, out, i = CONTROL.split(formatted), [], 1
    plain = lambda t: re.sub(r"([<\[])\\(\\*(?:/?(?:s>|INST\]|SYS\]|ROLE\])|SAYS\]))", r"\1\2", t)
    assert parts[0] == ""
    while i < len(parts):
        role = {"[INST]": "user", "[SYS]": "system", "<s>": "assistant"}.get(parts[i])
        if role:
            assert parts[i + 2] == {"user": "[/INST]", "system": "[/SYS]", "assistant": "</s>"}[role] and parts[i + 3] == ""
            out.append((role, plain(parts[i + 1])))
            i += 4
        else:
            assert (parts[i], parts[i + 2], parts[i + 4], parts[i + 5]) == ("[ROLE]", "[SAYS]", "[/ROLE]", "")
            out.append((plain(parts[i + 1]), plain(parts[i + 3])))
            i += 6
    return out


def chat_rows():
    rng = random.Random(4)
    bits = ["</s>", "<s>", "<\\s>", "<\\\\/s>", "[INST]", "[/INST]", "[\\INST]", "[SYS]", "[/SYS", "]", "[", "<", "\\", "[ROLE]", "[SAYS]", "[/ROLE]", "ok", " ", "\n", "é", "𝒳", "$1", "\\$", "[/SAYS]", "<INST]"]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "[SAYS]x", "User", "<\\s>"])
            rows.append((c, t, role, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))))
    rows += [(70, 0, "user", None), (70, 1, "assistant", None), (71, None, "assistant", "last"), (71, 5, "user", "b"), (71, 5, "user", "a"), (71, 5, "user", "a")]
    rows += [(None, 0, "user", "alone"), (None, 1, "assistant", "</s>"), (None, 1, "assistant", "</s>")]
    rows += [(72, 0, "assistant", "word </s> " * 30000), (73, 0, "user", "x" * 300000), (73, 1, "assistant", "<" * 20000 + "\\" * 20000)]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    return rows


def test_chats(spark):
    rows = chat_rows()
    df = spark.createDataFrame([(*r, "c", 1, "r", "t", "p", "f", "t", 9) for r in rows], "conv_id long, turn long, role string, text string, " + CLASHING).repartition(4)
    out = chat.format_chats(df)
    got, digest = out.collect(), {(r["conv_id"], r["formatted_chars"], r["turns_sha256"]): r for r in chat.digests(out).collect()}
    held = collections.defaultdict(list)
    for i, (c, t, role, text) in enumerate(rows):
        held[c if c is not None else ("alone", i)].append((t is None, t or 0, role or "", text or ""))
    want = collections.Counter((None if isinstance(c, tuple) else c, tuple((r, x) for _, _, r, x in sorted(ts))) for c, ts in held.items())
    assert collections.Counter((r["conv_id"], tuple((t["role"], t["text"]) for t in r["turns"])) for r in got) == want
    for r in got:
        turns = [(t["role"], t["text"]) for t in r["turns"]]
        assert read(r["formatted"]) == turns
        cuts = [read("<s>" + r["formatted"][m["start"] : m["start"] + m["length"]] + "</s>")[0][1] for m in r["loss_mask"]]
        learnt = [x for role, x in turns if role == "assistant"]
        assert cuts == learnt
        d = digest[(r["conv_id"], len(r["formatted"]), sha("".join(f"{a}\n{b}\n" for a, b in turns)))]
        assert (d["n_turns"], d["loss_chars"], d["loss_sha256"]) == (len(turns), len("".join(learnt)), sha("".join(learnt)))


def test_plain_text_is_not_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a [b] <c> \\ </S>"), (1, 1, "assistant", "fine"), (2, 0, "user", "<s>")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["formatted"], r["n_escaped"]) for r in chat.format_chats(df).collect()}
    assert got == {1: ("[INST]a [b] <c> \\ </S>[/INST]<s>fine</s>", 0), 2: ("[INST]<\\s>[/INST]", 1)}


def test_parser_refuses_what_is_no_conversation(spark):
    texts = ["", "x", "[INST]a", "[INST]a[/INST]b", "[INST]a<s>b[/INST]", "<s>a</s></s>", "[INST]a[/INST]<s>b</s>", "[ROLE]r[SAYS]t[/ROLE]", "[ROLE]r[/ROLE]"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.parse(F.col("t")).alias("p")).collect()
    assert {r["t"]: r["p"] and len(r["p"]) for r in got if r["p"] is not None} == {"": [], "[INST]a[/INST]<s>b</s>": 2, "[ROLE]r[SAYS]t[/ROLE]": 1}


def test_chats_without_rows_and_in_the_jvm(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = chat.digests(chat.format_chats(none))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
