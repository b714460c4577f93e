"""Quality rules, periodic runs and the prefix trie against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from voxmill.llm import decision_lists, periodic, prefix_trie, windows
from voxmill.llm.queries import CATALOG

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = "a b c d \U0001f600 ÜÜ\x0bx\x0cy\r\nz # | 12 ٣"


def slow_runs(x, least=24, times=3):
    """Every period by itself; a stretch counts at its smallest period only."""
    out = []
    x = np.asarray(x)
    for q in range(1, len(x) // times + 1):
        same = np.concatenate([[False], x[:-q] == x[q:], [False]])
        for i, j in np.flatnonzero(np.diff(same)).reshape(-1, 2).tolist():
            length = j - i + q
            seg = x[i : i + length]
            if length >= max(least, times * q) and not any(q % p == 0 and (seg[:-p] == seg[p:]).all() for p in range(1, q)):
                out.append((i, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_automaton_finds_what_every_period_by_itself_finds():
    rng = random.Random(3)
    for _ in range(600):
        k, x = rng.choice([1, 2, 3, 5]), []
        while len(x) < rng.randrange(0, 200):
            block = [rng.randrange(k) for _ in range(rng.randrange(1, 14))]
            x += block * rng.randrange(1, 9) + block[: rng.randrange(len(block) + 1)]
        least, times = rng.choice([24, 6, 3, 12]), rng.choice([3, 2, 4])
        want = slow_runs(x, least, times)
        assert sorted(periodic.automaton_runs(x, least, times), key=lambda r: (r[0], r[2])) == want
        assert periodic.runs_of(np.array(x, np.int64), least, times) == want


def slow_row(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [v if i < a else w[a + (i - a) % p] for i, v in enumerate(w)]
    number = {}
    runs = slow_runs([number.setdefault(v, len(number)) for v in w])
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(v for i, v in enumerate(w) if i not in gone)))


DIGEST = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def rows_of(df, columns=DIGEST):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_periodic_query_on_a_folder(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = rows_of(CATALOG["op12_periodic_runs"](spark, folder))
    assert got == sorted((slow_row(r["doc_id"], r["text"]) for r in docs), key=repr)
    assert sum(r[1] > 0 for r in got) > 10


def test_periodic_edges(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(9)}" for _ in range(30_000))
    texts = [None, "", " \t\n", ODD, "a " * 23, "a " * 24, "a b " * 12 + "a", "x " + "a b c d e f g h i " * 3, "p q " * 40 + "r s t " * 40, long, long[:50_000] * 2]
    tens = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, t) for t in texts] + [(k, t) for k, t in zip(tens, texts)] + [(3, "again")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("Best", F.lit(2))
    made = docs.withColumn("text", periodic.with_tail(F.col("doc_id"), F.col("text")))
    assert rows_of(periodic.digest(periodic.find(made))) == sorted((slow_row(*r) for r in rows), key=repr)
    found = {r["doc_id"]: r for r in periodic.find(docs.where("doc_id < 11")).collect()}
    assert found[5]["collapsed"] == "a" and [tuple(r) for r in found[8]["runs"]] == [(0, 80, 2), (80, 120, 3)]
    assert periodic.digest(periodic.find(docs.limit(0))).count() == 0


def slow_counts(text):
    w = WORD.findall(text or "")
    wins = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeats = {j for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, seen = 0, []
    for line in (text or "").split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.append(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), lines, len(repeats)


def test_counts_and_base_rules_by_their_definitions(spark):
    rng = random.Random(2)
    texts = [None, "", "\n\n \n", ODD, "a b c\na b c\n\n \na b c", "a " * 9, "a " * 10, "one two three four five " * 2]
    texts += [" ".join(rng.choice(["a", "b|", "c\n", "D#", "éé"]) for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, "x y"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("Kept", F.lit(0))
    got = decision_lists.judge(docs, []).collect()
    want = []
    for k, t in rows:
        c = slow_counts(t)
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        want.append((k, *c, failed, not failed))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert decision_lists.judge(docs.limit(0), []).count() == 0


def test_windows():
    rng = random.Random(9)
    for _ in range(200):
        x = [rng.randrange(3) for _ in range(rng.randrange(0, 40))]
        for width in (1, 2, 3, 5, 7, 16):
            wins = [tuple(x[i : i + width]) for i in range(len(x) - width + 1)]
            assert windows.repeated(np.array(x, np.int64), width).tolist() == [i for i, v in enumerate(wins) if wins.count(v) > 1]


def test_rules_cover_and_apply(spark):
    rng = np.random.default_rng(4)
    x = rng.random((3000, 3))
    bad = (x[:, 0] > 0.8) & (x[:, 1] <= 0.5) | (x[:, 2] > 0.95)
    names = ["n_words", "longest_word", "word_length"]
    rules = decision_lists.learn(x, bad, np.arange(3000) % 3 == 0, names)
    dropped = np.zeros(3000, bool)
    for rule in rules:
        met = np.ones(3000, bool)
        for name, above, t in rule.conditions:
            v = x[:, names.index(name)]
            met &= (v > t) if above else (v <= t)
        met &= ~dropped
        assert (rule.bad, rule.good) == ((met & bad).sum(), (met & ~bad).sum())
        dropped |= met
    assert (dropped == bad).mean() > 0.99
    assert decision_lists.learn(x, np.zeros(3000, bool), np.arange(3000) % 3 == 0, names) == []
    assert decision_lists.learn(x, np.ones(3000, bool), np.arange(3000) % 3 == 0, names) == []
    # noise gives no rule; equal values have no threshold
    assert decision_lists.learn(np.ones((50, 3)), np.arange(50) % 2 == 0, np.arange(50) % 3 == 0, names) == []
    # the expression is ordered: the first rule that holds decides
    listed = [decision_lists.Rule((("n_words", True, 5.0), ("longest_word", False, 3.0)), True), decision_lists.Rule((("n_words", True, 4.0),), False)]
    rows = [(n, m) for n in range(8) for m in range(6)]
    df = spark.createDataFrame(rows, "n_words long, longest_word long").withColumn("kept", decision_lists.expression(listed))
    assert all(r["kept"] == (r["n_words"] <= 4 or (r["n_words"] > 5 and r["longest_word"] <= 3)) for r in df.collect())


def test_quality_held_out(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    docs, labels = [], []
    for k in range(900):
        body = [word() for _ in range(rng.randrange(20, 90))]
        if k % 5 == 0:
            body = [w + "$$" for w in body]
        elif k % 7 == 0:
            body = [w for w in body for _ in range(3)]
        docs.append((k, " ".join(body)))
        labels.append((k, int(k % 5 > 0 and k % 7 > 0), 0))
    d = spark.createDataFrame(docs + docs[:50] + [(None, "x")], "doc_id long, text string").withColumn("good", F.lit(7))
    seen = labels[:600] + [(None, 0, 0), (3, None, 1), (8, 1, 0), (8, 0, 0)]
    lab = spark.createDataFrame(seen, "doc_id long, quality int, toxic int")
    rules = decision_lists.fit(d, lab)
    kept = {r["doc_id"]: r["kept"] for r in decision_lists.judge(d, rules).collect() if r["doc_id"] is not None}
    assert np.mean([kept[k] == bool(q) for k, q, _ in labels[600:]]) > 0.98
    assert decision_lists.fit(d, lab.limit(0)) == []


def slow_trie(rows):
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members = collections.defaultdict(list)
    for c, s in made.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(c for c in members[k] if len(made[c]) == len(k)))).encode()).hexdigest()
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], digest(k)) for k, m in members.items()), key=repr)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_prefix_trie(spark):
    rng = random.Random(7)
    rows = []
    for c in list(range(0, 60)) + [-7, 10**12]:
        size = rng.choice([1, 2, 3, 5, 9, 14])
        line = [(k, "user" if k % 2 == 0 else "bot", rng.choice(["hi", "ho", "hé", ""])) for k in range(size)]
        rows += [(c, *t) for t in line]
    rows += [(70, k, "user", "same") for k in range(300)]  # a hot conversation
    rows += [(c, 0, "user", "same") for c in range(200, 600)]  # a hot sequence
    rows += [(80, None, None, None), (80, None, None, "first"), (80, 1, None, "x"), (80, 1, "a", "y"), (80, 1, "a", "z"), (80, 1, "a", "z"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).withColumn("Part", F.lit(1))
    got = prefix_trie.nodes(prefix_trie.rebuilt(df.repartition(7)))
    assert rows_of(got, TRIE) == slow_trie(rows)
    assert prefix_trie.nodes(prefix_trie.rebuilt(df.limit(0))).count() == 0
    gone = prefix_trie.nodes(prefix_trie.rebuilt(df.where("conv_id = 1")))
    assert rows_of(gone, TRIE) == slow_trie([r for r in rows if r[0] == 1])


def test_plain_trie_and_lists_of_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = [(c, k, "r", "ab"[c % 2]) for c in range(20) for k in range(2)] + [(50, 0, "r", "a")]
    steps = prefix_trie.plain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    _, whole = prefix_trie.carried(steps)
    lists = collections.defaultdict(dict)
    for r in prefix_trie.ends(whole).collect():
        lists[(r["depth"], r["ka"], r["kb"])][r["from"]] = r["ids"].split(",")
        assert len(r["ids"].split(",")) <= 3
    joined = sorted([int(i) for first in sorted(v) for i in v[first]] for v in lists.values())
    assert joined == [list(range(0, 20, 2)), list(range(1, 20, 2)), [50]]
    top = prefix_trie.nodes(steps).where("depth = 0").first()
    assert (top["n_convs"], top["n_children"], top["n_leaves"], top["conv_id"]) == (21, 2, 2, 0)
