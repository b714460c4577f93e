"""SimHash components, containment search and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voxmill.llm import decontaminate, simhash
from voxmill.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    """texts: (doc_id, text) or text, numbered from 0."""
    rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], SCHEMA)


def slow_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps, distance=4):
    label = list(range(len(ids)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                label[root(a)] = root(b)
    low = {}
    for k, i in enumerate(ids):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return [low.get(root(k)) for k in range(len(ids))]


def test_fingerprint_rule():
    for text in ["", None, " \n\t", "one", "One TWO three", "a b c d", "A b c d e é É ß " * 30, "x " * 5]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_of_long_text_in_blocks(monkeypatch):
    text = " ".join(f"w{k % 977}" for k in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 100)
    assert simhash.fingerprint(text) == whole == slow_fingerprint(text)


@pytest.mark.parametrize("segments", [2, 3, 4])
def test_links_connect_what_all_pairs_connect(spark, segments):
    rng = random.Random(segments)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for base in list(fps)[:12]:  # chains and dense groups at every distance
        at = base
        for _ in range(25):
            for _ in range(rng.randrange(1, 6)):
                at ^= 1 << rng.randrange(64)
            fps.add(at)
            at = rng.choice([at, base])
    fps = sorted(fps)
    entries = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    found = [(r["a"], r["b"]) for r in simhash.near_links(entries, 4, segments).collect()]
    assert all((a ^ b).bit_count() <= 4 or ((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in found)
    signed = [simhash._signed(f) for f in fps]
    want = slow_components(signed, fps)
    got = {r["node"]: r["label"] for r in components(simhash.near_links(entries, 4, segments)).collect()}
    assert [got.get(s, s) for s in signed] == want
    classes = {r["fp"]: r["label"] for r in simhash.near_classes(entries, 4, segments).collect()}
    assert [classes[s] for s in signed] == want


def test_components_of_documents(spark):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(120)) for _ in range(6)]
    texts = [(k, b) for k, b in enumerate(base)]
    for n in range(40):
        words = base[n % 6].split()
        words[rng.randrange(120)] = "changed"
        texts.append((100 + n, " ".join(words)))
    texts += [(300, base[0]), (300, base[0]), (301, ""), (302, None), (None, base[1]), (None, "alone here in the text"), (303, "tie"), (304, "TIE")]
    got = sorted((r["doc_id"] or -1, r["fp"], r["component_id"]) for r in simhash.near_components(frame(spark, texts)).collect())
    fps = [slow_fingerprint(t) for _, t in texts]
    want = slow_components([i for i, _ in texts], fps)
    assert [(i, f) for i, f, _ in got] == sorted((i or -1, simhash._signed(f)) for (i, _), f in zip(texts, fps))
    assert sorted(str(c) for _, _, c in got) == sorted(str(c) for c in want)


def test_keep_one_with_clashing_columns(spark):
    texts = [(5, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (9, "other words stand in this text"), (None, "no number on this row at all")]
    docs = frame(spark, texts).withColumn("_kept", F.lit("x")).withColumn("fp", F.lit(1)).withColumn("label", F.lit(2))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "9", "None"]


def test_empty_tables(spark):
    none = frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert simhash.near_components(none).count() == 0
    assert simhash.keep_one(none).count() == 0
    assert decontaminate.contained(none, bench).count() == 0
    assert decontaminate.clean(frame(spark, ["a b c"]), bench).count() == 1


def slow_contained(docs, items, width=5, threshold=0.8):
    def cut(text, k):
        w = (text or "").lower().split()
        return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}

    merged = {}
    for item, text in items:
        w = (text or "").lower().split()
        if item is not None and w:
            merged.setdefault(item, set()).update((min(width, len(w)), s) for s in cut(text, min(width, len(w))))
    out = []
    for doc, text in set(docs):
        for item, shingles in merged.items():
            n = sum(s in cut(text, k) for k, s in shingles)
            if n / len(shingles) >= threshold - 1e-9:
                out.append((str(doc), item, len(shingles), n))
    return sorted(out)


def test_containment_against_brute_force(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(k, " ".join(word() for _ in range(rng.choice((1, 2, 4, 5, 6, 12, 40))))) for k in range(30)] + [(30, None), (31, " \n"), (None, "w1 w2 w3"), (0, "w5 w6 w7 w8 w9 w10 w11")]
    docs = []
    for k in range(120):
        body = [word() for _ in range(rng.choice((0, 3, 60, 2000)))]
        if k % 2:
            planted = items[rng.randrange(30)][1].upper().split()
            if len(planted) > 20 and k % 4 == 1:
                planted[rng.randrange(len(planted))] = "x"
            body[len(body) // 2 : len(body) // 2] = planted
        docs.append((k, "\n ".join(body)))
    docs += [(7, docs[1][1]), (7, docs[1][1]), (None, docs[1][1]), (500, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["item_id"], r["n_item"], r["n_shared"]) for r in decontaminate.contained(frame(spark, docs), bench).collect())
    assert got == slow_contained(docs, items)
    left = decontaminate.clean(frame(spark, docs), bench)
    dirty = {d for d, *_ in got}
    assert sorted(str(r["doc_id"]) for r in left.collect() if r["doc_id"] != 7) == sorted(str(i) for i, _ in docs if str(i) not in dirty and i != 7)


def test_components_on_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in range(100, 160)} == {100} and got[201] == 200
    assert np.all([got[k] <= k for k in got])


@pytest.mark.parametrize("task_links", [5, 40, 1 << 19])
def test_components_in_any_number_of_tasks(spark, task_links):
    rng = random.Random(task_links)
    links = [(k, k + 1) for k in range(60)] + [(500, k) for k in range(400, 460)] + [(rng.randrange(600, 900), rng.randrange(600, 900)) for _ in range(200)]
    links += [(-5, -9), (-9, 1000), (None, 4), (3, None), (8, 8)] + links[:20]
    label = {k: k for pair in links if None not in pair and pair[0] != pair[1] for k in pair}
    while True:
        moved = {**label}
        for a, b in links:
            if a in label and b in label:
                moved[a] = moved[b] = min(moved[a], moved[b])
        if moved == label:
            break
        label = moved
    frame = spark.createDataFrame(links, "a long, b long").repartition(7)
    assert {r["node"]: r["label"] for r in components(frame, task_links=task_links).collect()} == label
    assert components(frame.limit(0)).count() == 0
