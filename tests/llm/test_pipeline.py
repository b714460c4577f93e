"""The pipeline against brute force, stage by stage, on a small folder."""

import collections
import random

import corpus_pipeline
from test_pairs import slow_components, slow_contained, slow_fingerprint
from test_tables import slow_targets

from voxmill.llm import sharding, toxicity
from voxmill.llm.queries import SHARDS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(21)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6))) for _ in range(n))
    items = [(k, line(30)) for k in range(5)]
    docs, labels = [], []
    for k in range(260):
        text = line(rng.randrange(20, 120))
        if k % 5 == 0:
            text += rng.choice([" vileness", " filthyness"])
        if k % 7 == 3:
            text += " " + items[k % 5][1] + " " + line(10)
        docs.append((k, text, "en", f"s{k % 4}"))
        labels.append((k, 1, int(k % 5 == 0)))
    docs += [(1000 + k, docs[k][1], "en", "s1") for k in range(1, 60, 2)]  # exact copies
    docs += [(2000, None, None, None), (2001, "", "en", "s0"), (2002, "one more text without a source, to be kept", "en", None)]
    spark.createDataFrame([(*d, None if d[1] is None else len(d[1])) for d in docs], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    seen = []
    held = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, step in corpus_pipeline.STAGES[:3]:
        held = step(spark, held, str(tmp_path))
        assert held.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        held.write.parquet(str(tmp_path / name))
        held = spark.read.parquet(str(tmp_path / name))
        seen.append({r["doc_id"] for r in held.select("doc_id").collect()})

    source = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rate = toxicity.fit(source, spark.read.parquet(str(tmp_path / "labels.parquet"))).scorer()
    text, origin = {d[0]: d[1] for d in docs}, {d[0]: d[3] for d in docs}
    left = [i for i in text if rate(text[i]) < 0.5]
    assert seen[0] == set(left)
    assert not any("vileness" in (text[i] or "") or "filthyness" in (text[i] or "") for i in left)
    heads = slow_components(left, [slow_fingerprint(text[i]) for i in left])
    left = [i for i, h in zip(left, heads) if i == h]
    assert seen[1] == set(left)
    dirty = {int(d) for d, *_ in slow_contained([(i, text[i]) for i in left], items)}
    left = [i for i in left if i not in dirty]
    assert dirty and seen[2] == set(left)

    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot", "shard"]
    sizes = collections.Counter()
    for i in left:
        sizes[origin[i]] += len((text[i] or "").split())
    target, taken, copies = slow_targets(sizes), collections.Counter(), collections.Counter()
    for r in rows:
        assert r["text"] == text[r["doc_id"]] and r["doc_id"] in left
        taken[r["source"]] += len(r["text"].split())
        copies[r["doc_id"]] += 1
    assert max(copies.values()) <= 3
    assert all(abs(taken[s] - target[s]) <= 60 for s in sizes)
    table = sharding.lookup(sharding.shard_names(SHARDS), sharding.next_prime(100 * SHARDS))
    assert all(table[r["slot"]] == r["shard"] and r["slot"] == sharding.digest(str(r["doc_id"])) % len(table) for r in rows)
