"""Mixing, sharding, fingerprints, token store and url rules against plain versions."""

import collections
import functools
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxmill.llm import mixing, order_minhash, sharding, token_store, url_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_targets(sizes, most=3.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    left, target, free = float(sum(sizes.values())), {}, set(names)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > most * sizes[s] + 1e-9}
        if not over:
            target |= {s: weight[s] * unit for s in free}
            break
        target |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return target


def mixed_docs(spark):
    rng = random.Random(5)
    rows = []
    for k in range(900):
        source = rng.choice(["b", "b", "b", "b", "é", "a", "Z", None]) if k % 50 else "tiny"
        n = rng.choice((0, 1, 3, 10, 50, 50, 50, 400, 3000))
        rows.append((k, "\t ".join("w" * rng.randrange(1, 5) for _ in range(n)), "en", source, 0))
    rows += [(None, None, None, None, None), (None, "a b", "en", "a", 3), (5, "x y z", "en", "b", 5), (5, "x y z", "en", "b", 5)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_mix_meets_targets(spark):
    docs, rows = mixed_docs(spark)
    made = mixing.taken(docs.withColumn("size", F.lit("x")).withColumn("h", F.lit(1))).collect()
    assert len(made) == len(rows)
    sizes = collections.Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len((text or "").split())
    target = slow_targets(sizes)
    assert sorted((str(r["doc_id"]), r["size"]) for r in made) == sorted((str(i), len((t or "").split())) for i, t, *_ in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"] for r in made)
    total = collections.Counter()
    for r in mixing.mix(docs).collect():
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        total[r["source"]] += r["size"] * r["copies"]
    for s in sizes:
        assert abs(total[s] - target[s]) <= max(0.01 * target[s], 60)
    assert sorted(map(str, made)) == sorted(map(str, mixing.taken(docs.withColumn("size", F.lit("x")).withColumn("h", F.lit(1)).repartition(7)).collect()))


def test_mix_applied(spark):
    docs, _ = mixed_docs(spark)
    docs = docs.withColumn("_rank", F.lit(1)).withColumn("_size", F.lit("s")).withColumn("copies", F.lit(9))
    plan = mixing.mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).where("n > 0")
    made = mixing.apply(docs)
    assert made.columns == docs.columns
    assert sorted(map(tuple, made.groupBy("doc_id").agg(F.count("*")).collect()), key=str) == sorted(map(tuple, plan.collect()), key=str)
    assert mixing.taken(docs.limit(0)).count() == 0 and mixing.apply(docs.limit(0)).count() == 0


def slow_lookup(shards, slots):
    prefs = []
    for s in shards:
        at, skip = sharding.digest(f"offset:{s}") % slots, sharding.digest(f"skip:{s}") % (slots - 1) + 1
        prefs.append([(at + j * skip) % slots for j in range(slots)])
    owner = {}
    while len(owner) < slots:
        for k, p in enumerate(prefs):
            if len(owner) < slots:
                owner[next(s for s in p if s not in owner)] = k
    return [owner[s] for s in range(slots)]


def test_lookup_by_turns():
    names = sharding.shard_names(7)
    table = sharding.lookup(names, 211)
    assert table == slow_lookup(names, 211)
    count = collections.Counter(table)
    assert max(count.values()) - min(count.values()) <= 1
    fewer = sharding.lookup(names[:-1], 211)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.25 * 211
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup(bad, 211)
    with pytest.raises(ValueError):
        sharding.lookup(names, 210)


def test_assign(spark):
    rows = [(k, f"t{k}", "en", "s", 1) for k in range(300)] + [(None, f"n{k}", "en", "s", 1) for k in range(50)] + [(None, None, None, None, None), (3, "again", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit("old")).withColumn("Slot", F.lit("old")).withColumn("_slot", F.lit("mine"))
    made = sharding.assign(docs, sharding.shard_names(5))
    table = sharding.lookup(sharding.shard_names(5), sharding.next_prime(500))
    got = made.collect()
    assert len(got) == len(rows) and {r["_slot"] for r in got} == {"mine"}
    for r in got:
        slot = sharding.digest(str(r["doc_id"]) if r["doc_id"] is not None else r["text"] or "") % len(table)
        assert (r["slot"], r["shard"]) == (slot, table[slot])
    assert sharding.assign(docs.limit(0), sharding.shard_names(5)).count() == 0


def slow_signature(text, k=3, size=2):
    """Bin -> hash of its minimal occurrence-numbered k-mers in text order, one k-mer after the other."""
    words = (text or "").split()
    mers = [words[i : i + k] for i in range(len(words) - k + 1)] or ([[" ".join(words)]] if words else [])
    chain = lambda parts, seed: functools.reduce(lambda h, b: xxhash.xxh64_intdigest(b, seed=h), parts, seed)
    cut = lambda h: h >> 20 << 20
    seen, bins = collections.Counter(), collections.defaultdict(list)
    for place, mer in enumerate(mers):
        h = cut(chain([w.encode() for w in mer], 42))
        again = seen[h]
        seen[h] += 1
        if again:
            h = cut(chain([h.to_bytes(8, "little"), again.to_bytes(4, "little")], 42))
        bins[h >> 58].append((h, place))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    order = lambda e: (signed(e[0]), e[1])
    out = {}
    for b, found in bins.items():
        chosen = sorted(sorted(found, key=order)[:size], key=lambda e: e[1])
        out[b] = functools.reduce(lambda h, e: chain([h.to_bytes(8, "little"), e[0].to_bytes(8, "little")], 42), chosen, 42) >> 6
    return out


def test_signature_against_brute_force(spark):
    rng = random.Random(5)
    draw = lambda n, m: " ".join(f"w{rng.randrange(m)}" for _ in range(n))
    texts = ["", None, "one", "one two", "a b c", "a b c d " * 70, draw(40, 9), draw(900, 12), draw(3000, 4000), "été " * 300]
    d = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    # 8 packed words: the form of texts too long for packed positions has to give the same
    for packed_words in (1 << 20, 8):
        for k, size in ((3, 2), (2, 3)):
            got = d.select("n", order_minhash.signature(F.col("text"), k, size, packed_words).alias("s")).collect()
            for r in got:
                want = slow_signature(texts[r["n"]], k, size)
                assert {(x % (1 << 64)) >> 58: x % (1 << 58) for x in r["s"]} == want and len(r["s"]) == len(want)


def test_positions_of_a_text_beyond_packed_ones(spark):
    text = " ".join(f"w{i}" for i in range((1 << 20) + 5000))
    r = spark.createDataFrame([(text,)], "text string").select(order_minhash.signature(F.col("text")).alias("s")).first()
    assert {(x % (1 << 64)) >> 58: x % (1 << 58) for x in r["s"]} == slow_signature(text)


def test_fingerprints(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    base = [rng.choice(words) for _ in range(600)]
    swapped = base[300:] + base[:300]
    cut = base[:400] + [rng.choice(words) for _ in range(200)]
    texts = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(swapped)), (4, " ".join(cut)), (5, "a b c d " * 50), (6, "a b c d " * 60), (7, ""), (8, None), (9, "one"), (10, "one two"), (None, "x y z"), (4, "same number")]
    d = spark.createDataFrame(texts, "doc_id long, text string").withColumn("extra", F.lit(1)).withColumn("block", F.lit(2))
    rows = order_minhash.compare(d).collect()
    assert len(rows) == len(texts)
    by = {(r["doc_id"], r["n_chars"]): r for r in rows}
    sign = {r["doc_id"]: r["s"] for r in d.where("doc_id <> 4").select("doc_id", order_minhash.signature(F.col("text")).alias("s")).collect()}
    assert by[1, len(texts[0][1])]["fingerprint"] == by[2, len(texts[1][1])]["fingerprint"]
    assert sign[7] == sign[8] == [] and len(sign[9]) == 1
    like = lambda a, b: len(set(sign[a]) & set(sign[b])) / len({x >> 58 for x in sign[a] + sign[b]})
    assert like(1, 3) < 0.9 and like(1, 2) == 1  # order counts, although nearly all words are shared
    assert like(5, 6) < 1  # so do repeats: only occurrence numbers tell these apart
    likeness = lambda a, b: sum(a.get(k) == b[k] for k in b) / len(a.keys() | b.keys()) if a or b else 1.0
    for r in rows:
        text = next(t for i, t in texts if i == r["doc_id"] and len(t or "") == r["n_chars"])
        made = slow_signature(text)
        assert r["fingerprint"] == "".join(f"{made[b] % (1 << 48):012x}" if b in made else "-" * 12 for b in range(64))
    # the edited text and neighbours by descending doc_id, null ids last
    order = sorted(texts, key=lambda r: (r[0] is None, -(r[0] or 0)))
    ids = [r[0] for r in order]
    for k, (i, text) in enumerate(order):
        if ids.count(i) == 1 and ids.count(ids[(k + 1) % len(ids)]) == 1:
            text, following = text or "", order[(k + 1) % len(order)][1] or ""
            n = len(text) // 3
            r = by[i, len(text)]
            mine, changed = slow_signature(text), slow_signature(text[: len(text) - n] + following[:n])
            assert abs(r["near_edited"] - likeness(mine, changed)) < 1e-12 and abs(r["near_next"] - likeness(mine, slow_signature(following))) < 1e-12
            assert r["edited_sha256"] == hashlib.sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest()
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert order_minhash.compare(d.limit(0)).count() == 0


def test_neighbours_over_many_blocks(spark):
    d = spark.range(0, 3000, 3).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    rows = order_minhash.with_next(d, F.length("text"), rows_in_block=40).collect()
    assert {(r["doc_id"], r["next_text"]) for r in rows} == {(i, f"t{i - 3 if i else 2997}") for i in range(0, 3000, 3)}


def test_codes_by_level():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.array([0], np.uint32), rng.integers(0, 256, 3000, dtype=np.uint32), rng.integers(0, 1 << 16, 5000, dtype=np.uint32), rng.integers(0, 1 << 32, 3000, dtype=np.uint32)):
        levels, marks, ranks = token_store.encode_levels(ids)
        assert np.array_equal(token_store.decode_levels(levels, marks, len(ids)), ids)
        for i in rng.integers(0, len(ids), 200) if len(ids) else []:
            assert token_store.token_at(levels, marks, ranks, int(i)) == ids[i]


def test_store_round_trip(spark, tmp_path):
    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    whole = Tokenizer.from_str(spec)
    odd = ["It's don't I'LL x_y ²³ ½ été ÉTÉ e\u0301te\u0301 naïve", "a\u00a0b\u3000c <|endoftext|>a b<|startoftext|>", "中文 12ab3 !!?? \x1c a\x1cb \x85q 'd'm ÀÖ×÷", "", None, "  \n\t", "İSTANBUL ΑΣ ΌΣ. ǅ ß"]
    texts = [(7 * k % 101, f"text number {k} of the ÉCOLE, won't stop! " * (k % 9)) for k in range(101)] + [(200 + k, t) for k, t in enumerate(odd)] + [(300, "long " * 50_000)]
    d = spark.createDataFrame(texts, "doc_id long, text string").withColumn("part", F.lit("x"))
    folder = str(tmp_path / "ids")
    token_store.write(d, folder, spec)
    segments = token_store.read(spark, folder)
    got = sorted(token_store.documents(segments, with_ids=True).collect(), key=lambda r: r["start"])
    at = 0
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in texts)
    by = dict(texts)
    for r in got:
        ids = whole.encode(by[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
        assert (r["ids"], r["start"], r["n_tokens"]) == (ids, at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_store_with_ties_and_nulls(spark, tmp_path):
    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    d = spark.createDataFrame([(None, "a"), (None, None), (3, "b"), (3, "b"), (3, "c")], "doc_id long, text string")
    token_store.write(d, str(tmp_path / "a"), spec)
    got = sorted(token_store.documents(token_store.read(spark, str(tmp_path / "a"))).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, 3, 3, 3] and [r["start"] for r in got][0] == 0
    token_store.write(d.limit(0), str(tmp_path / "b"), spec)
    assert token_store.documents(token_store.read(spark, str(tmp_path / "b"))).count() == 0


def test_encoder_makes_a_word_once_in_a_process(monkeypatch):
    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    made, ids = [], token_store.Encoder._ids
    monkeypatch.setattr(token_store.Encoder, "_ids", lambda self, word: made.append(word) or ids(self, word))
    token_store.encoder_of.cache_clear()
    text = "Words words zürich don't 12 \u6f22 words"
    first, second = (token_store.encoder_of("".join(spec))(text, 2) for _ in range(2))  # as two tasks do
    token_store.encoder_of.cache_clear()
    assert first == second and len(made) == len(set(made)) == 6
    whole = Tokenizer.from_str(spec).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(first, "<u4").tolist() == [*whole, 2]


def slow_judge(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m.group(1), m.group(2)) if m else ("", "")
    host = re.sub("[A-Z]", lambda x: x.group().lower(), host)
    best = None
    for r in url_rules.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
            best = r
    return host, path, best


def test_url_rules(spark):
    urls = [
        "http://WWW.Example.com/en/1", "http://blog.example.com/en/1", "http://example.com/EN/", "https://a.net/es/x?q#f", "https://net/fr/", "http://anet/fr/", "http://a.net/de/", "http://x.org",
        "http://com", "http://b.com?x=/en/", "http://notexample.com/en/", "no scheme", "", None, "http://a.b://c.com/en/", "ftp://Ä.COM/#a", "http://bad.org/spam/1", "http://bad.org/spam/2", "http://x.org/\n/en/",
    ]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(None, None), (3, urls[3])], "page_id long, url string").withColumn("verdict", F.lit("old")).withColumn("own", F.lit(1))
    labelled = spark.createDataFrame([(f"http://bad.org/spam/{k}", True) for k in range(40)] + [(f"http://bad.org/fine/{k}", False) for k in range(40)] + [(f"http://good{k}.org/spam/{k}", False) for k in range(40)] + [(None, True), ("http://x.org", None)], "url string, bad boolean")
    rows = url_rules.judge(pages, labelled).collect()
    assert len(rows) == len(urls) + 2
    for r in rows:
        url = urls[r["page_id"]] if r["page_id"] is not None else None
        host, path, best = slow_judge(url)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best.text if best else None)
        mined = url is not None and host == "bad.org" and "/spam/" in path
        assert r["verdict"] == (best.verdict if best else "block" if mined else "allow")
    rules = url_rules.mine(labelled).collect()
    assert any(set(r["antecedent"]) >= {"h:bad", "p:spam"} and r["confidence"] == 1.0 for r in rules)
    assert all(r["confidence"] >= 0.6 and r["key_token"] in r["antecedent"] for r in rules)
    assert url_rules.judge(pages, labelled.limit(0)).count() == len(urls) + 2
    assert url_rules.judge(pages.limit(0), labelled).count() == 0


def test_mixing_applies_to_any_column_names(spark):
    rows = [(k, "a b c " * (k % 4), "s%d" % (k % 3), k) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    odd = docs.select("doc_id", "text", "source", *[F.col("n").alias(c) for c in ("_d", "_S", "_z", "_r", "_rank", "_copies", "_size")])
    plain, got = mixing.apply(docs), mixing.apply(odd)
    assert got.columns == odd.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in plain.collect())
    assert all(r["_d"] == r["doc_id"] == r["_size"] for r in got.collect())
