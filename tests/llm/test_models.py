"""Toxicity, context-tree scores and main-text extraction against plain versions."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.llm import boosting, html_text, language_model, toxicity


def test_toxicity_held_out_accuracy_and_edges(spark):
    rng = random.Random(1)
    word = lambda: f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"
    docs, labels = [], []
    for k in range(600):
        body, bad = [word() for _ in range(rng.randrange(5, 120))], k % 4 == 0
        if bad:
            body.insert(rng.randrange(len(body)), rng.choice(["vileness", "Rotten,", "filthy"]))
        if k % 3 == 0:
            body.append(rng.choice(["muslim", "women"]) if bad else "citizens")
        docs.append((k, " ".join(body)))
        labels.append((k, 1, int(bad)))
    docs += [(1000, "the women and the muslim neighbours came"), (1001, ""), (1002, None), (None, "filthy"), (1000, "rotten")]
    labels += [(None, 1, 1), (2, None, None), (4, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("y", F.lit(1))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, lab)
    rows = toxicity.score(d, model).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 600 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.97
    # a neutral mention of a group is not held against a text, and groups count alike
    rate = model.scorer()
    assert rate("the women and the muslim neighbours came") < 0.5
    assert abs(rate("the women came") - rate("the men came")) < 0.05
    kept = toxicity.clean(d, model)
    assert kept.columns == d.columns
    assert all(rate(r["text"]) < 0.5 for r in kept.collect())


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(d, toxicity.fit(d, lab)).collect()} == {0.5}
    only = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r["predicted"] == 0 for r in toxicity.score(d, toxicity.fit(d, only)).collect())


def test_toxicity_rows_are_bounded_and_weighted(spark, monkeypatch):
    texts = [(k, f"some plain words {chr(97 + k % 20) * 3}" + (" vileness women" if k % 4 == 0 else "")) for k in range(40)]
    lab = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(40)], "doc_id long, quality int, toxic int")
    plain, seen = toxicity._descend, []
    monkeypatch.setattr(toxicity, "_descend", lambda y, *more: seen.append((len(y), y, more)) or plain(y, *more))
    used = [k for k in range(40) if zlib.crc32(str(k).encode()) % 5]
    bad, fine = next(k for k in used if k % 4 == 0), next(k for k in used if k % 4)
    repeated = spark.createDataFrame(texts + [texts[bad]] * 200 + [texts[fine]] * 100, "doc_id long, text string")
    model = toxicity.fit(repeated, lab, most_rows=60)
    assert seen[-1][0] == len(used) and seen[-1][2][0].sum() == len(used) + 300
    # weights stand for repeated rows
    y, (weight, on, swaps, *rest) = seen[-1][1], seen[-1][2]
    times = weight.astype(int)
    many = lambda x: [v for v, n in zip(x, times) for _ in range(n)]
    w, b = plain(np.repeat(y, times), np.ones(times.sum()), many(on), many(swaps), *rest)
    assert np.isclose(b, model.bias) and np.allclose([v for v in w if v], list(model.weights.values()))
    # many different texts under one id stay within the bound
    different = spark.createDataFrame(texts + [(bad, f"vileness {k}") for k in range(300)], "doc_id long, text string")
    toxicity.fit(different, lab, most_rows=60)
    assert seen[-1][0] == 60


def test_toxicity_rows_reach_the_driver_as_arrays(spark, monkeypatch):
    texts = [(k, f"some plain words {chr(97 + k % 20) * 3}" + (" vileness women" if k % 4 == 0 else "")) for k in range(40)]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    lab = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(40)], "doc_id long, quality int, toxic int")
    plain, seen = toxicity._descend, []
    monkeypatch.setattr(toxicity, "_descend", lambda *given: seen.append(given) or plain(*given))
    monkeypatch.setattr(type(d), "toPandas", lambda self: pytest.fail("a pandas frame in the driver"))
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *given: pytest.fail("rows sent back by the driver"))
    toxicity.fit(d, lab)
    y, n, on, swaps = seen[0][:4]
    rows = [(a, b, tuple(c), tuple(e)) for a, b, c, e in zip(y, n, on, swaps)]
    assert rows == sorted(rows) and len(rows) == sum(zlib.crc32(str(k).encode()) % 5 > 0 for k in range(40))
    assert all(isinstance(x, np.ndarray) for x in on) and sum(map(len, swaps)) and sum(map(len, on))


def slow_tree_score(train, texts, depth):
    """Context-tree weighting by its definition, node by node."""
    counts = collections.defaultdict(lambda: [0, 0])
    kids = collections.defaultdict(set)

    def steps(text):
        line = bytes([language_model.PAD]) * depth + text + bytes([language_model.END])
        for i in range(depth, len(line)):
            yield line[i - depth : i][::-1], line[i]

    for text in train:
        for context, byte in steps(text):
            for j in range(8):
                prefix, bit = (1 << j) | byte >> (8 - j), byte >> (7 - j) & 1
                for d in range(depth + 1):
                    counts[context[:d], prefix][bit] += 1
                    if d:
                        kids[context[: d - 1], prefix].add(context[:d])
    memo = {}

    def evidence(n0, n1):
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.log(math.pi) - math.lgamma(n0 + n1 + 1)

    def weighted(context, prefix):
        key = context, prefix
        if key not in memo:
            own = evidence(*counts.get(key, (0, 0)))
            if len(context) == depth:
                memo[key] = own, 1.0
            else:
                below = sum(weighted(c, prefix)[0] for c in kids.get(key, ()))
                top = max(own, below)
                a, b = math.exp(own - top), math.exp(below - top)
                memo[key] = top + math.log((a + b) / 2), a / (a + b)
        return memo[key]

    out = []
    for text in texts:
        total = 0.0
        for context, byte in steps(text):
            for j in range(8):
                prefix, bit = (1 << j) | byte >> (8 - j), byte >> (7 - j) & 1
                p, rest = 0.0, 1.0
                for d in range(depth + 1):
                    n = counts.get((context[:d], prefix), (0, 0))
                    share = weighted(context[:d], prefix)[1]
                    p += rest * share * (n[bit] + 0.5) / (sum(n) + 1)
                    rest *= 1 - share
                total += math.log10(p)
        out.append(total)
    return out


def test_context_tree_scores(spark):
    texts = [(k, ("the cat sat on thé mat " * (k % 4 + 1))[k % 5 :]) for k in range(40)] + [(40, ""), (41, None), (None, "No number"), (3, "twice"), (3, "twice"), (42, "zzz \x00 qqq \n\n")]
    d = spark.createDataFrame(texts, "doc_id long, text string").withColumn("chunk", F.lit(9)).withColumn("held_out", F.lit("x"))
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    condition = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    rows = language_model.score(d, condition).collect()
    blobs = [((i, (t or "").encode())) for i, t in texts]
    train = [t for i, t in blobs if not fold(i)]
    words = collections.Counter(w for t in train for w in language_model.tokens(t))
    n, v = sum(words.values()), len(words)
    plain = lambda t: b" ".join(t.lower().split())
    scores = slow_tree_score([plain(t) for t in train], [plain(t) for _, t in blobs], language_model.DEPTH)
    want = sorted((str(i), fold(i), len(language_model.tokens(t)), round(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in language_model.tokens(t)), 6), round(s, 3)) for (i, t), s in zip(blobs, scores))
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], round(r["base_score"], 6), round(r["score"], 3)) for r in rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], rtol=1e-4, atol=0.01)
    assert {r["train_tokens"] for r in rows} == {n}
    assert language_model.score(d.limit(0), condition).count() == 0


def test_context_tree_scores_do_not_depend_on_chunks(spark, monkeypatch):
    rng = random.Random(23)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(30))) for _ in range(150)] + ["long " * 400, "", None]
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, t) for k, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    condition = F.coalesce(F.col("doc_id"), F.lit(0)) % 5 == 1

    def scored():
        found = language_model.score(d, condition).collect()
        return sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 2)) for r in found)

    whole = scored()
    monkeypatch.setattr(language_model, "CHUNK_BYTES", 400)
    monkeypatch.setattr(language_model, "SLICE_BYTES", 100)
    per_chunk = d.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    sizes = per_chunk.groupBy(language_model._chunk(per_chunk, 12).alias("chunk")).agg(F.sum(F.octet_length("text")).alias("n")).collect()
    assert len(sizes) > 12 and sorted(r["n"] for r in sizes)[-2] < 1200
    assert scored() == whole


def test_lookup_tables():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 48, 5000, dtype=np.uint64))
    values = rng.random(len(keys)).astype(np.float32)
    asked = rng.integers(0, len(keys), 20000)
    assert np.array_equal(language_model.Lookup(keys, values)(keys[asked]), values[asked])


def test_boosting_separates():
    rng = np.random.default_rng(2)
    x = rng.random((800, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = boosting.fit(x[:600], y[:600])
    assert np.mean((model.margin(x[600:]) > 0) == y[600:]) > 0.95
    assert boosting.fit(x[:0], y[:0]).margin(x[:2]).tolist() == [0.0, 0.0]


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><script>var x='<p>no</p>';</script></head><body>{body}</body></html>"


def story(k):
    return "".join(f"<p>Sentence {k} {j}, with some &amp; more words in it. And another one follows, here{j}.</p>" for j in range(4))


def test_extraction(spark):
    pages = [(k, f"http://h/{k}", page(f"<nav><ul><li><a href=/a>Home</a><li><a href=/b>News {k}</a></ul></nav><article><h1>Title {k}</h1>{story(k)}</article><footer>&copy; all rights {k}</footer>")) for k in range(40)]
    hard = page(f"<div class='cookie-notice'>We use cookies <button>OK</button></div>{'<main>'}<h1>Big &lt;news&gt;</h1><p>Some  white\n space, <b>bo</b>ld&nbsp;text that goes on for long.{story(7)}</main><aside class='sidebar'><a href=x>Other</a></aside><div id='comments'><p>I like it, thanks.</p></div><form><label>Mail</label><input></form>")
    pages += [(50, None, None), (51, "u", ""), (52, "u", hard), (52, "u", hard), (None, "u", "<p>unclosed <b>text")]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1))
    rows = html_text.extract(d, html_text.fit(d)).collect()
    assert len(rows) == len(pages)
    want = lambda k: " ".join(f"Sentence {k} {j}, with some & more words in it. And another one follows, here{j}." for j in range(4))
    by = {r["page_id"]: r["text"] for r in rows}
    assert [by[k] for k in range(40)] == [f"Title {k} {want(k)}" for k in range(40)]
    assert by[50] == by[51] == ""
    assert by[52] == "Big <news> Some white space, bold text that goes on for long. " + want(7)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert html_text.extract(d.limit(0), html_text.fit(d.limit(0))).count() == 0


def test_blocks_inside_inline_elements_are_kept():
    def whole(body):
        nodes = html_text.elements(html_text.parse(body))
        assert html_text.features(nodes)[0, 1] > 0
        return html_text.text_of(nodes, html_text.decode(nodes, np.full(len(nodes), 5.0)))

    assert whole("<div><a href=/x><h2>Title</h2></a><p>text</p></div>") == "Title text"
    assert whole("<font><p>one</p></font><span><div>two<i><p>three</p></i></div></span>") == "one two three"
    assert whole("<div><b>one<br><p>two</p><p>three</p></div><p>four") == "one two three four"
    assert whole("<table><tr><td><i>a<p>b</p><td>c</table><ul><li><a name=n>d<div>e</div><li>f</ul>") == "a b c d e f"
    assert whole("<p>seen</p><span hidden><div>not</div></span>") == "seen"
    # a dropped block inside an inline element goes alone
    nodes = html_text.elements(html_text.parse("<div><b>one<p>two</p><nav>off</nav><p>three</p></b></div>"))
    kept = html_text.decode(nodes, np.array([-5.0 if x.tag == "nav" else 5.0 for x in nodes]))
    assert html_text.text_of(nodes, kept) == "one two three"
    # a link around blocks counts as link text, an anchor that is never closed does not
    tally = lambda body: [html_text._tally(x)[:2] for x in html_text.elements(html_text.parse(body)) if x.tag == "h2"]
    assert tally("<a href=/x><h2>Title</h2></a><h2>Other</h2>") == [(5, 5), (5, 0)]
    assert tally("<div><a name=x><h2>Title</h2></div>") == [(5, 0)]
    # labels and training blocks see them as well
    nodes = html_text.elements(html_text.parse("<article><font><p>main text</p></font></article><footer><b><p>foot</p></b></footer>"))
    assert [x.tag for x, y in zip(nodes, html_text.plain_labels(nodes)) if y] == ["#root", "article", "p"]
    assert html_text._plain_blocks(nodes[0]) == (["main text"], ["foot"])


def test_head_without_end_tag():
    def whole(body):
        nodes = html_text.elements(html_text.parse(body))
        return html_text.text_of(nodes, html_text.decode(nodes, np.full(len(nodes), 5.0)))

    inner = "<meta charset=utf-8><title>t</title><link href=x><style>p{}</style><script>var x='<p>'</script>\n"
    body = "<article><h1>One</h1><p>two</article>"
    for page_ in (
        f"<html><head>{inner}<body>{body}</body></html>", f"<html><head>{inner}{body}", f"<head>{inner}</head><body>{body}",
        f"<html><head><title>t<body>{body}", f"<head><title>a <div> b</title></head>{body}", f"<html><head>{inner}<span>One</span><p>two</p>",
    ):
        assert whole(page_) == "One two"
    assert whole("<head><title>t</title>One two") == whole("<head><title>t</title>One<p>two") == "One two"
    nodes = html_text.elements(html_text.parse(f"<html><head>{inner}<body>{body}"))
    assert [x.tag for x in nodes] == ["#root", "html", "body", "article", "h1", "p"]
    assert html_text.plain_labels(nodes) == [1.0] * 6


def test_decoding_is_consistent_and_best():
    rng = random.Random(4)
    for _ in range(60):
        root = html_text.Node("#root")
        nodes = [root]
        for _ in range(6):
            parent = rng.choice(nodes)
            child = html_text.Node("div", (), parent)
            parent.parts.append(child)
            nodes.append(child)
        nodes = html_text.elements(root)
        margin = np.array([rng.uniform(-3, 3) for _ in nodes])
        kept = html_text.decode(nodes, margin)
        place = {id(n): k for k, n in enumerate(nodes)}

        def value(choice, margin=margin):
            return sum(-np.logaddexp(0, -m if c else m) for c, m in zip(choice, margin))

        def fits(choice, nodes=nodes, place=place):
            return choice[0] and all(not c or n.parent is None or choice[place[id(n.parent)]] for n, c in zip(nodes, choice))

        best = max((tuple(bool(b >> k & 1) for k in range(len(nodes))) for b in range(1 << len(nodes)) if fits([b >> k & 1 for k in range(len(nodes))])), key=value)
        assert abs(value(best) - value(kept)) < 1e-9 and fits(list(kept))


def _text(page):
    return " ".join(html_text.clean_text(html_text._inline(x)) for x in html_text.elements(html_text.parse(page)) if x.parts).split()


def test_pages_lose_nothing_behind_odd_tags():
    body = "<p>one <math><mi>x</mi><mo>+</mo></math> two</p><p>three</p>"
    for odd in ('<svg class="i"/>', "<svg class='i' />", "<iframe src=x />", "<p title=it's>", '<p title=5">', "<svg>", "<iframe>", '<a "x>', "<!-- a > b -->"):
        got = _text(f"<body><article>{odd}{body}</article></body>")
        assert got[:2] == ["one", "x+"] and got[-1] == "three", (odd, got)
    assert _text("<p>a</p><!-- never closed <p>b</p>") == ["a"] and set(_text("<p>a</p> b <!-- never")) == {"a", "b"}
    assert _text("<p>a</p><svg><path d='1'/>hid</svg><p>b</p>") == ["a", "b"]
    assert _text("<p>a<script>if (x<b && '</p>') {}</script>b</p>") == ["ab"]


def test_hostile_pages_take_linear_time():
    import time

    deep = html_text.parse("<p>" + "<b>" * 20_000 + "x")
    assert "".join(html_text._inline(deep.children()[0])) == "x"
    for page in ('<a "' * 250_000, '<a ="' * 200_000, "<a ='\"" * 150_000 + ">", "<svg>" * 200_000, "<title>" * 100_000, "<" * 1_000_000, "<a " * 300_000, "<!" * 400_000, "<a b=" * 200_000 + ">x"):
        start = time.time()
        html_text.parse(page)
        assert time.time() - start < 10, page[:12]
