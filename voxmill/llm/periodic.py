"""Periodic runs of words, by a suffix automaton with link-cut access.

A run is a longest stretch of words that repeats with its smallest period and holds it
``times`` times or more. Words are appended one by one to a suffix automaton. The suffix
links form a tree in which the path from the newest state to the root holds all suffixes of
the text so far; a link-cut tree keeps, as preferred paths, the stretches of that path with
one common last end. An access recolours the path with the new end, and each segment met
tells the distance to the previous end and the longest suffix that had it. A segment at
least as long as its distance is a square; one of ``times - 1`` distances is a run's end,
once the next word breaks the period. Together all accesses meet O(n log n) segments.

A run holds some window of ``least * (times - 1) / times`` words twice, and windows that
occur twice cover all of it. So the automaton reads only the stretches that such windows
cover, each by itself; text without a repeated window has no run. This loses nothing: a run
that a stretch's end would cut would be covered beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import bind, small, words
from voxmill.llm.windows import WORD, covered, numbered, repeated

LEAST, TIMES = 24, 3
RUN = "struct<start:long,length:long,period:long>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def automaton_runs(ids: list[int], least: int = LEAST, times: int = TIMES) -> Iterator[tuple[int, int, int]]:
    """Runs (start, length, period) of a sequence, by their ends.

    State 1 is the root, 0 stands for none. ``up`` holds a splay tree's parent or, at its
    root, the state above the path; ``end`` is read at the root of a splay tree and counts
    from 1. A copied state goes beside its original into the same path: both had one end.
    """
    n = len(ids)
    step: list[dict[int, int]] = [{}, {}]
    link, size, up, left, right, end = ([0, 0] for _ in range(6))
    last = 1

    def born(length: int, above: int, moves: dict[int, int]) -> int:
        step.append(moves)
        size.append(length)
        link.append(above)
        for table in (up, left, right, end):
            table.append(0)
        return len(step) - 1

    def rotate(x: int) -> None:
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def splay(x: int) -> None:
        top = x
        while (p := up[x]) and (left[p] == x or right[p] == x):
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                rotate(p if (left[g] == p) == (left[p] == x) else x)
                top = g
            else:
                top = p
            rotate(x)
        if top != x:
            end[x] = end[top]

    for i, word in enumerate(ids):
        new, p = born(size[last] + 1, 0, {}), last
        while p and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = step[p][word]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = born(size[p] + 1, link[q], dict(step[q]))
                while p and step[p].get(word) == q:
                    step[p][word] = copy
                    p = link[p]
                splay(q)
                if left[q]:
                    left[copy], up[left[q]] = left[q], copy
                left[q], up[copy] = copy, q
                link[q] = link[new] = copy
        up[new], last = link[new], new
        below, x = 0, new
        while x:
            splay(x)
            if end[x] and x != 1:
                distance = i + 1 - end[x]
                reach = size[x]
                if reach >= (times - 1) * distance and reach + distance >= least and (i + 1 == n or ids[i + 1] != ids[i + 1 - distance]):
                    yield i + 1 - reach - distance, reach + distance, distance
            if right[x]:
                end[right[x]] = end[x]
            right[x], below, x = below, x, up[x]
        end[below] = i + 1


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of word numbers, by start, then period."""
    width = -(-least * (times - 1) // times)
    starts = repeated(ids, width)
    if not len(starts):
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered(starts, width, len(ids)), [False]])))
    found = []
    for low, high in edges.reshape(-1, 2).tolist():
        found += [(low + s, length, period) for s, length, period in automaton_runs(ids[low:high].tolist(), least, times)]
    return sorted(found, key=itemgetter(0, 2))


def collapse(listed: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by spaces, without those that a run holds after its first period."""
    if not runs:
        return " ".join(listed)
    edges = np.zeros(len(listed) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    dropped = np.cumsum(edges[:-1]) > 0
    return " ".join([w for w, gone in zip(listed, dropped.tolist()) if not gone])


def find(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Rows (doc_id, n_words, runs, collapsed) of whole texts, one per row of ``docs``.

    ``runs`` lists all runs by start, then period; ``collapsed`` is the text with each run cut
    to its first period. Null and blank texts have no words and no runs. Other columns of
    ``docs`` are not read; repeated rows and null ids each keep their row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            made = []
            for text in batch.column(1).to_pylist():
                listed = WORD.findall(text or "")
                runs = runs_of(numbered(listed), least, times)
                made.append((len(listed), [dict(zip(("start", "length", "period"), r)) for r in runs], collapse(listed, runs)))
            counts, runs, texts = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def with_tail(doc_id: Column, text: Column) -> Column:
    """A tenth of the texts, by the id's crc32, with a periodic tail; the others, and those without an id, as they are.

    With h the crc32, g = h div 10 and n words: from word a = g % n on, word i becomes the
    original word a + (i - a) % p, where p = 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def changed(w: Column) -> Column:
        n = F.size(w)
        a = g % n

        def tail(s: Column) -> Column:
            return F.transform(w, lambda v, i: F.when(i < s["a"], v).otherwise(F.get(w, (s["a"] + (i - s["a"]) % s["p"]).cast("int"))))

        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        return F.when(n > 0, F.array_join(bind(F.struct(a.alias("a"), p.alias("p")), tail), " ")).otherwise("")

    return F.when(h % 10 == 0, bind(words(text), changed)).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """Rows (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) from those of :func:`find`.

    The run shown has the greatest length per period, compared exactly; ties go to the smallest
    start, then period. Without a run its columns are null.
    """
    better = (
        "aggregate(runs, CAST(NULL AS {run}), (b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)"
    ).format(run=RUN)  # runs come by start, then period, so the first of equals stays
    listed = "concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))"
    return found.withColumn("best", F.expr(better)).selectExpr(
        "doc_id", "CAST(size(runs) AS LONG) AS n_runs", "best.start AS start", "best.length AS length", "best.period AS period",
        "(1000 * best.length) DIV best.period AS exponent_milli", f"sha2({listed}, 256) AS runs_sha256", "sha2(collapsed, 256) AS collapsed_sha256",
    )
