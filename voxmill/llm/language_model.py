"""Language-model scores by context-tree weighting, with a smoothed word model as base.

Base and model see the same text: its lower-cased (A-Z) words with single spaces and an
end. The model predicts it byte by byte, each byte as eight binary decisions, after up to
``DEPTH`` preceding bytes. For each decision every depth has a Krichevsky-Trofimov estimate
from the training texts; the context tree weights a node's own estimate against the product
of its children by their evidence, so a prediction mixes all depths. The sum of the
decisions' logarithms is the text's code length.

Work is dealt in two ways. Texts are cut into chunks of about equal bytes by doc_id, and by text
within ranges of ids that hold more; a chunk's distinct words and byte runs leave it as sorted, packed binary columns, one per hash bucket, so what is shuffled is each
chunk's vocabulary, not each occurrence. Buckets sum the training counts over chunks, trees
are weighted in groups of their two latest bytes, and values return to the chunks that asked,
which score their whole texts by lookup. Nothing of the model is broadcast but the two
topmost levels, at most 256 x 256 numbers.

Words and byte runs are told apart by 64-bit keys: exact for byte runs, a hash for words.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import small, stage
from voxmill.llm.ranges import cuts_of, place_of

DEPTH = 5
#: Bytes that UTF-8 never contains: before a text's first byte, and after its last.
PAD, END = 0xFE, 0xFF
CHUNK_BYTES = 12 << 20
BLOCK_BYTES = 4 << 20
#: Text scored at once.
SLICE_BYTES = 2 << 20
WORDS, RUNS = 0, 1
#: The end of a text as a token; no word contains white space.
END_TOKEN = b"\n"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split() + [END_TOKEN]


def normal(listed: list[bytes]) -> bytes:
    """The text that the model scores: a text's lower-cased words, one space between them."""
    return b" ".join(listed[:-1])


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def run_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, predicted, starts): key of each position, latest context byte on top and the byte itself lowest."""
    pad = bytes([PAD]) * DEPTH
    line = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8)
    sizes = np.fromiter((len(t) + DEPTH + 1 for t in texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    predicted = np.ones(len(line), bool)
    predicted[(starts[:, None] + np.arange(DEPTH)[None, :]).ravel()] = False
    keys = line.astype(np.uint64)
    for back in range(1, DEPTH + 1):
        keys[back:] |= line[:-back].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - back))
    return keys, predicted, starts


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    made, place = np.unique(all_keys, return_inverse=True)
    return made, np.bincount(place, all_counts, len(made)).astype(np.int64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys * _MIX) >> np.uint64(33)).astype(np.int64) % buckets


def planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side; runs of zeros then vanish wherever blocks are compressed."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as planes of their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def _blobs(kind: int, chunk: int, keys: np.ndarray, values: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row per bucket: its sorted keys and their values as bytes."""
    where = bucket_of(keys, buckets)
    order = np.lexsort((keys, where))
    keys, values, where = keys[order], values[order], where[order]
    edges = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(keys) else np.zeros(0, np.int64)
    ends = np.r_[edges[1:], len(keys)]
    n = len(edges)
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * n, pa.int32()), pa.array([chunk] * n, pa.int64()), pa.array(where[edges], pa.int64()), pa.array([pack_keys(keys[a:b]) for a, b in zip(edges, ends)], pa.binary()), pa.array([planes(values[a:b]) for a, b in zip(edges, ends)], pa.binary())],
        names=["kind", "chunk", "bucket", "keys", "vals"],
    )


BLOB = "kind int, chunk long, bucket long, keys binary, vals binary"


class _Gathered:
    """Vocabulary of a chunk so far."""

    def __init__(self) -> None:
        self.words: Counter[bytes] = Counter()
        self.held: set[bytes] = set()
        self.texts: dict[bool, list[bytes]] = {False: [], True: []}
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.waiting = self.size = 0

    def add(self, text: bytes, held: bool) -> None:
        listed = tokens(text)
        if held:
            self.held.update(listed)
        else:
            self.words.update(listed)
        self.texts[held].append(normal(listed))
        self.waiting += len(text)
        self.size += len(text)
        if self.waiting >= BLOCK_BYTES:
            self.settle()

    def settle(self) -> None:
        for held, texts in self.texts.items():
            if texts:
                keys, predicted, _ = run_keys(texts)
                made, n = np.unique(keys[predicted], return_counts=True)
                self.keys.append(made)
                self.counts.append(np.zeros(len(made), np.int64) if held else n)
                texts.clear()
        self.waiting = 0

    def blobs(self, chunk: int, buckets: int) -> Iterator[pa.RecordBatch]:
        self.settle()
        yield _blobs(RUNS, chunk, *_summed(self.keys, self.counts), buckets)
        listed = list(self.words) + [w for w in self.held if w not in self.words]
        counted = np.fromiter((self.words[w] for w in listed), np.int64, len(listed))
        yield _blobs(WORDS, chunk, *_summed([word_keys(listed)], [counted]), buckets)


def gather(chunked: DataFrame, buckets: int) -> DataFrame:
    """Blobs of training counts; what only held-out texts have is listed with count zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_chunks: defaultdict[int, _Gathered] = defaultdict(_Gathered)
        for batch in small(batches):
            for chunk, held, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = open_chunks[chunk]
                found.add(text.encode("utf-8", "surrogatepass"), held)
                if found.size >= 1.25 * CHUNK_BYTES:
                    yield from open_chunks.pop(chunk).blobs(chunk, buckets)
            if sum(x.size for x in open_chunks.values()) >= 1.25 * CHUNK_BYTES:
                for chunk in list(open_chunks):
                    yield from open_chunks.pop(chunk).blobs(chunk, buckets)
        for chunk, found in open_chunks.items():
            yield from found.blobs(chunk, buckets)

    return chunked.select("chunk", "held_out", "text").mapInArrow(run, BLOB)


def _read(table: pa.Table, value_type: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, key, value) of all entries of some blobs."""
    keys = [unpack_keys(x) for x in table.column("keys").to_pylist()]
    vals = [from_planes(x, value_type) for x in table.column("vals").to_pylist()]
    chunks = np.repeat(table.column("chunk").to_numpy(), [len(k) for k in keys])
    none = np.zeros(0)
    return chunks, np.concatenate(keys or [none.astype(np.uint64)]), np.concatenate(vals or [none.astype(value_type)])


def _by_chunk(kind: int, bucket: int, chunks: np.ndarray, keys: np.ndarray, values: np.ndarray) -> pa.Table:
    order = np.lexsort((keys, chunks))
    chunks, keys, values = chunks[order], keys[order], values[order]
    same = np.r_[False, (chunks[1:] == chunks[:-1]) & (keys[1:] == keys[:-1])] if len(keys) else np.zeros(0, bool)
    chunks, keys, values = chunks[~same], keys[~same], values[~same]
    edges = np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1]]) if len(keys) else np.zeros(0, np.int64)
    ends, n = np.r_[edges[1:], len(keys)], len(edges)
    return pa.table([
        pa.array([kind] * n, pa.int32()), pa.array(chunks[edges], pa.int64()), pa.array([bucket] * n, pa.int64()),
        pa.array([pack_keys(keys[a:b]) for a, b in zip(edges, ends)], pa.binary()), pa.array([planes(values[a:b]) for a, b in zip(edges, ends)], pa.binary()),
    ], names=["kind", "chunk", "bucket", "keys", "vals"])


def sum_words(key: tuple, table: pa.Table) -> pa.Table:
    """Counts of a bucket's words over all chunks, returned to each chunk; one row (chunk -1) holds (tokens, distinct)."""
    chunks, keys, n = _read(table, np.int64)
    made, place = np.unique(keys, return_inverse=True)
    total = np.bincount(place, n, len(made)).astype(np.int64)
    bucket = key[0].as_py()
    out = _by_chunk(WORDS, bucket, chunks, keys, total[place])
    return pa.concat_tables([out, _by_chunk(WORDS, bucket, np.array([-1]), np.array([0], np.uint64), np.array([0], np.int64)).set_column(4, "vals", pa.array([np.array([total.sum(), (total > 0).sum()], np.int64).tobytes()], pa.binary()))])


def sum_runs(key: tuple, table: pa.Table) -> pa.Table:
    _, keys, n = _read(table, np.int64)
    made, total = _summed([keys], [n])
    return pa.table([pa.array(made.astype(np.int64)), pa.array(total), pa.array((made >> np.uint64(8 * (DEPTH - 1))).astype(np.int64))], names=["key", "n", "top"])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for _ in range(7):
        shift -= np.log(x)
        x = x + 1
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def kt_evidence(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives to n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - math.log(math.pi) - _log_gamma(n0 + n1 + 1.0)


def weigh(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log weighted probability, weight of the own estimate) of inner nodes."""
    most = np.maximum(own, children)
    a, b = np.exp(own - most), np.exp(children - most)
    return most + np.log(0.5 * a + 0.5 * b), a / (a + b)


def weigh_subtree(key: tuple, table: pa.Table) -> pa.Table:
    """Depths 2 and more of all trees that share their two latest bytes.

    Returns for each byte run the mixed estimates of its eight decisions from depth 2 down,
    and for each decision node of depth 2 its counts and weighted probability (key null).
    """
    keys, n = table.column("key").to_numpy().astype(np.uint64), table.column("n").to_numpy().astype(float)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    byte = keys & np.uint64(0xFF)
    levels = []
    for d in range(2, DEPTH + 1):
        made, place = np.unique(((keys >> np.uint64(8 * (DEPTH + 1 - d))) << np.uint64(8)) | byte, return_inverse=True)
        levels.append((made, place, np.bincount(place, n, len(made))))
    mixed = np.zeros((len(keys), 8), np.float32)
    tops: list[tuple[np.ndarray, ...]] = []
    for j in range(8):
        bit = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
        nodes, evidence, below = [], None, None
        for made, place, counted in levels:
            node = np.r_[0, np.cumsum(np.diff(made >> np.uint64(8 - j)) != 0)]
            one = ((made >> np.uint64(7 - j)) & np.uint64(1)).astype(float)
            n1 = np.bincount(node, counted * one)
            nodes.append((node[place], np.bincount(node, counted) - n1, n1))
        result = None
        for at in range(len(nodes) - 1, -1, -1):
            mine, n0, n1 = nodes[at]
            own, p1 = kt_evidence(n0, n1), (n1 + 0.5) / (n0 + n1 + 1)
            p = np.where(bit, p1[mine], 1 - p1[mine])
            if result is None:
                evidence, result = own, p
            else:
                parent = np.zeros(len(evidence), np.int64)
                parent[below] = mine
                evidence, share = weigh(own, np.bincount(parent, evidence, len(own)))
                result = share[mine] * p + (1 - share[mine]) * result
            below = mine
        mixed[:, j] = result
        first = np.unique(below, return_index=True)[1]
        prefix = (np.uint64(1) << np.uint64(j)) | (byte[first] >> np.uint64(8 - j))
        tops.append((prefix, nodes[0][1], nodes[0][2], evidence))
    prefix, n0, n1, evidence = (np.concatenate([t[k] for t in tops]) for k in range(4))
    latest, m = int(keys[0] >> np.uint64(8 * DEPTH)), len(prefix)
    nothing = np.zeros(len(keys))
    return pa.table([
        pa.array(np.r_[keys.astype(np.int64), np.zeros(m, np.int64)], mask=np.r_[np.zeros(len(keys), bool), np.ones(m, bool)]),
        pa.array([r.tobytes() for r in mixed] + [None] * m, pa.binary()),
        pa.array([latest] * (len(keys) + m), pa.int32()), pa.array(np.r_[nothing, prefix].astype(np.int32)),
        pa.array(np.r_[nothing, n0]), pa.array(np.r_[nothing, n1]), pa.array(np.r_[nothing, evidence]),
    ], names=["key", "mixed", "latest", "prefix", "n0", "n1", "evidence"])


def top_levels(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """(base, rest) by latest byte and decision prefix: a one has probability base + rest * deeper mix of a one."""
    n0, n1, below = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
    for r in rows:
        n0[r["latest"], r["prefix"]], n1[r["latest"], r["prefix"]], below[r["latest"], r["prefix"]] = r["n0"], r["n1"], r["evidence"]
    weighted, share1 = weigh(kt_evidence(n0, n1), below)
    r0, r1 = n0.sum(0), n1.sum(0)
    _, share0 = weigh(kt_evidence(r0, r1), weighted.sum(0))
    p0, p1 = (r1 + 0.5) / (r0 + r1 + 1), (n1 + 0.5) / (n0 + n1 + 1)
    return share0[None, :] * p0[None, :] + (1 - share0)[None, :] * share1 * p1, (1 - share0)[None, :] * (1 - share1)


class Lookup:
    """Values of integer keys from hash tables of falling size; all keys asked for are known or give zero."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.levels = []
        while len(keys):
            bits = max(4, int(2 * len(keys) - 1).bit_length())
            slot = self._slot(keys, bits)
            table, held = np.full(1 << bits, ~np.uint64(0)), np.zeros(1 << bits, values.dtype)
            table[slot], held[slot] = keys, values
            self.levels.append((bits, table, held))
            lost = table[slot] != keys
            keys, values = keys[lost], values[lost]

    def _slot(self, keys: np.ndarray, bits: int) -> np.ndarray:
        odd = _MIX + np.uint64(2 * len(self.levels))
        with np.errstate(over="ignore"):
            return (keys * odd) >> np.uint64(64 - bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, ask = None, None
        for level, (bits, table, held) in enumerate(self.levels):
            with np.errstate(over="ignore"):
                slot = (keys * (_MIX + np.uint64(2 * level))) >> np.uint64(64 - bits)
            found, hit = held[slot], table[slot] == keys
            if out is None:
                out = np.where(hit, found, 0)
                ask = np.flatnonzero(~hit)
            else:
                out[ask[hit]] = found[hit]
                ask = ask[~hit]
            keys = keys[~hit]
            if not len(keys):
                break
        return out if out is not None else np.zeros(len(keys))


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _slices(texts: pa.ChunkedArray) -> Iterator[pa.Array]:
    """The texts in order, in slices of about ``SLICE_BYTES``; a longer text is a slice of its own."""
    for part in texts.chunks:
        ends = np.cumsum(pc.binary_length(part).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(part):
            start = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, start + SLICE_BYTES, "right")))
            yield part.slice(at, to - at)
            at = to


def _score_chunk(total: int, distinct: int):
    unit = math.log10(total + distinct + 1)

    def run(docs: pa.Table, blobs: pa.Table) -> pa.Table:
        if docs.num_rows == 0:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=[c.split()[0] for c in SCORED.split(", ")])
        kinds = blobs.column("kind").to_numpy()
        _, run_key, run_value = _read(blobs.filter(pa.array(kinds == RUNS)), np.float32)
        runs = Lookup(run_key, run_value)
        del run_key, run_value
        _, word_key, word_n = _read(blobs.filter(pa.array(kinds == WORDS)), np.int64)
        del blobs
        order = np.argsort(word_key)
        word_key, word_n = word_key[order], word_n[order]
        made: list[list[float]] = [[], [], [], []]
        for part in _slices(docs.column("text")):
            place: defaultdict[bytes, int] = defaultdict(count().__next__)
            texts, listed = [], []
            for text in part.to_pylist():
                words = tokens(text.encode("utf-8", "surrogatepass"))
                texts.append(normal(words))
                listed.append(np.fromiter((place[w] for w in words), np.int64, len(words)))
            counted = word_n[np.searchsorted(word_key, word_keys(list(place)))]
            value = np.log10(counted + 1.0)
            asked, predicted, starts = run_keys(texts)
            gained = np.zeros(len(asked))
            gained[predicted] = runs(asked[predicted])
            made[0] += [len(x) for x in listed]
            made[1] += [int((counted[x] > 0).sum()) for x in listed]
            made[2] += [float(value[x].sum() - len(x) * unit) for x in listed]
            made[3] += np.add.reduceat(gained, starts).tolist()
        kept = [docs.column("doc_id"), docs.column("held_out")]
        return pa.table(kept + [pa.array(x, t) for x, t in zip(made, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=[c.split()[0] for c in SCORED.split(", ")])

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The (tokens, distinct) pairs of buckets as numbers."""
    for batch in batches:
        both = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["t", "d"])


def _chunk(rows: DataFrame, parts: int) -> Column:
    """Chunk of a row (doc_id, text): ranges of ids with about equal numbers of rows, those of many bytes cut by text.

    So neither long texts, nor rows of one id or without an id, nor more parts than ranges make a chunk large;
    only equal texts of one range, and a single long text, stay whole.
    """
    cuts = cuts_of(rows, "doc_id", parts)
    spot = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(place_of(cuts, F.col("doc_id"))).cast("int")
    sized = rows.groupBy(spot.alias("spot")).agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).collect()  # at most 16,385 rows
    shares = [1] * (len(cuts) + 2)
    for r in sized:
        shares[r["spot"]] = max(1, -(-int(r["bytes"]) // (CHUNK_BYTES + CHUNK_BYTES // 2)))
    first = np.concatenate(([0], np.cumsum(shares)[:-1])).tolist()
    share = F.expr(f"array({', '.join(f'{c}L' for c in shares)})")[spot]
    return (F.expr(f"array({', '.join(f'{c}L' for c in first)})")[spot] + F.pmod(F.xxhash64("text"), share)).cast("long")


def score(docs: DataFrame, held_out, least_chunks: int = 12) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of ``docs``.

    ``held_out`` is a condition on doc_id; where it is null the text trains. Null texts are
    empty: their score is that of an end after nothing. Repeated rows count as often as they
    occur. Without any training text all estimates are uniform.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(least_chunks, -(-size // CHUNK_BYTES))
    chunked = rows.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"), _chunk(rows, parts).alias("chunk"))
    buckets = max(24, parts)

    gathered = stage(gather(chunked, buckets))
    asked = gathered.where(F.col("kind") == RUNS)
    words = stage(gathered.where(F.col("kind") == WORDS).groupBy("bucket").applyInArrow(sum_words, BLOB))
    sums = words.where("chunk = -1").select("vals").mapInArrow(_pairs, "t long, d long").agg(F.sum("t"), F.sum("d")).first()
    total, distinct = (int(x or 0) for x in sums)

    counted = asked.groupBy("bucket").applyInArrow(sum_runs, "key long, n long, top long")
    trees = stage(counted.groupBy("top").applyInArrow(weigh_subtree, "key long, mixed binary, latest int, prefix int, n0 double, n1 double, evidence double"))
    upper = trees.where("key is null").groupBy("latest", "prefix").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("evidence").alias("evidence"))
    base, rest = top_levels(upper.collect())  # at most 256 x 255 rows

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().astype(np.uint64)
            mixed = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, 8).astype(float)
            latest, byte = (keys >> np.uint64(8 * DEPTH)).astype(np.int64), (keys & np.uint64(0xFF)).astype(np.int64)
            made = np.zeros(len(keys))
            for j in range(8):
                prefix, bit = (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1
                a, r = base[latest, prefix], rest[latest, prefix]
                made += np.log10(np.where(bit == 1, a, 1 - a - r) + r * mixed[:, j])
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(keys, buckets)), pa.array(keys.astype(np.int64)), pa.array(made)], ["bucket", "key", "value"])

    values = trees.where("key is not null").select("key", "mixed").mapInArrow(finish, "bucket long, key long, value double")

    def answer(key: tuple, blobs: pa.Table, found: pa.Table) -> pa.Table:
        known, value = found.column("key").to_numpy().astype(np.uint64), found.column("value").to_numpy()
        order = np.argsort(known)
        chunks, keys, _ = _read(blobs, np.int64)
        if not len(keys):
            return _by_chunk(RUNS, 0, chunks.astype(np.int64), keys, np.zeros(0, np.float32))
        return _by_chunk(RUNS, key[0].as_py(), chunks, keys, value[order][np.searchsorted(known[order], keys)].astype(np.float32))

    answered = asked.groupBy("bucket").cogroup(values.groupBy("bucket")).applyInArrow(answer, BLOB)
    lookups = words.where("chunk >= 0").union(answered).select("kind", "chunk", "keys", "vals")
    scored = chunked.groupBy("chunk").cogroup(lookups.groupBy("chunk")).applyInArrow(_score_chunk(total, distinct), SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
