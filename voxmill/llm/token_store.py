"""Token ids in directly addressable codes, written as Parquet rows of segments.

A segment holds whole documents. Its ids are split into 8-bit chunks by level: level 0 has
the lowest chunk of every id; a bitmap marks the ids that go on, whose next chunks stand in
level 1 in the same order, and so forth. A rank directory counts the marks before every
``RANK_BITS`` bits, so the place of an id's next chunk is one directory entry and a count in
one block: any id is read without decoding its neighbours.

Segments carry the ids of their documents and where they end. Documents are in ascending
doc_id order over all segments (null ids first, then by the text's hash).
"""

from __future__ import annotations

import itertools
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from voxmill.llm.common import shared_folder, small

RANK_BITS = 512
SEGMENT_IDS = 1 << 20
PART_BYTES = 24 << 20
#: Words a process remembers at most before it starts anew.
MOST_WORDS = 1 << 19
SEGMENT = "part int, seq int, n_ids long, doc_ids array<long>, doc_ends array<long>, levels array<binary>, marks array<binary>, ranks array<binary>"


def encode_levels(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """(chunks, bitmaps, rank directories) by level."""
    levels, marks, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        levels.append((rest & 0xFF).astype(np.uint8).tobytes())
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS)) if len(more) else np.zeros(0, np.int64)
        marks.append(bits.tobytes())
        ranks.append(np.concatenate(([0], np.cumsum(blocks)[:-1])).astype("<u4").tobytes() if len(more) else b"")
        if not more.any():
            return levels, marks, ranks
        rest = rest[more] >> 8


def token_at(levels: list[bytes], marks: list[bytes], ranks: list[bytes], i: int) -> int:
    """Id number ``i`` of a segment, by one step per level."""
    value = 0
    for k, chunk in enumerate(levels):
        value |= chunk[i] << (8 * k)
        if not marks[k][i >> 3] >> (i & 7) & 1:
            return value
        block = i // RANK_BITS
        head = block * RANK_BITS // 8
        before = int.from_bytes(marks[k][head : (i >> 3) + 1], "little") & ((1 << (i - block * RANK_BITS)) - 1)
        i = int.from_bytes(ranks[k][4 * block : 4 * block + 4], "little") + before.bit_count()
    raise ValueError("the last level goes on")


def decode_levels(levels: list[bytes], marks: list[bytes], n: int) -> np.ndarray:
    """All ids of a segment, level by level from the deepest."""
    sizes = [n] + [0] * (len(levels) - 1)
    going = []
    for k in range(len(levels)):
        going.append(np.unpackbits(np.frombuffer(marks[k], np.uint8), count=sizes[k], bitorder="little").astype(bool) if sizes[k] else np.zeros(0, bool))
        if k + 1 < len(levels):
            sizes[k + 1] = int(going[k].sum())
    rest = np.zeros(0, np.uint32)
    for k in range(len(levels) - 1, -1, -1):
        mine = np.frombuffer(levels[k], np.uint8).astype(np.uint32)
        if k + 1 < len(levels):
            mine[going[k]] |= rest << 8
        rest = mine
    return rest


class _Known(dict):
    """Values by key, each made at its first use: one look-up per key."""

    __slots__ = ("make",)

    def __init__(self, make: Callable) -> None:
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Whole texts to ids, each distinct word once.

    White space never joins tokens in this vocabulary, so a text's ids are its words' ids in
    order. A word of plain Latin letters, digits and signs is cut into the pieces that the
    tokenizer's own pattern gives, and the tokenizer's model encodes each new piece; any
    other word goes through the whole tokenizer.
    """

    PLAIN = re.compile(r"[\x21-\x7e\xc0-\xff]+")
    #: The file's split pattern, for plain words.
    PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")

    def __init__(self, spec: str) -> None:
        self.whole = Tokenizer.from_str(spec)
        self.model = self.whole.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_text = {}
        for code in range(0xC0, 0x100):
            self.byte_text[code] = "".join(x for x, _ in level.pre_tokenize_str(chr(code)))
        for code in (0xD7, 0xF7):
            self.byte_text[code] = "".join(x for x, _ in level.pre_tokenize_str(chr(code)))
        self.words = _Known(self._ids)
        self.pieces = _Known(self._piece)

    def _piece(self, piece: str) -> bytes:
        return _little([t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.byte_text))])

    def _ids(self, word: bytes) -> bytes:
        if word.isalpha():  # A-Z and a-z only: one piece
            return self.pieces[word.lower().decode()]
        text = word.decode("utf-8", "surrogatepass")
        if "<|" in text or not self.PLAIN.fullmatch(text):
            return _little(self.whole.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.pieces.__getitem__, self.PIECE.findall(text.lower())))

    def __call__(self, text: str, end: int) -> bytes:
        """Little-endian 32-bit ids of a text and the end id."""
        words = text.encode("utf-8", "surrogatepass").split()  # splits at plain white space only
        made = b"".join(map(self.words.__getitem__, words)) + end.to_bytes(4, "little")
        if len(self.words) > MOST_WORDS:
            self.words.clear()
            self.pieces.clear()
        return made


@lru_cache(maxsize=1)
def encoder_of(spec: str) -> Encoder:
    """The encoder of a process: its later tasks find the words that its earlier ones made."""
    return Encoder(spec)


def _little(ids: list[int]) -> bytes:
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


def write(docs: DataFrame, path: str, spec: str, end_id: int = 2) -> None:
    """Write the ids of whole texts, each document closed by ``end_id``, as segments in ``path``.

    ``spec`` is the tokenizer's file as text, so executors need no file of their own. Null and
    empty texts are the end id alone; repeated rows are written as often as they occur.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))  # null ids are ordered by text alone
    parts = rows.repartitionByRange(max(12, -(-size // PART_BYTES)), F.asc_nulls_first("doc_id"), spread.asc()).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder_of(shared.value), TaskContext.get().partitionId(), itertools.count()
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        ends: list[int] = []
        total = 0

        def segment() -> pa.RecordBatch:
            levels, marks, ranks = encode_levels(np.frombuffer(b"".join(ids), "<u4"))
            row = [part], [next(seq)], [total], [list(doc_ids)], [list(ends)], [levels], [marks], [ranks]
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.list_(pa.binary())] * 3
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], ["part", "seq", "n_ids", "doc_ids", "doc_ends", "levels", "marks", "ranks"])

        for batch in small(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made = encode(text, end_id)
                total += len(made) // 4
                ids.append(made)
                doc_ids.append(doc_id)
                ends.append(total)
                if total >= SEGMENT_IDS:
                    yield segment()
                    ids, doc_ids, ends, total = [], [], [], 0
        if doc_ids:
            yield segment()

    parts.mapInArrow(run, SEGMENT).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``seg_start``, the number of ids before each."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))  # one row per written part
    inside = segments.select("part", "seq", (F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("before"))
    placed = inside.join(starts, "part").select(F.col("part").alias("_p"), F.col("seq").alias("_s"), (F.col("part_start") + F.col("before")).alias("seg_start"))
    return segments.join(placed, (F.col("part") == F.col("_p")) & (F.col("seq") == F.col("_s"))).drop("_p", "_s")


def documents(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32[, ids]) of all documents in segments from :func:`read`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_levels(row["levels"], row["marks"], row["n_ids"]).astype("<u4")
                ends = np.array(row["doc_ends"], np.int64)
                begins = np.concatenate(([0], ends[:-1]))
                cut = [ids[a:b] for a, b in zip(begins, ends)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(begins + row["seg_start"]), pa.array(ends - begins), pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return segments.select("n_ids", "doc_ids", "doc_ends", "levels", "marks", "seg_start").mapInArrow(run, schema)


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
