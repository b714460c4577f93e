"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into segments. Two fingerprints within the distance agree in at
least one segment up to a small radius (pigeonhole), so each fingerprint enumerates
the small Hamming balls around its segments, fetches table entries with those values
and verifies the whole distance.

Equal fingerprints are one entry. A first pass links table entries to one leader per
segment value and contracts what is linked; the exact search then pairs only entries
of different contracted classes. Within one segment value the entries of its largest
class are met only by probes of other classes, so a large group of near copies costs
rows in proportion to its size, and no pair within it is enumerated again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import components, keep_best, stage, text_key

SEED = 42
BITS = 64
#: Shingles unpacked to bits at once; bounds memory for very long texts.
BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned 64-bit SimHash: bit set if set in over half of the shingle hashes; 0 without words."""
    listed = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not listed:
        return 0
    line = b" ".join(listed)
    ends = np.cumsum(np.fromiter(map(len, listed), np.int64, len(listed)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(listed))
    n = len(listed) - width + 1
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        raw = b"".join([digest(line[i:j], SEED) for i, j in zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist())])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """SimHash of given 64-bit hashes, as a signed long: bit set if set in over half of them."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        raw = hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, width: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, fp) for whole texts; fp is the fingerprint as a signed long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_signed(fingerprint(t, width)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], ["doc_id", "fp"])

    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _layout(distance: int, segments: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment; radius -1: the others suffice, it is not probed."""
    base, rest = divmod(distance, segments)
    out, shift = [], 0
    for k in range(segments):
        width = BITS // segments + (k < BITS % segments)
        out.append((shift, width, base if k <= rest else base - 1))
        shift += width
    return out


def _entry(k: int, shift: int, width: int, fp: Column, mask: Column | None = None) -> Column:
    value = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    return (value if mask is None else value.bitwiseXOR(mask)).bitwiseOR(F.lit(k << 40).cast("long"))


def _ball(k: int, shift: int, width: int, radius: int, fp: Column) -> Column:
    """Slots of all values of segment ``k`` within ``radius`` of its value in ``fp``."""
    masks = [sum(1 << i for i in chosen) for r in range(radius + 1) for chosen in combinations(range(width), r)]
    return F.transform(F.expr(f"array({', '.join(f'{m}L' for m in masks)})"), lambda mask: _entry(k, shift, width, fp, mask))


def _search(entries: DataFrame, distance: int, segments: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first links, classes that they make, found links between different classes) of distinct fingerprints ``fp``."""
    layout = _layout(distance, segments)
    fp = F.col("fp")
    held = entries.select("fp", F.explode(F.array(*[_entry(k, s, w, fp) for k, (s, w, _) in enumerate(layout)])).alias("slot"))
    lead = held.groupBy("slot").agg(F.min("fp").alias("lead"), F.count("*").alias("n")).where("n > 1").select("slot", "lead")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("lead"))) <= distance
    first = stage(held.join(lead, "slot").where((F.col("fp") != F.col("lead")) & near).select(F.col("fp").alias("a"), F.col("lead").alias("b")))
    known = components(first).withColumnRenamed("node", "fp")
    marked = stage(entries.select("fp").join(known, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label")))

    entry = F.explode(F.array(*[_entry(k, s, w, fp) for k, (s, w, _) in enumerate(layout)])).alias("slot")
    rows = marked.select("fp", "label", entry)
    sized = rows.groupBy("slot", "label").agg(F.count("*").alias("n"))
    largest = sized.groupBy("slot").agg(F.max_by("label", F.struct("n", "label")).alias("major"))
    listed = rows.join(largest, "slot").select("slot", "fp", "label", (F.col("label") == F.col("major")).alias("main"))

    balls = [_ball(k, s, w, r, fp) for k, (s, w, r) in enumerate(layout) if r >= 0]
    probes = marked.select("fp", "label", F.explode(F.concat(*balls)).alias("slot")).join(largest, "slot")
    wanted = F.when(F.col("label") == F.col("major"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    probes = probes.select("slot", F.col("fp").alias("a"), F.col("label").alias("from"), F.explode(wanted).alias("main"))
    found = probes.join(listed, ["slot", "main"]).where((F.col("from") != F.col("label")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= distance))
    return first, marked, found.select("a", F.col("fp").alias("b"), "from", "label")


def near_links(entries: DataFrame, distance: int = 4, segments: int = 3) -> DataFrame:
    """Links (a, b) that connect exactly what pairs of fingerprints within ``distance`` connect.

    ``entries`` holds distinct fingerprints ``fp``. More segments mean fewer probes and
    more chance candidates; the links found are complete for any number.
    """
    first, _, found = _search(entries, distance, segments)
    return found.select("a", "b").union(first).distinct()


def near_classes(entries: DataFrame, distance: int = 4, segments: int = 3) -> DataFrame:
    """Rows (fp, label) of all ``entries``: what :func:`near_links` connects has the smallest fp as label.

    The links found are contracted to links of the classes known before, as few as those are.
    """
    _, marked, found = _search(entries, distance, segments)
    merged = components(found, "from", "label").select(F.col("node").alias("label"), F.col("label").alias("top"))
    return marked.join(merged, "label", "left").select("fp", F.coalesce("top", "label").alias("label"))


def near_components(docs: DataFrame, distance: int = 4, width: int = 4, segments: int = 3) -> DataFrame:
    """Rows (doc_id, fp, component_id): the smallest doc_id reachable over links, itself included.

    Null doc_ids take part; a component of null ids only has a null id. Repeated rows
    stay. Columns of ``docs`` other than doc_id and text are not read.
    """
    made = stage(fingerprints(docs, width))
    entries = stage(made.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    placed = stage(entries.join(near_classes(entries, distance, segments), "fp"))
    heads = placed.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return made.join(placed.join(heads, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = 4, width: int = 4, segments: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one of the smallest doc_id.

    A row without a doc_id stays only if its group has no id at all. Of different texts with
    that id the one of the smallest hash stays, and of its repeated rows one.
    """
    groups = near_components(docs.select(text_key(F.col("text")).alias("doc_id"), "text"), distance, width, segments)
    return keep_best(docs, groups.select(F.col("doc_id").alias("k"), F.col("component_id").alias("label")).distinct())
