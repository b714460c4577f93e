"""Document fingerprints by order MinHash.

The k-mers of a text are numbered by occurrence, so each is one element. Hash space is
cut into bins; every bin selects its ``tuple_size`` minimal elements, puts them back into
text order and hashes that tuple. Equal tuples need the same minimal elements in the same
order, so the share of equal bins falls with the edit distance, not only with the set of
k-mers that two texts have in common.

Each text is handled inside its own row with array functions: k-mer hashes are packed with
their position into one long, sorted (which groups bins, and repeats of a k-mer by
position), numbered, and cut to the minimal ones. Nothing but the text itself is shuffled,
and only where a text has to meet its neighbour.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxmill.llm.common import bind, stage, words
from voxmill.llm.ranges import cuts_of, place_of

BINS = 64
#: Low bits of a packed element hold the position; texts of more k-mers hold elements as (hash, position).
POSITION_BITS = 20
BIN_SHIFT = 58
LOW, HIGH = (1 << POSITION_BITS) - 1, ~((1 << POSITION_BITS) - 1)


@dataclass(frozen=True)
class Form:
    """How an element holds its hash and its position; elements sort by hash, then position."""

    pack: Callable[[Column, Column], Column]
    hash: Callable[[Column], Column]
    place: Callable[[Column], Column]
    type: str


#: One long for both. The hash is cut to the high bits in either form, so both give the same signature.
LONGS = Form(lambda h, p: h.bitwiseAND(F.lit(HIGH)).bitwiseOR(p.cast("long")), lambda x: x.bitwiseAND(F.lit(HIGH)), lambda x: x.bitwiseAND(F.lit(LOW)), "bigint")
PAIRS = Form(lambda h, p: F.struct(h.bitwiseAND(F.lit(HIGH)).alias("h"), p.cast("long").alias("p")), lambda x: x["h"], lambda x: x["p"], "struct<h:bigint,p:bigint>")


def _elements(listed: Column, k: int, form: Form) -> Column:
    """One element per k-mer. Fewer words than k make one k-mer of all."""
    n = F.size(listed) - (k - 1)
    full = F.transform(F.sequence(F.lit(0), n - 1), lambda i: form.pack(F.xxhash64(*[listed[i + j] for j in range(k)]), i))
    short = F.array(form.pack(F.xxhash64(F.concat_ws(" ", listed)), F.lit(0)))
    return F.when(n > 0, full).when(F.size(listed) > 0, short).otherwise(F.array().cast(f"array<{form.type}>"))


def _numbered(elements: Column, form: Form) -> Column:
    """Sorted elements: a first occurrence keeps its hash, occurrence n of a k-mer is hashed with n.

    ``elements`` is sorted, so repeats are neighbours; the rank of one among them comes from a
    binary search for the first, made for repeats only.
    """
    n = F.size(elements)
    is_repeat = lambda i: (i > 0) & (form.hash(elements[i]) == form.hash(elements[F.greatest(i - 1, F.lit(0))]))
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def first_of(i: Column) -> Column:
        base = form.hash(elements[i])
        steps = F.sequence(F.lit(1), F.ceil(F.log2(n + 1)).cast("int") + 1)

        def halve(s: Column, _: Column) -> Column:
            middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            left = form.hash(elements[middle]) >= base
            going = s["lo"] < s["hi"]
            return F.struct(F.when(going & ~left, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(going & left, middle).otherwise(s["hi"]).alias("hi"))

        return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), i.alias("hi")), halve, lambda s: s["lo"])

    firsts = F.filter(elements, lambda x, i: ~is_repeat(i))
    again = F.transform(F.filter(every, is_repeat), lambda i: form.pack(F.xxhash64(form.hash(elements[i]), i - first_of(i)), form.place(elements[i])))
    has_repeat = F.exists(every, is_repeat)
    return F.when(has_repeat, F.sort_array(F.concat(firsts, again))).otherwise(elements)


def _tuples(elements: Column, size: int, form: Form) -> Column:
    """Array of (bin, hash of the ordered tuple) as packed longs: bin above, hash below."""
    bin_of = lambda x: F.shiftrightunsigned(form.hash(x), BIN_SHIFT)
    least = F.filter(elements, lambda x, i: (i < size) | (bin_of(elements[F.greatest(i - size, F.lit(0))]) != bin_of(x)))

    def made(chosen: Column) -> Column:
        n = F.size(chosen)
        every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        heads = F.filter(every, lambda i: (i == 0) | (bin_of(chosen[F.greatest(i - 1, F.lit(0))]) != bin_of(chosen[i])))

        def signed(i: Column) -> Column:
            mine = F.filter(F.slice(chosen, i + 1, F.lit(size)), lambda x: bin_of(x) == bin_of(chosen[i]))
            by_place = F.array_sort(F.transform(mine, lambda x: F.struct(form.place(x).alias("p"), form.hash(x).alias("h"))))
            mixed = F.aggregate(by_place, F.lit(42).cast("long"), lambda s, x: F.xxhash64(s, x["h"]))
            return F.shiftleft(bin_of(chosen[i]), BIN_SHIFT).bitwiseOR(F.shiftrightunsigned(mixed, 64 - BIN_SHIFT))

        return F.transform(heads, signed)

    return bind(least, made)


def _signed(listed: Column, k: int, size: int, form: Form) -> Column:
    return bind(F.sort_array(_elements(listed, k, form)), lambda p: bind(_numbered(p, form), lambda e: _tuples(e, size, form)))


def signature(text: Column, k: int = 3, tuple_size: int = 2, packed_words: int = 1 << POSITION_BITS) -> Column:
    """Array of longs, one for each bin that has an element, ordered by bin; empty for a blank or null text.

    Elements of texts of more than ``packed_words`` words, whose positions may not fit a packed
    long, are held as pairs; the signature does not depend on it.
    """
    fits = lambda w: F.size(w) <= min(packed_words, 1 << POSITION_BITS)
    return bind(words(text), lambda w: F.when(fits(w), _signed(w, k, tuple_size, LONGS)).otherwise(_signed(w, k, tuple_size, PAIRS)))


def as_text(sign: Column) -> Column:
    """Fingerprint as text: for each of the bins 12 hex digits, dashes where it is empty."""
    held = F.map_from_arrays(F.transform(sign, lambda x: F.shiftrightunsigned(x, BIN_SHIFT)), F.transform(sign, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit((1 << 48) - 1))), 12, "0"))))
    return bind(held, lambda m: F.concat_ws("", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), lambda b: F.coalesce(m[b], F.lit("-" * 12)))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among bins that either signature fills; 1 for two empty ones."""
    bins = lambda s: F.transform(s, lambda x: F.shiftrightunsigned(x, BIN_SHIFT))
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled).cast("double")


def with_next(docs: DataFrame, extra: Column, rows_in_block: int = 400) -> DataFrame:
    """Rows (doc_id, text, extra, next_text, next_extra): the next row by descending doc_id, after the last the first.

    ``extra`` is computed from ``text`` once for each row. Null texts are empty. Rows are laid
    into blocks of neighbouring ids, a window works within a block, and a block's last row
    takes the first row of the next block. There are at most 16,384 such first rows, whatever
    the input. Rows of one doc_id follow each other by their text's hash; null ids come last.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = cuts_of(rows, "doc_id", rows.select("doc_id").count() // rows_in_block)
    place = place_of(cuts, F.col("doc_id"))
    # Blocks count upward in the order of the walk: from the largest ids to the null ones.
    block = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - place)
    first_ids = rows.select("doc_id", block.alias("block")).groupBy("block").agg(F.max("doc_id").alias("first_id"))
    fits = rows["doc_id"].eqNullSafe(first_ids["first_id"])
    starts = rows.join(F.broadcast(first_ids), fits).groupBy("block").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    starts = starts.select("block", F.struct("text", extra.alias("extra")).alias("head"))
    along = W.orderBy("block")
    heads = stage(starts.select("block", F.coalesce(F.lead("head").over(along), F.first("head").over(along)).alias("head")))
    walk = W.partitionBy("block").orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    inside = rows.select("doc_id", "text", extra.alias("extra"), block.alias("block"))
    inside = inside.withColumn("next", F.lead(F.struct("text", "extra")).over(walk))
    joined = inside.join(heads.hint("merge"), "block")
    following = F.coalesce("next", "head")
    return joined.select("doc_id", "text", "extra", following["text"].alias("next_text"), following["extra"].alias("next_extra"))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last third of code points replaced by as many first ones of ``following``, or all of them."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - third).cast("int")), F.substring(following, F.lit(1), third))


def compare(docs: DataFrame, k: int = 3, tuple_size: int = 2) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's."""
    made = with_next(docs, signature(F.col("text"), k, tuple_size))
    made = made.select("doc_id", "text", "extra", "next_extra", edited(F.col("text"), F.col("next_text")).alias("edited"))
    signed = made.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("extra").alias("a"), signature(F.col("edited"), k, tuple_size).alias("b"), F.col("next_extra").alias("c"),
    )
    return signed.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
