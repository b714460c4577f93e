"""Quality rules as a learned decision list.

Every text is measured by a few readable statistics. From labelled texts, sequential covering
grows one rule at a time: a conjunction of thresholds that takes on the bad texts not
covered yet, condition by condition, by information gain; a part of the texts kept aside
prunes it, condition by condition from the end; and the list ends when a rule no longer pays
on that part. The finished list is an ordered Spark conditional expression over the statistics
columns, so it is applied where the statistics are made, without a model in Python.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import sampled, small
from voxmill.llm.windows import WORD, covered, numbered, repeated

#: Counted columns of a text, all exact.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_other", "n_distinct", "longest_word", "n_ended", "n_capital", "n_doubled")
#: Symbols that markup and tables leave, and marks that end a sentence.
SYMBOLS = "#*$%&|<>"
ENDS = (".", "!", "?", "…", "。")
BLANK = frozenset(" \t\n\x0b\x0c\r")
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20

#: Statistics that rules may test, as SQL over the counts; a text without words or letters gets 0.
STATISTICS = {
    "n_words": "double(n_words)",
    "word_length": "coalesce(word_chars / nullif(n_words, 0), 0D)",
    "symbols_per_word": "coalesce(n_symbols / nullif(n_words, 0), 0D)",
    "repeated_lines": "coalesce(n_dup_lines / nullif(n_lines, 0), 0D)",
    "repeated_words": "coalesce(n_repeat_words / nullif(n_words, 0), 0D)",
    "doubled_share": "coalesce(n_doubled / nullif(n_words, 0), 0D)",
    "words_per_line": "coalesce(n_words / nullif(n_lines, 0), 0D)",
    "upper_share": "coalesce(n_upper / nullif(n_letters, 0), 0D)",
    "letter_share": "coalesce(n_letters / nullif(word_chars, 0), 0D)",
    "digit_share": "coalesce(n_digits / nullif(word_chars, 0), 0D)",
    "other_share": "coalesce(n_other / nullif(word_chars, 0), 0D)",
    "distinct_share": "coalesce(n_distinct / nullif(n_words, 0), 0D)",
    "longest_word": "double(longest_word)",
    "ended_share": "coalesce(n_ended / nullif(n_words, 0), 0D)",
    "capital_share": "coalesce(n_capital / nullif(n_words, 0), 0D)",
}


def kind_of(code: int) -> int:
    """0 white space, 1 letter, 2 upper-case letter, 3 digit, 4 anything else."""
    c = chr(code)
    return 0 if c in BLANK else 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 4


def counts_of(text: str | None, kinds: dict[int, int]) -> tuple[int, ...]:
    """The counts of a text, in the order of ``COUNTS``; ``kinds`` remembers code points."""
    text = text or ""
    words = WORD.findall(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    each = np.bincount(codes, minlength=128) if len(codes) else np.zeros(128, np.int64)
    of = [0] * 5
    for code in np.flatnonzero(each).tolist():
        if (kind := kinds.get(code)) is None:
            kind = kinds[code] = kind_of(code)
        of[kind] += int(each[code])
    seen: set[str] = set()
    lines = again = 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            if line in seen:
                again += 1
            seen.add(line)
    ids = numbered(words)
    starts = repeated(ids, WINDOW)
    repeats = int(covered(starts, WINDOW, len(words)).sum()) if len(starts) else 0
    return (
        len(words), sum(of[1:]), int(each[[ord(s) for s in SYMBOLS]].sum()), again, repeats, lines, of[2], of[1] + of[2], of[3], of[4],
        len(set(words)), max(map(len, words), default=0), sum(w.endswith(ENDS) for w in words), sum(w[0].isupper() for w in words), int((ids[1:] == ids[:-1]).sum()),
    )


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """Rows (doc_id, *keep, *COUNTS) of whole texts, one per row; null texts count as empty. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[int, int] = {}
        for batch in small(batches):
            rows = [counts_of(t, kinds) for t in batch.column(batch.num_columns - 1).to_pylist()]
            made = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], ["doc_id", *keep, *COUNTS])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").cast("string").alias("text"))
    types = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join(["doc_id long", *[f"{c} {types[c]}" for c in keep], *[f"{c} long" for c in COUNTS]]))


def base_failed() -> Column:
    """The base rules: under ``LEAST_WORDS`` words, or over ``MOST_REPEATED`` per cent of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, above, threshold), all of which must hold, and the verdict; ``bad`` and ``good`` are training texts met first by it."""

    conditions: tuple[tuple[str, bool, float], ...]
    keep: bool
    bad: int = 0
    good: int = 0

    def holds(self) -> Column:
        met = F.lit(True)
        for name, above, threshold in self.conditions:
            value = F.expr(STATISTICS[name])
            met = met & ((value > threshold) if above else (value <= threshold))
        return met

    def __str__(self) -> str:
        tests = " and ".join(f"{n} {'>' if above else '<='} {t:.6g}" for n, above, t in self.conditions) or "otherwise"
        return f"{tests}: {'keep' if self.keep else 'drop'} ({self.bad} bad, {self.good} good)"


def expression(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression; without a rule that holds a text is kept."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(rule.holds(), F.lit(rule.keep)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 30_000, **options: float) -> list[Rule]:
    """Rules from at most ``most_rows`` labelled rows, chosen by hash, that pass the base rules.

    A row is bad if any label of its id says quality 0; null ids and null labels are left out.
    Repeated rows count once. The fold for pruning is chosen by hash.
    """
    lab = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    chosen = F.broadcast(sampled(lab.agg(F.min("quality").cast("int").alias("good")), F.xxhash64("doc_id"), most_rows))  # at most most_rows rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    texts = texts.withColumn("h", F.xxhash64("doc_id", "text")).groupBy("h").agg(F.first("doc_id").alias("doc_id"), F.first("good").alias("good"), F.min("text").alias("text"))
    rows = measured(sampled(texts, F.col("h"), most_rows), "h", "good").where(~base_failed())
    table = rows.select("h", "good", *[F.expr(e).alias(f"_{n}") for n, e in STATISTICS.items()]).toPandas().sort_values("h", kind="stable")
    values = table[[f"_{n}" for n in STATISTICS]].to_numpy(float)
    return learn(values, table["good"].to_numpy() == 0, table["h"].to_numpy() % 3 == 0, list(STATISTICS), **options)


def learn(x: np.ndarray, bad: np.ndarray, aside: np.ndarray, names: list[str], least: int = 3, purity: float = 0.9, most_rules: int = 40, most_conditions: int = 4) -> list[Rule]:
    """Sequential covering over rows of statistics; ``aside`` marks the rows that prune and judge.

    A rule stays if it meets ``least`` bad rows in all and at least ``purity`` of the rows that it
    meets aside are bad (of all rows if it meets none aside). Ties between thresholds go to
    the earlier statistic, then to the lower threshold. Without bad or without good rows
    there is no rule.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    if not bad.any() or bad.all():
        return rules
    while len(rules) < most_rules and (left & bad).any():
        grown = _grow(x, bad, left & ~aside, most_conditions)
        grown = _prune(x, bad, left & aside, grown)
        met = left & _meets(x, grown)
        judged = met & aside if (met & aside).any() else met
        if not grown or (met & bad).sum() < least or bad[judged].mean() < purity:
            break
        rules.append(Rule(tuple((names[j], above, t) for j, above, t in grown), False, int((met & bad).sum()), int((met & ~bad).sum())))
        left &= ~met
    return rules


def _meets(x: np.ndarray, conditions: list[tuple[int, bool, float]]) -> np.ndarray:
    met = np.ones(len(x), bool)
    for j, above, t in conditions:
        met &= (x[:, j] > t) if above else (x[:, j] <= t)
    return met


def _grow(x: np.ndarray, bad: np.ndarray, rows: np.ndarray, most: int) -> list[tuple[int, bool, float]]:
    """Conditions added one by one, each with the greatest gain: bad rows kept times the bits by which their share rises."""
    made: list[tuple[int, bool, float]] = []
    at = np.flatnonzero(rows)
    while len(made) < most:
        p, n = int(bad[at].sum()), int((~bad[at]).sum())
        if not p or not n:
            break
        best, found = 1e-9, None
        for j in range(x.shape[1]):
            order = at[np.argsort(x[at, j], kind="stable")]
            v, ps = x[order, j], np.cumsum(bad[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            low_p, low = ps[cut], cut + 1
            for above, some_p, some in ((False, low_p, low), (True, p - low_p, p + n - low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(some_p > 0, some_p * (np.log2(some_p / some) - math.log2(p / (p + n))), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, found = float(gain[k]), (j, above, float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if found is None:
            break
        made.append(found)
        at = at[_meets(x[at], [found])]
    return made


def _prune(x: np.ndarray, bad: np.ndarray, rows: np.ndarray, grown: list[tuple[int, bool, float]]) -> list[tuple[int, bool, float]]:
    """The shortest beginning of the conditions with the best (bad - good) / (bad + good) on the rows kept aside."""

    def worth(conditions: list[tuple[int, bool, float]]) -> float:
        met = rows & _meets(x, conditions)
        p, n = int((met & bad).sum()), int((met & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((grown[:k] for k in range(1, len(grown) + 1)), key=lambda c: (worth(c), -len(c)), default=[])


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), one per row of ``docs``.

    Null and blank texts have no words and so fail the base rules; texts that fail them are not
    kept, others get the verdict of the first rule that holds. Columns of ``docs`` other than
    doc_id and text are not read.
    """
    rows = measured(docs).withColumn("base_failed", base_failed())
    return rows.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & expression(rules)).alias("kept"))
