"""Text statistics and learned decision lists for document quality.

`learn_decision_list` runs sequential covering: each rule is grown on two thirds of the training rows by adding the
threshold condition with the best information gain, pruned on the other third, and kept if it is precise enough there;
the rows it covers leave the training set. A rule that fails is grown again on another deal of the rows. The list is applied as one Spark CASE expression, rule after rule.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_arrow import bytes_of, coded, mixed, per_row, row_of, slices, texts_of, words_of

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_digits", "n_chars", "n_adjacent")


def _count(flat: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(chosen[flat])
    return np.diff(np.searchsorted(at, offsets))


def _chosen(values: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(values)] = True
    return table


def repeat_words(codes: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """By text: words that lie in a window of `window` words which the text has twice or more.

    Windows are told apart by a 64-bit hash; within a slice of a few million windows a chance collision is below 1e-5.
    """
    n = len(codes) - window + 1
    if n <= 0:
        return np.zeros(len(offsets) - 1, dtype=np.int64)
    rows = row_of(offsets)
    word, key = mixed(codes), mixed(rows[:n].astype(np.uint64) + np.uint64(1 << 40))
    for k in range(window):
        key = key * np.uint64(0xD6E8FEB86659FD93) + word[k : k + n]
    inside = rows[:n] == rows[window - 1 :]
    at = np.flatnonzero(inside)
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    start = order[twice]
    edge = np.bincount(start, minlength=len(codes) + 1).astype(np.int64) - np.bincount(start + window, minlength=len(codes) + 1)[: len(codes) + 1]
    return per_row(np.cumsum(edge)[: len(codes)] > 0, offsets)


def _stats(texts: pa.Array) -> list[np.ndarray]:
    flat, offsets = bytes_of(texts)
    words, word_offsets = words_of(texts)
    codes, _ = coded(words)
    lines = pc.split_pattern(texts, "\n")
    line_offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64))])
    each = pc.list_flatten(lines)
    with_word = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(each)), 0).to_numpy(zero_copy_only=False)
    line_codes, _ = coded(each)
    key = row_of(line_offsets) * (int(line_codes.max(initial=0)) + 1) + line_codes
    earlier = np.ones(len(key), dtype=bool)
    earlier[np.unique(key, return_index=True)[1]] = False
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = row_of(word_offsets)
    adjacent = np.zeros(len(codes), dtype=bool)
    adjacent[1:] = (codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])
    return [
        np.diff(word_offsets),
        per_row(lengths, word_offsets),
        _count(flat, offsets, _chosen(SYMBOLS)),
        per_row(with_word & earlier, line_offsets),
        repeat_words(codes, word_offsets),
        per_row(with_word, line_offsets),
        _count(flat, offsets, _chosen(bytes(range(65, 91)))),
        _count(flat, offsets, _chosen(b"!")),
        _count(flat, offsets, _chosen(b"0123456789")),
        pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64),
        per_row(adjacent, word_offsets),
    ]


def text_stats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""id and the counts STATS (long) of every whole text, row by row.

    A word is a maximal run of `[^\x20\x09-\x0D]`. n_dup_lines counts lines with a word that equal an earlier line,
    n_repeat_words the words in 5-word windows found twice or more, n_upper the letters A-Z,
    n_adjacent the words that equal the word before. A null text has no words
    and all counts 0.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            made = [pa.array(x.astype(np.int64)) for x in _stats(texts_of(part, "t"))]
            yield pa.RecordBatch.from_arrays([part.column("i"), *made], ["i", *STATS])

    kind = df.schema[id_col].dataType.simpleString()
    made = df.select(df[id_col].alias("i"), df[text_col].alias("t")).mapInArrow(run, f"i {kind}, " + ", ".join(f"{s} bigint" for s in STATS))
    return made.toDF(id_col, *STATS)


#: Ratios the rules test, from the counts; a denominator is 1 at least.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "upper_share": ("n_upper", "n_chars"),
    "exclaims_per_word": ("n_exclaim", "n_words"),
    "digit_share": ("n_digits", "n_chars"),
    "chars_per_word": ("word_chars", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "adjacent_share": ("n_adjacent", "n_words"),
}


def ratio_columns() -> dict[str, Column]:
    return {name: F.col(a) / F.greatest(F.col(b), F.lit(1)) for name, (a, b) in RATIOS.items()}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return rows[self.feature] > self.threshold if self.above else rows[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int
    positive: int

    def column(self) -> Column:
        return functools.reduce(operator.and_, [c.column() for c in self.conditions])

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.holds(rows) for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) + f" -> junk ({self.positive} of {self.covered} training rows)"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds says junk, and a row that none covers is kept."""

    rules: tuple[Rule, ...]

    def kept(self) -> Column:
        """The list as one conditional expression over the columns of `text_stats` and `ratio_columns`."""
        case = None
        for rule in self.rules:
            case = F.when(rule.column(), F.lit(False)) if case is None else case.when(rule.column(), F.lit(False))
        return F.lit(True) if case is None else case.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join([*map(str, self.rules), "otherwise -> keep"])


def _grow(rows: dict[str, np.ndarray], bad: np.ndarray, features: list[str], cuts: int, longest: int) -> list[Condition]:
    held, chosen = np.ones(len(bad), dtype=bool), []
    while len(chosen) < longest:
        p, n = int((held & bad).sum()), int((held & ~bad).sum())
        if not p or not n:
            break
        before, best = math.log2(p / (p + n)), (0.0, None)
        for feature in features:
            values = rows[feature][held]
            marks = bad[held]
            order = np.argsort(values, kind="stable")
            values, marks = values[order], marks[order]
            ends = np.flatnonzero(values[1:] > values[:-1])
            if not len(ends):
                continue
            ends = np.unique(ends[np.linspace(0, len(ends) - 1, min(cuts, len(ends))).astype(int)])
            below_p = np.cumsum(marks)[ends]
            below = ends + 1
            for above, got_p, got in ((False, below_p, below), (True, p - below_p, p + n - below)):
                gain = np.where(got_p > 0, got_p * (np.log2(np.maximum(got_p, 1) / got) - before), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), Condition(feature, above, float((values[ends[k]] + values[ends[k] + 1]) / 2)))
        if best[1] is None:
            break
        chosen.append(best[1])
        held &= best[1].holds(rows)
    return chosen


def _pruned(conditions: list[Condition], rows: dict[str, np.ndarray], bad: np.ndarray) -> list[list[Condition]]:
    """The beginnings of a rule, from the one that tells best on the pruning rows."""

    def worth(k: int) -> float:
        held = np.logical_and.reduce([c.holds(rows) for c in conditions[:k]])
        p, n = int((held & bad).sum()), int((held & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return [conditions[:k] for k in sorted(range(1, len(conditions) + 1), key=lambda k: (-worth(k), k))]


def learn_decision_list(
    rows: dict[str, np.ndarray], bad: np.ndarray, features: list[str] | None = None, min_precision: float = 0.9, min_covered: int = 4, max_rules: int = 16, cuts: int = 64, longest: int = 4
) -> DecisionList:
    """Rules for `bad` rows, precise to `min_precision` on all rows left and on the pruning rows.

    Three deals of the rows are tried for each rule, and of each grown rule all beginnings; the list ends where none is precise enough.
    """
    features = features or list(rows)
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)

    def found() -> Rule | None:
        at = np.flatnonzero(left)
        for deal in range(3):
            third = at % 3 == (len(rules) + deal) % 3
            grow, prune = at[~third], at[third]
            grown = _grow({f: rows[f][grow] for f in features}, bad[grow], features, cuts, longest)
            for conditions in _pruned(grown, {f: rows[f][prune] for f in features}, bad[prune]):
                held = left & np.logical_and.reduce([c.holds(rows) for c in conditions])
                p, n, tested = int((held & bad).sum()), int(held.sum()), int(held[prune].sum())
                if n >= min_covered and p >= min_precision * n and (bad[prune] & held[prune]).sum() >= min_precision * tested:
                    return Rule(tuple(conditions), n, p)
        return None

    while len(rules) < max_rules and (left & bad).sum() >= min_covered:
        rule = found()
        if rule is None:
            break
        rules.append(rule)
        left &= ~rule.holds(rows)
    return DecisionList(tuple(rules))


def base_failed() -> Column:
    """Fewer than 10 words, or over 20 % of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def train_quality(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_training_rows: int = 20_000, **settings) -> DecisionList:
    """Learns a decision list for label 0 from labelled statistics of the rows that `base_failed` leaves to the list.

    About `max_training_rows` rows are used at most, chosen by a hash of id and statistics; only their counts, not their
    texts, come to the driver. Null labels and null ids don't train, an id with several labels has its lowest, and rows
    alike in everything train once, however often an id is repeated.
    """
    marked = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull()).groupBy(F.col(id_col)).agg(F.min(label_col).alias("_label"))
    made = stats.where(~base_failed()).join(marked, id_col).select(id_col, "_label", *STATS).distinct()
    there = made.count()
    slots = 1 << 40
    if there > max_training_rows:
        made = made.where(F.pmod(F.xxhash64(id_col, *STATS), F.lit(slots)) < int(slots * max_training_rows / there))
    table = made.select("*", *[c.alias(n) for n, c in ratio_columns().items()]).toPandas().sort_values([id_col, *STATS, "_label"], kind="stable")
    features = [*RATIOS, "n_words", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = {f: table[f].to_numpy(dtype=float) for f in features}
    # training rows are dealt to the grow and prune sets by place, so their order must not follow the id
    order = np.argsort(mixed(np.arange(len(table), dtype=np.uint64)), kind="stable")
    return learn_decision_list({f: v[order] for f, v in rows.items()}, (table["_label"].to_numpy() == 0)[order], features, **settings)


def quality_verdicts(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """The statistics with base_failed (n_words < 10, or over 20 % repeated words) and kept (boolean)."""
    made = stats.withColumns(ratio_columns()).withColumn("base_failed", base_failed())
    return made.withColumn("kept", ~F.col("base_failed") & rules.kept())
