"""Toxicity scores from Levenshtein automata run over a lexicon trie, with the context of each hit.

The lexicon - whole words, and stems that begin words - is learned from labelled rows. A trie holds it, and each
distinct word of a slice drives a Levenshtein automaton of bounded distance through the trie: the automaton's state is
the band of the edit matrix around the diagonal, all words advance together at each trie node, and words whose band has
gone beyond the distance leave. Misspelled forms that also occur in harmless training rows are ordinary words, not hits.
For every hit a window of words tells whether it stands inside quotation marks and how many further hits surround it;
a logistic model turns these counts into a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .text_arrow import coded, row_of, slices, texts_of, words_of

WORD, STEM, FUZZY = 1, 2, 3
STEM_LENGTHS = (4, 5, 6, 7)
CONTEXT = 8
OPENING, CLOSING = "\"“„«'‘", "\"”“»'’"
#: A misspelling counts as this part of the word; training rows with misspellings are too few to learn it.
MISSPELLED = 0.8
FEATURES = ("word_hits", "stem_hits", "per_100_words", "quoted_share", "crowding", "kinds", "any_word")


def normalised(words: pa.Array) -> pa.Array:
    """Lower case, without what is not a letter at either end."""
    return pc.replace_substring_regex(pc.utf8_lower(words), r"^[^\p{L}]+|[^\p{L}]+$", "")


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    word: int = -1  # entry that ends here
    stem: int = -1
    reach: int = 0  # largest distance of the words below


@dataclass
class Lexicon:
    """Terms with their kind (WORD or STEM) and weight; `ordinary` forms are near a term but not hits."""

    terms: list[str]
    kinds: list[int]
    weights: list[float]
    ordinary: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self.root, self.depth = Node(), max(map(len, self.terms), default=0)
        for i, (term, kind) in enumerate(zip(self.terms, self.kinds)):
            node, path = self.root, [self.root]
            for ch in term:
                node = node.children.setdefault(ch, Node())
                path.append(node)
            if kind == WORD:
                node.word = i
                for x in path:
                    x.reach = max(x.reach, allowed(term))
            else:
                node.stem = i

    def __reduce__(self):
        return Lexicon, (self.terms, self.kinds, self.weights, self.ordinary)  # the trie is built anew where it is used

    def matches(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(kind, entry) of each distinct word of any length, kind 0 where the lexicon has nothing near; an exact word wins over a stem, a stem over a misspelling."""
        n, k = len(words), self.root.reach
        kind, entry, far = np.zeros(n, dtype=np.int8), np.full(n, -1, dtype=np.int32), np.full(n, 99, dtype=np.int8)
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        # a word that is longer than every term and its misspellings is told by its length, so no more letters are read
        cut = pc.utf8_slice_codeunits(words, 0, self.depth + k + 1)
        read = np.minimum(lengths, self.depth + k + 1)
        letters = np.append(np.frombuffer("".join(cut.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.uint32(0))
        begin = np.cumsum(read) - read
        band = np.full((n, 2 * k + 1), 9, dtype=np.int8)
        for b in range(k, 2 * k + 1):
            band[:, b] = b - k  # distance of the empty path to the word's first b - k letters

        shortest = min((len(t) for t in self.terms), default=99) - k
        start = np.flatnonzero(lengths >= max(1, shortest))
        open_ = [(self.root, 0, start, band[start])] if len(start) and self.terms else []
        while open_:
            node, depth, alive, band = open_.pop()
            if node.stem >= 0:
                hit = alive[(band[:, k] == 0) & (lengths[alive] >= depth) & (kind[alive] != WORD)]
                kind[hit], entry[hit] = STEM, node.stem
            if node.word >= 0:
                limit = allowed(self.terms[node.word])
                b = lengths[alive] - depth + k
                inside = (b >= 0) & (b <= 2 * k)
                d = np.full(len(alive), 99, dtype=np.int8)
                d[inside] = band[inside, b[inside]]
                hit = (d <= limit) & ((d == 0) | (kind[alive] == 0) | ((kind[alive] == FUZZY) & (d < far[alive])))
                at = alive[hit]
                kind[at], entry[at], far[at] = np.where(d[hit] == 0, WORD, FUZZY), node.word, d[hit]
            # the word's letter in each column of the band, 0 beyond its ends
            column = [letters[np.where(j <= read[alive], begin[alive] + j - 1, -1)] if (j := depth + 1 - k + b) >= 1 else None for b in range(2 * k + 1)]
            below = []
            for ch, child in node.children.items():
                step = np.full_like(band, 9)
                for b in range(2 * k + 1):
                    j = depth + 1 - k + b  # the word's letters read so far in this column
                    if j < 0:
                        continue
                    best = band[:, b] + (column[b] != ord(ch)).astype(np.int8) if j else np.full(len(alive), min(depth + 1, 9), dtype=np.int8)
                    if b < 2 * k:
                        best = np.minimum(best, band[:, b + 1] + 1)
                    if b:
                        best = np.minimum(best, step[:, b - 1] + 1)
                    step[:, b] = np.minimum(best, 9)
                lasting = step.min(axis=1) <= child.reach
                if child.reach == 0:
                    lasting = step[:, k] == 0
                if lasting.any():
                    below.append((child, depth + 1, alive[lasting], step[lasting]))
            open_ += reversed(below)
        if self.ordinary:
            near = np.flatnonzero(kind == FUZZY)
            for i, form in zip(near.tolist(), words.take(pa.array(near)).to_pylist()):
                if form in self.ordinary:
                    kind[i], entry[i] = 0, -1
        return kind, entry


def allowed(term: str) -> int:
    """Edit distance within which a misspelling of a word counts."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def _ends(words: pa.Array, marks: str, last: bool) -> np.ndarray:
    group = "[" + marks + "]"
    return pc.match_substring_regex(words, rf"{group}[^\p{{L}}]*$" if last else rf"^[^\p{{L}}]*{group}").to_numpy(zero_copy_only=False)


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """FEATURES of each text, [texts, features]."""
    flat, offsets = words_of(texts)
    codes, distinct = coded(flat)
    kind_of, entry_of = lexicon.matches(normalised(distinct))
    n, made = len(texts), np.zeros((len(texts), len(FEATURES)))
    at = np.flatnonzero(kind_of[codes] > 0)
    rows = row_of(offsets)
    if not len(at):
        return made
    kind, entry, row = kind_of[codes[at]], entry_of[codes[at]], rows[at]
    weight = np.array(lexicon.weights)[entry] * np.where(kind == FUZZY, MISSPELLED, 1.0)
    place = np.arange(len(codes))
    opens, closes = _ends(distinct, OPENING, False)[codes], _ends(distinct, CLOSING, True)[codes]
    last_open = np.maximum.accumulate(np.where(opens, place, -1))
    last_close = np.concatenate([[-1], np.maximum.accumulate(np.where(closes, place, -1))[:-1]])
    next_close = np.minimum.accumulate(np.where(closes, place, 1 << 60)[::-1])[::-1]
    quoted = (last_open[at] >= np.maximum(offsets[row], at - CONTEXT)) & (last_open[at] > last_close[at])
    quoted &= next_close[at] < np.minimum(offsets[row + 1], at + CONTEXT + 1)
    low = np.searchsorted(at, np.maximum(offsets[row], at - CONTEXT))
    high = np.searchsorted(at, np.minimum(offsets[row + 1], at + CONTEXT + 1))
    crowd = (high - low - 1).astype(float)
    count = lambda w: np.bincount(row, weights=w.astype(float), minlength=n)
    hits = np.maximum(count(np.ones(len(at))), 1)
    words = np.maximum(np.diff(offsets), 1)
    first = np.unique(row * (len(lexicon.terms) + 1) + entry) // (len(lexicon.terms) + 1)
    open_weight = weight * ~quoted
    made[:, 0] = np.log1p(count(open_weight * (kind != STEM)))
    made[:, 1] = np.log1p(count(open_weight * (kind == STEM)))
    made[:, 2] = np.log1p(100 * count(open_weight) / words)
    made[:, 3] = count(quoted) / hits
    made[:, 4] = np.log1p(count(crowd) / hits)
    made[:, 5] = np.log1p(np.bincount(first, minlength=n))
    made[:, 6] = count((kind != STEM) & ~quoted) > 0
    return made


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = ((features(texts, self.lexicon) - self.centre) / self.spread) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_NOTHING_LEARNED = ToxicityModel(Lexicon([], [], []), np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), -30.0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps: (weights, bias)."""
    design = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(design.shape[1])
    penalty = np.diag([*[ridge] * x.shape[1], 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (p - y) + penalty @ w
        curve = (design * (p * (1 - p))[:, None]).T @ design + penalty
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, kind, toxic documents, other documents) of a task's texts."""
    held = []
    for part in slices(batches, "t"):
        flat, offsets = words_of(texts_of(part, "t"))
        codes, distinct = coded(normalised(flat))
        pair = np.unique(row_of(offsets) * max(1, len(distinct)) + codes)
        row, code = pair // max(1, len(distinct)), pair % max(1, len(distinct))
        toxic = part.column("y").to_numpy(zero_copy_only=False).astype(np.int64)[row]
        long_enough = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
        chosen = long_enough[code] >= 3
        held.append((distinct, WORD, code[chosen], toxic[chosen]))
        for size in STEM_LENGTHS:
            stem_code, stems = coded(pc.utf8_slice_codeunits(distinct, 0, size))
            able = long_enough[code] > size
            both = np.unique(row[able] * max(1, len(stems)) + stem_code[code[able]])
            of = part.column("y").to_numpy(zero_copy_only=False).astype(np.int64)[both // max(1, len(stems))]
            held.append((stems, STEM, both % max(1, len(stems)), of))
        for values, kind, code, toxic in held:
            ones = np.bincount(code, weights=toxic, minlength=len(values)).astype(np.int64)
            every = np.bincount(code, minlength=len(values))
            seen = pa.array(np.flatnonzero(every))
            yield pa.RecordBatch.from_arrays(
                [values.take(seen), pa.array(np.full(len(seen), kind, dtype=np.int32)), pa.array(ones[seen]), pa.array((every - ones)[seen].astype(np.int64))], ["e", "k", "p", "n"]
            )
        held = []


def learn_lexicon(sample: DataFrame, toxic: int, other: int, min_share: float = 0.01, min_log_odds: float = 2.0) -> Lexicon:
    """The terms that labelled texts (columns t, y) with y = 1 have far more often than the others.

    A term must be in a share of the sample's toxic rows, so there are at most as many as the sample's words divided by that share of its rows.
    """
    least = max(5, math.ceil(min_share * toxic))
    counts = sample.mapInArrow(_terms, "e string, k int, p bigint, n bigint").groupBy("e", "k").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    odds = F.log((F.col("p") + 0.5) / (toxic + 1)) - F.log((F.col("n") + 0.5) / (other + 1))
    rows = counts.where(F.col("p") >= least).withColumn("w", odds).where(F.col("w") >= min_log_odds).collect()
    chosen: list = []
    stems: set[str] = set()
    most: dict[str, int] = {}  # of each beginning, the rows of the most frequent chosen term that begins so
    for r in sorted(rows, key=lambda r: (-r["w"], -r["p"], r["k"], -len(r["e"]), r["e"])):
        starts = [r["e"][:size] for size in STEM_LENGTHS if size <= len(r["e"])]
        wider = any(s in stems for s in starts)
        same = r["k"] == STEM and r["p"] <= 1.1 * most.get(r["e"], -1)
        if not wider and not same:
            chosen.append(r)
            stems |= {r["e"]} if r["k"] == STEM else set()
            for s in starts:
                most[s] = max(most.get(s, 0), r["p"])
    return Lexicon([r["e"] for r in chosen], [r["k"] for r in chosen], [float(r["w"]) for r in chosen])


def train_toxicity(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    where: Column | None = None,
    max_training_docs: int = 6_000,
) -> ToxicityModel:
    """Learns lexicon and weights from the labelled rows that `where` (over `labels`) admits.

    Of each label about `max_training_docs` rows are used, chosen by a hash of the id: a bounded training sample. Rows
    with a null label or id don't train, nor do ids with labels of both kinds; an id that is labelled more than once alike counts once. Without documents of both labels every text gets a score of almost 0.
    """
    spark = df.sparkSession
    marked = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull())
    if where is not None:
        marked = marked.where(where)
    marked = marked.select(labels[id_col].alias("i"), (labels[label_col] == 1).cast("int").alias("y"))
    marked = marked.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("_y")).where("y = _y").drop("_y")
    there = {r["y"]: r["c"] for r in marked.groupBy("y").agg(F.count("*").alias("c")).collect()}
    if len(there) < 2:
        return _NOTHING_LEARNED
    slots = 1 << 40
    share = F.create_map(*[F.lit(x) for y in there for x in (y, min(slots, int(slots * max_training_docs / there[y])))])
    marked = marked.where(F.pmod(F.xxhash64("i"), F.lit(slots)) < share[F.col("y")])
    # the sampled labels are narrow rows bounded by max_training_docs, so the texts stay where they are
    sample = written(df.select(df[id_col].alias("i"), df[text_col].alias("t")).join(F.broadcast(marked), "i").select("i", "t", "y"), "toxicity-sample")
    size = {r["y"]: r["c"] for r in sample.groupBy("y").agg(F.count("*").alias("c")).collect()}
    if len(size) < 2:
        return _NOTHING_LEARNED
    lexicon = learn_lexicon(sample, size[1], size[0])
    shared = spark.sparkContext.broadcast(lexicon)

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            flat, _ = words_of(texts_of(part, "t"))
            _, distinct = coded(normalised(flat))
            kind, _ = shared.value.matches(distinct)
            yield pa.RecordBatch.from_arrays([distinct.take(pa.array(np.flatnonzero(kind == FUZZY)))], ["e"])

    # forms near a term in harmless rows: distinct words of the bounded sample, so the sample bounds them
    forms = [r["e"] for r in sample.where("y = 0").mapInArrow(near, "e string").distinct().collect()]
    lexicon = Lexicon(lexicon.terms, lexicon.kinds, lexicon.weights, frozenset(forms))
    final = spark.sparkContext.broadcast(lexicon)

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            made = features(texts_of(part, "t"), final.value)
            yield pa.RecordBatch.from_arrays([part.column("y"), *map(pa.array, made.T)], ["y", *FEATURES])

    rows = sample.mapInArrow(measured, "y int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    rows = rows.sort_values([*FEATURES, "y"], kind="stable")  # sums of floats don't depend on the order of tasks
    x, y = rows[list(FEATURES)].to_numpy(), rows["y"].to_numpy().astype(float)
    centre, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    weights, bias = logistic((x - centre) / spread, y)
    bias += math.log(there[1] / there[0]) - math.log(size[1] / size[0])  # back from the sample's share of labels to the table's
    return ToxicityModel(lexicon, centre, spread, weights, bias)


def score_toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every whole text, row by row; a null or empty text scores as one without hits."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(shared.value.scores(texts_of(part, "t")))], ["i", "s"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("i"), df[text_col].alias("t")).mapInArrow(run, f"i {kind}, s double").toDF(id_col, "score")
