"""Language identification by unigram piece models, marginalised over all segmentations.

The pieces come from a fixed public vocabulary; every language has its own probability for each piece. A word's
likelihood in a language is the sum, over all ways to cut the word into pieces, of the product of their probabilities.
The forward algorithm computes it once for each distinct word of a slice, and the backward pass gives the expected
piece counts with which expectation maximisation fits the probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .text_arrow import coded, row_of, slices, texts_of, words_of

UNDETERMINED = "und"
START = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Words of so many characters at most are summed side by side as they are; of longer ones, the sums are rescaled on the way.
_SHORT = 32
#: A word longer than this is summed by itself, in logarithms.
_LONG = 512
_SUFFIX_BITS = 22


def _code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    text = "".join(words.to_pylist())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    return points, np.concatenate([[0], np.cumsum(lengths)])


def _scrambled(points: np.ndarray) -> np.ndarray:
    x = points.astype(np.uint64) + np.uint64(1)
    x = (x ^ (x << np.uint64(21))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


class Vocabulary:
    """Pieces with their places in a hash table over character sequences.

    A piece that starts a word begins with START. Characters that are no piece of their own share one unknown piece.
    """

    def __init__(self, pieces: list[str]):
        longest = self.longest = max(map(len, pieces), default=0)
        own = sorted({p for p in pieces if p})
        self.pieces = own
        self.size = len(own) + 1
        self.unknown = len(own)
        points, offsets = _code_points(pa.array(own, pa.string()))
        key = np.zeros(len(own), dtype=np.uint64)
        lengths = np.diff(offsets)
        value = _scrambled(points)
        for k in range(longest):
            more = lengths > k
            key[more] = key[more] * _BASE + value[offsets[:-1][more] + k]
        key = _finished(key)
        self.bits = max(4, int(np.ceil(np.log2(max(len(own), 2)))) + 4)
        self.table_key = np.zeros(1 << self.bits, dtype=np.uint64)
        self.table_id = np.full(1 << self.bits, -1, dtype=np.int32)
        slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        self.table_key[slot] = key
        self.table_id[slot] = np.arange(len(own))
        lost = np.flatnonzero(self.table_key[slot] != key)  # places already taken: looked up by binary search
        order = np.argsort(key[lost])
        self.rest_key, self.rest_id = key[lost][order], lost[order].astype(np.int32)
        self.crowded = np.zeros(1 << self.bits, dtype=bool)
        self.crowded[slot[lost]] = True
        # which hashes the ends of pieces have: a stretch that ends no piece needs no longer look back
        self.suffix = np.zeros(1 << _SUFFIX_BITS, dtype=bool)
        tail, power = np.zeros(len(own), dtype=np.uint64), np.uint64(1)
        with np.errstate(over="ignore"):
            for n in range(1, longest + 1):
                more = lengths >= n
                tail[more] += value[offsets[1:][more] - n] * power
                power = power * _BASE
                self.suffix[self._place(tail[more])] = True

    @staticmethod
    def _place(key: np.ndarray) -> np.ndarray:
        return (_finished(key) >> np.uint64(64 - _SUFFIX_BITS)).astype(np.int64)

    def ids(self, key: np.ndarray) -> np.ndarray:
        key = _finished(key)
        slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        found = np.where(self.table_key[slot] == key, self.table_id[slot], np.int32(-1))
        if len(self.rest_key):
            at = np.flatnonzero(self.crowded[slot] & (found < 0))
            near = np.minimum(np.searchsorted(self.rest_key, key[at]), len(self.rest_key) - 1)
            found[at] = np.where(self.rest_key[near] == key[at], self.rest_id[near], -1)
        return found


@dataclass
class Lattice:
    """The pieces of distinct words: words sorted from long to short, and for each end position the pieces that end there."""

    order: np.ndarray
    lengths: np.ndarray
    active: list[int]  # by end position: words that are as long
    ending: list[list[tuple[int, np.ndarray, np.ndarray]]]  # by end position: (piece length, places of words, piece ids)


def lattice(words: pa.Array, vocabulary: Vocabulary) -> Lattice:
    points, offsets = _code_points(words)
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = offsets[:-1][order], lengths[order]
    value = _scrambled(points)
    every, ending = [], []
    for end in range(1, int(sizes[0]) + 1 if len(sizes) else 1):
        active = int(np.searchsorted(-sizes, -end, side="right"))
        here, place, at = [], np.arange(active), starts[:active] + end
        key, power = np.zeros(active, dtype=np.uint64), np.uint64(1)
        for n in range(1, min(vocabulary.longest, end) + 1):
            with np.errstate(over="ignore"):
                key = key + value[at - n] * power
                power = power * _BASE
            ids = vocabulary.ids(key)
            if n == 1:
                ids[ids < 0] = vocabulary.unknown
                here.append((1, place, ids))
            else:
                hit = np.flatnonzero(ids >= 0)
                if len(hit):
                    here.append((n, place[hit], ids[hit]))
            more = np.flatnonzero(vocabulary.suffix[vocabulary._place(key)])
            if not len(more):
                break
            place, at, key = place[more], at[more], key[more]
        every.append(active)
        ending.append(here)
    return Lattice(order, sizes, every, ending)


def forward(net: Lattice, p: np.ndarray) -> list[np.ndarray]:
    """alpha[end][word, language]: the summed probability of all segmentations of the first `end` characters, for words of up to _SHORT."""
    alpha = [np.ones((len(net.order), p.shape[1]))]
    for end, (active, here) in enumerate(zip(net.active, net.ending), 1):
        now = np.zeros((active, p.shape[1]))
        for n, place, ids in here:
            now[place] += alpha[end - n][place] * p[ids]
        alpha.append(now)
    return alpha


def log_forward(net: Lattice, p: np.ndarray, longest: int) -> np.ndarray:
    """log P of each word of the lattice, [word, language]: `forward` with rescaled sums, of which only the last are held."""
    size, made = len(net.order), np.zeros((len(net.order), p.shape[1]))
    scale, ring = np.zeros((size, p.shape[1])), {0: np.ones((size, p.shape[1]))}
    for end, (active, here) in enumerate(zip(net.active, net.ending), 1):
        now = np.zeros((active, p.shape[1]))
        for n, place, ids in here:
            now[place] += ring[end - n][place] * p[ids]
        ring[end] = now
        ring.pop(end - longest, None)
        if end % 16 == 0:
            top = np.max([x[:active] for x in ring.values()], axis=0)
            ring = {e: x[:active] / top for e, x in ring.items()}
            scale[:active] += np.log(top)
            now = ring[end]
        last = net.active[end] if end < len(net.active) else 0
        made[last:active] = np.log(np.maximum(now[last:], 1e-300)) + scale[last:active]
    return made


def _arcs_of_word(word: str, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, length, piece id) of all pieces in one word, ascending by end."""
    value = _scrambled(np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
    found, end, key, power = [], np.arange(1, len(value) + 1), np.zeros(len(value), dtype=np.uint64), np.uint64(1)
    for n in range(1, vocabulary.longest + 1):
        with np.errstate(over="ignore"):
            key = key + value[end - n] * power
            power = power * _BASE
        ids = vocabulary.ids(key)
        if n == 1:
            ids[ids < 0] = vocabulary.unknown
        hit = np.flatnonzero(ids >= 0)
        found.append((end[hit], np.full(len(hit), n), ids[hit]))
        more = np.flatnonzero((end > n) & vocabulary.suffix[vocabulary._place(key)])
        if not len(more):
            break
        end, key = end[more], key[more]
    end, n, ids = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(end, kind="stable")
    return end[order], n[order], ids[order]


def _log_sums(size: int, place: np.ndarray, source: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Summed probabilities, as logarithms, of all ways over arcs (source, place) from place 0 to each of `size` places; arcs ascend by place."""
    made = [-math.inf] * size
    made[0] = 0.0
    ends = np.searchsorted(place, np.arange(size + 1)).tolist()
    source, weight = source.tolist(), log_p.tolist()
    for at in range(1, size):
        terms = [made[source[k]] + weight[k] for k in range(ends[at], ends[at + 1])]
        top = max(terms)
        made[at] = top + math.log(sum(math.exp(x - top) for x in terms)) if len(terms) > 1 else top
    return np.array(made)


def word_log_likelihoods(words: pa.Array, vocabulary: Vocabulary, p: np.ndarray) -> np.ndarray:
    """log P(word | language) of each distinct word of any length, [words, languages]."""
    made = np.zeros((len(words), p.shape[1]))
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    usual = np.flatnonzero(lengths <= _LONG)
    if len(usual):
        net = lattice(words.take(pa.array(usual)), vocabulary)
        made[usual[net.order]] = log_forward(net, p, vocabulary.longest)
    for k in np.flatnonzero(lengths > _LONG).tolist():
        end, n, ids = _arcs_of_word(words[k].as_py(), vocabulary)
        for g in range(p.shape[1]):
            made[k, g] = _log_sums(int(lengths[k]) + 1, end, end - n, np.log(p[ids, g]))[-1]
    return made


def expected_counts(words: pa.Array, weight: np.ndarray, vocabulary: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Expected piece counts [pieces, languages] of words that occur weight[word, language] times."""
    made = np.zeros((vocabulary.size, p.shape[1]))
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    short = np.flatnonzero(lengths <= _SHORT)
    if len(short):
        net = lattice(words.take(pa.array(short)), vocabulary)
        alpha = forward(net, p)
        beta = [np.zeros_like(x) for x in alpha]
        total = np.zeros((len(net.order), p.shape[1]))
        for end, x in enumerate(alpha):
            last = net.active[end] if end < len(net.active) else 0
            total[last : len(x)] = x[last:]
            beta[end][last:] = 1.0
        scale = weight[short[net.order]] / np.maximum(total, 1e-300)
        for end in range(len(net.ending), 0, -1):
            for n, place, ids in net.ending[end - 1]:
                part = beta[end][place] * p[ids]
                beta[end - n][place] += part
                for g in range(p.shape[1]):
                    made[:, g] += np.bincount(ids, weights=part[:, g] * alpha[end - n][place, g] * scale[place, g], minlength=vocabulary.size)
    for k in np.flatnonzero(lengths > _SHORT).tolist():
        size = int(lengths[k]) + 1
        end, n, ids = _arcs_of_word(words[k].as_py(), vocabulary)
        back = np.argsort(size - 1 - (end - n), kind="stable")
        for g in np.flatnonzero(weight[k]).tolist():
            log_p = np.log(p[ids, g])
            alpha = _log_sums(size, end, end - n, log_p)
            beta = _log_sums(size, (size - 1 - (end - n))[back], (size - 1 - end)[back], log_p[back])
            share = np.exp(alpha[end - n] + log_p + beta[size - 1 - end] - alpha[-1])
            made[:, g] += np.bincount(ids, weights=weight[k, g] * share, minlength=vocabulary.size)
    return made


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes, distinct words, offsets by text): lower-case runs of letters and marks, each with START."""
    lettered = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+", " ")
    flat, offsets = words_of(lettered)
    codes, words = coded(flat)
    return codes, pc.binary_join_element_wise(START, words, ""), offsets


@dataclass
class LanguageModel:
    """Piece probabilities by language, p[piece, language]."""

    vocabulary: Vocabulary
    languages: list[str]
    p: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, its posterior probability) of each text, UNDETERMINED and 0 for one without letters."""
        codes, words, offsets = _words(texts)
        each = word_log_likelihoods(words, self.vocabulary, self.p)
        total = np.zeros((len(texts), len(self.languages)))
        for g in range(len(self.languages)):
            total[:, g] = np.bincount(row_of(offsets), weights=each[codes, g], minlength=len(texts))
        total -= total.max(axis=1, keepdims=True) if total.size else 0
        odds = np.exp(total)
        best = np.argmax(odds, axis=1) if len(self.languages) else np.zeros(len(texts), dtype=int)
        empty = np.diff(offsets) == 0
        letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
        named = ~empty & letters if self.languages else np.zeros(len(texts), dtype=bool)
        score = np.where(named, odds.max(axis=1, initial=0) / np.maximum(odds.sum(axis=1), 1e-300), 0.0)
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, named)], score


def sentencepiece_vocabulary(model_path: str) -> Vocabulary:
    """All pieces of a sentencepiece model; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return Vocabulary([model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))])


def train_languages(
    df: DataFrame,
    vocabulary: Vocabulary,
    lang_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    where: Column | None = None,
    max_training_docs: int = 1_500,
    rounds: int = 2,
    smoothing: float = 0.02,
    max_languages: int = 1_000,
) -> LanguageModel:
    """Fits piece probabilities for every language of the labelled rows that `where` admits.

    For each language about `max_training_docs` labelled rows are used, chosen by a hash of the id: a bounded training
    sample. Rows with a null language or text don't train. Without labelled rows the model knows no language. More
    languages than `max_languages` are taken for dirty labels: an error, as the model grows with them.
    """
    rows = df.select(df[id_col].alias("i"), df[text_col].alias("t"), df[lang_col].cast("string").alias("g"), (where if where is not None else F.lit(True)).alias("w"))
    rows = rows.where(F.col("w") & F.col("g").isNotNull() & F.col("t").isNotNull()).drop("w")
    there = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(there) > max_languages:
        raise ValueError(f"more than {max_languages} values in {lang_col}")
    languages = sorted(there)
    if not languages:
        return LanguageModel(vocabulary, [], np.zeros((vocabulary.size, 0)))
    slots = 1 << 40
    share = F.create_map(*[F.lit(x) for g in languages for x in (g, min(slots, int(slots * max_training_docs / there[g])))])
    chosen = rows.where(F.pmod(F.xxhash64("i"), F.lit(slots)) < share[F.col("g")]).select("g", "t")
    sample = written(chosen, "language-sample")
    spark = df.sparkSession
    p = np.full((vocabulary.size, len(languages)), 1.0 / vocabulary.size)
    for _ in range(rounds + 1):
        model = spark.sparkContext.broadcast((vocabulary, languages, p))  # as large as the vocabulary, times the languages

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, names, now = model.value
            place = {g: k for k, g in enumerate(names)}
            total = np.zeros((pieces.size, len(names)))
            for part in slices(batches, "t"):
                codes, words, offsets = _words(texts_of(part, "t"))
                of_row = np.array([place[g] for g in part.column("g").to_pylist()])
                key = codes * len(names) + of_row[row_of(offsets)]
                weight = np.bincount(key, minlength=len(words) * len(names)).reshape(len(words), len(names))
                total += expected_counts(words, weight.astype(float), pieces, now)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], ["k", "g", "c"])

        counts = np.zeros_like(p)
        # at most one row for each piece and language, whatever the corpus
        for row in sample.mapInArrow(run, "k int, g int, c double").groupBy("k", "g").agg(F.sum("c").alias("c")).toArrow().to_batches():
            counts[row.column(0).to_numpy(), row.column(1).to_numpy()] = row.column(2).to_numpy()
        counts += smoothing
        p = counts / counts.sum(axis=0)
    return LanguageModel(vocabulary, languages, p)


def identify_languages(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score (0 to 1) of every whole text, row by row.

    lang_pred is `und` with score 0 where the text is null or has no letter, and where the model knows no language.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            named, score = shared.value.predict(texts_of(part, "t"))
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(named, pa.string()), pa.array(score)], ["i", "l", "s"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("i"), df[text_col].alias("t")).mapInArrow(run, f"i {kind}, l string, s double").toDF(id_col, "lang_pred", "score")


def keep_identified(df: DataFrame, model: LanguageModel, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of `df`, all columns as they are, whose language is determined with a score of `min_score` at least."""
    shared, place = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f"c{k}" for k in range(batch.num_columns)]
            for part in slices([pa.RecordBatch.from_arrays(batch.columns, names)], names[place]):
                named, score = shared.value.predict(texts_of(part, names[place]))
                good = np.array([g != UNDETERMINED for g in named], dtype=bool) & (score >= min_score)
                kept = part.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays(kept.columns, batch.schema.names)

    return df.mapInArrow(run, df.schema)
