r"""Substring deduplication by sliding runs of sentences.

A sentence ends after a word that ends with `.`, `!` or `?`, at a line break, and after `longest` words. From every
sentence the shortest run forwards, and up to every sentence the shortest run backwards, of at least `sentences`
sentences and `words` words is hashed. Runs that occur more than once keep their first occurrence, in the order of
(id, place); the sentences of every other occurrence are removed.

Where a stretch without an end is cut depends on what stands before it, so a passage can be cut differently in each
text. Runs of words that know nothing of sentences find it too: of the runs of `passage - step + 1` words, the one of
the least hash among any `step` neighbours is taken. A passage of `passage` words or more has the same runs in every
text, at most `step` words apart. A run of which the sentences' runs leave fewer than `longest` words is left to them,
so of every other occurrence fewer than `longest + step` words stay at either end.

Hashing every run of sentences would find no more: of a repeated run of so many sentences and words, each sentence lies
in one of the shortest runs that begin or end inside it. A repeat below either number stays.

A task combines the runs of its slices before anything is shuffled: it keeps the first occurrence of each hash and
knows at once that the others go. So a passage that a third of all documents share costs a row for each task, not for each document.
Runs are told apart by 96 bits, a polynomial and a sum over their letters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import written
from .text_arrow import bytes_of, mixed, slices, squeezed, texts_of, unsqueezed

#: Several numbers are kept for each byte of a slice.
SLICE = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_END = np.zeros(256, dtype=bool)
_END[list(b".!?")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = mixed(np.arange(256, dtype=np.uint64)) | np.uint64(1)
_SECOND = mixed(np.arange(256, 512, dtype=np.uint64))
_P = 0xD1342543DE82EF95
_INVERSE = pow(_P, -1, 1 << 64)
#: Runs of words are told from runs of sentences by this number, added to their first word's; a text has fewer words.
_WORDS = 1 << 30
#: A task remembers so many runs to combine its slices; more are combined after the shuffle.
_REMEMBERED = 1 << 19
#: Buckets of hashes, and partitions that share them, however large the table.
MAX_BUCKETS, MAX_PARTITIONS = 1 << 16, 4096


@dataclass
class Sentences:
    """Sentences of the texts of a slice: their byte stretches, word counts and texts."""

    start: np.ndarray  # byte of the first word
    stop: np.ndarray  # byte at which the next sentence of the same text, or the text's end, begins
    words: np.ndarray  # words before each sentence, and of all
    of_text: np.ndarray  # offsets of sentences by text
    hash_of: object  # (first sentences, last sentences) -> hashes of the runs
    word_start: np.ndarray  # byte of each word
    word_of_text: np.ndarray  # offsets of words by text
    word_hash_of: object  # (first words, last words + 1) -> hashes of the runs
    check_of: object  # the same -> a second hash of 32 bits

    def runs(self, sentences: int, words: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, last + 1) of the shortest runs from and up to every sentence, without repetition."""
        n = len(self.start)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(self.of_text) - 1), np.diff(self.of_text))
        begin, end = self.of_text[:-1][text], self.of_text[1:][text]
        i = np.arange(n)
        last = np.maximum(i + sentences, np.searchsorted(self.words, self.words[:-1] + words))
        ok = last <= end
        first = np.minimum(i + 1 - sentences, np.searchsorted(self.words, self.words[1:] - words, side="right") - 1)
        back = first >= begin
        key = np.unique(np.concatenate([(i[ok] << 32) | last[ok], (first[back] << 32) | (i[back] + 1)]))
        return key >> 32, key & 0xFFFFFFFF

    def word_runs(self, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of the runs of `size` words with the least hash among `step` neighbours of a text."""
        n = len(self.word_start) - size + 1
        if n < step:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.arange(n)
        h = self.word_hash_of(first, first + size)
        text = np.repeat(np.arange(len(self.word_of_text) - 1), np.diff(self.word_of_text))
        at = np.flatnonzero(text[: n - step + 1] == text[size + step - 2 :])
        least = np.unique(at + np.lib.stride_tricks.sliding_window_view(h, step)[at].argmin(axis=1))
        return least, h[least]


def sentences_of(texts: pa.Array, longest: int) -> Sentences:
    flat, offsets = bytes_of(texts)
    space = _SPACE[flat]
    first_byte = np.zeros(len(flat), dtype=bool)
    first_byte[offsets[:-1][offsets[:-1] < len(flat)]] = True
    inside = ~space
    before_space = np.concatenate([[True], space[:-1]]) if len(flat) else np.zeros(0, bool)
    word_start = np.flatnonzero(inside & (before_space | first_byte))
    after_space = np.concatenate([space[1:], [True]]) if len(flat) else np.zeros(0, bool)
    last_byte = np.concatenate([first_byte[1:], [True]]) if len(flat) else np.zeros(0, bool)
    word_stop = np.flatnonzero(inside & (after_space | last_byte)) + 1
    n = len(word_start)
    text = np.searchsorted(offsets, word_start, side="right") - 1
    breaks = np.flatnonzero(flat == 10)
    ended = _END[flat[word_stop - 1]] if n else np.zeros(0, bool)
    opens = np.ones(n, dtype=bool)
    if n > 1:
        lines = np.searchsorted(breaks, word_start)
        opens[1:] = ended[:-1] | (text[1:] != text[:-1]) | (lines[1:] != lines[:-1])
        since = np.arange(n) - np.maximum.accumulate(np.where(opens, np.arange(n), 0))
        opens |= since % longest == 0
    at = np.flatnonzero(opens)
    of_text = np.searchsorted(text[at], np.arange(len(texts) + 1))
    stop = np.concatenate([word_start[at[1:]], [0]]).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    if len(at):
        final = np.unique(of_text[1:][np.diff(of_text) > 0]) - 1
        stop[final] = offsets[text[at[final]] + 1]
    # hashes of runs of words: a polynomial over their letters, where each word begins with a mark of its own
    letters = np.flatnonzero(inside)
    mark = np.zeros(len(flat), dtype=bool)
    mark[word_start] = True
    value = _VALUE[_LOWER[flat[letters]]]
    value[mark[letters]] *= np.uint64(0x9FB21C651E98DF25)
    power = np.full(len(letters) + 1, np.uint64(_P), dtype=np.uint64)
    inverse = np.full(len(letters) + 1, np.uint64(_INVERSE), dtype=np.uint64)
    power[0] = inverse[0] = 1
    power, inverse = np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(value * power[:-1], dtype=np.uint64)])
    second = np.concatenate([[np.uint64(0)], np.cumsum(_SECOND[_LOWER[flat[letters]]], dtype=np.uint64)])
    place = np.concatenate([np.searchsorted(letters, word_start), [len(letters)]]).astype(np.int64)
    words = np.concatenate([at, [n]]).astype(np.int64)

    def word_hash_of(first: np.ndarray, last: np.ndarray, salt: int = _WORDS) -> np.ndarray:
        a, b = place[first], place[last]
        return mixed(((total[b] - total[a]) * inverse[a]) ^ mixed((last - first + salt).astype(np.uint64)))

    def check_of(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (mixed(second[place[last]] - second[place[first]]) >> np.uint64(32)).astype(np.uint32)

    def hash_of(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return word_hash_of(words[first], words[last], 0)

    return Sentences(word_start[at], stop, words, of_text, hash_of, word_start, np.searchsorted(text, np.arange(len(texts) + 1)), word_hash_of, check_of)


@dataclass
class Runs:
    """Runs of words or sentences: two hashes, the row's order and text hash, and where the run begins and ends."""

    h: np.ndarray
    c: np.ndarray
    k: np.ndarray
    th: np.ndarray
    a: np.ndarray
    b: np.ndarray

    def take(self, at: np.ndarray) -> Runs:
        return Runs(*[x[at] for x in self.columns()])

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.h, self.c, self.k, self.th, self.a, self.b

    @classmethod
    def joined(cls, parts: list[tuple[np.ndarray, ...]]) -> Runs:
        return cls(*[np.concatenate(x) for x in zip(*parts)])

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """(places of first occurrences, places of others); occurrences with the same id, text and place are one."""
        order = np.lexsort((self.a, self.th, self.k, self.c, self.h))
        now = self.take(order)
        new = np.ones(len(order), dtype=bool)
        new[1:] = (now.h[1:] != now.h[:-1]) | (now.c[1:] != now.c[:-1])
        leader = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        other = (now.k != now.k[leader]) | (now.th != now.th[leader]) | (now.a != now.a[leader])
        return order[new], order[other]


class _Seen:
    """First occurrences that a task has sent, of a bounded number of runs, ascending by hash."""

    def __init__(self) -> None:
        self.runs = Runs(np.zeros(0, np.uint64), np.zeros(0, np.uint32), *[np.zeros(0, np.int64)] * 4)
        self.again = np.zeros(0, dtype=bool)

    def sort_out(self, found: Runs) -> tuple[np.ndarray, np.ndarray]:
        """(places of runs, ascending by hash and without repeats, that must be sent; places of those that go)."""
        mine = self.runs
        at = np.searchsorted(mine.h, found.h)
        near = np.minimum(at, max(0, len(mine.h) - 1))
        known = (mine.h[near] == found.h) & (mine.c[near] == found.c) if len(mine.h) else np.zeros(len(found.h), dtype=bool)
        there, here = near[known], np.flatnonzero(known)
        sign = np.zeros(len(here), dtype=np.int64)
        for x, y in ((mine.a, found.a), (mine.th, found.th), (mine.k, found.k)):
            sign = np.where(x[there] != y[here], np.where(x[there] < y[here], -1, 1), sign)
        self.again[there] = True
        before, after = there[sign > 0], here[sign > 0]
        for x, y in zip(mine.columns(), found.columns()):
            x[before] = y[after]
        new = np.flatnonzero(~known)
        sent, gone = np.sort(np.concatenate([new, after])), here[sign < 0]
        if len(mine.h) + len(new) > _REMEMBERED:
            held = self.again & (self.again.sum() < _REMEMBERED // 2)
            self.runs, self.again = mine.take(np.flatnonzero(held)), np.zeros(int(held.sum()), dtype=bool)
            at = np.searchsorted(self.runs.h, found.h)
        if len(self.runs.h) + len(new) <= _REMEMBERED:
            self.runs = Runs(*[np.insert(x, at[new], y[new]) for x, y in zip(self.runs.columns(), found.columns())])
            self.again = np.insert(self.again, at[new], False)
        return sent, gone


_ROWS = "bucket int, gone boolean, h binary, c binary, k binary, th binary, a binary, b binary"
_KINDS = (np.uint64, np.uint32, np.int64, np.int64, np.int64, np.int64)


def _rows(bucket: np.ndarray, gone: bool, runs: Runs) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)
    parts = [order[x:y] for x, y in zip(cuts[:-1], cuts[1:])]
    columns = [pa.array([b"" if gone and n < 2 else squeezed(x[p]) for p in parts], pa.binary()) for n, x in enumerate(runs.columns())]
    return pa.RecordBatch.from_arrays([pa.array([int(bucket[p[0]]) for p in parts], pa.int32()), pa.array([gone] * len(parts), pa.bool_()), *columns], ["bucket", "gone", "h", "c", "k", "th", "a", "b"])


def _runs_of(found: Sentences, sentences: int, words: int, passage: int, step: int) -> tuple[np.ndarray, ...]:
    """(hash, second hash, text, first, last + 1) of the runs of a slice; runs of words have _WORDS added to their place."""
    first, last = found.runs(sentences, words)
    row = np.searchsorted(found.of_text, first, side="right") - 1
    word, word_h = found.word_runs(passage - step + 1, step)
    word_row = np.searchsorted(found.word_of_text, word, side="right") - 1
    place, size = word - found.word_of_text[word_row] + _WORDS, passage - step + 1
    both = ((found.hash_of(first, last), word_h), (found.check_of(found.words[first], found.words[last]), found.check_of(word, word + size)), (row, word_row))
    both += ((first - found.of_text[row], place), (last - found.of_text[row], place + size))
    return tuple(np.concatenate(x) for x in both)


def repeated_runs(df: DataFrame, buckets: int, sentences: int, words: int, longest: int, passage: int, step: int) -> DataFrame:
    """k, th and range (first << 32 | last + 1: sentence numbers, or word numbers plus _WORDS) of each run that goes, of texts (k, th, t)."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for part in slices(batches, "t", SLICE):
            h, c, row, a, b = _runs_of(sentences_of(texts_of(part, "t"), longest), sentences, words, passage, step)
            k, th = (part.column(n).to_numpy(zero_copy_only=False)[row] for n in ("k", "th"))
            runs = Runs(h, c, k, th, a, b)
            first, other = runs.repeats()
            firsts = runs.take(first)
            sent, before = seen.sort_out(firsts)
            kept, gone = firsts.take(sent), Runs.joined([runs.take(other).columns(), firsts.take(before).columns()])
            yield _rows((kept.h % np.uint64(buckets)).astype(np.int64), False, kept)
            # what goes is dealt by text, so that a passage in many texts doesn't gather in its hash's bucket
            yield _rows((mixed(gone.th.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), True, gone)

    def ranges(k: np.ndarray, th: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(th), pa.array((a << 32) | b)], ["k", "th", "range"])

    def settled(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        runs = Runs.joined(held)
        return ranges(*runs.take(runs.repeats()[1]).columns()[2:])

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None  # the runs of one bucket
        for batch in batches:
            for bucket, gone, *parts in zip(*[batch.column(n).to_pylist() for n in ("bucket", "gone", "h", "c", "k", "th", "a", "b")]):
                if gone:
                    yield ranges(*[unsqueezed(x).astype(np.int64) for x in parts[2:]])
                    continue
                if held and bucket != now:
                    yield settled(held)
                    held = []
                now = bucket
                held.append(tuple(unsqueezed(x).astype(kind) for x, kind in zip(parts, _KINDS)))
        if held:
            yield settled(held)

    partitions = min(buckets, MAX_PARTITIONS)
    dealt = df.mapInArrow(spread, _ROWS).repartitionById(partitions, F.col("bucket") % partitions)
    return dealt.sortWithinPartitions("bucket").mapInArrow(settle, "k bigint, th bigint, range bigint")


def _covered(pairs: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the stretches (first, last + 1)."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, pairs[:, 1], -1)
    return np.cumsum(edge)[:-1] > 0


def remove_repeated_spans(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = 2, words: int = 25, longest: int = 20, counts: bool = True, rows_per_bucket: int = 4_000, passage: int = 51, step: int = 7
) -> DataFrame:
    """All rows and columns of `df`, the text without the sentences of repeated runs and without repeated runs of words.

    With `counts` the columns n_sentences and n_removed (long; sentences that lose words) follow; a column of that name is an error. A text from
    which nothing goes stays as it is, byte for byte; one that loses everything becomes empty, a null text stays null.
    Every row is an occurrence of its own: of rows with equal ids and texts one is the first. A null id comes last in
    the order, ids that aren't whole numbers are ordered by a hash, and equal ids by their texts' hashes.
    """
    if counts and {"n_sentences", "n_removed"} & set(df.columns):
        raise ValueError("the table has a column n_sentences or n_removed of its own")
    whole = isinstance(df.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    order = F.coalesce(df[id_col].cast("long") if whole else F.xxhash64(df[id_col]), F.lit((1 << 63) - 1))
    keys = df.select(order.alias("k"), F.xxhash64(df[text_col]).alias("th"), df[text_col].alias("t"))
    # narrow rows, combined in the tasks: which id and text come more than once
    alike = written(keys.where("t is not null").groupBy("k", "th").agg(F.count("*").alias("m")), "span-keys")
    every = alike.agg(F.sum("m"), F.max("m")).first()
    buckets = min(MAX_BUCKETS, max(8, -(-(every[0] or 0) // rows_per_bucket)))
    gone = repeated_runs(keys, buckets, sentences, words, longest, passage, step)
    # a text has a bounded number of runs
    gone = gone.groupBy("k", "th").agg(F.collect_list("range").alias("_ranges"))
    columns = [f"_c{n}" for n in range(len(df.columns))]
    place = df.columns.index(text_col)
    named = df.select(*[df[c].alias(n) for c, n in zip(df.columns, columns)], order.alias("k"), F.xxhash64(df[text_col]).alias("th"))
    if (every[1] or 0) > 1:
        copies = alike.where("m > 1").select("k", "th")
        # of such rows each gets a number, fixed by the writing; all but the first lose every run they have
        several = written(named.join(copies, ["k", "th"], "left_semi").withColumn("_n", F.monotonically_increasing_id()), "span-copies")
        least = several.groupBy("k", "th").agg(F.min("_n").alias("_least"))
        several = several.join(least, ["k", "th"]).withColumn("_all", F.col("_n") > F.col("_least")).drop("_n", "_least")
        named = named.join(copies, ["k", "th"], "left_anti").withColumn("_all", F.lit(False)).unionByName(several)
    else:
        named = named.withColumn("_all", F.lit(False))
    marked = named.join(gone, ["k", "th"], "left").select(*columns, "_ranges", "_all")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, columns[place], SLICE):
            texts = texts_of(part, columns[place])
            found = sentences_of(texts, longest)
            flat, offsets = bytes_of(texts)
            number = np.diff(found.of_text)
            removed = np.zeros(len(texts), dtype=np.int64)
            ranges, all_ = part.column("_ranges"), part.column("_all").to_numpy(zero_copy_only=False).astype(bool)
            made, own = None, _runs_of(found, sentences, words, passage, step)[2:] if all_.any() else None
            for i in np.flatnonzero(all_ | pc.is_valid(ranges).to_numpy(zero_copy_only=False)).tolist():
                if all_[i]:
                    pairs = np.stack([x[own[0] == i] for x in own[1:]], axis=1)
                else:
                    packed = ranges[i].values.to_numpy(zero_copy_only=False)
                    pairs = np.stack([packed >> 32, packed & 0xFFFFFFFF], axis=1)
                if not len(pairs):
                    continue
                start = found.word_start[found.word_of_text[i] : found.word_of_text[i + 1]]
                opens = np.append(found.words[found.of_text[i] : found.of_text[i + 1]] - found.word_of_text[i], len(start))
                sentence = pairs[:, 0] < _WORDS
                goes = _covered(opens[pairs[sentence]], len(start))
                word_runs = pairs[~sentence] - _WORDS
                left = np.concatenate([[0], np.cumsum(~goes)])[word_runs]
                goes |= _covered(word_runs[left[:, 1] - left[:, 0] >= longest], len(start))
                removed[i] = np.logical_or.reduceat(goes, opens[:-1]).sum()
                turns = np.flatnonzero(np.diff(np.concatenate([[True], goes, [True]]))).reshape(-1, 2)  # stretches of words that stay
                edges = np.append(start, offsets[i + 1])
                kept = b"".join(flat[x:y].tobytes() for x, y in edges[turns].tolist())
                made = texts.to_pylist() if made is None else made
                made[i] = kept.decode().rstrip() if goes[-1] else kept.decode()
            column = part.column(columns[place]) if made is None else pa.array(made, part.column(columns[place]).type, mask=pc.is_null(part.column(columns[place])).to_numpy(zero_copy_only=False))
            out = [column if n == place else part.column(c) for n, c in enumerate(columns)]
            if counts:
                out += [pa.array(number), pa.array(removed)]
            yield pa.RecordBatch.from_arrays(out, names)

    names = df.columns + (["n_sentences", "n_removed"] if counts else [])
    schema = T.StructType([*df.schema.fields, *([T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())] if counts else [])])
    return marked.mapInArrow(run, schema)
