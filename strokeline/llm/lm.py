"""Language-model scores by a weighted backoff automaton.

The model counts n-grams up to an order in the training texts and smooths each order with the one below by a Dirichlet
prior: P(w | h) = (c(h w) + m P(w | shorter h)) / (c(h) + m). As an automaton, contexts are states; a seen n-gram is an
arc with its smoothed log-probability, and a failure arc of weight log(m / (c(h) + m)) leads to the state of the context
without its first word. One traversal from left to right carries the state, falls along failure arcs until the state has
an arc for the token, and sums the weights.

No task or driver ever holds the whole model. Texts are cut into blocks; each block sends the distinct n-grams it needs,
with its own training counts, to buckets by hash, and gets the corpus counts of just these back: its part of the
automaton, as large as the block, whatever the corpus. Every n-gram of the training texts is counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import dropped, written
from .text_arrow import coded, hashes_of, mixed, slices, squeezed, texts_of, unsqueezed, words_of

BLOCK_BYTES = 4 << 20
#: At most so many partitions take part in counting, however large the corpus; more buckets than these share them.
MAX_PARTITIONS = 4096
_MAX_BUCKETS = 1 << 16
BLOCKS_PER_PARTITION = 4
_END, _START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)
_ORDER_STEP = mixed(np.arange(100, 116, dtype=np.uint64)) | np.uint64(1)
#: A lane of the traversal reads so many tokens.
_LANE = 256
ROOT, START = 0, 1


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token codes, offsets by text, hash of each code): words in lower case and an end; frequent tokens have small codes."""
    words, word_offsets = words_of(pc.ascii_lower(texts))
    codes, distinct = coded(words)
    offsets = word_offsets + np.arange(len(texts) + 1)
    token = np.full(len(codes) + len(texts), len(distinct), dtype=np.int64)
    inner = np.ones(len(token), dtype=bool)
    inner[offsets[1:] - 1] = False
    token[inner] = codes
    order = np.argsort(-np.bincount(token, minlength=len(distinct) + 1), kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank[token], offsets, np.append(hashes_of(distinct), _END)[order]


@dataclass
class Level:
    """The distinct n-grams of one order in a block, ascending by hash."""

    distinct: np.ndarray
    at: np.ndarray  # place of the n-gram that ends at each token, -1 where the text's start is too near
    own: np.ndarray  # count in the block's training texts
    last: np.ndarray  # code of the last token
    prefix: np.ndarray  # place of the n-gram without its last token one level below, -1 for the text's start
    suffix: np.ndarray  # place of the n-gram without its first token one level below


@dataclass
class Block:
    """The tokens of a block and its n-grams, order by order."""

    tokens: np.ndarray
    offsets: np.ndarray
    end: int  # code of the end token, -1 without texts
    types: int
    levels: list[Level]

    @classmethod
    def of(cls, tokens: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, training: np.ndarray, order: int) -> Block:
        n, lengths = len(tokens), np.diff(offsets)
        position = np.arange(n) - np.repeat(offsets[:-1], lengths)
        trains = np.repeat(training, lengths)
        key, before, levels = hashes[tokens], np.full(n, -1, dtype=np.int64), []
        for k in range(1, order + 1):
            if k > 1:
                previous = np.concatenate([[_START], key[:-1]])
                previous[position == 0] = _START
                key = mixed(previous * _ORDER_STEP[k] + hashes[tokens])
            there = np.flatnonzero(position >= k - 2)
            values, first, inverse = np.unique(key[there], return_index=True, return_inverse=True)
            at = np.full(n, -1, dtype=np.int64)
            at[there] = inverse
            first = there[first]
            prefix = np.where(position[first] > 0, before[first - 1], -1) if k > 1 else np.full(len(first), -1)
            suffix = before[first] if k > 1 else np.full(len(first), -1)
            levels.append(Level(values, at, np.bincount(inverse[trains[there]], minlength=len(values)), tokens[first], prefix, suffix))
            before = at
        return cls(tokens, offsets, int(tokens[-1]) if n else -1, len(hashes), levels)


class Automaton:
    """A block's part of the backoff automaton, from corpus counts of its n-grams.

    States: ROOT (no context), START (a text's start), and the seen n-grams shorter than the order. `arcs` holds
    state * types + token, ascending; `weight` and `target` belong to it. Every state but ROOT has a failure arc.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], tokens: int, types: int, starts: int, priors: tuple[float, ...]):
        order, self.types = len(block.levels), block.types
        base = np.cumsum([2, *[len(x.distinct) for x in block.levels]])[:-1]
        states = 2 + sum(len(x.distinct) for x in block.levels[:-1]) if order > 1 else 2
        self.fail, self.fail_weight = np.zeros(states, dtype=np.int64), np.zeros(states)
        if order > 1:
            self.fail_weight[START] = math.log10(priors[0] / (starts + priors[0]))
        arcs, weights, targets, p = [], [], [], None
        for k, (level, count) in enumerate(zip(block.levels, counts), 1):
            if k == 1:
                # the root has a prior count for every known type and for the unknown one, and an arc for every token
                p, source, seen = (count + 1.0) / (tokens + types + 1.0), np.full(len(count), ROOT), np.ones(len(count), dtype=bool)
            else:
                prior, begun = priors[k - 2], level.prefix < 0
                context = np.where(begun, starts, counts[k - 2][level.prefix])
                p = (count + prior * p[level.suffix]) / (context + prior)
                source, seen = np.where(begun, START, base[k - 2] + level.prefix), count > 0
            if k < order:
                here = np.arange(len(count)) + base[k - 1]
                self.fail[here] = ROOT if k == 1 else base[k - 2] + level.suffix
                self.fail_weight[here] = np.log10(priors[k - 1] / (count + priors[k - 1]))
                target = np.where(count > 0, here, ROOT)
            else:
                target = base[k - 2] + level.suffix if k > 1 else np.full(len(count), ROOT)
            target = np.where(level.last == block.end, ROOT, target)
            arcs.append((source * self.types + level.last)[seen])
            weights.append(np.log10(p[seen]))
            targets.append(target[seen])
        arcs = np.concatenate(arcs)
        sort = np.argsort(arcs, kind="stable")
        self.order, self.arcs, self.weight, self.target = order, arcs[sort], np.concatenate(weights)[sort], np.concatenate(targets)[sort]

    def read(self, tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 P of each token in its context.

        Texts are read side by side, long ones in lanes: a state depends on the last order - 1 tokens alone, so a lane
        that begins inside a text first reads these from the root.
        """
        made, lengths = np.zeros(len(tokens)), np.diff(offsets)
        number = -(-lengths // _LANE)
        text = np.repeat(np.arange(len(lengths)), number)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
        begin = offsets[text] + nth * _LANE
        stop = np.minimum(begin + _LANE, offsets[text + 1])
        warm = np.where(nth > 0, self.order - 1, 0)
        order = np.argsort(-(stop - begin + warm), kind="stable")
        begin, stop, warm = begin[order], stop[order], warm[order]
        at = begin - warm
        state = np.where(nth[order] > 0, ROOT, START if self.order > 1 else ROOT)
        length = stop - at
        for step in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -step, side="left"))
            token, total = tokens[at[:n] + step], np.zeros(n)
            open_, now = np.arange(n), state[:n].copy()
            while len(open_):
                wanted = now[open_] * self.types + token[open_]
                place = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
                found = self.arcs[place] == wanted
                hit, taken = open_[found], place[found]
                total[hit] += self.weight[taken]
                now[hit] = self.target[taken]
                open_ = open_[~found]
                total[open_] += self.fail_weight[now[open_]]
                now[open_] = self.fail[now[open_]]
            state[:n] = now
            counts = step >= warm[:n]
            made[at[:n][counts] + step] = total[counts]
        return made


def _buckets_of(distinct: np.ndarray, fine: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the buckets with n-grams, ends of their stretches); the first bits of the hash are the bucket."""
    edge = np.searchsorted(distinct, np.arange(fine, dtype=np.uint64) << np.uint64(64 - fine.bit_length() + 1))
    edge = np.append(edge, len(distinct))
    some = np.flatnonzero(np.diff(edge))
    return some, np.append(edge[some], len(distinct))


def score_texts(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 3, prior: float | tuple[float, ...] = (300.0, 3.0)) -> DataFrame:
    """id, n_tokens, n_known, train_tokens (long), base_score and score (double: log10 probability) of every whole text.

    Tokens are words in lower case (A-Z) and an end; a null text is its end alone. Rows for which `training` is true,
    and no others, are counted; a null counts as false. n_known tokens occur in training texts, and base_score is the
    add-one unigram score. `prior` holds the Dirichlet prior of each order from the second; one number serves all. Rows
    are scored one by one, so repeated and null ids stay. N-grams are told apart by hashes of 20 bits more than the
    number of tokens has, 64 at most, so one in a million is confused with another.
    """
    priors = (float(prior),) * (order - 1) if isinstance(prior, (int, float)) else tuple(prior)[: order - 1]
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("i"), df[text_col].alias("t"), F.coalesce(training, F.lit(False)).alias("w"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for part in slices(batches, "t", BLOCK_BYTES):
            tokens, offsets, hashes = tokens_of(texts_of(part, "t"))
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("i"))
            packed = [squeezed(x) for x in (tokens, np.diff(offsets), part.column("w").to_numpy(zero_copy_only=False).astype(np.uint8))]
            yield pa.RecordBatch.from_arrays([pa.array([number]), ids, pa.array([len(tokens)]), *[pa.array([x], pa.binary()) for x in (*packed, hashes.tobytes())]], ["block", "i", "n", "t", "l", "w", "h"])
            number += 1

    # written once: a block's number and rows stay the same for all that follows
    blocks = written(rows.mapInArrow(cut, f"block bigint, i array<{kind}>, n bigint, t binary, l binary, w binary, h binary"), "lm-blocks")
    about = blocks.agg(F.sum("n"), F.count("*")).first()
    every, number_of_blocks = int(about[0] or 0), int(about[1])
    fine = min(_MAX_BUCKETS, max(64, 1 << max(0, (every >> 20).bit_length())))
    partitions = min(fine, MAX_PARTITIONS)
    dropped_bits = np.uint64(64 - min(64, max(40, every.bit_length() + 20)))

    def block_of(batch: pa.RecordBatch, k: int) -> tuple[Block, np.ndarray]:
        tokens, lengths, flags = (unsqueezed(batch.column(c)[k].as_py()) for c in ("t", "l", "w"))
        trains = flags.astype(bool)
        return Block.of(tokens.astype(np.int64), np.concatenate([[0], np.cumsum(lengths.astype(np.int64))]), np.frombuffer(batch.column("h")[k].as_py(), dtype=np.uint64), trains, order), trains

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                made, trains = block_of(batch, k)
                for n, level in enumerate(made.levels):
                    buckets, ends = _buckets_of(level.distinct, fine)
                    key, size = level.distinct >> dropped_bits, len(buckets)
                    steps = np.diff(key, prepend=np.uint64(0))
                    steps[ends[:-1]] = key[ends[:-1]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(buckets.astype(np.int32)),
                            pa.array([batch.column("block")[k].as_py()] * size, pa.int64()),
                            pa.array([n] * size, pa.int32()),
                            pa.array([squeezed(steps[x:y]) for x, y in zip(ends[:-1], ends[1:])], pa.binary()),
                            pa.array([squeezed(level.own[x:y]) for x, y in zip(ends[:-1], ends[1:])], pa.binary()),
                            pa.array([int(trains.sum()) if n == 0 and b == 0 else 0 for b in range(size)], pa.int64()),
                        ],
                        ["bucket", "block", "level", "h", "c", "starts"],
                    )

    def settled(level: int, bucket: int, blocks: list[int], h: list[bytes], c: list[bytes], starts: int) -> pa.RecordBatch:
        keys = [np.cumsum(unsqueezed(x), dtype=np.uint64) for x in h]
        ends = np.cumsum([0, *map(len, keys)])
        key, own = np.concatenate(keys), np.concatenate([unsqueezed(x).astype(np.int64) for x in c])
        sort = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[sort][1:] != key[sort][:-1]])
        total = np.add.reduceat(own[sort], np.flatnonzero(new))
        all_ = np.empty(len(key), dtype=np.int64)
        all_[sort] = total[np.cumsum(new) - 1]
        counts = (int((total > 0).sum()), int(total.sum())) if level == 0 else (0, 0)
        size = len(blocks)
        once = [pa.array([x] + [0] * (size - 1), pa.int64()) for x in (*counts, starts)]
        packed = pa.array([squeezed(all_[x:y]) for x, y in zip(ends[:-1], ends[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([level] * size, pa.int32()), pa.array([bucket] * size, pa.int32()), packed, *once], ["block", "level", "bucket", "c", "types", "tokens", "starts"])

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, which = [], None  # the rows of one level and bucket
        for batch in batches:
            for level, bucket, block, h, c, starts in zip(*[batch.column(n).to_pylist() for n in ("level", "bucket", "block", "h", "c", "starts")]):
                if held and which != (level, bucket):
                    yield settled(*which, *map(list, list(zip(*held))[:3]), sum(x[3] for x in held))
                    held = []
                which = (level, bucket)
                held.append((block, h, c, starts))
        if held:
            yield settled(*which, *map(list, list(zip(*held))[:3]), sum(x[3] for x in held))

    sent = blocks.mapInArrow(spread, "bucket int, block bigint, level int, h binary, c binary, starts bigint")
    sent = sent.repartitionById(partitions, F.col("bucket") % partitions).sortWithinPartitions("level", "bucket")
    counted = written(sent.mapInArrow(settle, "block bigint, level int, bucket int, c binary, types bigint, tokens bigint, starts bigint"), "lm-counts")
    types, tokens, starts = (int(x or 0) for x in counted.agg(F.sum("types"), F.sum("tokens"), F.sum("starts")).first())
    # a block has a bounded number of n-grams
    # some blocks for each partition, whatever the session's number of them
    shares = min(MAX_PARTITIONS, max(8, -(-number_of_blocks // BLOCKS_PER_PARTITION)))
    own = counted.repartition(shares, "block").groupBy("block").agg(F.collect_list(F.struct("level", "bucket", "c")).alias("found"))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                made, _ = block_of(batch, k)
                counts = [np.zeros(len(x.distinct), dtype=np.int64) for x in made.levels]
                split = [dict(zip(buckets.tolist(), zip(ends[:-1].tolist(), ends[1:].tolist()))) for buckets, ends in (_buckets_of(x.distinct, fine) for x in made.levels)]
                found = batch.column("found").slice(k, 1).flatten()
                for level, b, c in zip(*[found.field(n).to_pylist() for n in ("level", "bucket", "c")]):
                    x, y = split[level][b]
                    counts[level][x:y] = unsqueezed(c)
                weights = Automaton(made, counts, tokens, types, starts, priors).read(made.tokens, made.offsets)
                c = counts[0][made.levels[0].at]
                base = np.log10((c + 1.0) / (tokens + 1.0 * (types + 1)))
                # every text has its end, so no stretch is empty
                summed = [np.add.reduceat(x, made.offsets[:-1]) if len(made.offsets) > 1 else x for x in ((c > 0).astype(np.int64), base, weights)]
                n = len(made.offsets) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("i").slice(k, 1).flatten(), pa.array(np.diff(made.offsets)), pa.array(summed[0]), pa.array(np.full(n, tokens, np.int64)), pa.array(summed[1]), pa.array(summed[2])], ["i", "n", "k", "w", "b", "s"]
                )

    met = blocks.repartition(shares, "block").join(own, "block").drop("n")
    scored = written(met.mapInArrow(score, f"i {kind}, n bigint, k bigint, w bigint, b double, s double"), "lm-scores")
    dropped(df.sparkSession, blocks, counted)
    return scored.toDF(id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score")
