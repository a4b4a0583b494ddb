"""Benchmark decontamination on templates.

Words become template tokens: numbers, units and names turn into typed placeholders, other words are lower-cased and
stripped of punctuation. Windows of template tokens are matched by hash between benchmark items and texts. For a text
and an item, the slots behind the placeholders must be consistent: equal values of the item stand for equal values of
the text throughout an occurrence; windows with a slot against its majority don't count, and where a name stands for two
names, only windows with the item's own values do. A capitalised word that opens a sentence may be a name or not: windows
take it both ways. A window with too few words of its own to be a template is matched word by word instead. A text leaks an item if the
windows of one occurrence that count cover enough of the item's tokens - verbatim, or with other numbers, names and units.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .text_arrow import coded, hashes_of, mixed, row_of, slices, texts_of, words_of

NUMBER, UNIT, NAME = 1, 2, 3
#: Units of length, mass, volume, time, money, temperature and share.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters "
    "mg g kg lb lbs oz ounce ounces pound pounds gram grams kilogram kilograms ton tons tonne tonnes "
    "ml l liter liters litre litres gallon gallons cup cups pint pints "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "$ dollar dollars cent cents euro euros usd eur "
    "c f degree degrees celsius fahrenheit k kelvin % percent mph kph w watt watts v volt volts j joule joules hz"
).split()
_STEP = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
#: Up to so many benchmark windows are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000
#: Size of the set of bits that tells which windows of a text a larger benchmark may hold.
_KNOWN_BITS = 1 << 26


@dataclass
class Templates:
    token: np.ndarray  # hash of the template token, by word
    value: np.ndarray  # hash of the word behind a placeholder, the last two bits its type; 0 for other words
    offsets: np.ndarray
    named: tuple[np.ndarray, np.ndarray]  # token and value, where capitalised words that open a sentence are names

    def values(self, at: np.ndarray, named: np.ndarray, size: int) -> np.ndarray:
        """Values of the `size` words from each place on, in the reading that `named` tells for it."""
        places = at[:, None] + np.arange(size)
        return np.where(named[:, None], self.named[1][places], self.value[places])

    def readings(self, size: int, literals: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
        """(whether opening words are names, hashes, whether there is a window at each place), a window without such words once only."""
        key, there = self.windows(size, literals)
        yield False, key, there.copy()
        n = len(self.token)
        opening = np.concatenate([[0], np.cumsum(self.named[1] != self.value)])
        plain = np.concatenate([[0], np.cumsum(self.named[1] == 0)])
        if n >= size and opening[-1]:
            both = np.zeros(n, dtype=bool)
            both[: n - size + 1] = (opening[size:] > opening[:-size]) & (plain[size:] - plain[:-size] >= literals)
            at = np.flatnonzero(both & there)
            key = np.zeros(n, dtype=np.uint64)
            for k in range(size):
                key[at] += self.named[0][at + k] * _STEP[k]
            yield True, mixed(key), both & there

    def windows(self, size: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the window at each place, whether there is one, that is, whether it lies in one text).

        A window with fewer than `literals` words of its own stands for itself, not for others of its form.
        """
        n = len(self.token)
        key, own = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
        plain = np.concatenate([[0], np.cumsum(self.value == 0)])
        for k in range(min(size, n)):
            key[: n - k] += self.token[k:] * _STEP[k]
            own[: n - k] += (self.token[k:] ^ self.value[k:]) * _STEP[k]
        row = row_of(self.offsets)
        there = np.zeros(n, dtype=bool)
        if n >= size:
            few = plain[size:] - plain[:-size] < literals
            key[: n - size + 1][few] = own[: n - size + 1][few] ^ _STEP[-1]
            there[: n - size + 1] = row[: n - size + 1] == row[size - 1 :]
        return mixed(key), there


def templates(texts: pa.Array) -> Templates:
    words, offsets = words_of(texts)
    codes, distinct = coded(words)
    bare = pc.replace_substring_regex(distinct, r"^[^\p{L}\p{N}$%]+|[^\p{L}\p{N}$%]+$", "")
    plain = pc.utf8_lower(bare)
    number = pc.match_substring_regex(bare, r"^[$]?[\p{N}][\p{N}.,:/]*%?$").to_numpy(zero_copy_only=False)
    unit = pc.is_in(plain, pa.array(UNITS)).to_numpy(zero_copy_only=False)
    capital = pc.match_substring_regex(bare, r"^\p{Lu}\p{Ll}+").to_numpy(zero_copy_only=False)
    ends = pc.match_substring_regex(distinct, r"[.!?:][^\p{L}\p{N}]*$").to_numpy(zero_copy_only=False)
    word = hashes_of(plain)
    opens = np.ones(len(codes), dtype=bool)
    opens[1:] = ends[codes[:-1]]
    opens[offsets[:-1][offsets[:-1] < len(codes)]] = True
    after_number = np.zeros(len(codes), dtype=bool)
    after_number[1:] = number[codes[:-1]]
    # a unit is a unit only after a number: "a", "in" or "second" are ordinary words elsewhere
    kind = np.where(number[codes], NUMBER, np.where(unit[codes] & after_number, UNIT, np.where(capital[codes] & ~opens, NAME, 0)))
    named = np.where((kind == 0) & capital[codes], NAME, kind)
    made = [(np.where(k == 0, word[codes], mixed(k.astype(np.uint64))), np.where(k == 0, np.uint64(0), word[codes] & ~np.uint64(3) | k.astype(np.uint64))) for k in (kind, named)]
    return Templates(*made[0], offsets, made[1])


def _judged_together(length: int, own: np.ndarray, doc_at: np.ndarray, item_at: np.ndarray, doc_value: np.ndarray) -> tuple[float, bool, bool]:
    """(share, whether slots differ, whether all windows count) of windows whose slots must agree with one another."""
    width = np.arange(own.shape[1])
    slot = own != 0
    votes: dict[int, Counter] = defaultdict(Counter)
    place = (doc_at[:, None] + width)[slot]
    for p, a, b in sorted(set(zip(place.tolist(), own[slot].tolist(), doc_value[slot].tolist()))):
        votes[a][b] += 1
    chosen = {a: max(c.items(), key=lambda x: (x[1], x[0] == a, -x[0]))[0] for a, c in votes.items()}
    if any(len(c) > 1 and a & 3 == NAME for a, c in votes.items()):  # equal numbers may be so by chance, equal names aren't
        chosen = {a: a for a in chosen}
    expected = np.array([chosen.get(a, 0) for a in own.ravel().tolist()], dtype=np.uint64).reshape(own.shape)
    good = (~slot | (expected == doc_value)).all(axis=1)
    covered = np.zeros(length, dtype=bool)
    for q in np.unique(item_at[good]).tolist():
        covered[q : q + len(width)] = True
    return float(covered.mean()) if length else 0.0, any(a != b for a, b in chosen.items()), bool(good.all())


def judged(length: int, own: np.ndarray, doc_at: np.ndarray, item_at: np.ndarray, doc_value: np.ndarray) -> tuple[float, bool]:
    """(share of an item's words that consistent windows cover, whether a slot has another value than the item's), of the best occurrence.

    own[window, k] and doc_value[window, k] are the values of word k of each window in the item and in the text. An occurrence
    is what has one alignment (place in the text less place in the item), or alignments at most half an item apart, as words
    may be put in; or the whole text, as an item may lie about in parts. Equal shares: the one with the item's own values.
    """
    share, differ, whole = _judged_together(length, own, doc_at, item_at, doc_value)
    best, align = (share, not differ), doc_at - item_at
    if not whole or differ:
        order = np.argsort(align, kind="stable")
        align, own, doc_at, item_at, doc_value = align[order], own[order], doc_at[order], item_at[order], doc_value[order]
        each = np.unique(align)
        tried = {(0, len(align))}
        for slack in (0, max(own.shape[1], length // 2)):
            for x, y in zip(np.searchsorted(align, each).tolist(), np.searchsorted(align, each + slack, side="right").tolist()):
                if (x, y) not in tried:
                    tried.add((x, y))
                    share, differ, _ = _judged_together(length, own[x:y], doc_at[x:y], item_at[x:y], doc_value[x:y])
                    best = max(best, (share, not differ))
    return best[0], not best[1]


@dataclass
class Benchmark:
    """Windows of all items, sorted by hash; items shorter than a window count whole, by their own length.

    Of an item of fewer than `shortest` words only a text that is nothing else is a leak: "yes" is in too many texts.
    """

    size: int
    literals: int
    shortest: int
    item_ids: list
    made: Templates
    by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # window size: (hashes, items, places, whether opening words are names)
    item_type: pa.DataType = pa.int64()

    @classmethod
    def of(cls, ids: list, texts: pa.Array, size: int, literals: int, shortest: int) -> Benchmark:
        made, by_size = templates(texts), {}
        row, lengths = row_of(made.offsets), np.diff(made.offsets)
        for width in sorted({size, *[int(n) for n in lengths if 0 < n < size]}):
            parts = []
            for named, key, there in made.readings(width, min(literals, width)):
                at = np.flatnonzero(there & (np.minimum(lengths, size) == width)[row])
                parts.append((key[at], row[at], at - made.offsets[row[at]], np.full(len(at), named)))
            hashes, item, place, named = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((named, place, item, hashes))
            by_size[width] = (hashes[order], item[order], place[order], named[order])
        return cls(size, literals, shortest, list(ids), made, by_size)

    def leaks(self, texts: pa.Array, coverage: float) -> list[tuple[int, int, float, bool]]:
        """(text, item, covered share, slots differ) of each leak."""
        made, hits = templates(texts), []
        row = row_of(made.offsets)
        for width, (hashes, item, place, own_named) in self.by_size.items():
            near = np.zeros(1 << 20, dtype=bool)
            near[hashes >> np.uint64(44)] = True
            for named, key, there in made.readings(width, min(self.literals, width)):
                if width < self.shortest:
                    there &= (np.diff(made.offsets) == width)[row]
                at = np.flatnonzero(there & near[key >> np.uint64(44)])
                low, high = np.searchsorted(hashes, key[at], side="left"), np.searchsorted(hashes, key[at], side="right")
                n = high - low
                at, low = np.repeat(at, n), np.repeat(low, n)
                pick = low + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                hits.append((at, item[pick], place[pick], np.full(len(at), width), np.full(len(at), named), own_named[pick]))
        if not hits:
            return []
        at, item, place, width, named, own_named = (np.concatenate(x) for x in zip(*hits))
        pair = row[at] * len(self.item_ids) + item
        order = np.argsort(pair, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(pair[order])) + 1, [len(order)]]) if len(order) else [0]
        found = []
        for x, y in zip(cuts[:-1], cuts[1:]):
            part = order[x:y]
            k, size = int(item[part[0]]), int(width[part[0]])
            start, stop = self.made.offsets[k : k + 2].tolist()
            own = self.made.values(start + place[part], own_named[part], size)
            share, differ = judged(stop - start, own, at[part], place[part], made.values(at[part], named[part], size))
            if share >= coverage:
                found.append((int(row[at[part[0]]]), k, share, differ))
        return found


def _benchmark(benchmark: DataFrame, item_col: str, text_col: str, size: int, literals: int, shortest: int) -> Benchmark | None:
    """The benchmark's windows, if they are few enough to broadcast."""
    words = benchmark.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0]
    if words > 2 * BROADCAST_WINDOWS:  # a word and a space have two characters at least
        return None
    table = benchmark.select(F.col(item_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("t")).orderBy("i", "t").toArrow()
    texts = pa.concat_arrays([pa.array([], pa.string()), *[c.cast(pa.string()) for c in table.column("t").chunks]])
    known = Benchmark.of(table.column("i").to_pylist(), texts, size, literals, shortest)
    known.item_type = table.column("i").type
    return known


def find_leaks(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 8, literals: int = 4, coverage: float = 0.5, shortest: int = 4
) -> DataFrame:
    """Pairs of id and item with coverage (double, of the item's words) and reparameterised (boolean), for each row that leaks an item.

    Null and empty texts leak nothing. Items of fewer than `shortest` words are found where they are the whole text, and
    windows with fewer than `literals` words of their own (all numbers, say) only as they are, not as templates. Rows that repeat an id give a pair each; null ids and items stay null.
    """
    known = _benchmark(benchmark, item_col, item_text_col, size, literals, shortest)
    kind, item_kind = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    texts = df.select(df[id_col].alias("i"), df[text_col].alias("t"))
    schema = f"i {kind}, item {item_kind}, coverage double, reparameterised boolean"
    if known is None:
        items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("t"))
        found = _joined_leaks(texts, items, size, literals, coverage, shortest)
        # each row of either side gives a pair of its own
        found = found.join(items.select("item", _text_key(F.col("t")).alias("k")), "k").join(texts.select("i", _text_key(F.col("t")).alias("d")), "d")
        return found.select("i", "item", "coverage", "reparameterised").toDF(id_col, item_col, "coverage", "reparameterised")
    shared = df.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            found = shared.value.leaks(texts_of(part, "t"), coverage)
            at = pa.array([f[0] for f in found], pa.int64())
            items = pa.array([shared.value.item_ids[f[1]] for f in found], shared.value.item_type)
            yield pa.RecordBatch.from_arrays([part.column("i").take(at), items, pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.bool_())], ["i", "item", "coverage", "reparameterised"])

    return texts.mapInArrow(run, schema).toDF(id_col, item_col, "coverage", "reparameterised")


def _text_key(text: Column) -> Column:
    """128 bits of a text's digest. Equal texts leak the same items and are leaked alike, so each is judged once, and every row takes part by its key."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def _window_rows(df: DataFrame, size: int, literals: int, shortest: int, known: Broadcast | None = None) -> DataFrame:
    """k, n (words of the text), w (window size), p, h and v (values of the window's words) of every window of texts (k, t); with `known`, of those that it may hold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", 1 << 20):
            made = templates(texts_of(part, "t"))
            row, lengths = row_of(made.offsets), np.diff(made.offsets)
            for width in range(1, size + 1):
                for named, h, there in made.readings(width, min(literals, width)):
                    if width < shortest:
                        there &= (lengths == width)[row]
                    if known is not None:
                        low = (h & np.uint64(_KNOWN_BITS - 1)).astype(np.int64)
                        there &= (known.value[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1
                    at = np.flatnonzero(there)
                    if not len(at):
                        continue
                    values = made.values(at, np.full(len(at), named), width).view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * width + 1, width), pa.int32()), pa.array(values.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("k").take(pa.array(row[at])), pa.array(lengths[row[at]]), pa.array(np.full(len(at), width, np.int32)), pa.array(at - made.offsets[row[at]]), pa.array(h[at].view(np.int64)), lists],
                        ["k", "n", "w", "p", "h", "v"],
                    )

    return df.mapInArrow(run, "k binary, n bigint, w int, p bigint, h bigint, v array<bigint>")


def _known_windows(windows: DataFrame) -> Broadcast:
    """A bit for each value that the last bits of the windows' hashes take: of one size, whatever the benchmark's."""
    place = F.col("h").bitwiseAND(_KNOWN_BITS - 1)
    parts = windows.select((place / 32_768).cast("int").alias("part"), (place % 32_768).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    known = np.zeros(_KNOWN_BITS // 8, dtype=np.uint8)
    for part, bits in parts.toLocalIterator():
        known[part * 4096 : part * 4096 + 4096] = np.frombuffer(bits, dtype=np.uint8)
    return windows.sparkSession.sparkContext.broadcast(known)


def _joined_leaks(texts: DataFrame, items: DataFrame, size: int, literals: int, coverage: float, shortest: int) -> DataFrame:
    """d and k (keys of a text and of an item's text), coverage and reparameterised of each leak of texts `t` and items `t`, for a benchmark of any size: windows meet in a shuffled join, then each pair is judged."""
    keyed = lambda df: df.select(F.coalesce("t", F.lit("")).alias("t")).distinct().select(_text_key(F.col("t")).alias("k"), "t")
    right = written(_window_rows(keyed(items), size, literals, shortest).where(f"w = least(n, {size})"), "benchmark-windows")
    left = _window_rows(keyed(texts), size, literals, shortest, _known_windows(right))
    met = left.select(F.col("k").alias("d"), "w", F.col("p").alias("dp"), "h", F.col("v").alias("dv")).join(right.select("k", "n", "w", F.col("p").alias("ip"), "h", F.col("v").alias("iv")), ["h", "w"])

    def judge(rows):
        import pandas as pd

        own, doc = (np.stack([np.asarray(v, dtype=np.int64).view(np.uint64) for v in rows[side]]) for side in ("iv", "dv"))
        share, differ = judged(int(rows["n"].iloc[0]), own, rows["dp"].to_numpy(), rows["ip"].to_numpy(), doc)
        return pd.DataFrame({"d": [rows["d"].iloc[0]], "k": [rows["k"].iloc[0]], "coverage": [share], "reparameterised": [differ]})

    # a group is one text and one item
    return met.groupBy("d", "k").applyInPandas(judge, "d binary, k binary, coverage double, reparameterised boolean").where(F.col("coverage") >= coverage)


def drop_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 8, literals: int = 4, coverage: float = 0.5, shortest: int = 4) -> DataFrame:
    """The rows of `df`, all columns as they are, that leak no item."""
    known = _benchmark(benchmark, item_col, item_text_col, size, literals, shortest)
    if known is None:
        texts, items = df.select(df[text_col].alias("t")), benchmark.select(F.col(item_text_col).alias("t"))
        found = _joined_leaks(texts, items, size, literals, coverage, shortest).select(F.col("d").alias("_leak")).distinct()
        named = df.toDF(*[f"c{n}" for n in range(len(df.columns))])
        kept = named.withColumn("_d", _text_key(F.col(f"c{df.columns.index(text_col)}"))).join(found, F.col("_d") == F.col("_leak"), "left_anti")
        return kept.drop("_d").toDF(*df.columns)
    shared, place = df.sparkSession.sparkContext.broadcast(known), df.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f"c{k}" for k in range(batch.num_columns)]
            for part in slices([pa.RecordBatch.from_arrays(batch.columns, names)], names[place]):
                keep = np.ones(part.num_rows, dtype=bool)
                keep[[f[0] for f in shared.value.leaks(texts_of(part, names[place]), coverage)]] = False
                yield pa.RecordBatch.from_arrays(part.filter(pa.array(keep)).columns, batch.schema.names)

    return df.mapInArrow(run, df.schema)
