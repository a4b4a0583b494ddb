"""Fill-in-the-middle: texts cut at token boundaries and put together again in another order.

A token is a run of ASCII letters or any other single code point. The boundaries of a text are found on whole texts at once:
`bytes.translate` turns its UTF-8 bytes into a mask of letters and one of first bytes of code points, each one big integer
with the first byte as its highest bit; a shift and two boolean operations leave a bit for each token's first byte, and
`bit_count` gives their number. The byte at which a token of a given rank begins is found by halving the mask.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_arrow import slices, texts_of

#: What marks the three parts in an output; a text that contains one of them stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_LETTERS = bytes(49 if 65 <= b <= 90 or 97 <= b <= 122 else 48 for b in range(256))
_FIRSTS = bytes(48 if 0x80 <= b < 0xC0 else 49 for b in range(256))


def masks(data: bytes) -> tuple[int, int]:
    """(first bytes of tokens, first bytes of code points) as integers of len(data) bits, the first byte's bit highest."""
    if not data:
        return 0, 0
    letters, firsts = int(data.translate(_LETTERS), 2), int(data.translate(_FIRSTS), 2)
    return firsts & ~(letters & (letters >> 1)), firsts


def selected(mask: int, width: int, ranks: list[int]) -> list[int]:
    """Places, counted from the highest of `width` bits, of the set bits with the given ascending ranks (0 for the first)."""
    if not ranks:
        return []
    if width == 1:
        return [0] * len(ranks)
    low = width // 2
    high = mask >> low
    count = high.bit_count()
    split = bisect_left(ranks, count)
    left = selected(high, width - low, ranks[:split])
    right = selected(mask & ((1 << low) - 1), low, [r - count for r in ranks[split:]]) if split < len(ranks) else []
    return left + [width - low + place for place in right]


def boundaries(mask: int, width: int, count: int, ranks: list[int]) -> list[int]:
    """The byte offsets after the first r tokens of a text, for ascending r; `count` is the number of its tokens."""
    inside = [r for r in ranks if r < count]
    return selected(mask, width, inside) + [width] * (len(ranks) - len(inside))


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """id, n (tokens), form, prefix_chars, middle_chars (code points) and output, by row.

    The first four groups of eight digits of sha256(`seed:id`) decide, so a row's result depends on nothing but the row.
    With n tokens the two cuts are the first two numbers modulo n + 1, the smaller one first. `plain_percent` of the texts
    stay as they are (form plain, no part lengths), as do empty texts and those that contain a marker; of the others
    `spm_percent` have the suffix first (spm), the rest the prefix (psm). A null text is an empty one; a null id counts as
    an empty string; rows that repeat an id are cut alike if their texts are.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(df[id_col].cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            texts = texts_of(part, "t")
            h1, h2, h3, h4 = (part.column(f"h{k}").to_pylist() for k in (1, 2, 3, 4))
            counts, forms, prefixes, middles, outputs = [], [], [], [], []
            for row, text in enumerate(texts):
                data = text.as_buffer().to_pybytes()
                tokens, firsts = masks(data)
                n = tokens.bit_count()
                plain = not data or any(mark.encode() in data for mark in (PREFIX, SUFFIX, MIDDLE)) or h3[row] % 100 >= 100 - plain_percent
                counts.append(n)
                if plain:
                    forms.append("plain")
                    prefixes.append(None)
                    middles.append(None)
                    outputs.append(data)
                    continue
                width = len(data)
                a, b = boundaries(tokens, width, n, sorted((h1[row] % (n + 1), h2[row] % (n + 1))))
                before = (firsts >> (width - a)).bit_count()
                prefixes.append(before)
                middles.append((firsts >> (width - b)).bit_count() - before)
                first, second = PREFIX.encode() + data[:a], SUFFIX.encode() + data[b:]
                suffix_first = h4[row] % 100 < spm_percent
                forms.append("spm" if suffix_first else "psm")
                outputs.append(b"".join((second, first) if suffix_first else (first, second)) + MIDDLE.encode() + data[a:b])
            arrays = [pa.array(counts, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64())]
            output = pa.array(outputs, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column("i"), *arrays, output], ["i", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = df.schema[id_col].dataType.simpleString()
    cut = df.select(df[id_col].alias("i"), df[text_col].alias("t"), *numbers).mapInArrow(run, f"i {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return cut.withColumnRenamed("i", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that `fill_in_middle` made an output of. No text has a marker, so the first one of each kind ends its part."""
    body = F.substring(output, 4, 2_000_000_000)

    def parts(second: str) -> tuple[Column, Column, Column]:
        one = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(one) + 4, F.lit(2_000_000_000))
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substring(rest, F.length(two) + 4, F.lit(2_000_000_000))

    prefix, suffix, middle = parts(SUFFIX)
    late_suffix, late_prefix, late_middle = parts(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(late_prefix, late_middle, late_suffix)).otherwise(output)
