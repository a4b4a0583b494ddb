"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a slice of texts are laid out as one array of symbols. An index maps every adjacent pair that
the vocabulary can merge to all its positions in that array. Active ranks are taken in ascending order from a heap; all
positions of a rank are merged at once, and only the neighbours of merged positions enter the index again. In a BPE
vocabulary a pair that contains a merged symbol always ranks below the merge that made the symbol, so this order gives
every pre-token the same merges as encoding it alone.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text_arrow import bytes_of, coded, gathered, slices, texts_of

#: Fixed value: the pre-tokenisation pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairIndexBpe:
    """A byte-level BPE vocabulary read from a tokenizer file in JSON."""

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        model, alphabet = spec["model"], byte_alphabet()
        if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError("only byte-level BPE without a normaliser is supported")
        split = spec["pre_tokenizer"]
        if split.get("add_prefix_space") or not split.get("use_regex", True) or any(model.get(k) for k in ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix")):
            raise ValueError("prefix spaces, other splits of words, and variants of the merges are not supported")
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take spaces, or match whole words only, are not supported")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = model["vocab"]
        raw = {i: bytes(alphabet[ch] for ch in token) for token, i in vocab.items()}
        raw |= {i: content.encode() for content, i in self.special.items()}
        size = max(raw) + 1
        pieces = [raw.get(i, b"") for i in range(size)]
        self.piece_lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        self.piece_starts = np.concatenate([[0], np.cumsum(self.piece_lengths)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.of_byte = np.array([next(vocab[ch] for ch, b in alphabet.items() if b == byte) for byte in range(256)], dtype=np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.half, self.kind = (16, np.uint32) if size <= 1 << 16 else (31, np.uint64)
        keys = ((self.left << self.half) | self.right).astype(self.kind)
        self.by_key = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.by_key]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where the vocabulary has no merge."""
        key = (left.astype(self.kind) << self.kind(self.half)) | right.astype(self.kind)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], -1)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by word) of pre-tokens, none of them empty."""
        flat, offsets = bytes_of(words)
        n = len(flat)
        symbol = self.of_byte[flat]
        following = np.arange(1, n + 1, dtype=np.int32)
        preceding = np.arange(-1, n - 1, dtype=np.int32)
        following[offsets[1:] - 1] = -1
        preceding[offsets[:-1]] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            rank = self.ranks(symbol[at], symbol[following[at]])
            real = rank >= 0
            at, rank = at[real], rank[real]
            if not len(at):
                return
            order = np.lexsort((at, rank))
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        enter(np.flatnonzero(following >= 0))
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.sort(np.concatenate(parts))
            a, b = self.left[r], self.right[r]
            after = following[at]
            live = (symbol[at] == a) & (after >= 0)
            live[live] = symbol[after[live]] == b
            at = at[live]
            if not len(at):
                continue
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]  # a position between two new symbols enters twice
            after = following[at]
            if a == b:  # in a run of equal symbols, pairs are taken from the left without overlap
                begins = np.concatenate([[True], at[1:] != after[:-1]])
                since = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
                at = at[since % 2 == 0]
                after = following[at]
            beyond = following[after]
            symbol[at] = self.made[r]
            symbol[after] = -1
            following[at] = beyond
            inner = beyond >= 0
            preceding[beyond[inner]] = at[inner]
            before = preceding[at]
            enter(np.concatenate([before[before >= 0], at[inner]]))
        kept = symbol >= 0
        return symbol[kept], np.concatenate([[0], np.cumsum(kept)])[offsets]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text); the strings of special tokens become their ids."""
        import regex

        find = regex.compile(PATTERN).findall
        cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        arrays, held, counts, weight, marked = [], [], [], 0, False
        for text in texts:
            before = len(held)
            if cut is not None and any(s in text for s in self.special):
                marked = True
                for part in cut.split(text):
                    held.extend(["\0special" + part] if part in self.special else find(part))
                # a pre-token never starts with NUL followed by a letter, so the mark cannot meet one
            else:
                held.extend(find(text))
            counts.append(len(held) - before)
            weight += len(text)
            if weight > 1 << 20:
                arrays.append(pa.array(held, pa.string()))
                held, weight = [], 0
        arrays.append(pa.array(held, pa.string()))
        codes, words = coded(pa.concat_arrays(arrays))
        del arrays, held
        marks = [(i, self.special[w[8:]]) for i, w in enumerate(words.to_pylist()) if w.startswith("\0special")] if marked else []
        ids, offsets = self.encode_words(words) if len(words) else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        lengths, starts = np.diff(offsets), offsets[:-1].copy()
        if marks:
            ids = np.concatenate([ids, np.array([i for _, i in marks], dtype=np.int64)])
            for k, (word, _) in enumerate(marks):
                starts[word], lengths[word] = len(ids) - len(marks) + k, 1
        ends = np.concatenate([[0], np.cumsum(lengths[codes])])
        return ids[gathered(starts[codes], lengths[codes])].astype("<u4"), ends[np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64))])]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids; ids outside the vocabulary give nothing."""
        ids = ids[ids < len(self.piece_lengths)].astype(np.int64)
        return self.piece_bytes[gathered(self.piece_starts[ids], self.piece_lengths[ids])].tobytes()


def _shared(df: DataFrame, tokenizer_path: str):
    with open(tokenizer_path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(PairIndexBpe(file.read()))  # its size is the vocabulary's, whatever the corpus


def bpe_encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens (long) and ids_le (binary: ids as little-endian unsigned 32-bit integers) of every whole text.

    A null or empty text has no tokens. Rows are encoded one by one: repeated ids and null ids stay as they are.
    """
    model = _shared(df, tokenizer_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", 4 << 20):
            ids, offsets = model.value.encode(texts_of(part, "t").to_pylist())
            packed = [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(np.diff(offsets), pa.int64()), pa.array(packed, pa.binary())], ["i", "n", "p"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("i"), df[text_col].alias("t")).mapInArrow(run, f"i {kind}, n bigint, p binary").toDF(id_col, "n_tokens", "ids_le")


def bpe_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids_le") -> DataFrame:
    """id and decoded (string) of packed ids; bytes that are not UTF-8 become U+FFFD, null ids decode to the empty text."""
    model = _shared(df, tokenizer_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [model.value.decode(np.frombuffer(x or b"", dtype="<u4")).decode("utf-8", "replace") for x in batch.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(made, pa.string())], ["i", "d"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("i"), df[ids_col].alias("p")).mapInArrow(run, f"i {kind}, d string").toDF(id_col, "decoded")


def bpe_round_trip(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns `carry`, n_tokens, ids_le and decoded, the text read back from the ids, in one pass over the texts.

    A null or empty text has no tokens and decodes to the empty text. Carried columns may not have the names of the new ones.
    """
    model = _shared(df, tokenizer_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", 4 << 20):
            ids, offsets = model.value.encode(texts_of(part, "t").to_pylist())
            packed = [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            decoded = [model.value.decode(np.frombuffer(p, dtype="<u4")).decode("utf-8", "replace") for p in packed]
            yield pa.RecordBatch.from_arrays(
                [part.column("i"), *[part.column(x) for x in names], pa.array(np.diff(offsets), pa.int64()), pa.array(packed, pa.binary()), pa.array(decoded, pa.string())],
                ["i", *names, "n", "p", "d"],
            )

    names = [f"x{n}" for n in range(len(carry))]
    kinds = "".join(f"{x} {df.schema[c].dataType.simpleString()}, " for x, c in zip(names, carry))
    kind = df.schema[id_col].dataType.simpleString()
    chosen = df.select(df[id_col].alias("i"), df[text_col].alias("t"), *[df[c].alias(x) for x, c in zip(names, carry)])
    made = chosen.mapInArrow(run, f"i {kind}, {kinds}n bigint, p binary, d string")
    return made.toDF(id_col, *carry, "n_tokens", "ids_le", "decoded")
