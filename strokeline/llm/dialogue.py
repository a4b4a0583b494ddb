"""Repair of conversations: faulty turns are found, and the cheapest edits that give an orderly change of roles.

A conversation is a layered graph: layer i stands before turn i, and each layer has four states - nothing yet, after the
system, after the user, after the assistant. Edits are arcs of small whole costs. Dial's bucket queue gives every vertex its
distance to an orderly end; the walk from the start that takes, of the arcs on a shortest path, the one with the least
initial is the audit. Turns are dealt in blocks of at most 4,096 (2 ** block_bits). What passes between the blocks of a long conversation
is four distances, so a conversation of any length is worked on by many tasks: first the costs through every block,
from every state to every state; then, block by block, the distances at its end; then the walk through it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

_FAR = 1 << 60
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. An orderly end is 0 or 3.
_END = [0, _FAR, _FAR, 0]
#: The state after a user or an assistant is put in or made of another role.
_NEXT = (2, 2, 3, 2)
#: The state after a turn with initial s, u, a or another one is kept; -1 where it can't be.
_KEEP = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
_INSERT, _DELETE, _REROLE, _TRUNCATED = 3, 4, 3, 3
_LONGEST = _REROLE + _TRUNCATED
_ROLES = {2: "user", 3: "assistant"}


def _arcs(code: int, state: int) -> list[tuple[str, int, int, int]]:
    """(initial, layers on, state, cost) of the arcs that leave a state before a turn, by ascending initials; code: fault * 4 + role."""
    fault, role = divmod(code, 4)
    made = [("D", 1, state, _DELETE), ("I", 0, _NEXT[state], _INSERT)]
    if fault in (0, 3):
        more = _TRUNCATED if fault else 0
        if _KEEP[state][role] >= 0:
            made.append(("K", 1, _KEEP[state][role], more))
        made.append(("R", 1, _NEXT[state], _REROLE + more))
    return made


_OUT = [[_arcs(code, state) for state in range(4)] for code in range(16)]
#: For each code of the turn before a layer and each state of that layer: (vertices back, cost) of the arcs that end there.
_IN = [[[(4 * layers + end - q, cost) for q in range(4) for _, layers, end, cost in _OUT[code][q] if end == state and layers] for state in range(4)] for code in range(16)]
_IN_LAYER = [[(state - q, _INSERT) for q in range(4) if _NEXT[q] == state] for state in range(4)]


def distances(codes: list[int], exits: list[int]) -> list[int]:
    """The distance of every vertex (4 * layer + state) to the end of a block whose last layer has the distances `exits`."""
    n = len(codes)
    found = [_FAR] * (4 * n + 4)
    known = [d for d in exits if d < _FAR]
    now, width = min(known), max(known) - min(known) + _LONGEST + 1
    buckets: list[list[int]] = [[] for _ in range(width)]
    waiting = 0
    for state, d in enumerate(exits):
        if d < _FAR:
            found[4 * n + state] = d
            buckets[d % width].append(4 * n + state)
            waiting += 1
    while waiting:
        bucket = buckets[now % width]
        while bucket:  # arcs that cost nothing put vertices into the bucket that is being emptied
            v = bucket.pop()
            waiting -= 1
            if found[v] != now:
                continue
            layer, state = divmod(v, 4)
            for back, cost in _IN_LAYER[state] + (_IN[codes[layer - 1]][state] if layer else []):
                if now + cost < found[v - back]:
                    found[v - back] = now + cost
                    buckets[(now + cost) % width].append(v - back)
                    waiting += 1
        now += 1
    return found


def walk(codes: list[int], found: list[int], state: int, last: bool) -> tuple[str, int]:
    """(initials of the edits, state at the end) of the walk from a state of the first layer; in the last block, to an orderly end."""
    layer, made = 0, []
    while layer < len(codes) or (last and found[4 * layer + state]):
        here = found[4 * layer + state]
        arcs = _OUT[codes[layer]][state] if layer < len(codes) else [("I", 0, _NEXT[state], _INSERT)]
        initial, on, state, _ = next(arc for arc in arcs if found[4 * (layer + arc[1]) + arc[2]] + arc[3] == here)
        layer += on
        made.append(initial)
    return "".join(made), state


def _lists(batch: pa.RecordBatch, name: str) -> list[list]:
    return batch.column(name).to_pylist()


def _through(blocks: DataFrame) -> DataFrame:
    """The costs through each block, its first and last role, and its disorderly neighbours."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, firsts, lasts, illegal = [], [], [], []
            for codes in _lists(batch, "codes"):
                ends = [distances(codes, [0 if q == end else _FAR for q in range(4)])[:4] for end in range(4)]
                costs.append([ends[end][q] for q in range(4) for end in range(4)])
                roles = [c % 4 for c in codes]
                firsts.append(roles[0])
                lasts.append(roles[-1])
                illegal.append(sum(pair not in _ORDERLY for pair in zip(roles, roles[1:])))
            made = [pa.array(costs, pa.list_(pa.int64())), pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64()), pa.array(illegal, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("b"), *made], ["k", "b", "costs", "first", "last", "illegal"])

    return blocks.select("k", "b", "codes").mapInArrow(run, "k string, b bigint, costs array<bigint>, first bigint, last bigint, illegal bigint")


_ORDERLY = {(0, 1), (1, 2), (2, 1)}


def _chained(through: DataFrame) -> DataFrame:
    """k, cost, illegal and, for each block, the distances at its end; a conversation here is one short record for each block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, illegal, ends = [], [], []
            for blocks in _lists(batch, "blocks"):
                exits, bad, made = _END, 0, []
                for n in range(len(blocks) - 1, -1, -1):
                    made.append({"b": blocks[n]["b"], "exits": exits, "final": n == len(blocks) - 1})
                    through = blocks[n]["costs"]
                    exits = [min(_FAR, *(through[4 * q + end] + exits[end] for end in range(4))) for q in range(4)]
                    bad += blocks[n]["illegal"] + (n > 0 and (blocks[n - 1]["last"], blocks[n]["first"]) not in _ORDERLY)
                costs.append(exits[0])
                illegal.append(bad)
                ends.append(made)
            kind = pa.list_(pa.struct([("b", pa.int64()), ("exits", pa.list_(pa.int64())), ("final", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(costs, pa.int64()), pa.array(illegal, pa.int64()), pa.array(ends, kind)], ["k", "cost", "illegal", "ends"])

    each = through.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("b", "costs", "first", "last", "illegal"))).alias("blocks"))
    return each.mapInArrow(run, "k string, cost bigint, illegal bigint, ends array<struct<b: bigint, exits: array<bigint>, final: boolean>>")


def _walked(blocks: DataFrame) -> DataFrame:
    """k, b, and for each state at the block's start the edits and the state at its end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, outs = [], []
            for codes, exits, final in zip(_lists(batch, "codes"), _lists(batch, "exits"), _lists(batch, "final")):
                found = distances(codes, exits)
                walks = [walk(codes, found, state, final) for state in range(4)]
                pieces.append([w[0] for w in walks])
                outs.append([w[1] for w in walks])
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("b"), pa.array(pieces, pa.list_(pa.string())), pa.array(outs, pa.list_(pa.int32()))], ["k", "b", "pieces", "outs"])

    return blocks.mapInArrow(run, "k string, b bigint, pieces array<string>, outs array<int>")


def _edits(blocks: DataFrame) -> DataFrame:
    """g, place and, in the order of the repaired conversation, the role a turn gets (empty: its own); place 0 are turns of the input.

    A turn that is deleted has no row. Turns put in before turn g have negative places, those after the last turn positive ones.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, gs, places, roles = [], [], [], []
            for k, turns, piece, state in zip(_lists(batch, "k"), _lists(batch, "gs"), _lists(batch, "piece"), _lists(batch, "state")):
                row, pending = 0, []
                codes = turns["codes"]
                for initial in piece:
                    if initial == "I":
                        state = _NEXT[state]
                        pending.append(_ROLES[state])
                        continue
                    g = turns["gs"][row]
                    lines = [(n - len(pending), role) for n, role in enumerate(pending)]
                    if initial != "D":
                        state = _NEXT[state] if initial == "R" else _KEEP[state][codes[row] % 4]
                        lines.append((0, _ROLES[state] if initial == "R" else ""))
                    row, pending = row + 1, []
                    for place, role in lines:
                        keys.append(k)
                        gs.append(g)
                        places.append(place)
                        roles.append(role)
                for n, role in enumerate(pending):
                    keys.append(k)
                    gs.append(turns["gs"][-1])
                    places.append(n + 1)
                    roles.append(role)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(gs, pa.int64()), pa.array(places, pa.int32()), pa.array(roles, pa.string())], ["k", "g", "place", "new_role"])

    return blocks.mapInArrow(run, "k string, g bigint, place int, new_role string")


def damage_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows of `df` (the four columns only) with faults, for tests and figures of the repair.

    crc32(`conv:turn`) modulo 20 decides: 0 drops a row, 1 empties its text, 2 removes `.`, `!` and `?` from it, 3 repeats the
    row, 4 makes its role user. A null conversation or turn counts as one space there; a null role or text becomes one.
    """
    blank = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(df[conv_col].cast("string"), blank), F.lit(":"), F.coalesce(df[turn_col].cast("string"), blank)).cast("binary")) % 20
    text, role = F.coalesce(df[text_col], blank), F.coalesce(df[role_col], blank)
    made = df.select(df[conv_col].alias("c"), df[turn_col].alias("t"), role.alias("r"), text.alias("x"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("x", ".!?", "")).otherwise(F.col("x"))
    made = made.select("c", "t", F.when(F.col("kind") == 4, "user").otherwise(F.col("r")).alias("r"), text.alias("x"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    return made.select(F.col("c").alias(conv_col), F.col("t").alias(turn_col), F.col("r").alias(role_col), F.col("x").alias(text_col))


class Repair:
    """The repair of a table of turns: `summary`, a row for each conversation, and `turns`, the repaired turns.

    summary: conversation, gaps, blank, duplicate, truncated, illegal, cost and audit. turns: conversation, g, place (the
    order of a conversation's turns), role and text. A conversation without turns has no row in either.

    Turns stand in the order of their number (nulls first), then role, then text. A null role or text counts as one space, a
    null conversation is one of its own. The first fault of a turn counts: blank (no character but spaces), duplicate (an
    earlier turn of the conversation has its role and text), truncated (its last such character is none of `.!?`). gaps
    are the numbers missing between the least and the largest; illegal counts neighbours whose initials are none of su,
    ua, au. The audit has one initial for each edit: Keep (0), Rerole to user or assistant (3), Delete (4, the only choice
    for blank turns and duplicates) and Insert of an empty user or assistant turn (3); a truncated turn that stays adds 3.
    It is the cheapest that leaves roles with the initials (s?(ua)+)?, of equally cheap ones the first in ASCII order. A
    turn whose role is empty can't be kept.
    """

    def __init__(self, df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_bits: int = 12):
        blank = F.lit(" ")
        key = F.when(df[conv_col].isNull(), "").otherwise(F.concat(F.lit("="), df[conv_col].cast("string")))
        rows = df.select(key.alias("k"), df[conv_col].alias("c"), df[turn_col].alias("turn"), F.coalesce(df[role_col], blank).alias("role"), F.coalesce(df[text_col], blank).alias("text"))
        ordered = rows.repartitionByRange("k", "turn", "role").sortWithinPartitions("k", "turn", "role", "text").withColumn("g", F.monotonically_increasing_id())
        ordered = written(ordered, "turns")

        trimmed = F.rtrim("text", F.lit(" \t\n\v\f\r"))
        last = F.substring(trimmed, -1, 1)
        fault = F.when(trimmed == "", 1).when(~last.isin(".", "!", "?"), 3).otherwise(0)
        role = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in zip("sua", (0, 1, 2)) for x in pair]), F.substring("role", 1, 1)), F.lit(3))
        narrow = ordered.select("k", "g", "role", F.sha2("text", 256).alias("digest"), fault.alias("fault"), role.alias("initial"))
        again = narrow.where("fault <> 1").groupBy("k", "role", "digest").agg(F.min("g").alias("first"), F.count("*").alias("n")).where("n > 1")
        marked = narrow.join(again.select("k", "role", "digest", "first"), ["k", "role", "digest"], "left")
        fault = F.when((F.col("fault") != 1) & (F.col("g") > F.col("first")), 2).otherwise(F.col("fault"))
        marked = marked.select("k", "g", F.shiftright("g", block_bits).alias("b"), fault.alias("fault"), (fault * 4 + F.col("initial")).alias("code"))
        counts = [F.sum((F.col("fault") == n).cast("long")).alias(name) for n, name in ((1, "blank"), (2, "duplicate"), (3, "truncated"))]
        turns = F.sort_array(F.collect_list(F.struct("g", "code"))).alias("turns")  # of one block
        blocks = written(marked.groupBy("k", "b").agg(turns, *counts).select("k", "b", F.col("turns.code").alias("codes"), F.col("turns.g").alias("gs"), "blank", "duplicate", "truncated"), "blocks")

        chained = written(_chained(_through(blocks)), "chained")
        ends = chained.select("k", F.explode("ends").alias("end")).select("k", "end.*")
        walked = written(_walked(blocks.join(ends, ["k", "b"]).select("k", "b", "codes", "exits", "final")), "walked")
        states = F.expr("aggregate(outs, array(0), (made, o) -> concat(made, array(o[made[size(made) - 1]])))")
        starts = walked.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("b", "outs"))).alias("each")).select("k", F.col("each.b").alias("bs"), F.col("each.outs").alias("outs")).select("k", "bs", states.alias("states"))
        starts = starts.select("k", F.explode(F.arrays_zip("bs", F.slice("states", 1, F.size("bs")).alias("state"))).alias("at")).select("k", F.col("at.bs").alias("b"), F.col("at.state").alias("state"))
        chosen = written(walked.join(starts, ["k", "b"]).select("k", "b", "state", F.col("pieces")[F.col("state")].alias("piece")), "chosen")
        pieces = chosen.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("b", "piece"))).alias("each")).select("k", F.array_join("each.piece", "").alias("audit"))

        numbers = ordered.groupBy("k", "turn").agg(F.lit(1)).groupBy("k").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
        sums = blocks.groupBy("k").agg(*[F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated")])
        names = ordered.groupBy("k").agg(F.first("c").alias(conv_col))
        found = names.join(numbers, "k").join(sums, "k").join(chained.select("k", "cost", "illegal"), "k").join(pieces, "k")
        self.summary = found.select("k", conv_col, F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

        own = _edits(blocks.join(chosen, ["k", "b"]).select("k", F.struct("gs", "codes").alias("gs"), "piece", "state"))
        own = written(own, "edits")
        texts = own.where("place = 0").join(ordered.select("g", "role", "text"), "g")
        texts = texts.select("k", "g", "place", F.when(F.col("new_role") == "", F.col("role")).otherwise(F.col("new_role")).alias("role"), "text")
        self.turns = texts.union(own.where("place <> 0").select("k", "g", "place", "new_role", F.lit("")))

    def digests(self) -> DataFrame:
        """k and the SHA-256 of its repaired turns, `role:text` joined by line feeds.

        A digest takes a conversation's turns one after the other, so one task reads each conversation; it holds a batch of them at a time.
        """

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, state = None, hashlib.sha256()
            for batch in batches:
                keys, made = [], []
                for k, line in zip(batch.column("k").to_pylist(), batch.column("line")):
                    if k != now:
                        if now is not None:
                            keys.append(now)
                            made.append(state.hexdigest())
                        now, state = k, hashlib.sha256()
                    else:
                        state.update(b"\n")
                    state.update(line.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(made, pa.string())], ["k", "digest"])
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["k", "digest"])

        lines = self.turns.select("k", "g", "place", F.concat("role", F.lit(":"), "text").alias("line"))
        return lines.repartition("k").sortWithinPartitions("k", "g", "place").select("k", "line").mapInArrow(run, "k string, digest string")


def repair_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_bits: int = 12) -> DataFrame:
    """The summary of `Repair`, by conversation, and repaired_sha256, the digest of the repaired turns (of the empty string if none is left)."""
    made = Repair(df, conv_col, turn_col, role_col, text_col, block_bits)
    empty = hashlib.sha256().hexdigest()
    return made.summary.join(made.digests(), "k", "left").select(conv_col, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("digest", F.lit(empty)).alias("repaired_sha256"))


def for_all(conversations: DataFrame, repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The rows of `repaired` and, for each other id of `conversations` (distinct ones), the row of a conversation without turns."""
    blank = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    joined = conversations.select(F.col(conv_col).alias("_c")).join(repaired, F.col("_c").eqNullSafe(F.col(conv_col)), "left")
    return joined.select(F.col("_c").alias(conv_col), *[F.coalesce(c, F.lit(v)).alias(c) for c, v in blank.items()])
