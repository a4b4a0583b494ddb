"""Raster operators on tables of ink pixels (page, px, py): thinning, pruning, tracing, distances, and masks as runs.

A page is never one group. A step looks at a pixel with its neighbours, a column, a row, or two neighbours on a line; what takes
many steps - thinning, following a line - goes in rounds over all pages at once, each round written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored

#: Offsets (x, y) of the eight neighbours, from north clockwise; neighbour n is bit n of a pixel's code.
RING = ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))
#: Pixels along the side of a tile: with the eight tiles around it a tile knows what eight passes, four rounds, make of it.
TILE, ROUNDS_A_JOB = 8, 4
#: Tiles along the side of a block. A tile is sent once to each block that it is in or touches, 1.6 on average, and there to the tiles around it.
BLOCK = 8
#: Whether the neighbour has the greater number.
_AFTER = np.array([(i, j) > (0, 0) for i, j in RING])
_BITS = np.array([n.bit_count() for n in range(256)], np.uint8)
_PLACE = np.array([max(n.bit_length() - 1, 0) for n in range(256)], np.uint8)


def tiles_of(ink: DataFrame, page: str = "document_id") -> DataFrame:
    """page, tx, ty and bits: ink by squares of eight pixels, bit 8 * row + column. Combined in the tasks, so that far fewer rows are shuffled."""
    bit = F.expr(f"shiftleft(1L, cast(pmod(py, {TILE}) * {TILE} + pmod(px, {TILE}) as int))")
    return ink.groupBy(page, F.floor(F.col("px") / TILE).alias("tx"), F.floor(F.col("py") / TILE).alias("ty")).agg(F.bit_or(bit).alias("bits"))


def pixels_of(tiles: DataFrame, page: str = "document_id") -> DataFrame:
    """page, px, py of tiles."""
    each = tiles.select(page, "tx", "ty", F.explode(F.expr("filter(sequence(0, 63), b -> shiftright(bits, b) & 1L = 1L)")).alias("b"))
    return each.select(page, (F.col("tx") * TILE + F.col("b") % TILE).alias("px"), (F.col("ty") * TILE + F.floor(F.col("b") / TILE)).alias("py"))


def _pass(a: np.ndarray, first: bool) -> np.ndarray:
    """Rows of 24 bits (tile, row) after half a round of Guo and Hall's rule; what lies outside isn't ink."""
    n, ne, e, se, s, sw, w, nw = _shifted(a)
    exactly, more = np.zeros_like(a), np.zeros_like(a)  # changes: one, and more than one
    for c in (~n & (ne | e), ~e & (se | s), ~s & (sw | w), ~w & (nw | n)):
        more |= exactly & c
        exactly |= c
    twice, whole = ~np.zeros_like(a), ~np.zeros_like(a)  # both counts of pairs: at least two, and four
    for pairs in ((nw | n, ne | e, se | s, sw | w), (n | ne, e | se, s | sw, w | nw)):
        one, two, four = np.zeros_like(a), np.zeros_like(a), ~np.zeros_like(a)
        for p in pairs:
            two |= one & p
            one |= p
            four &= p
        twice &= two
        whole &= four
    stays = (s | sw | ~nw) & w if first else (n | ne | ~se) & e
    return a & ~(exactly & ~more & twice & ~whole & ~stays) & np.uint32(0xFFFFFF)


def _around(tiles: DataFrame, page: str, grown: bool = False) -> DataFrame:
    """page, tx, ty and w0 to w8, the bits of a tile and of those around it, by row. `grown`: also of tiles without ink beside some."""
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / BLOCK), F.floor((F.col(c) + 1) / BLOCK)))
    sent = tiles.select(F.col(page).alias("page"), "tx", "ty", "bits", near("tx").alias("bx")).withColumn("by", near("ty")).repartition("page", "bx", "by")
    around = [F.struct(F.lit(-i).alias("i"), F.lit(-j).alias("j"), F.lit(3 * (j + 1) + i + 1).alias("k")) for j in (-1, 0, 1) for i in (-1, 0, 1)]
    each = sent.select("page", "bx", "by", "tx", "ty", "bits", F.explode(F.array(*around)).alias("s"))
    each = each.select("page", "bx", "by", (F.col("tx") + F.col("s.i")).alias("tx"), (F.col("ty") + F.col("s.j")).alias("ty"), "s.k", "bits")
    each = each.where(f"floor(tx / {BLOCK}) = bx and floor(ty / {BLOCK}) = by")
    met = each.groupBy("page", "bx", "by", "tx", "ty").agg(*[F.bit_or(F.when(F.col("k") == k, F.col("bits"))).alias(f"w{k}") for k in range(9)])
    return (met if grown else met.where("w4 is not null")).drop("bx", "by")


def _squares(part: pa.RecordBatch) -> np.ndarray:
    """Rows of 24 bits (tile, row) of each tile and those around it."""
    words = np.stack([part.column(k).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3, 12)], 1)
    square = np.ascontiguousarray(words, "<i8").view(np.uint8).reshape(-1, 3, 3, TILE).transpose(0, 1, 3, 2).reshape(-1, 3 * TILE, 3).astype(np.uint32)
    return square[:, :, 0] | square[:, :, 1] << 8 | square[:, :, 2] << 16


def _inner(a: np.ndarray) -> np.ndarray:
    """The bits of the tiles in the middle."""
    return np.ascontiguousarray((a[:, TILE : 2 * TILE] >> 8 & 255).astype(np.uint8)).view("<i8").reshape(-1)


def _shifted(a: np.ndarray) -> list[np.ndarray]:
    """Whether each neighbour, in the order of RING, is ink."""
    up, down = np.zeros_like(a), np.zeros_like(a)
    up[:, 1:], down[:, :-1] = a[:, :-1], a[:, 1:]
    return [up, up >> 1, a >> 1, down >> 1, down, down << 1, a << 1, up << 1]


def _widened(a: np.ndarray) -> np.ndarray:
    return np.bitwise_or.reduce([a, *_shifted(a)]) & np.uint32(0xFFFFFF)


def _framed(a: np.ndarray, part: pa.RecordBatch, frame: int) -> np.ndarray:
    """What lies in columns and rows 0 to `frame`, without the last."""
    inside = [(at >= 0) & (at < frame) for k in (1, 2) for at in [part.column(k).to_numpy()[:, None] * TILE - TILE + np.arange(3 * TILE)]]
    columns = (inside[0] << np.arange(3 * TILE)).sum(1).astype(np.uint32)
    return np.where(inside[1], a & columns[:, None], np.uint32(0))


def thinned_tiles(tiles: DataFrame, page: str = "document_id", widen: bool = False, close: int = 0) -> DataFrame:
    """Tiles of the skeleton of ink: two alternating passes of Guo and Hall's rule, until a round takes nothing away. A job goes four rounds on what a tile and those around it hold.

    The first job may widen the ink by a pixel on all sides, or close it by one within a frame of `close` pixels, and then goes three rounds.
    """
    kind = tiles.schema[page].dataType.simpleString()
    now, first = tiles, widen or close > 0

    def run(first: bool):
        def thin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                now = _squares(part)
                if first:
                    now = _widened(now)
                if first and close:
                    now = _framed(now, part, close)
                    now = np.bitwise_and.reduce([now, *_shifted(now)])
                for _ in range(ROUNDS_A_JOB - first):
                    before, now = now, _pass(_pass(now, True), False)
                bits = _inner(now)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(bits), pa.array(bits != _inner(before))], ["page", "tx", "ty", "bits", "changed"])

        return thin

    while True:
        made = _around(now, page, first).mapInArrow(run(first), f"page {kind}, tx bigint, ty bigint, bits bigint, changed boolean")
        made = stored(made.where("bits <> 0 or changed") if first else made, "thinned")
        now, first = made.where("bits <> 0").withColumnRenamed("page", page), False
        if made.where("changed").isEmpty():
            return now.drop("changed")


def thinned(ink: DataFrame, page: str = "document_id") -> DataFrame:
    """The skeleton of ink, thinned by tiles."""
    return pixels_of(thinned_tiles(tiles_of(ink.select(page, "px", "py"), page), page), page)


def pruned_tiles(tiles: DataFrame, rounds: int, page: str = "document_id") -> DataFrame:
    """Tiles of a skeleton after `rounds` times taking off the ends of its branches. A round looks two pixels around, so a job goes four."""
    kind = tiles.schema[page].dataType.simpleString()

    def run(rounds: int):
        def prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                now = _squares(part)
                for _ in range(rounds):
                    one, more = np.zeros_like(now), np.zeros_like(now)
                    for beside in _shifted(now):
                        more |= one & beside
                        one |= beside
                    end = now & one & ~more
                    # of two pixels alone the second, by row and column, stays: the other is north of it or to its left
                    n, ne, _, _, _, _, w, nw = _shifted(end)
                    now = now & ~(end & ~(n | ne | w | nw))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(_inner(now))], ["page", "tx", "ty", "bits"])

        return prune

    for done in range(0, rounds, ROUNDS_A_JOB):
        made = _around(tiles, page).mapInArrow(run(min(ROUNDS_A_JOB, rounds - done)), f"page {kind}, tx bigint, ty bigint, bits bigint")
        tiles = stored(made.where("bits <> 0").withColumnRenamed("page", page), "pruned")
    return tiles


def pruned(skeleton: DataFrame, rounds: int, page: str = "document_id") -> DataFrame:
    """The skeleton after `rounds` times taking off the ends of its branches. Of two pixels alone the first, by row and column, goes; a single one stays."""
    return pixels_of(pruned_tiles(tiles_of(skeleton.select(page, "px", "py"), page), rounds, page), page)


def _codes(now: np.ndarray) -> np.ndarray:
    """[tile, row, column] of the tile and one pixel around it: the sum of 2 ** n over the neighbours n that are ink, 0 where there is no ink."""
    ink = (now[:, 6:18, None] >> np.arange(6, 18, dtype=np.uint32) & 1).astype(np.uint8)
    made = np.zeros((len(ink), 10, 10), np.uint8)
    for n, (i, j) in enumerate(RING):
        made |= ink[:, 1 + j : 11 + j, 1 + i : 11 + i] << n
    return made * ink[:, 1:11, 1:11]


def tile_degrees(tiles: DataFrame, page: str = "document_id") -> DataFrame:
    """page, px, py of the ink of tiles, and degree, the number of its eight neighbours that are ink too."""
    kind = tiles.schema[page].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            now = _squares(part)
            t, r, c = np.nonzero(now[:, 8:16, None] >> np.arange(8, 16, dtype=np.uint32) & 1)
            tx, ty = (part.column(k).to_numpy() * TILE for k in (1, 2))
            degree = _BITS[_codes(now)[t, r + 1, c + 1]].astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(t)), pa.array(tx[t] + c), pa.array(ty[t] + r), pa.array(degree)], ["page", "px", "py", "degree"])

    return _around(tiles, page).mapInArrow(run, f"page {kind}, px bigint, py bigint, degree bigint").withColumnRenamed("page", page)


def tile_components(tiles: DataFrame, page: str = "document_id") -> DataFrame:
    """page, node, area, junctions and links: connected ink within each tile, known by the number of its first pixel, and what it touches in the tiles around it, each pair once.

    area counts pixels, junctions those with at least three neighbours.
    """
    kind = tiles.schema[page].dataType.simpleString()
    far = np.int16(9 * TILE * TILE)
    edge = np.arange(3 * TILE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            now = _squares(part)
            ink = (now[:, :, None] >> np.arange(3 * TILE, dtype=np.uint32) & 1).astype(bool)
            label = np.where(ink, np.arange(9 * TILE * TILE, dtype=np.int16).reshape(3 * TILE, 3 * TILE), far)
            while True:  # the least place of all that is connected within each of the nine tiles
                before = label
                for axis in (1, 2):
                    ahead, behind = np.roll(label, -1, axis), np.roll(label, 1, axis)
                    at = lambda k: (slice(None), edge % TILE == k) if axis == 1 else (slice(None), slice(None), edge % TILE == k)  # noqa: E731, B023
                    ahead[at(TILE - 1)], behind[at(0)] = far, far
                    label = np.minimum(label, np.minimum(ahead, behind))
                label = np.where(ink, label, far)
                if (label == before).all():
                    break
            tx, ty = (part.column(k).to_numpy() * TILE - TILE for k in (1, 2))
            number = lambda t, place: (tx[t] + place % (3 * TILE)) * 1_000_000 + ty[t] + place // (3 * TILE)
            t, r, c = np.nonzero(ink[:, TILE : 2 * TILE, TILE : 2 * TILE])
            own = label[t, r + TILE, c + TILE].astype(np.int64)
            key, of = np.unique(t * int(far) + own, return_inverse=True)
            area = np.bincount(of, minlength=len(key))
            junctions = np.bincount(of, _BITS[_codes(now)[t, r + 1, c + 1]] >= 3, len(key)).astype(np.int64)
            pairs = []
            for i, j in ((1, 0), (1, 1), (0, 1), (-1, 1)):
                other = label[t, r + TILE + j, c + TILE + i].astype(np.int64)
                crosses = (other < far) & ((c + i < 0) | (c + i >= TILE) | (r + j >= TILE))
                pairs.append(np.stack([of[crosses], other[crosses]], 1))
            links = np.unique(np.concatenate(pairs), axis=0)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(links[:, 0], np.arange(len(key) + 1)), pa.int32()), pa.array(number(key[links[:, 0]] // far, links[:, 1])))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(key // far)), pa.array(number(key // far, key % far)), pa.array(area), pa.array(junctions), lists], ["page", "node", "area", "junctions", "links"])

    return _around(tiles, page).mapInArrow(run, f"page {kind}, node bigint, area bigint, junctions bigint, links array<bigint>").withColumnRenamed("page", page)


def _chains(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Darts of tiles as chains: within a tile, up to a pixel that hasn't two neighbours or has a lesser number than both, by doubling pointers over all tiles of a batch."""
    step = np.array(RING)
    for part in batches:
        code = _codes(_squares(part))
        t, r, c, d = np.nonzero(code[:, 1:9, 1:9, None] >> np.arange(8, dtype=np.uint8) & 1)
        number = np.zeros((len(code), TILE, TILE, 8), np.int64)
        number[t, r, c, d] = np.arange(len(t))
        hr, hc, back = r + step[d, 1], c + step[d, 0], (d + 4) % 8
        there = code[t, hr + 1, hc + 1]
        through, on = _BITS[there] == 2, _PLACE[there & ~(1 << back)]
        goes = through & (hr >= 0) & (hr < TILE) & (hc >= 0) & (hc < TILE) & ~(_AFTER[back] & _AFTER[on])
        end, steps = np.arange(len(t)), goes.astype(np.int64)
        end[goes] = number[t[goes], hr[goes], hc[goes], on[goes]]
        while True:
            after = end[end]
            if (after == end).all():
                break
            steps, end = steps + steps[end], after
        order = np.lexsort((-steps, end))
        last = np.flatnonzero(steps[order] == 0)
        first = np.concatenate([[0], last[:-1] + 1]).astype(np.int64)[: len(last)]
        n = last - first + 1
        tx, ty = (part.column(k).to_numpy() for k in (1, 2))
        tail = (tx[t] * TILE + c) * 1_000_000 + ty[t] * TILE + r
        head = (tx[t] * TILE + hc) * 1_000_000 + ty[t] * TILE + hr
        a, z = order[first], order[last]
        offsets = pa.array(np.concatenate([[0], np.cumsum(n + 1)]), pa.int32())
        lists = []
        for at, to in ((c, hc), (r, hr)):
            flat = np.insert(at[order], last + 1, to[z]).astype(np.int8)
            lists.append(pa.ListArray.from_arrays(offsets, pa.array(flat)))
        following = pa.array(head[z] * 8 + on[z], mask=~through[z])
        starts = _BITS[code[t[a], r[a] + 1, c[a] + 1]] != 2
        low = np.minimum.reduceat(tail[order], first) if len(first) else tail
        columns = [part.column(0).take(pa.array(t[a])), pa.array(tx[t[a]]), pa.array(ty[t[a]]), pa.array(tail[a] * 8 + d[a]), following, pa.array(head[z]), pa.array(head[z] * 8 + back[z]), pa.array(low), pa.array(n), pa.array(starts), *lists]
        yield pa.RecordBatch.from_arrays(columns, ["page", "tx", "ty", "chain", "next", "head", "reverse", "low", "n", "starts", "xs", "ys"])


def _ranked(chains: DataFrame, page: str) -> DataFrame:
    """Chains with `end`, the last chain on their way, and `steps`, the darts up to its end, by doubling pointers; next is null at a way's end.

    What goes round for ever keeps its next chain, and `low`, the least tail on its way, is then the ring's least.
    """
    now = chains.select(page, "chain", "next", F.when(F.col("next").isNull(), F.col("chain")).alias("end"), F.col("n").alias("steps"), "low")
    now, before = stored(now, "chains"), None
    while True:
        state = tuple(now.where("next is not null").agg(F.count("*"), F.sum(F.col("low").cast("decimal(38,0)"))).first())
        if not state[0] or state == before:
            return now
        before = state
        ahead = now.select(page, F.col("chain").alias("next"), F.col("next").alias("next2"), F.col("end").alias("end2"), F.col("steps").alias("steps2"), F.col("low").alias("low2"))
        moved = now.where("next is not null").join(ahead.hint("merge"), [page, "next"]).select(page, "chain", F.col("next2").alias("next"), F.col("end2").alias("end"), (F.col("steps") + F.col("steps2")).alias("steps"), F.least("low", "low2").alias("low"))
        now = stored(moved.union(now.where("next is null")), "chains")


def traced_pieces(tiles: DataFrame, page: str = "document_id") -> DataFrame:
    """page, line, pos, n, whole, final, tx, ty, xs, ys: polylines along a skeleton as pieces within tiles.

    A piece has n steps and n + 1 points, from `pos` on, in columns xs and rows ys of its tile; the last point is the first one of
    the next piece, save on the `final` piece. A `whole` piece is its line's only one.

    Every pair of neighbouring pixels is in one polyline, once. A dart goes from a pixel to a neighbour; behind a pixel of two neighbours
    it goes on to the other one. Tiles make chains of darts; most are whole lines. The place of the others on their line is found by doubling
    pointers, so a line of n chains takes log2(n) joins. A closed ring begins and ends at its least pixel, by column and row, where
    a chain ends too. Of the two directions that from the lesser dart is taken. A pixel without neighbours is on no line.
    """
    kind = tiles.schema[page].dataType.simpleString()
    schema = f"page {kind}, tx bigint, ty bigint, chain bigint, next bigint, head bigint, reverse bigint, low bigint, n bigint, starts boolean, xs array<tinyint>, ys array<tinyint>"
    made = _around(tiles, page).mapInArrow(_chains, schema).withColumnRenamed("page", page)
    chains = stored(made.where("not starts or next is not null or chain < reverse"), "chains")
    told = [page, "line", "pos", "n", "whole", "final", "tx", "ty", "xs", "ys"]
    whole = chains.where("starts and next is null").withColumnsRenamed({"chain": "line"}).withColumns({"pos": F.lit(0).cast("long"), "whole": F.lit(True), "final": F.lit(True)})
    parts = chains.where("not (starts and next is null)")
    ranks = _ranked(parts, page)
    ends = ranks.where("next is null").select(page, "chain", "end", "steps")
    rings = ranks.where("next is not null").select(page, "chain", F.col("low").alias("least"))
    if not rings.isEmpty():  # cut open at the least pixel
        rings = stored(parts.join(rings.hint("merge"), [page, "chain"]), "rings")
        again = _ranked(rings.withColumn("next", F.when(F.col("head") != F.col("least"), F.col("next"))), page)
        ends = ends.union(again.select(page, "chain", "end", "steps"))
    lines = ends.groupBy(page, "end").agg(F.max_by("chain", "steps").alias("line"), F.max("steps").alias("length"))
    last = parts.select(page, F.col("chain").alias("end"), "reverse")
    lines = stored(lines.join(last.hint("merge"), [page, "end"]).where("line < reverse").drop("reverse"), "ends")
    placed = ends.join(lines.hint("merge"), [page, "end"]).select(page, "chain", "line", (F.col("length") - F.col("steps")).alias("pos"), (F.col("chain") == F.col("end")).alias("final"))
    joined = parts.join(placed.hint("merge"), [page, "chain"]).withColumn("whole", F.lit(False))
    return whole.select(*told).union(joined.select(*told))


def vertices_of(pieces: DataFrame, page: str = "document_id") -> DataFrame:
    """page, line, pos, px, py of pieces of polylines."""
    points = F.arrays_zip(F.when(F.col("final"), F.col("xs")).otherwise(F.expr("slice(xs, 1, cast(n as int))")).alias("xs"), F.when(F.col("final"), F.col("ys")).otherwise(F.expr("slice(ys, 1, cast(n as int))")).alias("ys"))
    each = pieces.select(page, "line", "pos", "tx", "ty", F.posexplode(points).alias("k", "p"))
    return each.select(page, "line", (F.col("pos") + F.col("k")).alias("pos"), (F.col("tx") * TILE + F.col("p.xs")).alias("px"), (F.col("ty") * TILE + F.col("p.ys")).alias("py"))


def traced(skeleton: DataFrame, page: str = "document_id") -> DataFrame:
    """page, line, pos, px, py: polylines along a skeleton between pixels that haven't two neighbours."""
    return vertices_of(traced_pieces(tiles_of(skeleton.select(page, "px", "py"), page), page), page)


def dilated(ink: DataFrame, radius: int, page: str = "document_id") -> DataFrame:
    """Ink with all pixels at most `radius` columns and rows from it."""
    around = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)]
    each = ink.select(page, "px", "py", F.explode(F.array(*around)).alias("s"))
    return each.select(page, (F.col("px") + F.col("s.i")).alias("px"), (F.col("py") + F.col("s.j")).alias("py")).distinct()


def eroded(ink: DataFrame, radius: int, page: str = "document_id") -> DataFrame:
    """Ink pixels with nothing but ink at most `radius` columns and rows from them."""
    around = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)]
    each = ink.select(page, "px", "py", F.explode(F.array(*around)).alias("s"))
    met = each.select(page, (F.col("px") + F.col("s.i")).alias("px"), (F.col("py") + F.col("s.j")).alias("py")).groupBy(page, "px", "py").agg(F.count("*").alias("n"))
    return met.where(F.col("n") == len(around)).drop("n")


def squared_distances(ink: DataFrame, page: str = "document_id") -> DataFrame:
    """Ink with d2, the squared Euclidean distance to the nearest pixel that isn't ink; everything beyond the ink isn't.

    First the distance g up and down each column, from the ends of the runs of ink in it. Then along each run of ink in a row: no pixel
    further away than g can be nearer, so each one looks at g columns on either side and at the run's ends.
    """
    column, row = Window.partitionBy(page, "px"), Window.partitionBy(page, "py")
    runs = ink.withColumn("run", F.col("py") - F.row_number().over(column.orderBy("py")))
    stretch = Window.partitionBy(page, "px", "run")
    near = F.least(F.col("py") - F.min("py").over(stretch), F.max("py").over(stretch) - F.col("py")) + 1
    columns = runs.select(page, "px", "py", near.alias("g"))
    rows = columns.withColumn("run", F.col("px") - F.row_number().over(row.orderBy("px")))
    lines = rows.groupBy(page, "py", "run").agg(F.min("px").alias("x0"), F.transform(F.sort_array(F.collect_list(F.struct("px", "g"))), lambda s: s["g"]).alias("gs"))
    nearest = """transform(gs, (g, i) -> least((i + 1L) * (i + 1L), (size(gs) - i) * bigint(size(gs) - i),
        array_min(transform(slice(gs, cast(greatest(i - g, 0) + 1 as int), cast(least(i + g, size(gs) - 1) - greatest(i - g, 0) + 1 as int)), (h, k) -> (greatest(i - g, 0) + k - i) * (greatest(i - g, 0) + k - i) + h * h))))"""
    return lines.select(page, "py", "x0", F.posexplode(F.expr(nearest)).alias("k", "d2")).select(page, (F.col("x0") + F.col("k")).alias("px"), "py", "d2")


def stroke_widths(lines: DataFrame, distances: DataFrame, percentile: float, samples: int = 10, page: str = "document_id") -> DataFrame:
    """page, line and width of polylines (page, line, pos, px, py): the percentile of twice the distance at every n-th point, n a tenth of their number."""
    size = lines.groupBy(page, "line").agg(F.count("*").alias("n"))
    chosen = lines.join(size, [page, "line"]).where(F.expr(f"pos % greatest(1, n div {samples}) = 0"))
    found = chosen.join(distances, [page, "px", "py"], "left")
    return found.groupBy(page, "line").agg(F.coalesce(F.percentile(2 * F.sqrt("d2"), percentile / 100), F.lit(1.0)).alias("width"))


def runs_of(ink: DataFrame, page: str = "document_id") -> DataFrame:
    """page, py, x0, x1: the runs of ink in each row, x1 included."""
    numbered = ink.withColumn("run", F.col("px") - F.row_number().over(Window.partitionBy(page, "py").orderBy("px")))
    return numbered.groupBy(page, "py", "run").agg(F.min("px").alias("x0"), F.max("px").alias("x1")).drop("run")


def box_runs(boxes: DataFrame, pad: int = 0, page: str = "document_id") -> DataFrame:
    """page, py, x0, x1: a run for each row of boxes (page, x, y, width, height) in whole pixels, `pad` pixels larger on every side."""
    whole = {c: F.floor(c).cast("long") for c in ("x", "y")} | {"right": F.floor(F.col("x") + F.col("width")).cast("long"), "below": F.floor(F.col("y") + F.col("height")).cast("long")}
    made = boxes.select(page, (whole["x"] - pad).alias("x0"), (whole["right"] + pad - 1).alias("x1"), (whole["y"] - pad).alias("y0"), (whole["below"] + pad - 1).alias("y1"))
    return made.where("x1 >= x0 and y1 >= y0").select(page, F.explode(F.sequence("y0", "y1")).alias("py"), "x0", "x1")


def combined(a: DataFrame, b: DataFrame, keep: Column, page: str = "document_id") -> DataFrame:
    """The runs of the pixels where `keep` holds, a condition on the booleans a and b: in the runs of `a`, in those of `b`.

    Runs may overlap. Their ends are swept along each row: what has begun and not ended is counted, and neighbouring
    stretches that stay are one run.
    """
    edges = None
    for n, runs in enumerate((a, b)):
        ends = F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("s")), F.struct((F.col("x1") + 1).alias("x"), F.lit(-1).alias("s")))).alias("e")
        told = runs.select(page, "py", ends).select(page, "py", "e.x", *[(F.col("e.s") if k == n else F.lit(0)).alias(c) for k, c in enumerate("ab")])
        edges = told if edges is None else edges.union(told)
    row = Window.partitionBy(page, "py").orderBy("x")
    swept = edges.groupBy(page, "py", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    swept = swept.select(page, "py", "x", F.lead("x").over(row).alias("until"), *[(F.sum(c).over(row) > 0).alias(c) for c in "ab"])
    stays = swept.where(keep & F.col("until").isNotNull())
    fresh = stays.withColumn("fresh", F.coalesce((F.lag("until").over(row) != F.col("x")).cast("int"), F.lit(1)))
    numbered = fresh.withColumn("run", F.sum("fresh").over(row))
    return numbered.groupBy(page, "py", "run").agg(F.min("x").alias("x0"), (F.max("until") - 1).alias("x1")).drop("run")


def union(a: DataFrame, b: DataFrame, page: str = "document_id") -> DataFrame:
    return combined(a, b, F.col("a") | F.col("b"), page)


def intersection(a: DataFrame, b: DataFrame, page: str = "document_id") -> DataFrame:
    return combined(a, b, F.col("a") & F.col("b"), page)


def difference(a: DataFrame, b: DataFrame, page: str = "document_id") -> DataFrame:
    return combined(a, b, F.col("a") & ~F.col("b"), page)


def markup_runs(ink: DataFrame, pipes: DataFrame, dimensions: DataFrame, regions: DataFrame, page: str = "document_id") -> DataFrame:
    """Runs of ink that may belong to markup: without that of pipes, save around dimensions, and without what lies in regions."""
    free = union(difference(ink, pipes, page), intersection(ink, dimensions, page), page)
    return difference(free, regions, page)
