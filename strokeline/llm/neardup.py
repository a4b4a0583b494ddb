"""Near-duplicate groups: fast similarity sketches, banding, and verification on full shingle sets.

Texts with equal sets form one node. Nodes that share a band meet in a bucket. First each node is checked against its
bucket's most frequent node, and links join nodes to components. Nodes of different components that still share a bucket are
then checked with each other: pair by pair in small buckets, and in large ones through the rarest shingles of their
sets - two sets as similar as asked must share one of these early enough - so that a large group of copies is resolved
without listing its pairs. Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .sketch import band_keys, fingerprints, overlap, packed, shingle_sets, sketches, unpacked
from .store import dropped, written
from .text_arrow import slices, texts_of


def sign(df: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """i, th, n (shingles), node (fingerprint of the set, null for an empty one) and keys (one for each band) of columns i, th, t."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            flat, offsets = shingle_sets(texts_of(part, "t"), shingle)
            sizes = np.diff(offsets)
            keys = band_keys(sketches(flat, offsets, bands * rows), bands, rows).view(np.int64)
            node = pa.array(fingerprints(flat, offsets).view(np.int64), mask=sizes == 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sizes) * bands + 1, bands), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("i"), part.column("th"), pa.array(sizes), node, lists], ["i", "th", "n", "node", "keys"])

    kind = df.schema["i"].dataType.simpleString()
    return df.mapInArrow(run, f"i {kind}, th bigint, n bigint, node bigint, keys array<bigint>")


def _sets(df: DataFrame, shingle: int) -> DataFrame:
    """node, n and s (packed set) of rows (node, t) whose text has that node's set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            flat, offsets = shingle_sets(texts_of(part, "t"), shingle)
            node = fingerprints(flat, offsets).view(np.int64)
            same = np.flatnonzero(node == part.column("node").to_numpy(zero_copy_only=False))
            made = [packed(flat[offsets[k] : offsets[k + 1]]) for k in same]
            yield pa.RecordBatch.from_arrays([pa.array(node[same]), pa.array(np.diff(offsets)[same]), pa.array(made, pa.binary())], ["node", "n", "s"])

    return df.mapInArrow(run, "node bigint, n bigint, s binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; `sets` joins them from either side."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    # sizes that differ too much need no comparison
    sized = pairs.join(left, "a").join(right, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                common, union = overlap(x.as_py(), y.as_py())
                good.append(100 * common >= percent * union)
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return sized.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _through_rare_shingles(members: DataFrame, sets: DataFrame, percent: int, rare: int) -> DataFrame:
    """Pairs (a, b) of members (node, component) of different components that may be similar enough; none is missed.

    Shingles that at most `rare` members have come first, from rare to common, and all others follow by their hash: one
    order for all members. Similar sets share a shingle among the first n - ceil(n * percent / 100) + 1 of each, and its
    places bound how many more they can share.
    """

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [unpacked(x.as_py()).view(np.int64) for x in batch.column("s")]
            row = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(row), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))], ["node", "x"])

    def ranked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for data, few in zip(batch.column("s"), batch.column("few")):
                x = unpacked(data.as_py())
                f = np.full(len(x), rare + 1, dtype=np.int64)
                if few.is_valid:
                    found = few.values
                    f[np.searchsorted(x, found.field("x").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))] = found.field("f").to_numpy(zero_copy_only=False)
                order = np.lexsort((x, f))[: len(x) + (-len(x) * percent) // 100 + 1]
                shared = np.flatnonzero(f[order] > 1)  # one that a single member has leads to nobody, but takes its place
                made.append((x[order][shared].view(np.int64), shared, len(x)))
            row = pa.array(np.repeat(np.arange(len(made)), [len(m[0]) for m in made]))
            x, place = (np.concatenate([m[k] for m in made]) if made else np.zeros(0, np.int64) for k in (0, 1))
            sizes = pa.array(np.array([m[2] for m in made], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x), batch.column("node").take(row), batch.column("component").take(row), sizes.take(row), pa.array(place)], ["x", "node", "component", "n", "place"])

    own = sets.join(members, "node").select("node", "component", "s")
    each = own.mapInArrow(split, "node bigint, x bigint")
    few = each.join(each.groupBy("x").agg(F.count("*").alias("f")).where(F.col("f") <= rare), "x")
    few = few.groupBy("node").agg(F.collect_list(F.struct("x", "f")).alias("few"))
    early = own.join(few, "node", "left").mapInArrow(ranked, "x bigint, node bigint, component bigint, n bigint, place bigint")
    left, right = early.alias("l"), early.alias("r")
    needed = f"ceil((l.n + r.n) * {percent} / {100 + percent}D - 1e-9)"
    return (
        left.join(right, F.expr("l.x = r.x and l.node < r.node and l.component <> r.component"))
        .where(f"100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n) and 1 + least(l.n - l.place - 1, r.n - r.place - 1) >= {needed}")
        .select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
        .distinct()
    )


def _grouped(df: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, bands: int, rows: int, small_bucket: int) -> DataFrame:
    """i, th (hash of the text), n, node and c (the smallest id of the row's group), by row."""
    spark = df.sparkSession
    texts = df.select(df[id_col].alias("i"), F.xxhash64(df[text_col]).alias("th"), df[text_col].alias("t"))
    signed = written(sign(texts, shingle, bands, rows), "signed")
    # a node is known by its least id, and its set is read from the least row: one with an id, if any has one
    rows_alike = signed.where("node is not null").groupBy("node", "i", "th").agg(F.count("*").alias("copies"), F.any_value("keys").alias("keys"))
    least_row = F.min(F.struct(F.col("i").isNull().alias("no"), "i", "th", "copies")).alias("row")
    nodes = written(rows_alike.groupBy("node").agg(least_row, F.any_value("keys").alias("keys")).select("node", F.col("row.i").alias("label"), "row", "keys"), "nodes")
    placed = nodes.select("node", F.explode("keys").alias("key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = written(placed.join(shared, "key"), "met")
    # the node that meets most others is likely the one that the others are copies of
    meets = met.groupBy("node").agg(F.sum("m").alias("meets"))
    centres = met.join(meets, "node").groupBy("key").agg(F.max(F.struct("meets", "node")).alias("top")).select("key", F.col("top.node").alias("centre"))
    buckets = written(met.join(centres, "key"), "buckets")

    involved = written(buckets.select("node").distinct().join(nodes.select("node", F.col("row.i").alias("_i"), F.col("row.th").alias("_th"), F.col("row.copies").alias("copies")), "node"), "involved")
    found = texts.join(involved.hint("merge"), F.col("i").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_th"))).select("node", "t", "copies")
    if not involved.where("copies > 1").isEmpty():  # rows alike in id and text: one of them
        found = found.where("copies = 1").union(found.where("copies > 1").groupBy("node").agg(F.first("t"), F.first("copies")))
    sets = written(_sets(found.select("node", "t"), shingle), "sets")
    star = buckets.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    links = written(_verified(star, sets, percent), "links")
    first = written(connected_components(links), "components")

    grouped = buckets.join(first, "node", "left").select("key", "node", "centre", "m", F.coalesce("component", "node").alias("component"))
    mixed_keys = grouped.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    open_members = written(grouped.join(mixed_keys, "key", "left_semi"), "open")
    few = open_members.where(F.col("m") <= small_bucket)
    left, right = few.alias("l"), few.alias("r")
    pairs = left.join(right, F.expr("l.key = r.key and l.node < r.node and l.component <> r.component and l.node <> r.centre"))
    more = [pairs.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()]
    many = open_members.where(F.col("m") > small_bucket)
    if not many.isEmpty():
        more.append(_through_rare_shingles(many.select("node", "component").distinct(), sets, percent, small_bucket))
    for candidates in more:
        links = links.union(written(_verified(candidates, sets, percent), "links"))

    final = connected_components(links)
    named = nodes.select("node", "label").join(final, "node", "left")
    least = named.where("component is not null").groupBy("component").agg(F.min("label").alias("least"))
    named = named.join(least, "component", "left").select("node", F.coalesce("least", "label").alias("component_id"))
    out = signed.select("i", "th", "n", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("i")).otherwise(F.col("component_id"))
    out = written(out.select("i", "th", "n", "node", component.alias("c")), "near-duplicates")
    dropped(spark, signed, nodes, met, buckets, involved, sets, open_members)
    return out


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, small_bucket: int = 64
) -> DataFrame:
    """id, n_shingles, component_id (the smallest id of the row's group) and kept (boolean: it is the row's own), by row.

    Rows are linked if 100 * |intersection| >= percent * |union| of their sets of `shingle`-word shingles; a text with
    fewer words has its whole sequence as one shingle. Null, empty and blank texts have no set and are linked with
    nothing. Rows that repeat an id are separate rows with equal ids. A row with a null id takes part in links, but
    never gives its group an id: alone, its component_id is null and it is kept.

    With `bands` of `rows` coordinates each, a pair at the very threshold is missed with the probability
    (1 - (percent / 100) ** rows) ** bands: 8e-7 for 24 bands of 5 at 85 percent, 5e-8 for 32 of 4 at 80.
    """
    found = _grouped(df, id_col, text_col, shingle, percent, bands, rows, small_bucket)
    return found.select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.col("c").eqNullSafe(F.col("i")).alias("kept"))


def keep_representatives(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, small_bucket: int = 64
) -> DataFrame:
    """The rows of `df`, all columns as they are, without near-duplicates: of each group of `near_duplicates` one row stays.

    It is the row with the smallest id, of those with equal ids the one with the smallest hash of its text, and of rows
    equal in both any one. Rows without shingles all stay; where a whole group has null ids, one row of it stays.
    """
    found = _grouped(df, id_col, text_col, shingle, percent, bands, rows, small_bucket)
    first = F.min(F.struct(F.col("i").isNull().alias("no"), "i", "th")).alias("of")
    # a group whose ids are all null is known by its set
    linked = found.where("node is not null").groupBy("c", F.when(F.col("c").isNull(), F.col("node")).alias("own")).agg(first)
    winners = linked.select(F.col("of.i").alias("_i"), F.col("of.th").alias("_th"))
    copies = found.where("node is not null").groupBy(F.col("i").alias("_i"), F.col("th").alias("_th")).agg(F.count("*").alias("copies"))
    winners = winners.alias("w").join(copies.alias("c"), F.expr("w._i <=> c._i and w._th = c._th")).select("w._i", "w._th", "copies")
    blank = found.where("node is null").groupBy(F.col("i").alias("_i"), F.col("th").alias("_th")).agg(F.lit(0).cast("long").alias("copies"))
    winners = written(winners.union(blank), "winners")
    names = [f"c{n}" for n in range(len(df.columns))]
    place = {c: names[n] for n, c in enumerate(df.columns)}
    keyed = df.toDF(*names).withColumns({"_row_i": F.col(place[id_col]), "_row_th": F.xxhash64(place[text_col])})
    joined = keyed.join(winners.hint("merge"), F.col("_row_i").eqNullSafe(F.col("_i")) & (F.col("_row_th") == F.col("_th")))
    kept = joined.where("copies < 2").select(*names)
    if not winners.where("copies > 1").isEmpty():  # one of the rows alike, combined in the tasks
        one = joined.where("copies > 1").groupBy("_row_i", "_row_th").agg(F.first(F.struct(*names)).alias("row"))
        kept = kept.union(one.select("row.*"))
    return kept.toDF(*df.columns)
