"""Set similarity join of texts by word shingles, size-aware: subsets of small sets, inverted lists for large ones.

Two sets with 100 * |intersection| >= percent * |union| miss at most n - need of each other's elements, where need is
percent of the own size n, rounded up. Hence, in any order of elements that is the same for all sets, they share k
elements among the first n - need + k of each. Sets go through five steps, all of them exact:

1. Texts with equal sets are one node. Of every node's elements the first ones by hash are counted; a node of which too
   few are in other nodes' heads as well is linked with nobody.
2. All elements of the nodes that are left are counted; a node with fewer than `need` shared elements is linked with nobody.
   From now on elements are ordered from rare to common.
3. Nodes that share one of four min-hashes are linked where they are similar, which finds most of every group of near copies with a few
   rows for each node. What a head shares with heads of other components only is looked at further.
4. Small sets emit every subset of two elements of their head; two small sets that are similar emit a common one. Large
   sets scan the inverted lists of the elements of their head, in which small sets of fitting sizes stand too. The boundary is
   the size at which subsets of all sets below it and lists of all sets from it on cost least together.
5. What meets at a subset or in a list is a group. Its members are compared with one of them, links join nodes to
   components, and only members of different components are compared further, those outside a group's largest
   component with all others. Components are followed from one round to the next by its new links alone. A large group of near copies takes as many comparisons as it has members.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components
from .sketch import fingerprints, shingle_sets
from .store import dropped, written
from .text_arrow import gathered, mixed, slices, texts_of

#: Elements of a subset of a small set.
SUBSET = 2


def _need(percent: int, n: str = "n") -> str:
    """The least intersection of a set of n elements with a similar one."""
    return f"cast(({percent} * {n} + 99) div 100 as bigint)"


def _alike(percent: int, a: str, b: str) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _identities(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit fingerprints of each set."""
    return fingerprints(flat, offsets), fingerprints(mixed(flat ^ np.uint64(0x9AE16A3B2F90404F)), offsets)


def _signed(df: DataFrame, shingle: int, percent: int) -> DataFrame:
    """i, th, n, f1, f2 and head (the first elements by hash) of columns i, th, t."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            flat, offsets = shingle_sets(texts_of(part, "t"), shingle)
            sizes = np.diff(offsets)
            f1, f2 = _identities(flat, offsets)
            spare = sizes - (percent * sizes + 99) // 100
            lengths = np.minimum(sizes, spare * 4 // 3 + 2)
            head = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat[gathered(offsets[:-1], lengths)].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("i"), part.column("th"), pa.array(sizes), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), head], ["i", "th", "n", "f1", "f2", "head"])

    kind = df.schema["i"].dataType.simpleString()
    return df.mapInArrow(run, f"i {kind}, th bigint, n bigint, f1 bigint, f2 bigint, head array<bigint>")


def _sets(df: DataFrame, shingle: int) -> DataFrame:
    """node and s (its elements) of rows (node, f1, t) whose text has that node's set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            flat, offsets = shingle_sets(texts_of(part, "t"), shingle)
            same = fingerprints(flat, offsets).view(np.int64) == part.column("f1").to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64)))
            mask = pa.array(same)
            yield pa.RecordBatch.from_arrays([part.column("node").filter(mask), lists.filter(mask)], ["node", "s"])

    return df.mapInArrow(run, "node bigint, s array<bigint>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b and more) whose full sets are similar enough; sizes have been compared before."""
    left, right = sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select(*pairs.columns, F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return both.where(f"100L * common >= {percent}L * (na + nb - common)").select(*pairs.columns)


def _linked(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components (a, b) of rows (node, component, other, co) whose full sets are similar enough; each pair of nodes is compared once."""
    first = F.col("node") < F.col("other")
    ends = (F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    pairs = met.select(*ends, F.when(first, F.col("component")).otherwise(F.col("co")).alias("ca"), F.when(first, F.col("co")).otherwise(F.col("component")).alias("cb")).distinct()
    return _confirmed(pairs, sets, percent).select(F.col("ca").alias("a"), F.col("cb").alias("b"))


#: The elements of a set's head that stand in the inverted lists.
_LISTED = "filter(early, e -> e.pos <= n - need + 1 - alone)"
#: Min-hashes by which near copies are linked first.
HASHES = 4


def _boundary(prefixes: DataFrame, percent: int) -> int:
    """The size from which sets are large: subsets below it and lists from it on cost least. One row for each class of sizes is read."""
    ratio = max(100 / percent, 1.1)
    lists = F.expr(f"aggregate({_LISTED}, 0L, (t, e) -> t + e.f)").cast("double")
    subsets = F.expr("size(early) * (size(early) - 1) / 2D")
    costs = prefixes.select(F.floor(F.log("n") / F.log(F.lit(ratio))).alias("class"), "n", subsets.alias("subsets"), lists.alias("lists"))
    rows = sorted(costs.groupBy("class").agg(F.min("n").alias("n"), F.sum("subsets").alias("subsets"), F.sum("lists").alias("lists")).collect(), key=lambda r: r.n)
    best, at = None, 0
    for cut in range(len(rows) + 1):
        cost = sum(r.subsets for r in rows[:cut]) + sum(r.lists for r in rows[cut:])
        if best is None or cost < best:
            best, at = cost, rows[cut].n if cut < len(rows) else 1 << 62
    return at


def _members(prefixes: DataFrame, percent: int, boundary: int) -> DataFrame:
    """kind, key, node, n, rest (elements after the key's last), large and component: who meets at which subset or in which list."""
    light = F.expr(f"need >= {SUBSET} and n < {boundary}")
    tiny = (SUBSET - 1) * 100 // percent  # sets too small for subsets use lists
    q = "size(early)"
    pairs = f"flatten(transform(sequence(1, {q} - 1), i -> transform(sequence(i + 1, {q}), j -> named_struct('key', xxhash64(early[i - 1].x, early[j - 1].x), 'rest', n - alone - early[j - 1].pos))))"
    small = prefixes.where(light & F.expr(f"{q} > 1"))
    subsets = small.select(F.lit(0).alias("kind"), "node", "n", "component", F.lit(False).alias("large"), F.explode(F.expr(pairs)).alias("at"))
    listed = prefixes.where(f"100 * n >= {percent} * {boundary}D or {percent} * n <= {100 * tiny}")
    entries = F.expr(f"transform({_LISTED}, e -> named_struct('key', e.x, 'rest', n - alone - e.pos))")
    lists = listed.select(F.lit(1).alias("kind"), "node", "n", "component", (~light).alias("large"), F.explode(entries).alias("at"))
    return subsets.union(lists).select("kind", "at.key", "node", "n", "at.rest", "large", "component")


def _renamed(met: DataFrame, found: DataFrame) -> DataFrame:
    """The members of groups, their components named as found since."""
    now = found.select(F.col("node").alias("component"), F.col("component").alias("_now"))
    placed = met.select("kind", "key", "node", "n", "rest", "large", "component").join(now.hint("merge"), "component", "left")
    return placed.withColumn("component", F.coalesce("_now", "component")).drop("_now")


def _open_groups(placed: DataFrame, turn: int) -> DataFrame:
    """The members of groups in which several components meet. main is whether a member is of its group's largest one; the centre `other` is of that in even turns, and of the smallest in odd ones."""
    any_one = F.max(F.struct(F.xxhash64("node", F.lit(turn)).alias("hash"), "node", "n")).alias("of")
    sizes = placed.groupBy("kind", "key", "component").agg(F.count("*").alias("k"), any_one)
    each = F.struct("k", "component", "of")
    top = sizes.groupBy("kind", "key").agg(F.max(each).alias("top"), F.min(each).alias("low"), F.sum("k").alias("m")).where("top.k < m")
    at = "low" if turn % 2 else "top"
    centre = (F.col(f"{at}.of.node").alias("other"), F.col(f"{at}.of.n").alias("no"), F.col(f"{at}.component").alias("co"))
    top = top.select("kind", "key", F.col("top.component").alias("_main"), (F.col("m") - F.col("top.k")).alias("others"), *centre)
    return placed.join(top.hint("merge"), ["kind", "key"]).withColumn("main", F.col("component") == F.col("_main")).drop("_main")


def _near_copies(prefixes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components of nodes that share a min-hash. The centre of a group is a node whose elements are in most others, which is likely the one that they are copies of."""
    each = prefixes.select("node", "n", "rank", F.posexplode("mins").alias("kind", "key"))
    top = each.groupBy("kind", "key").agg(F.max(F.struct("rank", "node", "n")).alias("top"), F.count("*").alias("m")).where("m > 1")
    top = top.select("kind", "key", F.col("top.node").alias("other"), F.col("top.n").alias("no"))
    met = each.join(top.hint("merge"), ["kind", "key"]).where(f"node <> other and {_alike(percent, 'n', 'no')}")
    return connected_components(_linked(met.withColumns({"component": F.col("node"), "co": F.col("other")}), sets, percent))


def _shared_heads(prefixes: DataFrame, found: DataFrame) -> DataFrame:
    """Prefixes with component, their heads without the elements that only heads of one component have; each element keeps its place `pos` in the head."""
    placed = prefixes.drop("mins", "rank", "s").join(found.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    # nodes of a component stand together, so that their elements combine before they are shuffled
    placed = written(placed.repartition("component"), "placed")
    each = placed.select("component", F.explode("early.x").alias("x"))
    shared = each.groupBy("x").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("x")
    heads = placed.select("node", F.posexplode("early").alias("at", "e")).select("node", F.col("e.x").alias("x"), F.col("e.f").alias("f"), (F.col("at") + 1).cast("bigint").alias("pos"))
    left = heads.join(shared.hint("merge"), "x").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", "f", "x"))).alias("early"))
    made = written(placed.drop("early").join(left.hint("merge"), "node"), "heads")
    dropped(prefixes.sparkSession, placed)
    return made


#: The members of open groups are compared with one another if that takes so many comparisons for each of them at most.
ENOUGH = 8


def _components(prefixes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """node and component of nodes linked by min-hashes, and of those components that other links connect; not every link within a component is looked for.

    A component is named by its smallest node, so later links join components as first ones join nodes, and each round
    follows only its own links.
    """
    spark, sets = prefixes.sparkSession, prefixes.select("node", "s")
    first = _near_copies(prefixes, sets, percent)
    heads = _shared_heads(prefixes, first)
    members = written(_members(heads, percent, _boundary(heads, percent)), "members")
    groups = members.groupBy("kind", "key").agg(F.max("large").alias("any_large"), F.min("component").alias("low"), F.max("component").alias("high"))
    groups = groups.where("low < high and (kind = 0 or any_large)").select("kind", "key")
    met = written(members.join(groups.hint("merge"), ["kind", "key"]), "met")
    dropped(spark, members, heads)
    steps, placed, cost, turn = [], met, 0.0, 0
    while True:
        left = written(_open_groups(placed, turn), "open")
        dropped(spark, met)
        met = left
        rows, now = met.agg(F.count("*"), F.coalesce(F.sum(F.col("others").cast("double")), F.lit(0.0))).first()
        # rounds while comparing all that is left would cost much more than a round, and rounds help; the first is made at every size
        if turn and (now <= ENOUGH * rows or now > 0.9 * cost):
            break
        links = _linked(met.where(f"component <> co and {_alike(percent, 'n', 'no')}"), sets, percent)
        steps.append(connected_components(links))
        placed, cost, turn = _renamed(met, steps[-1]), now, turn + 1
    others, everyone = met.where("not main").alias("l"), met.alias("r")
    needed = f"ceil((l.n + r.n) * {percent} / {100 + percent}D - 1e-9)"
    pairs = others.join(everyone.hint("merge"), F.expr("l.kind = r.kind and l.key = r.key and l.component <> r.component and (r.main or l.node < r.node)"))
    pairs = pairs.where(f"(l.kind = 0 or l.large or r.large) and {_alike(percent, 'l.n', 'r.n')} and if(l.kind = 0, {SUBSET}, 1) + least(l.rest, r.rest) >= {needed}")
    last = _linked(pairs.select("l.node", "l.component", F.col("r.node").alias("other"), F.col("r.component").alias("co")), sets, percent)
    then = connected_components(reduce(DataFrame.union, steps, last))
    dropped(spark, met, *steps)
    return first, then


def _likely(texts: DataFrame, involved: DataFrame) -> DataFrame:
    """The texts whose hash may be one of those involved, by a bitmap of eight bits for each: one in nine of the others is left."""
    size = max(8 * involved.count(), 1 << 15)
    bits = involved.select((F.pmod("_th", F.lit(size)) + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket"))  # buckets and their positions begin at 1
    whole = np.zeros(((size >> 15) + 1) * 4096, np.uint8)
    for row in bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect():
        whole[(row.bucket - 1) * 4096 :][:4096] = np.frombuffer(bytes(row.bits), np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(whole)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            at = part.column("th").to_numpy(zero_copy_only=False) % size
            yield part.filter(pa.array(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1))

    return texts.mapInArrow(run, texts.schema)


def similar_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles (long) and component_id (the smallest id of the row's component), by row.

    Rows are linked if 100 * |intersection| >= percent * |union| of their sets of distinct `shingle`-word shingles, words
    lower-cased in A-Z; a text with fewer words has its whole sequence as one shingle. Every component is found whole;
    links between rows of one component that another path connects aren't all looked for. Null, empty and blank texts
    have no set and are linked with nothing. Rows that repeat an id are separate rows with equal ids. A row with a null
    id takes part in links, but never gives its component an id: alone, its component_id is null.
    """
    spark = df.sparkSession
    texts = df.select(df[id_col].alias("i"), F.xxhash64(df[text_col]).alias("th"), df[text_col].alias("t"))
    signed = written(_signed(texts, shingle, percent), "signed")
    # a node is known by its least id, and its set is read from the least row: one with an id, if any has one
    real = signed.where("n > 0")
    alike = real.groupBy("f1", "f2", "i", "th").agg(F.count("*").alias("copies"))
    least = F.min(F.struct(F.col("i").isNull().alias("no"), "i", "th", "copies")).alias("row")
    heads = real.groupBy("f1", "f2").agg(F.any_value("n").alias("n"), F.any_value("head").alias("head"))
    nodes = heads.join(alike.groupBy("f1", "f2").agg(least).hint("merge"), ["f1", "f2"])
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    one = Window.partitionBy("x")  # elements are shuffled once, for their counts and for the nodes that have them
    placed = nodes.select("node", F.explode("head").alias("x"))
    enough = placed.withColumn("f", F.count("*").over(one)).where("f > 1").groupBy("node").agg(F.count("*").alias("met"))
    own = nodes.select("node", "f1", "n", F.size("head").alias("h"), F.col("row.i").alias("_i"), F.col("row.th").alias("_th"), "row.copies")
    involved = own.join(enough.hint("merge"), "node").where(f"met >= greatest(1, h - (n - {_need(percent)}))")
    involved = written(involved.select("node", "f1", "n", "_i", "_th", "copies"), "involved")
    found = _likely(texts, involved).join(involved.hint("merge"), F.col("i").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_th")))
    if not involved.where("copies > 1").isEmpty():  # rows alike in id and text: one of them
        first = found.where("copies > 1").groupBy("node").agg(F.first("f1").alias("f1"), F.first("t").alias("t"))
        found = found.where("copies = 1").select("node", "f1", "t").union(first)
    sets = written(_sets(found.select("node", "f1", "t"), shingle), "sets")

    counted = sets.select("node", F.explode("s").alias("x")).withColumn("f", F.count("*").over(one)).where("f > 1")
    common = counted.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("common"))
    close = common.join(sets.withColumn("n", F.size("s").cast("bigint")).hint("merge"), "node").withColumn("need", F.expr(_need(percent))).where("size(common) >= need")
    alone = close.withColumn("alone", F.col("n") - F.size("common"))
    early = F.expr(f"slice(common, 1, cast(n - need + {SUBSET} - alone as int))").alias("early")
    least = F.expr(f"transform(sequence(1, {HASHES}), k -> array_min(transform(common, e -> xxhash64(e.x, k))))").alias("mins")
    rank = (F.expr("aggregate(common, 0L, (t, e) -> t + e.f)") / F.col("n")).alias("rank")
    prefixes = written(alone.select("node", "n", "need", "alone", early, least, rank, "s"), "prefixes")
    dropped(spark, sets, involved)

    first, then = _components(prefixes, percent)
    then = then.select(F.col("node").alias("component"), F.col("component").alias("_then"))
    named = nodes.select("f1", "f2", "node", F.col("row.i").alias("label")).join(first.hint("merge"), "node", "left")
    named = named.withColumns({"component": F.coalesce("component", "node"), "linked": F.col("component").isNotNull()}).join(then.hint("merge"), "component", "left")
    named = named.withColumns({"component": F.coalesce("_then", "component"), "linked": F.col("linked") | F.col("_then").isNotNull()})
    least = named.where("linked").groupBy("component").agg(F.min("label").alias("least"))  # a node without links is no component's name, and meets nothing
    named = named.join(least.hint("merge"), "component", "left").select("f1", "f2", F.coalesce("least", "label").alias("c"))
    out = signed.select("i", "n", F.when(F.col("n") > 0, F.col("f1")).alias("f1"), "f2").join(named.hint("merge"), ["f1", "f2"], "left")
    component = F.when(F.col("n") == 0, F.col("i")).otherwise(F.col("c"))
    out = written(out.select("i", "n", component.alias("c")), "similar-texts")
    dropped(spark, signed, nodes, prefixes, first, then)
    return out.select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))
