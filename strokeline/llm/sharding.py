"""Shards of near-equal bytes by a K-d tree over document metadata.

A node of the tree holds rows and a number of shards. Its rows are ordered along the dimension in which they spread
widest, ties by a hash of the text and then by the row's own key, and cut at the weighted quantile that gives either side
its share of bytes, until every leaf is one shard. The exact cut is found by distributed histograms: sums of bytes by
digits of the order key are combined in the tasks, the digit in which the cut falls is followed for all nodes of a level
at once, and only a few rows for each node come to the driver. Rows never move: each row's path is a chain of comparisons.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import dropped, written

#: Digits of the order key (column, lowest bit, bits): 16 bits of the dimension, 32 of the text's hash, then the row's own 56.
DIGITS = (("k", 32, 16), ("k", 16, 16), ("k", 0, 16), ("tie", 40, 16), ("tie", 24, 16), ("tie", 8, 16))


@dataclass
class Node:
    shards: int
    first: int  # number of the first shard below


def _small(rows: DataFrame, records: list[dict], schema: str) -> DataFrame:
    """A table of one row for each open node, to be broadcast: there are fewer nodes than shards."""
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    table = pa.table({n: pa.array([r[n] for r in records], kinds[x.split(" ")[1]]) for n, x in zip(names, schema.split(", "))})
    return F.broadcast(rows.sparkSession.createDataFrame(table))


class KdSharder:
    """Splits rows (`size`, `dims`: an array of doubles, `text_hash`, `row_hash`, `node`: 1) into shards, level by level."""

    def __init__(self, rows: DataFrame, dimensions: int, shards: int, exact_rows: int):
        self.rows, self.dimensions, self.exact_rows = rows, dimensions, exact_rows
        self.nodes = {1: Node(shards, 0)}
        self.open = [1] if shards > 1 else []

    def _extents(self) -> dict:
        about = [F.sum("size").alias("bytes"), F.count("*").alias("n"), F.array(*[F.min(F.col("dims")[d]) for d in range(self.dimensions)]).alias("low"), F.array(*[F.max(F.col("dims")[d]) for d in range(self.dimensions)]).alias("high")]
        nodes = _small(self.rows, [{"node": n} for n in self.open], "node long")
        return {r["node"]: r for r in self.rows.join(nodes, "node").groupBy("node").agg(*about).collect()}

    def _keyed(self, splits: list[dict]) -> DataFrame:
        table = _small(self.rows, splits, "node long, dim int, low double, scale double, goal double")
        value = F.floor((F.element_at("dims", F.col("dim") + 1) - F.col("low")) * F.col("scale")).cast("long")
        k = F.shiftleft(value, 32).bitwiseOR(F.col("text_hash").bitwiseAND(F.lit((1 << 32) - 1)))
        return self.rows.join(table, "node").withColumns({"k": k, "tie": F.shiftrightunsigned("row_hash", 8)})

    def _cuts(self, keyed: DataFrame, splits: list[dict], rows: int) -> list[dict]:
        """(node, k, tie) of the last row of each node's left side."""
        state = {x["node"]: {"node": x["node"], "below": 0.0, "k": 0, "tie": 0} for x in splits}
        everything = keyed.select("node", "size", "goal", "k", "tie").alias("i")

        def inside(column: str, low: int) -> DataFrame:
            """Rows that agree with their node's digits down to bit `low` of `column`."""
            digits = _small(keyed, list(state.values()), "node long, below double, k long, tie long").alias("p")
            shift = low if column == "k" else 0
            same = F.shiftright(F.col("i.k"), shift) == F.shiftright(F.col("p.k"), shift)
            if column == "tie":
                same = same & (F.shiftright(F.col("i.tie"), low) == F.shiftright(F.col("p.tie"), low))
            return everything.join(digits, F.expr("i.node = p.node")).where(same).select("i.node", "i.size", "i.goal", "i.k", "i.tie", "p.below")

        now = inside("k", 48)
        for column, low, bits in DIGITS:
            if rows <= self.exact_rows:
                break
            if column == "tie" and low + bits == 56:
                now = inside("tie", 56)
            digit = F.shiftright(column, low).bitwiseAND(F.lit((1 << bits) - 1))
            sums = now.groupBy("node", digit.alias("v")).agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("goal").alias("goal"), F.min("below").alias("below"))
            upto = F.col("below") + F.sum("b").over(Window.partitionBy("node").orderBy("v"))
            found = sums.withColumn("upto", upto).where("upto > goal and upto - b <= goal").select("node", "v", "n", (F.col("upto") - F.col("b")).alias("before")).collect()
            rows = sum(r["n"] for r in found)
            for r in found:  # one for each node
                state[r["node"]][column] |= r["v"] << low
                state[r["node"]]["below"] = float(r["before"])
            now = inside(column, low)
        each = now.groupBy("node", "k", "tie").agg(F.sum("size").alias("b"), F.min("goal").alias("goal"), F.min("below").alias("below"))
        order = Window.partitionBy("node").orderBy("k", "tie")
        each = each.withColumn("upto", F.col("below") + F.sum("b").over(order)).where("upto > goal and upto - b <= goal")
        # the nearer of the two places to cut; one row for each node
        return [{"node": r["node"], "k": r["k"], "tie": r["tie"] if r["upto"] - r["goal"] < r["goal"] - (r["upto"] - r["b"]) else r["tie"] - 1} for r in each.collect()]

    def build(self) -> DataFrame:
        """The rows with `shard`; between levels they are written, so that a plan has one level only."""
        spread_of_all = None
        while self.open:
            seen = self._extents()
            if spread_of_all is None:
                spread_of_all = [(h - low) or 1.0 for low, h in zip(seen[1]["low"], seen[1]["high"])] if 1 in seen else [1.0] * self.dimensions
            splits = []
            for node, r in sorted(seen.items()):
                spread = [(h - low) / all_ for low, h, all_ in zip(r["low"], r["high"], spread_of_all)]
                d = max(range(self.dimensions), key=lambda x: spread[x])
                width = r["high"][d] - r["low"][d]
                shards = self.nodes[node].shards
                splits.append({"node": node, "dim": d, "low": r["low"][d], "scale": 65535 / width if width > 0 else 0.0, "goal": float(r["bytes"]) * (shards // 2) / shards})
            keyed = self._keyed(splits)
            cuts = self._cuts(keyed, splits, sum(r["n"] for r in seen.values())) if splits else []
            by_node = {c["node"]: c for c in cuts}
            table = [s | {"ck": by_node[s["node"]]["k"], "ct": by_node[s["node"]]["tie"]} for s in splits if s["node"] in by_node]
            following = []
            for node in self.open:
                here = self.nodes[node]
                left = here.shards // 2
                self.nodes[2 * node], self.nodes[2 * node + 1] = Node(left, here.first), Node(here.shards - left, here.first + left)
                following += [n for n in (2 * node, 2 * node + 1) if self.nodes[n].shards > 1]
            self.open = following
            before = self.rows
            small = _small(before, table, "node long, dim int, low double, scale double, ck long, ct long")
            value = F.floor((F.element_at("dims", F.col("dim") + 1) - F.col("low")) * F.col("scale")).cast("long")
            k = F.shiftleft(value, 32).bitwiseOR(F.col("text_hash").bitwiseAND(F.lit((1 << 32) - 1)))
            left = (k < F.col("ck")) | ((k == F.col("ck")) & (F.shiftrightunsigned("row_hash", 8) <= F.col("ct")))
            moved = before.join(small, "node", "left").withColumn("node", F.when(F.col("ck").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(left, 0).otherwise(1)))
            self.rows = written(moved.select(*before.columns), "shard-rows")
            dropped(before.sparkSession, before)
        leaves = [{"node": n, "shard": x.first} for n, x in self.nodes.items() if x.shards == 1]
        return self.rows.join(_small(self.rows, leaves, "node long, shard int"), "node")


def shard_by_kd_tree(
    df: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    metadata: tuple[str, ...] = ("source", "lang"),
    overhead: int = 16,
    rows_per_block: int = 10_000,
    exact_rows: int = 1_000,
) -> DataFrame:
    """id, size, text_crc32, shard and slot of every row: shards of near-equal bytes.

    Give `shards`, or `target_bytes` for as many shards as leaves of that size need. A row's size is its text in UTF-8
    plus `overhead`, a null text having no bytes and the crc32 0. The dimensions are the logarithm of the size and the
    `metadata` columns, each by a hash that spreads its values; null is a value of its own. Rows of one text stay
    together unless a cut falls into a group of copies; rows alike in everything are dealt by their ids, and rows whose
    ids are equal or null too by a number of their own. Slots number a shard's rows from 0 without gaps.
    """
    unit = lambda column: F.pmod(F.xxhash64(column), F.lit(1 << 20)).cast("double")
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + overhead).cast("long")
    crc = F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long")
    # 32 bits of the id and 32 that tell rows alike apart; fixed by the writing that follows
    own = F.xxhash64(F.col(id_col).cast("string"), F.lit(17)).bitwiseAND(F.lit(-1 << 32)).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 32) - 1)))
    rows = df.select(
        df[id_col].alias("i"),
        size.alias("size"),
        crc.alias("crc"),
        F.xxhash64(text_col).alias("text_hash"),
        own.alias("row_hash"),
        F.lit(1).cast("long").alias("node"),
        F.array(*[unit(c) for c in metadata], F.floor(F.log2(size)).cast("double")).alias("dims"),
    )
    rows = written(rows, "shard-rows")
    total = rows.agg(F.sum("size"), F.count("*")).first()
    count = int(shards or max(1, -(-(total[0] or 0) // (target_bytes or 1 << 30))))
    tree = KdSharder(rows, len(metadata) + 1, count if total[1] else 1, exact_rows)
    blocks = max(1, -(-(total[1] or 0) // (count * rows_per_block)))
    placed = tree.build().select("i", "size", "crc", "shard", F.pmod("row_hash", F.lit(blocks)).alias("block"), "row_hash")
    placed = written(placed, "shard-places")
    before = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = before.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.row_number().over(Window.partitionBy("shard", "block").orderBy("row_hash", "i", "crc")) - 1
    made = placed.withColumn("inner", inner).join(before.select("shard", "block", "base"), ["shard", "block"])
    return made.select(F.col("i").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("base") + F.col("inner")).cast("long").alias("slot"))
