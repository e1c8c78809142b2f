"""The prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns; its members are the conversations that start with it. Peeling goes from the greatest
depth up. At each depth, the conversations that end there meet the nodes that survive from below; those of
equal prefix are one node, whose sums are then complete. It is written, its last turn is stripped, and it goes on as one
row towards its parent. So a node is found and added up in the same pass, a subtree of any size travels as
one row, and conversations that are copies of one another are one row from the start.

* A prefix has a key of 128 bits: the exclusive or of the hashes of (position, role, text) of its turns. Keys of all prefixes of a
  conversation are a running exclusive or, in buckets of ``BUCKET`` turns, so that no task orders a whole
  long conversation.
* Depths are cut at 8, 64, 512 and so on (``cuts``). A row carries the keys of its own prefixes within one
  stretch only, at most ``WIDEST``, and fetches those of the next stretch by its conversation.
* Within a stretch, rows that share the key at its upper end form a group. Groups of at most ``LOCAL`` rows are peeled
  to the end of the stretch in one task, many groups at a time. Larger ones are peeled over the lower half of the
  stretch first, where they fall apart into smaller groups; a stretch of one turn is added up by Spark with partial sums. So a
  first turn that a third of all conversations share costs a few more rounds and no large task.
* Ids of the conversations that end in a node are sorted over the cluster, joined to texts of up to ``JOINED`` ids, and hashed in
  order as a stream.

Turns are ordered by turn (null first), equal turns by the hashes of role and text; null roles and texts are empty.
Rows without a conversation id belong to no conversation and are left out. Repeated rows are further turns. Texts of any length are
hashed whole. An empty table gives no node, not even a root. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm import common
from tidewatch.operators import spread

# Conversations that share their beginning stand in blocks of so many ids.
FAMILY, HEAD = 100, 6
BUCKET = 4096
LOCAL, WIDEST = 256, 65_536
# Prefixes of a group of several rows that one task holds.
LOCAL_PREFIXES = 1_000_000
# Rows peeled together, and ids joined to one text.
TOGETHER, JOINED = 20_000, 100_000

STATE = ["conv", "depth", "n", "children", "leaves", "saved"]
NODE = ["conv", "depth", "k1", "k2", "p1", "p2", "n", "children", "leaves", "saved"]
KEY = ["depth", "k1", "k2"]


def turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, p (place from 0), h1, h2 (hashes of role and text), size (code points of the text) of every turn."""
    said, who = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    rows = df.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), F.xxhash64(who, said).alias("h1"),
        F.xxhash64(F.lit("second"), said, who).alias("h2"), F.length(said).cast("long").alias("size"),
    )
    placed = spread.row_index(rows, ["conv"], ["turn", "h1", "h2"], "p")
    return placed.select("conv", "p", "h1", "h2", "size")


def head_length(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(HEAD))


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their family: (conv, n) and their turns (conv, d from 1, h1, h2, size)."""
    own = placed.groupBy("conv").agg(F.count("*").alias("own"))
    own = own.withColumns({"h": head_length(F.col("conv")), "first": F.col("conv") - F.col("conv") % FAMILY})
    there = own.select(F.col("conv").alias("first"), F.col("own").alias("given"))
    taken = F.least("h", F.coalesce("given", F.lit(0)))
    convs = own.join(there, "first", "left").withColumn("taken", taken)
    convs = common.stored(convs.withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    heads = placed.where(F.col("p") < HEAD).withColumnRenamed("conv", "first")
    begun = convs.select("conv", "first", "taken").join(heads, "first").where("p < taken")
    rest = placed.where(F.col("p") >= head_length(F.col("conv"))).join(convs.select("conv", "h", "taken"), "conv")
    columns = ["h1", "h2", "size"]
    return convs.select("conv", "n"), begun.select("conv", (F.col("p") + 1).alias("d"), *columns).unionByName(
        rest.select("conv", (F.col("p") - F.col("h") + F.col("taken") + 1).alias("d"), *columns)
    )


def keyed(said: DataFrame, bucket: int | None = None) -> DataFrame:
    """conv, d, k1, k2, size: the key of the prefix that ends with each turn."""
    bucket = bucket or BUCKET
    mixed = said.select(
        "conv", "d", F.xxhash64("d", "h1", "h2").alias("x1"), F.xxhash64("h2", "d", "h1").alias("x2"), "size",
        F.floor(F.col("d") / F.lit(bucket)).alias("part"),
    )
    within = Window.partitionBy("conv", "part").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    local = {k: F.bit_xor(x).over(within) for k, x in (("k1", "x1"), ("k2", "x2"))}
    out = common.stored(mixed.withColumns(local).select("conv", "d", "k1", "k2", "size", "part"))
    # Few conversations have a second bucket: only their turns meet what the earlier ones add up to.
    later = out.where("part > 0").select("conv").distinct()
    last = {o: F.max_by(k, "d") for o, k in (("o1", "k1"), ("o2", "k2"))}
    ends = out.join(later, "conv", "left_semi").groupBy("conv", "part").agg(*[c.alias(o) for o, c in last.items()])
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("conv", "part", F.bit_xor("o1").over(before).alias("o1"), F.bit_xor("o2").over(before).alias("o2"))
    moved = out.where("part > 0").join(ends, ["conv", "part"]).select(
        "conv", "d", F.col("k1").bitwiseXOR(F.col("o1")).alias("k1"), F.col("k2").bitwiseXOR(F.col("o2")).alias("k2"), "size"
    )
    return out.where("part = 0").select("conv", "d", "k1", "k2", "size").union(moved)


def cuts(deepest: int) -> list[int]:
    """Depths at which stretches meet, from 0 to at least ``deepest``."""
    out = [0]
    while out[-1] < deepest:
        out.append(min(max(8, 8 * out[-1]), out[-1] + WIDEST))
    return out


def chains(keys: DataFrame, low: int, high: int) -> DataFrame:
    """conv, and its keys and sizes at the depths ``low`` to ``high`` (as far as it goes)."""
    rows = keys.where((F.col("d") >= low) & (F.col("d") <= high))
    entry = F.array_sort(F.collect_list(F.struct("d", "k1", "k2", "size")))
    found = rows.groupBy("conv").agg(entry.alias("c"))
    if low == 0:
        root = F.struct(F.lit(0).cast("long").alias("d"), *[F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "size")])
        found = found.withColumn("c", F.concat(F.array(root), "c"))
    return found.select(F.col("conv"), *[F.col(f"c.{a}").alias(b) for a, b in (("k1", "c1"), ("k2", "c2"), ("size", "sizes"))])


class Peeled:
    """Nodes and survivors of rows that are peeled together, down to the depth ``low`` at their first key."""

    def __init__(self, rows: list[tuple], low: int):
        #: (conv, depth, n, children, leaves, saved, c1, c2, sizes); c1[0], c2[0] are the key at ``low``.
        levels: dict[int, list[tuple]] = {}
        for conv, depth, n, children, leaves, saved, c1, c2, sizes in rows:
            levels.setdefault(depth, []).append((conv, n, children, leaves, saved, c1, c2, sizes))
        self.nodes: list[tuple] = []
        depth = max(levels, default=low)
        while depth > low:
            merged: dict[tuple, list] = {}
            at = depth - low
            for conv, n, children, leaves, saved, c1, c2, sizes in levels.pop(depth, ()):
                key = (c1[at], c2[at])
                mine = merged.get(key)
                if mine is None:
                    merged[key] = [conv, n, children, leaves, saved, c1, c2, sizes]
                else:
                    mine[0] = min(mine[0], conv)
                    for i, v in enumerate((n, children, leaves, saved), 1):
                        mine[i] += v
            up = levels.setdefault(depth - 1, [])
            for key, (conv, n, children, leaves, saved, c1, c2, sizes) in merged.items():
                leaves, saved = leaves or 1, saved + (n - 1) * sizes[at]
                self.nodes.append((conv, depth, *key, c1[at - 1], c2[at - 1], n, children, leaves, saved))
                up.append((conv, n, 1, leaves, saved, c1, c2, sizes))
            depth -= 1
        joined: dict[tuple, list] = {}
        for conv, n, children, leaves, saved, c1, c2, _ in levels.get(low, ()):
            mine = joined.setdefault((c1[0], c2[0]), [conv, 0, 0, 0, 0])
            mine[0] = min(mine[0], conv)
            for i, v in enumerate((n, children, leaves, saved), 1):
                mine[i] += v
        self.survivors = [(conv, low, *sums) for conv, *sums in joined.values()]


def _local(groups: DataFrame, low: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and survivors of groups that fit a task; rows have g1, g2 (the key at ``low``)."""
    fields = ", ".join(f"{c} long" for c in NODE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def flush() -> pa.RecordBatch:
            done = Peeled(held, low)
            # A survivor has no key here: the next stretch finds it by its conversation.
            rows = done.nodes + [(s[0], s[1], None, None, None, None, *s[2:]) for s in done.survivors]
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NODE)

        for batch in batches:
            for *group, conv, depth, n, children, leaves, saved, c1, c2, sizes in zip(
                *(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True
            ):
                if group != last and len(held) >= TOGETHER:
                    yield flush()
                    held = []
                held.append((conv, depth, n, children, leaves, saved, c1, c2, sizes))
                last = group
        if held:
            yield flush()

    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.select("g1", "g2", *STATE, "c1", "c2", "sizes").repartition(parts, "g1", "g2")
    out = common.stored(dealt.sortWithinPartitions("g1", "g2").mapInArrow(run, fields))
    return out.where("k1 IS NOT NULL"), out.where("k1 IS NULL").select(STATE)


def _one_level(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for rows of one depth, added up by Spark."""
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    nodes = rows.groupBy("depth", "k1", "k2").agg(
        F.min("conv").alias("conv"), F.min("g1").alias("p1"), F.min("g2").alias("p2"), F.min("size").alias("size"), *sums
    )
    own = (F.col("n") - 1) * F.col("size")
    nodes = common.stored(nodes.withColumns({"leaves": F.greatest("leaves", F.lit(1)), "saved": F.col("saved") + own}).select(NODE))
    return nodes, _stripped(nodes)


def _stripped(nodes: DataFrame) -> DataFrame:
    """What survives of nodes, one row for each parent."""
    return nodes.groupBy((F.col("depth") - 1).alias("depth"), "p1", "p2").agg(
        F.min("conv").alias("conv"), F.sum("n").alias("n"), F.count("*").alias("children"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
    ).select(STATE)


def peel(state: DataFrame, chain: DataFrame, base: int, low: int, high: int, local: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes of the depths above ``low`` up to ``high``, and what survives at ``low``; ``chain`` starts at ``base``."""
    at = low - base + 1
    rows = state.join(chain, "conv")
    # From here on a row's keys begin with that at ``low``.
    trimmed = {c: F.slice(c, at, F.col("depth") - F.lit(low) + 1) for c in ("c1", "c2", "sizes")}
    rows = rows.withColumns(trimmed).withColumns({"g1": F.col("c1")[0], "g2": F.col("c2")[0]})
    rows = common.stored(rows)
    sizes = rows.groupBy("g1", "g2").agg(F.count("*").alias("many"), F.sum(F.col("depth") - low).alias("prefixes"))
    large = common.stored(sizes.where((F.col("many") > local) | (F.col("many") > 1) & (F.col("prefixes") > LOCAL_PREFIXES)))
    large = large.select("g1", "g2")
    if not large.limit(1).count():
        nodes, left = _local(rows, low)
        return [nodes], left
    nodes, left = _local(rows.join(large, ["g1", "g2"], "left_anti"), low)
    big = rows.join(large, ["g1", "g2"], "left_semi")
    if high - low == 1:
        one = {"k1": F.col("c1")[1], "k2": F.col("c2")[1], "size": F.col("sizes")[1]}
        more, over = _one_level(big.withColumns(one))
        return [nodes, more], left.unionByName(over)
    middle = (low + high) // 2
    big = common.stored(big.select(STATE))
    deep, over = peel(big.where(F.col("depth") > middle), chain, base, middle, high, local)
    upper, over = peel(over.unionByName(big.where(F.col("depth") <= middle)), chain, base, low, middle, local)
    return [nodes, *deep, *upper], left.unionByName(over)


def ended(convs: DataFrame) -> DataFrame:
    """k1, k2, depth, ends: the hash of the sorted ids of the conversations that end in a prefix."""
    key = ["depth", "k1", "k2"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted; a key's ids in a partition become texts of up to JOINED ids.
        last, ids, rows = None, [], []

        def close() -> None:
            if ids:
                rows.append((*last, ids[0], ",".join(map(str, ids))))

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64()] * 4 + [pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*key, "first", "part"]
            )

        for batch in batches:
            for d, a, b, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (d, a, b) != last or len(ids) >= JOINED:
                    close()
                    last, ids = (d, a, b), []
                ids.append(conv)
            if len(rows) >= 5000:
                yield batch_of()
                rows.clear()
        close()
        if rows:
            yield batch_of()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, rows = None, None, []

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64()] * 3 + [pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*key, "ends"]
            )

        for batch in batches:
            for d, a, b, _, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (d, a, b) != last:
                    if last is not None:
                        rows.append((*last, state.hexdigest()))
                    last, state = (d, a, b), hashlib.sha256(part.encode())
                else:
                    state.update(b"," + part.encode())
            if len(rows) >= 5000:
                yield batch_of()
                rows.clear()
        if last is not None:
            rows.append((*last, state.hexdigest()))
            yield batch_of()

    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*key, "conv"]
    ids = convs.select(order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    fields = "depth long, k1 long, k2 long"
    texts = ids.mapInArrow(join, f"{fields}, first long, part string")
    texts = texts.repartition(parts, *key).sortWithinPartitions(*key, "first")
    return texts.mapInArrow(digest, f"{fields}, ends string")


def trie(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    local: int = LOCAL, bucket: int | None = None,
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    with spread.job(df.sparkSession) as keep, common.tidy(df.sparkSession):
        placed = common.stored(turns(df, conv_id, turn, role, text))
        counted, said = rebuilt(placed)
        keys = common.stored(keyed(said, bucket))
        # Each conversation with the key of its whole; those without a turn have the root's.
        whole = counted.withColumnRenamed("n", "d").join(keys.select("conv", "d", "k1", "k2"), ["conv", "d"], "left")
        zero = {k: F.coalesce(k, F.lit(0)) for k in ("k1", "k2")}
        whole = common.stored(whole.withColumnRenamed("d", "depth").withColumns(zero).select("conv", *KEY))
        # Copies are one row: the smallest id stands for them.
        start = whole.groupBy(KEY).agg(F.min("conv").alias("conv"), F.count("*").alias("n"))
        nothing = {c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")}
        start = common.stored(start.withColumns(nothing).select(STATE))
        deepest = start.agg(F.max("depth")).first()[0] or 0
        limits, nodes, left = cuts(deepest), [], None
        for low, high in list(zip(limits, limits[1:], strict=False))[::-1]:
            state = start.where((F.col("depth") > low) & (F.col("depth") <= high))
            state = state if left is None else state.unionByName(left)
            chain = common.stored(chains(keys, low, high))
            more, left = peel(state, chain, low, low, high, local)
            nodes += more
            left = common.stored(left)
        state = start.where("depth = 0")
        state = state if left is None else state.unionByName(left)
        sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
        root = state.agg(F.min("conv").alias("conv"), *sums).where("conv IS NOT NULL")
        root = root.withColumn("leaves", F.greatest("leaves", F.lit(1)))
        none = F.lit(None).cast("long")
        zeros = {c: F.lit(0).cast("long") for c in KEY}
        found = root.withColumns({**zeros, "p1": none, "p2": none}).select(NODE)
        for more in nodes:
            found = found.unionByName(more)
        found = keep(found)
        ends = keep(ended(whole))
    parents = found.select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent")
    )
    out = found.join(parents, ["depth", "p1", "p2"], "left").join(ends, KEY, "left")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        F.col("conv").alias("conv_id"), F.col("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", nobody).alias("ends_sha256"),
    )


def op11_peel(spark: SparkSession, folder: str) -> DataFrame:
    return trie(common.table(spark, folder, "conversations"))


# The same rows from all prefixes of all conversations; the list expression is crc32 over the id's digits.
OP11_SQL = """
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS own, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''),
      lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
      lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 6 AS h
  FROM o GROUP BY conv_id),
k AS (SELECT c.*, least(c.h, coalesce(b.own, 0)) AS k FROM c LEFT JOIN c AS b ON c.base = b.conv_id),
t AS (
  SELECT k.conv_id, p + 1 AS d, role, text FROM k JOIN o ON o.conv_id = k.base WHERE p < k
  UNION ALL
  SELECT conv_id, p - h + k + 1 AS d, role, text FROM k JOIN o USING (conv_id) WHERE p >= h),
m AS (
  SELECT conv_id, d, length(text) AS size, md5(string_agg(md5(role) || md5(text), '') OVER (
    PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS x FROM t
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM c),
len AS (SELECT conv_id, max(d) AS n FROM m GROUP BY conv_id),
nodes AS (SELECT d, x, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size FROM m GROUP BY d, x),
up AS (
  SELECT n.d, n.x, p.x AS px FROM nodes n JOIN m p ON p.conv_id = n.conv_id AND p.d = n.d - 1),
kids AS (SELECT d - 1 AS d, px AS x, count(*) AS kids FROM up GROUP BY d, px),
sums AS (
  SELECT m.d, m.x, sum((kids IS NULL)::INT) AS leaves, sum((n.n - 1) * n.size) AS saved
  FROM nodes n LEFT JOIN kids USING (d, x) JOIN m ON m.conv_id = n.conv_id AND m.d <= n.d GROUP BY m.d, m.x),
ends AS (
  SELECT m.d, m.x, sha256(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id)) AS e
  FROM m JOIN len ON len.conv_id = m.conv_id AND len.n = m.d GROUP BY m.d, m.x)
SELECT nodes.conv_id, nodes.d::BIGINT AS depth, p.conv_id AS parent_conv_id, nodes.n::BIGINT AS n_convs,
  coalesce(kids, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
  coalesce(e, sha256('')) AS ends_sha256
FROM nodes LEFT JOIN up ON up.d = nodes.d AND up.x = nodes.x LEFT JOIN nodes p ON p.d = up.d - 1 AND p.x = up.px
  LEFT JOIN kids ON kids.d = nodes.d AND kids.x = nodes.x JOIN sums ON sums.d = nodes.d AND sums.x = nodes.x
  LEFT JOIN ends ON ends.d = nodes.d AND ends.x = nodes.x
"""
