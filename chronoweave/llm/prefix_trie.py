"""Trie of the starts that conversations share, in tables with minimal perfect hashing.

A node is a distinct sequence of first turns.  Its digest is the exclusive or of 64-bit hash pairs of
(place, turn), so the digests of all starts of a conversation are running values.  Nodes are an
aggregation by digest; depth, parent and the SHA-256 of the last turn must agree among all rows of a
digest, which proves it, from the root on, to stand for one sequence.

A node with at most ``limit`` turns in its subtree, whose parent has more, is the top of a light
subtree.  A task takes whole light subtrees, some at a time, and gives every node a slot by a minimal
perfect hash of its digest, compared with the digest stored there.  Counts are scattered into flat
arrays by slot and added from the deepest nodes upwards through an array of parent slots.  Nodes
above the tops are few or lie on few long conversations: values of tops and of these nodes themselves
are put on a member conversation each, summed along it and then by digest.  So neither a frequent
start nor a long conversation has to fit into one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, stored, to_batch

# Turns in the subtrees that a task holds at a time.
LIMIT = 200_000


# -- running values along conversations ---------------------------------------------------------


def running(df: DataFrame, group: str, order: list, sums: list[str] = [], xors: list[str] = []) -> DataFrame:  # noqa: B006
    """``df`` with the long columns ``sums`` and ``xors`` replaced by their running values, this row
    included, in every ``group`` (a long without NULLs) by ``order``.

    Rows are dealt out by ranges of group and order, so a long group is spread over tasks.  Every
    task adds up its own rows; what a group brings from the tasks before is known from one row a task.
    """
    names = [*sums, *xors]
    spark = df.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), "_part int", "_seq long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, last = TaskContext.get().partitionId(), 0, None
        held = dict.fromkeys(names, np.int64(0))
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = b.column(b.schema.get_field_index(group)).to_numpy()
            begin = np.append(True, keys[1:] != keys[:-1])
            first = np.maximum.accumulate(np.where(begin, np.arange(n), 0))  # of the row's group
            columns = {f.name: b.column(i) for i, f in enumerate(b.schema)}
            for c in names:
                v = columns[c].to_numpy().astype(np.int64)
                total = np.add.accumulate(v) if c in sums else np.bitwise_xor.accumulate(v)
                before = np.where(first > 0, total[first - 1], 0)
                total = total - before if c in sums else total ^ before
                if keys[0] == last:
                    mine = first == 0
                    total[mine] = total[mine] + held[c] if c in sums else total[mine] ^ held[c]
                held[c], columns[c] = total[-1], pa.array(total)
            last = keys[-1]
            columns |= {"_part": pa.array(np.full(n, part, np.int32)), "_seq": pa.array(np.arange(seq, seq + n))}
            seq += n
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    ranged = df.repartitionByRange(shards, group, *order).sortWithinPartitions(group, *order)
    made = stored(in_arrow(ranged, run, kinds), "running")
    tail = F.max_by(F.struct(*names), "_seq").alias("tail")
    ends = made.groupBy("_part").agg(F.min(group).alias("first"), F.max(group).alias("last"), tail).collect()
    rows, group_now, now = [], None, dict.fromkeys(names, 0)
    for r in sorted(ends, key=lambda r: r["_part"]):
        brought = now if r["first"] == group_now else dict.fromkeys(names, 0)
        rows.append((r["_part"], r["first"], *brought.values()))
        goes_on = r["last"] == r["first"]
        now = {c: _both(c in sums, brought[c] if goes_on else 0, r["tail"][c]) for c in names}
        group_now = r["last"]
    fields = ", ".join(f"_{c} long" for c in names)
    carried = F.broadcast(spark.createDataFrame(rows, f"_part int, {group} long, {fields}"))  # one row a task
    out = made.join(carried, ["_part", group], "left")
    for c in names:
        brought = F.coalesce(f"_{c}", F.lit(0))
        out = out.withColumn(c, F.col(c) + brought if c in sums else F.col(c).bitwiseXOR(brought))
    return out.select(*df.columns)


def _both(is_sum: bool, a: int, b: int) -> int:
    return a + b if is_sum else a ^ b


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_sha, bytes) of all turns.

    Turns stand by ``turn``, NULL first; ties go by role and the digest of the turn, so repeated rows
    are turns of their own.  NULL roles and texts are empty ones.  Rows without a conv_id belong to no
    conversation and are left out; other columns are dropped.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sha = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        sha.alias("turn_sha"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.lit(1).cast("long").alias("place"),
    )
    placed = running(rows, "conv_id", ["turn", "role", "turn_sha"], sums=["place"])
    return placed.select("conv_id", (F.col("place") - 1).alias("place"), "turn_sha", "bytes")


def sizes(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations with turns."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))


def regrouped(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and sizes of conversations rebuilt to share starts.

    Conversation c gets the first h turns of conversation c - c % 5, or all if there are fewer, and
    then its own ones after its first h; h is a hash of c below 9.  A conversation may end up empty.
    """
    own = stored(turns, "turns")
    known = sizes(own)
    h = F.expr("crc32(CAST(conv_id AS STRING)) % 9").cast("long")
    donors = known.select(F.col("conv_id").alias("donor"), F.col("n_turns").alias("donor_turns"))
    plan = known.withColumn("donor", F.expr("conv_id - pmod(conv_id, 5)")).withColumn("h", h).join(donors, "donor", "left")
    taken = F.least("h", F.coalesce("donor_turns", F.lit(0)))
    plan = stored(plan.select("conv_id", "donor", "h", "n_turns", taken.alias("taken")), "plan")
    lent = own.where("place < 8").withColumnRenamed("conv_id", "donor")
    first = lent.join(plan.select("conv_id", "donor", "h"), "donor").where("place < h")
    rest = own.join(plan.select("conv_id", "h", "taken"), "conv_id").where("place >= h")
    rest = rest.withColumn("place", F.expr("place - h + taken"))
    columns = ["conv_id", "place", "turn_sha", "bytes"]
    size = F.expr("taken + greatest(n_turns - h, 0)").alias("n_turns")
    return first.select(columns).union(rest.select(columns)), plan.select("conv_id", size)


# -- the hash table of one task -----------------------------------------------------------------


class SlotTable:
    """Minimal perfect hash of distinct digest pairs: n keys have the slots 0 to n - 1.

    In every round the keys left over are hashed to twice as many places; those alone at theirs are
    numbered in the order of the places.  The digests are stored by slot, so a foreign key is told.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.rounds: list[tuple[np.ndarray, int]] = []  # slot by place or -1, number of places
        self.a, self.b = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
        used, left_a, left_b = 0, a, b
        while len(left_a):
            if len(self.rounds) > 64:
                raise ValueError("a digest occurs twice")
            size = 2 * len(left_a) + 1
            at = self._places(left_a, left_b, len(self.rounds), size)
            alone = np.bincount(at, minlength=size) == 1
            slots = np.where(alone, np.cumsum(alone) - 1 + used, -1)
            self.rounds.append((slots, size))
            placed = alone[at]
            self.a[slots[at[placed]]], self.b[slots[at[placed]]] = left_a[placed], left_b[placed]
            used += int(alone.sum())
            left_a, left_b = left_a[~placed], left_b[~placed]

    @staticmethod
    def _places(a: np.ndarray, b: np.ndarray, number: int, size: int) -> np.ndarray:
        x = a.astype(np.uint64) ^ (b.astype(np.uint64) * np.uint64(2 * number + 1))
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):  # fixed values of a known mixing step
            x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(33))) % np.uint64(size)).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of digests; -1 for those that the table lacks."""
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for number, (slots, size) in enumerate(self.rounds):
            got = slots[self._places(a[left], b[left], number, size)]
            out[left[got >= 0]] = got[got >= 0]
            left = left[got < 0]
        same = out >= 0
        same[same] = (self.a[out[same]] == a[same]) & (self.b[out[same]] == b[same])
        return np.where(same, out, -1)


def accumulate(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Children, leaves, saved bytes and parent's conv_id (-1 for tops) of all nodes of whole subtrees.

    ``rows`` has a, b, pa, pb, depth, n_convs, bytes and conv_id by node, in any order.
    """
    table = SlotTable(rows["a"], rows["b"])
    mine, up = table.slots(rows["a"], rows["b"]), table.slots(rows["pa"], rows["pb"])
    n = len(mine)

    def scattered(values: np.ndarray) -> np.ndarray:
        flat = np.empty(n, np.int64)
        flat[mine] = values
        return flat

    parent, depth, conv = scattered(up), scattered(rows["depth"]), scattered(rows["conv_id"])
    children = np.bincount(parent[parent >= 0], minlength=n)
    leaves = (children == 0).astype(np.int64)
    saved = scattered((rows["n_convs"] - 1) * rows["bytes"])
    order = np.argsort(-depth, kind="stable")
    order = order[parent[order] >= 0]
    levels = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, levels) if len(order) else []:
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    above = np.where(parent >= 0, conv[parent], -1)
    return {"n_children": children[mine], "n_leaves": leaves[mine], "saved_tokens": saved[mine], "up_conv": above[mine], "top": parent[mine] < 0}


NODE = "conv_id long, depth long, a long, b long, pa long, pb long, n_convs long, bytes long"
SUMMED = f"{NODE}, n_children long, n_leaves long, saved_tokens long, up_conv long, top boolean"


def _subtrees(light: DataFrame, limit: int) -> DataFrame:
    """Light nodes (NODE and their top ta, tb) with the values of ``accumulate``."""
    names = [c.split()[0] for c in NODE.split(", ")]
    schema = pa.schema([(c.split()[0], pa.bool_() if c.endswith("boolean") else pa.int64()) for c in SUMMED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        n = 0

        def summed() -> pa.RecordBatch:
            rows = {c: np.concatenate([h[c] for h in held]) for c in names}
            return to_batch(rows | accumulate(rows), schema)

        for b in batches:
            if not b.num_rows:
                continue
            rows = {f.name: b.column(i).to_numpy() for i, f in enumerate(b.schema)}
            changes = np.flatnonzero((rows["ta"][1:] != rows["ta"][:-1]) | (rows["tb"][1:] != rows["tb"][:-1])) + 1
            if held and (held[-1]["ta"][-1] != rows["ta"][0] or held[-1]["tb"][-1] != rows["tb"][0]):
                changes = np.append(0, changes)
            # all subtrees that end in this batch are whole now
            if len(changes) and n + changes[-1] >= limit:
                held.append({c: v[: changes[-1]] for c, v in rows.items()})
                yield summed()
                held, n = [{c: v[changes[-1] :] for c, v in rows.items()}], b.num_rows - int(changes[-1])
            else:
                held.append(rows)
                n += b.num_rows
        if held:
            yield summed()

    return in_arrow(light.repartition("ta", "tb").sortWithinPartitions("ta", "tb"), run, SUMMED)


def _ends(rows: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of nodes that conversations end at: digest of their ids, ascending.

    A digest of one text can't be put together from parts, so the ids of a node pass through one
    task in order; it holds one batch of them at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, hashlib.sha256()
        for b in batches:
            done = []
            for a, c, conv in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (a, c) == key:
                    sha.update(b",")
                else:
                    if key:
                        done.append((*key, sha.hexdigest()))
                    key, sha = (a, c), hashlib.sha256()
                sha.update(str(conv).encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["a", "b", "ends_sha256"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, sha.hexdigest())], names=["a", "b", "ends_sha256"])

    ordered = rows.select("a", "b", "conv_id").repartition("a", "b").sortWithinPartitions("a", "b", "conv_id")
    return in_arrow(ordered, run, "a long, b long, ends_sha256 string")


# -- the operator -------------------------------------------------------------------------------


def prefixes(turns: DataFrame, known: DataFrame) -> DataFrame:
    """A row for every start of every conversation, from the empty one on.

    ``a`` and ``b`` are its digest, ``pa`` and ``pb`` the parent's, ``below`` counts the
    conversation's starts from here on.
    """
    place, sha = F.col("place"), F.col("turn_sha")
    hashed = turns.join(known, "conv_id").select(
        "conv_id",
        "place",
        "turn_sha",
        "bytes",
        "n_turns",
        F.xxhash64(place, sha).alias("ha"),
        F.xxhash64(sha, place).alias("hb"),
        F.xxhash64(place, sha).alias("a"),
        F.xxhash64(sha, place).alias("b"),
    )
    chained = running(hashed, "conv_id", ["place"], xors=["a", "b"]).select(
        "conv_id",
        (place + 1).alias("depth"),
        "a",
        "b",
        F.col("a").bitwiseXOR(F.col("ha")).alias("pa"),
        F.col("b").bitwiseXOR(F.col("hb")).alias("pb"),
        "turn_sha",
        "bytes",
        (F.col("n_turns") - place).alias("below"),
        (F.col("n_turns") == place + 1).alias("ends"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None)
    root = known.select(
        "conv_id", zero, zero, zero, none.cast("long"), none.cast("long"), none.cast("string"), zero, F.col("n_turns") + 1, F.col("n_turns") == 0
    )
    return chained.union(root)


def _verified(value: Column) -> Column:
    """``value``, or an error if the rows of a digest differ, as only a collision can make them."""
    same = F.lit(True)
    for c in ("depth", "pa", "pb", "turn_sha"):
        same = same & F.min(c).eqNullSafe(F.max(c))
    return F.when(same, value).otherwise(F.raise_error(F.lit("two prefixes share a digest")))


def build(turns: DataFrame, known: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of
    every node, for ``turns`` (conv_id, place, turn_sha, bytes), places from 0 without gaps, and the
    ``known`` conversations (conv_id, n_turns), empty ones among them.

    Without conversations there is no root and no row.  ``limit`` bounds what a task holds at a time
    and does not change the result.
    """
    rows = stored(prefixes(turns, known), "prefixes")
    made = rows.groupBy("a", "b").agg(
        F.min("conv_id").alias("conv_id"),
        _verified(F.count(F.lit(1))).alias("n_convs"),
        *[F.min(c).alias(c) for c in ("depth", "pa", "pb", "bytes")],
        F.sum("below").alias("below"),
    )
    nodes = stored(made, "nodes")
    heavy = nodes.where(F.col("below") > limit)
    # how far down every conversation's starts are heavy; tops are one turn further
    reach = rows.join(heavy.select("a", "b"), ["a", "b"], "left_semi").groupBy("conv_id").agg(F.max("depth").alias("reach"))
    reached = rows.join(stored(reach, "reach"), "conv_id", "left").withColumn("reach", F.coalesce("reach", F.lit(-1)))
    tops = reached.where("depth = reach + 1").select("conv_id", F.col("a").alias("ta"), F.col("b").alias("tb"))
    names = [c.split()[0] for c in NODE.split(", ")]
    light = nodes.where(F.col("below") <= limit).join(tops, "conv_id")
    # the root has no parent: a digest that no node has stands for it inside the arrays
    light = light.select(*[F.coalesce(c, F.lit(-1)).alias(c) if c in ("pa", "pb") else c for c in names], "ta", "tb")
    low = stored(_subtrees(light, limit), "subtrees")
    high = _above(rows, reached, nodes, heavy, low)
    both = low.where("NOT top").select(*names, "n_children", "n_leaves", "saved_tokens", F.col("up_conv").alias("parent_conv_id"))
    parents = heavy.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    upper = low.where("top").select(*names, "n_children", "n_leaves", "saved_tokens").union(high)
    both = both.union(upper.join(parents, ["pa", "pb"], "left").select(both.columns))
    ends = _ends(rows.where("ends"))
    out = both.join(ends, ["a", "b"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _above(rows: DataFrame, reached: DataFrame, nodes: DataFrame, heavy: DataFrame, low: DataFrame) -> DataFrame:
    """Heavy nodes with their sums.

    Each value is put on the conversation that is the node's smallest member, at the depth of the
    lowest heavy node it counts for; running sums from there up reach all heavy nodes above.
    """
    children = nodes.join(heavy.select(F.col("a").alias("pa"), F.col("b").alias("pb")), ["pa", "pb"], "left_semi")
    children = children.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    grown = heavy.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = grown.select(
        "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")
    )
    given = low.where("top AND depth > 0").select("conv_id", F.col("depth") - 1, "n_leaves", "saved_tokens")
    values = own.union(given).groupBy("conv_id", "depth").agg(*[F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")])
    values = stored(values, "values")
    path = reached.where("depth <= reach").select("conv_id", "depth", "a", "b")
    path = path.join(values.select("conv_id").distinct(), "conv_id", "left_semi").join(values, ["conv_id", "depth"], "left")
    path = path.withColumn("up", -F.col("depth")).fillna(0, ["n_leaves", "saved_tokens"])
    summed = running(path, "conv_id", ["up"], sums=["n_leaves", "saved_tokens"]).groupBy("a", "b")
    summed = summed.agg(*[F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")])
    names = [c.split()[0] for c in NODE.split(", ")]
    return grown.join(summed, ["a", "b"]).select(*names, "n_children", "n_leaves", "saved_tokens")


def prefix_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) as they are; see ``numbered`` for
    NULLs, ties and repeated rows and ``build`` for the columns."""
    turns = stored(numbered(conversations), "turns")
    return build(turns, sizes(turns), limit)


def regrouped_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The trie of the conversations that ``regrouped`` makes."""
    return build(*regrouped(numbered(conversations)), limit)
