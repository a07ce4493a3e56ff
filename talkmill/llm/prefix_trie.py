"""Conversation prefix trie: every distinct beginning of conversations as a node, built as a burst trie.

A turn becomes a digest of its role and text (16 bytes) and its length before
anything is shuffled, and a conversation the string of its turns' digests.
Equal conversations are one sequence. All sequences start in one container
below the root; a container that is too large bursts:

* its least and greatest sequence show the turns that all of it begins with.
  These become a path of nodes of the trie's head;
* the sequences behind that path go to new containers by their next turn, one
  that ends there becomes the end of the path's last node.

Bursting goes on until every container is small or holds one sequence, so a
hot beginning costs a round each time it branches, not for every turn. The
containers left are dealt by their heads, sorted, and swept: neighbours in
order share what their nodes share. Container by container the counts of
subtrees are added up to the head's paths, one round of bursts after the other.

A container of at most ``CONTAINER_TURNS`` turns, or one sequence, is held in
memory by the task that sweeps it. A conversation is one row of digests, so a
task holds that. The digest of a node's ends has to be taken over all of its
ids in order: one task reads them as a sorted stream, ids only, in constant memory.

Defined results: turns are ordered by number, null first; equal numbers by the
digest of role and text, so ties and repeated rows have one order. A null role or
text is empty. Rows without conv_id belong to no conversation and are left out. An
empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.common import take_columns
from talkmill.operators.joins import broadcast_if
from talkmill.session import cut_lineage, scratch_path, ship_package

# Bytes of a turn's digest.
TURN = 16
# Turns behind its head that a container may hold before it bursts.
CONTAINER_TURNS = 20_000
# Bytes of a container's row in a broadcast table.
ROW_BYTES = 128
# Nodes in one batch of a sweep's output.
BATCH_NODES = 20_000

_NO_ENDS = hashlib.sha256().hexdigest()
_NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, owner binary, owner_round int"
)


def _short_digest(value: Column) -> Column:
    return F.unhex(F.substring(F.sha2(value, 256), 1, 2 * TURN))


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order as structs (turn, id, bytes), ids in hex."""
    rows = take_columns(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    role, text = (F.coalesce(name, F.lit("")) for name in ("role", "text"))
    # the role's length keeps role and text apart
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN)
    turn = F.struct("turn", digest.alias("id"), F.octet_length(text).cast("long").alias("bytes"))
    narrow = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return narrow.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def packed(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, sizes): the digests of the turns as one binary string, and the texts' bytes, of ``turns``."""
    ids = F.array_join(F.transform("turns", lambda t: t["id"]), "")
    return conversations.select("conv_id", F.unhex(ids).alias("seq"), F.col("turns.bytes").alias("sizes"))


def rebuilt(conversations: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """(conv_id, seq, sizes) of conversations that share beginnings.

    Conversation c begins with the first h turns of conversation c - c % group
    (none if there is no such) and goes on with its own turns after its first h;
    h is the crc32 of the decimal id modulo ``heads``.
    """
    own = turn_digests(conversations)
    base = own.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, heads).alias("head")
    )
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads)).cast("int")
    met = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(base, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), taken), F.array().cast(own.schema["turns"].dataType))
    turns = F.concat(head, F.slice("turns", taken + 1, F.size("turns")))
    return packed(met.select("conv_id", turns.alias("turns")))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) to (key, n, lo, ends) of each key; the ids pass as a stream."""
    key, state, n, lo = None, None, 0, 0

    def out(rows: list) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        columns = zip(*rows) if rows else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "n", "lo", "ends"])

    for batch in batches:
        done = []
        for now, rows in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), lambda row: row[0]):
            ids = [conv_id for _, conv_id in rows]
            if now != key:
                if state is not None:
                    done.append((key, n, lo, state.hexdigest()))
                key, state, n, lo = now, hashlib.sha256(), 0, ids[0]
            state.update((("," if n else "") + ",".join(map(str, ids))).encode())
            n += len(ids)
        yield out(done)
    if state is not None:
        yield out([(key, n, lo, state.hexdigest())])


def _shared(left: bytes, right: bytes, start: int) -> int:
    """How many turns two sequences that share ``start`` turns begin with in common."""
    most = min(len(left), len(right)) // TURN
    while start < most and left[start * TURN : (start + 1) * TURN] == right[start * TURN : (start + 1) * TURN]:
        start += 1
    return start


def _nodes(rows: list[tuple]) -> list[list]:
    """The columns of all nodes of one container's sorted rows (head, owner, owner_round, up, level, seq, sizes, n, lo, ends)."""
    _, owner, owner_round, up, level, _, sizes, _, lo, _ = rows[0]
    depth, parent, weight = [level], [-1], [sizes[level - 1] if level else 0]
    convs, least, ends = [0], [lo], [_NO_ENDS]
    path, before = [0], None
    for *_, seq, sizes, n, lo, digest in rows:
        shared = level if before is None else _shared(before, seq, level)
        del path[shared - level + 1 :]
        for d in range(shared, len(sizes)):
            path.append(len(depth))
            depth.append(d + 1)
            parent.append(path[-2])
            weight.append(sizes[d])
            convs.append(0)
            least.append(lo)
            ends.append(_NO_ENDS)
        convs[path[-1]], ends[path[-1]] = n, digest
        least[path[-1]] = min(least[path[-1]], lo)
        before = seq
    size = len(depth)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for k in range(size - 1, -1, -1):  # a parent comes before its children
        leaves[k] = leaves[k] or 1
        saved[k] += (convs[k] - 1) * weight[k]
        p = parent[k]
        if p >= 0:
            children[p] += 1
            convs[p] += convs[k]
            least[p] = min(least[p], least[k])
            leaves[p] += leaves[k]
            saved[p] += saved[k]
    above = [up, *(least[p] for p in parent[1:])]
    none = [None] * (size - 1)
    return [least, depth, above, convs, children, leaves, saved, ends, [owner, *none], [owner_round, *none]]


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (head, seq) to the nodes of their containers."""
    names = [field.split()[0] for field in _NODE.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.int32()]
    columns: list[list] = [[] for _ in names]

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        for column in columns:
            column.clear()
        return batch

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if held and held[0][0] != row[0]:
                for column, values in zip(columns, _nodes(held)):
                    column.extend(values)
                held = []
                if len(columns[0]) >= BATCH_NODES:
                    yield out()
            held.append(row)
    if held:
        for column, values in zip(columns, _nodes(held)):
            column.extend(values)
    yield out()


class BurstTrie:
    """The trie of sequences (conv_id, seq, sizes), one row per conversation."""

    def __init__(self, sequences: DataFrame, container_turns: int = CONTAINER_TURNS):
        self.spark = sequences.sparkSession
        ship_package(self.spark)
        self.limit = container_turns
        self.bursts: list[DataFrame] = []
        settled = self._burst(self._distinct(sequences))
        columns = ("head", "owner", "owner_round", "up", "level", "seq", "sizes", "n", "lo", "ends")
        ordered = settled.select(*columns).repartition("head").sortWithinPartitions("head", "seq")
        self.parts = [self._kept(ordered.mapInArrow(_swept, _NODE), "nodes")]
        self._add_up()

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, f"trie-{name}")
        rows.write.parquet(path)
        return self.spark.read.parquet(path)

    def _distinct(self, sequences: DataFrame) -> DataFrame:
        """One row per distinct sequence, in the root's container."""
        keyed = self._kept(sequences.withColumn("key", _short_digest(F.col("seq"))), "sequences")
        once = keyed.groupBy("key").agg(F.any_value("seq").alias("seq"), F.any_value("sizes").alias("sizes"))
        ids = keyed.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
        ends = ids.mapInArrow(_digested, "key binary, n long, lo long, ends string")
        nothing = F.lit(None)
        return self._kept(
            once.join(ends, "key").select(
                "seq", "sizes", "n", "lo", "ends", F.lit(0).alias("level"), F.lit(b"").alias("head"),
                nothing.cast("binary").alias("owner"), nothing.cast("int").alias("owner_round"), nothing.cast("long").alias("up"),
            ),
            "distinct",
        )

    def _burst(self, rest: DataFrame) -> DataFrame:
        """Burst containers until all are small; the rows in their last containers."""
        settled = []
        while True:
            behind = F.size("sizes") - F.col("level") + 1
            load = rest.groupBy("head").agg(F.count(F.lit(1)).alias("rows"), F.sum(behind).alias("turns"))
            large = cut_lineage(load.where((F.col("rows") > 1) & (F.col("turns") > self.limit)).select("head"))
            number = large.count()
            if not number:
                return reduce(DataFrame.unionByName, [*settled, rest])
            chosen = broadcast_if(large, number * ROW_BYTES)
            settled.append(rest.join(chosen, "head", "left_anti"))
            inside = rest.join(chosen, "head")
            burst = self._kept(self._paths(inside), "burst")
            self.bursts.append(burst)
            opened = broadcast_if(burst.select("head", "common", F.col("lo").alias("above")), number * ROW_BYTES)
            moved = inside.join(opened, "head").where(F.length("seq") > F.col("common") * TURN)
            level = F.col("common") + 1
            rest = self._kept(
                moved.select(
                    "seq", "sizes", "n", "lo", "ends", level.alias("level"),
                    _short_digest(F.substring("seq", F.lit(1), level * TURN)).alias("head"),
                    F.col("head").alias("owner"), F.lit(len(self.bursts) - 1).alias("owner_round"), F.col("above").alias("up"),
                ),
                "rest",
            )

    def _paths(self, inside: DataFrame) -> DataFrame:
        """One row per bursting container: the turns all of it shares, and its counts."""
        found = inside.groupBy("head").agg(
            F.min(F.struct("seq", "sizes", "ends")).alias("least"), F.max("seq").alias("greatest"),
            F.sum("n").alias("n"), F.min("lo").alias("lo"),
            # the same in all of a container's rows
            *[F.min(name).alias(name) for name in ("level", "owner", "owner_round", "up")],
        )
        least, greatest = F.col("least.seq"), F.col("greatest")
        turn = lambda seq, k: F.substring(seq, k * TURN + 1, F.lit(TURN))
        places = F.sequence(F.lit(0), (F.least(F.length(least), F.length(greatest)) / TURN).cast("int"))
        # two sequences in order differ at the end of the shorter one at the latest
        common = F.get(F.filter(places, lambda k: turn(least, k) != turn(greatest, k)), F.lit(0))
        found = found.withColumn("common", common)
        return found.select(
            "head", "level", "common", "n", "lo", "owner", "owner_round", "up",
            F.slice("least.sizes", F.lit(1), F.col("common")).alias("sizes"),
            F.when(F.length(least) == F.col("common") * TURN, F.col("least.ends")).otherwise(_NO_ENDS).alias("ends"),
        )

    def _add_up(self) -> None:
        """The nodes on the paths of burst containers, the last round first."""
        for k in range(len(self.bursts) - 1, -1, -1):
            tops = reduce(DataFrame.unionByName, self.parts).where(F.col("owner_round") == k)
            sums = tops.groupBy(F.col("owner").alias("head")).agg(
                F.count(F.lit(1)).alias("below"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_below")
            )
            each = self.bursts[k].join(sums, "head").withColumn("depth", F.explode(F.sequence("level", "common")))
            weight = F.when(F.col("depth") > 0, F.get("sizes", F.col("depth") - 1)).otherwise(0)
            # a path is a container's only, and no longer than one conversation
            upwards = Window.partitionBy("head").orderBy(F.desc("depth"))
            saved = F.col("saved_below") + F.sum(weight * (F.col("n") - 1)).over(upwards)
            top, last = F.col("depth") == F.col("level"), F.col("depth") == F.col("common")
            self.parts.append(
                self._kept(
                    each.select(
                        F.col("lo").alias("conv_id"), F.col("depth").cast("long").alias("depth"),
                        F.when(top, F.col("up")).otherwise(F.col("lo")).alias("parent_conv_id"),
                        F.col("n").alias("n_convs"), F.when(last, F.col("below")).otherwise(1).alias("n_children"),
                        "n_leaves", saved.alias("saved_tokens"),
                        F.when(last, F.col("ends")).otherwise(_NO_ENDS).alias("ends_sha256"),
                        F.when(top, F.col("owner")).alias("owner"), F.when(top, F.col("owner_round")).alias("owner_round"),
                    ),
                    "paths",
                )
            )

    def nodes(self) -> DataFrame:
        """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
        return reduce(DataFrame.unionByName, self.parts).drop("owner", "owner_round")


def prefix_trie(conversations: DataFrame, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """The nodes of conversations (conv_id, turn, role, text) as they are."""
    return BurstTrie(packed(turn_digests(conversations)), container_turns).nodes()
