"""Prefix trie of conversations by time-forward processing.

A node is a distinct sequence of first ``d`` turns.  It is named by its depth and
128 bits: the exclusive-or of one random-looking pair of words for every (place,
turn) in it.  Exclusive-or needs no order, so a conversation of any length is cut
into the parts of a range partitioning, each part is summed by itself, and only
one total a part is carried on; no conversation is ever one group.

Totals of subtrees flow upward in time-forward processing.  Nodes are sorted
externally in reverse level order (deepest first); a node takes the messages of
its children from a priority queue, adds its own, and sends the sum to its parent
as a message that the queue delivers when the parent's turn comes.  The queue
keeps a bounded number of messages and spills sorted runs.  A child's row is
written when its parent reads the message, since only then its parent's name is
at hand.

Shards are the highest subtrees with at most ``m`` conversations, ``m`` being
``SHARD_CONVS`` or, on large inputs, a hundred-thousandth of all rebuilt turns:
nodes with more than ``m`` conversations ("heavy") then are at most
``HEAVY_MOST``.  Each shard is one stream; then the messages of the shard roots
are added per heavy parent and a last, bounded stream goes over the heavy nodes.
A subtree of one conversation is a chain whose totals are known (one leaf, nothing
saved); only its top enters the queue, so a single huge conversation is not one
stream.  Huge conversations that others repeat whole are, in bounded memory.

Defined results: null turns come first; null roles and texts are empty; rows
without conv_id belong to no conversation and are left out; turns with the same
number are ordered by a digest of role and text, so repeated rows stay side by
side and all count; no conversation, no node.  The hash of a node's ends is one
stream over its members by definition (only their ids are sorted and read).
"""
from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parleo.llm.common import shared_table
from parleo.plans.skew import attach

BLOCK = 100
MOST_SHARED = 6
SHARD_CONVS = 1_000
HEAVY_MOST = 100_000
QUEUE_MOST = 100_000
RUN_BLOCK = 1_000
FRAME = 10_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class SpillingQueue:
    """Priority queue of tuples; beyond ``most`` held ones, the held ones go to disk as a sorted run.

    Runs lie in Spark's own spill folder of the executor, belong to one attempt
    of one task and vanish with it.
    """

    def __init__(self, most: int = QUEUE_MOST):
        self.most, self.held, self.heads, self.runs = most, [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.held, item)
        if len(self.held) > self.most:
            run = self._read(self._write(sorted(self.held)))
            self.held, self.runs = [], self.runs + 1
            heapq.heappush(self.heads, (next(run), self.runs, run))

    def pop_at(self, key: tuple) -> Iterator[tuple]:
        """Remove and yield, in order, the items that start with ``key``, which must be the least in the queue."""
        while True:
            spilled = self.heads and (not self.held or self.heads[0][0] < self.held[0])
            if not spilled and not self.held or (self.heads[0][0] if spilled else self.held[0])[0] != key:
                return
            if not spilled:
                yield heapq.heappop(self.held)
                continue
            item, n, run = self.heads[0]
            after = next(run, None)
            heapq.heapreplace(self.heads, (after, n, run)) if after else heapq.heappop(self.heads)
            yield item

    @staticmethod
    def _write(items: list[tuple]):
        out = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        for start in range(0, len(items), RUN_BLOCK):
            pickle.dump(items[start:start + RUN_BLOCK], out, pickle.HIGHEST_PROTOCOL)
        out.seek(0)
        return out

    @staticmethod
    def _read(run) -> Iterator[tuple]:
        with run:
            while True:
                try:
                    block = pickle.load(run)
                except EOFError:
                    return
                yield from block


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, digest, len): texts leave the rows here."""
    r, t = (F.coalesce(rows[c].cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256), 1, 32))
    return rows.where(rows[conv].isNotNull()).select(rows[conv].cast("bigint").alias("conv_id"), rows[turn].alias("turn"), digest.alias("digest"), F.length(t).cast("bigint").alias("len"))


def _numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, part, i, digest, len): ``i`` counts the turns of a conversation within one part of a range partitioning."""
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, n = None, 0
        for f in frames:
            if f.empty:
                continue
            i = f.groupby("conv_id", sort=False).cumcount() + 1
            first = f.conv_id == last
            i[first] += n
            last, n = f.conv_id.iloc[-1], int(i.iloc[-1])
            yield f.assign(i=i)[["conv_id", "part", "i", "digest", "len"]]

    order = ["conv_id", "turn", "digest"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return ranged.drop("turn").mapInPandas(task, "conv_id bigint, part int, i bigint, digest binary, len bigint")


def _terms(depth: Column, digest: Column) -> list[Column]:
    return [F.xxhash64(F.lit(s), depth.cast("bigint"), digest) for s in (1, 2)]


def paths(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK, most_shared: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """All turns of all rebuilt conversations, and one row per conversation.

    (conv_id, part, d, len, f1, f2, g1, g2): node and parent of the ``d``-th turn;
    (conv_id, n): all conversations, also those rebuilt without turns.
    """
    own = shared_table(_numbered(_turns(rows, conv, turn, role, text)))
    spans = shared_table(own.groupBy("conv_id", "part").agg(F.count("*").alias("n")))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    convs = spans.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumns({
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most_shared, "base": F.col("conv_id") - F.col("conv_id") % block})
    bases = convs.where(F.col("conv_id") == F.col("base")).select("base", F.col("n").alias("n_base"))
    facts = convs.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))

    starts = spans.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    is_base = F.col("conv_id") % block == 0
    heads = (own.where(is_base).join(starts.where(is_base), ["conv_id", "part"]).withColumn("d", F.col("i") + F.col("start")).where(F.col("d") < most_shared)
             .withColumns(dict(zip(("t1", "t2"), _terms(F.col("d"), F.col("digest"))))))
    upto = Window.partitionBy("conv_id").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    heads = shared_table(heads.select(F.col("conv_id").alias("base"), "d", "len", "t1", "t2", *[F.bit_xor(f"t{s}").over(upto).alias(f"f{s}") for s in (1, 2)]))

    carried = facts.join(heads.select("base", F.col("d").alias("k"), F.col("f1").alias("c1"), F.col("f2").alias("c2")), ["base", "k"], "left").fillna(0, ["c1", "c2"])
    facts = shared_table(carried.select("conv_id", "base", "n", "h", "k", "c1", "c2"))
    at = starts.join(facts.select("conv_id", "h", "k"), "conv_id")
    p = F.col("i") + F.col("start")
    body = own.join(at, ["conv_id", "part"]).where(p > F.col("h")).select("conv_id", "part", (F.col("k") + p - F.col("h")).alias("d"), "len", "digest")
    body = shared_table(body.select("conv_id", "part", "d", "len", *[t.alias(f"t{s}") for s, t in enumerate(_terms(F.col("d"), F.col("digest")), 1)]))
    totals = body.groupBy("conv_id", "part").agg(*[F.bit_xor(f"t{s}").alias(f"s{s}") for s in (1, 2)])
    carry = totals.join(facts, "conv_id").select("conv_id", "part", *[F.coalesce(F.bit_xor(f"s{s}").over(before), F.lit(0)).bitwiseXOR(F.col(f"c{s}")).alias(f"c{s}") for s in (1, 2)])
    within = Window.partitionBy("conv_id", "part").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    run = body.join(carry, ["conv_id", "part"]).withColumns({f"f{s}": F.bit_xor(f"t{s}").over(within).bitwiseXOR(F.col(f"c{s}")) for s in (1, 2)})
    lead = facts.where("k > 0").select("conv_id", "base", "k").join(heads, "base").where(F.col("d") <= F.col("k")).withColumn("part", F.lit(-1))
    cols = ["conv_id", "part", "d", "len", "f1", "f2", *[F.col(f"f{s}").bitwiseXOR(F.col(f"t{s}")).alias(f"g{s}") for s in (1, 2)]]
    return shared_table(run.select(*cols).unionByName(lead.select(*cols))), facts.select("conv_id", "n")


NODE = ["d", "f1", "f2"]


def _ends(path: DataFrame, convs: DataFrame) -> DataFrame:
    """(d, f1, f2, n_ends, sha): for nodes where conversations end, the hash of their ids, streamed in order."""
    last = path.groupBy("conv_id").agg(F.max(F.struct("d", "f1", "f2")).alias("e"))
    ends = convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(f"e.{c}", F.lit(0)).alias(c) for c in NODE])

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, n, digest = None, 0, None
        for f in frames:
            out = []
            for conv_id, *at in zip(f.conv_id.tolist(), f.d.tolist(), f.f1.tolist(), f.f2.tolist()):
                if at != node:
                    if node:
                        out.append((*node, n, digest.hexdigest()))
                    node, n, digest = at, 0, hashlib.sha256()
                digest.update((f",{conv_id}" if n else str(conv_id)).encode())
                n += 1
            yield pd.DataFrame(out, columns=[*NODE, "n_ends", "sha"])
        if node:
            yield pd.DataFrame([(*node, n, digest.hexdigest())], columns=[*NODE, "n_ends", "sha"])

    return ends.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInPandas(task, "d bigint, f1 bigint, f2 bigint, n_ends bigint, sha string")


def _nodes(path: DataFrame, convs: DataFrame) -> DataFrame:
    """(d, f1, f2, g1, g2, conv_id, part, n, len, n_ends, sha): one row per node, the root included."""
    below = path.groupBy(*NODE).agg(F.min(F.struct("conv_id", "part")).alias("rep"), F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("len", "g1", "g2")])
    zero = F.lit(0).cast("bigint")
    root = convs.agg(F.min("conv_id").alias("c"), F.count("*").alias("n")).where("n > 0")
    root = root.select(*[zero.alias(c) for c in NODE], F.struct(F.col("c").alias("conv_id"), F.lit(-1).alias("part")).alias("rep"), "n", *[zero.alias(c) for c in ("len", "g1", "g2")])
    return below.unionByName(root).join(_ends(path, convs), NODE, "left").select(*NODE, "g1", "g2", "rep.conv_id", "rep.part", "n", "len", F.coalesce("n_ends", F.lit(0)).alias("n_ends"), "sha")


OUT = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, g1 bigint, g2 bigint, top boolean"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def _forward(most: int):
    """Task over (shard, nodes in reverse level order): rows of all nodes, that of a shard's root marked ``top`` and without parent.

    ``leaves``, ``saved`` and ``children`` of a node are what has come from other shards.
    """
    def walk(frames: Iterable[pd.DataFrame]) -> Iterator[tuple]:
        queue = SpillingQueue(most)
        names = ["s_d", "s_f1", "s_f2", "d", "f1", "f2", "g1", "g2", "conv_id", "n", "len", "n_ends", "sha", "children", "leaves", "saved"]
        for f in frames:
            for s_d, s1, s2, d, f1, f2, g1, g2, conv, n, size, n_ends, sha, children, leaves, saved in zip(*(f[c].tolist() for c in names)):
                for _, child, rest in queue.pop_at((s_d, s1, s2, -d, f1, f2)):
                    yield child, d + 1, conv, *rest, 0, 0, False
                    children, leaves, saved = children + 1, leaves + rest[2], saved + rest[3]
                if n == 1:  # the chain below has been left out
                    children, leaves = 1 - n_ends, 1
                facts = (n, children, leaves or 1, saved + (n - 1) * size, sha or EMPTY_SHA)
                if d > s_d:
                    queue.push(((s_d, s1, s2, 1 - d, g1, g2), conv, facts))
                else:
                    yield conv, d, None, *facts, g1, g2, True

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for row in walk(frames):
            out.append(row)
            if len(out) >= FRAME:
                yield pd.DataFrame(out, columns=COLUMNS).astype({"parent_conv_id": "Int64"})
                out = []
        yield pd.DataFrame(out, columns=COLUMNS).astype({"parent_conv_id": "Int64"})

    return task


def trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", shard_convs: int = SHARD_CONVS, queue: int = QUEUE_MOST, **rebuild: int) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations; see the module's text for odd rows."""
    path, convs = paths(rows, conv, turn, role, text, **rebuild)
    nodes = shared_table(_nodes(path, convs))
    most = max(shard_convs, int(nodes.agg(F.sum("n")).first()[0] or 0) // HEAVY_MOST)
    heavy = nodes.where(F.col("n") > most)  # at most HEAVY_MOST rows: every heavy node holds more than ``most`` of the summed members
    names = F.broadcast(heavy.select(*NODE, F.col("conv_id").alias("parent")))

    every_root = convs.select("conv_id", *[F.lit(0).cast("bigint").alias(c) for c in NODE])
    light = path.select("conv_id", *NODE).unionByName(every_root).join(names, NODE, "left_anti")
    shard = light.groupBy("conv_id").agg(F.min(F.struct(*NODE)).alias("s"))
    chain = nodes.where("n = 1").groupBy("conv_id").agg(F.min("d").alias("chain"))
    placed = shared_table(attach(nodes.where(F.col("n") <= most), shard.join(chain, "conv_id", "left"), ["conv_id"], "part"))

    in_chain = (F.col("n") == 1) & (F.col("d") > F.col("chain"))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    chains = placed.where(in_chain).select("conv_id", F.col("d").alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("n").alias("n_convs"), (1 - F.col("n_ends")).alias("n_children"),
                                           one.alias("n_leaves"), none.alias("saved_tokens"), F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"))
    order = ["s_d", "s_f1", "s_f2", F.desc("d"), "f1", "f2"]
    seeds = {c: none for c in ("children", "leaves", "saved")}
    queued = placed.where(~in_chain | F.col("chain").isNull()).withColumns({f"s_{c}": F.col(f"s.{c}") for c in NODE} | seeds).drop("s", "chain", "part")
    within = shared_table(queued.repartition("s_d", "s_f1", "s_f2").sortWithinPartitions(*order).mapInPandas(_forward(queue), OUT))

    tops = within.where("top")
    above = (F.col("depth") - 1).alias("d")
    sent = tops.where("depth > 0").groupBy(above, F.col("g1").alias("f1"), F.col("g2").alias("f2")).agg(
        F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    roots = heavy.drop("part").join(sent, NODE, "left").fillna(0, list(seeds)).withColumns({f"s_{c}": none for c in NODE})
    across = roots.repartition(1).sortWithinPartitions(*order).mapInPandas(_forward(queue), OUT)

    done = [c for c in COLUMNS if c not in ("g1", "g2", "top")]
    named = tops.where("depth > 0").withColumns({"d": F.col("depth") - 1, "f1": F.col("g1"), "f2": F.col("g2")}).join(names, NODE).withColumn("parent_conv_id", F.col("parent"))
    parts = [chains, within.where("not top or depth = 0").select(*done), named.select(*done), across.select(*done)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
