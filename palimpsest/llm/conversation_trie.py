"""Prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns, named by running sums of the turns'
digests at their depths, which any slice of a conversation can compute. Nodes are
sorted into shards so that a subtree mostly lies in one, and each shard is read in reverse
level order: a node takes its children's totals from a priority queue, which spills, and
sends its own to its parent. What goes to parents outside the shard is summed by parent;
those sums are carried on across the shards in the same way, as a tree of shard roots,
and a second reading of the shards takes them in.

No conversation, turn or subtree is one task's work: conversations are sliced, and shards
cut the nodes evenly however many of them share a turn.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import SPACE, running, sliced, stage

#: Turns of a slice, and nodes of a shard.
TURNS, NODES = 1 << 14, 1 << 16
#: Messages of a priority queue in memory, and ids of a member list that are joined at once.
QUEUE, IDS = 1 << 18, 1 << 12
#: The contract of the query: conversations of a block begin with up to so many turns of its first.
BLOCK, SHARED = 20, 3
ROOT = "root"
_LANES = [f"l{k}" for k in range(4)]


class SpillingQueue:
    """A priority queue of tuples; beyond `most` of them in memory they go, sorted, to an
    unnamed scratch file of the task, as Spark's sorts spill, and are read back in order.
    Nobody else reads it, and a task that is run again makes its own."""

    def __init__(self, most: int = QUEUE):
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []  # (next tuple, run number, the rest)
        self.most, self.count = most, 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        # where Spark's own sorts of this task spill to
        file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        for item in sorted(self.heap):
            pickle.dump(item, file)
        size, self.heap = len(self.heap), []
        file.seek(0)
        rest = (pickle.load(file) for _ in range(size))
        self.count += 1
        heapq.heappush(self.runs, (next(rest), self.count, rest))

    def first(self) -> tuple | None:
        """The smallest tuple, which stays."""
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, number, rest = self.runs[0]
            if (after := next(rest, None)) is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (after, number, rest))
            return item
        return heapq.heappop(self.heap)


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words, _slice) of each turn: pos counts from 0 in the order of
    turn (null first), then role, then digest. Null roles and texts are empty; rows
    without a conversation are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.size(F.regexp_extract_all(text, F.lit(f"[^{SPACE[1:-1]}]+"), F.lit(0))).cast("bigint").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    cut = sliced(rows, "turns", F.col("conv_id"), *order, rows=TURNS)
    return stage(running(cut, ["conv_id"], order, {"pos": F.lit(1)}).select("conv_id", "pos", "digest", "words", "_slice"), "numbered")


def rebuilt(turns: DataFrame, first: Column, shared: Column, most: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) where each conversation of numbered() turns begins with the
    first `shared` turns (`most` at most) of conversation `first` in place of as many of its
    own; both are functions of conv_id. conversations: conv_id, total; turns: conv_id,
    depth (from 1), digest, words, _slice."""
    head = F.when(F.col("pos") < most, F.struct("pos", "digest", "words"))
    own = stage(turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(head)).alias("head")), "heads")
    base = own.select(F.col("conv_id").alias("_base"), F.col("head").alias("_head"))
    plan = own.drop("head").withColumn("_first", first).withColumn("shared", shared).join(base, F.col("_first") == F.col("_base"), "left")
    plan = plan.withColumn("head", F.coalesce(F.slice("_head", F.lit(1), F.col("shared").cast("int")), F.array().cast(own.schema["head"].dataType)))
    plan = plan.withColumn("k", F.size("head").cast("bigint"))
    plan = stage(plan.select("conv_id", "shared", "head", "k", (F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("shared"))).alias("total")), "rebuilt")
    theirs = plan.select("conv_id", F.explode("head").alias("t")).select("conv_id", (F.col("t.pos") + 1).alias("depth"), "t.digest", "t.words", F.lit(-1).alias("_slice"))
    kept = turns.join(plan.select("conv_id", "shared", "k"), "conv_id").filter("pos >= shared")
    kept = kept.select("conv_id", (F.col("k") + F.col("pos") - F.col("shared") + 1).alias("depth"), "digest", "words", "_slice")
    return plan.select("conv_id", "total"), theirs.unionByName(kept)


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent, words): the node of each turn and its parent. A key is
    the digest of the depth and four sums of 32-bit hashes of (depth, turn) down to it."""
    hashed = [F.xxhash64(F.lit(seed), F.col("depth"), F.col("digest")) for seed in (1, 2)]
    low, high = (lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))), (lambda x: F.shiftrightunsigned(x, 32))
    rows = turns.select("conv_id", "depth", "words", "_slice", *[f(x).alias(n) for n, (x, f) in zip(_LANES, [(x, f) for x in hashed for f in (low, high)], strict=True)])
    sums = running(rows, ["conv_id"], [F.col("depth")], {f"before_{n}": F.col(n) for n in _LANES})
    name = lambda d, *lanes: F.md5(F.concat_ws(",", d.cast("string"), *[x.cast("string") for x in lanes]).cast("binary"))
    parent = F.when(F.col("depth") == 1, F.lit(ROOT)).otherwise(name(F.col("depth") - 1, *[F.col(f"before_{n}") for n in _LANES]))
    return sums.select("conv_id", "depth", name(F.col("depth"), *[F.col(f"before_{n}") + F.col(n) for n in _LANES]).alias("key"), parent.alias("parent"), "words")


def _member_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): digest of the conv_ids of a key, ascending, comma-joined. Ids are
    joined in stretches of IDS first; the digest is carried from stretch to stretch."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = ends.groupBy("key", F.expr(f"conv_id div {IDS}").alias("part")).agg(ids.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            keys, sums = [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key == at:
                    state.update(b",")
                else:
                    if at is not None:
                        keys.append(at)
                        sums.append(state.hexdigest())
                    at, state = key, hashlib.sha256()
                state.update(text.encode())
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "ends_sha256": pa.array(sums, pa.string())})
        if at is not None:
            yield pa.RecordBatch.from_pydict({"key": pa.array([at]), "ends_sha256": pa.array([state.hexdigest()])})

    return parts.repartition("key").sortWithinPartitions("key", "part").select("key", "ids").mapInArrow(digest, "key string, ends_sha256 string")


_UP = "portal string, shard int, key string, depth long, leaves long, saved long"


def _upwards(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Shards in reverse level order. Nodes (kind 1) and what other shards send them
    (kind 0) come by shard, depth downwards and key.

    last: gives the nodes with their totals. Else what leaves the shards: by outer parent
    the sums for it (portal null), and for each portal, a node with children elsewhere,
    the outer parent of its shard root (null at the top), found by a token that travels up."""
    queue, shard, out = SpillingQueue(), None, []

    def send(depth: int, key: str, leaves: int, saved: int, portal: str = "") -> None:
        queue.push((-depth, key, portal, leaves, saved))

    def leave(until: tuple | None) -> None:
        """Messages before `until`: nobody of this shard takes them."""
        while (m := queue.first()) is not None and (until is None or m[:2] < until):
            queue.pop()
            leaves, saved = m[3], m[4]
            while not m[2] and (more := queue.first()) is not None and more[:3] == m[:3]:
                leaves, saved = leaves + more[3], saved + more[4]
                queue.pop()
            if not last:
                out.append((m[2] or None, shard, m[1], -m[0], leaves, saved))

    def table() -> pa.RecordBatch:
        if last:
            return pa.RecordBatch.from_pylist(out, _TOTAL)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=[c.split()[0] for c in _UP.split(", ")])

    for batch in batches:
        for r in batch.to_pylist():
            if r["_slice"] != shard:
                leave(None)
                shard = r["_slice"]
            if not r["kind"]:
                send(r["depth"], r["key"], r["leaves"], r["saved"])
                continue
            at = (-r["depth"], r["key"])
            leave(at)
            leaves, saved, met, tokens = int(not r["n_children"]), r["saved"], 0, []
            while (m := queue.first()) is not None and m[:2] == at:
                queue.pop()
                leaves, saved, met = leaves + m[3], saved + m[4], met + (not m[2])
                if m[2]:
                    tokens.append(m[2])
            if last:
                out.append({n: r[n] for n in _TOTAL.names if n in r} | {"n_leaves": leaves, "saved_tokens": saved})
            elif met < r["n_children"]:
                tokens.append(r["key"])
            if r["parent"] is not None:
                send(r["depth"] - 1, r["parent"], leaves, saved)
                for token in tokens:
                    send(r["depth"] - 1, r["parent"], 0, 0, token)
            else:
                out.extend((t, shard, None, None, 0, 0) for t in tokens)
        if len(out) > 10_000:
            yield table()
            out.clear()
    leave(None)
    yield table()


_TOTAL = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])
_TOTAL_DDL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tree of shard roots, in one reading: a row is all that a shard sends to one node
    (key) of the shard home, and goes on to node up of home's parent shard. Rows come by
    depth downwards, key and shard; given back: what each node gets in all."""
    queue = SpillingQueue()
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            at, leaves, saved = (-r["depth"], r["key"], r["shard"]), r["leaves"], r["saved"]
            while (m := queue.first()) is not None and m[:3] == at:
                queue.pop()
                leaves, saved = leaves + m[3], saved + m[4]
            if r["up"] is not None:
                queue.push((-r["up_depth"], r["up"], r["home"], leaves, saved))
            out.append({"_slice": r["home"], "key": r["key"], "depth": r["depth"], "leaves": leaves, "saved": saved})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("_slice", pa.int32()), ("key", pa.string()), ("depth", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64())]))


def trie(conversations: DataFrame, turns: DataFrame, nodes_a_shard: int = NODES) -> DataFrame:
    """Nodes of the trie of turns (conv_id, depth from 1 without gaps, digest, words, _slice)
    with the root: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256. conversations (conv_id, total) has every
    member once, turnless ones too. Without conversations there is no node."""
    every = stage(paths(turns), "paths")
    nodes = every.groupBy("key", "parent", "depth", "words").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("words"), "conv_id", "n_convs")
    nodes = stage(nodes.unionByName(root), "nodes")
    ends = every.join(conversations, "conv_id").filter("depth = total").select("key", "conv_id")
    ends = ends.unionByName(conversations.filter("total = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # nodes by the keys of a member at depths 1, 2, 4, ...: near the order of a walk down
    marks = every.filter("(depth & (depth - 1)) = 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", F.xxhash64("key").alias("h")))).alias("marks"))
    full = nodes.join(children, "key", "left").join(_member_digests(ends), "key", "left").join(parents, "parent", "left").join(marks, "conv_id", "left")
    way = F.transform(F.filter(F.coalesce("marks", F.array().cast(marks.schema["marks"].dataType)), lambda m: m["depth"] <= F.col("depth")), lambda m: m["h"])
    full = full.select(
        "key", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), way.alias("way"),
        F.lit(0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.lit(1).alias("kind"),
    )
    shards = sliced(full, "shards", F.col("way"), F.col("conv_id"), F.col("depth"), rows=nodes_a_shard).drop("way")
    order = ["_slice", F.col("depth").desc(), "key", "kind"]
    levels = lambda df: df.repartition("_slice").sortWithinPartitions(*order)
    narrow = levels(shards.select("_slice", "key", "parent", "depth", "n_children", "saved", "kind"))
    left = stage(narrow.mapInArrow(lambda it: _upwards(it, False), _UP), "upwards")
    tokens = left.filter("portal is not null").select(F.col("portal").alias("key"), F.col("shard").alias("home"), F.col("key").alias("up"), F.col("depth").alias("up_depth"))
    roots = left.filter("portal is null").drop("portal").join(tokens, "key")
    given = roots.repartition(1).sortWithinPartitions(F.col("depth").desc(), "key", "shard").mapInArrow(_across, "_slice int, key string, depth long, leaves long, saved long")
    sent = given.groupBy("_slice", "key", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).withColumn("kind", F.lit(0))
    return levels(shards.unionByName(sent, allowMissingColumns=True)).mapInArrow(lambda it: _upwards(it, True), _TOTAL_DDL)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of `conversations`, each rebuilt on the first turns of its
    block's first conversation, as the contract says."""
    turns = numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)
    return trie(*rebuilt(turns, F.col("conv_id") - F.col("conv_id") % BLOCK, shared))
