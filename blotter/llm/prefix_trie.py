"""Conversation prefix trie: a z-fast trie in tables.

A turn is a SHA-256 digest of its role and text, a conversation the chain of digests of its prefixes: the digest at
depth d stands for the first d turns.  Conversations with equal chains are one class.  The trie is compacted: only
nodes where conversations part or end are kept, each with the range (a, b] of depths of the edge above it, and is
hashed at its handle, the depth in (a, b] divisible by the largest power of two.

Classes are inserted in batches.  A batch finds its exit nodes by fat binary search: a round looks up, for every
class at once, the two-fattest depth of the range that is still open, and a hit moves the range to the node's
end; after as many rounds as the longest range has bits the deepest node on the path is known, and one lookup by the
first digest beyond it gives the edge on which the class leaves the trie.  Edges are split there, and what lies beyond
becomes new nodes, by counting what follows each new prefix.  So only the part of a conversation that the trie
has not yet got is ever spelt out.

Sums over subtrees climb the compacted trie by doubling of the parent pointer, in as many rounds as the height has bits.
Last, every edge is expanded into its depths.

Every step is a join or a grouping with partial sums on written tables.  A hot prefix is a skewed key of a join (which
Spark splits), and the ids that end at a node are hashed in sorted pieces of bounded size, never held as a list.

Odd tables: null turns come first, equal turns of a conversation are ordered by role, then the first
``HEAD`` characters of the text, then digest; null roles and texts are empty; c % 5 has the sign of c; rows without conv_id belong to no conversation and are left out; a base conversation that does not
exist lends nothing.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import pick, step

#: A class with xxhash64 % divisor = 0 belongs to the first batch whose divisor says so; the last takes the rest.
BATCHES = (8, 1)
#: Bytes of a prefix digest; the empty prefix has the empty digest.
WIDTH = 16
#: Characters of a text that order equal turns.
HEAD = 64
NOTHING = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- conversations


def turn_lists(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<digest, bytes>> in order); a conversation's digests are one row, its texts are not."""
    t = pick(turns, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]).filter("conv_id is not null")
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    one = t.select("conv_id", F.struct(
        F.coalesce(F.col("turn"), F.lit(-2**63)).alias("turn"), F.col("turn").isNotNull().alias("given"), F.col("role").alias("role"),
        F.substring("text", 1, HEAD).alias("head"), F.unhex(F.sha2(whole, 256)).alias("digest"),
        F.octet_length("text").cast("long").alias("bytes")).alias("t"))
    return one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda x: F.struct(x.digest.alias("digest"), x.bytes.alias("bytes"))).alias("turns"))


def branched(lists: DataFrame, family: int = 5, longest: int = 9) -> DataFrame:
    """(conv_id, turns) rebuilt: the first h turns of conversation c - c % family, then c's own from turn h on."""
    lists = step(lists.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).withColumn(
        "h", (F.crc32(F.col("conv_id").cast("string")) % longest).cast("int")), "turn-lists")
    lent = lists.select(F.col("conv_id").alias("base"), F.col("turns").alias("lent"))
    none = F.slice("turns", 1, 0)
    return lists.join(lent, "base", "left").select("conv_id", F.concat(
        F.coalesce(F.when(F.col("h") > 0, F.slice("lent", 1, F.col("h"))), none),
        F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns"))


def chained(lists: DataFrame) -> DataFrame:
    """(conv_id, path binary, sizes array<long>): the digest of every prefix, end to end, and running sums of bytes."""

    def run(batches):
        for b in batches:
            paths, sizes = [], []
            for turns in b.column(1).to_pylist():
                at, path, total, run_ = b"", [], 0, []
                for t in turns or ():
                    at = hashlib.blake2b(at + t["digest"], digest_size=WIDTH).digest()
                    path.append(at)
                    total += t["bytes"]
                    run_.append(total)
                paths.append(b"".join(path))
                sizes.append(run_)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.binary()), pa.array(sizes, pa.list_(pa.int64()))],
                                             ["conv_id", "path", "sizes"])

    return lists.select("conv_id", "turns").mapInArrow(run, "conv_id long, path binary, sizes array<long>")


# ---------------------------------------------------------------- trie


def _digest(path: str | Column, depth: Column) -> Column:
    """The digest of the prefix of ``depth`` turns; empty at depth 0."""
    path = F.col(path) if isinstance(path, str) else path
    return F.when(depth > 0, F.substring(path, (depth - 1) * WIDTH + 1, F.lit(WIDTH))).otherwise(F.lit(b""))


def _fattest(low: Column, high: Column) -> Column:
    """The two-fattest number in (low, high]: high without the bits below the highest one in which both differ."""
    bits = F.length(F.bin(low.bitwiseXOR(high).cast("long"))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, bits), bits)


def _common(p: Column, q: Column, low: Column, high: Column) -> Column:
    """The depth, in low..high, down to which two paths agree; they agree at ``low``."""
    same = F.filter(F.sequence(low, high), lambda d: _digest(p, d) == _digest(q, d))
    return F.array_max(same)


NODE = ["id", "a", "b", "path", "sizes"]


def _keyed(nodes: DataFrame) -> DataFrame:
    """With ``handle`` and ``door``, the digests at the two-fattest depth and at the first depth of the edge."""
    return nodes.withColumn("handle", _digest("path", _fattest(F.col("a"), F.col("b")))).withColumn("door", _digest("path", F.col("a") + 1))


def locate(classes: DataFrame, nodes: DataFrame | None, longest: int) -> DataFrame:
    """``classes`` (whole, path, sizes, n_turns) with low, the end of the deepest node on the path, m, the depth at which
    it leaves the trie, and exit, the id of the node whose edge it leaves on (null: at a node)."""
    out = classes.withColumns({"low": F.lit(0), "high": F.col("n_turns") + 1, "exit": F.lit(None).cast("binary"), "m": F.lit(0)})
    if nodes is None:
        return out.drop("high")
    trie = nodes.select(*[F.col(c).alias(f"v_{c}") for c in ("id", "a", "b", "path", "handle", "door")])
    for r in range(max(1, longest).bit_length()):
        open_ = F.col("exit").isNull() & (F.col("high") - F.col("low") > 1)
        f = F.when(open_, _fattest(F.col("low"), F.col("high") - 1))
        look = out.withColumn("f", f).withColumn("key", F.when(F.col("f").isNotNull(), _digest("path", F.col("f"))))
        met = look.join(trie.drop("v_door"), F.col("key") == F.col("v_handle"), "left")
        end = F.least("v_b", "n_turns")
        met = met.withColumn("c", F.when(F.col("v_id").isNotNull(), _common(F.col("path"), F.col("v_path"), F.col("f"), end)))
        whole = F.col("c") == F.col("v_b")
        out = met.select(
            *classes.columns,
            F.when(whole, F.col("v_b")).when(F.col("c").isNotNull(), F.col("v_a")).otherwise(F.col("low")).alias("low"),
            F.when(F.col("f").isNotNull() & F.col("v_id").isNull(), F.col("f")).otherwise(F.col("high")).alias("high"),
            F.when(F.col("c").isNotNull() & ~whole, F.col("v_id")).otherwise(F.col("exit")).alias("exit"),
            F.when(F.col("c").isNotNull(), F.col("c")).otherwise(F.col("m")).alias("m"))
        if r % 4 == 3:
            out = step(out, "trie-search")
    # a class that ends its search at a node may still go some way along an edge below it
    look = out.withColumn("key", F.when(F.col("exit").isNull() & (F.col("n_turns") > F.col("low")), _digest("path", F.col("low") + 1)))
    met = look.join(trie.drop("v_handle", "v_a"), F.col("key") == F.col("v_door"), "left")
    c = F.when(F.col("v_id").isNotNull(), _common(F.col("path"), F.col("v_path"), F.col("low") + 1, F.least("v_b", "n_turns")))
    return met.select(*classes.columns, "low", F.coalesce("exit", "v_id").alias("exit"),
                      F.when(F.col("exit").isNotNull(), F.col("m")).otherwise(F.coalesce(c, F.col("low"))).alias("m"))


def insert(nodes: DataFrame | None, classes: DataFrame, longest: int) -> DataFrame:
    """The trie's nodes with the classes of a batch."""
    found = step(locate(classes, nodes, longest), "trie-exits")
    # the unknown part, spelt out: every new prefix with what follows it
    d = F.col("d")
    spelt = found.filter("n_turns > m").select("whole", "path", "m", "n_turns", F.explode(F.sequence(F.col("m") + 1, F.col("n_turns"))).alias("d"))
    spelt = spelt.select("whole", "m", "d", _digest("path", d).alias("id"), F.when(d < F.col("n_turns"), _digest("path", d + 1)).alias("next"))
    grown = step(spelt.groupBy("id").agg(F.min("whole").alias("whole"), F.min("next").alias("least"), F.max("next").alias("most"),
                                         F.bool_or(F.col("next").isNull()).alias("ends"))
                 .filter("ends or least <> most").select("id", "whole"), "trie-new")
    # edges of new nodes begin at the new node before, or where the class left the trie; a node's spells agree on that
    kept = spelt.select("id", "whole", "d").join(grown.select("id", F.col("whole").alias("own")), "id")
    stops = kept.groupBy("whole").agg(F.sort_array(F.collect_list(F.struct("d", (F.col("own") == F.col("whole")).alias("mine")))).alias("stops"))
    fresh = found.join(stops, "whole").select("path", "sizes", "m", "stops", F.posexplode("stops").alias("i", "s")).filter("s.mine").select(
        _digest("path", F.col("s.d")).alias("id"),
        F.when(F.col("i") == 0, F.col("m")).otherwise(F.expr("stops[i - 1].d")).cast("int").alias("a"), F.col("s.d").cast("int").alias("b"),
        F.substring(F.col("path"), F.lit(1), F.col("s.d") * WIDTH).alias("path"), F.slice("sizes", F.lit(1), F.col("s.d")).alias("sizes"))
    if nodes is None:
        return step(_keyed(fresh.select(*NODE)), "trie")
    # edges on which a class left are cut there; an edge has at most as many cuts as turns
    cuts = found.filter("exit is not null").groupBy(F.col("exit").alias("id")).agg(F.sort_array(F.collect_set("m")).alias("cuts"))
    old = nodes.select(*NODE).join(cuts, "id", "left")
    old = old.withColumn("ends", F.concat(F.coalesce(F.filter("cuts", lambda c: c < F.col("b")), F.expr("array()").cast("array<int>")), F.array("b")))
    parts = old.select("a", "path", "sizes", "ends", F.posexplode("ends").alias("i", "e")).select(
        _digest("path", F.col("e")).alias("id"), F.when(F.col("i") == 0, F.col("a")).otherwise(F.expr("ends[i - 1]")).alias("a"),
        F.col("e").alias("b"), F.substring(F.col("path"), F.lit(1), F.col("e") * WIDTH).alias("path"),
        F.slice("sizes", F.lit(1), F.col("e")).alias("sizes"))
    return step(_keyed(parts.select(*NODE).unionByName(fresh.select(*NODE))), "trie")


def build(classes: DataFrame, longest: int, batches: tuple[int, ...] = BATCHES) -> DataFrame:
    """The compacted trie of ``classes`` (whole, path, sizes, n_turns), without its root."""
    nodes, left = None, F.lit(True)
    for i, divisor in enumerate(batches):
        mine = F.lit(True) if i == len(batches) - 1 else F.pmod(F.xxhash64("whole"), F.lit(divisor)) == 0
        nodes = insert(nodes, classes.filter(left & mine), longest)
        left = left & ~mine
    return nodes


# ---------------------------------------------------------------- subtrees


def climb(nodes: DataFrame, longest: int) -> DataFrame:
    """(id, parent, a, n, first, leaves, ends_bytes, edge_bytes): sums over each node's subtree, itself included.

    Input: (id, parent, own values); ``parent`` is null at the root.  Round k adds the sums of all nodes whose
    2^k-th ancestor a node is, then doubles the pointers.
    """
    sums = ("n", "leaves", "ends_bytes", "edge_bytes")
    now = step(nodes.withColumn("jump", F.col("parent")), "trie-climb")
    for _ in range(max(1, longest).bit_length()):
        up = now.filter("jump is not null").groupBy(F.col("jump").alias("id")).agg(
            *[F.sum(c).alias(f"more_{c}") for c in sums], F.min("first").alias("more_first"))
        # children of the root are many and need no lookup: the root has no parent
        beyond = now.filter("jump is not null and id <> x''").select(F.col("id").alias("at"), F.col("jump").alias("then"))
        now = step(now.join(up, "id", "left").join(beyond, F.when(F.col("jump") != F.lit(b""), F.col("jump")) == F.col("at"), "left").select(
            "id", "parent", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums],
            F.least("first", "more_first").alias("first"), F.col("then").alias("jump")), "trie-climb")
    return now.drop("jump")


def id_digests(members: DataFrame) -> DataFrame:
    """(id, ends_sha256) of (id, conv_id): the ids in ascending decimal form, comma-joined.

    Ids are sorted in ranges over all tasks, which join them to pieces; pieces of a node then pass one digest in order.
    """

    def pieces(batches):
        at, first, held, size = None, 0, [], 0
        for b in batches:
            for node, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if node != at or size > 1 << 18:
                    if held:
                        yield flush(at, first, held)
                    at, first, held, size = node, conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield flush(at, first, held)

    def flush(at, first, held):
        return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([first], pa.int64()),
                                           pa.array([",".join(held).encode()], pa.binary())], ["id", "first", "piece"])

    def digests(batches):
        at, h = None, None
        for b in batches:
            out = []
            for node, piece in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if node != at or h is None:
                    if h is not None:
                        out.append((at, h.hexdigest()))
                    at, h = node, hashlib.sha256(piece)
                else:
                    h.update(b"," + piece)
            if out:
                yield named(out)
        if h is not None:
            yield named([(at, h.hexdigest())])

    def named(out):
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], ["id", "ends_sha256"])

    cut = members.select("id", "conv_id").repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id")
    cut = cut.mapInArrow(pieces, "id binary, first long, piece binary")
    return cut.repartition("id").sortWithinPartitions("id", "first").mapInArrow(digests, "id binary, ends_sha256 string")


def trie(lists: DataFrame, batches: tuple[int, ...] = BATCHES) -> DataFrame:
    """The prefix trie of (conv_id, turns array<struct<digest, bytes>>), a row per distinct prefix.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.
    """
    convs = step(chained(lists).withColumn("n_turns", F.size("sizes")).withColumn("whole", _digest("path", F.col("n_turns"))), "chains")
    classes = step(convs.groupBy("whole").agg(F.min(F.struct("conv_id", "path", "sizes", "n_turns")).alias("c"), F.count("*").alias("n")).select(
        "whole", "n", F.col("c.conv_id").alias("first"), "c.path", "c.sizes", "c.n_turns"), "classes")
    longest = classes.agg(F.max("n_turns")).first()[0] or 0
    nodes = build(classes.filter("n_turns > 0").select("whole", "path", "sizes", "n_turns"), longest, batches)
    root = classes.agg(F.count("*").alias("all")).filter("all > 0").select(
        F.lit(b"").alias("id"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(b"").alias("path"), F.expr("array()").cast("array<long>").alias("sizes"))
    nodes = nodes.select(*NODE).unionByName(root)
    size_at = lambda d: F.when(d > 0, F.col("sizes")[d - 1]).otherwise(F.lit(0)).cast("long")
    own = nodes.select("id", F.when(F.col("b") > 0, _digest("path", F.col("a"))).alias("parent"),
                       size_at(F.col("b")).alias("end_bytes"), (size_at(F.col("b")) - size_at(F.col("a"))).alias("edge_bytes"))
    children = own.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    own = step(own.join(classes.select(F.col("whole").alias("id"), F.col("n").alias("ends"), "first"), "id", "left").join(children, "id", "left"), "trie-own")
    ends = F.coalesce("ends", F.lit(0))
    total = climb(own.select("id", "parent", ends.alias("n"), "first", F.col("n_children").isNull().cast("long").alias("leaves"),
                             (ends * F.col("end_bytes")).alias("ends_bytes"), "edge_bytes"), longest)
    above = total.select(F.col("id").alias("parent"), F.col("first").alias("above"))
    hashed = id_digests(convs.select(F.col("whole").alias("id"), "conv_id"))
    full = nodes.join(total, "id").join(own.select("id", F.coalesce("n_children", F.lit(0)).alias("n_children")), "id").join(hashed, "id", "left").join(
        above, "parent", "left")
    depths = F.when(F.col("b") > 0, F.sequence(F.col("a") + 1, F.col("b"))).otherwise(F.array(F.lit(0)))
    d, last = F.col("d"), F.col("d") == F.col("b")
    before = F.when(F.col("b") > 0, size_at(d - 1)).otherwise(F.lit(0))
    # every member adds its bytes beyond d - 1, every node below its last text once less
    saved = F.col("ends_bytes") - before * F.col("n") - (F.col("edge_bytes") - (before - size_at(F.col("a"))))
    return full.withColumn("d", F.explode(depths)).select(
        F.col("first").alias("conv_id"), d.cast("long").alias("depth"),
        F.when(d > F.col("a") + 1, F.col("first")).otherwise(F.col("above")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        saved.alias("saved_tokens"), F.when(last, F.coalesce("ends_sha256", F.lit(NOTHING))).otherwise(F.lit(NOTHING)).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, batches: tuple[int, ...] = BATCHES) -> DataFrame:
    """The prefix trie of the rebuilt conversations of (conv_id, turn, role, text)."""
    return trie(branched(turn_lists(turns)), batches)
