"""Prefix trie of conversations, built as a distributed z-fast trie.

A sequence of turns is known by the prefix keys of all its depths (two 64-bit hashes of position, role and text,
xor-ed over the turns: equal prefixes have equal keys; different ones are taken to differ). The compacted trie is a
table of nodes, each the lower end of an edge over the depths ``(above, depth]``, with some sequence that passes
it. Every node is hashed at its handle: the prefix at the two-fattest depth of its edge, the one with the most
trailing zero bits. A sequence of L turns is located by fat binary search: of the depths still possible the
two-fattest is looked up among the handles, so about log2 L look-ups find its exit node; the place where it
leaves that node's edge is then bisected by prefix keys.

Sequences are inserted in batches. All sequences not yet in the trie are located; of those that leave it at one
point by one turn a random one is inserted, and edges that are left inside are split, all in one round of Spark.
What a sequence shares with the random one splits the rest of its group as a random pivot does, so the number of
rounds grows with the logarithm of the sequences. Sums and minima over subtrees come from pointer jumping
(each node hands what it has to a node twice as far above in every round). At last the edges are expanded to one
row per depth.

Nothing here holds the turns of a conversation, or the conversations of a node, together: prefixes and
sequences are rows, equal sequences are one row before anything is looked up, and only the ids behind one SHA-256
are read in order, as a sorted stream of one task (a digest has no parts).

Turns are ordered by turn (null first), then role and text; a null role or text is empty. Rows without a
conversation id are left out: they belong to no conversation. Repeated rows are turns of their own. An empty
table has no trie. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusframe.llm.common import durable
from corpusframe.operators import ordered

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ["k1", "k2"]
#: Turns of one conversation that one window holds.
BLOCK = 4096
MOST_ROUNDS = 200


# ---- sequences ----------------------------------------------------------------------------------------------------------------

def ordered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 1), role, text: the turns of every conversation in their order."""
    rows = turns.filter(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return ordered.numbered(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "pos", first=1).drop("turn")


def rebuilt(turns: DataFrame, group: int = 5, spread: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv, depth; turns: conv, pos, role, text) after each conversation took over the start of its group's first.

    With h = crc32(id) % ``spread``, conversation c has the first h turns of conversation c - c % ``group``, then its own without the first h.
    """
    c = F.col("conv")
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("n")).withColumns({
        "h": F.crc32(c.cast("string").cast("binary")) % spread, "base": c - F.pmod(c, F.lit(group))})
    bases = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    plan = sizes.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    plan = durable(plan.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth")))
    own = turns.join(plan.select("conv", "h", "taken"), "conv").filter("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "role", "text")
    starts = turns.filter((F.pmod(c, F.lit(group)) == 0) & (F.col("pos") < spread)).withColumnRenamed("conv", "base")
    lent = starts.join(plan.select("conv", "base", "taken"), "base").filter("pos <= taken").select("conv", "pos", "role", "text")
    return plan.select("conv", F.col("depth").cast("long").alias("depth")), own.unionByName(lent)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, d, k1, k2, upto: the key of the first d turns of each sequence, and the bytes of their texts.

    Running values inside blocks of turns, then over the blocks, so that a conversation of any length is many tasks.
    """
    keyed = turns.select("conv", F.col("pos").cast("long").alias("d"), F.xxhash64(F.lit(1), "pos", "role", "text").alias("a"), F.xxhash64(F.lit(2), "pos", "role", "text").alias("b"),
                         F.octet_length("text").cast("long").alias("bytes"), F.floor((F.col("pos") - 1) / BLOCK).cast("long").alias("part"))
    keyed = durable(keyed)
    inside = W.partitionBy("conv", "part").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = keyed.groupBy("conv", "part").agg(F.expr("bit_xor(a)").alias("a"), F.expr("bit_xor(b)").alias("b"), F.sum("bytes").alias("bytes"))
    zero = F.lit(0).cast("long")
    carried = parts.select("conv", "part", F.coalesce(F.expr("bit_xor(a)").over(before), zero).alias("a0"), F.coalesce(F.expr("bit_xor(b)").over(before), zero).alias("b0"),
                           F.coalesce(F.sum("bytes").over(before), zero).alias("bytes0")).filter("part > 0")
    rows = keyed.select("conv", "d", "part", F.expr("bit_xor(a)").over(inside).alias("a"), F.expr("bit_xor(b)").over(inside).alias("b"), F.sum("bytes").over(inside).alias("bytes"))
    whole = rows.filter("part = 0").select("conv", "d", F.col("a").alias("k1"), F.col("b").alias("k2"), F.col("bytes").alias("upto"))
    later = rows.filter("part > 0").join(carried, ["conv", "part"]).select(
        "conv", "d", F.expr("a ^ a0").alias("k1"), F.expr("b ^ b0").alias("k2"), (F.col("bytes") + F.col("bytes0")).alias("upto"))
    return whole.unionByName(later)


# ---- the trie -----------------------------------------------------------------------------------------------------------------

def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] with the most trailing zero bits: high without the bits below the first in which the two differ."""
    width = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return high - high % F.pow(F.lit(2.0), width).cast("long")


def at_depth(rows: DataFrame, keys: DataFrame, conv: str, depth: str, names: dict[str, str], how: str = "left") -> DataFrame:
    """Columns of ``keys`` (its name: new name) at a sequence and depth given by columns of ``rows``; depth 0 has none."""
    found = keys.select(F.col("conv").alias("__c"), F.col("d").alias("__d"), *[F.col(a).alias(b) for a, b in names.items()])
    return rows.join(found, (F.col(conv) == F.col("__c")) & (F.col(depth) == F.col("__d")), how).drop("__c", "__d")


def with_handles(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """Nodes (node key, above, depth, rep) with the keys of their handle and of their first turn: f, h1, h2, n1, n2."""
    rows = nodes.withColumns({"f": two_fattest(F.col("above"), F.col("depth")), "first": F.col("above") + 1})
    rows = at_depth(rows, keys, "rep", "f", {"k1": "h1", "k2": "h2"})
    return at_depth(rows, keys, "rep", "first", {"k1": "n1", "k2": "n2"}).drop("first")


def fat_search(waiting: DataFrame, keys: DataFrame, nodes: DataFrame, deepest: int) -> DataFrame:
    """``waiting`` (conv, length) with the depth ``a`` of the deepest node wholly above it.

    Each step looks up the handle of the two-fattest depth between a and b: without one, or with one whose node is
    not a prefix, the exit lies above; else the search goes on below that node.
    """
    handles = nodes.filter("depth > 0").select(F.col("f").alias("hf"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("depth").alias("to"), F.col("k1").alias("e1"), F.col("k2").alias("e2"))
    state = waiting.withColumns({"a": F.lit(0).cast("long"), "b": F.col("length")})
    for step in range(max(deepest, 1).bit_length()):
        open_ = F.col("a") < F.col("b")
        state = state.withColumn("f", F.when(open_, two_fattest(F.col("a"), F.col("b"))))
        state = at_depth(state, keys, "conv", "f", {"k1": "s1", "k2": "s2"})
        state = state.join(handles, (F.col("s1") == F.col("g1")) & (F.col("s2") == F.col("g2")) & (F.col("f") == F.col("hf")), "left")
        state = at_depth(state.withColumn("end", F.when(F.col("to") <= F.col("length"), F.col("to"))), keys, "conv", "end", {"k1": "t1", "k2": "t2"})
        below = F.coalesce((F.col("t1") == F.col("e1")) & (F.col("t2") == F.col("e2")), F.lit(False))
        a = F.when(below, F.col("to")).otherwise(F.col("a"))
        b = F.when(open_ & ~below, F.col("f") - 1).otherwise(F.col("b"))
        state = state.select("conv", "length", a.alias("a"), b.alias("b"))
        if step % 3 == 2:
            state = durable(state)
    return state.select("conv", "length", "a")


def exits(waiting: DataFrame, keys: DataFrame, nodes: DataFrame, deepest: int) -> DataFrame:
    """Where each waiting sequence leaves the trie: conv, length, leave (depth), into (depth of the node below, null: none), m1, m2 (that node)."""
    found = fat_search(waiting, keys, nodes, deepest).withColumn("next", F.when(F.col("a") < F.col("length"), F.col("a") + 1))
    found = at_depth(found, keys, "conv", "next", {"k1": "s1", "k2": "s2"})
    edges = nodes.filter("depth > 0").select(F.col("n1").alias("g1"), F.col("n2").alias("g2"), F.col("above").alias("up"), F.col("depth").alias("into"), F.col("rep"), F.col("k1").alias("m1"), F.col("k2").alias("m2"))
    found = durable(found.join(edges, (F.col("s1") == F.col("g1")) & (F.col("s2") == F.col("g2")) & (F.col("a") == F.col("up")), "left").select(
        "conv", "length", "a", "into", "rep", "m1", "m2"))
    # a sequence that enters an edge shares at least its first turn; how many more is bisected
    state = found.filter("into is not null").withColumns({"same": F.col("a") + 1, "other": F.least("length", "into") + 1})
    longest = state.agg(F.max(F.col("other") - F.col("same"))).head()[0] or 0
    for step in range(int(longest).bit_length()):
        state = state.withColumn("mid", F.when(F.col("other") - F.col("same") > 1, F.floor((F.col("same") + F.col("other")) / 2)))
        state = at_depth(state, keys, "conv", "mid", {"k1": "s1", "k2": "s2"})
        state = at_depth(state, keys, "rep", "mid", {"k1": "t1", "k2": "t2"})
        equal = F.coalesce((F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")), F.lit(False))
        state = state.withColumns({"same": F.when(equal, F.col("mid")).otherwise(F.col("same")),
                                   "other": F.when(~equal & F.col("mid").isNotNull(), F.col("mid")).otherwise(F.col("other"))}).drop("mid", "s1", "s2", "t1", "t2")
        if step % 3 == 2:
            state = durable(state)
    inside = state.select("conv", "length", F.col("same").alias("leave"), "into", "m1", "m2")
    return inside.unionByName(found.filter("into is null").select("conv", "length", F.col("a").alias("leave"), "into", "m1", "m2"))


def grow(nodes: DataFrame, chosen: DataFrame, keys: DataFrame) -> DataFrame:
    """The trie with a batch of sequences more (conv, length, leave, into, m1, m2), each leaving it at a point and by a turn of its own."""
    plain = ["k1", "k2", "above", "depth", "rep"]
    cuts = chosen.filter("into is not null and leave < into").select("m1", "m2", "leave").distinct()
    cut = nodes.join(cuts, (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2"))).select(*plain, "leave")
    below = W.partitionBy("k1", "k2").orderBy("leave")
    upper = at_depth(cut.select("rep", F.coalesce(F.lag("leave").over(below), F.col("above")).alias("above"), F.col("leave").alias("depth")), keys, "rep", "depth", {"k1": "k1", "k2": "k2"}, "inner")
    lower = cut.groupBy("k1", "k2").agg(F.max("leave").alias("above"), F.max("depth").alias("depth"), F.max("rep").alias("rep"))
    leaves = at_depth(chosen.filter("leave < length").select(F.col("conv").alias("rep"), F.col("leave").alias("above"), F.col("length").alias("depth")), keys, "rep", "depth",
                      {"k1": "k1", "k2": "k2"}, "inner")
    new = with_handles(upper.select(*plain).unionByName(lower.select(*plain)).unionByName(leaves.select(*plain)), keys)
    gone = cuts.select(F.col("m1").alias("k1"), F.col("m2").alias("k2")).distinct()
    return durable(nodes.join(gone, KEY, "left_anti").select(new.columns).unionByName(new))


def build(sequences: DataFrame, keys: DataFrame) -> tuple[DataFrame, int]:
    """(compacted trie: k1, k2, above, depth, rep, f, h1, h2, n1, n2; rounds) of different sequences (conv, length > 0)."""
    deepest = sequences.agg(F.max("length")).head()[0]
    nodes = keys.sparkSession.createDataFrame([], "k1 long, k2 long, above long, depth long, rep long, f long, h1 long, h2 long, n1 long, n2 long")
    if deepest is None:
        return nodes, 0
    none = F.lit(None).cast("long")
    waiting = durable(sequences.select("conv", "length"))
    for turn in range(MOST_ROUNDS):
        if turn:
            found = durable(exits(waiting, keys, nodes, deepest))
        else:
            found = waiting.select("conv", "length", F.lit(0).cast("long").alias("leave"), none.alias("into"), none.alias("m1"), none.alias("m2"))
        by = at_depth(found.withColumn("next", F.when(F.col("leave") < F.col("length"), F.col("leave") + 1)), keys, "conv", "next", {"k1": "s1", "k2": "s2"})
        draw = F.xxhash64(F.lit(turn), "conv")
        row = F.struct("conv", "length", "leave", "into", "m1", "m2")
        # of those that leave by one turn a random one goes in; one that ends here is alone, its key is its own
        groups = by.filter("next is not null").groupBy("s1", "s2").agg(F.min_by(row, draw).alias("r")).select("r.*")
        ends = found.filter("leave = length")
        chosen = durable(groups.unionByName(ends))
        nodes = grow(nodes, chosen, keys)
        waiting = durable(waiting.join(chosen.select("conv"), "conv", "left_anti"))
        if waiting.isEmpty():
            return nodes, turn + 1
    raise RuntimeError("sequences were left after the last batch")


# ---- what the nodes hold ------------------------------------------------------------------------------------------------------

def subtree(nodes: DataFrame, sums: list[str], least: str) -> DataFrame:
    """k1, k2 with ``sums`` added up and ``least`` minimised over the subtree of each node (k1, k2, p1, p2; the root's parent is null)."""
    state = nodes.select(*KEY, "p1", "p2", *sums, least)
    while True:
        below = state.filter("p1 is not null")
        if below.isEmpty():
            return state.drop("p1", "p2")
        handed = below.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(*[F.sum(c).alias(f"__{c}") for c in sums], F.min(least).alias(f"__{least}"))
        up = below.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
        # nodes just below the root have nothing to look up: the root has no parent
        high = below.filter("p1 != 0 or p2 != 0").select(*KEY, "p1", "p2").join(up, ["p1", "p2"]).select(*KEY, "q1", "q2")
        state = durable(state.drop("p1", "p2").join(handed, KEY, "left").join(high, KEY, "left").select(
            *KEY, F.col("q1").alias("p1"), F.col("q2").alias("p2"), *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in sums],
            F.least(least, f"__{least}").alias(least)))


def digests(ends: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of the ids (k1, k2, conv) that end at a node, ascending and comma-joined.

    A stream of sorted rows: whatever the number of ids, one digest state is held.
    """
    def run(batches):
        at, state = None, None
        for batch in batches:
            out = []
            for k1, k2, conv in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if at != (k1, k2):
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = (k1, k2), hashlib.sha256(str(conv).encode())
                else:
                    state.update(b",%d" % conv)
            yield rows(out)
        if at is not None:
            yield rows([(*at, state.hexdigest())])

    def rows(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())],
                                          names=["k1", "k2", "ends_sha256"])
    return ends.select(*KEY, "conv").repartition(*KEY).sortWithinPartitions(*KEY, "conv").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def nodes_of(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations (conv, depth) and their turns (conv, pos, role, text).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    keys = durable(prefixes(turns))
    last = at_depth(conversations, keys, "conv", "depth", {"k1": "k1", "k2": "k2", "upto": "upto"})
    zero = F.lit(0).cast("long")
    ends = durable(last.select("conv", "depth", *[F.coalesce(c, zero).alias(c) for c in ("k1", "k2", "upto")]))
    equal = durable(ends.groupBy(*KEY, "depth").agg(F.min("conv").alias("conv"), F.count("*").alias("n_ends"), F.max("upto").alias("upto")))
    nodes, _ = build(equal.filter("depth > 0").select("conv", F.col("depth").alias("length")), keys)
    # the root is the node of no turns, with the key of no turns
    edges = at_depth(at_depth(nodes.select(*KEY, "above", "depth", "rep"), keys, "rep", "above", {"k1": "p1", "k2": "p2", "upto": "up_bytes"}), keys, "rep", "depth", {"upto": "down_bytes"})
    edges = edges.select(*KEY, *[F.coalesce(c, zero).alias(c) for c in ("p1", "p2")], "above", "depth", "rep", F.coalesce("up_bytes", zero).alias("up_bytes"),
                         (F.col("down_bytes") - F.coalesce("up_bytes", zero)).alias("edge_bytes"))
    root = ends.limit(1).select(zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("above"), zero.alias("depth"),
                                F.lit(None).cast("long").alias("rep"), zero.alias("up_bytes"), zero.alias("edge_bytes"))
    edges = durable(edges.unionByName(root))
    children = edges.filter("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("children"))
    held = equal.select(*KEY, F.col("conv").alias("least"), F.col("n_ends").alias("convs"), (F.col("upto") * F.col("n_ends")).alias("member_bytes"))
    full = edges.join(children, KEY, "left").join(held, KEY, "left").withColumns({
        "children": F.coalesce("children", zero), "convs": F.coalesce("convs", zero), "member_bytes": F.coalesce("member_bytes", zero), "tree_bytes": F.col("edge_bytes")})
    full = durable(full.withColumn("leaves", (F.col("children") == 0).cast("long")))
    down = subtree(full, ["convs", "leaves", "member_bytes", "tree_bytes"], "least")
    known = durable(full.select(*KEY, "p1", "p2", "above", "depth", "rep", "up_bytes", "children").join(down, KEY))
    parents = known.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("least").alias("parent_least"))
    known = known.join(parents, ["p1", "p2"], "left").join(digests(ends), KEY, "left")
    # edges to depths: all members of an edge pass each of its depths, and none ends before the last
    rows = known.withColumn("d", F.explode(F.when(F.col("depth") > 0, F.sequence(F.col("above") + 1, F.col("depth"))).otherwise(F.array(zero)))).withColumn("over", F.col("d") - 1)
    over = F.coalesce("over_bytes", zero)
    at_end = F.col("d") == F.col("depth")
    nobody = F.sha2(F.lit("").cast("binary"), 256)
    return at_depth(rows, keys, "rep", "over", {"upto": "over_bytes"}).select(
        F.col("least").alias("conv_id"), F.col("d").alias("depth"),
        F.when(F.col("d") == 0, None).when(F.col("d") == F.col("above") + 1, F.col("parent_least")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("convs").alias("n_convs"), F.when(at_end, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        # bytes of all members from here on, less one copy of every node's text from here on
        (F.col("member_bytes") - F.col("tree_bytes") - (F.col("convs") - 1) * over - F.col("up_bytes")).alias("saved_tokens"),
        F.when(at_end, F.coalesce("ends_sha256", nobody)).otherwise(nobody).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of the trie of rebuilt conversations."""
    return nodes_of(*rebuilt(durable(ordered_turns(turns, conv, turn, role, text))))
