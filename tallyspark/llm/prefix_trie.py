"""The trie of conversations' common beginnings, by preorder intervals.

Method: every turn is a digest of its role and text, every conversation the path of its turns' digests. The different paths
are ranked in lexicographic order by a range sort; a node (a beginning of some path) is then the interval of ranks
[first, last] of the paths that begin with it, and nodes in the order of (first, depth) stand in preorder, so that a
node's subtree is a run of them: it ends at the last node of the path of rank ``last``. What a subtree sums up (leaves, savings)
is the difference of two prefix sums over that order, which are formed range by range and shifted by what the ranges before hold.

What moves are digests and numbers, never texts: each turn once to its conversation, each path once to its rank, each
beginning of a path once to its node, pre-aggregated, so that a beginning that all conversations share is one row a
task. One conversation's turns are held together as digests (about 30 bytes each). Members of a node are listed in pieces cut from
ranges of (path, conversation), and the pieces of one path are hashed in order as a stream, in bounded memory. Parents with very many
children meet them in joins that Spark splits where they are uneven. What is gathered is a row of totals for each range.

Defined cases: a null role or text is the empty string; turns go by number, null first, those of one number by role, then by
digest, repeated rows counting each; rows without a conversation id take no part; a conversation without turns is
the root's member; without conversations there are no nodes, not even a root. Columns other than the four are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.llm.shared import Scratch, written

#: Bytes of a piece of a list of ids.
PIECE = 1 << 12
EMPTY = hashlib.sha256(b"").hexdigest()
#: What prefix sums are of: nodes, leaves, saved tokens.
SUMMED = ("n", "leaf", "saved")
NO_TURNS = "array<struct<digest:binary,n_bytes:bigint>>"


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of a turn's role and text."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def turn_paths(conversations: DataFrame, bucket: Column | None = None) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (digest, n_bytes of the text). bucket: what else they are to be dealt out by."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    conv = F.col("conv_id").cast("long")
    rows = conversations.filter(conv.isNotNull()).select(*([bucket.alias("bucket")] if bucket is not None else []), conv.alias("conv_id"), turn.alias("turn"))
    keys = [c for c in rows.columns if c != "turn"]
    if bucket is not None:
        rows = rows.repartition("bucket")
    found = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return found.withColumn("turns", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["n_bytes"].alias("n_bytes"))))


def forked(conversations: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, turns): conversation c continues the first h turns of c - c % group with its own after the first h; h is crc32(c) % most.

    A fork and its origin are in one bucket, so one shuffle serves both.
    """
    conv = F.col("conv_id").cast("long")
    own = turn_paths(conversations, conv - conv % group)
    origin = own.filter("conv_id = bucket").select("bucket", F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    head = F.slice(F.coalesce("head", F.array().cast(NO_TURNS)), 1, F.col("h"))
    tail = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(origin, "bucket", "left").withColumn("h", h).select("conv_id", F.concat(head, tail).alias("turns"))


def listed(paths: DataFrame) -> DataFrame:
    """(path, ends_sha256): the sha256 of the comma-joined ids, ascending, of the conversations of each path (path, conv_id).

    Ranges of (path, conv_id) are cut into pieces of bounded size; a path's pieces are read in order, one at a time.
    """

    def pieces(batches):
        path, first, ids, size = None, None, [], 0
        for batch in batches:
            out = []
            for p, c in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if p != path or size >= PIECE:
                    if ids:
                        out.append((path, first, ",".join(ids)))
                    path, first, ids, size = p, c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], ["path", "first_id", "ids"])
        if ids:
            yield pa.record_batch([pa.array([path], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], ["path", "first_id", "ids"])

    def hashed(batches):
        path, h = None, None
        for batch in batches:
            done = []
            for p, ids in zip(batch.column("path").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if p != path:
                    if h:
                        done.append((path, h.hexdigest()))
                    path, h = p, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if done:
                yield pa.record_batch([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done])], ["path", "ends_sha256"])
        if h:
            yield pa.record_batch([pa.array([path], pa.binary()), pa.array([h.hexdigest()])], ["path", "ends_sha256"])

    parts = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(pieces, "path binary, first_id long, ids string")
    return parts.repartition("path").sortWithinPartitions("path", "first_id").mapInArrow(hashed, "path binary, ends_sha256 string")


def chained(batches):
    """Rows (rank, depth, digest and others), each path's by depth, with the node that the path has reached and its parent: digests of all turns so far."""
    rank, so_far, above = None, None, None
    for batch in batches:
        keys, parents = [], []
        for r, d in zip(batch.column("rank").to_pylist(), batch.column("digest").to_pylist(), strict=True):
            if r != rank:
                rank, so_far, above = r, hashlib.blake2b(digest_size=16), None
            so_far.update(d or b"")
            key = so_far.digest()
            keys.append(key)
            parents.append(above)
            above = key
        kept = [c for c in batch.schema.names if c != "digest"]
        yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(parents, pa.binary()), *(batch.column(c) for c in kept)], ["node", "parent", *kept])


def prefix_trie(paths: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder, subtree_end) of every node.

    paths: (conv_id, turns), a row for each conversation, as turn_paths() gives them. preorder numbers the nodes from 0, subtree_end is the last number of
    a node's subtree. Tokens are the bytes of texts; a node saves its own for all its members but one.
    """
    tables = Scratch()
    digests = F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")
    keyed = tables.written(paths.select(F.unhex(F.md5(digests.cast("binary"))).alias("path"), F.col("conv_id"), F.col("turns")))
    ranked = keyed.groupBy("path", "turns").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"))
    # Numbers of rows in sorted ranges ascend with the order; what they number is written once, so they stay.
    ranked = ranked.withColumn("order", F.transform("turns", lambda t: t["digest"])).repartitionByRange("order").sortWithinPartitions("order")
    ranked = tables.written(ranked.select(F.monotonically_increasing_id().alias("rank"), "path", "n", "conv", "turns"))
    root = F.lit(None).cast("struct<digest:binary,n_bytes:bigint>")
    steps = ranked.select("rank", "n", "conv", F.size("turns").cast("long").alias("size"), F.posexplode(F.concat(F.array(root), "turns")).alias("depth", "turn"))
    steps = steps.select("rank", "n", "conv", "size", F.col("depth").cast("long").alias("depth"), F.coalesce("turn.n_bytes", F.lit(0)).alias("n_bytes"), F.col("turn.digest").alias("digest"))
    reached = steps.mapInArrow(chained, "node binary, parent binary, rank long, n long, conv long, size long, depth long, n_bytes long")
    nodes = reached.groupBy("node", "parent", "depth", "n_bytes").agg(
        F.min("rank").alias("first"), F.max("rank").alias("last"), F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id"), F.max(F.when(F.col("depth") == F.col("size"), F.col("rank"))).alias("ends_at")
    )
    nodes = tables.written(nodes)
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    # Written, so that both sides of the next join are plain shuffles, of which Spark splits the part of a parent with very many children.
    above = tables.written(nodes.join(children, "node").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    whole = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).join(above, "parent", "left").drop("parent")
    whole = whole.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n_bytes"), "range": F.shiftright("first", 33)})
    whole = tables.written(whole)
    # Prefix sums: within a range of ranks, shifted by the ranges before; a row of totals for each range is gathered and sent back.
    totals = sorted(whole.groupBy("range").agg(F.count("*").alias("n"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")).collect())
    shift, at = [], (0, 0, 0)
    for r in totals:
        shift.append((r["range"], *at))
        at = tuple(x + y for x, y in zip(at, r[1:], strict=True))
    before = paths.sparkSession.createDataFrame(shift, "range long, " + ", ".join(f"{c}_before long" for c in SUMMED))
    running = W.partitionBy("range").orderBy("first", "depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = {f"to_{c}": F.sum(c).over(running) + F.col(f"{c}_before") for c in SUMMED}
    placed = whole.repartitionByRange("range").join(F.broadcast(before), "range").withColumn("n", F.lit(1).cast("long")).withColumns(sums)
    placed = tables.written(placed.drop("n", "range", *(f"{c}_before" for c in SUMMED)))
    ends = placed.filter("ends_at IS NOT NULL").select(F.col("ends_at").alias("last"), *(F.col(c).alias(f"{c}_end") for c in sums))
    hashes = listed(keyed.select("path", "conv_id")).join(ranked.select("path", "rank"), "path").select(F.col("rank").alias("own_end"), "ends_sha256")
    joined = placed.join(ends, "last").withColumn("own_end", F.coalesce("ends_at", -1 - F.col("first"))).join(hashes, "own_end", "left")
    result = joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("to_leaf_end") - F.col("to_leaf") + F.col("leaf")).alias("n_leaves"), (F.col("to_saved_end") - F.col("to_saved") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), (F.col("to_n") - 1).alias("preorder"), (F.col("to_n_end") - 1).alias("subtree_end"),
    )
    result = written(result)
    tables.clear()
    return result
