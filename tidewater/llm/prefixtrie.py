"""Conversation prefix trie by truncation peeling.

Every distinct sequence of first d turns of a conversation is a node at depth d; the
conversations that begin with it are its members. The trie is found from its leaves: at the
greatest depth stand the conversations of that length; one step strips the last turn of
every node found so far, puts the conversations that end one turn earlier beside them
and groups the two by path. Each group is a node, and all that is asked of it (members, least member,
children, leaves, saved words) is a sum or a minimum over the group, so the same
aggregation finds the nodes and measures their subtrees. Every row moves up once a level; there
is one aggregation for each level, combined map side first, so a beginning that a third of
all conversations share is one row a task.

Depths that at most ``DEEP_ROWS`` conversations of ``DEEP_BYTES`` in all reach are peeled in the same way
within tasks, one for each beginning: a single conversation of many turns costs no steps of its own.

A path is one binary value, ``WIDTH`` bytes a turn (the MD5 of its role and text, then the
number of words of the text): texts never move. A node is named by the MD5 of its path. Each
level is written to the shared folder, in one table, and read by the next: a lost executor costs
a part of one level.

The conversations that end at a node, in ascending order of their ids, are hashed in runs: ids are sorted
by (path, id) in range partitions, each makes one text of at most ``RUN`` ids after the other,
and only the nodes with more than one run stream theirs, in order, through one hash (SHA-256 has no
other way), holding one run at a time.

Null roles and texts are empty. Turns are ordered by number, null first, turns of one
number by their digests. Rows without a conv_id belong to no conversation and are left
out. An empty table gives no rows, a conversation none of whose turns is left ends at the root.
The turns' digests of one conversation (24 bytes each), not its texts, must fit into a task, and
a conversation of d turns is hashed at each of its d depths.
"""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import setup, stage_table
from tidewater.session import ensure_checkpoint_dir

WIDTH = 24     # bytes of a path for each turn: 16 of the digest, 8 of the number of words
SHARED = 4     # a conversation takes fewer than so many turns from the first of its block
BLOCK = 20     # ids in a block
RUN = 1 << 16  # ids in one text on the way to a node's hash
DEEP_ROWS, DEEP_BYTES = 1000, 1 << 24
_WORD = r"[^\x20\x09-\x0D]+"
_NONE = hashlib.sha256(b"").hexdigest()


def _first(path, turns) -> Column:
    return F.substring(path, F.lit(1), turns * WIDTH)


def _turns(path) -> Column:
    return F.floor(F.length(path) / WIDTH).cast("int")


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) of every conversation."""
    setup(conversations.sparkSession)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(_WORD)).cast("long")), 16, "0")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), F.concat(digest, words).alias("entry"))
    own = (conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
           .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")))
    return own.select("conv_id", F.unhex(F.array_join(F.col("ts.entry"), "")).alias("path"))


def rebuilt(own: DataFrame) -> DataFrame:
    """``own(conv_id, path)`` with the first turns of each conversation, 0 to ``SHARED`` - 1 by its id's
    CRC-32, replaced by those of the first conversation of its block; none if there is no such one."""
    c = F.col("conv_id")
    heads = own.where(c % BLOCK == 0).select(c.alias("block"), _first(F.col("path"), F.lit(SHARED - 1)).alias("head"))
    h = (F.crc32(c.cast("string").cast("binary")) % SHARED).cast("int")
    return (own.withColumn("block", c - c % BLOCK).withColumn("h", h).join(heads, "block", "left")
            .select("conv_id", F.concat(F.coalesce(_first(F.col("head"), F.col("h")), F.unhex(F.lit(""))),
                                        F.substring("path", F.col("h") * WIDTH + 1, F.length("path"))).alias("path")))


def _key(path) -> Column:
    return F.unhex(F.md5(path))


_NODE = ("path binary, key binary, parent binary, n_convs long, conv_id long, n_children long, n_leaves long, "
         "saved_tokens long, depth int")


def _peel(live: DataFrame) -> DataFrame:
    """The nodes of one level from its ended conversations and the stripped nodes below it."""
    words = F.conv(F.hex(F.substring("path", -8, 8)), 16, 10).cast("long")
    nodes = live.groupBy("path").agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_children").alias("n_children"),
        F.greatest(F.sum("n_leaves"), F.lit(1)).cast("long").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return nodes.select(
        "path", _key("path").alias("key"), F.when(_turns("path") > 0, _key(_first(F.col("path"), _turns("path") - 1))).alias("parent"),
        "n_convs", "conv_id", "n_children", "n_leaves",
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.coalesce(words, F.lit(0))).alias("saved_tokens"))


def _peel_deep(ended: DataFrame, floor: int) -> DataFrame:
    """The nodes beyond depth ``floor``, of few conversations; ``path`` only at the last level above it."""
    def peel(pdf: pd.DataFrame) -> pd.DataFrame:
        ends: dict[int, list] = {}
        for path, n, conv in zip(pdf["path"], pdf["n_convs"], pdf["conv_id"]):
            ends.setdefault(len(path) // WIDTH, []).append((bytes(path), (n, conv, 0, 0, 0)))
        live, out = {}, []

        def merge(path, row):
            old = live.get(path)
            live[path] = row if old is None else (old[0] + row[0], min(old[1], row[1]), old[2] + row[2], old[3] + row[3], old[4] + row[4])
        for depth in range(max(ends), floor, -1):
            for path, row in ends.get(depth, ()):
                merge(path, row)
            level, live = live, {}
            for path, (n, conv, children, leaves, saved) in level.items():
                leaves, saved = leaves or 1, saved + (n - 1) * int.from_bytes(path[-8:], "big")
                up = path[:-WIDTH]
                out.append((path if depth == floor + 1 else None, hashlib.md5(path).digest(), hashlib.md5(up).digest(),
                            n, conv, children, leaves, saved, depth))
                merge(up, (n, conv, 1, leaves, saved))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _NODE.split(", ")])
    same = ended.groupBy("path").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    return same.groupBy(_first(F.col("path"), F.lit(floor)).alias("start")).applyInPandas(peel, _NODE)


def nodes(convs: DataFrame) -> DataFrame:
    """``convs(conv_id, path)`` to (key, parent, depth, conv_id, n_convs, n_children, n_leaves, saved_tokens), one row a
    node; ``path`` where it was at hand."""
    spark = setup(convs.sparkSession)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    # sorted by depth, so that a level's conversations are in few files
    (convs.withColumn("depth", _turns("path")).repartitionByRange("depth", "conv_id")
     .write.partitionBy("depth").parquet(f"{root}/ended"))
    ended = spark.read.schema("conv_id long, path binary, depth int").parquet(f"{root}/ended")
    lengths = ended.groupBy("depth").count().orderBy(F.col("depth").desc()).collect()  # one row a length
    if not lengths:
        return spark.createDataFrame([], _NODE)
    floor, rows, size = lengths[0]["depth"], 0, 0
    for r in lengths:  # the least depth beyond which there are few conversations
        if rows > DEEP_ROWS or size > DEEP_BYTES or r["depth"] == 0:
            break
        floor, rows, size = r["depth"], rows + r["count"], size + r["count"] * r["depth"] * WIDTH
    if floor < lengths[0]["depth"]:
        _peel_deep(ended.where(F.col("depth") > floor), floor).write.partitionBy("depth").parquet(f"{root}/nodes")
    zero = F.lit(0).cast("long")
    below = floor < lengths[0]["depth"]
    for depth in range(floor, -1, -1):
        live = ended.where(F.col("depth") == depth).select(
            "path", F.lit(1).cast("long").alias("n_convs"), "conv_id", zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"))
        if below:
            under = spark.read.schema(_NODE).parquet(f"{root}/nodes").where(F.col("depth") == depth + 1)
            live = live.unionByName(under.select(
                _first(F.col("path"), F.lit(depth)).alias("path"), "n_convs", "conv_id",
                F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens"))
        _peel(live).write.parquet(f"{root}/nodes/depth={depth}")
        below = True
    return spark.read.schema(_NODE).parquet(f"{root}/nodes")


def ends(convs: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations end: the hash of their ids, ascending, joined by commas."""
    def runs(batches):
        key, ids = None, []
        for batch in batches:
            out = []
            for node, i in zip(batch["key"], batch["conv_id"]):
                if node != key or len(ids) == RUN:
                    if ids:
                        out.append((key, ids[0], ",".join(map(str, ids))))
                    key, ids = node, []
                ids.append(i)
            yield pd.DataFrame(out, columns=["key", "at", "ids"])
        yield pd.DataFrame([(key, ids[0], ",".join(map(str, ids)))] if ids else [], columns=["key", "at", "ids"])
    t = convs.select(_key("path").alias("key"), "conv_id")
    t = t.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    t = stage_table(t.mapInPandas(runs, "key binary, at long, ids string"), "runs")
    many = stage_table(t.groupBy("key").count().where("count > 1").select("key"), "many")

    def stream(batches):
        key, h = None, None
        for batch in batches:
            out = []
            for node, ids in zip(batch["key"], batch["ids"]):
                if node != key:
                    if h:
                        out.append((key, h.hexdigest()))
                    key, h = node, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["key", "ends_sha256"])
        yield pd.DataFrame([(key, h.hexdigest())] if h else [], columns=["key", "ends_sha256"])
    whole = t.join(many, "key", "left_anti").select("key", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    long = t.join(many, "key", "left_semi").repartition("key").sortWithinPartitions("key", "at")
    return whole.unionByName(long.select("key", "ids").mapInPandas(stream, "key binary, ends_sha256 string"))


def trie(convs: DataFrame) -> DataFrame:
    """``convs(conv_id, path)`` to one row a node: conv_id (its least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, and its ``key``."""
    convs = stage_table(convs, "conversations")
    found = nodes(convs).drop("path")
    parents = found.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (found.join(parents, "parent", "left").join(ends(convs), "key", "left")
            .select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
                    "saved_tokens", F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"), "key"))
