"""Prefix trie of conversations by smallest-member ownership.

A node of the trie is a sequence of first turns; its members are the conversations that start with it. The
smallest member of a node owns it, and as deeper nodes have fewer members, a conversation owns
a suffix of its own path. Windows over each prefix mark who owns it. What a subtree saves is then one
group-by over prefixes: each member adds the tokens of the rest of its path less those it owns, which stand
for the copy that is kept, and its flag if it owns a childless node. No tree is built or walked.

Texts are hashed where they are read and never shuffled. Nothing is gathered by conversation or by prefix
alone: turns are numbered over a range partitioning, prefixes are chained in blocks of ``BLOCK`` turns,
and windows run over shares of a prefix before they run over its candidates.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, reshuffled, table

#: Turns in a block of a prefix chain (a power of two), and its number of bits.
BLOCK_BITS = 6
BLOCK = 1 << BLOCK_BITS
#: Conversations in a group that share opening turns; the most turns shared.
GROUP, OPENING = 100, 6
#: Bits of a conversation id that differ within one piece of a list of ends.
PIECE_BITS = 12

_ROOT = hashlib.sha256(b"root").digest()


def _sha(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def turn_digest(role: str = "role", text: str = "text") -> Column:
    """SHA-256 of a turn's role, with its length in front, and text; null counts as empty."""
    r, t = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    return _sha(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t))


def _shares(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, pos, dig, n)`` of every turn, its place in its conversation from 0, digest and code points;
    and ``(conv_id, turns)``. Order: turn (null first), then the digest. However long a conversation is, it
    spreads over tasks: rows are sorted in ranges, and a range's rows count on from those of the ranges before."""
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest().alias("dig"), F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("n"))
    by = ["conv_id", F.col("turn").asc_nulls_first(), "dig"]
    rows = rows.repartitionByRange(_shares(turns), *by).sortWithinPartitions(*by).select("conv_id", "dig", "n", F.monotonically_increasing_id().alias("at"))
    rows = checkpointed(rows.withColumn("range", F.shiftright("at", 33)))
    runs = rows.groupBy("conv_id", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))  # one row a conversation and range
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(F.col("conv_id").alias("c"), F.col("range").alias("g"), (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("by"))
    out = rows.join(starts, (F.col("conv_id") == F.col("c")) & (F.col("range") == F.col("g"))).select("conv_id", (F.col("at") + F.col("by")).alias("pos"), "dig", "n")
    return out, runs.groupBy("conv_id").agg(F.sum("size").alias("turns"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the opening of their group's first one: ``(conv_id, depth, dig, n, len)`` of each turn, depth from 1,
    and ``(conv_id, len)`` of every conversation, turnless ones included.

    With ``h`` = CRC-32 of the decimal id modulo ``OPENING``, the first ``h`` turns of conversation
    ``conv_id - conv_id % GROUP`` (all, if there are fewer) come before the conversation's own turns from the ``h``-th on.
    """
    rows, sizes = numbered(turns)
    rows = checkpointed(rows)
    h = F.crc32(F.col("conv_id").cast("string")) % OPENING
    convs = sizes.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("group"))
    heads = sizes.select(F.col("conv_id").alias("head"), F.col("turns").alias("head_turns"))  # a head has at most 2 GROUP conversations
    convs = convs.join(heads, F.col("group") == F.col("head"), "left").withColumn("kept", F.least("h", F.coalesce("head_turns", F.lit(0))))
    convs = checkpointed(convs.select("conv_id", "h", "group", "kept", (F.col("kept") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("len")))
    of = convs.select(reshuffled("conv_id").alias("c"), "h", "kept", "len")
    own = rows.join(of, F.col("conv_id") == F.col("c")).where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("kept") + 1).alias("depth"), "dig", "n", "len")
    opening = rows.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < OPENING - 1)).select(F.col("conv_id").alias("head"), "pos", "dig", "n")
    shared = convs.join(opening, (F.col("group") == F.col("head")) & (F.col("pos") < F.col("kept"))).select("conv_id", (F.col("pos") + 1).alias("depth"), "dig", "n", "len")
    return own.unionByName(shared), convs.select("conv_id", "len")


def chained(rows: DataFrame, longest: int) -> DataFrame:
    """``rows(conv_id, depth, dig, n, len)`` with ``key``, a digest of all turns up to the row's, and ``upto``, the sum of their ``n``.

    A key is a chain of SHA-256 within the row's block, on top of the key of all blocks before, which is
    chained in the same way over blocks: no group has more than ``BLOCK`` rows, and equal keys mean equal turns.
    """
    turns = F.sort_array(F.collect_list(F.struct("depth", "dig", "n"))).alias("turns")
    blocks = rows.groupBy("conv_id", F.shiftright(F.col("depth") - 1, BLOCK_BITS).alias("block")).agg(turns, F.max("len").alias("len"))
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    none = F.array().cast("array<struct<key:binary,upto:bigint>>")
    step = lambda acc, x: F.concat(acc, F.array(F.struct(_sha(F.concat(F.coalesce(last(acc)["key"], F.lit(b"")), x["dig"])).alias("key"), (F.coalesce(last(acc)["upto"], F.lit(0)) + x["n"]).alias("upto"))))
    blocks = blocks.withColumn("run", F.aggregate("turns", none, step))
    above, key, upto = F.lit(None), F.col("r.key"), F.col("r.upto")
    if longest > BLOCK:
        end = last(F.col("run"))
        whole = blocks.where(F.size("run") == BLOCK).select("conv_id", (F.col("block") + 1).alias("depth"), end["key"].alias("dig"), end["upto"].alias("n"), "len")
        up = chained(whole, (longest + BLOCK - 1) // BLOCK).select(F.col("conv_id").alias("c"), F.col("depth").alias("b"), F.col("key").alias("above"), F.col("upto").alias("below"))
        blocks = blocks.join(up, (F.col("conv_id") == F.col("c")) & (F.col("block") == F.col("b")), "left")
        above = F.col("above")
        key, upto = F.when(above.isNull(), key).otherwise(_sha(F.concat(above, key))), upto + F.coalesce("below", F.lit(0))
    rows = blocks.select("*", F.explode(F.arrays_zip(F.col("turns").alias("t"), F.col("run").alias("r"))).alias("x")).select("*", "x.*")
    return rows.select("conv_id", F.col("t.depth").alias("depth"), F.col("t.dig").alias("dig"), F.col("t.n").alias("n"), "len", key.alias("key"), upto.alias("upto"))


def paths(turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, dig, n, len, key, upto)``: every node on the path of every rebuilt conversation, from the root (depth 0) on. A checkpoint."""
    rows, convs = rebuilt(turns)
    longest = convs.agg(F.max("len")).first()[0] or 0
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("dig"), F.lit(0).cast("long").alias("n"), "len", F.lit(_ROOT).alias("key"), F.lit(0).cast("long").alias("upto"))
    return checkpointed(chained(rows, longest).unionByName(root))


def owned(nodes: DataFrame) -> DataFrame:
    """The rows of ``nodes`` whose conversation owns the prefix, with ``longest``, the length of its longest member.

    A prefix may hold a third of all rows: windows first find the smallest member of each share of a prefix,
    and then the smallest of these.
    """
    share = F.pmod(F.xxhash64("conv_id"), F.lit(_shares(nodes)))
    rows = nodes.select("conv_id", "depth", "len", "key", (F.col("upto") - F.col("n")).alias("before"), share.alias("share"))
    for by, longest in ((["key", "share"], "len"), (["key"], "longest")):
        members = Window.partitionBy(*by)
        rows = rows.withColumn("longest", F.max(longest).over(members)).withColumn("place", F.row_number().over(members.orderBy("conv_id"))).where("place = 1")
    return rows.drop("share", "place")


def trie(nodes: DataFrame) -> DataFrame:
    """Each node once: ``(key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens)``, from ``paths``."""
    mine = owned(nodes).groupBy("conv_id").agg(F.min("depth").alias("from"), F.min("before").alias("spent"), F.max((F.col("depth") == F.col("len")) & (F.col("longest") == F.col("depth"))).alias("leaf"))
    all_ = nodes.groupBy("conv_id").agg(F.sum("n").alias("total"), F.max("len").alias("end"))
    mine = all_.join(mine, "conv_id", "left").select(reshuffled("conv_id").alias("c"), F.coalesce("from", F.col("end") + 1).alias("from"), F.coalesce("spent", "total").alias("spent"), F.coalesce("leaf", F.lit(False)).alias("leaf"))
    member = checkpointed(nodes.join(mine, F.col("conv_id") == F.col("c")).select("conv_id", "depth", "len", "key", (F.col("upto") - F.col("n")).alias("before"), "from", "spent", "leaf"))
    # of what lies from here on, the conversation owns all after ``spent``; the rest is saved
    one = lambda flag: F.sum(F.when(flag, 1).otherwise(0)).cast("long")
    child = (F.col("from") <= F.col("depth") + 1) & (F.col("depth") < F.col("len"))
    sums = checkpointed(
        member.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), one(child).alias("n_children"), one(F.col("leaf")).alias("n_leaves"), F.sum(F.greatest(F.col("spent") - F.col("before"), F.lit(0))).cast("long").alias("saved_tokens"))
    )
    # the parent of a node is its owner's too, but for the first node that the owner has
    joints = member.where(F.col("depth") == F.col("from") - 1).where(F.col("from") <= F.col("len")).select(F.col("key").alias("at"), F.col("conv_id").alias("c"), F.col("from").alias("d"))
    parents = joints.join(sums.select(F.col("key").alias("at"), F.col("conv_id").alias("parent")), "at").select("c", "d", "parent")
    out = sums.join(parents, (F.col("conv_id") == F.col("c")) & (F.col("depth") == F.col("d")), "left")
    parent = F.coalesce("parent", F.when(F.col("depth") > 0, F.col("conv_id")))
    return out.select("key", "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")


def ends(nodes: DataFrame) -> DataFrame:
    """``(key, ends_sha256)`` of the nodes at which conversations end: the hash of their ids, ascending, joined by commas.

    Ids are joined in pieces of at most ``2 ** PIECE_BITS``; a task hashes a node's pieces one after
    the other, so it holds one piece at a time, however many conversations end at the node.
    """
    last = nodes.where(F.col("depth") == F.col("len")).select("key", "conv_id", F.shiftright("conv_id", PIECE_BITS).alias("piece"))
    ids = F.concat_ws(",", F.transform(F.sort_array(F.collect_set("conv_id")), lambda c: c.cast("string")))
    pieces = last.groupBy("key", "piece").agg(ids.alias("ids")).repartition("key").sortWithinPartitions("key", "piece")

    def digest(batches):
        key, state = None, None
        for batch in batches:
            keys, values = [], []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != key:
                    if state is not None:
                        keys.append(key)
                        values.append(state.hexdigest())
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.string())], ["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])

    return pieces.mapInArrow(digest, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of ``turns(conv_id, turn, role, text)`` with its ends: ``(conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256)``, a row a node. ``(conv_id, depth)`` names a node: its owner and its place on that one's path.

    Null roles and texts are empty. A null turn comes first; turns of equal number, repeated rows among
    them, all count, by the SHA-256 of role and text. Rows without conv_id belong to no conversation. An empty table has
    no node. Other columns are not looked at.
    """
    nodes = paths(turns.select("conv_id", "turn", "role", "text"))
    out = trie(nodes).join(ends(nodes).withColumnRenamed("key", "at"), F.col("key") == F.col("at"), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def last_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, role, text)``: the last turn of each node but the root."""
    nodes = paths(turns.select("conv_id", "turn", "role", "text"))
    said = turns.select(turn_digest().alias("d"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]).dropDuplicates(["d"])
    own = nodes.join(owned(nodes).select(F.col("conv_id").alias("c"), F.col("depth").alias("k")), (F.col("conv_id") == F.col("c")) & (F.col("depth") == F.col("k")))
    return own.join(said, F.col("dig") == F.col("d")).select("conv_id", "depth", "role", "text")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


_SQL_BIT = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
SQL_OP11 = f"""
WITH RECURSIVE crc(c, s, k, r) AS (
       SELECT conv_id, CAST(conv_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
       UNION ALL
       SELECT c, s, k + 1, {_SQL_BIT} FROM (SELECT c, s, k, CASE WHEN k % 8 = 0 THEN xor(r, CAST(ascii(substr(s, k // 8 + 1, 1)) AS BIGINT)) ELSE r END AS x FROM crc WHERE k < 8 * length(s))),
     t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
     h AS (SELECT c, c - c % {GROUP} AS g, xor(r, 4294967295) % {OPENING} AS h FROM crc WHERE k = 8 * length(s)),
     u AS (SELECT h.c, 0 AS part, pos, role, text FROM h JOIN t ON t.c = g AND pos < h UNION ALL SELECT h.c, 1, pos, role, text FROM h JOIN t ON t.c = h.c AND pos >= h),
     p AS (SELECT h.c, coalesce(list({{'role': role, 'text': text}} ORDER BY part, pos) FILTER (pos IS NOT NULL), []) AS path FROM h LEFT JOIN u USING (c) GROUP BY h.c),
     m AS (SELECT c, len(path) AS l, d, path[1:d] AS key FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM p)),
     n AS (SELECT key, d, min(c) AS c, count(*) AS n, max(l) AS longest, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (l = d), '') AS ends FROM m GROUP BY key, d),
     s AS (SELECT key[1:i] AS key, CAST(sum((n - 1) * CASE WHEN d = 0 THEN 0 ELSE length(key[d].text) END) AS BIGINT) AS saved, count(*) FILTER (longest = d) AS leaves, count(*) FILTER (d = i + 1) AS children
           FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM n) GROUP BY ALL)
SELECT n.c AS conv_id, n.d AS depth, q.c AS parent_conv_id, n.n AS n_convs, children AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN s ON s.key = n.key LEFT JOIN n q ON q.d = n.d - 1 AND q.key = n.key[1:n.d - 1]
"""
