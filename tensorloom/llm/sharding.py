"""Sharding by extendible hashing, in DataFrame operations only.

A row's hash is read bit by bit. The directory starts as one bucket; only a
bucket above the byte limit splits, on the next bit, until every bucket fits.
A leaf is the shortest prefix of the hash whose rows fit the limit.

Splits are worked out in passes over the hashes and sizes alone, which are written once. A pass takes the
rows of the buckets that are still too large. Each bucket has bits of its own: those that all its rows share
are skipped, as they part nothing, and of the next ones it looks at as many as its bytes call for. So a pass leaves a
directory of a few entries for each leaf, whatever single keys weigh: an entry for every value that occurs of
a bucket's bits, with its leaf, or the bits at which a later pass goes on. A row finds its leaf by one equi-join a pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, every, fresh, table

#: Byte limit of a shard in the query.
LIMIT = 1 << 20
#: Bits that a pass looks at in a bucket at most.
PASS_BITS = 20
#: Bits of a row's hash: first those of the key, then those that part rows of equal key.
BITS, KEY_BITS = 60, 40
#: Directories up to so many entries are broadcast (some 60 bytes each); larger ones are joined by shuffle.
BROADCAST_ENTRIES = 100_000


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 of ``key`` as text, as a long; null hashes as the text ``null``."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def _leaf_of(sums: DataFrame, limit: int) -> DataFrame:
    """``sums(depth, prefix, bytes, n, low, high)`` with ``leaf``: the leaf that the bucket is, null if it has to split.

    A bucket of several rows that have one hash (``low`` and ``high`` are the least and largest one) is a leaf with all bits used.
    """
    leaf = lambda depth, prefix: F.struct(depth.alias("depth"), prefix.alias("prefix"), F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_rows"))
    fits = (F.col("bytes") <= limit) | (F.col("n") == 1)
    return sums.withColumn("leaf", F.when(fits, leaf(F.col("depth"), F.col("prefix"))).when(F.col("low") == F.col("high"), leaf(F.lit(BITS), F.col("low"))))


def directory(rows: DataFrame, limit: int) -> tuple[list[DataFrame], int, DataFrame | None]:
    """The directory of ``rows(bits, size)``: a table ``(at, entry, leaf, shared, next)`` for each pass, the number of all their
    entries, and the hashes of several rows that are too large with all bits used up, if there are any.

    An entry is a value of the first ``at`` bits that occurs. It has a leaf ``(depth, prefix, shard_bytes, shard_rows)``,
    or else the bits ``next`` at which the next pass has it: those that all its rows share, one for
    each doubling of the limit that its bytes make, and one more. The first table is the single bucket of all rows. A hash
    without rows has no entry; it would fall into an empty bucket. Rows with one hash stay a leaf
    whatever their size, and so does a single row above the limit.
    """
    totals = [F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("bits").alias("low"), F.max("bits").alias("high")]
    shared = f"{BITS} - length(bin(low ^ high))"  # of a bucket that splits, so low and high differ
    bits = f"least({PASS_BITS}, length(bin((bytes - 1) DIV {limit})) + 1)"
    opening = [F.expr(f"IF(leaf IS NULL, {shared}, NULL)").alias("shared"), F.expr(f"IF(leaf IS NULL, CAST(least({BITS}, {shared} + {bits}) AS INT), NULL)").alias("next")]
    rows, passes = rows.withColumn("at", F.lit(0)), []
    fine = _leaf_of(rows.agg(*totals).where("n > 0").selectExpr("0 AS at", "0L AS entry", "0 AS depth", "0L AS prefix", "*"), limit)
    while True:
        passes.append(checkpointed(fine.select("at", "entry", "leaf", *opening)))
        opened = passes[-1].where("next IS NOT NULL")
        if opened.isEmpty():
            break
        opened = opened.select(F.col("at").alias("was"), F.col("entry").alias("bucket"), "shared", "next")
        rows = rows.join(opened, (F.col("at") == F.col("was")) & (F.expr(f"shiftright(bits, {BITS} - at)") == F.col("bucket"))).select("bits", "size", F.col("next").alias("at"), "shared")
        sums = checkpointed(rows.groupBy("at", "shared", F.expr(f"shiftright(bits, {BITS} - at)").alias("entry")).agg(*totals))
        rows = rows.drop("shared")
        # every bucket between the one that splits and the entries: an entry's leaf is the first of these that is one
        between = sums.select("*", F.explode(F.expr("sequence(shared + 1, at)")).alias("depth")).withColumn("prefix", F.expr("shiftright(entry, at - depth)"))
        whole = between.groupBy("at", "depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        whole = _leaf_of(whole, limit).where("leaf IS NOT NULL").select("at", "depth", "prefix", "leaf")
        first = between.select("at", "entry", "depth", "prefix").join(whole, ["at", "depth", "prefix"]).groupBy("at", "entry").agg(F.min(F.struct("depth", "leaf"))["leaf"].alias("leaf"))
        fine = sums.join(first, ["at", "entry"], "left")
    full = [p.where(f"leaf.depth = {BITS} AND leaf.shard_bytes > {limit} AND leaf.shard_rows > 1").select("leaf.prefix") for p in passes]
    stuck = full[0]
    for more in full[1:]:
        stuck = stuck.unionByName(more)
    return passes, sum(p.count() for p in passes), None if stuck.isEmpty() else stuck


def _content(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed."""
    columns = [c for c, f in zip(every(docs), docs.schema.fields) if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(*columns)


def assign(docs: DataFrame, key: str, size: Column, limit: int = LIMIT) -> DataFrame:
    """``docs`` with ``shard_depth``, ``shard_prefix``, ``shard_bytes`` and ``shard_rows``; names that clash get underscores in front.

    Rows of equal key, even a third of the table, part by the hash of their other
    columns once the ``KEY_BITS`` bits of the key are used up, so the shard of a row
    depends on the table's rows alone. Only where rows that are equal in
    everything exceed the limit, they part by their place in the input; these rows
    are checkpointed first, so that a task that runs again cannot move them. A
    null size counts as 0. A single row above the limit is a shard of its own. An
    empty table gives an empty result.

    Rows are shuffled once at most, if the directory is too large to be broadcast; the
    leaves of the distinct hashes are then looked up without the rows.
    """
    bits, width, d, p, b, n = fresh(docs, "shard_bits", "shard_size", "shard_depth", "shard_prefix", "shard_bytes", "shard_rows")
    low = BITS - KEY_BITS
    own = lambda x: F.shiftleft(F.shiftright(x, low), low)  # noqa: E731  the key's bits
    marked = docs.withColumn(bits, own(hash_bits(F.col(key))) + F.pmod(_content(docs), F.lit(1 << low)))
    marked = marked.withColumn(width, F.coalesce(size, F.lit(0)).cast("long"))
    sizes = lambda rows: checkpointed(rows.select(F.col(bits).alias("bits"), F.col(width).alias("size")))  # noqa: E731  16 bytes a row
    passes, entries, stuck = directory(sizes(marked), limit)
    if stuck is not None:
        keys = checkpointed(stuck.select(F.shiftright("prefix", low).alias("stuck_key")).distinct())
        on = F.shiftright(F.col(bits), low) == F.col("stuck_key")
        place = F.pmod(F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(1 << low))
        heavy = checkpointed(marked.join(keys, on, "left_semi").withColumn(bits, own(F.col(bits)) + place))
        marked = marked.join(keys, on, "left_anti").unionByName(heavy)
        passes, entries, _ = directory(sizes(marked), limit)
    small = entries <= BROADCAST_ENTRIES
    found = marked if small else marked.select(bits).distinct()
    step, at = "0", []
    for k, entries in enumerate(passes):
        a, e, leaf, after = fresh(found, f"shard_at_{k}", f"shard_entry_{k}", f"shard_leaf_{k}", f"shard_next_{k}")
        entries = entries.select(F.col("at").alias(a), F.col("entry").alias(e), F.col("leaf").alias(leaf), F.col("next").alias(after))
        here = (F.expr(step) == F.col(a)) & (F.expr(f"shiftright({bits}, {BITS} - {step})") == F.col(e))
        found = found.join(F.broadcast(entries) if small else entries, here, "left").drop(a, e)
        step = after
        at.append(leaf)
    leaf = F.coalesce(*at)
    if not small:
        (same, one) = fresh(marked, "shard_same", "shard_leaf")
        found = marked.join(found.select(F.col(bits).alias(same), leaf.alias(one)), F.col(bits) == F.col(same))
        leaf = F.col(one)
    return found.select(*every(docs), leaf["depth"].alias(d), leaf["prefix"].alias(p), leaf["shard_bytes"].alias(b), leaf["shard_rows"].alias(n))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", limit: int = LIMIT) -> None:
    """Write one folder a shard under ``path``, each shard from one task."""
    sharded = assign(docs, key, F.octet_length("text"), limit)
    (shard,) = fresh(sharded, "shard")
    name = F.concat_ws("-", *[F.col(c) for c in sharded.columns[-4:-2]])
    sharded.withColumn(shard, name).repartition(shard).write.partitionBy(shard).parquet(path)


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = assign(docs, "doc_id", F.col("n_bytes"), LIMIT)
    return out.select("doc_id", "n_bytes", F.col("shard_depth").cast("int").alias("shard_depth"), "shard_prefix", "shard_bytes", "shard_rows")


SQL_OP10 = f"""
WITH d AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 10) AS BIGINT) AS bits
           FROM documents),
     p AS (SELECT d.*, depth, bits >> ({KEY_BITS} - depth) AS prefix FROM d, range(0, {KEY_BITS} + 1) t(depth)),
     s AS (SELECT *, sum(n_bytes) OVER (PARTITION BY depth, prefix) AS b, count(*) OVER (PARTITION BY depth, prefix) AS n FROM p),
     f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM s WHERE b <= {LIMIT} OR n = 1)
SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS shard_depth, prefix AS shard_prefix, CAST(b AS BIGINT) AS shard_bytes, n AS shard_rows
FROM f WHERE k = 1
"""
