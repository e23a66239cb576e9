"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source gets a target size; ``target / source size`` is the number of
copies that each of its documents should have on average. The whole part is
given to every document. The fractional part is rounded by pivotal steps: two
documents meet, one hands weighted mass to the other, in a direction drawn so
that every expectation holds, until one of them is 0 or 1; the other goes on
to meet the next. Mass is moved in units of size, so the sum of taken sizes of
a source does not change in any step but the very last one.

The steps form a reduction tree: documents of a source are dealt by hash to
small groups; each group settles all but one document, and those residuals are
dealt to groups of the next level, until a source has one left. A hot source
just has more groups, so no task holds a source. Documents meet others of
their size class, the largest first. What is left over in the end is rounded to
the nearer side; that is the only error of a source's sum. It is made smaller
where turning one other document of the last group, the one that fits best,
makes up for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, every, fresh, table, word_count

#: Documents that meet in one group, on average.
FAN_IN = 48
#: Up to so many sources the table of targets is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000
_TINY = 1e-9


def source_targets(sizes: DataFrame, source: str, size: str, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_docs, source_size, target)``: targets by weight, none above ``most`` times its source's size.

    Sources are ordered by code point, null last, and take ``weights`` in turn.
    The excess of capped sources is shared by weight among the rest until none
    is above its cap, which is one level for all uncapped sources.
    """
    by = sizes.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("source_docs"), F.sum(size).alias("source_size"))
    # One row a source from here on; the windows below order sources, never documents.
    at = F.expr("row_number() OVER (ORDER BY source ASC NULLS LAST) - 1")
    weighed = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int")))
    return (
        weighed.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.least(F.expr(f"{share:.17g}D * sum(source_size) OVER ()"), F.expr("sum(cap) OVER ()")))
        .withColumn("capped", F.expr("sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
        .withColumn("open", F.expr("sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"))
        .withColumn("level", (F.col("total") - F.coalesce(F.col("capped"), F.lit(0.0))) / F.col("open"))
        .withColumn("level", F.expr("min(CASE WHEN level <= ratio THEN struct(ratio, level) END) OVER ()"))
        .select("source", "source_docs", "source_size", F.least(F.col("weight") * F.coalesce(F.col("level.level"), F.lit(float("inf"))), F.col("cap")).alias("target"))
    )


def _uniform(*cols: Column) -> Column:
    """Deterministic draw from [0, 1) by the hash of ``cols``."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def _meet(state: Column, item: Column, seed: int) -> Column:
    """One pivotal step: the document that waits in ``state.left`` meets ``item``."""
    a, b = state["left"], item
    # sizes of at least 1 keep empty documents in the game
    wa, wb = F.greatest(a["size"], F.lit(1)).cast("double"), F.greatest(b["size"], F.lit(1)).cast("double")
    up = F.least((1 - a["p"]) * wa, b["p"] * wb)  # most mass that a can take from b
    down = F.least(a["p"] * wa, (1 - b["p"]) * wb)
    rise = _uniform(F.lit(seed), a["key"], b["key"]) * (up + down) < down
    move = F.when(rise, up).otherwise(-down)
    pa, pb = a["p"] + move / wa, b["p"] - move / wb
    done = lambda p: (p < _TINY) | (p > 1 - _TINY)
    moved = lambda x, p: F.struct(x["key"].alias("key"), x["size"].alias("size"), p.alias("p"))
    settled = lambda x, p: F.struct(x["key"].alias("key"), x["size"].alias("size"), F.round(p).cast("int").alias("extra"))
    na, nb = moved(a, pa), moved(b, pb)
    # a document that has become integral is settled; if both have, b waits with its 0 or 1 and changes nothing later
    return F.struct(
        F.when(done(pa), nb).otherwise(na).alias("left"),
        F.concat(state["settled"], F.array(F.when(done(pa), settled(a, pa)).otherwise(settled(b, pb)))).alias("settled"),
    )


def _fold(dealt: DataFrame, by: list[str], seed: int) -> DataFrame:
    """For each group of ``dealt``: ``left``, the one document still open, and ``settled``; larger documents meet first."""
    grouped = dealt.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("size", "key", "p")), asc=False).alias("items"))
    first = F.element_at("items", 1)
    start = F.struct(
        F.struct(first["key"].alias("key"), first["size"].alias("size"), first["p"].alias("p")).alias("left"),
        F.filter(F.transform("items", lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size"), F.lit(0).alias("extra"))), lambda x: F.lit(False)).alias("settled"),
    )
    rest = F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0)))
    return grouped.select(*by, F.aggregate(rest, start, lambda s, x: _meet(s, x, seed)).alias("s")).select(*by, "s.left", "s.settled")


def _evened(left: Column, settled: Column) -> Column:
    """All documents of a stratum's last group with their 0 or 1: the one left over on its nearer side, and one other turned if that helps."""
    extra = F.round(left["p"]).cast("int")
    over = (extra - left["p"]) * left["size"]
    turned = lambda x: over + F.when(x["extra"] == 1, -x["size"]).otherwise(x["size"])
    best = F.array_min(F.transform(settled, lambda x: F.struct(F.abs(turned(x)).alias("off"), F.xxhash64(x["key"]).alias("h"))))
    helps = lambda x: F.coalesce((best["off"] < F.abs(over)) & (F.abs(turned(x)) == best["off"]) & (F.xxhash64(x["key"]) == best["h"]), F.lit(False))
    rest = F.transform(settled, lambda x: F.struct(x["key"].alias("key"), F.when(helps(x), 1 - x["extra"]).otherwise(x["extra"]).alias("extra")))
    return F.concat(rest, F.array(F.struct(left["key"].alias("key"), extra.alias("extra"))))


def pivotal(items: DataFrame, seed: int = 0, fan_in: int = FAN_IN) -> DataFrame:
    """``(key, extra)`` from ``items(stratum, size_class, class_rows, key, size, p)``: 0 or 1 for each key with expectation ``p``.

    ``class_rows`` is the number of items of the stratum and size class; ``key``
    has no repeats; ``p`` is in [0, 1]. Within a stratum the sum of ``size * extra``
    differs from that of ``size * p`` by half the size of the last document at most.
    That document, and the one that makes up for it, are off their expectation.
    Each level of the tree leaves one of about ``fan_in`` documents of a size
    class open. Once no class of a stratum has more than ``fan_in`` open ones, all
    classes of the stratum meet, from the largest documents to the smallest.
    """
    items = items.select("stratum", "size_class", "class_rows", "key", F.col("size").cast("long").alias("size"), F.col("p").cast("double").alias("p"))
    largest = items.agg(F.max("class_rows")).first()[0] or 0
    parts, level = [], 0
    while largest > fan_in:
        groups = F.ceil(F.col("class_rows") / fan_in).cast("long")
        dealt = items.where(f"class_rows > {fan_in}").withColumn("groups", groups)
        dealt = dealt.withColumn("g", F.pmod(F.xxhash64(F.lit(seed + 7919 * (level + 1)), "key"), F.col("groups")))
        folded = checkpointed(_fold(dealt, ["stratum", "size_class", "groups", "g"], seed + level))
        parts.append(folded.select(F.explode("settled").alias("x")).select("x.key", "x.extra"))
        open_ = folded.select("stratum", "size_class", F.col("groups").alias("class_rows"), "left.key", "left.size", "left.p")
        items = items.where(f"class_rows <= {fan_in}").unionByName(open_)
        largest, level = -(-largest // fan_in), level + 1
    folded = checkpointed(_fold(items, ["stratum"], seed + level))
    parts.append(folded.select(F.explode(_evened(F.col("left"), F.col("settled"))).alias("x")).select("x.key", "x.extra"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def mix(docs: DataFrame, key: list[str], source: str, size: str, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """Columns ``key``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` for every row of ``docs``.

    Null sources form a source of their own; null or empty texts have size 0 and
    rows that agree in ``key``, source and size share one decision. A source
    whose documents are all empty has the target 0. An empty table gives an
    empty result. Columns that ``docs`` has besides are not looked at.
    """
    rows = docs.select(*[F.col(k) for k in key], F.col(source).alias("source_"), F.col(size).cast("long").alias("size"))
    rows = checkpointed(rows)  # ids and sizes; the texts are read once
    targets = source_targets(rows, "source_", "size", weights, share, most)
    targets = checkpointed(targets)
    small = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    sided = F.broadcast(targets) if small else targets
    sized = rows.join(sided, rows["source_"].eqNullSafe(targets["source"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.least(F.floor(rate + _TINY), F.lit(int(most)))
    sized = sized.withColumn("whole", whole.cast("int")).withColumn("p", F.greatest(rate - whole, F.lit(0.0)))
    same = F.struct(*[F.col(k) for k in key], F.col("size"), F.col("source_"))
    open_ = sized.where(f"p > {_TINY}").groupBy(F.col("source").alias("stratum"), same.alias("key"), "size", "p").agg(F.count(F.lit(1)).alias("n"))
    # rows that repeat weigh as often as they stand
    open_ = open_.select("stratum", "key", (F.col("size") * F.col("n")).alias("size"), "p").withColumn("size_class", F.floor(F.log2(F.col("size") + 1)).cast("int"))
    open_ = checkpointed(open_)
    counts = open_.groupBy(F.col("stratum").alias("cs"), F.col("size_class").alias("cc")).agg(F.count(F.lit(1)).alias("class_rows"))
    counts = F.broadcast(counts) if small else counts  # some 20 classes a source
    items = open_.join(counts, open_["stratum"].eqNullSafe(counts["cs"]) & (open_["size_class"] == counts["cc"]))
    drawn = pivotal(items, seed)
    drawn = drawn.select(*[F.col(f"key.{k}").alias(f"k_{i}") for i, k in enumerate(key)], F.col("key.size").alias("k_size"), F.col("key.source_").alias("k_source"), "extra")
    on = [sized[k].eqNullSafe(drawn[f"k_{i}"]) for i, k in enumerate(key)] + [sized["size"] == drawn["k_size"], sized["source_"].eqNullSafe(drawn["k_source"])]
    joined = sized.join(drawn, on, "left")
    copies = F.col("whole") + F.coalesce(F.col("extra"), F.lit(0))
    return joined.select(*[sized[k] for k in key], "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``."""
    key, size, copies, k, c = fresh(docs, "mix_key", "mix_size", "mix_copies", "mix_k", "mix_c")
    marked = docs.withColumn(key, F.struct(F.col("doc_id"), F.xxhash64("text"))).withColumn(size, word_count("text"))
    plan = mix(marked, [key], "source", size, seed=seed).where("copies > 0").groupBy(F.col(key).alias(k)).agg(F.max("copies").alias(c))
    joined = marked.join(plan, marked[key].eqNullSafe(plan[k]))
    return joined.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(c)))).select(*every(docs))


def op6_mixture(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"))
    return mix(docs, ["doc_id"], "source", "size").select("doc_id", "size", "source_size", "target", "taken")
