"""Line deduplication, mixture and sharding: brute force and edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tensorloom.llm import common, linededup, mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "doc_id long, text string, lang string, source string, n_chars long, k string, d int, t int, lines string, `a.b` string, key int, size int, copies int, shard_bytes int, taken int"


def wide(spark, rows):
    """Documents with columns whose names the operators might use themselves; every column may be null."""
    return spark.createDataFrame([(d, t, None, s, None, "k", 1, 2, "l", "x", 3, 4, 5, 6, 7) for d, t, s in rows], CLASH)


def removed_lines(docs, window=3):
    """{(doc_id, text): kept text} by reading windows in order."""
    first, out = {}, {}
    for d, text in sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines) - window + 1):
            w = tuple(lines[i : i + window])
            if not any(x.strip(" ") for x in w):
                continue
            at = first.setdefault(w, (d, i))
            if at != (d, i):
                gone |= set(range(max(i, at[1] + window) if at[0] == d else i, i + window))
        out[d, text] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_dedup_brute_force(spark):
    rng = random.Random(5)
    docs = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    docs += [(100, "x\ny\nz\nx\ny\nz"), (101, "q\nq\nq\nq\nq\nq\nq"), (102, "\n\n\n\n"), (103, ""), (None, "n\nm\no"), (104, "n\nm\no\np")]
    want = removed_lines(docs)
    out = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), removed="n")
    got = {(r["doc_id"]): (r["text"], r["n"]) for r in out.collect()}
    for (d, text), kept in want.items():
        assert got[d][0] == kept
        assert got[d][1] == len(text.split("\n")) - (len(kept.split("\n")) if kept else kept.count("\n") + bool(kept) if got[d][1] == len(text.split("\n")) else 1)
    assert got[104][0] == "p" and got[101][0] == "q\nq\nq"


def test_line_dedup_edges(spark):
    long = "\n".join(f"line {i % 5000}" for i in range(12000))
    rows = [(1, "a\nb\nc", "s"), (1, "a\nb\nc", "s"), (2, "a\nb\nc\nd", None), (None, None, None), (3, None, "s"), (4, long, "s")]
    out = linededup.dedup_lines(wide(spark, rows))
    assert out.columns == wide(spark, rows).columns
    got = defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append(r["text"])
    assert got[1] == ["a\nb\nc"] * 2 and got[2] == ["d"] and got[None] == [None] and got[3] == [None]
    assert got[4][0] == "\n".join(f"line {i}" for i in range(5000))
    assert linededup.dedup_lines(wide(spark, rows).where("false")).count() == 0


def targets(sizes):
    """Capped shares by weight, resharing the excess until no source is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_mixture(spark, seed):
    rng = random.Random(seed)
    sources = ["b", "a", None, "Z", "ä", "hot"]
    docs = [(i, " ".join(["w"] * int(rng.lognormvariate(4, 1.2))), "hot" if rng.random() < 0.4 else rng.choice(sources)) for i in range(1500)]
    docs += [(2000, "", "a"), (2001, None, "b"), (2002, "\t \n", "empty")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    df = df.withColumn("n", F.expr(r"size(filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), w -> w != ''))"))
    out = mixing.mix(df, ["doc_id"], "source", "n", seed=seed)
    rows = out.collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(5), ["doc_id"], "source", "n", seed=seed).collect()}
    assert {r["doc_id"]: r["taken"] for r in rows} == again and len(rows) == len(docs)
    source = {d: s for d, _, s in docs}
    words = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    sizes = Counter()
    for d, s in source.items():
        sizes[s] += words[d]
    want, taken = targets(sizes), Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.02 * sizes[s] + 60, s


def test_pivotal_expectation(spark):
    """Averaged over seeds, each document is taken as often as its fraction says."""
    n, seeds = 150, 40
    items = spark.range(n).select(F.lit("s").alias("stratum"), F.col("id").alias("key"), (F.col("id") % 7 + 1).alias("size"), F.lit(0.3).alias("p"))
    items = items.withColumn("size_class", F.floor(F.log2(F.col("size") + 1)).cast("int"))
    counts = items.groupBy("size_class").count().withColumnRenamed("count", "class_rows")
    items = items.join(counts, "size_class").cache()
    total = Counter()
    for seed in range(seeds):
        rows = mixing.pivotal(items, seed, fan_in=16).collect()
        assert len(rows) == n == len({r["key"] for r in rows})
        assert abs(sum(r["extra"] * (r["key"] % 7 + 1) for r in rows) - 0.3 * sum(i % 7 + 1 for i in range(n))) <= 7
        total.update({r["key"]: r["extra"] for r in rows})
    mean = sum(total.values()) / (n * seeds)
    assert abs(mean - 0.3) < 0.02
    assert max(total.values()) / seeds < 0.3 + 5 * math.sqrt(0.21 / seeds)


def test_mixture_edges(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", None), (2, None, "x"), (3, "word " * 50_000, "y"), (4, "", None)]
    df = wide(spark, rows)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert all(n <= 2 * rows.count(next(x for x in rows if x[:2] == k)) for k, n in got.items())
    assert mixing.mixed_documents(df.where("false")).count() == 0


def test_sharding(spark):
    rng = random.Random(2)
    docs = [(i, "x" * rng.randrange(0, 400)) for i in range(800)] + [(9000, "y" * 9000)] + [(7, "z" * 50)] * 700 + [(None, None)] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = sharding.assign(df, "doc_id", F.octet_length("text"), 4000)
    rows = out.collect()
    assert len(rows) == len(docs)
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard_depth"], r["shard_prefix"]].append(r)
    depths = {len(f"{d}") and d for d, _ in shards}
    assert len(depths) > 2, "only oversized buckets split"
    for (depth, prefix), members in shards.items():
        total = sum(len(r["text"] or "") for r in members)
        assert total == members[0]["shard_bytes"] and len(members) == members[0]["shard_rows"]
        assert total <= 4000 or len(members) == 1
        for other in range(depth):  # no shard lies within another
            assert (other, prefix >> (depth - other)) not in shards
    assert len({k for k, m in shards.items() if any(r["doc_id"] == 7 for r in m)}) > 5, "equal rows part"
    whole = sharding.assign(df, "doc_id", F.octet_length("text"), 10**9).select("shard_depth").distinct().collect()
    assert [r[0] for r in whole] == [0]


def test_sharding_without_broadcast(spark, monkeypatch):
    """The same shards from a directory that is joined by shuffle, and from rows that come out of a shuffle."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "x" * rng.randrange(0, 400)) for i in range(2000)], "doc_id long, text string")
    want = sorted(map(tuple, sharding.assign(docs, "doc_id", F.octet_length("text"), 3000).collect()), key=str)
    monkeypatch.setattr(sharding, "BROADCAST_ENTRIES", 0)
    monkeypatch.setattr(sharding, "PASS_BITS", 2)
    for moved in (docs, docs.repartition(7)):
        out = sharding.assign(moved, "doc_id", F.octet_length("text"), 3000)
        assert sorted(map(tuple, out.collect()), key=str) == want
    assert len({r[3] for r in want}) > 3


def test_assignment_shuffles_no_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = sharding.assign(docs, "doc_id", F.octet_length("text"), 10_000)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan and "Generate" not in plan.split("BroadcastExchange")[0]


def test_directory_of_a_hot_key(spark):
    """Most buckets are a little too large and one key weighs as much as a thousand of them: entries stay a few for each leaf."""
    bits = sharding.hash_bits(F.col("id"))
    usual = spark.range(200_000).select(bits.alias("bits"), F.lit(25_000).cast("long").alias("size"))
    hot = spark.range(1000).select(F.expr(f"(123L << {sharding.BITS - 40}) | (id * 1000)").alias("bits"), F.lit(1 << 20).cast("long").alias("size"))
    heavy = spark.range(300).select(sharding.hash_bits(F.col("id") % 3 + 10**9).alias("bits"), F.lit(1 << 19).cast("long").alias("size"))
    passes, entries, stuck = sharding.directory(usual.unionByName(hot).unionByName(heavy), 1 << 20)
    leaves = sum(p.select("leaf.*").where("depth IS NOT NULL").distinct().count() for p in passes)
    assert 4000 < leaves <= entries < 6 * leaves and len(passes) < 8
    assert stuck.count() == 3, "rows of one hash"
    for p in passes:
        assert p.where("(leaf IS NULL) = (next IS NULL)").isEmpty()


def test_sharding_edges(spark, tmp_path):
    df = wide(spark, [(1, "abc", "s"), (None, None, None), (2, "", "s"), (3, "x" * 100_000, "s")])
    out = sharding.assign(df, "doc_id", F.octet_length("text"), 50)
    assert out.columns[: len(df.columns)] == df.columns and out.columns[-2] == "_shard_bytes" and out.count() == 4
    assert sharding.assign(df.where("false"), "doc_id", F.octet_length("text"), 50).count() == 0
    sharding.write_shards(df.drop("a.b"), str(tmp_path / "s"), limit=50)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4


def test_native_plans(spark):
    """No Python, cross joins or caches on the main path."""
    docs = "/root/testdata/sf0.001"
    for query in (linededup.op1_line_dedup, mixing.op6_mixture, sharding.op10_sharding):
        plan = query(spark, docs)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop|InMemoryTableScan", plan), query.__name__


@pytest.fixture
def splitting(spark):
    """Adaptive execution as on large data: no broadcasts, and partitions above 64 KB and twice the median are split."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_windows_are_split(spark, splitting):
    passage = F.lit("\n".join(f"line {k} of a passage" for k in range(8)))
    docs = spark.range(0, 30_000, 1, 16).select(F.col("id").alias("doc_id"), F.concat(passage, F.lit("\nown "), F.col("id"))).toDF("doc_id", "text")
    out = linededup.repeated_lines(docs)
    assert out.toArrow().num_rows == 29_999
    assert "SortMergeJoin(skew=true)" in final_plan(out)


def test_hot_nodes_are_split(spark, splitting, monkeypatch):
    plans, plain = [], common.checkpointed

    def noted(df):
        out = plain(df)
        plans.append(final_plan(df))
        return out

    monkeypatch.setattr(common, "checkpointed", noted)
    star = spark.range(0, 200_000, 1, 16).select(F.when(F.col("id") < 150_000, F.lit(-5)).otherwise(F.col("id")).alias("a"), F.shiftrightunsigned(F.xxhash64("id"), 2).alias("b"))
    got = {r[0]: r[1] for r in common.components(star).groupBy("component").count().orderBy(F.desc("count")).limit(1).collect()}
    assert got == {-5: 150_000}  # the smallest node itself has no row
    assert any("SortMergeJoin(skew=true)" in p for p in plans)
