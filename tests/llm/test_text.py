"""Near-duplicates, repeated strings, quality and packing: brute force and edge cases."""

import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tensorloom.llm import bytesets, common, minhash, packing, quality, suffixes, tokens
from tests.llm.test_native import wide

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def sets_of(docs, n):
    out = defaultdict(list)
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        out[d].append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute_components(docs, n, percent):
    sets = sets_of([x for x in docs if x[0] is not None], n)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def family(rng, base, copies, edits):
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates_brute_force(spark, n, percent):
    rng = random.Random(n)
    texts = []
    for size in (60, 200, 90):
        base = [f"w{rng.randrange(400)}" for _ in range(size)]
        texts += family(rng, base, 45, size // 20)
        texts += [" ".join(base)] * 5
    texts += [None, "", " \t\n", "One two", "one TWO", "one", "é É", "É é"]
    rng.shuffle(texts)
    docs = list(enumerate(texts)) + [(5, texts[9]), (7, texts[7]), (None, texts[3]), (None, None)]
    want = brute_components(docs, n, percent)
    rows = minhash.near_duplicates(docs_of(spark, docs), n, percent).collect()
    assert len(rows) == len(docs)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]])
            assert r["n_shingles"] in {len(s) for s in sets_of(docs, n)[r["doc_id"]]}


@pytest.mark.parametrize("large", [1, 16])
def test_second_look_finds_links_that_miss_the_hub(spark, monkeypatch, large):
    """A chain whose ends are not alike, in blocks of a few members."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "LARGE_BLOCKS", large)
    rng = random.Random(1)
    w = [f"w{i}" for i in range(120)]
    docs = []
    for k in range(30):
        docs.append((k * 7 % 31, " ".join(w)))
        w[4 * k % 120] = f"x{rng.randrange(10**6)}"
    rows = minhash.near_duplicates(docs_of(spark, docs), 3, 85).collect()
    want = brute_components(docs, 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in rows} == want


def test_second_look_by_rare_shingles(spark, monkeypatch):
    """Pages of one template with texts of their own, some of them copied with small edits: links that miss the hub are found,
    and pages that share the template alone do not meet."""
    monkeypatch.setattr(minhash, "BLOCK", 6)
    monkeypatch.setattr(minhash, "LARGE_BLOCKS", 1)
    head = [f"t{i}" for i in range(60)]
    docs = []
    for k in range(60):
        own = [f"p{k // 3}x{i}" for i in range(40)]
        own[7 + k % 3] = f"e{k}"
        docs.append((k * 17 % 61, " ".join(head + own)))
    rows = minhash.near_duplicates(docs_of(spark, docs), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_components(docs, 3, 85)
    text = docs_of(spark, docs).select("doc_id", "text")
    members = text.select(F.lit(1).alias("key"), F.col("doc_id").alias("rep"), F.lit(98).alias("n"), F.col("doc_id").alias("label"), F.lit(10).alias("blocks"))
    met = minhash._rare(members, text, 3, 85)
    assert met.groupBy("key").count().agg(F.max("count")).first()[0] <= 3, "only copies meet"
    got = minhash._meet(minhash._undecided(met), text, 3, 85).collect()
    found = {(min(a, b), max(a, b)) for a, b in got}
    assert len({x for p in found for x in p}) == 60


def test_keep_one_edges(spark):
    base = "a b c d e f g h i j k l"
    df = wide(spark, [(1, base, "s"), (2, base, None), (None, base, "s"), (3, None, "s"), (4, "", None), (5, base + " m" * 30_000, "s")])
    out = minhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "3", "4", "5", "None"]
    assert minhash.keep_one(df.where("false")).count() == 0


def test_checkpoints_are_deleted(spark):
    with common.watched() as made:
        common.components(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")).collect()
    files = [d._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get() for d in made]
    path = spark._jvm.org.apache.hadoop.fs.Path
    there = [path(f).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(f)) for f in files]
    assert len(files) > 2 and there == [False] * (len(files) - 1) + [True], "only the last one is still read"
    common.discard(*made)
    common.discard(*made)


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 101), (103, 101), (200, 200)] + [(500, k) for k in range(501, 530)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 103: 100} | {k: 500 for k in range(501, 530)}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    errors = []
    for k in range(40):
        a, b = np.unique(pool[: 1000 + 10 * k]), np.unique(pool[500:1600])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        pool = rng.permutation(pool)
        errors.append((minhash.signature(a) == minhash.signature(b)).mean() - true)
    assert abs(np.mean(errors)) < 0.03


def removed_bytes(docs, length):
    """Kept bytes of each row by holding every string's smallest id."""
    least = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - length + 1) if d is not None else ():
            s = b[i : i + length]
            least[s] = min(least.get(s, d), d)
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1) if d is not None else ():
            if least[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        yield d, len(b), bytes(x for x, g in zip(b, gone) if not g), [m.span() for m in re.finditer(b"\1+", bytes(gone))]


@pytest.mark.parametrize("length,hot,fan_in", [(8, 20_000, 2048), (20, 2, 3), (50, 20_000, 2048), (50, 2, 1), (50, 0, 2048)])
def test_repeats_brute_force(spark, length, hot, fan_in, monkeypatch):
    """Also with hot minimizers, whose strings meet in lots of chunks first, and with partitions of a few bytes."""
    monkeypatch.setattr(suffixes, "HOT_UNITS", hot)
    monkeypatch.setattr(suffixes, "FAN_IN", fan_in)
    monkeypatch.setattr(suffixes, "LOTS_AT_ONCE", 4 if fan_in < 4 else 64)
    monkeypatch.setattr(suffixes, "PARTITION_BYTES", 700 if fan_in == 3 else 64 << 20)
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 600)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 2000)
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 9)))
    shared = ["".join(word() for _ in range(20)) for _ in range(4)]
    docs = []
    for i in range(60):
        parts = [rng.choice(shared)[rng.randrange(20) :] if rng.random() < 0.4 else "".join(word() for _ in range(rng.randrange(25))) for _ in range(3)]
        docs.append((rng.randrange(40), "".join(parts)))
    docs += [(None, shared[0]), (3, shared[1]), (4, shared[1]), (5, None), (6, ""), (50, "a" * 700), (51, "a" * 300), (52, "ab" * 200), (53, shared[2] * 2)]
    df = docs_of(spark, docs).repartition(3)
    key = lambda x: (str(x[0]), x[1], x[2], x[3])
    rows = [(r["doc_id"], r["n_bytes"], bytes(r["kept"]), [(s["begin"], s["end"]) for s in r["spans"]]) for r in suffixes.remove_repeats(df, length).collect()]
    assert sorted(rows, key=key) == sorted(removed_bytes(docs, length), key=key)


def test_repeats_edges(spark):
    df = wide(spark, [(1, "x" * 200_000, "s"), (2, "y" * 49 + "x" * 50, None), (None, None, None)])
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in suffixes.remove_repeats(df).collect()}
    assert got == {1: [], 2: [(49, 99)], None: []}
    assert suffixes.remove_repeats(df.where("false")).count() == 0


def test_interval_expansion_is_the_common_prefix():
    rng = np.random.default_rng(4)
    pieces = [rng.integers(1, 4, rng.integers(9, 60)).astype(np.uint8) for _ in range(40)]
    pieces += [pieces[0][3:40], pieces[1], np.repeat(np.uint8(2), 50)]
    text = np.concatenate([np.append(p, 0) for p in pieces]).astype(np.uint8)
    depth = 12
    order, bwt, words = suffixes.transform(text, depth)
    stop = np.concatenate([np.full(len(p) + 1, e) for p, e in zip(pieces, np.cumsum([len(p) + 1 for p in pieces]) - 1)])
    prefix = suffixes.expand(bwt, words, depth)
    suffix = lambda i: bytes(text[i : i + depth])
    assert [suffix(i) for i in order] == sorted(suffix(i) for i in range(len(text)))
    for k in range(1, len(text)):
        a, b = order[k - 1], order[k]
        if min(stop[a] - a, stop[b] - b) >= depth:
            same = next((x for x in range(depth) if text[a + x] != text[b + x]), depth)
            assert prefix[k] == same


def labelled(spark, n):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(n):
        good = rng.random() < 0.7
        w = ["".join(rng.choice("aeioutrnsl") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 120))]
        rows.append((i, " ".join(w if good else [x.upper() + "!!" for x in w])))
        marks.append((i, int(good), 0))
    return docs_of(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), dict((i, q) for i, q, _ in marks)


def test_quality(spark):
    docs, labels, truth = labelled(spark, 400)
    model = quality.train(docs, labels)
    rows = quality.scored(docs, model).withColumn("h", quality.held_out("doc_id")).collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["h"]]
    assert len(held) > 80 and sum((r["score"] >= 0.5) == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    # a sparse dot product of the whole text
    row = rows[0]
    codes, at = np.frombuffer(row["text"].encode(), np.uint8), np.array([0, len(row["text"].encode())])
    ((where, value),) = quality.sparse(codes, at)
    assert 1 / (1 + np.exp(-(model.bias + model.weights[where].astype(float) @ value))) == pytest.approx(row["score"], rel=1e-5)
    # labels of held-out rows are not read
    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.train(docs, flipped).weights, model.weights)
    assert np.array_equal(quality.train(docs.repartition(7), labels.repartition(3)).weights, model.weights)


def plain_leader(rows, epochs, alpha, beta, l1, l2):
    """Follow-the-regularised-leader as published, one coordinate at a time: the weights after all rows."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_leader_against_the_published_updates():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(60):
        at = np.unique(rng.integers(0, 32, 6))
        rows.append((at, rng.random(len(at)), int(rng.random() < 0.5)))
    options = {"alpha": 0.7, "beta": 0.3, "l1": 0.05, "l2": 0.02}
    model = quality.fit(rows, bits=5, epochs=3, **options)
    want = plain_leader([({**dict(zip(at.tolist(), value.tolist())), 32: 1.0}, y) for at, value, y in rows], 3, **options)
    np.testing.assert_allclose(model.weights, [want.get(i, 0.0) for i in range(32)], rtol=1e-5, atol=1e-7)
    assert model.bias == pytest.approx(want[32]) and (model.weights == 0).any()


def test_quality_edges(spark):
    docs, labels, _ = labelled(spark, 60)
    model = quality.train(docs, labels)
    odd = wide(spark, [(1, None, None), (2, "", "s"), (None, "some words", "s"), (3, "long " * 40_000, "s")])
    rows = quality.scored(odd, model, "s2").collect()
    assert len(rows) == 4 and rows[0]["s2"] == rows[1]["s2"] and all(0 <= r["s2"] <= 1 for r in rows)
    assert quality.keep_quality(odd, labels).columns == odd.columns
    none = quality.train(docs, labels.where("false"))
    assert quality.scored(odd, none, "s2").first()["s2"] == 0.5
    holes = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0)], "doc_id long, quality int")
    assert quality.scored(odd.where("false"), quality.train(docs, holes), "s2").count() == 0


def brute_best_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters):
        fits = [b for b in bins if b["left"] >= size and s not in b["s"] and (c < 0 or c not in b["c"])]
        b = min(fits, key=lambda x: (x["left"], x["id"]), default=None)
        if b is None:
            b = {"id": len(bins), "left": capacity, "s": set(), "c": set()}
            bins.append(b)
        out.append((b["id"], capacity - b["left"]))
        b["left"] -= size
        b["s"].add(s)
        b["c"].add(c)
    return out


@pytest.mark.parametrize("walk", [1, 32])
def test_best_fit_brute_force(monkeypatch, walk):
    monkeypatch.setattr(packing, "WALK", walk)
    rng = random.Random(3)
    for _ in range(20):
        n = rng.randrange(1, 150)
        sizes = [rng.randrange(1, 101) for _ in range(n)]
        sources, clusters = [rng.randrange(4) for _ in range(n)], [rng.randrange(-1, 10) for _ in range(n)]
        assert packing.best_fit(sizes, sources, clusters, 100) == brute_best_fit(sizes, sources, clusters, 100)


def test_packing(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 250))), rng.choice(["a", "b", "c", None])) for i in range(300)]
    docs += [(1000 + i, docs[5][1].upper() + " ", s) for i, s in enumerate(["a", "b", "c"])] + [docs[6]] * 3 + [(None, "x y", "a"), (2000, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = packing.pack_documents(df, 100).collect()
    size = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    bins, pieces = defaultdict(list), defaultdict(list)
    by = {d: (s, " ".join((t or "").lower().split())) for d, t, s in docs}
    for r in rows:
        pieces[r["doc_id"]].append(r)
        if r["bin_id"] is None:
            assert r["size"] == 0
        else:
            bins[r["bin_id"]].append(r)
    for members in bins.values():
        members.sort(key=lambda r: r["bin_offset"])
        assert sum(r["size"] for r in members) <= 100
        assert all(b["bin_offset"] == a["bin_offset"] + a["size"] for a, b in zip(members, members[1:]))
        assert len({by[r["doc_id"]][0] for r in members}) == len(members) == len({by[r["doc_id"]][1] for r in members})
    for d, own in pieces.items():
        repeats = sum(x[0] == d for x in docs)
        covered = sorted((r["doc_offset"], r["size"]) for r in own)
        assert sum(n for _, n in covered) == size[d] * repeats
        assert {(a, min(100, size[d] - a)) for a in range(0, size[d], 100)} <= set(covered)
    assert packing.pack_documents(df.where("false"), 100).count() == 0
    some = df.where("doc_id < 20").dropDuplicates(["doc_id"])
    texts = {r["bin_id"]: r["text"] for r in packing.packed_texts(some, packing.pack_documents(some, 100)).collect()}
    assert sum(len(t.split()) for t in texts.values()) == sum(size[d] for d in range(20))


def test_rows_that_repeat_without_end(spark):
    """Equal rows fill no shard: they are counted and dealt in lots."""
    docs = spark.range(3000).select(F.lit(7).alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    packed = packing.pack(docs, F.lit(3), F.lit(1), 10, shard_docs=100)
    rows = packed.collect()
    assert len(rows) == 3000 == len({r["bin_id"] for r in rows}) and {r["size"] for r in rows} == {3}
    shards = defaultdict(int)
    for r in rows:
        shards[r["bin_id"] >> 32] += 1
    assert max(shards.values()) <= 600 and len(shards) > 10
    again = packing.pack(docs.repartition(5), F.lit(3), F.lit(1), 10, shard_docs=100).collect()
    assert sorted(r["bin_id"] for r in again) == sorted(r["bin_id"] for r in rows)


def test_packing_edges(spark):
    df = wide(spark, [(2**60 + 1, "a b", None), (None, "a b", None), (3, "w " * 10_000, "s")])
    rows = packing.pack_documents(df, 2048).collect()
    assert {r["doc_id"] for r in rows} == {2**60 + 1, None, 3} and sum(r["size"] for r in rows) == 10_004


def test_segment_tree_packing():
    rng = random.Random(6)
    for _ in range(20):
        sizes = [rng.randrange(1, 65) for _ in range(rng.randrange(1, 200))]
        left, want = [], []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fits = [k for k in range(len(left)) if left[k] >= sizes[i]]
            least = min((left[k] for k in fits), default=None)
            want.append(64 if least is None else least)
            if least is None:
                left.append(64 - sizes[i])
            else:
                left[next(k for k in fits if left[k] == least)] -= sizes[i]
        rows = tokens.best_fit_decreasing(sizes, 64)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        assert len(rows) == len(left) and sorted(64 - sum(sizes[i] for i in r) for r in rows) == sorted(left)


def test_tokens_round_trip(spark, tmp_path):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["the", "and", "naïve", "x1", "日本", "\n"]) for _ in range(rng.randrange(0, 300)))) for i in range(40)]
    docs += [(None, "no id"), (7, None), (8, ""), (9, docs[9][1]), (100, "<|endoftext|> " * 500)]
    df = docs_of(spark, docs).coalesce(2)
    packed = tokens.pack_tokens(df, length=64, window=700)
    tokens.write_packed(packed, str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p")).collect()
    assert len({r["row_id"] for r in rows}) == len(rows)
    ids = tokens.matrix([bytes(r["ids"]) for r in rows])
    places = tokens.matrix([bytes(r["positions"]) for r in rows])
    assert ids.shape == (len(rows), 64)
    parts = defaultdict(list)
    for r, row, at in zip(rows, ids, places):
        cu = r["cu_seqlens"]
        assert cu[0] == 0 and cu[-1] == r["n_ids"] <= 64 and (row[cu[-1] :] == tokens.PAD).all()
        for d, o, a, b in zip(r["doc_ids"], r["doc_offsets"], cu, cu[1:]):
            assert at[a:b].tolist() == list(range(b - a))
            parts[d].append((o, row[a:b].tolist()))
    encoding = tokens._encoding(open(tokens.VOCABULARY, "rb").read(), tokens.PATTERN)
    for d in {x[0] for x in docs}:
        want = sorted(((o, tuple(e[o : o + 64])) for x, t in docs if x == d for e in [encoding.encode_ordinary(t or "")] for o in range(0, len(e), 64)))
        assert sorted((o, tuple(p)) for o, p in parts[d]) == want
    assert encoding.decode([i for _, p in sorted(parts[100]) for i in p]) == docs[-1][1]
    assert tokens.pack_tokens(wide(spark, [(1, "a", "s")]).where("false")).count() == 0


def test_words_and_hashes():
    texts = ["Ab  cd\tab", "", "x", None, "é\x0bé ", "   "]
    import pyarrow as pa

    codes, at = bytesets.texts(pa.array(texts)[0:6])
    starts, ends, first = bytesets.words(codes, at)
    got = [[bytes(codes[a:b]).decode() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first, first[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    h = bytesets.spans_hash(bytesets.LOWER[codes], starts, ends)
    assert h[0] == h[2] and h[4] == h[5] and len(set(h.tolist())) == 4
    assert list(bytesets.chunks(np.array([0, 5, 5, 30, 31]), 10)) == [(0, 2), (2, 3), (3, 4)]


def test_pipeline(spark):
    """The stages one by one over a small table with every odd row, and the whole on the smallest one."""
    base = " ".join(f"w{i}" for i in range(40))
    odd = wide(spark, [(1, base, "a"), (2, base, "b"), (2, base, "b"), (None, None, None), (4, "", "a"), (5, "x\ny\nz", "a"), (6, "x\ny\nz\nv", "b"), (7, "w " * 5000, None)])
    docs = odd
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == odd.columns, name
        docs.collect()
        assert stage(spark, odd.where("false"), "/root/testdata/sf0.001").count() == 0, name
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and {"doc_id", "bin_id"} <= set(out.columns)


@pytest.mark.parametrize("blank", [" ", "\n", "\t ", "　", "\x1c"])
def test_tokens_of_long_blank_runs(blank):
    """Texts that the split pattern's engine still takes whole have the same ids in parts."""
    encoding = tokens._encoding(Path(tokens.VOCABULARY).read_bytes(), tokens.PATTERN)
    for text in (f"x{blank * 3000}y", f"{blank * 2000}", f"{blank * 1500}'s{blank * 1023}ab{blank}", f"don't {blank * 1024}7{blank * 1025}?!", ("word é" + blank * 3) * 3000):
        for cut in (1 << 20, 1000):
            tokens.CUT, before = cut, tokens.CUT
            try:
                assert tokens.token_ids(encoding, text).tolist() == encoding.encode_ordinary(text)
            finally:
                tokens.CUT = before
        assert tokens.token_ids(encoding, text, pattern=tokens.PATTERN + "|x").tolist() == encoding.encode_ordinary(text) or blank == "\x1c"


def test_no_text_stops_the_packing(spark):
    """Runs of a million blanks, letters, digits and signs, 20 MB of words, and bytes that are no text."""
    encoding = tokens._encoding(Path(tokens.VOCABULARY).read_bytes(), tokens.PATTERN)
    n = 1_000_000
    texts = ["x" + " " * n + "y", "\n" * n, "x" * n, "7" * n, "-" * n, "a" + "\t" * n + " b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = rows.unionByName(spark.range(1).selectExpr("100 AS doc_id", "repeat('the quick brown fox ', 1000000) AS text")).unionByName(spark.range(1).selectExpr("101 AS doc_id", "CAST(X'61FF62' AS STRING) AS text"))
    got: dict = {}
    for r in tokens.pack_tokens(rows).collect():
        row = np.frombuffer(r["ids"], "<i4")
        for d, at, a, b in zip(r["doc_ids"], r["doc_offsets"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            got.setdefault(d, {})[at] = row[a:b]
    ids = {d: np.concatenate([x[k] for k in sorted(x)]).tolist() for d, x in got.items()}
    piece = encoding._encode_single_piece
    assert ids[0] == piece("x") + piece(" " * (n - 1)) + piece(" y")
    assert ids[1] == piece("\n" * n) and ids[5] == piece("a") + piece("\t" * n) + piece(" b")
    assert [ids[k] for k in (2, 3, 4)] == [piece(t) for t in texts[2:5]]
    assert ids[100] == piece("the") + [piece(" quick")[0], piece(" brown")[0], piece(" fox")[0], piece(" the")[0]] * 999_999 + piece(" quick") + piece(" brown") + piece(" fox") + piece(" ")
    assert ids[101] == encoding.encode_ordinary("a�b")


def test_long_words_of_equal_polynomials(spark):
    """A word of the doubling sequence and its complement have one polynomial hash for every base; they are not copies."""
    a = "a"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = [(1, a), (2, b), (3, a.upper()), (4, f"{a} x y"), (5, f"{b} x y"), (6, a[:1024]), (7, b[:1024])]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(spark, docs), 3, 85).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}
