"""Vector search against brute force, and containers read back box by box."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.llm import ann, media
from tests.llm.test_native import wide


def neighbours(rows, k):
    """Exact answers: {query: [(id, score)]}, the best score of an id that repeats."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q in {i for i, _ in good if i % 20 == 0}:
        best = {}
        for a, x in good:
            if a == q:
                for b, y in good:
                    if b != q:
                        best[b] = max(best.get(b, -np.inf), float(x @ y))
        out[q] = sorted(best.items(), key=lambda t: (-t[1], t[0]))[:k]
    return out


def searched(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(3000)]
    got, want = searched(spark, rows, k=10), neighbours(rows, 10)
    assert got.keys() == want.keys()
    hit = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(s == pytest.approx(vectors[q] @ vectors[i], rel=1e-12) for _, i, s in found)
        assert found == sorted(found, key=lambda t: (-t[2], t[1]))


def test_hot_vector_and_small_blocks(spark, monkeypatch):
    """A third of all rows are equal; blocks are small; ties go to the smaller id."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(2)
    rows = [(i, [1.0] * 4 if i % 3 == 0 else rng.normal(size=4).astype(np.float32).tolist()) for i in range(900)]
    got, want = searched(spark, rows, recall=1.0), neighbours(rows, 20)
    hit = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.95 * sum(map(len, want.values()))
    assert [i for _, i, _ in got[0]][:3] == [i for i, _ in want[0]][:3]


def exact_neighbours(rows, k):
    """By scores that are added up from the first component to the last."""
    x = np.array([v for _, v in rows], np.float32).astype(float)
    ids = np.array([i for i, _ in rows])
    out = {}
    for i, v in zip(ids, x):
        if i % 20 == 0:
            score = np.zeros(len(x))
            for d in range(x.shape[1]):
                score += v[d] * x[:, d]
            best = sorted((-s, j) for s, j in zip(score.tolist(), ids.tolist()) if j != i)[:k]
            out[int(i)] = [(j, -s) for s, j in best]
    return out


@pytest.mark.parametrize("block", [37, 4096])
def test_scores_and_ties_do_not_depend_on_blocks(spark, monkeypatch, block):
    """Equal real-valued vectors lie in several blocks: exact scores, ties to the smaller id."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", block)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 5 if block == 37 else 2048)
    rng = np.random.default_rng(5)
    few = rng.normal(size=(9, 33)).astype(np.float32)
    rows = [(i, few[i * 7 % 9].tolist()) for i in range(700)]
    got = searched(spark, rows, k=20, recall=1.0)
    assert {q: [(i, s) for _, i, s in v] for q, v in got.items()} == exact_neighbours(rows, 20)


def test_large_leaves_get_subtrees(spark, monkeypatch):
    """Leaves grow in number with the table; results stay near the exact ones."""
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 300)
    monkeypatch.setattr(ann, "LEAF_MOST", 120)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 8))
    rows = [(i, (centres[i % 40] + 0.2 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(4000)]
    grafted = []
    graft = ann.Tree.graft
    monkeypatch.setattr(ann.Tree, "graft", lambda self, subtrees: grafted.append((self.leaves, graft(self, subtrees))) or grafted[-1][1])
    got, want = searched(spark, rows, k=10), exact_neighbours(rows, 10)
    (before, tree) = grafted[0]
    assert tree.leaves > 2 * before and sorted(tree.leaf[tree.leaf >= 0]) == list(range(tree.leaves))
    x = np.array([v for _, v in rows])
    assert sum(tree.held) == 4000 and set(tree.file(x).tolist()) <= set(range(tree.leaves))
    hit = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (20, [3.0, 1.0]), (20, [-3.0, 1.0]), (1, [1.0, 0.0]), (None, [1.0, 1.0]), (40, [0.0, 0.0]), (9, [1.0, 2.0, 3.0])]
    want = neighbours([r for r in rows if r[1] is None or len(r[1]) < 3], 20)
    got = searched(spark, rows)
    assert {q: [(i, s) for _, i, s in v] for q, v in got.items()} == want
    assert searched(spark, rows[2:8]) == {} == searched(spark, rows[1:2])
    extra = spark.createDataFrame([(0, [1.0], 1, "x"), (1, [2.0], 2, "y")], "vec_id long, embedding array<float>, leaf int, id string")
    assert ann.search(extra, F.col("vec_id") == 0).collect()[0]["vec_id"] == 1


def test_tree_visits_best_leaves_first():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 8))
    tree = ann.grow(x)
    leaf = tree.file(x)
    assert set(leaf.tolist()) <= set(range(tree.leaves)) and tree.leaves > 20
    tree.held = np.bincount(leaf, minlength=tree.leaves).tolist()
    order = tree.order(x[:50], tree.leaves, 0)
    assert all(sorted(o) == list(range(tree.leaves)) for o in order)
    assert np.mean([o.index(k) for o, k in zip(order, leaf[:50])]) < tree.leaves / 4
    assert all(sum(tree.held[k] for k in o) >= 300 for o in tree.order(x[:20], 1, 300))
    assert ann.grow(np.ones((500, 4))).leaves == 1
    # a walk that looks for some leaves ends with the last of them
    wanted = [{o[3], o[7]} for o in order]
    assert tree.order(x[:50], 1, 0, wanted) == [o[:8] for o in order] and tree.order(x[:1], 1, 0, [set()]) == [[]]


def test_work_a_query_falls_as_clustered_tables_grow(spark, monkeypatch):
    """Clusters that grow in number: leaves get subtrees, and a query visits and scores a falling share of them, at the same recall."""
    monkeypatch.setattr(ann, "LEAF_MOST", 400)
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 512)
    rng, shares = np.random.default_rng(5), []
    for n in (1000, 5000):
        centres = rng.normal(size=(n // 25, 16)) * 4
        x = centres[np.arange(n) % len(centres)] + rng.normal(size=(n, 16)) * 0.3
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
        seen = []
        monkeypatch.setattr(ann, "calibrate", lambda rows, tree, *a, run=ann.calibrate: seen.append((run(rows, tree, *a), tree.leaves)) or seen[-1][0])
        got = defaultdict(set)
        for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
            got[r["query_id"]].add(r["vec_id"])
        monkeypatch.undo()
        monkeypatch.setattr(ann, "LEAF_MOST", 400)
        monkeypatch.setattr(ann, "SAMPLE_ROWS", 512)
        hits = [len(got[q] & {*sorted((k for k in range(n) if k != q), key=lambda k: (-float(x[k] @ x[q]), k))[:20]}) for q in range(0, n, 20)]
        assert np.mean(hits) >= 0.9 * 20
        shares.append(seen[0][0] / seen[0][1])
    assert shares[1] < shares[0]


def test_tree_stays_within_its_bytes(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_MOST", 20)
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 128)
    monkeypatch.setattr(ann, "TREE_BYTES", 1)
    grafted, graft = [], ann.Tree.graft
    monkeypatch.setattr(ann.Tree, "graft", lambda self, subtrees: grafted.append(len(subtrees)) or graft(self, subtrees))
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(1500, 4)))], "vec_id long, embedding array<double>")
    assert ann.search(df, F.col("vec_id") == 0).count() == 20 and grafted == [1]


@pytest.mark.parametrize("n", [64, 128, 2048, 2112, 64 * 1000])
def test_container(n):
    body = random.Random(n).randbytes(n)
    data = media.build(body)
    track = media.probe(data)
    assert media.payload(data, track) == body
    assert (track.codec, track.timescale, track.duration, track.samples) == ("raw ", 8000, n, n // 64)
    assert [data[a : a + k] for a, k in track.keyframes] == [body[a : a + 64] for a in range(0, n, 64 * media.KEY_EVERY)]
    paths = [p for p, _, _ in media.walk(data)]
    assert paths[0] == (b"ftyp",) and paths[-1] == (b"mdat",) and (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stss") in paths
    top = [(a, b) for p, a, b in media.walk(data) if len(p) == 1]
    assert top[-1][1] == len(data)


def test_broken_containers():
    data = media.build(bytes(64))
    for bad in (data[:-1], data[:20], b"\0\0\0\4moov", data.replace(b"stsz", b"xxxx")):
        with pytest.raises(ValueError):
            media.probe(bad)
    with pytest.raises(ValueError):
        media.build(b"x")
    # other writers' forms: 64-bit box sizes, a box up to the end, samples of different sizes, no table of sync samples
    import struct

    box, full = media._box, media._full
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1")), full(b"stts", struct.pack(">IIIII", 2, 1, 10, 2, 5)), full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)), full(b"stsz", struct.pack(">IIIII", 0, 3, 4, 6, 5)), full(b"co64", struct.pack(">IQQ", 2, 100, 200)))
    mdhd = full(b"mdhd", bytes(16), struct.pack(">IQ", 600, 20), bytes(4), version=1)
    moov = box(b"moov", box(b"trak", box(b"mdia", mdhd, box(b"minf", stbl))))
    wide = struct.pack(">I4sQ", 1, b"free", 20) + bytes(4)
    track = media.probe(wide + moov + struct.pack(">I4s", 0, b"mdat") + bytes(99))
    assert (track.codec, track.timescale, track.duration) == ("avc1", 600, 20)
    assert track.keyframes == [(100, 4), (104, 6), (200, 5)] and track.runs == [(100, 10), (200, 5)]


def test_two_tracks():
    """A track that lacks a table of sync samples, or has chunk offsets of another width, does not take the other track's."""
    import struct

    box, full = media._box, media._full

    def trak(codec, sizes, offsets, wide, keys):
        tables = [full(b"stsd", struct.pack(">I", 1), box(codec)), full(b"stts", struct.pack(">III", 1, len(sizes), 10)), full(b"stsc", struct.pack(">IIII", 1, 1, len(sizes), 1))]
        tables += [full(b"stsz", struct.pack(f">II{len(sizes)}I", 0, len(sizes), *sizes)), full(b"co64" if wide else b"stco", struct.pack(f">I{'Q' if wide else 'I'}", 1, *offsets))]
        tables += [full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys))] if keys else []
        mdhd = full(b"mdhd", bytes(8), struct.pack(">IIHH", 600, 30, 0, 0))
        return box(b"trak", box(b"mdia", mdhd, box(b"minf", box(b"stbl", *tables))))

    data = box(b"moov", trak(b"avc1", [3, 4, 5], [100], False, []), trak(b"mp4a", [6, 7], [200], True, [2]))
    one, two = media.tracks(data)
    assert one.codec == "avc1" and one.keyframes == [(100, 3), (103, 4), (107, 5)] and one.runs == [(100, 12)]
    assert two.codec == "mp4a" and two.keyframes == [(206, 7)] and two.runs == [(200, 13)]
    assert media.probe(data) == one
    with pytest.raises(ValueError, match="no track"):
        media.probe(box(b"moov"))


def test_media_columns(spark):
    docs = [(1, "hello"), (2, ""), (3, None), (4, "é" * 40), (5, "x" * 64), (None, "hello"), (6, "long " * 100_000)]
    df = wide(spark, [(d, t, "s") for d, t in docs])
    rows = media.probed(media.stored(df)).collect()
    assert len(rows) == len(docs)
    by = {r["doc_id"]: r for r in rows}
    for d, t in docs:
        raw = (t or "").encode()
        body = raw + bytes(-len(raw) % 64 if raw else 64)
        r = by[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        data = media.build(body)
        assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert r["feature"].startswith(f"codec=raw;timescale=8000;duration={len(body)};")
        assert len(r["keyframes"]) == -(-len(body) // (64 * media.KEY_EVERY))
    assert by[1]["feature"] == by[None]["feature"] and media.probed(media.stored(df.where("false"))).count() == 0
