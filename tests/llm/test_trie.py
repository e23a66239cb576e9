"""The prefix trie against one that is built node by node."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tensorloom.llm import trie
from tensorloom.llm.trie import last_turns, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0, digest), (role, text)))
    convs = {c: [t for _, t in sorted(x)] for c, x in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        group = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = convs.get(group, [])[:h] + own[h:]
    return out


def brute(rows):
    paths = rebuilt(rows)
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)

    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in children[key]) or 1
        saved[key] = (len(members[key]) - 1) * (len(key[-1][1]) if key else 0) + sum(saved[k] for k in children[key])
    out = []
    for key, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(paths[c]) == len(key))
        parent = members[key[:-1]][0] if key else None
        out.append((convs[0], len(key), parent, len(convs), len(children[key]), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == COLUMNS and {t for _, t in df.dtypes[:-1]} == {"bigint"}
    return sorted(map(tuple, df.collect()), key=repr)


def talk(seed, convs, longest=9, words=3):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for k in range(rng.randrange(1, longest)):
            rows.append((c, k, rng.choice(["user", "assistant"]), rng.choice(["", "a", "é日", "long " * 5][:words])))
    rng.shuffle(rows)
    return rows


ODD = [
    *[(c, None, "user", "hi") for c in (1, 1, 2)],
    *[(c, 0, None, None) for c in (1, 2, 3, None)],
    (2, 5, "", "user"),
    (3, 5, "user", ""),
    (3, 5, "user", ""),
    (-1, 1, "user", "neg"),
    (-100, 1, "user", "x"),
    (-101, 1, "user", "x"),
    (0, 9, "user", "\U0001f600" * 3),
    *[(10**15 + k, 1, "user", "far") for k in range(3)],
    *[(7, k, "user", f"t{k % 3}") for k in range(300)],
    *[(507, k, "user", f"t{k % 3}") for k in range(290)],
    (8, 0, "user", "word " * 400_000),
]


@pytest.mark.parametrize("rows", [talk(1, range(250)), talk(2, [*range(90, 130), *range(900, 930)], 14, 2), ODD], ids=["groups", "deep", "odd"])
def test_against_brute_force(spark, rows):
    assert got(prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(4))) == brute(rows)


def test_chains_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK_BITS", 1)
    monkeypatch.setattr(trie, "BLOCK", 2)
    monkeypatch.setattr(trie, "PIECE_BITS", 2)
    rows = talk(3, range(120), 24, 2)
    assert got(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_copies_of_one_conversation(spark):
    """Most conversations equal: shares of the prefix, pieces of the ends."""
    rows = [(c, k, "user", f"line {k}") for c in range(100, 1900) for k in range(7)] + talk(4, range(100))
    assert got(prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_no_task_has_a_prefix_or_a_conversation_alone(spark):
    """Where one conversation has most turns, or all members share a prefix, exchanges have other keys beside it."""
    rows = [(5, k, "user", "x") for k in range(4000)] + [(c, 0, "user", "same") for c in range(1000, 3000)]
    nodes = trie.paths(spark.createDataFrame(rows, SCHEMA))
    plan = trie.owned(nodes)._jdf.queryExecution().toString()
    assert "Window" in plan and plan.count("share") > 2
    assert prefix_trie(spark.createDataFrame(rows, SCHEMA)).count() == len(brute(rows))


def test_empty_tables_and_other_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", b"k", 5)], SCHEMA + ", key binary, depth int")
    assert got(prefix_trie(df)) == brute([(1, 0, "user", "a")])
    assert prefix_trie(df.where("false")).count() == 0
    assert prefix_trie(df.where("false").unionByName(df.selectExpr("CAST(NULL AS LONG) AS conv_id", "turn", "role", "text", "key", "depth"))).count() == 0


def test_last_turns(spark):
    rows = talk(6, range(130), 6)
    paths = rebuilt(rows)
    want = {(c, d): paths[c][d - 1] for c, d, *_ in brute(rows) if d}
    assert {(r[0], r[1]): (r[2], r[3]) for r in last_turns(spark.createDataFrame(rows, SCHEMA)).collect()} == want
