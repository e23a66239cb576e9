"""The queries as they are registered, on the smallest tables: columns, types, and every row against brute force or SQL."""

import hashlib
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tensorloom.llm import media, quality, registry
from tests.llm.test_native import WORD, removed_lines, targets
from tests.llm.test_search_and_media import exact_neighbours
from tests.llm.test_text import brute_components, removed_bytes, sets_of

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text, source FROM documents").fetchall()


def result(spark, name, **kinds):
    df = entry.queries()[name](spark, DATA)
    have = dict(df.dtypes)
    assert {k: have[k] for k in kinds} == kinds
    return df.collect()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    want = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(want.fetchall())


def test_op2(spark, docs):
    rows = result(spark, "op2_minhash_dedup", doc_id="bigint", n_shingles="bigint", component_id="bigint", kept="boolean")
    pairs = [(d, t) for d, t, _ in docs]
    sizes, want = sets_of(pairs, 3), brute_components(pairs, 3, 85)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sizes[r["doc_id"]][0]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_op3(spark, docs):
    from tensorloom.llm import tokens

    rows = result(spark, "op3_token_pack", row_id="bigint", n_ids="int", n_segments="int", ids_sha256="string")
    encoding = tokens._encoding(Path(tokens.VOCABULARY).read_bytes(), tokens.PATTERN)
    ids = {d: encoding.encode_ordinary(t or "") for d, t, _ in docs}
    seen = Counter()
    for r in rows:
        cu, row, place = r["cu_seqlens"], [], []
        for d, at, n in zip(r["doc_ids"], r["doc_offsets"], np.diff(cu).tolist()):
            row += ids[d][at : at + n]
            place += range(n)
            seen.update((d, k) for k in range(at, at + n))
        assert len(row) == r["n_ids"] == cu[-1] <= tokens.LENGTH and len(r["doc_ids"]) == r["n_segments"]
        pad = tokens.LENGTH - len(row)
        assert hashlib.sha256(np.array(row + [tokens.PAD] * pad, "<i4").tobytes()).hexdigest() == r["ids_sha256"]
        assert zlib.crc32(np.array(place + [0] * pad, "<i4").tobytes()) == r["positions_crc32"]
    assert seen == Counter((d, k) for d, x in ids.items() for k in range(len(x))), "every id once"


def packed_well(rows, docs, capacity=2048):
    """No bin too full or with two pieces of a source or of equal words; every document covered as often as it stands."""
    bins, pieces = defaultdict(list), defaultdict(list)
    words = {d: WORD.findall((t or "").lower()) for d, t, _ in docs}
    source = {d: s for d, _, s in docs}
    for r in rows:
        pieces[r["doc_id"]].append((r["doc_offset"], r["size"]))
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append(r)
    for members in bins.values():
        assert sum(r["size"] for r in members) <= capacity
        assert len({source[r["doc_id"]] for r in members}) == len(members) == len({tuple(words[r["doc_id"]]) for r in members})
        at = 0
        for r in sorted(members, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["size"]
    stands = Counter(d for d, _, _ in docs)
    assert pieces.keys() == stands.keys()
    for d, own in pieces.items():
        n = len(words[d])
        assert Counter(own) == Counter({(a, min(capacity, n - a)): stands[d] for a in range(0, max(n, 1), capacity)})


def test_op4(spark, docs):
    packed_well(result(spark, "op4_bestfit_pack", doc_id="bigint", piece="int", size="bigint", bin_id="bigint"), docs)


def test_op5(spark, duck):
    rows = result(spark, "op5_ann_search", query_id="bigint", rank="int", vec_id="bigint", score="double")
    vectors = duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    want, got = exact_neighbours(vectors, 20), defaultdict(list)
    scores = {q: dict(v) for q, v in exact_neighbours(vectors, len(vectors)).items()}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(scores[q][i] == s for _, i, s in found)
        assert found == sorted(found, key=lambda x: (-x[2], x[1]))
    hit = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 20 * len(want)


def test_op6(spark, docs):
    rows = result(spark, "op6_mixture", doc_id="bigint", size="bigint", source_size="bigint", target="double", taken="bigint")
    mixed_well(rows, docs)
    again = entry.queries()["op6_mixture"](spark, DATA).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def mixed_well(rows, docs):
    size = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    source = {d: s for d, _, s in docs}
    total, taken = Counter(), Counter()
    for d, s in source.items():
        total[s] += size[d]
    want = targets(total)
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s]) and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in total:
        assert abs(taken[s] - want[s]) <= max(size[d] for d in size if source[d] == s) / 2 + 1, s


def test_op7(spark, docs):
    kinds = {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}
    rows = {r["doc_id"]: r for r in result(spark, "op7_media_columns", **kinds)}
    assert len(rows) == len(docs)
    for d, t, _ in docs:
        raw, r = (t or "").encode(), rows[d]
        body = raw + bytes(-len(raw) % 64 if raw else 64)
        data = media.build(body)
        assert media.payload(data, media.probe(data)) == body
        assert tuple(r)[1:7] == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(data), hashlib.sha256(data).hexdigest())
        assert r["feature"] == media.feature(media.probe(data))


def test_op8(spark, docs):
    kinds = {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    rows = {r["doc_id"]: tuple(r) for r in result(spark, "op8_suffix_dedup", **kinds)}
    for d, n, kept, spans in removed_bytes([(d, t) for d, t, _ in docs], 50):
        assert rows[d] == (d, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    assert len(rows) == len(docs) and any(r[2] for r in rows.values())


def test_op9(spark, docs, duck):
    rows = result(spark, "op9_quality", doc_id="bigint", held_out="boolean", score="double", predicted="int")
    truth = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.85 * len(held)


def test_pipeline_stages_against_brute_force(spark, docs, duck, tmp_path):
    """Each stage's rows from its predecessor's, written and read again as the driver does."""
    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, rows = frame.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, DATA)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        rows[name] = frame.collect() if "bin_id" in frame.columns else [(r["doc_id"], r["text"], r["source"]) for r in frame.collect()]
    model = quality.train(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    margin = lambda t: model.bias + sum(model.weights[at].astype(float) @ v for at, v in quality.sparse(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())])))
    assert {d for d, _, _ in rows["quality"]} == {d for d, t, _ in docs if margin(t) >= 0}
    truth = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    kept = {d for d, _, _ in rows["quality"]}
    assert sum((d in kept) == bool(q) for d, q in truth.items()) >= 0.9 * len(truth)
    lines = removed_lines([(d, t) for d, t, _ in rows["quality"] if t is not None])
    assert sorted(rows["lines"], key=str) == sorted([(d, lines.get((d, t)), s) for d, t, s in rows["quality"]], key=str)
    component = brute_components([(d, t) for d, t, _ in rows["lines"]], 5, 80)
    assert sorted(rows["near_duplicates"], key=str) == sorted([r for r in rows["lines"] if component[r[0]] == r[0]], key=str)
    copies, size = Counter(d for d, _, _ in rows["mixture"]), {d: len(WORD.findall(t or "")) for d, t, _ in rows["near_duplicates"]}
    assert set(rows["mixture"]) <= set(rows["near_duplicates"]) and max(copies.values()) <= 2
    total, taken = Counter(), Counter()
    for d, _, s in rows["near_duplicates"]:
        total[s] += size[d]
        taken[s] += size[d] * copies[d]
    for s, n in targets(total).items():
        assert abs(taken[s] - n) <= max(size[d] for d, _, x in rows["near_duplicates"] if x == s) / 2 + 1, s
    packed_well(rows["packing"], rows["mixture"])
    whole = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(map(str, whole)) == sorted(map(str, rows["packing"]))
