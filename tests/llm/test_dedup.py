"""Near-duplicates, passage dedup and the pivot index against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlens.llm import common, minhash, pivots, queries, suffix_dedup
from tests.llm.helpers import SCHEMA, components, documents, frame, shingles


def test_local_minima_cover_every_window():
    rng = np.random.default_rng(0)
    for _ in range(200):
        group = np.repeat(np.arange(6), rng.integers(0, 12, 6))
        hashes, window = rng.integers(0, 9, len(group)).astype(np.uint64), int(rng.integers(1, 6))
        want = set()
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            for run in [at] if len(at) < window else [at[i : i + window] for i in range(len(at) - window + 1)]:
                want |= {int(i) for i in run if hashes[i] == hashes[run].min()}
        assert set(common.local_minima(hashes, group, window).tolist()) == want


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(200, 260)] + [(7, 7)]
    got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in (500, *range(200, 260))} == {200} and 7 not in got


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, size, percent):
    rows = documents(seed=size, n=60)
    # A chain of near copies: neighbours link, the ends do not.
    words = [f"w{i}" for i in range(120)]
    for step in range(6):
        rows.append((1000 + step, " ".join([f"v{step}x{i}" for i in range(4 * step)] + words[4 * step :]), *rows[0][2:]))
    sets = [shingles(r[1], size) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = components(len(rows), links)
    ids = [r[0] for r in rows]
    want = {(ids[i], len(sets[i]), min(ids[j] for j in range(len(rows)) if root[j] == root[i])) for i in range(len(rows))}
    got = minhash.near_duplicates(frame(spark, rows), size, percent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_rows_without_id_and_repeated_rows(spark):
    tail = documents(n=1)[0][2:]
    rows = [(None, "a b c d", *tail), (1, "a b c d", *tail), (1, "a b c d", *tail), (2, "a b c d", *tail), (3, None, *tail)]
    got = sorted(map(str, [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect()]))
    assert got == sorted(map(str, [(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]))
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_estimate_is_near_the_true_similarity(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    near = base.copy()
    near[:300] = rng.integers(0, 1 << 63, 300)
    flat = np.concatenate([np.unique(base), np.unique(near)])
    packed = minhash.packed_bits(minhash.signatures(flat, np.array([0, len(np.unique(base)), len(flat)]))).view(np.int64)
    pair = spark.createDataFrame([(packed[0].tolist(), packed[1].tolist())], "x array<long>, y array<long>")
    assert pair.select(minhash.estimate("x", "y")).first()[0] == pytest.approx(2700 / 3300, abs=0.12)


def brute_repeats(rows):
    seen, out = set(), set()
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        cover = np.zeros(len(data) + 1, int)
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                cover[i] += 1
                cover[i + 100] -= 1
            seen.add(data[i : i + 100])
        mask = np.cumsum(cover[:-1]) > 0
        spans = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~mask])
        out.add((doc_id, len(data), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    rows, rng = documents(seed, 50), random.Random(seed)
    pool = [r[1] for r in rows if r[1] and len(r[1]) > 150]
    for i in range(60):
        source = rng.choice(pool)
        a = rng.randrange(len(source) - 110)
        b = a + rng.randrange(90, 400)
        rows.append((5000 + i, source[a:b] + rng.choice(["", "x", " tail of its own " * 3]), *rows[0][2:]))
    rows += [(6000, "ab" * 400, *rows[0][2:]), (6001, "z" * 350, *rows[0][2:]), (6002, "z" * 99, *rows[0][2:]), (6003, "z" * 100, *rows[0][2:])]
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    assert {tuple(r) for r in got} == brute_repeats([(r[0], r[1]) for r in rows]) and len(got) == len(rows)


def test_cut_texts_keep_columns_and_whole_characters(spark):
    text = "é" * 60 + "end"
    tail = documents(n=1)[0][2:]
    rows = [(1, text, *tail), (2, "ü" + "é" * 60, *tail), (None, None, *tail), (2, "other text of the same id", *tail)]
    cut = suffix_dedup.remove_repeats(frame(spark, rows), keep_text=True)
    assert cut.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    got = {(r.doc_id, r.text) for r in cut.collect()}
    assert got == {(None, None), (1, brute_text(text)), (2, "ü"), (2, "other text of the same id")}
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_texts_without_id_are_documents_of_their_own(spark):
    n, passage = 140_000, "".join(f"{i:03d}" for i in range(34))
    docs = spark.range(n).selectExpr("cast(null as long) as doc_id", f"concat(id, ' {passage}') as text")
    found = suffix_dedup.remove_repeats(docs).selectExpr("count(*) as n", "count_if(n_removed < 102) as whole", "sum(n_bytes) as size").first()
    assert (found.n, found.whole, found.size) == (n, 1, sum(len(str(i)) for i in range(n)) + 103 * n)


def brute_text(text):
    """The text of a first document: bytes repeated inside it go, whole characters only."""
    data, seen = text.encode(), set()
    gone = np.zeros(len(data), bool)
    for i in range(len(data) - 99):
        if data[i : i + 100] in seen:
            gone[i : i + 100] = True
        seen.add(data[i : i + 100])
    return "".join(c for c, at in zip(text, np.cumsum([0] + [len(c.encode()) for c in text]), strict=False) if not gone[at : at + len(c.encode())].all())


def test_pivot_index_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 24))
    rows = []
    for i in range(900):
        v = base[i % 40] + rng.normal(size=24) * (0.05 if i % 3 else 0.6)
        rows.append([i, v.astype(np.float32).tolist(), i % 2])
    rows += [[2000 + i, rows[1][1], rows[1][2]] for i in range(5)]
    unit = np.array([r[1] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    root = components(len(rows), zip(*np.nonzero(near), strict=True))
    odd = [[3000, None, 1], [3001, [], 1], [3002, [0.0] * 24, 1], [3003, [float("nan")] * 24, 1], [3004, [None] * 24, 1], [3005, rows[1][1], None], [None, rows[1][1], 1], [3006, [1.0, 2.0], 1], [3007, [2.0, 4.0], 1]]
    frame_ = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<float>, label int, rep string, n long").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(frame_).collect()}
    want = {r[0]: (int(near[i].sum()), rows[root[i]][0], root[i] == i) for i, r in enumerate(rows)}
    found, all_links = sum(got[k][0] for k in want), int(near.sum())
    assert all_links > 5000 and found >= 0.98 * all_links
    assert sum(got[k] == want[k] for k in want) >= 0.97 * len(want) and all(got[k][0] <= want[k][0] for k in want)
    assert [got[k] for k in (3000, 3001, 3002, 3003, 3004, 3005)] == [(0, k, True) for k in (3000, 3001, 3002, 3003, 3004, 3005)]
    assert got[None] == (0, None, True) and got[3006] == (1, 3006, True) and got[3007] == (1, 3006, False)
    assert pivots.near_duplicates(frame_.limit(0)).count() == 0


def test_pivot_query_equals_brute_force(spark, tmp_path):
    """The registered query over the test table and four near copies of every third vector."""
    rng = np.random.default_rng(8)
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    some = [v is not None and len(v) > 0 for v in table.embedding]
    copies = [table[some].iloc[::3].assign(vec_id=lambda t, k=k: t.vec_id + 10_000 * k) for k in range(1, 5)]
    for c in copies:
        c["embedding"] = [(np.array(v, np.float32) + rng.normal(scale=0.08, size=len(v)) * np.abs(v).mean()).astype(np.float32) for v in c.embedding]
    table = pd.concat([table, *copies], ignore_index=True)
    spark.createDataFrame([(int(a), None if v is None else [float(x) for x in v], None if l != l else int(l)) for a, v, l in table[["vec_id", "embedding", "label"]].itertuples(index=False)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    valid = [v is not None and len(v) > 0 and np.isfinite(np.array(v, float)).all() and np.any(v) and l == l for v, l in zip(table.embedding, table.label, strict=True)]
    rows = table[valid].reset_index(drop=True)
    unit = np.array(rows.embedding.tolist(), float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (rows.label.values[:, None] == rows.label.values)
    np.fill_diagonal(near, False)
    order = np.argsort(rows.vec_id.values)
    root = components(len(rows), zip(*np.nonzero(near[np.ix_(order, order)]), strict=True))
    want = {int(v): (0, int(v), True) for v in table.vec_id}
    ids = rows.vec_id.values[order]
    want |= {int(ids[i]): (int(near[order[i]].sum()), int(ids[root[i]]), root[i] == i) for i in range(len(ids))}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op1_pivots(spark, str(tmp_path)).collect()}
    assert near.sum() > 1000 and set(got) == set(want)
    assert sum(g[0] for g in got.values()) >= 0.98 * near.sum() and all(got[k][0] <= want[k][0] for k in want)
    assert sum(got[k] == want[k] for k in want) >= 0.98 * len(want)


def test_descriptions_keep_order_and_count_shared_points():
    near = np.array([[5, 2, 9, 1], [9, 5, 7, 1], [3, 8, 4, 6]], np.int32)
    assert pivots.shared_points(near, near).tolist() == [[4, 3, 0], [3, 4, 0], [0, 0, 4]]
    # Leading points are the closest three: rows 0 and 1 meet in the lists 5 and 9, and count in 5.
    assert pivots.first_list(near[:1], near[1:2]).tolist() == [5]


def test_sub_keys_of_ids_that_are_multiples_of_the_number_of_sub_keys(spark):
    rows = spark.range(0, 64_000, 32).selectExpr("id", "1 as k")
    assert rows.selectExpr(f"pmod(xxhash64(id), {common.SALTS}) as s").distinct().count() == common.SALTS
    back = common.salted(rows, ["k"], [F.count("*").alias("c")], F.col("id"), 2)
    assert back.columns == ["k", "id", "c"] and back.where("c = 2000").count() == 2000
