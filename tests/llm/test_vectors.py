"""Operators on vectors, against comparisons of all pairs."""

import numpy as np
import pyarrow as pa
from conftest import SF_DIR
from pyspark.sql import functions as F

from normscope.llm import common, vector_dedup, vector_search
from normscope.llm.common import connected_components

KIND = "vec_id long, embedding array<double>, label int, node long, score double"
ODD = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] * 16]


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, 16))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(scale=0.14, size=(n, 16))
    x[10:20] = x[0]
    return x, rng.integers(0, 3, n)


def frame(spark, x, label):
    rows = [(i, [float(v) for v in r], int(k), 1, 2.0) for i, (r, k) in enumerate(zip(x, label, strict=True))]
    rows += [(len(x) + i, v, 1, 1, 2.0) for i, v in enumerate(ODD)] + [(len(x) + len(ODD), [1.0] * 16, None, 1, 2.0)]
    return spark.createDataFrame(rows, KIND)


def links(x, label, least):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= least) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    component = np.arange(len(x))
    while True:
        least_id = np.where(near, component[None, :], len(x)).min(axis=1)
        new = np.minimum(component, least_id)
        if np.array_equal(new, component):
            return near.sum(axis=1), component
        component = new


def test_links_equal_brute_force_also_in_small_blocks(spark):
    x, label = clustered(900)
    n, component = links(x, label, 0.93)
    assert n.max() > 5
    for block in (2_048, 8):
        got = vector_dedup.linked_vectors(frame(spark, x, label), settings=vector_dedup.LatticeSettings(block=block)).orderBy("vec_id").collect()
        assert len(got) == len(x) + len(ODD) + 1
        assert [(r["n_links"], r["component_id"]) for r in got[: len(x)]] == list(zip(n.tolist(), component.tolist(), strict=True))
        assert all((r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True) for r in got[len(x) :])


def test_pairs_at_the_threshold_are_seldom_missed():
    rng = np.random.default_rng(8)
    s = vector_dedup.LatticeSettings()
    a = rng.normal(size=(20_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * side
    zero = np.zeros(len(a), dtype=np.int64)
    p, q = vector_dedup.signatures(a, zero, s), vector_dedup.signatures(b, zero, s)
    met = ((p[:, :, :] == q[:, :, :1]).any(axis=2) | (q[:, :, :] == p[:, :, :1]).any(axis=2)).any(axis=1)
    print("missed at 0.93:", (~met).mean())
    assert (~met).mean() < 2e-3


def test_lattice_points_are_the_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)) * 2
    p = vector_dedup.nearest_e8(x)
    own = ((x - p) ** 2).sum(axis=1)
    for v in vector_dedup._SHORTEST:
        assert (((x - p - v) ** 2).sum(axis=1) >= own - 1e-9).all()
    assert len(vector_dedup._SHORTEST) == 240


def test_dedup_with_null_and_repeated_ids(spark):
    v = [1.0] + [0.0] * 15
    rows = [(None, v, 1, 0, 0.0), (4, v, 1, 0, 0.0), (4, v, 1, 0, 0.0), (9, v, 1, 0, 0.0)]
    got = vector_dedup.linked_vectors(spark.createDataFrame(rows, KIND)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == [("4", 2, "4"), ("4", 2, "4"), ("9", 2, "4"), ("None", 0, "None")]


def test_different_vectors_under_one_id_are_nodes_of_their_own(spark):
    rng = np.random.default_rng(7)
    x, label = clustered(300, seed=4)
    ids = rng.integers(0, 120, len(x))
    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T >= 0.93
    near &= label[:, None] == label[None, :]
    np.fill_diagonal(near, False)
    component = ids.copy()
    while True:
        new = np.minimum(component, np.where(near, component[None, :], 10**6).min(axis=1))
        if np.array_equal(new, component):
            break
        component = new
    rows = [(int(i), [float(v) for v in r], int(k), 1, 2.0) for i, r, k in zip(ids, x, label, strict=True)]
    got = vector_dedup.linked_vectors(spark.createDataFrame(rows, KIND)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted(zip(ids.tolist(), near.sum(axis=1).tolist(), component.tolist(), strict=True))


def test_settings_follow_the_number_of_vectors():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(4_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    zero = np.zeros(len(a), dtype=np.int64)
    for rows in (10**4, 10**6, 10**8):
        s = vector_dedup.LatticeSettings.for_rows(rows)
        p, q = vector_dedup.signatures(a, zero, s), vector_dedup.signatures(b, zero, s)
        met = ((p == q[:, :, :1]).any(axis=2) | (q == p[:, :, :1]).any(axis=2)).any(axis=1)
        own = np.sort(p[:, :, 0], axis=0)
        chance = np.mean([(np.searchsorted(own[:, t], p[:, t], "right") - np.searchsorted(own[:, t], p[:, t], "left")).sum() - len(a) for t in range(s.tables)]) * s.tables / len(a) ** 2
        print(rows, "missed", (~met).mean(), "share of pairs", chance)
        assert (~met).mean() < 3e-3


def test_links_do_not_depend_on_how_many_vectors_there_are(spark, monkeypatch):
    """Settings by counts would give other cells beyond 100,000 vectors; here any count would."""
    asked = []
    monkeypatch.setattr(vector_dedup.LatticeSettings, "for_rows", classmethod(lambda cls, rows: asked.append(rows) or cls(tables=1, probes=0, scale=50.0)))
    x, label = clustered(300, seed=2)
    n, component = links(x, label, 0.93)
    got = vector_dedup.linked_vectors(frame(spark, x, label)).where("vec_id < 300").orderBy("vec_id").collect()
    assert not asked and [(r["n_links"], r["component_id"]) for r in got] == list(zip(n.tolist(), component.tolist(), strict=True))


def test_components_with_a_large_hub(spark):
    rng = np.random.default_rng(1)
    edges = [(0, int(i)) for i in range(1, 3_000)] + [(int(a), int(a) + 1) for a in rng.integers(5_000, 6_000, 700)] + [(4, 4), (None, 7)]
    frame = spark.createDataFrame([e for e in edges], "u long, v long")
    parent = list(range(6_002))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for u, v in edges:
        if u is not None and u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    assert got == {n: root(n) for u, v in edges if u is not None and u != v for n in (u, v)}


def test_stars_of_many_tasks_leave_an_edge_for_each_node(spark, monkeypatch):
    """Sixty tasks have seen parts of one group of 600 and made a star each: the rounds begin with some 600 edges, not with the thousands of the stars."""
    rows = []
    plain = common.materialise

    def counted(df, name):
        out = plain(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(common, "materialise", counted)
    rng = np.random.default_rng(8)
    seen = [np.sort(rng.choice(600, 300, replace=False)) for _ in range(60)]
    edges = [(int(u), int(s[0])) for s in seen for u in s[1:]] + [(901, 900), (902, 901), (7, 7), (None, 3)]
    frame = spark.createDataFrame(edges, "u long, v long").repartition(8)
    got = {r["node"]: r["component"] for r in connected_components(frame, contracted=True).collect()}
    assert got == {int(u): int(min(s[0] for s in seen)) for s in seen for u in s} | {900: 900, 901: 900, 902: 900}
    assert len({e for e in edges if e[0] is not None}) > 3_000 and max(rows) < 800


def test_contraction_keeps_components_whatever_is_held():
    rng = np.random.default_rng(4)
    pairs = rng.integers(0, 900, (700, 2))
    edges = [(int(max(p)), int(min(p))) for p in pairs if p[0] != p[1]]
    batches = [pa.RecordBatch.from_pydict({"u": [u for u, _ in edges[a : a + 50]], "v": [v for _, v in edges[a : a + 50]]}, pa.schema([("u", pa.int64()), ("v", pa.int64())])) for a in range(0, 1_000, 50)]

    def classes(found):
        forest = common.Forest(900)
        forest.join(*np.array(found).T)
        return {n: forest.find(n) for e in edges for n in e}

    for held in (0, 120, 10_000):
        got = [(u, v) for b in common.contract(iter(batches), held) for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True)]
        assert classes(got) == classes(edges) and len(got) <= len(edges)
        assert held < 10_000 or len({u for u, _ in got}) == len(got)


def test_vectors_of_each_length_are_searched_among_themselves(spark):
    rows = [(k, [1.0, k / 9.0] if k % 3 else [1.0, k / 9.0, 0.5], 1, 1, 1.0) for k in range(30)] + [(None, [1.0, 2.0], 1, 1, 1.0), (4, [1.0, 4 / 9.0], 1, 1, 1.0)]
    got = vector_search.search(spark.createDataFrame(rows, KIND), F.col("vec_id") < 6).collect()
    assert {r["query_id"] for r in got} == set(range(6)) and len(got) == 30
    assert all((r["query_id"] % 3 == 0) == (r["vec_id"] % 3 == 0) for r in got)


def nearest(x, ids, queries, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        score = unit @ unit[q]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def test_search_recall_and_scores(spark):
    table = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.1')}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows], dtype=np.float64), np.array([r["vec_id"] for r in rows])
    want = nearest(x, ids, np.flatnonzero(ids % 50 == 0), 5)
    got = {}
    for r in vector_search.search(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want])
    print("recall", hits)
    assert hits >= 0.9
    place = {int(i): k for k, i in enumerate(ids)}
    for q, found in got.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        for i, s in found:
            a, b = x[place[q]], x[place[i]]
            assert abs(s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_search_of_few_rows_is_complete_and_orders_ties_by_id(spark):
    x, label = clustered(60)
    table = frame(spark, x, label)
    s = vector_search.SearchSettings(probe=1.0, shortlist=100, block=7, visitors=3)
    got = {}
    for r in vector_search.search(table, F.col("vec_id") % 10 == 0, settings=s).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    full = np.vstack([x, np.ones((1, 16))])
    ids = np.append(np.arange(60), len(x) + len(ODD))
    want = {q: [i for i, _ in v] for q, v in nearest(full, ids, np.flatnonzero(ids % 10 == 0), 5).items()}
    assert got[0] == [10, 11, 12, 13, 14]
    assert {q: got[q] for q in got if q not in (0, 10)} == {q: want[q] for q in want if q not in (0, 10)}
    few = vector_search.search(table.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert len(few) == 2
    assert vector_search.search(table.where("vec_id >= 60 and vec_id < 66"), F.lit(True)).count() == 0


def test_copies_and_tight_clusters_crowd_nothing_out(spark):
    rng = np.random.default_rng(8)
    x, _ = clustered(2_000, seed=3)
    hot = rng.permutation(2_000)
    x[hot[:600]] = x[hot[0]]
    x[hot[700:760]] = x[hot[700]] * (1 + 1e-9 * rng.normal(size=(60, 16)))
    ids = np.arange(len(x))
    got = {}
    for r in vector_search.search(frame(spark, x, ids * 0), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = nearest(np.vstack([x, np.ones((1, 16))]), np.append(ids, len(x) + len(ODD)), np.flatnonzero(ids % 20 == 0), 5)
    copies = np.sort(hot[:600]).tolist()
    asked = [q for q in copies if q % 20 == 0]
    assert len(asked) > 10
    for q in asked:
        assert [i for i, _ in got[q]] == [i for i in copies if i != q][:5]
    scores = {q: ([s for _, s in got[q]], [s for _, s in want[q]]) for q in want if q in got}
    recall = np.mean([np.mean(np.array(a) >= np.array(b) - 1e-12) for a, b in scores.values()])
    print("recall with a hot group", recall)
    assert recall >= 0.9


def test_search_finds_the_nearest_in_clusters_at_production_settings(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(50, 64))[rng.integers(0, 50, 6_000)] + 0.35 * rng.normal(size=(6_000, 64))
    rows = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in vector_search.search(rows, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit[::50] @ unit.T
    near[np.arange(len(near)), np.arange(0, len(x), 50)] = -2
    best = np.argsort(-near, axis=1)[:, :5]
    assert np.mean([len(got[50 * k] & set(b.tolist())) / 5 for k, b in enumerate(best)]) >= 0.93


def test_search_is_complete_where_queries_are_unlike_the_other_rows(spark):
    """Nearly all rows lie in tight clusters, the queries and some others anywhere: the table's rows tell nothing of the queries'."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(40, 32))[rng.integers(0, 40, 3_000)] + 0.05 * rng.normal(size=(3_000, 32))
    x[::50] = rng.normal(size=(60, 32))
    rows = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in vector_search.search(rows, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = nearest(x, np.arange(len(x)), range(0, len(x), 50), 5)
    assert got == {q: [i for i, _ in v] for q, v in want.items()}
