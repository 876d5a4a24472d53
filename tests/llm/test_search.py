import numpy as np
import pytest

from tilewright.llm import ann, blocks, topk

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def table(spark, x, bad=True):
    rows = [(i, [float(v) for v in r], 1, "s") for i, r in enumerate(x)]
    if bad:
        rows += [(1000, None, 1, "s"), (2000, [1.0, None], 1, "s"), (3000, [float("nan")] * 4, 1, "s"), (4000, [float("inf"), 1.0], 1, "s"), (5000, [], 1, "s")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("width", [64, 5])
def test_top_k(spark, width):
    x = np.random.default_rng(0).normal(size=(230, width)).astype("f4")
    x[100:140] = x[0]  # ties
    z = np.floor(x.astype(float) * 256).astype(int)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_top_k(table(spark, x)).collect()]
    expect = []
    for q in range(0, 230, 50):
        s = z @ z[q]
        order = sorted((i for i in range(230) if i != q), key=lambda i: (-s[i], i))[:5]
        expect += [(q, n, i, s[i]) for n, i in enumerate(order, 1)]
    assert sorted(got) == sorted(expect)


def test_top_k_small_tables_and_huge_values(spark):
    assert topk.exact_top_k(table(spark, np.zeros((0, 4)))).count() == 0
    got = topk.exact_top_k(table(spark, np.array([[3e18, 1], [2e18, 1], [1, 1]], "f4"), bad=False)).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [1, 2]


def test_bounds_hold():
    rng = np.random.default_rng(4)
    q, x = rng.normal(size=(20, 64)), rng.normal(size=(300, 64)) + rng.normal(size=(300, 1))
    for s in topk.LEVELS:
        assert (topk.statistics(q, s) @ topk.statistics(x, s).T >= q @ x.T - 1e-9).all()


@pytest.mark.parametrize(("bits", "sub_bits"), [(64, 21), (64, 16), (50, 8)])
def test_index_finds_every_code_within_the_radius(bits, sub_bits):
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << bits, 500, dtype=np.uint64)
    for i in range(1, 200):
        codes[i] = codes[0] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, bits, i // 6 + 1, dtype=np.uint64))
    index = ann.Index(codes, bits, sub_bits)
    for radius in (0, 1, 2, 5, 12, 20, 28, bits):
        d = ann.hamming(codes[0], codes)
        assert index.within(codes[0], radius).tolist() == np.flatnonzero(d <= radius).tolist()


def test_probing_prunes():
    """On clusters the share of rows that probing retrieves falls as the table grows by more clusters."""
    shares = []
    for clusters in (10, 40):
        rng = np.random.default_rng(7)
        x = np.repeat(rng.normal(size=(clusters, 64)), 60, axis=0) + rng.normal(size=(clusters * 60, 64)) * 0.2
        model, radius = ann.fit(x, 10)
        codes = ann.encode(x, model)
        index = ann.Index(codes)
        shares.append(np.mean([len(index.probed(c, radius)) / len(x) for c in codes[::37]]))
    assert shares[1] < 0.5 * shares[0] < 0.25


@pytest.mark.parametrize("piece", [16, 1024])
def test_repeated_ids(spark, monkeypatch, piece):
    """Rows that share an id are queries and candidates each for itself, over pieces and parts of any size."""
    monkeypatch.setattr(blocks, "CANDIDATE_ROWS", piece)
    monkeypatch.setattr(blocks, "QUERY_ROWS", 8)
    x = np.random.default_rng(9).normal(size=(160, 16)).astype("f4")
    ids = [i // 2 * 10 for i in range(160)]
    x[20:24] = x[20]
    df = spark.createDataFrame([(i, [float(v) for v in r], 1, "s") for i, r in zip(ids, x, strict=True)], SCHEMA).repartition(3)
    z = np.floor(x.astype(float) * 256).astype(int)
    expect, near = [], []
    for q in range(160):
        others = [i for i in range(160) if i != q]
        if ids[q] % 50 == 0:
            s = z @ z[q]
            expect += [(ids[q], n, ids[i], s[i]) for n, i in enumerate(sorted(others, key=lambda i: (-s[i], ids[i]))[:5], 1)]
        if ids[q] % 100 == 0:
            d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
            near += [(ids[q], n, round(d[i], 9)) for n, i in enumerate(sorted(others, key=lambda i: (d[i], ids[i]))[:10], 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(df).collect()) == sorted(expect)
    got = sorted((r.query_id, r["rank"], round(r.score, 9)) for r in ann.nearest(df).collect())
    assert [g[:2] for g in got] == [n[:2] for n in sorted(near)] and len(set(got) & set(near)) >= 0.9 * len(set(near))


def test_recall_and_ties(spark):
    x = np.random.default_rng(6).normal(size=(900, 64)).astype("f4")
    x[300:330] = x[100]
    x[7] = 0
    got = {}
    for r in ann.nearest(table(spark, x)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        order = sorted((i for i in range(900) if i not in (q, 7)), key=lambda i: (d[i], i))[:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(abs(s - d[i]) < 1e-12 for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & set(order))
        total += 10
    assert hits / total >= 0.9
    assert [i for _, i, _ in sorted(got[100])] == list(range(300, 310))


def test_few_candidates(spark):
    x = np.eye(4, dtype="f4")
    assert len(ann.nearest(table(spark, x)).collect()) == 3
    assert ann.nearest(table(spark, np.zeros((3, 4)))).count() == 0
