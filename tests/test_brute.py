"""Solves and bootstraps against brute force over small tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealedger.operators import forecast, hedonic, ledger, nowcast, panel, support, vintage


def drawn(*parts):
    """The number of hedonic.drawn before its remainder."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def sales(spark):
    rng, rows = random.Random(1), []
    for g in range(2):
        for d in range(3):
            for c in range(4):
                for _ in range(rng.randint(3, 14)):
                    q = rng.choice([0, 1, 2, 3, 5, 6])
                    rows.append((f"g{g}", f"g{g}_d{d}", f"g{g}_d{d}_c{c}", 8000 + q, c * 0.2 + 0.05 * q + rng.gauss(0, 0.1), len(rows)))
    return rows, spark.createDataFrame(rows, "sgg_cd string, dong string, cell string, q int, log_ppm2 double, order_no int")


@pytest.mark.parametrize("cells, origin", [(20_000, None), (2, [8003])])
def test_hedonic_equals_full_least_squares(spark, monkeypatch, cells, origin):
    monkeypatch.setattr(hedonic, "CELLS", cells)  # a dong's cells in one part, and in several
    rows, df = sales(spark)
    got = {(r["dong"], r["q"]): r for r in hedonic.hedonic_index(df, 5.0, origin).collect()}
    for g in ("g0", "g1"):
        own = [r for r in rows if r[0] == g and r[3] <= (origin or [8006])[0]]
        cs, qs, dq = (sorted({f(r) for r in own}) for f in (lambda r: r[2], lambda r: r[3], lambda r: (r[1], r[3])))
        x, y = np.zeros((len(own) + len(dq), len(cs) + len(qs) + len(dq))), np.zeros(len(own) + len(dq))
        for i, r in enumerate(own):
            x[i, [cs.index(r[2]), len(cs) + qs.index(r[3]), len(cs) + len(qs) + dq.index((r[1], r[3]))]] = 1
            y[i] = r[4]
        x[len(own) :, len(cs) + len(qs) :] = np.sqrt(5) * np.eye(len(dq))
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        level, dev = b[len(cs) : len(cs) + len(qs)], b[len(cs) + len(qs) :]
        for k, v in zip(dq, dev):
            assert got[k]["dq_effect"] == pytest.approx(v, abs=1e-8)
        for dong in {k[0] for k in dq}:
            change = [got[dong, q]["gq_effect"] - got[dong, qs[0]]["gq_effect"] for q in qs]
            assert change == pytest.approx(list(level - level[0]), abs=1e-8)
            assert all(got[dong, q]["dq_effect"] == 0 for q in qs if (dong, q) not in dq)


def test_vintages_equal_refits(spark):
    _, df = sales(spark)
    many = hedonic.hedonic_index(df, 5.0, [8002, 8005])
    for o in (8002, 8005):
        alone = hedonic.hedonic_index(df.where(F.col("q") <= o), 5.0).select("dong", "q", F.col("dq_effect").alias("x"))
        gap = many.where(F.col("origin") == o).join(alone, ["dong", "q"]).agg(F.max(F.abs(F.col("dq_effect") - F.col("x")))).first()[0]
        assert gap < 1e-9
    full = vintage.residual_index(df, 8002, 8006)
    part = vintage.residual_index(df.where("q <= 8003"), 8003, 8003).select("dong", "q", F.col("log_index").alias("x"))
    assert full.where("origin = 8003").join(part, ["dong", "q"]).where(F.abs(F.col("log_index") - F.col("x")) > 1e-9).count() == 0


def test_repeat_sales_equals_damped_least_squares(spark):
    rng = random.Random(3)
    pairs = [("d", *sorted(rng.sample(range(6), 2)), rng.gauss(0, 1)) for _ in range(30)]
    got = {r["q"]: r["repeat_index"] for r in hedonic.repeat_sales_index(spark.createDataFrame(pairs, "dong string, q0 int, q int, change double")).collect()}
    qs = sorted({x for p in pairs for x in p[1:3]})
    x, y = np.zeros((len(pairs) + len(qs), len(qs))), np.zeros(len(pairs) + len(qs))
    for i, (_, a, z, c) in enumerate(pairs):
        x[i, qs.index(z)], x[i, qs.index(a)], y[i] = 1, -1, c
    x[len(pairs) :] = 1e-4 * np.eye(len(qs))
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    assert [got[q] for q in qs] == pytest.approx(list(want), abs=1e-5)


def test_block_bootstrap_equals_its_draws(spark):
    rng = random.Random(5)
    rows = [(f"d{i % 7}", rng.random(), rng.random()) for i in range(60)]
    r = hedonic.block_bootstrap(spark.createDataFrame(rows, "dong string, a double, b double"), "dong", "a", "b", 40, 1).first()
    units = sorted({x[0] for x in rows})
    s, n = ([sum(f(x) for x in rows if x[0] == u) for u in units] for f in (lambda x: x[1] - x[2], lambda x: 1))
    draws = []
    for d in range(40):
        picks = [drawn(1, d, k) % 7 for k in range(7)]
        draws.append(sum(s[p] for p in picks) / sum(n[p] for p in picks))
    assert (r["low"], r["high"], r["mean"]) == pytest.approx((np.percentile(draws, 2.5), np.percentile(draws, 97.5), sum(s) / sum(n)))


def test_moving_blocks_skip_gaps(spark):
    series = [(i, None if i == 4 else float(i * i % 7)) for i in range(11)]
    r = forecast.moving_block_bootstrap(spark.createDataFrame(series, "pos int, value double"), 3, 50, 42).first()
    v = dict(series)
    starts = [i for i in range(9) if all(v.get(i + k) is not None for k in range(3))]
    means = []
    for d in range(50):
        at = [starts[drawn(42, d, k) % len(starts)] + o for k in range(4) for o in range(3) if 3 * k + o < 11]
        means.append(np.mean([v[p] for p in at]))
    assert (r["low"], r["high"], r["draws"]) == pytest.approx((np.percentile(means, 2.5), np.percentile(means, 97.5), 50))


def test_revision_model_equals_least_squares(spark):
    rng = random.Random(6)
    rows = [(q, d, rng.random(), rng.random(), rng.gauss(0, 1)) for q in range(12) for d in range(5)]
    df = spark.createDataFrame(rows, "q int, dong int, a double, b double, revision double")
    got = {(r["q"], r["dong"]): r["correction"] for r in nowcast.revision_model(df, ["a", "b"], least=8).collect()}
    assert {q for q, _ in got} == {8, 9, 10, 11}
    for q in range(8, 12):
        past = np.array([[1, r[2], r[3], r[4]] for r in rows if r[0] < q])
        c = np.linalg.lstsq(past[:, :3], past[:, 3], rcond=None)[0]
        for r in rows:
            if r[0] == q:
                assert got[q, r[1]] == pytest.approx(c @ [1, r[2], r[3]], abs=1e-8)
    score = nowcast.revision_score(nowcast.revision_model(df.withColumn("visible", F.lit(31)), ["a", "b"], least=8)).first()
    each = [np.mean([abs(r[4] - got[q, r[1]]) for r in rows if r[0] == q]) for q in range(8, 12)]
    assert score["corrected"] == pytest.approx(np.mean(each))


def test_rolling_ridge_equals_fits_on_known_origins(spark):
    rng = random.Random(8)
    rows = [(q, d, rng.random(), None if q > 9 else rng.gauss(0, 1)) for q in range(12) for d in range(6)]
    got = {(r["q"], r["d"]): r["pred"] for r in forecast.rolling_ridge(spark.createDataFrame(rows, "q int, d int, x double, y double"), ["x"], "y", 1.0, 2, 3).collect()}
    for q in range(12):
        past = np.array([r[2:] for r in rows if r[0] + 2 <= q and r[3] is not None], float)
        if len({r[0] for r in rows if r[0] + 2 <= q and r[3] is not None}) < 3:
            assert all(got[q, d] is None for d in range(6))
            continue
        m, s = past[:, 0].mean(), past[:, 0].std()
        z = (past[:, 0] - m) / s
        c = (z @ (past[:, 1] - past[:, 1].mean())) / (z @ z + 1)
        for r in rows:
            if r[0] == q:
                assert got[q, r[1]] == pytest.approx(past[:, 1].mean() + (r[2] - m) / s * c, abs=1e-8)


def test_thin_dongs(spark):
    """Dongs under 20 sales a year aren't eligible, carry a flag, and their peaks are hidden."""
    rows = [("g_a", 8000 + q, "a-1") for q in range(20) for _ in range(6)] + [("g_b", 8000 + q, "b-1") for q in range(20)]
    df = spark.createDataFrame(rows, "dong string, q int, apt_seq string")
    got = {(r["dong"], r["q"]): r["eligible"] for r in ledger.eligible(df, 8000, 8019).collect()}
    assert got["g_a", 8003] and not got["g_a", 8002] and not got["g_b", 8019]
    index = spark.createDataFrame([(d, 8000 + q, 1.0 + 0.01 * q * k, e) for d, k, e in (("g_a", 1, 0.001), ("g_b", -1, 0.05)) for q in range(20)], "dong string, q int, log_index double, log_index_se double")
    peaks = {r["dong"]: r for r in support.peak_states(index, 8019).collect()}
    assert peaks["g_a"]["peak_state"] == "AT_PEAK" and peaks["g_b"]["peak_q"] == 8000 and peaks["g_b"]["peak_gap"] == pytest.approx(-0.19)
    changes = {r["dong"]: r for r in support.change_states(index, spark.createDataFrame([("g_a", 3), ("g_b", 1)], "dong string, w int"), 8019).collect()}
    assert changes["g_a"]["mu"] == pytest.approx(0.02) and changes["g_a"]["delta_state"] == "DISTINGUISHABLE" and changes["g_b"]["delta_state"] == "INDISTINGUISHABLE"


def test_clusters_and_agreement(spark):
    rng = random.Random(2)
    rows = [(f"d{i}", float(10 * (i % 4)) + rng.random(), float(i % 2) * 20 + rng.random()) for i in range(80)]
    got = hedonic.structure_clusters(spark.createDataFrame(rows, "dong string, a double, b double"), ["a", "b"], ks=(4,), tries=3).collect()
    assert len({(int(r["dong"][1:]) % 4, r["cluster"]) for r in got}) == 4
    assert hedonic.structure_clusters(spark.createDataFrame(rows[:49], "dong string, a double, b double"), ["a", "b"]).count() == 0
    k = hedonic.choose_k(spark.createDataFrame([(4, 0.9), (4, 0.5), (5, 0.8), (5, 0.6), (6, 0.7), (6, 0.2)], "k int, ari double")).first()["k"]
    assert k == 5
    moves = vintage.adjacent_labels(spark.createDataFrame([(1, "a", 0), (1, "b", 1), (3, "a", 1), (3, "c", 0)], "as_of int, dong string, cluster int"))
    assert [tuple(r) for r in moves.collect()] == [(3, "a", 0, 1)]
    same = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1)], "a int, b int")
    assert panel.adjusted_rand(same, "a", "b").first()["ari"] == 1.0


def test_support_checks_find_what_breaks(spark):
    cols = "dong string, as_of int, sale_n bigint, n_complexes bigint, dominant_share double, index_se double, se_band string, flags string, change double, mu double, delta double, delta_se double, delta_state string, peak_gap double, peak_gap_se double, peak_state string, structure_type int, structure_desc string, peers string"
    good = ("g_a", 1, 30, 2, 0.4, 0.01, "LOW", "", 0.1, 0.05, 0.05, 0.02, "DISTINGUISHABLE", -0.1, 0.02, "DISTINGUISHABLE", 1, "x", "g_b:r")
    other = ("g_b", 1, 30, 2, 0.4, 0.01, "LOW", "", 0.0, 0.05, -0.05, 0.02, "DISTINGUISHABLE", None, None, None, None, None, None)
    weights = spark.createDataFrame([("g_a", 1), ("g_b", 1)], "dong string, w int")
    assert support.check_support(spark.createDataFrame([good, other], cols), weights).count() == 0
    bad = ("g_c", 1, 0, 2, 0.4, 0.01, "LOW", "FEW_SALES", 0.1, 0.05, 0.06, 0.001, None, 0.1, 0.02, "AT_PEAK", 1, None, "g_z:r|g_c:r")
    found = {r["rule"] for r in support.check_support(spark.createDataFrame([good, other, bad, bad], cols), weights).collect()}
    assert len(found) == 10, found
    assert [r["dong"] for r in support.recount(spark.createDataFrame([good, other], cols), spark.createDataFrame([("g_a", 31, 2, 0.4), ("g_b", 30, 2, 0.4)], "dong string, sale_n bigint, n_complexes bigint, dominant_share double")).collect()] == ["g_a"]
    assert [tuple(r) for r in support.same_gu_report(spark.createDataFrame([good], cols), 1).collect()] == [("g_a", 1)]
