import numpy as np

from seriesloom.llm import cube_sample as cs
from seriesloom.runtime import table


def test_flight_keeps_sums_and_probabilities():
    rng = np.random.default_rng(1)
    group = rng.integers(0, 5, 400)
    pi = rng.random(400)
    out = cs.flight(group, pi, rng.integers(-(2**62), 2**62, 400))
    for g in range(5):
        assert np.isclose(out[group == g].sum(), pi[group == g].sum())
        assert ((out[group == g] > 1e-9) & (out[group == g] < 1 - 1e-9)).sum() <= 1
    mean = np.mean([cs.flight(np.zeros(10, int), np.linspace(0.1, 0.9, 10), rng.integers(-(2**62), 2**62, 10)) for _ in range(4000)], axis=0)
    assert np.abs(mean - np.linspace(0.1, 0.9, 10)).max() < 0.04


def test_landing_keeps_balance():
    rng = np.random.default_rng(2)
    for _ in range(50):
        member = rng.random((12, 3)) < 0.5
        pi = rng.random(12)
        out = cs.land(pi, member, rng)
        assert set(out) <= {0.0, 1.0}
        assert np.abs(member.T @ out - member.T @ pi).max() <= 3


def brute(labels, targets):
    keys, concepts, corpora = {}, {}, set()
    for r in labels:
        if r.corpus_id is None:
            continue
        corpora.add(r.corpus_id)
        i = (r.indicator or "").strip().lower()
        if not i or r.key is None:
            continue
        keys.setdefault(r.corpus_id, set()).add(r.key)
        if i == "other":
            if not (r.source or "").strip():
                continue
            i = f"{r.source.strip().lower()}-other"
        concepts.setdefault((r.corpus_id, i), set()).add(r.key)
    return {
        (t.scheme_id, c, t.concept): (len(concepts.get((c, t.concept.strip().lower()), ())), max(t.min_keep or 0, (t.target_share or 0) * (t.sample_fraction or 0) * len(keys.get(c, ()))))
        for t in targets for c in corpora
    }


def test_sample_on_the_tables(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.01")
    labels, targets = table(spark, d, "series_labels"), table(spark, d, "sample_targets")
    want = brute(labels.collect(), targets.collect())
    sample, demand = cs.draw(labels, targets)
    report = {(r.scheme_id, r.corpus_id, r.concept): r for r in cs.sample_report(sample, demand, table(spark, d, "per_concept_matched_n")).collect()}
    assert set(report) == set(want)
    for k, (have, wish) in want.items():
        r = report[k]
        assert r.n_avail == have and abs(r.wanted - wish) < 1e-6 and r.too_few == (have < wish - 1e-9)
        assert r.n_selected == min(have, int(np.ceil(wish - 1e-9))) or abs(r.residual) <= 2
    assert sum(r.residual != 0 for r in report.values()) <= 0.1 * len(report)
    rows = [tuple(r)[:3] for r in sample.collect()]
    assert len(rows) == len(set(rows))
    got = {tuple(r) for r in cs.shortfalls(cs.sample_report(sample, demand)).collect()}
    assert got == {k for k, (have, wish) in want.items() if have < wish - 1e-9}


def test_edges(spark):
    cols = "idx long, corpus_id int, source string, indicator string, timescale string, n_points int, key string, cost_max float, pi double, grp int"
    rows = [(1, 1, "s", " GDP", None, None, "a", None, 1.0, 1), (2, 1, "s", "gdp", None, None, "a", None, 1.0, 1), (3, 1, None, "other", None, None, "b", None, 1.0, 1), (4, 1, "S ", "Other", None, None, "c", None, 1.0, 1),
            (5, 2, "s", None, None, None, "d", None, 1.0, 1), (6, None, "s", "gdp", None, None, "e", None, 1.0, 1), (7, 1, "s", "gdp", None, None, None, None, 1.0, 1), (8, 1, "s", " ", None, None, "f", None, 1.0, 1), (9, 1, "s", "labor", None, None, "a", None, 1.0, 1)]
    labels = spark.createDataFrame(rows, cols)
    targets = spark.createDataFrame([(1, "gdp", 0.5, 1, 1.0), (1, "S-other", 0.5, None, None), (2, "labor", None, 1, 0.1), (None, "gdp", 0.1, 1, 0.1)], "scheme_id int, concept string, target_share double, min_keep int, sample_fraction double")
    sample, want = cs.draw(labels, targets)
    report = {(r.scheme_id, r.corpus_id, r.concept): (r.wanted, r.n_avail, r.n_selected, r.too_few) for r in cs.sample_report(sample, want).collect()}
    assert report == {(1, 1, "gdp"): (1.5, 1, 1, True), (1, 1, "S-other"): (0.0, 1, 0, False), (2, 1, "labor"): (1.0, 1, 1, False), (1, 2, "gdp"): (1.0, 0, 0, True), (1, 2, "S-other"): (0.0, 0, 0, False), (2, 2, "labor"): (1.0, 0, 0, True)}
    assert cs.draw(labels.limit(0), targets)[0].count() == 0
    sample, want = cs.draw(labels, targets.limit(0))
    assert sample.count() == 0 and want.count() == 0


def test_overlapping_categories(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 1, "s", c, None, None, f"k{i % 300}", None) for i, c in enumerate(rng.choice(["gdp", "labor", "trade"], 600))]
    labels = spark.createDataFrame([(int(a), b, c, str(d), e, f, g, h) for a, b, c, d, e, f, g, h in rows], "idx long, corpus_id int, source string, indicator string, timescale string, n_points int, key string, cost_max float")
    targets = spark.createDataFrame([(1, "gdp", 0.3, 1, 0.5), (1, "labor", 0.3, 1, 0.5), (1, "trade", 0.4, 1, 0.5)], "scheme_id int, concept string, target_share double, min_keep int, sample_fraction double")
    sample, want = cs.draw(labels, targets)
    assert all(abs(r.residual) <= 1 for r in cs.sample_report(sample, want).collect())


def test_shared_keys_do_not_overshoot(spark):
    keys = [("gdp", k) for k in range(400)] + [("inflation", k) for k in range(200)] + [("inflation", k) for k in range(400, 420)]
    labels = spark.createDataFrame([(i, 1, "s", c, None, None, f"k{k}", None) for i, (c, k) in enumerate(keys)], "idx long, corpus_id int, source string, indicator string, timescale string, n_points int, key string, cost_max float")
    targets = spark.createDataFrame([(1, "gdp", 0.1, 1, 1.0), (1, "inflation", 0.1, 1, 1.0)], "scheme_id int, concept string, target_share double, min_keep int, sample_fraction double")
    sample, want = cs.draw(labels, targets)
    report = cs.sample_report(sample, want).collect()
    assert [r.n_take for r in report] == [42, 42] and all(abs(r.residual) <= 1 for r in report)


def test_probabilities_hold_every_sum():
    rng = np.random.default_rng(4)
    for _ in range(200):
        member = rng.random((12, 4)) < 0.4
        member = member[member.any(1)]
        n = rng.integers(1, 50, len(member)).astype(float)
        avail = n @ member
        member, avail = member[:, avail > 0], avail[avail > 0]
        x = rng.random(len(member))
        take = (n * x) @ member  # a feasible demand
        got = cs.probabilities(n, member, take, avail)
        assert got.min() >= 0 and got.max() <= 1 and np.abs((n * got) @ member - take).max() < 0.01 * take.max() + 1e-6
