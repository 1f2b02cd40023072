import numpy as np
import pytest

from strandwise.operators import metrics, mixture as X, runs
from strandwise.operators.scoring import score_reads
from strandwise.plans.reports import tumour_purity


@pytest.mark.parametrize("blocks", [(2, 2), (3, 4), (4096, 1024)])
def test_thin_curve_equals_walk(spark, blocks):
    rng, rows, want = np.random.default_rng(5), [], set()
    for run in "abcd":
        steps = np.unique(rng.integers(0, {"a": 400, "b": 3000, "c": 90, "d": 20000}[run], 300))
        kept = [steps[0]]
        for s in steps[1:]:
            if s - kept[-1] >= 10:
                kept.append(s)
        want |= {(run, int(s)) for s in [*kept, steps[-1]]}
        rows += [(run, int(s), float(s)) for s in steps]
    df = spark.createDataFrame(rows, "run string, step bigint, loss double")
    got = runs.thin_curve(df, 10, block_gaps=blocks[0], blocks=blocks[1]).collect()
    assert {(r["run"], r["step"]) for r in got} == want and len(got) == len(want)


def objective(theta, rows, margins):
    total = 0.0
    for t, p in rows:
        m, x = margins[t], theta[t]
        total += np.log((1 - x) * (1 - p) / (1 - m) + x * p / m)
    return total


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixture_proportions_is_the_maximum(spark, seed):
    rng = np.random.default_rng(seed)
    margins = {"A": 0.2, "B": 0.5, "C": 0.3}
    rows = [(t, float(np.clip(rng.beta(*shape), 0.01, 0.99))) for t, shape in (("A", (2, 5)), ("B", (4, 3)), ("C", (1, 3))) for _ in range(120)]
    df = spark.createDataFrame(rows, "dmr_ctype string, p_ctype double")
    got = {r["cell_type"]: r["pred"] for r in X.mixture_proportions(df, margins).collect()}
    assert sum(got.values()) == pytest.approx(1.0)
    best = objective(got, rows, margins)
    grid = np.linspace(0.001, 0.997, 15)
    for a in grid:
        for b in grid:
            if a + b < 0.999:
                assert objective({"A": a, "B": b, "C": 1 - a - b}, rows, margins) <= best + 1e-6
    for i, j in (("A", "B"), ("B", "C"), ("A", "C")):
        for d in (1e-4, -1e-4):
            moved = {**got, i: got[i] + d, j: got[j] - d}
            if min(moved.values()) > 0:
                assert objective(moved, rows, margins) <= best + 1e-9


@pytest.mark.parametrize("group_rows", [7, 10**6])
def test_region_grid_is_independent_of_the_cut(spark, group_rows):
    rng = np.random.default_rng(7)
    rows = [(i, i % 3, float(p), float(1 - p)) for i, p in enumerate(rng.uniform(0.05, 0.95, 90))]
    df = spark.createDataFrame(rows, "read_id int, dmr_label int, p_n double, p_t double")
    for r in X.mixture_grid_by_region(df, (0.5, 0.5), 50, group_rows=group_rows).collect():
        mine = np.array([(x[2], x[3]) for x in rows if x[1] == r["dmr_label"]]) / 0.5
        theta = np.arange(50) / 50
        ll = np.log(np.outer(mine[:, 0], 1 - theta) + np.outer(mine[:, 1], theta)).sum(axis=0)
        assert r["purity"] == theta[ll.argmax()] and r["loglik"] == pytest.approx(ll.max()) and r["fi"] == pytest.approx(np.var(np.diff(ll)))


def test_tumour_purity(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(1 - p), float(p)], int(p > 0.5), i % 4, "0212" if i % 5 else "2222") for i, p in enumerate(rng.beta(4, 2, 200))]
    scored = spark.createDataFrame(rows, "read_id int, probs array<double>, true_label int, dmr_label int, methyl_seq string")
    train = spark.createDataFrame([("N",)] * 6 + [("T",)] * 4, "ctype string")
    got = {r["cell_type"]: r["pred"] for r in tumour_purity(scored, train, 100).collect()}
    use = np.array([r[1] for r in rows if r[4] != "2222"]) / [0.6, 0.4]
    theta = np.arange(100) / 100
    ll = np.log(np.outer(use[:, 0], 1 - theta) + np.outer(use[:, 1], theta)).sum(axis=0)
    assert got["T"] == pytest.approx(theta[ll.argmax()]) and got["N"] == pytest.approx(1 - theta[ll.argmax()])
    by_region = {r["cell_type"]: r["pred"] for r in tumour_purity(scored, train, 100, by_region=True).collect()}
    assert 0 <= by_region["T"] <= 1 and by_region["T"] + by_region["N"] == pytest.approx(1)
    many = spark.createDataFrame([("A",), ("B",), ("C",)], "ctype string")
    assert sum(r["pred"] for r in tumour_purity(scored, many).collect()) == pytest.approx(1)
    with pytest.raises(ValueError):
        tumour_purity(scored, spark.createDataFrame([("A",)], "ctype string"))


def test_score_reads_loads_the_model_per_task(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], "id int, x double")
    out = score_reads(df, lambda: lambda pdf: np.stack([pdf["x"], -pdf["x"]], axis=1), ["x"], batch=7).collect()
    assert len(out) == 50 and all(r["pred"] == 0 and abs(sum(r["probs"]) - 1) < 1e-12 for r in out)


def test_metrics_of_absent_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 0)], "true_label int, pred int")
    got = {r["label"]: (r["precision"], r["recall"], r["f1"]) for r in metrics.class_report(df).collect()}
    assert got == {0: (0.5, 0.5, 0.5), 1: (0.0, 0.0, 0.0), 2: (0.0, 0.0, 0.0)}
    assert metrics.classification_metrics(df).first()["f1_macro"] == pytest.approx(0.166667)
