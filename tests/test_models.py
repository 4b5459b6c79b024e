"""Models fitted together against plain fits, one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstone.operators import learning as ML
from turnstone.operators import models as MD


def blobs(n=160, dims=5, kinds=4, seed=2):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(kinds, dims)) * 3
    return [(i, (middle[i % kinds] + rng.normal(size=dims)).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    rows = blobs() + [(900, None), (901, [float("nan")] * 5), (902, [])]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(3)


def plain_fit(m, centres, enough, rounds=100):
    for _ in range(rounds):
        label = ((m[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        now = np.array([m[label == c].mean(axis=0) if (label == c).any() else centres[c] for c in range(len(centres))])
        moved, centres = ((now - centres) ** 2).sum(), now
        if moved <= enough:
            break
    return centres, ((m[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_starts_and_ks_fitted_together_equal_single_fits(frame):
    rows = MD.vector_rows(frame, "id", "v")
    assert rows.count() == 160
    m = np.array([v for _, v in blobs()])
    specs = [(2, 42), (4, 42), (4, 43), (7, 42)]
    got = MD.fitted(rows, specs, starts=3)
    tags = [(s, i) for s in (42, 43) for i in range(3)]
    pools = dict(zip(tags, MD._pools(rows, tags, MD.POOL * 7)))
    assert all({tuple(x) for x in p} <= {tuple(x) for x in m} for p in pools.values())
    enough = 1e-4 * m.var(axis=0).mean()
    for (k, seed), model in zip(specs, got):
        want = min((plain_fit(m, MD.first_centres(pools[seed, s], k, seed, s), enough) for s in range(3)), key=lambda x: x[1])
        assert abs(model.inertia - want[1]) < 1e-6 * want[1] and np.allclose(model.centres, want[0])
    label = {r.id: r.cluster for r in MD.assigned(frame.where("id <> 901 and id <> 902"), "v", got[1]).collect()}
    assert label[900] is None and all(label[i] == ((m[i] - got[1].centres) ** 2).sum(axis=1).argmin() for i in range(160))
    with pytest.raises(ValueError):
        MD.fitted(rows.limit(0), specs)


def test_sweep_figures_equal_plain_ones(frame):
    got = MD.swept(frame, "id", "v", range(3, 6), starts=2)
    m = np.array([v for _, v in blobs()])
    u = m / np.sqrt((m * m).sum(axis=1))[:, None]
    far = 1 - u @ u.T
    other = {k: x for k, x in zip(range(3, 6), MD.fitted(MD.vector_rows(frame, "id", "v"), [(k, 43) for k in range(3, 6)], 2))}
    for r in got:
        label = ((m[:, None] - r["model"].centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        scores = []
        for i in range(len(m)):
            mean = {c: far[i][label == c].sum() / max(1, (label == c).sum() - (c == label[i])) for c in set(label)}
            a, b = mean[label[i]], min(x for c, x in mean.items() if c != label[i])
            scores.append((b - a) / max(a, b) if (label == label[i]).sum() > 1 else 0.0)
        assert abs(r["silhouette"] - np.mean(scores)) < 1e-9
        assert abs(r["min_share"] - np.bincount(label).min() / len(m)) < 1e-12
        second = ((m[:, None] - other[r["k"]].centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        same = lambda x: x[:, None] == x[None]
        up = np.triu_indices(len(m), 1)
        both, a, b, n = (same(label) & same(second))[up].sum(), same(label)[up].sum(), same(second)[up].sum(), len(up[0])
        assert abs(r["seed_ari"] - (both - a * b / n) / ((a + b) / 2 - a * b / n)) < 1e-9
    assert ML.chosen_k(got) in (3, 4, 5)


TEXTS = [("en", "the train is late and the seat is lost"), ("en", "late train the refund"), ("fr", "le train est en retard et la place"), ("fr", "retard le remboursement"), ("de", "der zug ist spat"), ("de", "zug und platz verloren")]


def words():
    return F.split("text", " ")


def labelled(spark):
    rows = [(i, TEXTS[i % 6][0], " ".join(TEXTS[i % 6][1].split()[: 1 + i % 5])) for i in range(90)] + [(200, None, "unlabelled"), (201, "en", None), (202, "fr", "")]
    return spark.createDataFrame(rows, "id long, label string, text string").repartition(3)


def loss_of(z, y, w, coef, bias, c):
    logits = z @ coef + bias
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    return -(w * np.log(p[np.arange(len(y)), y])).sum() / w.sum() + (coef**2).sum() / (2 * c * w.sum()), p


def test_a_grid_of_c_reaches_each_minimum(spark):
    width, cs = 256, [0.1, 1.0, 10.0]
    docs = labelled(spark).where("label is not null").select("id", "text", (F.array_position(F.array(F.lit("de"), F.lit("en"), F.lit("fr")), F.col("label")).cast("int") - 1).alias("y"), (F.lit(1.0) + F.col("id") % 2).alias("w"))
    counted = MD.hashed(docs, words(), "id", "y", "w", width=width)
    rows = MD.term_weights(counted, width=width).of(counted)
    data = rows.orderBy("id").collect()
    z = np.zeros((len(data), width))
    for i, r in enumerate(data):
        z[i, r.at] = r.x
    assert np.allclose([x for x in (z * z).sum(axis=1) if x], 1)
    y, w = np.array([r.y for r in data]), np.array([r.w for r in data])
    for c, (coef, bias) in zip(cs, MD.logistic_grid(rows.select("y", "w", "at", "x"), 3, cs, width, rounds=200, tol=1e-9)):
        best, flat = np.zeros((width, 3)), np.zeros(3)
        for _ in range(6000):  # plain descent
            p = loss_of(z, y, w, best, flat, c)[1]
            p[np.arange(len(y)), y] -= 1
            g = (p * w[:, None]) / w.sum()
            best, flat = best - 1.5 * (z.T @ g + best / (c * w.sum())), flat - 1.5 * g.sum(axis=0)
        want, got = loss_of(z, y, w, best, flat, c)[0], loss_of(z, y, w, coef, bias, c)[0]
        assert got <= want + 1e-5
        assert np.abs(coef - best).max() < 0.05 * max(1.0, np.abs(best).max())


def test_tuned_classifier(spark):
    docs = labelled(spark)
    model = MD.tuned(docs.where("id % 3 <> 0"), docs.where("id % 3 = 0"), words(), "label", width=512)
    assert model.labels == ["de", "en", "fr"] and sorted(model.dev_f1) == [0.1, 0.3, 1.0, 3.0, 10.0]
    assert model.c == min(c for c, f in model.dev_f1.items() if round(f, 12) == round(max(model.dev_f1.values()), 12))
    said = {r.id: (r.label, r.predicted) for r in model.predicted(docs, words(), "id", "label").collect()}
    assert len(said) == 93 and sum(a == b for i, (a, b) in said.items() if i < 90) > 75
    for c in model.dev_f1:  # macro F1 of the chosen C by hand
        if c == model.c:
            dev = [said[i] for i in said if i % 3 == 0 and said[i][0] is not None]
            golds = sorted({g for g, _ in dev})
            f1 = [2 * sum(g == s == t for g, s in dev) / (sum(g == t for g, _ in dev) + sum(s == t for _, s in dev)) for t in golds]
            assert abs(model.dev_f1[c] - sum(f1) / len(f1)) < 1e-12
    with pytest.raises(ValueError):
        MD.tuned(docs.limit(0), docs, words(), "label")
