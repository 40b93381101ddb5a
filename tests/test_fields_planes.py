"""Vector fields and planes of delayed states against plain loops over the same sequences."""

import itertools

import duckdb
import numpy as np
import pytest

from lumenframe.operators import fields, planes
from lumenframe.operators.sequence import STANDARD

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sequences():
    rows = duckdb.sql(f"WITH {STANDARD.replace('FROM events', f''' FROM '{FOLDER}/events.parquet' ''')} SELECT user_id, t, x FROM z ORDER BY user_id, t").fetchall()
    return {u: np.array([r[2] for r in own]) for u, own in itertools.groupby(rows, lambda r: r[0])}


def blocks(x, size):
    return [(k, x[i : i + size]) for k, i in enumerate(range(0, len(x), size))]


def powers(z):
    x, y = z.T
    return np.stack([np.ones_like(x), x, y, x * x, x * y, y * y, x**3, x * x * y, x * y * y, y**3], 1)


@pytest.fixture(scope="module")
def pairs_by_split(sequences):
    out = {}
    for user, x in sequences.items():
        for k, own in blocks(x, fields.BLOCK):
            z = np.stack([own[:-1], own[1:]], 1)
            if len(z) > 1:
                out.setdefault((user % 5, {3: 1, 4: 2}.get(k % 5, 0)), []).append(((z[1:] + z[:-1]) / 2, z[1:] - z[:-1]))
    return {k: tuple(map(np.concatenate, zip(*v, strict=True))) for k, v in out.items()}


def ridge(z, d, terms, lam):
    """The same penalty as rows below the design: terms of unit variance, the constant free."""
    f = powers(z)[:, 1:terms]
    m, s = f.mean(0), f.std(0)
    design = np.concatenate([(f - m) / s, np.sqrt(lam * len(f)) * np.eye(terms - 1)])
    w = np.linalg.lstsq(design, np.concatenate([d - d.mean(0), np.zeros((terms - 1, 2))]), rcond=None)[0] / s[:, None]
    return np.concatenate([(d.mean(0) - m @ w)[None], w])


@pytest.fixture(scope="module")
def fitted(spark):
    return {(r["condition"], r["model"], r["lam"]): r for r in fields.fields(spark, FOLDER).collect()}


def test_fields_equal_least_squares_on_rows(fitted, pairs_by_split):
    assert len(fitted) == 5 * 2 * len(fields.LAMBDAS)
    for (condition, model, lam), r in fitted.items():
        w = ridge(*pairs_by_split[condition, 0], fields.MODELS[model], lam)
        assert np.reshape(r["w"], (-1, 2)) == pytest.approx(w, abs=1e-7)
        for split, name in ((1, "validation"), (2, "test")):
            z, d = pairs_by_split[condition, split]
            assert r[name] == pytest.approx(((d - powers(z)[:, : len(w)] @ w) ** 2).sum() / ((d - d.mean(0)) ** 2).sum(), abs=1e-7)


def test_the_best_penalty_on_validation_is_chosen(fitted):
    for condition, model in {k[:2] for k in fitted}:
        own = [fitted[condition, model, lam] for lam in fields.LAMBDAS]
        assert [r["lam"] for r in own if r["chosen"]] == [min(own, key=lambda r: (r["validation"], r["lam"]))["lam"]]


def test_rollouts_equal_a_loop(spark, fitted, sequences):
    want = {}
    for user, x in sequences.items():
        for k, own in blocks(x, fields.BLOCK):
            for i in range(len(own) - 2) if k % 5 == 4 else ():
                for model in fields.MODELS:
                    w = np.reshape(next(r["w"] for (c, m, _), r in fitted.items() if (c, m) == (user % 5, model) and r["chosen"]), (-1, 2))
                    f = lambda v, w=w: powers(v[None])[0, : len(w)] @ w
                    z = start = own[i : i + 2]
                    for h in range(1, min(fields.HORIZON, len(own) - 2 - i) + 1):
                        for _ in range(fields.SUBSTEPS):
                            e = 1 / fields.SUBSTEPS
                            a = f(z); b = f(z + e / 2 * a); c = f(z + e / 2 * b)  # noqa: E702
                            z = z + e / 6 * (a + 2 * b + 2 * c + f(z + e * c))
                            if not np.hypot(*z) <= fields.RADIUS:
                                z = np.full(2, np.nan)
                        n, bad, se, stay = want.get((user % 5, model, h), (0, 0, 0.0, 0.0))
                        truth, gone = own[i + h : i + h + 2], bool(np.isnan(z).any())
                        want[user % 5, model, h] = (n + 1, bad + gone, se + (0 if gone else ((z - truth) ** 2).sum()), stay + ((start - truth) ** 2).sum())
    got = {tuple(r[:3]): r[3:] for r in map(tuple, fields.field_rollouts(spark, FOLDER).collect())}
    assert set(got) == set(want) and len(got) > 20
    for key, (n, bad, se, stay) in want.items():
        assert got[key][:2] == (n, bad)
        assert got[key][2] == (pytest.approx(np.sqrt(se / (2 * (n - bad))), abs=1e-5) if n > bad else None) and got[key][3] == pytest.approx(np.sqrt(stay / (2 * n)), abs=1e-5)


def test_a_state_that_leaves_the_radius_has_failed():
    away = np.zeros((3, 2))
    away[1, 0] = away[2, 1] = 2.0
    z = fields.advance(away, np.array([[0.1, 0.0], [3.0, 0.0]]))
    assert z[0] == pytest.approx([0.1 * np.exp(2), 0], rel=1e-2) and np.isnan(z[1]).all()


def test_a_field_without_spread_or_rows():
    f = np.array([[1.0, 2, 0, 4, 0, 0, 8, 0, 0, 0, 0.5, 0]] * 5)
    w = fields.solve_field(f.T @ f, 10, 0.01)
    assert w[0] == pytest.approx([0.5, 0]) and not w[1:].any()
    assert np.isnan(fields.field_error(f.T @ f, w)) and np.isnan(fields.field_error(np.zeros((12, 12)), w))


@pytest.fixture(scope="module")
def delayed(sequences):
    """(midpoints, differences) by user and half."""
    out = {}
    k6 = planes.DIMS
    for user, x in sequences.items():
        for k, own in blocks(x, planes.BLOCK):
            z = np.array([own[i : i + k6] for i in range(len(own) - k6 + 1)])
            if len(z) > 1:
                out.setdefault((user, k % 2), []).append(((z[1:] + z[:-1]) / 2, z[1:] - z[:-1]))
    return {k: tuple(map(np.concatenate, zip(*v, strict=True))) for k, v in out.items()}


def joined(parts):
    parts = list(parts)
    return tuple(np.concatenate([p[k] for p in parts]) for k in (0, 1))


def skew_by_rows(x, d):
    """Least squares over a basis of skew matrices."""
    k, basis = x.shape[1], []
    for i in range(k):
        for j in range(i + 1, k):
            m = np.zeros((k, k))
            m[i, j], m[j, i] = 1, -1
            basis.append(m)
    c = np.linalg.lstsq(np.stack([(x @ m.T).ravel() for m in basis], 1), d.ravel(), rcond=None)[0]
    return np.tensordot(c, basis, 1)


def projectors(m):
    """Of the two fastest planes, by the imaginary eigenvalues."""
    values, vectors = np.linalg.eig(m)
    order = [k for k in np.argsort(-values.imag) if values[k].imag > 0][:2]
    return [2 * np.real(np.outer(vectors[:, k], vectors[:, k].conj())) for k in order], [values[k].imag for k in order]


def angle(p, q):
    """Largest angle of two planes, by the spectrum of the product of their projectors."""
    return np.degrees(np.arccos(np.sqrt(np.clip(np.sort(np.linalg.eigvals(p @ q).real)[-2], 0, 1))))


def test_skew_from_sums_equals_rows(delayed):
    for x, d in delayed.values():
        if len(x) >= planes.DIMS:
            assert planes.skew_from_sums(x.T @ x, d.T @ x) == pytest.approx(skew_by_rows(x, d), abs=1e-7)


def test_planes_by_user(spark, delayed, sequences):
    got = {(r["user_id"], r["plane"]): r for r in planes.delay_planes(spark, FOLDER).collect()}
    assert len(got) == 2 * len(sequences) and any(r["status"] == "ok" for r in got.values())
    for user in sequences:
        x, d = joined(v for k, v in delayed.items() if k[0] == user)
        if len(x) < planes.LEAST:
            assert {got[user, k]["status"] for k in (0, 1)} == {"inapplicable"}
            continue
        m = skew_by_rows(x, d)
        wanted, rates = projectors(m)
        for k in (0, 1):
            r = got[user, k]
            q = np.array([[r[f"{c}{i}"] for i in range(planes.DIMS)] for c in "uv"])
            assert q.T @ q == pytest.approx(wanted[k], abs=1e-4)
            assert abs(r["rate"]) == pytest.approx(rates[k], abs=1e-5)
            assert r["share"] == pytest.approx(((x @ wanted[k]) ** 2).sum() / (x**2).sum(), abs=1e-5)
            assert r["explained"] == pytest.approx(1 - ((d - x @ m.T) ** 2).sum() / (d**2).sum(), abs=1e-5)
            assert q[0][np.abs(q[0]).argmax()] > 0 and q[1] @ m @ q[0] > 0  # the orientation: the second is where the first turns to


def check_match(got, own, other):
    a, b = (projectors(skew_by_rows(*v))[0] for v in (own, other))
    total = [angle(a[0], b[0]) + angle(a[1], b[1]), angle(a[0], b[1]) + angle(a[1], b[0])]
    assert [r["matched"] for r in got] == ([0, 1] if total[0] <= total[1] else [1, 0])
    assert sum(r["max_angle"] for r in got) == pytest.approx(min(total), abs=1e-3)
    for k, r in enumerate(got):
        assert r["projector"] == pytest.approx(np.linalg.norm(a[k] - b[r["matched"]]), abs=1e-4)


def test_halves_and_others_are_matched(spark, delayed, sequences):
    halves, others = ({u: sorted(v, key=lambda r: r["plane"]) for u, v in itertools.groupby(sorted(q(spark, FOLDER).collect(), key=lambda r: r["user_id"]), lambda r: r["user_id"])} for q in (planes.plane_stability, planes.plane_match))
    none = (np.zeros((0, planes.DIMS)),) * 2
    seen = 0
    for user in sequences:
        one, two = (delayed.get((user, h), none) for h in (0, 1))
        if min(len(one[0]), len(two[0])) < planes.LEAST:
            assert {r["status"] for r in halves[user]} == {"inapplicable"}
        else:
            check_match(halves[user], one, two)
        own, rest = joined([one, two]), joined(v for k, v in delayed.items() if k[0] != user and k[0] % 5 == user % 5)
        if min(len(own[0]), len(rest[0])) >= planes.LEAST:
            check_match(others[user], own, rest)
            seen += 1
    assert seen > 5
