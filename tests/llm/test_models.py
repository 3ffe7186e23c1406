"""The learned models' numbers against enumeration and finite differences, apart from the code that trains them."""

from itertools import product

import numpy as np

from quern.llm import html, toxicity


def test_the_risk_is_the_stated_one():
    """Adam on finite differences of the risk as the docstring states it comes to the same weights, through both branches."""
    r = np.random.default_rng(3)
    x = (r.random((14, 3)) < 0.6).astype(float)
    positive = np.arange(14) < 5
    x[positive, 0], x[~positive, 0] = 1, [0, 0, 1, 0, 0, 1, 0, 0, 0]
    prior, decay, rate = 0.6, 2e-4, 0.3
    loss = lambda z: np.logaddexp(0, -z)
    branches = set()

    def risk(v):
        z = x @ v[:-1] + v[-1]
        first, rest = prior * loss(z[positive]).mean(), loss(-z[~positive]).mean() - prior * loss(-z[positive]).mean()
        return first, rest, decay / 2 * (v[:-1] ** 2).sum()

    def slope(v):
        h, out = 1e-3, np.zeros(len(v))
        negative = risk(v)[1] < 0
        branches.add(negative)
        value = lambda parts: parts[2] - parts[1] if negative else sum(parts)
        for i in range(len(v)):
            at = lambda k: value(risk(v + np.eye(len(v))[i] * k * h))  # noqa: B023, E731
            out[i] = (8 * (at(1) - at(-1)) - (at(2) - at(-2))) / (12 * h)
        return out

    v = np.array([0, 0, 0, np.log(prior / (1 - prior))])
    m = s = np.zeros(4)
    for t in range(1, 41):
        g = slope(v)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        v = v - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    rows, columns = np.nonzero(x)
    w, b = toxicity.fit(rows, columns, positive, 3, prior, steps=40, rate=rate, decay=decay)
    assert branches == {True, False}
    assert np.allclose([*w, b], v, atol=1e-3)


def test_a_score_is_the_logistic_of_its_weights():
    model = toxicity.Model({b"bad$": 2.0, b"awfu": 1.5, b"good$": -1.0}, -0.5)
    for text, z in (("Bad bad!", 1.5), ("awful GOOD", 0.0), ("", -0.5), (None, -0.5), ("badly", -0.5), ("x" * 100_000 + " bad", 1.5)):
        assert abs(model.score(None if text is None else text.encode()) - 1 / (1 + np.exp(-z))) < 1e-12


def likelihoods(gain, between, start):
    """Of every labelling: (labels, its exponent)."""
    out = []
    for labels in product((0, 1), repeat=len(gain)):
        e = start[labels[0]] + sum(g for g, y in zip(gain, labels, strict=True) if y) + sum(between[a, b] for a, b in zip(labels, labels[1:], strict=False))
        out.append((labels, e))
    return out


def test_marginals_by_enumeration():
    r = np.random.default_rng(5)
    lengths = [5, 1, 3]
    gain, between, start = r.normal(size=(3, 5)), r.normal(size=(2, 2)), r.normal(size=2)
    real = np.arange(5)[None, :] < np.array(lengths)[:, None]
    marg, pair = html._marginals(gain, between, start, real)
    for i, n in enumerate(lengths):
        found = likelihoods(gain[i, :n], between, start)
        weights = np.exp([e for _, e in found])
        weights /= weights.sum()
        for t in range(n):
            assert np.isclose(marg[i, t, 1], sum(p for p, (y, _) in zip(weights, found, strict=True) if y[t]))
            for a, b in product((0, 1), repeat=2) if t + 1 < n else ():
                assert np.isclose(pair[i, t, a, b], sum(p for p, (y, _) in zip(weights, found, strict=True) if (y[t], y[t + 1]) == (a, b)))
        assert not marg[i, n:].any() and not pair[i, n - 1 :].any()


def test_fit_ends_where_the_likelihood_is_flat():
    """At its end the slope of the enumerated likelihood is what the decay takes back."""
    pages = [html.blocks_of(p) for p in (
        "<nav data-main='0'><a>one</a></nav><p data-main='1'>Some text of the page, at length.</p><footer>end</footer>",
        "<p data-main='1'>Another text.</p><p data-main='1'>More of it, still.</p><aside>links</aside>",
        "<div class='menu'><a>x</a></div><p>no article here</p>",
    )]
    decay = 0.05
    field = html.fit(pages, steps=3000, rate=0.02, decay=decay)

    def total(weights, between):
        out = 0.0
        for page in pages:
            gain = [sum(weights.get(f, 0.0) for f in html.features_of(b, n, len(page))) for n, b in enumerate(page)]
            found = dict(likelihoods(gain, between, field.start))
            out += found[tuple(int(b.label == "1") for b in page)] - np.logaddexp.reduce(list(found.values()))
        return out / len(pages)

    eps = 1e-5
    for name in list(field.weights)[:12]:
        up, down = ({**field.weights, name: field.weights[name] + d} for d in (eps, -eps))
        assert abs((total(up, field.between) - total(down, field.between)) / (2 * eps) - decay * field.weights[name]) < 2e-3
    for a, b in product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[a, b] = eps
        assert abs((total(field.weights, field.between + step) - total(field.weights, field.between - step)) / (2 * eps) - decay * field.between[a, b]) < 2e-3


def test_a_layout_that_no_training_page_has():
    """Tables for columns, old tags, no article element: labelled here by hand."""
    page = """<html><body bgcolor=white><table width=100%><tr><td colspan=2><font size=5><b>The Daily Example</b></font></td></tr>
    <tr><td width=150><div class="navbar"><a href=1>Home</a><br><a href=2>World</a><br><a href=3>Sport</a></div></td>
    <td><div class="story"><h2>Harbour wall is repaired</h2><p>The harbour wall was repaired last week, after two winters of storms.
    <p>Masons from the next valley laid <i>four hundred</i> stones, said the mayor, who had asked for the work in May.</div></td></tr>
    <tr><td colspan=2><div id="footer">Copyright 2003 The Daily Example. All rights reserved.</div></td></tr></table></body></html>"""
    text = html.default_field().extract(page)
    assert "Masons from the next valley laid four hundred stones, said the mayor, who had asked for the work in May." in text and "after two winters of storms." in text
    assert "Home" not in text and "Copyright" not in text and "Sport" not in text
