"""Trust over a generated link graph against plain power iteration, and the language network against plain convolutions."""

import random
import re

import numpy as np
import pytest

from flotsam.llm import langid_cnn, url_graph


def plain_scores(pages, rules=url_graph.RULES, damping=url_graph.DAMPING):
    """(trust, distrust) of hosts by power iteration until nothing changes."""
    hosts, links, seeds = set(), set(), {True: {}, False: {}}
    for _, url, html in pages:
        host, path = re.match(r"[^/?#]*", url.split("://", 1)[1])[0].lower(), ""
        path = url.split("://", 1)[1][len(host) :].split("?")[0].split("#")[0]
        hosts.add(host)
        links |= {(host, to.lower()) for to in re.findall(r"""(?:href|src)=["']?(?:[a-z]+:)?//([^/?#"'\s>]+)""", html)}
        fits = [(len(r), v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        if fits:
            kind = seeds[max(fits)[1] == "allow"]
            kind[host] = kind.get(host, 0) + 1
    edges = set(links)
    for h in hosts | {b for _, b in links}:
        parts = h.split(".")
        for k in range(len(parts) - url_graph.LEAST_LABELS):
            up = ".".join(parts[k:]), ".".join(parts[k + 1 :])
            edges |= {up, up[::-1]}
    edges = {(a, b) for a, b in edges if a != b}
    out = {}
    for trusts in (True, False):
        ways = edges if trusts else {(b, a) for a, b in edges}
        degree = {}
        for a, _ in ways:
            degree[a] = degree.get(a, 0) + 1
        total = sum(seeds[trusts].values())
        start = {h: (1 - damping) * n / total for h, n in seeds[trusts].items()}
        score = dict(start)
        for _ in range(400):
            new = dict(start)
            for a, b in ways:
                if a in score:
                    new[b] = new.get(b, 0) + damping * score[a] / degree[a]
            score = new
        out[trusts] = score
    return {h: (out[True].get(h, 0.0), out[False].get(h, 0.0)) for h in out[True].keys() | out[False].keys()}


@pytest.mark.parametrize("hot, few", [(1000, 200_000), (4, 200_000), (4, 5)])
def test_trust_over_links_hubs_and_cycles(spark, monkeypatch, hot, few):
    monkeypatch.setattr(url_graph, "LEAST_HOT", hot)
    monkeypatch.setattr(url_graph, "PARTITION_ROWS", few)
    rng = random.Random(9)
    names = [f"{rng.choice(['a', 'b.c', 'x.y.z'])}{k}.{rng.choice(['org', 'com', 'net', 'example.com'])}" for k in range(40)] + ["hub.org", "example.com", "www.example.com"]
    pages = []
    for k, host in enumerate(names * 2):
        to = rng.sample(names, rng.randint(0, 3)) + ["hub.org"] * rng.randint(0, 1) + ([names[(k + 1) % len(names)]] if k % 2 else [])
        html = "".join(f'<a href="{rng.choice(["https:", "http:", ""])}//{t}/x">' for t in to)
        pages.append((k, f"http://{host}/{rng.choice(['', 'en/', 'es/', 'fr/a'])}p?q", html))
    pages += [(900 + k, f"http://leaf{k}.hub.org/", '<img src="//hub.org/i">') for k in range(30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    want = plain_scores(pages)
    got = {r.host: (r.trust, r.distrust) for r in url_graph.host_scores(url_graph.judged_by_rules(df)).collect()}
    assert set(got) == set(want)
    assert all(got[h] == pytest.approx(want[h], abs=1e-8) for h in want)
    assert {r.verdict for r in url_graph.filter_urls(df).collect()} == {"allow", "block"}


def test_logits_are_those_of_plain_convolutions():
    rng = np.random.default_rng(2)
    windows = rng.integers(0, 256, (5, langid_cnn.WINDOW)).astype(np.uint8)
    model = langid_cnn.fit(windows, np.array([0, 1, 2, 0, 1]), ["x", "y", "z"], epochs=1)
    pooled = []
    for filters, bias, width in zip(model.filters, model.biases, langid_cnn.WIDTHS, strict=True):
        places = langid_cnn.WINDOW - width + 1
        conv = np.zeros((len(windows), places, filters.shape[-1]))
        for n in range(len(windows)):
            for p in range(places):
                for k in range(width):
                    conv[n, p] += model.vectors[windows[n, p + k]] @ filters[k]
        pooled.append(np.maximum(conv.max(1) + bias, 0))
    want = np.concatenate(pooled, 1) @ model.weights + model.offset
    assert np.allclose(model.logits(windows, model.tables()), want, atol=1e-3)


def test_learning_lowers_the_cross_entropy():
    rng = np.random.default_rng(4)
    labels = np.arange(90) % 3
    windows = (97 + labels[:, None] * 5 + rng.integers(0, 8, (90, langid_cnn.WINDOW))).astype(np.uint8)

    def loss(epochs):
        model = langid_cnn.fit(windows, labels, ["x", "y", "z"], epochs=epochs)
        z = model.logits(windows, model.tables())
        z = z - z.max(1, keepdims=True)
        return -(z[np.arange(90), labels] - np.log(np.exp(z).sum(1))).mean()

    assert loss(8) < 0.3 < loss(0)
