"""The learned models against plain implementations from their definitions: boosted trees split by split, Kneser-Ney from dictionaries of strings."""

from __future__ import annotations

import collections
import itertools
import math

import numpy as np
import pytest

from cadencia.llm import langid, quality


def tree_by_hand(x, gradient, weight, edges, depth, penalty, least):
    """(node -> (feature, threshold)) in heap order, and the node each row ends in, by trying every split of every node."""
    rows, splits = {0: list(range(len(x)))}, {}
    for node in range(2**depth - 1):
        own, best = rows.get(node, []), (1e-6, None)
        total = (sum(gradient[i] for i in own), sum(weight[i] for i in own))
        for f, candidates in enumerate(edges):
            for t in candidates:
                left = [i for i in own if x[i][f] <= t]
                g, h = sum(gradient[i] for i in left), sum(weight[i] for i in left)
                if h < least or total[1] - h < least:
                    continue
                gain = g**2 / (h + penalty) + (total[0] - g) ** 2 / (total[1] - h + penalty) - total[0] ** 2 / (total[1] + penalty)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, t))
        splits[node] = best[1]
        goes = lambda i: best[1] is not None and x[i][best[1][0]] > best[1][1]  # noqa: B023, E731
        rows[2 * node + 1], rows[2 * node + 2] = [i for i in own if not goes(i)], [i for i in own if goes(i)]
    return splits, {i: node for node in range(2**depth - 1, 2 ** (depth + 1) - 1) for i in rows[node]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trees_grow_as_by_hand(seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(120, 3)), 1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] + 0.3 * rng.normal(size=120) > 0)).astype(float)
    depth, rate, penalty, least, bins = 3, 0.3, 1.0, 2.0, 8
    model = quality.grow_trees(x, y, trees=4, depth=depth, rate=rate, bins=bins, penalty=penalty, least=least)
    edges = [sorted({float(q) for q in np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])}) for f in range(3)]
    raw = [math.log(y.mean() / (1 - y.mean()))] * len(x)
    for t in range(4):
        p = [1 / (1 + math.exp(-r)) for r in raw]
        gradient, weight = [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]
        splits, end = tree_by_hand(x.tolist(), gradient, weight, edges, depth, penalty, least)
        for node, split in splits.items():
            if split is None:
                assert model.threshold[t, node] == np.inf
            else:
                assert model.feature[t, node] == split[0] and model.threshold[t, node] == pytest.approx(split[1])
        leaves = {}
        for node in set(end.values()):
            own = [i for i in end if end[i] == node]
            leaves[node] = -rate * sum(gradient[i] for i in own) / (sum(weight[i] for i in own) + penalty)
            assert model.leaf[t, node - (2**depth - 1)] == pytest.approx(leaves[node])
        raw = [r + leaves[end[i]] for i, r in enumerate(raw)]
    assert model.score(x) == pytest.approx([1 / (1 + math.exp(-r)) for r in raw])


def kneser_ney(texts, alphabet, order):
    """p(code | context) of one language, from counts of strings."""
    raw = [collections.Counter() for _ in range(order + 1)]
    for text in texts:
        padded = " " * (order - 1) + text + " "
        for n in range(1, order + 1):
            raw[n].update(padded[i : i + n] for i in range(len(padded) - n + 1) if i + n >= order)
    counts = [None] + [raw[order] if n == order else collections.Counter(g[1:] for g in raw[n + 1]) for n in range(1, order + 1)]
    discount = [None]
    for n in range(1, order + 1):
        one, two = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        discount.append(min(max(one / (one + 2 * two) if one + two else 0.5, 0.1), 0.9))

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / alphabet
        below = p(gram[1:])
        if gram[:-1] == "  ":  # the blanks before a text are no context by themselves: its first letter goes by one blank
            return below
        same = [c for g, c in counts[n].items() if g[:-1] == gram[:-1]]
        if not same:
            return below
        return max(counts[n][gram] - discount[n], 0) / sum(same) + discount[n] * len(same) / sum(same) * below

    return p


def test_language_models_are_interpolated_kneser_ney(spark):
    order, texts = 3, {"xx": ["abracadabra", "a barbara cab", "dabba"], "yy": ["bcd bcd", "dcb", "bbbb c"]}
    rows = spark.createDataFrame([(g, t) for g, own in texts.items() for t in own], "lang string, text string")
    model = langid._smooth(langid._count_grams(rows, order).toArrow(), order)
    letters = sorted({c for own in texts.values() for t in own for c in t} | {" "})
    assert model.languages == ["xx", "yy"]
    for i, own in enumerate(texts.values()):
        p = kneser_ney(own, len(letters) + 1, order)
        for gram in itertools.product(letters, repeat=order):
            hashes = langid._hashes(np.array([*map(ord, gram)], np.uint32), order)
            assert math.exp(model._log(hashes, order, np.array([0]))[0, i]) == pytest.approx(p("".join(gram)), rel=1e-4)


def test_cross_entropy_is_the_mean_of_the_log_probabilities(spark):
    import pyarrow as pa

    order, texts = 3, ["abracadabra", "a barbara cab"]
    model = langid._smooth(langid._count_grams(spark.createDataFrame([("xx", t) for t in texts], "lang string, text string"), order).toArrow(), order)
    p = kneser_ney(texts, len({c for t in texts for c in t} | {" "}) + 1, order)
    padded = " " * (order - 1) + "cab abra" + " "
    want = -sum(math.log(p(padded[i : i + order])) for i in range(len(padded) - order + 1)) / 9
    nats, size, letters = model.cross_entropy(pa.array(["Cab, 12 ABRA"]))
    assert (size[0], letters[0]) == (9, 7) and nats[0, 0] == pytest.approx(want, rel=1e-4)
