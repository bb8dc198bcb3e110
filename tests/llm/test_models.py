"""What the trained operators compute, against plain solutions of the same problems."""

import numpy as np
import zstandard

from tessera.llm import quality_classifier, toxicity


def plain_machine(x, y, limit, steps=60_000):
    """The dual of the hinge-loss machine by projected gradient steps on all coefficients at once."""
    sign = np.where(y == 1, 1.0, -1.0)
    z = np.hstack([x, np.ones((len(x), 1))]) * sign[:, None]
    gram = z @ z.T
    rate, alpha = 1 / np.linalg.eigvalsh(gram)[-1], np.zeros(len(y))
    for _ in range(steps):
        alpha = np.clip(alpha + rate * (1 - gram @ alpha), 0, limit)
    w = z.T @ alpha
    return w[:-1], w[-1], alpha


def test_descent_solves_the_hinge_loss_problem():
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(30, rng.integers(1, 12), replace=False)) for _ in range(50)]
    y = rng.integers(0, 2, 50)
    values = rng.normal(size=30)
    x = np.zeros((50, 30))
    for i, r in enumerate(rows):
        x[i, r] = values[r] / np.sqrt(len(r))
    limit = np.where(y == 1, 50 / (2 * (y == 1).sum()), 50 / (2 * (y == 0).sum()))
    w, bias = quality_classifier.descend(rows, values, y, 1.0, 3000)
    expected, shift, _ = plain_machine(x, y, limit)
    assert np.abs(w - expected).max() < 1e-3 and abs(bias - shift) < 1e-3

    def objective(v, b):
        return (v @ v + b * b) / 2 + (limit * np.maximum(0, 1 - np.where(y == 1, 1, -1) * (x @ v + b))).sum()

    few, shorter = quality_classifier.descend(rows, values, y, 1.0, 12)
    assert objective(few, shorter) < 1.05 * objective(expected, shift)


def test_ratios_are_class_log_counts():
    rows = [np.array([0, 1]), np.array([1]), np.array([2])]
    ratios = quality_classifier.log_ratios(rows, np.array([1, 1, 0]))
    assert np.allclose(ratios[:3], [np.log((2 / 4) / (1 / 3)), np.log((3 / 4) / (1 / 3)), np.log((1 / 4) / (2 / 3))])


def test_logistic_curve_is_the_regularised_one():
    rng = np.random.default_rng(3)
    x = np.hstack([rng.normal(size=(200, 3)), np.ones((200, 1))])
    y = (x @ np.array([1.0, -2.0, 0.0, 0.5]) + rng.normal(size=200) > 0).astype(float)
    w, penalty = np.zeros(4), np.array([1.0, 1.0, 1.0, 1e-3])
    for _ in range(20_000):
        w -= 0.01 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) + penalty * w)
    assert np.abs(toxicity.logistic(x, y) - w).max() < 1e-4


def test_distances_are_differences_of_compressed_lengths():
    bad = ["you vilest wretch go away", "such a vilest wretch indeed", "wretch of the vilest kind"] * 8
    good = ["the morning was bright and calm", "a calm evening by the river", "bright stones in the river"] * 8
    toxic, ordinary = toxicity.dictionaries([*bad, *good], np.array([1] * 24 + [0] * 24), 4096)
    model = toxicity.Model(toxic, ordinary, np.zeros(2 * len(toxicity.CUTS) + 1))
    plain = {"format": zstandard.FORMAT_ZSTD1_MAGICLESS, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    made = zstandard.ZstdCompressionParameters.from_level(9, min_match=3, strategy=zstandard.STRATEGY_BTOPT, **plain)
    for word in ("vilest", "wretch", "river", "unknownword", "ab"):
        sizes = [len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=made).compress(toxicity.framed(word))) for d in (ordinary, toxic)]
        assert model.distance(word) == (sizes[0] - sizes[1] if len(word) > 2 else 0), word
    found = np.array([model.distance(w) for w in toxicity.windows("Vilest wretch, calm river!")])
    counts = np.array([(found >= c).sum() for c in toxicity.CUTS])
    assert np.allclose(model.features("Vilest wretch, calm river!"), [*np.log1p(counts), *np.minimum(100 * counts / 20, 10), 1.0])
