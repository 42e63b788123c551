import numpy as np
import pytest

from allelix.functions import stats
from allelix.operators import models


def test_fisher_and_tails():
    assert stats.fisher(3, 1, 1, 3)[2] == pytest.approx(0.4857142857)
    assert stats.f_test(4.0, 2, 10) == pytest.approx(0.0529267, abs=1e-4)
    assert stats.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert stats.binomial_cdf(2, 5, 0.5) == pytest.approx(0.5)


def test_trees():
    d = np.array([[0, 5, 9, 9, 8], [5, 0, 10, 10, 9], [9, 10, 0, 8, 7], [9, 10, 8, 0, 3], [8, 9, 7, 3, 0]], float)
    edges = models.neighbor_joining(d)
    assert len(edges) == 7 and (0, 5, 2.0) in edges and (1, 5, 3.0) in edges
    merges = models.upgma(d)
    assert merges[0][:3] == (3, 4, 1.5) and len(merges) == 4
    assert models.cut_tree(merges, 5, 1.6) == [0, 1, 2, 3, 3]
    with pytest.raises(ValueError):
        models.neighbor_joining(d[:2, :2])


def test_viterbi_smooths():
    e = np.array([[0.9, 0.1]] * 4 + [[0.4, 0.6]] + [[0.9, 0.1]] * 4)
    assert list(models.viterbi(np.full(2, 0.5), np.array([[0.95, 0.05], [0.05, 0.95]]), e)) == [0] * 9
