"""Texts of many lines: features in blocks, the same scores, bounded memory."""

import subprocess
import sys

import numpy as np
import pytest

from ferrule.llm import quality


@pytest.mark.parametrize("step", [1, 2, 3, 7, 4096])
def test_blocks_hold_the_same_features(step):
    text = "\n".join(f"Line {i} of it," + " word!" * (i % 5) + "\n" * (i % 3) for i in range(23)) + "\n \nend"
    x, n = quality.line_features(text)
    parts = list(quality.feature_blocks(text, step))
    assert (np.vstack([p for p, _ in parts]) == x).all() and (np.concatenate([q for _, q in parts]) == n).all()
    assert len(x) == 24 and x[:, -2].tolist() == [1] + [0] * 23 and x[:, -1].tolist() == [0] * 23 + [1]
    field = quality.LineField(np.random.default_rng(1).normal(size=quality.N_ALL), 0.7)
    assert np.allclose(field.scores([(x, n)]), field.scores_of([field.evidence(text)]))


def test_a_long_chain_alone_is_as_among_others():
    u = [np.random.default_rng(3).normal(size=6000) * 3, np.random.default_rng(4).normal(size=6001)]
    (f, b), (g, c) = quality.log_odds(u, -0.8), quality.log_odds(u[:1], -0.8)
    assert np.allclose(f[0], g[0]) and np.allclose(b[0], c[0])


def test_no_line_at_all():
    for text in (None, "", "\n \n"):
        (x, n), *more = quality.feature_blocks(text)
        assert not more and x.shape == (1, quality.N_ALL) and not x.any() and n.tolist() == [1.0]


def test_a_million_lines_take_little_memory():
    """Growth of a process that scores a text of a million lines, beyond the imports."""
    code = """
import resource, numpy as np
from ferrule.llm import quality
field = quality.LineField(np.random.default_rng(1).normal(size=quality.N_ALL), 0.7)
field.scores_of([field.evidence("a b\\n" * 1000)])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
score = field.scores_of([field.evidence("ab cd\\n" * 1_000_000)])
assert 0 <= score[0] <= 1
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[-1]) < 300
