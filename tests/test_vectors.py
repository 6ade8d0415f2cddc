"""Vectors that a caller hands over: cosines of Arrow batches, and the report with them."""

import math

import pyarrow as pa
import pytest

from rolefit.operators import vectors as ve
from rolefit.plans import catalog_ops
from rolefit.plans.catalog import EXACT, _report
from tests.conftest import SF_SMALL


def _cos(a, b):
    if a is None or b is None or len(a) != len(b):
        return 0.0
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / norm if norm else 0.0


ROWS = [([1.0, 2.0], [2.0, 4.0]), ([1.0, 0.0], [0.0, 3.0]), (None, [1.0]), ([1.0], None), ([], []), ([0.0, 0.0], [1.0, 1.0]),
        ([1.0, 2.0, 3.0], [3.0, 2.0]), ([1.0, -2.0, 3.0], [3.0, 2.0, -1.0]), ([5.0], [-5.0])]


def test_cosine_rows():
    a, b = (pa.array([r[k] for r in ROWS], pa.list_(pa.float32())) for k in (0, 1))
    assert ve.cosine_rows(a, b).tolist() == pytest.approx([_cos(*r) for r in ROWS])
    assert ve.cosine_rows(a[2:], b[2:]).tolist() == pytest.approx([_cos(*r) for r in ROWS[2:]])  # a slice has its own offsets


def test_report_with_vectors(spark):
    vectors = catalog_ops.fixture_vectors(spark, SF_SMALL)
    report = _report(spark, SF_SMALL, **EXACT, rounded=False, vectors=vectors)
    got = {(r.resume_id, r.jd_id): r for r in report.collect()}
    plain = {(r.resume_id, r.jd_id): r for r in _report(spark, SF_SMALL, **EXACT, rounded=False).collect()}
    r = {x.resume_id: x.head for x in vectors[0].collect()}
    j = {x.jd_id: x for x in vectors[1].collect()}
    assert set(got) == set(plain)
    for (a, b), row in got.items():
        assert row.job_title_score == pytest.approx(min(100 * _cos(r[a], j[b].title), 100))
        assert row.skill_match_score == plain[a, b].skill_match_score
    assert any(row.experience_score != plain[k].experience_score for k, row in got.items())
