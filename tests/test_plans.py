"""Plan shape: no cartesian or nested-loop joins, dictionary broadcast,
filters and column pruning at the parquet scans."""

import contextlib
import io
import re

from rolefit.plans.catalog import QUERIES
from rolefit.sources import fixtures as fx
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_report_has_no_cartesian_or_nested_loop(spark):
    p = _plan(QUERIES["ats_report"](spark, SF_SMALL))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_skill_extraction_broadcasts_dictionary(spark):
    p = _plan(QUERIES["skill_extract"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p and "BroadcastExchange" in p
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_scan_pushdown_and_pruning(spark):
    p = _plan(fx._jd_fx(spark, SF_SMALL))
    scan = [blk for blk in p.split("\n\n") if "Scan parquet" in blk and "lineitem" in blk][0]
    assert "PushedFilters: [IsNotNull(" in scan
    read_schema = [l for l in scan.splitlines() if l.startswith("ReadSchema")][0]
    assert read_schema.count(":") == 1 + 3 and all(c in read_schema for c in ("l_orderkey", "l_suppkey", "l_partkey"))


def test_pairs_come_from_equi_joins(spark):
    p = _plan(fx._pairs(spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    scans = [l for l in p.splitlines() if l.startswith("ReadSchema")]
    assert len(scans) == 5 and not any(c in l for l in scans for c in ("l_quantity", "o_totalprice", "p_type", "c_name"))


def test_skill_extraction_moves_no_text(spark):
    """Rows that are exchanged hold a document, a skill, a form and positions; no row holds the text or its tokens."""
    p = _plan(QUERIES["skill_extract"](spark, SF_SMALL))
    exchanges = [blk for blk in p.split("\n\n") if re.match(r"\(\d+\) (Broadcast)?Exchange\n", blk)]
    assert exchanges
    for blk in exchanges:
        inputs = next(l for l in blk.splitlines() if l.startswith("Input"))
        assert not re.search(r"[\[ ](text|t|norm|core|_norm|x)#", inputs), inputs


def test_report_reads_written_tables(spark):
    assert "Scan ExistingRDD" not in _plan(QUERIES["ats_report"](spark, SF_SMALL))
