"""Physical-plan checks: pruning, pushdown, no single-partition exchanges
on the data path, no Python UDFs in the relational plans."""

from pyspark.sql import functions as F

from itemlens.plans.browse import browse
from itemlens.plans.catalog import prepare_catalog
from itemlens.plans.trending import trending_categories
from itemlens.sources import tables as TB

from sample_data import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_catalogue_plan_has_no_python_and_no_single_partition(spark):
    raw = TB.load_catalog(spark, SF_SMALL)
    cat = prepare_catalog(raw, TB.PART_RULES, partitions=40)
    p = plan(cat)
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    # numbering runs per bucket; only the bounded offsets table is ordered globally
    assert p.count("SinglePartition") <= 1


def test_scan_pruning_and_pushdown(spark):
    part = TB.read_table(spark, SF_SMALL, "part")
    df = part.filter(F.col("p_size") >= 30).select("p_partkey")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(p_size), GreaterThanOrEqual(p_size,30)]" in p
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in p


def test_browse_and_trending_use_partial_topk(spark):
    raw = TB.load_catalog(spark, SF_SMALL)
    cat = prepare_catalog(raw, TB.PART_RULES)
    assert "TakeOrderedAndProject" in plan(browse(cat, sort_by="rating"))
    tp = plan(trending_categories(cat, 5, TB.PART_DEFAULT_CATEGORY))
    assert "TakeOrderedAndProject" in tp and "partial_count" in tp.replace(" ", "")
