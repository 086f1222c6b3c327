"""Glyphs stay where their document was dealt to: what is shuffled grows with the texts, not with sixty times as much."""

import re

import pytest

from quire.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = ["ag01_coverage", "ag02_coverage_gate", "ag03_glyph_report", "ag17_alignment_summary", "jn01_char_region", "jn02_uncovered_chars", "jn03_glyph_centre", "jn04_char_span", "wf09_line_groups", "wf12_word_gaps", "xo02_ocr_backfill", "xo29_region_growth"]


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffles(frame):
    """Partitionings of the plan's shuffles."""
    return re.findall(r"Exchange (.*?), (?:REPARTITION|ENSURE)", frame._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", NAMES)
def test_joins_and_groups_keep_to_the_deal(spark, no_broadcast, name):
    found = shuffles(registry.queries()[name](spark, SF))
    kept = [x for x in found if re.fullmatch(r"hashpartitioning\(doc_id#\d+L, \d+\)", x)]
    assert kept and len(found) - len(kept) <= (name == "ag01_coverage")  # its rollup is over pages


def test_a_glyphs_best_region_is_found_in_compiled_code(spark, no_broadcast):
    """No function over an array, which Spark does not compile, and no order of glyphs by region."""
    plan = registry.queries()["jn01_char_region"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "LeftAnti" in plan and not re.search("array_min|collect_list|Window", plan)


def test_a_glyphs_box_is_looked_up_in_compiled_code(spark, no_broadcast):
    """No function over an array for a glyph: the pieces of its stretch are made once, and glyphs find theirs in a hash."""
    plan = registry.queries()["jn04_char_span"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    join = plan[: plan.index("BuildRight")]
    assert "ShuffledHashJoin" in join and not re.search("array_min|filter\\(|transform\\(", join)


@pytest.mark.parametrize("name", ["ag01_coverage", "ag02_coverage_gate", "ag03_glyph_report"])
def test_glyphs_are_counted_by_joins(spark, no_broadcast, name):
    """Whether a box touches a glyph is a join's matter, which Spark compiles, not that of a function over its cell's boxes."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search("LeftAnti|LeftSemi", plan) and not re.search("collect_list|exists", plan)


def test_glyphs_of_one_height_are_counted_before_their_fold(spark, no_broadcast):
    """What Python gets are rows of glyphs, not glyphs, and they stay where their document was dealt to."""
    frame = registry.queries()["xo17_source_lines"](spark, SF)
    assert all(re.fullmatch(r"hashpartitioning\(doc_id#\d+L, \d+\)", x) for x in shuffles(frame))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInPandas") < plan.index("HashAggregate")


def test_links_are_looked_up_in_a_hash(spark, no_broadcast):
    """Only what a link matched is grouped, and glyphs are not sorted by page."""
    for name in ("jn18_link_chars", "xo03_single_char_marker"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and not re.search(r"Sort \[doc_id#\d+L ASC NULLS FIRST, page#", plan)


def test_the_callers_session_is_left_alone(spark):
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    registry.queries()["jn02_uncovered_chars"](spark, SF).count()
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before
