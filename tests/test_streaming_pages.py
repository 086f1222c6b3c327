"""Page schedule and republishing: restarts, reopened pages, patches that land late, state that goes."""

from datetime import datetime, timezone

import pytest

from quire.streaming import pages

SCHEDULE = "document long, seq long, kind string, page long, unit long, at timestamp"
PATCHES = "document long, seq long, kind string, page long, unit long, landing long, at timestamp"


@pytest.fixture
def feed(spark, tmp_path):
    """Runs a stream over batches of rows, one run for each, always from the same checkpoint."""
    names = iter(range(100))

    def run(make, schema, *batches):
        out = None
        for rows in batches:
            rows = [(*r, datetime.fromtimestamp(10**9 + r[1], timezone.utc)) for r in rows]
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{next(names)}")
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
            out = pages.drained(make(stream), f"{tmp_path}/out")
        return sorted((tuple(r) for r in out.collect()), key=repr)

    return run


def test_pages_over_restarts(feed):
    first = [(1, 0, "expect", 0, 1), (1, 1, "expect", 0, 2), (1, 2, "expect", 1, 1), (1, 3, "expect", 2, None), (1, 9, "arrive", 0, 1), (1, 9, "arrive", 0, 1)]
    then = [(1, 10, "arrive", 0, 2), (1, 11, "arrive", 0, 2), (1, 12, "arrive", 9, 9), (2, 1, "arrive", 0, 1), (1, 13, "gone", 1, 1), (1, 14, "arrive", None, 1)]
    last = [(1, 20, "arrive", 1, 1), (1, 21, "page", 2, None), (1, 22, "page", 2, None), (1, 23, "end", None, None)]
    want = [(1, 0, 2, 1, False), (1, 1, 1, 1, False), (1, 2, 0, 1, False)]
    assert feed(pages.page_schedule, SCHEDULE, first, then, last) == want


def test_reopened_page_is_given_again_and_the_rest_is_forced(feed):
    first = [(1, 0, "expect", 0, 1), (1, 1, "expect", 0, 2), (1, 2, "expect", 1, 1), (1, 3, "arrive", 0, 1), (1, 4, "arrive", 0, 2)]
    then = [(1, 5, "reopen", 0, None), (1, 6, "arrive", 0, 2), (1, 6, "reopen", 7, None)]
    last = [(1, 7, "arrive", 0, 1), (1, 8, "reopen", 0, None), (1, 9, "end", None, None)]
    assert feed(pages.page_schedule, SCHEDULE, first, then, last) == [(1, 0, 0, 3, True), (1, 0, 2, 1, False), (1, 0, 2, 2, False), (1, 1, 0, 1, True)]


def test_rows_of_a_batch_are_taken_in_order(feed):
    rows = [(1, 3, "arrive", 0, 1), (1, 1, "expect", 0, 1), (1, 4, "reopen", 0, None), (1, 5, "end", None, None)]
    assert feed(pages.page_schedule, SCHEDULE, rows) == [(1, 0, 0, 2, True), (1, 0, 1, 1, False)]


def test_late_patch_republishes_the_page_it_lands_on(feed):
    expect = [(1, k, "expect", p, u, None) for k, (p, u) in enumerate([(0, 1), (0, 2), (1, 3)])]
    first = [*expect, (1, 10, "patch", 0, 1, None), (1, 11, "patch", 0, 2, None), (1, 12, "patch", 0, 2, None)]
    then = [(1, 13, "patch", 1, 3, 0)]  # lands on page 0, which was published before the restart
    last = [(1, 14, "patch", 1, 3, 5), (1, 15, "end", None, None, None)]  # page 5 has no unit of its own
    want = [(1, 0, 2, 1, False, True), (1, 0, 3, 2, True, True), (1, 1, 3, 1, False, True), (1, 5, 3, 1, True, True)]
    assert feed(pages.published_pages, PATCHES, first, then, last) == want


def test_foreign_patch_waits_for_a_page_of_its_own_units(feed):
    rows = [(1, 0, "expect", 0, 1, None), (1, 1, "expect", 1, 2, None), (1, 2, "expect", 1, 3, None), (1, 3, "patch", 0, 1, 1), (1, 4, "patch", 1, 2, None)]
    assert feed(pages.published_pages, PATCHES, rows) == [(1, 0, 1, 1, False, True)]
    assert feed(pages.published_pages, PATCHES, [(1, 9, "end", None, None, None)]) == [(1, 0, 1, 1, False, True), (1, 1, None, 1, False, False)]


def test_state_goes_after_the_end_and_late_events_with_it(feed):
    """Once another document's events are days ahead, the first one's timer has fired: it knows no pages any more."""
    day = 24 * 3600
    first = [(1, 0, "expect", 0, 1), (1, 1, "arrive", 0, 1), (1, 2, "end", None, None), (3, 1, "expect", 0, 1)]
    ahead = [(2, 3 * day, "expect", 0, 1)]
    then = [(1, 4 * day, "page", 0, None), (3, 4 * day, "arrive", 0, 1), (1, 5, "expect", 0, 1), (1, 4 * day + 1, "end", None, None)]
    assert feed(pages.page_schedule, SCHEDULE, first, ahead, [(2, 3 * day + 1, "expect", 0, 2)], then) == [(1, 0, 1, 1, False), (3, 0, 1, 1, False)]
    assert feed(pages.page_schedule, SCHEDULE, [(2, 20 * day, "reopen", 0, None)], [(2, 21 * day, "arrive", 0, 1)], [(3, 21 * day, "reopen", 0, None), (3, 22 * day, "arrive", 0, 1)]) == [(1, 0, 1, 1, False), (3, 0, 1, 1, False)]


def test_forced_pages_of_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = pages.QUERIES["stm06_republished_pages"](spark, sf).collect()
    assert any(r.foreign for r in rows) and any(not r.complete for r in rows)
    assert max(r.revision for r in rows) > 1
