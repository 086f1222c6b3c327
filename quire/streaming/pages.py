"""Page readiness and republishing as stateful streams.

State lives in keyed maps of the state store, one entry for each unit and each page, so that an event reads and writes the
entries that it concerns and nothing else, whatever a document has gathered. State goes by timers on the events' own time:
once the watermark is ``KEEP_MS`` past the end of a document, or ``LIVE_MS`` past the last event of one that never ends.

Events of a document have an order, ``seq``, and a time, ``at``; rows of one micro-batch are taken in order. Defined results:
an event of an unknown kind, or without what its kind needs, changes nothing; repeated events change nothing; events behind
the watermark are dropped; an event after a document's state has gone begins it anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import drain, table_stream

#: The store that keeps map entries apart.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
KEEP_MS = 3_600_000
LIVE_MS = 7 * 24 * 3_600_000


def drained(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """``drain`` with a store for keyed state."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        return drain(stream, folder)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


class Pages(StatefulProcessor):
    """State of a document's pages: which units a page expects, which have arrived, and how often it was given out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.units = handle.getMapState("units", "page long, unit long", "arrived boolean")
        self.pages = handle.getMapState("pages", "page long", "expected long, arrived long, ready boolean, revision long")

    def page(self, page: int) -> list:
        return list(self.pages.getValue((page,))) if self.pages.containsKey((page,)) else [0, 0, False, 0]

    def unit(self, page: int, unit: int) -> bool | None:
        """Whether a unit has arrived; None if it isn't expected."""
        return self.units.getValue((page, unit))[0] if self.units.containsKey((page, unit)) else None

    def expect(self, page: int, unit: int | None) -> None:
        held = self.page(page)
        if unit is not None and self.unit(page, unit) is None:
            self.units.updateValue((page, unit), (False,))
            held[0] += 1
        self.pages.updateValue((page,), tuple(held))

    def arrive(self, page: int, unit: int) -> None:
        if self.unit(page, unit) is False:
            self.units.updateValue((page, unit), (True,))
            held = self.page(page)
            self.pages.updateValue((page,), (held[0], held[1] + 1, *held[2:]))

    def give(self, page: int) -> int:
        """Marks a page as given out once more; its revision."""
        expected, arrived, _, revision = self.page(page)
        self.pages.updateValue((page,), (expected, arrived, True, revision + 1))
        return revision + 1

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last, ended = None, False
        for r in sorted(rows, key=lambda r: (r.seq is None, r.seq or 0)):
            last, ended = r.at if last is None or r.at is not None and r.at > last else last, ended or r.kind == "end"
            yield from self.take(key[0], r)
        if last is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(last.timestamp() * 1000) + (KEEP_MS if ended else LIVE_MS))

    def take(self, document: Any, r: Row) -> Iterator[Row]:
        """What one event gives out."""
        raise NotImplementedError

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.units.clear()
        self.pages.clear()
        return iter(())

    def close(self) -> None:
        pass


class Schedule(Pages):
    """Pages that are ready: all units are there (``arrive``, ``page``), or the document has ended (``end``)."""

    def take(self, document: Any, r: Row) -> Iterator[Row]:
        if r.kind == "end":
            rest = sorted((p[0] for p, held in self.pages.iterator() if not held[2]))
            for page in rest:
                yield Row(document=document, page=page, units=self.page(page)[1], revision=self.give(page), forced=True)
        elif r.page is None:
            return
        elif r.kind == "expect":
            self.expect(r.page, r.unit)
        elif r.kind == "reopen" and self.pages.containsKey((r.page,)):
            expected, _, _, revision = self.page(r.page)
            for k in [k for k, v in self.units.iterator() if k[0] == r.page and v[0]]:
                self.units.updateValue(tuple(k), (False,))
            self.pages.updateValue((r.page,), (expected, 0, False, revision))
        elif r.kind in ("arrive", "page") and self.pages.containsKey((r.page,)):
            if r.kind == "page":
                for k in [k for k, v in self.units.iterator() if k[0] == r.page and not v[0]]:
                    self.arrive(*k)
            elif r.unit is None:
                return
            else:
                self.arrive(r.page, r.unit)
            expected, arrived, ready, _ = self.page(r.page)
            if not ready and arrived == expected and (expected or r.kind == "page"):
                yield Row(document=document, page=r.page, units=arrived, revision=self.give(r.page), forced=False)


class Publisher(Pages):
    """Pages to compose: once all units in scope have settled, and again whenever a unit of another page lands on a page
    that was given out. A page without units of its own is composed as soon as something lands on it."""

    def take(self, document: Any, r: Row) -> Iterator[Row]:
        if r.kind == "end":
            for page in sorted(p[0] for p, held in self.pages.iterator() if held[0] and not held[2] and held[1]):
                yield Row(document=document, page=page, unit=None, revision=self.give(page), foreign=False, complete=False)
        elif r.kind == "expect" and r.page is not None:
            self.expect(r.page, r.unit)
        elif r.kind == "patch" and r.page is not None and r.unit is not None:
            self.arrive(r.page, r.unit)
            for page in [r.page] if r.landing is None or r.landing == r.page else [r.page, r.landing]:
                foreign = page != r.page
                expected, arrived, given, _ = self.page(page)
                whole = expected > 0 and arrived == expected
                if given and not foreign or not whole and not (foreign and expected == 0):
                    continue
                yield Row(document=document, page=page, unit=r.unit, revision=self.give(page), foreign=foreign, complete=True)


def page_schedule(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events (document, seq, at, kind, page, unit), up to ``late`` behind the latest, to ready pages with their revisions.
    Kinds: expect (a unit; without a unit a page of none), arrive, page (all of a page has arrived), reopen, end."""
    return events.withWatermark("at", late).groupBy("document").transformWithState(Schedule(), "document long, page long, units long, revision long, forced boolean", "Append", "EventTime")


def published_pages(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events (document, seq, at, kind, page, unit, landing), up to ``late`` behind the latest, to pages composed. Kinds:
    expect, patch (a unit of ``page`` settled; it landed on ``landing``, null: on its own page), end."""
    return events.withWatermark("at", late).groupBy("document").transformWithState(Publisher(), "document long, page long, unit long, revision long, foreign boolean, complete boolean", "Append", "EventTime")


# Queries over the driver's tables ------------------------------------------------------------------------------

#: Two turns are a page. A turn is lost where (conversation + turn) % 5 = 0; pages are reopened where (conversation + page) % 3 = 0.
#: The table has no times: an event's place is its time in seconds, and none is late.
NEVER_LATE = "60 days"
PAGE, LOST, REOPENED = "turn div 2", "(conv_id + turn) % 5 = 0", "(conv_id + turn div 2) % 3 = 0"


def _events(spark: SparkSession, sf_dir: str, **kinds: tuple[str, str, str]) -> DataFrame:
    """Rows of the table, as events: by kind a condition, the place in order and the page that it lands on."""
    turns = table_stream(spark, sf_dir, "conversations")
    out = None
    for name, (where, seq, landing) in kinds.items():
        kind = name.rstrip("0123456789")
        some = turns.where(where).selectExpr("conv_id AS document", f"{seq} AS seq", f"timestamp_seconds(1000000000 + {seq}) AS at", f"'{kind}' AS kind", f"{PAGE} AS page", "turn AS unit", f"CAST({landing} AS BIGINT) AS landing")
        out = some if out is None else out.unionByName(some)
    return out


def stm05_page_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {
        "expect": ("true", "turn", "NULL"),
        "arrive": (f"NOT {LOST}", "1000000 + turn", "NULL"),
        "reopen": (f"{REOPENED} AND turn % 2 = 0", "2000000 + turn", "NULL"),
        "arrive2": (f"{REOPENED} AND NOT {LOST}", "3000000 + turn", "NULL"),
        "end": ("turn = 0", "4000000L", "NULL"),
    }
    return drained(page_schedule(_events(spark, sf_dir, **kinds), NEVER_LATE))


def stm06_republish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third turn lands on the page before its own, which may have been given out."""
    kinds = {
        "expect": ("true", "turn", "NULL"),
        "patch": (f"NOT {LOST}", "1000000 + turn", f"CASE WHEN turn % 3 = 2 THEN {PAGE} - 1 END"),
        "end": ("turn = 0", "4000000L", "NULL"),
    }
    return drained(published_pages(_events(spark, sf_dir, **kinds), NEVER_LATE))


QUERIES = {"stm05_page_schedule": stm05_page_schedule, "stm06_republished_pages": stm06_republish}

ORACLE = {
    "stm05_page_schedule": """WITH p AS (SELECT conv_id AS document, turn // 2 AS page, count(*) AS expected, count(CASE WHEN (conv_id + turn) % 5 <> 0 THEN 1 END) AS arrived, (conv_id + turn // 2) % 3 = 0 AND count(CASE WHEN turn % 2 = 0 THEN 1 END) > 0 AS again
        FROM conversations GROUP BY conv_id, turn // 2), d AS (SELECT conv_id AS document FROM conversations WHERE turn = 0)
        SELECT document, page, arrived AS units, CAST(1 AS BIGINT) AS revision, FALSE AS forced FROM p WHERE arrived = expected
        UNION ALL SELECT document, page, arrived AS units, CAST(2 AS BIGINT) AS revision, FALSE AS forced FROM p WHERE arrived = expected AND again
        UNION ALL SELECT document, page, arrived AS units, CAST(1 AS BIGINT) AS revision, TRUE AS forced FROM p WHERE arrived < expected AND document IN (SELECT document FROM d)""",
}
