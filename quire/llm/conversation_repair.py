"""Repair of conversations' structure: the cheapest edits that make roles read ``(s?(ua)+)?``.

A backward pass gives the cost to go from each state of the grammar (nothing yet, after system, after user, after
assistant) before each row; a forward walk then takes, among the edits that keep to that cost, the ASCII-least one. The
kept, changed and inserted turns are rebuilt and hashed.

A conversation may hold any share of all rows. Rows are dealt by ranges of (conversation, turn, role, text), so that a
conversation lies in one range or in several that follow one another:

1. Conversations that lie inside a range are repaired as the sorted rows go by.
2. Of the first and last conversation of each range, which may go on in the next, the rows are set aside. Each stretch
   (conversation, range) is summed up by the costs from each state to each state, sixteen numbers; these are chained
   backward over a conversation's stretches, which gives each stretch the cost to go at its end.
3. Each stretch then says where its walk ends from each state it may begin in; these are chained forward, and the walks
   are made. Only 2 x stretches small rows meet in one place, at most two for each range.
4. A checksum can only be taken front to back: the rebuilt rows of a set-aside conversation stream through one task.

Steps of the backward pass are looked up by (row's code, costs relative to the least), of which there are few.

Defined results: null role or text becomes one space; rows of null conv_id are one conversation; rows of one turn follow
each other by role, then text (its first 200 characters, then its hash), both as they were before the damage, and a
copy made by the damage follows its row; repeated rows stand one after the other, so that all but one are duplicates; the
initial of an empty role is nothing, so that keeping such a row changes no state; an empty table gives no row; texts of
any length are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import trimmed
from .common import partitions_for, staged
from .line_dedup import _few
from .ordered_runs import PREFIX, RANGE_BYTES, hashed_streams

#: White space, ends of sentences, initials by their code, costs of the edits.
SPACES = "\t\n\x0b\x0c\r "
ENDS = ".!?"
INITIALS = ("s", "u", "a", "")
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
BLANK_ROW, DUPLICATE_ROW, TRUNCATED_ROW = 1, 2, 3

#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; what an initial leads to, and the role that a
#: changed or inserted turn takes.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
GOES = (2, 2, 3, 2)
WANTED = ("user", "user", "assistant", "user")
Costs = tuple[int, int, int, int]
NEVER = 1 << 40
#: Cost to go after the last row: only nothing and an assistant's turn may end a conversation.
FINISH: Costs = (0, 2 * INSERT, INSERT, 0)
NOTHING = hashlib.sha256().hexdigest()


def _level(costs: list[int]) -> tuple[Costs, int]:
    """Costs relative to the least, and the least."""
    base = min(costs)
    return tuple(NEVER if c >= NEVER // 2 else c - base for c in costs), base  # type: ignore[return-value]


@lru_cache(maxsize=200_000)
def _before(code: int, after: Costs) -> tuple[Costs, int, str]:
    """Costs to go before a row from those after it (relative, and the least), and the edit that each state takes."""
    kind, fault = divmod(code, 4)
    ways: list[list[tuple[int, str]]] = []
    for s in range(4):
        mine = [(DELETE + after[s], "D")]
        if fault not in (BLANK_ROW, DUPLICATE_ROW):
            extra = TRUNCATED if fault == TRUNCATED_ROW else 0
            to = _kept(s, kind)
            if to is not None:
                mine.append((extra + after[to], "K"))
            mine.append((extra + REROLE + after[GOES[s]], "R"))
        ways.append(mine)
    costs = [min(w)[0] for w in ways]
    for _ in range(4):
        costs = [min(c, INSERT + costs[GOES[s]]) for s, c in enumerate(costs)]
    for s in range(4):
        ways[s].append((INSERT + costs[GOES[s]], "I"))
    letters = "".join(min(letter for c, letter in w if c <= costs[s]) for s, w in enumerate(ways))
    return *_level(costs), letters


def _kept(state: int, kind: int) -> int | None:
    if kind >= len(INITIALS):
        return None
    return state if INITIALS[kind] == "" else STEP.get((state, INITIALS[kind]))


def costs_before(codes: list[int], after: Costs) -> tuple[list[int], list[str]]:
    """Cost to go before the first row from each state, and each row's edits by state. ``after``: cost to go after the last."""
    level, total = _level(list(after))
    edits = [""] * len(codes)
    for i in range(len(codes) - 1, -1, -1):
        level, base, edits[i] = _before(codes[i], level)
        total += base
    return [min(NEVER, c + total) for c in level], edits


def walk(codes: list[int], edits: list[str], state: int) -> tuple[list[tuple[str, list[str], str | None]], int]:
    """The edits taken from ``state`` on: for each row their letters, the roles inserted before it and the role it takes
    (None: deleted; "": its own); and the state at the end."""
    out = []
    for code, mine in zip(codes, edits, strict=True):
        letters, inserted = "", []
        while mine[state] == "I":
            letters += "I"
            inserted.append(WANTED[state])
            state = GOES[state]
        letters += mine[state]
        role: str | None = None
        if mine[state] == "K":
            role, state = "", _kept(state, code // 4)  # type: ignore[assignment]
        elif mine[state] == "R":
            role, state = WANTED[state], GOES[state]
        out.append((letters, inserted, role))
    return out, state


def ending(state: int) -> list[str]:
    """Roles inserted after the last row."""
    out = []
    while FINISH[state]:
        out.append(WANTED[state])
        state = GOES[state]
    return out


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def repair(rows: list[tuple[int, str, str]]) -> tuple[int, int, str, str]:
    """illegal, cost, audit and checksum of one conversation; rows: code, role, text."""
    codes = [c for c, _, _ in rows]
    costs, edits = costs_before(codes, FINISH)
    taken, state = walk(codes, edits, 0)
    last, lines = ending(state), []
    for (_, role, text), (_, inserted, to) in zip(rows, taken, strict=True):
        lines += [f"{x}:" for x in inserted]
        if to is not None:
            lines.append(f"{to or role}:{text}")
    lines += [f"{x}:" for x in last]
    audit = "".join(t[0] for t in taken) + "I" * len(last)
    return _illegal([r[:1] for _, r, _ in rows]), costs[0], audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


# --- Spark


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by rule: conv_id, turn, role, text; role0 and text0 as they were; row and copy tell rows apart."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(filled("conv_id"), F.lit(":"), filled("turn"))
    rows = conversations.select("conv_id", "turn", filled("role").alias("role0"), filled("text").alias("text0"), (F.crc32(key.cast("binary")) % 20).alias("kind"), F.monotonically_increasing_id().alias("row"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text0", "[.!?]", "")).otherwise(F.col("text0"))
    rows = rows.where("kind <> 0").withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role0"))})
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", "role0", "text0", "row", F.explode(copies).alias("copy"))


def _coded(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault`` (0 none, blank, duplicate or truncated) and ``code`` (4 x the initial's place + fault)."""
    rows = rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "role", "text")})
    place = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)), F.col("role0"), F.substring("text0", 1, PREFIX), F.xxhash64("text0"), F.col("row"), F.col("copy"))
    rows = rows.withColumn("place", place)
    seen = staged(rows.groupBy("conv_id", "h1", "h2").agg(F.count(F.lit(1)).alias("m"), F.min("place").alias("first")).where("m > 1").drop("m"))
    seen = _few(seen.withColumnsRenamed({"conv_id": "c", "h1": "g1", "h2": "g2"}))
    met = rows.join(seen, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & F.col("conv_id").eqNullSafe(F.col("c")), "left")
    said = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(said == "", BLANK_ROW).when(F.col("first").isNotNull() & (F.col("place") > F.col("first")), DUPLICATE_ROW).when(~F.substring(said, -1, 1).isin(*ENDS), TRUNCATED_ROW).otherwise(0)
    initial = F.substring("role", 1, 1)
    kind = F.lit(len(INITIALS))
    for k, x in enumerate(INITIALS):
        kind = F.when(initial == x, k).otherwise(kind)
    return met.withColumn("fault", fault).withColumn("code", (4 * kind + F.col("fault")).cast("int"))


EDGE = "part int, pos long, code int, role string, text string"
DONE = "illegal long, cost long, audit string, repaired_sha256 string"


def _passed(rows: DataFrame) -> DataFrame:
    """One pass over rows in order: results of conversations inside a range, and the rows of those at its edges."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role0"), F.substring("text0", 1, PREFIX), F.xxhash64("text0"), F.col("row"), F.col("copy")]
    dealt = rows.repartitionByRange(partitions_for(rows, RANGE_BYTES), *order).sortWithinPartitions(*order).select("conv_id", "code", "role", "text")
    names = ["conv_id", *(x.split()[0] for x in f"{EDGE}, {DONE}".split(", "))]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, first, own = TaskContext.get().partitionId(), 0, True, None
        held: list[tuple[int, str, str]] = []

        def table(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [own_type, *types], strict=True)], names=names)

        def edge(rows: list[tuple[int, str, str]], at: int) -> list[tuple]:
            return [(own, part, (part << 33) + at + k, *row, None, None, None, None) for k, row in enumerate(rows)]

        begin = 0
        for batch in batches:
            own_type, out = batch.column(0).type, []
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n and conv != own:
                    out += edge(held, begin) if first else [(own, part, None, None, None, None, *repair(held))]
                    first, held, begin = False, [], n
                own, n = conv, n + 1
                held.append(tuple(row))
            if first:  # goes by: the range may hold nothing else
                out += edge(held, begin)
                held, begin = [], n
            if out:
                yield table(out)
        if held:
            yield table(edge(held, begin))

    return staged(dealt.mapInArrow(trimmed(run), f"conv_id {kind}, {EDGE}, {DONE}"))


def _chained(edges: DataFrame) -> DataFrame:
    """Results of the conversations whose rows were set aside."""
    kind = edges.schema["conv_id"].dataType.simpleString()
    codes = edges.select("conv_id", "part", "pos", "code", F.substring("role", 1, 1).alias("initial"))
    keys = ["conv_id", "part"]

    def column(table: pa.Table, name: str) -> list:
        return table.column(name).to_pylist()

    def keyed(table: pa.Table, rows: int, names: tuple[str, ...], **columns: pa.Array) -> pa.Table:
        """``rows`` rows with the group's keys, taken from its first row."""
        first = {k: table.column(k).combine_chunks().take(pa.array([0] * rows)) for k in names}
        return pa.table(first | columns)

    def sum_up(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        mine, initials = column(table, "code"), column(table, "initial")
        costs = [costs_before(mine, tuple(0 if s == end else NEVER for s in range(4)))[0] for end in range(4)]  # type: ignore[arg-type]
        return keyed(table, 1, ("conv_id", "part"), costs=pa.array([[c for x in costs for c in x]], pa.list_(pa.int64())), illegal=pa.array([_illegal(initials)], pa.int64()), ends=pa.array([[initials[0], initials[-1]]], pa.list_(pa.string())))

    def backward(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        costs, after = column(table, "costs"), [FINISH]
        for c in reversed(costs):
            after.append(tuple(min(NEVER, *(c[4 * e + s] + after[-1][e] for e in range(4))) for s in range(4)))
        ends = column(table, "ends")
        illegal = sum(column(table, "illegal")) + sum(_illegal([a[1], b[0]]) for a, b in zip(ends, ends[1:], strict=False))
        n = len(costs)
        return pa.table(
            {k: table.column(k) for k in keys}
            | {"after": pa.array([list(x) for x in after[-2::-1]], pa.list_(pa.int64())), "cost": pa.array([after[-1][0]] * n, pa.int64()), "illegal": pa.array([illegal] * n, pa.int64()), "last": pa.array([k == n - 1 for k in range(n)])}
        )

    def leads(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        mine = column(table, "code")
        _, edits = costs_before(mine, tuple(column(table, "after")[0]))  # type: ignore[arg-type]
        return keyed(table, 1, ("conv_id", "part"), to=pa.array([[walk(mine, edits, s)[1] for s in range(4)]], pa.list_(pa.int32())))

    def forward(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        state, begin = 0, []
        for to in column(table, "to"):
            begin.append(state)
            state = to[state]
        return pa.table({k: table.column(k) for k in keys} | {"begin": pa.array(begin, pa.int32())})

    def edit(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        mine = column(table, "code")
        _, edits = costs_before(mine, tuple(column(table, "after")[0]))  # type: ignore[arg-type]
        taken, state = walk(mine, edits, column(table, "begin")[0])
        more = ending(state) if column(table, "last")[0] else []
        rows = [(p, 0, *t) for p, t in zip(column(table, "pos"), taken, strict=True)]
        rows += [(rows[-1][0], 1, "I" * len(more), more, None)] if more else []
        pos, after_row, letters, inserted, role = zip(*rows, strict=True)
        return keyed(table, len(rows), ("conv_id", "part"), pos=pa.array(pos, pa.int64()), k=pa.array(after_row, pa.int32()), letters=pa.array(letters), inserted=pa.array(inserted, pa.list_(pa.string())), to=pa.array(role, pa.string()))

    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["part"] == b["part"])

    def told(df: DataFrame, more: DataFrame, *names: str) -> DataFrame:
        """``df`` with columns of ``more``, which has a row for each stretch."""
        more = F.broadcast(more.select("conv_id", "part", *names))  # two stretches for each range at most
        return df.join(more, same(df, more)).select(*[df[c] for c in df.columns], *[more[c] for c in names])

    stretches = staged(codes.groupBy(*keys).applyInArrow(sum_up, f"conv_id {kind}, part int, costs array<long>, illegal long, ends array<string>"))
    backwards = staged(stretches.groupBy("conv_id").applyInArrow(backward, f"conv_id {kind}, part int, after array<long>, cost long, illegal long, last boolean"))
    ways = staged(told(codes, backwards, "after").groupBy(*keys).applyInArrow(leads, f"conv_id {kind}, part int, to array<int>"))
    forwards = staged(ways.groupBy("conv_id").applyInArrow(forward, f"conv_id {kind}, part int, begin int"))
    taken = told(told(codes, backwards, "after", "last"), forwards, "begin").groupBy(*keys)
    taken = staged(taken.applyInArrow(edit, f"conv_id {kind}, part int, pos long, k int, letters string, inserted array<string>, to string"))

    texts = edges.select(F.col("pos").alias("at"), "role", "text")
    built = taken.join(texts, (F.col("pos") == F.col("at")) & (F.col("k") == 0), "left")
    own = F.concat(F.when(F.col("to") == "", F.col("role")).otherwise(F.col("to")), F.lit(":"), F.col("text"))
    lines = F.concat(F.transform("inserted", lambda r: F.concat(r, F.lit(":"))), F.when(F.col("to").isNull(), F.array().cast("array<string>")).otherwise(F.array(own)))
    chunks = built.select("conv_id", "pos", "k", lines.alias("lines")).where(F.size("lines") > 0).select("conv_id", "pos", "k", F.array_join("lines", "\n").alias("chunk"))
    digests = hashed_streams(chunks, ["conv_id"], ["pos", "k"], b"\n")
    # one letter and more for each row is the result's own size
    parts = taken.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "k", "letters"))), lambda x: x["letters"]), "").alias("audit"))
    audits = parts.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    facts = backwards.where("last").select("conv_id", "illegal", "cost")
    out = facts.join(audits, facts["conv_id"].eqNullSafe(audits["conv_id"])).join(digests, facts["conv_id"].eqNullSafe(digests["conv_id"]), "left")
    return out.select(facts["conv_id"], "illegal", "cost", "audit", F.coalesce("sha256", F.lit(NOTHING)).alias("repaired_sha256"))


def repair_all(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (as ``damaged`` gives them) with their faults, and the result of each conversation that has a row."""
    coded = _coded(rows)
    passed = _passed(coded)
    inside = passed.where("pos is null").select("conv_id", "illegal", "cost", "audit", "repaired_sha256")
    edges = passed.where("pos is not null").select("conv_id", "part", "pos", "code", "role", "text")
    return coded, inside.unionByName(_chained(edges))


def _facts(coded: DataFrame) -> DataFrame:
    """Gaps and faults by conversation. Turns are made distinct first, combined before each shuffle."""
    count = lambda f: F.sum((F.col("fault") == f).cast("long"))
    turns = coded.groupBy("conv_id", "turn").agg(*[count(f).alias(n) for f, n in ((BLANK_ROW, "blank"), (DUPLICATE_ROW, "duplicate"), (TRUNCATED_ROW, "truncated"))])
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")])


def repair_report(conversations: DataFrame) -> DataFrame:
    """Contract of ``op11``: damages the conversations by rule, then repairs them."""
    coded, results = repair_all(staged(damaged(conversations)))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    every = conversations.select("conv_id").distinct()
    facts = _facts(coded).withColumnRenamed("conv_id", "c1")
    results = results.withColumnRenamed("conv_id", "c2")
    out = every.join(facts, F.col("conv_id").eqNullSafe(F.col("c1")), "left").join(results, F.col("conv_id").eqNullSafe(F.col("c2")), "left")
    zero: list[Column] = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"))
