import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from quire.llm import conversation_repair as cr
from quire.llm.queries import QUERIES

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """Least (cost, audit) by a search forward over (row, initials so far); rows: (role, text, fault)."""

    def insert(states):
        for _ in range(3):
            for s, (c, a, out) in list(states.items()):
                for r in ("user", "assistant"):
                    if ok(s, r[0]):
                        put(states, r[0], c + 5, a + "I", [*out, f"{r}:"])
        return states

    def ok(s, x):
        return (s, x) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    def put(states, s, c, a, out):
        if s not in states or (c, a) < states[s][:2]:
            states[s] = (c, a, out)

    now = insert({"": (0, "", [])})
    for role, text, fault in rows:
        then = {}
        for s, (c, a, out) in now.items():
            put(then, s, c + 2, a + "D", out)
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault == "truncated" else 0
            x = role[:1]
            if not x or ok(s, x):
                put(then, x or s, c + extra, a + "K", [*out, f"{role}:{text}"])
            for r in ("user", "assistant"):
                if ok(s, r[0]):
                    put(then, r[0], c + 1 + extra, a + "R", [*out, f"{r}:{text}"])
        now = insert(then)
    return min((c, a, out) for s, (c, a, out) in now.items() if s in ("", "a"))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        said = text.rstrip("\t\n\x0b\x0c\r ")
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(data):
    convs = defaultdict(list)
    for c, t, role, text in data:
        convs[c]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        new = (t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        convs[c] += [((t is not None, t or 0, role, text), new)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for c, rows in convs.items():
        rows = [x for _, x in sorted(rows, key=lambda r: r[0])]
        turns = {t for t, *_ in rows if t is not None}
        found = faults([x[1:] for x in rows])
        initials = [r[:1] for _, r, _ in rows]
        cost, audit, lines = cheapest([(*x[1:], f) for x, f in zip(rows, found, strict=True)])
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return by_id(out)


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def got(df):
    return by_id([tuple(r[c] for c in COLUMNS) for r in df.collect()])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], "conv_id long, turn long, role string, text string, audit string, part int").repartition(6)


def some(seed, convs, longest):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "So?  \n", "cut", "", " \t", "a.b", None, "é𝒳?", "Well. And"]
    out = []
    for c in range(convs):
        for t in range(r.randrange(1, longest)):
            role = r.choice(["user", "assistant"] * 3 + ["system", "tool", "", None, "User"])
            out.append((c, r.choice([t, t, t, 2 * t, None]), role, r.choice([*texts, f"{r.randrange(9)}.", f"{r.randrange(9)}!"])))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_search_by_cost_to_go(seed):
    """Costs and edits of random sequences against every sequence of edits that the search forward tries; the repaired
    roles read as the grammar asks."""
    r = random.Random(seed)
    for _ in range(3000):
        rows = [(r.choice(["system", "user", "assistant", "tool", ""]), r.choice(["A.", "B.", "C", " "])) for _ in range(r.randrange(0, 8))]
        found = faults(rows)
        names = ["", "blank", "duplicate", "truncated"]
        coded = [(4 * (cr.INITIALS.index(role[:1]) if role[:1] in cr.INITIALS else 4) + names.index(f), role, text) for (role, text), f in zip(rows, found, strict=True)]
        _, cost, audit, digest = cr.repair(coded)
        want = cheapest([(*x, f) for x, f in zip(rows, found, strict=True)])
        assert (cost, audit, digest) == (want[0], want[1], hashlib.sha256("\n".join(want[2]).encode()).hexdigest())
        assert GRAMMAR.fullmatch("".join(x.split(":")[0][:1] for x in want[2]))


def test_all_edit_sequences_of_short_conversations():
    """The forward search itself against plain enumeration."""
    for roles in itertools.product(["system", "user", "assistant"], repeat=3):
        for marks in itertools.product(["", "truncated", "blank"], repeat=3):
            rows = [(r, "x", m) for r, m in zip(roles, marks, strict=True)]
            best = None
            one = lambda row: [("D", 2, "")] + ([] if row[2] == "blank" else [("K", 5 * bool(row[2]), row[0][0]), ("R", 1 + 5 * bool(row[2]), "u"), ("R", 1 + 5 * bool(row[2]), "a")])
            gaps = [[("", 0, "")] + [("I" * len(x), 5 * len(x), x) for x in ("u", "a", "ua", "au")]] * 4
            for seq in itertools.product(*[y for k in range(3) for y in (gaps[k], one(rows[k]))], gaps[3]):
                if GRAMMAR.fullmatch("".join(x[2] for x in seq)):
                    mine = (sum(x[1] for x in seq), "".join(x[0] for x in seq))
                    best = mine if best is None else min(best, mine)
            assert cheapest(rows)[:2] == best


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = [*some(seed, 120, 14), (None, 3, "user", "Hi."), (None, None, None, None), (-5, 1, "assistant", "x" * 100_000)]
    rows += rows[:40]
    assert got(cr.repair_report(frame(spark, rows))) == brute(rows)


def test_conversation_over_several_ranges(spark):
    """Two conversations with nearly all rows lie in several ranges each; stretches are chained."""
    r = random.Random(4)
    big = [(c, t, r.choice(["user", "assistant", "system", "tool"]), r.choice(["Yes.", "No!", "cut", ""]) + r.choice(["", f"{t}."])) for c in (50, 51) for t in range(2500)]
    rows = big + some(9, 20, 5)
    assert got(cr.repair_report(frame(spark, rows))) == brute(rows)


def test_all_dropped_and_empty(spark):
    drops = [(c, t, "user", "Hi.") for c in range(400) for t in [0] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    out = got(cr.repair_report(frame(spark, drops)))
    assert out == brute(drops) and {r[7] for r in out} == {""} and len(out) > 5
    assert cr.repair_report(frame(spark, [])).collect() == []


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op11_conversation_repair"](spark, sf)) == brute(rows)
