"""Personal data: certain patterns, and candidates judged by gradient-boosted trees.

Emails, addresses of machines, cards and phones in their plain forms are found by pattern and check (the base). On top
of them generators with high recall propose spans that a pattern alone can't decide: emails written in words, phone
numbers without a country code, identity numbers, bank accounts, hardware and longer machine addresses, keys and
passwords. Boosted trees judge each by its format and by the words around it; a kind's threshold is set on held-out
examples so that few of its negatives pass. The trees learn from examples made here by rule, positive and negative,
with a fixed seed: no label of any table is used, and training needs no data from the cluster.

Defined results: null text is empty and has no spans; repeated rows are treated alike; of spans that begin together the
kind listed first comes first; an empty table gives an empty one; other columns are ignored, whatever their names. Texts
of any length are searched whole; patterns are linear in the text. Spans count code points, the end is exclusive, and added spans
never overlap a base span or each other.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .bytescan import trimmed

# Kinds in their order, and the base patterns.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("email_words", "phone_local", "identity", "account", "machine", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: IP as it is searched: a leftmost match always begins where a run of digits does and takes whole runs, so that no
#: start within a run is tried and none is given back.
IP_SEARCH = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")

DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL, searched from each @ so that long runs of letters cost nothing."""
    at, least = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > least and text[lo - 1] in _LOCAL:
            lo -= 1
        m = EMAIL.match(text, lo) if lo < at else None
        if m and m.end() > at:
            yield m.span()
            least = m.end()
            at = text.find("@", max(at + 1, m.end()))
        else:
            at = text.find("@", at + 1)


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), sorted by start, then by kind as listed."""
    out = [(a, b, "email") for a, b in _emails(text)]
    if DIGIT.search(text):
        for m in IP_SEARCH.finditer(text):
            if all(int(p) <= 255 for p in m[0].split(".") if len(p.lstrip("0")) <= 3) and all(len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], BASE_KINDS.index(s[2])))


# Generators of candidates, by kind.
#: A dot within an address in words: a plain one alone or between two blanks (before one blank only it ends a sentence),
#: or the word, bracketed or not.
SPOKEN_DOT = r"(?:\.|\s\.\s|\s?[\[(]?\bdot\b[\])]?\s?)"
GENERATORS = {
    "email_words": re.compile(rf"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:{SPOKEN_DOT}[A-Za-z0-9_-]++){{0,3}}\s?[\[(]?(?:@|\bat\b)[\])]?\s?[A-Za-z0-9-]++(?:{SPOKEN_DOT}[A-Za-z]{{2,}}+){{1,3}}\b", re.I),
    "phone_local": re.compile(r"(?<![0-9.+])(?:\([0-9]{2,5}\)|[0-9]{2,5})[ ./-]?(?:[0-9]{2,4}[ ./-]?){1,4}[0-9]{2,4}(?![0-9])"),
    "identity": re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])|\b[A-Z]{1,2}[0-9]{6,8}[A-Z]?\b"),
    "account": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "machine": re.compile(r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b|\b(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}\b"),
    "secret": re.compile(r"[A-Za-z0-9_+/-]{16,}={0,2}"),
}
KEYED = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_ -]?key|access[_ -]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"',;]{6,})", re.I)
#: The end of ``email_words``, from its at sign on: no match without it.
WORDS_END = re.compile(r"(?:@|\bat\b)[\])]?\s?[A-Za-z0-9-]++\s?(?:\.|[\[(]?\bdot\b[\])]?)\s?[A-Za-z]{2}", re.I)
#: What must stand in a text for a generator to be tried.
NEEDS = {"email_words": "dot", "phone_local": "0-9", "identity": "0-9", "account": "0-9", "machine": ":-", "secret": "0-9"}
WORDS_BEFORE = (
    ("phone tel call mobile fax cell telefon handy whatsapp ring contact".split()),
    ("mail email write reach contact address".split()),
    ("ssn social security passport id identity identification license licence nino".split()),
    ("iban account bank bic swift konto".split()),
    ("token key secret password passwd pwd api access bearer auth credential apikey".split()),
    ("mac ip host address device server".split()),
    ("version v page pages isbn issn order invoice no nr number ref chapter section figure table fig doi sha commit hash md5 checksum build model serial sku item case year".split()),
    ("price cost usd eur gbp dollars euro total sum amount".split()),
)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) proposed, overlapping or not."""
    out = []
    digits = DIGIT.search(text) is not None
    for kind, pattern in GENERATORS.items():
        need = NEEDS[kind]
        if need == "0-9" and digits or need == ":-" and digits and (":" in text or "-" in text) or need == "dot" and WORDS_END.search(text):
            for m in pattern.finditer(text):
                if kind == "secret" and not (DIGIT.search(m[0]) and re.search("[A-Za-z]", m[0])):
                    continue
                out.append((*m.span(), kind))
    if "=" in text or ":" in text:
        out += [(*m.span(1), "secret") for m in KEYED.finditer(text)]
    return out


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    s = text[start:end]
    n = len(s)
    digits = sum("0" <= c <= "9" for c in s)
    upper, lower = sum(c.isupper() for c in s), sum(c.islower() for c in s)
    counts = Counter(s)
    entropy = -sum(v / n * log2(v / n) for v in counts.values())
    runs = [len(r) for r in re.findall("[0-9]+", s)]
    alone = re.sub("[^0-9]", "", s)
    compact = s.replace(" ", "").upper()
    iban = 0
    if kind == "account" and 15 <= len(compact) <= 34 and compact.isascii() and compact.isalnum():
        iban = int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1
    before = re.findall(r"[a-z]+", text[max(0, start - 40) : start].lower())[-4:]
    switches = sum((a.isdigit() != b.isdigit()) for a, b in zip(s, s[1:], strict=False))
    left, right = text[start - 1 : start], text[end : end + 1]
    hexes = bool(re.fullmatch("[0-9a-fA-F]+", s))
    return [
        *(float(kind == k) for k in ADDED_KINDS),
        n,
        digits,
        digits / n,
        upper / n,
        lower / n,
        entropy,
        len(runs),
        max(runs, default=0),
        min(runs, default=0),
        sum(c in " ./-()" for c in s),
        float("(" in s),
        float(s.count(".")),
        float(s.count("-")),
        float(runs == [3, 2, 4]),
        float(luhn(alone)) if alone else 0.0,
        float(iban),
        switches / n,
        float(hexes),
        float(s[:1] == "0"),
        *(float(any(w in words for w in before)) for words in WORDS_BEFORE),
        float(bool(left) and left in "\"'=:"),
        float(bool(left) and (left.isalnum() or left in "./-$€£#_")),
        float(bool(right) and (right.isalnum() or right in "%/-_°$€£")),
        float("@" in s),
        len(re.findall(r"(?i)\bdot\b|\bat\b", s)),
        float(re.search(r"\.\s", s) is not None),
    ]


def _examples(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Candidates in made-up contexts with their labels."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    pick = lambda s, k: "".join(r.choice(s) for _ in range(k))
    word = lambda: pick("etaoinshrdlucm", r.randrange(2, 10))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def iban() -> str:
        country, body = r.choice(["DE", "FR", "ES", "GB", "IT"]), num(r.choice([18, 20]))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        s = f"{country}{check:02d}{body}"
        return s if r.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    at, dot = (lambda: r.choice([" at ", " (at) ", " [at] ", " AT "])), (lambda: r.choice([" dot ", " (dot) ", " [dot] ", " DOT "]))
    positive = [
        lambda: (r.choice(["write to", "mail", "email:", "reach", word()]), f"{word()}{at()}{word()}{dot()}{r.choice(['com', 'org', 'net', 'de', 'co'])}"),
        lambda: (r.choice(["email", word()]), f"{word()}{dot()}{word()}{at()}{word()}{dot()}{r.choice(['com', 'org', 'eu'])}"),
        lambda: (r.choice(["write to", "mail", word()]), f"{word()}{at()}{word()}.{r.choice(['com', 'org', 'net', 'de'])}"),
        lambda: (r.choice(["call", "tel", "phone:", "mobile", word(), word()]), r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(3)}/{num(6)}"])),
        lambda: (r.choice(["ssn", "social security", word()]), f"{num(3)}-{num(2)}-{num(4)}"),
        lambda: (r.choice(["passport", "id", "licence"]), pick("ABCDEFGHJKLMNP", r.randrange(1, 3)) + num(r.randrange(6, 9))),
        lambda: (r.choice(["iban", "account", word()]), iban()),
        lambda: (r.choice(["mac", "device", word()]), ":".join(pick("0123456789abcdef", 2) for _ in range(6))),
        lambda: (r.choice(["host", word()]), ":".join(pick("0123456789abcdef", 4) for _ in range(8))),
        lambda: (r.choice(["token =", "api_key:", "secret =", "key =", "TOKEN ="]), '"' + pick(r.choice(["0123456789abcdef", "0123456789ABCDEF", alnum]), r.choice([24, 32, 40, 64])) + '"'),
        lambda: (r.choice(["password:", "pwd =", "password ="]), pick(alnum + "!#%", r.randrange(8, 16))),
        lambda: (word(), pick(alnum, r.choice([32, 40, 48]))),
    ]
    negative = [
        lambda: (r.choice(["met", "stay", word()]), f"{word()} at {word()} dot {word()}"),
        lambda: (r.choice(["met", "look", word()]), f"{word()} at {word()}.{r.choice([' ', chr(10)])}{r.choice([word(), word().capitalize()])}"),
        lambda: (r.choice(["isbn", "version", "pages", "order", "invoice", "no", "ref"]), r.choice([f"{num(3)}-{num(3)}-{num(4)}", f"978-{num(1)}-{num(3)}-{num(5)}", f"{num(4)}-{num(4)}", num(9), num(12)])),
        lambda: (r.choice(["on", "in", "from", word()]), r.choice([f"20{num(2)}-0{r.randrange(1, 9)}-{r.randrange(10, 28)}", f"{r.randrange(10, 28)}/0{r.randrange(1, 9)}/20{num(2)}", f"19{num(2)}-19{num(2)}", f"{r.randrange(10, 28)}.{r.randrange(10, 12)}.20{num(2)}"])),
        lambda: (r.choice(["price", "total", word(), "sum"]), r.choice([f"{num(3)} {num(3)} {num(3)}", f"{num(2)} {num(3)}", num(8), num(16), num(14)])),
        lambda: (r.choice(["model", "serial", "figure", "case", word()]), pick("ABCDEFGH", r.randrange(1, 3)) + num(r.randrange(6, 9))),
        lambda: (r.choice(["commit", "sha", "hash", "checksum", "md5"]), pick("0123456789abcdef", r.choice([32, 40, 64]))),
        lambda: (word(), f"{word()}{word()}{word()}{word()}{num(1)}"),
        lambda: (word(), f"{word()}-{word()}-{word()}-20{num(2)}-{word()}"),
        lambda: (word(), f"www/{word()}/{word()}/{word()}/{num(4)}/{word()}"),
        lambda: (word(), f"{word()}_{word()}_{word()}_{num(2)}"),
        lambda: (r.choice(["at", word()]), f"{num(2)}:{num(2)}:{num(2)}:{num(2)}:{num(2)}"),
        lambda: (word(), pick("ABCDEF", 2) + num(2) + " " + " ".join(pick("ABCDEFGH", 4) for _ in range(3))),
        lambda: (r.choice(["version", "v", "section"]), f"{num(2)}.{num(2)}.{num(2)}.{num(3)}"),
        lambda: (r.choice(["key:", "token:", "password:"]), word() + word()),
    ]
    x, y, kinds = [], [], []
    for _ in range(n):
        label = r.random() < 0.5
        lead, body = r.choice(positive if label else negative)()
        core = body.strip('"')
        text = f"{word()} {word()} {lead} {body}{r.choice(['', '.', ',', ' '])} {word()} {word()}"
        lo = text.index(core, text.index(lead) + len(lead))
        for a, b, kind in candidates(text):
            mine = a <= lo and b >= lo + len(core) - 1 or lo <= a and b <= lo + len(core) and b - a >= 0.9 * len(core)
            if a < lo + len(core) and b > lo:
                x.append(features(text, a, b, kind))
                y.append(float(label and mine))
                kinds.append(kind)
    return np.array(x), np.array(y), kinds


@lru_cache(maxsize=1)
def model() -> tuple[boosting.Forest, dict[str, float]]:
    """The trees, and for each kind the least threshold at which at most one in a hundred held-out negatives pass (0.5
    at least)."""
    x, y, _ = _examples(20_260_201, 3000)
    forest = boosting.fit(x, y)
    hx, hy, kinds = _examples(20_260_202, 2000)
    p, kind = forest.probability(hx), np.array(kinds)
    limits = {}
    for k in ADDED_KINDS:
        wrong = np.sort(p[(kind == k) & (hy == 0)])[::-1]
        limits[k] = max(0.5, float(wrong[len(wrong) // 100]) + 1e-9) if len(wrong) else 0.5
    return forest, limits


def added_spans(text: str, base: list[tuple[int, int, str]], forest: boosting.Forest, limits: dict[str, float]) -> list[tuple[int, int, str, float]]:
    taken = sorted((a, b) for a, b, _ in base)
    found = [c for c in dict.fromkeys(candidates(text))]
    if not found:
        return []
    p = forest.probability(np.array([features(text, *c) for c in found]))
    out: list[tuple[int, int, str, float]] = []
    import bisect

    for k in sorted(range(len(found)), key=lambda k: (-p[k], found[k][0], -found[k][1], KINDS.index(found[k][2]))):
        a, b, kind = found[k]
        if p[k] < limits[kind]:
            continue
        i = bisect.bisect_left(taken, (a, b))
        if (i < len(taken) and taken[i][0] < b) or (i and taken[i - 1][1] > a):
            continue
        bisect.insort(taken, (a, b))
        out.append((a, b, kind, float(p[k])))
    return sorted(out)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


SPANS = "array<struct<kind:string,start:long,end:long,score:double,base:boolean>>"


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, spans (kind, start, end, score, base), redacted (the text with each span as ``<KIND>``)."""
    source = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    forest, limits = model()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, redacted = [], []
            for x in batch.column(1):
                text = x.as_py()
                base = base_spans(text)
                every = [(a, b, k, 1.0, True) for a, b, k in base] + [(*s, False) for s in added_spans(text, base, forest, limits)]
                every.sort(key=lambda s: (s[0], KINDS.index(s[2])))
                spans.append([{"kind": k, "start": a, "end": b, "score": p, "base": o} for a, b, k, p, o in every])
                part, at = [], 0
                for a, b, k, _, _ in every:
                    if a >= at:
                        part += [text[at:a], f"<{k.upper()}>"]
                    at = max(at, b)
                redacted.append("".join([*part, text[at:]]) if every else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span)), pa.array(redacted, pa.string())], names=["doc_id", "spans", "redacted"])

    return source.mapInArrow(trimmed(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, spans {SPANS}, redacted string")


def report(docs: DataFrame) -> DataFrame:
    """Contract of ``op10``, derived from the spans, with n_spans (spans of all kinds) after it."""
    found = find(docs)
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as long) as n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def base_digest(text: str | None) -> str:
    return hashlib.sha256(_joined(base_spans(text or "")).encode()).hexdigest()
