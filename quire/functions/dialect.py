"""SQL text for two engines from one definition.

An operator is written once as a SQL template; what Spark and DuckDB spell differently goes through a ``Dialect``, so
that the same definition gives the query that runs on the cluster and the one that checks it on a single machine.
"""

from __future__ import annotations


class Dialect:
    """Spark SQL."""

    name = "spark"

    def lit(self, text: str) -> str:
        """A string literal with no escapes in it."""
        if "'" in text:
            return "concat(" + ", chr(39), ".join(f"r'{x}'" for x in text.split("'")) + ")"
        return f"r'{text}'"

    def like(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.lit(pattern)})"

    def sub(self, x: str, pattern: str, to: str = "") -> str:
        """All matches replaced; groups as $1."""
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(to)})"

    def found(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, 0)"

    def group(self, x: str, pattern: str, k: int) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {k})"

    def times(self, x: str, pattern: str) -> str:
        return f"CAST(regexp_count({x}, {self.lit(pattern)}) AS BIGINT)"

    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS BIGINT)"

    def sort(self, a: str) -> str:
        return f"array_sort({a})"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def minus(self, a: str, b: str) -> str:
        """Distinct elements of a that are not in b."""
        return f"array_except({a}, {b})"

    def joined(self, a: str, sep: str) -> str:
        return f"array_join({a}, {self.lit(sep)})"

    def split(self, x: str, sep: str) -> str:
        return f"split({x}, {self.lit(sep)})"

    def at(self, a: str, k: str) -> str:
        """Element at a 1-based place, null beyond."""
        return f"try_element_at({a}, CAST({k} AS INT))"

    def sliced(self, a: str, lo: str, n: str) -> str:
        return f"slice({a}, {lo}, {n})"

    def map(self, a: str, var: str, body: str) -> str:
        return f"transform({a}, {var} -> {body})"

    def keep(self, a: str, var: str, body: str) -> str:
        return f"filter({a}, {var} -> {body})"

    def any(self, a: str, var: str, body: str) -> str:
        return f"exists({a}, {var} -> {body})"

    def numbers(self, lo: str, hi: str) -> str:
        """lo..hi inclusive, empty if hi < lo."""
        return f"CASE WHEN {hi} < {lo} THEN array() ELSE sequence(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT)) END"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def present(self, a: str) -> str:
        """Without nulls."""
        return f"array_compact({a})"

    def tuple(self, *items: str) -> str:
        """Values that are ordered one after the other."""
        return f"struct({', '.join(items)})"

    def has(self, x: str, part: str) -> str:
        return f"contains({x}, {part})"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def listed(self, x: str, order: str) -> str:
        """Values of a group joined by commas in an order."""
        return f"listagg({x}, ',') WITHIN GROUP (ORDER BY {order})"

    def nlisted(self, x: str, sep: str, order: str) -> str:
        return f"listagg({x}, {sep}) WITHIN GROUP (ORDER BY {order})"

    def collected(self, x: str) -> str:
        return f"array_sort(collect_list({x}))"

    def distance(self, a: str, b: str) -> str:
        """Levenshtein distance in signs."""
        return f"levenshtein({a}, {b})"

    def closer(self, a: str, b: str, bound: int) -> str:
        """Whether the distance is under the bound; beyond it none is computed (-1)."""
        return f"(levenshtein({a}, {b}, {bound}) BETWEEN 0 AND {bound - 1})"

    def repeats(self, x: str, period: int = 16, span: int = 12) -> str:
        """How often the most repeated stretch of up to ``period`` signs follows itself, if that covers ``span`` signs; at
        least four times, else 0. The text is compared with itself a period on; equal stretches of that are repeats."""
        signs, run = f"split({x}, '')", "array_max(transform(regexp_extract_all({}, r'1+', 0), __s -> length(__s)))"
        same = f"array_join(zip_with({signs}, slice({signs}, CAST(__p + 1 AS INT), length({x})), (__a, __b) -> CASE WHEN __a = __b THEN '1' ELSE '0' END), '')"
        times = f"transform(sequence(1, {period}), __p -> CASE WHEN __p < length({x}) THEN coalesce({run.format(same)}, 0) div __p + 1 ELSE 0 END)"
        counted = f"array_max(transform({times}, (__k, __i) -> CASE WHEN __k >= 4 AND __k * (__i + 1) >= {span} THEN __k ELSE 0 END))"
        return f"CAST(CASE WHEN {x} RLIKE r'(?s)(.{{1,{period}}}?)\\1{{3}}' THEN {counted} ELSE 0 END AS BIGINT)".replace("\\\\", "\\")

    def carried(self, x: str, window: str) -> str:
        """The last value that is not null."""
        return f"last_value({x}) IGNORE NULLS OVER ({window})"

    def hashed(self, *tables: str) -> str:
        """Tables whose rows a join holds in a hash, after SELECT: the other side then needs no order. For Spark only."""
        return f"/*+ SHUFFLE_HASH({', '.join(tables)}) */ "

    def div(self, a: str, b: str) -> str:
        return f"CAST(floor(({a}) / ({b})) AS BIGINT)"

    def micros(self, ts: str) -> str:
        return f"CAST(unix_micros(CAST({ts} AS TIMESTAMP)) AS BIGINT)"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, {self.lit('$.' + key)})"

    def unnest(self, table: str, keep: str, array: str, name: str, place: str | None = None) -> str:
        """Rows of ``table`` with columns ``keep``, one for each element of ``array`` (and its 1-based place)."""
        if place:
            return f"(SELECT {keep}, CAST(__p + 1 AS BIGINT) AS {place}, {name} FROM {table} LATERAL VIEW posexplode({array}) __e AS __p, {name})"
        return f"(SELECT {keep}, {name} FROM {table} LATERAL VIEW explode({array}) __e AS {name})"


class DuckDB(Dialect):
    name = "duckdb"

    def hashed(self, *tables: str) -> str:
        return ""

    def tuple(self, *items: str) -> str:
        return f"row({', '.join(items)})"

    def lit(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def sub(self, x: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(to.replace('$', chr(92)))}, 'g')"

    def found(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)})"

    def times(self, x: str, pattern: str) -> str:
        return f"CAST(len(regexp_extract_all({x}, {self.lit(pattern)})) AS BIGINT)"

    def size(self, a: str) -> str:
        return f"CAST(len({a}) AS BIGINT)"

    def sort(self, a: str) -> str:
        return f"list_sort({a})"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"

    def minus(self, a: str, b: str) -> str:
        return f"list_distinct(list_filter({a}, lambda __m: NOT list_contains({b}, __m)))"

    def joined(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, {self.lit(sep)})"

    def split(self, x: str, sep: str) -> str:
        return f"string_split({x}, {self.lit(sep)})"

    def at(self, a: str, k: str) -> str:
        return f"({a})[{k}]"

    def sliced(self, a: str, lo: str, n: str) -> str:
        return f"({a})[({lo}):({lo}) + ({n}) - 1]"

    def map(self, a: str, var: str, body: str) -> str:
        return f"list_transform({a}, lambda {var}: {body})"

    def keep(self, a: str, var: str, body: str) -> str:
        return f"list_filter({a}, lambda {var}: {body})"

    def any(self, a: str, var: str, body: str) -> str:
        return f"(len(list_filter({a}, lambda {var}: {body})) > 0)"

    def numbers(self, lo: str, hi: str) -> str:
        return f"generate_series(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT))"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def present(self, a: str) -> str:
        return f"list_filter({a}, lambda __n: __n IS NOT NULL)"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def listed(self, x: str, order: str) -> str:
        return f"string_agg({x}, ',' ORDER BY {order})"

    def nlisted(self, x: str, sep: str, order: str) -> str:
        return f"string_agg({x}, {sep} ORDER BY {order})"

    def collected(self, x: str) -> str:
        return f"list_sort(list({x}))"

    def distance(self, a: str, b: str) -> str:
        """DuckDB counts bytes: each sign of the pair gets a byte of its own (up to 127 signs; beyond, an error)."""
        signs = f"array_to_string(list_distinct(string_split({a} || {b}, '')), '')"
        own = "array_to_string(list_transform(range(1, 128), lambda __k: chr(CAST(__k AS INT))), '')"
        return f"CASE WHEN length({signs}) > 127 THEN error('too many signs') ELSE levenshtein(translate({a}, {signs}, {own}), translate({b}, {signs}, {own})) END"

    def closer(self, a: str, b: str, bound: int) -> str:
        return f"({self.distance(a, b)} < {bound})"

    def repeats(self, x: str, period: int = 16, span: int = 12) -> str:
        signs = f"string_split({x}, '')"
        same = f"array_to_string(list_transform(list_zip({signs}, ({signs})[__p + 1:], true), lambda __z: CASE WHEN __z[1] = __z[2] THEN '1' ELSE '0' END), '')"
        run = f"coalesce(list_max(list_transform(regexp_extract_all({same}, '1+'), lambda __s: length(__s))), 0) // __p + 1"
        times = f"list_transform(generate_series(1, {period}), lambda __p: list_transform([{run}], lambda __k: CASE WHEN __p < length({x}) AND __k >= 4 AND __k * __p >= {span} THEN __k ELSE 0 END)[1])"
        return f"CAST(list_max({times}) AS BIGINT)"

    def carried(self, x: str, window: str) -> str:
        return f"last_value({x} IGNORE NULLS) OVER ({window})"

    def micros(self, ts: str) -> str:
        return f"CAST(epoch_us({ts}) AS BIGINT)"

    def json(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, {self.lit('$.' + key)})"

    def unnest(self, table: str, keep: str, array: str, name: str, place: str | None = None) -> str:
        if place:
            return f"(SELECT {keep}, CAST(generate_subscripts(__a, 1) AS BIGINT) AS {place}, unnest(__a) AS {name} FROM (SELECT *, {array} AS __a FROM {table}))"
        return f"(SELECT {keep}, unnest({array}) AS {name} FROM {table})"


SPARK, DUCKDB = Dialect(), DuckDB()
