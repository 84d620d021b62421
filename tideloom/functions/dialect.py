"""The few places where Spark SQL and the checking engine's SQL spell the same thing differently.

A plan is written once against a dialect object ``d``; relations are its attributes (``d.posts``), the time that
counts as now is ``d.now``.  :class:`Spark` renders what the engine runs, :class:`Duck` what the tests check it with.
"""

from __future__ import annotations


class Dialect:
    """What both dialects share."""

    name = ""
    string = "string"

    def __init__(self, relations: dict[str, str], now: str):
        self._relations = relations
        self.now = now

    def __getattr__(self, relation: str) -> str:
        try:
            return self._relations[relation]
        except KeyError:
            raise AttributeError(relation) from None

    @staticmethod
    def lit(value: object) -> str:
        """A literal: numbers as they are, strings quoted."""
        if value is None:
            return "null"
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, (int, float)):
            return repr(value)
        return "'" + str(value).replace("'", "''") + "'"

    def any_of(self, expr: str, words: list[str]) -> str:
        """True if the text holds one of the words, whatever their case."""
        return "(" + " or ".join(f"{expr} ilike {self.lit('%' + w + '%')}" for w in words) + ")"

    def count_of(self, expr: str, text: str) -> str:
        """How often a fixed text stands in a string, without overlaps."""
        return self.idiv(f"(length({expr}) - length(replace({expr}, {self.mark(text)}, '')))", str(len(text)))

    def mark(self, text: str) -> str:
        """A literal of characters that the two dialects escape in different ways."""
        return "chr(10)" if text == "\n" else self.lit(text)

    def ago(self, hours: float) -> str:
        return f"({self.now} - interval {int(hours * 60)} minute)"

    def cosine(self, a: str, b: str) -> str:
        return f"({self.dot(a, b)} / nullif(sqrt({self.dot(a, a)}) * sqrt({self.dot(b, b)}), 0))"

    def days(self, late: str, early: str) -> str:
        return f"(({self.micros(late)} - {self.micros(early)}) / 8.64e10)"


class Spark(Dialect):
    name = "spark"

    @staticmethod
    def lit(value: object) -> str:
        return Dialect.lit(value.replace("\\", "\\\\") if isinstance(value, str) else value)

    def stamp(self, text: str) -> str:
        return f"timestamp_ntz'{text}'"

    def micros(self, ts: str) -> str:
        return f"unix_micros(cast({ts} as timestamp))"

    def weekday(self, ts: str) -> str:
        return f"weekday({ts})"

    def joined(self, expr: str, sep: str = ",", distinct: bool = False) -> str:
        """The values of a group in order, as one text."""
        kind = "collect_set" if distinct else "collect_list"
        return f"array_join(sort_array({kind}(cast({expr} as string))), {self.lit(sep)})"

    def count_matches(self, expr: str, pattern: str) -> str:
        return f"regexp_count({expr}, r'{pattern}')"

    def matches(self, expr: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({expr}, r'{pattern}', {group})"

    def replace_all(self, expr: str, pattern: str, by: str) -> str:
        return f"regexp_replace({expr}, r'{pattern}', {self.lit(by)})"

    def tokens(self, expr: str, least: int, most: int) -> str:
        """Words of a-z letters between word boundaries."""
        return f"regexp_extract_all(lower({expr}), r'(?<![\\p{{L}}\\p{{N}}_])[a-z]{{{least},{most}}}+(?![\\p{{L}}\\p{{N}}_])', 0)"

    def explode(self, array: str) -> str:
        return f"explode({array})"

    def split_space(self, expr: str) -> str:
        return f"split({expr}, r'\\s+')"

    def join_array(self, array: str, sep: str) -> str:
        return f"array_join({array}, {self.lit(sep)})"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, v) -> s + v)"

    def spine(self, first: int, last: int) -> str:
        return f"explode(sequence({first}, {last}))"

    def idiv(self, a: str, b: str) -> str:
        return f"({a} div {b})"

    def array(self, *values: str) -> str:
        return f"array({', '.join(values)})"

    def contains(self, array: str, value: str) -> str:
        return f"array_contains({array}, {value})"

    def overlap(self, a: str, b: str) -> str:
        return f"size(array_intersect({a}, {b}))"

    def all_of(self, a: str, b: str) -> str:
        return f"size(array_union({a}, {b}))"

    def first_of(self, array: str, n: int) -> str:
        return f"slice({array}, 1, {n})"

    def json(self, expr: str, key: str) -> str:
        return f"get_json_object({expr}, '$.{key}')"

    def mod(self, a: str, b: str) -> str:
        return f"pmod({a}, {b})"

    def values(self, rows: list[tuple], columns: list[str]) -> str:
        body = ", ".join("(" + ", ".join(self.lit(v) for v in row) + ")" for row in rows)
        return f"(select * from values {body} as t({', '.join(columns)}))"


class Duck(Dialect):
    name = "duck"
    string = "varchar"

    def stamp(self, text: str) -> str:
        return f"timestamp '{text}'"

    def micros(self, ts: str) -> str:
        return f"epoch_us({ts})"

    def weekday(self, ts: str) -> str:
        return f"(isodow({ts}) - 1)"

    def joined(self, expr: str, sep: str = ",", distinct: bool = False) -> str:
        text = f"cast({expr} as varchar)"
        return f"coalesce(string_agg({'distinct ' if distinct else ''}{text}, {self.lit(sep)} order by {text}), '')"

    def count_matches(self, expr: str, pattern: str) -> str:
        return f"len(regexp_extract_all({expr}, '{pattern}'))"

    def matches(self, expr: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({expr}, '{pattern}', {group})"

    def replace_all(self, expr: str, pattern: str, by: str) -> str:
        return f"regexp_replace({expr}, '{pattern}', {self.lit(by)}, 'g')"

    def tokens(self, expr: str, least: int, most: int) -> str:
        return f"list_filter(regexp_extract_all(lower({expr}), '[\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-z]{{{least},{most}}}'))"

    def explode(self, array: str) -> str:
        return f"unnest({array})"

    def split_space(self, expr: str) -> str:
        return f"regexp_split_to_array({expr}, '\\s+')"

    def join_array(self, array: str, sep: str) -> str:
        return f"array_to_string({array}, {self.lit(sep)})"

    def dot(self, a: str, b: str) -> str:
        return f"list_dot_product(cast({a} as double[]), cast({b} as double[]))"

    def spine(self, first: int, last: int) -> str:
        return f"unnest(generate_series({first}, {last}))"

    def idiv(self, a: str, b: str) -> str:
        return f"({a} // {b})"

    def array(self, *values: str) -> str:
        return f"[{', '.join(values)}]"

    def contains(self, array: str, value: str) -> str:
        return f"list_contains({array}, {value})"

    def overlap(self, a: str, b: str) -> str:
        return f"len(list_intersect({a}, {b}))"

    def all_of(self, a: str, b: str) -> str:
        return f"len(list_distinct(list_concat({a}, {b})))"

    def first_of(self, array: str, n: int) -> str:
        return f"list_slice({array}, 1, {n})"

    def json(self, expr: str, key: str) -> str:
        return f"json_extract_string({expr}, '$.{key}')"

    def mod(self, a: str, b: str) -> str:
        return f"((({a}) % ({b})) + ({b})) % ({b})"

    def values(self, rows: list[tuple], columns: list[str]) -> str:
        body = ", ".join("(" + ", ".join(self.lit(v) for v in row) + ")" for row in rows)
        return f"(select * from (values {body}) as t({', '.join(columns)}))"
