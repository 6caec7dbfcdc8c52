"""SQL text that Spark and DuckDB both run: the few functions they spell differently."""

from __future__ import annotations


class Spark:
    #: Words of a WITH clause: that views may be recursive, and that each is computed once.
    RECURSIVE, ONCE = "", ""
    ANTI = "LEFT ANTI JOIN"

    def rx(self, pattern: str) -> str:
        return "r'" + pattern + "'"

    def matches(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, {self.rx(pattern)}, 0)"

    def found(self, text: str, pattern: str) -> str:
        return f"regexp_like({text}, {self.rx(pattern)})"

    def replace_all(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, {self.rx(pattern)}, '{by}')"

    def group(self, n: int) -> str:
        """A group of the pattern in the text that replaces it."""
        return f"${n}"

    def struct(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def array(self, *items: str) -> str:
        return "array(" + ", ".join(items) + ")"

    def sha(self, text: str) -> str:
        return f"sha2({text}, 256)"

    def one_json(self, text: str) -> str:
        return f"coalesce(json_array_length(concat('[', {text}, ']')), 0) = 1"

    def size(self, array: str) -> str:
        return f"CAST(size({array}) AS BIGINT)"

    def joined(self, value: str, order: str, sep: str = " ") -> str:
        return f"array_join(transform(array_sort(collect_list(struct({order} AS o, {value} AS v))), x -> x.v), '{sep}')"

    def elements(self, table: str, columns: str, array: str, keep: str = "") -> str:
        """One row for each element: columns, pos, piece. keep: a condition on x."""
        array = f"filter({array}, x -> {keep})" if keep else array
        return f"SELECT {columns}, CAST(pos AS BIGINT) AS pos, piece FROM {table} LATERAL VIEW posexplode({array}) e AS pos, piece"

    def trimmed(self, array: str) -> str:
        return f"transform({array}, x -> {self.replace_all('x', TRIM, '')})"

    def split(self, text: str, by: str) -> str:
        return f"split({text}, {self.rx(by)})"

    def except_(self, a: str, b: str) -> str:
        return f"array_join(array_sort(array_except({a}, {b})), ',')"

    def intersect(self, a: str, b: str) -> str:
        return f"array_join(array_sort(array_intersect({a}, {b})), ',')"

    def words(self, *values: str) -> str:
        return "array(" + ", ".join(f"'{v}'" for v in values) + ")"

    def before(self, text: str, sep: str) -> str:
        """The text up to the first `sep`, or all of it."""
        return f"split_part({text}, '{sep}', 1)"

    def at(self, needle: str, text: str) -> str:
        return f"instr({text}, {needle})"


class Duck(Spark):
    RECURSIVE, ONCE = "RECURSIVE ", "MATERIALIZED "
    ANTI = "ANTI JOIN"

    def rx(self, pattern: str) -> str:
        return "'" + pattern + "'"

    def matches(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, {self.rx(pattern)})"

    def found(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, {self.rx(pattern)})"

    def replace_all(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, {self.rx(pattern)}, '{by}', 'g')"

    def group(self, n: int) -> str:
        return f"\\{n}"

    def struct(self, **fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def array(self, *items: str) -> str:
        return "[" + ", ".join(items) + "]"

    def sha(self, text: str) -> str:
        return f"sha256({text})"

    def one_json(self, text: str) -> str:
        return f"json_valid({text})"

    def size(self, array: str) -> str:
        return f"CAST(len({array}) AS BIGINT)"

    def joined(self, value: str, order: str, sep: str = " ") -> str:
        return f"string_agg({value}, '{sep}' ORDER BY {order}, {value})"

    def elements(self, table: str, columns: str, array: str, keep: str = "") -> str:
        array = f"list_filter({array}, lambda x: {keep})" if keep else array
        return f"SELECT {columns}, CAST(unnest(range(len(_l))) AS BIGINT) AS pos, unnest(_l) AS piece FROM (SELECT *, {array} AS _l FROM {table}) _t"

    def trimmed(self, array: str) -> str:
        return f"list_transform({array}, lambda x: {self.replace_all('x', TRIM, '')})"

    def split(self, text: str, by: str) -> str:
        return f"string_split_regex({text}, {self.rx(by)})"

    def except_(self, a: str, b: str) -> str:
        return f"array_to_string(list_sort(list_distinct(list_filter({a}, lambda x: NOT list_contains({b}, x)))), ',')"

    def intersect(self, a: str, b: str) -> str:
        return f"array_to_string(list_sort(list_distinct(list_filter({a}, lambda x: list_contains({b}, x)))), ',')"

    def words(self, *values: str) -> str:
        return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SPARK, DUCK = Spark(), Duck()

# The white space that trimming takes, and what counts as a word.
TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
WORD = rf"{LETTER}+(?:[\x27’\-]{LETTER}+)*|\p{{Nd}}+(?:[.,]\p{{Nd}}+)?"
TOKEN = r"__(?:NAME|TAG)_\d+__"
HYPHENATED = rf"{LETTER}+(?:-{LETTER}+)+"
