"""The read-only SQL surface (Q1-Q3, T5, U6): a gate in front of temporary views."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: words that a statement must not hold, wherever they stand.
FORBIDDEN = ("insert", "update", "delete", "drop", "create", "alter", "replace", "vacuum", "attach", "detach", "begin", "commit", "rollback", "savepoint", "union", "intersect", "except")
MOST_ROWS = 1000


@dataclass
class Answer:
    """What a statement gave: rows up to the cap, or the error; frame is the whole result, not yet computed."""

    ok: bool
    error: str | None = None
    rows: list[dict] = field(default_factory=list)
    truncated: bool = False
    frame: DataFrame | None = None


#: Words that may stand before a parenthesis without being a function.
_KEYWORDS = frozenset("select from where and or not in exists as on by over filter when then else case between like rlike having join using distinct all any some within group order partition end is limit offset cast try_cast extract position substring trim overlay".split())
#: Functions that statements may call: those whose result depends on their arguments alone.
FUNCTIONS = frozenset(
    """count sum avg min max mean stddev stddev_pop stddev_samp variance var_pop var_samp median percentile percentile_approx approx_count_distinct count_if
    bool_and bool_or every first last any_value collect_list collect_set array_agg group_concat listagg string_agg max_by min_by mode corr covar_pop covar_samp skewness kurtosis
    row_number rank dense_rank percent_rank ntile lag lead first_value last_value nth_value cume_dist
    abs ceil ceiling floor round bround sign sqrt cbrt power pow exp ln log log2 log10 mod pmod greatest least div degrees radians sin cos tan asin acos atan atan2 pi e hash xxhash64 crc32 md5 sha sha1 sha2
    length char_length character_length octet_length lower upper lcase ucase trim ltrim rtrim substr substring left right replace translate concat concat_ws instr locate position lpad rpad repeat reverse split split_part
    startswith endswith contains regexp_extract regexp_replace regexp_like regexp_count regexp like ilike rlike initcap ascii chr char format_number format_string printf levenshtein soundex base64 unbase64 hex unhex
    coalesce ifnull nvl nvl2 nullif if iff isnull isnotnull isnan nanvl typeof cast try_cast int bigint double float string boolean date timestamp decimal
    date_format date_add date_sub datediff year month day dayofmonth dayofweek dayofyear hour minute second quarter weekofyear to_date to_timestamp unix_timestamp from_unixtime date_trunc trunc add_months last_day months_between extract make_date
    array map struct named_struct size cardinality array_contains array_distinct array_join array_position array_sort sort_array array_max array_min array_union array_intersect array_except element_at get explode explode_outer posexplode inline
    transform filter exists forall aggregate reduce zip_with map_keys map_values map_entries flatten slice sequence arrays_zip get_json_object json_tuple to_json from_json struct bit_count bit_and bit_or bit_xor""".split()
)
_TOKEN = re.compile(
    r"""(?P<text>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")|(?P<quoted>`(?:[^`]|``)*`)|(?P<note>--[^\n]*|/\*.*?\*/)|(?P<word>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<space>\s+)|(?P<sign>.)""",
    re.DOTALL,
)


def _tokens(sql: str) -> list[tuple[str, str]]:
    """(kind, text) of words, quoted names, texts, numbers and signs, without white space and comments."""
    return [(m.lastgroup, m.group()) for m in _TOKEN.finditer(sql) if m.lastgroup not in ("space", "note")]


def gate(sql: str | None) -> tuple[str, str | None]:
    """(statement, None) or ("", error). Texts in quotes and comments may say anything; what is looked at is the rest."""
    text = (sql or "").strip()
    if not text:
        return "", "Empty SQL query"
    tokens = _tokens(text)
    while tokens and tokens[-1] == ("sign", ";"):
        tokens.pop()
        text = text[: text.rindex(";")].rstrip()
    words = [t.lower() for k, t in tokens if k == "word"]
    first = tokens[0][1].lower() if tokens else ""
    describes = first == "pragma" and words[1:2] == ["table_info"]
    if not (first == "select" or (first == "explain" and words[1:2] == ["select"]) or describes):
        return "", "Only SELECT, EXPLAIN SELECT, or PRAGMA table_info are allowed"
    if bad := sorted(set(words) & set(FORBIDDEN)):
        return "", f"Database modification or set-operation keywords are not allowed: {', '.join(bad)}"
    if ("sign", ";") in tokens:
        return "", "Multiple statements are not allowed"
    if describes:
        name = re.fullmatch(r"(?is)pragma\s+table_info\s*\(\s*['\"`]?(\w+)['\"`]?\s*\)", text)
        return (f"DESCRIBE TABLE {name[1]}", None) if name else ("", "PRAGMA table_info needs a table")
    for (kind, name), after in zip(tokens, tokens[1:], strict=False):
        plain = name.strip("`").lower()
        if after == ("sign", "(") and (kind == "quoted" or kind == "word" and plain not in _KEYWORDS) and plain not in FUNCTIONS:
            return "", f"Function is not allowed: {plain}"
    return text, None


class Surface:
    """Tables that statements may read, as temporary views of their own names in the tables' session."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
        self.spark, self.tables = spark, dict(tables)
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)

    def _foreign(self, statement: str) -> str | None:
        """A relation that isn't one of the tables, from the parsed plan and its subqueries."""
        inner = re.sub(r"(?i)^explain\b", "", statement)  # a command doesn't show the plan that it holds
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(inner).treeString()
        names = re.findall(r"UnresolvedRelation \[(.*?)\], \[", plan) + re.findall(r"UnresolvedTableOrView \[(.*?)\]", plan)
        known = {n.lower() for n in self.tables}
        odd = next((n for n in names if n.strip("`").lower() not in known), None)
        if odd is None and (other := re.search(r"Unresolved(TableValuedFunction|TVF\w*|InlineTable|PathBasedTable\w*)", plan)):
            odd = other.group()
        return odd

    def run(self, sql: str | None) -> Answer:
        """Plans a statement; nothing is computed yet, and errors are returned."""
        statement, error = gate(sql)
        if error:
            return Answer(False, error)
        try:
            if (odd := self._foreign(statement)) is not None:
                return Answer(False, f"No such table: {odd}")
            return Answer(True, frame=self.spark.sql(statement))
        except Exception as e:  # noqa: BLE001  whatever is wrong with a statement is its answer
            return Answer(False, str(e).splitlines()[0])

    def query(self, sql: str | None, most: int = MOST_ROWS) -> Answer:
        """Runs a statement and returns `most` rows at most; one row more is asked for, to tell a cut."""
        answer = self.run(sql)
        if not answer.ok:
            return answer
        try:
            rows = [r.asDict(recursive=True) for r in answer.frame.limit(most + 1).collect()]
        except Exception as e:  # noqa: BLE001
            return Answer(False, str(e).splitlines()[0])
        return Answer(True, rows=rows[:most], truncated=len(rows) > most, frame=answer.frame)
