"""SQL text in the MySQL-like dialect, run on Spark.

Most of the dialect is Spark SQL already. What differs is rewritten on tokens, so that strings and comments stay as they
are: case-insensitive LIKE with classes, LIKE BINARY, the vector operators ``<->``, ``<*>`` and ``<=>``, one-based
subscripts, rounding casts, percent formats, ``LIMIT offset, n``, NULL as the highest value of an ORDER BY, ``@var`` and
``@@var``, the information schema, and the table functions SCAN, VECTOR, TEXT_SEARCH and HYBRID_SEARCH. With the hints
``/*+ vector_pre */`` and ``/*+ text_search_pre */`` the query's WHERE restricts the rows that are searched; it may name
columns of the searched table only then. VECTOR's map of index parameters has no effect, as the search is exact.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import system
from ..functions.strings import like_regex
from ..functions.temporal import pattern
from ..operators import vector
from ..operators.hybrid import hybrid_search
from ..operators.text import text_search
from ..sources import catalog
from .statements import Statements

_TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|'(?:''|\\.|[^'\\])*'|\"[^\"]*\"|`[^`]*`|\d+\.?\d*(?:[eE][+-]?\d+)?|@@[\w.]+|@\w+|[A-Za-z_][\w$]*|:\w+|<->|<\*>|<=>|<=|>=|<>|!=|\|\||.", re.S)
OPERATORS = {"<->": "L2", "<*>": "INNER_PRODUCT", "<=>": "COSINE"}
#: Functions of the dialect by the name of Spark's, where only the name differs.
NAMES = {"ucase": "upper", "lcase": "lower", "pow": "power", "curdate": "current_date", "from_unixtime": "timestamp_seconds", "schema": "current_database", "database": "current_database", "instr": "instr", "mod": "try_mod"}
TEMPORARY = {
    "l2Distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v)"),
    "IPDistance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "1D - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)"),
    "cosineDistance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "1D - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v) / ((sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) + 1e-30D) * (sqrt(aggregate(b, 0D, (s, v) -> s + v * v)) + 1e-30D))"),
    "mid": ("s STRING, p DOUBLE, n DOUBLE", "STRING", "CASE WHEN round(n) < 0 THEN '' ELSE substring(s, CAST(round(p) AS INT), CAST(round(n) AS INT)) END"),
    "format": ("x DECIMAL(38,10), d INT", "STRING", "replace(format_number(round(x, 10), d), ',', '')"),
    "curtime": ("", "STRING", "date_format(current_timestamp(), 'HH:mm:ss')"),
}
#: Where an ORDER BY and a WHERE end.
AFTER_ORDER = {"limit", "offset", "rows", "range", "union", "intersect", "except"}
AFTER_WHERE = {"group", "having", "order", "limit", "union", "intersect", "except", "window"}
FUNCTION = {"L2": "l2Distance", "INNER_PRODUCT": "IPDistance", "COSINE": "cosineDistance"}


class Dialect:
    """A session's statements, variables and search tables."""

    def __init__(self, spark: SparkSession, metrics: dict[str, str] | None = None):
        """``metrics``: metric by ``table.column`` for VECTOR; L2 where none is given."""
        self.spark, self.metrics, self.prepared = spark, {k.lower(): v for k, v in (metrics or {}).items()}, {}
        self.users: dict[str, str] = {}
        self.variables: dict[str, str] = {}
        self.hints: set[str] = set()
        self.statements = Statements(self)
        for name, (args, kind, body) in TEMPORARY.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")

    def sql(self, text: str, args: list | dict | None = None) -> DataFrame:
        if m := re.match(r"\s*PREPARE\s+(\w+)\s+FROM\s+'((?:''|[^'])*)'\s*;?\s*$", text, re.I | re.S):
            self.prepared[m[1].lower()] = m[2].replace("''", "'")
            return self.spark.createDataFrame([], "ok int")
        if m := re.match(r"\s*EXECUTE\s+(\w+)(?:\s+USING\s+(.*?))?\s*;?\s*$", text, re.I | re.S):
            values = [self.spark.sql(f"SELECT {v} AS v").first().v for v in m[2].split(",")] if m[2] else []
            return self.sql(self.prepared[m[1].lower()], values)
        done = self.statements.run(text)
        if done is not None:
            return done
        self.hints = {h.lower() for h in re.findall(r"/\*\+\s*(vector_pre|text_search_pre)\s*\*/", text, re.I)}
        return self.spark.sql(self.translate(text), args=args) if args else self.spark.sql(self.translate(text))

    def translate(self, text: str) -> str:
        return "".join(self._rewrite(self.tokens(text.strip().rstrip(";"))))

    @staticmethod
    def tokens(text: str) -> list[str]:
        return _TOKEN.findall(text)

    def _rewrite(self, t: list[str]) -> list[str]:
        out: list[str] = []
        i = 0
        while i < len(t):
            word, low = t[i], t[i].lower()
            after = self._skip(t, i + 1)
            call = after < len(t) and t[after] == "("
            if low in ("vector", "text_search", "hybrid_search", "scan") and call and self._last(out) in ("from", "join", ","):
                end = self._close(t, after)
                out.append(self._table(low, self._split(t[after + 1 : end]), self._before_search(low, t, end + 1)))
                i = end + 1
            elif low == "information_schema" and t[i + 1 : i + 2] == ["."]:
                out.append(self._view(catalog.information_schema(self.spark, t[i + 2])))
                i += 3
            elif word.startswith("@@"):
                value = {"on": "1", "off": "0"}.get(str(v := system.known(self.spark, word[2:], self.variables)).lower(), v)
                out.append("NULL" if value is None else value if value.isdigit() else "'" + value.replace("'", "\\'") + "'")
                i += 1
            elif word.startswith("@") and len(word) > 1:
                out.append(self.users.get(word[1:].lower(), "NULL"))
                i += 1
            elif low == "version" and call:
                out.append(f"'{system.VERSION}'")
                i = self._close(t, after) + 1
            elif low == "by" and self._last(out) == "order":
                end = self._until(t, i + 1, AFTER_ORDER)
                items = ["".join(self._rewrite(self.tokens(x))).strip() for x in self._split(t[i + 1 : end])]
                high = [x if re.search(r"\bNULLS\s+(FIRST|LAST)$", x, re.I) else x + (" NULLS FIRST" if re.search(r"\bDESC$", x, re.I) else " NULLS LAST") for x in items]
                out.append("BY " + ", ".join(high) + " ")
                i = end
            elif low == "array" and after < len(t) and t[after] == "[":
                end = self._close(t, after)
                out.append("array(" + "".join(self._rewrite(t[after + 1 : end])) + ")")
                i = end + 1
            elif word == "[" and out:
                end = self._close(t, i)
                base = self._take(out)
                out.append(f"try_element_at({base}, {''.join(self._rewrite(t[i + 1 : end]))})")
                i = end + 1
            elif word in OPERATORS:
                base, (right, end) = self._take(out), self._operand(t, after)
                out.append(f"{FUNCTION[OPERATORS[word]]}({base}, {right})")
                i = end
            elif low == "like":
                if after < len(t) and t[after].lower() == "binary":
                    out.append("LIKE")
                    i = after + 1
                elif after < len(t) and t[after].startswith("'") and "[" in t[after]:
                    out.append("RLIKE '(?is)^" + like_regex(t[after][1:-1]).replace("\\", "\\\\") + "$'")
                    i = after + 1
                else:
                    out.append("ILIKE")
                    i += 1
            elif low == "cast" and call:
                end = self._close(t, after)
                inner = self._rewrite(t[after + 1 : end])
                body = "".join(inner)
                m = re.match(r"(.*)\s+AS\s+(INT|INTEGER|BIGINT|LONG)\s*$", body, re.I | re.S)
                out.append(f"CAST(round(CAST({m[1]} AS DECIMAL(38,10))) AS {m[2]})" if m else f"CAST({body})")
                i = end + 1
            elif low in ("date_format", "timestamp_format") and call:
                end = self._close(t, after)
                parts = self._split(t[after + 1 : end])
                fmt = parts[1].strip() if len(parts) > 1 else ("'%Y-%m-%d'" if low == "date_format" else "'%Y-%m-%d %H:%i:%s'")
                out.append("date_format(" + self.translate(parts[0]) + ", '" + pattern(fmt[1:-1]).replace("'", "\\'") + "')")
                i = end + 1
            elif low == "limit":
                m = re.match(r"\s*(\d+)\s*,\s*(\d+)", "".join(t[i + 1 : i + 7]))
                if m:
                    out.append(f"LIMIT {m[2]} OFFSET {m[1]}")
                    i += 1 + len(_TOKEN.findall(m[0]))
                else:
                    out.append(word)
                    i += 1
            elif low in NAMES and call:
                out.append(NAMES[low])
                i += 1
            else:
                out.append(word)
                i += 1
        return out

    @staticmethod
    def _until(t: list[str], i: int, words: set[str]) -> int:
        """Where one of the words follows outside of brackets, or the brackets around close."""
        depth = 0
        for j in range(i, len(t)):
            depth += (t[j] in "([") - (t[j] in ")]") if len(t[j]) == 1 else 0
            if depth < 0 or not depth and t[j].lower() in words:
                return j
        return len(t)

    def _before_search(self, name: str, t: list[str], i: int) -> tuple[str, str] | None:
        """The alias of a searched table and its query's condition, if a hint asks for the condition first."""
        if f"{name}_pre" not in self.hints:
            return None
        at = self._until(t, i, {"where"} | AFTER_WHERE)
        if at == len(t) or t[at].lower() != "where":
            return None
        alias = [x for x in t[i:at] if not x.isspace() and x.lower() != "as"]
        return alias[0] if alias else "", "".join(self._rewrite(t[at + 1 : self._until(t, at + 1, AFTER_WHERE)]))

    @staticmethod
    def _skip(t: list[str], i: int) -> int:
        while i < len(t) and t[i].isspace():
            i += 1
        return i

    @staticmethod
    def _last(out: list[str]) -> str:
        return next((x.lower() for x in reversed(out) if not x.isspace()), "")

    @staticmethod
    def _close(t: list[str], i: int) -> int:
        depth = 0
        for j in range(i, len(t)):
            depth += (t[j] in "([") - (t[j] in ")]") if len(t[j]) == 1 else 0
            if not depth:
                return j
        raise ValueError("unbalanced brackets")

    def _split(self, t: list[str]) -> list[str]:
        parts, depth = [""], 0
        for x in t:
            depth += (x in "([") - (x in ")]") if len(x) == 1 else 0
            if x == "," and not depth:
                parts.append("")
            else:
                parts[-1] += x
        return parts

    @staticmethod
    def _take(out: list[str]) -> str:
        """Removes and returns the operand that ``out`` ends with."""
        while out and out[-1].isspace():
            out.pop()
        base = out.pop()
        if base == ")":
            depth = 1
            while depth:
                x = out.pop()
                depth += (x == ")") - (x == "(")
                base = x + base
            if out and re.fullmatch(r"[A-Za-z_]\w*", out[-1]):
                base = out.pop() + base
        while out and out[-1] == ".":
            base = out.pop() + base
            base = out.pop() + base
        return base

    def _operand(self, t: list[str], i: int) -> tuple[str, int]:
        end = i + 1
        while end < len(t) and (t[end] in (".", "(", "[") or t[end - 1] == "."):
            end = self._close(t, end) + 1 if t[end] in "([" else end + 1
        return "".join(self._rewrite(t[i:end])), end

    def _view(self, df: DataFrame) -> str:
        name = f"search_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(name)
        return name

    def _searched(self, table: str, before: tuple[str, str] | None) -> tuple[DataFrame, Column | None]:
        df = self.spark.table(table)
        return (df.alias(before[0] or table), F.expr(before[1])) if before else (df, None)

    def _vector(self, parts: list[str], before: tuple[str, str] | None = None) -> DataFrame:
        table, column, query, n = (p.strip() for p in parts[:4])
        values = [float(v) for v in self.spark.sql(f"SELECT {self.translate(query)} AS v").first().v]
        metric = self.metrics.get(f"{table}.{column}".lower(), "L2")
        df, first = self._searched(table, before)
        return vector.vector_search(df, column, values, int(n), metric, df.columns[0], first, name=f"{column}$distance")

    def _text(self, parts: list[str], before: tuple[str, str] | None = None) -> DataFrame:
        table, index, query, n = (p.strip() for p in parts[:4])
        df, first = self._searched(table, before)
        return text_search(df, df.columns[0], query[1:-1], int(n), default=index, prefilter=first, name=f"{index}$rank_bm25")

    def _table(self, name: str, parts: list[str], before: tuple[str, str] | None = None) -> str:
        if name == "scan":
            return parts[0].strip()
        if name == "vector":
            return self._view(self._vector(parts, before))
        if name == "text_search":
            return self._view(self._text(parts, before))
        found, weights = {}, []
        for p in parts:
            m = re.match(r"\s*(text_search|vector)\s*\((.*)\)\s*$", p, re.I | re.S)
            if m:
                found[m[1].lower()] = self._split(_TOKEN.findall(m[2]))
            else:
                weights.append(float(p))
        v, t = self._vector(found["vector"]), self._text(found["text_search"])
        text_weight = weights[0] if weights else 0.5
        vector_weight = weights[1] if len(weights) > 1 else 0.5
        return self._view(hybrid_search(v, t, v.columns[0], t.columns[0], v.columns[-1], t.columns[-1], vector_weight, text_weight))
