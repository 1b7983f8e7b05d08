"""Statements that aren't queries: DDL, DML, SHOW, SET, LOAD DATA, INTO OUTFILE, ANALYZE and EXPLAIN.

Tables are managed Parquet tables of the session's catalog; keys, required and self-numbered columns are table properties.
INSERT appends. UPDATE and DELETE write a new version beside the table, which then takes its name; if the job fails before
that, the old version stays. Results: one row (affected) for changes, the rows asked for otherwise.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import system
from ..functions.strings import like
from ..operators import dml
from ..operators.statistics import analyze_table
from ..sources import catalog
from ..sources.delimited import export_outfile, load_data

#: Types of the dialect by Spark's.
TYPES = {"varchar": "STRING", "char": "STRING", "text": "STRING", "any": "STRING", "time": "STRING", "integer": "INT", "long": "BIGINT", "bool": "BOOLEAN", "datetime": "TIMESTAMP", "real": "DOUBLE", "varbinary": "BINARY", "blob": "BINARY"}
_NAME = r"([\w.`]+)"
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "0": "\0"}


def _plain(quoted: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), quoted[1:-1].replace("''", "'"), flags=re.S)


def _delimiters(text: str) -> dict:
    """Options of FIELDS and LINES clauses as arguments of load_data and export_outfile."""
    fields, lines = re.search(r"\b(?:FIELDS|COLUMNS)\b(.*?)(?=\bLINES\b|\bIGNORE\b|$)", text, re.I | re.S), re.search(r"(?<!\d )\bLINES\b(.*)$", text, re.I | re.S)
    out = {}
    for part, names in ((fields, {"TERMINATED": "sep", "ENCLOSED": "enclosed", "ESCAPED": "escaped"}), (lines, {"TERMINATED": "line_end", "STARTING": "starting"})):
        for word, name in names.items():
            if part and (m := re.search(word + r"\s+BY\s+('(?:''|\\.|[^'\\])*')", part[1], re.I | re.S)):
                out[name] = _plain(m[1])
    return out


class Statements:
    def __init__(self, dialect):
        self.d, self.spark = dialect, dialect.spark

    def run(self, text: str) -> DataFrame | None:
        """The statement's result, or None if the text is a query."""
        for pattern, method in _PATTERNS:
            if m := pattern.fullmatch(text.strip().rstrip(";").strip()):
                return method(self, *m.groups())
        return None

    def _affected(self, n: int = 0) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "affected long")

    def _properties(self, table: str) -> dict[str, str]:
        return {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {table}").collect() if r.key.startswith("tidewater.")}

    def _list(self, table: str, name: str) -> list[str]:
        return [c for c in self._properties(table).get(f"tidewater.{name}", "").split(",") if c]

    def _mark(self, table: str, properties: dict[str, str]) -> None:
        if properties:
            self.spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES (" + ", ".join(f"'{k}' = '{v}'" for k, v in properties.items()) + ")")

    def _write(self, rows: DataFrame, table: str) -> int:
        """Appends the rows and counts them in the same pass."""
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.insertInto(table)
        return seen.get["n"]

    def _take_name(self, table: str, new: str) -> None:
        marks = self._properties(table)
        self.spark.sql(f"DROP TABLE {table}")
        self.spark.sql(f"ALTER TABLE {new} RENAME TO {table}")
        self._mark(table, marks)

    def _version(self, table: str, rows: DataFrame) -> None:
        new = f"{table}_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {new} LIKE {table}")
        try:
            self._write(rows, new)
        except Exception:
            self.spark.sql(f"DROP TABLE IF EXISTS {new}")
            raise
        self._take_name(table, new)

    # DDL

    def _column(self, item: str) -> tuple[str, set[str]]:
        """A column's definition for Spark, and its marks: key, required, numbered."""
        name, rest = item.strip().split(None, 1)
        marks = set()
        for pattern, mark in ((r"\bPRIMARY\s+KEY\b", "key"), (r"\bNOT\s+NULL\b", "required"), (r"\bAUTO_INCREMENT\b", "numbered"), (r"\bNULL\b(?=\s*$)", None)):
            if mark is None and re.search(r"\bDEFAULT\s+NULL\s*$", rest, re.I):
                continue
            if re.search(pattern, rest, re.I):
                rest = re.sub(pattern, "", rest, flags=re.I)
                marks.add(mark)
        m = re.match(r"(\w+)(\s*\([\d\s,]*\))?(\s+ARRAY\b)?", rest)
        kind = TYPES.get(m[1].lower(), m[1])
        size = m[2] if m[2] and kind.lower() in ("decimal", "numeric") else ""
        kind = f"ARRAY<{kind}{size}>" if m[3] else kind + (size or "")
        return f"{name} {kind} {rest[m.end():].strip()}".strip(), marks

    def create_table(self, unless: str | None, table: str, body: str) -> DataFrame:
        if self.spark.catalog.tableExists(table):
            if unless:
                return self._affected()
            raise ValueError(f"table exists: {table}")
        columns, marks = [], {"key": [], "required": [], "numbered": []}
        for item in self.d._split(self.d.tokens(body)):
            if m := re.match(r"\s*(?:CONSTRAINT\s+\w+\s+)?PRIMARY\s+KEY\s*\((.*)\)", item, re.I | re.S):
                marks["key"] += [c.strip(" `") for c in m[1].split(",")]
            elif not re.match(r"\s*(UNIQUE|INDEX|KEY)\b", item, re.I):  # filters reach the scan without an index
                column, found = self._column(item)
                columns.append(column)
                for k in found - {None}:
                    marks[k].append(column.split()[0].strip("`"))
        self.spark.sql(f"CREATE TABLE {table} ({', '.join(columns)}) USING parquet")
        self._mark(table, {f"tidewater.{k}": ",".join(v) for k, v in marks.items() if v})
        return self._affected()

    def create_as(self, table: str, query: str) -> DataFrame:
        self.d.sql(query).write.saveAsTable(table)
        return self._affected()

    def create_view(self, replace: str | None, view: str, query: str) -> DataFrame:
        rows = self.d.sql(query)
        rows.createOrReplaceTempView(view) if replace else rows.createTempView(view)
        return self._affected()

    def drop(self, kind: str, maybe: str | None, name: str) -> DataFrame:
        if kind.lower() == "view" and self.spark.catalog.dropTempView(name):
            return self._affected()
        self.spark.sql(f"DROP {'TABLE' if 'view' in kind.lower() else kind} {maybe or ''} {name}")
        return self._affected()

    def truncate(self, table: str) -> DataFrame:
        self.spark.sql(f"TRUNCATE TABLE {table}")
        return self._affected()

    def add_column(self, table: str, item: str) -> DataFrame:
        self.spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({self._column(item)[0]})")
        return self._affected()

    def drop_column(self, table: str, column: str) -> DataFrame:
        if column in self._list(table, "key"):
            raise ValueError(f"key column: {column}")
        new = f"{table}_{uuid.uuid4().hex}"
        self.spark.table(table).drop(column).write.saveAsTable(new)
        self._take_name(table, new)
        return self._affected()

    # DML

    def insert(self, ignore: str | None, table: str, columns: str | None, source: str) -> DataFrame:
        kept = self.spark.table(table)
        rows = self.d.sql(source if not re.match(r"VALUES\b", source, re.I) else f"SELECT * FROM {source}")
        names = [c.strip(" `") for c in columns.split(",")] if columns else kept.columns
        if len(names) != len(rows.columns):
            raise ValueError("as many values as columns are needed")
        rows = rows.toDF(*names)
        given, numbered = {n.lower() for n in names}, self._list(table, "numbered")
        for c in numbered:
            if c.lower() not in given:
                start = (kept.agg(F.max(c).alias("m")).first().m or 0) + 1
                rows = dml.with_auto_increment(rows, c, names, start)
                given.add(c.lower())
        default = {f.name: f.metadata.get("CURRENT_DEFAULT", "NULL") for f in kept.schema}
        rows = rows.select(*[(F.col(f.name) if f.name.lower() in given else F.expr(default[f.name])).cast(f.dataType).alias(f.name) for f in kept.schema])
        key = self._list(table, "key")
        for c in {*key, *self._list(table, "required")}:
            rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"column {c} cannot be null"))).otherwise(F.col(c)))
        if key:
            if not ignore:
                dml.insert(kept, rows, key, "error")
            rows = rows.dropDuplicates(key).join(kept.select(*key), key, "left_anti").select(*kept.columns)
        return self._affected(self._write(rows, table))

    def update(self, table: str, changes: str, condition: str | None) -> DataFrame:
        rows, where = self.spark.table(table), F.expr(self.d.translate(condition)) if condition else F.lit(True)
        new = {}
        for item in self.d._split(self.d.tokens(changes)):
            name, value = item.split("=", 1)
            new[next(c for c in rows.columns if c.lower() == name.strip(" `\n").lower())] = F.expr(self.d.translate(value))
        if set(new) & set(self._list(table, "key")):
            raise ValueError("key columns can't be updated")
        n = dml.updated(rows, where, new).first().affected
        if n:
            self._version(table, dml.update(rows, where, new))
        return self._affected(n)

    def delete(self, table: str, condition: str | None) -> DataFrame:
        rows, where = self.spark.table(table), F.expr(self.d.translate(condition)) if condition else F.lit(True)
        n = rows.where(where).count()
        if n:
            self._version(table, dml.delete(rows, where))
        return self._affected(n)

    # Files

    def load(self, path: str, table: str, options: str) -> DataFrame:
        kept = self.spark.table(table)
        ignore, encoding = re.search(r"\bIGNORE\s+(\d+)\s+(?:LINES|ROWS)", options, re.I), re.search(r"CHARACTER\s+SET\s+'?([\w-]+)", options, re.I)
        more = {"ignore": int(ignore[1])} if ignore else {}
        more |= {"encoding": {"utf8": "UTF-8", "utf8mb4": "UTF-8"}.get(encoding[1].lower(), encoding[1])} if encoding else {}
        rows = load_data(self.spark, _plain(path), kept.schema, **_delimiters(options), **more)
        key = self._list(table, "key")
        if key:  # rows whose key is there are passed over
            rows = rows.dropDuplicates(key).join(kept.select(*key), key, "left_anti").select(*kept.columns)
        return self._affected(self._write(rows, table))

    def outfile(self, head: str, path: str, options: str, tail: str | None) -> DataFrame:
        export_outfile(self.d.sql(head + " " + (tail or "")), _plain(path), **_delimiters(options))
        return self._affected()

    # SHOW, SET and the rest

    def show_tables(self, pattern: str | None) -> DataFrame:
        return catalog.show_tables(self.spark, _plain(pattern) if pattern else "%")

    def show_columns(self, table: str, pattern: str | None = None) -> DataFrame:
        return catalog.show_columns(self.spark, table, _plain(pattern) if pattern else "%")

    def show_databases(self) -> DataFrame:
        return catalog.schemata(self.spark).select("schema_name")

    def show_variables(self, pattern: str | None) -> DataFrame:
        rows = self.spark.createDataFrame(sorted((system.VARIABLES | self.d.variables).items()), "variable_name string, value string")
        return rows.where(like(F.col("variable_name"), _plain(pattern))) if pattern else rows

    def show_create(self, table: str) -> DataFrame:
        return self.spark.sql(f"SHOW CREATE TABLE {table}").selectExpr(f"'{table}' AS table", "createtab_stmt AS create_table")

    def show_index(self, table: str) -> DataFrame:
        return catalog.statistics(self.spark).where(F.col("table_name") == table.strip("`").lower())

    def set(self, text: str) -> DataFrame:
        for item in self.d._split(self.d.tokens(text)):
            name, value = (x.strip() for x in item.split("=", 1))
            name = name.rstrip(":").strip()
            if re.fullmatch(r"@\w+", name):
                row = self.d.sql(f"SELECT {value} AS v")
                v, kind = row.selectExpr("CAST(v AS STRING) AS v").first().v, row.schema["v"].dataType.simpleString()
                self.d.users[name[1:].lower()] = "CAST(NULL AS STRING)" if v is None else "CAST('" + v.replace("\\", "\\\\").replace("'", "\\'") + f"' AS {kind if kind != 'void' else 'string'})"
                continue
            name, value = re.sub(r"^(?:@@)?(?:(?:global|session)[.\s]+)?", "", name, flags=re.I).strip("`"), value.strip("'\"")
            if name.startswith("spark."):
                self.spark.conf.set(name, value)
            else:
                self.d.variables[name.lower()] = value
        return self._affected()

    def analyze(self, table: str) -> DataFrame:
        return analyze_table(self.spark.table(table))

    def explain(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(catalog.explain(self.d.sql(query)),)], "plan string")


def _p(text: str):
    return re.compile(text.replace("NAME", _NAME).replace(" ", r"\s+").replace("_~", r"\s*"), re.I | re.S)


_TEXT = r"('(?:''|\\.|[^'\\])*')"
_PATTERNS = [
    (_p(r"CREATE TABLE( IF NOT EXISTS)? NAME_~\((.*)\)"), Statements.create_table),
    (_p(r"CREATE (?:TABLE|MATERIALIZED VIEW) NAME AS (.*)"), Statements.create_as),
    (_p(r"CREATE( OR REPLACE)? VIEW NAME AS (.*)"), Statements.create_view),
    (_p(r"DROP (TABLE|VIEW|MATERIALIZED VIEW)( IF EXISTS)? NAME"), Statements.drop),
    (_p(r"TRUNCATE(?: TABLE)? NAME"), Statements.truncate),
    (_p(r"ALTER TABLE NAME ADD(?: COLUMN)? (.*)"), Statements.add_column),
    (_p(r"ALTER TABLE NAME DROP(?: COLUMN)? NAME"), Statements.drop_column),
    (_p(r"INSERT( IGNORE)? INTO NAME(?:_~\(([^()]*)\))?_~((?:VALUES|SELECT|WITH)\b.*)"), Statements.insert),
    (_p(r"UPDATE NAME SET (.*?)(?: WHERE (.*))?"), Statements.update),
    (_p(r"DELETE FROM NAME(?: WHERE (.*))?"), Statements.delete),
    (_p(rf"LOAD DATA(?: LOCAL)? INFILE {_TEXT} INTO TABLE NAME(.*)"), Statements.load),
    (_p(rf"(SELECT .*?) INTO OUTFILE {_TEXT}((?:_~(?:FIELDS|COLUMNS|LINES|(?:OPTIONALLY )?(?:TERMINATED|ENCLOSED|ESCAPED|STARTING) BY {_TEXT.replace('(', '(?:', 1)}))*)( FROM .*)?"), Statements.outfile),
    (_p(rf"SHOW(?: FULL)? TABLES(?: LIKE {_TEXT})?"), Statements.show_tables),
    (_p(rf"SHOW(?: FULL)? COLUMNS (?:FROM|IN) NAME(?: LIKE {_TEXT})?"), Statements.show_columns),
    (_p(r"DESC(?:RIBE)?(?: TABLE)? NAME"), Statements.show_columns),
    (_p(r"SHOW (?:DATABASES|SCHEMAS)"), Statements.show_databases),
    (_p(rf"SHOW(?: GLOBAL| SESSION)? VARIABLES(?: LIKE {_TEXT})?"), Statements.show_variables),
    (_p(r"SHOW CREATE TABLE NAME"), Statements.show_create),
    (_p(r"SHOW (?:INDEX|INDEXES|KEYS) FROM NAME"), Statements.show_index),
    (_p(r"SET (?!.*\bWHERE\b)(.*)"), Statements.set),
    (_p(r"ANALYZE TABLE NAME(?: COMPUTE STATISTICS)?"), Statements.analyze),
    (_p(r"EXPLAIN(?: PLAN FOR)? (.*)"), Statements.explain),
]
