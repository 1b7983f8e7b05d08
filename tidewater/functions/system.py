"""Session functions and variables."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

VERSION = "5.7.41-tidewater"


def version() -> Column:
    return F.lit(VERSION)


def database() -> Column:
    return F.current_database()


def user() -> Column:
    return F.current_user()


#: Engine variables that have a value in every session.
VARIABLES = {"autocommit": "ON", "sql_mode": "", "character_set_client": "utf8", "character_set_connection": "utf8", "character_set_results": "utf8", "collation_connection": "utf8_bin", "transaction_isolation": "REPEATABLE-READ", "tx_isolation": "REPEATABLE-READ", "transaction_read_only": "OFF", "wait_timeout": "28800", "interactive_timeout": "28800", "net_write_timeout": "60", "max_allowed_packet": "16777216", "lower_case_table_names": "0", "auto_increment_increment": "1", "auto_increment_offset": "1", "version": VERSION, "version_comment": "tidewater"}


def known(spark: SparkSession, name: str, own: dict[str, str] | None = None) -> str | None:
    """A variable's text: a session's own value, an engine variable, or a setting of Spark, set or by default."""
    name = re.sub(r"^(global|session)\.", "", name.strip("`"), flags=re.I)
    for values in (own or {}, VARIABLES):
        if name.lower() in values:
            return values[name.lower()]
    try:
        return spark.conf.get(name)
    except Exception:  # no such setting
        return None


def variable(spark: SparkSession, name: str, own: dict[str, str] | None = None) -> Column:
    """@@name; ON and OFF are 1 and 0, an unknown name is NULL."""
    value = known(spark, name, own)
    return F.lit({"on": "1", "true": "1", "off": "0", "false": "0"}.get(str(value).lower(), value))


def raise_error(message: str) -> Column:
    return F.raise_error(F.lit(message))
