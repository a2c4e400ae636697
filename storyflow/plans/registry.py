"""Name -> query and its oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyflow.plans.data import AS_OF, Data, with_views

QUERIES: dict[str, Callable[[Data], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return register


# ---- oracle text helpers

NOW = f"TIMESTAMP '{AS_OF}'"


def half_even(x: str, digits: int = 2) -> str:
    return f"(round_even(({x}) * 1e{digits}, 0) / 1e{digits})"


def age(col: str = "published_at", now: str = NOW) -> str:
    return f"((epoch_us({now}) - epoch_us({col})) / 3.6e9)"


def age0(col: str = "published_at", now: str = NOW) -> str:
    return f"coalesce(greatest(0e0, {age(col, now)}), 0e0)"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def norm_title(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def token_set(x: str, stop=()) -> str:
    base = f"list_distinct(list_filter(string_split({norm_title(x)}, ' '), lambda w: w <> ''))"
    return f"list_filter({base}, lambda w: w NOT IN {sql_in(stop)})" if len(stop) else base


def jac(a: str, b: str) -> str:
    i = f"len(list_intersect({a}, {b}))"
    return f"({i} * 1e0 / (len({a}) + len({b}) - {i}))"


def stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


# ---- result helpers

def text_ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def joined(c, sep: str = ","):
    """Arrays leave queries as text, so that results compare the same everywhere."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)
