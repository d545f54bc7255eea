"""Pages that continue behind a key, so that no page sorts or skips what came before."""

from __future__ import annotations

import base64
import datetime
import decimal
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


@dataclass(frozen=True)
class Key:
    """A column of a sort order: its name, and whether it falls. Nulls come first either way."""

    name: str
    falls: bool = False

    def order(self) -> Column:
        return F.col(self.name).desc_nulls_first() if self.falls else F.col(self.name).asc_nulls_first()

    def same(self, value: Column) -> Column:
        return F.col(self.name).eqNullSafe(value)

    def behind(self, value, literal: Column) -> Column:
        """Whether a row comes behind ``value`` by this key; behind a null all that isn't one."""
        if value is None:
            return F.col(self.name).isNotNull()
        return F.col(self.name) < literal if self.falls else F.col(self.name) > literal

    def not_before(self, value, literal: Column) -> Column | None:
        if value is None:
            return None
        return F.col(self.name) <= literal if self.falls else F.col(self.name) >= literal


def _written(value) -> object:
    if isinstance(value, (decimal.Decimal, datetime.date, datetime.datetime)):
        return str(value)
    return value


def token_of(row: Row, keys: list[Key]) -> str:
    """Where the page behind a row begins, as text that is safe in a link."""
    return base64.urlsafe_b64encode(json.dumps([_written(row[k.name]) for k in keys]).encode()).decode()


def values_of(token: str, keys: list[Key]) -> list:
    """The key that a token stands for. ValueError if it is not one of these keys."""
    try:
        values = json.loads(base64.urlsafe_b64decode(token.encode()))
    except (ValueError, UnicodeError) as e:
        raise ValueError("not a continuation") from e
    if not isinstance(values, list) or len(values) != len(keys) or any(isinstance(v, (list, dict)) for v in values):
        raise ValueError("not a continuation of this order")
    return values


def behind(rows: DataFrame, keys: list[Key], token: str) -> Column:
    """The rows behind a token, as a predicate over the keys; the range of the first key reaches the scan."""
    kinds: dict[str, DataType] = {f.name: f.dataType for f in rows.schema.fields}
    values = values_of(token, keys)
    literals = [F.lit(v).cast(kinds[k.name]) for k, v in zip(keys, values, strict=True)]
    ways = []
    for i, key in enumerate(keys):
        equal = [k.same(x) for k, x in zip(keys[:i], literals, strict=False)]
        ways.append(reduce(Column.__and__, [*equal, key.behind(values[i], literals[i])]))
    later = reduce(Column.__or__, ways)
    first = keys[0].not_before(values[0], literals[0])
    return later if first is None else first & later


def page(rows: DataFrame, keys: list[Key], size: int, token: str | None = None) -> DataFrame:
    """The next ``size`` rows in the order of ``keys``, of which the last should be unique, behind a token if there is one.

    Each task keeps ``size`` rows at most. A row that is added or taken away before the token moves no page.
    """
    wanted = rows if token is None else rows.filter(behind(rows, keys, token))
    return wanted.orderBy(*[k.order() for k in keys]).limit(size)


def page_and_token(rows: DataFrame, keys: list[Key], size: int, token: str | None = None) -> tuple[list[Row], str | None]:
    """A page for a client and the token of the next; None behind the last."""
    found = page(rows, keys, size + 1, token).collect()
    return found[:size], token_of(found[size - 1], keys) if len(found) > size else None
