"""Predicates as columns: structural filters, any-field payload conditions, time scopes, log filters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371000.0
DAY_MS = 86_400_000
#: A payload value is tagged by type, so an integer 1 does not equal a float 1.0.
VALUE = "struct<t:string,s:string,i:bigint,f:double,b:boolean,l:array<string>,lat:double,lon:double>"


def _value(tag: str, **parts: Column) -> Column:
    kinds = {"s": "string", "i": "long", "f": "double", "b": "boolean", "l": "array<string>", "lat": "double", "lon": "double"}
    return F.struct(F.lit(tag).alias("t"), *[parts.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


def string(c: Column) -> Column:
    return _value("s", s=c)


def integer(c: Column) -> Column:
    return _value("i", i=c)


def number(c: Column) -> Column:
    return _value("f", f=c)


def boolean(c: Column) -> Column:
    return _value("b", b=c)


def listing(c: Column) -> Column:
    return _value("l", l=c)


def geo(lat: Column, lon: Column) -> Column:
    return _value("g", lat=lat, lon=lon)


def structural(column: str, operator: str, value) -> Column:
    """``Equals`` compares string forms; the ordering operators compare typed values. Null never passes."""
    c = F.col(column)
    if operator == "Equals":
        text = value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)
        return F.coalesce(c.cast("string") == F.lit(text), F.lit(False))
    ops = {"NotEquals": lambda: c != F.lit(value), "GreaterThan": lambda: c > F.lit(value), "LessThan": lambda: c < F.lit(value), "GreaterThanOrEqual": lambda: c >= F.lit(value), "LessThanOrEqual": lambda: c <= F.lit(value)}
    if operator not in ops:
        raise ValueError(f"unknown operator {operator}")
    return F.coalesce(ops[operator](), F.lit(False))


def structural_all(filters: list[tuple[str, str, object]] | None) -> Column:
    """All filters hold; none or an empty list restricts nothing."""
    out = F.lit(True)
    for f in filters or []:
        out = out & structural(*f)
    return out


def haversine(lat1: Column, lon1: Column, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    whole = lambda v: v if isinstance(v, Column) else F.lit(v)
    p1, p2 = F.radians(lat1), F.radians(whole(lat2))
    dp, dl = (p2 - p1) / 2, (F.radians(whole(lon2)) - F.radians(lon1)) / 2
    a = F.pow(F.sin(dp), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


@dataclass
class Match:
    """Type-strict equality with a Python str, bool, int, float, list of str or (lat, lon)."""

    value: object

    def __call__(self, v: Column) -> Column:
        x = self.value
        if isinstance(x, bool):
            hit = (v["t"] == "b") & (v["b"] == x)
        elif isinstance(x, int):
            hit = (v["t"] == "i") & (v["i"] == x)
        elif isinstance(x, float):
            hit = (v["t"] == "f") & (v["f"] == x)
        elif isinstance(x, str):
            hit = (v["t"] == "s") & (v["s"] == x)
        elif isinstance(x, tuple):
            hit = (v["t"] == "g") & (v["lat"] == float(x[0])) & (v["lon"] == float(x[1]))
        else:
            hit = (v["t"] == "l") & (v["l"] == F.array(*[F.lit(s) for s in x]).cast("array<string>"))
        return F.coalesce(hit, F.lit(False))


@dataclass
class Range:
    """Inclusive bounds on integer or float values; bounds are compared as they are, not rounded."""

    lower: float | None = None
    upper: float | None = None

    def __call__(self, v: Column) -> Column:
        x = F.when(v["t"] == "i", v["i"].cast("double")).when(v["t"] == "f", v["f"])
        hit = x.isNotNull()
        if self.lower is not None:
            hit = hit & (x >= self.lower)
        if self.upper is not None:
            hit = hit & (x <= self.upper)
        return F.coalesce(hit, F.lit(False))


@dataclass
class GeoRadius:
    lat: float
    lon: float
    metres: float

    def __call__(self, v: Column) -> Column:
        return F.coalesce((v["t"] == "g") & (haversine(v["lat"], v["lon"], self.lat, self.lon) <= self.metres), F.lit(False))


def matches(fields: Column, condition, name: str | None = None) -> Column:
    """A condition holds if any field satisfies it, or the named one."""
    if name is not None:
        return F.coalesce(condition(F.try_element_at(fields, F.lit(name))), F.lit(False))
    return F.coalesce(F.exists(F.map_values(fields), condition), F.lit(False))


@dataclass
class PayloadFilter:
    """All of must, none of must_not, and any of should if there are some. A condition or (condition, field)."""

    must: list = field(default_factory=list)
    should: list = field(default_factory=list)
    must_not: list = field(default_factory=list)

    def column(self, fields: Column) -> Column:
        one = lambda c: matches(fields, *c) if isinstance(c, tuple) else matches(fields, c)
        out = F.lit(True)
        for c in self.must:
            out = out & one(c)
        for c in self.must_not:
            out = out & ~one(c)
        if self.should:
            any_ = F.lit(False)
            for c in self.should:
                any_ = any_ | one(c)
            out = out & any_
        return out

    def must_match(self, value) -> PayloadFilter:
        self.must.append(Match(value))
        return self

    def must_range(self, lower=None, upper=None) -> PayloadFilter:
        self.must.append(Range(lower, upper))
        return self

    def should_match(self, value) -> PayloadFilter:
        self.should.append(Match(value))
        return self

    def must_not_match(self, value) -> PayloadFilter:
        self.must_not.append(Match(value))
        return self


def time_scope(ts: Column, scope: str, now_ms: int, custom: tuple[int, int] | None = None) -> Column:
    """Rolling windows before ``now_ms``, both ends included."""
    days = {"today": (1, 0), "week": (7, 0), "month": (30, 0), "quarter": (90, 0), "year": (365, 0), "last_year": (730, 365)}
    if scope == "custom":
        lo, hi = custom or (0, 0)
    elif scope == "chat":
        lo, hi = 0, (1 << 63) - 1
    elif scope in days:
        lo, hi = (now_ms - d * DAY_MS for d in days[scope])
    else:
        raise ValueError(f"unknown scope {scope}")
    return ts.between(lo, hi)


#: Other names of log sources.
SOURCE_ALIASES = {"grpc": "GrpcServer", "grpc_server": "GrpcServer", "http": "HttpApi", "http_api": "HttpApi", "index": "Indexing", "scheduler": "Scheduler", "ui": "Frontend"}


def log_filter(level: str | None = None, context: str | None = None, source: str | None = None, since: str | None = None) -> Column:
    """Level (any case), context substring, source (aliases, any case), timestamp from an RFC 3339 time on."""
    from datetime import datetime

    out = F.lit(True)
    if level is not None:
        out = out & (F.lower("level") == level.lower())
    if context is not None:
        out = out & F.contains(F.col("context"), F.lit(context))
    if source is not None:
        out = out & (F.lower("source") == SOURCE_ALIASES.get(source.lower(), source).lower())
    if since is not None:
        at = datetime.fromisoformat(since.replace("Z", "+00:00"))
        if at.tzinfo is None:
            raise ValueError("since needs a time zone")
        out = out & (F.col("timestamp") >= int(at.timestamp() * 1000))
    return out
