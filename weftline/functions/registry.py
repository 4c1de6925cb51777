"""Named functions of job expressions.

A call is data: a name and arguments, which are calls or Spark SQL text; in a job's
plain form {"enumMap": ["o.status", "states"]}. Each name builds a Column from
Spark's own expressions, so Catalyst sees nothing but built-in operators. Jobs may
register functions of their own with `function`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import dates, enums, geometry, logic, numbers, text


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()


Expression = str | Column | Call
#: Calls that a rule turns into joins; see operators.rules.
JOINED = {"lookup", "lookupoptional", "lookupin", "existsin"}


@dataclass
class Context:
    """What the columns of an expression are built against: the records, the job's value maps, columns of joined calls.

    `problems` collects (code, condition, key) of what a run has to report of rows.
    """

    df: DataFrame | None = None
    enums: dict[str, dict[str, str]] = field(default_factory=dict)
    joined: dict[Call, Column] = field(default_factory=dict)
    problems: list[tuple[str, Column, Column]] = field(default_factory=list)

    def kind(self, c: Column) -> str:
        """boolean, text, number or other; found by planning, nothing runs."""
        if self.df is None:
            return "boolean"
        name = self.df.select(c.alias("x")).schema["x"].dataType.typeName()
        if name in ("byte", "short", "integer", "long", "float", "double") or name.startswith("decimal"):
            return "number"
        return {"boolean": "boolean", "string": "text", "void": "void"}.get(name, "other")

    def truthy(self, c: Column) -> Column:
        return logic.truthy(c, self.kind(c)) if self.kind(c) != "void" else F.lit(False)

    def values(self, name: str) -> dict[str, str]:
        if name not in self.enums:
            raise ValueError(f"no value map {name!r}")
        return self.enums[name]


@dataclass(frozen=True)
class Function:
    name: str
    build: Callable[..., Column]
    least: int
    most: int | None
    raw: tuple[int, ...] = ()
    deterministic: bool = True


REGISTRY: dict[str, Function] = {}


def function(name: str, least: int, most: int | None = -1, *, raw: tuple[int, ...] = (), deterministic: bool = True):
    """Register a builder (context, *arguments) -> Column under a name that no other has, in either case.

    It takes `least` to `most` arguments (None: any number); those at the places `raw` are names, not expressions.
    """

    def keep(build: Callable[..., Column]) -> Callable[..., Column]:
        if name.lower() in REGISTRY or name.lower() in JOINED:
            raise ValueError(f"function {name} exists")
        REGISTRY[name.lower()] = Function(name, build, least, least if most == -1 else most, raw, deterministic)
        return build

    return keep


def expression_of(e) -> Expression:
    """An expression from its plain form."""
    if isinstance(e, dict):
        if len(e) != 1:
            raise ValueError(f"a call has one name: {sorted(e)}")
        ((name, args),) = e.items()
        return Call(name, tuple(expression_of(a) for a in (args if isinstance(args, list) else [] if args is None else [args])))
    if isinstance(e, bool):
        return "true" if e else "false"
    return str(e) if isinstance(e, int | float) else "null" if e is None else e


def calls_in(e: Expression) -> Iterator[Call]:
    """All calls of an expression, inner ones first."""
    if isinstance(e, Call):
        for a in e.args:
            yield from calls_in(a)
        yield e


def deterministic(e: Expression) -> bool:
    """Whether all its calls are; of SQL text, whether Spark says so (see `plans.job.lineage`)."""
    return all(c.name.lower() in JOINED or REGISTRY[c.name.lower()].deterministic for c in calls_in(e))


def column_of(e: Expression, context: Context | None = None) -> Column:
    """The Column of an expression; ValueError for an unknown function or a wrong number of arguments."""
    context = context or Context()
    if isinstance(e, Column):
        return e
    if isinstance(e, str):
        return F.expr(e)
    if e in context.joined:
        return context.joined[e]
    found = REGISTRY.get(e.name.lower())
    if not found:
        raise ValueError(f"no function {e.name!r}" if e.name.lower() not in JOINED else f"{e.name} needs the classes of a rule")
    if len(e.args) < found.least or found.most is not None and len(e.args) > found.most:
        raise ValueError(f"{found.name} takes {found.least} to {found.most or 'any number of'} arguments, not {len(e.args)}")
    return found.build(context, *(a if i in found.raw else column_of(a, context) for i, a in enumerate(e.args)))


def _plain(name: str, build: Callable[..., Column], least: int, most: int | None = -1) -> None:
    function(name, least, most)(lambda _, *args: build(*args))


for _name, _build, _least, _most in [
    ("coalesce", F.coalesce, 1, None), ("defined", lambda v: v.isNotNull(), 1, 1), ("notDefined", lambda v: v.isNull(), 1, 1),
    ("isNull", lambda v: v.isNull(), 1, 1), ("default", F.coalesce, 2, 2), ("null", lambda: F.lit(None), 0, 0),
    ("concat", text.concat_text, 1, None), ("substring", text.substring_at, 3, 3), ("trim", text.trim_controls, 1, 1), ("upper", F.upper, 1, 1),
    ("lower", F.lower, 1, 1), ("replace", text.replace_all, 3, 3), ("truncate", text.truncate_text, 2, 2),
    ("toXmlDateTime", dates.to_datetime_value, 1, 1), ("toInterlis1Date", dates.to_compact_date, 1, 1), ("toDate", dates.to_date_value, 1, 1),
    ("enumDefault", enums.enum_default, 2, 2), ("enumName", lambda v: v, 1, 1), ("refOid", lambda v: v.cast("string"), 1, 1),
    ("refEquals", lambda a, b: F.coalesce(a.cast("string") == b.cast("string"), F.lit(False)), 2, 2),
    ("div", numbers.div, 2, 2), ("mul", numbers.mul, 2, 2), ("add", numbers.add, 2, 2), ("sub", numbers.sub, 2, 2), ("abs", numbers.abs_of, 1, 1),
    ("min", numbers.min_of, 2, 2), ("max", numbers.max_of, 2, 2), ("toNumber", numbers.to_number, 1, 1), ("coordEquals", geometry.coord_equals, 3, 3),
    ("pointOnSurface", geometry.point_on_surface, 1, 2),
]:
    _plain(_name, _build, _least, _most)


@function("now", 0, deterministic=False)
def _now(_: Context) -> Column:
    return F.current_timestamp()


@function("round", 1, 2, raw=(1,))
def _round(_: Context, x: Column, scale: str = "0") -> Column:
    return numbers.round_to(x, int(scale))


@function("oid", 1, raw=(0,))
def _oid(_: Context, alias: str) -> Column:
    return F.col(f"{alias}._oid")


@function("bagFirst", 3, raw=(0, 1, 2))
def _bag_first(_: Context, alias: str, bag: str, attribute: str) -> Column:
    return F.try_element_at(F.col(f"{alias}.{bag}"), F.lit(1))[attribute]


@function("and", 2, None)
def _and(c: Context, *args: Column) -> Column:
    out = args[-1]
    for a in reversed(args[:-1]):
        out = F.when(c.truthy(a), out).otherwise(False)
    return out


@function("or", 2, None)
def _or(c: Context, *args: Column) -> Column:
    out = args[-1]
    for a in reversed(args[:-1]):
        out = F.when(c.truthy(a), True).otherwise(out)
    return out


@function("not", 1)
def _not(c: Context, x: Column) -> Column:
    return F.lit(True) if c.kind(x) == "void" else logic.not_value(x, c.kind(x))


@function("if", 3)
def _if(c: Context, condition: Column, yes: Column, no: Column) -> Column:
    return F.when(c.truthy(condition), yes).otherwise(no)


def _comparable(c: Context, a: Column, b: Column) -> tuple[Column, Column]:
    """Two numbers as they are, other kinds as text; a number against a text is refused when the rule is planned."""
    kinds = {c.kind(a), c.kind(b)} - {"void"}
    if kinds == {"number", "text"}:
        raise ValueError("a number is compared with a text; use toNumber")
    return (a, b) if len(kinds) < 2 else (a.cast("string"), b.cast("string"))


for _name, _compare in [
    ("eq", logic.eq_value), ("neq", logic.neq_value), ("lt", logic.lt_value), ("lte", logic.lte_value), ("gt", logic.gt_value), ("gte", logic.gte_value),
]:
    function(_name, 2)(lambda c, a, b, compare=_compare: compare(*_comparable(c, a, b)))


@function("enumMap", 2, raw=(1,))
def _enum_map(c: Context, x: Column, name: str) -> Column:
    found = enums.enum_map(x, c.values(name))
    c.problems.append(("ENUM_NO_MATCH", x.isNotNull() & found.isNull(), x.cast("string")))
    return found


@function("enumMapDefault", 3, raw=(1,))
def _enum_map_default(c: Context, x: Column, name: str, fallback: Column) -> Column:
    return enums.enum_map_default(x, c.values(name), fallback)


@function("enumMapStrict", 2, raw=(1,))
def _enum_map_strict(c: Context, x: Column, name: str) -> Column:
    found, miss = enums.enum_map_strict(x, c.values(name))
    c.problems.append(("ENUM_STRICT_NO_MATCH", miss, x.cast("string")))
    return found


class _AllButFirst:
    """Places of arguments that are names: all behind the first."""

    def __contains__(self, place: int) -> bool:
        return place > 0


@function("enumResolve", 2, None, raw=_AllButFirst())
def _enum_resolve(c: Context, x: Column, *names: str) -> Column:
    """The full name of an enumeration's value; one that isn't among the names stays, and is told."""
    found = enums.enum_resolve(x.cast("string"), list(names))
    c.problems.append(("ENUM_UNKNOWN_VALUE", F.coalesce(~found.isin(*names), F.lit(False)), x.cast("string")))
    return found


@function("coordText", 1)
def _coord_text(c: Context, x: Column) -> Column:
    """A WKT point of a text 'x y' or a coordinate; a WKT text stays."""
    if c.df is not None and c.df.select(x).schema[0].dataType.typeName() == "struct":
        return F.when(x.isNotNull(), F.concat(F.lit("POINT ("), x["x"].cast("string"), F.lit(" "), x["y"].cast("string"), F.lit(")")))
    given = F.trim(x.cast("string"))
    return F.when(geometry.coord_of_text(given).isNotNull(), F.concat(F.lit("POINT ("), F.regexp_replace(given, r"\s+", " "), F.lit(")"))).otherwise(given)
