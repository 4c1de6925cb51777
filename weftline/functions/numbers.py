"""Decimal arithmetic; what can't be computed is null."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "decimal(38,10)"
_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_number(text: Column) -> Column:
    """The number that a text states; null for anything else, blanks around it included."""
    text = text.cast("string")
    return F.when(text.rlike(_TEXT), text.try_cast(NUMBER))


def _number(x: Column) -> Column:
    return x.try_cast(NUMBER)


def _summed(operation, a: Column, b: Column) -> Column:
    """Spark keeps ten decimals of sums where the operands have 27 digits before the point at most; beyond that, nine."""
    p, q = _number(a), _number(b)
    return F.coalesce(operation(p.try_cast("decimal(37,10)"), q.try_cast("decimal(37,10)")).try_cast(NUMBER), operation(p, q).try_cast(NUMBER))


def add(a: Column, b: Column) -> Column:
    return _summed(F.try_add, a, b)


def sub(a: Column, b: Column) -> Column:
    return _summed(F.try_subtract, a, b)


def _finer(x: Column) -> Column:
    """Whether ten decimals don't hold a value."""
    return x.try_cast("double") != _number(x).cast("double")


def _digits(x: Column) -> tuple[Column, Column]:
    """A number's digits as a whole number, and the power of ten that it is to be taken by; of a double those of its shortest text."""
    part = lambda k: F.regexp_extract(x.cast("string"), r"^([+-]?)([0-9]*)[.]?([0-9]*?)0*(?:[eE]([+-]?[0-9]+))?$", k)
    power = F.coalesce(part(4).try_cast("int"), F.lit(0)) - F.length(part(3))
    return F.concat(part(1), part(2), part(3)).try_cast("decimal(38,0)"), power


def _shifted(whole: Column, power: Column) -> Column:
    return F.concat(whole.cast("string"), F.lit("E"), power.cast("string")).try_cast(NUMBER)


def _bound(a: Column, b: Column, f) -> Column:
    """`f` of both, computed once however often `f` names them."""
    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda x: f(x["a"], x["b"]))[0]


#: Pairs of types of so few digits that Spark's own product is exact: 15 digits, or a long beside a whole number.
_FEW = r"tinyint|smallint|int|decimal\((1[0-5]|[1-9]),([0-9]|10)\)"
FEW_DIGITS = rf"^({_FEW})[|]({_FEW})$|^bigint[|](tinyint|smallint|int)$|^(tinyint|smallint|int)[|]bigint$"


def mul(a: Column, b: Column) -> Column:
    """The product to ten decimals, half up; null where it has more than 28 digits before the point.

    Numbers of few digits, by their type or their value, are one product. Of others whole parts and fractions are
    multiplied each, as Spark's product of two such numbers would keep six decimals only. Where a factor has finer
    decimals, all digits of both are multiplied as whole numbers; only a product of more than 38 digits goes by doubles.
    """

    def exact(a: Column, b: Column) -> Column:
        whole = lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).try_cast("decimal(27,0)")
        p, q = _number(a), _number(b)
        pw, qw = whole(p), whole(q)
        pf, qf = ((x % F.lit(1)).try_cast("decimal(10,10)") for x in (p, q))
        found = F.try_multiply(pw, qw).try_cast(NUMBER)
        for x, y in ((pw, qf), (pf, qw), (pf, qf)):
            found = add(found, F.try_multiply(x, y).try_cast(NUMBER))
        (da, ea), (db, eb) = _digits(a), _digits(b)
        finer = F.coalesce(_shifted(F.try_multiply(da, db), ea + eb), (a.try_cast("double") * b.try_cast("double")).try_cast(NUMBER))
        return F.when(_finer(a) | _finer(b), finer).otherwise(found)

    one = F.lit(Decimal(1))
    # Planning folds the types, and leaves out the branch that doesn't apply.
    few = F.when(F.concat(F.typeof(a), F.lit("|"), F.typeof(b)).rlike(FEW_DIGITS), F.try_multiply(a * one, b * one).try_cast(NUMBER))
    small = F.try_multiply(_number(a).try_cast("decimal(18,10)"), _number(b).try_cast("decimal(18,10)")).try_cast(NUMBER)
    small = F.when(~(_finer(a) | _finer(b)), small)  # null beyond eight digits before the point
    return F.coalesce(few, small, _bound(a, b, exact))


def _quotient(p: Column, q: Column) -> Column:
    """With the first types Spark's quotient has ten decimals, with the second six."""
    return F.coalesce(F.try_divide(p.try_cast("decimal(28,10)"), q).try_cast(NUMBER), F.try_divide(p, q).try_cast(NUMBER))


def div(a: Column, b: Column) -> Column:
    """To ten decimals, half up; by zero: null.

    A dividend of over 18 digits before the point gives six decimals. Of operands with finer decimals the digits are
    divided as whole numbers, the powers of ten with the one that has more; only those of too many digits go by doubles.
    """

    def finer(a: Column, b: Column) -> Column:
        (da, ea), (db, eb) = _digits(a), _digits(b)
        top, bottom = (_shifted(d, F.greatest(e, F.lit(0))) for d, e in ((da, ea - eb), (db, eb - ea)))
        doubles = F.try_divide(a.try_cast("double"), b.try_cast("double")).try_cast(NUMBER)
        return F.when(_finer(a) | _finer(b), F.when(db != 0, F.coalesce(_quotient(top, bottom), doubles)))

    plain = F.when(~(_finer(a) | _finer(b)), _quotient(_number(a), _number(b)))
    return F.coalesce(plain, _bound(a, b, finer))


def round_to(x: Column, scale: int) -> Column:
    """Half up, away from zero at a tie."""
    return F.round(_number(x), scale)


def abs_of(x: Column) -> Column:
    return F.abs(_number(x))


def min_of(a: Column, b: Column) -> Column:
    """Null where either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(_number(a), _number(b)))


def max_of(a: Column, b: Column) -> Column:
    """Null where either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(_number(a), _number(b)))


def number_text(x: Column) -> Column:
    """Digits without an exponent: whole numbers without a decimal point, others without zeros at the end; finer than
    ten decimals: a double's text."""
    n = F.abs(_number(x))
    whole = F.floor(n)
    rest = F.lpad(((n % F.lit(1)) * F.lit(10**10)).cast("bigint").cast("string"), 10, "0")
    shown = F.concat(F.when(_number(x) < 0, "-").otherwise(""), whole.cast("string"), F.regexp_replace(F.concat(F.lit("."), rest), r"\.?0+$", ""))
    return F.when(x.isNotNull(), F.when(_finer(x), x.try_cast("double").cast("string")).otherwise(shown))
