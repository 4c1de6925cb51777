"""References between produced objects, resolved by joins at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a frame of references; src_input and src_class may be null for 'any'. ref_id tells those of an owner, role and ord apart.
REFERENCE = "ref_id owner_class owner_oid role src_input src_basket src_class src_oid target_rule expected_class card_max required ord".split()
#: Columns of a frame that says which target object a source record became under a rule.
TARGET = "input basket class oid rule target_class target_oid".split()
#: What a reference asks for.
ASKED = "src_oid src_input src_class src_basket target_rule".split()


def resolve(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Every reference with `outcome`, `target_oid`, `target_class`, `n` and `tier`.

    Targets match on the source identifier; input and class match where stated.
    Those in the reference's own basket (tier 1) win over others (tier 2), and only
    then the producing rule counts. One target: RESOLVED, or TYPE_MISMATCH when
    another class was expected, or CARDINALITY beyond the role's maximum, in `ord`.
    Several: AMBIGUOUS. None: MISSING_MANDATORY or UNRESOLVED.
    """
    # What is asked for is looked up once, however many references ask for it; they meet the answers by one join.
    asked = refs.select(*ASKED).where("src_oid is not null").distinct()
    t = targets.select(*(F.col(c).alias(f"t_{c}") for c in TARGET))
    same = F.col("src_oid") == F.col("t_oid")
    for c in ("input", "class"):
        same = same & (F.col(f"src_{c}").isNull() | (F.col(f"src_{c}") == F.col(f"t_{c}")))
    met = asked.join(t, same).withColumn("tier", F.when(F.col("src_basket").eqNullSafe(F.col("t_basket")), 1).otherwise(2))
    produced = F.col("target_rule").isNull() | (F.col("target_rule") == F.col("t_rule"))
    # Aggregates, not windows: an object that very many rows refer to isn't gathered in one place.
    best = met.groupBy(*ASKED).agg(
        F.min("tier").alias("tier"),
        *(
            f.alias(f"{n}{k}")
            for k in (1, 2)
            for n, f in (
                ("n", F.count_if((F.col("tier") == k) & produced)),
                ("oid", F.min(F.when((F.col("tier") == k) & produced, F.struct("t_target_oid", "t_target_class")))),
            )
        ),
    )
    first = F.col("tier") == 1
    best = best.select(
        *(F.col(c).alias(f"b_{c}") for c in ASKED),
        "tier",
        F.when(first, F.col("n1")).otherwise(F.col("n2")).alias("n"),
        F.when(first, F.col("oid1")).otherwise(F.col("oid2")).alias("hit"),
    )
    answers = F.col("src_oid") == F.col("b_src_oid")
    for c in ASKED[1:]:
        answers = answers & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    out = refs.join(best, answers, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    one = F.col("n") == 1
    fits = one & (F.col("expected_class").isNull() | (F.col("expected_class") == F.col("hit.t_target_class")))
    place = F.row_number().over(Window.partitionBy("owner_class", "owner_oid", "role", fits).orderBy("ord", "ref_id"))
    outcome = (
        F.when(fits & F.col("card_max").isNotNull() & (place > F.col("card_max")), "CARDINALITY")
        .when(fits, "RESOLVED")
        .when(one, "TYPE_MISMATCH")
        .when(F.col("n") > 1, "AMBIGUOUS")
        .when(F.col("required"), "MISSING_MANDATORY")
        .otherwise("UNRESOLVED")
    )
    out = out.withColumn("outcome", outcome)
    good = F.col("outcome") == "RESOLVED"
    return out.select(
        *refs.columns,
        "outcome",
        F.when(good, F.col("hit.t_target_oid")).alias("target_oid"),
        F.when(good, F.col("hit.t_target_class")).alias("target_class"),
        F.col("n").cast("long").alias("n"),
        "tier",
    )


def resolve_singletons(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """References to the one object of a rule: resolved where `target_rule` made exactly one of the expected class, if one is
    stated, and the role takes one at least."""
    per_rule = targets.groupBy(F.col("rule").alias("s_rule"), F.col("target_class").alias("s_class")).agg(F.count("*").alias("n"), F.min("target_oid").alias("only"))
    fits = (F.col("target_rule") == F.col("s_rule")) & (F.col("expected_class").isNull() | (F.col("expected_class") == F.col("s_class")))
    per_ref = refs.select("target_rule", "expected_class").distinct().join(per_rule, fits).groupBy(F.col("target_rule").alias("p_rule"), F.col("expected_class").alias("p_class"))
    counted = per_ref.agg(F.sum("n").alias("n"), F.min("only").alias("only"))
    joined = refs.join(counted, (F.col("target_rule") == F.col("p_rule")) & F.col("expected_class").eqNullSafe(F.col("p_class")), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    one = (F.col("n") == 1) & F.coalesce(F.col("card_max") > 0, F.lit(True))
    outcome = F.when(one, "RESOLVED").when(F.col("n") > 1, "AMBIGUOUS").when(F.col("required"), "MISSING_MANDATORY").otherwise("UNRESOLVED")
    return joined.withColumn("outcome", outcome).select(*refs.columns, "outcome", F.when(one, F.col("only")).alias("target_oid"), F.col("n").cast("long").alias("n"))


def report(resolved: DataFrame) -> DataFrame:
    """(outcome, role, n)."""
    return resolved.groupBy("outcome", "role").agg(F.count("*").alias("n"))


def severity(outcome: str, policy: str) -> str:
    """Of an outcome under a fail policy; only ambiguity stays an error when lenient."""
    if outcome == "RESOLVED":
        return "INFO"
    if outcome == "UNRESOLVED":
        return "WARNING"
    return "ERROR" if policy == "strict" or outcome == "AMBIGUOUS" else "WARNING"


UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def packed(oid: Column) -> Column:
    """An identifier as bytes, a UUID as 17 of them: half of what its text takes in a shuffle. Different texts have different bytes."""
    return F.when(oid.rlike(UUID), F.concat(F.lit(b"\1"), F.unhex(F.replace(oid, F.lit("-"))))).otherwise(F.concat(F.lit(b"\0"), F.encode(oid, "UTF-8")))


def unpacked(b: Column) -> Column:
    """The identifier that `packed` took."""
    rest = F.substring(b, 2, 2**31 - 1)
    uuid = F.regexp_replace(F.lower(F.hex(rest)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(F.substring(b, 1, 1) == F.lit(b"\1"), uuid).otherwise(F.decode(rest, "UTF-8"))


def attach(objects: DataFrame, resolved: DataFrame, roles: dict[str, int | None], oid: str = "_oid") -> DataFrame:
    """`objects` with a column for each role: the target's identifier, or an array of them for roles that take several.

    Owners are told apart by class and identifier, as two classes may share identifiers.
    """
    if not roles:
        return objects
    good = resolved.where("outcome = 'RESOLVED'").groupBy(F.col("owner_class").alias("_owner_class"), packed(F.col("owner_oid")).alias("_owner"))
    of_role = lambda r: F.sort_array(F.collect_list(F.when(F.col("role") == r, F.struct("ord", packed(F.col("target_oid")).alias("to")))))
    gathered = good.agg(*(of_role(r).alias(r) for r in roles))
    columns = [(unpacked(F.try_element_at(F.col(r), F.lit(1))["to"]) if most == 1 else F.transform(r, lambda x: unpacked(x["to"]))).alias(r) for r, most in roles.items()]
    own = (packed(F.col(oid)) == F.col("_owner")) & (F.col("_class") == F.col("_owner_class"))
    return objects.join(gathered.select("_owner_class", "_owner", *columns), own, "left").drop("_owner_class", "_owner")
