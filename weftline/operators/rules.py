"""Transformation rules lowered to DataFrame plans.

A rule takes records of one or more classes, filters them, joins further classes,
and makes one target object of each. Attributes are Spark expressions over the
aliases of the rule's sources ("c.c_name", "upper(c.c_name)"), given as SQL text, as
Columns, or as calls of named functions; lookups and bags become joins. The rule
itself is only a description, and Catalyst plans the work.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.registry import JOINED, Call, Context, Expression, calls_in, column_of
from weftline.operators import bags as nested
from weftline.operators.bands import band_join, fold
from weftline.operators.identity import basket, deterministic_uuid, numbered_oids, preserved_oid
from weftline.operators.lookups import first_matches
from weftline.storage import stored

#: Columns that every source record has, beside its attributes.
ENVELOPE = ["_input", "_basket", "_class", "_oid", "_ord"]


@dataclass(frozen=True)
class Source:
    alias: str
    cls: str
    inputs: tuple[str, ...] = ()
    where: Expression | None = None


@dataclass(frozen=True)
class Join:
    """right: an alias of the rule's sources; on: pairs of expressions that must be equal as text."""

    right: str
    on: tuple[tuple[Expression, Expression], ...]
    kind: str = "inner"


@dataclass(frozen=True)
class Ref:
    role: str
    source_oid: Expression | None
    target_rule: str | None = None
    source_class: str | None = None
    source_input: str | None = None
    expected_class: str | None = None
    required: bool = False
    card_max: int | None = 1
    singleton: bool = False


@dataclass(frozen=True)
class Loss:
    source_path: str
    reason_code: str
    description: str = ""
    when: Expression | None = None


@dataclass(frozen=True)
class Create:
    """A further object of every record of the rule's sources. `id` names it among those of its class; references may be
    stated as a rule's are. `oid` is its own strategy: deterministicUuid, or integer."""

    cls: str
    assign: dict[str, Expression]
    id: str | None = None
    refs: tuple[Ref, ...] = ()
    oid: str | None = None


@dataclass(frozen=True)
class Bag:
    """A bag of a rule's target.

    embed: records of `source` whose `parent_ref` is the parent's identifier become
    an array of structures, by `order` (the child's own by default). Without
    `parent_ref` it is taken from a refEquals of `where` with the parent's alias.
    With `band`, a value and two bounds, of which one side is the child's and the
    other the parent's, records belong to all parents that the band joins them to.
    Without `source`: one structure made from the parent itself, where `where` holds.
    summary: what embed would give, but its length `n` and its `first` structure only, and no array is made. With a band
    its pairs aren't made either, as far as children are alike in what `where` holds against the parent.
    expand: every structure of the array `items` becomes an object of class `target`,
    numbered, with its parent's identifier as `parent_role`; expressions name the
    structure by `alias`. Bags within it are expanded too. An embedded bag holds
    embedded ones only.
    """

    attribute: str
    assign: dict[str, Expression]
    source: Source | None = None
    mode: str = "embed"
    where: Expression | None = None
    parent_ref: Expression | None = None
    order: Expression | None = None
    items: str | None = None
    alias: str = "item"
    target: str | None = None
    parent_role: str | None = None
    max_items: int | None = None
    mandatory: tuple[str, ...] = ()
    bags: tuple[Bag, ...] = ()
    band: tuple[Expression, Expression, Expression] | None = None


@dataclass(frozen=True)
class Rule:
    id: str
    output: str
    cls: str
    sources: tuple[Source, ...]
    assign: dict[str, Expression]
    joins: tuple[Join, ...] = ()
    where: Expression | None = None
    defaults: dict[str, Expression] = field(default_factory=dict)
    identity: tuple[str, ...] = ()
    refs: tuple[Ref, ...] = ()
    losses: tuple[Loss, ...] = ()
    create: tuple[Create, ...] = ()
    bags: tuple[Bag, ...] = ()
    #: Said of the mapping, not used by it: direction, roundtrip, lossiness.
    metadata: tuple[tuple[str, str], ...] = ()


#: What `full` holds beside a target: where it came from, its references and the problems of its row.
HIDDEN = ["_source_input", "_source_basket", "_source_class", "_refs", "_problems"]


@dataclass
class RuleFrames:
    """What a rule gives: all lazy. The frames of targets, identifiers, references and problems come from `full`,
    so a run that stores it once plans and reads the rule's records once."""

    rule: Rule
    full: DataFrame
    losses: DataFrame | None
    #: Each with what it was made by.
    created: list[tuple[Create, DataFrame]]
    misses: DataFrame | None
    visited: DataFrame
    matches: DataFrame
    expanded: list[tuple[Bag, DataFrame]] = field(default_factory=list)

    @property
    def targets(self) -> DataFrame:
        return self.full.drop(*HIDDEN)

    @property
    def id_map(self) -> DataFrame:
        source = [F.col(f"_source_{c}").alias(c) for c in ("input", "basket", "class", "oid")]
        return self.full.select(*source, F.lit(self.rule.id).alias("rule"), F.lit(self.rule.cls).alias("target_class"), F.col("_oid").alias("target_oid"))

    @property
    def refs(self) -> DataFrame | None:
        found = [_references(self.rule.id, self.rule.cls, self.rule.refs, self.full)] if self.rule.refs else []
        found += [_references(f"{self.rule.id}/{_creation(self.rule, c)}", c.cls, c.refs, df) for c, df in self.created if c.refs]
        return reduce(lambda a, b: a.unionByName(b), found) if found else None

    @property
    def diagnostics(self) -> DataFrame | None:
        """(code, rule, key) of joins that missed and of problems of rows."""
        if "_problems" not in self.full.columns:
            return self.misses
        rows = self.full.select(F.inline("_problems")).select("code", F.lit(self.rule.id).alias("rule"), "key")
        return rows if self.misses is None else self.misses.unionByName(rows)


def _references(owner: str, cls: str, refs: tuple[Ref, ...], objects: DataFrame) -> DataFrame:
    """A row for each of `refs` of each of `objects`, whose `_refs` has the identifiers that they name; `ref_id` is the
    `owner`, which tells rows of one object's identifier and place apart."""
    text = lambda v: F.lit(v).cast("string")
    each = [
        F.struct(
            text(r.role).alias("role"), text(r.source_input).alias("src_input"), text(r.source_class).alias("src_class"),
            F.get("_refs", F.lit(n)).alias("src_oid"), text(r.target_rule).alias("target_rule"), text(r.expected_class).alias("expected_class"),
            F.lit(r.card_max).cast("int").alias("card_max"), F.lit(r.required).alias("required"), F.lit(n).alias("ord"),
        )
        for n, r in enumerate(refs)
    ]
    rows = objects.select("_oid", "_source_basket", F.explode(F.array(*each)).alias("r"))
    return rows.select(
        F.lit(owner).alias("ref_id"), F.lit(cls).alias("owner_class"), F.col("_oid").alias("owner_oid"), "r.role", "r.src_input", F.col("_source_basket").alias("src_basket"),
        "r.src_class", "r.src_oid", "r.target_rule", "r.expected_class", "r.card_max", "r.required", "r.ord",
    )


def _creation(rule: Rule, create: Create) -> str:
    """Tells a rule's created objects apart: `create`, and the own id, or the place among those of the class behind the first."""
    if create.id:
        return f"create/{create.id}"
    before = [c for c in rule.create if c.cls == create.cls and not c.id]
    place = next(i for i, c in enumerate(before) if c is create)
    return f"create/{place}" if place else "create"


def as_column(e: Expression, context: Context | None = None) -> Column:
    return column_of(e, context)


def as_condition(e: Expression, context: Context | None = None) -> Column:
    """A condition by the rules of truth: null is false, a text true unless empty, a number unless 0, another value where it's defined."""
    if context is None or context.df is None:
        return F.coalesce(as_column(e, context).cast("boolean"), F.lit(False))
    return context.truthy(as_column(e, context))


def with_envelope(df: DataFrame, *, input_id: str, cls: str, oid: Expression, order: Expression | None = None, basket_id: Expression | None = None) -> DataFrame:
    """A table as records of a class: its columns, and the envelope. `order` defaults to the identifier."""
    oid = as_column(oid).cast("string")
    return df.select(
        "*",
        F.lit(input_id).alias("_input"),
        (F.lit(None) if basket_id is None else as_column(basket_id)).cast("string").alias("_basket"),
        F.lit(cls).alias("_class"),
        oid.alias("_oid"),
        (oid if order is None else as_column(order)).alias("_ord"),
    )


class Catalog:
    """Records by class and input. Several inputs of a class are a union."""

    def __init__(self):
        self._frames: dict[tuple[str, str], DataFrame] = {}

    def add(self, df: DataFrame, *, input_id: str, cls: str, oid: Expression, order: Expression | None = None, basket_id: Expression | None = None):
        self._frames[cls, input_id] = with_envelope(df, input_id=input_id, cls=cls, oid=oid, order=order, basket_id=basket_id)
        return self

    def classes(self) -> list[tuple[str, str]]:
        return list(self._frames)

    def records(self, cls: str, inputs: tuple[str, ...] = ()) -> DataFrame:
        found = [df for (c, i), df in self._frames.items() if c == cls and (not inputs or i in inputs)]
        if not found:
            raise KeyError(f"no input has class {cls!r}" + (f" in {list(inputs)}" if inputs else ""))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)

    def add_structures(self, cls: str, attribute: str, name: str | None = None):
        """The structures of an array attribute as records of a class of their own, `cls`.`attribute` by default: their
        fields, and _parent_class and _parent_oid; an identifier is the parent's and the place, joined by '-'."""
        name = name or f"{cls}.{attribute}"
        for (c, input_id), df in list(self._frames.items()):
            if c != cls:
                continue
            rows = df.select("_input", "_basket", "_class", "_oid", F.posexplode(attribute).alias("_at", "_item"))
            self._frames[name, input_id] = rows.select(
                "_item.*", "_input", "_basket", F.lit(name).alias("_class"), F.concat_ws("-", F.col("_oid"), F.col("_at").cast("string")).alias("_oid"),
                F.col("_at").alias("_ord"), F.col("_class").alias("_parent_class"), F.col("_oid").alias("_parent_oid"),
            )
        return self


def with_lookups(df: DataFrame, expressions: list[Expression], catalog: Catalog, context: Context) -> DataFrame:
    """`df` with what the lookups of expressions find, joined on: one join for all that share class, key and value.

    lookup(class, key, value, return), lookupOptional(same), lookupIn(input, class,
    key, value, return) and existsIn(input, class, key, value, ...): keys and values
    match as text, of several records the first counts. `context` learns the columns,
    and the problems of misses and of several different answers.
    """
    groups: dict[tuple, list[tuple[Call, str]]] = {}
    exists: list[Call] = []
    for e in expressions:
        for c in calls_in(e):
            name = c.name.lower()
            if name not in JOINED or c in context.joined:
                continue
            if name == "existsin":
                if len(c.args) < 4 or len(c.args) % 2:
                    raise ValueError("existsIn takes an input, a class, and pairs of keys and values")
                exists += [c] if c not in exists else []
                continue
            if len(c.args) != (5 if name == "lookupin" else 4):
                raise ValueError(f"{c.name} takes {5 if name == 'lookupin' else 4} arguments")
            inputs, (cls, key, value, back) = ((c.args[0],), c.args[1:]) if name == "lookupin" else ((), c.args)
            members = groups.setdefault((cls, inputs, key, value), [])
            members += [(c, back)] if c not in [m for m, _ in members] else []
    for (cls, inputs, key, value), members in groups.items():
        n = len(context.joined)
        wanted = {f"_l{n}_{i}": F.col(b) for i, b in enumerate(dict.fromkeys(b for _, b in members))}
        place = {b: f"_l{n}_{i}" for i, b in enumerate(dict.fromkeys(b for _, b in members))}
        right = first_matches(catalog.records(cls, inputs), F.col(key), wanted, F.col("_ord")).withColumnRenamed("k", f"_l{n}_k")
        by = column_of(value, context).cast("string")
        df = df.join(right, by == F.col(f"_l{n}_k"), "left")
        for c, b in members:
            context.joined[c] = F.col(place[b])
            if c.name.lower() != "lookupoptional":
                context.problems.append(("LOOKUP_NO_MATCH", by.isNotNull() & F.col(f"_l{n}_k").isNull(), by))
            context.problems.append(("LOOKUP_AMBIGUOUS", F.coalesce(F.col(f"{place[b]}_ambiguous"), F.lit(False)), by))
    for c in exists:
        n, (input_id, cls, *rest) = len(context.joined), c.args
        keys, values = rest[::2], [column_of(v, context).cast("string") for v in rest[1::2]]
        table = catalog.records(cls, (input_id,)).select(*(F.col(k).cast("string").alias(f"_x{n}_{i}") for i, k in enumerate(keys)))
        hits = table.dropna().distinct().withColumn(f"_x{n}", F.lit(True))
        df = df.join(hits, reduce(lambda a, b: a & b, (v == F.col(f"_x{n}_{i}") for i, v in enumerate(values))), "left")
        context.joined[c] = F.coalesce(F.col(f"_x{n}"), F.lit(False))
    context.df = df
    return df


def _parent_ref(e: Expression | None, parent: str) -> tuple[Expression | None, Expression | None]:
    """What a condition's refEquals holds against the parent's alias, and the rest of the condition."""
    if isinstance(e, Call):
        if e.name.lower() == "refequals" and parent in e.args:
            return next(a for a in e.args if a != parent), None
        if e.name.lower() == "and":
            for i, a in enumerate(e.args):
                ref, rest = _parent_ref(a, parent)
                if ref is not None and rest is None:
                    left = e.args[:i] + e.args[i + 1 :]
                    return ref, left[0] if len(left) == 1 else Call("and", left)
    return None, e


def with_bag(df: DataFrame, parent: str, bag: Bag, catalog: Catalog, context: Context) -> DataFrame:
    """`df` with the array of structures of an embedded bag, named by its attribute."""
    if bag.source is None:
        own = Context(df, context.enums, context.joined, context.problems)
        condition = F.lit(True) if bag.where is None else as_condition(bag.where, own)
        return df.withColumn(bag.attribute, nested.synthetic(condition, {k: column_of(e, own) for k, e in bag.assign.items()}))
    ref, where = (bag.parent_ref, bag.where) if bag.parent_ref is not None or bag.band else _parent_ref(bag.where, parent)
    if ref is None and not bag.band:
        raise ValueError(f"bag {bag.attribute}: no reference to the parent; name parent_ref or a band, or give refEquals in the condition")
    child = _aliased(catalog, bag.source).dropDuplicates(["_input", "_basket", "_class", "_oid"])
    for b in bag.bags:
        child = with_bag(child, bag.source.alias, b, catalog, Context(child, context.enums))
    own = Context(child, context.enums)
    child = with_lookups(child, [*bag.assign.values(), *(x for x in (bag.source.where, where) if x is not None)], catalog, own)
    if bag.source.where is not None:
        child = child.where(as_condition(bag.source.where, own))
    fields = {k: column_of(e, own) for k, e in bag.assign.items()} | {b.attribute: F.col(b.attribute) for b in bag.bags}
    order = F.col(f"{bag.source.alias}._ord") if bag.order is None else column_of(bag.order, own)
    of_parent = F.col(f"{parent}._oid")
    item = F.struct(order.isNull().alias("last"), order.alias("place"), F.struct(*(c.alias(n) for n, c in fields.items())).alias("item"))
    name = f"_b_{bag.attribute}"
    if bag.mode == "summary" and bag.band:
        return _summarised(df, parent, _band_summary(df, parent, child, bag, where, item, own, context), bag)
    if bag.band:
        parents = df.select(*(F.col(f"{parent}.{c}") for c in df.select(f"{parent}.*").columns)).alias(parent)
        child, key = _banded(parents, child, bag, own), of_parent
        own = Context(child, context.enums, own.joined)
    else:
        key = column_of(ref, own).cast("string")
    if where is not None:
        try:
            child = child.where(as_condition(where, own))
        except AnalysisException:  # it names the parent as well
            met = df.select(*(F.col(f"{parent}.{c}") for c in df.select(f"{parent}.*").columns)).alias(parent).join(child, key == of_parent)
            child = met.where(as_condition(where, Context(met, context.enums, own.joined)))
    rows = child.select(key.alias(name), item.alias("row")).where(F.col(name).isNotNull())
    if bag.mode == "summary":
        return _summarised(df, parent, rows.groupBy(name).agg(F.count("*").alias("n"), F.min("row").alias("row")), bag)
    found = rows.groupBy(name).agg(F.transform(F.sort_array(F.collect_list("row")), lambda x: x["item"]).alias(bag.attribute))
    kind = found.schema[bag.attribute].dataType
    joined = df.join(found, of_parent == F.col(name), "left").drop(name)
    return joined.withColumn(bag.attribute, F.coalesce(F.col(bag.attribute), F.array().cast(kind)))


def _summarised(df: DataFrame, parent: str, found: DataFrame, bag: Bag) -> DataFrame:
    """`df` with `found` (key, n, row) as the summary of a bag; none: 0, and no first structure."""
    name = f"_b_{bag.attribute}"
    found = found.select(name, F.struct("n", F.col("row.item").alias("first")).alias(bag.attribute))
    joined = df.join(found, F.col(f"{parent}._oid") == F.col(name), "left").drop(name)
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast(found.schema[bag.attribute].dataType["first"].dataType).alias("first"))
    return joined.withColumn(bag.attribute, F.coalesce(F.col(bag.attribute), none))


def _band_summary(df: DataFrame, parent: str, child: DataFrame, bag: Bag, where: Expression | None, item: Column, own: Context, context: Context) -> DataFrame:
    """(key, n, row) of the children that a band, and a condition, join to each parent."""
    name, alias = f"_b_{bag.attribute}", bag.source.alias
    parents = df.select(*(F.col(f"{parent}.{c}") for c in df.select(f"{parent}.*").columns), F.col(f"{parent}._oid").alias(name)).where(F.col(name).isNotNull()).alias(parent)
    value, low, high = (column_of(e, own) for e in bag.band)
    try:
        child.select(value)
        of_children = True
    except AnalysisException:
        of_children = False
    shared: list[str] = []
    met = lambda rows: rows
    if where is not None:
        try:
            child = child.where(as_condition(where, own))
        except AnalysisException:  # it names the parent as well
            met = lambda rows: rows.where(as_condition(where, Context(rows, context.enums, own.joined)))
            shared = _named_by(met, parents, child)
    # Children are numbered by their order, so that the first one is the least number.
    sides = [value] if of_children else [low, high]
    held = child.select(*(c.alias(f"_s{i}") for i, c in enumerate(sides)), *shared, item.alias("row"))
    held = stored(numbered_oids(held, ["row"], name="_first").withColumn("_first", F.col("_first").cast("long")), "bag-children")
    value, low, high = (F.col("_s0"), low, high) if of_children else (value, F.col("_s0"), F.col("_s1"))
    plain = [c.rpartition(".")[2] for c in shared]
    found = fold(parents, name, held, value, low, high, of_children=of_children, shared=plain, place="_first", met=met, name=lambda rows: rows.alias(alias))
    rows = held.select(F.col("_first").alias("_numbered"), "row")
    return found.join(rows, F.col("_first") == F.col("_numbered")).select(name, "n", "row")


def _named_by(met, parents: DataFrame, child: DataFrame) -> list[str]:
    """The columns of `child` that a condition over it and `parents` reads; all of them where it gives another answer each time."""
    mine: dict[int, str] = {}
    output = child._jdf.queryExecution().analyzed().output().iterator()
    while output.hasNext():
        a = output.next()
        mine[a.exprId().id()] = ".".join([*(q for q in a.qualifier().mkString(".").split(".") if q), a.name()])
    condition = met(parents.crossJoin(child))._jdf.queryExecution().analyzed().condition()
    if not condition.deterministic():
        return list(mine.values())
    read, found = condition.references().iterator(), []
    while read.hasNext():
        a = read.next()
        if a.exprId().id() in mine:
            found.append(mine[a.exprId().id()])
    return found


def _banded(parents: DataFrame, child: DataFrame, bag: Bag, own: Context) -> DataFrame:
    """Children beside the parents that the bag's band joins them to, whichever side has the value."""
    value, low, high = (column_of(e, own) for e in bag.band)
    try:
        child.select(value)
    except AnalysisException:
        return band_join(parents, value, child, low, high)
    return band_join(child, value, parents, low, high)


def expanded_bag(df: DataFrame, rule: Rule, bag: Bag, context: Context, owner: Column, base: list[Column]) -> list[tuple[Bag, DataFrame]]:
    """The objects of an expanded bag, and of the bags within it, each frame beside its bag: envelope, parent's identifier and
    attributes. An object's identifier, until it is numbered, is its parent's, the bag's name and its place."""
    items = F.col(bag.items or bag.attribute)
    items = F.slice(items, 1, bag.max_items) if bag.max_items else items
    at = f"_at_{bag.attribute}"
    rows = df.withColumn("_owner", owner).select("*", F.posexplode(items).alias(at, bag.alias))
    own = Context(rows, context.enums, context.joined)
    if bag.where is not None:
        rows = rows.where(as_condition(bag.where, own))
    path = F.concat_ws("-", F.col("_owner"), F.lit(bag.attribute), F.col(at).cast("string"))
    columns = [F.lit(rule.output).alias("_output"), F.lit(bag.target or rule.cls).alias("_class"), path.alias("_oid"), *base]
    if bag.parent_role:
        columns.append(F.col("_owner").alias(bag.parent_role))
    out = [(bag, rows.select(*columns, *(column_of(e, own).alias(k) for k, e in bag.assign.items())))]
    inner = rows.withColumn("_up", path).drop("_owner")
    for b in bag.bags:
        out += expanded_bag(inner, rule, b, Context(inner, context.enums, context.joined), F.col("_up"), base)
    return out


def _aliased(catalog: Catalog, source: Source) -> DataFrame:
    return catalog.records(source.cls, source.inputs).alias(source.alias)


def joined(rule: Rule, catalog: Catalog, context: Context) -> tuple[DataFrame, list[DataFrame]]:
    """The joined records of a rule before its condition, and per inner join the driver rows that miss.

    Only the first source's own filter is applied: records of a right side are
    chosen by the join. Filters on other sources of a joined rule are refused.
    """
    by_alias = {s.alias: s for s in rule.sources}
    first = rule.sources[0]
    if rule.joins and any(s.where is not None for s in rule.sources[1:]):
        raise ValueError(f"rule {rule.id}: a filter on a joined source; put it into the rule's condition")
    context.df = df = _aliased(catalog, first)
    if first.where is not None:
        df = with_lookups(df, [first.where], catalog, context)
        df = df.where(as_condition(first.where, context))
    misses, bound = [], {first.alias}
    for join in rule.joins:
        pairs = [(as_column(a, context).cast("string"), as_column(b, context).cast("string")) for a, b in join.on]
        condition = reduce(lambda a, b: a & b, (a == b for a, b in pairs))
        if join.right in bound:  # both sides are there: the equality is a filter
            df = df.where(condition)
            continue
        if join.kind not in ("inner", "left"):
            raise ValueError(f"rule {rule.id}: join kind {join.kind!r}")
        right = _aliased(catalog, by_alias[join.right])
        if join.kind == "inner":
            key = F.concat_ws("|", *(a for a, _ in pairs))
            misses.append(df.join(right, condition, "left_anti").select(F.lit("RUN_JOIN_MISSING").alias("code"), F.lit(rule.id).alias("rule"), key.alias("key")))
        df = df.join(right, condition, join.kind)
        bound.add(join.right)
    context.df = df
    return df, misses


def matched(rule: Rule, catalog: Catalog, context: Context | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """`joined`, with the rule's condition."""
    context = context or Context()
    df, misses = joined(rule, catalog, context)
    if rule.where is not None:
        df = with_lookups(df, [rule.where], catalog, context)
        df = df.where(as_condition(rule.where, context))
    context.df = df
    return df, misses


def prepared(rule: Rule, source: Source, df: DataFrame, catalog: Catalog, context: Context, attributes: dict[str, Expression]) -> DataFrame:
    """Matched records with the lookups of all of a rule's expressions and its embedded bags."""
    expressions = [*attributes.values(), *(r.source_oid for r in rule.refs if r.source_oid is not None)]
    expressions += [e for b in rule.bags if b.mode == "expand" or b.source is None for e in (*b.assign.values(), b.where) if e is not None]
    df = with_lookups(df, expressions, catalog, context)
    for b in rule.bags:
        if b.mode in ("embed", "summary"):
            context.df = df = with_bag(df, source.alias, b, catalog, context)
            for name in b.mandatory:
                missing = F.array_contains(F.transform(F.col(f"{b.attribute}.{name}"), lambda v: v.isNull()), True)
                context.problems.append(("RUN_BAG_MANDATORY_MISSING", missing, F.concat_ws(".", F.lit(b.attribute), F.lit(name))))
    return df


def lower(
    rule: Rule, catalog: Catalog, *, oid: str = "deterministicUuid", namespace: str = "", baskets: str = "preserve",
    defaults: dict[str, Expression] | None = None, enums: dict[str, dict[str, str]] | None = None,
) -> RuleFrames:
    """The frames of a rule. A rule without joins takes each of its sources in turn (a merge)."""
    single = lambda s: Rule(rule.id, rule.output, rule.cls, (s,), rule.assign, where=rule.where)
    parts = []
    for s, r in [(rule.sources[0], rule)] if rule.joins else [(s, single(s)) for s in rule.sources]:
        context = Context(enums=enums or {})
        before, misses = joined(r, catalog, Context(enums=enums or {}))
        df, _ = matched(r, catalog, context)
        parts.append((s, df, context, before, misses))
    # An assignment decides even where it gives null; the rule's default goes before the job's.
    attributes = {**(defaults or {}), **rule.defaults, **rule.assign}
    made, losses, created, expanded, missing = [], [], [], [], []
    for s, df, context, _, misses in parts:
        missing += misses
        df = prepared(rule, s, df, catalog, context, attributes)
        own = {k: F.col(f"{s.alias}.{k}") for k in ENVELOPE}
        source = {"input": own["_input"], "basket": own["_basket"], "class": own["_class"], "oid": own["_oid"]}
        keys = {k: as_column(k) for k in rule.identity}
        if oid == "deterministicUuid":
            target_oid = deterministic_uuid(namespace, rule.id, rule.cls, keys, source)
        elif oid == "preserve":
            # Records without an identifier differ by nothing else for sure; objects of expanded bags need one that comes again.
            again = keys or any(b.mode == "expand" for b in rule.bags)
            target_oid = preserved_oid(own["_oid"], deterministic_uuid(namespace, rule.id, rule.cls, keys, source) if again else F.uuid())
        elif oid == "uuid":
            target_oid = F.uuid()
        else:
            raise ValueError(f"identifier strategy {oid!r}; number the targets of all rules with numbered_oids")
        home = basket(baskets, own["_basket"], F.lit(rule.cls.rpartition(".")[0])).alias("_basket")
        envelope = [
            F.lit(rule.output).alias("_output"),
            F.lit(rule.cls).alias("_class"),
            target_oid.alias("_oid"),
            home,
            F.lit(rule.id).alias("_rule"),
            own["_oid"].alias("_source_oid"),
        ]
        columns = [as_column(e, context).alias(n) for n, e in attributes.items()]
        bags = [F.col(b.attribute) for b in rule.bags if b.mode != "expand"]
        refs = F.array(*((F.lit(None) if r.source_oid is None else as_column(r.source_oid, context)).cast("string") for r in rule.refs))
        problems = [F.when(c, F.struct(F.lit(code).alias("code"), key.alias("key"))) for code, c, key in context.problems]
        hidden = [own[f"_{c}"].alias(f"_source_{c}") for c in ("input", "basket", "class")] + [refs.cast("array<string>").alias("_refs")]
        hidden.append((F.array_compact(F.array(*problems)) if problems else F.array()).cast("array<struct<code:string,key:string>>").alias("_problems"))
        made.append(df.select(*envelope, *hidden, *columns, *bags))
        for b in rule.bags:
            if b.mode == "expand":
                if oid == "uuid":
                    raise ValueError(f"rule {rule.id}: expanded bags need identifiers that a second run of the plan gives again")
                base = [home, F.lit(rule.id).alias("_rule"), own["_oid"].alias("_source_oid")]
                expanded += expanded_bag(df, rule, b, context, target_oid, base)
                if b.max_items:
                    lost = F.size(F.col(b.items or b.attribute)) - b.max_items
                    losses.append(
                        df.where(lost > 0).select(
                            F.lit(rule.id).alias("rule"), own["_class"].alias("source_class"), own["_oid"].alias("source_oid"), F.lit(b.attribute).alias("source_path"),
                            F.lit("BAG_MAX_ITEMS_EXCEEDED").alias("reason_code"), F.concat(lost.cast("string"), F.lit(" more")).alias("description"),
                        )
                    )
        for loss in rule.losses:
            # Single-source rules report losses of filtered records too; joined ones only of matches.
            rows, of_loss = (df, context) if rule.joins else (_aliased(catalog, s), Context(enums=enums or {}))
            of_loss.df = rows
            rows = rows if loss.when is None else rows.where(as_condition(loss.when, of_loss))
            losses.append(
                rows.select(
                    F.lit(rule.id).alias("rule"),
                    own["_class"].alias("source_class"),
                    own["_oid"].alias("source_oid"),
                    F.lit(loss.source_path).alias("source_path"),
                    F.lit(loss.reason_code).alias("reason_code"),
                    F.lit(loss.description).alias("description"),
                )
            )
    for c in rule.create:
        # Further objects are made of every record of every source, whatever the filters and joins.
        for s in rule.sources:
            rows = _aliased(catalog, s)
            of_rows = Context(rows, enums or {})
            rows = with_lookups(rows, [*c.assign.values(), *(r.source_oid for r in c.refs if r.source_oid is not None)], catalog, of_rows)
            own = {k: F.col(f"{s.alias}._{k}") for k in ("input", "basket", "class", "oid")}
            refs = F.array(*((F.lit(None) if r.source_oid is None else as_column(r.source_oid, of_rows)).cast("string") for r in c.refs))
            made_by = rows.select(
                F.lit(rule.output).alias("_output"),
                F.lit(c.cls).alias("_class"),
                deterministic_uuid(namespace, f"{rule.id}/{_creation(rule, c)}", c.cls, {}, own).alias("_oid"),
                basket(baskets, own["basket"], F.lit(c.cls.rpartition(".")[0])).alias("_basket"),
                own["basket"].alias("_source_basket"),
                own["oid"].alias("_source_oid"),
                F.lit(rule.id).alias("_rule"),
                refs.cast("array<string>").alias("_refs"),
                *(as_column(e, of_rows).alias(n) for n, e in c.assign.items()),
            )
            created.append((c, made_by))
    union = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None
    visited = union([catalog.records(s.cls, s.inputs).select(F.lit(rule.id).alias("rule")) for s in (rule.sources[:1] if rule.joins else rule.sources)])
    matches = union([before.select(F.lit(rule.id).alias("rule")) for *_, before, _ in parts])
    return RuleFrames(rule, union(made), union(losses), created, union(missing), visited, matches, expanded)


def metrics(frames: list[RuleFrames]) -> DataFrame:
    """(rule, visited, matches, filtered, created) of rules: records of the first source, what they and the joins give
    after the sources' own filters, what the rule's condition drops, and target objects."""
    parts = []
    for f in frames:
        for name, rows in (("visited", f.visited), ("matches", f.matches), ("created", f.full.select(F.col("_rule").alias("rule")))):
            parts.append(rows.groupBy("rule").agg(*((F.count("*") if n == name else F.lit(0).cast("long")).alias(n) for n in ("visited", "matches", "created"))))
    both = reduce(lambda a, b: a.unionByName(b), parts)
    sums = both.groupBy("rule").agg(*(F.sum(n).alias(n) for n in ("visited", "matches", "created")))
    return sums.select("rule", "visited", "matches", (F.col("matches") - F.col("created")).alias("filtered"), "created")
