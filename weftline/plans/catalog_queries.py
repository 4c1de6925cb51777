"""One query per operator over the example tables, with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import functions as W
from weftline.functions.geometry import wkb_text
from weftline.operators import bags, identity, lookups, references, transfer
from weftline.operators.rules import Catalog, Create, Join, Loss, Ref, Rule, Source, lower, matched, metrics
from weftline.plans import bundle, runner
from weftline.plans.job import job_of, rule_of
from weftline.sources import formats
from weftline.storage import shared_folder

KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
    "orders": "o_orderkey", "events": "event_id",
}
STATUS = {"F": "finished", "O": "open"}
FLAGS = {"R": "true", "A": "false", "N": "false"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _catalog(spark: SparkSession, sf_dir: str, *names: str) -> Catalog:
    found = Catalog()
    for n in names:
        found.add(_table(spark, sf_dir, n), input_id="tpch", cls=f"tpch.Main.{n}", oid=KEYS[n], order=KEYS[n])
    return found


def registering(queries: dict[str, Callable], sqls: dict[str, str]):
    """A decorator that takes a query, with its SQL, into these."""

    def query(sql: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return keep

    return query


query = registering(QUERIES, ORACLE_SQL)


def _uuid_sql(name: str) -> str:
    h = f"md5({name})"
    return (
        f"substr({h},1,8)||'-'||substr({h},9,4)||'-3'||substr({h},14,3)||'-'||translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab')"
        f"||substr({h},18,3)||'-'||substr({h},21,12)"
    )


# Filters


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
def flt_source_where(spark, sf_dir):
    c = _catalog(spark, sf_dir, "orders")
    rule = Rule("r", "out", "T", (Source("o", "tpch.Main.orders", where="o.o_orderstatus = 'F'"),), {})
    return matched(rule, c)[0].select("o_orderkey", "o_totalprice")


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_totalprice > 100000 and c_acctbal > 0")
def flt_rule_where(spark, sf_dir):
    c = _catalog(spark, sf_dir, "orders", "customer")
    rule = Rule(
        "r", "out", "T", (Source("o", "tpch.Main.orders"), Source("c", "tpch.Main.customer")), {},
        joins=(Join("c", (("o.o_custkey", "c.c_custkey"),)),), where="o.o_totalprice > 100000 and c.c_acctbal > 0",
    )
    return matched(rule, c)[0].select("o_orderkey", "c_name")


@query(
    "select event_id, (event_type is not null and event_type <> '') as text_true, (value is not null and value <> 0) as number_true,"
    " (props is not null) as other_true from events"
)
def flt_truthy(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        W.truthy(F.col("event_type"), "text").alias("text_true"),
        W.truthy(F.col("value"), "number").alias("number_true"),
        W.truthy(F.col("props"), "other").alias("other_true"),
    )


# Projections


@query("select c_custkey, c_name as label, upper(c_name) as label_upper, 'EUR' as currency from customer")
def prj_assign_defaults(spark, sf_dir):
    c = _catalog(spark, sf_dir, "customer")
    rule = Rule(
        "r", "out", "tpch.Main.T", (Source("c", "tpch.Main.customer"),), {"c_custkey": "c.c_custkey", "label": "c.c_name", "label_upper": "upper(c.c_name)"},
        defaults={"label": "'none'"},
    )
    return lower(rule, c, defaults={"currency": "'EUR'"}).targets.select("c_custkey", "label", "label_upper", "currency")


@query("select o_orderkey, case o_orderstatus when 'F' then 'finished' when 'O' then 'open' end as status from orders")
def prj_enum_map(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", W.enum_map(F.col("o_orderstatus"), STATUS).alias("status"))


@query("select o_orderkey, case o_orderstatus when 'F' then 'finished' when 'O' then 'open' else 'other' end as status from orders")
def prj_enum_map_default(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", W.enum_map_default(F.col("o_orderstatus"), STATUS, F.lit("other")).alias("status"))


@query("select o_orderstatus as miss, count(*) as n from orders where o_orderstatus not in ('F','O') group by 1")
def prj_enum_strict_misses(spark, sf_dir):
    _, miss = W.enum_map_strict(F.col("o_orderstatus"), STATUS)
    return _table(spark, sf_dir, "orders").where(miss).groupBy(F.col("o_orderstatus").alias("miss")).agg(F.count("*").alias("n"))


@query("select l_returnflag as flag, l_returnflag = 'R' as returned, count(*) as n from lineitem group by 1, 2")
def prj_enum_typed_bool(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").withColumn("returned", W.enum_map(F.col("l_returnflag"), FLAGS))
    return df.groupBy(F.col("l_returnflag").alias("flag"), "returned").agg(F.count("*").alias("n"))


@query("select n_nationkey, case n_regionkey when 0 then 'world.africa' when 1 then 'world.america' else n_name end as area from nation")
def prj_enum_resolve(spark, sf_dir):
    short = F.when(F.col("n_regionkey") == 0, "africa").when(F.col("n_regionkey") == 1, "world.america").otherwise(F.col("n_name"))
    return _table(spark, sf_dir, "nation").select("n_nationkey", W.enum_resolve(short, ["world", "world.africa", "world.america"]).alias("area"))


# Conditions


@query(
    "select c_custkey, o_orderkey, coalesce(c_acctbal < o_totalprice, false) as lt, coalesce(c_acctbal <= o_totalprice, true) as lte,"
    " coalesce(c_acctbal > o_totalprice, false) as gt, coalesce(c_acctbal >= o_totalprice, true) as gte,"
    " c_custkey is not distinct from o_custkey as eq, c_custkey is distinct from o_custkey as neq"
    " from customer left join orders on o_custkey = c_custkey"
)
def expr_null_compare(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    a, b = F.col("c_acctbal"), F.col("o_totalprice")
    return df.select(
        "c_custkey", "o_orderkey", W.lt_value(a, b).alias("lt"), W.lte_value(a, b).alias("lte"), W.gt_value(a, b).alias("gt"),
        W.gte_value(a, b).alias("gte"), W.eq_value(F.col("c_custkey"), F.col("o_custkey")).alias("eq"), W.neq_value(F.col("c_custkey"), F.col("o_custkey")).alias("neq"),
    )


@query(
    "select o_orderkey, case when o_totalprice > 200000 then o_orderstatus = 'O' else false end as both_true,"
    " case when o_totalprice > 200000 then true else o_orderstatus = 'O' end as either_true, not (o_orderstatus = 'O') as negated,"
    " case when o_totalprice > 200000 then 'big' else 'small' end as size_name from orders"
)
def expr_and_or_not_if(spark, sf_dir):
    big, is_open = F.col("o_totalprice") > 200000, F.col("o_orderstatus") == "O"
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", W.and_value(big, is_open).alias("both_true"), W.or_value(big, is_open).alias("either_true"),
        W.not_value(is_open).alias("negated"), W.if_value(big, F.lit("big"), F.lit("small")).alias("size_name"),
    )


# Text


@query(
    "select p_partkey, p_brand || p_type as joined, case when length(p_name) > 3 then substr(p_name, 4, 5) else '' end as middle,"
    " trim(p_name) as trimmed, upper(p_name) as up, lower(p_name) as low, replace(p_name, 'a', '_') as replaced, substr(p_type, 1, 6) as short,"
    " case when length(p_name) > 500 then p_name else '' end as beyond from part"
)
def str_functions(spark, sf_dir):
    n = F.col("p_name")
    return _table(spark, sf_dir, "part").select(
        "p_partkey", W.concat_text(F.col("p_brand"), F.lit(None).cast("string"), F.col("p_type")).alias("joined"), W.substring_at(n, 3, 5).alias("middle"),
        W.trim_controls(n).alias("trimmed"), F.upper(n).alias("up"), F.lower(n).alias("low"), W.replace_all(n, "a", "_").alias("replaced"),
        W.truncate_text(F.col("p_type"), 6).alias("short"), W.substring_at(n, 500, 5).alias("beyond"),
    )


# Dates


@query(
    "select o_orderkey, cast(o_orderdate as date) as day, strftime(o_orderdate, '%Y%m%d') as compact,"
    " strftime(cast(o_orderdate as date) + interval 12 hour, '%Y-%m-%d %H:%M:%S') as noon,"
    " strftime(o_orderdate, '%Y-%m-%d') || ' 10:11:12' as local_time from orders"
)
def date_functions(spark, sf_dir):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", W.to_date_value(iso).alias("day"), W.to_compact_date(iso).alias("compact"),
        show(W.to_datetime_value(F.date_format("o_orderdate", "yyyyMMdd"))).alias("noon"),
        show(W.to_datetime_value(F.concat(iso, F.lit("T10:11:12+02:00")))).alias("local_time"),
    )


# Numbers


@query(
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity + l_tax as double) as added, cast(l_quantity - l_discount as double) as less,"
    " cast(l_quantity * 2 as double) as doubled, cast(abs(-l_quantity) as double) as positive, cast(least(l_quantity, 10) as double) as lowest,"
    " cast(greatest(l_quantity, 10) as double) as highest, null::double as no_lowest from lineitem"
)
def num_functions(spark, sf_dir):
    q = F.col("l_quantity")
    double = lambda c: c.cast("double")
    return _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", double(W.add(q, F.col("l_tax"))).alias("added"), double(W.sub(q, F.col("l_discount"))).alias("less"),
        double(W.mul(q, F.lit(2))).alias("doubled"), double(W.abs_of(-q)).alias("positive"), double(W.min_of(q, F.lit(10))).alias("lowest"),
        double(W.max_of(q, F.lit(10))).alias("highest"), double(W.min_of(q, F.lit(None))).alias("no_lowest"),
    )


@query(
    "select s_suppkey, cast(round(cast(s_acctbal as decimal(20,10)) / 3, 6) as double) as third, null::double as by_zero,"
    " cast(round(cast(s_acctbal as decimal(38,10)), 1) as double) as rounded from supplier"
)
def num_div_round(spark, sf_dir):
    x = F.col("s_acctbal")
    return _table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.round(W.div(x, F.lit(3)), 6).cast("double").alias("third"), W.div(x, F.lit(0)).cast("double").alias("by_zero"), W.round_to(x, 1).cast("double").alias("rounded")
    )


@query("select s_suppkey, cast(s_suppkey as double) as plain, null::double as no_number, cast(s_suppkey as varchar) as shown from supplier")
def num_to_number(spark, sf_dir):
    text = F.col("s_suppkey").cast("string")
    return _table(spark, sf_dir, "supplier").select(
        "s_suppkey", W.to_number(text).cast("double").alias("plain"), W.to_number(F.concat(F.lit(" "), text)).cast("double").alias("no_number"), W.number_text(F.col("s_suppkey")).alias("shown")
    )


@query("select event_id, sqrt(power(value - 5, 2) + power(3 - 3, 2)) <= 10 as near, false as negative from events")
def coord_equals(spark, sf_dir):
    a = F.struct(F.col("value").alias("x"), F.lit(3.0).alias("y"))
    b = F.struct(F.lit(5.0).alias("x"), F.lit(3.0).alias("y"))
    return _table(spark, sf_dir, "events").select("event_id", W.coord_equals(a, b, F.lit(10.0)).alias("near"), W.coord_equals(a, b, F.lit(-1.0)).alias("negative"))


@query("select s_suppkey, s_suppkey + 1.0::double as x, 1.0::double as y from supplier")
def point_on_surface(spark, sf_dir):
    k = F.col("s_suppkey")
    corners = ", ".join(["%1$d 0", "%2$d 0", "%2$d 2", "%1$d 2", "%1$d 0"])
    wkt = F.format_string(f"POLYGON (({corners}))", k, k + 2)
    return _table(spark, sf_dir, "supplier").withColumn("p", W.point_on_surface(wkt)).select("s_suppkey", "p.x", "p.y")


# Joins

_ORDERS = (Source("o", "tpch.Main.orders"), Source("c", "tpch.Main.customer"))
_ON_CUSTOMER = Join("c", (("o.o_custkey", "c.c_custkey"),))


@query(
    f"select {_uuid_sql("'ns::orders::tpch.Main.Sale::o.o_orderkey=' || o_orderkey")} as oid, o_orderkey, upper(c_name) || '/' || o_orderstatus as label"
    " from orders join customer on o_custkey = c_custkey"
)
def join_inner(spark, sf_dir):
    c = _catalog(spark, sf_dir, "orders", "customer")
    assign = {"o_orderkey": "o.o_orderkey", "label": "concat_ws('', upper(c.c_name), '/', o.o_orderstatus)"}
    rule = Rule("orders", "out", "tpch.Main.Sale", _ORDERS, assign, joins=(_ON_CUSTOMER,), identity=("o.o_orderkey",))
    return lower(rule, c, namespace="ns").targets.select(F.col("_oid").alias("oid"), "o_orderkey", "label")


@query("select c_custkey, o_orderkey, o_totalprice from customer left join orders on o_custkey = c_custkey")
def join_left(spark, sf_dir):
    c = _catalog(spark, sf_dir, "orders", "customer")
    rule = Rule("r", "out", "T", (Source("c", "tpch.Main.customer"), Source("o", "tpch.Main.orders")), {}, joins=(Join("o", (("c.c_custkey", "o.o_custkey"),), "left"),))
    return matched(rule, c)[0].select("c_custkey", "o_orderkey", "o_totalprice")


@query(
    "select o_orderkey, c_name, n_name, r_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"
    " join region on n_regionkey = r_regionkey"
)
def join_chain(spark, sf_dir):
    c = _catalog(spark, sf_dir, "orders", "customer", "nation", "region")
    sources = (*_ORDERS, Source("n", "tpch.Main.nation"), Source("r", "tpch.Main.region"))
    joins = (_ON_CUSTOMER, Join("n", (("c.c_nationkey", "n.n_nationkey"),)), Join("r", (("n.n_regionkey", "r.r_regionkey"),)))
    return matched(Rule("r", "out", "T", sources, {}, joins=joins), c)[0].select("o_orderkey", "c_name", "n_name", "r_name")


@query("select o_orderkey, c_name from orders join customer on cast(o_custkey as varchar) = cast(c_custkey as varchar)")
def join_ref_to_object(spark, sf_dir):
    c = _catalog(spark, sf_dir, "orders", "customer")
    return matched(Rule("r", "out", "T", _ORDERS, {}, joins=(Join("c", (("o.o_custkey", "c._oid"),)),)), c)[0].select("o_orderkey", "c_name")


@query("select 'RUN_JOIN_MISSING' as code, cast(c_custkey as varchar) as key from customer where c_custkey not in (select o_custkey from orders)")
def diag_join_missing(spark, sf_dir):
    c = _catalog(spark, sf_dir, "orders", "customer")
    rule = Rule("r", "out", "T", (Source("c", "tpch.Main.customer"), Source("o", "tpch.Main.orders")), {}, joins=(Join("o", (("c.c_custkey", "o.o_custkey"),)),))
    return matched(rule, c)[1][0].select("code", "key")


# Lookups


@query(
    "select c_custkey, arg_min(o_orderstatus, o_orderkey) as first_status, count(o_orderkey) > 0 as found, coalesce(count(distinct o_orderstatus) > 1, false) as ambiguous"
    " from customer left join orders on o_custkey = c_custkey group by c_custkey"
)
def lookup_first(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    df = lookups.lookup(_table(spark, sf_dir, "customer"), F.col("c_custkey"), o, F.col("o_custkey"), {"first_status": F.col("o_orderstatus")}, F.col("o_orderkey"))
    return df.select("c_custkey", "first_status", F.col("_found").alias("found"), F.col("first_status_ambiguous").alias("ambiguous"))


@query(
    "select 'LOOKUP_NO_MATCH' as code, cast(c_custkey as varchar) as key, 1 as n from customer where c_custkey not in (select o_custkey from orders) union all"
    " select 'LOOKUP_AMBIGUOUS', cast(o_custkey as varchar), 1 from orders where o_custkey in (select c_custkey from customer) group by o_custkey having count(distinct o_orderstatus) > 1"
)
def lookup_diagnostics(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    df = lookups.lookup(_table(spark, sf_dir, "customer"), F.col("c_custkey"), o, F.col("o_custkey"), {"first_status": F.col("o_orderstatus")}, F.col("o_orderkey"))
    return lookups.lookup_diagnostics(df, F.col("c_custkey"), ["first_status"])


@query("select c_custkey, exists(select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') as found from customer")
def exists_in(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return lookups.exists(_table(spark, sf_dir, "customer"), [(F.col("c_custkey"), F.col("o_custkey")), (F.lit("F"), F.col("o_orderstatus"))], o).select("c_custkey", "found")


# Merge, split, create


@query("select c_custkey as key, c_name as name, 'c' as kind from customer union all select s_suppkey, s_name, 's' from supplier")
def merge_multi_source(spark, sf_dir):
    c = Catalog()
    c.add(_table(spark, sf_dir, "customer").selectExpr("c_custkey as key", "c_name as name", "'c' as kind"), input_id="a", cls="Party", oid="key")
    c.add(_table(spark, sf_dir, "supplier").selectExpr("s_suppkey as key", "s_name as name", "'s' as kind"), input_id="b", cls="Party", oid="key")
    rule = Rule("r", "out", "T", (Source("p", "Party", ("a", "b")),), {"key": "p.key", "name": "p.name", "kind": "p.kind"})
    return lower(rule, c).targets.select("key", "name", "kind")


@query("select o_orderkey, case when o_orderstatus = 'F' then 'Closed' else 'Open' end as cls from orders")
def split_rules(spark, sf_dir):
    c = _catalog(spark, sf_dir, "orders")
    both = [
        lower(Rule(i, "out", i, (Source("o", "tpch.Main.orders", where=w),), {"o_orderkey": "o.o_orderkey"}), c).targets
        for i, w in (("Closed", "o.o_orderstatus = 'F'"), ("Open", "o.o_orderstatus <> 'F'"))
    ]
    return both[0].unionByName(both[1]).select("o_orderkey", F.col("_class").alias("cls"))


@query("select o_orderkey, 'Sale' as cls from orders where o_orderstatus = 'F' union all select o_orderkey, 'Log' from orders")
def create_additional(spark, sf_dir):
    c = _catalog(spark, sf_dir, "orders")
    key = {"o_orderkey": "o.o_orderkey"}
    f = lower(Rule("r", "out", "Sale", (Source("o", "tpch.Main.orders", where="o.o_orderstatus = 'F'"),), key, create=(Create("Log", key),)), c)
    return f.targets.unionByName(f.created[0][1], allowMissingColumns=True).select("o_orderkey", F.col("_class").alias("cls"))


@query("select o_orderkey, 'priority' as source_path, 'DROPPED' as reason_code from orders where o_orderpriority like '1%'")
def loss_events(spark, sf_dir):
    c = _catalog(spark, sf_dir, "orders")
    loss = Loss("priority", "DROPPED", "not in the target", "o.o_orderpriority like '1%'")
    f = lower(Rule("r", "out", "T", (Source("o", "tpch.Main.orders", where="o.o_orderstatus = 'F'"),), {}, losses=(loss,)), c)
    return f.losses.select(F.col("source_oid").cast("bigint").alias("o_orderkey"), "source_path", "reason_code")


# Bags


def _embedded(spark, sf_dir, where=None):
    c, o = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    return bags.embed(c, F.col("c_custkey"), o, F.col("o_custkey"), {"key": F.col("o_orderkey"), "price": F.col("o_totalprice")}, order=F.col("o_orderkey"), where=where)


@query(
    "select c_custkey, count(o_orderkey) as n, min(o_orderkey) as first_key, arg_min(o_totalprice, o_orderkey) as first_price"
    " from customer left join orders on o_custkey = c_custkey group by 1"
)
def bag_embed(spark, sf_dir):
    return _embedded(spark, sf_dir).select(
        "c_custkey", F.size("bag").cast("long").alias("n"), bags.first_of("bag", "key").alias("first_key"), bags.first_of("bag", "price").alias("first_price")
    )


@query("select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F' group by 1")
def bag_embed_where(spark, sf_dir):
    return _embedded(spark, sf_dir, F.col("o_orderstatus") == "F").select("c_custkey", F.size("bag").cast("long").alias("n"))


@query(
    "select n_nationkey, count(s_suppkey) as n, min(s_suppkey) as first_key from nation left join supplier on s_nationkey = n_nationkey and s_acctbal > n_nationkey * 100 group by 1"
)
def bag_embed_condition(spark, sf_dir):
    n, s = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "supplier")
    condition = (F.col("s_nationkey") == F.col("n_nationkey")) & (F.col("s_acctbal") > F.col("n_nationkey") * 100)
    df = bags.embed_where(n, "n_nationkey", s, condition, {"key": F.col("s_suppkey")}, order=F.col("s_suppkey"))
    return df.select("n_nationkey", F.size("bag").cast("long").alias("n"), bags.first_of("bag", "key").alias("first_key"))


@query("select o_orderkey, case when o_totalprice > 200000 then 1 else 0 end::bigint as n, case when o_totalprice > 200000 then o_orderpriority end as note from orders")
def bag_synthetic(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").withColumn("bag", bags.synthetic(F.col("o_totalprice") > 200000, {"note": F.col("o_orderpriority")}))
    return df.select("o_orderkey", F.size("bag").cast("long").alias("n"), bags.first_of("bag", "note").alias("note"))


@query(
    "select c_custkey, count(distinct o_orderkey) as n_orders, count(l_orderkey) as n_lines from customer left join orders on o_custkey = c_custkey"
    " left join lineitem on l_orderkey = o_orderkey group by 1"
)
def bag_nested(spark, sf_dir):
    c, o, line = (_table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    inner = bags.embed(o, F.col("o_orderkey"), line, F.col("l_orderkey"), {"line": F.col("l_linenumber")}, order=F.col("l_linenumber"), bag="lines")
    outer = bags.embed(c, F.col("c_custkey"), inner, F.col("o_custkey"), {"key": F.col("o_orderkey"), "lines": F.col("lines")}, order=F.col("o_orderkey"))
    lines = F.aggregate("bag", F.lit(0).cast("long"), lambda a, x: a + F.size(x["lines"]))
    return outer.select("c_custkey", F.size("bag").cast("long").alias("n_orders"), lines.alias("n_lines"))


@query(
    "select c_custkey, o_orderkey, place - 1 as place, c_custkey || '-' || (place - 1) as item_oid from"
    " (select o_custkey as c_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as place from orders"
    " where o_custkey in (select c_custkey from customer)) where place <= 3"
)
def bag_expand_max(spark, sf_dir):
    rows = bags.expand(_embedded(spark, sf_dir), "bag", max_items=3, oid="c_custkey")
    return rows.select("c_custkey", F.col("item.key").alias("o_orderkey"), F.col("item_at").cast("long").alias("place"), "item_oid")


@query(
    "select c_custkey as source_oid, 'BAG_MAX_ITEMS_EXCEEDED' as reason_code, count(*) - 3 as n_lost from customer join orders on o_custkey = c_custkey group by 1 having count(*) > 3"
)
def bag_overflow(spark, sf_dir):
    return bags.overflow(_embedded(spark, sf_dir), "bag", 3, "c_custkey").withColumn("n_lost", F.col("n_lost").cast("long"))


# Identity and baskets


@query(f"select c_custkey, {_uuid_sql("'ns::r::tpch::null::tpch.Main.customer::' || c_custkey")} as oid from customer")
def oid_uuid_fallback(spark, sf_dir):
    c = _catalog(spark, sf_dir, "customer")
    f = lower(Rule("r", "out", "T", (Source("c", "tpch.Main.customer"),), {"c_custkey": "c.c_custkey"}), c, namespace="ns")
    return f.targets.select("c_custkey", F.col("_oid").alias("oid"))


@query("select c_custkey, cast(c_custkey as varchar) as oid from customer")
def oid_preserve(spark, sf_dir):
    c = _catalog(spark, sf_dir, "customer")
    f = lower(Rule("r", "out", "T", (Source("c", "tpch.Main.customer"),), {"c_custkey": "c.c_custkey"}), c, oid="preserve")
    return f.targets.select("c_custkey", F.col("_oid").alias("oid"))


@query("select o_orderkey, cast(row_number() over (order by o_totalprice, o_orderkey) as varchar) as oid from orders")
def oid_integer(spark, sf_dir):
    df = identity.numbered_oids(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])
    return df.select("o_orderkey", F.col("_oid").alias("oid"))


@query("select l_orderkey || '.' || l_linenumber as oid, count(*) as n from lineitem group by 1 having count(*) > 1")
def oid_duplicates(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select(F.concat_ws(".", "l_orderkey", "l_linenumber").alias("oid"))
    return identity.duplicate_oids(df, ("oid",))


@query(f"select n_nationkey, {_uuid_sql("'basket:' || n_regionkey")} as basket from nation")
def basket_by_topic(spark, sf_dir):
    b = identity.basket("byTopic", F.lit(None), F.col("n_regionkey").cast("string"))
    return _table(spark, sf_dir, "nation").select("n_nationkey", b.alias("basket"))


# References


def _order_refs(spark, sf_dir, **ref):
    c = _catalog(spark, sf_dir, "orders", "customer")
    clients = lower(Rule("clients", "out", "Client", (Source("c", "tpch.Main.customer", where="c.c_acctbal > 0"),), {"name": "c.c_name"}), c)
    sales = lower(Rule("sales", "out", "Sale", (Source("o", "tpch.Main.orders"),), {"k": "o.o_orderkey"}, refs=(Ref("client", "o.o_custkey", **ref),)), c)
    return clients, sales


@query(
    "select case when c_acctbal > 0 then 'RESOLVED' else 'UNRESOLVED' end as outcome, count(*) as n from orders left join customer on o_custkey = c_custkey group by 1"
)
def ref_resolve(spark, sf_dir):
    clients, sales = _order_refs(spark, sf_dir, target_rule="clients")
    return references.report(references.resolve(sales.refs, clients.id_map)).groupBy("outcome").agg(F.sum("n").alias("n"))


@query("select o_orderkey from orders left join customer on o_custkey = c_custkey where not coalesce(c_acctbal > 0, false)")
def ref_missing_mandatory(spark, sf_dir):
    clients, sales = _order_refs(spark, sf_dir, target_rule="clients", required=True)
    missing = references.resolve(sales.refs, clients.id_map).where("outcome = 'MISSING_MANDATORY'").select("owner_oid")
    return sales.targets.join(missing, F.col("_oid") == F.col("owner_oid"), "left_semi").select(F.col("k").alias("o_orderkey"))


@query("select o_orderkey from orders join customer on o_custkey = c_custkey where c_acctbal > 0")
def ref_ambiguous(spark, sf_dir):
    clients, sales = _order_refs(spark, sf_dir)
    twice = clients.id_map.unionByName(clients.id_map.withColumn("target_oid", F.concat(F.lit("x"), "target_oid")))
    found = references.resolve(sales.refs, twice).where("outcome = 'AMBIGUOUS'").select("owner_oid")
    return sales.targets.join(found, F.col("_oid") == F.col("owner_oid"), "left_semi").select(F.col("k").alias("o_orderkey"))


@query(
    "select c_custkey, least(count(o_orderkey), 2) as resolved, greatest(count(o_orderkey) - 2, 0) as beyond from customer join orders on o_custkey = c_custkey group by 1"
)
def ref_cardinality(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    refs = o.select(
        F.col("o_orderkey").cast("string").alias("ref_id"), F.lit("Client").alias("owner_class"), F.col("o_custkey").cast("string").alias("owner_oid"),
        F.lit("sale").alias("role"), F.lit(None).cast("string").alias("src_input"), F.lit(None).cast("string").alias("src_basket"), F.lit(None).cast("string").alias("src_class"),
        F.col("o_orderkey").cast("string").alias("src_oid"), F.lit(None).cast("string").alias("target_rule"), F.lit(None).cast("string").alias("expected_class"),
        F.lit(2).alias("card_max"), F.lit(False).alias("required"), F.col("o_orderkey").alias("ord"),
    )
    c = _catalog(spark, sf_dir, "orders")
    sales = lower(Rule("sales", "out", "Sale", (Source("o", "tpch.Main.orders"),), {}), c)
    found = references.resolve(refs, sales.id_map)
    return found.groupBy(F.col("owner_oid").cast("bigint").alias("c_custkey")).agg(
        F.count_if(F.col("outcome") == "RESOLVED").alias("resolved"), F.count_if(F.col("outcome") == "CARDINALITY").alias("beyond")
    )


@query("select r_regionkey, 'RESOLVED' as outcome, 1::bigint as n from region union all select r_regionkey + 100, 'AMBIGUOUS', (select count(*) from region) from region")
def ref_singleton(spark, sf_dir):
    c = _catalog(spark, sf_dir, "region")
    source = lambda where: (Source("r", "tpch.Main.region", where=where),)
    one = lower(Rule("one", "out", "World", source("r.r_regionkey = 0"), {}), c)
    many = lower(Rule("many", "out", "Area", source(None), {}), c)
    parts = []
    for shift, rule in ((0, "one"), (100, "many")):
        f = lower(Rule(f"x{shift}", "out", "X", source(None), {"k": f"r.r_regionkey + {shift}"}, refs=(Ref("only", None, rule, singleton=True),)), c)
        found = references.resolve_singletons(f.refs, one.id_map.unionByName(many.id_map))
        parts.append(f.targets.join(found, F.col("_oid") == F.col("owner_oid")).select(F.col("k").alias("r_regionkey"), "outcome", "n"))
    return parts[0].union(parts[1])


# Transfers


@query(
    "select 'tpch.Main.customer' as cls, count(*) as n_objects from customer union all select 'tpch.Main.orders', count(*) from orders"
    " union all select 'tpch.Main.nation', count(*) from nation"
)
def inventory_class_counts(spark, sf_dir):
    return transfer.inventory(_catalog(spark, sf_dir, "customer", "orders", "nation")).select("cls", "n_objects")


@query("select 'tpch.Main.orders' as cls, 'o_custkey' as attribute, count(o_custkey) as n_set, count(distinct o_custkey) as n_distinct from orders")
def inventory_references(spark, sf_dir):
    return transfer.inventory_references(_catalog(spark, sf_dir, "orders"), {"tpch.Main.orders": ["o_custkey"]})


@query(
    "select 'sales' as rule, count(*) as visited, count(*) filter (o_orderstatus = 'F') as matches, count(*) filter (o_orderstatus = 'F' and o_totalprice <= 100000) as filtered,"
    " count(*) filter (o_orderstatus = 'F' and o_totalprice > 100000) as created from orders"
)
def rule_metrics(spark, sf_dir):
    c = _catalog(spark, sf_dir, "orders")
    return metrics([lower(Rule("sales", "out", "Sale", (Source("o", "tpch.Main.orders", where="o.o_orderstatus = 'F'"),), {}, where="o.o_totalprice > 100000"), c)])


@query(
    "with e as (select 'n' || n_nationkey as src, 'r' || n_regionkey as dst from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer"
    " union all select 'o' || o_orderkey, 'c' || o_custkey from orders), b as (select src, dst from e union select dst, src from e),"
    " l1 as (select dst as node from b where src = 'r0'), l2 as (select distinct dst as node from b where src in (select node from l1))"
    " select 'r0' as node, 0 as depth union all select distinct node, 1 from l1 union all"
    " select node, 2 from l2 where node <> 'r0' and node not in (select node from l1)"
)
def graph_subgraph(spark, sf_dir):
    n, c, o = (_table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    edge = lambda df, a, k, b, t: df.select(F.concat(F.lit(a), k).alias("src"), F.concat(F.lit(b), t).alias("dst"))
    edges = edge(n, "n", "n_nationkey", "r", "n_regionkey").union(edge(c, "c", "c_custkey", "n", "c_nationkey")).union(edge(o, "o", "o_orderkey", "c", "o_custkey"))
    return transfer.subgraph(edges, spark.createDataFrame([("r0",)], "node string"), max_depth=2)


@query(
    "select 'DIFFERENT' as kind, 'balance' as attribute, count(*) as n from customer where c_custkey % 10 = 3 union all"
    " select 'MISSING', null, count(*) from customer where c_custkey % 10 = 4 union all select 'UNEXPECTED', null, count(*) from customer where c_custkey % 10 = 5"
)
def compare_diff(spark, sf_dir):
    k = F.col("c_custkey") % 10
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_acctbal").alias("balance"))
    # Within tolerance at 2, beyond at 3.
    other = c.withColumn("balance", F.col("balance") + F.when(k == 3, 1.0).when(k == 2, 0.0001).otherwise(0.0)).where(k != 4)
    other = other.withColumn("c_custkey", F.when(k == 5, F.col("c_custkey") + 10_000_000).otherwise(F.col("c_custkey")))
    return transfer.compare_summary(c.where(k != 5), other, transfer.Comparison(("c_custkey",), numeric=("balance",)))


@query(
    "select o_orderkey, case when o_totalprice < 1000 or o_totalprice > 300000 then 'RANGE' end as code from orders where o_totalprice < 1000 or o_totalprice > 300000 union all"
    " select o_orderkey, 'VALUE' from orders where o_orderstatus not in ('F', 'O')"
)
def constraint_violations(spark, sf_dir):
    limits = [transfer.Constraint("o_totalprice", low=1000, high=300000), transfer.Constraint("o_orderstatus", mandatory=True, max_length=3, values=("F", "O"))]
    return transfer.violations(_table(spark, sf_dir, "orders"), limits, "o_orderkey").select(F.col("oid").alias("o_orderkey"), "code")


# Jobs: rules from their plain form, with calls, lookups and bags


def _job_rule(spark, sf_dir, rule: dict, *names: str, enums=None, catalog=None, **strategies):
    plain = {"id": "r", "target": {"output": "out", "class": "tpch.Main.T"}, **rule}
    return lower(rule_of(plain), catalog or _catalog(spark, sf_dir, *names), enums=enums or {}, **strategies)


_O = [{"alias": "o", "class": "tpch.Main.orders"}]
_C = [{"alias": "c", "class": "tpch.Main.customer"}]


@query("select c_custkey, c_name as name, c_acctbal as balance from customer")
def prj_assign_copy(spark, sf_dir):
    assign = {"c_custkey": "c.c_custkey", "name": "c.c_name", "balance": "c.c_acctbal"}
    return _job_rule(spark, sf_dir, {"sources": _C, "assign": assign}, "customer").targets.select(*assign)


@query("select c_custkey, case when c_acctbal > 0 then c_name end as name, 'CHF' as currency, 1 as version from customer")
def prj_defaults(spark, sf_dir):
    """A null assignment doesn't fall through to the default."""
    rule = {"sources": _C, "assign": {"c_custkey": "c.c_custkey", "name": "if(c.c_acctbal > 0, c.c_name, null)"}, "defaults": {"name": "'none'", "currency": "'CHF'"}}
    f = _job_rule(spark, sf_dir, rule, "customer", defaults={"currency": "'EUR'", "version": "1"})
    return f.targets.select("c_custkey", "name", "currency", "version")


@query(
    "select o_orderkey, case o_orderstatus when 'F' then 'finished' when 'O' then 'open' end as status, case o_orderstatus when 'F' then 'finished' when 'O' then 'open' else 'other' end as status_or,"
    " case when o_totalprice > 200000 then 'big' when o_orderpriority like '1%' then 'urgent' else o_orderstatus || '!' end as kind, substr(o_orderpriority, 1, 3) as short,"
    " o_totalprice <= 200000 as small, true as lte_null, false as lt_null, o_orderstatus = 'F' and o_totalprice > 200000 as both_true, not (o_orderstatus = 'F') as negated,"
    " strftime(cast(o_orderdate as date), '%Y%m%d') as compact, cast(o_custkey as varchar) as ref, o_custkey = o_orderkey as same from orders"
)
def job_functions(spark, sf_dir):
    assign = {
        "o_orderkey": "o.o_orderkey",
        "status": {"enumMap": ["o.o_orderstatus", "states"]},
        "status_or": {"enumMapDefault": ["o.o_orderstatus", "states", "'other'"]},
        "kind": {"if": [{"gt": ["o.o_totalprice", 200000]}, "'big'", {"if": ["o.o_orderpriority like '1%'", "'urgent'", {"concat": ["o.o_orderstatus", "'!'", None]}]}]},
        "short": {"truncate": [{"enumName": ["o.o_orderpriority"]}, 3]},
        "small": {"lte": ["o.o_totalprice", 200000]},
        "lte_null": {"lte": ["o.o_totalprice", None]},
        "lt_null": {"lt": ["o.o_totalprice", None]},
        "both_true": {"and": [{"eq": ["o.o_orderstatus", "'F'"]}, "o.o_totalprice > 200000"]},
        "negated": {"not": [{"eq": ["o.o_orderstatus", "'F'"]}]},
        "compact": {"toInterlis1Date": ["cast(o.o_orderdate as date)"]},
        "ref": {"refOid": ["o.o_custkey"]},
        "same": {"refEquals": ["o.o_custkey", "o.o_orderkey"]},
    }
    return _job_rule(spark, sf_dir, {"sources": _O, "assign": assign}, "orders", enums={"states": STATUS}).targets.select(*assign)


@query("select 'ENUM_NO_MATCH' as code, o_orderstatus as key, count(*) as n from orders where o_orderstatus not in ('F', 'O') group by 2")
def job_enum_problems(spark, sf_dir):
    rule = {"sources": _O, "assign": {"status": {"enumMap": ["o.o_orderstatus", "states"]}}}
    f = _job_rule(spark, sf_dir, rule, "orders", enums={"states": STATUS})
    return f.diagnostics.groupBy("code", "key").agg(F.count("*").alias("n"))


@query("select event_id from events where event_type is not null and event_type <> '' and value is not null and value <> 0")
def flt_truthy_where(spark, sf_dir):
    rule = {"sources": [{"alias": "e", "class": "tpch.Main.events", "where": "e.event_type"}], "where": "e.value", "assign": {"event_id": "e.event_id"}}
    return _job_rule(spark, sf_dir, rule, "events").targets.select("event_id")


@query(
    "select c_custkey, arg_min(o_orderstatus, o_orderkey) as first_status, arg_min(o_totalprice, o_orderkey) as first_price, count(o_orderkey) > 0 as found,"
    " count(o_orderkey) filter (o_orderstatus = 'F') > 0 as closed from customer left join orders on o_custkey = c_custkey group by c_custkey"
)
def job_lookups(spark, sf_dir):
    look = lambda name, back: {name: ["tpch.Main.orders", "o_custkey", "c.c_custkey", back]}
    exists = lambda *more: {"existsIn": ["tpch", "tpch.Main.orders", "o_custkey", "c.c_custkey", *more]}
    assign = {
        "c_custkey": "c.c_custkey", "first_status": look("lookup", "o_orderstatus"), "first_price": look("lookupOptional", "o_totalprice"),
        "found": exists(), "closed": exists("o_orderstatus", "'F'"),
    }
    return _job_rule(spark, sf_dir, {"sources": _C, "assign": assign}, "customer", "orders").targets.select(*assign)


@query("select 'LOOKUP_NO_MATCH' as code, count(*) as n from customer where c_custkey * 3 not in (select o_custkey from orders)")
def lookup_optional(spark, sf_dir):
    """Only the plain lookup reports what it misses."""
    found = []
    for name in ("lookup", "lookupOptional"):
        f = _job_rule(spark, sf_dir, {"sources": _C, "assign": {"x": {name: ["tpch.Main.orders", "o_custkey", "c.c_custkey * 3", "o_custkey"]}}}, "customer", "orders")
        found.append(f.diagnostics)
    return found[0].union(found[1]).groupBy("code").agg(F.count("*").alias("n"))


@query("select n_nationkey, (select min(s_name) from supplier where s_nationkey = n_nationkey and s_suppkey = (select min(s_suppkey) from supplier where s_nationkey = n_nationkey)) as party from nation")
def lookup_scoped(spark, sf_dir):
    c = _catalog(spark, sf_dir, "nation")
    c.add(_table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "c_nationkey as nation", "c_name as name"), input_id="clients", cls="Party", oid="k", order="k")
    c.add(_table(spark, sf_dir, "supplier").selectExpr("s_suppkey as k", "s_nationkey as nation", "s_name as name"), input_id="suppliers", cls="Party", oid="k", order="k")
    assign = {"n_nationkey": "n.n_nationkey", "party": {"lookupIn": ["suppliers", "Party", "nation", "n.n_nationkey", "name"]}}
    return _job_rule(spark, sf_dir, {"sources": [{"alias": "n", "class": "tpch.Main.nation"}], "assign": assign}, catalog=c).targets.select(*assign)


@query(
    "select c_custkey, exists(select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F' and o_orderpriority = '1-URGENT') as urgent"
    " from customer where exists(select 1 from orders where o_custkey = c_custkey)"
)
def exists_in_multi(spark, sf_dir):
    exists = lambda *more: {"existsIn": ["tpch", "tpch.Main.orders", "o_custkey", "c.c_custkey", *more]}
    assign = {"c_custkey": "c.c_custkey", "urgent": exists("o_orderstatus", "'F'", "o_orderpriority", "'1-URGENT'")}
    return _job_rule(spark, sf_dir, {"sources": _C, "assign": assign, "where": exists()}, "customer", "orders").targets.select(*assign)


_ORDER_BAG = {"from": {"class": "tpch.Main.orders", "alias": "o", "where": "o.o_orderstatus = 'F'"}, "assign": {"key": "o.o_orderkey", "price": "o.o_totalprice"}}


@query(
    "with o as (select * from orders where o_orderstatus = 'F'), l as (select l_orderkey, count(*) as n, min(l_linenumber) as low from lineitem group by 1)"
    " select c_custkey, count(o_orderkey) as n_orders, min(o_orderkey) as first_key, arg_min(o_totalprice, o_orderkey) as first_price, coalesce(sum(l.n), 0)::bigint as n_lines"
    " from customer left join o on o_custkey = c_custkey left join l on l_orderkey = o_orderkey group by 1"
)
def job_bags(spark, sf_dir):
    """A bag of orders, each with a bag of its lines."""
    c = _catalog(spark, sf_dir, "customer", "orders")
    line = F.expr("concat_ws('.', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate)")
    lines = _table(spark, sf_dir, "lineitem").withColumn("place", F.monotonically_increasing_id())
    c.add(lines, input_id="tpch", cls="tpch.Main.lineitem", oid=F.concat_ws(".", line, "place"), order="l_linenumber")
    inner = {"lines": {"from": {"class": "tpch.Main.lineitem", "alias": "l"}, "parentRef": {"attribute": "l_orderkey"}, "assign": {"line": "l.l_linenumber"}}}
    bag = {**_ORDER_BAG, "parentRef": {"attribute": "o_custkey"}, "nestedBags": inner}
    f = _job_rule(spark, sf_dir, {"sources": _C, "assign": {"c_custkey": "c.c_custkey"}, "bags": {"orders": bag}}, catalog=c)
    n_lines = F.aggregate("orders", F.lit(0).cast("long"), lambda a, x: a + F.size(x["lines"]))
    return f.targets.select(
        "c_custkey", F.size("orders").cast("long").alias("n_orders"), bags.first_of("orders", "key").alias("first_key"), bags.first_of("orders", "price").alias("first_price"), n_lines.alias("n_lines")
    )


@query(
    "select c_custkey, count(o_orderkey) as n, case when max(c_acctbal) > 0 then 1 else 0 end::bigint as noted from customer left join orders"
    " on o_custkey = c_custkey and o_orderstatus = 'F' and o_totalprice > c_acctbal * 10 group by 1"
)
def job_bag_condition(spark, sf_dir):
    """The reference to the parent stands in the condition, which names the parent too; and a bag made from the parent."""
    where = {"and": [{"refEquals": ["o.o_custkey", "c"]}, {"gt": ["o.o_totalprice", "c.c_acctbal * 10"]}]}
    note = {"assign": {"balance": "c.c_acctbal"}, "where": "c.c_acctbal > 0"}
    f = _job_rule(spark, sf_dir, {"sources": _C, "assign": {"c_custkey": "c.c_custkey"}, "bags": {"orders": {**_ORDER_BAG, "where": where}, "notes": note}}, "customer", "orders")
    return f.targets.select("c_custkey", F.size("orders").cast("long").alias("n"), F.size("notes").cast("long").alias("noted"))


@query(
    "select c_custkey, place - 1 as place, o_orderkey, k.n as total from (select o_custkey as c_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as place"
    " from orders) join (select o_custkey, count(*) as n from orders group by 1) k on k.o_custkey = c_custkey where place <= 3 and c_custkey in (select c_custkey from customer)"
)
def job_bag_expand(spark, sf_dir):
    """Every structure of a bag becomes an object that refers to its parent; the rest is reported as lost."""
    nested = _embedded(spark, sf_dir).withColumnRenamed("bag", "orders")
    c = Catalog().add(nested, input_id="tpch", cls="Client", oid="c_custkey")
    bag = {"mode": "expand", "items": "orders", "alias": "x", "target": "Order", "maxItems": 3, "parentRef": {"role": "client"}, "assign": {"o_orderkey": "x.key"}}
    f = _job_rule(spark, sf_dir, {"sources": [{"alias": "c", "class": "Client"}], "assign": {"c_custkey": "c.c_custkey"}, "bags": {"orders": bag}}, catalog=c)
    place = F.regexp_extract("_oid", "-([0-9]+)$", 1).cast("long")
    rows = f.expanded[0][1].select("client", place.alias("place"), "o_orderkey").join(f.targets.select(F.col("_oid").alias("client"), "c_custkey"), "client")
    lost = f.losses.select(F.col("source_oid").cast("long").alias("l_key"), (F.split("description", " ")[0].cast("long") + 3).alias("beyond"))
    sizes = nested.select(F.col("c_custkey").alias("s_key"), F.size("orders").cast("long").alias("n"))
    rows = rows.join(sizes, F.col("c_custkey") == F.col("s_key")).join(lost, F.col("c_custkey") == F.col("l_key"), "left")
    return rows.select("c_custkey", "place", "o_orderkey", F.coalesce("beyond", "n").alias("total"))


@query("select c_custkey, arg_min(o_orderpriority, o_orderkey) as first_priority from customer left join orders on o_custkey = c_custkey group by 1")
def bag_first(spark, sf_dir):
    c, o = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    nested = bags.embed(c, F.col("c_custkey"), o, F.col("o_custkey"), {"priority": F.col("o_orderpriority")}, order=F.col("o_orderkey"), bag="orders")
    catalog = Catalog().add(nested, input_id="tpch", cls="Client", oid="c_custkey")
    assign = {"c_custkey": "c.c_custkey", "first_priority": {"bagFirst": ["c", "orders", "priority"]}}
    return _job_rule(spark, sf_dir, {"sources": [{"alias": "c", "class": "Client"}], "assign": assign}, catalog=catalog).targets.select(*assign)


@query("select cast(o_custkey as varchar) as parent, o_orderkey as key from orders join customer on o_custkey = c_custkey")
def bag_structures_as_records(spark, sf_dir):
    c = Catalog().add(_embedded(spark, sf_dir), input_id="tpch", cls="Client", oid="c_custkey").add_structures("Client", "bag")
    return c.records("Client.bag").select(F.col("_parent_oid").alias("parent"), "key")


# Numbers at their limits


@query(
    "select s_suppkey, cast((cast(s_suppkey as hugeint) * 7 * 20000000000 + 13) // 26 as bigint) as unscaled, s_suppkey as back, cast((123456789012345 + s_suppkey) * 10::hugeint as varchar) as large,"
    " cast(s_suppkey * 10000000::bigint as varchar) as by_small, case when s_suppkey % 10 = 0 then (s_suppkey // 10)::varchar else (s_suppkey // 10) || '.' || (s_suppkey % 10) end as tenth,"
    " '0.0001' as tiny, '12345678901234567890' as beyond_long, cast(12345678901 + s_suppkey as varchar) as long_ratio from supplier"
)
def num_limits(spark, sf_dir):
    k, dec = F.col("s_suppkey"), lambda x: F.lit(x).cast("decimal(38,10)")
    text = W.number_text
    return _table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.replace(W.div(k * 7, F.lit(13)).cast("string"), F.lit("."), F.lit("")).cast("long").alias("unscaled"),
        W.mul(W.mul(k, dec("0.000001")), F.lit(1000000)).cast("long").alias("back"),
        text(W.mul(F.lit(123456789012345) + k, F.lit(10))).alias("large"),
        text(W.div(k, dec("0.0000001"))).alias("by_small"),
        text(W.div(k, F.lit(10))).alias("tenth"),
        text(dec("0.0001")).alias("tiny"),
        text(dec("12345678901234567890")).alias("beyond_long"),
        text(W.div((F.lit(12345678901) + k).cast("decimal(38,0)") * 10, F.lit(10))).alias("long_ratio"),
    )


@query(
    "select s_suppkey, (((2 * s_suppkey + 1) * 300000000001::hugeint + 10) // 20)::bigint as product, (((2 * s_suppkey + 2469135780000001) * 300000000001::hugeint + 10) // 20)::varchar as large,"
    " ((s_suppkey * 2 * 1000000000000000000000::hugeint // 300000000001 + 1) // 2)::bigint as ratio from supplier"
)
def num_finer(spark, sf_dir):
    """Factors and divisors with more than ten decimals count with all their digits."""
    k, fine = F.col("s_suppkey"), F.lit(3.00000000001)
    unscaled = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(""))
    half = (k.cast("double") + 0.5, k.cast("double") + 1234567890000000.5)
    return _table(spark, sf_dir, "supplier").select(
        "s_suppkey", unscaled(W.mul(half[0], fine)).cast("long").alias("product"), unscaled(W.mul(fine, half[1])).alias("large"), unscaled(W.div(k, fine)).cast("long").alias("ratio")
    )


# Baskets, references, order


@query("select n_nationkey, cast(n_regionkey as varchar) as basket from nation")
def basket_preserve(spark, sf_dir):
    c = Catalog().add(_table(spark, sf_dir, "nation"), input_id="tpch", cls="tpch.Main.nation", oid="n_nationkey", basket_id="n_regionkey")
    f = _job_rule(spark, sf_dir, {"sources": [{"alias": "n", "class": "tpch.Main.nation"}], "assign": {"n_nationkey": "n.n_nationkey"}}, catalog=c)
    return f.targets.select("n_nationkey", F.col("_basket").alias("basket"))


@query("select o_orderkey from orders left join customer on o_custkey = c_custkey where not coalesce(c_acctbal > 0, false)")
def ref_unresolved(spark, sf_dir):
    clients, sales = _order_refs(spark, sf_dir, target_rule="clients")
    missing = references.resolve(sales.refs, clients.id_map).where("outcome = 'UNRESOLVED'").select("owner_oid")
    return sales.targets.join(missing, F.col("_oid") == F.col("owner_oid"), "left_semi").select(F.col("k").alias("o_orderkey"))


@query(
    "select 'Shop' as cls, s_suppkey as key, cast(s_nationkey as varchar) as place from supplier union all select 'Client', c_custkey, cast(c_nationkey + 100 as varchar) from customer"
)
def ref_attach_by_class(spark, sf_dir):
    """Two classes that share identifiers keep their own references."""
    c = _catalog(spark, sf_dir, "customer", "supplier", "nation")
    n = lower(Rule("n", "out", "Nation", (Source("n", "tpch.Main.nation"),), {}), c, oid="preserve")
    c.add(_table(spark, sf_dir, "nation").selectExpr("n_nationkey + 100 as k"), input_id="more", cls="More", oid="k")
    more = lower(Rule("m", "out", "Nation", (Source("m", "More"),), {}), c, oid="preserve")
    shop = lower(Rule("s", "out", "Shop", (Source("s", "tpch.Main.supplier"),), {"key": "s.s_suppkey"}, refs=(Ref("place", "s.s_nationkey", "n"),)), c, oid="preserve")
    client = lower(Rule("c", "out", "Client", (Source("c", "tpch.Main.customer"),), {"key": "c.c_custkey"}, refs=(Ref("place", "c.c_nationkey + 100", "m"),)), c, oid="preserve")
    resolved = references.resolve(shop.refs.unionByName(client.refs), n.id_map.unionByName(more.id_map))
    rows = shop.targets.unionByName(client.targets)
    return references.attach(rows, resolved, {"place": 1}).select(F.col("_class").alias("cls"), "key", "place")


def _sales_job(sf_dir: str, folder: str, **strategy) -> dict:
    return {
        "job": {
            "name": "sales",
            "inputs": [
                {"id": "c", "class": "Customer", "path": f"{sf_dir}/customer.parquet", "oid": "c_custkey"},
                {"id": "o", "class": "Order", "path": f"{sf_dir}/orders.parquet", "oid": "o_orderkey"},
            ],
            "outputs": [{"id": "out", "path": folder}],
        },
        "mapping": {
            "oidStrategy": strategy or {"default": "deterministicUuid", "namespace": "ns"},
            "rules": [
                {"id": "clients", "target": {"output": "out", "class": "Client"}, "sources": [{"alias": "c", "class": "Customer"}], "assign": {"name": "c.c_name"}},
                {
                    "id": "sales", "target": {"output": "out", "class": "Sale"}, "sources": [{"alias": "o", "class": "Order"}], "assign": {"k": "o.o_orderkey"}, "where": "o.o_totalprice > 50000",
                    "refs": [{"role": "client", "sourceRef": "o.o_custkey", "targetRule": "clients"}, {"role": "clients", "sourceRef": "o.o_custkey", "targetRule": "clients", "max": 5}],
                    "create": [{"class": "Note", "assign": {"k": "o.o_orderkey"}}],
                },
            ],
        },
    }


@query(
    "with n as (select c_custkey, row_number() over (order by cast(c_custkey as varchar)) as number from customer), s as (select *, row_number() over (order by cast(o_orderkey as varchar)) as r"
    " from orders where o_totalprice > 50000) select 'Sale' as cls, o_orderkey as k, cast((select count(*) from customer) + r as varchar) as oid, cast(number as varchar) as client,"
    " case when number is null then 0 else 1 end::bigint as n_clients, cast(number as varchar) as first_of_several from s left join n on o_custkey = c_custkey union all"
    " select 'Note', o_orderkey, cast((select count(*) from customer) + (select count(*) from s) + row_number() over (order by cast(o_orderkey as varchar)) as varchar), null, null, null from orders"
)
def job_integer_oids(spark, sf_dir):
    """Numbers over targets and created objects, and in roles of one and of several targets."""
    folder = shared_folder(spark, "job-integer")
    runner.run(spark, job_of(_sales_job(sf_dir, folder, default="integer")))
    sale, note = (spark.read.parquet(f"{folder}/{c}") for c in ("Sale", "Note"))
    sale = sale.select(
        F.lit("Sale").alias("cls"), "k", F.col("_oid").alias("oid"), "client", F.coalesce(F.size("clients"), F.lit(0)).cast("long").alias("n_clients"),
        F.try_element_at("clients", F.lit(1)).alias("first_of_several"),
    )
    return sale.unionByName(note.select(F.lit("Note").alias("cls"), "k", F.col("_oid").alias("oid")), allowMissingColumns=True)


@query(
    "select 'clients' as rule, count(*) as visited, 0::bigint as filtered, count(*) as created from customer union all"
    " select 'sales', count(*), count(*) filter (o_totalprice <= 50000), count(*) filter (o_totalprice > 50000) from orders"
)
def bundle_summary(spark, sf_dir):
    plain = _sales_job(sf_dir, shared_folder(spark, "bundle"))
    base = {"job": plain["job"], "mapping": {"oidStrategy": plain["mapping"]["oidStrategy"]}}
    found = bundle.run_bundle(spark, {"base": base}, {"m": plain}, commit=False)["summary"]["rules"]
    return spark.createDataFrame([(k.removeprefix("m."), v["visited"], v["filtered"], v["created"]) for k, v in found.items()], "rule string, visited bigint, filtered bigint, created bigint")


@query(
    "select o_orderkey, row_number() over (order by o_orderstatus, case when o_custkey % 2 = 0 then 1 else 0 end, 'Sale', cast(o_orderkey as varchar)) as place from orders"
)
def sort_output(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("_basket"), F.lit("Sale").alias("_class"), F.col("o_orderkey").cast("string").alias("_oid"),
        F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("client"),
    )
    return transfer.output_places(o, ["client"]).select("o_orderkey", "place")


# Whole transfers


@query("select o_orderstatus as value, count(*) as n from orders group by 1")
def inventory_values(spark, sf_dir):
    return transfer.inventory_values(_catalog(spark, sf_dir, "orders"), {"tpch.Main.orders": ["o_orderstatus"]}).select("value", "n")


@query("select case when s_suppkey % 2 = 0 then 'COORD' else 'SURFACE' end as kind, count(*) as n from supplier group by 1")
def inventory_geometries(spark, sf_dir):
    shape = F.expr("if(s_suppkey % 2 = 0, concat('POINT (', s_suppkey, ' 1)'), 'POLYGON ((0 0, 1 0, 1 1, 0 0))')")
    c = Catalog().add(_table(spark, sf_dir, "supplier").withColumn("shape", shape), input_id="tpch", cls="Shop", oid="s_suppkey")
    return transfer.inventory_geometries(c, {"Shop": ["shape"]}).select("kind", "n")


@query("select 'r_regionkey' as attribute, 'int' as type union all select 'r_name', 'string' union all select 'n_nationkey', 'int' union all select 'n_name', 'string' union all select 'n_regionkey', 'int'")
def model_inventory(spark, sf_dir):
    return transfer.model_inventory(_catalog(spark, sf_dir, "region", "nation")).select("attribute", "type")


_REFS = {"tpch.Main.nation": ["n_regionkey"], "tpch.Main.customer": ["c_nationkey"], "tpch.Main.orders": ["o_custkey"]}


@query(
    "select c_custkey as k, 'n' as hit from customer where c_nationkey in (select n_nationkey from nation) union all select c_custkey, 'c' from customer where c_nationkey in (select c_custkey from customer)"
    " union all select c_custkey, 'r' from customer where c_nationkey in (select r_regionkey from region)"
)
def graph_edges(spark, sf_dir):
    """An identifier that several classes have is referred to in each of them."""
    edges = transfer.reference_edges(_catalog(spark, sf_dir, "region", "nation", "customer"), {"tpch.Main.customer": ["c_nationkey"]})
    hit = F.when(F.col("dst").contains(".nation#"), "n").when(F.col("dst").contains(".customer#"), "c").otherwise("r")
    return edges.select(F.element_at(F.split("src", "#"), 2).cast("long").alias("k"), hit.alias("hit"))


@query(
    "with e as (select 'n' || n_nationkey as src, 'r' || n_regionkey as dst from nation union all select 's' || s_suppkey, 'n' || s_nationkey from supplier),"
    " b as (select src, dst from e union select dst, src from e), l0 as (select 'r' || r_regionkey as node from region),"
    " l1 as (select distinct dst as node from b where src in (select node from l0) and dst not in (select node from l0)),"
    " l2 as (select distinct dst as node from b where src in (select node from l1) and dst not in (select node from l0 union select node from l1))"
    " select node, 0 as depth from l0 union all select node, 1 from l1 union all select node, 2 from l2"
)
def graph_extract(spark, sf_dir):
    """Seeds by class; the records of the part and how far they lie from a seed."""
    c = Catalog()
    for t, k, ref in (("region", "r", None), ("nation", "n", ("n_regionkey", "r")), ("supplier", "s", ("s_nationkey", "n"))):
        df = _table(spark, sf_dir, t)
        df = df.withColumn("id", F.concat(F.lit(k), KEYS[t])).withColumn("ref", F.concat(F.lit(ref[1]), ref[0]) if ref else F.lit(None).cast("string"))
        c.add(df, input_id="tpch", cls=f"tpch.Main.{t}", oid="id")
    references_ = {"tpch.Main.nation": ["ref"], "tpch.Main.supplier": ["ref"]}
    parts, reached = transfer.extract(c, references_, transfer.seeds_of(c, "region", "suffix"), max_depth=2)
    rows = None
    for (cls, _), df in parts.items():
        one = df.select(transfer.node_of("_class", "_oid").alias("node"), F.col("_oid").alias("oid"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.join(reached, "node").select(F.col("oid").alias("node"), "depth")


# Formats: what is written and read back


@query("select n_nationkey as key, n_name as name, case when n_regionkey = 0 then null else n_regionkey end as region from nation")
def format_csv(spark, sf_dir):
    path = shared_folder(spark, "format-csv")
    rows = _table(spark, sf_dir, "nation").selectExpr("n_nationkey as key", "n_name as name", "if(n_regionkey = 0, null, n_regionkey) as region")
    rows.write.option("header", True).option("sep", ";").csv(path)
    return formats.read_input(spark, path, {"separator": "semicolon", "schema": "key int, name string, region int"}, "csv")


@query(
    "select cast(c_custkey as varchar) as oid, c_name || ' <&>' as name, cast(c_nationkey as varchar) as basket, count(o_orderkey) as n, min(o_orderkey) as first_key, 'x' || c_nationkey as nation"
    " from customer left join orders on o_custkey = c_custkey group by c_custkey, c_name, c_nationkey"
)
def format_xtf(spark, sf_dir):
    """Objects with a bag and a role."""
    path = shared_folder(spark, "format-xtf")
    rows = _embedded(spark, sf_dir).select(
        F.col("c_custkey").cast("string").alias("_oid"), F.col("c_nationkey").cast("string").alias("_basket"), F.concat("c_name", F.lit(" <&>")).alias("name"),
        F.transform("bag", lambda x: F.struct(x["key"].alias("key"))).alias("orders"), F.concat(F.lit("x"), "c_nationkey").alias("nation"),
    )
    formats.write_output(rows, path, {"class": "Client", "roles": ["nation"], "structures": {"orders": "OrderKey"}}, "xtf")
    schema = "name string, orders struct<OrderKey:array<struct<key:bigint>>>, nation struct<_a_ref:string>"
    read = formats.read_input(spark, path, {"class": "Client", "basketTag": "basket", "schema": schema}, "xtf")
    n = F.coalesce(F.size("orders"), F.lit(0)).cast("long")
    return read.select(F.col("_oid").alias("oid"), "name", F.col("_basket").alias("basket"), F.greatest(n, F.lit(0)).alias("n"), F.try_element_at("orders", F.lit(1))["key"].alias("first_key"), "nation")


@query("select cast(s_suppkey as varchar) as oid, s_name as name, case when s_suppkey % 2 = 0 then 'a b' end as note, 'POINT (' || s_suppkey || ' 7)' as geometry from supplier")
def format_itf(spark, sf_dir):
    path = shared_folder(spark, "format-itf")
    rows = _table(spark, sf_dir, "supplier").selectExpr(
        "cast(s_suppkey as string) as _oid", "cast(null as string) as _basket", "s_name as name", "if(s_suppkey % 2 = 0, 'a b', null) as note", "concat('POINT (', s_suppkey, ' 7)') as geometry"
    )
    formats.write_output(rows, path, {"class": "M.T.Shop"}, "itf")
    return formats.read_input(spark, path, {"table": "Shop", "fields": "name,note"}, "itf").select(F.col("_oid").alias("oid"), "name", "note", "geometry")


@query("select s_suppkey, 'POINT (' || (s_suppkey + 1) || ' 0.5)' as shape from supplier")
def geometry_wkb(spark, sf_dir):
    """WKB points, made of the bits of their coordinates."""
    number = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    bits = _double_bits(F.col("s_suppkey") + 1)
    df = _table(spark, sf_dir, "supplier").withColumn("big", F.concat(F.unhex(F.lit("0000000001")), number(bits), F.unhex(F.lit("3FE0000000000000"))))
    return df.select("s_suppkey", wkb_text("big").alias("shape"))


def _double_bits(k):
    """The bits of a positive whole number as a double."""
    exponent = F.floor(F.log2(k.cast("double")) + 1e-12).cast("int")
    return F.expr("1023L * 4503599627370496L") + exponent.cast("long") * 4503599627370496 + ((k.cast("double") / F.pow(F.lit(2.0), exponent) - 1) * 4503599627370496).cast("long")
