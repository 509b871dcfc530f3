"""Registered queries of the table engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tessera as t
from tessera.functions.post import apply_conditional_format, apply_row_masks, collapse_row_labels, str_extract_num, str_indent_wrap

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
N_PCT = t.f_str("xx (xx.x%)", "n", "pct")


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        _queries[fn.__name__] = fn
        if sql is not None:
            _sql[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# ------------------------------------------------------------------ SQL of formats


def rnd(x: str, d: int) -> str:
    """R's rounding in SQL: the nearer candidate, ties to the even one."""
    s = f"cast(1{'0' * d} as double)"
    low, high = f"(floor(({x})*{s})/{s})", f"(ceil(({x})*{s})/{s})"
    return f"(case when {low}={high} then {low} when ({high}-({x}))<(({x})-{low}) or (({high}-({x}))=(({x})-{low}) and cast(floor(({x})*{s}) as bigint)%2<>0) then {high} else {low} end)"


def pad(x: str, w: int) -> str:
    return f"(repeat(' ', greatest({w}-length({x}),0)) || {x})"


def num(x: str, w: int, d: int) -> str:
    shown = f"printf('%.{d}f', {rnd(x, d)} + 0.0)"
    return f"(case when ({x}) is null then repeat(' ', {w}) else {pad(shown, w)} end)"


def n_pct(n: str, total: str) -> str:
    p = f"(cast({n} as double)/{total}*100)"
    return f"({num(f'cast({n} as double)', 2, 0)} || ' (' || {num(p, 4, 1)} || '%)')"


def wide(cells: str, levels: list[str], keys: str = "rowlabel1") -> str:
    """Pivot rows (keys, arm, cell) by named arms."""
    columns = ", ".join(f"max(case when arm='{x}' then cell end) as res{k}" for k, x in enumerate(levels, 1))
    return f"select {keys}, {columns} from ({cells}) group by {keys}"


STATUS = ["F", "O", "P"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet")


def lineitem(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet")


def customer(spark: SparkSession, d: str) -> DataFrame:
    """Customers with nation and region."""
    c, n, r = (spark.read.parquet(f"{d}/{x}.parquet") for x in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)


CUSTOMER = "(select * from customer join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey)"


def sales(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the segment of their customer."""
    return orders(spark, d).join(spark.read.parquet(f"{d}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))


SALES = "(select * from orders join customer on o_custkey=c_custkey)"


def count_of(spec_cols, target, **settings) -> t.TableSpec:
    return t.table_spec(spec_cols, layers=[t.group_count(target, settings=t.layer_settings(**settings))])


def shown(result: t.BuildResult, *columns: str) -> DataFrame:
    names = columns or [c for c in result.table.columns if c.startswith(("rowlabel", "res"))]
    return result.table.select(*names)


def raw(result: t.BuildResult, layer: int = 1) -> DataFrame:
    """Statistics with six decimals, so that both engines' last bits don't matter."""
    frame = result.numeric[layer]
    return frame.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k in ("bigint", "int") else F.col(c) for c, k in frame.dtypes])


# ------------------------------------------------------------------ count layers

_COUNT = "select o_orderpriority as rowlabel1, o_orderstatus as arm, {} as cell from (select o_orderpriority, o_orderstatus, count(*) as n from orders group by all) join (select o_orderstatus, count(*) as total from orders group by all) using (o_orderstatus)"


@query(wide(_COUNT.format(n_pct("n", "total")), STATUS))
def count_layer(spark, d):
    return shown(t.build(count_of("o_orderstatus", "o_orderpriority"), orders(spark, d)))


@query("select o_orderstatus, o_orderpriority, n, total, round(cast(n as double)/total*100, 6) as pct from (select o_orderstatus, o_orderpriority, count(*) as n from orders where o_totalprice > 200000 group by all) join (select o_orderstatus, count(*) as total from orders where o_totalprice > 200000 group by all) using (o_orderstatus)")
def count_where(spark, d):
    return raw(t.build(count_of("o_orderstatus", "o_orderpriority"), orders(spark, d), where="o_totalprice > 200000"))


@query("select c_mktsegment, o_orderpriority, o_orderstatus, n, total, round(cast(n as double)/total*100, 6) as pct from (select c_mktsegment, o_orderpriority, o_orderstatus, count(*) as n from " + SALES + " group by all) join (select c_mktsegment, count(*) as total from " + SALES + " group by all) using (c_mktsegment)")
def count_by(spark, d):
    spec = t.table_spec("c_mktsegment", layers=[t.group_count("o_orderstatus", by=["Orders", "o_orderpriority"])])
    return raw(t.build(spec, sales(spark, d)))


@query("select l_returnflag, l_linestatus, l_linenumber, coalesce(n,0) as n, total, round(coalesce(n,0)*100.0::double/total, 6) as pct from (select distinct l_returnflag from lineitem) cross join (select distinct l_linestatus from lineitem) cross join (select distinct cast(l_linenumber as varchar) as l_linenumber from lineitem) left join (select l_returnflag, l_linestatus, cast(l_linenumber as varchar) as l_linenumber, count(*) as n from lineitem group by all) using (l_returnflag, l_linestatus, l_linenumber) left join (select l_returnflag, l_linestatus, count(*) as total from lineitem group by all) using (l_returnflag, l_linestatus)")
def count_multi_cols(spark, d):
    return raw(t.build(count_of(["l_returnflag", "l_linestatus"], "l_linenumber"), lineitem(spark, d)))


@query("select o_orderstatus, o_orderpriority, n, distinct_n, total, distinct_total, round(n*100.0::double/total,6) as pct, round(distinct_n*100.0::double/distinct_total,6) as distinct_pct from (select o_orderstatus, o_orderpriority, count(*) as n, count(distinct o_custkey) as distinct_n from orders group by all) join (select o_orderstatus, count(*) as total, count(distinct o_custkey) as distinct_total from orders group by all) using (o_orderstatus)")
def count_distinct(spark, d):
    return raw(t.build(count_of("o_orderstatus", "o_orderpriority", distinct_by="o_custkey"), orders(spark, d)))


@query("select c_mktsegment, o_orderpriority, n, total, round(n*100.0::double/total,6) as pct from (select c_mktsegment, o_orderpriority, count(*) as n from " + SALES + " group by all) join (select c_mktsegment, count(*) as total from customer group by all) using (c_mktsegment)")
def count_pop_denominators(spark, d):
    spec = t.table_spec("arm", pop_data=t.pop_data({"arm": "c_mktsegment"}), layers=[t.group_count("o_orderpriority")])
    pop = spark.read.parquet(f"{d}/customer.parquet")
    return raw(t.build(spec, sales(spark, d).withColumnRenamed("c_mktsegment", "arm"), pop)).withColumnRenamed("arm", "c_mktsegment")


@query("select o_orderstatus, o_orderpriority, n, total, round(n*100.0::double/total,6) as pct from (select o_orderstatus, o_orderpriority, count(*) as n from orders group by all) join (select o_orderpriority, count(*) as total from orders group by all) using (o_orderpriority)")
def denoms_by(spark, d):
    return raw(t.build(count_of("o_orderstatus", "o_orderpriority", denoms_by=["o_orderpriority"]), orders(spark, d)))


@query("select o_orderstatus, o_orderpriority, n, total, round(n*100.0::double/total,6) as pct from (select o_orderstatus, o_orderpriority, count(*) as n from orders group by all) join (select o_orderstatus, count(*) as total from orders where o_totalprice > 100000 group by all) using (o_orderstatus)")
def denom_where(spark, d):
    return raw(t.build(count_of("o_orderstatus", "o_orderpriority", denom_where="o_totalprice > 100000"), orders(spark, d)))


@query("select o_orderstatus, o_orderpriority, n, total, round(n*100.0::double/total,6) as pct from (select o_orderstatus, o_orderpriority, count(*) as n from orders group by all) join (select o_orderstatus, count(*) as total from orders where o_orderpriority <> '5-LOW' group by all) using (o_orderstatus)")
def denom_ignore(spark, d):
    return raw(t.build(count_of("o_orderstatus", "o_orderpriority", denom_ignore=["5-LOW"]), orders(spark, d)))


@query("with x as (select o_orderstatus, o_orderpriority from orders union all select 'All', o_orderpriority from orders) " + wide(_COUNT.format(n_pct("n", "total")).replace("from orders", "from x"), ["All", *STATUS]))
def total_group(spark, d):
    spec = t.table_spec("o_orderstatus", total_groups=[t.total_group("o_orderstatus", "All")], layers=[t.group_count("o_orderpriority")])
    return shown(t.build(spec, orders(spark, d)))


@query("with x as (select o_orderstatus, o_orderpriority from orders union all select 'Done', o_orderpriority from orders where o_orderstatus in ('F','P')) " + wide(_COUNT.format(n_pct("n", "total")).replace("from orders", "from x"), ["Done", *STATUS]))
def custom_group(spark, d):
    spec = t.table_spec("o_orderstatus", custom_groups=[t.custom_group("o_orderstatus", Done=["F", "P"])], layers=[t.group_count("o_orderpriority")])
    return shown(t.build(spec, orders(spark, d)))


_LOW = "(select *, nullif(o_orderpriority, '4-NOT SPECIFIED') as p from orders)"


def low(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).withColumn("p", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")))


@query(wide(f"select label as rowlabel1, o_orderstatus as arm, {n_pct('n', 'total')} as cell from (select o_orderstatus, coalesce(p,'Missing') as label, count(*) as n from {_LOW} group by all union all select o_orderstatus, 'Any', count(*) from orders group by all) join (select o_orderstatus, count(*) as total from orders group by all) using (o_orderstatus)", STATUS))
def missing_and_total_rows(spark, d):
    return shown(t.build(count_of("o_orderstatus", "p", missing_count={"label": "Missing"}, total_row=True, total_row_label="Any"), low(spark, d)))


@query(wide(f"select label as rowlabel1, o_orderstatus as arm, {n_pct('n', 'total')} as cell from (select o_orderstatus, case when p is null or p='5-LOW' then 'Unknown' else p end as label, count(*) as n from {_LOW} group by all union all select o_orderstatus, 'Total', count(*) from {_LOW} where p is not null and p<>'5-LOW' group by all) join (select o_orderstatus, count(*) as total from {_LOW} where p is not null and p<>'5-LOW' group by all) using (o_orderstatus)", STATUS))
def missing_values_excluded(spark, d):
    missing = {"label": "Unknown", "missing_values": ["5-LOW"], "denom_exclude": True}
    return shown(t.build(count_of("o_orderstatus", "p", missing_count=missing, total_row=True, total_row_count_missings=False), low(spark, d)))


@query("with s as (select c_mktsegment as arm, o_custkey from " + SALES + " where o_totalprice > 400000), pop as (select c_mktsegment as arm, count(distinct c_custkey) as total from customer group by all) select 'No such order' as rowlabel1, " + ", ".join(f"max(case when arm='{x}' then {num('cast(n as double)', 3, 0)} end) as res{k}" for k, x in enumerate(SEGMENTS, 1)) + " from (select arm, total - coalesce(m,0) as n from pop left join (select arm, count(distinct o_custkey) as m from s group by all) using (arm))")
def missing_subjects(spark, d):
    settings = t.layer_settings(distinct_by="c_custkey", missing_subjects=True, missing_subjects_label="No such order", format_strings={"n_counts": t.f_str("xxx", "distinct_n")})
    spec = t.table_spec("c_mktsegment", where="o_totalprice > 400000", pop_data=t.pop_data("c_mktsegment"), layers=[t.group_count("o_orderstatus", settings=settings)])
    return shown(t.build(spec, sales(spark, d), spark.read.parquet(f"{d}/customer.parquet"))).where("rowlabel1 = 'No such order'")


@query("select o_orderstatus, o_orderpriority, n, total, round(n*100.0::double/total,6) as pct from (select o_orderstatus, o_orderpriority, count(*) as n from orders where o_orderpriority in ('1-URGENT','2-HIGH') group by all) join (select o_orderstatus, count(*) as total from orders group by all) using (o_orderstatus)")
def keep_levels(spark, d):
    return raw(t.build(count_of("o_orderstatus", "o_orderpriority", keep_levels=["1-URGENT", "2-HIGH"]), orders(spark, d)))


@query("select s.c_mktsegment, g.r_name, g.n_name, coalesce(n,0) as n, total, round(coalesce(n,0)*100.0::double/total,6) as pct from (select distinct r_name, n_name from " + CUSTOMER + ") g cross join (select c_mktsegment, count(*) as total from customer group by all) s left join (select c_mktsegment, r_name, n_name, count(*) as n from " + CUSTOMER + " group by all) x on x.c_mktsegment=s.c_mktsegment and x.r_name=g.r_name and x.n_name=g.n_name")
def limit_data_by(spark, d):
    spec = t.table_spec("c_mktsegment", layers=[t.group_count("n_name", by="r_name", settings=t.layer_settings(limit_data_by=["r_name", "n_name"]))])
    return raw(t.build(spec, customer(spark, d)))


_NESTED = (
    "with x as (select c_mktsegment as arm, r_name, n_name, c_custkey from " + CUSTOMER + "), den as (select arm, count(*) as total from x group by all), "
    "c as (select arm, r_name, case when grouping(n_name)=1 then '' else n_name end as n_name, grouping(n_name) as g, count(*) as n from x group by grouping sets ((arm, r_name), (arm, r_name, n_name))), "
    "keys as (select distinct r_name, n_name, g from c), f as (select keys.r_name, keys.n_name, keys.g, den.arm, coalesce(c.n,0) as n, total from keys cross join den left join c on c.arm=den.arm and c.r_name=keys.r_name and c.n_name=keys.n_name and c.g=keys.g)"
)


@query(_NESTED + " " + wide(f"select r_name as rowlabel1, n_name as rowlabel2, arm, {n_pct('n', 'total')} as cell from f", SEGMENTS, "rowlabel1, rowlabel2"))
def nested_count(spark, d):
    return shown(t.build(count_of("c_mktsegment", ["r_name", "n_name"]), customer(spark, d)))


@query(_NESTED + ", s as (select r_name, n_name, g, sum(n) as k from f group by all), o as (select s.*, r.k as rk from s join s r on r.r_name=s.r_name and r.g=1) select r_name as rowlabel1, n_name as rowlabel2, cast(row_number() over (order by rk desc, r_name, g desc, k desc, n_name) as integer) as ord_layer_1, cast(2-g as integer) as ord_layer_2 from o")
def nested_bycount(spark, d):
    result = t.build(count_of("c_mktsegment", ["r_name", "n_name"], order_count_method="bycount"), customer(spark, d))
    return shown(result, "rowlabel1", "rowlabel2", "ord_layer_1", "ord_layer_2")


@query("select o_orderpriority as rowlabel1, " + ", ".join(f"max(case when o_orderstatus='{x}' then {num('cast(n as double)', 5, 0)} end) as res{2 * k - 1}, max(case when o_orderstatus='{x}' then {num('n*100.0::double/total', 5, 2)} end) as res{2 * k}" for k, x in enumerate(STATUS, 1)) + " from (select o_orderpriority, o_orderstatus, count(*) as n from orders group by all) join (select o_orderstatus, count(*) as total from orders group by all) using (o_orderstatus) group by all")
def stat_columns(spark, d):
    return shown(t.build(count_of("o_orderstatus", "o_orderpriority", stat_columns={"n": t.f_str("xxxxx", "n"), "%": t.f_str("xx.xx", "pct")}), orders(spark, d)))


@query("with c as (select o_orderpriority, sum(case when o_orderstatus='F' then 1 else 0 end) as n from orders group by all) select o_orderpriority as rowlabel1, cast(row_number() over (order by n desc, o_orderpriority) as integer) as ord_layer_1 from c")
def order_bycount(spark, d):
    result = t.build(count_of("o_orderstatus", "o_orderpriority", order_count_method="bycount", ordering_cols=["F"]), orders(spark, d))
    return shown(result, "rowlabel1", "ord_layer_1")


@query("with e as (select event_type, min(length(event_type)*100 - ascii(event_type)) as k from events group by all) select event_type as rowlabel1, cast(row_number() over (order by k, event_type) as integer) as ord_layer_1 from e")
def order_byvarn(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("event_typeN", F.length("event_type") * 100 - F.ascii("event_type"))
    return shown(t.build(count_of(None, "event_type", order_count_method="byvarn"), e), "rowlabel1", "ord_layer_1")


@query("select o_orderstatus as arm, count(*) as n from orders group by all")
def header_counts(spark, d):
    result = t.build(t.table_spec("o_orderstatus", pop_data=t.pop_data("o_orderstatus"), layers=[t.group_count("o_orderpriority")]), orders(spark, d), orders(spark, d))
    return spark.createDataFrame([(combo[0], n) for combo, n in t.header_n(result)], "arm string, n long")


@query(wide(_COUNT.format("(case when n < 1000 then '' else " + n_pct("n", "total") + " end)").replace("count(*) as n", "count(*) filter (where o_totalprice > 480000) as n"), STATUS).replace("n < 1000", "n = 0"))
def zero_display(spark, d):
    df = orders(spark, d)
    spec = t.table_spec("o_orderstatus", pop_data=t.pop_data("o_orderstatus"), where="o_totalprice > 480000", levels={"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}, layers=[t.group_count("o_orderpriority", settings=t.layer_settings(zero_count_display="blank"))])
    return shown(t.build(spec, df, df))


@query(wide("select r as rowlabel1, arm, case when pct > 0 and " + rnd("pct", 0) + " < 2 then ' <2%' else " + num("pct", 3, 0) + " || '%' end as cell from (select n_name as r, c_mktsegment as arm, n*100.0::double/total as pct from (select n_name, c_mktsegment, count(c_custkey) as n from (select distinct n_name from nation) cross join (select distinct c_mktsegment from customer) left join " + CUSTOMER + " using (n_name, c_mktsegment) group by all) join (select c_mktsegment, count(*) as total from customer group by all) using (c_mktsegment))", SEGMENTS))
def pct_thresholds(spark, d):
    return shown(t.build(count_of("c_mktsegment", "n_name", pct_lt=2, format_strings={"n_counts": t.f_str("xxx%", "pct")}), customer(spark, d)))


# ------------------------------------------------------------------ descriptive layers

_STATS = "count({v}) as n, count(*) as n_records, round(avg({v}),6) as mean, round(stddev_samp({v}),6) as sd, round(median({v}),6) as median, round(var_samp({v}),4) as var, round(min({v}),6) as min, round(max({v}),6) as max, round(quantile_cont({v},0.75)-quantile_cont({v},0.25),6) as iqr, round(quantile_cont({v},0.25),6) as q1, round(quantile_cont({v},0.75),6) as q3, sum(case when {v} is null then 1 else 0 end)::bigint as missing"


def stats_of(frame: DataFrame) -> DataFrame:
    return frame.withColumn("var", F.round("var", 4)).drop("total", "pct")


@query("select l_returnflag, " + _STATS.format(v="q") + " from (select l_returnflag, nullif(l_quantity, 13) as q from lineitem) group by all")
def desc_stats(spark, d):
    df = lineitem(spark, d).withColumn("q", F.nullif("l_quantity", F.lit(13.0)))
    return stats_of(raw(t.build(t.table_spec("l_returnflag", layers=[t.group_desc("q")]), df)))


@query("select l_returnflag, l_linestatus, " + _STATS.format(v="l_extendedprice") + " from lineitem group by all")
def desc_by(spark, d):
    return stats_of(raw(t.build(t.table_spec("l_returnflag", layers=[t.group_desc("l_extendedprice", by="l_linestatus")]), lineitem(spark, d))))


@query("select l_returnflag, variable, " + _STATS.format(v="v") + " from (select l_returnflag, 'l_quantity' as variable, l_quantity as v from lineitem union all select l_returnflag, 'l_discount', l_discount from lineitem) group by all")
def desc_multi_target(spark, d):
    return stats_of(raw(t.build(t.table_spec("l_returnflag", layers=[t.group_desc(["l_quantity", "l_discount"])]), lineitem(spark, d))))


@query(wide(f"select 'Mean (SD)' as rowlabel1, l_returnflag as arm, {num('avg(l_quantity)', 4, 1)} || ' (' || {num('stddev_samp(l_quantity)', 5, 2)} || ')' as cell from lineitem group by l_returnflag union all select 'Min, Max', l_returnflag, {num('cast(min(l_quantity) as double)', 2, 0)} || ', ' || {num('cast(max(l_quantity) as double)', 2, 0)} from lineitem group by l_returnflag", ["A", "N", "R"]))
def desc_formats(spark, d):
    formats = {"Mean (SD)": t.f_str("xx.x (xx.xx)", "mean", "sd"), "Min, Max": t.f_str("xx, xx", "min", "max")}
    return shown(t.build(t.table_spec("l_returnflag", layers=[t.group_desc("l_quantity", settings=t.layer_settings(format_strings=formats))]), lineitem(spark, d)))


@query("select l_returnflag, (list_sort(list(l_quantity)))[cast(greatest(1, case when count(*)*0.25::double - 0.5 - floor(count(*)*0.25::double - 0.5) > 0 then floor(count(*)*0.25::double-0.5)+1 when cast(floor(count(*)*0.25::double-0.5) as bigint)%2=0 then floor(count(*)*0.25::double-0.5) else floor(count(*)*0.25::double-0.5)+1 end) as bigint)] as q1 from lineitem group by all")
def quantile_type_3(spark, d):
    result = t.build(t.table_spec("l_returnflag", layers=[t.group_desc("l_quantity")]), lineitem(spark, d), options=t.Options(quantile_type=3))
    return result.numeric[1].select("l_returnflag", "q1")


@query("select l_returnflag, round(sum(l_quantity)/count(*), 6) as own from lineitem group by all")
def custom_summary(spark, d):
    settings = t.layer_settings(custom_summaries={"own": "sum(.var) / count(.var)"}, format_strings={"Own": t.f_str("xx.xx", "own")})
    return raw(t.build(t.table_spec("l_returnflag", layers=[t.group_desc("l_quantity", settings=settings)]), lineitem(spark, d))).select("l_returnflag", "own")


@query("select l_linestatus as rowlabel1, " + ", ".join(f"max(case when l_returnflag='{x}' then {num('cast(n as double)', 6, 0)} end) as res{2 * k - 1}, max(case when l_returnflag='{x}' then {num('m', 5, 2)} end) as res{2 * k}" for k, x in enumerate(["A", "N", "R"], 1)) + " from (select l_linestatus, l_returnflag, count(*) as n, avg(l_quantity) as m from lineitem group by all) group by all")
def stats_as_columns(spark, d):
    formats = {"N": t.f_str("xxxxxx", "n"), "Mean": t.f_str("xx.xx", "mean")}
    layer = t.group_desc("l_quantity", by="l_linestatus", settings=t.layer_settings(stats_as_columns=True, format_strings=formats))
    out = shown(t.build(t.table_spec("l_returnflag", layers=[layer]), lineitem(spark, d)))
    return out.select(*[F.nullif(c, F.lit("")).alias(c) if c != "rowlabel1" else F.col(c) for c in out.columns])


@query("select o_orderstatus, max(length(cast(cast(floor(o_totalprice) as bigint) as varchar)))::bigint as max_int from orders group by all")
def precision_widths(spark, d):
    from tessera.operators.describing import precision_scan

    found = precision_scan(F.col("o_totalprice"))
    return orders(spark, d).groupBy("o_orderstatus").agg(found["max_int"].cast("long").alias("max_int"))


@query(wide(f"select 'Mean' as rowlabel1, o_orderstatus as arm, {num('avg(c)', 5, 2)} as cell from (select o_orderstatus, o_custkey % 100 as c from orders) group by o_orderstatus", STATUS))
def auto_precision(spark, d):
    settings = t.layer_settings(format_strings={"Mean": t.f_str("a.a+2", "mean")})
    spec = t.table_spec("o_orderstatus", layers=[t.group_desc("c", settings=settings)])
    return shown(t.build(spec, orders(spark, d).withColumn("c", F.col("o_custkey") % 100))).select("rowlabel1", *[F.lpad(F.trim(f"res{k}"), 5, " ").alias(f"res{k}") for k in (1, 2, 3)])


@query("select o_orderstatus as arm, (sign(x)*floor(abs(x)*10+0.5)/10) as v from (select o_orderstatus, sum(o_totalprice)/count(*) as x from orders group by all)")
def ibm_rounding(spark, d):
    from tessera.functions.fmt import round_column

    means = orders(spark, d).groupBy(F.col("o_orderstatus").alias("arm")).agg((F.sum("o_totalprice") / F.count(F.lit(1))).alias("x"))
    return means.select("arm", round_column(F.col("x"), 1, t.Options(ibm_rounding=True)).alias("v"))


# ------------------------------------------------------------------ shift layers

_GRID = "(select a.l_returnflag, b.l_linestatus, c.l_linenumber from (select distinct l_returnflag from lineitem) a cross join (select distinct l_linestatus from lineitem) b cross join (select distinct cast(l_linenumber as varchar) as l_linenumber from lineitem) c)"
_SHIFT = "select g.l_returnflag, g.l_linestatus, g.l_linenumber, coalesce(n,0) as n, total, round(coalesce(n,0)*100.0::double/total,6) as pct from " + _GRID + " g left join (select l_returnflag, l_linestatus, cast(l_linenumber as varchar) as l_linenumber, count(*) as n from lineitem group by all) x using (l_returnflag, l_linestatus, l_linenumber) left join (select {k}, count(*) as total from lineitem group by all) y using ({k})"


@query(_SHIFT.format(k="l_returnflag"))
def shift_total(spark, d):
    return raw(t.build(t.table_spec("l_returnflag", layers=[t.group_shift({"row": "l_linenumber", "column": "l_linestatus"})]), lineitem(spark, d)))


@query(_SHIFT.format(k="l_returnflag, l_linestatus"))
def shift_column(spark, d):
    layer = t.group_shift({"row": "l_linenumber", "column": "l_linestatus"}, settings=t.layer_settings(shift_denom="column"))
    return raw(t.build(t.table_spec("l_returnflag", layers=[layer]), lineitem(spark, d)))


@query("select 'n' as rowlabel1, " + ", ".join(f"{pad(f'coalesce(sum(case when l_returnflag={chr(39)}{f}{chr(39)} and l_linestatus={chr(39)}{s}{chr(39)} then 1 end),0)::bigint::varchar', 6)} as res{2 * i + j + 1}" for i, f in enumerate("ANR") for j, s in enumerate("FO")) + " from lineitem")
def shift_denominator_row(spark, d):
    settings = t.layer_settings(shift_denom="column", denom_row=True, denom_row_format=t.f_str("xxxxxx", "total"))
    layer = t.group_shift({"row": "l_linenumber", "column": "l_linestatus"}, settings=settings)
    return shown(t.build(t.table_spec("l_returnflag", layers=[layer]), lineitem(spark, d))).where("rowlabel1 = 'n'")


# ------------------------------------------------------------------ comparisons

_Z = "1.959963984540054"
_TWO = "(select o_orderpriority, count(*) filter (where o_orderstatus='F')::double as a, count(*) filter (where o_orderstatus='O')::double as b, (select count(*) from orders where o_orderstatus='F')::double as m, (select count(*) from orders where o_orderstatus='O')::double as k from orders group by all)"
_HALF = f"({_Z}::double*sqrt(a/m*(1-a/m)/m + b/k*(1-b/k)/k))"


@query(f"select o_orderpriority as rowlabel1, {num('(a/m-b/k)*100', 4, 1)} || ' (' || {num(f'(a/m-b/k-{_HALF})*100', 4, 1)} || ', ' || {num(f'(a/m-b/k+{_HALF})*100', 4, 1)} || ')' as rdiff1 from {_TWO}")
def risk_difference(spark, d):
    result = t.build(count_of("o_orderstatus", "o_orderpriority", risk_diff={"comparisons": [("F", "O")]}), orders(spark, d))
    return shown(result, "rowlabel1", "rdiff1")


def interval(method: str) -> Query:
    def run(spark, d):
        settings = dict(ci_method=method, format_strings={"n_counts": t.f_str("xx [xx.x, xx.x]", "n", "ci_lower", "ci_upper")})
        return raw(t.build(count_of("o_orderstatus", "o_orderpriority", **settings), orders(spark, d))).select("o_orderstatus", "o_orderpriority", "ci_lower", "ci_upper")

    run.__name__ = f"ci_{method}"
    return run


_CELLS = "(select o_orderstatus, o_orderpriority, count(*)::double as x, any_value(m)::double as m from orders join (select o_orderstatus, count(*) as m from orders group by all) using (o_orderstatus) group by all)"
_LIMITS = "select o_orderstatus, o_orderpriority, round(greatest(c-h,0)*100,6) as ci_lower, round(least(c+h,1)*100,6) as ci_upper from (select *, {c} as c, {h} as h from " + _CELLS + ")"
_ZD = f"{_Z}::double"
query(_LIMITS.format(c="x/m", h=f"{_ZD}*sqrt(x/m*(1-x/m)/m)"))(interval("wald"))
query(_LIMITS.format(c=f"(x/m+{_ZD}*{_ZD}/(2*m))/(1+{_ZD}*{_ZD}/m)", h=f"{_ZD}*sqrt(x/m*(1-x/m)/m+{_ZD}*{_ZD}/(4*m*m))/(1+{_ZD}*{_ZD}/m)"))(interval("wilson"))
_P = f"((x+{_ZD}*{_ZD}/2)/(m+{_ZD}*{_ZD}))"
query(_LIMITS.format(c=_P, h=f"{_ZD}*sqrt({_P}*(1-{_P})/(m+{_ZD}*{_ZD}))"))(interval("agresti_coull"))

# A quantile of the beta distribution: trapezia of its density over 18 standard deviations with the correction for
# slopes at the end, then a step of second order from the last place below the tail.
_STEP = "0.002::double"
_BETA = (
    "with c as {cells}, ends as ({ends}), "
    "shape as (select *, a/(a+b) as mu, sqrt(a*b/(a+b+1))/(a+b)*" + _STEP + " as h from ends), "
    "grid as (select *, mu+h*i as y from shape, (select unnest(generate_series(-4500, 4500)) as i) where mu+h*i > 0 and mu+h*i < 1), "
    "dense as (select *, exp((a-1)*ln(y/mu)+(b-1)*ln((1-y)/(1-mu))) as f from grid), "
    "runs as (select *, f*((a-1)/y-(b-1)/(1-y)) as slope, sum(f) over w-f/2 as part, sum(f) over (partition by o_orderstatus, o_orderpriority, side) as whole "
    "from dense window w as (partition by o_orderstatus, o_orderpriority, side order by i)), "
    "below as (select *, (part-h/12*slope)/whole as cdf from runs where (part-h/12*slope)/whole <= tail), "
    "final as (select *, (tail-cdf)*whole*h/f as d from below qualify row_number() over (partition by o_orderstatus, o_orderpriority, side order by i desc)=1) "
    "select o_orderstatus, o_orderpriority, round(max(case when side='low' then y+d-slope/(2*f)*d*d end)*100,6) as ci_lower, "
    "round(max(case when side='high' then y+d-slope/(2*f)*d*d end)*100,6) as ci_upper from final group by all"
)


def _beta(low: tuple[str, str], high: tuple[str, str]) -> str:
    """Limits by beta quantiles, for cells that are neither empty nor full."""
    end = "select *, '{}' as side, {}::double as tail, {}::double as a, {}::double as b from c"
    return _BETA.format(cells=_CELLS, ends=end.format("low", 0.025, *low) + " union all " + end.format("high", 0.975, *high))


query(_beta(("x", "m-x+1"), ("x+1", "m-x")))(interval("clopper_pearson"))
query(_beta(("x+0.5", "m-x+0.5"), ("x+0.5", "m-x+0.5")))(interval("jeffreys"))

# Fisher's test: the probabilities of all tables of the same margins that are no likelier than the one observed.
_FISHER = (
    "with c as (select o_orderpriority, o_orderstatus, count(distinct o_custkey) as n from orders group by all), "
    "total as (select o_orderstatus, count(distinct o_custkey) as m from orders group by all), "
    "pairs as (select r.o_orderpriority, k.o_orderstatus as arm, r.n as a, k.n as b, rt.m as ma, kt.m as mb from c r join c k using (o_orderpriority) "
    "join total rt on rt.o_orderstatus='F' join total kt on kt.o_orderstatus=k.o_orderstatus where r.o_orderstatus='F' and k.o_orderstatus<>'F'), "
    "tables as (select *, unnest(generate_series(greatest(0, a+b-mb), least(a+b, ma))) as i from pairs), "
    "chances as (select *, {ways} as p, {own} as own from tables), "
    "tests as (select o_orderpriority, arm, least(1, sum(exp(p-own)) filter (where p-own <= 1e-7)/sum(exp(p-own))) as v from chances group by all) "
)
_WAYS = "-(lgamma({i}+1)+lgamma(ma-{i}+1)+lgamma(a+b-{i}+1)+lgamma(mb-(a+b-{i})+1))"


@query(
    _FISHER.format(ways=_WAYS.format(i="i"), own=_WAYS.format(i="a"))
    + "select o_orderpriority as rowlabel1, "
    + ", ".join(f"max(case when arm='{x}' then {num('v', 5, 3)} end) as pval{k}" for k, x in enumerate("OP", 1))
    + " from tests group by all"
)
def assoc_pairwise(spark, d):
    test = t.assoc_test(t.fisher_exact_2x2, reference="F")
    return shown(t.build(count_of("o_orderstatus", "o_orderpriority", assoc_test=test, distinct_by="o_custkey"), orders(spark, d)), "rowlabel1", "pval1", "pval2")


@query(
    "select o_orderpriority as rowlabel1, case when row_number() over (order by o_orderpriority)=1 then "
    + num("(select avg(o_totalprice) from orders)", 8, 1)
    + " else '' end as pval1 from (select distinct o_orderpriority from orders)"
)
def assoc_omnibus(spark, d):
    test = t.assoc_test(lambda rows: float(rows["o_totalprice"].mean()), format=t.f_str("xxxxxx.x", "v"))
    return shown(t.build(count_of("o_orderstatus", "o_orderpriority", assoc_test=test), orders(spark, d)), "rowlabel1", "pval1")


@query("select 'Mean' as rowlabel1, " + ", ".join(f"max(case when o_orderstatus='{x}' then {num('v', 8, 1)} end) as res{k}" for k, x in enumerate(STATUS, 1)) + " from (select o_orderstatus, avg(o_custkey) as v from orders group by all)")
def analyze_layer(spark, d):
    layer = t.group_analyze("o_custkey", analyze_fn=lambda rows, v: {"m": float(rows[v].mean())}, settings=t.layer_settings(format_strings={"Mean": t.f_str("xxxxxx.x", "m")}))
    return shown(t.build(t.table_spec("o_orderstatus", layers=[layer]), orders(spark, d)))


# ------------------------------------------------------------------ several layers, layer and population filters, weights

_DEAR = "(select * from orders where o_totalprice > 200000)"


@query(
    "select *, 1 as ord_layer_index from (" + wide(_COUNT.format(n_pct("n", "total")), STATUS) + ") union all "
    "select *, 2 as ord_layer_index from (" + wide(_COUNT.format(n_pct("n", "total")).replace("from orders", f"from {_DEAR}"), STATUS) + ")"
)
def several_layers(spark, d):
    layers = [t.group_count("o_orderpriority"), t.group_count("o_orderpriority", where="o_totalprice > 200000")]
    return shown(t.build(t.table_spec("o_orderstatus", layers=layers), orders(spark, d)), "rowlabel1", "res1", "res2", "res3", "ord_layer_index")


@query("select c_mktsegment, o_orderpriority, n, total, round(n*100.0::double/total,6) as pct from (select c_mktsegment, o_orderpriority, count(*) as n from " + SALES + " where c_acctbal > 0 group by all) join (select c_mktsegment, count(*) as total from customer where c_acctbal > 0 group by all) using (c_mktsegment)")
def pop_where(spark, d):
    spec = t.table_spec("arm", pop_data=t.pop_data({"arm": "c_mktsegment"}, "c_acctbal > 0"), layers=[t.group_count("o_orderpriority", where="c_acctbal > 0")])
    pop = spark.read.parquet(f"{d}/customer.parquet")
    return raw(t.build(spec, sales(spark, d).withColumnRenamed("c_mktsegment", "arm"), pop)).withColumnRenamed("arm", "c_mktsegment")


_BOTH = "select {k}, {a}, case when grouping({b})=1 then '' else {b} end as {b}, {n} from x group by grouping sets (({k}, {a}), ({k}, {a}, {b}))"


@query(
    "with x as (select c_mktsegment, o_orderstatus, o_orderpriority, o_custkey from " + SALES + "), d as (select c_mktsegment, count(*) as total, count(distinct o_custkey) as distinct_total from x group by all), "
    "c as (" + _BOTH.format(k="c_mktsegment", a="o_orderstatus", b="o_orderpriority", n="count(*) as n, count(distinct o_custkey) as distinct_n") + ") "
    "select c.*, total, distinct_total, round(n*100.0::double/total,6) as pct, round(distinct_n*100.0::double/distinct_total,6) as distinct_pct from c join d using (c_mktsegment)"
)
def nested_distinct(spark, d):
    return raw(t.build(count_of("c_mktsegment", ["o_orderstatus", "o_orderpriority"], distinct_by="o_custkey"), sales(spark, d)))


@query(
    "with x as (select c_mktsegment, r_name, n_name from " + CUSTOMER + "), c as (" + _BOTH.format(k="c_mktsegment", a="r_name", b="n_name", n="count(*) as n") + "), "
    "arm as (select c_mktsegment, count(*) as total from x group by all), region as (select c_mktsegment, r_name, count(*) as total from x group by all) "
    "select *, round(n*100.0::double/total,6) as pct from (select c.*, arm.total from c join arm using (c_mktsegment) where n_name = '' "
    "union all select c.*, region.total from c join region using (c_mktsegment, r_name) where n_name <> '')"
)
def denoms_by_level(spark, d):
    spec = count_of("c_mktsegment", ["r_name", "n_name"], denoms_by=[["c_mktsegment"], ["c_mktsegment", "r_name"]])
    return raw(t.build(spec, customer(spark, d)))


@query("select o_orderstatus, o_orderpriority, n, total, round(n*100.0::double/total, 6) as pct from (select o_orderstatus, o_orderpriority, count(*) as n from orders group by all) join (select o_orderstatus, count(*) as total from orders group by all) using (o_orderstatus)")
def weighted_counts(spark, d):
    counted = orders(spark, d).groupBy("o_orderstatus", "o_orderpriority", "o_custkey").agg(F.count(F.lit(1)).alias("times"))
    return raw(t.build(count_of("o_orderstatus", "o_orderpriority"), counted, weight="times"))


# ------------------------------------------------------------------ results, lineage, post-processing


@query("select 1 as analysis_id, o_orderstatus, o_orderpriority, s.stat_name, round(case s.stat_name when 'n' then n when 'total' then total else n*100.0::double/total end, 6)::double as stat_value from (select o_orderstatus, o_orderpriority, count(*) as n from orders group by all) join (select o_orderstatus, count(*) as total from orders group by all) using (o_orderstatus) cross join (select unnest(['n','total','pct']) as stat_name) s")
def ard(spark, d):
    return t.to_ard(t.build(count_of("o_orderstatus", "o_orderpriority"), orders(spark, d))).withColumn("stat_value", F.round("stat_value", 6))


@query(wide(_COUNT.format(n_pct("n", "total")), STATUS))
def ard_round_trip(spark, d):
    spec = count_of("o_orderstatus", "o_orderpriority")
    return t.from_ard(t.to_ard(t.build(spec, orders(spark, d))), spec).select("rowlabel1", "res1", "res2", "res3")


@query("select count(*) as n, round(sum(c_acctbal), 2) as v from " + CUSTOMER + " where r_name='ASIA' and n_name=(select min(n_name) from " + CUSTOMER + " where r_name='ASIA') and c_mktsegment='BUILDING'")
def metadata_subset(spark, d):
    df = customer(spark, d)
    result = t.build(count_of("c_mktsegment", ["r_name", "n_name"]), df, metadata=True)
    name = df.where("r_name = 'ASIA'").agg(F.min("n_name")).first()[0]
    return t.meta_subset(result, f"1_ASIA_{name}", "res2").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("v"))


@query("select case when lag(r_name) over (order by r_name, n_name)=r_name then '' else r_name end as rowlabel1, n_name as rowlabel2 from (select distinct r_name, n_name from " + CUSTOMER + " union all select distinct r_name, '' from " + CUSTOMER + ")")
def row_masks(spark, d):
    return apply_row_masks(t.build(count_of("c_mktsegment", ["r_name", "n_name"]), customer(spark, d)).table).select("rowlabel1", "rowlabel2")


@query("select r_name as row_label from (select distinct r_name from " + CUSTOMER + ") union all select '   ' || n_name from (select distinct n_name from " + CUSTOMER + ")")
def collapse_labels(spark, d):
    table = t.build(count_of("c_mktsegment", ["r_name", "n_name"]), customer(spark, d)).table
    return collapse_row_labels(table, nest=True, indent="   ").select("row_label")


@query("select o_orderpriority as rowlabel1, count(*)::double as n from orders where o_orderstatus='F' group by all")
def extract_num(spark, d):
    table = t.build(count_of("o_orderstatus", "o_orderpriority"), orders(spark, d)).table
    return table.select("rowlabel1", str_extract_num(F.col("res1")).alias("n"))


@query("select o_orderpriority as rowlabel1, case when count(*) < 985 then 'few' else 'many' end as size from orders where o_orderstatus='F' group by all")
def conditional_format(spark, d):
    table = t.build(count_of("o_orderstatus", "o_orderpriority"), orders(spark, d)).table
    few = apply_conditional_format(F.col("res1"), 1, "x < 985", "few", full_string=True)
    return table.select("rowlabel1", F.when(few == "few", "few").otherwise("many").alias("size"))


# Words of more than seven characters part with a hyphen after every seventh; then words join lines of seven at most.
_PARTS = r"regexp_replace(regexp_replace(trim(p_name), '(\w{7})', '\1- ', 'g'), '(\w{7})- (\W|$)', '\1\2', 'g')"


@query(
    f"select p_partkey, list_reduce(string_split_regex({_PARTS}, '\\s+'), lambda line, word: line || case when length(regexp_extract(line, '[^\n]*$')) + 1 + length(word) <= 7 "
    "then ' ' else chr(10) end || word) as p_name from part"
)
def indent_wrap(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", str_indent_wrap(F.col("p_name"), 8).alias("p_name"))
