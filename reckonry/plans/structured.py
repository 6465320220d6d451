"""Structured questions over lineitem, orders and part."""

from pyspark.sql import functions as F

from reckonry.operators.query import answer
from reckonry.plans.catalog import Tables, query


def _rounded(df, **places):
    return df.select(*[
        F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in df.columns
    ])


@query("Q1 Q2 Q3 Q5 Q8 Q9 Q11 Q13 Q14", """
    select l_returnflag, count(*) as row_count,
           round(sum(l_extendedprice), 2) as sum_l_extendedprice,
           round(avg(l_extendedprice), 4) as avg_l_extendedprice,
           round(median(l_extendedprice), 4) as median_l_extendedprice,
           min(l_extendedprice) as min_l_extendedprice, max(l_extendedprice) as max_l_extendedprice,
           count(distinct l_suppkey) as suppliers
    from lineitem
    where l_shipdate between timestamp '1994-01-01' and timestamp '1998-12-31'
    group by l_returnflag""")
def structured_group_aggregates(t: Tables):
    spec = {
        "select": [
            {"agg": "count", "column": "*"},
            *[{"column": "l_extendedprice", "agg": a} for a in ("sum", "avg", "median", "min", "max")],
            {"column": "l_suppkey", "agg": "count_distinct", "alias": "suppliers"},
        ],
        "group_by": ["l_returnflag"],
        "filters": [{"column": "l_shipdate", "op": "between", "value": ["1994-01-01", "1998-12-31"]}],
        "order_by": [{"column": "sum_l_extendedprice", "direction": "desc"}],
    }
    return _rounded(answer(t.lineitem, spec).rows, sum_l_extendedprice=2, avg_l_extendedprice=4,
                    median_l_extendedprice=4)


@query("Q3 Q5 Q6 Q7 Q9 Q10", """
    select count(*) as row_count, min(o_totalprice) as lowest, max(o_totalprice) as highest
    from orders
    where o_orderstatus in ('F', 'O') and o_totalprice >= 1000 and o_totalprice < 400000
      and o_orderpriority <> '5-LOW' and o_custkey is not null
      and o_orderdate between timestamp '1993-01-01' and timestamp '1999-12-31'""")
def structured_every_filter(t: Tables):
    return answer(t.orders, {
        "select": [{"agg": "count"}, {"column": "o_totalprice", "agg": "min", "alias": "lowest"},
                   {"column": "o_totalprice", "agg": "max", "alias": "highest"}],
        "filters": [
            {"column": "o_orderstatus", "op": "in", "value": ["F", "O"]},
            {"column": "o_totalprice", "op": "gte", "value": 1000},
            {"column": "o_totalprice", "op": "lt", "value": 400000},
            {"column": "o_orderpriority", "op": "neq", "value": "5-LOW"},
            {"column": "o_custkey", "op": "not_null"},
            {"column": "o_orderdate", "op": "between", "value": ["1993-01-01", "1999-12-31"]},
        ],
    }).rows


@query("Q4 Q1 Q13 Q14", """
    select p_partkey, p_name as part_name, p_retailprice from part
    where p_name ilike '%RING%' order by p_retailprice desc, p_partkey limit 50""")
def structured_like_topk(t: Tables):
    return answer(t.part, {
        "select": ["p_partkey", {"column": "p_name", "alias": "Part Name"}, "p_retailprice"],
        "filters": [{"column": "p_name", "op": "like", "value": "%RING%"}],
        "order_by": [{"column": "p_retailprice", "direction": "desc"}, "p_partkey"],
        "limit": 50,
    }).rows


@query("Q10 Q8", """
    select count(*) as row_count, round(median(value), 4) as median_value,
           count(distinct user_id) as users from events""")
def structured_global_median(t: Tables):
    spec = {"select": [{"agg": "count", "column": "*"},
                       {"column": "value", "agg": "median"},
                       {"column": "user_id", "agg": "count_distinct", "alias": "users"}]}
    return _rounded(answer(t.events, spec).rows, median_value=4)


@query("Q8 Q13 Q7", """
    select user_id, event_type, round(median(value), 4) as median_value, count(value) as count_value
    from events where value is not null group by user_id, event_type
    order by count_value desc, user_id, event_type""")
def structured_grouped_median(t: Tables):
    spec = {"select": [{"column": "value", "agg": "median"}, {"column": "value", "agg": "count"}],
            "group_by": ["user_id", "event_type"],
            "filters": [{"column": "value", "op": "not_null"}],
            "order_by": [{"column": "count_value", "direction": "desc"}, "user_id", "event_type"]}
    return _rounded(answer(t.events, spec).rows, median_value=4)


@query("Q12", "select o_orderpriority, o_orderkey as source_row from orders where o_totalprice > 100000")
def structured_row_refs(t: Tables):
    dataset = t.orders.withColumnRenamed("o_orderkey", "__source_row")
    return answer(dataset, {"select": [{"column": "o_totalprice", "agg": "sum"}], "group_by": ["o_orderpriority"],
                            "filters": [{"column": "o_totalprice", "op": "gt", "value": 100000}]}).refs


@query("Q3 Q8 Q9", """
    select p_brand, count(*) as parts, cast(sum(cast(p_retailprice as decimal(18, 4))) as double) as total
    from part where p_size > 10 and p_size <= 40 and p_type = 'ECONOMY' group by p_brand
    order by parts desc, p_brand limit 10""")
def structured_top_groups(t: Tables):
    dataset = t.part.withColumn("price", F.col("p_retailprice").cast("decimal(18, 4)"))
    rows = answer(dataset, {
        "select": [{"agg": "count", "alias": "parts"}, {"column": "price", "agg": "sum", "alias": "total"}],
        "group_by": ["p_brand"],
        "filters": [{"column": "p_size", "op": "gt", "value": 10}, {"column": "p_size", "op": "lte", "value": 40},
                    {"column": "p_type", "op": "eq", "value": "ECONOMY"}],
        "order_by": [{"column": "parts", "direction": "desc"}, "p_brand"],
        "limit": 10,
    }).rows
    return rows.withColumn("total", F.col("total").cast("double"))


@query("Q15", """
    select 'o_orderpriority' as grouped_by, o_orderpriority, count(*) as orders, count(*) over () as row_count,
           (select count(*) from orders) as ref_count
    from orders group by o_orderpriority""")
def structured_run_record(t: Tables):
    """One recorded run: the question, and its rows and references as its files hold them."""
    dataset = t.orders.withColumnRenamed("o_orderkey", "__source_row")
    record = answer(dataset, {"select": [{"agg": "count", "alias": "orders"}], "group_by": ["o_orderpriority"]}).run_record(t.spark)
    rows = t.spark.read.parquet(record.first()["result_path"])
    return rows.crossJoin(F.broadcast(record)).select(  # the record is one row
        F.get_json_object("spec", "$.group_by[0]").alias("grouped_by"), "o_orderpriority", "orders", "row_count", "ref_count")
