"""Registered queries of the engine and the SQL that each must agree with.

Every query runs over whole tables, but for kinship, null_placement, values_left_join and
lateral_left_join, whose SQL cuts rows; each has a query named .._whole without the cut. The SQL is written for another engine in its own idiom
(QUALIFY, DISTINCT ON, GROUPS, ANY / ALL ..), so that it checks the meaning and not a transcript.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import arrays, geo, jsons, ranges, texts
from millrace.model import Model, Relation
from millrace.operators import aggregates as agg
from millrace.operators import changes, expressions, graph, joins, setops, subqueries, windows
from millrace.operators.order import asc, desc
from millrace.operators.predicates import all_of, any_of, field, portable, xor
from millrace.queryset import QuerySet
from millrace.sources import tables, tiles
from millrace.streaming import outbox, refresh

REGION = Model("region", {"r_regionkey": "int", "r_name": "string"}, "r_regionkey")
NATION = Model("nation", {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}, "n_nationkey", relations={"region": Relation("n_regionkey", REGION)})
CUSTOMER = Model("customer", {"c_custkey": "long", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}, "c_custkey", relations={"nation": Relation("c_nationkey", NATION)})
SUPPLIER = Model("supplier", {"s_suppkey": "long", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"}, "s_suppkey")
PART = Model("part", {"p_partkey": "long", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"}, "p_partkey")
ORDERS = Model("orders", {"o_orderkey": "long", "o_custkey": "long", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}, "o_orderkey", relations={"customer": Relation("o_custkey", CUSTOMER)})
LINEITEM = Model("lineitem", {"l_orderkey": "long", "l_partkey": "long", "l_suppkey": "long", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}, "l_orderkey")
EVENTS = Model("events", {"event_id": "long", "ts": "timestamp_ntz", "user_id": "long", "event_type": "string", "value": "double", "props": "string"}, "event_id")
EMBEDDINGS = Model("embeddings", {"vec_id": "long", "embedding": "array<float>", "label": "int"}, "vec_id")
CONVERSATIONS = Model("conversations", {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}, "conv_id")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def q(model: Model, spark: SparkSession, d: str) -> QuerySet:
    return model.objects(spark.read.parquet(f"{d}/{model.name}.parquet"))


# -- 2.1 sources and terminals


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc,
 avg(l_quantity) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL HAVING count(*) > 10""")
def pricing_summary(spark, d):
    rows = q(LINEITEM, spark, d).filter(field("l_shipdate").lte(F.expr("timestamp_ntz'1998-09-02'"))).group_by("l_returnflag", "l_linestatus")
    out = rows.annotate(sum_qty=F.sum("l_quantity"), sum_base=F.sum("l_extendedprice"), sum_disc=F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4), avg_qty=agg.avg(F.col("l_quantity")), n=F.count("*"))
    return out.having(F.col("n") > 10).order_by("l_returnflag", "l_linestatus").to_df()


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def table_scan(spark, d):
    return q(ORDERS, spark, d).to_df().drop("o_orderdate")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O' QUALIFY place <= 50")
def proxy_defaults(spark, d):
    proxy = Model("orders", ORDERS.columns, "o_orderkey", where=F.col("o_orderstatus") == "O", order=(desc("o_totalprice"), asc("o_orderkey")))
    top = q(proxy, spark, d).limit(50).to_df()
    return top.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("place"))


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F')")
def soft_delete(spark, d):
    rows = q(ORDERS, spark, d).computed(deleted_at=F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    return rows.not_deleted().to_df().select("o_orderkey")


@query("SELECT count(*) AS n FROM orders WHERE 1 = 0")
def empty_relation(spark, d):
    return q(ORDERS, spark, d).none().filter(field("o_orderkey").gt(0)).aggregate(n=F.count("*"))


@query("SELECT * FROM (VALUES (1, 'a', 1.5), (2, NULL, 2.5), (NULL, 'c', NULL)) t(i, s, x)")
def inline_values(spark, d):
    return tables.values(spark, [(1, "a", 1.5), (2, None, 2.5), (None, "c", None)], "i int, s string, x double")


@query("""SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders)) AS distinct_count, (SELECT count(*) FROM orders WHERE o_totalprice > 1000) AS plain_count,
 (SELECT count(*) > 0 FROM orders WHERE o_totalprice < 0) AS any_negative, (SELECT max(o_orderkey) FROM orders) AS first_key""")
def terminals(spark, d):
    rows = q(ORDERS, spark, d)
    distinct = QuerySet(None, rows.to_df().select("o_custkey")).distinct().limit(3).count()
    first = rows.order_by("-o_orderkey").first()["o_orderkey"]
    one = rows.filter(o_orderkey=first).fetch_one()["o_orderkey"]
    bulk = rows.in_bulk([first, -1])
    assert one == first and list(bulk) == [first]
    return spark.createDataFrame([(distinct, rows.filter(field("o_totalprice").gt(1000)).order_by("o_orderkey").limit(5).count(), rows.filter(field("o_totalprice").lt(0)).exists(), first)], "distinct_count long, plain_count long, any_negative boolean, first_key long")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def row_stream(spark, d):
    """A cursor over the rows; here it only proves that streaming sees the same relation."""
    rows = q(CUSTOMER, spark, d).filter(field("c_acctbal").gt(5000))
    head = next(rows.stream(), None)
    assert head is None or head["c_acctbal"] > 5000
    return rows.to_df().select("c_custkey")


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 100 GROUP BY n_name")
def raw_sql(spark, d):
    return tables.raw(spark, "SELECT n_name, count(*) AS n FROM {c} JOIN {n} ON c_nationkey = n_nationkey WHERE c_acctbal > :low GROUP BY n_name", {"low": 100}, c=CUSTOMER.table(spark, d), n=NATION.table(spark, d))


@query()
def vector_tiles(spark, d):
    rows = q(EVENTS, spark, d).to_df().select("event_type", (F.col("user_id") % 4096).cast("int").alias("x"), (F.col("event_id") % 4096).cast("int").alias("y"), "value")
    return tiles.as_mvt(rows, "event_type", "x", "y", ["value"])


@query()
def geobuf(spark, d):
    return tiles.as_geobuf(_points(spark, d), "event_type", "lon", "lat")


# -- 2.2 projection


@query("SELECT c_custkey AS id, upper(c_name) AS shout, c_acctbal * 2 AS double_balance, c_mktsegment AS seg FROM customer")
def projection(spark, d):
    rows = q(CUSTOMER, spark, d).computed(double_balance="c_acctbal * 2")
    return rows.project(id="c_custkey", shout=F.upper("c_name"), double_balance="double_balance", seg="c_mktsegment").to_df()


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark, d):
    return QuerySet(None, ORDERS.table(spark, d).select("o_orderstatus", "o_orderpriority")).distinct().to_df()


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, d):
    return q(ORDERS, spark, d).distinct_on("o_custkey").order_by("o_custkey", "-o_totalprice", "o_orderkey").to_df().select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_acctbal, round(avg(c_acctbal) OVER (), 6) AS mean, count(*) OVER () AS n FROM customer")
def annotate_totals(spark, d):
    return q(CUSTOMER, spark, d).annotate_totals(mean=F.round(F.avg("c_acctbal"), 6), n=F.count("*")).to_df().select("c_custkey", "c_acctbal", "mean", "n")


# -- 2.3 predicates


def _nulled(spark, d) -> DataFrame:
    """Customers with nulls: no segment for BUILDING, no balance under 0."""
    return CUSTOMER.table(spark, d).select("c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"), (F.col("c_custkey") % 7).cast("int").alias("k"))


_NULLED = "(SELECT c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS seg, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal, (c_custkey % 7)::INT AS k FROM customer)"


def _counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """How many rows each predicate keeps."""
    rows = [F.struct(F.lit(k).alias("predicate"), F.coalesce(c, F.lit(False)).alias("kept")) for k, c in conditions.items()]
    return df.select(F.inline(F.array(*rows))).groupBy("predicate").agg(F.count_if("kept").alias("n"))


def _count_sql(source: str, **conditions: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS predicate, count(*) FILTER (WHERE {c}) AS n FROM {source}" for k, c in conditions.items())


@query(_count_sql(_NULLED, eq="seg = 'MACHINERY'", neq="seg <> 'MACHINERY'", gt="bal > 500", gte="bal >= 500", lt="bal < 500", lte="bal <= 500", between="bal BETWEEN 100 AND 900", in_="seg IN ('MACHINERY', 'FURNITURE')",
    not_in="seg NOT IN ('MACHINERY', 'FURNITURE')", in_empty="false", not_in_empty="true", is_null="seg IS NULL", not_null="seg IS NOT NULL", distinct_from="seg IS DISTINCT FROM 'MACHINERY'", same="bal IS NOT DISTINCT FROM NULL", some="bal > 500"))
def comparisons(spark, d):
    s, b = field("seg"), field("bal")
    two = ["MACHINERY", "FURNITURE"]
    return _counts(_nulled(spark, d), eq=s.eq("MACHINERY"), neq=s.neq("MACHINERY"), gt=b.gt(500), gte=b.gte(500), lt=b.lt(500), lte=b.lte(500), between=b.between(100, 900), in_=s.in_(two), not_in=s.not_in(two), in_empty=s.in_([]), not_in_empty=s.not_in([]), is_null=s.is_null(), not_null=s.is_not_null(), distinct_from=s.distinct_from("MACHINERY"), same=b.not_distinct_from(None), some=b.some().gt(500))


@query(_count_sql("part", contains="p_name ILIKE '%Re%'", starts="p_type ILIKE 'ST%'", ends="p_type ILIKE '%el'", contains_cs="contains(p_name, 'e')", starts_cs="starts_with(p_type, 'S')", ends_cs="ends_with(p_type, 'L')", iexact="lower(p_brand) = 'brand#11'",
    regex="regexp_matches(p_brand, '#[13]')", iregex="regexp_matches(p_brand, 'BRAND#2', 'i')", wild="contains(lower(p_name), '%')"))
def string_matching(spark, d):
    n, t, b = field("p_name"), field("p_type"), field("p_brand")
    return _counts(PART.table(spark, d), contains=n.contains("Re"), starts=t.starts_with("ST"), ends=t.ends_with("el"), contains_cs=n.contains_case_sensitive("e"), starts_cs=t.starts_with_case_sensitive("S"), ends_cs=t.ends_with_case_sensitive("L"), iexact=b.iexact("Brand#11"), regex=b.regex("#[13]"), iregex=b.iregex("BRAND#2"), wild=n.contains("%"))


@query(_count_sql(_NULLED, both="seg = 'MACHINERY' AND bal > 500", either="seg = 'MACHINERY' OR bal > 500", either_one="(NOT (seg = 'MACHINERY') AND bal > 500) OR (seg = 'MACHINERY' AND NOT (bal > 500))", none_="true", nothing="false", excluded="NOT (seg = 'MACHINERY' AND bal > 500)", deep="(k = 1 OR (k = 2 AND NOT (bal < 300))) AND seg IS NOT NULL"))
def boolean_algebra(spark, d):
    s, b, k = field("seg").eq("MACHINERY"), field("bal").gt(500), field("k")
    return _counts(_nulled(spark, d), both=all_of(s, b), either=any_of(s, b), either_one=xor(s, b), none_=all_of(), nothing=any_of(), excluded=~all_of(s, b), deep=all_of(any_of(k.eq(1), all_of(k.eq(2), ~field("bal").lt(300))), field("seg").is_not_null()))


@query(_count_sql(_NULLED, neq="seg IS NULL OR seg <> 'MACHINERY'", neq_none="seg IS NOT NULL", in_none="seg IS NULL OR seg IN ('MACHINERY')", in_only_none="seg IS NULL", in_empty="false", not_in="seg IS NULL OR seg NOT IN ('MACHINERY')", not_in_none="seg IS NOT NULL AND seg NOT IN ('MACHINERY')", not_in_only_none="seg IS NOT NULL", not_in_empty="true", iexact="lower(seg) = 'machinery'", not_gt="NOT coalesce(bal > 500, false)"))
def portable_nulls(spark, d):
    s = portable("seg")
    return _counts(_nulled(spark, d), neq=s.neq("MACHINERY"), neq_none=s.neq(None), in_none=s.in_([None, "MACHINERY"]), in_only_none=s.in_([None]), in_empty=s.in_([]), not_in=s.not_in(["MACHINERY"]), not_in_none=s.not_in([None, "MACHINERY"]), not_in_only_none=s.not_in([None]), not_in_empty=s.not_in([]), iexact=s.iexact("MACHINERY"), not_gt=~portable("bal").gt(500))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 100 AND c_nationkey IN (1, 2, 3) AND NOT (lower(c_name) LIKE '%9%')")
def struct_filter(spark, d):
    return q(CUSTOMER, spark, d).filter_struct({"c_mktsegment": "BUILDING", "c_acctbal__gte": 100, "c_nationkey__in": [1, 2, 3]}).exclude_struct({"c_name__contains": "9"}).to_df().select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0")
def tenant_rows(spark, d):
    tenanted = Model("customer", CUSTOMER.columns, "c_custkey", tenant="c_nationkey")
    return tenanted.objects(spark.read.parquet(f"{d}/customer.parquet"), tenant=3).filter(field("c_acctbal").gt(0)).to_df().select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal * 2 > c_custkey * 3")
def expression_filter(spark, d):
    return q(CUSTOMER, spark, d).filter_expr(F.col("c_acctbal") * 2 > F.col("c_custkey") * 3).to_df().select("c_custkey")


# -- 2.4 scalar expressions


@query("""SELECT l_orderkey, l_linenumber, (l_orderkey // l_linenumber)::BIGINT AS whole, ((0 - l_orderkey) // 7)::BIGINT AS negative_floor, l_quantity / 4 AS part, (l_linenumber + 2) * 3 - 1 AS mixed, coalesce(nullif(l_returnflag, 'N'), 'none') AS flag,
 CASE WHEN l_quantity > 40 THEN 'large' WHEN l_quantity > 20 THEN 'medium' ELSE 'small' END AS size, strftime(l_shipdate + INTERVAL 36 HOUR, '%Y-%m-%d %H') AS later, (nullif(l_returnflag, 'N') IS DISTINCT FROM 'A') AS not_a FROM lineitem""")
def scalar_expressions(spark, d):
    df = LINEITEM.table(spark, d).withColumn("neg", -F.col("l_orderkey"))
    flag = F.nullif("l_returnflag", F.lit("N"))
    return df.select(
        "l_orderkey", "l_linenumber", expressions.divide(df, "l_orderkey", "l_linenumber").alias("whole"), expressions.int_div(F.col("neg"), F.lit(7)).alias("negative_floor"), (F.col("l_quantity") / 4).alias("part"), ((F.col("l_linenumber") + 2) * 3 - 1).alias("mixed"), F.coalesce(flag, F.lit("none")).alias("flag"),
        expressions.case((F.col("l_quantity") > 40, "large"), (F.col("l_quantity") > 20, "medium"), otherwise="small").alias("size"), F.date_format(F.col("l_shipdate") + expressions.interval(36 * 3600 * 10**6), "yyyy-MM-dd HH").alias("later"), field(flag).distinct_from("A").alias("not_a"),
    )


@query("SELECT o_orderkey, year(current_date)::INT - year(o_orderdate)::INT AS age, strftime(o_orderdate + INTERVAL 2 MONTH + INTERVAL 3 DAY, '%Y-%m-%d') AS due FROM orders")
def dates(spark, d):
    span = expressions.calendar_interval(months=2, days=3)
    return ORDERS.table(spark, d).select("o_orderkey", (expressions.current_year() - F.year("o_orderdate")).alias("age"), F.date_format(expressions.plus(F.col("o_orderdate").cast("timestamp"), span), "yyyy-MM-dd").alias("due"))


# -- 2.5 joins


@query("SELECT o_orderkey, c_name AS rel_o_custkey_c_name, n_name AS rel_c_nationkey_n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def select_related(spark, d):
    rows = q(ORDERS, spark, d).select_related("o_custkey", CUSTOMER.table(spark, d), "c_custkey")
    rows = joins.select_related(rows, "rel_o_custkey_c_nationkey", NATION.table(spark, d), "n_nationkey", "rel_c_nationkey_")
    return rows.select("o_orderkey", "rel_o_custkey_c_name", "rel_c_nationkey_n_name")


@query("SELECT n_nationkey, count(s_suppkey) AS suppliers, min(s_suppkey) AS first_supplier FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def prefetch(spark, d):
    rows = joins.prefetch(NATION.table(spark, d), "n_nationkey", SUPPLIER.table(spark, d), "s_nationkey")
    return rows.select("n_nationkey", F.size("children").cast("long").alias("suppliers"), F.get("children", F.lit(0))["s_suppkey"].alias("first_supplier"))


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def reverse_relation(spark, d):
    nations = q(NATION, spark, d).filter(n_regionkey=1).to_df()
    return joins.reverse(nations, "n_nationkey", SUPPLIER.table(spark, d), "s_nationkey").select("s_suppkey")


@query("SELECT p_partkey, s_suppkey AS target_s_suppkey, count(*) AS links, sum(l_quantity) AS qty FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")
def many_to_many(spark, d):
    rows = joins.many_to_many(PART.table(spark, d).select("p_partkey"), "p_partkey", LINEITEM.table(spark, d).select("l_partkey", "l_suppkey", "l_quantity"), "l_partkey", "l_suppkey", SUPPLIER.table(spark, d).select("s_suppkey"), "s_suppkey")
    return rows.groupBy("p_partkey", "target_s_suppkey").agg(F.count("*").alias("links"), F.sum("l_quantity").alias("qty"))


@query("SELECT o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' OR c_custkey IS NULL")
def relation_filter(spark, d):
    rows = q(ORDERS, spark, d).select_related("o_custkey", CUSTOMER.table(spark, d), "c_custkey")
    return rows.where((F.col("rel_o_custkey_c_mktsegment") == "BUILDING") | F.col("rel_o_custkey_c_custkey").isNull()).select("o_orderkey")


@query("SELECT a.n_nationkey AS l_n_nationkey, b.r_regionkey AS r_r_regionkey FROM nation a CROSS JOIN region b WHERE a.n_nationkey > 5 AND b.r_regionkey < 3")
def cross_join(spark, d):
    pairs = q(NATION, spark, d).cross_join_with(q(REGION, spark, d)).filter_left(F.col("n_nationkey") > 5).filter_right(F.col("r_regionkey") < 3)
    return pairs.to_df().select("l_n_nationkey", "r_r_regionkey")


@query("SELECT a.s_suppkey AS l_s_suppkey, b.s_suppkey AS r_s_suppkey, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY b.s_acctbal DESC, b.s_suppkey) AS place FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey AND a.s_nationkey = b.s_nationkey")
def self_pairs(spark, d):
    pairs = q(SUPPLIER, spark, d).self_pairs().where(F.col("l_s_nationkey") == F.col("r_s_nationkey")).to_df()
    w = Window.partitionBy("l_s_suppkey").orderBy(F.desc("r_s_acctbal"), "r_s_suppkey")
    return pairs.select("l_s_suppkey", "r_s_suppkey", F.row_number().over(w).alias("place"))


_VALUES = [("BUILDING", 1, "b"), ("MACHINERY", 2, "m"), ("NOPE", 3, "x")]


@query("SELECT c_custkey, v.k AS v_k, v.t AS v_t FROM customer JOIN (VALUES ('BUILDING', 1, 'b'), ('MACHINERY', 2, 'm'), ('NOPE', 3, 'x')) v(seg, k, t) ON c_mktsegment = v.seg")
def values_join(spark, d):
    v = tables.values(spark, _VALUES, "seg string, k int, t string")
    return q(CUSTOMER, spark, d).join_values(v, {"c_mktsegment": "seg"}).select("c_custkey", "v_k", "v_t")


@query("SELECT c_custkey, v.k AS v_k FROM customer LEFT JOIN (VALUES ('BUILDING', 1), ('MACHINERY', 2)) v(seg, k) ON c_mktsegment = v.seg ORDER BY c_custkey DESC LIMIT 40")
def values_left_join(spark, d):
    v = tables.values(spark, _VALUES[:2], "seg string, k int, t string")
    return q(CUSTOMER, spark, d).order_by("-c_custkey").limit(40).left_join_values(v, {"c_mktsegment": "seg"}).select("c_custkey", "v_k")


@query("SELECT c_custkey, v.k AS v_k FROM customer LEFT JOIN (VALUES ('BUILDING', 1), ('MACHINERY', 2)) v(seg, k) ON c_mktsegment = v.seg")
def values_left_join_whole(spark, d):
    v = tables.values(spark, _VALUES[:2], "seg string, k int, t string")
    return q(CUSTOMER, spark, d).left_join_values(v, {"c_mktsegment": "seg"}).select("c_custkey", "v_k")


@query("SELECT r_regionkey, v.k AS v_k FROM region CROSS JOIN (VALUES (1), (2), (NULL)) v(k)")
def values_cross_join(spark, d):
    return q(REGION, spark, d).cross_join_values(tables.values(spark, [(1,), (2,), (None,)], "k int")).select("r_regionkey", "v_k")


@query("SELECT c_custkey, o.o_orderkey AS r_o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) o")
def lateral_join(spark, d):
    return q(CUSTOMER, spark, d).join_lateral(ORDERS.table(spark, d), {"c_custkey": "o_custkey"}, ["-o_totalprice", "o_orderkey"], 2).select("c_custkey", "r_o_orderkey")


@query("SELECT c_custkey, o.o_orderkey AS r_o_orderkey, o.o_orderkey IS NOT NULL AS r_present FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100) c LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_orderkey LIMIT 1) o ON true")
def lateral_left_join(spark, d):
    outer = q(CUSTOMER, spark, d).order_by("-c_acctbal", "c_custkey").limit(100)
    return outer.join_lateral(ORDERS.table(spark, d), {"c_custkey": "o_custkey"}, ["o_orderkey"], 1, left=True).select("c_custkey", "r_o_orderkey", "r_present")


@query("SELECT c_custkey, o.o_orderkey AS r_o_orderkey, o.o_orderkey IS NOT NULL AS r_present FROM customer c LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_orderkey LIMIT 1) o ON true")
def lateral_left_join_whole(spark, d):
    return q(CUSTOMER, spark, d).join_lateral(ORDERS.table(spark, d), {"c_custkey": "o_custkey"}, ["o_orderkey"], 1, left=True).select("c_custkey", "r_o_orderkey", "r_present")


# -- 2.6 subqueries


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def exists_rows(spark, d):
    failed = q(ORDERS, spark, d).filter(o_orderstatus="F").to_df().select(F.col("o_custkey").alias("c_custkey"))
    return q(CUSTOMER, spark, d).where_exists(failed, ["c_custkey"]).to_df().select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def not_exists_rows(spark, d):
    placed = ORDERS.table(spark, d).select(F.col("o_custkey").alias("c_custkey"))
    return q(CUSTOMER, spark, d).where_exists(placed, ["c_custkey"], negate=True).to_df().select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def in_subquery(spark, d):
    inner = q(LINEITEM, spark, d).filter(field("l_quantity").gt(49)).selecting("l_partkey")
    return subqueries.in_(PART.table(spark, d), "p_partkey", inner).select("p_partkey")


@query("""SELECT 'plain' AS kind, count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) UNION ALL
 SELECT 'null', count(*) FROM part WHERE p_partkey NOT IN (SELECT nullif(l_partkey, 1) FROM lineitem) UNION ALL SELECT 'empty', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 0)""")
def not_in_subquery(spark, d):
    part, line = PART.table(spark, d).select("p_partkey"), LINEITEM.table(spark, d)
    sets = {"plain": line.where("l_quantity > 49").select("l_partkey"), "null": line.select(F.nullif("l_partkey", F.lit(1).cast("long"))), "empty": line.where("l_quantity < 0").select("l_partkey")}
    out = [subqueries.not_in(part, "p_partkey", s).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, s in sets.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS best FROM customer")
def scalar_subquery(spark, d):
    return subqueries.scalar(CUSTOMER.table(spark, d), "best", ORDERS.table(spark, d), F.max("o_totalprice"), {"c_custkey": "o_custkey"}).select("c_custkey", "best")


def _quantified_sql() -> str:
    sets = {"plain": "SELECT p_size FROM part WHERE p_size BETWEEN 10 AND 20", "nulls": "SELECT nullif(p_size, 15) FROM part WHERE p_size BETWEEN 10 AND 20", "empty": "SELECT p_size FROM part WHERE p_size < 0", "constant": "SELECT 7"}
    tests = [(o, w) for o in (">", ">=", "<", "<=") for w in ("ANY", "ALL")] + [("=", "ALL")]
    parts = [f"SELECT '{k} {o} {w.lower()}' AS test, x.k, x.k {o} {w} ({s}) AS result FROM (SELECT DISTINCT nullif(p_size, 3) AS k FROM part) x" for k, s in sets.items() for o, w in tests]
    return " UNION ALL ".join(parts)


@query(_quantified_sql())
def any_all(spark, d):
    part = PART.table(spark, d)
    x = part.select(F.nullif("p_size", F.lit(3)).alias("k")).distinct()
    some = part.where("p_size between 10 and 20")
    sets = {"plain": some.select("p_size"), "nulls": some.select(F.nullif("p_size", F.lit(15))), "empty": part.where("p_size < 0").select("p_size"), "constant": spark.range(1).select(F.lit(7))}
    tests = [(o, w) for o in (">", ">=", "<", "<=") for w in ("any", "all")] + [("=", "all")]
    out = None
    for name, s in sets.items():
        rows = x
        for o, w in tests:
            rows = subqueries.compare(rows, f"{name} {o} {w}", "k", o, w, s)
        long = rows.select("k", F.inline(F.array(*[F.struct(F.lit(f"{name} {o} {w}").alias("test"), F.col(f"`{name} {o} {w}`").alias("result")) for o, w in tests])))
        out = long if out is None else out.unionByName(long)
    return out.select("test", "k", "result")


# -- 2.7 aggregation


@query("""SELECT count(*) AS rows, count(seg) AS segs, count(DISTINCT seg) AS kinds, sum(k)::INT AS total, avg(bal) AS mean, min(bal) AS low, max(bal) AS high, count(*) FILTER (WHERE bal > 500) AS rich, sum(k) FILTER (WHERE bal > 500)::INT AS rich_total FROM """ + _NULLED)
def whole_table_aggregates(spark, d):
    df = _nulled(spark, d)
    rich = F.col("bal") > 500
    return df.agg(F.count("*").alias("rows"), agg.count("seg").alias("segs"), agg.count_distinct(F.col("seg")).alias("kinds"), agg.sum_(df, "k").alias("total"), agg.avg(F.col("bal")).alias("mean"), F.min("bal").alias("low"), F.max("bal").alias("high"), F.count(agg.where(rich)).alias("rich"), agg.sum_(df, "k", rich).alias("rich_total"))


@query("""SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss, round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs, round(covar_pop(l_quantity, l_tax), 6) AS cp, round(covar_samp(l_quantity, l_tax), 6) AS cs, round(corr(l_quantity, l_tax), 6) AS co FROM lineitem GROUP BY l_returnflag""")
def statistics(spark, d):
    r = lambda c: F.round(c, 6)
    y, x = "l_quantity", "l_tax"
    return LINEITEM.table(spark, d).groupBy("l_returnflag").agg(r(agg.stddev_pop(y)).alias("sp"), r(agg.stddev(y)).alias("ss"), r(agg.var_pop(y)).alias("vp"), r(agg.variance(y)).alias("vs"), r(agg.covar_pop(y, x)).alias("cp"), r(agg.covar_samp(y, x)).alias("cs"), r(agg.corr(y, x)).alias("co"))


_REGR = "avgx avgy count intercept r2 slope sxx sxy syy".split()


@query("SELECT l_linestatus, " + ", ".join(f"round(regr_{k}(l_extendedprice, l_quantity)::DOUBLE, 2) AS {k}" for k in _REGR) + " FROM lineitem GROUP BY l_linestatus")
def regression(spark, d):
    return LINEITEM.table(spark, d).groupBy("l_linestatus").agg(*[F.round(getattr(agg, f"regr_{k}")("l_extendedprice", "l_quantity").cast("double"), 2).alias(k) for k in _REGR])


@query("SELECT p_brand, bool_and(p_size > 1) AS all_big, bool_or(p_size > 49) AS any_huge, bool_and(p_retailprice > 0) AS priced, bit_and(p_size)::INT AS ba, bit_or(p_size)::INT AS bo, bit_xor(p_size)::INT AS bx FROM part GROUP BY p_brand")
def boolean_and_bit_aggregates(spark, d):
    return PART.table(spark, d).groupBy("p_brand").agg(agg.bool_and(F.col("p_size") > 1).alias("all_big"), agg.bool_or(F.col("p_size") > 49).alias("any_huge"), agg.every(F.col("p_retailprice") > 0).alias("priced"), agg.bit_and("p_size").alias("ba"), agg.bit_or("p_size").alias("bo"), agg.bit_xor("p_size").alias("bx"))


@query("""SELECT n_regionkey, array_agg(nullif(n_nationkey, 5) ORDER BY n_name) AS ids, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names, string_agg(DISTINCT substr(n_name, 1, 1), ',' ORDER BY substr(n_name, 1, 1)) AS initials,
 array_agg(DISTINCT n_nationkey % 2 ORDER BY n_nationkey % 2) AS parity FROM nation GROUP BY n_regionkey""")
def list_and_string_aggregates(spark, d):
    initial = F.substring("n_name", 1, 1)
    return NATION.table(spark, d).groupBy("n_regionkey").agg(agg.array_agg(F.nullif("n_nationkey", F.lit(5)), [F.col("n_name")]).alias("ids"), agg.string_agg(F.col("n_name"), "; ", [F.col("n_name")], descending=True).alias("names"), agg.string_agg(initial, ",", [initial], distinct=True).alias("initials"), agg.array_agg(F.col("n_nationkey") % 2, distinct=True).alias("parity"))


@query("""SELECT n_regionkey, '[' || string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) || ']' AS ids, '{' || string_agg('"' || n_nationkey || '":"' || n_name || '"', ',' ORDER BY n_nationkey::VARCHAR) || '}' AS names FROM nation GROUP BY n_regionkey""")
def json_aggregates(spark, d):
    return NATION.table(spark, d).groupBy("n_regionkey").agg(agg.json_agg(F.col("n_nationkey")).alias("ids"), agg.json_object_agg(F.col("n_nationkey"), F.col("n_name")).alias("names"))


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.9), 4) AS q9, round(quantile_cont(l_extendedprice, 0.8), 4) AS desc2, quantile_disc(l_quantity, 0.5) AS med, mode() WITHIN GROUP (ORDER BY l_linenumber)::INT AS mo FROM lineitem GROUP BY l_returnflag""")
def ordered_set_aggregates(spark, d):
    return LINEITEM.table(spark, d).groupBy("l_returnflag").agg(F.round(agg.percentile_cont("l_extendedprice", 0.25), 4).alias("q1"), F.round(agg.percentile_cont("l_extendedprice", 0.9), 4).alias("q9"), F.round(agg.percentile_cont("l_extendedprice", 0.2, descending=True), 4).alias("desc2"), agg.percentile_disc(F.col("l_quantity"), 0.5).alias("med"), agg.mode("l_linenumber").alias("mo"))


@query("""SELECT n_regionkey, quantile_disc(n_name, 0.5) AS middle, quantile_disc(n_name, 0.0) AS first FROM nation GROUP BY n_regionkey""")
def percentile_disc_of_text(spark, d):
    return NATION.table(spark, d).groupBy("n_regionkey").agg(agg.percentile_disc(F.col("n_name"), 0.5).alias("middle"), agg.percentile_disc(F.col("n_name"), 0.0).alias("first"))


@query(f"""SELECT seg, (count(*) FILTER (WHERE bal < 500) + 1)::BIGINT AS r, (count(DISTINCT k) FILTER (WHERE k < 3) + 1)::BIGINT AS dr, count(*) FILTER (WHERE bal < 500) / count(*)::DOUBLE AS pr, (count(*) FILTER (WHERE bal <= 500) + 1) / (count(*) + 1)::DOUBLE AS cd,
 (count(*) FILTER (WHERE bal > 500 OR bal IS NULL) + 1)::BIGINT AS rd FROM {_NULLED} GROUP BY seg""")
def hypothetical_set_aggregates(spark, d):
    b = F.col("bal")
    return _nulled(spark, d).groupBy("seg").agg(agg.rank_of(500, b).alias("r"), agg.dense_rank_of(3, F.col("k")).alias("dr"), agg.percent_rank_of(500, b).alias("pr"), agg.cume_dist_of(500, b).alias("cd"), agg.rank_of(500, b, descending=True).alias("rd"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus, o_orderpriority)::BIGINT AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark, d):
    return q(ORDERS, spark, d).rollup("o_orderstatus", "o_orderpriority").annotate(n=F.count("*"), g=agg.grouping_of("o_orderstatus", "o_orderpriority")).to_df()


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus)::INT AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, d):
    return q(ORDERS, spark, d).cube("o_orderstatus", "o_orderpriority").annotate(n=F.count("*"), g=F.grouping("o_orderstatus").cast("int")).to_df()


@query("SELECT l_returnflag, l_linestatus, l_linenumber, sum(l_quantity) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
def grouping_sets(spark, d):
    return q(LINEITEM, spark, d).grouping_sets([["l_returnflag", "l_linestatus"], ["l_linenumber"], []], ["l_returnflag", "l_linestatus", "l_linenumber"]).annotate(qty=F.sum("l_quantity")).to_df()


@query("SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 8 ORDER BY total DESC, o_custkey LIMIT 20 OFFSET 5")
def grouped_having_limit(spark, d):
    out = q(ORDERS, spark, d).group_by("o_custkey").annotate(n=F.count("*"), total=F.sum("o_totalprice"))
    return out.having(F.col("n") > 8).order_by("-total", "o_custkey").offset(5).limit(20).to_df()


@query("SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def group_by_expression(spark, d):
    return q(ORDERS, spark, d).group_by(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"), "o_orderpriority").annotate(n=F.count("*")).to_df()


# -- 2.8 windows, ordering, limits


@query("""SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER p AS rk, dense_rank() OVER p AS dr, round(percent_rank() OVER p, 9) AS pr, round(cume_dist() OVER p, 9) AS cd, ntile(4) OVER w::INT AS nt FROM orders
 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def ranking(spark, d):
    w, p = windows.over("o_custkey", ["o_totalprice", "o_orderkey"]).spec(), windows.over("o_custkey", ["o_orderpriority"]).spec()
    return q(ORDERS, spark, d).annotate(rn=windows.row_number().over(w), rk=windows.rank().over(p), dr=windows.dense_rank().over(p), pr=F.round(windows.percent_rank().over(p), 9), cd=F.round(windows.cume_dist().over(p), 9), nt=windows.ntile(4).over(w)).to_df().select("o_orderkey", "rn", "rk", "dr", "pr", "cd", "nt")


@query("""SELECT o_orderkey, lead(o_totalprice, 1) OVER w AS ld, lag(o_totalprice, 2) OVER w AS lg, first_value(o_orderkey) OVER w AS fv, last_value(o_orderkey) OVER w AS lv, nth_value(o_orderkey, 2) OVER w AS nv FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)""")
def offsets(spark, d):
    w = windows.over("o_custkey", ["o_totalprice", "o_orderkey"]).spec()
    return q(ORDERS, spark, d).annotate(ld=windows.lead("o_totalprice", 1).over(w), lg=windows.lag("o_totalprice", 2).over(w), fv=windows.first_value("o_orderkey").over(w), lv=windows.last_value("o_orderkey").over(w), nv=windows.nth_value("o_orderkey", 2).over(w)).to_df().select("o_orderkey", "ld", "lg", "fv", "lv", "nv")


@query("""SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rows_sum, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS range_sum,
 max(l_quantity) OVER (PARTITION BY l_orderkey) AS whole FROM lineitem""")
def frames(spark, d):
    w = windows.over("l_orderkey", ["l_linenumber"])
    exact = windows.over("l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    return LINEITEM.table(spark, d).select("l_orderkey", "l_linenumber", F.sum("l_quantity").over(exact.rows(-2, 0).spec()).alias("rows_sum"), F.sum("l_quantity").over(w.range(-1, 1).spec()).alias("range_sum"), F.max("l_quantity").over(windows.over("l_orderkey").spec()).alias("whole"))


_FRAMES = [("g", "groups", -1, 1, "no others"), ("gc", "groups", -1, 1, "current row"), ("gg", "groups", -1, 1, "group"), ("gt", "groups", -1, 1, "ties"), ("rc", "rows", None, None, "current row"), ("rt", "rows", -2, 2, "ties")]


def _frames_sql() -> str:
    edge = lambda n, side: f"UNBOUNDED {side}" if n is None else "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"
    cols = [f"{fn}({v}) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority{', o_orderkey' if kind == 'rows' else ''} {kind.upper()} BETWEEN {edge(a, 'PRECEDING')} AND {edge(b, 'FOLLOWING')} EXCLUDE {x.upper()}) AS {n}_{fn}" for n, kind, a, b, x in _FRAMES for fn, v in (("sum", "p"), ("min", "p"), ("count", "p"))]
    return f"SELECT o_orderkey, {', '.join(cols)} FROM (SELECT *, round(o_totalprice)::BIGINT AS p FROM orders)"


@query(_frames_sql())
def groups_and_exclude(spark, d):
    df = ORDERS.table(spark, d).select("o_orderkey", "o_custkey", "o_orderpriority", F.round("o_totalprice").cast("long").alias("p"))
    for n, kind, a, b, x in _FRAMES:
        w = windows.Over(("o_custkey",), ("o_orderpriority", "o_orderkey") if kind == "rows" else ("o_orderpriority",), kind, a, b, x)
        for fn in ("sum", "min", "count"):
            df = windows.with_frame(df, f"{n}_{fn}", fn, F.col("p"), w)
    return df.drop("o_custkey", "o_orderpriority", "p")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def qualify_top3(spark, d):
    w = windows.over("o_custkey", ["-o_totalprice", "o_orderkey"]).spec()
    return q(ORDERS, spark, d).qualify(F.col("place") <= 3, place=windows.row_number().over(w)).to_df().select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, count(DISTINCT o_orderpriority) OVER (PARTITION BY c_nationkey)::BIGINT AS kinds FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 10 < 10")
def distinct_over(spark, d):
    rows = CUSTOMER.table(spark, d).join(ORDERS.table(spark, d), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("c_custkey", windows.count_distinct_over(F.col("o_orderpriority"), windows.over("c_nationkey").spec()).alias("kinds"))


@query(f"""SELECT c_custkey, row_number() OVER (ORDER BY bal ASC NULLS LAST, c_custkey) AS a, row_number() OVER (ORDER BY bal DESC NULLS FIRST, c_custkey) AS b, row_number() OVER (ORDER BY bal ASC NULLS FIRST, c_custkey) AS c, row_number() OVER (ORDER BY bal DESC NULLS LAST, c_custkey) AS e FROM (SELECT * FROM {_NULLED} ORDER BY c_custkey LIMIT 300)""")
def null_placement(spark, d):
    rows = QuerySet(None, _nulled(spark, d)).order_by("c_custkey").limit(300).to_df()
    place = lambda o: F.row_number().over(windows.over((), [o, "c_custkey"]).spec())
    return rows.select("c_custkey", place(asc("bal")).alias("a"), place(desc("bal")).alias("b"), place(asc("bal").nulls_first()).alias("c"), place(desc("bal").nulls_last()).alias("e"))


@query(f"""SELECT c_custkey, row_number() OVER (ORDER BY bal ASC NULLS LAST, c_custkey) AS a, row_number() OVER (ORDER BY bal DESC NULLS FIRST, c_custkey) AS b, row_number() OVER (ORDER BY bal ASC NULLS FIRST, c_custkey) AS c, row_number() OVER (ORDER BY bal DESC NULLS LAST, c_custkey) AS e FROM {_NULLED}""")
def null_placement_whole(spark, d):
    place = lambda o: F.row_number().over(windows.over((), [o, "c_custkey"]).spec())
    return _nulled(spark, d).select("c_custkey", place(asc("bal")).alias("a"), place(desc("bal")).alias("b"), place(asc("bal").nulls_first()).alias("c"), place(desc("bal").nulls_last()).alias("e"))


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 25 OFFSET 10")
def limit_offset(spark, d):
    return q(ORDERS, spark, d).order_by("-o_totalprice", "o_orderkey").limit(25).offset(10).to_df().select("o_orderkey")


@query("SELECT l_s_suppkey, r_s_suppkey, place FROM (SELECT a.s_suppkey AS l_s_suppkey, b.s_suppkey AS r_s_suppkey, rank() OVER (PARTITION BY a.s_suppkey ORDER BY abs(a.s_acctbal - b.s_acctbal), b.s_suppkey) AS place FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey AND a.s_nationkey = b.s_nationkey) WHERE place <= 2")
def pair_windows(spark, d):
    pairs = q(SUPPLIER, spark, d).self_pairs().where(F.col("l_s_nationkey") == F.col("r_s_nationkey")).to_df()
    w = Window.partitionBy("l_s_suppkey").orderBy(F.abs(F.col("l_s_acctbal") - F.col("r_s_acctbal")), "r_s_suppkey")
    return windows.qualify(pairs, F.col("place") <= 2, place=F.rank().over(w)).select("l_s_suppkey", "r_s_suppkey", "place")


# -- 2.9 set operations, arrays, JSON, ranges


def _keys(spark, d, low: int, high: int) -> QuerySet:
    return QuerySet(None, q(PART, spark, d).filter(field("p_size").between(low, high)).to_df().select("p_brand", "p_size"))


def _arm(low: int, high: int) -> str:
    return f"(SELECT p_brand, p_size FROM part WHERE p_size BETWEEN {low} AND {high})"


@query(f"{_arm(1, 20)} UNION {_arm(15, 40)}")
def union_distinct(spark, d):
    return _keys(spark, d, 1, 20).union(_keys(spark, d, 15, 40)).to_df()


@query(f"{_arm(1, 5)} UNION ALL {_arm(4, 9)}")
def union_all(spark, d):
    return _keys(spark, d, 1, 5).union_all(_keys(spark, d, 4, 9)).to_df()


@query(f"{_arm(1, 20)} INTERSECT {_arm(15, 40)}")
def intersect(spark, d):
    return _keys(spark, d, 1, 20).intersect(_keys(spark, d, 15, 40)).to_df()


@query(f"{_arm(1, 20)} EXCEPT {_arm(15, 40)}")
def except_rows(spark, d):
    return _keys(spark, d, 1, 20).except_(_keys(spark, d, 15, 40)).to_df()


@query(f"SELECT * FROM (({_arm(1, 10)} UNION {_arm(30, 40)}) INTERSECT (SELECT * FROM {_arm(5, 35)} ORDER BY p_size DESC, p_brand LIMIT 400)) ORDER BY p_size, p_brand LIMIT 60")
def nested_set_operations(spark, d):
    arm = _keys(spark, d, 5, 35).order_by("-p_size", "p_brand").limit(400)
    return _keys(spark, d, 1, 10).union(_keys(spark, d, 30, 40)).intersect(arm).order_by("p_size", "p_brand").limit(60).to_df()


@query("SELECT s_suppkey AS id, s_name AS label FROM supplier UNION SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 9000")
def cross_model_union(spark, d):
    rich = q(CUSTOMER, spark, d).filter(field("c_acctbal").gt(9000)).to_df().select("c_custkey", "c_name")
    return setops.combine_as("union", SUPPLIER.table(spark, d).select("s_suppkey", "s_name"), rich, ["id", "label"])


_SHORT = "SELECT vec_id, [label, (vec_id % 5)::INT, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE (vec_id % 7)::INT END] AS a FROM embeddings"


@query(f"""SELECT vec_id, list_has_all(a, [1, 2]) AS has, list_has_all([0, 1, 2, 3, 4, 5, 6, 7, 8, 9], a) AND NOT list_contains(list_transform(a, lambda x: x IS NULL), true) AS within, list_has_any(a, [3, 4]) AS meets, CASE WHEN len(a) > 0 THEN len(a)::INT END AS n, len(a) = 0 AS empty FROM ({_SHORT})""")
def array_predicates(spark, d):
    v = F.col("vec_id")
    a = F.array("label", (v % 5).cast("int"), F.when(v % 3 != 0, (v % 7).cast("int")))
    lits = lambda *x: F.array(*map(F.lit, x))
    return EMBEDDINGS.table(spark, d).select("vec_id", arrays.contains(a, lits(1, 2)).alias("has"), arrays.contained_by(a, lits(*range(10))).alias("within"), arrays.overlap(a, lits(3, 4)).alias("meets"), expressions.array_length(a).alias("n"), expressions.is_empty(a).alias("empty"))


@query("""SELECT event_id, (props ->> '$.k')::BIGINT AS k, coalesce((props ->> '$.k')::BIGINT > 50, false) AS big, coalesce((props ->> '$.k')::BIGINT IN (1, 2, 3), false) AS few, (props ->> '$.none') IS NULL AS absent FROM events""")
def json_typed_path(spark, d):
    k = jsons.typed(F.col("props"), "k", kind="int")
    return EVENTS.table(spark, d).select("event_id", k.alias("k"), F.coalesce(k > 50, F.lit(False)).alias("big"), F.coalesce(k.isin(1, 2, 3), F.lit(False)).alias("few"), jsons.typed(F.col("props"), "none").isNull().alias("absent"))


_DOCS = [(1, '{"a": null, "b": 5, "c": [1, 2, {"x": "y"}], "d": {"k": 1}, "s": "t", "f": true}'), (2, '{"b": "5", "c": [], "d": [1], "s": 1.5}'), (3, '{"a": 0, "b": 12.50, "c": {"k": 1}, "f": false}'), (4, None), (5, "[1, 2]")]
_JSON_EXPECTED = {
    "a exists": [1, 3], "a missing": [2, 4, 5], "a null": [1], "a not null": [3], "b number": [1, 3], "b string": [2], "c array": [1, 2], "d object": [1], "f bool": [1, 3], "d has k": [1], "d any": [1], "d all": [], "eq_json": [1], "neq_json": [2, 3],
    "contains 2": [1], "contains obj": [1], "len = 0": [2], "len > 2": [1], "len <= 3": [1, 2], "b eq 5": [1], "b neq 5": [3], "b gt 5": [3], "b between": [1, 3], "b in": [1], "b not in": [3], "b in empty": [], "b not in empty": [1, 3], "s eq t": [1], "f eq true": [1],
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::BIGINT[])" for k, v in _JSON_EXPECTED.items()) + ") t(predicate, ids)")
def json_untyped(spark, d):
    """Untyped predicates on hand-made documents; the SQL states the known answers."""
    df = tables.values(spark, _DOCS, "id long, j string")
    p = lambda *parts: jsons.Path(F.col("j"), *parts)
    a, b, c, e, s, f = (p(x) for x in "abcdsf")
    tests = {
        "a exists": a.exists(), "a missing": a.missing(), "a null": a.is_json_null(), "a not null": a.is_not_json_null(), "b number": b.is_number(), "b string": b.is_type("string"), "c array": c.is_array(), "d object": e.is_object(), "f bool": f.is_bool(), "d has k": e.has_key("k"), "d any": e.has_any_key("z", "k"), "d all": e.has_all_keys("k", "z"),
        "eq_json": c.eq_json([1, 2, {"x": "y"}]), "neq_json": c.neq_json([1, 2, {"x": "y"}]), "contains 2": c.array_contains(2), "contains obj": c.array_contains({"x": "y"}), "len = 0": c.array_len_eq(0), "len > 2": c.array_len_gt(2), "len <= 3": c.array_len_lte(3), "b eq 5": b.eq(5), "b neq 5": b.neq(5), "b gt 5": b.gt(5),
        "b between": b.between(5, 13), "b in": b.in_([5, 6]), "b not in": b.not_in([5, 6]), "b in empty": b.in_([]), "b not in empty": b.not_in([]), "s eq t": s.eq("t"), "f eq true": f.eq(True),
    }
    rows = df.select("id", F.inline(F.array(*[F.struct(F.lit(k).alias("predicate"), t.alias("ok")) for k, t in tests.items()])))
    return rows.groupBy("predicate").agg(F.array_sort(F.collect_list(F.when(F.col("ok"), F.col("id")))).alias("ids"))


@query("SELECT count(*) FILTER (WHERE (props ->> '$.k')::INT > 10) AS n, count(*) FILTER (WHERE json_exists(props, '$.k')) AS present FROM events")
def json_portable_scan(spark, d):
    k = jsons.Path(F.col("props"), "k")
    return EVENTS.table(spark, d).agg(F.count_if(k.gt(10)).alias("n"), F.count_if(k.exists()).alias("present"))


@query("""WITH r AS (SELECT p_partkey, p_size AS lo, p_size + (p_partkey % 9)::INT AS hi FROM part) SELECT p_partkey, hi > lo AND lo <= 12 AND 12 < hi AS elem, hi > lo AND lo <= 10 AND 15 <= hi AS has, hi = lo OR (lo >= 10 AND hi <= 30) AS within, hi > lo AND lo < 30 AND 10 < hi AS meets,
 hi > lo AND hi <= 10 AS before, hi > lo AND lo >= 30 AS after, hi > lo AND hi <= 30 AS left_of, hi > lo AND lo >= 10 AS right_of, hi > lo AND (hi = 10 OR lo = 30) AS next_to, hi = lo AS empty FROM r""")
def range_predicates(spark, d):
    lo = F.col("p_size")
    r = ranges.make(lo, lo + (F.col("p_partkey") % 9).cast("int"), discrete=True)
    df = PART.table(spark, d).select("p_partkey", r.alias("r"))
    r, c, small = F.col("r"), ranges.make(F.lit(10), F.lit(29), "[]", discrete=True), ranges.make(F.lit(10), F.lit(15), discrete=True)
    return df.select("p_partkey", ranges.contains_element(r, F.lit(12)).alias("elem"), ranges.contains(r, small).alias("has"), ranges.contained_by(r, c).alias("within"), ranges.overlaps(r, c).alias("meets"), ranges.strictly_left(r, c).alias("before"), ranges.strictly_right(r, c).alias("after"), ranges.not_extends_right(r, c).alias("left_of"), ranges.not_extends_left(r, c).alias("right_of"), ranges.adjacent(r, c).alias("next_to"), r["empty"].alias("empty"))


# -- 2.10 text search


@query()
def full_text_search(spark, d):
    rows = CONVERSATIONS.table(spark, d)
    tokens = texts.vector(F.col("text"))
    found = rows.withColumn("tokens", tokens).where(texts.matches(F.col("tokens"), "(the & then) | !a"))
    return found.select("conv_id", "turn", F.round(texts.rank(F.col("tokens"), ["the", "then", "ering"]), 6).alias("rank"), F.round(texts.rank_cover(F.col("tokens"), ["ering", "tion"]), 6).alias("cover"))


_TRI = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""WITH t AS (SELECT p_partkey, {_TRI.format("p_name")} AS a, {_TRI.format("'blue green part 7'")} AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE, 6) AS similarity FROM t""")
def trigram_similarity(spark, d):
    return PART.table(spark, d).select("p_partkey", F.round(texts.similarity(F.col("p_name"), F.lit("blue green part 7")), 6).alias("similarity"))


@query(f"""WITH t AS (SELECT n_nationkey, {_TRI.format("n_name")} AS a, {_TRI.format("'nation 1'")} AS b FROM nation) SELECT n_nationkey FROM t WHERE len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE >= 0.3""")
def trigram_match(spark, d):
    return NATION.table(spark, d).where(texts.similar(F.col("n_name"), F.lit("nation 1"))).select("n_nationkey")


# -- 2.11 CTEs, recursion, graph


@query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY 1) SELECT o_custkey, n FROM per WHERE n > 1")
def cte_terms(spark, d):
    big = q(ORDERS, spark, d).filter(field("o_totalprice").gt(200000)).to_df()
    return tables.raw(spark, "WITH per AS (SELECT o_custkey, count(*) AS n FROM {big} GROUP BY 1) SELECT o_custkey, n FROM per WHERE n > 1", big=big)


def _tree(spark, d) -> DataFrame:
    """Customers as a tree: the parent of n is n div 3 (1 is the root)."""
    k = F.col("c_custkey")
    return CUSTOMER.table(spark, d).where("c_custkey > 0").select(k.alias("id"), F.when(k > 1, F.greatest(F.lit(1), F.expr("c_custkey div 3"))).alias("parent_id"), F.col("c_acctbal").alias("bal"))


_TREE = "(SELECT c_custkey AS id, CASE WHEN c_custkey > 1 THEN greatest(1, c_custkey // 3) END AS parent_id, c_acctbal AS bal FROM customer WHERE c_custkey > 0)"


@query(f"WITH RECURSIVE t AS {_TREE}, w AS (SELECT id, 0 AS depth FROM t WHERE id = 1 UNION ALL SELECT t.id, w.depth + 1 FROM w JOIN t ON t.parent_id = w.id WHERE t.bal > -500) SELECT id, depth::INT AS depth FROM w")
def tree_descendants(spark, d):
    return graph.descendants(_tree(spark, d), "id", "parent_id", 1, keep=F.col("bal") > -500, max_depth=40).select("id", "depth")


@query(f"WITH RECURSIVE t AS {_TREE}, s AS (SELECT max(id) AS id FROM t), w AS (SELECT t.id, t.parent_id, 0 AS depth, []::VARCHAR[] AS path FROM t JOIN s USING (id) UNION ALL SELECT t.id, t.parent_id, w.depth + 1, w.path || ['parent_id'] FROM w JOIN t ON t.id = w.parent_id) SELECT id, depth::INT AS depth, path FROM w")
def tree_ancestors(spark, d):
    t = _tree(spark, d)
    last = t.agg(F.max("id")).first()[0]
    return graph.ancestors(t, "id", "parent_id", last).select("id", "depth", "path")


def _pedigree(spark, d) -> DataFrame:
    """Suppliers as a pedigree of two edges: mother n div 2, father n div 3 (none below 1)."""
    k = F.col("s_suppkey")
    half, third = F.expr("s_suppkey div 2"), F.expr("s_suppkey div 3")
    return SUPPLIER.table(spark, d).where("s_suppkey > 0").select(k.alias("id"), F.when(half > 0, half).alias("mother_id"), F.when(third > 0, third).alias("father_id"))


_PED = "(SELECT s_suppkey AS id, nullif(s_suppkey // 2, 0) AS mother_id, nullif(s_suppkey // 3, 0) AS father_id FROM supplier WHERE s_suppkey > 0)"
_EDGE = f"(SELECT id AS child, mother_id AS parent, 'mother_id' AS label FROM {_PED} WHERE mother_id IS NOT NULL UNION ALL SELECT id, father_id, 'father_id' FROM {_PED} WHERE father_id IS NOT NULL)"


@query(f"WITH RECURSIVE e AS {_EDGE}, w AS (SELECT max(id) AS id, 0 AS depth, []::VARCHAR[] AS path FROM {_PED} UNION ALL SELECT e.parent, w.depth + 1, w.path || [e.label] FROM w JOIN e ON e.child = w.id) SELECT id, depth::INT AS depth, path FROM w")
def full_ancestors(spark, d):
    t = _pedigree(spark, d)
    last = t.agg(F.max("id")).first()[0]
    return graph.full_ancestors(t, "id", ["mother_id", "father_id"], last, max_depth=60).select("id", "depth", "path")


@query(f"WITH RECURSIVE e AS {_EDGE}, w AS (SELECT id AS src, id AS anc, 0 AS depth FROM {_PED} UNION ALL SELECT w.src, e.parent, w.depth + 1 FROM w JOIN e ON e.child = w.anc) SELECT src, anc, depth::INT AS depth, count(*) AS path_count FROM w GROUP BY ALL")
def transitive_closure(spark, d):
    return graph.closure(_pedigree(spark, d), "id", ["mother_id", "father_id"])


@query(f"""WITH RECURSIVE e AS {_EDGE}, w AS (SELECT id AS src, id AS anc, 0 AS depth FROM {_PED} UNION ALL SELECT w.src, e.parent, w.depth + 1 FROM w JOIN e ON e.child = w.anc), c AS (SELECT src, anc, depth, count(*) AS n FROM w GROUP BY ALL),
 p AS (SELECT a.id AS l_id, b.id AS r_id FROM {_PED} a, {_PED} b WHERE a.id <> b.id AND a.id <= 30 AND b.id <= 30) SELECT l_id, r_id, round(coalesce((SELECT sum(x.n * y.n * 0.5::DOUBLE ** (x.depth + y.depth + 1)) FROM c x JOIN c y ON x.anc = y.anc WHERE x.src = l_id AND y.src = r_id), 0), 9) AS kinship FROM p""")
def kinship(spark, d):
    t = _pedigree(spark, d)
    pairs = joins.Pairs(t, t, "id", "id", drop_equal=True).filter_left(F.col("id") <= 30).filter_right(F.col("id") <= 30)
    found = joins.kinship(pairs, graph.closure(t.where("id <= 30"), "id", ["mother_id", "father_id"]))
    return found.select("l_id", "r_id", F.round("kinship", 9).alias("kinship"))


@query()
def kinship_whole(spark, d):
    """All pairs; no SQL, tests compare with brute force."""
    t = _pedigree(spark, d)
    ids = t.select("id")
    return joins.kinship(joins.Pairs(ids, ids, "id", "id", drop_equal=True), graph.closure(t, "id", ["mother_id", "father_id"]), digits=9)


@query(f"""WITH RECURSIVE t AS {_TREE}, c AS (SELECT id, parent_id FROM t WHERE id = 1 UNION ALL SELECT t.id, t.parent_id FROM t JOIN c ON t.parent_id = c.id) SELECT id, parent_id FROM c""")
def recursive_cte(spark, d):
    t = _tree(spark, d).select("id", "parent_id")
    return graph.recursive_term(t.where("id = 1"), t, ("parent_id", "id"))


@query("SELECT * FROM (VALUES (1, 2, false), (2, 3, false), (3, 1, false), (1, 2, true)) t(id, next_id, is_cycle)")
def recursive_cte_cycle(spark, d):
    t = tables.values(spark, [(1, 2), (2, 3), (3, 1), (9, 9)], "id int, next_id int")
    return graph.recursive_term(t.where("id = 1"), t, ("id", "next_id"), cycle_key="id")


# -- 2.12 spatial


def _points(spark, d) -> DataFrame:
    """Events at made-up places: longitude from the user, latitude from the event."""
    return EVENTS.table(spark, d).select("event_id", "event_type", "user_id", (F.col("user_id") % 360 - 180 + F.lit(0.25)).cast("double").alias("lon"), ((F.col("event_id") * 7) % 170 - 85 + F.lit(0.5)).cast("double").alias("lat"))


_POINTS = "(SELECT event_id, event_type, user_id, (user_id % 360 - 180 + 0.25)::DOUBLE AS lon, ((event_id * 7) % 170 - 85 + 0.5)::DOUBLE AS lat FROM events)"
_HAVERSINE = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin((radians(lat) - radians(48.5)) / 2), 2) + cos(radians(48.5)) * cos(radians(lat)) * pow(sin(radians(lon - 2.25) / 2), 2))))"


@query(f"SELECT event_id, round({_HAVERSINE} / 1000, 3) AS km FROM {_POINTS} WHERE {_HAVERSINE} <= 3000000")
def within_distance(spark, d):
    here, p = geo.point(F.lit(2.25), F.lit(48.5)), geo.point(F.col("lon"), F.col("lat"))
    return _points(spark, d).where(geo.within_km(p, here, 3000)).select("event_id", F.round(geo.distance_m(p, here) / 1000, 3).alias("km"))


@query(f"SELECT event_id FROM {_POINTS} ORDER BY round({_HAVERSINE}, 3), event_id LIMIT 40")
def nearest(spark, d):
    p = _points(spark, d)
    return p.withColumn("m", F.round(geo.distance_m(geo.point(F.col("lon"), F.col("lat")), geo.point(F.lit(2.25), F.lit(48.5))), 3)).orderBy("m", "event_id").limit(40).select("event_id")


_SQUARES = {"a": (-60, -30, 20, 40), "b": (0, 10, 90, 80), "c": (100, -80, 170, 0)}


@query(f"SELECT event_id, lon > -60 AND lon < 20 AND lat > -30 AND lat < 40 AS inside, lon BETWEEN -10 AND 30 AND lat BETWEEN -10 AND 30 AS boxed FROM {_POINTS}")
def point_in_polygon(spark, d):
    w, s, e, n = _SQUARES["a"]
    square = F.array(geo.ring([(w, s), (e, s), (e, n), (w, n)]))
    p = geo.point(F.col("lon"), F.col("lat"))
    return _points(spark, d).select("event_id", geo.contains(square, p).alias("inside"), geo.bounded_by(p, -10, -10, 30, 30).alias("boxed"))


@query(f"SELECT region, count(*) AS n FROM {_POINTS} LEFT JOIN (VALUES " + ", ".join(f"('{k}', {w}, {s}, {e}, {n})" for k, (w, s, e, n) in _SQUARES.items()) + ") r(region, w, s, e, n) ON lon > w AND lon < e AND lat > s AND lat < n GROUP BY region")
def count_by_region(spark, d):
    shapes = [geo.ring([(w, s), (e, s), (e, n), (w, n)]) for w, s, e, n in _SQUARES.values()]
    regions = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.array(r).alias("shape")) for k, r in zip(_SQUARES, shapes, strict=True)])))
    return geo.by_region(_points(spark, d), "lon", "lat", regions, "name", "shape").groupBy("region").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES (true, false, false, 4.0, 1.0, 0.25)) t(meets, touches, within, area, shared, ratio)")
def shape_predicates(spark, d):
    """Two squares that overlap in a quarter; the SQL states the known answers."""
    a, b = geo.ring([(0, 0), (2, 0), (2, 2), (0, 2)]), geo.ring([(1, 1), (3, 1), (3, 3), (1, 3)])
    df = spark.range(1).select(a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    return df.select(geo.rings_intersect(a, b).alias("meets"), geo.rings_touch(a, b).alias("touches"), geo.ring_within(a, b).alias("within"), geo.area_deg2(a).alias("area"), geo.intersection_area(a, b).alias("shared"), geo.overlap_ratio(a, b).alias("ratio"))


@query(f"SELECT event_type, round(min(lon), 6) AS west, round(min(lat), 6) AS south, round(max(lon), 6) AS east, round(max(lat), 6) AS north, round(avg(lon), 6) AS clon, round(avg(lat), 6) AS clat, count(*) AS n FROM {_POINTS} GROUP BY event_type")
def spatial_aggregates(spark, d):
    out = _points(spark, d).groupBy("event_type").agg(*[F.round(c, 6).alias(n) for c, n in zip((F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")), ("west", "south", "east", "north"), strict=True)], geo.centroid("lon", "lat").alias("c"), F.size(geo.make_line(geo.point(F.col("lon"), F.col("lat")), F.col("event_id"))).cast("long").alias("n"))
    return out.select("event_type", "west", "south", "east", "north", F.round("c.lon", 6).alias("clon"), F.round("c.lat", 6).alias("clat"), "n")


@query()
def convex_hull(spark, d):
    return geo.convex_hull(_points(spark, d), "event_type", "lon", "lat")


@query(f"""WITH b AS (SELECT event_id, least(31, floor((lon + 180) / 360 * 32))::INT AS x, least(31, floor((lat + 90) / 180 * 32))::INT AS y FROM {_POINTS}), i AS (SELECT event_id, [(x >> 4) & 1, (y >> 4) & 1, (x >> 3) & 1, (y >> 3) & 1, (x >> 2) & 1, (y >> 2) & 1, (x >> 1) & 1, (y >> 1) & 1, x & 1, y & 1] AS t FROM b)
 SELECT event_id, substr('0123456789bcdefghjkmnpqrstuvwxyz', t[1] * 16 + t[2] * 8 + t[3] * 4 + t[4] * 2 + t[5] + 1, 1) || substr('0123456789bcdefghjkmnpqrstuvwxyz', t[6] * 16 + t[7] * 8 + t[8] * 4 + t[9] * 2 + t[10] + 1, 1) AS cell FROM i""")
def geohash_cells(spark, d):
    return _points(spark, d).select("event_id", geo.geohash(geo.point(F.col("lon"), F.col("lat")), 2).alias("cell"))


@query()
def proximity_clusters(spark, d):
    places = _points(spark, d).groupBy("lon", "lat").agg(F.min("event_id").alias("event_id"))
    return geo.cluster_by_proximity(places, "event_id", "lon", "lat", 111_320 * 1.2, 3)


# -- 2.13 streams


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' OR user_id = 7")
def delta_refresh(spark, d):
    rows = EVENTS.table(spark, d)
    t = refresh.tick(rows, "event_id", "ts", last=F.expr("timestamp_ntz'2024-01-15'"), tracked=rows.where("user_id = 7"))
    return t.rows.select("event_id")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def outbox_stream(spark, d):
    """Every event published once through a checkpointed stream, then counted where it arrived."""
    from millrace import runtime

    work = runtime.Workspace(spark, "outbox")
    rows = work.save(EVENTS.table(spark, d).select(F.col("event_id"), F.col("user_id").alias("row_id"), F.col("event_type").alias("action"), F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("created_at")))
    stream = outbox.events(spark, work._paths[id(rows)])
    outbox.publish(stream, f"{work.root}/checkpoint", outbox.to_table(f"{work.root}/out", f"{work.root}/failed")).awaitTermination()
    return spark.read.parquet(f"{work.root}/out").groupBy(F.col("action").alias("event_type")).agg(F.count("*").alias("n"))


# -- 2.14 writes


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 10 ELSE c_acctbal END AS bal FROM customer")
def update_rows(spark, d):
    after, _ = changes.update(CUSTOMER.table(spark, d), F.col("c_mktsegment") == "BUILDING", {"c_acctbal": changes.increment("c_acctbal", 10)})
    return after.select("c_custkey", F.col("c_acctbal").alias("bal"))


@query("SELECT c_custkey AS old_c_custkey, c_acctbal AS old_c_acctbal, -c_acctbal AS new_c_acctbal FROM customer WHERE c_acctbal < 0")
def update_returning_pairs(spark, d):
    return changes.returning_pairs(CUSTOMER.table(spark, d), F.col("c_acctbal") < 0, {"c_acctbal": -F.col("c_acctbal")}).select("old_c_custkey", "old_c_acctbal", "new_c_acctbal")


@query("SELECT 'kept' AS part, count(*) AS n FROM customer WHERE NOT (c_acctbal < 0) UNION ALL SELECT 'gone', count(*) FROM customer WHERE c_acctbal < 0")
def delete_rows(spark, d):
    kept, gone = changes.delete(CUSTOMER.table(spark, d), F.col("c_acctbal") < 0)
    return kept.agg(F.count("*").alias("n")).select(F.lit("kept").alias("part"), "n").unionByName(gone.agg(F.count("*").alias("n")).select(F.lit("gone").alias("part"), "n"))


_TARGET = "(SELECT s_suppkey AS id, s_name AS name, s_acctbal AS bal FROM supplier WHERE s_suppkey % 2 = 0)"
_SOURCE = "(SELECT s_suppkey AS id, upper(s_name) AS name, s_acctbal + 1 AS bal FROM supplier WHERE s_suppkey % 3 = 0)"


def _target_source(spark, d) -> tuple[DataFrame, DataFrame]:
    s = SUPPLIER.table(spark, d).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return s.where("id % 2 = 0"), s.where("id % 3 = 0").select("id", F.upper("name").alias("name"), (F.col("bal") + 1).alias("bal"))


@query(f"SELECT * FROM {_TARGET} UNION ALL SELECT * FROM {_SOURCE} s WHERE id NOT IN (SELECT id FROM {_TARGET})")
def insert_do_nothing(spark, d):
    t, s = _target_source(spark, d)
    return changes.insert_select(t, s, {"id": "id", "name": "name", "bal": "bal"}, conflict=["id"])[0]


@query(f"SELECT id, coalesce(CASE WHEN s.bal > 100 THEN s.name END, t.name, s.name) AS name, coalesce(CASE WHEN s.bal > 100 THEN s.bal END, t.bal, s.bal) AS bal FROM {_TARGET} t FULL JOIN {_SOURCE} s USING (id)")
def upsert_rows(spark, d):
    t, s = _target_source(spark, d)
    return changes.insert_select(t, s, {"id": "id", "name": "name", "bal": "bal"}, conflict=["id"], do_update={"name": F.col("s_name"), "bal": F.col("s_bal")}, update_where=F.col("s_bal") > 100)[0]


@query(f"""SELECT id, coalesce(t.name, s.name) AS name, CASE WHEN t.id IS NULL THEN s.bal WHEN s.id IS NULL THEN t.bal - 5 ELSE s.bal END AS bal FROM {_TARGET} t FULL JOIN {_SOURCE} s USING (id) WHERE NOT (t.id IS NOT NULL AND s.id IS NOT NULL AND coalesce(s.bal < 0, false)) AND NOT (t.id IS NULL AND s.bal < 0)""")
def merge_rows(spark, d):
    t, s = _target_source(spark, d)
    branches = [
        changes.Branch("matched", "delete", condition=F.col("s_bal") < 0),
        changes.Branch("matched", "update", {"bal": F.col("s_bal")}),
        changes.Branch("not_matched", "insert", {"id": F.col("s_id"), "name": F.col("s_name"), "bal": F.col("s_bal")}, F.col("s_bal") >= 0),
        changes.Branch("by_source", "update", {"bal": F.col("t_bal") - 5}),
    ]
    return changes.merge(t, s, {"id": "id"}, branches)[0]
