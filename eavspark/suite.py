"""The registered queries of the fact engine over the driver's tables, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eavspark.conn import Database
from eavspark.sources.mapped import MappedTables

KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "lineitem": None, "events": "event_id", "documents": "doc_id", "labels": "doc_id", "embeddings": "vec_id", "pages": "page_id", "conversations": None, "benchmark": "item_id",
}
REFS = {
    "nation": ("n_regionkey",), "customer": ("c_nationkey",), "supplier": ("s_nationkey",), "orders": ("o_custkey",),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey"),
}


def database(spark: SparkSession, sf_dir: str, *tables: str) -> Database:
    return Database(spark, MappedTables.parquet(spark, sf_dir, {t: KEYS[t] for t in tables or KEYS}, REFS))


#: name: (tables, Datalog, arguments, result columns, SQL)
CASES: dict[str, tuple] = {}


def case(name: str, tables: str, datalog: str, columns: str, sql: str, *args) -> None:
    CASES[name] = (tables.split(), datalog, args, columns.split(), sql)


case(
    "flagship_orders_by_nation", "orders customer nation",
    """{:find [?name (count ?o) (sum ?k)]
        :where [[?o :orders/o_custkey ?c] [?o :orders/o_totalprice ?p] [?o :orders/o_orderkey ?k]
                [?c :customer/c_nationkey ?n] [?n :nation/n_name ?name] [(> ?p 1000.0)]]}""",
    "n_name orders keys",
    """SELECT n_name, count(*) AS orders, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 1000.0 GROUP BY n_name""",
)
case("scan_pattern", "nation", "[:find ?n ?name :where [?n :nation/n_name ?name]]", "n name", "SELECT CAST(n_nationkey AS BIGINT) AS n, n_name AS name FROM nation")
case("scan_constant_value", "customer", '[:find ?c :where [?c :customer/c_mktsegment "BUILDING"]]', "c", "SELECT c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'")
case("scan_constant_entity", "nation", "[:find ?name :where [7 :nation/n_name ?name]]", "name", "SELECT n_name AS name FROM nation WHERE n_nationkey = 7")
case("scan_star", "orders", "[:find ?o ?s ?p :where [?o :orders/o_orderstatus ?s] [?o :orders/o_orderpriority ?p]]", "o s p", "SELECT o_orderkey AS o, o_orderstatus AS s, o_orderpriority AS p FROM orders")
case("ground_pattern_true", "nation region", "[:find ?r :where [?r :region/r_name ?x] [7 :nation/n_regionkey 2]]", "r", "SELECT CAST(r_regionkey AS BIGINT) AS r FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 7 AND n_regionkey = 2)")
case("ground_pattern_false", "nation region", "[:find ?r :where [?r :region/r_name ?x] [7 :nation/n_regionkey 99]]", "r", "SELECT CAST(r_regionkey AS BIGINT) AS r FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 7 AND n_regionkey = 99)")
case("reverse_attribute", "customer nation", '[:find ?c :where [?n :nation/n_name "NATION_3"] [?n :customer/_c_nationkey ?c]]', "c", "SELECT c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'")
case("in_scalar", "customer", "[:find ?c :in ?seg :where [?c :customer/c_mktsegment ?seg]]", "c", "SELECT c_custkey AS c FROM customer WHERE c_mktsegment = 'MACHINERY'", "MACHINERY")
case("in_scalar_found", "customer", "[:find ?c ?seg :in ?seg :where [?c :customer/c_mktsegment ?seg]]", "c seg", "SELECT c_custkey AS c, c_mktsegment AS seg FROM customer WHERE c_mktsegment = 'MACHINERY'", "MACHINERY")
case("in_collection", "customer", "[:find ?c ?seg :in [?seg ...] :where [?c :customer/c_mktsegment ?seg]]", "c seg", "SELECT c_custkey AS c, c_mktsegment AS seg FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')", ["MACHINERY", "BUILDING", "BUILDING"])
case("in_collection_empty", "customer", "[:find ?c :in [?seg ...] :where [?c :customer/c_mktsegment ?seg]]", "c", "SELECT c_custkey AS c FROM customer WHERE false", [])
case("in_mixed_types", "customer", "[:find ?c :in [?k ...] :where [?c :customer/c_nationkey ?k]]", "c", "SELECT c_custkey AS c FROM customer WHERE c_nationkey IN (1, 2)", [1, "foo", 2, 3.0])
case("join_ref_chain", "lineitem orders customer nation region",
    """[:find ?r (count ?l) :where [?l :lineitem/l_orderkey ?o] [?o :orders/o_custkey ?c] [?c :customer/c_nationkey ?n]
        [?n :nation/n_regionkey ?g] [?g :region/r_name ?r]]""", "region items",
    """SELECT r_name AS region, count(*) AS items FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")  # fmt: skip
case("join_self_value", "nation", "[:find ?a ?b :where [?x :nation/n_regionkey ?r] [?y :nation/n_regionkey ?r] [?x :nation/n_name ?a] [?y :nation/n_name ?b] [(< ?x ?y)]]", "a b",
    "SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y USING (n_regionkey) WHERE x.n_nationkey < y.n_nationkey")
case("join_theta", "nation region", "[:find ?n ?r :where [?n :nation/n_regionkey ?k] [?r :region/r_name ?x] [(<= ?k ?r)]]", "n r",
    "SELECT CAST(n_nationkey AS BIGINT) AS n, CAST(r_regionkey AS BIGINT) AS r FROM nation, region WHERE n_regionkey <= r_regionkey")
case("product", "region", "[:find ?a ?b :where [?x :region/r_name ?a] [?y :region/r_name ?b]]", "a b", "SELECT x.r_name AS a, y.r_name AS b FROM region x, region y")
case("join_triangle", "lineitem", "[:find (count ?o) :where [?l :lineitem/l_orderkey ?o] [?l :lineitem/l_partkey ?p] [?m :lineitem/l_partkey ?p] [?m :lineitem/l_suppkey ?s] [?l :lineitem/l_suppkey ?s]]", "n",
    "SELECT count(*) AS n FROM lineitem l JOIN lineitem m ON l.l_partkey = m.l_partkey AND l.l_suppkey = m.l_suppkey")
case("bag_duplicates", "nation", "[:find ?r :where [?n :nation/n_regionkey ?r]]", "r", "SELECT CAST(n_regionkey AS BIGINT) AS r FROM nation")
for _name, _op in {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "=", "ne": "not=", "ne_bang": "!="}.items():
    _sql = {"not=": "<>", "!=": "<>"}.get(_op, _op)
    case(f"compare_{_name}", "part", f"[:find ?p ?s :where [?p :part/p_size ?s] [({_op} ?s 25)]]", "p s", f"SELECT p_partkey AS p, CAST(p_size AS BIGINT) AS s FROM part WHERE p_size {_sql} 25")
case("compare_long_double", "part", "[:find ?p :where [?p :part/p_size ?s] [(< ?s 10.5)]]", "p", "SELECT p_partkey AS p FROM part WHERE p_size < 10.5")
case("equal_across_types", "part", "[:find ?p :where [?p :part/p_size ?s] [(= ?s 10.0)]]", "p", "SELECT p_partkey AS p FROM part WHERE false")
case("unequal_across_types", "part", "[:find ?p :where [?p :part/p_size ?s] [?p :part/p_name ?n] [(not= ?s ?n)]]", "p", "SELECT p_partkey AS p FROM part")
case("unorderable_pair", "part", "[:find ?p :where [?p :part/p_size ?s] [?p :part/p_name ?n] [(< ?s ?n)]]", "p", "SELECT p_partkey AS p FROM part WHERE false")
for _name, (_call, _expr) in {
    "add": ("(+ ?s 7)", "p_size + 7"), "sub": ("(- ?s 30)", "p_size - 30"), "mul": ("(* ?s 3)", "p_size * 3"), "div": ("(/ ?s 4)", "p_size // 4"),
    "quot": ("(quot ?s 7)", "p_size // 7"), "mod": ("(mod ?s 6)", "p_size % 6"), "abs": ("(abs (- ?s 30))", "abs(p_size - 30)"), "nested": ("(* (+ ?s 1) (- ?s 2))", "(p_size + 1) * (p_size - 2)"),
    "if": ("(if (> ?s 25) 1 0)", "CASE WHEN p_size > 25 THEN 1 ELSE 0 END"),
}.items():
    case(f"function_{_name}", "part", f"[:find ?p ?v :where [?p :part/p_size ?s] [{_call} ?v]]", "p v", f"SELECT p_partkey AS p, CAST({_expr} AS BIGINT) AS v FROM part")
case("function_negative_div", "part", "[:find ?p ?v :where [?p :part/p_size ?s] [(/ (- 0 ?s) 4) ?v]]", "p v", "SELECT p_partkey AS p, CAST(-(p_size // 4) AS BIGINT) AS v FROM part")
case("function_div_zero", "part", "[:find ?p ?v :where [?p :part/p_size ?s] [(/ 100 (- ?s 10)) ?v]]", "p v", "SELECT p_partkey AS p, CAST(trunc(100.0 / (p_size - 10)) AS BIGINT) AS v FROM part WHERE p_size <> 10")
case("function_double", "part", "[:find ?p ?v :where [?p :part/p_retailprice ?s] [(* ?s 2) ?v]]", "p v", "SELECT p_partkey AS p, p_retailprice * 2 AS v FROM part")
for _name, (_call, _expr) in {
    "concat": ('(concat ?n "!")', "n_name || '!'"), "upper": ("(upper ?n)", "upper(n_name)"), "lower": ("(lower ?n)", "lower(n_name)"), "str": ("(str ?k)", "CAST(n_regionkey AS VARCHAR)"),
}.items():
    case(f"function_{_name}", "nation", f"[:find ?e ?v :where [?e :nation/n_name ?n] [?e :nation/n_regionkey ?k] [{_call} ?v]]", "e v", f"SELECT CAST(n_nationkey AS BIGINT) AS e, {_expr} AS v FROM nation")
case("function_strlen", "documents", "[:find ?d ?v :where [?d :documents/text ?t] [(strlen ?t) ?v]]", "d v", "SELECT doc_id AS d, CAST(strlen(text) AS BIGINT) AS v FROM documents")
case("function_year_month", "orders", "[:find ?y ?m (count ?o) :where [?o :orders/o_orderdate ?d] [(year ?d) ?y] [(month ?d) ?m]]", "y m n", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL")
case("compare_instant", "orders", '[:find ?o :where [?o :orders/o_orderdate ?d] [(< ?d #inst "1996-01-01T00:00:00Z")]]', "o", "SELECT o_orderkey AS o FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'")
case("function_not", "part", "[:find ?p :where [?p :part/p_size ?s] [(not (< ?s 25))]]", "p", "SELECT p_partkey AS p FROM part WHERE NOT p_size < 25")
case("function_check", "nation", "[:find ?n :where [?n :nation/n_regionkey ?r] [?n :nation/n_name ?m] [(mod ?n 5) ?r]]", "n", "SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation WHERE n_nationkey % 5 = n_regionkey")
case("function_failing_row", "part", "[:find ?x :in [?in ...] :where [?p :part/p_partkey 1] [(* ?in 2) ?x]]", "x", "SELECT CAST(v AS BIGINT) AS x FROM (VALUES (2), (4)) t(v) WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = 1)", [1, 2])
case("regexp_like", "nation", '[:find ?n :where [?e :nation/n_name ?n] [(regexp_like ?n "[1-3]$")]]', "n", "SELECT n_name AS n FROM nation WHERE regexp_matches(n_name, '[1-3]$')")
case("or_constants", "customer", '[:find ?c :where (or [?c :customer/c_mktsegment "BUILDING"] [?c :customer/c_mktsegment "MACHINERY"])]', "c", "SELECT c_custkey AS c FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
case("or_two_attributes", "customer", '[:find ?c ?n :where [?c :customer/c_name ?n] (or [?c :customer/c_mktsegment "BUILDING"] [?c :customer/c_nationkey 3])]', "c n", "SELECT c_custkey AS c, c_name AS n FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 3")
case("or_new_variable", "customer supplier", "[:find ?n ?k :where [?x :customer/c_nationkey ?k] [?x :customer/c_mktsegment \"BUILDING\"] (or [?n :customer/c_nationkey ?k] [?n :supplier/s_nationkey ?k])]", "n k",
    """SELECT n, CAST(c_nationkey AS BIGINT) AS k FROM customer JOIN (SELECT c_custkey AS n, c_nationkey AS k FROM customer UNION SELECT s_suppkey, s_nationkey FROM supplier) u ON c_nationkey = k WHERE c_mktsegment = 'BUILDING'""")
case("or_and", "customer", '[:find ?c :where (or (and [?c :customer/c_mktsegment "BUILDING"] [?c :customer/c_nationkey 3]) (and [?c :customer/c_mktsegment "MACHINERY"] [?c :customer/c_nationkey 4]))]', "c",
    "SELECT c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3 OR c_mktsegment = 'MACHINERY' AND c_nationkey = 4")
case("or_predicates", "part", "[:find ?p :where [?p :part/p_size ?s] (or [(< ?s 5)] [(> ?s 45)])]", "p", "SELECT p_partkey AS p FROM part WHERE p_size < 5 OR p_size > 45")
case("or_with_not", "customer", '[:find ?c :where [?c :customer/c_nationkey ?n] (or (and [?c :customer/c_nationkey ?n] (not [?c :customer/c_mktsegment "BUILDING"]) [(< ?n 3)]) (and [?c :customer/c_nationkey ?n] [(> ?n 22)]))]', "c",
    "SELECT c_custkey AS c FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_nationkey < 3 OR c_nationkey > 22")
case("not_single", "customer", '[:find ?c :where [?c :customer/c_nationkey ?n] (not [?c :customer/c_mktsegment "BUILDING"])]', "c", "SELECT c_custkey AS c FROM customer WHERE c_mktsegment <> 'BUILDING'")
case("not_multi", "customer", '[:find ?c :where [?c :customer/c_nationkey ?n] (not [?c :customer/c_mktsegment "BUILDING"] [?c :customer/c_nationkey 3])]', "c", "SELECT c_custkey AS c FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_nationkey = 3)")
case("not_two", "customer", '[:find ?c :where [?c :customer/c_nationkey ?n] (not [?c :customer/c_mktsegment "BUILDING"]) (not [?c :customer/c_nationkey 3])]', "c", "SELECT c_custkey AS c FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_nationkey <> 3")
case("not_predicate", "part", "[:find ?p :where [?p :part/p_size ?s] (not [(> ?s 10)])]", "p", "SELECT p_partkey AS p FROM part WHERE NOT p_size > 10")
case("not_first", "customer", '[:find ?c :where (not [?c :customer/c_mktsegment "BUILDING"]) [?c :customer/c_nationkey 4]]', "c", "SELECT c_custkey AS c FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_nationkey = 4")
case("not_nested", "customer", '[:find ?c :where [?c :customer/c_nationkey ?n] (not [?c :customer/c_mktsegment "BUILDING"] (not [?c :customer/c_nationkey 3]))]', "c", "SELECT c_custkey AS c FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_nationkey <> 3)")
case("not_or", "customer", '[:find ?c :where [?c :customer/c_nationkey ?n] (not (or [?c :customer/c_mktsegment "BUILDING"] [?c :customer/c_nationkey 3]))]', "c", "SELECT c_custkey AS c FROM customer WHERE NOT (c_mktsegment = 'BUILDING' OR c_nationkey = 3)")
case("set_intersection", "customer supplier", "[:find ?k :where [?k :customer/c_name ?a] [?k :supplier/s_name ?b]]", "k", "SELECT c_custkey AS k FROM customer JOIN supplier ON c_custkey = s_suppkey")
case("agg_count", "customer", "[:find ?s (count ?c) :where [?c :customer/c_mktsegment ?s]]", "s n", "SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1")
case("agg_count_distinct", "orders", "[:find (count-distinct ?c) :where [?o :orders/o_custkey ?c]]", "n", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
case("agg_sum_long", "part", "[:find ?b (sum ?s) :where [?p :part/p_brand ?b] [?p :part/p_size ?s]]", "b total", "SELECT p_brand AS b, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY 1")
case("agg_sum_empty", "part", "[:find (sum ?s) (count ?s) :where [?p :part/p_size ?s] [(> ?s 100000)]]", "total n", "SELECT CAST(coalesce(sum(p_size), 0) AS BIGINT) AS total, count(*) AS n FROM part WHERE p_size > 100000")
case("agg_grouped_empty", "part", "[:find ?b (count ?s) :where [?p :part/p_brand ?b] [?p :part/p_size ?s] [(> ?s 100000)]]", "b n", "SELECT p_brand AS b, count(*) AS n FROM part WHERE p_size > 100000 GROUP BY 1")
case("agg_avg", "part", "[:find ?b (avg ?s) :where [?p :part/p_brand ?b] [?p :part/p_size ?s]]", "b mean", "SELECT p_brand AS b, avg(p_size) AS mean FROM part GROUP BY 1")
case("agg_min_max", "orders", "[:find ?s (min ?p) (max ?p) (min ?k) :where [?o :orders/o_orderstatus ?s] [?o :orders/o_totalprice ?p] [?o :orders/o_orderpriority ?k]]", "s low high first",
    "SELECT o_orderstatus AS s, min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_orderpriority) AS first FROM orders GROUP BY 1")
case("agg_over_expression", "lineitem", "[:find ?f ?s (count ?l) (sum ?q) :where [?l :lineitem/l_returnflag ?f] [?l :lineitem/l_linestatus ?s] [?l :lineitem/l_linenumber ?k] [(* ?k 100) ?q]]", "f s n q",
    "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n, CAST(sum(l_linenumber * 100) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2")
case("order_limit", "orders", "[:find ?o ?p :where [?o :orders/o_totalprice ?p] :order [?p :desc] [?o :asc] :limit 10]", "o p", "SELECT o_orderkey AS o, o_totalprice AS p FROM orders ORDER BY p DESC, o LIMIT 10")
case("order_ascending", "nation", "[:find ?name ?n :where [?n :nation/n_name ?name] :order [?name]]", "name n", "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS n FROM nation ORDER BY 1")
case("limit_variable", "nation", "[:find ?n :in ?k :where [?n :nation/n_name ?name] :order [?n :asc] :limit ?k]", "n", "SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation ORDER BY 1 LIMIT 4", 4)
case("limit_zero", "nation", "[:find ?n :in ?k :where [?n :nation/n_name ?name] :limit ?k]", "n", "SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation LIMIT 0", 0)
case("order_by_group", "customer", "[:find ?s (count ?c) :where [?c :customer/c_mktsegment ?s] :order [?s :desc] :limit 3]", "s n", "SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1 ORDER BY 1 DESC LIMIT 3")
case("with_ignored", "nation", "[:find ?r :with ?n :where [?n :nation/n_regionkey ?r]]", "r", "SELECT CAST(n_regionkey AS BIGINT) AS r FROM nation")


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, datalog, args, columns, _ = CASES[name]
    return database(spark, sf_dir, *tables).q(datalog, *args, columns=columns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, name=name: run(name, spark, sf_dir) for name in CASES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (*_, sql) in CASES.items()}
