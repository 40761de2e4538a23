"""The registered queries of stored facts: the driver's tables as transactions, and what follows from them, with SQL that says the same.

``region``, ``nation`` and ``supplier`` are transacted whole: regions and nations; suppliers; new balances; retractions.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eavspark.edn import Keyword
from eavspark.plans.parse import parse
from eavspark.streaming.delta import delta
from eavspark.streaming.stream import stream
from eavspark.streaming.subscription import MaterializedView, Subscription
from eavspark.tx.connection import Connection, connect

ATTRIBUTES = {
    ":region/name": ("string", "one", "identity"), ":nation/name": ("string", "one", "identity"), ":nation/key": ("long", "one", "value"), ":nation/region": ("ref", "one", None),
    ":nation/next": ("ref", "many", None), ":supplier/name": ("string", "one", "identity"), ":supplier/key": ("long", "one", None), ":supplier/nation": ("ref", "one", None),
    ":supplier/balance": ("double", "one", None), ":supplier/tag": ("string", "many", None),
}
#: Numbers of the transactions below.
SCHEMA, PLACES, SUPPLIERS, RAISED, RETRACTED, TAGGED, REFUSED, UPSERTED = range(8)


def transactions(spark: SparkSession, sf_dir: str) -> list:
    rows = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()
    k = Keyword
    schema = [
        {k("db/ident"): k(a[1:]), k("db/valueType"): k(f"db.type/{t}"), k("db/cardinality"): k(f"db.cardinality/{c}"), **({k("db/unique"): k(f"db.unique/{u}")} if u else {})}
        for a, (t, c, u) in ATTRIBUTES.items()
    ]
    region, nation, supplier = rows("region"), rows("nation"), rows("supplier")
    places = [{":db/id": f"r{r.r_regionkey}", ":region/name": r.r_name} for r in region]
    places += [{":db/id": f"n{n.n_nationkey}", ":nation/name": n.n_name, ":nation/key": n.n_nationkey, ":nation/region": f"r{n.n_regionkey}"} for n in nation]
    # each nation points to that of 7 times its key and 3
    known = {n.n_nationkey for n in nation}
    places += [[k("db/add"), f"n{n}", ":nation/next", f"n{(7 * n + 3) % 25}"] for n in sorted(known) if (7 * n + 3) % 25 in known]
    name_of = {n.n_nationkey: n.n_name for n in nation}
    suppliers = [{":supplier/name": s.s_name, ":supplier/key": s.s_suppkey, ":supplier/balance": s.s_acctbal, ":supplier/nation": [k("nation/name"), name_of[s.s_nationkey]]} for s in supplier]
    at = lambda s: [k("supplier/name"), s.s_name]
    raised = [[k("db/add"), at(s), ":supplier/balance", s.s_acctbal + 1000.0] for s in supplier if s.s_suppkey % 2 == 0]
    retracted = [[k("db/retract"), at(s), ":supplier/balance", s.s_acctbal + (1000.0 if s.s_suppkey % 2 == 0 else 0.0)] for s in supplier if s.s_suppkey % 3 == 0]
    tagged = [[k("db/add"), at(s), ":supplier/tag", t] for s in supplier for t in ("all", f"mod{s.s_suppkey % 4}")]
    refused = [[k("db/add"), [k("nation/name"), nation[0].n_name], ":nation/key", nation[1].n_nationkey]]
    upserted = [{":supplier/name": s.s_name, ":supplier/tag": "again"} for s in supplier if s.s_suppkey % 5 == 0]
    upserted += [[k("db/retract"), at(s), ":supplier/tag", "mod3"] for s in supplier if s.s_suppkey % 4 == 3]
    return [schema, places, suppliers, raised, retracted, tagged, refused, upserted]


def store(spark: SparkSession, sf_dir: str, path: str | None = None, upto: int = UPSERTED) -> Connection:
    conn = connect(spark, path, extensions=True)
    for ops in transactions(spark, sf_dir)[: upto + 1]:
        conn.submit(ops)
    return conn


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one; one of our own only where that is unset and there are no other machines."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not spark.sparkContext.master.startswith(("local[", "local")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{at or tempfile.mkdtemp(prefix='facts-')}/store-{uuid.uuid4().hex}"


#: name: (function, SQL)
CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def registered(sql: str):
    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add


def asked(name: str, datalog: str, columns: str, sql: str, *args, basis: int | None = None, **options) -> None:
    """A query of the store in memory, at a basis."""
    CASES[name] = (lambda spark, sf_dir: store(spark, sf_dir, upto=UPSERTED).db(basis).q(datalog, *args, columns=columns.split(), extensions=True, **options), sql)


#: Suppliers as they are after all transactions.
NOW = "SELECT s_suppkey AS k, s_name AS n, s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal + 1000.0 ELSE s_acctbal END AS b FROM supplier"
TAGS = """SELECT s_suppkey AS k, unnest(list_filter(['all', 'mod' || (s_suppkey % 4), CASE WHEN s_suppkey % 5 = 0 THEN 'again' END], lambda t: t IS NOT NULL AND t <> 'mod3')) AS t FROM supplier"""

asked("stored_scan", "[:find ?k ?n ?b :where [?s :supplier/key ?k] [?s :supplier/name ?n] [?s :supplier/balance ?b]]", "k n b", f"SELECT k, n, b FROM ({NOW}) WHERE k % 3 <> 0")
asked("stored_join", "[:find ?k ?r :where [?s :supplier/key ?k] [?s :supplier/nation ?c] [?c :nation/region ?g] [?g :region/name ?r]]", "k r",
      "SELECT s_suppkey AS k, r_name AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
asked("stored_key_lookup", "[:find ?k :in [?n ...] :where [?c :nation/name ?n] [?s :supplier/nation ?c] [?s :supplier/key ?k]]", "k", "SELECT s_suppkey AS k FROM supplier WHERE s_nationkey IN (3, 4)", ["NATION_3", "NATION_4"])
asked("as_of_places", "[:find ?n ?k :where [?c :nation/name ?n] [?c :nation/key ?k] (not-join [?c] [?s :supplier/nation ?c])]", "n k", "SELECT n_name AS n, CAST(n_nationkey AS BIGINT) AS k FROM nation", basis=PLACES)
asked("as_of_suppliers", "[:find ?k ?b :where [?s :supplier/key ?k] [?s :supplier/balance ?b]]", "k b", "SELECT s_suppkey AS k, s_acctbal AS b FROM supplier", basis=SUPPLIERS)
asked("as_of_raised", "[:find ?k ?b :where [?s :supplier/key ?k] [?s :supplier/balance ?b]]", "k b", f"SELECT k, b FROM ({NOW})", basis=RAISED)
asked("as_of_nothing", "[:find ?k :where [?s :supplier/key ?k]]", "k", "SELECT s_suppkey AS k FROM supplier WHERE false", basis=PLACES)
asked("retracted_values", "[:find ?k :where [?s :supplier/key ?k] (not-join [?s] [?s :supplier/balance ?b])]", "k", "SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 3 = 0")
asked("many_values", "[:find ?k ?t :where [?s :supplier/key ?k] [?s :supplier/tag ?t]]", "k t", TAGS)
asked("aborted_transaction", "[:find ?i ?k :where [?t :db/txError ?x] [?t :db/txId ?i] [?c :nation/name \"NATION_0\"] [?c :nation/key ?k]]", "i k", f"SELECT CAST({REFUSED} AS BIGINT) AS i, CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_name = 'NATION_0'")
asked("transaction_facts", "[:find ?i :where [?t :db/txResult :db.tx/committed] [?t :db/txId ?i]]", "i", f"SELECT CAST(i AS BIGINT) AS i FROM range(0, {UPSERTED + 1}) t(i) WHERE i <> {REFUSED}")
asked("transaction_place", "[:find ?i (count ?s) :where [?s :supplier/balance ?b ?t] [?t :db/txId ?i]]", "i n", f"SELECT CAST(CASE WHEN s_suppkey % 2 = 0 THEN {RAISED} ELSE {SUPPLIERS} END AS BIGINT) AS i, count(*) AS n FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY 1")
asked("upserts", '[:find ?k ?n :where [?s :supplier/tag "again"] [?s :supplier/key ?k] [?s :supplier/name ?n]]', "k n", "SELECT s_suppkey AS k, s_name AS n FROM supplier WHERE s_suppkey % 5 = 0")
asked("placeholder", "[:find ?k :where [?s :supplier/key ?k] [?s :supplier/tag _]]", "k", "SELECT s_suppkey AS k FROM supplier")
asked("variable_attribute", "[:find ?a (count ?v) :where [?s :supplier/key ?k] [?s ?a ?v]]", "a n",
      f"""SELECT a, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest([':supplier/name', ':supplier/key', ':supplier/nation']) AS a, 1 AS n FROM supplier
          UNION ALL SELECT ':supplier/balance', 1 FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT ':supplier/tag', 1 FROM ({TAGS})) GROUP BY 1""")  # fmt: skip
asked("in_tuple", "[:find ?k :in [?t ?n] :where [?c :nation/name ?n] [?s :supplier/nation ?c] [?s :supplier/tag ?t] [?s :supplier/key ?k]]", "k",
      f"SELECT s_suppkey AS k FROM supplier JOIN ({TAGS}) ON k = s_suppkey WHERE t = 'mod1' AND s_nationkey = 5", ("mod1", "NATION_5"))
asked("in_relation", "[:find ?k ?t :in [[?t ?n]] :where [?c :nation/name ?n] [?s :supplier/nation ?c] [?s :supplier/tag ?t] [?s :supplier/key ?k]]", "k t",
      f"SELECT k, t FROM supplier JOIN ({TAGS}) ON k = s_suppkey WHERE (t = 'mod1' AND s_nationkey = 5) OR (t = 'all' AND s_nationkey = 6)", [("mod1", "NATION_5"), ("all", "NATION_6")])
asked("or_join", '[:find ?k :where [?s :supplier/key ?k] (or-join [?s] [?s :supplier/tag "again"] (and [?s :supplier/balance ?b] [(> ?b 5000.0)]))]', "k",
      f"SELECT k FROM ({NOW}) WHERE k % 5 = 0 OR (k % 3 <> 0 AND b > 5000.0)")
asked("not_join", "[:find ?k :where [?s :supplier/key ?k] (not-join [?s] [?s :supplier/balance ?b] [(> ?b 5000.0)])]", "k", f"SELECT k FROM ({NOW}) WHERE NOT (k % 3 <> 0 AND b > 5000.0)")
asked("rules_reach", "[:find ?a ?b :where (reach ?x ?y) [?x :nation/name ?a] [?y :nation/name ?b]]", "a b",
      """WITH RECURSIVE e AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON y.n_nationkey = (7 * x.n_nationkey + 3) % 25),
         r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
         SELECT x.n_name AS a, y.n_name AS b FROM r JOIN nation x ON x.n_nationkey = r.a JOIN nation y ON y.n_nationkey = r.b""",
      rules="[[(reach ?a ?b) [?a :nation/next ?b]] [(reach ?a ?b) [?a :nation/next ?c] (reach ?c ?b)]]")
asked("rules_twice", "[:find ?a ?b :where (reach ?x ?y) [?x :nation/name ?a] [?y :nation/name ?b]]", "a b", CASES["rules_reach"][1],
      rules="[[(reach ?a ?b) [?a :nation/next ?b]] [(reach ?a ?b) (reach ?a ?c) (reach ?c ?b)]]")


@registered(f"SELECT k, n, b FROM ({NOW}) WHERE k % 3 <> 0")
def pull_entities(spark, sf_dir):
    found = store(spark, sf_dir).db().q("[:find (pull ?s [:supplier/key :supplier/name :supplier/balance]) :where [?s :supplier/balance ?b]]", extensions=True)
    p = found.columns[0]
    return found.select(*[F.col(f"`{p}`.`:supplier/{a}`").alias(c) for a, c in (("key", "k"), ("name", "n"), ("balance", "b"))])


@registered("SELECT count(*) AS n, CAST(max(s_suppkey) AS BIGINT) AS k FROM supplier")
def find_shapes(spark, sf_dir):
    """A scalar, and the greatest of a collection."""
    db = store(spark, sf_dir).db()
    n = db.value("[:find (count ?s) . :where [?s :supplier/key ?k]]")
    return spark.createDataFrame([(n, max(db.value("[:find [?k ...] :where [?s :supplier/key ?k]]")))], "n long, k long")


@registered("SELECT s_suppkey AS k FROM supplier WHERE s_nationkey <> 3 UNION ALL SELECT CAST(-1 AS BIGINT) WHERE EXISTS (SELECT 1 FROM nation WHERE n_name = 'NATION_3')")
def retract_entity(spark, sf_dir):
    """A nation goes, with the refs to it; -1 if it was there before."""
    conn = store(spark, sf_dir)
    before = conn.latest
    conn.transact('[[:db/retractEntity [:nation/name "NATION_3"]]]')
    there = conn.db(before).q('[:find ?m :where [?c :nation/name "NATION_3"] [(- 0 1) ?m]]', columns=["k"])
    assert not conn.q('[:find ?c :where [?c :nation/name "NATION_3"]]').count()
    return conn.q("[:find ?k :where [?s :supplier/key ?k] [?s :supplier/nation ?c]]", columns=["k"]).unionByName(there)


@registered(f"SELECT k, n, b FROM ({NOW}) WHERE k % 3 <> 0")
def reopened_store(spark, sf_dir):
    """Written to files, merged in part, opened again."""
    path = folder(spark)
    conn = store(spark, sf_dir, path, RAISED)
    conn.compact()
    for ops in transactions(spark, sf_dir)[RETRACTED:]:
        conn.submit(ops)
    return connect(spark, path).q("[:find ?k ?n ?b :where [?s :supplier/key ?k] [?s :supplier/name ?n] [?s :supplier/balance ?b]]", columns=["k", "n", "b"])


@registered("SELECT s_suppkey AS k, s_acctbal AS b FROM supplier")
def merged_as_of(spark, sf_dir):
    """A basis before the merge, from merged files."""
    path = folder(spark)
    store(spark, sf_dir, path).compact()
    return connect(spark, path).db(SUPPLIERS).q("[:find ?k ?b :where [?s :supplier/key ?k] [?s :supplier/balance ?b]]", columns=["k", "b"])


@registered("SELECT s_suppkey AS k FROM supplier")
def sent_transactions(spark, sf_dir):
    conn = connect(spark, extensions=True)
    sent = [conn.send(ops) for ops in transactions(spark, sf_dir)[: SUPPLIERS + 1]]
    return conn.db(sent[-1].result()).q("[:find ?k :where [?s :supplier/key ?k]]", columns=["k"])


def summed(name: str, datalog: str, columns: str, sql: str) -> None:
    """The result at the first basis and the delta of each transaction after it, added up: it must be the result at the last."""

    def run(spark, sf_dir):
        # in files, and each delta written before the next is planned: a plan holds no rows, and there is never more than one delta's
        at = folder(spark)
        conn, query, names = store(spark, sf_dir, f"{at}/store"), parse(datalog), columns.split()
        source = conn.source()
        total = conn.db(PLACES).q(datalog, columns=names).withColumn("_w", F.lit(1).cast("long"))
        for tx in range(PLACES + 1, UPSERTED + 1):
            change = delta(spark, source, query, tx - 1, tx)
            if change is not None:
                change.toDF(*names, "_w").write.parquet(f"{at}/deltas/{tx}")
                total = total.unionByName(spark.read.schema(total.schema).parquet(f"{at}/deltas/{tx}"))
        weights = total.groupBy(*names).agg(F.sum("_w").alias("_w")).where("_w <> 0")
        # a negative weight would be a row that was never there: it has to show
        return weights.withColumn("_w", F.explode(F.sequence(F.lit(1), F.greatest(F.abs("_w"), F.lit(1))))).drop("_w")

    CASES[f"delta_{name}"] = (run, sql)


summed("pattern", "[:find ?s ?t :where [?x :supplier/name ?s] [?x :supplier/tag ?t]]", "n t", f"SELECT s_name AS n, t FROM supplier JOIN ({TAGS}) ON k = s_suppkey")
summed("join", "[:find ?k ?b ?n :where [?s :supplier/key ?k] [?s :supplier/balance ?b] [?s :supplier/nation ?c] [?c :nation/name ?n]]", "k b n", f"SELECT k, b, n_name AS n FROM ({NOW}) JOIN nation ON s_nationkey = n_nationkey WHERE k % 3 <> 0")
summed("bag", "[:find ?n :where [?s :supplier/tag ?t] [?s :supplier/nation ?c] [?c :nation/name ?n]]", "n", f"SELECT n_name AS n FROM supplier JOIN ({TAGS}) ON k = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
summed("filter", "[:find ?k ?h :where [?s :supplier/key ?k] [?s :supplier/balance ?b] [(> ?b 3000.0)] [(* ?b 2) ?h]]", "k h", f"SELECT k, b * 2 AS h FROM ({NOW}) WHERE k % 3 <> 0 AND b > 3000.0")
summed("not", "[:find ?k :where [?s :supplier/key ?k] [?s :supplier/balance ?b] (not [(> ?b 5000.0)])]", "k", f"SELECT k FROM ({NOW}) WHERE k % 3 <> 0 AND b <= 5000.0")
summed("not_value", '[:find ?k :where [?s :supplier/key ?k] (not [?s :supplier/tag "again"])]', "k", "SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 5 <> 0")
summed("or", '[:find ?k :where [?s :supplier/key ?k] (or [?s :supplier/tag "mod1"] [?s :supplier/tag "again"])]', "k", "SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 4 = 1 OR s_suppkey % 5 = 0")
summed("or_predicates", "[:find ?k :where [?s :supplier/key ?k] [?s :supplier/balance ?b] (or [(< ?b 1000.0)] [(> ?b 6000.0)])]", "k", f"SELECT k FROM ({NOW}) WHERE k % 3 <> 0 AND (b < 1000.0 OR b > 6000.0)")
summed("triangle", "[:find ?a ?b ?c :where [?x :nation/next ?y] [?y :nation/next ?z] [?x :nation/name ?a] [?y :nation/name ?b] [?z :nation/name ?c]]", "a b c",
       """SELECT x.n_name AS a, y.n_name AS b, z.n_name AS c FROM nation x JOIN nation y ON y.n_nationkey = (7 * x.n_nationkey + 3) % 25 JOIN nation z ON z.n_nationkey = (7 * y.n_nationkey + 3) % 25""")  # fmt: skip


@registered(f"SELECT k, b FROM ({NOW}) WHERE k % 3 <> 0")
def materialized_view(spark, sf_dir):
    """A subscription from before the suppliers came; its deltas add up to the last basis."""
    conn = store(spark, sf_dir, upto=PLACES)
    with Subscription(conn, "[:find ?k ?b :where [?s :supplier/key ?k] [?s :supplier/balance ?b]]") as subscription:
        view = MaterializedView(subscription)
        for ops in transactions(spark, sf_dir)[SUPPLIERS:]:
            conn.submit(ops)
        while view.tx_key is None or view.tx_key.tx_id < RETRACTED:
            if not view.update(120):
                break
    return spark.createDataFrame([r for r, w in view.get().items() for _ in range(w)], "k long, b double")


@registered(f"SELECT k, b FROM ({NOW}) WHERE k % 3 <> 0")
def streamed_deltas(spark, sf_dir):
    """Structured Streaming over the log of a store that another connection wrote."""
    path, out = folder(spark), folder(spark)
    reader = connect(spark, path)
    store(spark, sf_dir, path)
    sink = lambda df, tx: df.withColumn("tx", F.lit(tx)).write.mode("overwrite").parquet(f"{out}/rows/{tx}")
    stream(reader, "[:find ?k ?b :where [?s :supplier/key ?k] [?s :supplier/balance ?b]]", sink, f"{out}/checkpoint", once=True).awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/rows")
    return rows.groupBy("k", "b").agg(F.sum("_w").alias("_w")).where("_w <> 0").select("k", "b")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CASES.items()}
