"""Queries over the driver's tables, one per operator, and the same in SQL."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skein.builder import Builder, Elements, script
from skein.functions import BUILTINS as B
from skein.operators import relational as R, run_state as S
from skein.plans import graphs as G
from skein.plans.frames import run
from skein.udf import Worker

QUERIES: dict[str, object] = {}
ORACLE: dict[str, str] = {}

worker = Worker("demo")


class Parts(NamedTuple):
    words: int
    first: str


@worker.task()
def greet(greeting: str, subject: str = "world") -> str:
    return f"{greeting} {subject}"


@worker.task()
def parts(text: str) -> Parts:
    found = (text or "").split(" ")
    return Parts(len(found), found[0])


@worker.task()
def halve(x: int) -> int:
    if x % 2:
        raise ValueError("odd")
    return x // 2


@worker.task(capture=True)
def halve_or_tell(x: int) -> int:
    return halve(x)


@worker.task(vectorized=True)
def plus_one(x: int) -> int:
    return x + 1


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns that tell lineitem rows apart and order the list of an order.
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_ORDER = LINE[1:]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem")


def _l(name: str) -> Column:
    return F.col(name).cast("long")


def _lists(spark: SparkSession, sf_dir: str, names: str = "q") -> DataFrame:
    """Per order: quantities (q) and part keys (p) as whole numbers, discounts (d), part keys as texts (s)."""
    items = {"q": _l("l_quantity"), "p": _l("l_partkey"), "d": F.col("l_discount"), "s": F.col("l_partkey").cast("string")}
    return R.collect_ordered(_lines(spark, sf_dir), ["l_orderkey"], _ORDER, **{n: items[n] for n in names})


def _elements(df: DataFrame, **lists: Column) -> DataFrame:
    """(l_orderkey, kind, pos, value) of some list columns."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("items")) for k, v in lists.items()]))
    rows = df.select("l_orderkey", each.alias("x")).select("l_orderkey", "x.kind", F.posexplode("x.items").alias("pos", "value"))
    return rows.select("l_orderkey", "kind", _l("pos").alias("pos"), "value")


_SQL_LISTS = """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos,
                      CAST(l_quantity AS BIGINT) AS q, CAST(l_partkey AS BIGINT) AS p, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
"""
_SQL_ARRAYS = """
    WITH a AS (SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS q,
                      list(CAST(l_partkey AS BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS p FROM lineitem GROUP BY l_orderkey)
"""


def _unnested(*parts: tuple[str, str]) -> str:
    """SQL that lists elements of some list expressions over ``a``."""
    return _SQL_ARRAYS + " UNION ALL ".join(f"SELECT l_orderkey, '{k}' AS kind, CAST(unnest(range(len({e}))) AS BIGINT) AS pos, unnest({e}) AS value FROM a" for k, e in parts)


# scalar tasks


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, CAST(l_quantity AS BIGINT) * 2 + 6 AS value FROM lineitem")
def doubler_plus(spark, sf_dir):
    return run(_lines(spark, sf_dir), G.doubler_plus(), keep=LINE, x=_l("l_quantity"), intercept=6)


@query("""SELECT l_orderkey, l_partkey + l_linenumber AS iadd, l_partkey - 100 AS isubtract, l_partkey * l_linenumber AS itimes, l_partkey > 100 AS igt, abs(l_partkey - 100) AS abs_,
       l_suppkey, l_quantity FROM lineitem""")
def math_int(spark, sf_dir):
    p, n = _l("l_partkey"), _l("l_linenumber")
    return _lines(spark, sf_dir).select("l_orderkey", "l_suppkey", "l_quantity", B["iadd"](p, n).alias("iadd"), B["isubtract"](p, F.lit(100)).alias("isubtract"), B["itimes"](p, n).alias("itimes"), B["igt"](p, F.lit(100)).alias("igt"), B["abs"](p - 100).alias("abs_"))


@query("""SELECT l_orderkey, l_partkey, l_quantity + l_tax AS add_, l_quantity - l_tax AS subtract_, l_quantity * l_discount AS times_, l_quantity / (l_discount + 1) AS divide_,
       l_discount > l_tax AS gt_, l_discount = l_tax AS eq_, l_discount <> l_tax AS neq_ FROM lineitem""")
def math_num(spark, sf_dir):
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return _lines(spark, sf_dir).select("l_orderkey", "l_partkey", B["add"](q, t).alias("add_"), B["subtract"](q, t).alias("subtract_"), B["times"](q, d).alias("times_"), B["divide"](q, d + 1).alias("divide_"), B["gt"](d, t).alias("gt_"), B["eq"](d, t).alias("eq_"), B["neq"](d, t).alias("neq_"))


@query("""SELECT l_orderkey, l_partkey, b, CAST(floor((l_partkey - 100) / b) AS BIGINT) AS quotient, CAST((l_partkey - 100) - b * floor((l_partkey - 100) / b) AS BIGINT) AS remainder
       FROM lineitem, (VALUES (7), (-7)) v(b)""")
def floor_div_mod(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_partkey", F.explode(F.array(F.lit(7), F.lit(-7))).alias("b"))
    a, b = _l("l_partkey") - 100, _l("b")
    return rows.select("l_orderkey", "l_partkey", "b", B["idivide"](a, b).alias("quotient"), B["mod"](a, b).alias("remainder"))


@query("SELECT l_orderkey, l_partkey, CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS rounded FROM lineitem")
def round_half_even(spark, sf_dir):
    return _lines(spark, sf_dir).select("l_orderkey", "l_partkey", B["round"](F.col("l_quantity") / 2).alias("rounded"))


@query("SELECT l_orderkey, l_partkey, CAST(pow(l_quantity, l_linenumber) AS BIGINT) AS ipow, round(pow(l_quantity, 0.5), 9) AS pow_ FROM lineitem")
def powers(spark, sf_dir):
    return _lines(spark, sf_dir).select("l_orderkey", "l_partkey", B["ipow"](_l("l_quantity"), _l("l_linenumber")).alias("ipow"), F.round(B["pow"](F.col("l_quantity"), F.lit(0.5)), 9).alias("pow_"))


@query("SELECT l_orderkey, l_partkey, l_quantity AS re, -l_discount AS im FROM lineitem")
def complex_conj(spark, sf_dir):
    z = B["conjugate"](F.struct(F.col("l_quantity").alias("re"), F.col("l_discount").alias("im")))
    return _lines(spark, sf_dir).select("l_orderkey", "l_partkey", z["re"].alias("re"), z["im"].alias("im"))


@query("""SELECT l_orderkey, l_partkey, NOT (l_returnflag = 'R') AS neg, l_returnflag = 'R' AND l_linestatus = 'O' AS and_, l_returnflag = 'R' OR l_linestatus = 'O' AS or_ FROM lineitem""")
def logic(spark, sf_dir):
    r, o = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    return _lines(spark, sf_dir).select("l_orderkey", "l_partkey", B["neg"](r).alias("neg"), B["and"](r, o).alias("and_"), B["or"](r, o).alias("or_"))


@query("SELECT l_orderkey, bool_and(l_discount <> 0) AS all_, bool_or(l_discount <> 0) AS any_ FROM lineitem GROUP BY l_orderkey")
def all_any_truthy(spark, sf_dir):
    return _lists(spark, sf_dir, "d").select("l_orderkey", B["all"](F.col("d")).alias("all_"), B["any"](F.col("d")).alias("any_"))


@query("SELECT o_orderkey, o_custkey AS same, o_orderkey AS a, o_orderstatus AS b FROM orders")
def identity_tuple(spark, sf_dir):
    pair = B["untuple"](B["tuple"](F.col("o_orderkey"), F.col("o_orderstatus")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", B["id"](F.col("o_custkey")).alias("same"), pair["a"].alias("a"), pair["b"].alias("b"))


@query("SELECT o_orderkey, o_orderpriority = '1-URGENT' AS same, o_orderpriority <> '1-URGENT' AS other, o_orderstatus || o_orderpriority AS joined FROM orders")
def text_eq_concat(spark, sf_dir):
    p = F.col("o_orderpriority")
    return _t(spark, sf_dir, "orders").select("o_orderkey", B["str_eq"](p, F.lit("1-URGENT")).alias("same"), B["str_neq"](p, F.lit("1-URGENT")).alias("other"), B["concat"](F.col("o_orderstatus"), p).alias("joined"))


@query("SELECT doc_id, sha256(hex(encode(text))) AS bytes_sha, text AS back FROM documents")
def encode_decode(spark, sf_dir):
    raw = B["encode"](F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(F.hex(raw), 256).alias("bytes_sha"), B["decode"](raw).alias("back"))


@query("""SELECT l_orderkey, l_partkey, CAST(l_partkey AS VARCHAR) AS whole, CASE WHEN l_returnflag = 'R' THEN 'True' ELSE 'False' END AS flag,
       CAST(l_quantity AS VARCHAR) AS float, CAST(trunc(l_extendedprice) AS BIGINT) AS cut, CAST(trunc(-l_extendedprice) AS BIGINT) AS cut_neg, l_partkey AS parsed FROM lineitem""")
def to_str_int(spark, sf_dir):
    return _lines(spark, sf_dir).select(
        "l_orderkey", "l_partkey", B["str"](_l("l_partkey")).alias("whole"), B["str"](F.col("l_returnflag") == "R").alias("flag"), B["str"](F.col("l_quantity")).alias("float"),
        B["int"](F.col("l_extendedprice")).alias("cut"), B["int"](-F.col("l_extendedprice")).alias("cut_neg"), B["int"](F.concat(F.lit(" "), F.col("l_partkey").cast("string"))).alias("parsed"),
    )


@query()
def rand_in_range(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", B["rand_int"](F.lit(1), F.lit(6), 7).alias("value"))


@query()
def sleep_true(spark, sf_dir):
    return _t(spark, sf_dir, "region").select("r_regionkey", B["sleep"](F.lit(0.001)).alias("value"))


# lists


@query(_unnested(("append", "list_append(q, CAST(l_orderkey AS BIGINT))"), ("extend", "list_concat(q, p)"), ("concat", "list_concat(p, q)")))
def list_append_extend_concat(spark, sf_dir):
    return _elements(_lists(spark, sf_dir, "qp"), append=B["append"](F.col("q"), _l("l_orderkey")), extend=B["extend"](F.col("q"), F.col("p")), concat=B["concat_lists"](F.col("p"), F.col("q")))


@query(_SQL_ARRAYS + "SELECT l_orderkey, q[1] AS head, coalesce(list_aggregate(q[2:], 'sum'), 0)::BIGINT AS rest_sum, CAST(len(q) AS BIGINT) AS n FROM a")
def list_head_rest_len(spark, sf_dir):
    h = B["head"](F.col("q"))
    return _lists(spark, sf_dir).select("l_orderkey", h["head"].alias("head"), B["sum_int_list"](h["rest"]).alias("rest_sum"), B["len"](F.col("q")).alias("n"))


@query(_SQL_ARRAYS + "SELECT l_orderkey, CAST(unnest(range(len(z))) AS BIGINT) AS pos, unnest(list_transform(z, lambda x: x[1])) AS a, unnest(list_transform(z, lambda x: x[2])) AS b FROM (SELECT l_orderkey, list_zip(q, p[1:2], true) AS z FROM a)")
def list_zip_unzip(spark, sf_dir):
    z = B["unzip"](B["zip"](F.col("q"), B["take"](F.col("p"), F.lit(2))))
    both = _lists(spark, sf_dir, "qp").select("l_orderkey", F.arrays_zip(z["a"].alias("a"), z["b"].alias("b")).alias("z"))
    return both.select("l_orderkey", F.posexplode("z").alias("pos", "z")).select("l_orderkey", _l("pos").alias("pos"), "z.a", "z.b")


@query(_unnested(("reversed", "list_reverse(q)"), ("sorted", "list_sort(q)"), ("texts", "list_transform(list_sort(list_transform(p, lambda x: CAST(x AS VARCHAR))), lambda x: CAST(x AS BIGINT))")))
def list_reverse_sort(spark, sf_dir):
    texts = F.transform(B["sort_string_list"](F.col("s")), lambda x: x.cast("long"))
    return _elements(_lists(spark, sf_dir, "qs"), reversed=B["reversed"](F.col("q")), sorted=B["sort_number_list"](F.col("q")), texts=texts)


@query(_unnested(("flat", "flatten([q, p])"), ("take2", "q[1:2]"), ("drop2", "q[3:]"), ("take_2", "q[1:greatest(len(q) - 2, 0)]"), ("drop_2", "q[greatest(len(q) - 1, 1):]")))
def list_flatten_take_drop(spark, sf_dir):
    q = F.col("q")
    return _elements(_lists(spark, sf_dir, "qp"), flat=B["flatten"](F.array("q", "p")), take2=B["take"](q, F.lit(2)), drop2=B["drop"](q, F.lit(2)), take_2=B["take"](q, F.lit(-2)), drop_2=B["drop"](q, F.lit(-2)))


@query("""SELECT l_orderkey, round(avg(l_quantity), 9) AS mean, CAST(sum(l_quantity) AS BIGINT) AS total, round(product(l_discount + 1), 9) AS product_, CAST(max(l_quantity) AS BIGINT) AS max_, CAST(min(l_quantity) AS BIGINT) AS min_
       FROM lineitem GROUP BY l_orderkey""")
def reductions(spark, sf_dir):
    q = F.col("q")
    return _lists(spark, sf_dir, "qd").select("l_orderkey", F.round(B["mean"](q), 9).alias("mean"), B["sum_int_list"](q).alias("total"), F.round(B["prod_list"](F.transform("d", lambda x: x + 1)), 9).alias("product_"), B["max_item"](q).alias("max_"), B["min_item"](q).alias("min_"))


@query(_unnested(("value", "q")))
def unfold_fold(spark, sf_dir):
    rows = R.unfold(_lists(spark, sf_dir).select("l_orderkey", "q"), "q")
    back = R.collect_ordered(rows, ["l_orderkey"], ["pos"], q=F.col("value"))
    return _elements(back, value=F.col("q"))


# maps, application, choice


@query(_unnested(("value", "list_transform(q, lambda x: 2 * x + 6)")))
def map_doubler(spark, sf_dir):
    return _elements(run(_lists(spark, sf_dir), G.map_plus(), keep=["l_orderkey"], value="q", intercept=6), value=F.col("value"))


@query(_unnested(("value", "list_transform(q, lambda x: 4 * x)")))
def map_series(spark, sf_dir):
    return _elements(run(_lists(spark, sf_dir), G.maps_in_series(), keep=["l_orderkey"], value="q"), value=F.col("value"))


@query(_unnested(("value", "list_transform(list_filter(q, lambda x: x > 40), lambda x: 2 * x + 6)")))
def map_some_empty(spark, sf_dir):
    df = _lists(spark, sf_dir).withColumn("q", F.filter("q", lambda x: x > 40))
    return _elements(run(df, G.map_plus(), keep=["l_orderkey"], value="q", intercept=6), value=F.col("value"))


@query(_SQL_LISTS + "SELECT l_orderkey, 'value' AS kind, CAST(pos AS BIGINT) AS pos, q + p AS value FROM r")
def map_multi_input(spark, sf_dir):
    return _elements(run(_lists(spark, sf_dir, "qp"), G.map_two(), keep=["l_orderkey"], a="q", b="p"), value=F.col("value"))


@query(_unnested(("a", "q"), ("value", "list_transform(q, lambda x: 2 * x + 1)")))
def map_project_field(spark, sf_dir):
    return _elements(run(_lists(spark, sf_dir), G.map_field(), keep=["l_orderkey"], value="q", intercept=1), a=F.col("a"), value=F.col("value"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) * 4 + 3 AS value FROM lineitem")
def eval_nested(spark, sf_dir):
    return run(_lines(spark, sf_dir), G.nested().bind(intercept=3), keep=["l_orderkey", "l_partkey", "l_suppkey"], value=_l("l_quantity"))


_SQL_PICK = "SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(floor(l_partkey / (l_linenumber % 3)) AS BIGINT) ELSE -1 END AS value FROM lineitem"


@query(_SQL_PICK)
def ifelse_lazy(spark, sf_dir):
    return run(_lines(spark, sf_dir), G.pick(), keep=["l_orderkey", "l_partkey", "l_suppkey"], a=_l("l_partkey"), b=_l("l_linenumber") % 3)


@query(_SQL_PICK)
def ifelse_eager(spark, sf_dir):
    return run(_lines(spark, sf_dir), G.pick(eager=True), keep=["l_orderkey", "l_partkey", "l_suppkey"], a=_l("l_partkey"), b=_l("l_linenumber") % 3)


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey // 2 AS BIGINT) ELSE CAST(o_custkey AS BIGINT) END AS value FROM orders")
def ifelse_udf_split(spark, sf_dir):
    """The user task fails on odd numbers, so it must not see them."""
    g = Builder("x")
    even = g.task("eq", a=g.task("mod", a=g["x"], b=2), b=0)
    graph = g.outputs(value=g.ifelse(even, g.task("demo.halve", x=g["x"]), g["x"]))
    return run(_t(spark, sf_dir, "orders"), graph, keep=["o_orderkey"], x=_l("o_custkey"))


# loops and recursion


@query("SELECT l_orderkey, l_partkey, l_suppkey, CAST(greatest(l_quantity + 1, 30) AS BIGINT) AS value FROM lineitem")
def loop_until(spark, sf_dir):
    return run(_lines(spark, sf_dir), G.count_to(30), limit=32, keep=["l_orderkey", "l_partkey", "l_suppkey"], value=_l("l_quantity"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber + n AS BIGINT) AS acc1, CAST(2 * n AS BIGINT) AS acc2, CAST(l_partkey + 3 * n AS BIGINT) AS acc3 FROM (SELECT *, greatest(10 - l_linenumber, 1) AS n FROM lineitem)")
def loop_multi_acc(spark, sf_dir):
    return run(_lines(spark, sf_dir), G.three_counters(10), limit=12, keep=["l_orderkey", "l_partkey", "l_suppkey"], x=_l("l_linenumber"), y=0, z=_l("l_partkey"))


@query("SELECT o_orderkey, CAST(greatest(o_custkey % 5 + 1, 4) AS BIGINT) AS value FROM orders")
def loop_udf_rounds(spark, sf_dir):
    body = Builder("x")
    new = body.task("demo.plus_one", x=body["x"])
    inner = body.outputs(x=new, should_continue=body.task("igt", a=4, b=new))
    g = Builder("x")
    return run(_t(spark, sf_dir, "orders"), g.outputs(value=g.loop(inner, x=g["x"]).x), keep=["o_orderkey"], x=_l("o_custkey") % 5)


@query("SELECT l_orderkey, l_partkey, l_suppkey, CAST(gcd(CAST(l_partkey AS BIGINT), CAST(l_quantity AS BIGINT)) AS BIGINT) AS value FROM lineitem")
def rec_gcd(spark, sf_dir):
    return run(_lines(spark, sf_dir), G.gcd(), keep=["l_orderkey", "l_partkey", "l_suppkey"], limit=16, a=_l("l_partkey"), b=_l("l_quantity"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, CAST(factorial(CAST(l_quantity AS INTEGER) % 15) AS BIGINT) AS value FROM lineitem")
def rec_factorial(spark, sf_dir):
    return run(_lines(spark, sf_dir), G.factorial(), keep=["l_orderkey", "l_partkey", "l_suppkey"], limit=16, n=_l("l_quantity") % 15)


@query("SELECT l_orderkey, round(sum(l_quantity * l_discount), 6) AS value FROM lineitem GROUP BY l_orderkey")
def fold_weighted_sum(spark, sf_dir):
    lists = R.collect_ordered(_lines(spark, sf_dir), ["l_orderkey"], _ORDER, v=F.col("l_quantity"), w=F.col("l_discount"))
    return run(lists, G.weighted_sum(), keep=["l_orderkey"], values="v", weights="w").withColumn("value", F.round("value", 6))


@query("SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) * 2 ELSE CAST(l_quantity AS BIGINT) * CAST(l_quantity AS BIGINT) END AS value FROM lineitem")
def branch_two_graphs(spark, sf_dir):
    name = F.when(F.col("l_returnflag") == "R", "double").otherwise("square")
    return run(_lines(spark, sf_dir), G.by_name(), keep=["l_orderkey", "l_partkey", "l_suppkey"], name=name, value=_l("l_quantity"))


# user tasks


@query("SELECT c_custkey, 'hello ' || c_name AS value FROM customer")
def udf_greet(spark, sf_dir):
    g = Builder("s")
    return run(_t(spark, sf_dir, "customer"), g.outputs(value=g.task("demo.greet", greeting="hello", subject=g["s"])), keep=["c_custkey"], s="c_name")


@query("SELECT c_custkey, 'hello world' AS value FROM customer")
def udf_default_arg(spark, sf_dir):
    g = Builder("s")
    return run(_t(spark, sf_dir, "customer"), g.outputs(value=g.task("demo.greet", greeting="hello")), keep=["c_custkey"], s="c_name")


@query("SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS words, string_split(p_name, ' ')[1] AS first FROM part")
def udf_bundle(spark, sf_dir):
    g = Builder("t")
    out = g.task("demo.parts", text=g["t"])
    return run(_t(spark, sf_dir, "part"), g.outputs(words=out.words, first=out.first), keep=["p_partkey"], t="p_name")


@query(_unnested(("value", "list_transform(q, lambda x: x + 1)")))
def map_udf_body(spark, sf_dir):
    inner = Builder("x")
    body = inner.outputs(value=inner.task("demo.plus_one", x=inner["x"]))
    g = Builder("v")
    graph = g.outputs(value=g.map(body, x=Elements(g["v"])))
    return _elements(run(_lists(spark, sf_dir), graph, keep=["l_orderkey"], keys=["l_orderkey"], v="q"), value=F.col("value"))


@query("SELECT n_nationkey, lower(n_name) AS value FROM nation")
def script_pipe(spark, sf_dir):
    g = Builder("s")
    return run(_t(spark, sf_dir, "nation"), g.outputs(value=g.task(script("tr A-Z a-z"), text=g["s"])), keep=["n_nationkey"], s="n_name")


# table algorithms

_BITS = "lpad(bin(CAST(l_partkey % 64 AS BIGINT)), 6, '0')"


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("l_orderkey", "l_suppkey", F.lpad(F.bin(_l("l_partkey") % 64), 6, "0").alias("bits"), _l("l_quantity").alias("n"))


@query(f"SELECT {_BITS} AS bits, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def counts_merge(spark, sf_dir):
    return R.merge_counts(_bits(spark, sf_dir), "bits", "n")


@query("""WITH c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
       SELECT CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n FROM c UNION ALL SELECT CAST(c_custkey AS BIGINT), 0 FROM customer WHERE c_custkey NOT IN (SELECT k FROM c)""")
def counts_union_missing(spark, sf_dir):
    have = _t(spark, sf_dir, "orders").groupBy(_l("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return R.add_missing(have, _t(spark, sf_dir, "customer").select(_l("c_custkey").alias("k"), F.lit(0).cast("long").alias("n")), "k")


@query("""WITH p AS (SELECT a.s_nationkey AS nation, a.s_suppkey AS i, b.s_suppkey AS j, CAST(trunc(a.s_acctbal) AS BIGINT) * CAST(trunc(b.s_acctbal) AS BIGINT) AS element FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_suppkey <= a.s_suppkey)
       SELECT * FROM p WHERE abs(element) > 1000 UNION ALL SELECT nation, j, i, element FROM p WHERE i <> j AND abs(element) > 1000""")
def pair_lower_triangle(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", _l("s_acctbal").alias("bal"))
    return R.lower_triangle(s, "s_suppkey", "bal", "nation", lambda a, b: a * b, F.lit(1000))


@query("SELECT l_partkey, l_returnflag, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END), 6) AS weight FROM lineitem GROUP BY 1, 2 HAVING abs(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END)) > 50")
def terms_threshold(spark, sf_dir):
    signed = _lines(spark, sf_dir).select("l_partkey", "l_returnflag", F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(-F.col("l_quantity")).alias("weight"))
    return R.summed_terms(signed, ["l_partkey", "l_returnflag"], "weight", 50).withColumn("weight", F.round("weight", 6))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, spent FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY abs(l_extendedprice) DESC, l_partkey, l_suppkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS spent FROM lineitem) WHERE spent <= 60""")
def running_budget(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return R.within_budget(rows, "l_orderkey", "l_extendedprice", "l_quantity", 60, ["l_partkey", "l_suppkey", "l_linenumber"]).drop("l_quantity")


_OCCUPIED = "list_transform(range(3), lambda i: CAST(substr({0}, 2 * i + 1, 1) AS INT) + CAST(substr({0}, 2 * i + 2, 1) AS INT))"


@query(f"""WITH b AS (SELECT DISTINCT {_BITS} AS bits FROM lineitem), t AS (SELECT lpad(bin(CAST(i AS BIGINT)), 6, '0') AS bits FROM range(64) t(i))
       SELECT bits FROM t WHERE substr(bits, 1, 1)::INT + substr(bits, 3, 1)::INT + substr(bits, 5, 1)::INT = 2 AND substr(bits, 2, 1)::INT + substr(bits, 4, 1)::INT + substr(bits, 6, 1)::INT = 1
       AND {_OCCUPIED.format("bits")} IN (SELECT {_OCCUPIED.format("bits")} FROM b)""")
def config_expand(spark, sf_dir):
    return R.expand_configurations(_bits(spark, sf_dir).select("bits"), "bits", "111000")


def _one(p: str, q: str) -> str:
    return f"(CASE WHEN {p} % 2 = {q} % 2 THEN 1.0::DOUBLE / (1 + abs({p} // 2 - {q} // 2)) ELSE 0 END)"


def _two(p: str, q: str, r: str, t: str) -> str:
    return f"(CASE WHEN {p} % 2 = {q} % 2 AND {r} % 2 = {t} % 2 THEN 1.0::DOUBLE / (2 + {p} // 2 + 2 * ({q} // 2) + 3 * ({r} // 2) + 5 * ({t} // 2)) ELSE 0 END)"


def _after(bits: str, places: str) -> str:
    return f"coalesce(list_sum(list_transform({places}, lambda i: list_sum({bits}[i + 2 :]))), 0)"


@query(f"""WITH s AS (SELECT s_nationkey AS nation, s_suppkey AS k, list_transform(range(8), lambda i: (s_suppkey >> (7 - i)) & 1) AS v FROM supplier),
       p AS (SELECT a.nation, a.k AS i, b.k AS j, a.v AS x, b.v AS y, list_filter(range(8), lambda i: b.v[i + 1] < a.v[i + 1]) AS g, list_filter(range(8), lambda i: b.v[i + 1] > a.v[i + 1]) AS c,
                    list_filter(range(8), lambda i: a.v[i + 1] = 1) AS f FROM s a JOIN s b ON a.nation = b.nation AND b.k <= a.k),
       q AS (SELECT *, CASE WHEN ({_after("x", "g")} + {_after("y", "c")}) % 2 = 0 THEN 1 ELSE -1 END AS phase FROM p WHERE len(g) = len(c) AND len(g) <= 2),
       e AS (SELECT nation, i, j, CASE len(g) WHEN 2 THEN phase * ({_two("g[1]", "c[1]", "g[2]", "c[2]")} - {_two("g[1]", "c[2]", "g[2]", "c[1]")})
             WHEN 1 THEN phase * ({_one("g[1]", "c[1]")} + coalesce(list_sum(list_transform(list_filter(f, lambda m: m <> g[1]), lambda m: {_two("g[1]", "c[1]", "m", "m")} - {_two("g[1]", "m", "m", "c[1]")})), 0))
             ELSE coalesce(list_sum(list_transform(f, lambda m: {_one("m", "m")} + coalesce(list_sum(list_transform(list_filter(f, lambda n: n < m), lambda n: {_two("m", "m", "n", "n")} - {_two("m", "n", "n", "m")})), 0))), 0) + 0.5 END AS element FROM q)
       SELECT nation, i, j, round(element, 9) + 0.0 AS element FROM e WHERE abs(element) > 1e-10 UNION ALL SELECT nation, j, i, round(element, 9) + 0.0 FROM e WHERE i <> j AND abs(element) > 1e-10""")
def matrix_elements(spark, sf_dir):
    n = 4
    # literals: an array made by an expression would be made anew at each look into it
    place = lambda k, d: k // n**d % n
    one = F.array(*[F.lit(1.0 / (1 + abs(place(k, 1) - place(k, 0)))) for k in range(n**2)])
    two = F.array(*[F.lit(1.0 / (2 + place(k, 3) + 2 * place(k, 2) + 3 * place(k, 1) + 5 * place(k, 0))) for k in range(n**4)])
    bits = F.transform(F.sequence(F.lit(0), F.lit(2 * n - 1)), lambda i: F.call_function("shiftright", F.col("s_suppkey").cast("int"), 7 - i).bitwiseAND(F.lit(1)))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", bits.alias("v"))
    out = R.lower_triangle(s, "s_suppkey", "v", "nation", lambda a, b: R.matrix_element(a, b, one, two, n, 0.5), F.lit(1e-10), repeated=True)
    return out.withColumn("element", F.round("element", 9) + 0.0)


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("shot"), F.col("o_orderstatus").alias("reg"), F.lpad(F.bin(_l("o_orderkey") % 8), 3, "0").alias("b"))
    return o.select("k", "shot", "reg", F.posexplode(F.filter(F.split("b", ""), lambda x: x != "")).alias("bit", "value"))


_SQL_SHOTS = "(SELECT o_custkey AS k, o_orderkey AS shot, o_orderstatus AS reg, lpad(bin(CAST(o_orderkey % 8 AS BIGINT)), 3, '0') AS b FROM orders)"


@query(f"SELECT k, reg, string_agg(b, ',' ORDER BY shot) AS shots FROM {_SQL_SHOTS} GROUP BY k, reg")
def shots_to_dict(spark, sf_dir):
    maps = R.shots_to_dict(_shots(spark, sf_dir), ["k"], "reg", "shot", "bit", "value")
    return maps.select("k", F.explode("registers").alias("reg", "s")).select("k", "reg", F.array_join("s", ",").alias("shots"))


@query(f"""SELECT k, reg AS register, CAST(row_number() OVER (PARTITION BY k, reg ORDER BY shot) - 1 AS BIGINT) AS shot, CAST(i - 1 AS BIGINT) AS bit, CAST(substr(b, CAST(i AS INTEGER), 1) AS INTEGER) AS value
       FROM {_SQL_SHOTS}, range(1, 4) t(i) QUALIFY true""".replace("row_number() OVER (PARTITION BY k, reg ORDER BY shot)", "row_number() OVER (PARTITION BY k, reg, i ORDER BY shot)"))
def dict_to_shots(spark, sf_dir):
    maps = R.shots_to_dict(_shots(spark, sf_dir), ["k"], "reg", "shot", "bit", "value")
    return R.dict_to_shots(maps, ["k"], "registers").withColumns({"shot": _l("shot"), "bit": _l("bit")})


@query(f"SELECT l_orderkey, round(sum(CASE WHEN length(replace({_BITS}, '0', '')) % 2 = 0 THEN l_quantity ELSE -l_quantity END) / sum(l_quantity), 9) AS expectation FROM lineitem GROUP BY l_orderkey")
def expectation(spark, sf_dir):
    return R.expectation(_bits(spark, sf_dir), ["l_orderkey"], "bits", "n").withColumn("expectation", F.round("expectation", 9))


@query("SELECT p_partkey, CAST(i AS BIGINT) AS pos, round(p_size + i * (p_retailprice - p_size) / 4, 6) AS value FROM part, range(5) t(i)")
def ndarray_linspace(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.posexplode(R.linspace(F.col("p_size").cast("double"), F.col("p_retailprice"), 5)).alias("pos", "value")).select("p_partkey", _l("pos").alias("pos"), F.round("value", 6).alias("value"))


@query("SELECT vec_id, CAST(k AS BIGINT) AS pos, CAST(embedding[CAST((k % 8) * 8 + k // 8 AS INTEGER) + 1] AS DOUBLE) AS value FROM embeddings, range(64) t(k)")
def ndarray_transpose(spark, sf_dir):
    t = R.transpose(F.array(F.lit(8), F.lit(8)), F.col("embedding"))
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(t).alias("pos", "value")).select("vec_id", _l("pos").alias("pos"), F.col("value").cast("double").alias("value"))


@query("""SELECT s_nationkey, s_suppkey, CASE WHEN n < core THEN 'core' WHEN n < core + 2 THEN 'active' ELSE 'virtual' END AS space
       FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS n, floor((sum(s_suppkey % 2) OVER (PARTITION BY s_nationkey) - 2) / 2) AS core FROM supplier)""")
def active_space(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") % 2).alias("filled"))
    return R.split_space(s, ["s_nationkey"], "s_suppkey", "filled", 2, 2).drop("filled")


@query("""WITH h AS (SELECT lpad(bin(CAST(i AS BIGINT)), 5, '0') AS b FROM range(32) t(i) WHERE length(replace(lpad(bin(CAST(i AS BIGINT)), 5, '0'), '0', '')) = 2)
       SELECT '11' || x.b[1] || y.b[1] || x.b[2] || y.b[2] || x.b[3] || y.b[3] || x.b[4] || y.b[4] || x.b[5] || y.b[5] || '0000' AS bits FROM h x, h y""")
def configurations(spark, sf_dir):
    return R.configurations(spark, 4, 5, core=1, virtual=2)


@query("""WITH RECURSIVE p AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size AS BIGINT) AS c, row_number() OVER (ORDER BY p_retailprice / p_size DESC, p_partkey) AS n FROM part),
       g(n, k, left_over) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(200 AS BIGINT) UNION ALL
            SELECT x.n, x.k, x.l FROM (SELECT p.n, p.k, g.left_over - p.c AS l, row_number() OVER (ORDER BY p.n) AS r FROM g JOIN p ON p.n > g.n AND p.c <= g.left_over) x WHERE x.r = 1)
       SELECT k, left_over FROM g WHERE n > 0""")
def greedy_pool(spark, sf_dir):
    pool = _t(spark, sf_dir, "part").select(_l("p_partkey").alias("k"), F.col("p_retailprice").alias("score"), _l("p_size").alias("c"))
    return spark.createDataFrame(R.greedy(pool, "k", "score", "c", 200), "k long, left_over long")


@query("SELECT vec_id, CAST(8 AS BIGINT) AS rows, CAST(8 AS BIGINT) AS cols, CAST(embedding[vec_id % 64 + 1] AS DOUBLE) AS point FROM embeddings")
def ndarray_reshape_point(spark, sf_dir):
    shaped = R.reshape(F.array(F.lit(64)), F.col("embedding"), [8, 8])
    point = R.at_point(R.pointed(F.col("embedding"), F.col("vec_id") % 64))
    return _t(spark, sf_dir, "embeddings").select("vec_id", _l_of(shaped["shape"], 0).alias("rows"), _l_of(shaped["shape"], 1).alias("cols"), point.cast("double").alias("point"))


def _l_of(items: Column, i: int) -> Column:
    return F.get(items, F.lit(i)).cast("long")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey // 2 AS BIGINT) ELSE -1 END AS value, CASE WHEN o_custkey % 2 = 1 THEN 'ValueError: odd' ELSE '' END AS error FROM orders")
def udf_error_capture(spark, sf_dir):
    """Errors of single rows become values."""
    g = Builder("x")
    out = g.task("demo.halve_or_tell", x=g["x"])
    told = run(_t(spark, sf_dir, "orders"), g.outputs(value=out.value, error=out.error), keep=["o_orderkey"], x=_l("o_custkey"))
    return told.fillna({"value": -1, "error": ""})


# run state


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per user, a node per event; errors and purchases end a node."""
    e = _t(spark, sf_dir, "events")
    place = F.concat(F.lit("-.N"), (F.col("event_id") % 20).cast("string"), F.lit(".L"), (F.col("event_id") % 3).cast("string"), F.lit(".N"), F.col("event_id").cast("string"))
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run"), place.alias("location"), F.lit("Call").alias("kind"), F.when(F.col("event_type") != "signup", F.col("ts")).alias("started"), F.when(F.col("event_type") == "purchase", F.col("ts")).alias("finished"), F.when(F.col("event_type") == "error", "failed").alias("error"), "event_id", "value")


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 'Finished' WHEN 'error' THEN 'Error' WHEN 'signup' THEN 'Not started' ELSE 'Started' END AS status FROM events")
def state_status(spark, sf_dir):
    return S.with_status(_nodes(spark, sf_dir)).select("event_id", "status")


@query("""WITH n AS (SELECT 'u' || user_id AS run, '-.N' || (event_id % 20) AS a, '-.N' || (event_id % 20) || '.L' || (event_id % 3) AS b FROM events WHERE event_type = 'error'),
       x AS (SELECT run, a AS location FROM n UNION SELECT run, b FROM n UNION SELECT run, '-' FROM n) SELECT run, location FROM x""")
def state_errors(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    above = nodes.select("run", F.explode(S.ancestors(F.col("location"))).alias("location"), F.lit(None).cast("string").alias("error")).distinct()
    return S.errors_above(above.unionByName(nodes.select("run", "location", "error"))).filter("error is null and location not like '%.L%.N%'").select("run", "location").distinct()


@query("SELECT * FROM (SELECT user_id, event_id AS from_round, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS to_round, value FROM events) WHERE to_round IS NOT NULL")
def state_loop_edges(spark, sf_dir):
    return S.loop_edges(_t(spark, sf_dir, "events"), ["user_id"], "event_id", "value")


@query("SELECT 'u' || user_id AS run, min(CASE WHEN event_type <> 'signup' THEN ts END) AS started FROM events GROUP BY user_id")
def state_runs(spark, sf_dir):
    return S.runs(_nodes(spark, sf_dir))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '-.N' || (event_id % 20) ELSE '-.N' || (event_id % 20) || '.L' || (event_id % 3 - 1) END AS before FROM events""")
def state_loop_parent(spark, sf_dir):
    turn = F.regexp_replace("location", r"\.N\d+$", "")
    return _nodes(spark, sf_dir).select("event_id", S.parent(turn).alias("before"))


@query()
def graph_edges(spark, sf_dir):
    return S.graph_tables(spark, G.pick())[1]
