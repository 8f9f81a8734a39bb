"""Queries on profiling, projections, encoding and missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthframe.functions import special
from synthframe.functions.rng import md5_uniform
from synthframe.operators import encode, missing, profile, project
from synthframe.plans import sqltext as S
from synthframe.plans.registry import Tables, query

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = "l_orderkey, l_linenumber"


def gappy_orders(t: Tables) -> DataFrame:
    """Orders with holes: the tables themselves hold no null."""
    key = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey", F.when(key % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(key % 5 != 2, F.col("o_orderpriority")).alias("o_orderpriority"), "o_orderstatus")


GAPPY = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 5 <> 2 THEN o_orderpriority END AS o_orderpriority, o_orderstatus FROM orders"""


def customer_ids(t: Tables) -> DataFrame:
    """Customers with a prefixed and a hyphenated identifier."""
    key = F.col("c_custkey")
    return t.customer.select(
        "c_custkey", F.concat(F.lit("C"), F.lpad(key.cast("string"), 6, "0")).alias("code"),
        F.concat_ws("-", F.lpad((key % 1000).cast("string"), 3, "0"), F.lpad((key % 100).cast("string"), 2, "0"),
                    F.lpad(key.cast("string"), 6, "0")).alias("policy"), "c_mktsegment", "c_acctbal", "c_nationkey")


CUSTOMER_IDS = """SELECT c_custkey, 'C' || lpad(cast(c_custkey as varchar), 6, '0') AS code,
  lpad(cast(c_custkey % 1000 as varchar), 3, '0') || '-' || lpad(cast(c_custkey % 100 as varchar), 2, '0')
  || '-' || lpad(cast(c_custkey as varchar), 6, '0') AS policy, c_mktsegment, c_acctbal, c_nationkey FROM customer"""


# ------------------------------------------------------------------ profiling

def _profile_sql(source: str, columns: list[tuple[str, str, str]]) -> str:
    parts = []
    for name, dtype, kind in columns:
        if kind == "number":
            role = ("CASE WHEN count(DISTINCT {c}) = count(*) AND '{t}' IN ('bigint', 'int') THEN 'surrogate_id' "
                    "ELSE 'numeric' END").format(c=name, t=dtype)
            low, high = f"min({name})", f"max({name})"
        elif kind == "time":
            role = "'datetime'"
            low, high = f"min(epoch({name})) / 86400.0", f"max(epoch({name})) / 86400.0"
        else:
            role = f"'{kind}'"
            low = high = "NULL"
        parts.append(f"SELECT '{name}' AS \"column\", '{dtype}' AS dtype, {role} AS role, count(*) AS n, "
                     f"count(*) - count({name}) AS n_null, count(DISTINCT {name}) AS n_distinct, "
                     f"cast({low} as double) AS min, cast({high} as double) AS max FROM ({source})")
    return " UNION ALL ".join(parts)


_ORDER_PROFILE = _profile_sql("SELECT * FROM orders", [
    ("o_orderkey", "bigint", "number"), ("o_custkey", "bigint", "number"), ("o_orderstatus", "string", "category"),
    ("o_totalprice", "double", "number"), ("o_orderdate", "timestamp_ntz", "time"), ("o_orderpriority", "string", "category")])


@query("profile_columns", "P1 P4 P12", _ORDER_PROFILE)
def profile_columns(t):
    return profile.profile_frame(t.orders, exact_distinct=True).drop("prefix", "digits")


@query("profile_sketched", "P1 S5", f"""SELECT "column", role, n, n_null, min, max,
  CASE WHEN n_distinct >= 0.95 * (n - n_null) THEN n_distinct END AS near_unique FROM ({_ORDER_PROFILE})""")
def profile_sketched(t):
    """The default path: sketched counts, exact ones only where a column comes near uniqueness."""
    made = profile.profile_frame(t.orders)
    return made.select("column", "role", "n", "n_null", "min", "max",
                       F.when(F.col("n_distinct") >= 0.95 * (F.col("n") - F.col("n_null")), F.col("n_distinct")).alias("near_unique"))


@query("profile_id_columns", "P1 P2 P3 S5", _profile_sql(CUSTOMER_IDS, [
    ("c_custkey", "bigint", "number"), ("code", "string", "prefixed_id"), ("policy", "string", "hyphen_id"),
    ("c_mktsegment", "string", "category"), ("c_acctbal", "double", "number"), ("c_nationkey", "int", "number")]))
def profile_id_columns(t):
    return profile.profile_frame(customer_ids(t), order_by="c_custkey", exact_distinct=True).drop("prefix", "digits")


@query("id_prefix_pattern", "P2", f"""SELECT regexp_matches(code, '^([A-Za-z]+)([0-9]+)') AS matched,
  regexp_extract(code, '^([A-Za-z]+)([0-9]+)', 1) AS prefix,
  cast(length(regexp_extract(code, '^([A-Za-z]+)([0-9]+)', 2)) as int) AS digits, count(*) AS n
FROM ({CUSTOMER_IDS}) GROUP BY ALL""")
def id_prefix_pattern(t):
    rows = customer_ids(t).select(profile.prefix_parts(F.col("code")).alias("p")).select("p.*")
    return rows.groupBy("matched", "prefix", "digits").agg(F.count("*").alias("n"))


@query("id_hyphen_pattern", "P3", f"""SELECT regexp_matches(policy, '^([0-9]+)-([0-9]+)-([0-9]+)') AS matched,
  cast(length(split_part(policy, '-', 1)) as int) AS d1, cast(length(split_part(policy, '-', 2)) as int) AS d2,
  cast(length(split_part(policy, '-', 3)) as int) AS d3, count(*) AS n FROM ({CUSTOMER_IDS}) GROUP BY ALL""")
def id_hyphen_pattern(t):
    rows = customer_ids(t).select(profile.hyphen_parts(F.col("policy")).alias("p"))
    return (rows.select("p.matched", *[F.col("p.digits")[i].alias(f"d{i + 1}") for i in range(3)])
            .groupBy("matched", "d1", "d2", "d3").agg(F.count("*").alias("n")))


@query("null_profile", "P5 M7", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, "
    f"round((count(*) - count({c})) / cast(count(*) as double), 9) AS null_share FROM ({GAPPY})"
    for c in ("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")))
def null_profile(t):
    return profile.null_profile(gappy_orders(t)).withColumn("null_share", F.round("null_share", 9))


@query("columns_of_type", "P7 F3", f"SELECT {', '.join(MEASURES)} FROM lineitem")
def columns_of_type(t):
    return profile.columns_of_type(t.lineitem, "double")


def _flagged(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("rare", (F.col("l_orderkey") % 100 == 0).cast("int")).withColumn("fixed", F.lit(1.0))


FLAGGED = "SELECT *, cast(l_orderkey % 100 = 0 as int) AS rare, 1.0 AS fixed FROM lineitem"


@query("near_constant_columns", "P8", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg(cast({c} = 0 as int)), 9) AS zero_share FROM ({FLAGGED})"
    for c in ("l_discount", "l_tax", "rare", "fixed")))
def near_constant_columns(t):
    shares = profile.zero_shares(_flagged(t), ["l_discount", "l_tax", "rare", "fixed"])
    return shares.withColumn("zero_share", F.round("zero_share", 9))


@query("prune_near_constant", "P8 P9", f"SELECT {KEY}, l_discount, l_tax, fixed FROM ({FLAGGED})")
def prune_near_constant(t):
    df = _flagged(t).select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "rare", "fixed")
    return profile.prune_near_constant(df, 0.98, keep=("l_orderkey",), columns=["l_discount", "l_tax", "rare", "fixed"])


@query("constant_columns", "P10", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) = 1 AS is_constant FROM ({FLAGGED})"
    for c in ("l_quantity", "l_linestatus", "rare", "fixed")))
def constant_columns(t):
    df = _flagged(t)
    return profile.constant_columns(df.select("l_quantity", "l_linestatus", "rare", "fixed"),
                                    ["l_quantity", "l_linestatus", "rare", "fixed"])


@query("equal_pairs", "P11", """WITH x AS (SELECT l_quantity AS a, l_quantity AS b,
  CASE WHEN l_orderkey % 50 = 0 THEN -1 ELSE l_quantity END AS c, l_discount AS d FROM lineitem),
p AS (SELECT 'a' AS col_i, 'b' AS col_j, avg(cast(a = b as int)) AS s FROM x
  UNION ALL SELECT 'a', 'c', avg(cast(a = c as int)) FROM x UNION ALL SELECT 'a', 'd', avg(cast(a = d as int)) FROM x
  UNION ALL SELECT 'b', 'c', avg(cast(b = c as int)) FROM x UNION ALL SELECT 'b', 'd', avg(cast(b = d as int)) FROM x
  UNION ALL SELECT 'c', 'd', avg(cast(c = d as int)) FROM x)
SELECT col_i, col_j, round(s, 9) AS equal_share FROM p WHERE s > 0.95""")
def equal_pairs(t):
    q = F.col("l_quantity")
    df = t.lineitem.select(q.alias("a"), q.alias("b"), F.when(F.col("l_orderkey") % 50 == 0, -1.0).otherwise(q).alias("c"),
                           F.col("l_discount").alias("d"))
    return profile.equal_pairs(df, ["a", "b", "c", "d"]).withColumn("equal_share", F.round("equal_share", 9))


@query("column_ranges", "P12", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", min({c}) AS lo, max({c}) AS hi FROM lineitem" for c in MEASURES))
def column_ranges(t):
    found = profile.column_ranges(t.lineitem, MEASURES)
    return t.spark.createDataFrame([(c, *r) for c, r in found.items()], "column string, lo double, hi double")


# ------------------------------------------------------- projections, repairs

@query("project_reorder", "F1 F2", f"SELECT l_linestatus, l_returnflag, l_quantity, {KEY} FROM lineitem")
def project_reorder(t):
    slim = project.drop_columns(t.lineitem, ["l_tax", "l_discount", "l_extendedprice", "l_partkey", "l_suppkey", "l_shipdate"])
    return project.reorder_like(slim, ["l_linestatus", "l_returnflag", "l_quantity", "l_orderkey", "l_linenumber"])


@query("rows_of_cluster", "F4", "SELECT vec_id, label FROM embeddings WHERE label = 3")
def rows_of_cluster(t):
    return project.rows_of_cluster(t.embeddings.select("vec_id", "label"), "label", 3)


@query("within_range", "F5", f"SELECT o_orderkey, coalesce(o_totalprice BETWEEN 100000 AND 300000, false) AS inside FROM ({GAPPY})")
def within_range(t):
    return gappy_orders(t).select("o_orderkey", project.within_range(F.col("o_totalprice"), 100000.0, 300000.0).alias("inside"))


@query("first_rows", "F6", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def first_rows(t):
    return project.first_rows(t.orders.select("o_orderkey", "o_totalprice"), 1000, "o_orderkey")


@query("clip_to_range", "F8", f"""SELECT o_orderkey, CASE WHEN o_totalprice IS NOT NULL THEN
  greatest(least(o_totalprice, 400000.0), 50000.0) END AS o_totalprice FROM ({GAPPY})""")
def clip_to_range(t):
    return project.clip(gappy_orders(t).select("o_orderkey", "o_totalprice"), {"o_totalprice": (50000.0, 400000.0)})


@query("round_and_cast", "F9 G12", f"""SELECT {KEY}, cast(round_even(abs(l_extendedprice - 50000), 0) as bigint) AS rounded,
  cast(trunc(l_extendedprice) as bigint) AS truncated FROM lineitem""")
def round_and_cast(t):
    price = F.col("l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", project.round_to_int(price - 50000, absolute=True).alias("rounded"),
                             project.truncate_to_int(price).alias("truncated"))


@query("binarize_threshold", "F10", f"SELECT {KEY}, cast(l_quantity / 50 > 0.5 as int) AS flag FROM lineitem")
def binarize_threshold(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", project.binarize(F.col("l_quantity") / 50).alias("flag"))


@query("clamp_unit", "F11", f"SELECT {KEY}, round(CASE WHEN l_tax * 12.5 <= 1e-10 THEN 1e-10 WHEN l_tax * 12.5 >= 1 - 1e-10 "
       "THEN 1 - 1e-10 ELSE l_tax * 12.5 END, 12) AS p FROM lineitem")
def clamp_unit(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(project.clamp_unit(F.col("l_tax") * 12.5), 12).alias("p"))


@query("sqrt_roundtrip", "F12", f"SELECT {KEY}, round(sqrt(l_extendedprice), 8) AS root, l_extendedprice AS back FROM lineitem")
def sqrt_roundtrip(t):
    root = project.sqrt_transform(F.col("l_extendedprice"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(root, 8).alias("root"),
                             F.round(project.square_back(root), 6).alias("back"))


@query("row_vectors", "F13", f"SELECT {KEY}, round(list_sum([l_quantity, l_extendedprice, l_discount, l_tax]), 4) AS total, "
       "4 AS width FROM lineitem")
def row_vectors(t):
    v = t.lineitem.select("l_orderkey", "l_linenumber", project.row_vector(MEASURES).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return v.select("l_orderkey", "l_linenumber", F.round(total, 4).alias("total"), F.size("v").alias("width"))


@query("keep_non_null", "F14", f"SELECT o_orderkey, o_totalprice FROM ({GAPPY}) WHERE o_totalprice IS NOT NULL")
def keep_non_null(t):
    return project.keep_non_null(gappy_orders(t).select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("restore_types", "G12", f"SELECT {KEY}, cast(round_even(l_quantity * 1.05, 0) as int) AS l_quantity, "
       "cast(l_extendedprice as float) AS l_extendedprice FROM lineitem")
def restore_types(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 1.05).alias("l_quantity"), "l_extendedprice")
    return project.restore_types(df, {"l_quantity": "int", "l_extendedprice": "float"})


# ------------------------------------------------------------------- encoding

def intervals_sql(columns: dict[str, str], source: str | None = None) -> str:
    """E1 in SQL; `columns` maps column to table."""
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", cast({c} as varchar) AS category, count(*) AS n FROM {source or table} "
        f"WHERE {c} IS NOT NULL GROUP BY 2" for c, table in columns.items())
    return f"""SELECT "column", category, n, n / cast(total as double) AS share,
  (upto - n) / cast(total as double) AS lo, upto / cast(total as double) AS hi
FROM (SELECT *, sum(n) OVER (PARTITION BY "column") AS total, sum(n) OVER (PARTITION BY "column"
  ORDER BY n DESC, category ROWS UNBOUNDED PRECEDING) AS upto FROM ({parts}))"""


@query("category_interval", "E1", f"""SELECT "column", category, n, round(share, 9) AS share, round(lo, 9) AS lo, round(hi, 9) AS hi
FROM ({intervals_sql({"o_orderstatus": "orders", "o_orderpriority": "orders"})})""")
def category_interval(t):
    found = encode.category_intervals(t.orders, ["o_orderstatus", "o_orderpriority"])
    return found.select("column", "category", "n", *[F.round(c, 9).alias(c) for c in ("share", "lo", "hi")])


@query("category_interval_wide", "E1", f"""SELECT "column", category, n, round(lo, 9) AS lo, round(hi, 9) AS hi
FROM ({intervals_sql({"p_name": "part", "p_brand": "part", "p_type": "part"})})""")
def category_interval_wide(t):
    found = encode.category_intervals(t.part, ["p_name", "p_brand", "p_type"])
    return found.select("column", "category", "n", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


_LEFT, _RIGHT = (float(special.np_norm_cdf(x)) for x in (-3.0, 3.0))


def _encoded_sql(column: str, table: str, key: str) -> str:
    return f"""SELECT {key}, (lo + hi) / 2 + (hi - lo) / 6 * z AS x FROM (SELECT {key}, lo, hi, {S.norm_ppf('p')} AS z
  FROM (SELECT {key}, lo, hi, {_LEFT!r} + {S.md5_uniform(key, column)} * ({_RIGHT!r} - {_LEFT!r}) AS p
    FROM {table} JOIN ({intervals_sql({column: table})}) ON category = {column}))"""


@query("category_encode_values", "E2", "SELECT o_orderkey, round(x, 7) AS x FROM ("
       + _encoded_sql("o_orderpriority", "orders", "o_orderkey") + ")")
def category_encode_values(t):
    intervals = encode.category_intervals(t.orders, ["o_orderpriority"])
    made = encode.encode_categories(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], intervals,
                                    "o_orderkey", uniform=md5_uniform)
    return made.select("o_orderkey", F.round("o_orderpriority", 7).alias("x"))


_UNIT = f"""SELECT o_orderkey, lo, hi, (0 - (lo + hi) / 2) / ((hi - lo) / 6) AS a, (1 - (lo + hi) / 2) / ((hi - lo) / 6) AS b,
  {S.md5_uniform('o_orderkey', 'o_orderstatus')} AS u FROM orders
  JOIN ({intervals_sql({"o_orderstatus": "orders"})}) ON category = o_orderstatus"""


@query("category_encode_unit", "E2", f"""SELECT o_orderkey, round((lo + hi) / 2 + (hi - lo) / 6 * z, 7) AS x FROM (
  SELECT *, {S.norm_ppf('p')} AS z FROM (SELECT o_orderkey, lo, hi, fa + u * (fb - fa) AS p FROM (
    SELECT *, {S.norm_cdf('a')} AS fa, {S.norm_cdf('b')} AS fb FROM ({_UNIT}))))""")
def category_encode_unit(t):
    intervals = encode.category_intervals(t.orders, ["o_orderstatus"])
    made = encode.encode_categories(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], intervals,
                                    "o_orderkey", within_interval=False, uniform=md5_uniform)
    return made.select("o_orderkey", F.round("o_orderstatus", 7).alias("x"))


@query("category_encode_decode", "E1 E2 E3", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def category_encode_decode(t):
    columns = ["o_orderstatus", "o_orderpriority"]
    df = t.orders.select("o_orderkey", *columns)
    intervals = encode.category_intervals(df, columns)
    numbers = encode.encode_categories(df, columns, intervals, "o_orderkey")
    return encode.decode_categories(numbers, columns, intervals)


@query("decode_numbers", "E3", f"""WITH d AS (SELECT *, row_number() OVER (ORDER BY lo) AS pos, count(*) OVER () AS top
  FROM ({intervals_sql({"o_orderpriority": "orders"})})),
x AS (SELECT o_orderkey, (o_totalprice - 100000) / 300000 AS v FROM orders)
SELECT o_orderkey, category FROM x JOIN d ON (v >= lo AND v < hi) OR (v < 0 AND pos = 1) OR (v >= 1 AND pos = top)""")
def decode_numbers(t):
    intervals = encode.category_intervals(t.orders, ["o_orderpriority"])
    x = t.orders.select("o_orderkey", ((F.col("o_totalprice") - 100000) / 300000).alias("o_orderpriority"))
    return encode.decode_categories(x, ["o_orderpriority"], intervals).withColumnRenamed("o_orderpriority", "category")


@query("date_to_days", "E4", """SELECT o_orderkey, epoch(o_orderdate) / 86400.0 AS days,
  CASE WHEN o_orderkey % 50 <> 0 THEN epoch(o_orderdate) / 86400.0 END AS from_text FROM orders""")
def date_to_days(t):
    text = F.when(F.col("o_orderkey") % 50 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return encode.dates_to_days(t.orders.select("o_orderkey", F.col("o_orderdate").alias("days"), text.alias("from_text")),
                                ["days", "from_text"])


@query("days_to_date", "E5 E6", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def days_to_date(t):
    days = encode.dates_to_days(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate"])
    moved = days.withColumn("o_orderdate", F.col("o_orderdate") + 0.4 - 0.8 * (F.col("o_orderkey") % 2))
    back = encode.days_to_dates(moved, ["o_orderdate"])
    return back.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def _digits_sql(key: str, stream: str, length: int) -> str:
    return f"lpad(cast({S.md5_number(key, stream + '/0')} % {10 ** length} as varchar), {length}, '0')"


@query("synthetic_prefixed_ids", "E7", f"SELECT c_custkey, 'C' || {_digits_sql('c_custkey', 'code', 6)} AS code FROM customer")
def synthetic_prefixed_ids(t):
    p = {p.column: p for p in profile.profile_columns(customer_ids(t), order_by="c_custkey")}["code"]
    return t.customer.select("c_custkey", encode.prefixed_id(F.col("c_custkey"), p.prefix, p.digits[0], "code").alias("code"))


@query("synthetic_hyphen_ids", "E8", "SELECT c_custkey, " + " || '-' || ".join(
    _digits_sql("c_custkey", f"policy-{i}", d) for i, d in enumerate((3, 2, 6))) + " AS policy FROM customer")
def synthetic_hyphen_ids(t):
    p = {p.column: p for p in profile.profile_columns(customer_ids(t), order_by="c_custkey")}["policy"]
    return t.customer.select("c_custkey", encode.hyphenated_id(F.col("c_custkey"), p.digits, "policy").alias("policy"))


@query("repad_ids", "E9", f"SELECT c_custkey, policy FROM ({CUSTOMER_IDS})")
def repad_ids(t):
    key = F.col("c_custkey")
    short = F.concat_ws("-", (key % 1000).cast("string"), (key % 100).cast("string"), key.cast("string"))
    return t.customer.select("c_custkey", encode.repad_id(short, [3, 2, 6]).alias("policy"))


@query("id_numbers", "E10 P3", f"""SELECT c_custkey, c_custkey AS number, c_custkey % 1000 AS g1, c_custkey % 100 AS g2,
  c_custkey AS g3 FROM ({CUSTOMER_IDS})""")
def id_numbers(t):
    groups = encode.hyphen_groups(F.col("policy"))
    return customer_ids(t).select("c_custkey", encode.id_number(F.col("code")).alias("number"),
                                  *[groups[i].alias(f"g{i + 1}") for i in range(3)])


@query("minmax_scale", "E11", f"""WITH b AS (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_extendedprice) AS p0,
  max(l_extendedprice) AS p1 FROM lineitem)
SELECT {KEY}, round((l_quantity - q0) / (q1 - q0), 9) AS l_quantity, round((l_extendedprice - p0) / (p1 - p0), 9) AS l_extendedprice
FROM lineitem, b""")
def minmax_scale(t):
    columns = ["l_quantity", "l_extendedprice"]
    df = t.lineitem.select("l_orderkey", "l_linenumber", *columns)
    made = encode.minmax_scale(df, encode.minmax_bounds(df, columns))
    return made.select("l_orderkey", "l_linenumber", *[F.round(c, 9).alias(c) for c in columns])


@query("standardize", "E12", f"""WITH b AS (SELECT avg(l_quantity) AS m0, stddev_pop(l_quantity) AS s0, avg(l_extendedprice) AS m1,
  stddev_pop(l_extendedprice) AS s1 FROM lineitem)
SELECT {KEY}, round((l_quantity - m0) / s0, 7) AS l_quantity, round((l_extendedprice - m1) / s1, 7) AS l_extendedprice FROM lineitem, b""")
def standardize(t):
    columns = ["l_quantity", "l_extendedprice"]
    df = t.lineitem.select("l_orderkey", "l_linenumber", *columns)
    made = encode.standardize(df, encode.standard_moments(df, columns))
    return made.select("l_orderkey", "l_linenumber", *[F.round(c, 7).alias(c) for c in columns])


@query("one_hot", "E13", """SELECT o_orderkey, cast(o_orderstatus = 'F' as int) AS "status_F", cast(o_orderstatus = 'O' as int) AS "status_O",
  cast(o_orderstatus = 'P' as int) AS "status_P" FROM orders""")
def one_hot(t):
    df = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return encode.one_hot(df, {"status": encode.category_levels(df, "status")})


@query("binarize_labels", "E14", "SELECT doc_id, quality, cast(quality = 0 as int) AS quality_is_0, "
       "cast(quality = 1 as int) AS quality_is_1 FROM labels")
def binarize_labels(t):
    df = t.labels.select("doc_id", "quality")
    return encode.binarize_labels(df, "quality", encode.category_levels(df, "quality"))


# -------------------------------------------------------------- missing values

@query("missing_indicator", "M1", f"""SELECT *, cast(o_totalprice IS NULL as int) AS o_totalprice_missing,
  cast(o_orderpriority IS NULL as int) AS o_orderpriority_missing FROM ({GAPPY})""")
def missing_indicator(t):
    return missing.add_missing_indicators(gappy_orders(t), ["o_totalprice", "o_orderpriority"])


@query("ffill_bfill", "M2", f"""SELECT o_orderkey, coalesce(last_value(o_totalprice IGNORE NULLS) OVER w,
  first_value(o_totalprice IGNORE NULLS) OVER v) AS o_totalprice, coalesce(last_value(o_orderpriority IGNORE NULLS) OVER w,
  first_value(o_orderpriority IGNORE NULLS) OVER v) AS o_orderpriority, o_orderstatus FROM ({GAPPY})
WINDOW w AS (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  v AS (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def ffill_bfill(t):
    return missing.fill_forward_backward(gappy_orders(t), ["o_totalprice", "o_orderpriority"], "o_orderkey")


@query("mean_fill", "M3", f"""SELECT o_orderkey, round(coalesce(o_totalprice, avg(o_totalprice) OVER ()), 4) AS o_totalprice FROM ({GAPPY})""")
def mean_fill(t):
    made = missing.fill_mean(gappy_orders(t).select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    return made.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


@query("missing_reapply", "M4", f"""WITH r AS (SELECT avg(cast(o_totalprice IS NULL as int)) AS a, avg(cast(o_orderpriority IS NULL as int)) AS b FROM ({GAPPY}))
SELECT o_orderkey, CASE WHEN {S.md5_uniform('o_orderkey', 'missing:o_totalprice')} >= a THEN o_totalprice END AS o_totalprice,
  CASE WHEN {S.md5_uniform('o_orderkey', 'missing:o_orderpriority')} >= b THEN o_orderpriority END AS o_orderpriority FROM orders, r""")
def missing_reapply(t):
    columns = ["o_totalprice", "o_orderpriority"]
    rates = missing.missing_rates(gappy_orders(t), columns)
    return missing.reapply_missing(t.orders.select("o_orderkey", *columns), rates, "o_orderkey", uniform=md5_uniform)


@query("missing_by_position", "M4", f"SELECT o_orderkey, o_totalprice, o_orderpriority FROM ({GAPPY})")
def missing_by_position(t):
    columns = ["o_totalprice", "o_orderpriority"]
    return missing.reapply_missing_by_position(t.orders.select("o_orderkey", *columns), gappy_orders(t), columns, "o_orderkey")


def _broken_scores(t: Tables) -> DataFrame:
    key, q = F.col("l_orderkey"), F.col("l_quantity")
    z = F.when(key % 11 == 0, None).when(key % 13 == 0, float("nan")).when(key % 17 == 0, float("inf")).otherwise(q)
    return t.lineitem.select("l_orderkey", "l_linenumber", z.alias("z"))


_BROKEN = """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN 'nan'::double
  WHEN l_orderkey % 17 = 0 THEN 'inf'::double ELSE l_quantity END AS z FROM lineitem"""


@query("cluster_mean_fill", "M5", f"""WITH x AS ({_BROKEN}), f AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN isnan(z) THEN NULL WHEN isinf(z) THEN 0 ELSE z END AS z FROM x)
SELECT l_orderkey, l_linenumber, round(coalesce(z, avg(z) OVER (PARTITION BY l_linenumber)), 8) AS z FROM f""")
def cluster_mean_fill(t):
    finite = _broken_scores(t).withColumn("z", F.when(F.col("z") == float("inf"), 0.0).otherwise(F.col("z")))
    made = missing.fill_cluster_mean(finite, ["z"], "l_linenumber")
    return made.withColumn("z", F.round("z", 8))


@query("invalid_scores", "M6", f"""SELECT l_linenumber, 'z' AS "column", cast(sum(cast(z IS NULL OR isnan(z) as int)) as bigint) AS n_nan,
  cast(sum(coalesce(cast(isinf(z) as int), 0)) as bigint) AS n_inf FROM ({_BROKEN}) GROUP BY l_linenumber""")
def invalid_scores(t):
    return missing.invalid_scores(_broken_scores(t), ["z"], "l_linenumber")
