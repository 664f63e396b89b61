"""The query catalogue: each operator on the driver's tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright import selectors as s
from tablewright.functions import concat_rows, ngram_similarity, quantiles_nearest, value_counts
from tablewright.operators import (
    AggJoiner, AggTarget, ApplyToCols, Cleaner, CleanNullStrings, DatetimeEncoder, DropSimilar, DropUninformative, DurationToFloat, MinHashEncoder, MultiAggJoiner, OneHot, Ordinal,
    SessionEncoder, SquashingScaler, TableVectorizer, ToDatetime, ToFloat, column_associations, column_profile, fuzzy_join, left_join,
)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(oracle: str | None = None):
    """Register a function ``(t) -> DataFrame``, t reading tables by name."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(Tables(spark, sf_dir))

        run.__name__ = run.__qualname__ = function.__name__
        QUERIES[function.__name__] = run
        if oracle:
            ORACLES[function.__name__] = oracle
        return run

    return register


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Floats rounded, so that summation order does not show."""
    return df.select(*[F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{f.name}`") for f in df.schema])


@query("""
with a as (select o_custkey, count(o_totalprice) o_totalprice_count, round(coalesce(sum(o_totalprice), 0), 2) o_totalprice_sum, round(median(o_totalprice), 3) o_totalprice_median,
  min(o_totalprice) o_totalprice_min, max(o_totalprice) o_totalprice_max from orders group by 1)
select c_custkey, o_totalprice_count, o_totalprice_sum, o_totalprice_median, o_totalprice_min, o_totalprice_max from customer left join a on c_custkey = o_custkey""")
def agg_joiner_customer_orders(t):
    joiner = AggJoiner(t("orders"), ["count", "sum", "median", "min", "max"], main_key="c_custkey", aux_key="o_custkey", cols="o_totalprice")
    out = joiner.fit_transform(t("customer").select("c_custkey"))
    return out.withColumns({"o_totalprice_sum": F.round("o_totalprice_sum", 2), "o_totalprice_median": F.round("o_totalprice_median", 3)})


@query("""
with a as (select l_partkey, avg(l_quantity) l_quantity_mean, round(stddev_samp(l_quantity), 6) l_quantity_std, median(l_quantity) l_quantity_median from lineitem group by 1)
select p_partkey, l_quantity_mean, l_quantity_std, l_quantity_median from part left join a on p_partkey = l_partkey""")
def agg_joiner_part_quantity(t):
    joiner = AggJoiner(t("lineitem"), ["mean", "std", "median"], main_key="p_partkey", aux_key="l_partkey", cols="l_quantity")
    return joiner.fit_transform(t("part").select("p_partkey")).withColumn("l_quantity_std", F.round("l_quantity_std", 6))


FLAGSHIP = QUERIES["agg_joiner_customer_orders"]


@query("select o_orderkey, o_custkey, c_name, c_mktsegment from orders left join customer on o_custkey = c_custkey")
def left_join_orders_customer(t):
    return left_join(t("orders").select("o_orderkey", "o_custkey"), t("customer").select("c_custkey", "c_name", "c_mktsegment"), "o_custkey", "c_custkey")


@query("""
with n as (select o_custkey, o_orderpriority p, count(*) n from orders group by all), r as (select *, row_number() over (partition by o_custkey order by n desc, p) k from n)
select c_custkey, p as o_orderpriority_mode from customer left join (select * from r where k = 1) on c_custkey = o_custkey""")
def agg_joiner_mode(t):
    return AggJoiner(t("orders"), ["mode"], main_key="c_custkey", aux_key="o_custkey", cols=["o_orderpriority"]).fit_transform(t("customer").select("c_custkey"))


@query("""
with a as (select l_returnflag, l_linestatus, max(l_quantity) l_quantity_max, count(l_quantity) l_quantity_count from lineitem group by 1, 2)
select l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity_max, l_quantity_count from lineitem left join a using (l_returnflag, l_linestatus)""")
def agg_joiner_multi_key(t):
    line = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return AggJoiner(t("lineitem"), ["max", "count"], key=["l_returnflag", "l_linestatus"], cols=["l_quantity"]).fit_transform(line)


@query("""
with a as (select user_id, count(value) value_count, min(value) value_min from events group by 1) select event_id, user_id, value, value_count, value_min from events left join a using (user_id)""")
def agg_joiner_self(t):
    return AggJoiner("X", ["count", "min"], key="user_id", cols=["value"]).fit_transform(t("events").select("event_id", "user_id", "value"))


@query("""
with a as (select l_partkey, sum(l_quantity) l_quantity_sum_0 from lineitem group by 1), b as (select l_partkey, max(l_discount) l_discount_max_1, min(l_discount) l_discount_min_1 from lineitem group by 1)
select p_partkey, l_quantity_sum_0, l_discount_max_1, l_discount_min_1 from part left join a on p_partkey = a.l_partkey left join b on p_partkey = b.l_partkey""")
def multi_agg_joiner(t):
    line = t("lineitem")
    joiner = MultiAggJoiner([line, line], [["sum"], ["max", "min"]], main_keys=["p_partkey", "p_partkey"], aux_keys=["l_partkey", "l_partkey"], cols=[["l_quantity"], ["l_discount"]])
    return joiner.fit_transform(t("part").select("p_partkey"))


@query("""
with a as (select o_orderpriority, count(o_totalprice) o_totalprice_count_target, max(o_totalprice) o_totalprice_max_target from orders group by 1)
select o_orderkey, o_orderpriority, o_totalprice_count_target, o_totalprice_max_target from orders left join a using (o_orderpriority)""")
def agg_target(t):
    out = AggTarget("o_orderpriority", ["count", "max"], "o_totalprice").fit_transform(t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice"))
    return out.drop("o_totalprice")


_SESSIONS = """
with b as (select *, case when lag(ts) over ({by} order by ts) is null or epoch_us(ts) - epoch_us(lag(ts) over ({by} order by ts)) > 21600000000 then 1 else 0 end o from events)
select event_id, cast(sum(o) over (order by {order} rows unbounded preceding) - 1 as bigint) ts_session_id from b"""


@query(_SESSIONS.format(by="partition by user_id", order="user_id, ts"))
def session_id_user(t):
    return SessionEncoder("ts", "user_id", 6 * 3600).transform(t("events").select("event_id", "user_id", "ts")).select("event_id", "ts_session_id")


@query(_SESSIONS.format(by="", order="ts").replace("21600000000", "600000000"))
def session_id_global(t):
    return SessionEncoder("ts", None, 600).transform(t("events").select("event_id", "ts")).select("event_id", "ts_session_id")


@query(f"select ts_session_id, count(*) n from ({_SESSIONS.format(by='partition by user_id', order='user_id, ts')}) group by 1")
def session_sizes(t):
    return SessionEncoder("ts", "user_id", 6 * 3600).transform(t("events").select("user_id", "ts")).groupBy("ts_session_id").agg(F.count(F.lit(1)).alias("n"))


@query("select * from nation union all by name select * from region")
def concat_rows_relaxed(t):
    return concat_rows(t("nation"), t("region"))


@query("select o_orderkey, o_orderstatus, o_orderdate, o_orderpriority from orders")
def select_glob(t):
    return s.select(t("orders"), s.glob("o_order*"))


@query("select p_partkey, p_size, p_retailprice from part")
def select_numeric(t):
    return s.select(t("part"), s.numeric())


@query("select o_custkey, o_totalprice from orders")
def drop_regex(t):
    return s.drop(t("orders"), s.regex("o_order"))


@query("select o_orderstatus, o_orderpriority from orders")
def select_cardinality_below(t):
    return s.select(t("orders"), s.cardinality_below(10))


@query("select o_custkey_f from (select c_custkey, case when c_custkey % 3 = 0 then null else c_custkey end o_custkey_f from customer)")
def select_has_nulls(t):
    frame = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("o_custkey_f"))
    return s.select(frame, s.has_nulls())


@query("select event_id, case when event_id % 7 = 0 or event_id % 5 = 0 then null else event_type end event_type from events")
def clean_null_strings(t):
    c = F.when(F.col("event_id") % 7 == 0, "N/A").when(F.col("event_id") % 5 == 0, "  ").otherwise(F.col("event_type"))
    return ApplyToCols(CleanNullStrings(), "event_type").fit_transform(t("events").select("event_id", c.alias("event_type")))


@query("select l_orderkey, l_linenumber from lineitem")
def drop_uninformative(t):
    frame = t("lineitem").select("l_orderkey", "l_linenumber", F.lit("x").alias("same"), F.lit(None).cast("string").alias("nothing"))
    return ApplyToCols(DropUninformative(drop_if_constant=True)).fit_transform(frame)


@query("select o_orderkey, cast(date_trunc('day', o_orderdate) as timestamp) as day from orders")
def to_datetime_parse(t):
    frame = t("orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"))
    return ApplyToCols(ToDatetime(), "day").fit_transform(frame).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("select o_orderkey, cast(case when o_orderkey % 2 = 0 then -floor(o_totalprice) else floor(o_totalprice) end as double) price from orders")
def to_float_parse(t):
    text = F.format_number(F.floor("o_totalprice"), 0)
    frame = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text).alias("price"))
    return ApplyToCols(ToFloat(thousand=",", parentheses=True), "price").fit_transform(frame).withColumn("price", F.col("price").cast("double"))


@query("select l_orderkey, l_linenumber, cast(epoch(l_shipdate) - epoch(o_orderdate) as double) wait from lineitem join orders on l_orderkey = o_orderkey")
def duration_to_float(t):
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    frame = joined.select("l_orderkey", "l_linenumber", (F.col("l_shipdate") - F.col("o_orderdate")).alias("wait"))
    return ApplyToCols(DurationToFloat(), "wait").fit_transform(frame).withColumn("wait", F.col("wait").cast("double"))


@query("""select event_id, cast(year(ts) as double) ts_year, cast(month(ts) as double) ts_month, cast(day(ts) as double) ts_day, cast(hour(ts) as double) ts_hour,
cast(isodow(ts) as double) ts_weekday, cast(dayofyear(ts) as double) ts_day_of_year from events""")
def datetime_features(t):
    encoder = DatetimeEncoder(add_weekday=True, add_day_of_year=True, add_total_seconds=False)
    out = ApplyToCols(encoder, "ts").fit_transform(t("events").select("event_id", "ts"))
    return _rounded(out)


@query("""select event_id, cast(year(ts) as double) ts_year, 0.0 + round(sin(2*pi()*month(ts)/12), 4) ts_month_circular_0, 0.0 + round(cos(2*pi()*month(ts)/12), 4) ts_month_circular_1,
0.0 + round(sin(2*pi()*day(ts)/30), 4) ts_day_circular_0, 0.0 + round(cos(2*pi()*day(ts)/30), 4) ts_day_circular_1, 0.0 + round(sin(2*pi()*hour(ts)/24), 4) ts_hour_circular_0,
0.0 + round(cos(2*pi()*hour(ts)/24), 4) ts_hour_circular_1 from events""")
def datetime_circular(t):
    encoder = DatetimeEncoder(add_total_seconds=False, periodic_encoding="circular")
    out = _rounded(ApplyToCols(encoder, "ts").fit_transform(t("events").select("event_id", "ts")))
    return out.select(*[(F.col(c) + 0.0).alias(c) if "circular" in c else F.col(c) for c in out.columns])  # no minus zero


@query("""with q as (select quantile_cont(l_extendedprice, .25) a, quantile_cont(l_extendedprice, .5) m, quantile_cont(l_extendedprice, .75) b from lineitem),
z as (select l_orderkey, l_linenumber, (l_extendedprice - m) / (b - a) z from lineitem, q) select l_orderkey, l_linenumber, round(z / sqrt(1 + (z / 3) * (z / 3)), 6) l_extendedprice from z""")
def squashing_scaler(t):
    out = ApplyToCols(SquashingScaler(), "l_extendedprice").fit_transform(t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"))
    return _rounded(out, 6)


@query("""select o_orderkey, cast(o_orderstatus = 'F' as double) "o_orderstatus_F", cast(o_orderstatus = 'O' as double) "o_orderstatus_O", cast(o_orderstatus = 'P' as double) "o_orderstatus_P" from orders""")
def one_hot(t):
    return _rounded(ApplyToCols(OneHot(), "o_orderstatus").fit_transform(t("orders").select("o_orderkey", "o_orderstatus")))


@query("select o_orderkey, cast(dense_rank() over (order by o_orderpriority) - 1 as int) o_orderpriority from orders")
def ordinal(t):
    return ApplyToCols(Ordinal(), "o_orderpriority").fit_transform(t("orders").select("o_orderkey", "o_orderpriority"))


@query("""
with x as (select 'n' k, n_name v from nation union select 'r', r_name from region), p as (select k, v, ' ' || lower(v) || ' ' t from x),
g as (select k, v, substr(t, i, n) g, count(*) c from p, range(1, 40) r(i), unnest([2, 3, 4]) q(n) where i + n - 1 <= length(t) group by all), z as (select k, v, sum(c) c from g group by all),
s as (select a.v a, b.v b, sum(least(a.c, b.c)) m from g a join g b on a.g = b.g where a.k = 'n' and b.k = 'r' group by all)
select n.v n_name, r.v r_name, round(coalesce(m, 0) / (n.c + r.c - coalesce(m, 0)), 6) similarity from z n join z r on n.k = 'n' and r.k = 'r' left join s on s.a = n.v and s.b = r.v""")
def ngram_similarities(t):
    regions = [r["r_name"] for r in t("region").select("r_name").collect()]  # five rows
    pairs = t("nation").select("n_name", F.explode(F.array(*[F.lit(r) for r in regions])).alias("r_name"))
    return pairs.select("n_name", "r_name", F.round(ngram_similarity(F.col("n_name"), F.col("r_name"), 2, 4), 6).alias("similarity"))


@query()
def minhash_rows(t):
    return ApplyToCols(MinHashEncoder(10), "p_name").fit_transform(t("part").select("p_partkey", "p_name"))


@query("select n_nationkey, 'x' || n_name typo, n_name, n_nationkey k from nation")
def fuzzy_join_nation(t):
    nation = t("nation")
    typos = nation.select("n_nationkey", F.concat(F.lit("x"), "n_name").alias("typo"))
    right = nation.select("n_name", F.col("n_nationkey").alias("k"))
    return fuzzy_join(typos, right, left_on="typo", right_on="n_name")


@query("""
with x as (select l_returnflag a, l_linestatus b, count(*) n from lineitem group by all), c as (select *, sum(n) over (partition by a) na, sum(n) over (partition by b) nb, sum(n) over () t from x)
select 'l_returnflag' left_column_name, 'l_linestatus' right_column_name,
round(sqrt(greatest(0, sum(n * n / (na::double * nb)) - 1) / greatest(1, least(count(distinct a), count(distinct b)) - 1)), 6) cramer_v from c""")
def cramer_v(t):
    out = column_associations(t("lineitem").select("l_returnflag", "l_linestatus"), compute_pearson=False)
    return out.select("left_column_name", "right_column_name", F.round("cramer_v", 6).alias("cramer_v"))


@query("""select 'l_quantity' left_column_name, 'l_extendedprice' right_column_name, round(corr(l_quantity, l_extendedprice), 6) pearson_corr from lineitem
union all select 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) from lineitem
union all select 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) from lineitem""")
def pearson_pairs(t):
    out = column_associations(t("lineitem").select("l_quantity", "l_extendedprice", "l_discount"))
    return out.select("left_column_name", "right_column_name", F.round("pearson_corr", 6).alias("pearson_corr"))


@query("select o_orderkey, o_orderstatus from orders")
def drop_similar_columns(t):
    frame = t("orders").select("o_orderkey", "o_orderstatus", F.lower("o_orderstatus").alias("copy"))
    kept = DropSimilar(1.0).fit(frame.select("o_orderstatus", "copy"))
    return frame.drop(*kept.to_drop_)


@query("select o_orderpriority as value, count(*) count from orders group by 1 order by 2 desc, 1 limit 3")
def value_counts_top3(t):
    return value_counts(t("orders"), "o_orderpriority", 3)


@query("""with r as (select n_chars v, row_number() over (order by n_chars) k, count(*) over () n from documents), q as (select unnest([0.0, 0.25, 0.5, 0.75, 1.0]) q)
select 'n_chars' as "column", q::double q, v::double as value from r, q where k = round_even(q * (n - 1), 0) + 1""")
def quantiles_of_lengths(t):
    return quantiles_nearest(t("documents"), ["n_chars"], [0.0, 0.25, 0.5, 0.75, 1.0])


@query("""select column_name, n_rows, n_nulls, n_unique, round(mean, 4) mean, round(std, 4) std, min, max from (
select 'c_custkey' column_name, count(*) n_rows, count(*) - count(c_custkey) n_nulls, count(distinct c_custkey) n_unique, avg(c_custkey) mean, stddev_samp(c_custkey) std, min(c_custkey)::double min, max(c_custkey)::double max from customer
union all select 'c_acctbal', count(*), count(*) - count(c_acctbal), count(distinct c_acctbal), avg(c_acctbal), stddev_samp(c_acctbal), min(c_acctbal), max(c_acctbal) from customer
union all select 'c_mktsegment', count(*), count(*) - count(c_mktsegment), count(distinct c_mktsegment), null, null, null, null from customer)""")
def profile_customer(t):
    out = column_profile(t("customer").select("c_custkey", "c_acctbal", "c_mktsegment"))
    return out.select("column_name", "n_rows", "n_nulls", "n_unique", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max")


@query("""select o_orderkey::double o_orderkey, o_custkey::double o_custkey, cast(o_orderstatus = 'F' as double) "o_orderstatus_F", cast(o_orderstatus = 'O' as double) "o_orderstatus_O",
cast(o_orderstatus = 'P' as double) "o_orderstatus_P", cast(year(o_orderdate) as double) o_orderdate_year, cast(month(o_orderdate) as double) o_orderdate_month, cast(day(o_orderdate) as double) o_orderdate_day from orders""")
def vectorize_orders(t):
    frame = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    return _rounded(TableVectorizer(datetime=DatetimeEncoder(add_total_seconds=False)).fit_transform(frame))


@query("""select event_id, case when event_id % 4 = 0 then null else event_type end event_type, cast(event_id % 9 as double) number from events""")
def clean_events(t):
    c = F.when(F.col("event_id") % 4 == 0, "NA").otherwise(F.col("event_type"))
    frame = t("events").select("event_id", c.alias("event_type"), (F.col("event_id") % 9).cast("string").alias("number"), F.lit(None).cast("string").alias("nothing"))
    out = Cleaner(parse_numbers=True).fit_transform(frame)
    return out.withColumn("number", F.col("number").cast("double"))


@query("select conv_id, count(role) role_count, min(turn) turn_min, max(turn) turn_max from conversations group by 1")
def aggregate_conversations(t):
    from tablewright.operators import aggregate

    out = aggregate(t("conversations"), "conv_id", ["role", "turn"], ["count", "min", "max"])
    return out.select("conv_id", "role_count", "turn_min", "turn_max")
