"""Registered queries of joins over time, windows, fuzzy matches, edits and summaries, each beside its SQL.

Orders, line items and parts get times within those of the events, and arrival batches and
misreadings, by rules that the SQL repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import edits
from pagewright.operators import fuzzy, summaries, table_functions, timejoins, variants
from pagewright.plans import oracle, queries
from pagewright.sources.readers import spread
from pagewright.streaming import windows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Microseconds of the first of January 2024, and seconds of 30 days.
_BEGIN, _SPAN = 1_704_067_200_000_000, 2_592_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their times, which have no zone, as of UTC."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return table(spark, sf_dir, "events").withColumn("ts", F.timestamp_micros(micros))


def _moment(seconds) -> F.Column:
    return F.timestamp_micros(F.lit(_BEGIN) + (seconds % _SPAN) * 1_000_000)


def _seconds(time: str) -> F.Column:
    return F.floor(F.unix_micros(time) / 1_000_000).cast("long")


# Joins over time


def as_of_orders(spark, sf_dir):
    """Each order with the latest event of its user that is not later and not over two days old."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 180).alias("user_id"), _moment(F.col("o_orderkey") * 86_413).alias("at"))
    events = _events(spark, sf_dir)
    found = timejoins.as_of_join(orders, events, ["user_id"], "at", "ts", ["event_id", "event_type", "value"], tolerance=172_800)
    return found.select("o_orderkey", "event_id", "event_type", "value")


AS_OF_ORDERS = """
with o as (
  select o_orderkey, o_custkey % 180 as user_id, 1704067200000000 + (o_orderkey * 86413) % 2592000 * 1000000 as at_us from orders
), ranked as (
  select o_orderkey, at_us, epoch_us(e.ts) as t, e.event_id, e.event_type, e.value,
         row_number() over (partition by o_orderkey order by e.ts desc, e.event_id desc) as r
  from o left join events e on e.user_id = o.user_id and epoch_us(e.ts) <= o.at_us
)
select o_orderkey, case when at_us - t <= 172800000000 then event_id end as event_id,
       case when at_us - t <= 172800000000 then event_type end as event_type, case when at_us - t <= 172800000000 then value end as value
from ranked where r = 1
"""


def _shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as spans: under way for as many minutes as their quantity, now and then for days."""
    start = F.col("l_orderkey") * 7_919 + F.col("l_linenumber") * 3_607 + F.col("l_partkey") * 60
    minutes = F.col("l_quantity").cast("long") * F.when(F.col("l_partkey") % 97 == 0, 200).otherwise(1)
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("quantity"), _moment(start).alias("shipped"), minutes.alias("minutes"))
    return items.select("l_suppkey", "quantity", "shipped", F.timestamp_micros(F.unix_micros("shipped") + F.col("minutes") * 60_000_000).alias("received"))


def interval_events(spark, sf_dir):
    """Each event with how many line items were under way, and their quantity."""
    events = _events(spark, sf_dir).select("event_id", "ts")
    made = timejoins.interval_totals(events, _shipments(spark, sf_dir), "ts", "shipped", "received", "n_items", ["quantity"])
    return made.groupBy("event_id").agg(F.sum("n_items").alias("n_items"), F.sum("quantity").alias("quantity"))


def interval_users(spark, sf_dir):
    """Events of users while line items of the supplier of that number were under way."""
    events = _events(spark, sf_dir).select("event_id", "ts", (F.col("user_id") % 100).alias("l_suppkey"))
    pairs = timejoins.interval_join(events, _shipments(spark, sf_dir), "ts", "shipped", "received", ["l_suppkey"])
    return pairs.select("event_id", "l_suppkey", "quantity", (F.unix_micros("ts") - F.unix_micros("shipped")).alias("micros"))


_SHIPMENTS = """
shipped as (
  select l_suppkey, l_quantity::bigint as quantity, 1704067200000000 + (l_orderkey * 7919 + l_linenumber * 3607 + l_partkey * 60) % 2592000 * 1000000 as s,
         l_quantity::bigint * (case when l_partkey % 97 = 0 then 200 else 1 end) * 60000000 as n
  from lineitem
)
"""
INTERVAL_EVENTS = f"""
with {_SHIPMENTS}
select event_id, count(*)::bigint as n_items, sum(quantity)::bigint as quantity
from events join shipped on epoch_us(ts) >= s and epoch_us(ts) < s + n group by event_id
"""
INTERVAL_USERS = f"""
with {_SHIPMENTS}
select event_id, l_suppkey, quantity, epoch_us(ts) - s as micros
from events join shipped on user_id % 100 = l_suppkey and epoch_us(ts) >= s and epoch_us(ts) < s + n
"""


# Windows


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number of the six hours in which they arrived: some up to two days late."""
    late = F.when(F.col("event_id") % 13 == 0, F.col("event_id") % 48).otherwise(0)
    arrived = F.unix_micros("ts") - _BEGIN + late * 3_600_000_000
    cents = F.round(F.col("value") * 100).cast("long")
    return _events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", cents.alias("cents"), F.floor(arrived / 21_600_000_000).cast("int").alias("batch"))


def _measured(made: DataFrame, key: str) -> DataFrame:
    return made.select(key, _seconds("start").alias("start_s"), _seconds("end").alias("end_s"), "n", "total")


_MEASURES = lambda: [F.count("*").alias("n"), F.sum("cents").alias("total")]


def event_tumbling(spark, sf_dir):
    return _measured(windows.windowed_batches(_arrivals(spark, sf_dir), "ts", ["event_type"], _MEASURES(), "1 hour", 7_200, "batch"), "event_type")


def event_sliding(spark, sf_dir):
    return _measured(windows.windowed_batches(_arrivals(spark, sf_dir), "ts", ["event_type"], _MEASURES(), "6 hours", 7_200, "batch", "2 hours"), "event_type")


def event_sessions(spark, sf_dir):
    made = windows.session_batches(_arrivals(spark, sf_dir), "ts", "user_id", "cents", 21_600, 7_200, "batch")
    micros = lambda c: F.unix_micros(c).alias(f"{c}_us")
    return made.select("user_id", micros("start"), micros("end"), "n", "total")


def _marked(lag: int) -> str:
    return f"""
arrived as (
  select event_id, user_id, event_type, epoch_us(ts) as t, round(value * 100)::bigint as cents,
         ((epoch_us(ts) - 1704067200000000 + (case when event_id % 13 = 0 then event_id % 48 else 0 end) * 3600000000) // 21600000000)::int as batch
  from events
), tops as (
  select batch, max(t) // 1000 - 7200000 as top from arrived group by batch
), marked as (
  select a.*, (select max(top) from tops where tops.batch <= a.batch - {lag}) as mark from arrived a
)
"""


def _hopping(width: int, slide: int) -> str:
    return f"""
with {_marked(2)}, placed as (
  select *, (t // {slide} - k) * {slide} as s from marked, unnest(range(0, {width // slide})) u(k)
)
select event_type, s // 1000000 as start_s, (s + {width}) // 1000000 as end_s, count(*)::bigint as n, sum(cents)::bigint as total
from placed where mark is null or s + {width} > mark * 1000 group by event_type, s
"""


EVENT_TUMBLING, EVENT_SLIDING = _hopping(3_600_000_000, 3_600_000_000), _hopping(21_600_000_000, 7_200_000_000)
EVENT_SESSIONS = f"""
with {_marked(1)}, fresh as (
  select user_id, t, cents, case when t - lag(t) over (partition by user_id order by t) < 21600000000 then 0 else 1 end as new
  from marked where mark is null or t // 1000 > mark
), numbered as (
  select *, sum(new) over (partition by user_id order by t rows unbounded preceding) as no from fresh
)
select user_id, min(t) as start_us, max(t) + 21600000000 as end_us, count(*)::bigint as n, sum(cents)::bigint as total
from numbered group by user_id, no
"""


# Fuzzy matches and edits


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels of parts, and the same as misread."""
    whole = F.concat_ws(" ", "p_name", "p_brand", "p_type", (F.col("p_partkey") % 50).cast("string"))
    part = table(spark, sf_dir, "part").select("p_partkey", whole.alias("label"))
    read = F.when(F.col("p_partkey") % 3 == 0, F.regexp_replace("label", "[ae]", "o")).when(F.col("p_partkey") % 3 == 1, F.concat(F.substring("label", 1, 4), F.expr("substring(label, 6, 100)"))).otherwise(F.concat(F.lit("l"), F.regexp_replace("label", "Brand", "8rand")))
    return part, part.select(read.alias("misread"))


def fuzzy_labels(spark, sf_dir):
    """Distinct misread labels with all labels within two edits."""
    labels, misread = _labels(spark, sf_dir)
    made = fuzzy.fuzzy_pairs(misread, labels, "misread", "label", 2)
    return made.select(F.col("left_text").alias("misread"), F.col("right_text").alias("label"), "edits")


FUZZY_LABELS = """
with labels as (
  select p_partkey, concat_ws(' ', p_name, p_brand, p_type, (p_partkey % 50)::varchar) as label from part
), misread as (
  select distinct case p_partkey % 3 when 0 then regexp_replace(label, '[ae]', 'o', 'g') when 1 then substr(label, 1, 4) || substr(label, 6, 100)
    else 'l' || replace(label, 'Brand', '8rand') end as misread from labels
)
select misread, label, levenshtein(misread, label)::int as edits
from misread, (select distinct label from labels) l where abs(length(misread) - length(label)) <= 2 and levenshtein(misread, label) <= 2
"""


def edit_counts(spark, sf_dir):
    """Turns of conversations against a poor reading of them, in ASCII: edits, and whether their counts fit together."""
    turns = spread(table(spark, sf_dir, "conversations"))
    ref = F.regexp_replace("text", r"[^\x00-\x7f]", "?")
    pairs = turns.select("conv_id", "turn", ref.alias("ref")).withColumn("hyp", F.replace(F.replace("ref", F.lit("rn"), F.lit("m")), F.lit("e"), F.lit("c")))
    made = pairs.withColumn("c", edits.edit_counts(F.col("ref"), F.col("hyp")))
    fit = (F.col("c.substitutions") + F.col("c.deletions") + F.col("c.insertions") == F.col("c.distance")) & (F.col("c.deletions") - F.col("c.insertions") == F.length("ref") - F.length("hyp"))
    return made.select("conv_id", "turn", F.col("c.distance").cast("long").alias("distance"), fit.alias("fit"))


EDIT_COUNTS = r"""
with pairs as (
  select conv_id, turn, regexp_replace(text, '[^\x00-\x7f]', '?', 'g') as ref from conversations
)
select conv_id, turn, levenshtein(ref, replace(replace(ref, 'rn', 'm'), 'e', 'c'))::bigint as distance, (text_given)::boolean as fit
from (select *, ref is not null as text_given from pairs)
"""

# Summaries


def error_subtotals(spark, sf_dir):
    """Error rates of turns by speaker, recogniser and place in the conversation, with all subtotals."""
    turns = spread(table(spark, sf_dir, "conversations"))
    ref = F.regexp_replace("text", r"[^\x00-\x7f]", "?")
    engine = F.element_at(F.array(F.lit("left"), F.lit("right"), F.lit(None)), (F.col("conv_id") % 3 + 1).cast("int"))
    stage = F.when(F.col("turn") < 2, "opening").otherwise("rest")
    pairs = turns.select("conv_id", "role", engine.alias("engine"), stage.alias("stage"), ref.alias("ref"))
    hyp = F.replace(F.replace("ref", F.lit("rn"), F.lit("m")), F.when(F.col("engine") == "left", "e").otherwise("a"), F.lit("c"))
    dims = ["role", "engine", "stage"]
    rows = pairs.select(*dims, "conv_id", edits.edit_distance(F.col("ref"), hyp).cast("long").alias("edits"), F.length("ref").cast("long").alias("chars"))
    made = summaries.subtotals(rows, dims, summaries.cube_sets(dims), {"n_turns": F.lit(1), "edits": F.col("edits"), "chars": F.col("chars")}, {"n_convs": F.col("conv_id")})
    return made.withColumn("rate", F.col("edits") / F.col("chars"))


ERROR_SUBTOTALS = r"""
with pairs as (
  select conv_id, role, case conv_id % 3 when 0 then 'left' when 1 then 'right' end as engine, case when turn < 2 then 'opening' else 'rest' end as stage,
         regexp_replace(text, '[^\x00-\x7f]', '?', 'g') as ref
  from conversations
), rows_ as (
  select *, levenshtein(ref, replace(replace(ref, 'rn', 'm'), case when engine = 'left' then 'e' else 'a' end, 'c'))::bigint as edits, length(ref)::bigint as chars from pairs
)
select role, engine, stage, grouping(role, engine, stage)::int as level, count(*)::bigint as n_turns, sum(edits)::bigint as edits, sum(chars)::bigint as chars,
       count(distinct conv_id)::bigint as n_convs, sum(edits)::double / sum(chars)::double as rate
from rows_ group by cube (role, engine, stage)
"""


def sketched_days(spark, sf_dir):
    """Sketches of events by day and type, merged to types: whether users and values are within the stated bounds of the exact figures."""
    events = _events(spark, sf_dir)
    kept = summaries.sketched(events.withColumn("day", F.to_date("ts")), ["day", "event_type"], F.col("user_id"), F.col("value"))
    made = summaries.estimates(summaries.merged_sketches(kept, ["event_type"]), [0.5, 0.9])
    ranks = events.select(F.col("event_type").alias("t"), "user_id", "value").join(made, F.col("event_type") == F.col("t"))
    share = lambda i, upto: F.avg(((F.col("value") <= F.col("quantiles")[i]) if upto else (F.col("value") < F.col("quantiles")[i])).cast("int"))
    near = lambda i, rank: (share(i, False) - summaries.RANK_ERROR <= rank) & (share(i, True) + summaries.RANK_ERROR >= rank)
    users = F.count_distinct("user_id")
    return ranks.groupBy("event_type", "n").agg(
        users.alias("users"),
        (F.abs(F.first("distinct_estimate") - users) <= summaries.DISTINCT_ERROR * users).alias("users_near"),
        near(0, 0.5).alias("median_near"),
        near(1, 0.9).alias("ninth_near"),
    )


SKETCHED_DAYS = """
select event_type, count(*)::bigint as n, count(distinct user_id)::bigint as users, true as users_near, true as median_near, true as ninth_near
from events group by event_type
"""


def best_events(spark, sf_dir):
    """The five events of the highest value of each type."""
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return summaries.best_of_each(events, ["event_type"], [F.col("value").desc(), F.col("event_id")], 5)


BEST_EVENTS = """
select event_type, event_id, value, rank::int as rank
from (select *, row_number() over (partition by event_type order by value desc, event_id) as rank from events) where rank <= 5
"""


def _stocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as a template has them, and as they were read: some otherwise, some twice."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", (F.col("p_size") % 4).alias("size"))
    read = part.withColumn("p_type", F.when(F.col("p_partkey") % 5 == 0, F.lower("p_type")).otherwise(F.col("p_type")))
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("p_partkey") % 7 == 0, 2).otherwise(1)))
    return part.drop("p_partkey"), read.select("p_brand", "p_type", "size", twice.alias("i")).drop("i")


def reconcile_except(spark, sf_dir):
    return summaries.left_over(*_stocks(spark, sf_dir))


def reconcile_intersect(spark, sf_dir):
    return summaries.in_both(*_stocks(spark, sf_dir))


def reconcile_anti(spark, sf_dir):
    left, right = _stocks(spark, sf_dir)
    return summaries.without_match(right, left, ["p_brand", "p_type"])


def reconcile_counts(spark, sf_dir):
    return summaries.reconciled(*_stocks(spark, sf_dir))


_STOCKS = """
with template as (
  select p_brand, p_type, p_size % 4 as size from part
), read as (
  select p_brand, case when p_partkey % 5 = 0 then lower(p_type) else p_type end as p_type, p_size % 4 as size
  from part, unnest(range(0, case when p_partkey % 7 = 0 then 2 else 1 end))
)
"""
RECONCILE_EXCEPT = _STOCKS + "select * from template except all select * from read"
RECONCILE_INTERSECT = _STOCKS + "select * from template intersect all select * from read"
RECONCILE_ANTI = _STOCKS + "select r.* from read r where not exists (select 1 from template t where t.p_brand = r.p_brand and t.p_type = r.p_type)"
RECONCILE_COUNTS = (
    _STOCKS
    + """, one as (select p_brand, p_type, size, count(*)::bigint as n_left from template group by all),
two as (select p_brand, p_type, size, count(*)::bigint as n_right from read group by all)
select p_brand, p_type, size, coalesce(n_left, 0)::bigint as n_left, coalesce(n_right, 0)::bigint as n_right
from one full join two using (p_brand, p_type, size) where coalesce(n_left, 0) <> coalesce(n_right, 0)
"""
)

# Table functions of SQL, and variants


def pages_in_sql(spark, sf_dir):
    """Pages of conversations' texts, by the table function."""
    table_functions.register(spark)
    docs = queries.lines.document_texts(queries.lines.page_texts(queries._turn_lines(spark, sf_dir)))
    return spark.sql("SELECT d.doc, p.* FROM {docs} d, LATERAL pagewright_pages(d.text) p", docs=docs)


def best_lines_in_sql(spark, sf_dir):
    """The merge of two recognisers' lines, by the table function over pages."""
    table_functions.register(spark)
    ranked = queries.lines.ranked(*queries._engine_lines(spark, sf_dir)).withColumns({"seq": F.col("seq").cast("int"), "engine_rank": F.col("engine_rank").cast("int")})
    call = "SELECT page, seq, text, confidence, engine FROM pagewright_best_lines(TABLE(SELECT * FROM {lines}) PARTITION BY (doc, page) ORDER BY (engine_rank, seq))"
    return spark.sql(call, lines=ranked)


PAGES_IN_SQL, BEST_LINES_IN_SQL = oracle.ORACLE_SQL["split_pages"], oracle.ORACLE_SQL["ensemble_merge"]


def variant_rules(spark, sf_dir):
    """Nations as rules of their region's program, in JSON of three shapes by region."""
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    label = F.collect_list(F.struct(F.concat(F.lit(">= "), F.col("n_nationkey").cast("string")).alias("value"), F.col("n_name").alias("label")))
    each = both.groupBy("r_regionkey", "r_name").agg(label.alias("labelled"), F.collect_list("n_name").alias("names"))
    name, nations = F.col("r_name"), F.lit("nations").alias("category")
    plain = F.to_json(F.struct(F.create_map(name, F.array(F.struct(nations, F.lit(True).alias("present"), F.col("labelled").alias("values")))).alias("programs")))
    listed = F.to_json(F.struct(F.array(F.struct(name.alias("program"), F.struct(nations, F.lit("yes").alias("present"), F.col("names").alias("values")).alias("rules"))).alias("programs")))
    bare = F.to_json(F.struct(F.create_map(name, F.struct(nations, F.size("names").alias("values"), F.lit("counted").alias("summary"))).alias("programs")))
    shape = F.when(F.col("r_regionkey") % 3 == 0, plain).when(F.col("r_regionkey") % 3 == 1, listed).otherwise(bare)
    return variants.flat_rules(each.select(shape.alias("t")), "t")


VARIANT_RULES = """
select r_name as program, 'nations' as category, true as present, case r_regionkey % 3 when 0 then n_name end as label,
       case r_regionkey % 3 when 0 then '>= ' || n_nationkey else n_name end as value, null::varchar as summary
from nation join region on n_regionkey = r_regionkey where r_regionkey % 3 <> 2
union all
select r_name, 'nations', null, null, count(*)::varchar, 'counted' from nation join region on n_regionkey = r_regionkey where r_regionkey % 3 = 2 group by r_name
"""


def payload_keys(spark, sf_dir):
    """Keys of events' payloads by type, whatever they are, with the sum of those that are whole numbers."""
    rows = variants.payload_keys(table(spark, sf_dir, "events"), "props", ["event_type"])
    return rows.groupBy("event_type", "key", "kind").agg(F.count("*").alias("n"), F.sum(F.expr("try_cast(value as bigint)")).alias("total"))


PAYLOAD_KEYS = r"""
select event_type, 'k' as key, 'BIGINT' as kind, count(*)::bigint as n, sum(regexp_extract(props, '"k": (-?\d+)', 1)::bigint)::bigint as total
from events where regexp_matches(props, '"k": -?\d+') group by event_type
"""

_NAMES = (
    "as_of_orders interval_events interval_users event_tumbling event_sliding event_sessions fuzzy_labels edit_counts "
    "error_subtotals sketched_days best_events reconcile_except reconcile_intersect reconcile_anti reconcile_counts "
    "pages_in_sql best_lines_in_sql variant_rules payload_keys"
)
QUERIES = {name: globals()[name] for name in _NAMES.split()}
ORACLE_SQL = {name: globals()[name.upper()] for name in _NAMES.split()}
