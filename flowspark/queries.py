"""The registered queries of the conserved-flow engine: operators over flows derived from the test tables, with DuckDB SQL.

FLOW makes transfers of the order tables: a line item moves its quantity from its supplier's nation to its customer's
market segment in its ship month. FORCING makes hourly series of the events. Models for the executors are documents
whose forcings and parameters are fixed here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import numeric as N
from .functions import quantum as Q
from .operators import execute, ledger, partition, projection, runlog, series, sweep, validate
from .plans import builders as B
from .plans.expr import Expr, add, clamp, compare, divide, forcing, lit, maximum, minimum, multiply, param, power, select, subtract, table_lookup
from .plans.model import Model
from .sources import log
from .sources.documents import forcing_violations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FIRST, LAST = 0, 83
QUANTUM = 0.01


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.strip()
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flow(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """Transfers; a run is a market segment's year of orders, so that windows by run are many."""
    t = lambda n: table(spark, sf_dir, n)
    rows = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.concat(F.lit("y"), F.year("o_orderdate").cast("string")).alias("run_id"),
            ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("long").alias("timestep"),
            F.concat(F.lit("sup-"), F.col("s_nationkey").cast("string")).alias("source"),
            F.concat(F.lit("mkt-"), F.lower("c_mktsegment")).alias("target"),
            F.lower("l_returnflag").alias("substance"),
            F.col("l_quantity").cast("long").alias("count"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        )
    )
    if not numbered:
        return rows
    # runs are few and long: records are numbered by run and timestep, from the number of those of the run's earlier timesteps on
    counts = rows.groupBy(F.col("run_id").alias("__run"), F.col("timestep").alias("__step")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("__run").orderBy("__step").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__run", "__step", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    order = Window.partitionBy("run_id", "timestep").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = rows.withColumn("__place", F.row_number().over(order))
    rows = rows.join(F.broadcast(counts), F.col("run_id").eqNullSafe(F.col("__run")) & F.col("timestep").eqNullSafe(F.col("__step"))).withColumn("seq", F.col("__before") + F.col("__place"))
    return rows.select("run_id", "seq", "timestep", "source", F.lit("boundary").alias("source_kind"), "target", F.lit("finite").alias("target_kind"), "substance", "count", (F.col("count").cast("double") * F.lit(QUANTUM)).alias("amount"))


_FLOW = """flow AS (SELECT 'y' || year(o_orderdate)::VARCHAR AS run_id, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::BIGINT AS timestep,
  'sup-' || s_nationkey::VARCHAR AS source, 'mkt-' || lower(c_mktsegment) AS target, lower(l_returnflag) AS substance, l_quantity::BIGINT AS count,
  l_quantity::BIGINT::DOUBLE * 0.01::DOUBLE AS amount,
  row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1), l_orderkey, l_linenumber, l_partkey, l_suppkey)::BIGINT AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey)"""
_LEGS = _FLOW + """,
legs AS (SELECT run_id, seq, timestep, source AS endpoint, substance, -count AS delta FROM flow UNION ALL SELECT run_id, seq, timestep, target, substance, count FROM flow)"""


# facts and series


@query(f"WITH {_FLOW} SELECT run_id, timestep, target AS endpoint, substance, sum(count)::BIGINT AS count FROM flow GROUP BY ALL")
def fact_incoming(spark, sf_dir):
    return series.facts(flow(spark, sf_dir, False), "incoming")


@query(f"WITH {_FLOW} SELECT run_id, timestep, source AS endpoint, substance, sum(count)::BIGINT AS count FROM flow GROUP BY ALL")
def fact_outgoing(spark, sf_dir):
    return series.facts(flow(spark, sf_dir, False), "outgoing")


@query(f"""WITH {_FLOW}, f AS (SELECT run_id, source AS endpoint, substance, timestep, sum(count)::BIGINT AS count FROM flow GROUP BY ALL),
k AS (SELECT DISTINCT run_id, endpoint, substance FROM f), s AS (SELECT unnest(range(0, 84))::BIGINT AS timestep)
SELECT run_id, endpoint, substance, timestep, coalesce(count, 0)::BIGINT AS count FROM k CROSS JOIN s LEFT JOIN f USING (run_id, endpoint, substance, timestep)""")
def dense_count_series(spark, sf_dir):
    return series.dense_counts(flow(spark, sf_dir, False), "outgoing", FIRST, LAST)


@query(f"""WITH {_FLOW}, f AS (SELECT run_id, target AS endpoint, substance, timestep, list_reduce(list_prepend(0::DOUBLE, list(amount ORDER BY seq)), lambda a, x: a + x) AS amount FROM flow GROUP BY ALL),
k AS (SELECT DISTINCT run_id, endpoint, substance FROM f), s AS (SELECT unnest(range(0, 84))::BIGINT AS timestep)
SELECT run_id, endpoint, substance, timestep, coalesce(amount, 0::DOUBLE) AS amount FROM k CROSS JOIN s LEFT JOIN f USING (run_id, endpoint, substance, timestep)""")
def dense_amount_series(spark, sf_dir):
    return series.dense_amounts(flow(spark, sf_dir), "incoming", FIRST, LAST)


_RANGED = """WITH {flow}, f AS (SELECT timestep, sum(count)::BIGINT AS count FROM flow WHERE source = 'sup-7' AND substance = '{sub}' GROUP BY timestep),
s AS (SELECT unnest(range(-3, 91))::BIGINT AS timestep), p AS (SELECT timestep, CASE WHEN NOT {modelled} THEN 'not_modelled' WHEN timestep BETWEEN 0 AND 83 THEN 'present' ELSE 'absent' END AS presence, count FROM s LEFT JOIN f USING (timestep))
SELECT timestep, presence, CASE WHEN presence = 'present' THEN coalesce(count, 0) END AS count, CASE WHEN presence = 'present' THEN coalesce(count, 0)::DOUBLE * 0.01::DOUBLE END AS value FROM p"""


@query(_RANGED.format(flow=_FLOW, sub="a", modelled="true"))
def series_presence_range(spark, sf_dir):
    return series.ranged(flow(spark, sf_dir, False), "outgoing", "sup-7", "a", (FIRST, LAST), (-3, 90), QUANTUM)


@query(_RANGED.format(flow=_FLOW, sub="x", modelled="false"))
def series_not_modelled(spark, sf_dir):
    return series.ranged(flow(spark, sf_dir, False), "outgoing", "sup-7", "x", (FIRST, LAST), (-3, 90), None, modelled=False).withColumn("value", F.col("value").cast("double"))


_HOUR0 = 1704067200


@query(f"""SELECT event_id, CASE WHEN u >= {_HOUR0} AND (u - {_HOUR0}) % 3600 = 0 THEN ((u - {_HOUR0}) // 3600)::BIGINT END AS timestep,
({_HOUR0} + (event_id % 720) * 3600)::BIGINT AS instant FROM (SELECT event_id, ((floor(epoch(ts))::BIGINT // 1800) * 1800)::BIGINT AS u FROM events)""")
def series_at_instant(spark, sf_dir):
    u = F.floor(F.unix_timestamp("ts") / 1800) * 1800
    return table(spark, sf_dir, "events").select("event_id", series.index_of(u, _HOUR0, 3600).alias("timestep"), series.instant_of(F.col("event_id") % 720, _HOUR0, 3600).alias("instant"))


# replay


@query(f"WITH {_LEGS} SELECT run_id, seq, timestep, endpoint, substance, delta FROM legs")
def signed_legs(spark, sf_dir):
    return ledger.signed_legs(flow(spark, sf_dir))


@query(f"WITH {_LEGS} SELECT run_id, substance, sum(delta)::BIGINT AS net, sum(abs(delta))::BIGINT AS moved FROM legs GROUP BY ALL")
def conservation_totals(spark, sf_dir):
    return ledger.conservation_totals(flow(spark, sf_dir))


@query(f"WITH {_LEGS} SELECT run_id, seq, timestep, endpoint, substance, delta, sum(delta) OVER (PARTITION BY run_id, endpoint, substance ORDER BY seq)::BIGINT AS balance FROM legs")
def stock_replay_record(spark, sf_dir):
    return ledger.replay_records(flow(spark, sf_dir))


@query(f"""WITH {_LEGS}, s AS (SELECT run_id, endpoint, substance, timestep, sum(delta)::BIGINT AS delta FROM legs GROUP BY ALL)
SELECT *, sum(delta) OVER (PARTITION BY run_id, endpoint, substance ORDER BY timestep)::BIGINT AS balance FROM s""")
def stock_replay_timestep(spark, sf_dir):
    return ledger.replay_timesteps(flow(spark, sf_dir, False).withColumn("seq", F.lit(0)))


@query(f"""WITH {_LEGS}, s AS (SELECT run_id, endpoint, substance, timestep, sum(delta)::BIGINT AS delta FROM legs GROUP BY ALL),
c AS (SELECT DISTINCT run_id, endpoint, substance FROM s), t AS (SELECT unnest(range(0, 84))::BIGINT AS timestep)
SELECT run_id, endpoint, substance, timestep, sum(coalesce(delta, 0)) OVER (PARTITION BY run_id, endpoint, substance ORDER BY timestep)::BIGINT AS balance FROM c CROSS JOIN t LEFT JOIN s USING (run_id, endpoint, substance, timestep)""")
def stock_snapshots(spark, sf_dir):
    moves = flow(spark, sf_dir, False).withColumn("seq", F.lit(0))
    steps = moves.select("run_id").distinct().select("run_id", F.explode(F.sequence(F.lit(FIRST).cast("long"), F.lit(LAST).cast("long"))).alias("timestep"))
    return ledger.snapshots(moves, steps)


@query(f"WITH {_LEGS} SELECT run_id, endpoint, substance, sum(delta)::BIGINT AS balance FROM legs GROUP BY ALL")
def final_stock(spark, sf_dir):
    return ledger.final_stock(flow(spark, sf_dir, False).withColumn("seq", F.lit(0)))


_BACK = """back AS (SELECT run_id, seq, timestep, target AS source, source AS target, substance, count FROM flow WHERE seq % 3 = 0
  UNION ALL SELECT run_id, seq, timestep, source, target, substance, count FROM flow WHERE seq % 3 <> 0)"""


def _mixed(spark, sf_dir):
    """FLOW with every third transfer turned round, so that markets can overdraw."""
    f = flow(spark, sf_dir)
    turn = F.col("seq") % 3 == 0
    swap = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
    return f.select("run_id", "seq", "timestep", swap("source", "target").alias("source"), swap("source_kind", "target_kind").alias("source_kind"), swap("target", "source").alias("target"), swap("target_kind", "source_kind").alias("target_kind"), "substance", "count", "amount")


@query(f"""WITH {_FLOW}, {_BACK}, legs AS (SELECT run_id, seq, timestep, source AS endpoint, substance, -count AS delta FROM back UNION ALL SELECT run_id, seq, timestep, target, substance, count FROM back),
b AS (SELECT *, sum(delta) OVER (PARTITION BY run_id, endpoint, substance ORDER BY seq)::BIGINT AS balance FROM legs)
SELECT run_id, seq, timestep, endpoint, substance, delta, balance FROM b WHERE balance < 0 AND delta < 0 AND endpoint LIKE 'mkt-%'""")
def overdraw_violations(spark, sf_dir):
    return ledger.overdrafts(_mixed(spark, sf_dir))


@query(f"WITH {_LEGS} SELECT endpoint, substance, sum(delta)::BIGINT AS balance, sum(delta)::DOUBLE * 0.01::DOUBLE AS amount FROM legs WHERE endpoint LIKE 'sup-%' GROUP BY ALL")
def boundary_balance(spark, sf_dir):
    sums = ledger.final_stock(flow(spark, sf_dir, False).withColumn("seq", F.lit(0))).where(F.col("endpoint").startswith("sup-"))
    sums = sums.groupBy("endpoint", "substance").agg(F.sum("balance").alias("balance"))
    return sums.withColumn("amount", Q.to_amount(F.col("balance"), F.lit(QUANTUM)))


_SEALS = "seals AS (SELECT run_id, 83::BIGINT AS final_timestep, (count(*) + CASE WHEN run_id = 'y1996' THEN 1 ELSE 0 END)::BIGINT AS transfer_count FROM flow WHERE run_id <> 'y1995' GROUP BY run_id)"


@query(f"""WITH {_FLOW}, {_SEALS}, r AS (SELECT run_id, count(*)::BIGINT AS transfers, max(timestep) AS last_timestep FROM flow GROUP BY run_id)
SELECT run_id, transfers, last_timestep, final_timestep, transfer_count, CASE WHEN transfer_count IS NULL THEN 'resumable' WHEN transfer_count = transfers AND last_timestep <= final_timestep THEN 'complete' ELSE 'seal_mismatch' END AS status FROM r LEFT JOIN seals USING (run_id)""")
def run_status(spark, sf_dir):
    moves = flow(spark, sf_dir, False)
    seals = ledger.seal(moves, LAST).where("run_id <> 'y1995'").withColumn("transfer_count", F.col("transfer_count") + F.when(F.col("run_id") == "y1996", 1).otherwise(0))
    return ledger.run_status(moves, seals)


@query(f"WITH {_FLOW} SELECT run_id, max(timestep) AS final_timestep, count(*)::BIGINT AS transfer_count, sum(count)::BIGINT AS moved FROM flow GROUP BY run_id")
def completion_seal(spark, sf_dir):
    return ledger.seal(flow(spark, sf_dir, False))


@query(f"""WITH {_FLOW}, x AS (SELECT run_id, seq, (timestep - CASE WHEN seq % 11 = 0 THEN 2 ELSE 0 END)::BIGINT AS timestep FROM flow), y AS (SELECT *, lag(timestep) OVER (PARTITION BY run_id ORDER BY seq) AS previous FROM x)
SELECT run_id, seq, timestep, previous FROM y WHERE timestep < previous""")
def append_order_violations(spark, sf_dir):
    moves = flow(spark, sf_dir).withColumn("timestep", F.col("timestep") - F.when(F.col("seq") % 11 == 0, 2).otherwise(0))
    return ledger.order_violations(moves).select("run_id", "seq", "timestep", "previous")


_EDGES = "edges AS (SELECT DISTINCT source, target FROM flow WHERE (length(source) + length(target)) % 3 <> 0)"


def _edges(moves: DataFrame) -> DataFrame:
    return moves.select("source", "target").distinct().where((F.length("source") + F.length("target")) % 3 != 0)


@query(f"WITH {_FLOW}, {_EDGES} SELECT run_id, seq, source, target FROM flow SEMI JOIN edges USING (source, target)")
def edge_semi(spark, sf_dir):
    moves = flow(spark, sf_dir)
    return ledger.declared(moves, _edges(moves)).select("run_id", "seq", "source", "target")


@query(f"WITH {_FLOW}, {_EDGES} SELECT run_id, seq, source, target FROM flow ANTI JOIN edges USING (source, target)")
def edge_anti(spark, sf_dir):
    moves = flow(spark, sf_dir)
    return ledger.undeclared(moves, _edges(moves)).select("run_id", "seq", "source", "target")


@query(f"""WITH {_FLOW}, e AS (SELECT DISTINCT target AS endpoint FROM flow UNION SELECT 'mkt-none'), m AS (SELECT run_id, seq, source, CASE WHEN seq % 13 = 0 THEN source WHEN seq % 17 = 0 THEN 'nowhere' ELSE target END AS target FROM flow)
SELECT run_id, seq, CASE WHEN source = target THEN 'SelfTransfer' ELSE 'UnknownEndpoint' END AS violation FROM m WHERE source = target OR target = 'nowhere'""")
def self_transfer(spark, sf_dir):
    moves = flow(spark, sf_dir)
    ends = moves.select(F.col("source").alias("endpoint"), F.lit("boundary").alias("kind")).unionAll(moves.select("target", F.lit("finite"))).distinct()
    moves = moves.withColumn("target", F.when(F.col("seq") % 13 == 0, F.col("source")).when(F.col("seq") % 17 == 0, "nowhere").otherwise(F.col("target")))
    return validate.endpoint_kinds(moves.withColumn("target_kind", F.when(F.col("target") == F.col("source"), "boundary").otherwise("finite")), ends)


@query(f"""WITH {_FLOW}, e AS (SELECT DISTINCT target AS endpoint FROM flow UNION SELECT 'mkt-none'), s AS (SELECT DISTINCT substance FROM flow), i AS (SELECT target AS endpoint, substance, sum(count)::BIGINT AS count FROM flow WHERE substance <> 'r' GROUP BY ALL)
SELECT endpoint, 'finite' AS kind, substance, coalesce(count, 0)::BIGINT AS count FROM e CROSS JOIN s LEFT JOIN i USING (endpoint, substance)""")
def seed_cells(spark, sf_dir):
    moves = flow(spark, sf_dir, False)
    ends = moves.select(F.col("target").alias("endpoint")).distinct().unionAll(spark.sql("SELECT 'mkt-none'")).withColumn("kind", F.lit("finite"))
    stocks = moves.where("substance <> 'r'").groupBy(F.col("target").alias("endpoint"), "substance").agg(F.sum("count").alias("count"))
    return ledger.seed_cells(ends, moves.select("substance").distinct(), stocks)


@query(f"""WITH {_FLOW}, f AS (SELECT *, CASE WHEN seq % 19 = 0 THEN amount + 0.001::DOUBLE ELSE amount END AS a FROM flow) SELECT run_id, seq, substance, count, a AS amount FROM f WHERE a <> count::DOUBLE * 0.01::DOUBLE""")
def inexact_amounts(spark, sf_dir):
    moves = flow(spark, sf_dir).withColumn("amount", F.col("amount") + F.when(F.col("seq") % 19 == 0, 0.001).otherwise(0.0))
    units = moves.select("substance").distinct().withColumn("quantum", F.lit(QUANTUM))
    return ledger.inexact(moves, units).select("run_id", "seq", "substance", "count", "amount")


@query(f"""WITH {_FLOW}, p AS (SELECT run_id, seq, timestep, source, target, substance, count + CASE WHEN seq = 40 AND run_id <> 'y1995' THEN 1 ELSE 0 END AS count FROM flow WHERE seq <= 100)
SELECT run_id, min(p.seq) AS seq FROM p LEFT JOIN flow f USING (run_id, seq) WHERE f.count IS NULL OR p.count <> f.count OR p.timestep <> f.timestep OR p.source <> f.source OR p.target <> f.target OR p.substance <> f.substance GROUP BY run_id""")
def resume_divergence(spark, sf_dir):
    moves = flow(spark, sf_dir)
    ends = moves.groupBy(F.col("run_id").alias("run")).agg(F.max("timestep").alias("last"))
    # the log as it stood before each run's last timestep; what it holds beyond the oracle's prefix agrees with the run
    stored = moves.join(ends, F.col("run_id") == F.col("run")).where("seq <= 100 OR timestep < last").drop("run", "last").withColumn("count", F.col("count") + F.when((F.col("seq") == 40) & (F.col("run_id") != "y1995"), 1).otherwise(0))
    return ledger.divergence(stored, moves)


# logs as evidence


@query(f"""WITH {_FLOW}, n AS (SELECT run_id, count(*)::BIGINT AS n, max(timestep) AS reached FROM flow GROUP BY run_id)
SELECT run_id, CASE run_id WHEN 'y1993' THEN 'AlreadySealed' WHEN 'y1996' THEN 'SealTransferCount' WHEN 'y1997' THEN 'SealDigest' ELSE 'SealFinalTimestep' END AS violation FROM n WHERE run_id IN ('y1993', 'y1996', 'y1997', 'y1998')
UNION ALL SELECT run_id, 'RecordAfterSeal' FROM flow WHERE run_id = 'y1994' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq) > (SELECT n - 2 FROM n WHERE run_id = 'y1994')""")
def seal_verification(spark, sf_dir):
    """Seals of the flow's runs: 1995 has none, 1994's stands two records before the end, and others are forged."""
    moves = flow(spark, sf_dir)
    digests = log.log_digests(moves)
    run = F.col("run_id")
    seals = digests.join(ledger.seal(moves, LAST).select("run_id", "final_timestep"), "run_id").where(run != "y1995")
    seals = seals.select(
        "run_id", F.when(run == "y1998", 10).otherwise(F.col("final_timestep")).cast("long").alias("final_timestep"),
        (F.col("transfer_count") + F.when(run == "y1996", 1).when(run == "y1994", -2).otherwise(0)).alias("transfer_count"), F.when(run == "y1997", "0").otherwise(F.col("log_digest")).alias("log_digest"),
    )
    seals = seals.unionAll(seals.where(run == "y1993"))
    begun = moves.select("run_id").distinct().select("run_id", F.lit("m").alias("model_digest"), F.lit("v1").alias("numerical_semantics"), F.lit("e").alias("endpoint"), F.lit("s").alias("substance"))
    return runlog.log_violations(begun, moves, seals, digests=digests).select("run_id", "violation")


@query(f"""WITH {_FLOW}, r AS (SELECT DISTINCT run_id FROM flow), c AS (SELECT target AS endpoint, substance, sum(count)::BIGINT AS count FROM flow GROUP BY ALL)
SELECT run_id, 'ModelDigestMismatch' AS violation FROM r WHERE run_id = 'y1993' UNION ALL SELECT run_id, 'ModelArtifactNotFound' FROM r WHERE run_id = 'y1994' UNION ALL SELECT run_id, 'NumericalSemanticsMismatch' FROM r WHERE run_id = 'y1995'
UNION ALL SELECT run_id, 'GenesisStocksMismatch' FROM r WHERE run_id = 'y1996' UNION ALL SELECT run_id, 'GenesisTopologyMismatch' FROM r WHERE run_id IN ('y1997', 'y1998')""")
def genesis_mismatch(spark, sf_dir):
    """Beginnings of the flow's runs, most of them not what their model says."""
    moves = flow(spark, sf_dir, False)
    cells = moves.groupBy(F.col("target").alias("endpoint"), "substance").agg(F.sum("count").alias("count"))
    run = F.col("run_id")
    runs = moves.select("run_id").distinct()
    begun = runs.crossJoin(F.broadcast(cells)).select("run_id", F.when(run == "y1993", "other").otherwise("m").alias("model_digest"), F.when(run == "y1995", "v0").otherwise("v1").alias("numerical_semantics"), "endpoint", "substance", (F.col("count") + F.when((run == "y1996") & (F.col("substance") == "r"), 1).otherwise(0)).alias("count"))
    begun = begun.where((run != "y1997") | (F.col("endpoint") != "mkt-building"))
    begun = begun.withColumn("endpoint", F.when((run == "y1998") & (F.col("endpoint") == "mkt-building"), "mkt-none").otherwise(F.col("endpoint")))
    held = runs.where(run != "y1994").withColumn("model_digest", F.lit("m"))
    return runlog.genesis_violations(begun, cells, held).select("run_id", "violation")


@query(f"""WITH {_FLOW}, e AS (SELECT run_id, max(timestep) AS last FROM flow GROUP BY run_id), d AS (SELECT run_id, min(seq) AS seq FROM flow JOIN e USING (run_id) WHERE timestep < last AND seq % 1000 = 7 AND run_id IN ('y1994', 'y1996') GROUP BY run_id)
SELECT run_id, count(*)::BIGINT AS transfers, CASE WHEN count(d.seq) > 0 THEN min(d.seq) END AS differs FROM flow LEFT JOIN d USING (run_id) GROUP BY run_id""")
def resume_replay(spark, sf_dir):
    """Prefixes up to each run's last timestep, two of them altered in every thousandth record: whole logs in place of those that agree."""
    moves = flow(spark, sf_dir)
    ends = moves.groupBy("run_id").agg(F.max("timestep").alias("last"), F.count("*").alias("all"))
    odd = (F.col("seq") % 1000 == 7) & F.col("run_id").isin("y1994", "y1996")
    stored = moves.join(ends, "run_id").where("timestep < last").withColumn("count", F.col("count") + F.when(odd, 1).otherwise(0))
    whole, differs = runlog.replaced(stored, moves)
    kept = whole.groupBy("run_id").agg(F.count("*").alias("n"))
    out = ends.join(kept, "run_id", "left").join(differs.withColumnRenamed("seq", "differs"), "run_id", "left")
    return out.select("run_id", F.coalesce("n", "all").alias("transfers"), "differs")


@query(f"""WITH {_LEGS}, r AS (SELECT run_id, max(timestep) AS last FROM flow GROUP BY run_id), c AS (SELECT DISTINCT endpoint, substance FROM legs UNION ALL SELECT 'mkt-none', 'z'),
m AS (SELECT run_id, endpoint, substance, sum(delta)::BIGINT AS moved FROM legs WHERE timestep <= 40 GROUP BY ALL), s AS (SELECT run_id, endpoint, substance, CASE WHEN endpoint = 'mkt-none' THEN 'not_modelled' WHEN last >= 40 THEN 'present' ELSE 'absent' END AS presence, moved FROM r CROSS JOIN c LEFT JOIN m USING (run_id, endpoint, substance))
SELECT run_id, endpoint, substance, presence, CASE WHEN presence = 'present' THEN 5 + coalesce(moved, 0) END::BIGINT AS balance FROM s""")
def state_at(spark, sf_dir):
    """Every cell's balance at timestep 40: absent in the runs that end before, not modelled where no cell is."""
    moves = flow(spark, sf_dir, False).withColumn("seq", F.lit(0))
    cells = ledger.signed_legs(moves).select("endpoint", "substance").distinct().select("endpoint", "substance", F.lit(5).cast("long").alias("count"), F.lit(True).alias("modelled"))
    cells = cells.unionAll(spark.sql("SELECT 'mkt-none', 'z', 0L, false"))
    return runlog.state_at(moves, cells, moves.groupBy("run_id").agg(F.max("timestep").alias("last_timestep")), 40, FIRST)


_HUGE = 1 << 40


@query(f"""WITH {_LEGS}, b AS (SELECT run_id, seq, timestep, endpoint, substance, delta * {_HUGE} AS delta, sum(delta * {_HUGE}) OVER (PARTITION BY run_id, endpoint, substance ORDER BY seq) AS balance FROM legs)
SELECT run_id, seq, timestep, endpoint, substance, delta::BIGINT AS delta, balance::BIGINT AS balance FROM b WHERE abs(balance) > {Q.MAX_COUNT}""")
def count_ceiling(spark, sf_dir):
    return ledger.over_ceiling(flow(spark, sf_dir).withColumn("count", F.col("count") * F.lit(_HUGE)))


# expressions, over line items


def _compiled(expr: Expr, **columns: str):
    out = expr.column(lambda x: F.col(columns[x.name]), {})
    return N.finite(out) if expr.value_kind == "scalar" else out


_P, _D, _T, _QTY = param("price"), param("discount"), param("tax"), param("quantity")
_NAMES = {"price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "quantity": "l_quantity"}
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_KEYSQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _items(spark, sf_dir, **exprs: Expr) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*_KEYS, *[_compiled(e, **_NAMES).alias(n) for n, e in exprs.items()])


@query(f"SELECT {_KEYSQL}, l_extendedprice * (1::DOUBLE - l_discount) * (1::DOUBLE + l_tax) AS charge, l_extendedprice / l_quantity AS unit_price FROM lineitem")
def expr_arithmetic(spark, sf_dir):
    return _items(spark, sf_dir, charge=multiply(multiply(_P, subtract(lit(1), _D)), add(lit(1), _T)), unit_price=divide(_P, _QTY))


@query(f"SELECT {_KEYSQL}, pow(l_quantity, 2::DOUBLE) AS square, pow(l_quantity * l_quantity, 0.5::DOUBLE) AS root FROM lineitem")
def expr_power(spark, sf_dir):
    return _items(spark, sf_dir, square=power(_QTY, lit(2)), root=power(multiply(_QTY, _QTY), lit(0.5)))


@query(f"SELECT {_KEYSQL}, least(l_discount, l_tax) AS low, greatest(l_discount, l_tax) AS high, least(greatest(l_quantity, 10::DOUBLE), 40::DOUBLE) AS clamped FROM lineitem")
def expr_minmax_clamp(spark, sf_dir):
    return _items(spark, sf_dir, low=minimum(_D, _T), high=maximum(_D, _T), clamped=clamp(_QTY, lit(10), lit(40)))


@query(f"SELECT {_KEYSQL}, l_discount = l_tax AS eq, l_discount <> l_tax AS ne, l_discount < l_tax AS lt, l_discount <= l_tax AS le, l_discount > l_tax AS gt, l_discount >= l_tax AS ge FROM lineitem")
def expr_compare(spark, sf_dir):
    ops = dict(zip(("eq", "ne", "lt", "le", "gt", "ge"), N.COMPARISONS))
    return _items(spark, sf_dir, **{k: compare(op, _D, _T) for k, op in ops.items()})


@query(f"SELECT {_KEYSQL}, CASE WHEN l_quantity > 25 THEN l_extendedprice ELSE l_extendedprice / 2::DOUBLE END AS chosen, CASE WHEN l_discount <> 0.05::DOUBLE THEN l_extendedprice / (l_discount - 0.05::DOUBLE) ELSE 0::DOUBLE END AS lazy FROM lineitem")
def expr_select(spark, sf_dir):
    off = subtract(_D, lit(0.05))
    return _items(spark, sf_dir, chosen=select(compare("greater_than", _QTY, lit(25)), _P, divide(_P, lit(2))), lazy=select(compare("not_equal", _D, lit(0.05)), divide(_P, off), lit(0)))


@query(f"SELECT {_KEYSQL}, l_discount <> 0 AS is_true, CASE WHEN l_discount <> 0 THEN l_tax ELSE l_quantity END AS strict, 0::DOUBLE AS zero FROM lineitem")
def expr_truth_normalize(spark, sf_dir):
    d, t, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(*_KEYS, N.truth(d).alias("is_true"), N.select_number(d, t, q).alias("strict"), N.finite(d * F.lit(-0.0) * 0.0).alias("zero"))


_KNOTS = [(5.0, 1.0), (15.0, 4.0), (25.0, 2.5), (40.0, 10.0)]


def _ladder(below: str, above: str) -> str:
    line = lambda a, b: f"{a[1]}::DOUBLE + ((q - {a[0]}::DOUBLE) / ({b[0]}::DOUBLE - {a[0]}::DOUBLE)) * ({b[1]}::DOUBLE - {a[1]}::DOUBLE)"
    knots = " ".join(f"WHEN q = {x}::DOUBLE THEN {y}::DOUBLE" for x, y in _KNOTS)
    inner = " ".join(f"WHEN q > {a[0]} AND q < {b[0]} THEN {line(a, b)}" for a, b in zip(_KNOTS, _KNOTS[1:]))
    ends = {"clamp": (f"{_KNOTS[0][1]}::DOUBLE", f"{_KNOTS[-1][1]}::DOUBLE"), "line": (line(*_KNOTS[:2]), line(*_KNOTS[-2:])), "null": ("NULL::DOUBLE", "NULL::DOUBLE")}
    return f"CASE WHEN q < {_KNOTS[0][0]} THEN {ends[below][0]} WHEN q > {_KNOTS[-1][0]} THEN {ends[above][1]} {knots} {inner} END"


_QROWS = f"(SELECT {_KEYSQL}, l_quantity AS q FROM lineitem)"


@query(f"SELECT {_KEYSQL}, {_ladder('clamp', 'clamp')} AS y FROM {_QROWS}")
def interp_clamp(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*_KEYS, N.interpolate(F.col("l_quantity"), _KNOTS, "clamp_to_endpoint").alias("y"))


@query(f"SELECT {_KEYSQL}, {_ladder('line', 'line')} AS y FROM {_QROWS}")
def interp_extrapolate(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*_KEYS, N.interpolate(F.col("l_quantity"), _KNOTS, "linear_extrapolate").alias("y"))


@query(f"SELECT {_KEYSQL}, {_ladder('null', 'null')} AS y FROM {_QROWS}")
def interp_reject_rows(spark, sf_dir):
    with N.quiet():
        y = N.interpolate(F.col("l_quantity"), _KNOTS, "reject")
    return table(spark, sf_dir, "lineitem").select(*_KEYS, F.nullif(y, F.lit(float("nan"))).alias("y"))


@query(f"SELECT {_KEYSQL}, {_ladder('clamp', 'clamp')} AS y FROM {_QROWS}")
def interp_segment_join(spark, sf_dir):
    """The same by the join for tables of any size, here of one table."""
    knots = spark.createDataFrame([("t", x, y, "clamp_to_endpoint") for x, y in _KNOTS], "table_id string, x double, y double, policy string")
    rows = table(spark, sf_dir, "lineitem").select(*_KEYS, F.col("l_quantity").alias("q"), F.lit("t").alias("table_id"))
    return N.interpolate_join(rows, knots, "q").select(*_KEYS, "y")


@query("""SELECT l_orderkey, list_reduce(list_prepend(0::DOUBLE, list(l_extendedprice ORDER BY l_linenumber, l_partkey, l_suppkey)), lambda a, x: a + x) AS total FROM lineitem GROUP BY l_orderkey""")
def ordered_accumulate(spark, sf_dir):
    x = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(x.alias("x")).select("l_orderkey", N.ordered_sum(F.transform("x", lambda v: v["l_extendedprice"])).alias("total"))


# quanta and partitions


def _sqlfloor(v: str, q: str) -> str:
    f = f"floor({v} / {q})"
    return f"coalesce({_sqlwhole(v, q)}, CASE WHEN {f} * {q} > {v} THEN {f} - 1 ELSE {f} END)::BIGINT"


def _sqlwhole(v: str, q: str) -> str:
    r = f"floor({v} / {q} + 0.5::DOUBLE)"
    return f"(CASE WHEN {r} * {q} = {v} AND ({r} + 1) * {q} <> {v} AND ({r} = 0 OR ({r} - 1) * {q} <> {v}) THEN {r} END)::BIGINT"


@query(f"SELECT {_KEYSQL}, {_sqlfloor('l_extendedprice', '0.1::DOUBLE')} AS tenths, {_sqlfloor('l_extendedprice', '0.125::DOUBLE')} AS eighths FROM lineitem")
def quantum_floor(spark, sf_dir):
    v = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(*_KEYS, Q.floor_count(v, F.lit(0.1)).alias("tenths"), Q.floor_count(v, F.lit(0.125)).alias("eighths"))


@query(f"SELECT {_KEYSQL}, {_sqlwhole('l_extendedprice', '0.01::DOUBLE')} AS cents, {_sqlwhole('l_extendedprice', '0.25::DOUBLE')} AS quarters FROM lineitem")
def quantum_whole_count(spark, sf_dir):
    v = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(*_KEYS, Q.whole_count(v, F.lit(0.01)).alias("cents"), Q.whole_count(v, F.lit(0.25)).alias("quarters"))


def _rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*_KEYS, F.col("l_quantity").alias("amount"), F.col("l_discount").alias("share"))


def _partsql(*branches: tuple[str, str]) -> str:
    items = ", ".join(f"{{'branch': '{n}', 'amount': {e}}}" for n, e in branches)
    return f"SELECT {_KEYSQL}, branch, amount, count FROM (SELECT *, {_sqlfloor('amount', '1::DOUBLE')} AS count FROM (SELECT {_KEYSQL}, b.branch AS branch, b.amount AS amount FROM (SELECT {_KEYSQL}, unnest([{items}]) AS b FROM lineitem))) WHERE count > 0"


@query(_partsql(("out", "l_quantity")))
def partition_release_all(spark, sf_dir):
    return partition.release_all(_rows(spark, sf_dir), "out", F.col("amount"), F.lit(1.0), _KEYS)


@query(f"SELECT {_KEYSQL}, 'InvalidAmount' AS violation FROM lineitem WHERE l_quantity - 3 < 0")
def partition_retain_all(spark, sf_dir):
    return partition.retain_all(_rows(spark, sf_dir), F.col("amount") - 3, F.lit(1.0), _KEYS)


@query(_partsql(("a", "l_quantity * 0.25::DOUBLE"), ("b", "l_quantity * 0.5::DOUBLE")))
def partition_fixed_split(spark, sf_dir):
    return partition.fixed_fraction(_rows(spark, sf_dir), {"b": 0.5, "a": 0.25}, 0.25, F.col("amount"), F.lit(1.0), _KEYS)


@query(_partsql(("out", "l_quantity * 0.3::DOUBLE")))
def partition_constant_fraction(spark, sf_dir):
    return partition.constant_fraction(_rows(spark, sf_dir), "out", 0.3, F.col("amount"), F.lit(1.0), _KEYS)


@query(_partsql(("out", "l_discount * 100::DOUBLE")))
def partition_exogenous(spark, sf_dir):
    return partition.exogenous(_rows(spark, sf_dir), "out", F.col("share") * 100, F.lit(1.0), _KEYS)


@query(_partsql(("to-a", "l_quantity * l_discount"), ("to-b", "l_quantity / 2::DOUBLE")))
def partition_expression(spark, sf_dir):
    return partition.by_expression(_rows(spark, sf_dir), {"to-b": F.col("amount") / 2, "to-a": F.col("amount") * F.col("share")}, F.lit(1.0), _KEYS)


@query(f"""WITH m AS ({_partsql(("a", "l_quantity * 0.25::DOUBLE"), ("b", "l_quantity * 0.5::DOUBLE"))}), s AS (SELECT {_KEYSQL}, sum(count)::BIGINT AS moved FROM m GROUP BY ALL)
SELECT {_KEYSQL}, l_quantity::BIGINT AS available, (l_quantity::BIGINT - coalesce(moved, 0))::BIGINT AS retained FROM lineitem LEFT JOIN s USING ({_KEYSQL})""")
def partition_retained(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("available", F.col("amount").cast("long"))
    moved = partition.fixed_fraction(rows, {"b": 0.5, "a": 0.25}, 0.25, F.col("amount"), F.lit(1.0), _KEYS)
    return partition.retained(rows, moved, "available", _KEYS)


@query(f"""SELECT {_KEYSQL}, 'a' AS branch, 'InvalidAmount' AS violation FROM lineitem WHERE l_quantity - 3 < 0 UNION ALL SELECT {_KEYSQL}, 'b', 'InvalidAmount' FROM lineitem WHERE l_discount = 0
UNION ALL SELECT {_KEYSQL}, 'c', 'InvalidAmount' FROM lineitem WHERE l_extendedprice * 1e12::DOUBLE > {Q.MAX_COUNT}::DOUBLE""")
def partition_violations(spark, sf_dir):
    """Amounts that cannot move: negative, not a number, above the largest count."""
    rows = table(spark, sf_dir, "lineitem").select(*_KEYS, F.col("l_quantity").alias("amount"), F.col("l_discount").alias("share"), "l_extendedprice")
    branches = [("a", F.col("amount") - 3), ("b", F.when(F.col("share") == 0, F.lit(float("nan"))).otherwise(F.col("share"))), ("c", F.col("l_extendedprice") * F.lit(1e12))]
    return partition.violations(rows, branches, F.lit(1.0), _KEYS).select(*_KEYS, "branch", "violation")


# projections, over hourly event series


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FORCING: event_type, timestep (hours of January 2024), cents; dense."""
    e = table(spark, sf_dir, "events").select("event_type", F.floor((F.unix_timestamp("ts") - _HOUR0) / 3600).alias("timestep"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    sums = e.groupBy("event_type", "timestep").agg(F.sum("cents").alias("cents"))
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(719).cast("long"))).alias("timestep")
    return sums.select("event_type").distinct().select("event_type", steps).join(sums, ["event_type", "timestep"], "left").withColumn("cents", F.coalesce("cents", F.lit(0)))


_HOURLY = f"""e AS (SELECT event_type, ((floor(epoch(ts))::BIGINT - {_HOUR0}) // 3600)::BIGINT AS timestep, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL),
hourly AS (SELECT event_type, timestep, coalesce(cents, 0)::BIGINT AS cents FROM (SELECT DISTINCT event_type FROM e) CROSS JOIN (SELECT unnest(range(0, 720))::BIGINT AS timestep) LEFT JOIN e USING (event_type, timestep))"""
_W = "(PARTITION BY event_type ORDER BY timestep)"


@query(f"WITH {_HOURLY} SELECT *, CASE timestep WHEN 0 THEN 5 WHEN 1 THEN 6 ELSE lag(cents, 2) OVER {_W} END::BIGINT AS lagged FROM hourly")
def lag_projection(spark, sf_dir):
    return projection.bounded_lag(hourly(spark, sf_dir), ["event_type"], "cents", 2, [5, 6], "lagged").withColumn("lagged", F.col("lagged").cast("long"))


@query(f"WITH {_HOURLY} SELECT *, sum(cents) OVER (PARTITION BY event_type ORDER BY timestep ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)::BIGINT AS day FROM hourly")
def rolling_sum_exact(spark, sf_dir):
    return projection.rolling_count(hourly(spark, sf_dir), ["event_type"], "cents", 24, "day")


@query(f"""WITH {_HOURLY}, v AS (SELECT event_type, timestep, cents * 0.01::DOUBLE AS value FROM hourly), l AS (SELECT *, list(value) OVER (PARTITION BY event_type ORDER BY timestep ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS x FROM v)
SELECT event_type, timestep, value, list_reduce(list_prepend(0::DOUBLE, list_concat(list_slice([0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE], len(x), 3), x)), lambda a, y: a + y) AS rolling FROM l""")
def rolling_sum_ordered(spark, sf_dir):
    rows = hourly(spark, sf_dir).select("event_type", "timestep", (F.col("cents") * F.lit(0.01)).alias("value"))
    return projection.rolling_sum(rows, ["event_type"], "value", 4, [0.1, 0.2, 0.3], "rolling")


def _recursive(start: str, step: str) -> str:
    return f"""WITH RECURSIVE {_HOURLY}, r AS (SELECT event_type, -1::BIGINT AS timestep, {start} FROM (SELECT DISTINCT event_type FROM hourly)
UNION ALL SELECT r.event_type, r.timestep + 1, {step} FROM r JOIN hourly h ON h.event_type = r.event_type AND h.timestep = r.timestep + 1)"""


@query(_recursive("8::DOUBLE AS s, 0::DOUBLE AS o", "(s - 0.25::DOUBLE * s) + h.cents::DOUBLE, 0.25::DOUBLE * s") + " SELECT event_type, timestep, o AS outflow FROM r WHERE timestep >= 0")
def recurrence_linear_reservoir(spark, sf_dir):
    update = lambda s, x: [(s[0] - F.lit(0.25) * s[0]) + x["cents"].cast("double"), F.lit(0.25) * s[0]]
    return projection.recurrence(hourly(spark, sf_dir), ["event_type"], ["cents"], [8.0, 0.0], update, 1, "outflow")


@query(_recursive("1::DOUBLE AS a, 2::DOUBLE AS b", "0.5::DOUBLE * a + 0.25::DOUBLE * b, a + h.cents::DOUBLE") + " SELECT event_type, timestep, a AS value FROM r WHERE timestep >= 0")
def recurrence_two_slot(spark, sf_dir):
    update = lambda s, x: [F.lit(0.5) * s[0] + F.lit(0.25) * s[1], s[0] + x["cents"].cast("double")]
    return projection.recurrence(hourly(spark, sf_dir), ["event_type"], ["cents"], [1.0, 2.0], update, 0, "value")


@query(f"""WITH {_HOURLY}, l AS (SELECT *, CASE timestep WHEN 0 THEN 5 ELSE lag(cents, 1) OVER {_W} END::BIGINT AS lagged FROM hourly)
SELECT *, sum(lagged) OVER (PARTITION BY event_type ORDER BY timestep ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS rolled FROM l""")
def projection_chain(spark, sf_dir):
    rows = projection.bounded_lag(hourly(spark, sf_dir), ["event_type"], "cents", 1, [5], "lagged").withColumn("lagged", F.col("lagged").cast("long"))
    return projection.rolling_count(rows, ["event_type"], "lagged", 3, "rolled")


# models


_wrap, _projection = B.expression, B.projection


def _rule(c: str, e: Expr, kind: dict, **parameters: float) -> dict:
    return B.rule(c, "water", e, kind, parameters)


def _fact_source(direction: str, c: str) -> dict:
    return B.fact(direction, c, "water")


def basin(last: int = 119, closed: bool = False, stock: float = 100000.0) -> Model:
    """rain -> upper -> lower -> sea: the upper releases by table and parameter, the lower what came two steps before;
    closed: and a pool releases half of what it released before."""
    values = [float((7 * t) % 11) for t in range(last + 1)]
    lag, state = _projection("late", B.bounded_lag(_fact_source("incoming", "lower"), 2), [1.0, 2.0])
    half, half_state = _projection("own", B.bounded_lag(_fact_source("outgoing", "pool"), 1), [64.0])
    late = Expr("projection", name="late", declared="extensive")
    own = Expr("projection", name="own", declared="extensive")
    rain = add(multiply(param("gain"), forcing("rain")), table_lookup("curve", forcing("rain")))
    rules = [_rule("upper", rain, B.release_all("down"), gain=0.5), _rule("lower", late, B.release_all("out"))]
    bindings = [("upper", "down", "lower"), ("lower", "out", "sea")]
    if closed:
        rules.append(_rule("pool", multiply(own, lit(0.5)), B.release_all("spill")))
        bindings.append(("pool", "spill", "sea"))
    finite = ["lower", "upper", *(["pool"] if closed else [])]
    return Model.from_document(B.model_document(
        finite, ["sea"], [(a, b) for a, _, b in bindings], {(c, "water"): stock for c in finite}, {"water": ("m3", 0.25)}, (0, last), rules, {(c, "water", b): d for c, b, d in bindings},
        projections=[(lag, state), *([(half, half_state)] if closed else [])], forcings={"rain": values}, tables=[B.table("curve", [(0.0, 0.0), (4.0, 1.0), (8.0, 4.0)], "clamp_to_endpoint")],
    ))


def _document(finite: list[str], edges: list[tuple[str, str]], last: int, quantum: float, stock: float, rules: list[dict], bindings: list[tuple[str, str, str]], inputs: list[tuple[str, str, str]] = (), projections: list[tuple[dict, dict]] = (), forcings: dict[str, list[float]] | None = None, tables: list[dict] = ()) -> Model:
    """A model of one substance, water, with daily steps and the same stock in each compartment."""
    return Model.from_document(B.model_document(
        finite, ["outside"], edges, {(c, "water"): stock for c in finite}, {"water": ("m3", quantum)}, (0, last), rules, {(c, "water", b): d for c, b, d in bindings},
        [B.forcing_input(c, "water", n, f) for c, n, f in inputs], projections, forcings, tables,
    ))


def chain(length: int, last: int) -> Model:
    """c000 -> c001 -> ... -> outside: the first releases a constant, every other what came in a step before."""
    names = [f"c{k:03d}" for k in range(length)]
    lags = [_projection(f"late-{c}", B.bounded_lag(_fact_source("incoming", c), 1), [1.0]) for c in names[1:]]
    rules = [_rule(c, Expr("projection", name=f"late-{c}", declared="extensive") if k else lit(2), B.release_all("on")) for k, c in enumerate(names)]
    edges = list(zip(names, [*names[1:], "outside"]))
    return _document(names, edges, last, 0.5, 1000.0, rules, [(a, "on", b) for a, b in edges], projections=lags)


def published_sweep(last: int = 2190) -> Model:
    """The published benchmark's model: 50 compartments without connections, 20 forcings, one rule that retains all, one parameter."""
    names = [f"basin-{k:02d}" for k in range(50)]
    return _document(names, [], last, 1e-6, 1.0, [_rule(names[0], param("release-coefficient"), B.retain_all(), **{"release-coefficient": 0.2})], [], forcings={f"forcing-{k:02d}": [float(k)] * (last + 1) for k in range(20)})


def hydrology(without: tuple[str, ...] = ()) -> Model:
    """Seven compartments that each release to the outside by a rule of another kind: recurrence, lag, Muskingum routing (which reads
    its own past), table lookup, minimum of inputs, a policy that chooses, and a shared demand."""
    scalar = lambda n: Expr("input", name=n, declared="scalar")
    past = lambda n: Expr("projection", name=n, declared="extensive")
    kept = multiply(param("linear-coefficient"), scalar("storage"))
    store = B.recurrence([subtract(scalar("storage"), kept), kept], [B.state_input("storage", 0)], ["linear-coefficient"], 1)
    weights = ("muskingum-c0", "muskingum-c1", "muskingum-c2")
    parts = [multiply(param(w), x) for w, x in zip(weights, (scalar("inflow"), past("inflow-before"), past("outflow-before")))]
    routed = B.recurrence([add(add(parts[0], parts[1]), parts[2])], [B.fact_input("inflow", _fact_source("incoming", "muskingum"))], weights)
    lag = lambda way, c, n: B.bounded_lag(_fact_source(way, c), n)
    projections = [
        ("linear-reservoir", _projection("linear-reservoir-state", store, [8.0, 0.0])), ("lag", _projection("travel-time-lag", lag("incoming", "lag", 2), [3.0, 2.0])),
        ("muskingum", _projection("inflow-before", lag("incoming", "muskingum", 1), [4.0])), ("muskingum", _projection("outflow-before", lag("outgoing", "muskingum", 1), [2.0])),
        ("muskingum", _projection("muskingum-routed", routed, [0.0])),
    ]
    chosen = select(compare("greater_than_or_equal", scalar("policy-storage"), param("flood-threshold")), param("flood-release"), param("conservation-release"))
    rules = {
        "muskingum": (past("muskingum-routed"), dict(zip(weights, (0.4, 0.3, 0.3)))),
        "lag": (past("travel-time-lag"), {}),
        "linear-reservoir": (past("linear-reservoir-state"), {"linear-coefficient": 0.25}),
        "evaporation": (table_lookup("evaporation-by-temperature", forcing("air-temperature")), {}),
        "seepage": (minimum(scalar("seepage-available"), maximum(lit(0), multiply(param("seepage-conductance"), scalar("hydraulic-head")))), {"seepage-conductance": 0.5}),
        "reservoir-policy": (clamp(chosen, lit(0), scalar("policy-available")), {"flood-threshold": 50.0, "flood-release": 8.0, "conservation-release": 3.0}),
        "demand": (minimum(forcing("requested-demand"), divide(scalar("demand-available"), param("delivery-period"))), {"delivery-period": 2.0}),
    }
    series = {"air-temperature": [0.0, 10.0, 20.0], "seepage-available": [10.0] * 3, "hydraulic-head": [4.0, 6.0, 8.0], "policy-storage": [40.0, 60.0, 45.0], "policy-available": [10.0] * 3, "requested-demand": [6.0, 8.0, 10.0], "demand-available": [20.0] * 3}
    inputs = [("seepage", "seepage-available"), ("seepage", "hydraulic-head"), ("reservoir-policy", "policy-storage"), ("reservoir-policy", "policy-available"), ("demand", "demand-available")]
    curve = B.table("evaporation-by-temperature", [(0.0, 1.0), (10.0, 2.0), (20.0, 3.0)], "clamp_to_endpoint")
    own = [c for c in rules if c not in without]
    return _document(
        own, [(c, "outside") for c in own], 2, 1e-6, 100.0, [_rule(c, rules[c][0], B.release_all(f"{c}-out"), **rules[c][1]) for c in own], [(c, f"{c}-out", "outside") for c in own],
        [(c, n, n) for c, n in inputs if c in own], [p for c, p in projections if c in own], series, [curve],
    )


_CURVE = "CASE WHEN x > 8 THEN 4::DOUBLE WHEN x = 0 THEN 0::DOUBLE WHEN x = 4 THEN 1::DOUBLE WHEN x = 8 THEN 4::DOUBLE WHEN x < 4 THEN 0::DOUBLE + ((x - 0) / 4::DOUBLE) * 1::DOUBLE ELSE 1::DOUBLE + ((x - 4) / 4::DOUBLE) * 3::DOUBLE END"


def _basinsql(runs: str, gain: str, last: int) -> str:
    return f"""WITH runs AS ({runs}), w AS (SELECT unnest(range(0, {last + 1}))::BIGINT AS timestep), a AS (SELECT run_id, timestep, gain, ((7 * timestep) % 11)::DOUBLE AS x FROM runs CROSS JOIN w),
u AS (SELECT run_id, timestep, {_sqlfloor('v', '0.25::DOUBLE')} AS n FROM (SELECT run_id, timestep, gain * x + ({_CURVE}) AS v FROM a)),
l AS (SELECT run_id, timestep, CASE timestep WHEN 0 THEN 4 WHEN 1 THEN 8 ELSE lag(n, 2) OVER (PARTITION BY run_id ORDER BY timestep) END::BIGINT AS n FROM u),
f AS (SELECT run_id, timestep, 'upper' AS source, 'lower' AS target, n FROM u UNION ALL SELECT run_id, timestep, 'lower', 'sea', n FROM l)"""


_ONE = "SELECT 'run-000000' AS run_id, 0.5::DOUBLE AS gain"


@query(_basinsql(_ONE, "gain", 119) + " SELECT run_id, timestep, source, target, n AS count, n * 0.25::DOUBLE AS amount FROM f WHERE n > 0 AND source = 'upper'")
def simulate_tier_a(spark, sf_dir):
    return execute.run(spark, basin()).where("source = 'upper'").select("run_id", "timestep", "source", "target", "count", "amount")


@query(_basinsql(_ONE, "gain", 119) + " SELECT run_id, timestep, source, target, n AS count, n * 0.25::DOUBLE AS amount FROM f WHERE n > 0")
def simulate_tier_b(spark, sf_dir):
    return execute.run(spark, basin()).select("run_id", "timestep", "source", "target", "count", "amount")


@query(_basinsql(_ONE, "gain", 39).replace("WITH runs", "WITH RECURSIVE runs") + """, p AS (SELECT 0::BIGINT AS timestep, 128::BIGINT AS n UNION ALL SELECT timestep + 1, n // 2 FROM p WHERE timestep < 39)
SELECT run_id, timestep, source, target, n AS count, n * 0.25::DOUBLE AS amount FROM f WHERE n > 0 UNION ALL SELECT 'run-000000', timestep, 'pool', 'sea', n, n * 0.25::DOUBLE FROM p WHERE n > 0""")
def simulate_tier_c(spark, sf_dir):
    return execute.run(spark, basin(39, closed=True)).select("run_id", "timestep", "source", "target", "count", "amount")


@query(_basinsql("SELECT 'run-' || lpad(i::VARCHAR, 6, '0') AS run_id, 0.25::DOUBLE * (i % 8) AS gain FROM range(0, 500) t(i)", "gain", 119) + " SELECT run_id, source, sum(n)::BIGINT AS count, count(*)::BIGINT AS transfers FROM f WHERE n > 0 GROUP BY ALL")
def parameter_sweep(spark, sf_dir):
    grid = sweep.sweep(spark, 500, ("upper", "water", "gain"), F.lit(0.25) * (F.col("id") % 8))
    return execute.run(spark, basin(), grid).groupBy("run_id", "source").agg(F.sum("count").alias("count"), F.count("*").alias("transfers"))


def _given(rows: DataFrame, run: str, target: tuple[str, str, str] | None = None, value=None) -> DataFrame:
    """The parameter rows of one run for each row of a table."""
    c, s, p = target or (None, None, None)
    text = lambda x: F.lit(x).cast("string")
    return rows.select(F.expr(run).alias("run_id"), text(c).alias("compartment"), text(s).alias("substance"), text(p).alias("parameter"), (F.lit(None) if value is None else value).cast("double").alias("value"))


@query(f"""WITH runs AS (SELECT 's' || s_suppkey::VARCHAR AS run_id, s_acctbal / 1000::DOUBLE AS gain FROM supplier), w AS (SELECT unnest(range(0, 120))::BIGINT AS timestep), a AS (SELECT run_id, timestep, gain, ((7 * timestep) % 11)::DOUBLE AS x FROM runs CROSS JOIN w),
v AS (SELECT run_id, timestep, gain * x + ({_CURVE}) AS v FROM a), u AS (SELECT run_id, timestep, v, CASE WHEN v >= 0 THEN {_sqlfloor('v', '0.25::DOUBLE')} ELSE 0 END AS n FROM v), b AS (SELECT *, sum(n) OVER (PARTITION BY run_id ORDER BY timestep) AS moved FROM u),
e AS (SELECT run_id, timestep, CASE WHEN v < 0 THEN 'InvalidAmount' WHEN moved > 8000 THEN 'RuleOverdraw' END AS error FROM b), f AS (SELECT run_id, min(timestep) AS timestep, min_by(error, timestep) AS error FROM e WHERE error IS NOT NULL GROUP BY run_id),
l AS (SELECT run_id, n, CASE timestep WHEN 0 THEN 4 WHEN 1 THEN 8 ELSE lag(n, 2) OVER (PARTITION BY run_id ORDER BY timestep) END AS m FROM u), t AS (SELECT run_id, sum((n > 0)::INTEGER + (m > 0)::INTEGER)::BIGINT AS transfers FROM l GROUP BY run_id)
SELECT run_id, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, error, f.timestep, CASE WHEN error IS NULL THEN transfers ELSE 0 END AS transfers FROM t LEFT JOIN f USING (run_id)""")
def run_outcomes(spark, sf_dir):
    """A run for each supplier, its gain from the account balance: debts release less than nothing, large credits overdraw."""
    grid = _given(table(spark, sf_dir, "supplier"), "concat('s', s_suppkey)", ("upper", "water", "gain"), F.col("s_acctbal") / F.lit(1000.0))
    return execute.outcomes(spark, basin(stock=2000.0), grid)


@query(f"""WITH {_HOURLY}, a AS (SELECT event_type AS run_id, timestep, (cents % 11)::DOUBLE AS x FROM hourly), u AS (SELECT run_id, timestep, {_sqlfloor('v', '0.25::DOUBLE')} AS n FROM (SELECT run_id, timestep, 0.5::DOUBLE * x + ({_CURVE}) AS v FROM a)),
l AS (SELECT run_id, timestep, CASE timestep WHEN 0 THEN 4 WHEN 1 THEN 8 ELSE lag(n, 2) OVER (PARTITION BY run_id ORDER BY timestep) END::BIGINT AS n FROM u), f AS (SELECT run_id, timestep, 'upper' AS source, n FROM u UNION ALL SELECT run_id, timestep, 'lower', n FROM l)
SELECT run_id, timestep, source, n AS count, n * 0.25::DOUBLE AS amount FROM f WHERE n > 0""")
def simulate_from_tables(spark, sf_dir):
    """A run for each type of event, with the type's hourly series as its rain."""
    rain = hourly(spark, sf_dir).select(F.col("event_type").alias("run_id"), F.lit("rain").alias("forcing_id"), "timestep", (F.col("cents") % 11).cast("double").alias("value"))
    params = _given(rain.select("run_id").distinct(), "run_id")
    return execute.run(spark, basin(719), params, forcings=rain).select("run_id", "timestep", "source", "count", "amount")


@query("""WITH base(source, timestep, n) AS (VALUES ('linear-reservoir', 0, 2000000), ('linear-reservoir', 1, 1500000), ('linear-reservoir', 2, 1125000), ('lag', 0, 3000000), ('lag', 1, 2000000), ('muskingum', 0, 1800000), ('muskingum', 1, 540000), ('muskingum', 2, 161999),
 ('evaporation', 0, 1000000), ('evaporation', 1, 2000000), ('evaporation', 2, 3000000), ('seepage', 0, 2000000), ('seepage', 1, 3000000), ('seepage', 2, 4000000), ('reservoir-policy', 0, 3000000), ('reservoir-policy', 1, 0), ('reservoir-policy', 2, 3000000), ('demand', 0, 6000000), ('demand', 1, 8000000), ('demand', 2, 10000000)),
r AS (SELECT 's' || s_suppkey::VARCHAR AS run_id, 1 + s_nationkey % 12 AS release FROM supplier), x AS (SELECT run_id, timestep::BIGINT AS timestep, source, (CASE WHEN source = 'reservoir-policy' AND timestep = 1 THEN least(release, 10) * 1000000 ELSE n END)::BIGINT AS count FROM base CROSS JOIN r)
SELECT run_id, timestep, source, count, count::DOUBLE * 0.000001::DOUBLE AS amount FROM x""")
def hydrology_fixture(spark, sf_dir):
    """The end-to-end model, step by step (tier C), for each supplier with a flood release of its own."""
    grid = _given(table(spark, sf_dir, "supplier"), "concat('s', s_suppkey)", ("reservoir-policy", "water", "flood-release"), 1 + F.col("s_nationkey") % 12)
    return execute.run(spark, hydrology(), grid).select("run_id", "timestep", "source", "count", "amount")


@query("""WITH RECURSIVE e(a, b) AS (VALUES ('lower', 'sea'), ('upper', 'lower'), ('pool', 'sea')), n AS (SELECT a AS id FROM e UNION SELECT b FROM e),
r AS (SELECT id, 0 AS d FROM n UNION ALL SELECT e.b, r.d + 1 FROM r JOIN e ON e.a = r.id) SELECT id AS endpoint, max(d)::INTEGER AS depth FROM r GROUP BY id""")
def topological_order(spark, sf_dir):
    return spark.createDataFrame(list(basin(3, closed=True).topology.depths().items()), "endpoint string, depth int")


# checks


@query("""SELECT c_name AS name, CASE WHEN c_name = '' THEN 'Empty' WHEN NOT regexp_matches(c_name, '^[a-z]') THEN 'InvalidStart' WHEN NOT regexp_full_match(c_name, '[a-z][a-z0-9_-]*') THEN 'InvalidCharacter' END AS violation FROM
(SELECT CASE c_custkey % 3 WHEN 0 THEN lower(c_name) WHEN 1 THEN c_name ELSE replace(lower(c_name), '#', '-') END AS c_name FROM customer) WHERE violation IS NOT NULL""")
def identity_violations(spark, sf_dir):
    k = F.col("c_custkey") % 3
    name = F.when(k == 0, F.lower("c_name")).when(k == 1, F.col("c_name")).otherwise(F.regexp_replace(F.lower("c_name"), "#", "-"))
    return validate.identities(table(spark, sf_dir, "customer").select(name.alias("name")), "name")


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n, 'DuplicateTransferBranch' AS violation FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_bindings(spark, sf_dir):
    return validate.repeated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "DuplicateTransferBranch")


@query("SELECT p_partkey, 'RuleNotFound' AS violation FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def substitution_violations(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return validate.unmatched(table(spark, sf_dir, "part").select("p_partkey"), used, ["p_partkey"], "RuleNotFound")


@query(f"""WITH e AS (SELECT event_type AS forcing_id, ((floor(epoch(ts))::BIGINT - {_HOUR0}) // 3600)::BIGINT AS timestep, value FROM events)
SELECT forcing_id, count(*)::BIGINT AS n, count(DISTINCT timestep)::BIGINT AS steps, 0::BIGINT AS non_finite, (count(*) FILTER (timestep NOT BETWEEN 0 AND 359))::BIGINT AS outside FROM e GROUP BY ALL""")
def forcing_shape_violations(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("forcing_id"), F.floor((F.unix_timestamp("ts") - _HOUR0) / 3600).alias("timestep"), "value")
    return forcing_violations(e, 0, 359)


@query("""SELECT * FROM (SELECT l_orderkey::VARCHAR AS table_id, row_number() OVER w AS idx, l_quantity AS x, lag(l_quantity) OVER w AS before, 'AbscissaeNotStrictlyIncreasing' AS violation FROM lineitem
WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) WHERE x <= before""")
def table_order_violations(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    knots = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("table_id"), F.row_number().over(w).cast("long").alias("idx"), F.col("l_quantity").alias("x"))
    return validate.table_order(knots)


@query("SELECT event_id, CASE WHEN event_id % 100 = 0 THEN 'NonFinite' ELSE 'Negative' END AS violation FROM events WHERE event_id % 100 = 0 OR value - 10 < 0")
def non_finite_violations(spark, sf_dir):
    v = F.when(F.col("event_id") % 100 == 0, F.lit(float("nan"))).otherwise(F.col("value") - 10)
    return validate.amounts(table(spark, sf_dir, "events").select("event_id", v.alias("v")), "v").select("event_id", "violation")


_LINE = "concat_ws(',', " + ", ".join(f"length({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR" for f in log.FIELDS) + ")"


@query(f"""WITH {_FLOW}, b AS (SELECT run_id, seq // {log.BLOCK} AS block, sha256(string_agg({_LINE}, chr(10) ORDER BY seq)) AS d, count(*) AS n FROM flow GROUP BY ALL)
SELECT run_id, sha256(string_agg(d, chr(10) ORDER BY block)) AS log_digest, sum(n)::BIGINT AS transfer_count FROM b GROUP BY run_id""")
def log_digest(spark, sf_dir):
    return log.log_digests(flow(spark, sf_dir))
