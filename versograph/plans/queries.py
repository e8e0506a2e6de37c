"""Registered queries over the two test archives, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versograph.functions import stats, terms
from versograph.operators import chain, lookup, patch
from versograph.operators import query as q
from versograph.operators.log import intervals, normalise
from versograph.operators.model import OPEN, TRIPLE
from versograph.plans import strategy
from versograph.plans.fixtures import EVENTS_SQL, LAST_ORDERS, ORDERS_SQL, events_log, events_presence, orders_log, orders_presence, parts, stored_orders
from versograph.sources import ntriples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SNAPSHOTS = [0, 3, 6]
S, P, O = "ex:order/10", "ex:status", "F"  # noqa: E741


def _listed(rows: DataFrame) -> DataFrame:
    """Version lists as text."""
    return rows.select(*TRIPLE, F.concat_ws(" ", F.transform("versions", lambda v: v.cast("string"))).alias("versions"))


def _add(name: str, run: Query, sql: str, archive: str = ORDERS_SQL) -> None:
    QUERIES[name] = run
    ORACLES[name] = f"{archive}\n{sql}"


def _presence(f: Callable[[DataFrame], DataFrame], of: Query = orders_presence) -> Query:
    return lambda spark, d: f(of(spark, d))


def _log(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(orders_log(spark, d))


def _at(v: int) -> str:
    return f"v_from <= {v} AND v_to > {v}"


def _match(m: tuple) -> str:
    return "".join(f" AND {c} = '{v}'" for c, v in zip(TRIPLE, m, strict=True) if v)


def _both(i: int, j: int, extra: str = "") -> str:
    """Flags of presence at two versions per triple."""
    return f"SELECT s, p, o, max(CAST(({_at(i)}) AS INT)) AS a, max(CAST(({_at(j)}) AS INT)) AS b FROM pres WHERE true{extra} GROUP BY s, p, o"


def _delta(i: int, j: int, extra: str = "") -> str:
    return f"SELECT s, p, o, b = 1 AS addition FROM ({_both(i, j, extra)}) WHERE a <> b"


def _signed(i: int, j: int) -> str:
    return f"SELECT s, p, o, b - a AS op FROM ({_both(i, j)}) WHERE a <> b"


_add("vm_all", _presence(lambda p: q.vm(p, 9), events_presence), f"SELECT s, p, o FROM pres WHERE {_at(9)}", EVENTS_SQL)
for name, v, m in (
    ("vm_spo", 6, (S, P, "archived")), ("vm_sp", 4, (S, P, None)), ("vm_so", 4, (S, None, O)), ("vm_s", 4, (S, None, None)), ("vm_po", 3, (None, P, O)),
    ("vm_p", 5, (None, P, None)), ("vm_o", 6, (None, None, O)), ("vm_unknown_term", 3, (None, "ex:none", None)), ("vm_beyond_max", 99, (None, P, O)), ("vm_before_first", -1, (None, None, None)),
):
    _add(name, _presence(lambda p, v=v, m=m: q.vm(p, v, m)), f"SELECT s, p, o FROM pres WHERE {_at(v)}{_match(m)}")
_add("vm_offset_limit", _presence(lambda p: q.vm(p, 5, (None, P, None), offset=100, limit=50)), f"SELECT s, p, o FROM pres WHERE {_at(5)}{_match((None, P, None))} ORDER BY s, p, o LIMIT 50 OFFSET 100")
_add("vm_hybrid", lambda spark, d: chain.vm_hybrid(q.vm(orders_presence(spark, d), 3), orders_log(spark, d), 3, 5), f"SELECT s, p, o FROM pres WHERE {_at(5)}")
_add("vm_hybrid_pattern", lambda spark, d: chain.vm_hybrid(q.vm(orders_presence(spark, d), 3), orders_log(spark, d), 3, 5, (None, P, O)), f"SELECT s, p, o FROM pres WHERE {_at(5)}{_match((None, P, O))}")
_add("vm_chain_order", _presence(lambda p: q.vm_in_chain_order(p, 5, 3, (None, P, None), offset=20, limit=30)), f"""SELECT s, p, o FROM (SELECT s, p, o, max(CAST(({_at(5)}) AS INT)) AS now, min(CASE WHEN {_at(3)} THEN 0 ELSE 1 END) AS seg FROM pres WHERE p = '{P}' GROUP BY s, p, o)
  WHERE now = 1 ORDER BY seg, CASE WHEN seg = 0 THEN s END, CASE WHEN seg = 0 THEN o END, p, o, s LIMIT 30 OFFSET 20""")


def _count_per_version(spark: SparkSession, d: str) -> DataFrame:
    return q.vm_counts(orders_presence(spark, d), spark.range(LAST_ORDERS + 1).select(F.col("id").cast("int").alias("version")))


_add("vm_count_per_version", _count_per_version, "SELECT CAST(r.v AS INTEGER) AS version, count(pres.s) AS n FROM range(0, 7) r(v) LEFT JOIN pres ON v_from <= r.v AND v_to > r.v GROUP BY r.v")

for name, i, j, m in (("dm_adjacent", 4, 5, ()), ("dm_range", 1, 6, ()), ("dm_pattern_p", 1, 5, (None, P, None)), ("dm_pattern_s", 2, 5, (S, None, None)), ("dm_pattern_po", 1, 5, (None, P, "archived")), ("dm_reverse_empty", 5, 2, ())):
    _add(name, _presence(lambda p, i=i, j=j, m=m: q.dm(p, i, j, m)), _delta(i, j, _match(m or (None,) * 3)) + (" AND false" if i >= j else ""))
_add("dm_offset", _presence(lambda p: q.dm(p, 1, 5, (None, P, None), offset=100, limit=40)), _delta(1, 5, _match((None, P, None))) + " ORDER BY p, o, s LIMIT 40 OFFSET 100")
_add("dm_beyond_max", _presence(lambda p: q.dm(p, 4, 60, last=LAST_ORDERS)), _delta(4, 6))
_add("dm_plain_diff", _presence(lambda p: q.dm_plain(p, 2, 6)), _delta(2, 6))
_add("dm_hybrid", _log(lambda g: chain.dm_hybrid(g, 1, 5)), _delta(1, 5))
_add("dm_snapshot_diff", _presence(lambda p: chain.snapshot_difference(q.vm(p, 0), q.vm(p, 3))), _delta(0, 3))
_add("dm_compose", _log(lambda g: patch.compose(patch.reconstruct(g, 0, 3), patch.reconstruct(g, 3, 6))), _signed(0, 6))
_add("dm_rebase", _log(lambda g: patch.rebase(patch.reconstruct(g, 0, 2), patch.reconstruct(g, 0, 5))), _signed(2, 5))


_add("dm_count_matrix", _presence(lambda p: q.dm_counts(p, LAST_ORDERS)), """, v AS (SELECT CAST(range AS INTEGER) AS v FROM range(0, 7)),
h AS (SELECT s, p, o, v.v, max(CASE WHEN v_from <= v.v AND v_to > v.v THEN 1 ELSE 0 END) AS h FROM pres, v GROUP BY ALL)
SELECT a.v AS i, b.v AS j, CAST(sum(abs(a.h - b.h)) AS BIGINT) AS n FROM h a JOIN h b USING (s, p, o) WHERE a.v < b.v GROUP BY a.v, b.v""")
_add("dm_estimate", _presence(lambda p: q.dm_estimate(p, 1, 5, SNAPSHOTS)), f"""SELECT (SELECT count(*) FROM ({_delta(0, 1)})) + (SELECT count(*) FROM ({_delta(3, 5)})) + (SELECT count(*) FROM pres WHERE {_at(0)}) + (SELECT count(*) FROM pres WHERE {_at(3)}) AS n, 'UP_TO' AS kind""")
_add("dm_estimate_same_chain", _presence(lambda p: q.dm_estimate(p, 4, 5, SNAPSHOTS, (None, P, None))), f"SELECT (SELECT count(*) FROM ({_delta(3, 4, _match((None, P, None)))})) + (SELECT count(*) FROM ({_delta(3, 5, _match((None, P, None)))})) AS n, 'UP_TO' AS kind")


def _lists(extra: str = "") -> str:
    return f"""SELECT s, p, o, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY v) AS versions
  FROM (SELECT s, p, o, unnest(range(v_from, least(v_to, 7))) AS v FROM pres WHERE v_from <= 6{extra}) GROUP BY s, p, o"""


_add("vq_all", _presence(lambda p: _listed(q.vq(p, LAST_ORDERS))), _lists())
_add("vq_pattern", _presence(lambda p: _listed(q.vq(p, LAST_ORDERS, (None, P, "archived")))), _lists(_match((None, P, "archived"))))
_add("vq_offset", _presence(lambda p: _listed(q.vq(p, LAST_ORDERS, (None, P, None), offset=100, limit=40))), f"SELECT * FROM ({_lists(_match((None, P, None)))}) ORDER BY p, o, s LIMIT 40 OFFSET 100")
_add("vq_count", _presence(q.vq_count), "SELECT count(*) AS n FROM (SELECT DISTINCT s, p, o FROM pres)")
_add("vq_events", _presence(lambda p: _listed(q.vq(p, 9)), events_presence), _lists().replace("least(v_to, 7)", "least(v_to, 10)").replace("v_from <= 6", "v_from <= 9"), EVENTS_SQL)


def _combined(spark: SparkSession, d: str) -> DataFrame:
    p = orders_presence(spark, d)
    return _listed(chain.vq_hybrid({v: q.vm(p, v) for v in SNAPSHOTS}, orders_log(spark, d), LAST_ORDERS))


_add("vq_combined_chains", _combined, _lists())
_add("vq_first_versions", _presence(lambda p: p.groupBy(*TRIPLE).agg(F.min("v_from").alias("first_version"))), "SELECT s, p, o, min(v_from) AS first_version FROM pres GROUP BY s, p, o")
_add("presence_intervals", _presence(lambda p: p), "SELECT s, p, o, v_from, CAST(v_to AS INTEGER) AS v_to FROM pres")
_add("presence_events", _presence(lambda p: p, events_presence), "SELECT s, p, o, v_from, CAST(v_to AS INTEGER) AS v_to FROM pres", EVENTS_SQL)


def _untidy(spark: SparkSession, d: str) -> DataFrame:
    """The log with a redundant addition at version 6 for each addition and a deletion before everything for each change."""
    change = lambda version, op: F.struct(F.lit(version).alias("version") if isinstance(version, int) else version, F.lit(op).alias("op") if isinstance(op, int) else op)
    more = F.when(F.col("op") == 1, F.array(change(6, 1))).otherwise(F.array())
    three = F.concat(F.array(change(F.col("version"), F.col("op")), change(-1, -1)), more)
    return intervals(normalise(orders_log(spark, d, together=True).select(*TRIPLE, F.explode(three).alias("c")).select("c.version", *TRIPLE, "c.op")))


_add("log_normalised", _untidy, f""", one AS (SELECT version, s, p, o, max(op) AS op FROM (SELECT * FROM log UNION ALL SELECT DISTINCT 6, s, p, o, 1 FROM log WHERE op = 1) GROUP BY ALL),
kept AS (SELECT * FROM (SELECT *, lag(op) OVER (PARTITION BY s, p, o ORDER BY version) AS b FROM one) WHERE op <> coalesce(b, -1))
SELECT s, p, o, version AS v_from, CAST(v_to AS INTEGER) AS v_to FROM (SELECT *, coalesce(lead(version) OVER (PARTITION BY s, p, o ORDER BY version), {OPEN}) AS v_to FROM kept) WHERE op = 1""")

_add("patch_reconstruct", _log(lambda g: patch.reconstruct(g, 3, 5)), _signed(3, 5))


def _lww(spark: SparkSession, d: str) -> DataFrame:
    g = orders_log(spark, d).select(*TRIPLE, "op", F.col("version").alias("seq"))
    return patch.last_write_wins(g)


_add("patch_dedup_lww", _lww, "SELECT s, p, o, op FROM (SELECT *, row_number() OVER (PARTITION BY s, p, o ORDER BY version DESC) AS rn FROM log) WHERE rn = 1")


def _writes(spark: SparkSession, d: str) -> DataFrame:
    """The log and a second addition of each triple just before the last version; the flag is set where the order is even."""
    g = orders_log(spark, d)
    more = g.where("op = 1").select(*TRIPLE).distinct().select(*TRIPLE, F.lit(1).alias("op"), F.lit(11).alias("seq"))
    all_writes = g.select(*TRIPLE, "op", (2 * F.col("version")).alias("seq")).unionByName(more)
    return patch.written_in_order(all_writes.withColumn("local", F.col("seq") % 4 == 0))


_add("patch_writes_in_order", _writes, """, w AS (SELECT s, p, o, op, 2 * version AS seq FROM log UNION ALL SELECT DISTINCT s, p, o, 1, 11 FROM log WHERE op = 1),
f AS (SELECT s, p, o, list_reduce(list({'op': op, 'l': seq % 4 = 0} ORDER BY seq), lambda a, x: CASE WHEN a.op = x.op THEN x ELSE {'op': x.op, 'l': NOT a.l} END) AS r FROM w GROUP BY s, p, o)
SELECT s, p, o, r.op AS op, r.l AS local FROM f""")
_add("patch_join", _log(lambda g: patch.join_patches(g.where("version = 5"), g.where("version = 6"))), """SELECT s, p, o, coalesce(b, a) AS op, coalesce(a <> b, false) AS local
  FROM (SELECT s, p, o, max(op) FILTER (version = 5) AS a, max(op) FILTER (version = 6) AS b FROM log WHERE version IN (5, 6) GROUP BY s, p, o)""")
_add("patch_contains", _log(lambda g: patch.contains(g, 3, 5, g.select(*TRIPLE).distinct())), f"SELECT t.s, t.p, t.o, coalesce(d.op, 0) AS op FROM (SELECT DISTINCT s, p, o FROM log) t LEFT JOIN ({_signed(3, 5)}) d USING (s, p, o)")
_add("patch_clashes", _log(lambda g: patch.clashes(g, 5, g.where("version = 6").select(*TRIPLE))), "SELECT s, p, o FROM log WHERE version IN (5, 6) GROUP BY s, p, o HAVING count(DISTINCT version) = 2")


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """Both parts of a version in one order, with each element's place."""
    g = orders_log(spark, d).where("version = 2")
    both = g.where("op = 1").select(*TRIPLE, "op").unionByName(g.where("op = -1").select(*TRIPLE, "op"))
    return patch.numbered(both, [*TRIPLE, "op"], {"place": 0})


_add("patch_merged", _merged, "SELECT s, p, o, op, row_number() OVER (ORDER BY s, p, o, op) - 1 AS place FROM log WHERE version = 2")
_add("deletion_count", _log(lambda g: patch.deletion_count(g, 3, 6, (None, P, None))), f"SELECT * FROM (SELECT count(*) OVER () AS n, s, p, o FROM ({_signed(3, 6)}) WHERE op = -1 AND p = '{P}') ORDER BY s DESC, p DESC, o DESC LIMIT 1")
_add("addition_count", _log(lambda g: patch.addition_count(g, 3, 6, (None, P, None))), f"SELECT count(*) AS n FROM ({_signed(3, 6)}) WHERE op = 1 AND p = '{P}'")
_positions = ", ".join(f"row_number() OVER ({'PARTITION BY ' + ', '.join(k) if k else ''} ORDER BY s, p, o) - 1 AS pos_{''.join(c if c in k else '_' for c in TRIPLE)}" for k in patch.SHAPES)
_add("deletion_positions", _log(lambda g: patch.deletion_positions(g, 3, 6)), f"SELECT s, p, o, {_positions} FROM ({_signed(3, 6)}) WHERE op = -1")
_add("addition_counts_cube", _log(lambda g: patch.addition_counts(g, 3, 6, 3)), f"SELECT s, p, o, count(*) AS n FROM ({_signed(3, 6)}) WHERE op = 1 GROUP BY CUBE (s, p, o) HAVING count(*) >= 3 AND grouping(s, p, o) <> 0")


def _routing(spark: SparkSession, d: str) -> DataFrame:
    starts = spark.createDataFrame([(s,) for s in SNAPSHOTS], "snapshot int")
    return chain.routing(starts, spark.range(-1, 9).select(F.col("id").cast("int").alias("version")))


_add("chain_routing", _routing, "SELECT CAST(v AS INTEGER) AS version, CASE WHEN v < 0 THEN -1 WHEN v < 3 THEN 0 WHEN v < 6 THEN 3 ELSE 6 END AS snapshot FROM range(-1, 9) r(v)")


def _meta(spark: SparkSession, d: str) -> DataFrame:
    g = orders_log(spark, d)
    return strategy.version_meta(intervals(g), g, 0, LAST_ORDERS)


_META = f""", st AS (SELECT s, p, o, max(CASE WHEN {_at(0)} THEN 1 ELSE 0 END) AS base FROM pres GROUP BY s, p, o),
v AS (SELECT CAST(range AS INTEGER) AS version FROM range(1, 7)),
h AS (SELECT v.version, s, p, o, max(CASE WHEN v_from <= v.version AND v_to > v.version THEN 1 ELSE 0 END) AS now FROM pres, v GROUP BY ALL),
g AS (SELECT version, CAST(sum(CASE WHEN now = 1 AND base = 0 THEN 1 ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN now = 0 AND base = 1 THEN 1 ELSE 0 END) AS BIGINT) AS d, CAST(sum(base) AS BIGINT) AS n FROM h JOIN st USING (s, p, o) GROUP BY version),
x AS (SELECT g.version, (SELECT count(*) FROM log WHERE log.version = g.version) AS delta_size, a + d AS agg_delta_size, n - d + a AS version_size, CAST(a + d AS DOUBLE) / greatest(n + a, 1) AS change_ratio, n FROM g),
meta AS (SELECT version, delta_size, agg_delta_size, version_size, change_ratio, coalesce(CAST(delta_size AS DOUBLE) / (lag(version_size) OVER (ORDER BY version) + delta_size), 0.0) AS local_change_ratio, n FROM x)
"""
_add("version_metadata", _meta, _META + "SELECT version, delta_size, agg_delta_size, version_size, change_ratio, local_change_ratio FROM meta")


def _strategy(make: Callable[[], strategy.Strategy]) -> Query:
    """(version, create) of each version of one chain, from its metadata (a row per version)."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = sorted(_meta(spark, d).collect(), key=lambda r: r.version)
        first = q.vm(orders_presence(spark, d), 0).count()
        c, out, decide = strategy.Chain(0, first), [], make()
        for r in rows:
            c.versions.append(strategy.Version(r.version, r.delta_size, r.agg_delta_size, r.version_size, r.change_ratio, r.local_change_ratio))
            out.append((r.version, decide(c)))
        return spark.createDataFrame(out, "version int, create boolean")

    return run


_size2, _agg = "agg_delta_size > 1.5 * n", "sum(change_ratio) OVER (ORDER BY version) >= 1.5"
for name, make, sql in (
    ("strategy_interval", lambda: strategy.interval(2), "version % 2 = 0"),
    ("strategy_size", lambda: strategy.size(2.0), "CAST(agg_delta_size AS DOUBLE) / (CAST(sum(delta_size) OVER (ORDER BY version) AS BIGINT) // version) > 2.0"),
    ("strategy_size2", lambda: strategy.size2(1.5), _size2),
    ("strategy_change", lambda: strategy.change(0.6), "change_ratio > 0.6"),
    ("strategy_aggchange", lambda: strategy.aggchange(1.5), _agg),
    ("strategy_locaggchange", lambda: strategy.locaggchange(0.8), "sum(local_change_ratio) OVER (ORDER BY version) >= 0.8"),
    ("strategy_composite", lambda: strategy.parse("and_interval-size2", "2-1.5"), f"version % 2 = 0 AND {_size2}"),
    ("strategy_either", lambda: strategy.parse("or_interval-aggchange", "4-1.5"), f"version % 4 = 0 OR {_agg}"),
):
    _add(name, _strategy(make), _META + f'SELECT version, {sql} AS "create" FROM meta')

_c = lambda x: f"(SELECT CAST(count(*) AS DOUBLE) FROM {x})"
_terms = lambda v: f"SELECT s AS t FROM pres WHERE {_at(v)} UNION SELECT p FROM pres WHERE {_at(v)} UNION SELECT o FROM pres WHERE {_at(v)}"
_subjects = lambda i, j: f"((SELECT s FROM pres WHERE {_at(i)} EXCEPT SELECT s FROM pres WHERE {_at(j)}) UNION (SELECT s FROM pres WHERE {_at(j)} EXCEPT SELECT s FROM pres WHERE {_at(i)}))"
_add("stat_change_ratio", _presence(lambda p: stats.change_ratio(p, 2, 4)), f"SELECT {_c('(' + _delta(2, 4) + ')')} / ({_c(f'pres WHERE {_at(2)}')} + {_c('(' + _delta(2, 4) + ')')}) AS value")
_add("stat_growth_ratio", _presence(lambda p: stats.growth_ratio(p, 2, 4)), f"SELECT {_c(f'pres WHERE {_at(4)}')} / {_c(f'pres WHERE {_at(2)}')} AS value")
_add("stat_dynamicity", _presence(lambda p: stats.dynamicity(p, 2, 4)), f"SELECT {_c(f'(({_terms(2)}) EXCEPT ({_terms(4)}))')[:-1]}) + {_c(f'(({_terms(4)}) EXCEPT ({_terms(2)}))')} AS x".replace("SELECT (", "SELECT ((", 1).replace(" AS x", f") / {_c(f'(({_terms(2)}) UNION ({_terms(4)}))')} AS value"))
_add("stat_entity_changes", _presence(lambda p: stats.entity_changes(p, 2, 4)), f"SELECT count(*) AS value FROM {_subjects(2, 4)}")
_add("stat_triple_to_entity_change", _presence(lambda p: stats.triple_to_entity_change(p, 2, 4)), f"SELECT (SELECT CAST(count(*) AS DOUBLE) FROM ({_delta(2, 4)}) WHERE s IN {_subjects(2, 4)}) / {_c(_subjects(2, 4))} AS value")
_add("stat_object_updates", _presence(lambda p: stats.object_updates(p, 2, 4)), f"SELECT count(*) AS value FROM ({_delta(2, 4)}) a JOIN ({_delta(2, 4)}) b USING (s, p) WHERE a.addition AND NOT b.addition AND a.o <> b.o")
_add("stat_consecutive", _presence(lambda p: stats.consecutive(p, LAST_ORDERS)), """, c AS (SELECT CAST(r.v AS INTEGER) AS v, count(pres.s) AS n FROM range(0, 7) r(v) LEFT JOIN pres ON v_from <= r.v AND v_to > r.v GROUP BY r.v),
a AS (SELECT v_from AS v, count(*) AS n FROM pres GROUP BY v_from), d AS (SELECT v_to AS v, count(*) AS n FROM pres GROUP BY v_to),
x AS (SELECT c.v AS version, CAST(b.n AS DOUBLE) AS before, c.n AS now, coalesce(a.n, 0) AS n_added, coalesce(d.n, 0) AS n_deleted FROM c JOIN c b ON b.v = c.v - 1 LEFT JOIN a ON a.v = c.v LEFT JOIN d ON d.v = c.v)
SELECT version, (n_added + n_deleted) / (before + n_added + n_deleted) AS change_ratio, now / before AS growth_ratio, n_added, n_deleted FROM x""")
_add("dict_cardinalities", _presence(lambda p: terms.cardinalities(q.vm(p, 5))), f"""SELECT (SELECT count(*) FROM ({_terms(5)})) AS n_elements, count(DISTINCT s) AS n_subjects, count(DISTINCT p) AS n_predicates, count(DISTINCT o) AS n_objects,
  (SELECT count(*) FROM (SELECT s FROM pres WHERE {_at(5)} INTERSECT SELECT o FROM pres WHERE {_at(5)})) AS n_shared, count(DISTINCT o) FILTER (o LIKE '"%') AS n_literals, count(DISTINCT o) FILTER (o NOT LIKE '"%') AS n_non_literals FROM pres WHERE {_at(5)}""")


def _shared(spark: SparkSession, d: str) -> DataFrame:
    """Customers become subjects too, so that some terms take both positions."""
    t = q.vm(orders_presence(spark, d), 5)
    turned = F.when(F.col("p") == "ex:placedBy", F.struct(F.col("o").alias("s"), F.lit("ex:placed").alias("p"), F.col("s").alias("o")))
    return terms.terms(t.select(F.explode(F.array(F.struct(*TRIPLE), turned)).alias("t")).where("t IS NOT NULL").select("t.*"), "shared")


_add("dict_shared_terms", _shared, f"SELECT DISTINCT x AS term FROM (SELECT s AS x FROM pres WHERE {_at(5)} AND p = 'ex:placedBy' UNION ALL SELECT o FROM pres WHERE {_at(5)} AND p = 'ex:placedBy')")


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return terms.dictionary(q.vm(orders_presence(spark, d), 5))


_add("dict_term_ids", _ids, f"SELECT t AS term, row_number() OVER (ORDER BY t) AS term_id FROM ({_terms(5)})")


def _round_trip(spark: SparkSession, d: str) -> DataFrame:
    t = q.vm(orders_presence(spark, d), 5, (None, P, None)).select(*[F.concat(F.lit("<"), c, F.lit(">")).alias(c) for c in ("s", "p")], F.concat(F.lit('"'), "o", F.lit('"')).alias("o"))
    return ntriples.parse(ntriples.lines(t))


_add("ntriples_roundtrip", _round_trip, f"""SELECT '<' || s || '>' AS s, '<' || p || '>' AS p, '"' || o || '"' AS o FROM pres WHERE {_at(5)}{_match((None, P, None))}""")
for name, run, sql in (
    ("sink_vm", lambda p: ntriples.show_triples(q.vm(p, 5, (None, P, O))), f"SELECT s || ' ' || p || ' ' || o || '.' AS line FROM pres WHERE {_at(5)}{_match((None, P, O))}"),
    ("sink_dm", lambda p: ntriples.show_delta(q.dm(p, 4, 5)), f"SELECT CASE WHEN addition THEN '+ ' ELSE '- ' END || s || ' ' || p || ' ' || o || '.' AS line FROM ({_delta(4, 5)})"),
    ("sink_vq", lambda p: ntriples.show_versions(q.vq(p, LAST_ORDERS, (None, P, O))), f"SELECT s || ' ' || p || ' ' || o || '. :: [ ' || versions || ' ]' AS line FROM ({_lists(_match((None, P, O)))})"),
):
    _add(name, _presence(run), sql)


# --- lookups, seeks, positions, routes and estimates

_E = ("ex:order/100", P, "archived", 1)
_K = "(s, p, o) >= ('ex:order/5', 'ex:placedBy', 'x')"
_add("latest_versions", _log(lambda g: lookup.latest_versions(g, 4, (None, P, None))), f"SELECT s, p, o, coalesce(max(version) FILTER (op = 1), -1) AS added, coalesce(max(version) FILTER (op = -1), -1) AS deleted FROM log WHERE version <= 4 AND p = '{P}' GROUP BY s, p, o")
_add("latest_versions_exact", _log(lambda g: lookup.latest_versions(g, 4, exact=True)), "SELECT s, p, o, coalesce(max(version) FILTER (op = 1), -1) AS added, coalesce(max(version) FILTER (op = -1), -1) AS deleted FROM log WHERE version = 4 GROUP BY s, p, o")
_add("changes_up_to", _log(lambda g: lookup.changes(g, version=2, exact=False)), "SELECT version, s, p, o, op FROM log WHERE version <= 2")
_add("changes_from_key", _log(lambda g: lookup.changes(g, ("ex:order/5", "ex:placedBy", "x"), version=3, limit=50)), f"SELECT version, s, p, o, op FROM log WHERE version = 3 AND {_K} ORDER BY s, p, o LIMIT 50")
_add("changes_backwards", _log(lambda g: lookup.changes(g, ("ex:order/5", "ex:placedBy", "x"), version=3, reverse=True, limit=50)), f"SELECT version, s, p, o, op FROM log WHERE version = 3 AND {_K.replace('>', '<')} ORDER BY s DESC, p DESC, o DESC LIMIT 50")
_add("first_deletion", _log(lambda g: lookup.first_deletion(g, 3, 6, (None, P, None))), f"SELECT s, p, o FROM ({_signed(3, 6)}) WHERE op = -1 AND p = '{P}' ORDER BY p, o, s LIMIT 1")
_add("additions_from_offset", _log(lambda g: lookup.additions(g, 3, 6, (None, P, None), 40, 30)), f"SELECT s, p, o FROM ({_signed(3, 6)}) WHERE op = 1 AND p = '{P}' ORDER BY p, o, s LIMIT 30 OFFSET 40")
_add("additions_of_all_versions", _log(lambda g: lookup.additions(g, 0, 0, (None, P, None))), f"SELECT DISTINCT s, p, o FROM log WHERE op = 1 AND p = '{P}'")
_add("version_index", _presence(lambda p: lookup.version_index(p, 5)), f'SELECT s, p, o, CAST(sum(greatest(least(v_to, 5) - v_from, 0)) AS BIGINT) AS "index" FROM pres WHERE v_from <= 5 GROUP BY s, p, o HAVING max(CASE WHEN {_at(5)} THEN 1 ELSE 0 END) = 1')
_v5 = "(SELECT s, p, o, op FROM log WHERE version = 5)"
_e = "('" + "', '".join(_E[:3]) + "', 1)"
for name, run, sql in (
    ("position_of", lambda g: lookup.position_of(g, _E), f"SELECT count(*) AS position FROM {_v5} WHERE (s, p, o, op) < {_e}"),
    ("position_of_strict", lambda g: lookup.position_of(g, ("ex:none", "x", "y", 1), strict=True), "SELECT CAST(-1 AS BIGINT) AS position"),
    ("position_of_pattern", lambda g: lookup.position_of_pattern(g, _E, "pt"), f"SELECT count(*) - 1 AS position FROM {_v5} WHERE (s, p, o, op) <= {_e} AND p = '{P}' AND op = 1"),
    ("index_of_triple", lambda g: lookup.index_of_triple(g, ("ex:none", "x", "y")), "SELECT CAST(-1 AS BIGINT) AS position"),
    ("element_at", lambda g: lookup.element_at(g, 7), f"SELECT * FROM {_v5} ORDER BY s, p, o, op LIMIT 1 OFFSET 7"),
    ("overwritten", lambda g: lookup.overwritten(g, 7, ("a", "b", "c", 1)), f"SELECT s, p, o, op FROM (SELECT *, row_number() OVER (ORDER BY s, p, o, op) AS n FROM {_v5}) WHERE n <> 8 UNION ALL SELECT 'a', 'b', 'c', 1"),
):
    _add("patch_" + name, _log(lambda g, run=run: run(g.where("version = 5").select(*TRIPLE, "op"))), sql)
_add("dm_folded_chains", _log(lambda g: lookup.folded_delta(g, SNAPSHOTS, 0, 6)), _signed(0, 6))


def _snapshot_route(i: int, j: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = orders_presence(spark, d)
        return lookup.snapshot_delta(orders_log(spark, d), {v: q.vm(p, v) for v in SNAPSHOTS}, i, j)

    return run


_add("dm_snapshot_route_near", _snapshot_route(0, 3), _delta(0, 3))
_add("dm_snapshot_route_far", _snapshot_route(0, 6), _delta(0, 6))
_add("vm_estimate", lambda spark, d: lookup.vm_estimate(orders_log(spark, d), q.vm(orders_presence(spark, d), 3), 3, 5, (None, P, None)), f"SELECT count(*) AS n, 'EXACT' AS kind FROM pres WHERE {_at(5)}{_match((None, P, None))}")
_add("vq_estimate", _presence(lambda p: lookup.vq_estimate(p, SNAPSHOTS, (None, P, None))), " UNION ALL ".join(
    [f"SELECT sum(n)::BIGINT AS n, 'UP_TO' AS kind FROM (SELECT count(*) AS n FROM pres WHERE {_at(0)}{_match((None, P, None))}"]
    + [f"SELECT count(*) FROM pres WHERE {_at(v)}{_match((None, P, None))}" for v in SNAPSHOTS[1:]]
    + [f"SELECT count(DISTINCT (s, p, o)) FROM pres WHERE v_from > {a} AND v_from < {b}{_match((None, P, None))}" for a, b in ((0, 3), (3, 6), (6, OPEN))]
) + ")")


def _by_ids(spark: SparkSession, d: str) -> DataFrame:
    """VM by a pattern of ids: encoded where the predicate has the pattern's id, then decoded."""
    n = parts(spark.read.parquet(f"{d}/orders.parquet"))
    rows = q.vm(orders_presence(spark, d), 5).persist(StorageLevel.DISK_ONLY)
    ids = terms.dictionary(rows, n)
    match = {"p": ids.where(F.col("term") == P)}
    encoded = terms.encode(rows, ids, match).persist(StorageLevel.DISK_ONLY)
    return terms.decode(encoded, ids, match).select(*TRIPLE)


_add("vm_by_ids", _by_ids, f"SELECT s, p, o FROM pres WHERE {_at(5)}{_match((None, P, None))}")
for _role, _name in (("s", "subjects"), ("p", "predicates"), ("o", "objects")):
    _add(f"dict_{_name}", _presence(lambda p, r=_role: terms.terms(q.vm(p, 5), r)), f"SELECT DISTINCT {_role} AS term FROM pres WHERE {_at(5)}")
_add("stat_consecutive_table", lambda spark, d: stats.consecutive_table(orders_log(spark, d), orders_presence(spark, d), LAST_ORDERS), """, v AS (SELECT CAST(range AS INTEGER) AS v FROM range(0, 7)),
h AS (SELECT s, p, o, v.v FROM pres, v WHERE v_from <= v.v AND v_to > v.v),
tv AS (SELECT DISTINCT t, v FROM (SELECT s AS t, v FROM h UNION ALL SELECT p, v FROM h UNION ALL SELECT o, v FROM h)),
sv AS (SELECT DISTINCT s, v FROM h),
pairs AS (SELECT i.v AS version FROM v i WHERE i.v > 0),
dyn AS (SELECT version, count(*) FILTER (n = 1)::DOUBLE / count(*) AS dynamicity FROM (SELECT version, t, count(*) AS n FROM pairs JOIN tv ON tv.v IN (version - 1, version) GROUP BY version, t) GROUP BY version),
sigma AS (SELECT version, s FROM pairs JOIN sv ON sv.v IN (version - 1, version) GROUP BY version, s HAVING count(*) = 1),
ec AS (SELECT version, count(*) AS k FROM sigma GROUP BY version),
tec AS (SELECT log.version, count(*) AS n FROM log JOIN sigma USING (version, s) GROUP BY log.version),
rest AS (SELECT log.* FROM log ANTI JOIN sigma USING (version, s)),
ou AS (SELECT version, count(*) AS u FROM rest a WHERE op = 1 AND EXISTS (SELECT 1 FROM rest b WHERE b.op = -1 AND b.version = a.version AND b.s = a.s AND b.p = a.p) GROUP BY version),
n AS (SELECT v, count(*)::DOUBLE AS n FROM h GROUP BY v), d AS (SELECT version, count(*)::DOUBLE AS d FROM log GROUP BY version)
SELECT version, coalesce(d, 0) / (b.n + coalesce(d, 0)) AS change_ratio, dynamicity, n.n / b.n AS growth_ratio, coalesce(k, 0) AS entity_changes,
  coalesce(tec.n::DOUBLE / k, 0.0) AS triple_to_entity_change, coalesce(u, 0) AS object_updates
FROM pairs JOIN n ON n.v = version JOIN n b ON b.v = version - 1 LEFT JOIN d USING (version) LEFT JOIN dyn USING (version) LEFT JOIN ec USING (version) LEFT JOIN tec USING (version) LEFT JOIN ou USING (version)""")


# --- the same from an archive on disk


def _stored(f: Callable) -> Query:
    return lambda spark, d: f(stored_orders(spark, d))


for name, v, m in (("vm_all", 5, (None, None, None)), ("vm_s", 4, (S, None, None)), ("vm_po", 3, (None, P, O)), ("vm_o", 6, (None, None, O)), ("vm_beyond_max", 99, (None, P, O))):
    _add(f"stored_{name}", _stored(lambda a, v=v, m=m: a.vm(v, m)), f"SELECT s, p, o FROM pres WHERE {_at(v)}{_match(m)}")
_add("stored_vm_hybrid", _stored(lambda a: a.vm_hybrid(5, (None, P, None))), f"SELECT s, p, o FROM pres WHERE {_at(5)}{_match((None, P, None))}")
_add("stored_dm_range", _stored(lambda a: a.dm(1, 6)), _delta(1, 6))
_add("stored_dm_pattern", _stored(lambda a: a.dm(1, 5, (None, P, "archived"))), _delta(1, 5, _match((None, P, "archived"))))
_add("stored_vq_pattern", _stored(lambda a: _listed(a.vq((None, P, "archived")))), _lists(_match((None, P, "archived"))))
_add("stored_log", _stored(lambda a: a.log()), "SELECT version, s, p, o, op FROM log")
_add("stored_presence", _stored(lambda a: a.presence()), "SELECT s, p, o, v_from, CAST(v_to AS INTEGER) AS v_to FROM pres")
