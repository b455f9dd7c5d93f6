"""Strategies against brute force, streams against batches, time zones, unions, opaque functions, generators, the entry without the rest."""

import datetime
import itertools
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from test_engine import START, brute, found, frame

from evenstride.functions.kleene import register_python_fn
from evenstride.operators.match import match, timeouts
from evenstride.plans.catalog import PATTERNS, WEATHER_TEXT
from evenstride.plans.generate import random_pattern
from evenstride.plans.parser import parse_match_recognize
from evenstride.plans.spec import pattern
from evenstride.sources import generators, readers
from evenstride.streaming.processor import Evaluator, match_stream

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def stream_of(seed, n=10):
    import random

    r = random.Random(seed)
    return [(i, r.randrange(25), r.choice((1, 2)), r.choice("abc"), float(r.randrange(10))) for i in range(n)]


def streamed(rows, p):
    ev, got = Evaluator(p), set()
    for k in {r[2] for r in rows} if p.key else {None}:
        partials = []
        for number, (s, i, v, t) in enumerate(sorted((s * 10**6, i, v, t) for i, s, u, t, v in rows if u == k or k is None), 1):
            partials, done = ev.step(partials, (s, i, v), t, number)
            got |= {(k, *(tuple(e[1] for e in m.get(x.name, [])) for x in p.vars)) for m in done}
    return got


@pytest.mark.parametrize("seed", range(12))
def test_random_patterns(spark, seed):
    p = random_pattern(seed, key="user_id" if seed % 2 else None)
    rows = stream_of(seed, 11)
    want = brute(rows, p)
    assert found(match(frame(spark, rows), p), p) == want and streamed(rows, p) == want


def by_definition(rows, p):
    """Strict: each event right after the one before in the key's stream. Next match: each event the first that its variable itself can take."""
    any_ = brute(rows, pattern(" ".join(v.name + {(1, None): "+", (1, 1): ""}[v.least, v.most] for v in p.vars), {v.name: v.types for v in p.vars}, tuple(c.text for c in p.where), p.within, p.key))
    out = set()
    for k, *ids in any_:
        mine = [i for _, i in sorted((s, i) for i, s, u, t, v in rows if u == k or k is None)]
        kind = {i: (t, v) for i, s, u, t, v in rows}
        at = [mine.index(i) for seq in ids for i in seq]
        ok = True
        for v, seq in zip(p.vars, ids):
            for i in seq:
                here = mine.index(i)
                before = max([x for x in at if x < here], default=None)
                if before is None:
                    continue
                if v.strategy == "strict":
                    ok = ok and here == before + 1
                if v.strategy == "stnm":
                    between = [kind[x] for x in mine[before + 1 : here]]
                    own = [c for c in p.where if c.variables == {v.name}]
                    ok = ok and not any(t in v.types and all(Evaluator(p).holds(c, {v.name: [(0, 0, x)]}) for c in own) for t, x in between)
        if ok:
            out.add((k, *ids))
    return out


@pytest.mark.parametrize("regex,where,strategy", [("A B C", (), "strict"), ("A B+ C", (), "strict"), ("A B C", ("B >= 3",), "stnm"), ("A B C", ("C - A >= 0",), {"A": "stam", "B": "stnm", "C": "stam"}), ("A B+", ("B[i] >= 2",), "strict")])
def test_strategies_by_definition(spark, regex, where, strategy):
    p = pattern(regex, {"A": ("a", "b"), "B": ("b", "c"), "C": ("c", "a")}, where, 14, "user_id", strategy)
    some = 0
    for seed in range(5):
        rows = stream_of(seed, 14)
        want = by_definition(rows, p)
        some += len(want)
        assert found(match(frame(spark, rows), p), p) == want, seed
        assert streamed(rows, p) == want, seed
    assert some > 3


def test_contiguous_runs_by_definition(spark):
    p = pattern("A B+ C", {"A": "a", "B": "b", "C": "c"}, (), 14, "user_id", {"A": "stam", "B": "contiguous", "C": "stam"})
    free = pattern("A B+ C", {"A": "a", "B": "b", "C": "c"}, (), 14, "user_id")
    for seed in range(6):
        rows = stream_of(seed, 14)
        want = set()
        for k, a, b, c in brute(rows, free):
            mine = [i for _, i in sorted((s, i) for i, s, u, t, v in rows if u == k and t == "b")]
            at = [mine.index(i) for i in b]
            if at == list(range(at[0], at[0] + len(at))):
                want.add((k, a, b, c))
        assert found(match(frame(spark, rows), p), p) == want


@pytest.mark.parametrize("name", ["seq_abc", "kleene_plus", "kleene_star", "quant_n_m", "q_hadoop", "sel_strict", "sel_stnm", "sel_mixed", "c_union", "c_time_last", "c_step", "neg_type"])
def test_stream_evaluator_equals_batch(spark, sf_dir, name):
    p = PATTERNS[name]
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", F.expr("timestampdiff(MICROSECOND, timestamp'1970-01-01 00:00:00', cast(ts as timestamp))").alias("us"))
    rows = [(r.event_id, r.us / 1e6, r.user_id, r.event_type, r.value) for r in ev.collect()]
    rows = [(i, s, u, t, v) for i, s, u, t, v in rows if u < 6]
    batch = found(match(spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id < 6"), p), p)
    assert streamed([(i, round(s * 10**6) / 10**6, u, t, v) for i, s, u, t, v in rows], p) == batch


def test_stream_with_timeouts(spark, sf_dir, tmp_path):
    p = PATTERNS["c_window"]
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    ev.repartitionByRange(2, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    users = spark.range(0, 200).select((-1 - F.col("id")).alias("event_id"), F.lit("2030-01-01").cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("flush").alias("event_type"), F.lit(0.0).alias("value")).limit(1)
    users.write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    q = match_stream(src, p, timeouts=True).writeStream.format("memory").queryName("stream_timeouts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    rows = spark.table("stream_timeouts").collect()
    assert {(r.key, int(r.ids), r.last_us) for r in rows if r.status == "timeout"} == {(str(r.user_id), r.a_id, r.timeout_us) for r in timeouts(ev, p).collect()}
    assert {(r.key, r.ids) for r in rows if r.status == "match"} == {(str(r.user_id), f"{r.a_id};{r.b_id}") for r in match(ev, p).collect()}


def test_results_do_not_depend_on_the_time_zone(spark, sf_dir):
    import __spark_entry__ as entry

    names = ["q_hadoop", "timeouts", "reshape", "source_offset_ts", "source_project", "p_find_increase", "trace_partials", "j_interval", "x_shared_once", "f_slope", "f_at_ts", "q_peak", "gen_hadoop", "gen_distribution"]
    show = lambda: [sorted(map(str, entry.queries()[n](spark, sf_dir).collect())) for n in names]
    utc = show()
    rows = [(1, 0, 1, "a", 1.0), (2, 1800, 1, "b", 1.0), (3, 5400, 1, "b", 1.0)]
    at = datetime.datetime(2024, 3, 10, 1, 30)  # clocks in New York skip from 2 to 3 that night
    d = spark.createDataFrame([(i, at + datetime.timedelta(seconds=s), u, t, v) for i, s, u, t, v in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    p = pattern("A B", {"A": "a", "B": "b"}, (), 3600, "user_id")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert show() == utc
        assert found(match(d, p), p) == {(1, (1,), (2,))}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_unions_and_intervals_are_read():
    p = parse_match_recognize("""SELECT * FROM Weather MATCH RECOGNIZE( PATTERN (A* D2+ B* Z) SUBSET U = (A, D, B)
      DEFINE D AS tstamp - first(D.tstamp) <= INTERVAL '5' DAY,
      Z AS last(U.tstamp) - first(U.tstamp) BETWEEN INTERVAL '25' DAY AND INTERVAL '30' DAY AND mannkendalltest(U.temp) >= 3.0
      AND linearregressionr2(D.tstamp, D.temp) >= 0.95 AND last(D.temp) - first(D.temp) < -20 )""")
    assert [(v.name, v.least, v.most) for v in p.vars] == [("A", 0, None), ("D", 2, None), ("B", 0, None), ("Z", 1, 1)]
    assert len(p.where) == 5 and p.needs(p.where[1]) == {"A", "D", "B"} and p.where[1].parts[1][2].value == 30 * 86400
    assert parse_match_recognize(WEATHER_TEXT).within == 30 * 86400
    for bad in ("U > 3", "average(X) > 1", "average(A.tstamp) > 1", "A[i].tstamp > 1", "first(A, B) > 1"):
        with pytest.raises(ValueError):
            pattern("A+ B", {}, (bad,), unions=(("U", ("A", "B")),))
    with pytest.raises(ValueError):
        pattern("A B", {}, (), unions=(("U", ("A", "Q")),))


def test_opaque_functions(spark):
    register_python_fn(spark, "spread_of_values", lambda xs: max(xs) - min(xs) if xs else None)
    p = pattern("A+ B", {"A": "a", "B": "b"}, ("spread_of_values(A) >= 4",), 20, "user_id")
    rows = [(i, i, 1, "a", float(v)) for i, v in enumerate((1, 3, 6))] + [(9, 9, 1, "b", 0.0)]
    want = {(1, c, (9,)) for n in (1, 2, 3) for c in itertools.combinations(range(3), n) if max((1, 3, 6)[i] for i in c) - min((1, 3, 6)[i] for i in c) >= 4}
    assert found(match(frame(spark, rows), p), p) == want == {(1, (0, 2), (9,)), (1, (0, 1, 2), (9,))}


def test_reshaped_prices(spark):
    rows = [(START + datetime.timedelta(microseconds=us), 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, "X") for us in (0, 600, 999, 1000, 1_500_999)]
    d = spark.createDataFrame(rows, "Date timestamp_ntz, Low double, Open double, Volume double, High double, Close double, `Adjusted Close` double, Name string")
    out = readers.reshape_prices(d)
    assert out.columns == ["ticker", "timestamp", "open_price", "peak_price", "lowest_price", "close_price", "volume"]
    assert [tuple(r) for r in out.orderBy("timestamp").collect()] == [("X", 1704067200000 + ms, 2.0, 4.0, 1.0, 5.0, 3.0) for ms in (0, 0, 0, 1, 1500)]
    text = readers.reshape_prices(spark.createDataFrame([("2024-01-01", 1.0, 2.0, 3.0, 4.0, 5.0, "X")], "Date string, Low double, Open double, Volume double, High double, Close double, Name string"))
    assert text.first().timestamp == 1704067200000


def test_symbol_csv_and_metrics(spark, tmp_path):
    (tmp_path / "g.csv").write_text("Date,Low,Open,Volume,High,Close,Adjusted Close,Type\n2024-01-02,1,2,3,4,5,6,GOOG\n2024-01-03,7,2,3,8,9,6,MSFT\n")
    got = [(r.event_type, r.value, str(r.ts)) for r in readers.read_symbol_csv(spark, str(tmp_path / "g.csv")).orderBy("event_id").collect()]
    assert got == [("GOOG", 5.0, "2024-01-02 00:00:00"), ("MSFT", 9.0, "2024-01-03 00:00:00")]
    for n in (1, 2):
        readers.write_metrics(spark, str(tmp_path / "m"), window_time=n, selection_strategy="stam", engine="batch", handle_time=0.5, matches=3, memory_usage=1.0)
    assert sorted((r.window_time, r.matches) for r in spark.read.csv(str(tmp_path / "m"), header=True, inferSchema=True).collect()) == [(1, 3), (2, 3)]


def test_generators(spark):
    h = generators.hadoop_events(spark, 700, series=2).toPandas()
    assert set(h.event_type) == set(generators.HADOOP_TYPES) and (h.value == h.value.round()).all() and h.value.min() >= 1
    assert all(g.value.max() <= generators.HADOOP_TYPES[t] for t, g in h.groupby("event_type")) and all(list(generators.HADOOP_TYPES)[c] == t for c, t in zip(h.code, h.event_type))
    for _, g in h.sort_values("event_id").groupby("series"):
        assert g.seconds.diff().dropna().between(1, 5).all() and ((g.ts - g.ts.iloc[0]).dt.total_seconds() == g.seconds - g.seconds.iloc[0]).all()
    c = generators.causal_events(spark, 400, series=2).toPandas().sort_values("event_id")
    a, b = (c[c.event_type == t].reset_index(drop=True) for t in "AB")
    assert len(a) == len(b) == 400 and abs((b.value - 2 * a.value).mean()) < 0.3 and (b.ts == a.ts).all() and c.event_id.is_unique
    w = generators.weighted_events(spark, **generators.LNG, n=2000).toPandas()
    assert abs((w.event_type == "c").mean() - 0.6) < 0.05 and w[w.event_type == "c"].value.between(200, 300).all()
    m = generators.mixture_events(spark, ["A", "B"], (0, 10), [20, 7], 0.1, 1000).toPandas()
    assert 0.05 < (m[m.event_type == "A"].value == 20).mean() < 0.15 and (m[m.event_type == "B"].value == 7).mean() > 0.05
    d = generators.distribution_events(spark, {"A": ("uniform", 0, 10), "B": ("normal", 5, 2), "C": ("exponential", 3, 1)}, 1000, kleene=("B",)).toPandas()
    assert d[d.event_type == "A"].value.between(0, 10).all() and abs(d[d.event_type == "B"].value.mean() - 5) < 0.3 and d[d.event_type == "C"].value.min() >= 1
    assert generators.hadoop_events(spark, 50).collect() == generators.hadoop_events(spark, 50).collect()


def test_entry_without_the_training_data_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    for extra in (True, False):  # with and without corpus_pipeline.py
        if not extra and (copy / "corpus_pipeline.py").exists():
            (copy / "corpus_pipeline.py").unlink()
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'q_hadoop' in q and set(o) <= set(q) and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q), list(q)"
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=120)
