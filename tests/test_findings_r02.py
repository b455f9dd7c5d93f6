"""Cases of the second round's findings: many candidates, slopes on a bound, events of one second."""

import datetime
import math

from evenstride.operators.match import match
from evenstride.plans.catalog import QUERIES
from evenstride.plans.spec import pattern

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
START = datetime.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(i, START + datetime.timedelta(seconds=s), 1, t, float(v)) for i, s, t, v in rows], SCHEMA)


def test_queries_refuse_no_number_of_candidates(spark, tmp_path):
    rows = [(0, 0, "signup", 1), *((i, 60 * i, "click", i % 5) for i in range(1, 23)), (23, 9000, "purchase", 1)]
    frame(spark, rows).write.parquet(str(tmp_path / "events.parquet"))
    assert QUERIES["quant_n_m"](spark, str(tmp_path)).count() == 22 + math.comb(22, 2)
    types = {"A": "signup", "B": "click", "C": "purchase"}
    assert match(frame(spark, rows), pattern("A B{20,} C", types, (), 9000, "user_id", max_candidates=None)).count() == math.comb(22, 2) + 22 + 1


def test_subsets_in_halves_are_those_of_one_fold(spark):
    ev = frame(spark, [(i, 7 * i, "ab"[i % 4 == 3], i * 7 % 5) for i in range(26)])
    for regex, where in (("A B{2,}", ()), ("A{9,}", ("average(A) >= 2",)), ("A{,3} B*", ("sum(A) - sum(B) >= 1",))):
        both = []
        for most in (20, None):
            p = pattern(regex, {"A": "a", "B": "b"} if "B" in regex else {"A": "a"}, where, 100, "user_id", max_candidates=most)
            both.append(sorted(map(tuple, match(ev, p).collect())))
        assert both[0] == both[1] and len(set(both[0])) == len(both[0]) > 0


def test_slopes_equal_those_of_the_sql_bit_by_bit(spark):
    import random

    import duckdb

    from evenstride.functions.kleene import lookup
    from evenstride.plans.oracle import list_function
    from evenstride.streaming.processor import sequence_function

    rnd = random.Random(5)
    rows = [(i, [(START + datetime.timedelta(hours=h), j, round(rnd.expovariate(0.02), 2)) for j, h in enumerate(sorted(rnd.choices(range(140), k=i % 8)))]) for i in range(600)]
    a = spark.createDataFrame(rows, "id long, a array<struct<ts:timestamp_ntz,event_id:bigint,value:double>>")
    got = dict(a.selectExpr("id", lookup("least_squares").build("a", None)).collect())
    con, sql = duckdb.connect(), list_function("least_squares", "v", "t")
    for i, seq in rows:
        v, t = [e[2] for e in seq], [e[0] for e in seq]
        assert got[i] == con.execute(f"SELECT {sql} FROM (SELECT ?::DOUBLE[] AS v, ?::TIMESTAMP[] AS t)", [v, t]).fetchone()[0], seq
        assert got[i] == sequence_function("least_squares", v, None, [(x - datetime.datetime(1970, 1, 1)).days for x in t])


def test_slope_on_the_bound_of_a_query(spark, tmp_path):
    import duckdb

    from evenstride.plans.catalog import ORACLES

    rows = []
    for u in range(400):  # four clicks whose slope is 10 exactly, in steps of a cent
        days = [0, 1, 3, 4] if u % 2 else [0, 1, 2, 5]
        rows += [(10 * u + k, START + datetime.timedelta(days=d, seconds=u), u, "click", round(u * 0.37 + 10 * d, 2)) for k, d in enumerate(days)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    name = "q_udf_sweep_least_squares"
    want = con.execute(f"SELECT user_id, a_ids FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select("user_id", "a_ids").collect())) == sorted(want)


def test_value_at_a_time_tells_events_of_one_second_apart(spark, tmp_path):
    import duckdb

    from evenstride.plans.catalog import ORACLES

    at = [(0, 0), (1, 100), (1, 900), (2, 0), (100, 7), (100, 7)]  # seconds and milliseconds of each user's clicks
    rows = []
    for u in range(2, 7):
        rows += [(10 * u + i, START + datetime.timedelta(seconds=s, milliseconds=ms), u, "click", 1.5 * i) for i, (s, ms) in enumerate(at[:u])]
    rows += [(100 + i, START + datetime.timedelta(seconds=9), 9, "click", 1.0 + i) for i in range(4)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT user_id, result FROM ({ORACLES['f_at_ts']}) ORDER BY user_id").fetchall()
    assert sorted(map(tuple, QUERIES["f_at_ts"](spark, str(tmp_path)).select("user_id", "result").collect())) == want


def test_rise_and_fall_with_slopes_on_their_bounds(spark, tmp_path):
    import duckdb

    from evenstride.plans.catalog import ORACLES

    rows = []
    for u in range(150):  # slopes of 0.1 and -0.1 exactly, in steps of a cent
        low, n = round(7.03 + 0.31 * u, 2), 0
        rise = [("click", d, round(low + 0.1 * d, 2)) for d in ((0, 1, 2), (0, 1, 3), (0, 2, 3))[u % 3]]
        fall = [("click", d, round(low - 0.1 * d, 2)) for d in ((7, 8, 9), (7, 8), (7, 9))[u % 3]]
        for kind, day, value in [*rise, ("view", 4, low + 2), ("view", 5, low + 5), ("view", 6, low + 3), *fall]:
            rows.append((20 * u + n, START + datetime.timedelta(days=day, seconds=u), u, kind, value))
            n += 1
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    cols = ["user_id", "d_ids", "e_ids"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES['q_rise_fall']})").fetchall()
    assert sorted(map(tuple, QUERIES["q_rise_fall"](spark, str(tmp_path)).select(*cols).collect())) == sorted(want) and want


def test_freed_native_memory_goes_back(spark):
    from evenstride.llm import common

    assert "Trim native heap" in common.trim(spark)
    common.tidy(spark)
