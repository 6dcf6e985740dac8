import pytest

from panelforge.plans import expr
from panelforge.plans.expr import ExpressionError, evaluate, parse, valid
from panelforge.plans.gp import Breeder, Settings, rank_ic_fitness, search
from panelforge.plans.panel import Panel

FIELDS = ("open", "close", "volume")


def test_registries():
    n, d, old = expr.native(), expr.dialect(), expr.legacy()
    assert len(n.ops) == 14 + 5 + 12 and len(n.ints) == 63
    assert len(expr.native(False, False).ops) == 14
    assert len(d.ops) == 56 and d.ints == tuple(range(1, 1000))
    assert old.ints == (3, 5, 6, 9, 10, 12, 15, 18, 20, 24, 30, 60, 90, 120) and "fabs" in old.ops


@pytest.mark.parametrize("text", ["open", "add(open, close)", "ts_corr(rank(open), close, get_10)", "signed_power(open, get_f2)"])
def test_round_trip(text):
    assert valid(text, expr.native(), FIELDS)
    assert str(parse(str(parse(text, expr.native(), FIELDS)), expr.native(), FIELDS)) == text


@pytest.mark.parametrize("text", ["", "add(open)", "add(open, get_3)", "nothing(open)", "price", "add(open, close", "add(open, close))", "ts_mean(open, close)", "rank(open) x", "ts_mean(open, get_f3)"])
def test_refused(text):
    assert not valid(text, expr.native(), FIELDS)
    with pytest.raises(ExpressionError):
        parse(text, expr.native(), FIELDS)


def test_one_level_shares_its_shuffle(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 2.0, 3.0)], "symbol string, ts int, open double, close double, volume double")
    p = Panel(df, FIELDS)
    plan = evaluate(p, {"a": "ts_mean(open, 3)", "b": "ts_sum(close, 5)", "c": "add(ts_mean(open, 3), ts_delay(volume, 2))"}).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    plan = evaluate(p, {"a": "ts_mean(rank(ts_mean(open, 3)), 3)"}).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3


def test_user_operator(spark):
    reg = expr.native()

    @reg.register("twice", (expr.SERIES,))
    def twice(x):
        return x * 2

    df = spark.createDataFrame([("a", 1, 1.5)], "symbol string, ts int, open double")
    assert evaluate(Panel(df, ("open",)), {"v": "twice(open)"}, reg).df.first()["v"] == 3.0


def test_dialect_numbers(spark):
    df = spark.createDataFrame([("a", 1, 1.5)], "symbol string, ts int, open double")
    row = evaluate(Panel(df, ("open",)), {"a": "add_nf(open, 2.0)", "b": "subtract_fn(2.0, open)", "c": "add_nf(open, multiply_ff(2.0, 3.0))", "d": "max_nf(open, 9.0)"}, expr.dialect()).df.first()
    assert (row["a"], row["b"], row["c"], row["d"]) == (3.5, 0.5, 7.5, 9.0)


def _panel(spark):
    from panelforge.sources.ingest import made_up_bars

    df = made_up_bars(spark, 12, 40).withColumnRenamed("open_time", "ts").select("symbol", "ts", "open", "close", "volume")
    p = Panel(df.cache(), FIELDS)
    return p.forward_returns().trim()


def test_search_is_deterministic_and_selects(spark):
    p = _panel(spark)
    s = Settings(population=6, generations=1, max_depth=2, max_height=3, seed=3)
    a, b = search(p, s), search(p, s)
    assert a.best == b.best and a.log == b.log
    assert [v for v, _ in a.best] == sorted((v for v, _ in a.best), reverse=True)
    assert all(valid(e, expr.native(), FIELDS) for _, e in a.best)


def test_fitness_of_a_generation_is_one_number_each(spark):
    p = _panel(spark)
    trees = [parse(e, expr.native(), FIELDS) for e in ("rank(close)", "close", "sign(volume)")]
    got = rank_ic_fitness(p, trees, expr.native())
    assert abs(got["rank(close)"] - got["close"]) < 1e-12
    assert got["sign(volume)"] == float("-inf")


def test_breeding_keeps_types_and_height():
    import random

    b = Breeder(expr.native(), FIELDS, random.Random(1))
    for _ in range(200):
        x, y = b.individual(2, 4), b.individual(2, 4)
        for t in (*b.cross(x, y, 5), b.mutate(x, 5)):
            assert t.height <= 5 and str(parse(str(t), expr.native(), FIELDS)) == str(t)
