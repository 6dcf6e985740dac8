"""Genetic search over factor expressions.

Trees are made, crossed and changed on the driver with a seeded generator: typed growth half and half
(Koza, 1992; types after Montana, 1995), one-point crossover, uniform mutation, tournaments, a limit on
height. A whole generation is scored in one Spark job: every distinct expression is one column of one
panel, and all their rank ICs are one grouped aggregation."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field
from statistics import mean, pstdev

from pyspark.sql import functions as F

from panelforge.functions.nulls import fin, safe_div
from panelforge.operators.cross_section import rank
from panelforge.plans.expr import FLOAT, INT, SERIES, Node, Registry, evaluate, native
from panelforge.plans.panel import Panel

WORST = float("-inf")


@dataclass(frozen=True)
class Settings:
    population: int = 20
    generations: int = 5
    min_depth: int = 2
    max_depth: int = 4
    max_height: int = 4
    tournament: int = 5
    crossover: float = 0.4
    mutation: float = 0.4
    hall_of_fame: int = 50
    seed: int = 42


@dataclass
class Result:
    best: list[tuple[float, str]]
    log: list[dict] = field(default_factory=list)


class Breeder:
    """Random trees over a registry and the fields of a panel."""

    def __init__(self, registry: Registry, fields: tuple[str, ...], rng: random.Random):
        self.registry, self.fields, self.rng = registry, fields, rng
        self.by_type = {t: sorted((o for o in registry.ops.values() if o.returns == t and o.family != "frame"), key=lambda o: o.name) for t in (SERIES, FLOAT)}

    def leaf(self, kind: str) -> Node:
        if kind == INT:
            return Node("const", kind=INT, value=self.rng.choice(self.registry.ints or (3, 5, 10)))
        if kind == FLOAT:
            return Node("const", kind=FLOAT, value=self.rng.choice(self.registry.floats or (1.0, 2.0)))
        return Node(self.rng.choice(self.fields))

    def grow(self, kind: str, low: int, high: int, full: bool) -> Node:
        """A tree whose leaves lie between depths low and high; all at high if full."""
        stop = high <= 0 or (not full and low <= 0 and self.rng.random() < 0.3)
        choice = self.by_type.get(kind)
        if stop or not choice:
            return self.leaf(kind)
        op = self.rng.choice(choice)
        return Node(op.name, tuple(self.grow(k, low - 1, high - 1, full) for k in op.args), kind)

    def individual(self, low: int, high: int) -> Node:
        return self.grow(SERIES, low, self.rng.randint(low, high), self.rng.random() < 0.5)

    @staticmethod
    def places(n: Node, at: tuple[int, ...] = ()) -> list[tuple[tuple[int, ...], Node]]:
        return [(at, n)] + [x for k, a in enumerate(n.args) for x in Breeder.places(a, (*at, k))]

    @staticmethod
    def put(n: Node, at: tuple[int, ...], new: Node) -> Node:
        if not at:
            return new
        args = tuple(Breeder.put(a, at[1:], new) if k == at[0] else a for k, a in enumerate(n.args))
        return Node(n.name, args, n.kind, n.value)

    def cross(self, a: Node, b: Node, height: int) -> tuple[Node, Node]:
        """Two sub-trees of one type swapped; a child over the height limit is its parent instead."""
        pa, pb = self.places(a)[1:], self.places(b)[1:]
        kinds = sorted({n.kind for _, n in pa} & {n.kind for _, n in pb})
        if not kinds:
            return a, b
        kind = self.rng.choice(kinds)
        (i, x), (j, y) = self.rng.choice([p for p in pa if p[1].kind == kind]), self.rng.choice([p for p in pb if p[1].kind == kind])
        c, d = self.put(a, i, y), self.put(b, j, x)
        return c if c.height <= height else a, d if d.height <= height else b

    def mutate(self, a: Node, height: int) -> Node:
        at, old = self.rng.choice(self.places(a))
        new = self.put(a, at, self.grow(old.kind, 0, 2, True))
        return new if new.height <= height else a


def rank_ic_fitness(panel: Panel, trees: list[Node], registry: Registry, returns: str = "fwd_ret") -> dict[str, float]:
    """Mean rank IC of every distinct expression, from one job; WORST where there is none."""
    names = {str(t): f"e{k}" for k, t in enumerate(dict.fromkeys(trees))}
    full = evaluate(panel, {names[str(t)]: t for t in dict.fromkeys(trees)}, registry)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("e"), F.col(n).cast("double").alias("f")) for n in names.values()]))
    long = full.df.select(F.col(panel.symbol).alias("symbol"), F.col(panel.ts).alias("ts"), fin(F.col(returns)).alias("r"), pairs.alias("p")).select("symbol", "ts", "r", "p.e", fin(F.col("p.f")).alias("f"))
    long = long.where("f is not null and r is not null").withColumn("at", F.struct("e", "ts"))
    long = long.withColumn("fr", rank(F.col("f"), "at")).withColumn("rr", rank(F.col("r"), "at"))
    per = long.groupBy("e", "ts").agg(F.when(F.count("*") > 1, safe_div(F.covar_pop("fr", "rr"), F.stddev_pop("fr") * F.stddev_pop("rr"))).alias("v"))
    got = {r["e"]: r["v"] for r in per.groupBy("e").agg(F.avg("v").alias("v")).collect()}  # one row per expression
    return {key: WORST if got.get(n) is None else got[n] for key, n in names.items()}


def search(panel: Panel, settings: Settings = Settings(), registry: Registry | None = None, fitness: Callable | None = None, returns: str = "fwd_ret") -> Result:
    """Evolve expressions over the panel's fields. fitness: (panel, trees, registry) -> value by printed
    expression. The same settings give the same result."""
    registry = registry or native()
    rng = random.Random(settings.seed)
    breeder = Breeder(registry, panel.fields, rng)
    score = fitness or (lambda p, t, r: rank_ic_fitness(p, t, r, returns))
    known: dict[str, float] = {}
    people = [breeder.individual(settings.min_depth, settings.max_depth) for _ in range(settings.population)]
    log, fame = [], {}
    for generation in range(settings.generations + 1):
        new = [t for t in dict.fromkeys(people) if str(t) not in known]
        if new:
            known |= score(panel, new, registry)
        fame |= {str(t): known[str(t)] for t in people}
        values = [known[str(t)] for t in people if known[str(t)] > WORST]
        sizes = [t.size for t in people]
        of = lambda xs: {"avg": mean(xs), "std": pstdev(xs), "min": min(xs), "max": max(xs)} if xs else {}
        log.append({"generation": generation, "evaluated": len(new), "fitness": of(values), "size": of(sizes)})
        if generation == settings.generations:
            break
        chosen = [max(rng.choices(people, k=settings.tournament), key=lambda t: known[str(t)]) for _ in people]
        for k in range(1, len(chosen), 2):
            if rng.random() < settings.crossover:
                chosen[k - 1], chosen[k] = breeder.cross(chosen[k - 1], chosen[k], settings.max_height)
        people = [breeder.mutate(t, settings.max_height) if rng.random() < settings.mutation else t for t in chosen]
    best = sorted(((v, e) for e, v in fame.items()), key=lambda x: (-x[0], x[1]))[: settings.hall_of_fame]
    return Result(best, log)
