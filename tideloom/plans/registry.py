"""Operators as declarative plans: one SQL text per operator, rendered for Spark and left to Catalyst."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import Dialect, Duck, Spark
from ..tables import Tables, duck_ctes

Plan = Callable[..., str]


def doubles(sql: str) -> str:
    """Make decimal literals doubles: money-like decimal arithmetic has no place in shares and scores."""
    parts = re.split(r"('(?:[^']|'')*')", sql)
    return "".join(p if i % 2 else re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", p) for i, p in enumerate(parts))


@dataclass(frozen=True)
class Operator:
    """A named plan and the parameters that its test query uses instead of the defaults."""

    name: str
    plan: Plan
    test: dict

    def sql(self, d: Dialect, **params: object) -> str:
        return doubles(self.plan(d, **params))


OPERATORS: dict[str, Operator] = {}


def operator(name: str, **test: object) -> Callable[[Plan], Plan]:
    """Register a plan ``(d, **params) -> SQL``; ``test`` are parameters under which the test tables give rows."""

    def add(plan: Plan) -> Plan:
        if name in OPERATORS:
            raise ValueError(f"{name} is registered twice")
        OPERATORS[name] = Operator(name, plan, test)
        return plan

    return add


Prepare = Callable[..., dict]
PREPARED: dict[str, Prepare] = {}


def prepared(*names: str) -> Callable[[Prepare], Prepare]:
    """Register for plans a function ``(engine, d, **params) -> more parameters``, such as the relation of a part that Spark computes in another way."""

    def add(make: Prepare) -> Prepare:
        PREPARED.update(dict.fromkeys(names, make))
        return make

    return add


class Engine:
    """Runs operators over a set of tables: ``Engine(tables).run("ag_trending", hours=48)``."""

    def __init__(self, tables: Tables, as_of: str | None = None):
        self.tables = tables
        self.as_of = as_of
        #: Fingerprints that a job of several rules has made for all of them.
        self.prints: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.tables.spark

    def dialect(self, as_of: str | None = None, lean: bool = False) -> Spark:
        """``lean``: for plans that read no texts."""
        when = as_of or self.as_of
        d = Spark(self.tables.lean_views() if lean else self.tables.views(), "")
        d.now = d.stamp(when) if when else f"(select as_of from {d.clock})"
        return d

    def sql(self, name: str, as_of: str | None = None, **params: object) -> str:
        return OPERATORS[name].sql(self.dialect(as_of), **params)

    def run(self, name: str, as_of: str | None = None, **params: object) -> DataFrame:
        more = {}
        if name in PREPARED:
            # a limit that the plan has by default limits what is prepared too
            takes = inspect.signature(PREPARED[name]).parameters
            more = PREPARED[name](self, self.dialect(as_of), **{k: v for k, v in self.parameters(name).items() if k in takes} | params)
        return self.query(lambda d: OPERATORS[name].sql(d, **params, **more), as_of)

    def query(self, plan: Callable[[Dialect], str], as_of: str | None = None) -> DataFrame:
        """The rows of a plan, over tables without their texts where it gives the same columns without them."""
        whole = self.spark.sql(doubles(plan(self.dialect(as_of))))
        if self.tables.lean:
            try:
                lean = self.spark.sql(doubles(plan(self.dialect(as_of, lean=True))))
            except AnalysisException:
                return whole
            if lean.schema == whole.schema:
                return lean
        return whole

    @staticmethod
    def parameters(name: str) -> dict[str, object]:
        """Names and defaults of an operator's parameters."""
        own = inspect.signature(OPERATORS[name].plan).parameters
        return {k: p.default for k, p in own.items() if p.default is not inspect.Parameter.empty}


def oracle(name: str) -> str:
    """The same operator, with its test parameters, as SQL of the checking engine over the raw driver tables."""
    op = OPERATORS[name]
    params = dict(op.test)
    when = params.pop("as_of", None)
    ctes, relations = duck_ctes()
    d = Duck(relations, "")
    d.now = d.stamp(str(when)) if when else "(select as_of from clock)"
    body = op.sql(d, **params).strip()
    if body.lower().startswith("with "):
        return f"with {ctes}, {body[5:]}"
    return f"with {ctes} {body}"
