"""Operators written as one SQL text over a relation of bars, for Spark and for the DuckDB checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.plans.staged import DUCK, SPARK, Kit
from barloom.registry import query
from barloom.sources import bars

SOURCES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "brand": (bars.bars_brand, bars.BRAND_SQL),
    "supp": (bars.bars_supp, bars.SUPP_SQL),
    "hour": (bars.bars_hour, bars.HOUR_SQL),
}
P = "PARTITION BY symbol ORDER BY ts"


class SqlOp:
    """A function of a bar frame.  ``text(kit)`` gives SQL in which @bars stands for the bars."""

    def __init__(self, name: str, text: Callable[[Kit], str]):
        self.name, self.text = name, text

    def __call__(self, frame: DataFrame) -> DataFrame:
        return frame.sparkSession.sql(self.text(SPARK).replace("@bars", "{bars}"), bars=frame)

    def oracle(self, source: str) -> str:
        return self.text(DUCK).replace("@bars", f"({SOURCES[source][1]})")


def sql_op(name: str, source: str = "brand"):
    """Registers the operator as a query on a source."""

    def keep(text: Callable[[Kit], str]) -> SqlOp:
        op = SqlOp(name, text)
        query(name, op.oracle(source))(lambda spark, sf_dir: op(SOURCES[source][0](spark, sf_dir)))
        return op

    return keep


def panel_op(name: str, source: str, view: str):
    """Registers text(kit, **options), SQL in which @panel stands for the panel, as a query on a view of bars.

    The decorated name is a function (panel, **options) -> DataFrame for any panel; its defaults are the query's.
    """

    def keep(text: Callable[..., str]) -> Callable[..., DataFrame]:
        def run(panel: DataFrame, **options) -> DataFrame:
            return panel.sparkSession.sql(text(SPARK, **options).replace("@panel", "{panel}"), panel=panel)

        run.__doc__, run.__name__ = text.__doc__, text.__name__
        read, sql = SOURCES[source]
        oracle = f"WITH the_panel AS ({view.replace('@bars', f'({sql})')}) SELECT * FROM ({text(DUCK).replace('@panel', 'the_panel')})"

        def of_tables(spark, sf_dir):
            return run(spark.sql(view.replace("@bars", "{bars}"), bars=read(spark, sf_dir)))

        query(name, oracle)(of_tables)
        return run

    return keep


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0e0"


def safe_corr(x: str, y: str) -> str:
    """Pearson correlation of a group; null where a side is constant."""
    return f"(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0e0))"


def avg_rank(part: str, x: str) -> str:
    """Average rank of x in a partition, ties sharing it."""
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2e0)"
