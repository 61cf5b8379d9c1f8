"""Wall time of the headline queries; prints one JSON line.

Each query runs once to warm up, then BENCH_RUNS times (3); the median counts, and value is the sum of medians.
"""

import atexit
import json
import os
import shutil
import statistics
import tempfile
import time

from pyspark.sql import functions as F

from barloom import catalog
from barloom.operators import backtest, evaluate, features, intraday, language_a, portfolio, quality, reducers
from barloom.plans import formula_b
from barloom.plans.staged import SPARK, Plan
from barloom.queries.panel import operands
from barloom.session import session
from barloom.sources import bars

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def all_operators(b):
    """All 62 operators in one plan."""
    p = Plan(SPARK)
    x = operands(p)
    out = {n: language_a.apply(p, n, *x[: o.arity]) for n, o in language_a.OPERATORS.items()}
    return p.spark(bars.numbered(b), out)


def rolling_mean(b):
    p = Plan(SPARK)
    return p.spark(bars.numbered(b), {"value": reducers.evaluate(p, formula_b.decode([11, 0, 2, 10, 0, 0, 0, 0, 0, 5]), post=False)})


def main() -> None:
    spark = session("bench", f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "20g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = {"brand": bars.bars_brand, "supp": bars.bars_supp, "hour": bars.bars_hour}
    for name, make in made.items():  # the bars are made once, and timed by themselves
        make(spark, SF_DIR).write.parquet(f"{folder}/{name}")
    brand, supp, hour = (spark.read.parquet(f"{folder}/{name}") for name in made)
    todo = {f"bars_{name}": (lambda f=make: f(spark, SF_DIR)) for name, make in made.items()}
    todo |= {
        "flagship_rankic": lambda: evaluate.flagship_of(brand),
        "all_operators_supp": lambda: all_operators(supp),
        "feature_table_brand": lambda: features.table(brand),
        "hf_all": lambda: intraday.daily(hour),
        "pvm_Mean": lambda: rolling_mean(brand),
        "dq_jumps": lambda: quality.classify_jumps(supp.withColumn("seq", F.lit(0.0))),
        "pf_performance": lambda: portfolio.performance(supp),
        "pf_neutralize_industry": lambda: portfolio.neutralize_industry(supp),
        "bt_full": lambda: backtest.backtest(spark.sql(backtest.FACTOR_VIEW.replace("@bars", "{bars}"), bars=supp)),
        "eval_deciles": lambda: evaluate.deciles(brand),
        "join_asof": lambda: portfolio.asof(supp),
    }
    # from the tables on, bars included
    todo |= {n: (lambda q=catalog.QUERIES[n]: q(spark, SF_DIR)) for n in ("num_neutralize", "ml_ridge")}
    took = {}
    for name, run in todo.items():
        times = []
        for _ in range(RUNS + 1):
            t = time.time()
            run().write.format("noop").mode("overwrite").save()
            times.append(time.time() - t)
        took[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "sum of median wall times", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS), "runs": RUNS}))


if __name__ == "__main__":
    main()
