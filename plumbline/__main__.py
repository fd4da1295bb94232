"""Command line over a store: import a file, run an analysis, inject an attack, export a run."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.config import Config, overridden
from plumbline.operators import attacks as A
from plumbline.operators import evaluate as E
from plumbline.sources import reviews as R
from plumbline.store import Store


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    parser.add_argument("--store", required=True, help="folder of the tables")
    todo = parser.add_subparsers(dest="todo", required=True)
    one = todo.add_parser("import", help="reviews from a CSV file with a header")
    for name in ("path", "dataset", "text", "rating"):
        one.add_argument(f"--{name}", required=True)
    for name in ("timestamp", "author", "key"):
        one.add_argument(f"--{name}")
    one.add_argument("--salt", default="")
    one = todo.add_parser("run", help="analyse a dataset; settings as policy.downweight_below=0.6")
    one.add_argument("dataset")
    one.add_argument("--set", nargs="*", default=[], metavar="NAME=VALUE")
    one = todo.add_parser("inject", help="a dataset with synthetic attacks, beside the clean one")
    one.add_argument("dataset")
    one.add_argument("attacked")
    one.add_argument("--seed", type=int, default=7)
    one = todo.add_parser("pull", help="how far an attack moves the rating, and what of it is removed")
    one.add_argument("clean")
    one.add_argument("attacked")
    one = todo.add_parser("export", help="a run as static files")
    one.add_argument("run")
    one.add_argument("path")
    todo.add_parser("list", help="datasets and runs")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[dict]:
    """Does what the arguments say; prints and returns its rows."""
    a = _arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("plumbline").getOrCreate()
    store = Store(spark, a.store)
    if a.todo == "import":
        rows, scale = R.mapped(R.read_csv(spark, a.path), R.Mapping(a.text, a.rating, a.timestamp, a.author, a.key), a.salt)
        store.add_dataset(rows if "created_at" in rows.columns else rows.withColumn("created_at", F.lit(None).cast("timestamp_ntz")), a.dataset, a.dataset, "upload", scale)
        out = store.dataset(a.dataset)
    elif a.todo == "run":
        changes = {k: json.loads(v) for k, v in (x.split("=", 1) for x in a.set)}
        run = store.run(a.dataset, overridden(Config(), changes))
        out = store.summary(run).withColumn("run", F.lit(run))
    elif a.todo == "inject":
        clean = store.reviews(a.dataset).drop("id", "dataset_id")
        store.add_dataset(A.attacked(clean, A.injected_rows(spark, a.seed)), a.attacked, f"{a.dataset} attacked", "injected")
        out = store.dataset(a.attacked)
    elif a.todo == "pull":
        out = E.pull_removed(*[store.summary(r).select("raw", "adjusted") for r in (a.clean, a.attacked)])
    elif a.todo == "export":
        store.export(a.run, a.path)
        out = store.summary(a.run)
    else:
        out = store.datasets().select("id", F.lit("dataset").alias("kind"), "status").unionByName(store.runs().select("id", F.lit("run").alias("kind"), "status"))
    rows = [r.asDict() for r in out.collect()]
    for r in rows:
        print(json.dumps(r, default=str))
    return rows


if __name__ == "__main__":
    main()
