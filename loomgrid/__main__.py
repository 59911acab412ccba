"""Command line: backgrounds and histories from mapping files, or one registered query.

    python -m loomgrid backgrounds --mappings DIR --templates FILE --out DIR [--dimensions A,B]
    python -m loomgrid histories --backgrounds DIR --out DIR [--names FILE] [--partial]
    python -m loomgrid query NAME DATA_DIR
"""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _answer(df):
    """The mock model: other models are given to ``loomgrid.api`` as a function."""
    from .functions.text import mock_reply

    return df.withColumn("r", mock_reply(F.col("prompt"))).select("*", F.col("r.content").alias("content"), F.lit("success").alias("status")).drop("r")


def backgrounds(spark, args) -> int:
    from . import api
    from .operators.personas import select_dimensions
    from .sources import readers
    from .sources.writers import Store

    templates = readers.templates(spark, args.templates)
    named = {r.dim: f"{args.mappings}/{r.dim.lower()}.csv" for r in templates.collect()}  # a row a dimension
    found = [readers.mapping(spark, path, dim) for dim, path in named.items() if readers.find_paths(spark, path)]
    if not found:
        print("no mapping file matches a template", file=sys.stderr)
        return 1
    mapping = select_dimensions(reduce(lambda a, b: a.unionByName(b), found), args.dimensions.split(",") if args.dimensions else None)
    progress = api.generate_backgrounds(mapping, templates, _answer, Store(spark, args.out, ["combination_id"])).collect()
    for r in progress:
        print(f"{r.dimension}: {r.total} combinations, {r.pending} pending")
    return int(any(r.pending for r in progress))


def histories(spark, args) -> int:
    from .operators import personas
    from .sources import readers
    from .sources.writers import Store

    made = Store(spark, args.backgrounds, ["combination_id"]).read()
    if made is None:
        print("no backgrounds", file=sys.stderr)
        return 1
    dims = sorted(r.dimension for r in made.select("dimension").distinct().collect())  # a row a dimension
    names = readers.names(spark, args.names) if args.names else None
    store = Store(spark, args.out, ["history_id"])
    done = store.read()
    new = personas.histories(made, dims, names, args.partial, done=done)
    store.replace(new if done is None else done.unionByName(new))
    print(f"{store.read().count()} histories")
    return 0


def query(spark, args) -> int:
    from .plans import catalog

    catalog.queries()[args.name](spark, args.data).show(args.rows, truncate=80)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomgrid", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(required=True)
    one = commands.add_parser("backgrounds")
    for name in ("mappings", "templates", "out"):
        one.add_argument(f"--{name}", required=True)
    one.add_argument("--dimensions")
    one.set_defaults(run=backgrounds)
    two = commands.add_parser("histories")
    for name in ("backgrounds", "out"):
        two.add_argument(f"--{name}", required=True)
    two.add_argument("--names")
    two.add_argument("--partial", action="store_true")
    two.set_defaults(run=histories)
    three = commands.add_parser("query")
    three.add_argument("name")
    three.add_argument("data")
    three.add_argument("--rows", type=int, default=20)
    three.set_defaults(run=query)
    args = parser.parse_args(argv)
    return args.run(SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
