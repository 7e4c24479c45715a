"""python -m filtra info CLOUD | diagram DIAGRAM | compute CLOUD --max-dim N --radius R --out FILE"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from filtra.operators import diagram, distance, persistence
from filtra.sources import formats


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="filtra", description="Persistence diagrams of point clouds")
    commands = parser.add_subparsers(dest="command", required=True)
    info = commands.add_parser("info", help="points, repeats, bad coordinates and range of each cloud")
    pairs = commands.add_parser("diagram", help="statistics of each diagram and dimension")
    compute = commands.add_parser("compute", help="Vietoris-Rips diagrams")
    for command in (info, pairs, compute):
        command.add_argument("path")
        command.add_argument("--format", help="instead of the file's extension")
    compute.add_argument("--max-dim", type=int, default=1)
    compute.add_argument("--radius", type=float)
    compute.add_argument("--out", help="a csv, json or parquet path; else the pairs are shown")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    table = formats.auto_load(spark, args.path, args.format)
    if args.command == "info":
        distance.data_quality(table).show(truncate=False)
    elif args.command == "diagram":
        diagram.statistics(table).show(truncate=False)
    else:
        found = persistence.persistence(table, args.max_dim, args.radius)
        if args.out:
            formats.auto_save(found, args.out)
        else:
            found.orderBy("diagram_id", "dim", "birth", "death").show(truncate=False)


if __name__ == "__main__":
    main()
