"""Command line: explore a space of puzzles and write its clusters, or list presets.

    python -m boardflow --space rh --blocks 4 --moves 10 --output clusters
    python -m boardflow --presets default.puzzle
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from boardflow.operators import statespace
from boardflow.sources import presets

SPACES = {"rh": statespace.RUSH_HOUR, "klotski": statespace.KLOTSKI}
log = logging.getLogger("boardflow")


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="boardflow", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--presets", default="default.puzzle", help="file or folder of presets")
    parser.add_argument("--output", default="clusters", help="folder for the clusters of a space")
    parser.add_argument("--space", help="rh or klotski; anything else lists the presets")
    parser.add_argument("--blocks", type=lambda v: min(15, max(1, int(v))), default=5, help="most blocks, 1 to 15, the target among them")
    parser.add_argument("--moves", type=lambda v: max(0, int(v)), default=10, help="least moves that a cluster's hardest state needs")
    return parser.parse_args(argv)


def puzzle_space(spark: SparkSession, name: str, blocks: int, moves: int, output: str) -> int:
    """Explore a space, write its clusters as presets, and log what was found; the number of clusters written."""
    rules = SPACES[name]
    log.info("at most %d sets of blocks", statespace.upper_bound(len(rules.shapes), blocks))
    states = statespace.space_states(rules, blocks, spark)
    found = statespace.staged(statespace.clusters(states), "clusters")
    for counted, n in statespace.counters(found, moves).first().asDict().items():
        log.info("%s: %d", counted, n)
    kept = found.where(F.col("winnable") & (F.col("max_moves") >= moves))
    return presets.export(statespace.exported(kept, states), output)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    spark = spark or SparkSession.builder.getOrCreate()
    if args.space in SPACES:
        n = puzzle_space(spark, args.space, args.blocks, args.moves, args.output)
        log.info("wrote %d clusters to %s", n, args.output)
        return n
    found = presets.read(spark, args.presets).orderBy("idx")
    for row in found.select("idx", "name", "text").toLocalIterator():
        print(f"{row['idx']}: {row['name']}\n{row['text']}")
    return found.count()


if __name__ == "__main__":
    main()
