"""python -m lodestone ROOT [--data FOLDER] [--watch]: indexes a source tree and answers JSON-RPC lines from standard input."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession

from . import rpc
from .engine import opened
from .sources.tables import IndexStore, ensure_ignored
from .streaming import incremental


def main(given: list[str] | None = None, lines: Iterable[str] = sys.stdin) -> int:
    arguments = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    arguments.add_argument("root")
    arguments.add_argument("--data", help="folder of the index (default: .lodestone below the root)")
    arguments.add_argument("--watch", action="store_true", help="keep the index up to date while answering")
    a = arguments.parse_args(given)
    root = os.path.abspath(a.root)
    data = a.data or os.path.join(root, ".lodestone")
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    if a.data is None:
        ensure_ignored(root, ".lodestone/")
    store = IndexStore(data)
    engine = opened(spark, root, store)
    stream = incremental.watch_tree(spark, root, store, os.path.join(data, "checkpoint")) if a.watch else None
    for answer in rpc.serve(lines, engine):
        print(answer, flush=True)
    if stream:
        stream.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
