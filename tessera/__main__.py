"""The command line. python -m tessera --list; python -m tessera QUERY --tables FOLDER [--out FOLDER] [--show N]."""

from __future__ import annotations

import argparse
import logging
import time
from collections.abc import Sequence

from tessera.plans.catalogue import QUERIES
from tessera.session import local_session, ship

log = logging.getLogger("tessera")


def arguments(given: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tessera", description="Runs a query of the catalogue over a folder of tables.")
    parser.add_argument("query", nargs="?", help="its name; see --list")
    parser.add_argument("--list", action="store_true", help="the names of all queries")
    parser.add_argument("--tables", help="the folder of the tables, which Spark reads")
    parser.add_argument("--out", help="a folder to write the rows to; without it some are shown")
    parser.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
    parser.add_argument("--show", type=int, default=20, help="rows to show")
    parser.add_argument("--cores", default="*", help="of a local session, where spark-submit gives none")
    parser.add_argument("-v", "--verbose", action="store_true")
    found = parser.parse_args(given)
    if not found.list and not (found.query in QUERIES and found.tables):
        parser.error("name a query of --list, and --tables")
    return found


def main(given: Sequence[str] | None = None) -> None:
    asked = arguments(given)
    logging.basicConfig(level=logging.INFO if asked.verbose else logging.WARNING, format="%(asctime)s %(name)s %(message)s")
    if asked.list:
        print("\n".join(sorted(QUERIES)))
        return
    spark, began = ship(local_session(asked.cores)), time.time()
    rows = QUERIES[asked.query](spark, asked.tables)
    if asked.out:
        rows.write.mode("error").format(asked.format).save(asked.out)
    else:
        rows.show(asked.show, truncate=80)
    log.info("%s: %.1f s", asked.query, time.time() - began)


if __name__ == "__main__":
    main()
