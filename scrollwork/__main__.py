"""python -m scrollwork list | QUERY FOLDER [OUT]: list the queries, show one or write it as parquet."""

from __future__ import annotations

import sys

from scrollwork.plans import briefqueries, checkqueries, corpusqueries, intakequeries, ledgerqueries, measurequeries, problems, tablequeries, textqueries
from scrollwork.session import local_session

QUERIES = {k: q for m in (problems, textqueries, corpusqueries, ledgerqueries, checkqueries, tablequeries, briefqueries, intakequeries, measurequeries) for k, q in m.QUERIES.items()}


def main(args: list[str]) -> int:
    if args[:1] == ["list"]:
        print("\n".join(QUERIES))
        return 0
    if len(args) not in (2, 3) or args[0] not in QUERIES:
        print(__doc__, file=sys.stderr)
        return 2
    df = QUERIES[args[0]](local_session(), args[1])
    if len(args) == 3:
        df.write.mode("overwrite").parquet(args[2])
    else:
        df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
