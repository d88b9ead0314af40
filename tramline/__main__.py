"""python -m tramline validate FEED.zip [REPORT.json] | reconcile A.zip B.zip BOOK.xlsx | audit SOURCE.zip FINAL.zip | compare A.zip B.zip | build BASE.zip OTHER.zip OUT.zip FIRST LAST [RAIL.zip] [POLICY.json] [--draft]"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tramline.plans import analyses, ledger
from tramline.sources import sinks
from tramline.sources.feed import plain_path
from tramline.sources.policy import load_policy


def main(args: list[str]) -> int:
    """0 if nothing needs review, 1 if something does, 2 if the input can't be taken."""
    if len(args) < 2 or args[0] not in ("validate", "reconcile", "audit", "compare", "build"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("tramline").getOrCreate()
    what, paths = args[0], [plain_path(a) for a in args[1:]]
    try:
        if what == "validate":
            found = analyses.validate(spark, paths[0]).cache()
            if len(paths) > 1:
                sinks.report_json(found, paths[1])
            told = ledger.decision(found).collect()
            print(*told, sep="\n")
            return 2 if any(r.blockers for r in told) else 1 if any(r.errors + r.warnings for r in told) else 0
        if what == "build":
            more = [p for p in paths[5:] if p != "--draft"]
            rail = next((p for p in more if p.endswith(".zip")), None)
            policy = next((load_policy(p) for p in more if p.endswith(".json")), None)
            inputs = tuple(p for p in (paths[0], paths[1], rail) if p)
            feeds = [analyses.load(spark, p, f, True) for p, f in zip(inputs, ("base", "other", "rail"))]
            print(analyses.build(*feeds[:2], *paths[2:5], feeds[2] if rail else None, policy, allow_draft="--draft" in paths, inputs=inputs))
            return 0
        a, b = analyses.load(spark, paths[0], "a", what == "compare"), analyses.load(spark, paths[1], "b", what == "compare")
        if what == "reconcile":
            got = analyses.reconcile(a, b)
            sinks.write_xlsx({n: got[n] for n in ("routes", "pairs", "stops", "journeys", "crosswalk")}, paths[2])
            return 1 if not got["routes"].where("status != 'healthy'").isEmpty() else 0
        if what == "audit":
            got = analyses.audit_source(a, b).cache()
            got.groupBy("status").count().show()
            return 1 if not got.where("status in ('issues', 'missing')").isEmpty() else 0
        diffs = analyses.compare(a, b)
        rows = {n: d.count() for n, d in diffs.items()}
        print(rows)
        return 1 if any(rows.values()) else 0
    except (OSError, ValueError) as e:
        print(e)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
