"""Print the formatted physical plan of registered queries (default: bench headline set).

usage: python tools/explain_plans.py [sf_dir] [query ...]
Look for: PushedFilters / ReadSchema at the scans, one Exchange per key change,
ReusedExchange after execution, no SinglePartition exchanges on large inputs.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from bench import HEADLINE
    from driftkit.plans import registry
    from driftkit.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or HEADLINE
    spark = build_session()
    qs = registry.queries()
    for name in names:
        print(f"===== {name} =====", flush=True)
        qs[name](spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main()
