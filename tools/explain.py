"""Print the executed physical plan shape of headline queries (after AQE).

usage: python tools/explain.py [sf_dir] [query ...]  > PLANS.md
Keeps only the operators that matter for scale: exchanges, joins, aggregates,
windows, scans (with pushed/partition filters).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEEP = re.compile(r"(Exchange|Join|Aggregate|Window|Scan|Generate|TakeOrdered|Sort |Union|WindowGroupLimit)")


def main():
    from restate.queries import all_queries
    from restate.queries.common import clear_cache
    from restate.session import local_session

    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    names = [a for a in args if not a.startswith("/")] or [
        "adj_scale_orders_batch", "adj_entity_roll", "jn_supersede_anti", "jn_block_running", "srt_preview_sample"]
    spark = local_session(8, 16)
    qs = all_queries()
    print(f"# Physical plans at {sf} (local[8], AQE final plans, scale-relevant operators only)\n")
    for n in names:
        clear_cache()
        df = qs[n].build(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = []
        for line in plan.splitlines():
            if KEEP.search(line):
                line = re.sub(r"#\d+L?", "", line)
                line = re.sub(r"\[plan_id=\d+\]", "", line)
                lines.append(line[:220])
        print(f"## {n}\n\n```")
        print("\n".join(lines[:80]))
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
