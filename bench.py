"""Wall time per query: one warm-up, then the median of BENCH_RUNS runs. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from hearthline.catalog import load_all  # noqa: E402
from hearthline.session import build_session  # noqa: E402

# roll-ups, joins, picks, ordered work, tables, tests, models and sequences of every part
HEADLINE = """
label_decode recode_positional unit_fix property_value wave_coalesce quantile_bin_lowest person_attr_join hh_full_join
child_two_key_join preferred_match interval_overlap best_overlap_spell slot_lookup_join unpivot_blocks pivot_counts hh_sum strict_mean group_median
distribution_table sibling_rank group_size nearest_before sample_one spell_lead cross_tab_row cross_tab_p summary_table
strata_summary sequential_logit mimic om_kmeans choose_k cluster_stability study_life_course anova_f spearman missing_glimpse missing_pattern mcar boxplot histogram ols_simple logit tobit
spells_to_yearly transition_rates om_distance impute_pmm study_parents_children ownership_by_parental_wealth study_couples
""".split()


def run(spark, folder: str, fn) -> float:
    start = time.perf_counter()
    fn(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    out = sys.stdout
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    queries, _ = load_all()
    times = {}
    for name in names:
        run(spark, folder, queries[name])
        times[name] = round(statistics.median(run(spark, folder, queries[name]) for _ in range(runs)), 4)
    spark.stop()
    line = {"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
            "sf": Path(folder).name.removeprefix("sf")}
    print(json.dumps(line), file=out, flush=True)


if __name__ == "__main__":
    main()
