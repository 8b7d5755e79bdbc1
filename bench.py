"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default ``/root/testdata/sf0.1``), ``BENCH_CPUS`` the
cores (default 8), ``BENCH_RUNS`` the timed runs per query after one warm-up (default 1;
the best counts).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from crivo.functions.text import normalize_name  # noqa: E402
from crivo.plans import catalog, screening_queries  # noqa: E402
from crivo.plans import enrolments as en  # noqa: E402
from crivo.session import local_session  # noqa: E402
from crivo.shared import work_path  # noqa: E402
from crivo.sources import files, sinks  # noqa: E402

HEADLINES = [
    "cramers_v_rank", "chi2_class_sum", "chi2_full", "contingency_test", "top_residuals",
    "chi2_total_test", "label_fit", "label_encode", "one_hot_scores", "minmax_scale",
    "strip_accents", "drop_null_rows", "consolidate", "aligned_union", "read_differing_files",
    "fedavg_importance", "incremental_importance", "one_hot_fedavg", "compare_metrics",
    "stream_class_sums", "screen_by_class_sums", "screen_by_association", "screen_one_hot",
    "screen_by_model", "screen_late_encoding", "prepare_from_files",
]


def best_time(run, runs: int) -> float:
    """Shortest of several runs after one warm-up."""
    run()
    times = []
    for _ in range(runs):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return round(min(times), 3)


def write_raw(spark, sf_dir: str) -> tuple[str, float]:
    """All 55 raw columns as delimited files by year, and their size in MB.

    Columns that the screening drops hold codes of the usual length; categories have up to a
    hundred values, so that one-hot columns stay a few hundred.
    """
    folder = work_path(spark, "bench-raw")
    raw = screening_queries.raw_enrolments(spark, sf_dir).withColumn("Nome de Curso", F.concat(F.lit("Curso "), F.pmod(F.hash("Nome de Curso"), F.lit(100))))
    known = {normalize_name(c) for c in raw.columns}
    code = F.md5(F.col("Código da Matrícula"))
    fill = {c: F.substring(code, 1 + i % 20, 11) for i, c in enumerate(dict.fromkeys([*en.UNUSED, *en.NOMINAL])) if c not in known}
    category = {c: F.concat(F.lit(f"{c} "), F.pmod(F.hash(v), F.lit(12))) for c, v in fill.items() if c in en.NOMINAL}
    full = raw.withColumns(fill | category)
    full.hint("rebalance", "source_file").write.partitionBy("source_file").csv(folder, sep=";", header=True)
    # Names and sizes of the files, whatever store they are in.
    size = spark.read.format("binaryFile").load(f"{folder}/*/*.csv").agg(F.sum("length")).first()[0]
    return f"{folder}/*/*.csv", size / 1e6


def preprocess(spark, paths: str) -> None:
    """Delimited files to one-hot parts by source, and those to one consolidated table."""
    prepared = en.prepare(files.read_files(spark, paths), en.ONE_HOT, wide=True)
    parts = work_path(spark, "bench-parts")
    sinks.write_delimited_partitions(prepared.table, parts)
    again = files.read_encoded(spark, f"{parts}/*/*.csv", en.TARGET)
    sinks.write_consolidated(again, work_path(spark, "bench-whole")).collect()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.shuffle.partitions", cores)
    times = {}
    for name in HEADLINES:
        query = catalog.QUERIES[name]
        times[name] = best_time(lambda: query(spark, sf_dir).write.format("noop").mode("overwrite").save(), runs)
    folder, megabytes = write_raw(spark, sf_dir)
    times["preprocess_csv"] = best_time(lambda: preprocess(spark, folder), runs)
    print(json.dumps({
        "metric": "headline queries, total seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cores": cores,
        "csv_megabytes": round(megabytes, 1),
        "csv_megabytes_per_sec": round(megabytes / times["preprocess_csv"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
