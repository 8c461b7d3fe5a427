"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import contextlib
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "null_profile", "duplicate_profile", "flag_duplicates", "column_samples", "iqr_outliers",
    "outlier_profile", "type_inconsistencies", "mixed_type_columns", "value_type_match",
    "declared_type_match", "primary_key", "constraint_range", "constraint_violations",
    "sanitize_name", "clean_query", "concept_web_url", "descriptor_findings", "compliance_level",
    "findings_report", "build_fields", "suggest_concepts", "concept_definition", "read_csv",
    "read_parquet", "pack_write", "pack_catalog", "stream_quality", "validate_all",
]
RUNS = 3
# Sizes of one CSV file that is read with a schema, without the time it takes to write it.
CSV_MB = (10, 100, 1000)


def timed(make, runs: int = RUNS) -> float:
    """Median of several runs after one that warms up."""
    seconds = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds[1:]), 4)


def csv_reads(spark, sf_dir: str) -> dict[str, float]:
    """Seconds to read CSV files of the sizes above, made of the rows of lineitem."""
    from packwright.sources import read_csv

    lines = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet")
    out = {}
    with tempfile.TemporaryDirectory() as folder:
        lines.coalesce(1).write.option("header", True).csv(f"{folder}/one")
        (one,) = [os.path.join(folder, "one", f) for f in os.listdir(f"{folder}/one") if f.endswith(".csv")]
        with open(one, "rb") as f:
            header, body = f.readline(), f.read()
        for mb in CSV_MB:
            path = f"{folder}/{mb}.csv"
            with open(path, "wb") as f:
                f.write(header)
                left = mb * 1_000_000
                while left > 0:
                    part = body if len(body) <= left else body[:body.rfind(b"\n", 0, left) + 1] or body
                    f.write(part)
                    left -= len(part) if part is body else left
            out[f"read_csv_{mb}mb"] = timed(lambda: read_csv(spark, path, lines.schema), 2)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    with contextlib.redirect_stdout(sys.stderr):
        from packwright.session import build_session
        from workload import QUERIES

        spark = build_session("bench", f"local[{cpus}]", int(cpus))
        spark.sparkContext.setLogLevel("ERROR")
        seconds = {}
        for name in names:
            seconds[name] = timed(lambda: QUERIES[name](spark, sf_dir))
            print(name, seconds[name], file=sys.stderr, flush=True)
        total = sum(seconds.values())
        if not sys.argv[1:]:
            seconds |= csv_reads(spark, sf_dir)
        spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(total, 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
