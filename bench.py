"""Headline timings at one scale; prints ONE JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8).

Warm timings are the best of two runs; "cold" ones include code generation.
Every frame is written whole to the noop sink (a count would let the
optimizer drop what it does not need).  Measured: enrichment throughput
(events, long documents), then the headline queries on the stored table, plus
the rest of the registered queries.  The few large files of the test data are
spread over the cores first; a cluster's input has splits enough.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))

HEADLINE = (
    "search_page", "filtered_page", "page_info", "stats_bundle", "severity_counts",
    "age_buckets", "retention_info", "last_100_per_path", "latency_report",
    "latency_report_approx", "delivery_report", "trends", "hourly_error_series",
    "pattern_stats", "detection_accuracy", "delete_list_report", "retention_report",
    "document_search_total", "export_csv_rows",
)


def _sf_value(path: str):
    base = os.path.basename(path)
    try:
        return float(base.replace("sf", ""))
    except ValueError:
        return base


def main() -> None:
    from pyspark.sql import functions as F

    from logspark.operators.enrich import enrich
    from logspark.plans import catalog
    from logspark.session import local_session
    from logspark.sources.adapters import document_logs, raw_logs, read_table
    from logspark.sources.store import spread

    spark = local_session(cores=CPUS, app="logspark-bench", shuffle_partitions=CPUS)
    timings: dict[str, float] = {}
    rates: dict[str, float] = {}

    # warm-up: JVM, parquet reader, codegen caches
    read_table(spark, SF_DIR, "events").agg(F.count(F.lit(1))).collect()

    def timed(name, fn, repeat: int = 1):
        """Best of ``repeat`` runs (the VM is noisy)."""
        best, out = None, None
        for _ in range(repeat):
            t0 = time.perf_counter()
            out = fn()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        timings[name] = round(best, 3)
        return out

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    # enrichment throughput: write-time analysis; the first run includes the
    # one-off code generation / compilation of the rule cascade ("cold")
    ev = read_table(spark, SF_DIR, "events")
    n_events = ev.count()
    timed("enrich_events_cold", lambda: noop(enrich(raw_logs(spread(ev, CPUS)))))
    timed("enrich_events", lambda: noop(enrich(raw_logs(spread(ev, CPUS)))), repeat=2)
    rates["enrich_events_rows_per_s"] = round(n_events / max(timings["enrich_events"], 1e-9), 1)

    docs = read_table(spark, SF_DIR, "documents")
    n_docs = docs.count()
    timed("enrich_documents_cold", lambda: noop(enrich(document_logs(spread(docs, CPUS)))))
    timed("enrich_documents", lambda: noop(enrich(document_logs(spread(docs, CPUS)))), repeat=2)
    rates["enrich_documents_rows_per_s"] = round(n_docs / max(timings["enrich_documents"], 1e-9), 1)
    mb = docs.agg(F.sum(F.octet_length("text"))).first()[0] / 1e6
    rates["enrich_documents_mb_per_s"] = round(mb / max(timings["enrich_documents"], 1e-9), 2)

    # the stored tables the queries read (built once, like the write path)
    timed("store_logs", lambda: noop(catalog.logs(spark, SF_DIR)))
    timed("store_documents", lambda: noop(catalog.doc_logs(spark, SF_DIR)))

    qs = catalog.queries()
    for name in HEADLINE:
        timed(name, lambda n=name: noop(qs[n](spark, SF_DIR)), repeat=2)
    others = {}
    for name, build in qs.items():
        if name in HEADLINE or name in timings:
            continue
        t0 = time.perf_counter()
        noop(build(spark, SF_DIR))
        others[name] = round(time.perf_counter() - t0, 3)

    headline_total = round(sum(timings[n] for n in HEADLINE), 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": headline_total,
        "unit": "sec",
        "queries": timings,
        "other_queries": others,
        "rates": rates,
        "rows": {"events": n_events, "documents": n_docs},
        "cpus": CPUS,
        "sf": _sf_value(SF_DIR),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
