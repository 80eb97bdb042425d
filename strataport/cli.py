"""Command line: python -m strataport.cli <command> config.yml --source DIR --root DIR [--key table=col,col] [--log DIR]"""

from __future__ import annotations

import argparse
import signal
import sys

from pyspark.sql import functions as F

from .errors import MigrationError
from .operators.catalogs import read_catalog
from .operators.commands import Migration
from .operators.reconcile import preflight_summary
from .plans.spec import load_config
from .sources import demo
from .sources.store import Files


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="strataport")
    p.add_argument("command", choices=["analyze", "diff", "preflight", "migrate", "status", "verify", "cutover", "readiness", "demo", "cleanup"])
    p.add_argument("config")
    p.add_argument("--source", required=True, help="folder of Parquet tables")
    p.add_argument("--root", required=True, help="folder of the target store")
    p.add_argument("--key", action="append", default=[], metavar="TABLE=COLUMNS")
    p.add_argument("--log", help="folder of the source's change log: Parquet files of (seq, message)")
    p.add_argument("--catalog", help="folder of the source's catalog (see operators/catalogs.py)")
    p.add_argument("--target-catalog", help="the same of the target, for readiness")
    p.add_argument("--table")
    p.add_argument("--follow", action="store_true", help="go on applying the log after the copy")
    p.add_argument("--listings", type=int, default=10_000, help="rows of demo data")
    p.add_argument("--resume", action="store_true")
    p.add_argument("--force", action="store_true")
    p.add_argument("--sample-size", type=int)
    p.add_argument("--drop-target", metavar="ROOT", default="")
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("strataport").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        with open(a.config) as f:
            config = load_config(f.read())
        keys = {k: v.split(",") for k, v in (x.split("=", 1) for x in a.key)}
        names = {t.name for t in (config.migrate.tables if config.migrate else ())} | set(config.analyze_tables) | ({a.table} if a.table else set())
        paths = {n: f"{a.source.rstrip('/')}/{n}.parquet" for n in names}
        if a.command == "demo":
            for name, make in (("users", demo.users), ("agents", demo.agents), ("listings", demo.listings)):
                make(spark, a.listings).write.mode("overwrite").parquet(f"{a.source.rstrip('/')}/{name}.parquet")
                print(f"{name}: {spark.read.parquet(f'{a.source.rstrip(chr(47))}/{name}.parquet').count()} rows")
            return 0
        files = Files(spark)
        catalog = read_catalog(spark, a.catalog) if a.catalog else None
        m = Migration(spark, config, {n: spark.read.parquet(p) for n, p in paths.items() if files.exists(p)}, keys, a.root, log=a.log, catalog=catalog)
        if a.command == "analyze":
            m.analyze(a.table).show(truncate=False)
        elif a.command == "diff":
            for t in [a.table] if a.table else [t.name for t in m.tables]:
                m.diff(t).orderBy("ord").show(100, truncate=False)
        elif a.command == "preflight":
            items = m.preflight(a.force, a.resume)
            items.orderBy("ord").show(200, truncate=False)
            return 0 if preflight_summary(items).first().passed else 1
        elif a.command == "migrate":
            halt: list[int] = []
            for sign in (signal.SIGINT, signal.SIGTERM):
                signal.signal(sign, lambda n, _: halt.append(n))
            print(m.migrate(a.resume, a.force, lambda: bool(halt), lambda b: print(f"page {b['batch_no']}: {b['rows']} rows"), a.follow))
        elif a.command == "status":
            phase, stats = m.status()
            print(phase)
            stats.show(truncate=False)
            if a.log:
                m.read_lag().orderBy(F.desc("taken_at")).limit(1).show(truncate=False)
        elif a.command == "verify":
            counts, found = m.verify(a.sample_size)
            counts.show(truncate=False)
            if found is not None:
                found.show(100, truncate=False)
            return int(counts.where("not equal").limit(1).count() > 0 or (found is not None and found.limit(1).count() > 0))
        elif a.command == "readiness":
            m.readiness(read_catalog(spark, a.target_catalog or f"{a.root.rstrip('/')}/catalog")).orderBy("table_name", "category", "name").show(1000, truncate=False)
        elif a.command == "cutover":
            m.cutover().show(truncate=False)
        else:
            m.cleanup(bool(a.drop_target), a.drop_target)
        return 0
    except MigrationError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
