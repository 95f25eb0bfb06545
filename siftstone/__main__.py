"""Command lines: python -m siftstone ingest | rebuild | retry | reconcile | status | audit | evaluate | compare | check-config | models."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession

from siftstone.operators import bookkeeping, dense
from siftstone.plans import config, evaluate, ingest, models, query
from siftstone.sources import tables
from siftstone.streaming import jobs as streaming


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="siftstone", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("ingest", "rebuild", "retry", "reconcile", "status", "audit", "evaluate"):
        job = jobs.add_parser(name)
        job.add_argument("--root", required=True, help="folder of the engine's tables")
        job.add_argument("--config", required=True, help="configuration file")
    jobs.choices["ingest"].add_argument("--source", required=True, help="folder of JSON documents")
    jobs.choices["evaluate"].add_argument("--golden", required=True)
    jobs.choices["evaluate"].add_argument("--report", required=True, help="folder for the report")
    jobs.choices["audit"].add_argument("--limit", type=int, default=20)
    jobs.choices["audit"].add_argument("--doc-id", help="audit this document, whether it has a review or not")
    jobs.choices["audit"].add_argument("--model", help="package.module:function that maps prompts to replies")
    jobs.choices["audit"].add_argument("--dry-run", action="store_true", help="say what would be audited")
    for name in ("check-config", "models"):
        jobs.add_parser(name).add_argument("--config", required=True, help="configuration file")
    compare = jobs.add_parser("compare")
    compare.add_argument("--baseline", required=True)
    compare.add_argument("--current", required=True)
    compare.add_argument("--threshold", type=float, default=0.02)
    return parser


def main(argv: list[str] | None = None) -> int:
    """0, or 1 where a comparison finds regressions or a configuration can't be used."""
    args = _parser().parse_args(argv)
    if args.job == "check-config":
        try:
            found = config.load_config(args.config)
        except (OSError, ValueError) as e:
            print(e)
            return 1
        print(json.dumps({"version": found.version, "models": [m["id"] for m in found.embeddings], "retrievers": [r.id for r in found.retrievers]}))
        return 0
    spark = SparkSession.builder.appName("siftstone").getOrCreate()
    if args.job == "compare":
        reports = (evaluate.long_metrics(tables.read_report(spark, path)) for path in (args.baseline, args.current))
        found = evaluate.regressions(*reports, args.threshold).orderBy("metric", "k").collect()
        print("\n".join(r.message for r in found) or "no regressions")
        return int(bool(found))
    settings = config.load_config(args.config)
    if args.job == "models":
        print("\n".join(json.dumps(r.asDict()) for r in models.models(spark, settings).orderBy("ord").collect()))
        return 0
    providers = {m["vector_name"]: (dense.hashing_provider(m["dimension"]), m["dimension"], str(m.get("version", "1"))) for m in settings.embeddings}
    engine = ingest.Engine(spark, args.root, providers, settings.budget, settings.version)
    if args.job == "ingest":
        result = engine.add(tables.read_json_originals(spark, args.source)).agg({"indexed": "sum", "failed": "sum"}).first()
        print(json.dumps({"indexed": result[0], "failed": result[1]}))
    elif args.job == "status":
        print(json.dumps({r.name: r.rows for r in engine.status().collect()}))
    elif args.job == "audit":
        due = engine.due_reviews(args.limit) if args.doc_id is None else spark.createDataFrame([(args.doc_id,)], "doc_id string")
        chunks = engine.table("lexical").join(due, "doc_id", "left_semi")
        if args.dry_run:
            groups = bookkeeping.audit_groups(chunks).groupBy("doc_id").count().orderBy("doc_id").collect()
            print(json.dumps({"documents": {r[0]: r[1] for r in groups}}))
            return 0
        if not args.model:
            print("an audit needs --model")
            return 1
        module, _, name = args.model.partition(":")
        engine.add_reviews(streaming.audit(chunks, getattr(importlib.import_module(module), name)))
        print(json.dumps({"audited": chunks.select("doc_id").distinct().count()}))
    elif args.job == "evaluate":
        embed = {r.id: providers[r.vector_name][:2] for r in settings.retrievers if r.type == "dense"}
        options = {"ladder": settings.ladder, "weights": settings.weights(), "fusion_k": settings.fusion_k, "rerank_enabled": settings.rerank_enabled, "min_score": settings.min_score}
        _, report = evaluate.run_golden(tables.read_golden(spark, args.golden), engine.corpus(), list(settings.retrievers), query.Models(embed=embed), **options)
        tables.write_report(report, args.report)
        print(json.dumps(report.first().asDict()))
    else:
        print(json.dumps(getattr(engine, args.job)()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
