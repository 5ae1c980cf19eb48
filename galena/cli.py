"""The command line: python -m galena.cli COMMAND PATH ...

Exit codes: 0 done, 1 an error, 2 wrong usage, 3 check found errors.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from . import __version__
from .collection import Collection
from .errors import GalenaError
from .functions.metrics import INDEX_NAMES, METRIC_NAMES
from .plans.filters import Filter, typed
from .plans.options import CollectionConfig, HnswConfig, QueryOptions
from .sources.csvs import parse_literal, write_csv
from .sources.dataset import KINDS, DatasetSpec, generate
from .sources.vecs import read_vecs, write_vecs

LEVELS = {"trace": 5, "debug": 10, "info": 20, "warn": 30, "warning": 30, "error": 40, "off": 100}


def session() -> SparkSession:
    return SparkSession.builder.appName("galena").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def metadata(pairs: Sequence[str]) -> dict:
    """key=value pairs; values are typed by their shape, quoted ones are text."""
    out = {}
    for p in pairs:
        key, eq, value = p.partition("=")
        if not eq or not key:
            raise GalenaError(f"{p!r} is no key=value pair")
        out[key] = value[1:-1] if len(value) > 1 and value[0] == value[-1] == '"' else typed(value)
    return out


def parser() -> argparse.ArgumentParser:
    # these may stand before or behind the command, so neither place may have defaults of its own
    common = argparse.ArgumentParser(add_help=False, argument_default=argparse.SUPPRESS)
    for flag in ("--json", "--quiet", "--verbose"):
        common.add_argument(flag, action="store_true")
    common.add_argument("--log-level", choices=LEVELS)
    common.add_argument("--log-file")
    out = argparse.ArgumentParser(prog="galena", parents=[common], allow_abbrev=False)
    out.add_argument("--version", action="version", version=__version__)
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, help: str, path: bool = True) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=help, parents=[common], allow_abbrev=False)
        if path:
            c.add_argument("path")
        return c

    def options(c: argparse.ArgumentParser) -> None:
        c.add_argument("-k", type=int, default=10)
        c.add_argument("--ef-search", type=int, default=0)
        c.add_argument("--filter", default="")
        c.add_argument("--exact", action="store_true")
        c.add_argument("--oversample", type=int, default=0)
        c.add_argument("--no-metadata", action="store_true")

    c = command("create", "make an empty collection")
    c.add_argument("--dimension", type=int, required=True)
    c.add_argument("-m", "--metric", choices=METRIC_NAMES, default="l2")
    c.add_argument("--index", choices=INDEX_NAMES, default="brute_force")
    c.add_argument("--normalize", action="store_true")
    c.add_argument("--links", type=int, default=16, help="M of the graph")
    c.add_argument("--ef-construction", type=int, default=200)
    c.add_argument("--ef-search", type=int, default=64)
    c.add_argument("--seed", type=int, default=42)
    command("info", "configuration")
    command("stats", "counts and sizes")
    c = command("insert", "add one vector")
    c.add_argument("--vector", required=True)
    c.add_argument("--id", type=int)
    c.add_argument("--meta", action="append", default=[], metavar="KEY=VALUE")
    c = command("upsert", "add or replace one vector")
    c.add_argument("--vector", required=True)
    c.add_argument("--id", type=int, required=True)
    c.add_argument("--meta", action="append", default=[], metavar="KEY=VALUE")
    c = command("set-metadata", "replace the metadata of a vector")
    c.add_argument("--id", type=int, required=True)
    c.add_argument("--meta", action="append", default=[], metavar="KEY=VALUE")
    for name in ("get", "delete"):
        command(name, f"{name} one vector").add_argument("--id", type=int, required=True)
    c = command("search", "neighbours of one vector")
    c.add_argument("--vector", required=True)
    options(c)
    c = command("batch-search", "neighbours of all vectors of a .vecs file")
    c.add_argument("--queries", required=True)
    options(c)
    command("filter-ids", "ids whose metadata matches").add_argument("--filter", required=True)
    c = command("import", "insert a file")
    c.add_argument("--input", required=True)
    c.add_argument("--csv", action="store_true")
    c.add_argument("--csv-ids", action="store_true")
    c.add_argument("--start-id", type=int)
    c = command("export", "write live vectors by id")
    c.add_argument("--output", required=True)
    c.add_argument("--csv", action="store_true")
    c = command("generate", "write deterministic vectors", path=False)
    c.add_argument("--output", required=True)
    c.add_argument("--dimension", type=int, default=128)
    c.add_argument("--count", type=int, default=10_000)
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--sample-seed", type=int)
    c.add_argument("--kind", choices=KINDS, default="clustered")
    c.add_argument("--clusters", type=int, default=0)
    c.add_argument("--csv", action="store_true")
    command("rebuild-index", "build the graph anew")
    command("compact", "drop tombstones")
    command("vacuum", "delete tables of older snapshots").add_argument("--hours", type=float, default=24)
    command("check", "look for damage").add_argument("--deep", action="store_true")
    return out


def results(rows) -> list[dict]:
    from .functions.metadata import plain

    return [{k: plain(v) if k == "metadata" else v for k, v in r.asDict().items() if k != "slot"} for r in rows]


def run(a: argparse.Namespace) -> tuple[int, object]:
    spark = session()
    if a.command == "create":
        hnsw = HnswConfig(a.links, a.ef_construction, a.ef_search, a.seed)
        c = Collection.create(spark, a.path, CollectionConfig(a.dimension, METRIC_NAMES[a.metric], INDEX_NAMES[a.index], a.normalize, hnsw))
        return 0, {"created": a.path, **c.config.plain()}
    if a.command == "generate":
        spec = DatasetSpec(a.dimension, a.count, a.seed, a.seed if a.sample_seed is None else a.sample_seed, a.kind, a.clusters)
        rows = generate(spark, spec)
        if a.csv:
            write_csv(rows, a.output)
        else:
            write_vecs(rows, a.output, ids=False)
        return 0, {"generated": a.count, "output": a.output}
    c = Collection.open(spark, a.path)
    if a.command in ("search", "batch-search"):
        o = QueryOptions(a.k, a.ef_search, Filter.parse(a.filter), a.exact, a.oversample, not a.no_metadata)
        if a.command == "search":
            return 0, {"results": results(c.search(parse_literal(a.vector), o).orderBy("rank").collect())}
        q = read_vecs(spark, a.queries).selectExpr("ordinal AS qid", "embedding AS query")
        return 0, {"results": results(c.batch_search(q, o).orderBy("qid", "rank").collect())}
    if a.command in ("insert", "upsert"):
        batch = c.batch([(a.id, parse_literal(a.vector), metadata(a.meta))])
        return 0, {a.command: getattr(c, a.command)(batch), "id": a.id if a.id is not None else c._state["next_id"] - 1}
    if a.command == "set-metadata":
        c.set_metadata(a.id, metadata(a.meta))
        return 0, {"id": a.id}
    if a.command == "get":
        found = c.get(a.id)
        return (0, {"id": a.id, "vector": found[0], "metadata": found[1]}) if found else (1, {"error": f"id {a.id} does not exist"})
    if a.command == "delete":
        n = c.remove([a.id])
        return (0, {"deleted": a.id}) if n else (1, {"error": f"id {a.id} does not exist"})
    if a.command == "filter-ids":
        return 0, {"ids": [r["id"] for r in c.filter_ids(a.filter).collect()]}
    if a.command == "import":
        return 0, {"imported": c.import_file(a.input, a.csv, a.csv_ids, a.start_id)}
    if a.command == "export":
        return 0, {"exported": c.export_file(a.output, a.csv), "output": a.output}
    if a.command == "info":
        return 0, {"path": a.path, "size": c.size(), "describe": c.index.describe(), **c.config.plain()}
    if a.command == "stats":
        return 0, c.stats()
    if a.command == "rebuild-index":
        c.rebuild_index()
        return 0, {"rebuilt": a.path}
    if a.command == "compact":
        return 0, {"reclaimed": c.compact()}
    if a.command == "vacuum":
        return 0, {"deleted": c.vacuum(a.hours)}
    issues = c.check(a.deep)
    return (3 if any(s == "error" for s, _ in issues) else 0), {"issues": [{"severity": s, "message": m} for s, m in issues]}


def text(value: object, indent: str = "") -> str:
    if isinstance(value, dict):
        return "\n".join(f"{indent}{k}:\n{text(v, indent + '  ')}" if isinstance(v, dict | list) and v else f"{indent}{k}: {v}" for k, v in value.items())
    if isinstance(value, list):
        return "\n".join(f"{indent}{json.dumps(v, ensure_ascii=False, default=str)}" for v in value)
    return f"{indent}{value}"


def main(argv: Sequence[str] | None = None) -> int:
    try:
        given = vars(parser().parse_args(argv))
    except SystemExit as e:
        return int(e.code or 0)
    a = argparse.Namespace(**{"json": False, "quiet": False, "verbose": False, "log_level": "warn", "log_file": None, **given})
    logging.basicConfig(level=10 if a.verbose else LEVELS[a.log_level], filename=a.log_file)
    try:
        code, out = run(a)
    except (GalenaError, OSError) as e:
        code, out = 1, {"error": str(e)}
    if code == 1 and not a.json:
        print(f"error: {out['error']}", file=sys.stderr)
    elif a.json or not a.quiet:
        print(json.dumps(out, ensure_ascii=False, default=str) if a.json else text(out))
    return code


if __name__ == "__main__":
    sys.exit(main())
