"""Command line (API8, API10, SNK14): dump a tree's texts, report on a diagnostic log, answer calls over standard input.

    python -m lumenspan.cli dump <input> <output> [--only ext,ext] [--max-size N[KB|MB|GB]] [--include-failed] [--overwrite]
    python -m lumenspan.cli report --input LOG --output REPORT [--since TIME]
    python -m lumenspan.cli mcp --files TABLE --chunks TABLE

Exit codes of dump: 0 done, 1 wrong call, 2 output can't be made, 3 output isn't empty, 130
interrupted; of report: 0 done, 1 no input, 2 no events.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import words
from .operators import logs as L
from .sources import scan, store, tree


def session() -> SparkSession:
    return SparkSession.builder.appName("lumenspan").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _option(args: list[str], name: str) -> str | None:
    at = args.index(name) if name in args else -1
    return args[at + 1] if 0 <= at < len(args) - 1 else None


def dump(spark: SparkSession, args: list[str]) -> int:
    """SNK14: a .txt file for each file that could be read, below the same path, and _summary.json. Texts are written where they are read; the driver gets counts and one line a file."""
    if len(args) < 2:
        print(__doc__, file=sys.stderr)
        return 1
    source, out = args[0].rstrip("/"), args[1].rstrip("/")
    if not store.exists(spark, source) or source == out:
        print(f"no input folder {source}, or the output is the same", file=sys.stderr)
        return 1
    if store.names(spark, out) and "--overwrite" not in args:
        print(f"{out} isn't empty; use --overwrite", file=sys.stderr)
        return 3
    try:
        fs, where = store.filesystem(spark, out)
        if not fs.mkdirs(where):
            return 2
    except Exception as e:
        print(f"{out} can't be made: {e}", file=sys.stderr)
        return 2
    began = time.monotonic()
    only, most = _option(args, "--only"), _option(args, "--max-size")
    files = scan.scan(spark, source, content=True).where(F.col("extension").isin(words.CONTENT_EXTENSIONS))
    if only:
        files = files.where(F.col("extension").isin([e.lower() if e.startswith(".") else f".{e.lower()}" for e in only.split(",") if e]))
    if most:
        files = files.where(F.col("size_bytes") <= scan.parse_size(most))
    root, failed = tree.local(source) or source, "--include-failed" in args
    target = tree.local(out) or out

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            results, lengths = [], []
            for path, ok, text, code, detail in zip(*[batch.column(i).to_pylist() for i in range(1, 6)], strict=True):
                place = target + path.removeprefix(root) + (".txt" if ok else ".error.txt")
                if ok or failed:
                    tree.put(place, (text or "" if ok else f"ErrorCode: {code}\nDetail: {detail or ''}\n").encode("utf-8", "replace"))
                results.append("error" if not ok else "success" if text else "success_empty")
                lengths.append(len(text) if ok and text else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(results, pa.string()), pa.array(lengths, pa.int64()), batch.column(4), batch.column(6)], names=["extension", "path", "result", "text_length", "error_code", "size_bytes"])

    read = scan.with_text(files).select("extension", "path", "success", "text", "error_code", "error_detail", "size_bytes")
    done = read.mapInArrow(write, "extension string, path string, result string, text_length long, error_code string, size_bytes long").persist()
    by = {c: {r[0]: r[1] for r in done.groupBy(c).count().orderBy(c).collect()} for c in ("extension", "result")}
    each = [{"path": r["path"].removeprefix(root).lstrip("/"), "ext": r["extension"], "size_bytes": r["size_bytes"], "result": r["result"], "text_length": r["text_length"], "error_code": r["error_code"]} for r in done.orderBy("path").toLocalIterator()]
    done.unpersist()
    summary = {"generated_at": datetime.now(UTC).isoformat(), "input_dir": source, "output_dir": out, "total_ms": int((time.monotonic() - began) * 1000), "total_files": len(each), "by_ext": by["extension"], "by_result": by["result"], "files": each}
    tree.put(f"{target}/_summary.json", json.dumps(summary, indent=2, ensure_ascii=False).encode())
    print(f"{len(each)} files: {by['result']}")
    return 0


def report(spark: SparkSession, args: list[str]) -> int:
    """API10: tables of a diagnostic log as Markdown."""
    parser = argparse.ArgumentParser(prog="report")
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--since")
    asked = parser.parse_args(args)
    if not store.exists(spark, asked.input):
        print(f"no input {asked.input}", file=sys.stderr)
        return 1
    events = L.parse_log(scan.read_log(spark, asked.input), asked.since)
    rows, stages = L.extracts(events), L.details(events)
    if rows.isEmpty():
        print("no events", file=sys.stderr)
        return 2
    text = L.markdown({"By extension": L.by_extension(rows), "Results": L.results(rows), "Failures": L.failures(rows), "By size": L.by_size(rows), "Stages": L.by_stage(stages), "Slowest files": L.slowest(rows), "Throughput": L.throughput(rows), "Bottlenecks": L.bottlenecks(rows, stages)})
    os.makedirs(os.path.dirname(os.path.abspath(asked.output)), exist_ok=True)
    with open(asked.output, "w", encoding="utf-8") as f:
        f.write(text)
    return 0


def answer(engine, call: dict) -> dict:
    """One call of a tool by name, as JSON-RPC: {id, method: tools/list or tools/call, params: {name, arguments}}."""
    tools = {"search_files": lambda query="", topK=20, extensions=None: engine.search_files(query, topK, extensions), "get_file_content": lambda fileId="": engine.get_file_content(fileId), "list_indexed_files": lambda folder=None, extension=None, limit=50: engine.list_indexed_files(folder, extension, limit), "get_pipeline_status": lambda: engine.get_pipeline_status()}  # noqa: N803
    out = {"jsonrpc": "2.0", "id": call.get("id")}
    if call.get("method") == "tools/list":
        return out | {"result": {"tools": [{"name": n} for n in tools]}}
    asked = call.get("params") or {}
    if call.get("method") != "tools/call" or asked.get("name") not in tools:
        return out | {"error": {"code": -32601, "message": f"no such method or tool: {call.get('method')} {asked.get('name')}"}}
    try:
        return out | {"result": tools[asked["name"]](**(asked.get("arguments") or {}))}
    except TypeError as e:
        return out | {"error": {"code": -32602, "message": str(e)}}


def serve(spark: SparkSession, args: list[str], lines=None, write=print) -> int:
    """The tools over standard input and output, a JSON call a line."""
    from .plans.api import Engine

    files, chunks = (spark.read.parquet(_option(args, f"--{name}")) for name in ("files", "chunks"))
    engine = Engine(files, chunks, F.current_timestamp().cast("timestamp_ntz"))
    for line in lines if lines is not None else sys.stdin:
        if line.strip():
            try:
                call = json.loads(line)
            except json.JSONDecodeError as e:
                write(json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}))
                continue
            write(json.dumps(answer(engine, call), ensure_ascii=False, default=str))
    return 0


def main(args: list[str]) -> int:
    verbs = {"dump": dump, "report": report, "mcp": serve}
    if not args or args[0].lower() not in verbs:
        print(__doc__, file=sys.stderr)
        return 1
    try:
        return verbs[args[0].lower()](session(), args[1:])
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
