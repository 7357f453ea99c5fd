"""Command line: clean one export, or all four, into workbooks or Parquet."""

from __future__ import annotations

import argparse
import json
import logging
import os
import re
import sys

from pyspark.sql import SparkSession

from tracewell.plans.export import clean_to_parquet, clean_to_workbook
from tracewell.sources.specs import SPECS

VERSION = "0.2"
# The default file of each kind.
FILES = {"shares": "Shares.csv", "comments": "Comments.csv", "messages": "messages.csv", "connections": "Connections.csv"}


log = logging.getLogger("tracewell")


class JsonLines(logging.Formatter):
    """A record as one line of JSON."""

    def format(self, record: logging.LogRecord) -> str:
        line = {"timestamp": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        return json.dumps({**line, "exception": self.formatException(record.exc_info)} if record.exc_info else line)


def _limit(text: str) -> int:
    if not re.fullmatch(r"\d+", text.strip(), re.ASCII):
        raise argparse.ArgumentTypeError("a whole number of 0 or more; 0 disables the limit")
    return int(text)


def _from_env(name: str) -> int | None:
    """The limit an environment variable sets; what is no limit sets none."""
    try:
        return _limit(os.environ[name])
    except (KeyError, argparse.ArgumentTypeError):
        return None


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tracewell")
    parser.add_argument("kind", nargs="?", choices=[*SPECS, "all"])
    parser.add_argument("--version", action="version", version=f"%(prog)s {VERSION}")
    parser.add_argument("--log-level", default=os.environ.get("LOG_LEVEL", "INFO"), choices=["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"])
    parser.add_argument("--log-format", default=os.environ.get("LOG_FORMAT", "text"), choices=["text", "json"])
    parser.add_argument("--input-dir", default=".")
    parser.add_argument("--output-dir", default=".")
    parser.add_argument("--input", help="the file of a single kind")
    parser.add_argument("--output", help="where a single kind is written")
    for kind in SPECS:
        parser.add_argument(f"--{kind}-input")
        parser.add_argument(f"--{kind}-output")
    parser.add_argument("--encoding")
    parser.add_argument("--time-zone", help="the zone times are turned to, the session's by default")
    parser.add_argument("--max-input-bytes", type=_limit, default=_from_env("TRACEWELL_MAX_INPUT_BYTES"), help="0 disables")
    parser.add_argument("--max-rows", type=_limit, default=_from_env("TRACEWELL_MAX_ROWS"), help="0 disables")
    parser.add_argument("--skip-missing", action="store_true")
    parser.add_argument("--format", choices=["xlsx", "parquet"], default="xlsx", help="a workbook, written by the driver, or a folder of Parquet, written by the executors")
    return parser


def main(argv: list[str] | None = None) -> int:
    """0 where all went well, 1 where a file failed or lacks, 130 where the user stopped it."""
    parser = _parser()
    args = parser.parse_args(argv)
    handler = logging.StreamHandler()
    handler.setFormatter(JsonLines() if args.log_format == "json" else logging.Formatter("%(levelname)s %(name)s: %(message)s"))
    log.handlers, log.propagate = [handler], False
    log.setLevel(args.log_level)
    if args.kind is None:
        parser.print_help()
        return 0
    try:
        return _run(args)
    except KeyboardInterrupt:
        log.error("stopped by the user")
        return 130
    except Exception:
        log.exception("unexpected error")
        return 1


def _run(args: argparse.Namespace) -> int:
    write = clean_to_parquet if args.format == "parquet" else clean_to_workbook
    limits = {k: v for k, v in (("encoding", args.encoding), ("max_bytes", args.max_input_bytes), ("max_rows", args.max_rows), ("zone", args.time_zone)) if v is not None}
    spark = SparkSession.builder.appName("tracewell").getOrCreate()
    failed = False
    for kind in SPECS if args.kind == "all" else [args.kind]:
        one = args.kind != "all"
        source = getattr(args, f"{kind}_input") or (one and args.input) or os.path.join(args.input_dir, FILES[kind])
        target = getattr(args, f"{kind}_output") or (one and args.output) or os.path.join(args.output_dir, f"{kind}.{args.format}")
        if not os.path.exists(source):
            skip = args.skip_missing and not one
            log.log(logging.WARNING if skip else logging.ERROR, "%s: no file %s", kind, source)
            failed |= not skip
            continue
        result = write(spark, source, target, kind, **limits)
        if result.success:
            print(f"{kind}: {result.rows} rows to {result.path}")
        else:
            log.error("%s: %s", kind, result.error)
        failed |= not result.success
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
