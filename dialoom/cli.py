"""Command line: run, benchmark, config, version."""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
from pathlib import Path

from dialoom.schemas import CHANNELS, SOURCE_FORMATS


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="dialoom")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run the pipeline over text files")
    run.add_argument("path")
    run.add_argument("--out", required=True)
    run.add_argument("--channel", choices=CHANNELS, default="voice")
    run.add_argument("--format", choices=SOURCE_FORMATS, default="labeled")
    run.add_argument("--rules", help="file of rules, one to a line")
    run.add_argument("--config")
    commands.add_parser("benchmark", help="time the headline queries")
    show = commands.add_parser("config", help="write or check a configuration")
    show.add_argument("path")
    show.add_argument("--check", action="store_true")
    commands.add_parser("version")
    args = parser.parse_args(argv)
    if args.command == "version":
        from dialoom.pipeline import VERSION

        print(VERSION)
        return 0
    if args.command == "benchmark":
        return subprocess.call([sys.executable, str(Path(__file__).resolve().parents[1] / "bench.py")])
    from dialoom import pipeline

    if args.command == "config":
        if args.check:
            print(pipeline.PipelineConfig.load(args.path).fingerprint)
        else:
            pipeline.PipelineConfig().save(args.path)
        return 0
    from dialoom.plans.rules import compile_rule
    from dialoom.sources import readers

    config = pipeline.PipelineConfig.load(args.config) if args.config else pipeline.PipelineConfig()
    rules = [compile_rule(line, f"rule_{i}") for i, line in enumerate(Path(args.rules).read_text().splitlines()) if line.strip()] if args.rules else []
    result = pipeline.run(readers.transcripts(pipeline.session(), args.path, args.channel, args.format), config, rules)
    print(json.dumps(result.manifest | {"path": pipeline.save_outputs(pipeline.session(), result, args.out, args.path)}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
