"""Command line: components, schema, checks, and runs of configured streams.

python -m rivulet components list [--kind KIND]
python -m rivulet components show KIND NAME [--format text|json]
python -m rivulet schema
python -m rivulet --config FILE [--validate] [--checkpoint FOLDER] [--master URL]
"""

from __future__ import annotations

import argparse
import json
import sys

from rivulet.errors import ConfigError
from rivulet.streaming import config as configurations


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="rivulet")
    out.add_argument("--config", "-c", metavar="FILE")
    out.add_argument("--validate", "-v", action="store_true", help="check the configuration, start nothing")
    out.add_argument("--checkpoint", metavar="FOLDER", help="run the streams continuously from here; without it bounded inputs are read once")
    out.add_argument("--master", default="local[*]")
    commands = out.add_subparsers(dest="command")
    commands.add_parser("schema", help="JSON Schema of a configuration")
    parts = commands.add_parser("components").add_subparsers(dest="what", required=True)
    parts.add_parser("list").add_argument("--kind", "-k", choices=sorted(configurations.COMPONENTS))
    show = parts.add_parser("show")
    show.add_argument("kind", choices=sorted(configurations.COMPONENTS))
    show.add_argument("name")
    show.add_argument("--format", "-f", choices=("text", "json"), default="text")
    return out


def described(kind: str, name: str) -> str:
    own = configurations.schema_of(kind, name)
    lines = [f"{kind} {name}: {own['description']}"]
    for key, value in own["properties"].items():
        if key != "type":
            types = value.get("type", "")
            lines.append(f"  {key} ({types if isinstance(types, str) else ' or '.join(types)}{', needed' if key in own['required'] else ''})")
    return "\n".join(lines)


def run(config: dict, args: argparse.Namespace) -> None:
    from rivulet.session import session
    from rivulet.streaming import runtime

    spark, streams = session(args.master), runtime.streams(config)
    if not args.checkpoint:
        for one in streams:
            one.run(spark)
        return
    queries = [one.start(spark, f"{args.checkpoint.rstrip('/')}/{one.id}") for one in streams]
    for query in queries:
        query.awaitTermination()


def main(words: list[str] | None = None) -> int:
    args = parser().parse_args(words)
    try:
        if args.command == "schema":
            print(json.dumps(configurations.schema(), indent=2))
        elif args.command == "components" and args.what == "list":
            for kind in [args.kind] if args.kind else configurations.COMPONENTS:
                print(f"{kind}: {', '.join(sorted(configurations.COMPONENTS[kind]))}")
        elif args.command == "components":
            print(json.dumps(configurations.schema_of(args.kind, args.name), indent=2) if args.format == "json" else described(args.kind, args.name))
        elif not args.config:
            raise ConfigError("give --config FILE, or one of components and schema")
        else:
            config = configurations.load(args.config)
            issues = configurations.validate(config)
            for issue in issues:
                print(f"{issue.path}: {issue.message}", file=sys.stderr)
            if issues:
                return 1
            if args.validate:
                print("the configuration is valid")
            else:
                run(config, args)
    except (ConfigError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
