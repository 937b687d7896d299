"""python -m karst generate NAME | migrate | status | shadow | diff | push | pull | query SQL"""

from __future__ import annotations

import argparse
import sys

from . import config as settings
from .plans import ddl


def main(args: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="karst")
    parser.add_argument("--config")
    commands = parser.add_subparsers(dest="command", required=True)
    generate = commands.add_parser("generate", help="write the migration from the last snapshot to the schema")
    generate.add_argument("name")
    generate.add_argument("--allow-loss", action="store_true")
    for name in ("migrate", "status", "shadow", "diff", "pull"):
        commands.add_parser(name)
    push = commands.add_parser("push", help="bring the catalog to the schema without a migration")
    push.add_argument("--allow-loss", action="store_true")
    commands.add_parser("query").add_argument("sql")
    given = parser.parse_args(args)
    config = settings.load(given.config)
    spark = spark or settings.session(config)
    migrations = ddl.Migrations(spark, config.migrations)
    if given.command == "generate":
        print(migrations.generate(given.name, migrations.latest(), settings.model(config), given.allow_loss) or "nothing to do")
    elif given.command == "migrate":
        print("\n".join(migrations.up()) or "nothing to do")
    elif given.command == "status":
        for tag, state in migrations.status():
            print(state, tag)
    elif given.command == "shadow":
        errors = migrations.shadow()
        print("\n".join(errors) or "all statements run")
        return int(bool(errors))
    elif given.command == "diff":
        for c in ddl.diff(migrations.latest(), settings.model(config)):
            print("!" if c.loses else " ", c.kind, c.name, c.detail)
    elif given.command == "push":
        steps = ddl.diff(ddl.introspect(spark), settings.model(config))
        if ddl.losses(steps) and not given.allow_loss:
            print("would lose data: " + ", ".join(ddl.losses(steps)), file=sys.stderr)
            return 1
        for c in steps:
            if c.sql:
                spark.sql(c.sql)
                print(c.kind, c.name)
    elif given.command == "pull":
        print(ddl.snapshot(ddl.introspect(spark)))
    else:
        spark.sql(given.sql).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
