"""What the jobs share: the command line, config files, and settings that are put back."""

from __future__ import annotations

import argparse
import contextlib
import json
import logging
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


@contextlib.contextmanager
def settings(spark: SparkSession, **wanted: str) -> Iterator[None]:
    """Session settings for a while; dots in names are written as double underscores."""
    names = {k.replace("__", "."): v for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def main(run: Callable[[SparkSession, dict], object], name: str, defaults: dict, argv: list[str] | None = None) -> None:
    """Read the config file and what the command line changes of it, make a session, run, stop."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}")
    parser.add_argument("config", help="JSON file of the job's settings")
    parser.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="overrides a setting; VALUE is JSON or text")
    args = parser.parse_args(argv)
    with open(args.config, encoding="utf-8") as file:
        config = defaults | json.load(file)
    for item in args.set:
        key, _, value = item.partition("=")
        with contextlib.suppress(ValueError):
            value = json.loads(value)
        config[key] = value
    unknown = set(config) - set(defaults)
    if unknown:
        parser.error(f"unknown settings: {', '.join(sorted(unknown))}")
    missing = [k for k, v in config.items() if v is None]
    if missing:
        parser.error(f"settings without a value: {', '.join(missing)}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, config)
    finally:
        spark.stop()
