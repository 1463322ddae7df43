"""Runs a script file over stored datasets:  python -m regionframe.cli script --data DIR --out DIR"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from regionframe.lang.script import Script
from regionframe.sources.readers import read
from regionframe.sources.repository import Repository
from regionframe.sources.writers import write_parquet, write_text


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("script")
    p.add_argument("--data", required=True, help="folder of stored datasets; a name with a / is a folder of region files")
    p.add_argument("--out", required=True)
    p.add_argument("--format", choices=("parquet", "tab", "gtf"), default="parquet")
    p.add_argument("--bin", type=int, default=10_000)
    p.add_argument("--max-distance", type=int, default=100_000)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    stored = Repository(spark, a.data)

    def load(name: str, parser: str | None):
        return read(spark, name, parser) if "/" in name else stored.load(name)

    with open(a.script, encoding="utf-8") as f:
        results = Script(loader=load, bin_size=a.bin, max_distance=a.max_distance).run(f.read())
    for name, ds in results.items():
        path = name if "/" in name else f"{a.out.rstrip('/')}/{name}"
        if a.format == "parquet":
            write_parquet(ds, path)
        else:
            write_text(ds, path, a.format, name=name.rpartition("/")[2])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
