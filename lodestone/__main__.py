"""python -m lodestone QUERY FOLDER [--out PATH]: run a registered query over a folder of Parquet tables."""

import argparse

from pyspark.sql import SparkSession

from .plans import registry


def main() -> None:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    parser.add_argument("query", choices=sorted(registry.QUERIES))
    parser.add_argument("folder")
    parser.add_argument("--out", help="write Parquet there instead of showing rows")
    args = parser.parse_args()
    spark = SparkSession.builder.appName(f"lodestone {args.query}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    rows = registry.QUERIES[args.query](spark, args.folder)
    if args.out:
        rows.write.mode("overwrite").parquet(args.out)
    else:
        rows.show(50, truncate=80)


if __name__ == "__main__":
    main()
