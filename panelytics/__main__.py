"""spark-submit or ``python -m panelytics``: answer every question about the CSV panels below a folder."""

from __future__ import annotations

import argparse

from panelytics.contract import COMPARED_ENTITIES, FOCUS_ENTITY
from panelytics.plans.workflow import run
from panelytics.session import build_session


def main() -> None:
    parser = argparse.ArgumentParser(prog="panelytics", description=__doc__)
    parser.add_argument("--input", required=True, help="folder searched for the two CSV panels")
    parser.add_argument("--output", required=True, help="folder for the typed panels and the reports")
    parser.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    parser.add_argument("--focus", default=FOCUS_ENTITY, help="entity of the single-entity reports")
    parser.add_argument("--compare", nargs="+", default=list(COMPARED_ENTITIES), help="entities compared over time")
    parser.add_argument("--only", nargs="+", default=[], help="names of the reports to write")
    parser.add_argument("--require-unique-keys", action="store_true", help="stop if a panel repeats a key")
    parser.add_argument("--cluster-by", nargs="+", default=[], help="sort the stored panels by these columns")
    parser.add_argument("--buckets", type=int, help="also save the panels as tables with so many buckets by their key")
    parser.add_argument("--refuse-unread-dates", action="store_true", help="stop if a date is in no known layout")
    parser.add_argument("--all-matches", action="store_true", help="make one panel of all files with the keyword")
    parser.add_argument("--shuffle-partitions", type=int, help="about the GB shuffled times 8; surplus is merged")
    parser.add_argument("--master", help="Spark master, where spark-submit has not set one")
    args = parser.parse_args()
    spark = build_session(master=args.master, shuffle_partitions=args.shuffle_partitions)
    names = run(
        spark,
        args.input,
        args.output,
        args.format,
        args.only,
        args.require_unique_keys,
        args.cluster_by,
        args.buckets,
        "refuse" if args.refuse_unread_dates else "report",
        args.all_matches,
        focus=args.focus,
        compared=args.compare,
    )
    for name in names:
        print(name)


if __name__ == "__main__":
    main()
