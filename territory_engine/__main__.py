"""Job entry points for spark-submit: ``python -m territory_engine <job> ...``.

* ``poll``: the streaming poll job (claim batch files -> state, rankings, recents, dump).
* ``rank``: recompute rankings, recents and the dump from a state table once.
* ``assign``: label land cells with their nearest facility and write facility outlines.
* ``boundaries``: countries or regions with their area polygons, as GeoJSON lines.
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .functions.cells import Grid
from .session import get_spark


def _grid(text: str) -> Grid:
    parts = [float(x) for x in text.split(",")]
    width, height, size = int(parts[0]), int(parts[1]), parts[2]
    return Grid(width=width, height=height, size=size, lat_size=parts[3] if len(parts) > 3 else None)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="territory_engine")
    sub = ap.add_subparsers(dest="job", required=True)
    p = sub.add_parser("poll")
    p.add_argument("--input", required=True)
    p.add_argument("--state", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--interval", default="60 seconds")
    p.add_argument("--once", action="store_true", help="process what is there and stop")
    p.add_argument("--lines", action="store_true", help="input files hold one object per line")
    p.add_argument("--compact-every", type=int, default=10)
    p.add_argument("--keep-versions", type=int, help="full snapshots of the state that stay (default: all)")
    p.add_argument("--fail-fast", action="store_true", help="stop on unusable input instead of setting it aside")
    p.add_argument("--clean-source", choices=["archive", "delete"])
    p.add_argument("--archive-dir")
    r = sub.add_parser("rank")
    r.add_argument("--state", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--as-of-ms", type=int, help="default: now")
    a = sub.add_parser("assign")
    a.add_argument("--land", required=True, help="Parquet with a cell column")
    a.add_argument("--facilities", required=True, help="Parquet with cell and seed_id columns")
    a.add_argument("--grid", required=True, help="width,height,size[,lat_size]")
    a.add_argument("--out", required=True)
    b = sub.add_parser("boundaries")
    b.add_argument("--divisions", required=True, help="base folder with type=... partitions")
    b.add_argument("--subtype", choices=["country", "region"], required=True)
    b.add_argument("--out", required=True)
    args = ap.parse_args(argv)
    spark = get_spark()

    if args.job == "poll":
        from .streaming.ingest import run_stream
        q = run_stream(spark, args.input, args.state, args.out, args.checkpoint, interval=args.interval,
                       available_now=args.once, clean_source=args.clean_source, archive_dir=args.archive_dir,
                       lines=args.lines, compact_every=args.compact_every, fail_fast=args.fail_fast,
                       keep_versions=args.keep_versions)
        q.awaitTermination()
    elif args.job == "rank":
        from .functions.clock import now_ms
        from .operators.rankings import leaderboards, public_claims, recents
        from .sinks.publish import write_leaderboards, write_public_claims
        from .sources.state import read_state
        state = read_state(spark, args.state)
        as_of = args.as_of_ms if args.as_of_ms is not None else now_ms()
        write_leaderboards(leaderboards(state, as_of), f"{args.out}/leaderboards")
        recents(state, as_of).write.mode("overwrite").json(f"{args.out}/recents")
        write_public_claims(public_claims(state), f"{args.out}/claims", F.floor(F.unix_millis(F.current_timestamp()) / 1000))
    elif args.job == "assign":
        from .operators.geo import outline_parts
        from .plans.jobs import assign_cells
        from .sinks.publish import geojson_features, write_text
        grid = _grid(args.grid)
        assigned, outlines, offenders = assign_cells(spark.read.parquet(args.land), spark.read.parquet(args.facilities), grid)
        assigned.write.mode("overwrite").parquet(f"{args.out}/cells")
        offenders.write.mode("overwrite").parquet(f"{args.out}/gate_offenders")
        polys = outline_parts(outlines).withColumnRenamed("key", "seed_id")
        write_text(geojson_features(polys, "parts", ["seed_id"]), "feature", f"{args.out}/outlines")
    elif args.job == "boundaries":
        from .plans.jobs import boundaries
        from .sinks.publish import geojson_features, write_text
        from .sources.geojson import read_divisions
        out = boundaries(read_divisions(spark, args.divisions), args.subtype)
        props = [c for c in out.columns if c not in ("geometry", "parts")]
        write_text(geojson_features(out, "parts", props), "feature", args.out)


if __name__ == "__main__":
    main()
