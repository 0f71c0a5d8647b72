"""Command line: python -m larkspur.cli match|organize."""

from __future__ import annotations

import argparse
import sys

from larkspur import console
from larkspur.config import OrganizeConfig, PlaylistConfig
from larkspur.operators.layout import DEFAULT, LAYOUTS, help_text

VERSION = "1.0.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="larkspur")
    p.add_argument("--version", action="version", version=f"larkspur version {VERSION}")
    sub = p.add_subparsers(dest="program", required=True)
    a = sub.add_parser("match", help="match a playlist table with a library and write an M3U file")
    a.add_argument("-c", "--csv", default="", help="playlist CSV")
    a.add_argument("-s", "--source", default=".", help="folder of audio files")
    a.add_argument("-o", "--output", default="playlist.m3u", help="playlist to write")
    a.add_argument("-p", "--target-prefix", default="", dest="prefix", help="prefix of the paths in the playlist")
    a.add_argument("--debug", action="store_true", help="report misses and their nearest tracks")
    b = sub.add_parser("organize", help="move audio files into a folder layout", epilog=help_text(), formatter_class=argparse.RawDescriptionHelpFormatter)
    b.add_argument("-s", "--source", default=".", help="folder to scan")
    b.add_argument("-t", "--target", default=".", help="folder to fill")
    b.add_argument("-l", "--layout", default=DEFAULT, choices=list(LAYOUTS), dest="layout_name")
    b.add_argument("--no-track-numbers", action="store_false", dest="track_numbers")
    b.add_argument("--no-consolidate", action="store_false", dest="consolidate")
    for x in (a, b):
        x.add_argument("-r", "--recursive", action="store_true")
        x.add_argument("-n", "--dry-run", action="store_true")
        x.add_argument("-v", "--verbose", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    program = args.pop("program")
    if program == "match" and not args["csv"]:
        print("Error: --csv is required", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from larkspur.plans.programs import match_playlist, organize

    spark = SparkSession.builder.appName("larkspur").getOrCreate()
    if program == "match":
        out = match_playlist(spark, PlaylistConfig(**args))
    else:
        out = organize(spark, OrganizeConfig(**args))
    report = out.pop("report", [])
    console.summary("Summary" + (" (dry run)" if args["dry_run"] else ""), out)
    print("\n".join(report), end="\n" if report else "")
    return 0


if __name__ == "__main__":
    sys.exit(main())
