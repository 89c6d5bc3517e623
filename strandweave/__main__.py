"""Command line: `python -m strandweave align REFERENCE READS... -o FOLDER`, `version`."""

from __future__ import annotations

import argparse

from strandweave import mapper


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strandweave")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version", help="print the version")
    align = commands.add_parser("align", help="map reads (FASTA, FASTQ, BAM) to a FASTA reference and write PAF lines")
    align.add_argument("reference")
    align.add_argument("reads", nargs="+")
    align.add_argument("-o", "--output", required=True, help="folder of part files, in order of the reads")
    align.add_argument("-x", "--preset", default="lr")
    for short, name in (("-k", "k"), ("-s", "s"), ("-r", "band"), ("-g", "gap"), ("--max-vote-occ", "occ_cap")):
        align.add_argument(short, dest=name, type=int)
    align.add_argument("-m", dest="min_score", type=int, default=40)
    args = parser.parse_args(argv)
    if args.command == "version":
        print("strandweave 0.1.0")
        return 0
    try:
        config = mapper.Config(args.preset, args.k, args.s, 1, args.occ_cap, args.band, args.gap, args.min_score).resolved()
    except ValueError as e:
        parser.error(str(e))

    from pyspark.sql import SparkSession

    from strandweave.sources import fastx, sinks

    spark = SparkSession.builder.appName("strandweave").getOrCreate()
    own = mapper.identified(fastx.reads(spark, args.reads).orderBy("file", "ordinal"))
    lines = mapper.Mapper(fastx.fasta(spark, args.reference), config).paf(own)
    sinks.write_lines(lines, args.output, ["id", "rank"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
