"""Command line: nearest neighbours (one column) or, with --info-path, overlap of repertoires (two columns)."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from seqsim.operators import neighbors, overlap, stats
from seqsim.sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqsim", description=__doc__)
    p.add_argument("-i", "--input-path", required=True)
    p.add_argument("-n", "--input-length", type=int)
    p.add_argument("-I", "--info-path")
    p.add_argument("-N", "--info-length", type=int)
    p.add_argument("-d", "--distance", type=int, default=1)
    p.add_argument("-m", "--measurement", choices=["leven", "hamming"], default="leven")
    p.add_argument("-o", "--output-path")
    p.add_argument("-a", "--airr", action="store_true", help="AIRR format: cdr3_aa and duplicate_count")
    p.add_argument("-t", "--text", action="store_true", help="text without a header")
    p.add_argument("-c", "--check-output", action="store_true", help="compare with the exhaustive search")
    p.add_argument("-V", "--verbose", action="store_true")
    p.add_argument("-v", "--version", action="version", version="1.0.0")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.distance < 1:
        parser().error("the distance must be 1 or more")
    if (args.info_path is None) != (args.info_length is None):
        parser().error("--info-path and --info-length go together")
    spark = SparkSession.builder.appName("seqsim").getOrCreate()
    measure = "hamming" if args.measurement == "hamming" else "levenshtein"
    if args.info_path:
        info = tables.read_info(spark, args.info_path, args.info_length, args.input_length)
        rows = (tables.read_airr if args.airr else tables.read_counts)(spark, args.input_path, expected_rows=args.input_length)
        held = overlap.repertoire_rows(rows.withColumnRenamed("seq_id", "row"), info)
        out = overlap.repertoire_overlap(held, args.distance, measure)
        write = tables.write_overlap
    else:
        read = tables.read_airr if args.airr else tables.read_text if args.text else tables.read_sequences
        rows = read(spark, args.input_path, expected_rows=args.input_length).select("seq_id", "seq")
        out = neighbors.neighbors_within(rows, args.distance, measure)
        write = tables.write_neighbors
        if args.check_output and stats.differences(out, neighbors.neighbors_within(rows, args.distance, measure, strategy="exhaustive")).limit(1).count():
            print("the results differ from the exhaustive search")
            return 1
    if args.verbose:
        out.explain("formatted")
    if args.output_path:
        write(out, args.output_path)
    else:
        print(tables.discard(out))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
