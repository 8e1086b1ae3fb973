"""Command line: compress, restore and verify read sets.

    python -m strandloom.cli [options] -i READS [PAIR] ARCHIVE
    python -m strandloom.cli -d [-i READS [PAIR]] ARCHIVE
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from strandloom.params import EngineParams
from strandloom.plans.archive import compress, decompress, verify
from strandloom.sources.readers import read
from strandloom.sources.sinks import write_ordered, write_pe, write_se

VERSION = "0.1"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandloom", description="Compress, restore and verify sets of short reads.")
    add = p.add_argument
    add("archive")
    add("-i", nargs="+", metavar="FILE", help="reads, and their mates; with -d the files to verify against")
    add("-o", action="store_true", help="keep the order of reads")
    add("-d", action="store_true", help="restore")
    add("-q", type=int, default=120, metavar="N", help="error limit in per mille; 1000 turns the division off")
    add("-Q", action="store_true", help="mean probability instead of the suffix rule")
    add("-g", type=int, default=65, metavar="N", help="overlap threshold in per cent; 0 turns it off")
    add("-s", type=int, default=38, metavar="N", help="seed length")
    add("-M", type=int, default=3, metavar="N", help="least characters per mismatch")
    add("-p", type=int, default=45, metavar="N", help="least reverse-complement repeat")
    add("-S", action="store_true", help="single reads: drop the pairing")
    add("-I", action="store_true", help="ignore the order inside a pair")
    add("-r", action="store_true", help="do not reverse-complement mate 2")
    add("-N", action="store_true", help="no separate set for reads with N")
    add("-v", action="version", version=VERSION)
    return p


def params_of(a: argparse.Namespace) -> EngineParams:
    paired = bool(a.i and len(a.i) > 1) and not a.S
    if a.S and (a.o or a.I):
        raise SystemExit("-S excludes -o and -I")
    mode = ("pe_ord" if a.o else "min_pe" if a.I else "pe") if paired else ("se_ord" if a.o else "se")
    return EngineParams(err=a.q / 1000, suffix_mode=not a.Q, separate_n=not a.N, ov=a.g / 100, seed=a.s, min_chars_per_mismatch=a.M, min_repeat=a.p, mode=mode, rc_mate2=paired and not a.r)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    if not a.d:
        if not a.i:
            raise SystemExit("reads are needed: -i FILE [PAIR]")
        params = params_of(a)
        print(json.dumps(compress(read(spark, *a.i[:2]), a.archive, params)))
        return
    mode = json.loads(spark.read.text(f"{a.archive}/manifest").first()[0])["params"]["mode"]
    decoded = decompress(spark, a.archive)
    if a.i:
        print(json.dumps(verify(decoded, read(spark, *a.i[:2]), mode).first().asDict()))
    elif mode in ("se", "se_ord"):
        (write_se(decoded, f"{a.archive}_out", ["read_id"]) if mode == "se" else write_ordered(decoded, f"{a.archive}_out"))
    else:
        write_pe(decoded, f"{a.archive}_out_1", f"{a.archive}_out_2", ["pair_id"])


if __name__ == "__main__":
    main()
