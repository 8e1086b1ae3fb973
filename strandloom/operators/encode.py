"""Columns of the stored form: offsets, mismatch gaps, pair order and positions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequence import reverse_offsets
from strandloom.operators.ranking import global_rank, previous_value, running_sum


def offset_delta(placed: DataFrame, part: list[str] | None = None) -> DataFrame:
    """rl_idx, read_id, off: reads by position, with the distance to the read before (the first counts from 0)."""
    ranked = global_rank(placed, "pos", ["read_id"], "rl_idx", part)
    before = previous_value(ranked, "rl_idx", "pos", "_before", part)
    return before.select(*(part or []), "rl_idx", "read_id", (F.col("pos") - F.coalesce("_before", F.lit(0))).cast("long").alias("off"))


def positions(offsets: DataFrame, part: list[str] | None = None) -> DataFrame:
    """The inverse: positions as running sums of offsets in list order."""
    return running_sum(offsets, "rl_idx", F.col("off"), "pos", part)


def mismatch_cumulative(listed: DataFrame) -> DataFrame:
    """rl_idx, mis_cnt and the mismatches up to each entry."""
    return running_sum(listed.select("rl_idx", "mis_cnt"), "rl_idx", F.col("mis_cnt"), "mis_cum")


def reverse_gaps(rows: DataFrame, length: int) -> DataFrame:
    """read_id, gaps from mismatches (read_id, off), last to first."""
    offs = rows.groupBy("read_id").agg(F.array_sort(F.collect_list("off")).alias("offs"))
    return offs.select("read_id", F.array_join(reverse_offsets(F.col("offs"), F.lit(length)), ",").alias("gaps"))


def zero_split(listed: DataFrame) -> DataFrame:
    """rl_idx, zero flag, and the count where it is not zero."""
    return listed.select("rl_idx", (F.col("mis_cnt") == 0).alias("zero"), F.when(F.col("mis_cnt") != 0, F.col("mis_cnt")).alias("nonzero"))


def mismatch_groups(listed: DataFrame) -> DataFrame:
    """mis_cnt, n, start: entries of each mismatch count, and where their offsets begin when streams of equal counts follow
    one another; a row per count, at most the read's length of them.
    """
    counts = listed.where("mis_cnt > 0").groupBy("mis_cnt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("mis_cnt").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum(F.col("n") * F.col("mis_cnt")).over(before), F.lit(0)).cast("long"))


def pair_offsets(listed: DataFrame) -> DataFrame:
    """pair_id, base_rl, offset, base_mate: distance in list order between mates, from the earlier one."""
    first = F.min(F.struct("rl_idx", "mate"))
    return listed.groupBy("pair_id").agg(first.alias("f"), F.max("rl_idx").alias("last")).select("pair_id", F.col("f.rl_idx").alias("base_rl"), (F.col("last") - F.col("f.rl_idx")).alias("offset"), F.col("f.mate").alias("base_mate"))


def pair_positions(placed: DataFrame) -> DataFrame:
    """pair_id, base_rank, distance and sign of mates' positions, pairs ranked by the first mate's position."""
    both = placed.groupBy("pair_id").agg(F.max(F.when(F.col("mate") == 0, F.col("pos"))).alias("pos"), F.max(F.when(F.col("mate") == 1, F.col("pos"))).alias("other"))
    ranked = global_rank(both.where("pos IS NOT NULL AND other IS NOT NULL"), "pos", ["pair_id"], "base_rank")
    return ranked.select("pair_id", "base_rank", F.abs(F.col("other") - F.col("pos")).alias("distance"), (F.col("other") < F.col("pos")).alias("backward"))


def sticky_delta(pairs: DataFrame, order: str, value: str, small: int, near: int, segment: int = 1 << 16) -> DataFrame:
    """Adds enc ('small', 'delta', 'full') and val: values up to ``small`` as they are, others as the difference to a
    reference if that is within ``near``, else in full. The reference is the last value coded in full or as a
    difference; it starts at zero in each segment of ``segment`` values of the order, so that segments code alone.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", enc string, val long"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        enc, val, ref = [], [], 0
        for v in group[value].tolist():
            if v <= small:
                enc.append("small")
                val.append(v)
                continue
            d = v - ref
            enc.append("delta" if -near <= d < near else "full")
            val.append(d if -near <= d < near else v)
            ref = v
        return group.assign(enc=enc, val=val)

    return pairs.groupBy(F.floor(F.col(order) / segment)).applyInPandas(run, schema)


def restore_sticky(coded: DataFrame, order: str, name: str, segment: int = 1 << 16) -> DataFrame:
    """The inverse of sticky_delta."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema) + f", `{name}` long"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        out, ref = [], 0
        for enc, val in zip(group["enc"].tolist(), group["val"].tolist(), strict=True):
            v = val if enc != "delta" else ref + val
            out.append(v)
            ref = ref if enc == "small" else v
        return group.assign(**{name: out})

    return coded.groupBy(F.floor(F.col(order) / segment)).applyInPandas(run, schema)


def trim_matches(matches: DataFrame, least: int) -> DataFrame:
    """Matches of one class left to right without overlap on the destination: heads are cut by what is taken, and what
    becomes shorter than ``least`` goes. Order decides, so a class is one ordered group; it holds matches, not bases.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group, end, rows = group.sort_values(["dest_pos", "src_pos", "length"]), 0, []
        for r in group.to_dict("records"):
            cut = max(0, end - r["dest_pos"])
            if r["length"] - cut >= least:
                r.update(dest_pos=r["dest_pos"] + cut, length=r["length"] - cut)
                end = r["dest_pos"] + r["length"]
                rows.append(r)
        return pd.DataFrame(rows, columns=group.columns)

    return matches.groupBy("dest_class").applyInPandas(run, matches.schema)


def compressed_size(streams: DataFrame, codec: str = "auto") -> DataFrame:
    """name, codec, bytes_in, bytes_out for each value of a binary column ``data``; auto keeps the smallest."""
    import bz2
    import lzma
    import zlib

    tools = {"plain": bytes, "zlib": lambda x: zlib.compress(x, 9), "bz2": bz2.compress, "lzma": lzma.compress}
    chosen = tools if codec == "auto" else {codec: tools[codec]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(name, *min(((len(f(bytes(data))), c) for c, f in chosen.items())), len(data)) for name, data in zip(b["name"], b["data"], strict=True)]
            yield pd.DataFrame(rows, columns=["name", "bytes_out", "codec", "bytes_in"])[["name", "codec", "bytes_in", "bytes_out"]]

    return streams.select("name", "data").mapInPandas(run, "name string, codec string, bytes_in long, bytes_out long")
