"""Column expressions on reads, regions and segments."""

from __future__ import annotations

import colorsys
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Flag bits of the SAM specification.
PAIRED, PROPER, UNMAPPED, REVERSE, READ1 = 1, 2, 4, 16, 64
#: The barcode of records that have none.
NO_BARCODE = "dummy"


def flag(bit: int, column: str = "flag") -> Column:
    return F.col(column).bitwiseAND(bit) != 0


def barcode(rule: str | Callable[[Column], Column], qname: str = "qname", tags: str = "tags") -> Column:
    """The barcode of a read.

    rule: a function of the read name's column; "prefix" for the text before the first colon or full stop of the name;
    else the name of a tag, either a key of the tag map or, if there is no such column, a column tag_<name>.
    """
    if callable(rule):
        found = rule(F.col(qname))
    elif rule == "prefix":
        found = F.split(qname, "[.:]")[0]
    else:
        found = F.col(tags)[rule] if tags else F.col(f"tag_{rule.lower()}")
    return F.coalesce(found, F.lit(NO_BARCODE))


def barcode_of_read(rule: Callable[[pd.DataFrame], pd.Series], *columns: str) -> Column:
    """The barcode of a read by a function of the whole read: it gets the named columns of many reads at once, as a frame.

    Columns may be name, flag, position, tags or any other; a null is a read without a barcode. Rules that column
    expressions can state are faster with `barcode`.
    """

    @F.pandas_udf("string")
    def found(reads: pd.DataFrame) -> pd.Series:
        return rule(reads)

    return F.coalesce(found(F.struct(*columns)), F.lit(NO_BARCODE))


def usable_read(min_mapq: int = 30, max_length: int = 2000, only_with_barcode: bool = False, code: str = "barcode") -> Column:
    """Template within max_length, mapping quality min_mapq or more and, if asked for, a barcode."""
    fine = (F.abs("tlen") <= max_length) & (F.col("mapq") >= min_mapq)
    return fine & (F.col(code) != NO_BARCODE) if only_with_barcode else fine


def five_prime() -> Column:
    return F.when(flag(REVERSE), F.col("pos") + F.col("rlen") - 1).otherwise(F.col("pos"))


def positions(mode: str) -> Column:
    """The positions at which a read counts, as an array.

    midpoint: read 1 of a proper pair at the middle of its template, unpaired reads at their 5' end, others nowhere.
    countboth: every read at its 5' end. eitherend: the 5' ends of a read and of its mate.
    """
    nowhere = F.expr("cast(array() as array<bigint>)")
    if mode == "midpoint":
        middle = F.least("pos", "mpos") + F.floor(F.abs("tlen") / 2)
        return F.when(flag(PROPER) & flag(READ1), F.array(middle)).when(~flag(PAIRED), F.array(five_prime())).otherwise(nowhere)
    if mode == "countboth":
        return F.array(five_prime())
    if mode == "eitherend":
        return F.when(flag(PAIRED), F.array(five_prime(), F.col("mpos"))).otherwise(F.array(five_prime()))
    raise ValueError(f"unknown counting mode {mode!r}")


def tss_window(flank: int, using_tss: bool = True) -> tuple[Column, Column]:
    """(start, stop) of a feature's window: its start site, which is stop on the minus strand, or its body, and the flank."""
    if using_tss:
        site = F.when(F.col("strand") == "-", F.col("stop")).otherwise(F.col("start"))
        first, last = site, site + 1
    else:
        first, last = F.col("start"), F.col("stop")
    return F.greatest(first - flank, F.lit(0)).cast("long"), (last + flank).cast("long")


def rainbow(state: str, n_states: int) -> Column:
    """"r,g,b" of a state, evenly spaced hues."""
    shades = [",".join(str(round(255 * c)) for c in colorsys.hsv_to_rgb(i / max(1, n_states), 1.0, 1.0)) for i in range(n_states)]
    return F.array(*map(F.lit, shades))[F.col(state)]


def bed9(segments: DataFrame, n_states: int) -> DataFrame:
    """Segments with the columns that a BED9 line has: strand ., thick ends, colour by state and score by probability."""
    return segments.withColumns(
        {
            "strand": F.lit("."),
            "thickStart": F.col("start"),
            "thickEnd": F.col("stop"),
            "itemRgb": rainbow("state", n_states),
            "score": F.floor(F.col("Prob_max") * 1000).cast("long"),
        }
    )


def best_state(probabilities: list[str]) -> tuple[Column, Column]:
    """(highest probability, its state); the lowest state wins ties."""
    top = F.greatest(*probabilities) if len(probabilities) > 1 else F.col(probabilities[0])
    return top, F.coalesce(*(F.when(F.col(p) == top, F.lit(i)) for i, p in enumerate(probabilities))).cast("int")


def state_name(state: str = "state") -> Column:
    return F.concat(F.lit("state_"), F.col(state).cast("string"))


def locus(text: str, window: int = 0) -> tuple[str, int, int]:
    """(chrom, start, stop) of chr:start-stop, widened by window on both sides and clamped at 0."""
    chrom, _, ends = text.rpartition(":")
    start, _, stop = ends.replace(",", "").partition("-")
    if not chrom or not start or not stop:
        raise ValueError(f"not a locus: {text!r}")
    return chrom, max(0, int(start) - window), int(stop) + window
