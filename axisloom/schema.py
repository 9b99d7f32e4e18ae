"""Declared schemas of the tables that sources read and operators exchange. Coordinates are 0-based and half-open."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


STR, LONG, INT, DBL = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

BED3 = _struct(chrom=STR, start=LONG, stop=LONG)
FRAGMENTS = _struct(chrom=STR, start=LONG, stop=LONG, barcode=STR, dup=INT)
ALIGNMENTS = T.StructType([*_struct(qname=STR, rname=STR, pos=LONG, mname=STR, mpos=LONG, tlen=LONG, rlen=LONG, mapq=INT, flag=INT).fields, T.StructField("tags", T.MapType(STR, STR))])
REGIONS = _struct(ridx=LONG, chrom=STR, start=LONG, stop=LONG, name=STR)
COUNTS = _struct(ridx=LONG, barcode=STR, cnt=LONG)
COORDINATES = _struct(row=LONG, col=LONG, val=LONG)
START = _struct(state=INT, p=DBL)
TRANSITIONS = _struct(i=INT, j=INT, p=DBL)
EMISSION = _struct(dataset=STR, barcode=STR, state=INT, suffstat=DBL, prior=DBL)
FEATURES = _struct(chrom=STR, start=LONG, stop=LONG, name=STR, score=STR, strand=STR)
