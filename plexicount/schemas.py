"""Schemas of the tables that operators exchange.  Sources give every row an ``ordinal``:
its place in the input, from 0, since row order decides ties and output order."""

from __future__ import annotations

READS = "ordinal bigint, id string, seq string, qual string"
ALIGNMENTS = (
    "ordinal bigint, qname string, flag int, tid int, contig string, pos bigint, mapq int, cigar string, "
    "mtid int, mpos bigint, tlen bigint, seq string, qual string, tags map<string,struct<type:string,value:string>>"
)
PAIRS = "ordinal bigint, r1 struct<id:string,seq:string,qual:string>, r2 struct<id:string,seq:string,qual:string>"
LINES = "ordinal bigint, value string"

UNMAPPED, MATE_UNMAPPED, REVERSE, SECOND, PAIRED = 0x4, 0x8, 0x10, 0x80, 0x1
