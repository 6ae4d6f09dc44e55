"""The gene model's states, features and legal steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The state indices' names.
STATES = (
    "intergenic", "intron_0", "intron_1", "intron_2", "exon_0", "exon_1", "exon_2", "start",
    "exon_intron_0", "exon_intron_1", "exon_intron_2", "intron_exon_0", "intron_exon_1", "intron_exon_2", "stop",
    "utr5", "utr3", "utr_exon_intron", "utr_intron", "utr_intron_exon",
)

#: The feature each state belongs to; the two markers are exon bases of an unknown UTR.
FEATURES = (
    "intergenic", "intron", "intron", "intron", "CDS", "CDS", "CDS", "CDS", "CDS", "CDS", "CDS",
    "CDS", "CDS", "CDS", "CDS", "5UTR", "3UTR", "UTR_EI", "intron", "UTR_IE",
)

#: The states that may follow each state in transcription.
NEXT = {
    0: (0, 7, 15),
    1: (1, 11),
    2: (2, 12),
    3: (3, 13),
    4: (5, 8),
    5: (6, 9, 14),
    6: (4, 10),
    7: (5,),
    8: (1,),
    9: (2,),
    10: (3,),
    11: (4,),
    12: (5,),
    13: (6,),
    14: (0, 16),
    15: (7, 15, 17),
    16: (0, 16, 17),
    17: (18,),
    18: (18, 19),
    19: (15, 16),
}

CONTEXT = ("5UTR", "3UTR", "UTR_EI", "UTR_IE", "intron")


def feature_of(state: Column) -> Column:
    """Feature name of a state; an error outside 0 to 19."""
    known = F.element_at(F.array(*map(F.lit, FEATURES)), (state + 1).cast("int"))
    return F.when(state.between(0, 19), known).otherwise(F.raise_error(F.lit("a state is outside 0 to 19")))


def legal_step(left: Column, right: Column, strand: Column) -> Column:
    """May right follow left in genomic order? On the minus strand the arguments change places."""
    codes = [a * 100 + b for a, after in NEXT.items() for b in after]
    step = F.when(strand == "-", right * 100 + left).otherwise(left * 100 + right)
    return F.coalesce(step.isin(codes), F.lit(False))
