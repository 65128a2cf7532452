"""Queries of this package and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op3_simhash_decontam as op3
from . import op4_line_spread as op4
from . import op10_entropy_mixing as op10
from . import op12_phrase_stripes as op12
from . import op13_warc as op13
from .op1_ordinal_toxicity import op1_ordinal_toxicity
from .op2_rans_tokens import op2_rans_tokens
from .op3_simhash_decontam import op3_simhash_decontam
from .op4_line_spread import op4_line_spread
from .op5_html_blocks import op5_html_blocks
from .op6_language_evidence import op6_language_evidence
from .op7_nn_descent import op7_nn_descent
from .op8_ngram_jaccard import op8_ngram_jaccard
from .op9_ppm_scoring import op9_ppm_scoring
from .op10_entropy_mixing import op10_entropy_mixing
from .op11_periodic_runs import op11_periodic_runs
from .op12_phrase_stripes import op12_phrase_stripes
from .op13_warc import op13_warc_merge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ordinal_toxicity": op1_ordinal_toxicity,
    "op2_rans_tokens": op2_rans_tokens,
    "op3_simhash_decontam": op3_simhash_decontam,
    "op4_line_spread": op4_line_spread,
    "op5_html_blocks": op5_html_blocks,
    "op6_language_evidence": op6_language_evidence,
    "op7_nn_descent": op7_nn_descent,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_ppm_scoring": op9_ppm_scoring,
    "op10_entropy_mixing": op10_entropy_mixing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_phrase_stripes": op12_phrase_stripes,
    "op13_warc_merge": op13_warc_merge,
}

ORACLES = {
    "op3_simhash_decontam": op3.ORACLE,
    "op4_line_spread": op4.ORACLE,
    "op10_entropy_mixing": op10.ORACLE,
    "op12_phrase_stripes": op12.ORACLE,
    "op13_warc_merge": op13.ORACLE,
}
