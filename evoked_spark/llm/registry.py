"""The registered queries of this subpackage."""

from __future__ import annotations

from . import queries_dedup as dedup
from . import queries_lines as lines
from . import queries_mixing as mixing
from . import queries_models as models
from . import queries_quality as quality
from . import queries_text as text

QUERIES = {
    "op1_sentencepiece": text.op1_sentencepiece,
    "op2_warc_fixity": text.op2_warc_fixity,
    "op6_chat_format": text.op6_chat_format,
    "op3_simhash_dedup": dedup.op3_simhash_dedup,
    "op4_exact_dedup": dedup.op4_exact_dedup,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op7_toxicity": models.op7_toxicity,
    "op8_substring_dedup": dedup.op8_substring_dedup,
    "op9_hmm_scoring": models.op9_hmm_scoring,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_periodic_runs": lines.op11_periodic_runs,
    "op12_line_dedup": lines.op12_line_dedup,
    "op13_spelling_variants": lines.op13_spelling_variants,
}

ORACLE = {
    "op2_warc_fixity": text.OP2_SQL,
    "op6_chat_format": text.OP6_SQL,
    "op4_exact_dedup": dedup.OP4_SQL,
    "op5_mix_sources": mixing.OP5_SQL,
    "op12_line_dedup": lines.OP12_SQL,
}
