"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from tellumen.llm.ann import op10_ann
from tellumen.llm.chat import OP7_SQL, op7_chat_formatting
from tellumen.llm.decontam import op2_decontamination
from tellumen.llm.linededup import op1_line_dedup
from tellumen.llm.minhash import op3_minhash_dedup
from tellumen.llm.mixing import OP6_SQL, op6_mixing
from tellumen.llm.pii import op9_pii
from tellumen.llm.quality import op5_quality_classifier
from tellumen.llm.rnnlm import op4_lm_scoring
from tellumen.llm.toxicity import op8_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_decontamination,
        op3_minhash_dedup,
        op4_lm_scoring,
        op5_quality_classifier,
        op6_mixing,
        op7_chat_formatting,
        op8_toxicity,
        op9_pii,
        op10_ann,
    )
}
SQL = {"op6_mixing": OP6_SQL, "op7_chat_formatting": OP7_SQL}
