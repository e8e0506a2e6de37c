"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from versograph.llm.op01_license import op1_license
from versograph.llm.op02_quality import op2_quality
from versograph.llm.op03_lm import op3_lm
from versograph.llm.op04_toxicity import op4_toxicity
from versograph.llm.op05_bpe import op5_bpe
from versograph.llm.op06_tokens import op6_tokens
from versograph.llm.op07_decontaminate import op7_decontaminate
from versograph.llm.op08_secrets import OP8_SQL, op8_secrets
from versograph.llm.op09_rules import op9_rules
from versograph.llm.op10_simhash import op10_simhash

QUERIES = {
    "op1_license": op1_license,
    "op2_quality": op2_quality,
    "op3_lm": op3_lm,
    "op4_toxicity": op4_toxicity,
    "op5_bpe": op5_bpe,
    "op6_tokens": op6_tokens,
    "op7_decontaminate": op7_decontaminate,
    "op8_secrets": op8_secrets,
    "op9_rules": op9_rules,
    "op10_simhash": op10_simhash,
}

ORACLES: dict[str, str] = {"op8_secrets": OP8_SQL}
