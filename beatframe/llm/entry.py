"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from beatframe.llm import oracles
from beatframe.llm.chat import op8_chat
from beatframe.llm.decontamination import op1_decontamination
from beatframe.llm.langid import op9_language
from beatframe.llm.lines import op7_lines
from beatframe.llm.negatives import op12_negatives
from beatframe.llm.oddsketch import op13_oddsketch
from beatframe.llm.packing import op6_packing
from beatframe.llm.periods import op11_periods
from beatframe.llm.sharding import op10_sharding
from beatframe.llm.simhash import op5_simhash
from beatframe.llm.substrings import op2_substrings
from beatframe.llm.suffixarrays import op3_suffixes
from beatframe.llm.topk import op4_topk

QUERIES = {f.__name__: f for f in (op1_decontamination, op2_substrings, op3_suffixes, op4_topk, op5_simhash, op6_packing, op7_lines, op8_chat, op9_language, op10_sharding, op11_periods, op12_negatives, op13_oddsketch)}
ORACLES: dict[str, str] = {"op1_decontamination": oracles.OP1, "op2_substrings": oracles.OP2, "op4_topk": oracles.OP4, "op7_lines": oracles.OP7, "op8_chat": oracles.OP8, "op11_periods": oracles.OP11, "op12_negatives": oracles.OP12, "op13_oddsketch": oracles.OP13}
