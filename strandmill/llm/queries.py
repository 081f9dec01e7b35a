"""The queries of this subpackage, by name, and the SQL that checks them."""

from __future__ import annotations

from .chat import op4_chat
from .line_rules import op7_line_rules
from .merkle import op13_merkle
from .mixing import op5_mixing
from .mpeg import op9_mpeg
from .negatives import op12_negatives
from .oracles import OP4_CHAT, OP6_SUBSTRING, OP7_LINE_RULES, OP12_NEGATIVES, OP13_MERKLE
from .orc_tokens import op2_orc_tokens
from .packing import op8_packing
from .prefix_bpe import op11_prefix_bpe
from .quality import op3_quality
from .simhash import op10_simhash
from .substring import op6_substring
from .toxicity import op1_toxicity

QUERIES = {
    "op4_chat": op4_chat,
    "op9_mpeg": op9_mpeg,
    "op7_line_rules": op7_line_rules,
    "op6_substring": op6_substring,
    "op3_quality": op3_quality,
    "op1_toxicity": op1_toxicity,
    "op5_mixing": op5_mixing,
    "op8_packing": op8_packing,
    "op2_orc_tokens": op2_orc_tokens,
    "op10_simhash": op10_simhash,
    "op11_prefix_bpe": op11_prefix_bpe,
    "op12_negatives": op12_negatives,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {
    "op4_chat": OP4_CHAT,
    "op6_substring": OP6_SUBSTRING,
    "op7_line_rules": OP7_LINE_RULES,
    "op12_negatives": OP12_NEGATIVES,
    "op13_merkle": OP13_MERKLE,
}
