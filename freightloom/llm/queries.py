"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from freightloom.llm.codes import op13_codes
from freightloom.llm.ctw import op11_ctw
from freightloom.llm.html import op7_html
from freightloom.llm.langid import op1_langid
from freightloom.llm.linededup import OP5_SQL, op5_linededup
from freightloom.llm.packing import op8_packing
from freightloom.llm.phrases import OP12_SQL, op12_phrases
from freightloom.llm.pieces import op10_pieces
from freightloom.llm.quality import op3_quality
from freightloom.llm.simhash import op2_simhash
from freightloom.llm.tokens import op9_tokens
from freightloom.llm.topk import OP4_SQL, op4_topk
from freightloom.llm.urlfilter import OP6_SQL, op6_urls

QUERIES = {
    "op1_langid": op1_langid,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_topk": op4_topk,
    "op5_linededup": op5_linededup,
    "op6_urls": op6_urls,
    "op7_html": op7_html,
    "op8_packing": op8_packing,
    "op9_tokens": op9_tokens,
    "op10_pieces": op10_pieces,
    "op11_ctw": op11_ctw,
    "op12_phrases": op12_phrases,
    "op13_codes": op13_codes,
}

#: The others tokenize, estimate or follow links; they are tested against brute force.
ORACLES = {"op4_topk": OP4_SQL, "op5_linededup": OP5_SQL, "op6_urls": OP6_SQL, "op12_phrases": OP12_SQL}
