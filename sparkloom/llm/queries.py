"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from sparkloom.llm.bpe import op9_bpe
from sparkloom.llm.ctw import op6_ctw
from sparkloom.llm.exact_dedup import SQL as OP1
from sparkloom.llm.exact_dedup import op1_exact_dedup
from sparkloom.llm.licenses import op4_license
from sparkloom.llm.mixing import op10_mixing
from sparkloom.llm.near_dedup import SQL as OP3
from sparkloom.llm.near_dedup import op3_near_dedup
from sparkloom.llm.pii import op2_pii
from sparkloom.llm.topk import SQL as OP8
from sparkloom.llm.topk import op8_topk
from sparkloom.llm.toxicity import op5_toxicity
from sparkloom.llm.warc import op7_warc

QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_pii, op3_near_dedup, op4_license, op5_toxicity, op6_ctw, op7_warc, op8_topk, op9_bpe, op10_mixing)}
ORACLES = {"op1_exact_dedup": OP1, "op3_near_dedup": OP3, "op8_topk": OP8}
