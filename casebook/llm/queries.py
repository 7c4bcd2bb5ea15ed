"""The subpackage's queries and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from casebook.llm.op01_toxicity import op1_toxicity
from casebook.llm.op02_warc import OP2_SQL, op2_warc
from casebook.llm.op03_topk import OP3_SQL, op3_topk
from casebook.llm.op04_line_dedup import OP4_SQL, op4_line_dedup
from casebook.llm.op05_bpe import op5_bpe_encode_decode
from casebook.llm.op06_decontam import op6_decontaminate
from casebook.llm.op07_chat import OP7_SQL, op7_chat_format
from casebook.llm.op08_license import OP8_SQL, op8_license_scan
from casebook.llm.op09_minhash import op9_near_dedup
from casebook.llm.op10_records import op10_token_records

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_warc": op2_warc,
    "op3_topk": op3_topk,
    "op4_line_dedup": op4_line_dedup,
    "op5_bpe_encode_decode": op5_bpe_encode_decode,
    "op6_decontaminate": op6_decontaminate,
    "op7_chat_format": op7_chat_format,
    "op8_license_scan": op8_license_scan,
    "op9_near_dedup": op9_near_dedup,
    "op10_token_records": op10_token_records,
}

ORACLE_SQL = {
    "op2_warc": OP2_SQL,
    "op3_topk": OP3_SQL,
    "op4_line_dedup": OP4_SQL,
    "op7_chat_format": OP7_SQL,
    "op8_license_scan": OP8_SQL,
}
