"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from dagloom.llm.decontaminate import op2_decontamination
from dagloom.llm.licenses import op3_license_scan
from dagloom.llm.mixing import op8_mixing
from dagloom.llm.parity import OP6_SQL, op6_jaccard_join
from dagloom.llm.recurrent import op9_language_model
from dagloom.llm.secrets import op5_secret_scan
from dagloom.llm.sharding import op10_sharding
from dagloom.llm.substring import OP4_SQL, op4_substring_dedup
from dagloom.llm.telephony import op1_telephony
from dagloom.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_telephony": op1_telephony,
    "op2_decontamination": op2_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_language_model": op9_language_model,
    "op10_sharding": op10_sharding,
}

ORACLE_SQL = {
    "op6_jaccard_join": OP6_SQL,
    "op4_substring_dedup": OP4_SQL,
}
