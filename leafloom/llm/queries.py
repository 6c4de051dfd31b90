"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafloom.llm.audit import OP11_SQL, op11_audit
from leafloom.llm.bpe import op4_bpe
from leafloom.llm.fingerprints import op9_fingerprints
from leafloom.llm.licenses import OP1_SQL, op1_licenses
from leafloom.llm.mixing import OP5_SQL, op5_mixing
from leafloom.llm.neardup import op2_neardup
from leafloom.llm.packing import op13_packing
from leafloom.llm.quality import OP7_SQL, op7_quality
from leafloom.llm.repeats import op3_repeats
from leafloom.llm.sharding import op10_sharding
from leafloom.llm.spelling import OP12_SQL, op12_spelling
from leafloom.llm.toxicity import op6_toxicity
from leafloom.llm.warc import OP8_SQL, op8_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_licenses": op1_licenses, "op2_neardup": op2_neardup, "op3_repeats": op3_repeats, "op4_bpe": op4_bpe, "op5_mixing": op5_mixing, "op6_toxicity": op6_toxicity, "op7_quality": op7_quality, "op8_warc": op8_warc, "op9_fingerprints": op9_fingerprints, "op10_sharding": op10_sharding, "op11_audit": op11_audit, "op12_spelling": op12_spelling, "op13_packing": op13_packing}


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": OP1_SQL, "op5_mixing": OP5_SQL, "op7_quality": OP7_SQL, "op8_warc": OP8_SQL, "op11_audit": OP11_SQL, "op12_spelling": OP12_SQL}
