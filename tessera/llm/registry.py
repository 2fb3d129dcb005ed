"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm.ann import op9_nearest, op9_sql
from tessera.llm.decontaminate import decontaminate_proximity, op1_decontaminate, op1_sql
from tessera.llm.html_text import op2_html
from tessera.llm.langid import op10_langid
from tessera.llm.linededup import op8_line_dedup
from tessera.llm.mixing import op5_mix, op5_sql
from tessera.llm.phrases import op11_phrases, op11_sql
from tessera.llm.pii import op6_pii
from tessera.llm.quality import op3_quality
from tessera.llm.runs import op13_runs
from tessera.llm.sharding import op4_shard, op4_sql
from tessera.llm.simhash import op7_simhash
from tessera.llm.topk import op12_sql, op12_topk


def queries() -> dict:
    found = (op1_decontaminate, op2_html, op3_quality, op4_shard, op5_mix, op6_pii, op7_simhash, op8_line_dedup, op9_nearest, op10_langid, op11_phrases, op12_topk, op13_runs, decontaminate_proximity)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": op1_sql(), "op4_shard": op4_sql(), "op5_mix": op5_sql(), "op9_nearest": op9_sql(), "op11_phrases": op11_sql(), "op12_topk": op12_sql()}
