"""The queries of this package by name, with the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline
from siltstone.llm import ann, brown, decontam, divergence, html, importance, licences, lines, multiindex, packing, pii, simhash, toxicity

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_html": html.op2_html,
    "op3_pii": pii.op3_pii,
    "op4_packing": packing.op4_packing,
    "op5_simhash": simhash.op5_simhash,
    "op6_lines": lines.op6_lines,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_brown": brown.op9_brown,
    "op10_licences": licences.op10_licences,
    "op11_resampling": importance.op11_resampling,
    "op12_embedding_dedup": multiindex.op12_embedding_dedup,
    "op13_divergence": divergence.op13_divergence,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op6_lines": lines.ORACLE_SQL, "op11_resampling": importance.ORACLE_SQL, "op12_embedding_dedup": multiindex.ORACLE_SQL, "op13_divergence": divergence.ORACLE_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
