"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

import corpus_pipeline
from prosemill.llm.op10_chat import OP10_SQL, op10_chat_format
from prosemill.llm.op11_divergence import OP11_SQL, op11_source_divergence
from prosemill.llm.op12_compression import op12_quality_rules
from prosemill.llm.op13_vector_codes import OP13_SQL, op13_vector_codes
from prosemill.llm.op1_token_store import op1_token_store
from prosemill.llm.op2_secrets import op2_secret_scan
from prosemill.llm.op3_decontam import op3_decontamination
from prosemill.llm.op4_pii import op4_pii_pseudonyms
from prosemill.llm.op5_packing import op5_best_fit_packing
from prosemill.llm.op6_url_lists import OP6_SQL, op6_url_filter
from prosemill.llm.op7_minhash import OP7_SQL, op7_minhash_near_dedup
from prosemill.llm.op8_embeddings import OP8_SQL, op8_embedding_near_dedup
from prosemill.llm.op9_language import op9_language_id

QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_secret_scan": op2_secret_scan,
    "op3_decontamination": op3_decontamination,
    "op4_pii_pseudonyms": op4_pii_pseudonyms,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_url_filter": op6_url_filter,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_language_id": op9_language_id,
    "op10_chat_format": op10_chat_format,
    "op11_source_divergence": op11_source_divergence,
    "op12_quality_rules": op12_quality_rules,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
    "op6_url_filter": OP6_SQL,
    "op7_minhash_near_dedup": OP7_SQL,
    "op8_embedding_near_dedup": OP8_SQL,
    "op10_chat_format": OP10_SQL,
    "op11_source_divergence": OP11_SQL,
    "op13_vector_codes": OP13_SQL,
}
