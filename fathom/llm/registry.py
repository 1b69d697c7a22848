"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from .decontaminate import op1_decontaminate
from .divergence import OP13_SQL, op13_source_divergence
from .embed_dedup import OP5_SQL, op5_embeddings
from .language import op6_language
from .minhash import OP2_SQL, op2_minhash
from .packing import op9_packing
from .periodic import OP11_SQL, op11_periodic_runs
from .quality import op8_quality
from .secrets import op4_secrets
from .sharding import OP3_SQL, op3_sharding
from .token_files import op10_token_files
from .toxicity import op7_toxicity
from .warc import OP12_SQL, op12_warc

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_minhash": op2_minhash,
    "op3_sharding": op3_sharding,
    "op4_secrets": op4_secrets,
    "op5_embeddings": op5_embeddings,
    "op6_language": op6_language,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_token_files": op10_token_files,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_warc": op12_warc,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {"op2_minhash": OP2_SQL, "op3_sharding": OP3_SQL, "op5_embeddings": OP5_SQL, "op11_periodic_runs": OP11_SQL, "op12_warc": OP12_SQL, "op13_source_divergence": OP13_SQL}
