"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from assaykit.llm.centroids import OP12_SQL, op12_drake
from assaykit.llm.hnsw import op2_hnsw
from assaykit.llm.katz import op4_katz
from assaykit.llm.language import op11_cross_parse
from assaykit.llm.lexical import OP13_SQL, op13_ranked_search
from assaykit.llm.packing import op1_packing
from assaykit.llm.pieces import op7_trie_counts, op8_nbest
from assaykit.llm.quality import op6_quality
from assaykit.llm.rules import op5_rules
from assaykit.llm.simhash import op3_simhash
from assaykit.llm.toxicity import op9_toxicity
from assaykit.llm.warc import OP10_SQL, op10_warc

QUERIES = {f.__name__: f for f in (op1_packing, op2_hnsw, op3_simhash, op4_katz, op5_rules, op6_quality, op7_trie_counts, op8_nbest, op9_toxicity, op10_warc, op11_cross_parse, op12_drake, op13_ranked_search)}
#: Only what SQL can express.
SQL: dict[str, str] = {"op10_warc": OP10_SQL, "op12_drake": OP12_SQL, "op13_ranked_search": OP13_SQL}
