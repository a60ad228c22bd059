"""The queries of this folder and their SQL (none where SQL cannot express the operator)."""

from __future__ import annotations

from .bpe import op7_bpe
from .decontaminate import op9_decontaminate
from .exact_dedup import SQL as EXACT_SQL
from .exact_dedup import op2_exact_dedup
from .graph_dedup import op8_graph_dedup
from .langid import op10_language_id
from .mixing import op12_source_mix
from .ngram_join import op4_ngram_join
from .periodic import op13_periodic_runs
from .pii import op5_pii
from .suffix_dedup import op3_suffix_dedup
from .toxicity import op6_toxicity
from .turns import op11_turn_repair
from .url_filter import SQL as URL_SQL
from .url_filter import op1_url_filter

QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_exact_dedup, op3_suffix_dedup, op4_ngram_join, op5_pii, op6_toxicity, op7_bpe, op8_graph_dedup, op9_decontaminate,
    op10_language_id, op11_turn_repair, op12_source_mix, op13_periodic_runs)}

SQL = {"op1_url_filter": URL_SQL, "op2_exact_dedup": EXACT_SQL}
