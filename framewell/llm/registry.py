"""The training-data queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from framewell.llm.bestfit import op12_best_fit
from framewell.llm.digests import op6_fingerprints
from framewell.llm.langid import op7_language_id
from framewell.llm.media import op8_media_columns
from framewell.llm.mixing import op5_mixing
from framewell.llm.packing import op4_packing
from framewell.llm.ranked import OP13_SQL, op13_ranked_search
from framewell.llm.secrets import OP1_SQL, op1_secret_scan
from framewell.llm.separators import op3_token_counts
from framewell.llm.simhash import op2_simhash_near_dedup
from framewell.llm.substrings import OP10_SQL, op10_substring_dedup
from framewell.llm.variants import op11_spelling_variants
from framewell.llm.wrappers import op9_html_extraction

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_packing": op4_packing,
    "op5_mixing": op5_mixing,
    "op6_fingerprints": op6_fingerprints,
    "op7_language_id": op7_language_id,
    "op8_media_columns": op8_media_columns,
    "op9_html_extraction": op9_html_extraction,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_best_fit": op12_best_fit,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE_SQL: dict[str, str] = {"op1_secret_scan": OP1_SQL, "op10_substring_dedup": OP10_SQL, "op13_ranked_search": OP13_SQL}
