"""The queries of this subpackage, for the entry module: name -> callable, and the SQL of those that SQL can express."""

from __future__ import annotations

from .collocations import OP12_SQL, op12_collocations
from .ctph import op7_ctph
from .html_template import op9_html_template
from .language_id import op11_language_id
from .line_dedup import op3_line_dedup
from .mixing import OP5_SQL, op5_mixing
from .ngram_join import op2_ngram_join
from .packing import op10_packing
from .pseudo_lm import op4_pseudo_lm
from .quality_gbt import op1_quality_rules
from .secret_scan import op8_secret_scan
from .toxicity import op6_toxicity
from .valid_time import OP13_SQL, op13_sale_versions

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_ngram_join": op2_ngram_join,
    "op3_line_dedup": op3_line_dedup,
    "op4_pseudo_lm": op4_pseudo_lm,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_ctph": op7_ctph,
    "op8_secret_scan": op8_secret_scan,
    "op9_html_template": op9_html_template,
    "op10_packing": op10_packing,
    "op11_language_id": op11_language_id,
    "op12_collocations": op12_collocations,
    "op13_sale_versions": op13_sale_versions,
}
ORACLE_SQL: dict[str, str] = {"op5_mixing": OP5_SQL, "op12_collocations": OP12_SQL, "op13_sale_versions": OP13_SQL}
