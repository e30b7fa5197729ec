"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontaminate import op5_decontaminate
from .html import op4_html_extract
from .interactions import op13_filter_audit
from .licenses import op10_license_scan
from .neardups import op3_jaccard_join
from .packing import op6_packing
from .quality import op2_quality_rules
from .secrets import op9_secret_scan
from .sql import SQL  # noqa: F401
from .suffixes import op8_suffix_dedup
from .tokens import op7_token_counts
from .urls import op12_url_filters
from .vectors import op11_vector_codes
from .warc import op1_warc

QUERIES = {f.__name__: f for f in (op1_warc, op2_quality_rules, op3_jaccard_join, op4_html_extract, op5_decontaminate, op6_packing, op7_token_counts, op8_suffix_dedup, op9_secret_scan, op10_license_scan, op11_vector_codes, op12_url_filters, op13_filter_audit)}
