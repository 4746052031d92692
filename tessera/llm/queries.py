"""Queries and SQL of this subpackage's operators."""

from __future__ import annotations

from .chat import OP7_SQL, op7_chat
from .decontaminate import OP1_SQL, op1_decontaminate
from .html_text import op5_html
from .language import op4_language
from .mixing import op10_mixing
from .neighbours import op13_neighbours
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality import OP3_SQL, op3_quality
from .secrets import op9_secrets
from .simhash import op8_simhash
from .toxicity import op6_toxicity
from .warc import OP2_SQL, op2_warc
from .whitening import op12_whitening

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_warc": op2_warc,
    "op3_quality": op3_quality,
    "op4_language": op4_language,
    "op5_html": op5_html,
    "op6_toxicity": op6_toxicity,
    "op7_chat": op7_chat,
    "op8_simhash": op8_simhash,
    "op9_secrets": op9_secrets,
    "op10_mixing": op10_mixing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_whitening": op12_whitening,
    "op13_neighbours": op13_neighbours,
}
SQL = {
    "op1_decontaminate": OP1_SQL,
    "op2_warc": OP2_SQL,
    "op3_quality": OP3_SQL,
    "op7_chat": OP7_SQL,
    "op11_prefix_trie": OP11_SQL,
}
