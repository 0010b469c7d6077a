"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bottom_k import op8_bottom_k
from .html_cut import op6_min_cut
from .kneser_ney import op10_kneser_ney
from .licenses import op2_diagonals
from .matroska import op1_matroska
from .mixing import op3_splitting_tree
from .oracles import ORACLES
from .packing import op9_packing
from .quality import op4_log_ratio
from .secrets import op5_ownership
from .toxicity import op7_toxicity

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_matroska": op1_matroska,
    "op2_diagonals": op2_diagonals,
    "op3_splitting_tree": op3_splitting_tree,
    "op4_log_ratio": op4_log_ratio,
    "op5_ownership": op5_ownership,
    "op6_min_cut": op6_min_cut,
    "op7_toxicity": op7_toxicity,
    "op8_bottom_k": op8_bottom_k,
    "op9_packing": op9_packing,
    "op10_kneser_ney": op10_kneser_ney,
}

