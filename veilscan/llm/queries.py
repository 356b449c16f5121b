"""Registered queries of the training-data operators, and their SQL where there is any."""

from .op1_language_id import op1_language_id
from .op2_token_counts import op2_token_counts
from .op3_decontamination import SQL as OP3
from .op3_decontamination import op3_decontamination
from .op4_toxicity import op4_toxicity
from .op5_packing import op5_packing
from .op6_image_copies import op6_image_copies
from .op7_license_scan import op7_license_scan
from .op8_warc import SQL as OP8
from .op8_warc import op8_warc
from .op9_chat_format import SQL as OP9
from .op9_chat_format import op9_chat_format
from .op10_near_duplicates import op10_near_duplicates
from .op11_bpe import op11_bpe
from .op12_whitening import op12_whitening
from .op13_prefix_trie import SQL as OP13
from .op13_prefix_trie import op13_prefix_trie


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_token_counts": op2_token_counts,
        "op3_decontamination": op3_decontamination,
        "op4_toxicity": op4_toxicity,
        "op5_packing": op5_packing,
        "op6_image_copies": op6_image_copies,
        "op7_license_scan": op7_license_scan,
        "op8_warc": op8_warc,
        "op9_chat_format": op9_chat_format,
        "op10_near_duplicates": op10_near_duplicates,
        "op11_bpe": op11_bpe,
        "op12_whitening": op12_whitening,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3, "op8_warc": OP8, "op9_chat_format": OP9, "op13_prefix_trie": OP13}
