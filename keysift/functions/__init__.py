from keysift.functions.entropy import (adjusted_entropy, is_all_lowercase, is_base64, is_hex,
                                       is_one_case, is_sequential_or_repeated, has_symbol,
                                       shannon_entropy)
from keysift.functions.text import (byte_length, clip_match, fingerprint, fingerprint_short, let,
                                    match_context, match_position, redact, stable_fingerprint,
                                    truncate)

__all__ = ["adjusted_entropy", "byte_length", "clip_match", "fingerprint", "fingerprint_short",
           "has_symbol", "is_all_lowercase", "is_base64", "is_hex", "is_one_case",
           "is_sequential_or_repeated", "let", "match_context", "match_position", "redact",
           "shannon_entropy", "stable_fingerprint", "truncate"]
