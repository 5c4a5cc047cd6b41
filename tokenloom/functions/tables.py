"""Fixed values of the vocabulary layout."""

from __future__ import annotations

# The special tokens, their names and ids.
SPECIALS = {
    "pad": "<|pad|>",
    "unk": "<|unk|>",
    "bos": "<|startoftext|>",
    "eos": "<|endoftext|>",
    "user": "<|user|>",
    "assistant": "<|assistant|>",
    "system": "<|system|>",
}
SPECIAL_IDS = {name: i for i, name in enumerate(SPECIALS)}

# The chat markers, which are also cut out of running text as whole pieces.
ROLES = ("user", "assistant", "system")
USER_SYMBOLS = tuple(SPECIALS[r] for r in ROLES)

# Ids left out when decoding without specials; the unknown id stays.
SKIPPED_IDS = tuple(SPECIAL_IDS[n] for n in ("pad", "bos", "eos", "user", "assistant", "system"))

BYTE_BASE = len(SPECIALS)
PIECE_BASE = BYTE_BASE + 256
MAX_VOCAB = 1 << 16  # ids are stored as 16-bit numbers

# What the unknown id decodes to, and the longest trained piece.
UNKNOWN_SURFACE = " ⁇ "
MAX_PIECE_CHARS = 16
