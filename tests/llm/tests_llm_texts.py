"""Texts that are hard on tokenizers, hashes and word rules."""

import random

SPACES = [" ", " ", " ", " ", "\n", "  ", "\t", "\r\n", " \n ", "\x0b", "\x0c", " ", " ", "\x1c", "\x85"]
WORDS = ["the", "of", "Straße", "ñañdú", "a", "b", "1234", "x1", "don't", "we'LL", "日本語", "éa", "́",
         "😀", "▁", "▁▁x", "<|endoftext|>", "</s>", "[INST]", "<0x41>", "<unk>", "#tag", "$%&|", "\\", "\\|", "Σας",
         "ÅNGSTRÖM", "ǅ", "a.b", "(c)"]


def messy_texts(seed: int, n: int) -> list:
    """Null, empty, blank, one-word, repeated, long and randomly mixed texts."""
    r = random.Random(seed)
    out = [None, "", " ", "\n\n", "word", "word", "same line\nsame line\nsame  LINE 7\n", "a " * 400, "a" * 3000]
    while len(out) < n:
        out.append("".join(r.choice(WORDS) + r.choice(SPACES) for _ in range(r.choice([3, 8, 40, 200]))))
    base = [r.choice(WORDS[:10]) + str(r.randrange(50)) for _ in range(150)]
    for i in range(6):
        w = list(base)
        w[r.randrange(150)] = f"edit{i}"
        out.append(" ".join(w))
    return out + out[9:12]
