"""Documents with every awkward case."""

from __future__ import annotations

import random

#: Extra columns whose names the operators use inside.
CLASH = ("t", "w", "key", "node", "tag", "salt", "rank", "ids", "kept", "h", "size", "found", "n_words", "length", "name")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASH)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["en", "ta", "or", "il", "ma", "ou", "st"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    long_ = prose(7, 20_000)
    texts = [
        (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, prose(1, 60), "en"), (4, prose(1, 60), "en"), (5, prose(1, 60), None), (6, prose(1, 60) + " extra", "de"),
        (7, long_, "en"), (8, long_ + " and more", "en"), (None, prose(2, 50), "en"), (None, None, None), (9, "Ünïcödé ÇA 漢字 🎉 " * 30, "fr"), (10, "one", "en"),
        (11, "a b c", "en"), (12, prose(3, 80) + " mail me at x.y@mail.example.com or +1 (743) 555-3824, 10.0.0.1, 4539578763621486", "en"), (13, "<|endoftext|> and <|startoftext|>", "en"),
    ]
    return [(i, t, g, "src", len(t) if t else None, *["x"] * len(CLASH)) for i, t, g in texts]
