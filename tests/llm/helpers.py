"""Rows and brute-force versions for the operators' tests."""

import hashlib
import re

LONG = "lorem ipsum dolor sit amet " * 4000
TEXTS = [
    None, "", " \n\t", "one", "one two", "One two three four five", "one TWO three four five", "ÄÖ ß Straße naïve 漢字 🙂 it's we'll 12,345.67 <|endoftext|> tail  ",
    "a repeated line of text\nshort\na repeated line of text\n\nend of it", "  A repeated LINE of text \nanother line that is here\nshort", LONG,
        LONG + "x", "x" * 30_000, "same same same " * 40, "%% ## $$ && || <> " * 30,
    "the quick brown fox jumps over the lazy dog and runs far away from here " * 3, "the quick brown fox jumps over the lazy dog and runs far away from here " * 3 + "now",
]


def rows():
    """(doc_id, text, lang, source, n_chars): every text, ties, repeated rows, nulls in every column."""
    out = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    out += [(100 + i, t, "fr", "s1", 1) for i, t in enumerate(TEXTS)] + [out[5], out[5], out[8]]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()
