"""Script-based language and token estimates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code point ranges that count as kana, and as one token each.
KANA = r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}"
CJK = KANA + r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"
#: White space as Unicode has it, with the four separators that text libraries add.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _count(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]", ""))


def detect_language(text: Column) -> Column:
    """'ja' if kana are 2 % or CJK 15 % of what is no white space, else 'en'."""
    t = F.coalesce(text, F.lit(""))
    letters = F.length(F.regexp_replace(t, SPACE, ""))
    wide = F.regexp_replace(t, f"[^{CJK}]", "")
    cjk = F.length(F.regexp_replace(wide, SPACE, ""))
    return F.when((letters > 0) & ((_count(wide, KANA) >= letters * 0.02) | (cjk >= letters * 0.15)), "ja").otherwise("en")


def estimate_tokens(text: Column) -> Column:
    """One token for each CJK code point and for every four others."""
    t = F.coalesce(text, F.lit(""))
    cjk = _count(t, CJK)
    return (cjk + F.floor((F.length(t) - cjk + 3) / 4)).cast("int")


def budget_chars(tokens: Column | int, text: Column) -> Column:
    """Characters of ``text`` that a token budget buys at its own density."""
    n = F.lit(tokens) if isinstance(tokens, int) else tokens
    est = estimate_tokens(text)
    per = F.greatest(F.lit(1.0), F.length(text) / F.nullif(est, F.lit(0)))
    return F.when(n <= 0, 0).when(est == 0, n * 4).otherwise(F.greatest(F.lit(1), F.floor(n * per).cast("int"))).cast("int")
