"""Tokens and ids as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokenizer's pattern and the special tokens, whose ids are their places.
TOKEN_PATTERN = r"[A-Za-z0-9_]+|[?.,:;/()]"
SPECIALS = ("<pad>", "<bos>", "<eos>", "<ans>", "<q>", "<fact>", "<unk>")
PAD, BOS, EOS, ANS, Q, FACT, UNK = range(7)
IGNORED = -100
#: The same classes over all letters and digits, for text that is not ASCII.
UNICODE_PATTERN = r"[\p{L}\p{N}_]+|[?.,:;/()]"


def tokens(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    """Tokens of a text in order; null has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.array().cast("array<string>"))


def slot_name(slot_id: Column) -> Column:
    return F.format_string("slot_%06d", slot_id)


def slot_number(name: Column) -> Column:
    return F.element_at(F.split(name, "_"), -1).cast("int")


def mix(*parts: Column | int) -> Column:
    """A deterministic shuffle key: a linear congruence that any SQL engine computes alike."""
    found = F.lit(0).cast("bigint")
    for p in parts:
        p = F.lit(p) if isinstance(p, int) else p
        found = ((found * 31 + p.cast("bigint")) % 2147483648 * 1103515245 + 12345) % 2147483648
    return found


def labels(ids: Column, prompt_len: Column) -> Column:
    """Training labels: ids with the prompt ignored."""
    return F.transform(ids, lambda x, i: F.when(i < prompt_len, IGNORED).otherwise(x))


def padded(ids: Column, width: Column, pad: int = PAD) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), width - F.size(ids)))
