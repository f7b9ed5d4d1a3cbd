"""Word pieces of texts and pairs of texts by a given vocabulary, padded to one length."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.functions.workers import importable

SPECIAL = ("[PAD]", "[UNK]", "[CLS]", "[SEP]")


def tokenizer(vocabulary: Sequence[str], lowercase: bool = False):
    from tokenizers import Regex, Tokenizer
    from tokenizers.models import WordPiece
    from tokenizers.normalizers import NFC, Lowercase, Sequence as Both
    from tokenizers.pre_tokenizers import Split

    if missing := [s for s in SPECIAL if s not in vocabulary]:
        raise ValueError(f"vocabulary lacks {missing}")
    t = Tokenizer(WordPiece({w: i for i, w in enumerate(vocabulary)}, unk_token="[UNK]", max_input_chars_per_word=100))
    t.normalizer = Both([NFC(), Lowercase()]) if lowercase else NFC()
    t.pre_tokenizer = Split(Regex(r"[\p{L}\p{M}\p{N}]+|[^\s]"), "removed", invert=True)
    return t


def shares(left: int, right: int, room: int) -> tuple[int, int]:
    """Lengths that are left when the longer of two loses pieces, the left one if they are equal, until both fit."""
    if left + right <= room:
        return left, right
    if right <= room - room // 2:
        return room - right, right
    if left <= room // 2:
        return left, room - left
    return room // 2, room - room // 2


def encode(docs: DataFrame, vocabulary: Sequence[str], first: str, second: str | None = None, most: int = 128, lowercase: bool = False) -> DataFrame:
    """``doc_id, ids, mask, types`` of ``most`` entries each; null texts are empty, an empty second text has no closing mark."""
    if not 8 <= most <= 512:
        raise ValueError("most must be between 8 and 512")
    importable(docs.sparkSession)
    tokenizer(vocabulary)
    words = list(vocabulary)

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        t = tokenizer(words, lowercase)
        pad, cls, sep = (t.token_to_id(s) for s in ("[PAD]", "[CLS]", "[SEP]"))
        for a, b in parts:
            rows = []
            for x, y in zip(*([e.ids for e in t.encode_batch(s.tolist(), add_special_tokens=False)] for s in (a, b)), strict=True):
                n, m = shares(len(x), len(y), most - (3 if y else 2))
                ids = [cls, *x[:n], sep]
                types = [0] * len(ids)
                if y:
                    ids, types = [*ids, *y[:m], sep], [*types, *[1] * (m + 1)]
                gap = most - len(ids)
                rows.append((ids + [pad] * gap, [1] * len(ids) + [0] * gap, types + [0] * gap))
            yield pd.DataFrame(rows, columns=["ids", "mask", "types"])

    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c else F.lit("")
    of = F.pandas_udf(run, "ids array<int>, mask array<int>, types array<int>")
    return docs.select("doc_id", of(text(first), text(second)).alias("e")).select("doc_id", "e.*")
