"""Token counts by prefix dynamic programming.

``PrefixCounts`` holds, for one text, the exact token count of every prefix that ends with a piece, the
pieces being words, single marks or white-space separated chunks over whose ends tokens never reach: the
count of a prefix is the count of the one before plus the tokens of the piece between.  A prefix that
ends inside a piece adds the count of that part alone.  So truncation and budget questions need no
second encoding of the text.

Tokenizers that join over white space have no such boundaries; their one stored prefix is the whole
text, and other prefixes are encoded when asked for.

Edge cases: null and empty texts have 0 bytes and 0 tokens; a row with a null doc_id is counted like
any other; repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankspark.llm.common import each_text, texts_of
from rankspark.llm.encode import Encoder, encoder, vocabulary

LIMIT = 2048


class PrefixCounts:
    """Counts at the prefix ends of one text; where the ends are is worked out when first asked for."""

    def __init__(self, text: str, coder: Encoder):
        self.text, self.coder = text, coder
        sizes = np.fromiter(map(len, coder.pieces(text)), np.int64)
        self.counts = np.cumsum(sizes // coder.dtype.itemsize)

    @cached_property
    def spans(self) -> np.ndarray:
        return np.array(self.coder.spans(self.text), np.int64).reshape(-1, 2)

    @property
    def ends(self) -> np.ndarray:
        return self.spans[:, 1]

    def total(self) -> int:
        return int(self.counts[-1]) if len(self.counts) else 0

    def at(self, chars: int) -> int:
        """Tokens of ``text[:chars]``."""
        done = int(np.searchsorted(self.ends, chars, side="right"))
        base = int(self.counts[done - 1]) if done else 0
        if done < len(self.spans) and self.spans[done, 0] < chars:
            base += PrefixCounts(self.text[self.spans[done, 0]: chars], self.coder).total()
        return base

    def longest_within(self, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        done = int(np.searchsorted(self.counts, budget, side="right"))
        if done == len(self.spans):
            return len(self.text)
        start, end = map(int, self.spans[done])
        return next((chars for chars in range(end - 1, start, -1) if self.at(chars) <= budget), start)


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = LIMIT,
                 with_prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    ``with_prefixes`` adds the stored table: ``prefix_ends`` (characters) and ``prefix_counts``.
    """
    kinds = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    kinds += ", prefix_ends array<long>, prefix_counts array<long>" if with_prefixes else ""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary(tokenizer))
        for keys, texts in each_text(batches):
            tables = (PrefixCounts(t, coder) for t in texts)
            got = [(p.total(), *((p.ends, p.counts) if with_prefixes else ())) for p in tables]
            columns = {
                "doc_id": pa.array(keys, pa.int64()),
                "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                "n_tokens": pa.array([g[0] for g in got], pa.int64()),
                "over_limit": pa.array([g[0] > limit for g in got], pa.bool_()),
            }
            if with_prefixes:
                columns |= {name: pa.array([g[k] for g in got], pa.list_(pa.int64()))
                            for k, name in ((1, "prefix_ends"), (2, "prefix_counts"))}
            yield pa.RecordBatch.from_pydict(columns)

    return texts_of(docs).mapInArrow(count, kinds)
