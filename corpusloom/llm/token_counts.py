"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are grouped into batches of bounded bytes.  Each text is cut at *safe* boundaries, spaces with
a non-space character on both sides: a byte-level BPE pre-tokenizer always starts a pre-token there,
so the count of a text is the sum of its pieces' counts.  Pieces repeat a lot in any language, so
their counts are kept in a bounded memo and only unknown pieces go through the library, in batches.
"""

from __future__ import annotations

import functools
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

BATCH_BYTES = 1 << 20
MEMO = 250_000
#: White space by Python's rule is a superset of the library's, so fewer places count as safe, none wrongly.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Longer pieces are not memorised.
PIECE = 64


class Counter:
    """Counts tokens of texts as one tokenizer file gives them, without begin, end or added special tokens."""

    def __init__(self, name: str):
        path = common.tokenizer_path(name)
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.pieces = False
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.whole = lambda texts: [len(x) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
            self.pieces = "byte_bpe" in name
        self.memo = common.TwoGenerations(MEMO)

    def count(self, texts: list[str]) -> list[int]:
        if not self.pieces:
            return self.whole(texts)
        split = [text.split(" ") for text in texts]
        known = self.memo.fill(split, PIECE, self._rate)
        out = [0] * len(texts)
        slow, owner = [], []
        for i, words in enumerate(split):
            if words[0]:
                slow.append(words[0])
                owner.append(i)
            counts = list(map(known.get, words[1:]))
            if None in counts:  # runs of white space, or a long piece: cut by the expression instead
                if words[0]:
                    slow.pop()
                    owner.pop()
                rest = self._safe_pieces(texts[i])
                slow += rest
                owner += [i] * len(rest)
            else:
                out[i] = sum(counts)
        for i, n in zip(owner, self.whole(slow), strict=True):
            out[i] += n
        return out

    def _rate(self, words: list[str]) -> list[int | None]:
        """None marks a piece that touches white space, at which a cut isn't safe."""
        good = [" " + w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        rated = iter(self.whole(good))
        return [next(rated) if w and not w[0].isspace() and not w[-1].isspace() else None for w in words]

    @staticmethod
    def _safe_pieces(text: str, least: int = 4096) -> list[str]:
        """The text in pieces of about ``least`` characters, each but the first beginning at a safe space."""
        pieces, start = [], 0
        while len(text) - start > 2 * least and (found := SAFE.search(text, start + least)):
            pieces.append(text[start : found.start()])
            start = found.start()
        return [*pieces, text[start:]]


@functools.lru_cache(maxsize=2)
def counter(name: str) -> Counter:
    """One to a Python worker; the memo outlives the task."""
    return Counter(name)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text).

    A null or empty text has 0 bytes and 0 tokens.  Repeated rows give repeated rows, a null doc_id
    stays null, an empty table gives an empty one, other columns are not looked at.
    """

    def run(batches):
        count = counter(tokenizer).count
        for batch in common.byte_batches(batches, BATCH_BYTES):
            text = batch.column(1)
            n = count(text.to_pylist())
            yield common.record(SCHEMA, batch.column(0), pa.compute.binary_length(text).cast(pa.int64()), n, [x > limit for x in n])

    return common.id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.documents(spark, sf_dir))
