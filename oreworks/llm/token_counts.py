"""Token counts: texts are encoded in batches inside Arrow functions that return lengths only.

Rows stay where they are; only texts go to a Python worker and only numbers come back. Within an Arrow batch, texts are
put into calls of the tokenizer by their bytes, so that many short texts cost one call and a few long ones don't pile up
token ids. A long text is cut where no piece of the vocabulary spans the cut: merges only ever make pieces of the
vocabulary, so both sides give the tokens that they give together, and memory follows the cuts and not the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from oreworks.llm.common import small_batches

#: The tokenizer's mark for a blank.
BLANK = "▁"
#: Stands before the later parts of a text. No piece may hold it, so nothing merges with it.
LEAD = "\n"


@dataclass(frozen=True)
class Settings:
    """model: a sentencepiece BPE model that leaves characters as they are. part: characters of a part, about.

    call_bytes: bytes of the parts that one call of the tokenizer gets, about. limit: tokens beyond which a text is marked.
    """

    model: str = public_tokenizers.path("piece_bpe_32k.model")
    part: int = 8192
    call_bytes: int = 1 << 18
    limit: int = 4096


class Counter:
    """Numbers of tokens of texts, without begin, end or other added tokens."""

    def __init__(self, settings: Settings = Settings()):
        self.settings = settings
        self.model = sentencepiece.SentencePieceProcessor(model_file=settings.model)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if self.model.normalize("AÅ  ½") not in ("AÅ  ½", f"{BLANK}AÅ{BLANK}{BLANK}½"):
            raise ValueError("texts can be cut for models only that don't normalise them")
        self.joined = {a + b for piece in pieces for a, b in zip(piece, piece[1:])}
        self.lead = len(self.model.encode(LEAD))
        if any(LEAD in piece for piece in pieces):
            raise ValueError("a piece of the vocabulary holds a line feed")

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts of about the set size, cut where no piece spans the cut. A stretch without such a place stays whole."""
        start, size = 0, self.settings.part
        while len(text) - start > size:
            cut = self._cut(text, start, start + size)
            if cut is None:
                break
            yield text[start:cut]
            start = cut
        yield text[start:]

    def _cut(self, text: str, start: int, near: int) -> int | None:
        free = lambda at: text[at - 1 : at + 1].replace(" ", BLANK) not in self.joined
        before = next((at for at in range(near, start, -1) if free(at)), None)
        return before or next((at for at in range(near + 1, len(text)) if free(at)), None)

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; none for NULL."""
        found = [0] * len(texts)
        call, owners, size = [], [], 0

        def encode() -> None:
            for k, ids in zip(owners, self.model.encode(call, num_threads=1)):
                found[k] += len(ids)

        for k, text in enumerate(texts):
            for number, part in enumerate(self.parts(text or "")):
                if number:
                    part = LEAD + part
                    found[k] -= self.lead
                call.append(part)
                owners.append(k)
                size += len(part.encode())
                if size >= self.settings.call_bytes:
                    encode()
                    call, owners, size = [], [], 0
        encode()
        return found


def token_count(text: Column, settings: Settings = Settings()) -> Column:
    """Number of tokens of a text, as a long."""

    @arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(settings)
        for batch in batches:
            yield pa.array(counter.counts(batch.to_pylist()), pa.int64())

    return count(text)


def count_tokens(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`docs` (with `text`; other columns stay) with `n_bytes`, `n_tokens` and `over_limit`.

    A NULL text is empty and has neither bytes nor tokens. Rows are counted one by one: NULL ids, repeated rows and very
    long texts are as good as others, and an empty table gives no rows. Columns of these three names are replaced.
    """
    small_batches(docs.sparkSession)
    return docs.withColumns(
        {"n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "n_tokens": token_count(F.col("text"), settings)}
    ).withColumn("over_limit", F.col("n_tokens") > settings.limit)
