"""Exact token counts of whole texts with a sentencepiece model.

Texts of up to ``CHUNK`` code points are encoded whole.  Longer ones are encoded in overlapping
chunks with offsets, and neighbours are spliced at a stable common boundary inside the overlap: a
place that is proven to be a token boundary of the whole text, at which both encodings begin a
token, and from which on they agree as far as the overlap reaches.  When there is none, the overlap
widens, up to the rest of the text.

Where is a place proven?  When no piece of the vocabulary has a word-start mark anywhere but in its
leading run of marks, no merge can ever join a non-blank character to a blank that follows it.  Then
every such place is a token boundary of the whole text, and the tokens on both sides do not depend
on each other.  ``Counter`` proves this from the vocabulary before it relies on it; with another
vocabulary every text is encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

from .common import short_batches

LIMIT = 4096
#: Texts of more code points are encoded in overlapping chunks.
CHUNK = 4096
OVERLAP = 128
_MARK = "▁"


class Counter:
    def __init__(self, model: bytes, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.pieces = SentencePieceProcessor(model_proto=model)
        self.chunk, self.overlap = chunk, overlap
        n = self.pieces.get_piece_size()
        names = (self.pieces.id_to_piece(i) for i in range(n) if not (self.pieces.is_control(i) or self.pieces.is_byte(i) or self.pieces.is_unknown(i)))
        inner = all(_MARK not in x.lstrip(_MARK) for x in names)
        plain = self.pieces.encode("a b", out_type=str) == self.pieces.encode("a", out_type=str) + self.pieces.encode("b", out_type=str)
        spaced = len(self.pieces.encode(" ", out_type=str)) > 0 and "".join(self.pieces.encode("a  b ", out_type=str)) == f"{_MARK}a{_MARK}{_MARK}b{_MARK}"
        #: whether [not blank][blank] is a proven boundary
        self.proven = inner and plain and spaced
        self.blank = self.pieces.piece_to_id(_MARK) != self.pieces.unk_id()

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(text) <= self.chunk or not self.proven or not self.blank:
            return len(self.pieces.encode(text))
        return self._spliced(text.replace(_MARK, " "))  # the library writes blanks as marks, so both mean the same

    def _encoded(self, text: str, start: int, end: int, since: int) -> tuple[int, list[int]]:
        """The number of tokens of text[start:end], and where those from ``since`` on begin, last first.

        A chunk that is not the first starts at a blank, which the library puts before it anyway.
        Pieces are laid against the text from its end; where they are not its characters (bytes of
        unknown ones, normalised ones) the library's own offsets count.
        """
        skipped = 1 if start else 0
        part = text[start + skipped : end]
        found = self.pieces.encode(part, out_type=str)
        begins, place = [], end
        for piece in reversed(found):
            if place <= since:
                return len(found), begins
            surface = piece.replace(_MARK, " ")
            if not text.endswith(surface, start, place):
                break
            place -= len(surface)
            if place >= since:
                begins.append(place)
        if place == start or place < since:
            return len(found), begins
        return len(found), self._offsets(part, start, skipped, end, since)

    def _offsets(self, part: str, start: int, skipped: int, end: int, since: int) -> list[int]:
        raw = part.encode("utf-8", "surrogatepass")
        begins, at, place = [], len(raw), end
        found = self.pieces.encode(part, return_type="proto").pieces
        for i in range(len(found) - 1, -1, -1):
            if i:
                begin = found[i].begin  # in bytes
                place -= sum(b & 0xC0 != 0x80 for b in raw[begin:at])
                at = begin
            else:
                place = start
            if place < since:
                break
            begins.append(place)
        return begins

    def _spliced(self, text: str) -> int:
        """A splice is the last proven boundary in the overlap.  The tokens before it come from the left
        chunk, the rest from the right one, which starts there."""
        total, start, n = 0, 0, len(text)
        while True:
            overlap = self.overlap
            while True:
                end = start + self.chunk + overlap
                if end >= n:
                    return total + self._encoded(text, start, n, n)[0]
                low = max(start + 1, end - 2 * overlap)
                right = max(low, end - overlap)
                splice = self._boundary(text, low, right)
                if splice:
                    size, left = self._encoded(text, start, end, splice)
                    again = set(self._encoded(text, splice, min(n, end + overlap), splice)[1])
                    if left and left[-1] == splice and all(x in again for x in left if x < right):
                        total += size - len(left)
                        start = splice
                        break
                overlap *= 2  # no boundary there, or the encodings disagree

    @staticmethod
    def _boundary(text: str, low: int, high: int) -> int:
        """The last blank in [low, high) that a character other than a blank precedes, or 0."""
        at = text.rfind(" ", low, high)
        while at > low and text[at - 1] == " ":
            at -= 1
        return at if at >= low and at > 0 and text[at] == " " and text[at - 1] != " " else 0


@lru_cache(maxsize=2)
def counter(model: bytes) -> Counter:
    return Counter(model)


def token_counts(docs: DataFrame, model: bytes, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit.

    ``model`` is the serialised tokenizer (a file of fixed size, broadcast).  Null texts count as
    empty: no bytes, no tokens.  No begin, end or special tokens are added; such strings inside a
    text are ordinary text.  Long texts are read in chunks, so the encoder's memory is bounded while
    blanks occur.  Repeated rows are counted each by itself; null ids are kept; an empty table gives
    no rows.  Columns other than id and text are not read.  Narrow: no shuffle.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(shared.value).count
        for batch in batches:
            tokens = pa.array(map(count, batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), tokens], names=["id", "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    text = F.col(text_column).cast("string")
    counted = docs.select(F.col(id_column), text, F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).toDF("id", "text", "n").mapInArrow(run, schema)
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
