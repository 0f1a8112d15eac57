"""Token counts by a sentencepiece model, with overlapping chunks for huge texts.

A huge text is encoded in chunks that overlap. Two neighbouring chunks are spliced at an offset
where both have a piece boundary that no merge can cross: before a space that follows another
character. No piece of the vocabulary holds a space mark after another character (checked when the
model is loaded), so whatever stands left of such a place cannot change the pieces right of it. When
an overlap holds no such place, it is widened, to the whole rest of the text if need be.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tracemill.llm import ship

CHUNK = 32_768
OVERLAP = 256
MARK = "▁"


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    stable = not any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size()))
    return model, stable


def _boundaries(model, text: str, start: int) -> dict[int, int]:
    """Offset in the whole text -> number of pieces of this chunk that begin before it.

    Only places where a piece begins are listed.
    """
    seen: dict[int, int] = {}
    for i, (begin, _) in enumerate(model.encode(text, return_type="offset_mapping")["offsets"]):
        seen.setdefault(start + begin, i)
    return seen


def spliced_count(model, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Pieces of ``text``, from chunks of ``chunk`` characters that overlap."""
    total, start, skip = 0, 0, 0  # skip: pieces of this chunk that lie before the last splice
    while True:
        stop = min(start + chunk, len(text))
        if stop == len(text):
            return total + len(model.encode(text[start:], return_type="numpy")) - skip
        left = _boundaries(model, text[start:stop], start)
        width, splice = overlap, None
        while splice is None:
            begin = max(start + 1, stop - width)
            following = text[begin : min(begin + chunk, len(text))]
            right = _boundaries(model, following, begin)
            for at in range(stop - 1, begin, -1):
                if text[at] == " " and text[at - 1] not in (" ", MARK) and at in left and at in right and left[at] >= skip:
                    splice = at
                    break
            else:
                if begin == start + 1:  # no common boundary in the whole chunk: take a longer one
                    chunk *= 2
                    break
                width *= 4
        if splice is None:
            continue
        total += left[splice] - skip
        skip, start = right[splice], begin


def _counter(path: str, chunk: int):
    model, stable = _model(path)

    def counts(texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if not stable or len(t) <= 2 * chunk]
        for i, ids in zip(short, model.encode([texts[i] for i in short], num_threads=1, return_type="numpy")):
            out[i] = len(ids)
        if stable:
            for i, t in enumerate(texts):
                if len(t) > 2 * chunk:
                    out[i] = spliced_count(model, t, chunk)
        return out

    return counts


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text.

    ``model_path`` must exist on every executor. A null or empty text has no bytes and no tokens.
    Repeated rows give repeated rows; other columns are not read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counter(model_path, chunk)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                texts = pc.fill_null(batch.column(1), "")
                n = pa.array(counts(texts.to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), n, pc.greater(n, limit)],
                    [id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
