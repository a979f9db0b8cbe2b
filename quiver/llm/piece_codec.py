"""SentencePiece encoding and decoding through a distinct-chunk table.

No piece of the model holds a whitespace marker behind another character, or a
line feed, so no merge crosses the places before a run of markers or around a line
feed. A text is the sequence of its chunks between these places; the library
segments each distinct chunk once, and the ids and decoded strings of the chunks
are joined back by position. The table belongs to a task, which sees
its rows in Arrow batches; it is emptied when it holds too many characters, and long chunks pass it by, so
memory stays bounded on any input."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quiver.llm.common import spread_out, vocabulary

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
TABLE_CHARS, LONG_CHUNK = 24_000_000, 64


class Codec:
    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces):
            raise ValueError("this model's pieces can cross whitespace markers or line feeds")
        self.lead = len(self.sp.encode("\n"))
        self.table: dict[str, tuple[str, int, str]] = {}
        self.chars = 0

    def segment(self, chunks: list[str]) -> list[tuple[str, int, str]]:
        """Ids, their number and the decoded string of each chunk. A line feed goes in front, so that
        the library's own dummy marker does not touch the chunk, and comes off again."""
        out = []
        for ids in self.sp.encode(["\n" + c for c in chunks], num_threads=1):
            out.append((",".join(map(str, ids[self.lead:])), len(ids) - self.lead, self.sp.decode(ids)[1:]))
        return out

    def lookup(self, chunks: list[str]) -> list[tuple[str, int, str]]:
        if self.chars > TABLE_CHARS:
            self.table, self.chars = {}, 0
        new = [c for c in set(chunks) if c not in self.table]
        keep, found = {}, self.segment(new)
        for c, x in zip(new, found):
            if len(c) <= LONG_CHUNK:
                self.table[c] = x
                self.chars += len(c)
            else:
                keep[c] = x
        if not keep:
            return list(map(self.table.__getitem__, chunks))
        return [self.table.get(c) or keep[c] for c in chunks]

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and what they decode to."""
        if not text:
            return 0, "", ""
        found = self.lookup(CHUNK.findall(MARK + text.replace(" ", MARK)))
        ids, counts, strings = zip(*found)
        return sum(counts), ",".join(ids), "".join(strings)[1:]  # the dummy marker's space goes


def encode_rows(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text",
                with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and on request the ids and the decoded text. Null texts count as empty: no ids, empty text."""
    extra = ", ids array<int>, decoded string" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for b in batches:
            rows = [codec.encode(t or "") for t in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array([r[0] for r in rows], pa.int64())]
            for k in (1, 2):
                cols.append(pa.array([hashlib.sha256(r[k].encode()).hexdigest() for r in rows], pa.string()))
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array([[int(x) for x in r[1].split(",") if x] for r in rows], pa.list_(pa.int32())),
                         pa.array([r[2] for r in rows], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    src = spread_out(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + extra)


def op7(docs: DataFrame) -> DataFrame:
    return encode_rows(docs, vocabulary("piece_bpe_32k.model"))
