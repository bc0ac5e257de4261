"""SentencePiece encoding and decoding with a table of distinct chunks.

White space is written as a marker before the word that follows it. Where no piece of the vocabulary has a marker after
another character, no merge can reach over the place before a marker: a text is then a row of chunks (a run of markers
and what follows up to the next one), each of which is segmented on its own. Texts of a slice of rows share one table of
their distinct chunks: each chunk is segmented once, and its ids are put back by position.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.bpe import Encoded

MARK = "▁"
#: A run of spaces and what follows up to the next one; white space alone only at the end of a text.
CHUNK = re.compile(" *[^ ]+| +")
#: So many bytes of text are encoded together; a longer text is encoded alone.
AT_ONCE = 4 << 20


class Pieces:
    """One model file, ready to encode; kept by each Python worker. It remembers nothing of the texts it has met."""

    _made: dict[str, Pieces] = {}

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        shown = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        normal = [
            p for i, p in enumerate(shown)
            if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))
        ]
        #: Whether chunks may be told apart: no piece has a marker after another character, spaces stay as they are,
        #: and a text gets one marker in front.
        self.splits = not any(MARK in p.lstrip(MARK) for p in normal) and self._keeps_spaces()
        self.mark = self.model.piece_to_id(MARK)
        self.decimals = pa.array(map(str, range(len(shown))), pa.large_string())
        self.plain = np.array([not (self.model.is_control(i) or self.model.is_unknown(i)) for i in range(len(shown))])
        self.bytes = pa.array(
            [
                bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() * bool(self.plain[i])
                for i, p in enumerate(shown)
            ],
            pa.large_binary(),
        )

    def _keeps_spaces(self) -> bool:
        """Whether the file's own rules leave a text as it is, but for one marker in front."""
        texts = ("x", "  x   y ", "ﬁ é　", "\t\n")
        return all(self.model.normalize(t) == MARK + t.replace(" ", MARK) for t in texts)

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
        """The chunks of texts, the one marker that each begins with left out, and where each text's chunks begin."""
        if not self.splits:
            some = pc.not_equal(texts, "")
            return np.r_[0, np.cumsum(some.to_numpy(zero_copy_only=False))], texts.filter(some).dictionary_encode()
        texts = pc.replace_substring(texts, MARK, " ")
        runs = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " "))
        if not pc.any(runs).as_py():  # one space before each chunk: what stands between spaces is a chunk without it
            parts = pc.split_pattern(pc.if_else(pc.equal(texts, ""), None, texts), " ")
            sizes = pc.fill_null(pc.list_value_length(parts), 0).to_numpy()
            return np.r_[0, np.cumsum(sizes)], parts.flatten().dictionary_encode()
        found = [CHUNK.findall(" " + t) if t else [] for t in texts.to_pylist()]
        chunks = pa.array([c[1:] for c in chain.from_iterable(found)], pa.string())
        return np.cumsum([0, *map(len, found)]), chunks.dictionary_encode()

    def encode(self, texts: pa.Array) -> Encoded:
        """Texts as chunks, and the ids of each distinct chunk."""
        offsets, chunks = self.cut(texts)
        names = chunks.dictionary.to_pylist()
        # the library puts one marker before what it gets, but nothing before an empty string
        got = [ids or [self.mark] for ids in self.model.encode(names, num_threads=1)] if names else []
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))
        return Encoded(offsets, chunks.indices.to_numpy(), flat, sizes)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The decoded texts in UTF-8 of rows of ids, one after the other; ends: where each begins, and the last one's end.

        Ids are looked up as bytes and put together. Bytes that make no whole characters are left to the library.
        """
        shown = self.bytes.take(pa.array(ids))
        at = np.frombuffer(shown.buffers()[1], np.int64)[ends] if len(ids) else ends
        data = memoryview(shown.buffers()[2]) if len(ids) else b""
        out = []
        for k, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
            raw, own = bytes(data[a:b]), ids[ends[k] : ends[k + 1]]
            try:
                raw.decode()
                whole = self.plain[own].all()
            except UnicodeDecodeError:
                whole = False
            if whole and len(own) and not self.model.is_byte(int(own[0])):  # the marker in front of the first piece
                raw = raw.removeprefix(b" ")
            out.append(raw if whole else self.model.decode(own.tolist()).encode())
        return out

    def listed(self, e: Encoded) -> pa.Array:
        """Of each text its ids in decimal, with commas between them."""
        lists = pa.LargeListArray.from_arrays(e.ends, self.decimals.take(pa.array(e.ids())))
        return pc.binary_join(lists, pa.scalar(",", pa.large_string()))


def encode_and_decode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (the decoded text in UTF-8); with
    keep_ids also ids and decoded.

    A null text counts as empty: no tokens, hashes of the empty string. Nulls in other columns, repeated ids (ties), and
    further columns of any name change nothing: each row is encoded on its own. An empty table gives no rows. Very long
    texts are handled whole, with white space or without; memory is that of one Arrow batch and of the ids of one slice
    of AT_ONCE bytes, or of one longer text. A model whose pieces do cross markers is used on whole texts.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" * keep_ids
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            slices = np.cumsum(pc.binary_length(texts).to_numpy()) // AT_ONCE
            for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(slices)) + 1) if len(texts) else ():
                own = slice(int(rows[0]), int(rows[0]) + len(rows))
                e = pieces.encode(texts[own])
                ids = e.ids()
                decoded = pieces.decode(ids, e.ends)
                sha = [
                    pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in pieces.listed(e)], pa.string()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in decoded], pa.string()),
                ]
                columns = [b.column(0)[own], pa.array(e.counts(), pa.int64()), *sha]
                if keep_ids:
                    lists = pa.ListArray.from_arrays(pa.array(e.ends, pa.int32()), pa.array(ids.astype(np.int32)))
                    columns += [lists, pa.array([t.decode() for t in decoded], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])
        pa.default_memory_pool().release_unused()  # the worker lives on for other tasks

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
