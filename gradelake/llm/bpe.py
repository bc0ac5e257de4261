"""BPE encoding and decoding with forced-boundary splitting.

Every merge makes a vocabulary token, so two neighbouring bytes that stand side by side inside no token are never merged over: between them is a
certain cut. Words are split there, the fragments are encoded on their own (each once a slice of rows, by the vocabulary's own merges), and the ids
are concatenated. The vocabulary comes from a tokenizers file with BPE and an end-of-word suffix; its own normalizer and pre-tokenizer define the words.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of these characters only are the same before and after NFC and are lower-cased letter by letter; others take the file's own normalizer.
PLAIN = re.compile(r"[\x00-\x1b\x20-~À-ÖØ-öø-ÿ]*\Z")
#: For plain lower-case texts, what the file's splitting pattern matches.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+")
#: Stands before the id of a special token among the words of a text; bytes that no UTF-8 text holds.
SPECIAL = b"\xff\xff"
#: So many bytes of text are encoded together; a longer text is encoded alone.
AT_ONCE = 4 << 20


def gathered(values: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Runs of values, of these sizes one after the other, put together in the order of codes."""
    start, size = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
    return values[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each run of values, of these sizes one after the other, the sum."""
    ends = np.cumsum(sizes)
    total = np.r_[0, np.cumsum(values)]
    return total[ends] - total[ends - sizes]


def laid_out(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary values without nulls, one after the other, and where each begins; the end of the last."""
    ends = np.r_[0, np.cumsum(pc.binary_length(strings).to_numpy())].astype(np.int32)
    if not ends[-1]:
        return np.zeros(0, np.uint8), ends
    first = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset]
    return np.frombuffer(strings.buffers()[2], np.uint8)[first : first + ends[-1]], ends


@dataclass
class Encoded:
    """Texts as pieces: text i has the pieces codes[offsets[i]:offsets[i + 1]]; of piece c there are sizes[c] ids, and flat holds those of all pieces."""

    offsets: np.ndarray
    codes: np.ndarray
    flat: np.ndarray
    sizes: np.ndarray

    @cached_property
    def ends(self) -> np.ndarray:
        """Of each text, how many ids it and the texts before have; a leading 0."""
        return np.r_[0, np.cumsum(self.sizes[self.codes])][self.offsets]

    def counts(self) -> np.ndarray:
        return np.diff(self.ends)

    def ids(self) -> np.ndarray:
        """The ids of all texts, one after the other."""
        return gathered(self.flat, self.sizes, self.codes)

    def joined(self, shown: pa.Array) -> pa.Array:
        """Of each text its ids as shown[id], with a space between them."""
        return pc.binary_join(pa.LargeListArray.from_arrays(self.ends, shown.take(pa.array(self.ids()))), pa.scalar(" ", pa.large_string()))


class Encoder:
    """One tokenizers file, ready to encode; kept by each Python worker. It remembers nothing of the texts it has met."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        self.whole = Tokenizer.from_file(path)
        vocab, merges = model["vocab"], [tuple(m) for m in model["merges"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the printable bytes stand for themselves, the others follow from 256 on
        rest = [b for b in range(256) if b not in set(shown)]
        self.char = {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(rest)}}
        self.byte = {c: b for b, c in self.char.items()}
        self.joined = np.zeros((256, 256), bool)  # which bytes stand side by side in some token
        for token in vocab:
            t = [self.byte[c] for c in token.removesuffix(suffix)]
            self.joined[t[:-1], t[1:]] = True
        self.inner, self.last = (Tokenizer(models.BPE(vocab, merges, **end)) for end in ({}, {"end_of_word_suffix": suffix}))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in (vocab | self.special).items()}
        self.tokens = pa.array([tokens.get(i, "") for i in range(max(tokens) + 1)], pa.large_string())
        self.ending = np.zeros(len(self.tokens), bool)
        self.ending[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.decimals = pa.array(map(str, range(len(self.tokens))), pa.large_string())
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def fragments(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The fragments of words (as bytes), and how many each word has."""
        data, ends = laid_out(words)
        cuts = np.flatnonzero(~self.joined[data[:-1], data[1:]]) + 1
        every = np.union1d(ends, cuts)
        parts = pa.BinaryArray.from_buffers(pa.binary(), len(every) - 1, [None, pa.py_buffer(every.astype(np.int32)), pa.py_buffer(data)])
        return parts, np.diff(np.searchsorted(every, ends))

    def merged(self, fragments: pa.Array, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of fragments (as bytes; last: of those at the end of a word), each encoded independently: all ids, and how many each has."""
        if not len(fragments):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        data, ends = laid_out(fragments)
        chars, ends = data.tobytes().decode("latin-1").translate(self.char), ends.tolist()
        parts = [chars[a:b] for a, b in zip(ends, ends[1:])]
        if last:  # one call for all of them: the one token with the end-of-word suffix is a fragment's last
            ids = np.array(self.last.encode_batch_fast([parts], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            return ids, np.diff(np.flatnonzero(self.ending[ids]) + 1, prepend=0)
        got = [e.ids for e in self.inner.encode_batch_fast(parts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), np.uint32), np.array(list(map(len, got)))

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words (as bytes): all ids, and how many each has."""
        parts, n = self.fragments(words)
        last = np.zeros(len(parts), bool)
        last[np.cumsum(n) - 1] = True
        ids, sizes, number = [], [], np.zeros(len(parts), np.int64)
        for kind in (True, False):
            own = parts.filter(pa.array(last == kind)).dictionary_encode()
            number[last == kind] = own.indices.to_numpy() + sum(map(len, sizes))
            some, size = self.merged(own.dictionary, kind)
            ids.append(some)
            sizes.append(size)
        flat, size = np.concatenate(ids), np.concatenate(sizes)
        return gathered(flat, size, number), sums(size[number], n)

    def is_plain(self, text: str) -> bool:
        return bool(PLAIN.match(text)) and not (self.cut_special and "<|" in text and self.cut_special.search(text))

    def encode(self, texts: pa.Array, plain: bool) -> Encoded:
        """Texts that are all plain, or all not. Pieces are what stands between white space in plain texts, words and special tokens in others."""
        if plain:
            cut = pc.ascii_split_whitespace(pc.utf8_lower(texts))
            offsets, pieces = cut.offsets.to_numpy() - cut.offsets[0].as_py(), cut.flatten()
            some = pc.not_equal(pieces, "")  # white space at an end leaves an empty string
            offsets = np.r_[0, np.cumsum(some.to_numpy(zero_copy_only=False))][offsets]
            pieces = pieces.filter(some).dictionary_encode()
            codes, names = pieces.indices.to_numpy(), pieces.dictionary
            letters = pc.utf8_is_alpha(names).to_numpy(zero_copy_only=False)
            mixed = list(map(WORDS.findall, names.filter(pa.array(~letters)).to_pylist()))
            n = np.ones(len(names), np.int64)
            n[~letters] = list(map(len, mixed))
            words = pa.concat_arrays([names.filter(pa.array(letters)), pa.array(chain.from_iterable(mixed), pa.string())]).cast(pa.binary()).dictionary_encode()
            flat, sizes = self.encode_words(words.dictionary)
            number = words.indices.to_numpy()
            at = np.r_[np.flatnonzero(letters), np.repeat(np.flatnonzero(~letters), n[~letters])]
            number = number[np.argsort(at, kind="stable")]  # words in the order of their pieces
            return Encoded(offsets, codes, gathered(flat, sizes, number), sums(sizes[number], n))
        cut = list(map(self._cut, texts.to_pylist()))
        offsets, pieces = np.cumsum([0, *map(len, cut)]), pa.array(chain.from_iterable(cut), pa.binary()).dictionary_encode()
        special = pc.starts_with(pieces.dictionary, SPECIAL).to_numpy(zero_copy_only=False)
        flat, sizes = self.encode_words(pieces.dictionary.filter(pa.array(~special)))
        flat = np.r_[flat, [int(p[len(SPECIAL) :]) for p in pieces.dictionary.filter(pa.array(special)).to_pylist()]].astype(np.uint32)
        sizes = np.r_[sizes, np.ones(special.sum(), np.int64)]
        place = np.argsort(np.argsort(special, kind="stable"), kind="stable")
        return Encoded(offsets, place[pieces.indices.to_numpy()], flat, sizes)

    def _cut(self, text: str) -> list[bytes]:
        if self.cut_special and self.cut_special.search(text):
            parts = self.cut_special.split(text)
            return [p for i, x in enumerate(parts) for p in ([SPECIAL + b"%d" % self.special[x]] if i % 2 else self._cut(x))]
        return [bytes(map(self.byte.__getitem__, w)) for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(text))]

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder: tokens joined by a space, as the library does then."""
        return " ".join(self.tokens.take(pa.array(ids, pa.int64())).to_pylist())


@contextmanager
def without_collector() -> Iterator[None]:
    """Pause the search for cycles: millions of tuples of ids hold none, and looking through them takes most of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def with_tokens(
    docs: DataFrame, path: str, columns: list[str], schema: str, make: Callable[[Encoded, pa.RecordBatch], pa.RecordBatch], text_col: str = "text"
) -> DataFrame:
    """columns and the text of docs through make(encoded texts, their rows). Rows may change their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for b in batches:
            texts = pc.fill_null(b.column(len(columns)), "")
            slices = np.cumsum(pc.binary_length(texts).to_numpy()) // AT_ONCE
            for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(slices)) + 1) if len(texts) else ():
                part, own = b.slice(int(rows[0]), len(rows)), texts.slice(int(rows[0]), len(rows))
                plain = pa.array([encoder.is_plain(t) for t in own.to_pylist()], pa.bool_())
                for kind, some in ((True, plain), (False, pc.invert(plain))):
                    if pc.any(some).as_py():
                        with without_collector():
                            out = make(encoder.encode(own.filter(some), kind), part.filter(some))
                        yield out
        pa.default_memory_pool().release_unused()  # the worker lives on for other tasks

    return docs.select(*columns, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256 (the decoded text in UTF-8); with keep_ids also ids and decoded.

    A null text counts as empty: no tokens, hashes of the empty string. Nulls in other columns, repeated ids, and further columns of any name change
    nothing: each row is encoded on its own. An empty table gives no rows. Very long texts are handled whole; memory is that of one Arrow batch and
    of the ids of one slice of AT_ONCE bytes, or of one longer text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def make(e: Encoded, b: pa.RecordBatch) -> pa.RecordBatch:
        encoder = Encoder.of(path)
        decimal, decoded = e.joined(encoder.decimals), e.joined(encoder.tokens)
        sha = [pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts], pa.string()) for texts in (decimal, decoded)]
        columns, names = [b.column(0), pa.array(e.counts(), pa.int64()), *sha], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            ids = pa.ListArray.from_arrays(pa.array(e.ends, pa.int32()), pa.array(e.ids().astype(np.int32)))
            columns, names = [*columns, ids, decoded.cast(pa.string())], [*names, "ids", "decoded"]
        return pa.RecordBatch.from_arrays(columns, names)

    return with_tokens(docs, path, [id_col], schema, make, text_col)
