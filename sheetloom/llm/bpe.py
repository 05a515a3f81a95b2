"""BPE encoding and decoding through a table of distinct words.

Words are cut out of whole Arrow batches, every distinct word is encoded once, and
ids are joined back by word position. Decoding joins ids to their pieces.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._util import WHITE, slices, text_buffers


def white_space_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, and the number of words before each text.

    Right for tokenizers that drop white space and never merge across it.
    """
    plain = ~WHITE[data]
    first = plain.copy()
    first[1:] &= ~plain[:-1]
    starts_of_texts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts_of_texts] = plain[starts_of_texts]
    starts = np.flatnonzero(first)
    kept = np.flatnonzero(first[plain])
    packed = data[plain]
    bounds = np.append(kept, len(packed)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(kept), [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
    return words, np.searchsorted(starts, offsets)


def spaced_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Cut before every single space between two characters that are not white space.

    A byte-level BPE that splits words with their leading space always splits there,
    so pieces can be encoded apart; longer runs of white space are never cut.
    """
    n = len(data)
    cut = np.zeros(n, dtype=bool)
    if n > 2:
        plain = ~WHITE[data]
        cut[1:-1] = (data[1:-1] == 0x20) & plain[:-2] & plain[2:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    cut[inner - 1] = False  # a space that ends its text
    cut[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(cut)
    bounds = np.append(starts, n).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]), np.searchsorted(starts, offsets)


class WordTable:
    """Ids of distinct words, each encoded once; emptied when it holds ``most`` words."""

    def __init__(self, path: str, most: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def _add(self, new: list[bytes]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self._put(new, np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum())), lengths)

    def _put(self, new: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.flat = np.concatenate([self.flat, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids before each word."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.place) + len(distinct) > self.most:
            self._clear()
        self._add([w for w in distinct if w not in self.place])
        at = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        lengths = self.ends[at + 1] - self.ends[at]
        before = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[np.repeat(self.ends[at] - before[:-1], lengths) + np.arange(before[-1])], before

    def pieces(self) -> pa.Array:
        """The piece of every id of the vocabulary."""
        size = self.tokenizer.get_vocab_size()
        return pa.array([self.tokenizer.id_to_token(i) or "" for i in range(size)])


class ByteWordTable(WordTable):
    """The same for a byte-level BPE whose ids follow its merges, over pieces of spaced_pieces.

    Plain pieces (a space, then anything but white space at the end, letters up to
    U+01FF, no special token) are encoded in one run by the same merges, and the run is
    cut by the byte lengths of its ids; other pieces go through the tokenizer one by one.
    """

    #: Fixed value: the published pattern of this kind of tokenizer.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str, most: int = 250_000):
        import tiktoken

        super().__init__(path, most)
        # bytes that print stand for themselves in a piece, the others for 256 and up in order
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in self.tokenizer.get_vocab().items() if piece not in special}
        self.special = [t.encode() for t in special]
        self.run = tiktoken.Encoding("merges", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.width[i] = len(piece)

    def _plain(self, w: bytes) -> bool:
        return w[:1] == b" " and w[-1] > 0x20 and (w.isascii() or max(w) < 0xC8) and not any(t in w for t in self.special)

    def _add(self, new: list[bytes]) -> None:
        plain = [w for w in new if self._plain(w)]
        if plain:
            ids = np.array(self.run.encode_ordinary(b"".join(plain).decode()), np.uint32)
            ends = np.cumsum(self.width[ids])
            bounds = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))
            cuts = np.searchsorted(ends, bounds, side="left") + 1
            if (ends[cuts - 1] == bounds).all():
                self._put(plain, ids, np.diff(cuts, prepend=0))
            else:  # an id spans two pieces
                plain = []
        done = set(plain)
        super()._add([w for w in new if w not in done])


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text under a BPE that drops white space; null texts have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(path)
        for part in slices(batches, "text"):
            data, offsets = text_buffers(part.column("text"))
            words, first = white_space_words(data, offsets)
            ids, before = table.ids(words)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(before[first].astype(np.int32)), pa.array(ids.view(np.int32)))], ["id", "ids"])

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded", glue: str = " ") -> DataFrame:
    """Add the text of ``ids_col``: each id is joined to its piece and the pieces to a text.

    ``glue`` stands between pieces, as in a tokenizer file that names no decoder. Null
    ids give a null text, no ids an empty one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = WordTable(path).pieces()
        for batch in batches:
            ids = batch.column(ids_col)
            lists = pa.ListArray.from_arrays(ids.offsets, pieces.take(ids.values), mask=ids.is_null() if ids.null_count else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.binary_join(lists, glue)], [*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of the decoded text, for every row of documents.

    A null or empty text has no ids and decodes to an empty one; rows that repeat are
    encoded each on its own, and null ids are kept. Texts are cut nowhere, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(path)
        pieces = table.pieces()
        for part in slices(batches, "text", 4 << 20):
            data, offsets = text_buffers(part.column("text"))
            words, first = white_space_words(data, offsets)
            ids, before = table.ids(words)
            bounds = before[first]
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pieces.take(pa.array(ids))), " ")
            raw = memoryview(ids.astype("<u4").tobytes())
            chars, at = text_buffers(texts)
            chars = memoryview(np.ascontiguousarray(chars))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(bounds)),
                    pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.string()),
                    pa.array([hashlib.sha256(chars[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
