"""Problem 6: token ids of every text by a public byte-level vocabulary, long texts by tree concatenation."""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts with more code points are encoded in pieces of at most half as many, by different tasks.
LONG_TEXT = 32_768
#: Tokens on either side of a join that are encoded again at first; doubled until both sides agree.
WINDOW = 32
#: Bytes of a word that spans a join from which on its halves are joined rather than encoded again.
LONG_WORD = 256
#: A split pattern looks ahead by one character after a run of one kind, and over contractions of up to so many characters.
_AHEAD = 4


def public_vocabulary(name: str = "byte_bpe_50k") -> tuple[str, bytes]:
    """Split pattern and ranks file of an installed public vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:
        return public_tokenizers.PATTERN, file.read()


@dataclass
class Piece:
    """Consecutive text with its ids. ``safe`` begins a word of the split pattern whatever text follows, ``last`` the last word."""

    text: str
    ids: np.ndarray
    safe: int = 0
    last: int = 0


class Encoder:
    """A byte-level vocabulary: exact encoding of whole texts and joining of encoded neighbours."""

    def __init__(self, pattern: str, ranks: bytes):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self._encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self._words = regex.compile(pattern)
        self._bytes: list[bytes] = [b""] * (max(table.values()) + 1)
        for token, number in table.items():
            self._bytes[number] = token
        self.widths = np.array([len(x) for x in self._bytes])
        #: Bytes encoded as parts of words so far: what joins cost.
        self.encoded = 0

    def encode(self, text: str) -> np.ndarray:
        """Token ids; special tokens' strings are ordinary text."""
        return np.array(self._encoding.encode_ordinary(text), np.int32)

    def _word(self, word: bytes) -> np.ndarray:
        self.encoded += len(word)
        return np.array(self._encoding._core_bpe.encode_single_piece(word), np.int32)

    def piece(self, text: str) -> Piece:
        """A piece that is to be joined with others."""
        starts = [m.start() for m in self._words.finditer(text)]
        return Piece(text, self.encode(text), _safe_start(text, starts), starts[-1] if starts else 0)

    def join(self, left: Piece, right: Piece, window: int = WINDOW) -> Piece:
        """The piece of both texts one after the other, as if it had been encoded whole.

        The words around the join are found from the last safe start in ``left`` on, until one ends where a word
        of ``right`` ends: from there on both splits are the same, as a pattern without lookbehind sees nothing
        of what is before. These words are encoded anew. A long word that spans the join is not: its halves'
        ids are joined by :meth:`join_word`.
        """
        if not left.text or not right.text:
            return right if not left.text else left
        seam = len(left.text) - left.safe
        tail = left.text[left.safe :] + right.text
        here, there = self._words.finditer(tail), self._words.finditer(right.text)
        words: list[tuple[int, int]] = []
        at, other, first_end = 0, seam, None
        while at != other:
            if at < other:
                word = next(here)
                words.append(word.span())
                at = word.end()
            else:
                other = seam + next(there).end()
                first_end = first_end or other
        left_ends = len(left.ids) - self._count(left.ids[::-1], len(left.text[left.safe :].encode()))
        skipped = self._count(right.ids, len(right.text[: at - seam].encode()))
        middle = []
        for start, end in words:
            whole = start < seam < end and start + left.safe == left.last and end == first_end
            if whole and end - start > LONG_WORD:
                known = len(left.ids) - self._count(left.ids[::-1], len(tail[start:seam].encode()))
                middle.append(self.join_word(left.ids[known:], right.ids[:skipped], window))
            else:
                middle.append(self._word(tail[start:end].encode()))
        ids = np.concatenate([left.ids[:left_ends], *middle, right.ids[skipped:]])
        shift, after = len(left.text), at - seam
        last = shift + right.last if right.last >= after else left.safe + words[-1][0]
        safe = shift + right.safe if right.safe and right.safe >= after else left.safe + _safe_start(tail, [x for x, _ in words] + [at] * (at < len(tail)))
        return Piece(left.text + right.text, ids, safe, last)

    def join_word(self, left: np.ndarray, right: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """Ids of one word from the ids of its two halves.

        A growing window of tokens around the join is encoded again until its first token is the known one on
        the left and its last the known one on the right. That proves the result: ids are those of a word if and
        only if every two neighbours among them are what these two encode to, and all of them are neighbours in
        one of the three encodings.
        """
        while True:
            head, tail = max(0, len(left) - window), min(len(right), window)
            middle = self._word(b"".join(self._bytes[i] for i in (*left[head:], *right[:tail])))
            if (head == 0 or middle[0] == left[head]) and (tail == len(right) or middle[-1] == right[tail - 1]):
                return np.concatenate([left[:head], middle, right[tail:]])
            window *= 2

    def _count(self, ids: np.ndarray, size: int) -> int:
        """How many ids make up the first ``size`` bytes."""
        ends = np.cumsum(self.widths[ids])
        place = int(np.searchsorted(ends, size)) + 1 if size else 0
        if size and ends[place - 1] != size:
            raise ValueError("no token ends where a word does")
        return place

    def encode_tree(self, text: str, limit: int, window: int = WINDOW) -> np.ndarray:
        """Like :meth:`encode`, from parts of at most ``limit`` code points that are joined as a tree."""
        limit = max(1, limit)
        return self.join_all([self.piece(text[i : i + limit]) for i in range(0, len(text), limit)], window)

    def join_all(self, parts: list[Piece], window: int = WINDOW) -> np.ndarray:
        """Ids of consecutive pieces, joined in pairs as a balanced tree."""
        while len(parts) > 1:
            parts = [self.join(a, b, window) for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) - len(parts) % 2 :]
        return parts[0].ids if parts else np.empty(0, np.int32)


def _safe_start(text: str, starts: list[int]) -> int:
    """The last of some ascending word starts that no text to come can move; the first character if there is none.

    The word before it ends in something other than white space, as the end of white space depends on what follows,
    and begins far enough from the end of the text for nothing to be looked for beyond it.
    """
    for before, start in zip(starts[-2::-1], starts[:0:-1], strict=True):
        if start < len(text) and before <= len(text) - _AHEAD and not text[start - 1].isspace():
            return start
    return 0


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder per Python worker; the cache is keyed by the broadcast it was made from."""
    if shared.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.id] = Encoder(*shared.value)
    return _ENCODERS[shared.id]


class _Shared:
    def __init__(self, broadcast, number: int):
        self.broadcast, self.id = broadcast, number

    @property
    def value(self):
        return self.broadcast.value


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))


def _encode_rows(shared, rows: int = 256):
    """Ids in place of the last column's texts."""

    def run(batches):
        encode: Callable[[str], np.ndarray] = _encoder(shared).encode
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = _lists([encode(t) if t else np.empty(0, np.int32) for t in part.columns[-1].to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*part.schema.names[:-1], "ids"])

    return run


_PIECES = "doc_id bigint, row bigint, piece int, text string, ids array<int>, safe int, last int"


def _encode_pieces(shared, rows: int = 64):
    def run(batches):
        piece = _encoder(shared).piece
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                own = [piece(t) for t in part.columns[-1].to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, _lists([x.ids for x in own]), pa.array([x.safe for x in own], pa.int32()), pa.array([x.last for x in own], pa.int32())], names=[*part.schema.names, "ids", "safe", "last"])

    return run


def _join_pieces(shared):
    def run(table: pa.Table) -> pa.Table:
        # rows of one key: pieces are told apart by the row they come from
        order = np.lexsort((table["piece"].to_numpy(), table["row"].to_numpy()))
        rows, texts, ids = table["row"].to_numpy()[order], table["text"].to_pylist(), table["ids"]
        safe, last = table["safe"].to_pylist(), table["last"].to_pylist()
        out = [_encoder(shared).join_all([Piece(texts[i], ids[int(i)].values.to_numpy(), safe[i], last[i]) for i in order[rows == row]]) for row in np.unique(rows)]
        return pa.table({"doc_id": pa.array([table["doc_id"][0].as_py()] * len(out), pa.int64()), "ids": _lists(out)})

    return run


def token_ids(documents: DataFrame, vocabulary: tuple[str, bytes] | None = None, long_text: int = LONG_TEXT) -> DataFrame:
    """``(doc_id, ids ARRAY<INT>)`` of every row of ``documents`` (``doc_id, text``), without special tokens.

    A null or empty text has the empty list. Texts up to ``long_text`` code points are encoded where they
    are read. Longer ones are cut into pieces that different tasks encode, and the pieces are joined as a
    tree, see :meth:`Encoder.join`; the result is that of encoding the whole text. ``vocabulary`` is a split
    pattern and the content of a ranks file (default: the public byte_bpe_50k). Rows with a null ``doc_id``
    are kept; repeated rows give a row each. Other columns are ignored. An empty table gives no rows.
    """
    spark = documents.sparkSession
    content = vocabulary or public_vocabulary()
    shared = _Shared(spark.sparkContext.broadcast(content), hash(content))
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = F.coalesce(F.length("text"), F.lit(0))
    short = source.where(size <= long_text).mapInArrow(_encode_rows(shared), "doc_id bigint, ids array<int>")
    piece = max(1, long_text // 2)
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / piece).cast("int"))
    cut = source.where(size > long_text).withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", F.posexplode(F.transform(starts, lambda i: F.substring("text", i * piece + 1, F.lit(piece)))).alias("piece", "text"))
    encoded = cut.repartition("doc_id", "row", "piece").select("doc_id", "row", "piece", "text").mapInArrow(_encode_pieces(shared), _PIECES)
    whole = encoded.groupBy("doc_id", "row").applyInArrow(_join_pieces(shared), "doc_id bigint, ids array<int>")
    return short.unionByName(whole)
