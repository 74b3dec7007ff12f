"""Byte-level BPE encoding and decoding by tree concatenation.

A long text is halved until its pieces are short, wherever the halves fall; the pieces are
encoded in parallel tasks and joined again pairwise.  At a join the last tokens of the left
part and the first of the right are encoded anew as one window, which grows until its first
and last tokens are those both sides had already; from there on nothing can change.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest piece, in characters, that is encoded at once.
LEAF = 8192
#: Fixed values of the vocabulary file: the special text, its id, and the splitting pattern.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import json

        import tiktoken

        shown = byte_letters()
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        ranks = {bytes(shown[c] for c in token): i for token, i in vocabulary.items() if i != SPECIAL_ID}
        self.engine = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
        self.bytes = [b""] * (max(SPECIAL_ID, *vocabulary.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.bytes[SPECIAL_ID] = SPECIAL.encode()
        self.digits = [str(i).encode() for i in range(len(self.bytes))]

    def encode_piece(self, text: str) -> list[int]:
        return self.engine.encode(text, allowed_special="all") if SPECIAL in text else self.engine.encode_ordinary(text)

    def decode_bytes(self, ids) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids])

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        """The whole tree in one place, for texts that fit a task."""
        return self.join_all([self.encode_piece(p) for p in halves(text, leaf)])

    def join_all(self, parts: list[list[int]]) -> list[int]:
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of the two parts' joined text."""
        if not left or not right:
            return left or right
        width = 4
        while True:
            a, b = self.window_start(left, width), self.window_end(right, width)
            tail, head = left[a:], right[:b]
            window = self.encode_piece(self.decode_bytes(tail + head).decode("utf-8"))
            settled = min(2, len(tail) - 1, len(head) - 1)
            left_agrees = a == 0 or (settled > 0 and window[:settled] == tail[:settled])
            right_agrees = b == len(right) or (settled > 0 and window[-settled:] == head[-settled:])
            if left_agrees and right_agrees:
                return left[:a] + window + right[b:]
            width *= 2

    def window_start(self, left: list[int], width: int) -> int:
        """A token at which a character starts, and not a space run that looks back."""
        a = max(0, len(left) - width)
        while a > 0 and self.bytes[left[a]][0] & 0xC0 == 0x80:
            a -= 1
        return a

    def window_end(self, right: list[int], width: int) -> int:
        b = min(len(right), width)
        while b < len(right) and self.bytes[right[b]][0] & 0xC0 == 0x80:
            b += 1
        return b

    def digest(self, ids) -> str:
        digits = self.digits
        return hashlib.sha256(b",".join([digits[i] for i in ids])).hexdigest()


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for
    themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in plain):
        letters[chr(256 + n)] = b
    return letters


def halves(text: str, leaf: int = LEAF) -> list[str]:
    """The text cut into halves, and these again, until all are short; never inside the special text."""
    if len(text) <= leaf:
        return [text]
    cut = len(text) // 2
    inside = text.find(SPECIAL, max(0, cut - len(SPECIAL) + 1), cut + len(SPECIAL) - 1)
    if 0 <= inside < cut:
        cut = inside or len(SPECIAL)
    return [text] if cut >= len(text) else halves(text[:cut], leaf) + halves(text[cut:], leaf)


RESULT = "doc_id long, n_tokens long, ids array<int>"


def _encoded(codec: Codec, ids, tokens, digests: bool) -> pa.RecordBatch:
    columns = {"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array([len(t) for t in tokens], pa.int64())}
    if digests:
        columns["ids_sha256"] = pa.array([codec.digest(t) for t in tokens], pa.string())
        columns["decoded_sha256"] = pa.array([hashlib.sha256(codec.decode(t).encode()).hexdigest() for t in tokens], pa.string())
    else:
        columns["ids"] = pa.array(tokens, pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict(columns)


def encode_documents(docs: DataFrame, vocabulary: str, digests: bool = False, leaf: int = LEAF, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) per document, or digests of ids and of the decoded text instead of ids.

    A null text counts as empty and has no tokens.  Rows that repeat an id and a text give as
    many equal rows.  ``vocabulary`` is a file every executor can read, such as one that an
    installed package brings.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else RESULT
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def short(batches):
        codec = Codec(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                tokens = [codec.encode_piece(t) for t in part.column(1).to_pylist()]
                yield _encoded(codec, part.column(0), tokens, digests)

    def cut(batches):
        for batch in batches:
            for key, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = halves(whole, leaf)
                sha = hashlib.sha256(whole.encode()).digest()
                for at in range(0, len(parts), 256):
                    few = parts[at : at + 256]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([key] * len(few), pa.int64()), "sha": pa.array([sha] * len(few), pa.binary()),
                        "nth": pa.array(range(at, at + len(few)), pa.int32()), "piece": pa.array(few, pa.string()),
                    })

    def piece(batches):
        codec = Codec(vocabulary)
        for batch in batches:
            tokens = [codec.encode_piece(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(tokens, pa.list_(pa.int32()))], ["doc_id", "sha", "nth", "ids"])

    def tree(table):
        codec = _codec(vocabulary)
        nth = table.column("nth").to_pylist()
        parts = dict(zip(nth, table.column("ids").to_pylist()))
        tokens = codec.join_all([parts[i] for i in sorted(parts)])
        copies = nth.count(0)
        return pa.Table.from_batches([_encoded(codec, [table.column("doc_id")[0].as_py()] * copies, [tokens] * copies, digests)])

    long = F.length("text") > leaf
    spread = rows.filter(long).mapInArrow(cut, "doc_id long, sha binary, nth int, piece string").repartition(F.xxhash64("sha", "nth"))
    joined = spread.mapInArrow(piece, "doc_id long, sha binary, nth int, ids array<int>").groupBy("doc_id", "sha").applyInArrow(tree, schema)
    return rows.filter(~long).mapInArrow(short, schema).unionByName(joined)


_open: dict[str, Codec] = {}


def _codec(vocabulary: str) -> Codec:
    """One codec per task: groups of a task share it."""
    if vocabulary not in _open:
        _open[vocabulary] = Codec(vocabulary)
    return _open[vocabulary]


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); bytes that are no valid UTF-8 become U+FFFD, null ids an empty text."""

    def decode(batches):
        codec = Codec(vocabulary)
        for batch in batches:
            texts = [codec.decode(t or []) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(decode, "doc_id long, text string")
