"""Byte-level BPE: merges by a priority queue of ranks over a doubly linked list of symbols, and decoding.

The encoder cuts a text at special tokens, then at white space, then by the vocabulary's own pattern; the bytes of
every piece form a linked list, a heap holds the ranks of neighbouring pairs, and the lowest rank, leftmost first,
is merged; entries whose symbols have changed since are stale and skipped. Decoding joins the byte strings of the
vocabulary. Workers keep the ids of chunks they have met, since words recur, up to a fixed number and a fixed number of bytes:
a chunk is kept among the recent ones, and for longer when it is met again there, so that chunks met once do not displace words.

Null and empty texts have no ids and decode to the empty text. Texts of any length are encoded whole. Repeated
rows give equal rows; null ids stay null; a table without rows gives none; other columns are left alone, whatever their
names. A tokenizer file with another normaliser, pattern or model is an error, since it would be encoded wrongly. The file is read on the driver and broadcast (a few MB, whatever the input).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from sys import getsizeof

import pandas as pd
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexmat.llm.common import kept_in_worker

#: Fixed value: white space as the tokenizer patterns understand it (Unicode White_Space).
SPACES = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Fixed value: the pattern that cuts text before byte-level merges.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: Latin letters: a run of them that ends before an ASCII character that is no letter, or at the text's end, is a piece of its own.
LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u02af"
#: A space goes with the word after it, marks behind a Latin word are cut from it; the last of other white space before a word stands alone.
CHUNKS = re.compile(f" ?[{LATIN}]++(?![^\x00-\x7f])| ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: Chunks longer than this are not kept.
KEEP_CHARS = 64
#: A worker's kept chunks and their ids take this many bytes at most, whatever the texts: the executor's memory holds them too.
KEEP_BYTES = 48 << 20
#: Fixed value: bytes of a dict for each entry, at most, beside the strings.
ENTRY_BYTES = 64


#: What the tokenizer file says of the kind that is encoded here.
_KIND = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    rest = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in plain)}
    return [chr(rest.get(b, b)) for b in range(256)]


class ByteBPE(dict):
    """A tokenizer. As a dict it maps a chunk of text to its ids as decimal text, and fills itself."""

    def __init__(self, definition: str, most: int = 900_000, most_bytes: int = KEEP_BYTES):
        super().__init__()
        spec = json.loads(definition)
        model, self.most, self.most_bytes = spec["model"], most, most_bytes
        self.recent: dict[str, str] = {}
        self.bytes = self.recent_bytes = 0
        if {k: spec[k] for k in _KIND} != _KIND or any(model.get(k) != v for k, v in _MODEL.items()):
            raise ValueError("not a plain byte-level tokenizer")
        vocab = model["vocab"]
        self.byte_ids = [vocab[c] for c in byte_alphabet()]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[left] << 32 | vocab[right], len(self.made))
            self.made.append(vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        of_char = {c: b for b, c in enumerate(byte_alphabet())}
        strings = {i: bytes(of_char[c] for c in t) for t, i in vocab.items() if t not in self.special}
        strings |= {i: t.encode() for t, i in self.special.items()}
        self.strings = {str(i): s for i, s in strings.items()}
        self.pieces = regex.compile(PIECES)

    def merge(self, ids: list[int]) -> list[int]:
        """The ids of one piece after all merges."""
        n = len(ids)
        if n < 2:
            return ids
        get, made = self.ranks.get, self.made
        heap = [rank * n + k for k in range(n - 1) if (rank := get(ids[k] << 32 | ids[k + 1])) is not None]
        if not heap:
            return ids
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            rank, k = divmod(pop(heap), n)
            right = after[k]
            if ids[k] < 0 or right >= n or get(ids[k] << 32 | ids[right]) != rank:
                continue  # stale: a symbol of the pair has gone or changed
            ids[k], ids[right] = made[rank], -1
            after[k] = end = after[right]
            if end < n:
                before[end] = k
                if (r := get(ids[k] << 32 | ids[end])) is not None:
                    push(heap, r * n + k)
            if (left := before[k]) >= 0 and (r := get(ids[left] << 32 | ids[k])) is not None:
                push(heap, r * n + left)
        return [i for i in ids if i >= 0]

    def __missing__(self, chunk: str) -> str:
        if (known := self.recent.get(chunk)) is not None:
            return self.keep(chunk, known, again=True)
        pieces = self.pieces.findall(chunk)
        if len(pieces) > 1:  # a word and the marks around it, each of which may be known
            return self.keep(chunk, ",".join(map(self.__getitem__, pieces)))
        of_byte = self.byte_ids
        return self.keep(chunk, ",".join(map(str, self.merge([of_byte[b] for b in chunk.encode()]))))

    def keep(self, chunk: str, ids: str, again: bool = False) -> str:
        if len(chunk) > KEEP_CHARS:
            return ids
        size = getsizeof(chunk) + getsizeof(ids) + ENTRY_BYTES
        if again:
            del self.recent[chunk]
            self.recent_bytes -= size
            if self.full(len(self), self.bytes + size):  # all have to be met once more to stay
                self.recent, self.recent_bytes, self.bytes = dict(self), self.bytes, 0
                self.clear()
            self[chunk] = ids
            self.bytes += size
        else:
            if self.full(len(self.recent), self.recent_bytes + size):
                self.recent.clear()
                self.recent_bytes = 0
            self.recent[chunk] = ids
            self.recent_bytes += size
        return ids

    def full(self, number: int, size: int) -> bool:
        """Whether one of the two dicts has no room for one more chunk, which makes it `size` bytes."""
        return 2 * number >= self.most or 2 * size > self.most_bytes

    def encode_text(self, text: str | None) -> str:
        """The ids of a text, as decimal numbers joined by commas."""
        text = text or ""
        if self.cut is None or not self.cut.search(text):
            return ",".join(map(self.__getitem__, CHUNKS.findall(text)))
        parts, at = [], 0
        for m in self.cut.finditer(text):
            parts += map(self.__getitem__, CHUNKS.findall(text[at : m.start()]))
            parts.append(str(self.special[m[0]]))
            at = m.end()
        return ",".join([*parts, *map(self.__getitem__, CHUNKS.findall(text[at:]))])

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.encode_text(text).split(",") if i]

    def decode_text(self, ids: str) -> str:
        return b"".join(map(self.strings.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""

    def decode(self, ids: list[int]) -> str:
        return self.decode_text(",".join(map(str, ids)))


def worker_tokenizer(shared: Broadcast) -> ByteBPE:
    key = hashlib.sha256(shared.value.encode()).hexdigest()
    return kept_in_worker(("byte_bpe", key), lambda: ByteBPE(shared.value))


def _shared(df: DataFrame, path: str) -> Broadcast:
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every document."""
    shared = _shared(docs, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = worker_tokenizer(shared)
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "ids": [bpe.encode(t) for t in x["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of encode_documents."""
    shared = _shared(encoded, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = worker_tokenizer(shared)
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "text": [bpe.decode(list(i)) for i in x["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row for each document: n_tokens, and digests of its ids and of the text decoded from them."""
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_tokenizer(shared)
        for x in batches:
            n, ids_sum, text_sum = [], [], []
            for text in x.column("text"):  # one text at a time as a Python string
                ids = bpe.encode_text(text.as_py())
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sum.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sum.append(hashlib.sha256(bpe.decode_text(ids).encode()).hexdigest())
            made = [pa.array(n, pa.int64()), pa.array(ids_sum, pa.string()), pa.array(text_sum, pa.string())]
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), *made], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
