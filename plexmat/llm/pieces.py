"""SentencePiece BPE that keeps offsets: every piece is known with the bytes of the text that it stands for.

A text is normalised through the model's compiled character map: from left to right the longest rule that begins there
is applied, other characters stand for themselves, and white space is escaped; for each byte of the result the place in the text that it
comes from is recorded. The characters of the normalised text are merged as their joined pieces rank, leftmost first among
equals (long chunks by a heap over a linked list with stale entries skipped); what is no piece becomes its bytes. A piece's
place in the normalised text is then projected through the record to its span in the original one.

Pieces join only characters that are neighbours in some piece, and in most models no escaped space to what is before it, so a
text is cut into runs of characters that may be joined, and workers remember their ids (`common.Remembered`, bounded by bytes).

Null and empty texts have no ids and decode to the empty text. Texts of any length are encoded whole. Repeated rows give
equal rows; null ids stay null; a table without rows gives none; other columns are left alone, whatever their names. A model of another
kind (no BPE, no byte fallback, user-defined pieces, white space as suffix or unescaped) is an error, since it would be
encoded wrongly. The model is read on the driver and broadcast (under a MB, whatever the input).
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise
from struct import pack, unpack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexmat.llm.common import Remembered, kept_in_worker

#: The escaped space; what a byte that is no UTF-8 decodes to.
SPACE, REPLACED = "▁", "�"
#: Kinds of pieces, and the kind of model that merges pairs.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2
#: Chunks up to this many characters are merged without a heap.
SHORT = 40
#: A worker's remembered chunks and their ids take this many bytes at most, whatever the texts.
KEEP_BYTES = 96 << 20


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def message(data: bytes) -> dict[int, list]:
    """The fields of a protocol buffer by number: numbers, or bytes."""
    out, at = defaultdict(list), 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = {1: (8, at), 5: (4, at)}.get(tag & 7) or _varint(data, at)
            value, at = data[at : at + size], at + size
        out[tag >> 3].append(value)
    return out


class CharacterMap:
    """Rules of a compiled character map: a double array of byte strings, each with the place of its replacement."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]
        self.begins: dict[str, bool] = {}

    def _walk(self, data: bytes, at: int) -> tuple[int, int, int]:
        """Length and value of the longest rule at a place, and how many bytes the rules follow the text."""
        node, length, value = self._next(self.units[0]), 0, 0
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                return length, value, i - at
            node ^= self._next(unit)
            if unit & 0x100:
                length, value = i + 1 - at, self.units[node] & 0x7FFFFFFF
        return length, value, len(data) - at

    @staticmethod
    def _next(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def active(self, chars: set[str]) -> set[str]:
        """Those of the characters that some rule begins with."""
        for c in chars.difference(self.begins):
            data = c.encode()
            self.begins[c] = bool(self.units) and self._walk(data, 0)[2] == len(data)
        return {c for c in chars if self.begins[c]}

    def longest(self, data: bytes, at: int) -> tuple[int, str] | None:
        """Bytes and replacement of the longest rule at a place."""
        length, value, _ = self._walk(data, at)
        return (length, self.replacements[value : self.replacements.index(0, value)].decode()) if length else None


class PieceModel(Remembered):
    """A tokenizer. As a dict it maps a chunk of normalised text to its ids (4 bytes each), and fills itself."""

    def __init__(self, data: bytes, most_bytes: int = KEEP_BYTES):
        super().__init__(most_bytes)
        model = message(data)
        trainer, rules = message(b"".join(model[2])), message(b"".join(model[3]))
        last = lambda fields, number, default: fields[number][-1] if fields[number] else default
        pieces = [message(p) for p in model[1]]
        self.texts = [p[1][0].decode() for p in pieces]
        scores = [unpack("<f", p[2][0])[0] for p in pieces]
        kinds = [last(p, 3, NORMAL) for p in pieces]
        if last(trainer, 3, 1) != BPE or not last(trainer, 35, 0) or last(trainer, 24, 0) or not last(rules, 5, 1) or not {NORMAL, UNKNOWN, CONTROL, BYTE}.issuperset(kinds):
            raise ValueError("not a pair-merging model with byte fallback, escaped spaces and plain pieces")
        self.dummy_prefix, self.remove_extra = bool(last(rules, 3, 1)), bool(last(rules, 4, 1))
        self.map = CharacterMap(last(rules, 2, b""))
        normal = {t: i for i, (t, k) in enumerate(zip(self.texts, kinds, strict=True)) if k == NORMAL}
        self.byte_ids = [0] * 256
        for i, (t, k) in enumerate(zip(self.texts, kinds, strict=True)):
            if k == BYTE:
                self.byte_ids[int(t[1:-1], 16)] = i
        self.ids = normal
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        self.ranks = {t: order[scores[i]] for t, i in normal.items() if len(t) > 1}
        self.neighbours = {t[k : k + 2] for t in self.ranks for k in range(len(t) - 1)}
        self.chunks = re.compile(self.chunk_pattern()).findall
        kind = np.array(kinds)
        self.is_byte = kind == BYTE
        self.width = np.array([1 if k == BYTE else len(t.encode()) for t, k in zip(self.texts, kinds, strict=True)])
        of_byte = {i: b for b, i in enumerate(self.byte_ids)}
        #: Whether an id can begin a character: bytes 10xxxxxx cannot.
        self.leads = np.array([k != BYTE or of_byte[i] & 0xC0 != 0x80 for i, k in enumerate(kinds)])
        surface = last(trainer, 44, b" \xe2\x81\x87 ")
        self.surfaces = [bytes([of_byte[i]]) if k == BYTE else b"" if k == CONTROL else surface if k == UNKNOWN else t.replace(SPACE, " ").encode() for i, (t, k) in enumerate(zip(self.texts, kinds, strict=True))]
        self.kinds, self.decimals = kinds, list(map(str, range(len(kinds))))

    def chunk_pattern(self) -> str:
        """Runs of characters that pieces may join, directly or by others between them: letters apart from marks, in most models.

        The space in front of a run goes with it; characters that are in no longer piece are runs of their own.
        """
        group = {c: c for pair in self.neighbours for c in pair if c != SPACE}

        def top(c: str) -> str:
            while group[c] != c:
                group[c] = c = group[group[c]]
            return c

        for a, b in self.neighbours:
            if SPACE not in (a, b):
                group[top(a)] = top(b)
        runs = defaultdict(list)
        for c in sorted(group):
            runs[top(c)].append(re.escape(c))
        inner = "".join(x for run in runs.values() for x in run)
        if any(SPACE in t.lstrip(SPACE) for t in self.ranks):
            return f"[{SPACE}{inner}]+|[^{SPACE}{inner}]+"
        parts = [f"{SPACE}*[{''.join(run)}]+" for run in sorted(runs.values(), key=len, reverse=True)]
        return "|".join([*parts, f"{SPACE}+", f"[^{SPACE}{inner}]+"])

    # ---- normalising

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the byte of the text that it comes from."""
        active = self.map.active(set(text)) if self.map.units else set()
        if active or self.remove_extra:
            return self._by_rules(text, active)
        raw = text.encode()
        if not raw:
            return "", np.zeros(1, np.int64)
        own = np.frombuffer(raw, np.uint8)
        places = np.repeat(np.arange(len(raw) + 1), np.append(np.where(own == 32, 3, 1), 1))
        if not self.dummy_prefix:
            return text.replace(" ", SPACE), places
        return SPACE + text.replace(" ", SPACE), np.concatenate([np.zeros(3, np.int64), places])

    def _steps(self, text: str, active: set[str]) -> Iterator[tuple[str, int]]:
        """What replaces each stretch of the text, and the stretch's bytes."""
        data, at = text.encode(), 0
        heads = {c.encode() for c in active}
        while at < len(data):
            size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            char = data[at : at + size]
            found = self.map.longest(data, at) if char in heads else None
            length, new = found or (size, char.decode())
            yield new, length
            at += length

    def _by_rules(self, text: str, active: set[str]) -> tuple[str, np.ndarray]:
        steps, at = list(self._steps(text, active)), 0
        first = 0
        if self.remove_extra:
            while first < len(steps) and steps[first][0] == " ":
                at += steps[first][1]
                first += 1
        if first == len(steps):
            return "", np.zeros(1, np.int64)
        out, places = ([SPACE], [at] * 3) if self.dummy_prefix else ([], [])
        after_space = self.remove_extra
        for new, length in steps[first:]:
            if after_space:
                new = new.lstrip(" ")
            if new:
                new_escaped = new.replace(" ", SPACE)
                out.append(new_escaped)
                places += [at] * len(new_escaped.encode())
                after_space = self.remove_extra and new.endswith(" ")
            at += length
        normal = "".join(out)
        if self.remove_extra:
            kept = normal.rstrip(SPACE)
            gone = 3 * (len(normal) - len(kept))
            if gone:
                at = places[len(places) - gone]
                normal, places = kept, places[: len(places) - gone]
        return normal, np.array([*places, at], np.int64)

    # ---- merging

    def merge(self, chunk: str) -> list[str]:
        """The pieces of one chunk after all merges."""
        n = len(chunk)
        get = self.ranks.get
        if n <= SHORT:
            return self._merge_short(list(chunk))
        heap = [rank * n + k for k in range(n - 1) if (rank := get(chunk[k : k + 2])) is not None]
        if not heap:
            return list(chunk)
        heapq.heapify(heap)
        # a symbol is the text from its place to the place after it; at[k] is that, 0 when the symbol has gone
        at, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            rank, k = divmod(pop(heap), n)
            middle = at[k]
            if not middle or middle >= n or get(chunk[k : at[middle]]) != rank:
                continue  # stale: a symbol of the pair has gone or grown
            end = at[k] = at[middle]
            at[middle] = 0
            if end < n:
                before[end] = k
                if (r := get(chunk[k : at[end]])) is not None:
                    push(heap, r * n + k)
            if (left := before[k]) >= 0 and (r := get(chunk[left:end])) is not None:
                push(heap, r * n + left)
        return [chunk[k : at[k]] for k in range(n) if at[k]]

    def _merge_short(self, parts: list[str]) -> list[str]:
        """merge() where a look at all pairs takes less time than a heap."""
        get, none = self.ranks.get, len(self.texts)
        ranks = [get(a + b, none) for a, b in pairwise(parts)]
        while ranks and (rank := min(ranks)) < none:
            k = ranks.index(rank)
            parts[k] += parts.pop(k + 1)
            del ranks[k]
            if k < len(ranks):
                ranks[k] = get(parts[k] + parts[k + 1], none)
            if k:
                ranks[k - 1] = get(parts[k - 1] + parts[k], none)
        return parts

    def make(self, word: str) -> bytes:
        ids: list[int] = []
        for piece in self.merge(word):
            own = self.ids.get(piece)
            ids += [own] if own is not None else [self.byte_ids[b] for b in piece.encode()]
        return pack(f"<{len(ids)}i", *ids)

    # ---- texts

    def encode_text(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a text, and where the bytes of its normalised form come from."""
        normal, places = self.normalise(text or "")
        return np.frombuffer(b"".join(map(self.__getitem__, self.chunks(normal))), "<i4"), places

    def spans(self, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last byte, exclusive, of every piece in the original text. Of a character that became its bytes the last one spans it, the others nothing at its begin."""
        end = np.cumsum(self.width[ids])
        begin = end - self.width[ids]
        byte = self.is_byte[ids]
        if byte.any():
            leads = self.leads[ids]
            first = np.maximum.accumulate(np.where(leads, begin, 0))
            closes = np.append(leads[1:], True)
            begin, end = np.where(byte, first, begin), np.where(byte & ~closes, first, end)
        return places[begin], places[end]

    def decode(self, ids: list[int]) -> str:
        """The text of some ids: escaped spaces are spaces, the one put in front goes, bytes that are no UTF-8 are replaced."""
        parts = list(map(self.surfaces.__getitem__, ids))
        if self.dummy_prefix or self.remove_extra:
            for k, i in enumerate(ids):
                if self.kinds[i] != NORMAL or parts[k][:1] != b" ":
                    if parts[k]:
                        break
                    continue
                parts[k] = parts[k][1:]
                if parts[k] or not self.remove_extra:
                    break
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            return self._decode_runs(ids, parts)

    def _decode_runs(self, ids: list[int], parts: list[bytes]) -> str:
        out, run = [], b""
        for i, part in zip([*ids, -1], [*parts, b""], strict=True):
            if i >= 0 and self.kinds[i] == BYTE:
                run += part
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[:size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    size = 1
                    out.append(REPLACED)
                run = run[size:]
            out.append(part.decode())
        return "".join(out)


def worker_model(shared: Broadcast) -> PieceModel:
    return kept_in_worker(("pieces", hashlib.sha256(shared.value).hexdigest()), lambda: PieceModel(shared.value))


def _shared(df: DataFrame, path: str) -> Broadcast:
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, and the begin and end of every piece in bytes of the original text (UTF-8)."""
    shared = _shared(docs, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = worker_model(shared)
        for x in batches:
            out = {"ids": [], "begins": [], "ends": []}
            for text in x["text"]:
                ids, places = model.encode_text(text)
                begins, ends = model.spans(ids, places)
                for c, v in zip(out, (ids, begins, ends), strict=True):
                    out[c].append(v)
            yield pd.DataFrame({"doc_id": x["doc_id"], **out})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, ids array<int>, begins array<long>, ends array<long>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of encode_documents."""
    shared = _shared(encoded, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = worker_model(shared)
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "text": [model.decode([] if i is None else list(i)) for i in x["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row for each document: n_tokens, digests of its ids and of the text decoded from them, crc32 of the spans (begins, then ends, as 8-byte integers)."""
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_model(shared)
        for x in batches:
            n, ids_sum, text_sum, span_sum = [], [], [], []
            for text in x.column("text"):  # one text at a time as a Python string
                ids, places = model.encode_text(text.as_py())
                begins, ends = model.spans(ids, places)
                numbers = ids.tolist()
                n.append(len(numbers))
                ids_sum.append(hashlib.sha256(",".join(map(model.decimals.__getitem__, numbers)).encode()).hexdigest())
                text_sum.append(hashlib.sha256(model.decode(numbers).encode()).hexdigest())
                span_sum.append(zlib.crc32(ends.astype("<i8").tobytes(), zlib.crc32(begins.astype("<i8").tobytes())))
            made = [pa.array(n, pa.int64()), pa.array(ids_sum, pa.string()), pa.array(text_sum, pa.string()), pa.array(span_sum, pa.int64())]
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), *made], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
