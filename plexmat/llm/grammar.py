"""Token-ID files compressed by a Re-Pair grammar for each shard, with random access.

Documents are put in ascending order of id over range partitions, encoded, and cut into shards of about SHARD_TOKENS ids.
In a shard the most frequent neighbouring pairs are replaced by nonterminals, round after round, until no pair is left that
comes MIN_COUNT times; pairs never cross the end of a document. A file holds the rules, the length that each nonterminal
expands to, the compressed symbols in as many bits as they need, and where each document starts in ids and in symbols, so
any range of ids of any document is decoded from its own symbols alone (`read_ranges`).

Shards are rows of a Parquet table (shard_part, shard_no, n_tokens, file): (shard_part, shard_no) is their order.
Null and empty texts hold the end id only; null ids come first; rows of equal id follow by a hash of the text, and repeated
rows are encoded as often as they come; texts of any length are encoded whole; a table without rows gives no shard; other
columns are left alone, whatever their names. A tokenizer of another kind than the words here assume (see WordEncoder) is
run by the library on whole texts.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from plexmat.llm.bpe import SPACES, byte_alphabet
from plexmat.llm.common import kept_in_worker, shared_dir

MAGIC = b"RPG2"
#: Ids to a shard at least (the last shard of a partition may have fewer); pairs rarer than MIN_COUNT stay as they are.
SHARD_TOKENS, MIN_COUNT = 1_000_000, 12
_HEAD = struct.Struct("<4sIIIII")
#: Characters past Latin Extended-B, separators that are no white space here, and a letter whose lower case is two.
_ODD = re.compile("[\x1c-\x1f\u0130\u0250-\U0010ffff]").search
_PLAIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch
#: Punctuation that ends words; an apostrophe may begin a contraction.
_MARKS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~"
#: The letters that stand for the bytes of UTF-8; ASCII stays, spaces among it.
_BYTES = "".join(chr(b) if b < 0x80 else byte_alphabet()[b] for b in range(256))
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1, one span after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = starts - np.concatenate([[0], np.cumsum(lengths)[:-1]])
    kind = np.int32 if total < 2**31 and int(np.abs(first).max()) < 2**31 - total else np.int64
    return np.repeat(first.astype(kind), lengths) + np.arange(total, dtype=kind)


def _alone(at: np.ndarray) -> np.ndarray:
    """Of pairs that overlap in a run, every other one, the leftmost first."""
    place = np.arange(len(at))
    start = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(at) > 1]), place, 0))
    return (place - start) % 2 == 0


def _by_cell(symbols: np.ndarray, cell: np.ndarray, at: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """One pair of each cell: the places of `at` that hold it, and the cell as its number."""
    own = cell[at]
    chosen = np.zeros(cells, np.int64)
    chosen[own] = at
    like = chosen[own]
    same = (symbols[at] == symbols[like]) & (symbols[at + 1] == symbols[like + 1])
    return at[same], own[same]


def _by_pair(symbols: np.ndarray, at: np.ndarray, least: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The (most frequent) pairs that come `least` times at `at`: their places, and numbers for them."""
    _, number, times = np.unique(symbols[at].astype(np.int64) << 32 | symbols[at + 1], return_inverse=True, return_counts=True)
    good = times >= least
    if most is not None:
        rank = np.empty(len(times), np.int64)
        rank[np.argsort(-times, kind="stable")] = np.arange(len(times))
        good &= rank < most
    keep = good[number]
    return at[keep], number[keep]


class _Shard:
    """Symbols of a shard while pairs are replaced; last marks the last symbol of each document."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, base: int):
        self.symbols, self.last, self.base, self.made = ids.astype(np.int32), np.zeros(len(ids), bool), base, 0
        self.last[ends[ends > 0] - 1] = True
        self.rules: list[np.ndarray] = []

    def replace(self, at: np.ndarray, own: np.ndarray, least: int) -> int:
        """Replaces the pairs at `at`, numbered by own, that come often enough without overlapping; how many places that were."""
        free = _alone(at)
        at, own = at[free], own[free]
        used = np.bincount(own)
        worth = np.flatnonzero(used >= least)
        if not len(worth):
            return 0
        worth = worth[np.argsort(-used[worth], kind="stable")]
        number = np.full(len(used), -1, np.int32)
        number[worth] = self.base + self.made + np.arange(len(worth), dtype=np.int32)
        new = number[own]
        at, own, new = at[new >= 0], own[new >= 0], new[new >= 0]
        example = np.zeros(len(used), np.int64)
        example[own] = at
        self.rules.append(np.stack([self.symbols[example[worth]], self.symbols[example[worth] + 1]], 1).astype(np.int64))
        self.made += len(worth)
        self.symbols[at] = new
        self.last[at] = self.last[at + 1]
        keep = np.ones(len(self.symbols), bool)
        keep[at + 1] = False
        self.symbols, self.last = self.symbols[keep], self.last[keep]
        return len(at)


def compress(ids: np.ndarray, ends: np.ndarray, base: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, the symbol place after each document, and rules (pairs of symbols; rule r makes symbol base + r).

    ids: the ids of all documents of the shard, each below base; ends: the place after each document.
    """
    shard, least = _Shard(ids, ends, base), max(2, min_count // 2)
    cells = 1 << max(10, min(20, int(len(ids)).bit_length()))
    found, few = np.zeros(0, np.int64), False  # places of pairs that may be frequent
    while len(shard.symbols) > 1:
        # Pairs are counted in cells of a hash, which bounds how often each comes; of a full cell one pair is replaced a round.
        symbols = shard.symbols
        cell = (symbols[:-1] * np.int32(-1640531527) + symbols[1:] * np.int32(1255595)) & np.int32(cells - 1)
        cell[shard.last[:-1]] = cells
        load = np.bincount(cell, minlength=cells + 1)
        load[cells] = 0
        if few:  # what is left is too little for rounds over all symbols
            found = np.flatnonzero((load >= min_count)[cell])
            break
        at = np.flatnonzero((load >= max(min_count, int(load.max()) // 32))[cell])
        few = not len(at) or 64 * shard.replace(*_by_cell(symbols, cell, at, cells), least) < len(symbols)
    # What is left is counted exactly: a pair that is frequent now was so in the round before, or holds a symbol made since.
    while len(found):
        at, own = _by_pair(shard.symbols, found, min_count)
        if not len(at):
            break
        live, before = np.zeros(base + shard.made + len(at), bool), base + shard.made
        live[shard.symbols[at]] = live[shard.symbols[at + 1]] = True
        if not shard.replace(at, own, least) and not shard.replace(*_by_pair(shard.symbols, at, min_count, 1), least):
            break
        left, right = shard.symbols[:-1], shard.symbols[1:]
        found = np.flatnonzero(~shard.last[:-1] & ((np.maximum(left, right) >= before) | (live[left] & live[right])))
    symbols, last, rules = shard.symbols, shard.last, shard.rules
    stops = np.flatnonzero(last) + 1
    # documents without ids end where the one before them ends
    empty = np.diff(np.concatenate([[0], ends])) == 0
    after = np.zeros(len(ends), np.int64)
    after[~empty] = stops
    return symbols, np.maximum.accumulate(after) if len(after) else after, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def packed(numbers: np.ndarray, bits: int) -> bytes:
    """Numbers of `bits` bits each, one after the other."""
    if bits == 16:
        return numbers.astype("<u2").tobytes()
    rows = np.unpackbits(numbers.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(rows[:, 32 - bits :]).tobytes()


def unpacked(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.int64)
    rows = np.zeros((n, 32), np.uint8)
    rows[:, 32 - bits :] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(rows, axis=1).view(">u4").ravel().astype(np.int64)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """The number of ids that each rule expands to; a rule only uses rules before it."""
    out = np.ones(base + len(rules), np.int64)
    for r, (a, b) in enumerate(rules.tolist()):
        out[base + r] = out[a] + out[b]
    return out[base:]


def pack(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray, base: int) -> bytes:
    """The file of a shard."""
    symbols, stops, rules = compress(ids, ends, base)
    bits = max(16, int(base + len(rules) - 1).bit_length())
    known = np.array([i is not None for i in doc_ids], np.uint8)
    parts = [
        np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes(), known.tobytes(), ends.astype("<u4").tobytes(), stops.astype("<u4").tobytes(),
        rules.astype("<u4").tobytes(), expansion_lengths(rules, base).astype("<u4").tobytes(), packed(symbols, bits),
    ]
    return _HEAD.pack(MAGIC, len(doc_ids), len(rules), len(symbols), base, bits) + b"".join(parts)


class Shard:
    """A file that is read back."""

    def __init__(self, data: bytes):
        magic, docs, rules, symbols, self.base, bits = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a grammar file")
        at = _HEAD.size

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.known = take("<i8", docs), take("u1", docs)
        self.ends, self.stops = take("<u4", docs).astype(np.int64), take("<u4", docs).astype(np.int64)
        self.rules = take("<u4", 2 * rules).reshape(-1, 2).astype(np.int64)
        self.lengths = take("<u4", rules).astype(np.int64)
        self.symbols = unpacked(data[at:], bits, symbols)

    @staticmethod
    def names(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the documents of a file, and whether each is one; nothing else is read."""
        n = _HEAD.unpack_from(data)[1]
        return np.frombuffer(data, "<i8", n, _HEAD.size), np.frombuffer(data, "u1", n, _HEAD.size + 8 * n)

    def decode(self) -> np.ndarray:
        """All ids of the shard: every rule is expanded once, and the symbols gather the expansions."""
        sizes = np.concatenate([np.ones(self.base, np.int64), self.lengths])
        starts = np.concatenate([np.arange(self.base), self.base + np.cumsum(self.lengths) - self.lengths])
        flat = np.concatenate([np.arange(self.base), np.zeros(int(self.lengths.sum()), np.int64)])
        for r, (a, b) in enumerate(self.rules.tolist()):
            s, m = starts[self.base + r], sizes[a]
            flat[s : s + m] = flat[starts[a] : starts[a] + m]
            flat[s + m : s + m + sizes[b]] = flat[starts[b] : starts[b] + sizes[b]]
        return flat[spans(starts[self.symbols], sizes[self.symbols])]

    def document(self, k: int, start: int = 0, stop: int | None = None) -> list[int]:
        """Ids start to stop of the k-th document, from its own symbols; the rest of the shard isn't expanded."""
        own = self.symbols[(self.stops[k - 1] if k else 0) : self.stops[k]]
        n = int(self.ends[k] - (self.ends[k - 1] if k else 0))
        stop = n if stop is None else min(stop, n)
        size = np.where(own < self.base, 1, self.lengths[np.maximum(own - self.base, 0)] if len(self.lengths) else 1)
        after = np.cumsum(size)
        first = int(np.searchsorted(after, start, side="right"))
        out: list[int] = []
        at = int(after[first - 1]) if first else 0
        stack = own[first:][::-1].tolist()
        while stack and at < stop:
            s = stack.pop()
            n = 1 if s < self.base else int(self.lengths[s - self.base])
            if at + n <= start:
                at += n
            elif s < self.base:
                out.append(s)
                at += 1
            else:
                a, b = self.rules[s - self.base].tolist()
                stack += [b, a]
        return out


#: Fixed value: the normaliser and the pre-tokeniser that words are cut and joined for below.
_KIND = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordEncoder(dict):
    """Encodes by a tokenizer that drops white space and puts texts in lower case; keeps the ids (as bytes) of words it has
    met, up to a fixed number of them and of bytes whatever the texts, and none of over KEEP_CHARS characters. Any other tokenizer is given whole texts."""

    KEEP_CHARS = 64

    def __init__(self, definition: str, most: int = 700_000, most_bytes: int = 224 << 20):
        super().__init__()
        self.tokenizer, self.most, self.most_bytes, self.bytes = Tokenizer.from_str(definition), most, most_bytes, 0
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        size = self.tokenizer.get_vocab_size()
        self.kind, self.base = ("<u2" if size <= 65_536 else "<u4"), size
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(size, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words = re.compile(f"[^{SPACES}]+").findall
        spec = json.loads(definition)
        self.by_word = {k: spec[k] for k in _KIND} == _KIND and spec["model"].get("end_of_word_suffix") == "</w>" and not spec["model"].get("dropout")

    def learn(self, words: list[str]) -> None:
        """Plain words (lower-case letters of Latin-1) go to the tokenizer's model together, as the bytes that its
        normaliser would make of them, and are told apart by the ids that close a word; others go through all of it, alone.
        """
        plain = [w for w in words if _PLAIN(w)]
        done = False
        if plain:
            lines = [" ".join(plain[i : i + 5000]) for i in range(0, len(plain), 5000)]
            got = self.bare.encode_batch_fast([x if x.isascii() else codecs.charmap_decode(x.encode(), "strict", _BYTES)[0] for x in lines], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.int64) for e in got])
            stops = np.flatnonzero(self.closes[ids]) + 1
            if done := len(stops) == len(plain):
                data, wide = ids.astype(self.kind).tobytes(), 2 if self.kind == "<u2" else 4
                ends = (stops * wide).tolist()
                self.update(zip(plain, [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        rest = [w for w in words if w not in self] if done else words
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self[w] = np.array(e.ids, np.int64).astype(self.kind).tobytes()

    def meet(self, words: list[str]) -> list[bytes]:
        """The ids of the words of one batch, new ones among them."""
        data = list(map(self.get, words))
        new = [w for w, d in zip(words, data, strict=True) if d is None]
        if not new:
            return data
        # Letters with punctuation after them have the ids of both.
        parts = [(w, w.rstrip(_MARKS)) for w in new if w[-1:] in _MARKS]
        parts = [(w, stem, w[len(stem) :]) for w, stem in parts if stem.isalpha() and not _ODD(stem)]
        need = set(new).difference([w for w, _, _ in parts]).union(*[p[1:] for p in parts])
        fresh = [w for w in need if w not in self]
        self.learn(fresh)
        self.update([(w, self[stem] + self[tail]) for w, stem, tail in parts])
        out = [self[w] if d is None else d for w, d in zip(words, data, strict=True)]
        added = fresh + [p[0] for p in parts]
        if max(map(len, added)) > self.KEEP_CHARS:
            for w in added:
                if len(w) > self.KEEP_CHARS:
                    del self[w]
            added = [w for w in added if len(w) <= self.KEEP_CHARS]
        self.bytes += self.size(added)
        if self.bytes > self.most_bytes or len(self) > self.most:  # those of the batch that were there before stay, frequent ones among them
            self.clear()
            self.update({w: d for w, d in zip(words, data, strict=True) if d is not None})
            self.bytes = self.size(list(self))
        return out

    @staticmethod
    def size(words: list[str]) -> int:
        """Bytes that the entries of words take at most: of a word's characters, 4, and of an id for each of its bytes, 12."""
        return 160 * len(words) + 16 * sum(map(len, words))

    def batch(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_word:
            got = self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return [np.array(e.ids, np.int64).astype(self.kind).tobytes() for e in got]
        # Special tokens are matched before case is changed, and few letters change case by rules of their own.
        odd = {i: self.words(t) for i, t in enumerate(texts) if t and ("<|" in t or _ODD(t))}
        plain = pa.array(["" if i in odd else t or "" for i, t in enumerate(texts)], pa.large_string())
        cut = pc.utf8_split_whitespace(pc.utf8_lower(plain))
        met = cut.flatten().dictionary_encode()
        data, wide = self.meet(met.dictionary.to_pylist()), np.dtype(self.kind).itemsize
        sizes = np.fromiter(map(len, data), np.int64, len(data)) // wide
        firsts, place = np.cumsum(sizes) - sizes, met.indices.to_numpy()
        ids = np.frombuffer(b"".join(data), self.kind)[spans(firsts[place], sizes[place])].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes[place])])[cut.offsets.to_numpy()] * wide
        out = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for i, ws in odd.items():
            own = list(dict.fromkeys(ws))
            out[i] = b"".join(map(dict(zip(own, self.meet(own), strict=True)).__getitem__, ws))
        return out


def worker_encoder(shared: Broadcast) -> WordEncoder:
    return kept_in_worker(("words", zlib.crc32(shared.value.encode())), lambda: WordEncoder(shared.value))


def _chunks(texts: list[str | None], most: int = 3_000_000) -> Iterator[slice]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encodes all documents and writes the shards' files, as a table, to path."""
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part = worker_encoder(shared), TaskContext.get().partitionId()
        end = np.array([end_id], encoder.kind).tobytes()
        doc_ids: list[int | None] = []
        data: list[bytes] = []
        held, number = 0, 0
        wide = len(end)

        def file() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(data), encoder.kind)
            ends = np.cumsum([len(d) // wide for d in data])
            return pd.DataFrame({"shard_part": [part], "shard_no": [number], "n_tokens": [len(ids)], "file": [pack(doc_ids, ids, ends, encoder.base)]})

        for x in batches:
            texts, names = x["text"].tolist(), [None if pd.isna(i) else int(i) for i in x["doc_id"]]
            for cut in _chunks(texts):
                for name, ids in zip(names[cut], encoder.batch(texts[cut]), strict=True):
                    doc_ids.append(name)
                    data.append(ids + end)
                    held += len(data[-1]) // wide
                    if held >= SHARD_TOKENS:
                        yield file()
                        doc_ids, data, held, number = [], [], 0, number + 1
        if data:
            yield file()

    # by a hash of the text too, so that an id which very many rows have is no partition
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    ordered = keyed.repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text").select("doc_id", "text")
    ordered.mapInPandas(run, "shard_part int, shard_no int, n_tokens long, file binary").write.parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document: doc_id, start, n_tokens, ids_crc32, decoded from the files."""
    files = spark.read.schema("shard_part int, shard_no int, n_tokens long, file binary").parquet(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for part, number, data in zip(x["shard_part"], x["shard_no"], x["file"], strict=True):
                shard = Shard(data)
                ids = shard.decode().astype("<u4")
                starts = np.concatenate([[0], shard.ends[:-1]])
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), shard.ends.tolist(), strict=True)]
                names = pd.array(np.where(shard.known == 1, shard.doc_ids, 0), "Int64")
                names[shard.known == 0] = pd.NA
                yield pd.DataFrame({"shard_part": part, "shard_no": number, "doc_id": names, "inside": starts, "n_tokens": shard.ends - starts, "ids_crc32": np.array(sums, np.int64)})

    rows = files.select("shard_part", "shard_no", "file").mapInPandas(run, "shard_part int, shard_no int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    sizes = files.select("shard_part", "shard_no", "n_tokens")
    before = Window.orderBy("shard_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("shard_part").agg(F.sum("n_tokens").alias("_n")).select("shard_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("shard_part").orderBy("shard_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(parts, "shard_part").select("shard_part", "shard_no", (F.col("_base") + F.col("_inside")).alias("_start"))
    return rows.join(offsets, ["shard_part", "shard_no"]).select("doc_id", (F.col("_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_ranges(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Ids start to stop (before stop; null: to the end) of documents: doc_id, start, stop, ids of each row of `wanted`.

    Each range is decoded from its document's own symbols. An id that several documents have gives a row for each.
    """
    files = spark.read.schema("shard_part int, shard_no int, n_tokens long, file binary").parquet(path)
    key = ["shard_part", "shard_no"]

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for part, number, data in zip(x["shard_part"], x["shard_no"], x["file"], strict=True):
                ids, known = Shard.names(data)
                place = np.flatnonzero(known)
                yield pd.DataFrame({"shard_part": part, "shard_no": number, "doc_id": ids[place], "place": place})

    index = files.select(*key, "file").mapInPandas(names, "shard_part int, shard_no int, doc_id long, place int")
    asked = index.join(wanted.select("doc_id", F.coalesce("start", F.lit(0)).cast("long").alias("start"), F.col("stop").cast("long").alias("stop")), "doc_id")
    per_shard = asked.groupBy(*key).agg(F.collect_list(F.struct("doc_id", "place", "start", "stop")).alias("asked"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for data, rows in zip(x["file"], x["asked"], strict=True):
                shard = Shard(data)
                ids = [shard.document(r["place"], r["start"], r["stop"]) for r in rows]
                stops = pd.array([r["stop"] for r in rows], "Int64")
                yield pd.DataFrame({"doc_id": [r["doc_id"] for r in rows], "start": [r["start"] for r in rows], "stop": stops, "ids": ids})

    return files.select(*key, "file").join(per_shard, key).select("file", "asked").mapInPandas(decode, "doc_id long, start long, stop long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the files of all documents to the shared folder and reads them back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/plexmat/grammar-{uuid.uuid4().hex}"
    write_files(docs, path, tokenizer, end_id)
    return read_files(spark, path)
