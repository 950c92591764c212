"""Hard negatives, fill-in-the-middle and pieces with spans: brute force, the sentencepiece library, round trips, every odd case."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers as vocabularies
import pytest
import sentencepiece
from pyspark.sql import functions as F

from plexmat.llm import common, fim, hard_negatives, pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "one", " one two ", "a\x00b\x0bc", "<P>in<S>", "x <M> y", "é 你好　 👍🏽  z", "▁ ▁a", "tail space  \n", "<s> </s> <0x41> <unk>", "x" * 3000, "ab cd " * 20_000, "� ​"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def odd_rows() -> list[tuple]:
    out = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(ODD * 3)]
    return [*out, (None, "no id here at all", None, None, None), (None, None, None, None, None), out[4], out[4]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def clashing(df):
    return df.withColumns({c: F.lit(7) for c in ("n", "form", "output", "batch", "units", "a", "b", "hash", "ids", "begins", "num", "codes", "rest", "task", "side", "windows", "rank", "score", "w", "id")})


# ---- fill in the middle


def fim_of(doc_id, text: str | None) -> tuple:
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_against_brute_force(docs):
    made = fim.transform_documents(docs)
    want = collections.Counter((r[0], *fim_of(r[0], r[1])) for r in odd_rows())
    assert collections.Counter(map(tuple, made.collect())) == want
    back = collections.Counter(map(tuple, fim.restore_documents(made).collect()))
    assert back == collections.Counter((r[0], r[1] or "") for r in odd_rows())
    digests = collections.Counter(map(tuple, fim.digest_documents(clashing(docs)).collect()))
    assert digests == collections.Counter((r[0], *(m := fim_of(r[0], r[1]))[:4], sha(m[4]), sha(r[1] or "")) for r in odd_rows())


def test_fill_in_middle_rates_slices_and_empty_tables(docs, spark, monkeypatch):
    monkeypatch.setattr(fim, "SLICE_BYTES", 100)
    import pyarrow as pa

    batch = pa.record_batch({"text": pa.array(ODD, pa.string())})
    assert pa.Table.from_batches(list(fim._slices(batch, "text")))["text"].to_pylist() == ODD
    forms = {r["form"] for r in fim.transform_documents(docs, percent=100, spm_percent=0).collect()}
    assert forms == {"plain", "psm"}  # the empty ones and those with marks stay plain
    assert fim.digest_documents(spark.createDataFrame([], SCHEMA)).count() == 0


# ---- pieces


def model_bytes() -> bytes:
    with open(vocabularies.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def with_rules(data: bytes, rule: str, prefix: int, extra: int) -> bytes:
    """The model with another character map: of a field that comes twice the parts are merged."""
    spec = b"".join(pieces.message(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())[3])
    spec += bytes([3 << 3, prefix, 4 << 3, extra])
    size, head = len(spec), b""
    while size > 127:
        head, size = head + bytes([size & 127 | 128]), size >> 7
    return data + bytes([3 << 3 | 2]) + head + bytes([size]) + spec


ALPHABET = ["a", "b", "e", "th", " ", "  ", "    ", "\n", "\t", "▁", "é", "é", "①", "ｱ", "ﾞ", "你", "𠀀", "👍", "。", "...", "23", "　", " ", "\r\n", "<s>", "<0x41>", "\x00", "�", "한", "ﬁ", "the ", "Ⅷ", "㌔", "eronthereing" * 5, "xx" * 40]


@pytest.mark.parametrize("rules", [None, ("nmt_nfkc", 1, 1), ("nmt_nfkc", 1, 0), ("nmt_nfkc", 0, 1), ("nfkc_cf", 0, 0)])
def test_pieces_ids_spans_and_decoding_are_the_librarys(rules):
    data = with_rules(model_bytes(), *rules) if rules else model_bytes()
    library = sentencepiece.SentencePieceProcessor()
    library.LoadFromSerializedProto(data)
    model = pieces.PieceModel(data)
    rng = random.Random(5)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))) for _ in range(500)]
    for text in texts:
        ids, places = model.encode_text(text)
        begins, ends = model.spans(ids, places)
        want = library.encode(text, return_type="proto").pieces
        assert [p.id for p in want] == ids.tolist()
        assert [(p.begin, p.end) for p in want] == list(zip(begins.tolist(), ends.tolist(), strict=True))
        assert model.decode(ids.tolist()) == library.decode(ids.tolist())
        if not rules:  # spans follow one another over the whole text
            assert b"".join(text.encode()[a:b] for a, b in zip(begins, ends, strict=True)) == text.encode()
    for _ in range(300):  # ids that no text gives
        ids = [rng.choice([rng.randint(0, 400), rng.randint(0, 31_999)]) for _ in range(12)]
        assert model.decode(ids) == library.decode(ids)


def test_long_chunks_are_merged_like_short_ones(monkeypatch):
    model, rng = pieces.PieceModel(model_bytes()), random.Random(6)
    words = ["".join(rng.choice("etaoinshr▁") for _ in range(rng.randint(1, 200))) for _ in range(200)]
    short = [model.merge(w) for w in words]
    monkeypatch.setattr(pieces, "SHORT", 0)
    assert [model.merge(w) for w in words] == short


def test_pieces_over_odd_rows(docs, spark):
    path = vocabularies.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = pieces.encode_documents(clashing(docs), path)
    found = collections.Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect())
    assert found == collections.Counter((r[0], tuple(library.encode(r[1] or ""))) for r in odd_rows())
    decoded = collections.Counter((r["doc_id"], r["text"]) for r in pieces.decode_documents(encoded, path).collect())
    assert decoded == collections.Counter((r[0], library.decode(library.encode(r[1] or ""))) for r in odd_rows())
    digests = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.digest_documents(docs, path).collect())
    assert digests == collections.Counter((r[0], len(i := library.encode(r[1] or "")), sha(",".join(map(str, i))), sha(library.decode(i))) for r in odd_rows())
    assert pieces.digest_documents(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_other_kinds_of_model_are_refused():
    with pytest.raises(ValueError):
        pieces.PieceModel(model_bytes() + bytes([2 << 3 | 2, 2, 3 << 3, 1]))  # unigram
    with pytest.raises(ValueError):
        pieces.PieceModel(model_bytes() + bytes([3 << 3 | 2, 2, 5 << 3, 0]))  # spaces as they are


def test_remembered_words_are_bounded_by_bytes():
    class Lengths(common.Remembered):
        def make(self, word: str) -> bytes:
            return b"x" * len(word)

    kept = Lengths(1 << 16)
    for i in range(5000):
        assert kept[f"{i % 700}-" + "y" * (i % 60)] == b"x" * len(f"{i % 700}-" + "y" * (i % 60))
        assert kept["z" * 10_000] == b"x" * 10_000
    assert kept.bytes <= 1 << 15 and all(len(w) <= 64 for w in [*kept, *kept.older]) and len(kept) + len(kept.older) < 500


# ---- hard negatives


def mined(rows: list[tuple], every: int, positives: int, negatives: int, least: int, greatest: int, dim: int) -> collections.Counter:
    """All products; rows are (vec_id, label, vec)."""
    ok = [(i, lab, np.array([math.floor(256 * float(np.float32(x))) for x in v] + [0] * (dim - len(v)), np.int64)) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = collections.Counter()
    for k, (i, lab, y) in enumerate(ok):
        if i is None or i % every:
            continue
        scored = sorted(((-int(y @ z), math.inf if j is None else j, j, other) for n, (j, other, z) in enumerate(ok) if n != k), key=lambda t: t[:2])
        for s, _, p, _ in [t for t in scored if t[3] == lab][:positives]:
            window = [(n, -t) for t, _, n, other in scored if other != lab and least * -s <= 100 * -t <= greatest * -s]
            out.update((i, p, r, n, -s, t) for r, (n, t) in enumerate(window[:negatives], 1))
    return out


def vectors(seed: int, n: int, dim: int, hot: float) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        label = 0 if rng.random() < hot else int(rng.integers(0, 6))
        rows.append((i, label, [float(np.float32(v)) for v in (centres[label] + rng.normal(size=dim)) / 8]))
    return rows


RESULT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def result(df) -> collections.Counter:
    return collections.Counter(tuple(r[c] for c in RESULT) for r in df.collect())


ITEMS = "vec_id long, label long, vec array<float>"


@pytest.mark.parametrize(("dim", "hot", "small"), [(8, 0.0, True), (7, 0.6, True), (3, 0.3, False)])
def test_hard_negatives_against_all_products(spark, monkeypatch, dim, hot, small):
    if small:  # many tasks, blocks and batches
        for name, value in (("ANCHORS", 9), ("ROWS", 100), ("STEP_ANCHORS", 4), ("STEP_ROWS", 32), ("PRODUCTS", 50)):
            monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(dim, 400, dim, hot)
    rows += [(500 + i, 1, rows[3][2]) for i in range(40)] + [rows[5], rows[5], rows[10], rows[10]]  # ties, repeated rows, a repeated anchor
    rows += [(None, 2, rows[7][2]), (601, None, rows[7][2]), (602, 1, None), (603, 1, [0.1, None] + [0.0] * (dim - 2)), (604, 1, [float("nan")] * dim), (605, 1, [float("inf")] * dim), (606, 1, []), (610, 1, rows[1][2][:1]), (620, 3, [0.0] * dim)]
    df = clashing(spark.createDataFrame(rows, ITEMS)).repartition(5)
    assert result(hard_negatives.mine(df, F.col("vec_id") % 10 == 0, 4, 3, 50, 95)) == mined(rows, 10, 4, 3, 50, 95, dim + dim % 2)


def test_hard_negatives_of_the_query(spark):
    rows = vectors(1, 300, 6, 0.4)
    table = spark.createDataFrame(rows, ITEMS).withColumnRenamed("vec", "embedding")
    moved = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in rows]
    assert result(hard_negatives.mine_embeddings(table)) == mined(moved, 50, 5, 3, 50, 95, 6)


def test_hard_negatives_of_few_rows(spark):
    empty = spark.createDataFrame([], ITEMS)
    assert hard_negatives.mine(empty, F.col("vec_id") % 10 == 0).count() == 0
    no_anchor = spark.createDataFrame([(1, 1, [0.5, 0.25]), (2, 1, [0.5, 0.25])], ITEMS)
    assert hard_negatives.mine(no_anchor, F.col("vec_id") % 10 == 0).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.mine(spark.createDataFrame([(0, 1, [1e30])], ITEMS), F.col("vec_id") % 10 == 0)


def test_bounds_hold_for_rows_the_index_was_not_fitted_on():
    rng = np.random.default_rng(2)
    seen, new = (np.floor(256 * rng.normal(size=(300, 10)) / s).astype(np.int64) for s in (8, 0.5))
    books = hard_negatives.fit_codebooks(seen)
    codes, rest = hard_negatives.encode(new, books)
    import pandas as pd

    anchors = pd.DataFrame({"num": range(50), "label": 0, "vec": [v.tobytes() for v in new[:50].astype("<i4")]})
    block = hard_negatives.Block(anchors, books)
    est, off = block.bounds(np.arange(50), codes, rest)
    assert (np.abs(est - new[:50] @ new.T) <= off).all()
