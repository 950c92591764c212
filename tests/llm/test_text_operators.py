"""The text operators against brute force, round trips and held-out labels, on small fixtures with every odd case."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import sys
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as vocabularies
import pytest
from tokenizers import Tokenizer

from plexmat.llm import bpe, chosen_path, common, grammar, iblt, license_scan, line_rules, mixing, rule_ensemble, sharding, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    parts = [rng.choice(["ka", "lo", "mi", "ter", "an", "so", "ve", "du", "ri", "pel"]) for _ in range(4 * n)]
    words = ["".join(parts[4 * i : 4 * i + rng.randint(1, 4)]) for i in range(n)]
    return "".join(w + (".\n" if i % 9 == 8 else ", " if i % 7 == 6 else " ") for i, w in enumerate(words))


def rows() -> list[tuple]:
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(60, 160)) for _ in range(40)]
    texts += [texts[0], texts[0], None, "", " ", "one", "one two three four five", "x" * 5000, prose(rng, 4000)]
    out = [(i, t, "en", f"s{i % 3}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*out, (None, "no id here at all", None, None, None), out[1], out[1]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Extra columns named like what operators make."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in ("size", "shard", "slot", "start", "kept", "score", "n_words", "digest", "rep", "_text", "_key", "_own", "h")})


def by_id(df) -> dict:
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


# ---- sharding


def test_sharding_slots_and_growth(docs, empty):
    found = sharding.shard_documents(docs).collect()
    assert len(found) == docs.count()
    slots = collections.defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    text = {r[0]: r[1] or "" for r in rows()}
    for r in found:
        assert r["size"] == len(text[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
    assert sharding.shard_documents(empty).count() == 0
    assert sharding.shard_documents(clashing(docs)).count() == docs.count()


def test_weighted_shards_follow_weights(spark):
    from pyspark.sql import functions as F

    ids = spark.range(6000)
    counts = {r["s"]: r["count"] for r in ids.groupBy(sharding.rendezvous_shard(F.col("id"), {0: 1.0, 1: 1.0, 2: 2.0}).alias("s")).count().collect()}
    assert abs(counts[2] / 6000 - 0.5) < 0.03
    with pytest.raises(ValueError):
        sharding.scores(F.col("id"), {0: 0.0})


# ---- token files


def test_grammar_round_trip(docs, empty):
    path = vocabularies.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    expected, start = collections.defaultdict(list), 0
    for r in ordered:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [1]
        expected[r[0]].append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = by_id(grammar.round_trip(docs, path))
    assert {k: sorted((r["start"], r["n_tokens"], r["ids_crc32"]) for r in v) for k, v in found.items()} == dict(expected)
    assert grammar.round_trip(empty, path).count() == 0


def test_grammar_random_access():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 9, n).tolist() + [1] for n in (0, 50, 3000, 7)]
    ids, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
    shard = grammar.Shard(grammar.pack([5, None, 7, 8], ids, ends, 300))
    assert shard.decode().tolist() == ids.tolist() and len(shard.rules) and len(shard.symbols) < len(ids)
    assert [shard.document(k) for k in range(4)] == docs
    assert shard.document(2, 100, 140) == docs[2][100:140]
    assert shard.known.tolist() == [1, 0, 1, 1]


def test_grammar_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(2)
    for ids in (rng.zipf(1.3, 60_000) % 500, np.zeros(5_000, np.int64), np.tile([1, 2, 3, 1, 2], 4_000), rng.integers(0, 3, 20_000)):
        ends = np.unique(np.append(rng.integers(1, len(ids), 50), len(ids)))
        symbols, stops, rules = grammar.compress(ids, ends, 500)
        left = collections.Counter((a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if i + 1 not in set(stops.tolist()))
        assert not [p for p, n in left.items() if n >= 2 * grammar.MIN_COUNT or (n >= grammar.MIN_COUNT and p[0] != p[1])]
        assert grammar.Shard(grammar.pack(list(range(len(ends))), ids, ends, 500)).decode().tolist() == ids.tolist()
    for bits in (16, 17, 20, 32):
        numbers = rng.integers(0, 1 << (bits - 1), 1_001)
        assert grammar.unpacked(grammar.packed(numbers, bits), bits, len(numbers)).tolist() == numbers.tolist()


def test_grammar_reads_ranges(spark, docs, tmp_path):
    path = vocabularies.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    grammar.write_files(clashing(docs), str(tmp_path / "files"), path)
    texts = {r[0]: r[1] for r in rows()}
    asked = [(0, 0, None), (0, 3, 9), (48, 500, 520), (42, 0, 5), (47, 2, 2), (7777, 0, 1), (3, None, 4)]
    got = grammar.read_ranges(spark, str(tmp_path / "files"), spark.createDataFrame(asked, "doc_id long, start long, stop long")).collect()
    for d, a, b in asked[:-2] + [(3, 0, 4)]:
        ids = [*library.encode(texts[d] or "", add_special_tokens=False).ids, 1][a:b]
        assert [r["ids"] for r in got if (r["doc_id"], r["start"], r["stop"]) == (d, a, b)] == [ids]
    assert not [r for r in got if r["doc_id"] == 7777]


def test_tokenizers_of_another_kind(docs):
    path = vocabularies.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        other = f.read()
    encoder, library = grammar.WordEncoder(other), Tokenizer.from_file(path)
    texts = ["It's here,  and there.", None, "A  B"]
    assert [np.frombuffer(b, encoder.kind).tolist() for b in encoder.batch(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    with open(vocabularies.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        bpe.ByteBPE(f.read())


def test_word_encoder_equals_library():
    path = vocabularies.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        encoder = grammar.WordEncoder(f.read(), most=50)
    library = Tokenizer.from_file(path)
    texts = ["It's <|endoftext|> x<|endoftext|>", "a\x1cb \x85 c\xa0d", "Don't I'M 12 345 6, İstanbul ΑΣ.", "é é ̈a", "日本", "<|ENDOFTEXT|> Word, word. WORD.", "İ& \u0958&! ñandú$$$ ÿ,&& x's, a-b.c- ªº#", "  lead\ttrail \x85", "", None]
    for _ in range(2):
        got = [np.frombuffer(b, encoder.kind).tolist() for b in encoder.batch(texts)]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


# ---- BPE


def test_bpe_keeps_no_more_than_its_bytes(spark):
    path = vocabularies.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    library, room = Tokenizer.from_file(path), 200_000
    own = bpe.ByteBPE(definition, most_bytes=room)
    rng = random.Random(3)
    odd = ["don't x's 'sound, (word) e.g. a-b_c", "d\u00e9j\u00e0, vu\u00b2 x\u00b2. e\u0301t\u00e9, \u00aao \u00d7y \u02afz \u02b0q", "caf\u00e9's\u4e2d\u6587, na\u00efve\u0416\u0418 3a4 a3,  b", "a\u00a0b, c\n\nd. "]
    for k in range(300):
        text = " the, " + " ".join("".join(rng.choice("ab\u00e9\u4e2d\u6587\U0001f600,1'") for _ in range(rng.randrange(1, 60))) for _ in range(6)) + " " + odd[k % len(odd)]
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
        held = sum(sys.getsizeof(c) + sys.getsizeof(i) for table in (own, own.recent) for c, i in table.items())
        assert held <= own.bytes + own.recent_bytes <= room
    assert " the" in own  # met in every text, so it outlasts what was met once

    words = chosen_path.word_hashes()
    words["a"]
    shared = spark.sparkContext.broadcast(definition)
    kept = bpe.worker_tokenizer(shared)
    assert bpe.worker_tokenizer(shared) is kept and chosen_path.word_hashes() is not words  # one operator's table at a time
    mixing.take_words.func(pd.Series(["a b"]), pd.Series([[{"from": 0, "upto": 1}]]))
    assert not common._KEPT


def test_bpe_keeps_large_ids_beside_null_ones(spark):
    docs = spark.createDataFrame([(2**60 + 1, "a"), (None, "b"), (-(2**60) - 1, None)], "doc_id long, text string")
    found = bpe.digest_documents(docs.coalesce(1), vocabularies.path("byte_bpe_50k.json")).collect()
    assert {r["doc_id"] for r in found} == {2**60 + 1, None, -(2**60) - 1}


def test_bpe_equals_library_and_decodes(docs, empty):
    path = vocabularies.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        own = bpe.ByteBPE(f.read(), most=40)
    odd = ["  a  b \n\n c\t\td  ", "it's <|endoftext|> x<|endoftext|>", "a\x1cb \x85 c\xa0\xa0d e", " \n \n", "\r\n\r\n a", "日本語 \U0001f389", "x" * 3000, "don't we'll I'M 's"]
    for t in odd + [r[1] or "" for r in rows()]:
        ids = own.encode(t)
        assert ids == library.encode(t, add_special_tokens=False).ids
        assert own.decode(ids) == t
    found = by_id(bpe.digest_documents(docs, path))
    for r in rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        x = found[r[0]][0]
        assert (x["n_tokens"], x["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert x["decoded_sha256"] == hashlib.sha256((r[1] or "").encode()).hexdigest()
    back = by_id(bpe.decode_documents(bpe.encode_documents(docs, path), path))
    assert all(back[r[0]][0]["text"] == (r[1] or "") for r in rows())
    assert bpe.digest_documents(empty, path).count() == 0


# ---- quality rules


def counts(t: str | None) -> tuple:
    w = WORD.findall(t or "")
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = collections.Counter(g)
    covered = {j for i, x in enumerate(g) if c[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(covered)


def test_rules_counts(docs, empty, spark):
    odd = spark.createDataFrame([(900, "a b c a b c | # x\na b\na b\n \nq\x0bz", None, "h", 3), (901, "w " * 200, None, "h", 3), (902, "a b c d a b c", None, None, 1)], SCHEMA)
    found = by_id(line_rules.document_rules(docs.unionByName(odd)))
    every = [*rows(), *[tuple(r) for r in odd.collect()]]
    for r in every:
        n = counts(r[1])
        for x in found[r[0]]:
            assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == n
            assert x["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and (x["kept"] is False or not x["base_failed"])
    assert sum(map(len, found.values())) == len(every)
    assert line_rules.document_rules(empty).count() == 0
    assert line_rules.document_rules(clashing(docs)).count() == docs.count()
    assert line_rules.apply_rules(clashing(docs)).columns == clashing(docs).columns


def test_rules_remove_boilerplate_and_spare_copies(spark):
    rng = random.Random(5)
    head = " ".join(f"banner{i}" for i in range(80))
    depleted = [(i, f"{head}\n{prose(rng, 15)}", "en", "host", 0) for i in range(30)]
    light = [(100 + i, f"see also this page\n{prose(rng, 120)}", "en", "host", 0) for i in range(30)]
    base = prose(rng, 200).split("\n")
    family = [(200 + i, "\n".join(x if j != i % len(base) else prose(rng, 9).replace("\n", " ") for j, x in enumerate(base)), "en", "host", 0) for i in range(60)]
    df = spark.createDataFrame(depleted + light + family, SCHEMA)
    found = by_id(line_rules.document_rules(df, spare_copies=True))
    assert not any(found[i][0]["kept"] for i in range(30))
    assert all(found[100 + i][0]["kept"] and found[100 + i][0]["removed_words"] == 4 for i in range(30))
    assert all(found[200 + i][0]["kept"] for i in range(60))
    kept = by_id(line_rules.apply_rules(df, spare_copies=True))
    assert "see also" not in kept[100][0]["text"] and kept[100][0]["n_chars"] == len(kept[100][0]["text"])
    assert kept[200][0]["text"] == family[0][1]


def test_rules_remove_boilerplate_of_several_lines(spark):
    rng = random.Random(6)
    line = lambda n: prose(rng, n).replace("\n", " ")
    every, lines = [], {}
    for k, (shared, own) in enumerate([(2, 3), (5, 6), (10, 10), (20, 6)]):
        lines[k] = [f"menu{k} {i} of the site" for i in range(shared)]
        every += [(1000 * k + i, "\n".join(lines[k] + [line(30) for _ in range(own)]), "en", f"host{k}", 0) for i in range(40)]
    found = by_id(line_rules.document_rules(spark.createDataFrame(every, SCHEMA), spare_copies=True))
    for i, *_ in every:
        assert found[i][0]["removed_words"] == 5 * len(lines[i // 1000])


def test_rules_remove_boilerplate_from_copies(spark):
    rng = random.Random(7)
    line = lambda n: prose(rng, n).replace("\n", " ")

    def copies(first: int, size: int, host: str, menu: list[str]) -> list[tuple]:
        base = [line(12) for _ in range(20)]
        return [(first + i, "\n".join([line(12) if j == i % 20 else x for j, x in enumerate(base)] + menu), "en", host, 0) for i in range(size)]

    menu = ["see also this page"]
    mixed = copies(0, 300, "a", menu) + [(1000 + i, "\n".join([line(40), line(40), *menu]), "en", "a", 0) for i in range(15)]
    families = [x for k in range(20) for x in copies(2000 + 100 * k, 15, "b", [*menu, "all pages"])]
    alone = copies(5000, 300, "c", menu)
    found = by_id(line_rules.document_rules(spark.createDataFrame(mixed + families + alone, SCHEMA), spare_copies=True))
    for rows_of, removed in ((mixed, 4), (families, 6), (alone, 0)):
        assert {found[i][0]["removed_words"] for i, *_ in rows_of} == {removed}


def line_verdicts(every: list[tuple], share: float, floor: int, min_left: int = 30) -> list[tuple]:
    """(doc_id, removed words, kept) of each row by the rule as it is stated."""
    words = lambda x: WORD.findall(x)
    lines_of = [[(" ".join(words(x)).lower(), len(words(x))) for x in (r[1] or "").split("\n") if words(x)] for r in every]
    hosts, holders = collections.Counter(r[3] for r in every), collections.defaultdict(set)
    for r, own in zip(every, lines_of, strict=True):
        for x, _ in own:
            holders[r[3], x].add((r[0], r[1]))
    out = []
    for r, own in zip(every, lines_of, strict=True):
        lost = sum(n for x, n in own if len(holders[r[3], x]) > max(floor, share * hosts[r[3]]))
        c = counts(r[1])
        base = c[0] < 50 or 100 * c[4] > 50 * c[0]
        out.append((r[0], lost, not base and 100 * (c[0] - lost) >= min_left * c[0]))
    return out


def test_rules_verdict_against_brute_force(spark):
    rng = random.Random(8)
    line = lambda n: prose(rng, n).replace("\n", " ")
    head, every = [f"Banner {i} of  the site" for i in range(12)], []
    for i in range(120):  # from lines of the host alone to lines of the document alone
        own = [line(12) for _ in range(i % 9)]
        every.append((i if i % 10 else None, "\n".join([x.upper() if i % 2 else x for x in head[: i % 13]] + own + [line(20)] * (i % 2)), "en", ["a", "b", None][i % 3], 0))
    every += [every[4], every[4], (5, "another text of id five " * 12, "en", "a", 0), (900, None, "en", "a", 0), (901, "", "en", None, 0)]
    df = spark.createDataFrame(every, SCHEMA)
    for share, floor in ((0.001, 10), (0.2, 3), (0.0, 1_000)):
        found = [(r["doc_id"], r["removed_words"], r["kept"]) for r in line_rules.document_rules(df, share=share, floor=floor).collect()]
        expected = line_verdicts(every, share, floor)
        assert collections.Counter(found) == collections.Counter(expected)
        assert floor == 1_000 or {k for _, lost, k in expected if lost} == {True, False}


# ---- quality and toxicity


def labelled(spark, kind: str):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        t = prose(rng, 120)
        if kind == "quality" and bad:
            t = " ".join(w.upper() + "!!" for w in t.split()) if i % 10 else " | ".join(t.split())
        if kind == "toxic" and bad:
            w = t.split(" ")
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zorgface", "zorgfaces", "blixhead", "blixheads", "zorgfacex"]))
            t = " ".join(w)
        docs.append((i, t, "en", "s", 0))
        labels.append((i, int(not bad), int(bad)))
    odd = [(1000, None, None, None, None), (1001, "", None, None, None), (None, "text without id", None, None, None)]
    return spark.createDataFrame(docs + odd, SCHEMA), spark.createDataFrame([*labels, (0, None, None), (5000, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality_held_out(spark, empty):
    docs, labels = labelled(spark, "quality")
    found = by_id(rule_ensemble.score_documents(clashing(docs), labels))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i][0]["held_out"] for i in held)
    assert np.mean([found[i][0]["predicted"] == truth[i] for i in held]) > 0.95
    assert len(found[1000]) == len(found[1001]) == len(found[None]) == 1 and 0 <= found[1001][0]["score"] <= 1
    assert rule_ensemble.score_documents(empty, labels).count() == 0
    alone = rule_ensemble.score_documents(docs, labels.where("quality = 1"))
    assert {r["predicted"] for r in alone.collect()} == {1}
    assert rule_ensemble.keep_good(docs, labels).columns == docs.columns


def test_rules_column_equals_numpy(spark):
    x = np.random.default_rng(2).normal(size=(500, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 1] <= 0.5)).astype(float)
    model = rule_ensemble.fit(x, y, ["a", "b", "c"])
    frame = spark.createDataFrame(x.tolist(), "a double, b double, c double").select("a", model.column().alias("s")).toPandas()
    assert np.allclose(frame["s"], model.predict(frame.assign(b=x[:, 1], c=x[:, 2])[["a", "b", "c"]].to_numpy()))
    assert ((model.predict(x) >= 0.5) == (y == 1)).mean() > 0.95


def test_toxicity_held_out_and_misspellings(spark, empty):
    docs, labels = labelled(spark, "toxic")
    found = by_id(toxicity.score_documents(clashing(docs), labels))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i][0]["held_out"] for i in held)
    assert np.mean([found[i][0]["predicted"] == truth[i] for i in held]) > 0.9
    assert len(found[1000]) == 1 and 0 <= found[1000][0]["score"] <= 1
    fold = labels.doc_id % 5 == 1
    scorer = toxicity.Scorer(toxicity.train(docs, labels, "toxic", fold))
    clean = prose(random.Random(77), 60)
    assert scorer([clean + " zorgfacez blixhead"])[0] > scorer([clean])[0]
    assert toxicity.score_documents(empty, labels).count() == 0


def test_scores_of_repeated_and_very_long_texts(spark):
    for kind, score in (("quality", rule_ensemble.score_documents), ("toxic", toxicity.score_documents)):
        docs, labels = labelled(spark, kind)
        long = prose(random.Random(4), 2_000) * 100
        more = spark.createDataFrame([(7000, long, "en", "s", 0), (7000, long, "en", "s", 0), (3, "another text of id three", "en", "s", 0)], SCHEMA)
        found = by_id(score(docs.unionByName(more).unionByName(docs.where("doc_id = 1")), labels.unionByName(labels)))
        assert len(found[7000]) == 2 and len({r["score"] for r in found[7000]}) == 1 and 0 <= found[7000][0]["score"] <= 1
        assert len(found[1]) == 2 and len({r["score"] for r in found[1]}) == 1 and len(found[3]) == 2


# ---- licences


def exhaustive_scan(texts: list[str | None], notices: dict[str, str]) -> set:
    """(place of the text, license, contained) where any window's surroundings hold enough of a template's word pairs."""
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    pairs = lambda w: list(zip(w, w[1:], strict=False))
    out = set()
    for i, t in enumerate(texts):
        grams = pairs(words(t or ""))
        for name, notice in notices.items():
            n, own = len(words(notice)), set(pairs(words(notice)))
            best = 0.0
            for at in range(0, len(grams), license_scan.STRIDE):
                begin = max(at - n, 0)
                best = max(best, len(own & set(grams[begin : begin + 2 * n + license_scan.WINDOW - 1])) / len(own))
            if best >= license_scan.MIN_CONTAINED:
                out.add((i, name, round(best, 9)))
    return out


def test_license_scan_against_brute_force(spark, docs, empty):
    rng = random.Random(13)
    notices = license_scan.NOTICES
    names, texts = list(notices), []
    for i in range(60):  # whole notices, notices with words changed, and parts of them, at any place
        words = notices[names[i % 13]].split()
        if i % 3 == 1:
            words[rng.randrange(len(words))] = "other"
        if i % 5 == 4:
            words = words[: max(2, len(words) * 2 // 3)]
        body = prose(rng, 100)
        at = rng.randrange(len(body))
        texts.append(body[:at] + " " + " ".join(words) + " " + body[at:])
    texts += [texts[0] * 300, " ".join(notices.values()), "All", "", None, texts[3]]
    # null and repeated ids tell nothing: every row is a text of its own
    table = spark.createDataFrame([(None if i % 7 == 0 else 5 if i % 7 == 1 else i, t, str(i), "s", 0) for i, t in enumerate(texts)], SCHEMA)
    expected = exhaustive_scan(texts, notices)
    got = license_scan.scan(clashing(table)).collect()
    by_doc = collections.Counter((None if i % 7 == 0 else 5 if i % 7 == 1 else i, name, c) for i, name, c in expected)
    assert collections.Counter((r["doc_id"], r["license"], round(r["contained"], 9)) for r in got) == by_doc
    assert sum(n for (d, _, _), n in by_doc.items() if d is None) > 5
    assert not license_scan.scan(docs).count() and not license_scan.scan(empty).count()
    assert 1 - (1 - license_scan.least_jaccard(3)) ** license_scan.bands_for(3) >= license_scan.TARGET


def test_license_scan_of_long_templates(spark, monkeypatch):
    rng = random.Random(14)
    long = {f"long{k}": " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(6_000)) for k in range(3)}
    texts = [prose(rng, 50) + " " + long["long0"] + " " + prose(rng, 50), prose(rng, 80), long["long2"]]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert license_scan.Templates(spark, long).anchors is None
    assert {(r["doc_id"], r["license"], r["contained"]) for r in license_scan.scan(table, long).collect()} == {(0, "long0", 1.0), (2, "long2", 1.0)}
    few = license_scan.scan(table, {"t": long["long0"][:200]}).collect()
    monkeypatch.setattr(license_scan, "LITERALS", 1)
    assert license_scan.scan(table, {"t": long["long0"][:200]}).collect() == few


# ---- fingerprints


def test_fingerprints_against_sets(docs, empty, spark):
    found = iblt.fingerprint_documents(clashing(docs)).collect()
    ordered = [r[1] or "" for r in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))]  # rows of equal id have equal texts
    assert len(found) == len(ordered)

    def keys(t: str) -> set:
        return set(iblt.digests([t])[0].tolist())

    def jaccard(a: str, b: str) -> float:
        x, y = keys(a), keys(b)
        return len(x & y) / len(x | y) if x | y else 1.0

    expected = collections.Counter()
    for i, t in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)]
        e = iblt.edited(t, after)
        expected[len(t), hashlib.sha256(e.encode()).hexdigest(), round(jaccard(t, e), 9), round(jaccard(t, after), 9)] += 1
    assert collections.Counter((r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found) == expected
    equal = [r["fingerprint"] for r in found if r["doc_id"] in (0, 40, 41)]
    assert len(set(equal)) == 1
    assert iblt.fingerprint_documents(empty).count() == 0
    alone = iblt.fingerprint_documents(spark.createDataFrame([(1, "a. b.", None, None, None)], SCHEMA)).collect()
    assert alone[0]["near_next"] == 1.0


def test_fingerprints_of_one_id_for_most_rows(spark):
    rng = random.Random(15)
    every = [(None if i % 3 else i, prose(rng, 40) if i % 5 else "the same. text.", "en", "s", 0) for i in range(300)]
    found = iblt.fingerprint_documents(spark.createDataFrame(every, SCHEMA)).collect()
    assert collections.Counter(r["doc_id"] for r in found) == collections.Counter(r[0] for r in every)
    # one cycle through all rows: the edited texts are those of some order, in which every row is once the next
    halves = collections.Counter(t[1] for t in every)
    texts = {r[0]: r[1] for r in every if r[0] is not None}
    named = sorted(texts)
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    for a, b in zip(named, named[1:], strict=False):
        assert by[a]["edited_sha256"] == hashlib.sha256(iblt.edited(texts[a], texts[b]).encode()).hexdigest()
    assert sum(r["near_next"] == 1.0 for r in found) >= halves["the same. text."] // 2


def test_stored_fingerprints_subtract(spark):
    rng = random.Random(16)
    text = prose(rng, 300)
    parts = iblt.paragraphs(text)
    after = "".join(p for i, p in enumerate(parts) if i not in (3, 7)) + "Something new. "
    keys, at = iblt.digests([text, after, prose(rng, 400)])
    stored = iblt.fingerprints(iblt.base_tables(keys, at), range(3))
    a, b = set(keys[at[0] : at[1]].tolist()), set(keys[at[1] : at[2]].tolist())
    gone, new = iblt.changed(stored[:1], stored[1:2])[0]
    assert set(gone.tolist()) == a - b and set(new.tolist()) == b - a and len(a - b) >= 2
    assert iblt.changed(stored[:1], stored[2:])[0] is None
    for other in (after, prose(rng, 400), "", text, text * 50):
        gone, new = iblt.changed_digests(text, other)
        x, y = (set(iblt.digests([t])[0].tolist()) for t in (text, other))
        assert set(gone.tolist()) == x - y and set(new.tolist()) == y - x
    one, two = (spark.createDataFrame([(1, t, None, None, 0), (2, "same", None, None, 0), (None, t, None, None, 0), (3 + k, t, None, None, 0)], SCHEMA) for k, t in enumerate((text, after)))
    got = iblt.changed_documents(one, two).collect()
    assert [(r["doc_id"], len(r["gone"]), len(r["new"])) for r in got] == [(1, len(a - b), len(b - a))]


# ---- near duplicates


def exact_classes(texts: dict) -> dict:
    """Class, first id and links of every id, by all pairs of different texts."""
    first: dict = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)

    def shingles(t: str) -> frozenset:
        w = WORD.findall(t)
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets, parent, links = {i: shingles(t) for t, i in first.items()}, {}, collections.Counter()

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (root(first[t]), first[t], links[first[t]]) for i, t in texts.items()}


def family(rng: random.Random, n: int, size: int, edits: int) -> list[str]:
    base = prose(rng, n).split(" ")
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_against_all_pairs(spark, empty):
    rng = random.Random(21)
    passage = prose(rng, 60)
    texts = [prose(rng, 150) for _ in range(60)] + family(rng, 150, 150, 2) + family(rng, 120, 7, 4) + [passage + prose(rng, 150) for _ in range(120)]
    texts += [texts[3]] * 5 + ["", "", "one two", "one two", "one two three", "a b c d e"]
    texts += [x for k in range(15) for x in family(rng, 90, 2, 3)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    found = {r["doc_id"]: (r["class_id"], r["rep"], r["n_links"]) for r in chosen_path.near_duplicates(clashing(df)).collect()}
    assert found == exact_classes(dict(enumerate(texts)))
    kept = {r["doc_id"] for r in chosen_path.keep_first(df).collect()}
    assert kept == {c for c, _, _ in found.values()}
    assert chosen_path.near_duplicates(empty).count() == 0


def test_near_duplicates_odd_rows(docs):
    found = by_id(chosen_path.near_duplicates(docs))
    assert sum(map(len, found.values())) == docs.count()
    assert {found[i][0]["class_id"] for i in (0, 40, 41)} == {0}
    assert {found[i][0]["class_id"] for i in (42, 43)} == {42}
    assert len(chosen_path.keep_first(docs).where("doc_id = 1").collect()) == 1


def test_near_duplicates_of_null_and_shared_ids(spark):
    rng = random.Random(31)
    pairs = [family(rng, 100, 1, 0) for _ in range(4)]
    near = [[p[0], p[0] + " one more word", p[0] + " another end"] for p in pairs]
    alone = [prose(rng, 100) for _ in range(3)]
    given = [(None, t) for t in near[0] + near[1] + alone] + [(7, t) for t in near[2]] + [(7, near[3][0]), (8, near[3][1]), (None, near[3][2])]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in given], SCHEMA)
    found = chosen_path.Join(df).result().collect()
    of = {r["digest"]: r for r in found}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert len(found) == len(of) == len(given)
    for k, first in enumerate((None, None, 7, None)):
        assert {(of[md5(t)]["n_links"], of[md5(t)]["class_id"]) for t in near[k]} == {(2, first)}
    assert {of[md5(t)]["n_links"] for t in alone} == {0}
    kept = collections.Counter((r["doc_id"], r["text"]) for r in chosen_path.keep_first(df).collect())
    lowest = [min(near[k], key=md5) for k in range(3)]
    assert kept == collections.Counter([(None, lowest[0]), (None, lowest[1]), (7, lowest[2]), (None, near[3][2]), *[(None, t) for t in alone]])


# ---- mixing


def test_mixture_law(docs, empty):
    found = mixing.mix_documents(clashing(docs), block=16).collect()
    assert len(found) == docs.count()
    source = {r[0]: r[3] for r in rows()}
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in found:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    for r in found:
        assert r["source_size"] == sizes[source[r["doc_id"]]]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in order] == pytest.approx(mixing.targets([sizes[s] for s in order]))
    again = mixing.mix_documents(docs, block=16).collect()
    key = lambda x: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in x)
    assert key(found) == key(again)
    assert mixing.mix_documents(empty).count() == 0


def test_mixture_documents(docs):
    words = collections.Counter()
    for r in mixing.mix_documents(docs, block=16).collect():
        words[r["doc_id"]] += r["taken"]
    mixed = mixing.apply_mix(clashing(docs), block=16)
    assert mixed.columns == clashing(docs).columns
    got = collections.Counter()
    for r in mixed.collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert +got == +words


def test_permutation_and_plans():
    for n in (1, 2, 3, 10, 257, 1000):
        p = mixing.permuted(np.arange(n), n, 5)
        assert sorted(p) == list(range(n)) and (mixing.permuted(p, n, 5, back=True) == np.arange(n)).all()
    for size, target in ((1000, 1500.0), (1000, 2000.0), (1000, 1.0), (999, 998.0), (5, 7.5), (16, 0.0), (0, 0.0)):
        plan = mixing.source_plan(size, target, 16, 3)
        lengths = [min(16, size - 16 * b) for b in mixing.permuted(np.arange(plan["slots"]), max(plan["blocks"], 1), 3)] if plan["slots"] else []
        if lengths:
            lengths[-1] = min(lengths[-1], plan["cut"])
        assert plan["passes"] * size + sum(lengths) == int(np.floor(target + 0.5))
    dealt = mixing.deal([100, 7, 0, 3], 8, 1)
    assert dealt.sum(0).tolist() == [100, 7, 0, 3] and (dealt >= 0).all()


# ---- hot groups, odd ids, long texts and words


def test_mixing_deals_plans_to_thousands_of_equal_rows(spark):
    hot = [(7, "a b c d e f g h", "en", "s", 15)] * 6000 + [(7, "a b c d e f g h", "de", "s", 15)] * 2000
    rest = [(100 + i, f"x y z {i}", "en", "t", 8) for i in range(500)]
    docs = spark.createDataFrame([*hot, *rest], SCHEMA).repartition(7)
    taken = {r["source_size"]: r["n"] for r in mixing.mix_documents(docs).groupBy("source_size").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()}
    made = collections.Counter()
    passes = collections.Counter()
    for r in mixing.apply_mix(docs).collect():
        made[r["source"]] += len(WORD.findall(r["text"]))
        passes[r["doc_id"], r["lang"]] += 1
    assert made == {"s": taken[64_000], "t": taken[2000]}
    assert sum(n for (i, _), n in passes.items() if i == 7) <= 2 * 8000 and passes[7, "en"] > passes[7, "de"] > 0


def test_mixing_takes_an_equal_row_no_oftener_than_planned(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)] * 3 + [(2, "c " * 4000, "en", "s", 8000)], SCHEMA)
    per = mixing.mix_documents(docs, share=0.01).groupBy("doc_id").agg({"taken": "sum"}).collect()
    made = collections.Counter()
    for r in mixing.apply_mix(docs, share=0.01).collect():
        made[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert {r[0]: r[1] for r in per if r[1]} == dict(made)


def test_classes_have_keys_where_ids_are_null_or_shared(spark):
    rng = random.Random(9)
    groups = []
    for i in range(3):
        base = prose(rng, 200)
        groups.append([(None, base, "en", "s", 1), (i + 10, base + " more", "en", "s", 1)])
    groups.append([(None, prose(rng, 150), "en", "s", 1)])
    found = chosen_path.near_duplicates(spark.createDataFrame([r for g in groups for r in g], SCHEMA)).collect()
    assert len({r["class_key"] for r in found}) == 4
    assert sorted(collections.Counter(r["class_key"] for r in found).values()) == [1, 2, 2, 2]
    assert sorted(r["n_links"] for r in found) == [0, 1, 1, 1, 1, 1, 1]


def test_one_very_long_labelled_text_leaves_the_fit_alone(spark, monkeypatch):
    rng = random.Random(4)
    bad = ["grolf", "snarb", "zwick"]
    rows, labels = [], []
    for i in range(400):
        words = [w for w in prose(rng, 30).split()] + ([rng.choice(bad)] * 2 if i % 4 == 0 else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    held = {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}

    def accuracy(rows, labels) -> float:
        got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
        return sum(got[i] == int(i % 4 == 0) for i in held) / len(held)

    plain = accuracy(rows, labels)
    assert plain > 0.9
    monkeypatch.setattr(toxicity, "MOST_CHARS", 200_000)
    long = [(1000 + i, "word " * 100_000, "en", "s", 1) for i in range(8)]
    assert accuracy([*rows, *long], [*labels, *[(1000 + i, 1, i % 2) for i in range(8)]]) == plain


def test_kept_words_are_bounded_by_bytes():
    with open(vocabularies.path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    coder, plain = grammar.WordEncoder(definition, most_bytes=1 << 16), Tokenizer.from_str(definition)
    rng = random.Random(2)
    for _ in range(40):
        words = ["".join(rng.choice("etaoin") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["".join(rng.choice("etaoin") for _ in range(2000))]
        got = coder.batch([" ".join(words)])[0]
        assert np.frombuffer(got, coder.kind).tolist() == plain.encode(" ".join(words), add_special_tokens=False).ids
        assert coder.bytes <= 1 << 16 and all(len(w) <= coder.KEEP_CHARS for w in coder)
        assert sum(sys.getsizeof(w) + sys.getsizeof(d) for w, d in coder.items()) <= coder.bytes
    hashes = chosen_path.WordHashes(1 << 16)
    assert [hashes[f"w{i % 900}"] == hashes[f"w{i % 900}"] for i in range(3000)] == [True] * 3000 and hashes.bytes <= 1 << 15
