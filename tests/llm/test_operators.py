"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from runweave.llm import byte_bpe, common, decontaminate, exact_dedup, jaccard_join, language_model, licenses, queries, sharding, token_counts, toxicity

SF = "/root/testdata/sf0.001"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named as the operators' own.
CLASH = ["node", "id", "spans", "__h", "__text", "text_", "file", "place", "row", "sha", "maybe", "n_words", "score", "_metadata", "__slot", "key_slot"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "under the MIT license, under the mit License"), (5, "one two"), (5, "one two"), (6, "one  two"),
    (7, "Ünder thé bridge 東京 ' 'll  don't\n\n" * 3), (8, "word " * 9000), (9, "x" * 40_000), (10, "a  b   c\t\td " * 900), (11, "<|endoftext|> and <|endoftext|>"), (None, "no id but the words of a text"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in ODD], SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df.coalesce(2)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_exact_dedup(spark, odd, docs, empty, tmp_path):
    for df in (odd, docs):
        rows = df.select("doc_id", "text").collect()
        groups = {}
        for r in rows:
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append(r)
        want = []
        for norm, own in groups.items():
            keep = min(own, key=lambda r: (-len(r.text or ""), -1 if r.doc_id is None else r.doc_id)).doc_id
            want += [(r.doc_id, keep, len(own), r.doc_id == keep, hashlib.sha256(norm.encode()).hexdigest()) for r in own]
        got = [tuple(r) for r in exact_dedup.mark_copies(df).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert exact_dedup.mark_copies(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0
    for stored in (False, True):
        df = odd
        if stored:
            df.write.mode("overwrite").parquet(str(tmp_path / "odd"))
            df = spark.read.parquet(str(tmp_path / "odd"))
        kept = exact_dedup.drop_copies(df, stored=stored)
        assert kept.columns == odd.columns
        assert Counter(r.doc_id for r in kept.collect()) == Counter([3, 4, 6, 7, 8, 9, 10, 11, None])
        assert all(r[c] == "clash" for r in kept.collect() for c in CLASH)


def plan_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_exact_dedup_beyond_each_bound(spark, docs, tmp_path, monkeypatch):
    want = sorted(map(repr, exact_dedup.mark_copies(docs).collect()))
    docs.repartition(5, "doc_id").write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    kept = sorted(map(repr, exact_dedup.drop_copies(stored, stored=True).collect()))
    assert len(kept) == docs.select(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]", "")).distinct().count()
    monkeypatch.setattr(exact_dedup, "MOST_BROADCAST_BLOCKS", 0)
    monkeypatch.setattr(common, "MOST_BITMAPS", 3)
    assert sorted(map(repr, exact_dedup.mark_copies(docs).collect())) == want
    out = exact_dedup.drop_copies(stored, stored=True)
    assert sorted(map(repr, out.collect())) == kept
    plan = plan_of(out)
    assert "Exchange" not in plan.replace("BroadcastExchange", "") and plan.count("Scan parquet") >= 4


def test_decontamination(spark, odd, docs, empty):
    bench = spark.createDataFrame([("i1", "one two"), ("i2", "word " * 20), ("i3", None), (None, "one two"), (None, "no id but the words"), ("i4", " ".join(f"w{k}" for k in range(30))), ("i5", "under the mit license")], "item_id string, text string")
    more = spark.createDataFrame([(50, " ".join(["z"] * 300 + [f"w{k}" for k in range(5, 25)]), "en", "s", 0)], SCHEMA)
    for df, b in ((odd.select(empty.columns).union(more), bench), (docs, spark.read.parquet(f"{SF}/benchmark.parquet"))):
        windows = {}
        for r in b.collect():
            w = ALNUM.findall(lower(r.text))
            n = min(13, len(w))
            for k in range(len(w) - n + 1 if n else 0):
                windows.setdefault(tuple(w[k : k + n]), set()).update([] if r.item_id is None else [str(r.item_id)])
        got = by_id(decontaminate.contamination(decontaminate.find_spans(df, b)))
        for r in df.collect():
            w, hit, items = ALNUM.findall(lower(r.text)), set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if (own := windows.get(tuple(w[k : k + n]))) is not None:
                        items |= own
                        hit.update(range(k, k + n))
            y = got[r.doc_id]
            assert (y.n_words, y.n_hit, y.n_items, y.contaminated) == (len(w), len(hit), len(items), bool(hit) and 20 * len(hit) >= len(w))
            assert y.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    clean = decontaminate.drop_contaminated(odd, bench)
    assert clean.columns == odd.columns and {r.doc_id for r in clean.collect()} == {1, 2, 3, 7, 9, 10, 11}
    assert all(r[c] == "clash" for r in clean.collect() for c in CLASH)
    assert decontaminate.find_spans(empty, bench).count() == 0
    assert decontaminate.find_spans(odd, bench.limit(0)).where("size(items) > 0").count() == 0


def test_blocks_of_a_large_benchmark_add_up(spark, docs, odd, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole, clean = by_id(decontaminate.find_spans(docs, bench)), sorted(map(repr, decontaminate.drop_contaminated(docs, bench).collect()))
    assert any(r.spans for r in whole.values()) and len(clean) < len(whole)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2_000)
    assert by_id(decontaminate.find_spans(docs, bench)) == whole
    for stored in (False, True):
        assert sorted(map(repr, decontaminate.drop_contaminated(docs, bench, stored=stored).collect())) == clean
    few = spark.createDataFrame([("i1", "one two"), ("i2", "word " * 900), ("i3", "under the mit license")], "item_id string, text string")
    kept = decontaminate.drop_contaminated(odd, few).collect()
    assert {r.doc_id for r in kept} == {1, 2, 3, 7, 9, 10, 11, None} and all(r[c] == "clash" for r in kept for c in CLASH)


def test_suffix_array_and_search():
    rng = np.random.default_rng(0)
    for _ in range(30):
        runs = [rng.integers(1, 4, rng.integers(1, 40)) for _ in range(5)]
        text = np.concatenate([np.append(r, 0) for r in runs])
        index = decontaminate.FMIndex(text, 3, rate=4)
        for n in (1, 2, 5):
            phrases = rng.integers(1, 4, (20, n))
            found, low, high = index.search(phrases)
            places = {int(f): sorted(index.locate(np.arange(a, b)).tolist()) for f, a, b in zip(found, low, high, strict=True)}
            for k, p in enumerate(phrases):
                want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
                assert places.get(k, []) == want


def test_licenses(odd, docs, empty):
    phrases = {k: v.split() for k, v in licenses.BASE_PHRASES.items()}
    for df in (odd, docs):
        got = {(r.doc_id, r.n_words): r for r in licenses.scan_licenses(df).collect()}
        for r in df.select("doc_id", "text").collect():
            w = ALNUM.findall(lower(r.text))
            want = sorted((k, name) for name, p in phrases.items() for k in range(len(w)) if w[k : k + len(p)] == p)
            assert sorted((x.first_word, x.label) for x in got[r.doc_id, len(w)].places) == want
    assert licenses.scan_licenses(empty).count() == 0


def labels_of(text):
    df = pa.array([lower(text)])
    scanner = licenses.Scanner(licenses.BASE_PHRASES, licenses.TEMPLATES)
    _, pieces, told = scanner.scan(licenses.Words(df, licenses.ALNUM), 1)
    return {c[0] for c in scanner.chains(pieces[0], told[0])}


def labels_by_brute_force(text):
    """Every way to chain common runs of a text and a template that are as long as they can be."""
    w, out = ALNUM.findall(lower(text)), set()
    telling = {*licenses.TELLING, *(x[1:] for texts in licenses.TEMPLATES.values() for t in texts for x in t.split() if x[0] == "*")}
    for label, texts in licenses.TEMPLATES.items():
        for t in texts:
            own = [x.lstrip("*") for x in t.split()]
            needed = {i for i, x in enumerate(t.split()) if x[0] == "*"}
            runs = []
            for i in range(len(w)):
                for k in range(len(own)):
                    n = 0
                    while i + n < len(w) and k + n < len(own) and w[i + n] == own[k + n]:
                        n += 1
                    if n >= 4 and not (i and k and w[i - 1] == own[k - 1]):
                        runs.append((i, i + n, k, k + n))

            def grow(chain, covered):
                if needed <= covered and len(covered) >= 0.6 * len(own):
                    out.add(label)
                for r in runs:
                    _, b, _, k = chain[-1]
                    if r[0] > chain[-1][0] and r[1] > b and r[3] > k and r[0] - b <= 4 and (r[0] < b or not telling & set(w[b : r[0]])):
                        grow([*chain, r], covered | set(range(r[2], r[3])))

            for r in runs:
                grow([r], set(range(r[2], r[3])))
    return out


LICENSED = {
    "This work is licensed under the GNU General Public License version 2": {"gpl-2"},
    "This work is licensed under the GNU General Public License, version 3.": {"gpl-3"},
    "This work is licensed under the GNU Lesser General Public License version 3": {"lgpl-3"},
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": {"cc-by-nd"},
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": {"cc-by"},
    "this work is licensed under a creative commons attribution noncommercial sharealike 4.0 international license": {"cc-by-nc-sa"},
    "The contents of this file are subject to the Mozilla Public License Version 1.1": {"mpl-1.1"},
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1": set(),
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": {"mpl-2"},
    "you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License": {"gpl-2"},
    "you can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License": {"agpl-3"},
    "this work is not licensed under the gnu general public license": set(),
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this font software and associated documentation files, to deal in the software without restriction": {"mit"},
    "Licensed under the Apache License, Version 1.1": set(),
}


@pytest.mark.parametrize(("text", "want"), LICENSED.items())
def test_license_labels(text, want):
    assert labels_of(text) == want == labels_by_brute_force(text)


def test_license_labels_of_whole_tables_by_brute_force(spark, docs):
    got = {r.doc_id: r for r in queries.queries()["op2_license_scan"](spark, SF).collect()}
    for r in docs.collect():
        text = lower(r.text)
        found = labels_by_brute_force(text) if "licen" in text or "permi" in text or "software" in text else set()
        base = set(filter(None, got[r.doc_id].base_labels.split(",")))
        assert set(filter(None, got[r.doc_id].labels.split(","))) == base | found
        assert 0 <= got[r.doc_id].score <= 1 and (got[r.doc_id].n_base > 0) == bool(base)


def test_matching_statistics_are_longest():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 4, 12).tolist() for _ in range(4)]
    automaton = licenses.Automaton()
    automaton.add(texts)
    pieces = {tuple(t[i:j]) for t in texts for i in range(12) for j in range(i + 1, 13)}
    query = rng.integers(0, 5, 200).tolist()
    for i, (_, size) in enumerate(automaton.walk(query)):
        assert size == max((n for n in range(min(12, i + 1) + 1) if n == 0 or tuple(query[i + 1 - n : i + 1]) in pieces), default=0)


def test_token_counts(spark, odd, docs, empty, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    for df in (odd, docs):
        got = Counter(map(tuple, token_counts.count_tokens(df, path).collect()))
        want = Counter((r.doc_id, len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False))) for r in df.select("doc_id", "text").collect())
        assert got == want
    assert token_counts.count_tokens(empty, path).count() == 0
    # a tokenizer with other rules encodes whole texts
    changed = json.load(open(path, encoding="utf-8"))
    changed["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(changed), encoding="utf-8")
    assert token_counts.Counter(path).safe and not token_counts.Counter(str(tmp_path / "other.json")).safe
    other, text = Tokenizer.from_file(str(tmp_path / "other.json")), "one two, three. four " * 30
    assert token_counts.Counter(str(tmp_path / "other.json")).lengths([text]) == [len(other.encode(text, add_special_tokens=False))]
    got = by_id(queries.queries()["op4_token_counts"](spark, SF))
    assert all(got[r.doc_id].over_limit == (len(tokenizer.encode(r.text or "", add_special_tokens=False)) > 1024) for r in docs.collect())


def test_byte_bpe(odd, docs, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (odd, docs):
        encoded = byte_bpe.encode_documents(df, path, public_tokenizers.PATTERN, chunk=2_000, overlap=100)
        want = Counter((r.doc_id, np.array(encoding.encode_ordinary(r.text or ""), "<u4").tobytes()) for r in df.select("doc_id", "text").collect())
        assert Counter((r.doc_id, bytes(r.ids)) for r in encoded.collect()) == want
        decoded = byte_bpe.decode_documents(encoded, path)
        assert Counter((r.doc_id, bytes(r.bytes).decode()) for r in decoded.collect()) == Counter((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())
    assert byte_bpe.encode_documents(empty, path, public_tokenizers.PATTERN).count() == 0


def test_pieces_are_whole_pretokens():
    pattern, rng, held = regex.compile(public_tokenizers.PATTERN), np.random.default_rng(2), 0
    parts = ["ab", " ", "  ", "\n", "'ll", "12", ".", "é", "!!", " \n "]
    for _ in range(300):
        text = "".join(rng.choice(parts, 150))
        n = -(-len(text) // 64)
        pieces = [byte_bpe.piece_of(text[: 64 + 24] if k == 0 else text[k * 64 - 24 : k * 64 + 64 + 24], k == 0, k == n - 1, pattern, 64, 24) for k in range(n)]
        if None not in pieces:
            held += 1
            assert [p for x in pieces for p in pattern.findall(x)] == pattern.findall(text)
    assert held > 30


def linked(rows, size, percent):
    sets, parent = [], list(range(len(rows)))
    for r in rows:
        w = SPACED.findall(lower(r.text))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            low[root(i)] = min(low.get(root(i), r.doc_id), r.doc_id)
    return Counter((r.doc_id, len(s), low.get(root(i)) if s else r.doc_id) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join(spark, odd, empty, size, percent, monkeypatch):
    rng = np.random.default_rng(size)
    rows, i = [], 100
    for _ in range(8):  # families of edited copies around the threshold, with a passage that all share
        base = [f"w{x}" for x in rng.integers(0, 3_000, rng.integers(20, 200))] + [f"p{k}" for k in range(30)]
        for _ in range(12):
            copy = list(base)
            for at in rng.integers(0, len(copy), rng.integers(0, 6)):
                copy[at] = f"e{rng.integers(0, 99999)}"
            rows.append((i, " ".join(copy), "en", "s", 0))
            i += 1
    # near copies with null ids, one of which alone links two others; one id with different texts; null ids alone
    text = [f"b{k}" for k in range(60)]
    rows += [(None, " ".join(text[:-1]), "en", "s", 0), (7_000, " ".join(text), "en", "s", 0), (7_001, " ".join(text[:-7]), "en", "s", 0), (None, " ".join(text[:-4]), "en", "s", 0)]
    rows += [(7_002, " ".join(text[:-2]), "en", "s", 0), (7_002, "another text of this id", "en", "s", 0), (None, "c " * 30 + "d", "en", "s", 0), (None, "c " * 30 + "d", "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA).union(odd.select(SCHEMA_NAMES))
    monkeypatch.setattr(jaccard_join, "LIST_PART", 5)
    if size == 5:
        monkeypatch.setattr(common, "MOST_BITMAPS", 2)
    got = Counter((r.doc_id, r.n_shingles, r.component) for r in jaccard_join.link_texts(df, size=size, percent=percent).collect())
    assert got == linked(df.select("doc_id", "text").collect(), size, percent)
    assert jaccard_join.link_texts(empty).count() == 0 and jaccard_join.drop_near_copies(empty).count() == 0
    clash = df.withColumn("node", F.lit("clash")).withColumn("file", F.lit("clash")).withColumn("row", F.lit("clash"))
    kept = jaccard_join.drop_near_copies(clash, size=size, percent=percent).collect()
    assert all(r.node == r.file == r.row == "clash" for r in kept)
    want = linked(df.select("doc_id", "text").collect(), size, percent)
    assert len(kept) == sum(n for (_, m, _), n in want.items() if not m) + len({c for _, m, c in want if m and c is not None}) + 2  # two components have null ids alone
    assert {r.doc_id for r in kept} >= {c for _, m, c in want if m and c is not None}


SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def test_language_model(spark, docs, odd, empty):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    model, counts, least, tokens = language_model.fit(docs, held)
    got = by_id(language_model.score(docs, model, counts, least))
    words = {r.doc_id: [*SPACED.findall(lower(r.text)), "\n"] for r in docs.collect()}
    c = Counter(w for i, own in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in own)
    total, distinct = sum(c.values()), len(c)
    assert tokens == total
    for i, own in words.items():
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        assert got[i].base_score == pytest.approx(base) and got[i].n_tokens == len(own) and got[i].n_known == sum(c[w] > 0 for w in own)
    test = [r for i, r in got.items() if zlib.crc32(str(i).encode()) % 5 == 1]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)
    assert language_model.score(odd, model, counts, least).count() == len(ODD)
    nothing = language_model.fit(empty, F.lit(False))
    assert all(r.score <= 0 for r in language_model.score(odd, *nothing[:3]).collect())


def test_the_model_is_a_distribution(docs):
    model, counts, _, _ = language_model.fit(docs, F.lit(False))
    tokens = language_model.Tokens.of(pa.array(["the of and"]))
    _, _, place, rows, slot_rows = model.prepared(tokens)
    layers = language_model.softmax(model.class_bias, model.classes, rows), language_model.softmax(model.slot_bias[place // 32], model.slots, slot_rows)
    for layer in layers:
        assert layer.sum(1) == pytest.approx(np.ones(len(layer)))
    known = counts.where("bucket >= 0").toPandas()
    alone = set(model.known[model.own >= 0].astype(np.int64).tolist())
    tail = known[~known.word.isin(alone)]
    for place, own in tail.groupby(model.shared[tail["bucket"].to_numpy()])["n"]:
        assert ((own + 0.5).sum() + 0.5) / model.slot_total[place] == pytest.approx(1)


def test_the_model_has_all_classes_and_features(docs):
    model, _, _, _ = language_model.fit(docs, F.lit(False))
    assert (model.own >= 0).sum() == 512 and model.slot_bias.shape == (32, 32)
    assert 512 <= model.shared.min() and model.shared.max() < 1_024 and len(set(model.shared.tolist())) > 100
    tokens = language_model.Tokens.of(pa.array(["one b c d", "the b c d"]))
    _, _, place, rows, slot_rows = model.prepared(tokens)
    same = [bool(r[3] == r[8]) for r in (*rows, *slot_rows)]  # of d, after words that differ three before
    assert same == [True, True, False, True, True, True] and place[0] != place[5]
    assert rows[0][0] == 1_024 and max(map(max, rows)) < len(model.classes) and max(map(max, slot_rows)) < len(model.slots) <= 65_536


def test_language_model_without_broadcast_words(docs, monkeypatch):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    want = {}
    for most in (400_000, 600):
        monkeypatch.setattr(language_model, "MOST_COMMON", most)
        monkeypatch.setattr(language_model, "FAN_IN", 16 if most > 600 else 2)
        model, counts, least, _ = language_model.fit(docs.repartition(5), held)
        got = by_id(language_model.score(docs, model, counts, least))
        assert not want or {i: (r.n_tokens, r.n_known, pytest.approx(r.base_score)) for i, r in got.items()} == {i: (r.n_tokens, r.n_known, r.base_score) for i, r in want.items()}
        want = got


def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(600):
        w = rng.choice([f"w{k}" for k in range(300)], 40).tolist()
        toxic = int(i % 6 == 0)
        if toxic:
            w[5], w[20] = rng.choice(["slurro", "slurra", "vileness"], 2)
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, toxic))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    got = by_id(toxicity.score(docs, model))
    test = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i].score >= 0.5) == (i % 6 == 0) for i in test) >= 0.97 * len(test)
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    kept = toxicity.drop_toxic(odd, model)
    assert kept.columns == odd.columns and all(r[c] == "clash" for r in kept.collect() for c in CLASH)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in toxicity.score(odd, model).collect() if r.score < 0.5)
    assert toxicity.score(empty, toxicity.fit(empty, marks)).count() == 0


def test_sharding(spark, odd, empty):
    shards = [f"s{k}" for k in range(7)]
    table = sharding.lookup_table(shards, 1_009)
    share = Counter(table)
    assert max(share.values()) - min(share.values()) <= 1
    fewer = sharding.lookup_table(shards[:-1], 1_009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.1 * 1_009
    placed = sharding.place(odd, "doc_id", shards, 1_009)
    for r in placed.collect():
        key = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 1_009
        assert (r.slot, r.shard) == (slot, shards[table[slot]])
    assert sharding.place(empty, "doc_id", shards, 1_009).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 1_000)
    named = sharding.place(odd.withColumns({"Slot": F.lit("old"), "a.b": F.lit(1), "SHARD_": F.lit(2)}), "Slot", shards, 1_009)
    assert named.columns == [*odd.columns, "a.b", "SHARD_", "slot", "shard"]
    assert {r.slot for r in named.collect()} == {int(hashlib.md5(b"old").hexdigest()[:15], 16) % 1_009}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
