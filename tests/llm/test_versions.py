"""Fingerprints, fill-in-the-middle and Merkle manifests against plain versions, and on odd tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runweave.llm import common, fill_in_middle, fingerprints, licenses, merkle

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["id", "h", "size", "packed", "grp", "idx", "n", "level", "digest", "at", "part", "edge", "output", "form", "top", "path"]
LONG = "\n".join(f"line {k} of a long text, word{k} word{k % 7} and so on" for k in range(30_000))
ODD = [
    (1, None, "en"), (2, "", None), (3, " \t\n", "en"), (4, "one\n\n two  words\nthree", "de"), (5, "same", "en"), (5, "same", "en"), (5, "other", "en"), (None, "no id\nbut lines", None), (None, None, None),
    (6, "Ünder thé bridge\n東京\n" * 5, "fr"), (7, "has a <P> in it\nand more", "fr"), (8, "<" * 9 + "\nS>M>\n<S\n>", "fr"), (9, LONG, "en"), (10, LONG[:500_000] + "new\n" + LONG[500_000:], "en"), (11, "x" * 40_000, "es"),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(i, t, g, "s" if i else None, len(t) if t and i != 4 else None) for i, t, g in ODD], SCHEMA)
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH)).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


UNITS = {"line": re.compile(r"[^\n]*\n|[^\n]+"), "word": re.compile(r"[\t-\r ]+|[^\t-\r ]+[\t-\r ]*"), "char": re.compile(r"(?s).")}


def plain_fim(key, text, unit, rate, spm, seed, p, s, m):
    units = UNITS[unit].findall(text)
    h = [int(sha(f"{seed}:{'' if key is None else key}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in (p, s, m)) or h[2] % 100 >= rate:
        return key, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return key, len(units), "spm", len(pre), len(mid), s + suf + p + pre + m + mid
    return key, len(units), "psm", len(pre), len(mid), p + pre + s + suf + m + mid


@pytest.mark.parametrize("unit, rate, spm, seed, markers", [("line", 100, 50, 7, ("<P>", "<S>", "<M>")), ("word", 60, 30, 1, ("<P>", "<S>", "<M>")), ("char", 100, 0, 2, ("«p", "«s", "«m")), ("line", 100, 100, 3, ("Z", "Q", "J"))])
def test_fill_in_middle(odd, docs, unit, rate, spm, seed, markers):
    for df in (odd, docs):
        texts = df.select("doc_id", "text").collect()
        out = fill_in_middle.fill_in_middle(df, unit=unit, rate=rate, spm=spm, seed=seed, markers=markers)
        assert Counter(map(tuple, out.collect())) == Counter(plain_fim(i, t or "", unit, rate, spm, seed, *markers) for i, t in texts)
        back = out.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form"), markers))
        assert Counter(map(tuple, back.collect())) == Counter((i, t or "") for i, t in texts)


def test_fill_in_middle_refuses_and_takes_empty_tables(empty):
    assert fill_in_middle.fill_in_middle(empty).count() == 0
    for markers in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("aba", "c", "d")):
        with pytest.raises(ValueError, match="markers"):
            fill_in_middle.fill_in_middle(empty, markers=markers)
    with pytest.raises(ValueError, match="unit"):
        fill_in_middle.fill_in_middle(empty, unit="page")


def test_select_finds_every_rank():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 1000):
        bits = [int(x) for x in rng.permutation(n)[: max(1, n // 3)]]
        mask = sum(1 << b for b in bits)
        assert [fill_in_middle.select(mask, k, n) for k in range(len(bits))] == sorted(bits)


def plain_tree(leaves, size):
    """The root, and the siblings of each leaf with what folds them."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[k : k + size] for k in range(0, len(level), size)]
        for k, path in enumerate(paths):
            run, j = runs[at[k] // size], at[k] % size
            path.append(("".join(run[:j]), "".join(run[j + 1 :])))
            at[k] //= size
        level = [sha("".join(run)) for run in runs]
    return level[0], paths


def plain_manifest(rows, size):
    def leaf(r, n_chars):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, n_chars, r.text)))

    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.n_chars), r))
    keys = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], size) for g in keys}
    root, tops = plain_tree([trees[g][0] for g in keys], size)
    out = []
    for g, top in zip(keys, tops, strict=True):
        for (_, _, own, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None
            fold = leaf(r, r.n_chars + 1) if changed else own
            for a, b in path + top:
                fold = sha(a + fold + b)
            out.append((r.doc_id, own, trees[g][0], root, sha("".join(a + b for a, b in path + top)), fold, fold == root))
            assert changed != (fold == root)
    return out


@pytest.mark.parametrize("size", [2, 3, 20])
def test_merkle(odd, docs, size):
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    for df in (odd, docs) if size < 20 else (odd,):
        rows = merkle.manifest(df, size=size, claims={"n_chars": F.col("n_chars") + F.when(changed, 1).otherwise(0)})
        proof = F.array_join(F.transform("path", lambda s: F.concat(s.left, s.right)), "")
        got = [tuple(r) for r in rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256), "folded_root", "verified").collect()]
        assert Counter(got) == Counter(plain_manifest(df.collect(), size))


def test_merkle_of_no_rows_of_one_and_of_other_columns(spark, empty):
    assert merkle.manifest(empty).count() == 0
    one = merkle.manifest(empty.union(spark.createDataFrame([(1, "a", "en", "s", 1)], SCHEMA))).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.path == []
    other = spark.createDataFrame([(f"k{k}", k % 3, 0.5 * k) for k in range(40)], "key string, bucket int, value double")
    rows = merkle.manifest(other, "key", "bucket", ("key", "value"), claims={"value": F.when(F.col("key") == "k7", 9.9).otherwise(F.col("value"))})
    assert {r.key for r in rows.collect() if not r.verified} == {"k7"}
    with pytest.raises(ValueError, match="two nodes"):
        merkle.manifest(other, "key", "bucket", ("key",), size=1)


def plain_paragraphs(text):
    out, words = Counter(), re.compile(rb"[^\x20\x09-\x0D]+")
    for line in text.encode().split(b"\n"):
        begin = None
        for m in words.finditer(line):
            begin = m.start() if begin is None else begin
            if int(common.word_hashes([m[0].decode()])[0]) % fingerprints.PIECE_WORDS == 0:
                out[line[begin : m.end()]] += 1
                begin = None
            end = m.end()
        if begin is not None:
            out[line[begin:end]] += 1
    return out


def jaccard(a, b):
    union = (a | b).total()
    return (a & b).total() / union if union else 1.0


def test_edited_fingerprints(odd, docs, empty):
    for df in (odd.where("doc_id IS NULL OR doc_id NOT IN (9, 10)"), docs.where("doc_id < 60"), docs.where("doc_id = 3")):
        rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
        rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h), reverse=True)
        paras, want = [plain_paragraphs(r.text) for r in rows], []
        for k, r in enumerate(rows):
            after, half = rows[(k + 1) % len(rows)].text, len(r.text) // 2
            edited = r.text[: len(r.text) - half] + after[:half]
            want.append((r.doc_id, len(r.text), sha(edited), jaccard(paras[k], plain_paragraphs(edited)), jaccard(paras[k], paras[(k + 1) % len(rows)]), paras[k].total()))
        got = fingerprints.edited_fingerprints(df)
        found = got.select("doc_id", "n_chars", "edited_sha256", F.round("near_edited", 12), F.round("near_next", 12), "n_paragraphs").collect()
        assert Counter(map(tuple, found)) == Counter((*x[:3], round(x[3], 12), round(x[4], 12), x[5]) for x in want)
        own = {r.text: fingerprints.fingerprints(df).where(F.col("doc_id").eqNullSafe(r.doc_id)).first().fingerprint for r in rows[:3]}
        assert all(r.fingerprint in own.values() for r in got.collect() if r.doc_id == rows[0].doc_id)
    assert fingerprints.edited_fingerprints(empty).count() == 0


def test_long_texts_and_order_across_tasks(odd, docs, spark):
    got = {(r.doc_id, r.n_chars): r for r in fingerprints.edited_fingerprints(odd).collect()}
    a, b = LONG[:500_000] + "new\n" + LONG[500_000:], LONG
    r = got[10, len(a)]
    assert r.edited_sha256 == sha(a[: len(a) - len(a) // 2] + b[: len(a) // 2]) and 0.9 < r.near_next < 1
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = fingerprints.edited_fingerprints(docs.repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for r in rows:
        t, after = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        assert r.edited_sha256 == sha(t[: len(t) - len(t) // 2] + after[: len(t) // 2])
    assert len(rows) == len(texts)


def test_peeling_recovers_differences_in_any_number_of_cells(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["\n".join(f"p{x}" for x in rng.integers(0, 60, rng.integers(0, 50))) for _ in range(40)]
    rows, digests = fingerprints.paragraphs(pa.array(texts))
    sets = [set(digests[rows == k].tolist()) for k in range(40)]
    assert [len(s) for s in sets] == [len(t.split()) for t in texts]
    pairs = np.array([(a, b) for a in range(40) for b in range(40)])
    want = [len(sets[a] ^ sets[b]) for a, b in pairs]
    for cells, full in ((4, 8), (64, 8), (4, 0)):
        monkeypatch.setattr(fingerprints, "FULL", full)
        got, tried = fingerprints.numbers_of_differences(rows, digests, 40, pairs, cells)
        assert got.tolist() == want
    counts, sums = fingerprints.sketch(rows, digests, 40, 128)
    whole, pair, digest, first = fingerprints.peel(counts[pairs[:, 0]] - counts[pairs[:, 1]], sums[pairs[:, 0]] ^ sums[pairs[:, 1]])
    assert whole.mean() > 0.99
    for k in np.flatnonzero(whole)[::37]:
        a, b = pairs[k]
        assert set(digest[(pair == k) & first].tolist()) == sets[a] - sets[b] and set(digest[(pair == k) & ~first].tolist()) == sets[b] - sets[a]


@pytest.mark.parametrize("most_cells", [1 << 14, 8])
def test_differences_of_two_versions(spark, most_cells):
    def lines(*numbers):
        return "\n".join(f"paragraph number {n}" for n in numbers)

    old = spark.createDataFrame([(1, lines(*range(400))), (2, lines(1, 2, 3)), (3, None), (4, lines(5)), (6, lines(7))], "doc_id long, text string")
    new = spark.createDataFrame([(1, lines(*range(100, 600))), (2, lines(1, 3, 9, 9)), (3, ""), (5, lines(6)), (6, lines(7))], "doc_id long, text string")
    rows = fingerprints.differences(old, new, most_cells=most_cells).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(got) == 6 and got[1].cells > 8
    for i, (gone, added) in {1: (100, 200), 2: (1, 2), 3: (0, 0), 4: (1, 0), 5: (0, 1), 6: (0, 0)}.items():
        assert (len(got[i].removed), len(got[i].added)) == (gone, added)
    assert {i: round(r.likeness, 6) for i, r in got.items()} == {1: 0.5, 2: 0.4, 3: 1, 4: 0, 5: 0, 6: 1}
    assert fingerprints.differences(old.limit(0), new.limit(0)).count() == 0


def test_whole_licences_are_found_in_part_and_with_other_names():
    scanner = licenses.Scanner(licenses.BASE_PHRASES, licenses.TEMPLATES)

    def labels(text):
        _, pieces, told = scanner.scan(licenses.Words(pa.array([text.lower()]), licenses.ALNUM), 1)
        return {c[0] for c in scanner.chains(pieces[0], told[0])}

    for label, text in licenses.WHOLE.items():
        w = [x.lstrip("*") for x in text.split()]
        assert label in labels("Copyright (c) X. " + " ".join(w).capitalize() + " the end")
        assert label in labels(" ".join(w[: int(0.7 * len(w))])), label
        assert label not in labels(" ".join(w[-len(w) // 3 :])), label
        named = [x for k, x in enumerate(w) for x in ([x, "acme"] if k % 40 == 39 else [x])]
        assert label in labels(" ".join(named)), label
