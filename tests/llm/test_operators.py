"""The operators against brute force, on the small tables and on odd rows."""

import hashlib
import json
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.llm import (fingerprints, jaccard_join, license_scan, line_dedup, packing, piece_codec, pretokens,
                        quality_rules, shingles, token_counts, token_files, warc)
from gradus.llm.queries import BYTE_BPE, PIECE_BPE

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_BPE)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# -- op1 ---------------------------------------------------------------------------------------------------------

def slow_fingerprint(data: bytes) -> str:
    rolled = []
    padded = bytes(8) + data
    for i in range(8, len(padded)):
        h = sum(padded[i - j] * pow(fingerprints._MULTIPLIER, j, 1 << 32) for j in range(8)) & 0xFFFFFFFF
        h ^= h >> 16
        h = h * 0x7FEB352D & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x846CA68B & 0xFFFFFFFF
        rolled.append(h ^ h >> 16)

    def signature(size):
        out, start = "", 0
        for i, h in enumerate(rolled):
            if h % size == size - 1 or i == len(data) - 1:
                v = sum((c + 1) * pow(fingerprints._BASE, k, 1 << 64) for k, c in enumerate(data[start:i + 1])) % (1 << 64)
                v = (v ^ v >> 31) * 0x94D049BB133111EB % (1 << 64)
                out, start = out + chr(fingerprints._ALPHABET[v >> 58]), i + 1
        return out

    size = 4
    while sum(h % size == size - 1 for h in rolled) >= 64:
        size *= 2
    return f"{size}:{signature(size)}:{signature(2 * size)}"


def test_fingerprints_agree_with_a_slow_version_at_any_block(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [b"", b"a", b"ab" * 400, bytes(60), b"some plain words in a row", bytes(rng.integers(0, 256, 2500, dtype=np.uint8))]
    expected = [slow_fingerprint(t) for t in texts]
    assert fingerprints.fingerprints(texts) == expected
    monkeypatch.setattr(fingerprints, "_BLOCK", 700)
    assert fingerprints.fingerprints(texts) == expected


def slow_likeness(a, b):
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    if a == b:
        return 1.0
    (s, a1, a2), (t, b1, b2) = ((int(x), y, z) for x, y, z in (v.split(":") for v in (a, b)))
    x, y = {s: (a1, b1), 2 * s: (a2, b1), s // 2: (a1, b2)}.get(t, ("", ""))
    return 1 - distance(x, y) / max(len(x), len(y)) if x or y else 0.0


@pytest.mark.parametrize("kind", ["documents", "odd_documents"])
def test_neighbours_and_edits(request, kind):
    df = request.getfixturevalue(kind)
    rows = sorted(texts_of(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    expected = []
    for k, (doc, text) in enumerate(rows):
        own, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        quarter = len(own) // 4
        changed = own[:len(own) - quarter] + after[:quarter]
        prints = fingerprints.fingerprints([own.encode(), changed.encode(), after.encode()])
        expected.append((doc, len(own), hashlib.sha256(changed.encode()).hexdigest(), prints[0], prints[1],
                         round(slow_likeness(prints[0], prints[1]), 9), round(slow_likeness(prints[0], prints[2]), 9)))
    got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in fingerprints.compare_documents(df).collect()]
    assert Counter(got) == Counter(expected)


# -- op2, op8 ----------------------------------------------------------------------------------------------------

def test_base_features_of_odd_documents(odd_documents):
    for row in quality_rules.base_features(odd_documents).collect():
        text = row.text or ""
        words = WORDS.findall(text)
        grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
        covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        assert (row.n_words, row.word_chars, row.n_dup_lines, row.n_repeat_words) == (
            len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(covered))
        assert row.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_thresholds_follow_their_group(spark):
    rows = [(i, " ".join(["plain words here are many"] * 1) + " " + " ".join(f"w{i}x{k}" for k in range(20)) + ("#" * (8 if s == "b" else 0)), "en", s)
            for i, s in enumerate("ab" * 100)]
    rows.append((1000, rows[0][1] + "#" * 8, "en", "a"))
    judged = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert {r.doc_id for r in judged.filter("not kept").collect()} == {1000}


@pytest.mark.parametrize("metric,spoil", [
    ("word_length", lambda words: [w + "lengthened" * 3 for w in words]), ("short words", lambda words: [w[:1] for w in words]),
    ("symbol_share", lambda words: [w + "##" for w in words]),
    ("dup_line_share", lambda words: words[:1] * 2 + words), ("repeat_share", lambda words: words[:60] + words[:6])])
def test_each_metric_rejects_an_outlier_of_its_group(spark, metric, spoil):
    """A document that passes the base rules goes when it stands out in its own group, and stays where all are like it."""
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 8))) for _ in range(4000)]

    def text(spoilt):
        words = list(rng.choice(vocabulary, 60, replace=False))
        return "\n".join(spoil(words)) if spoilt else "\n".join(words)

    rows = [(i, text(False), "en", "plain") for i in range(200)] + [(1000, text(True), "en", "plain")]
    rows += [(2000 + i, text(True), "en", "other") for i in range(200)]
    judged = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    bad = judged.filter("not kept").collect()
    assert 1000 in {r.doc_id for r in bad} and not any(r.base_failed for r in bad), metric
    assert sum(r.doc_id < 1000 for r in bad) < 8 and sum(r.doc_id >= 2000 for r in bad) < 16


def test_features_and_symbols_of_plain_rows(spark):
    df = spark.createDataFrame([(1, "a#b * $%&|<> #\nx")], "doc_id long, text string")
    assert quality_rules.base_features(df).first().n_symbols == 9


def test_carried_columns_of_any_name_come_back_unchanged(spark, sf):
    """Stages that carry all columns leave every one as it is, whatever steps inside are called."""
    import corpus_pipeline

    names = ["row", "carried", "id", "site", "text_", "several", "key", "gone", "again", "kept", "n_lines", "n_removed", "n_words", "base_failed",
             "word_chars", "_words", "_lines", "_sorted", "_windows", "_lang", "_source", "_hash", "_all", "_cuts", "_removed", "_rid", "_id",
             "_text_hash", "_key", "_again", "most_word_length", "least_word_length", "rows", "lang_x", "_first", "_place"]
    rows = [(i, f"own line {i} " + " ".join(f"w{i}x{k}" for k in range(30)) + "\na line that all the many sites have", "en", f"s{i % 12}") for i in range(60)]
    df = spark.createDataFrame([(*r, *(f"{n}{r[0]}" for n in names)) for r in rows],
                               "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns
        for r in out.collect():
            assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names], name
        assert out.count() > 40
    plain = line_dedup.drop_shared_lines(df.drop("n_lines", "n_removed"))
    assert {r["_hash"] for r in plain.collect()} == {f"_hash{i}" for i in range(60)}
    for taken in ("kept", "N_words"):
        with pytest.raises(ValueError, match="already there"):
            quality_rules.quality_rules(df.select("doc_id", "text", "lang", "source", df["kept"].alias(taken)), carry=True)
    with pytest.raises(ValueError, match="n_lines"):
        line_dedup.drop_shared_lines(df)


def test_line_dedup_of_odd_documents(spark, odd_documents):
    shared = "a line that many sites have"
    rows = [(i, f"own line {i}\n{shared} \n\nlast {i}", "en", f"s{i}") for i in range(12)] + [(99, shared, "en", None), (98, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.drop_shared_lines(df).collect()}
    assert got[0] == (rows[0][1], 3, 0) and got[5] == ("own line 5\n\nlast 5", 3, 1) and got[99] == ("", 1, 1) and got[98] == (None, 0, 0)
    kept = line_dedup.drop_shared_lines(odd_documents, min_sites=3)
    assert sorted(map(str, texts_of(kept))) == sorted(map(str, texts_of(odd_documents)))


# -- op3, op4, op5, op9 ------------------------------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["documents", "odd_documents"])
def test_packing_places_every_piece(request, library, kind):
    df = request.getfixturevalue(kind)
    wanted = Counter()
    for doc, text in texts_of(df):
        ids = np.array([*ids_of(library, text), 0], "<u4")
        bounds = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        wanted.update((doc, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:])))
    rows = packing.pack_documents(df, BYTE_BPE).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    sequences = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 2048
    assert len(sequences) <= math.ceil(sum(sequences.values()) / 2048) + 1


def test_local_search_saves_a_bin():
    sizes = [6, 4, 5, 5, 3, 4, 3]
    assert len(packing.improve([[0], [2, 1], [3, 4], [5, 6]], sizes, 10)) == 3
    for seed in range(20):
        sizes = np.random.default_rng(seed).integers(1, 60, 200).tolist()
        bins = packing.pack(sizes, 60)
        assert sorted(i for b in bins for i in b) == list(range(200)) and max(sum(sizes[i] for i in b) for b in bins) <= 60


def test_search_goes_on_across_shards(spark):
    """Small shards end near the bound and below what best fit alone needs in them; every piece is placed once."""
    sizes = np.random.default_rng(3).integers(1, 2048, 3000) ** 2 // 2048 + 1
    loose = spark.createDataFrame(list(enumerate(sizes.tolist())), "serial long, length long")
    bound = math.ceil(sizes.sum() / 2048)
    for pieces, excess in ((64, 0.01), (256, 0.005), (1024, 0.002)):
        rows = [r for part in packing.pack_pieces(loose, 2048, pieces) for r in part.collect()]
        assert Counter((r.serial, r.length) for r in rows) == Counter(enumerate(sizes.tolist()))
        ends = {}
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == ends.get(r.sequence_id, 0)
            ends[r.sequence_id] = r.offset + r.length
        alone = sum(len(packing.best_fit(part.tolist(), 2048)) for part in np.array_split(sizes, round(3000 / pieces)))
        assert max(ends.values()) <= 2048 and len(ends) <= bound * (1 + excess) + 1 and len(ends) < alone


def test_token_files_give_every_document_back(spark, library, odd_documents):
    manifest = token_files.write_tokens(odd_documents, BYTE_BPE, length=64)
    rows = token_files.read_tokens(spark, manifest).orderBy("start").collect()
    order = sorted(texts_of(odd_documents), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for row, (doc, text) in zip(rows, order, strict=True):
        ids = np.array([*ids_of(library, text), 0], "<u4")
        assert tuple(row) == (doc, at, len(ids), zlib.crc32(ids))
        at += len(ids)
    file = token_files.SequenceFile(*token_files.open_folder(manifest.first().file))
    ids, mask = file.sequence(0)
    assert len(ids) == 64 and mask.all() and not ids.flags.owndata


def test_sequences_by_division(tmp_path):
    """Batches hold 256 sequences whatever the documents' sizes; ids and masks are views of the mapped file."""
    rng, path = np.random.default_rng(4), str(tmp_path / "x.arrow")
    ids = rng.integers(0, 50_000, 20_003).astype(np.uint32)
    folder, root = token_files.open_folder(f"file://{path}")
    with folder.open_output_stream(root) as sink:
        out = token_files.SequenceWriter(sink, 16, token_files.pa.uint16())
        for piece in np.split(ids, np.sort(rng.integers(0, len(ids), 40))):
            out.append(piece)
        out.close()
    file = token_files.SequenceFile(folder, root)
    batches = [file.reader.get_batch(k).num_rows for k in range(file.reader.num_record_batches)]
    assert set(batches[:-1]) == {256} and sum(batches) == math.ceil(len(ids) / 16)
    for i in (0, 255, 256, 777, sum(batches) - 1):
        got, mask = file.sequence(i)
        wanted = ids[16 * i:16 * i + 16]
        assert not got.flags.owndata and not mask.flags.owndata
        assert got[:len(wanted)].tolist() == wanted.tolist()
        assert np.unpackbits(mask, bitorder="little").tolist() == [1] * len(wanted) + [0] * (16 - len(wanted))
    assert np.array_equal(file.tokens(4090, 12_345), ids[4090:12_345])


def test_rows_that_share_an_id_spread_over_files(spark):
    df = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).repartition(8)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")  # so little text would end in one partition otherwise
    try:
        manifest = token_files.write_tokens(df, BYTE_BPE)
    finally:
        spark.conf.set(coalesce, before)
    assert manifest.count() > 1 and manifest.agg(F.sum("documents")).first()[0] == 20_000


@pytest.mark.parametrize("kind", ["documents", "odd_documents"])
def test_token_counts(request, library, kind):
    df = request.getfixturevalue(kind)
    expected = Counter((d, len((t or "").encode()), len(ids_of(library, t)), len(ids_of(library, t)) > 512) for d, t in texts_of(df))
    assert Counter(map(tuple, token_counts.count_tokens(df, BYTE_BPE).collect())) == expected


ODD = ["  a  b\n\n c", "it's we'll 'sabc x''s 'T they've\n's  's", "<|endoftext|>a<|endoftext|><|endoftext|> b", " \n", "é 12½ ²³ 漢字　x y",
       "re're 'll'm", "x" * 3000, "ab " * 9 + "\t\t", " ' s", "\r\n\r\n1a1"]


def test_pretokens_of_odd_texts(library, monkeypatch):
    monkeypatch.setattr(pretokens, "PIECE_CHARS", 20)
    monkeypatch.setattr(pretokens, "BLOCK_CHARS", 50)
    memo, counts = pretokens.LibraryIds(BYTE_BPE, limit=5), token_counts.MergedCounts(BYTE_BPE, limit=5)
    long = "some words, and more  of them\nin several lines " * 5
    for text in [*ODD, long]:
        assert memo.encode([text])[0].tolist() == ids_of(library, text)
        assert counts.tokens([text]).tolist() == [len(ids_of(library, text))]


def test_memory_of_the_split_and_its_memo():
    class Numbered(pretokens.Memo):
        def clear(self):
            self.words = 0

        def add(self, words):
            self.words += len(words)

    memo, texts = Numbered(), [" ".join(f"w{k}" for k in range(first, first + 50_000)) for first in range(0, 200_000, 50_000)]
    memo.clear()
    tracemalloc.start()
    try:
        pretokens._classes.__wrapped__()
        assert tracemalloc.get_traced_memory()[1] < 8 << 20  # the table itself takes one MB
        pretokens._classes()
        start = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        rows = [memo.rows(pretokens.Split(block)) for block in pretokens.blocks(texts, None)]
        assert tracemalloc.get_traced_memory()[1] - start < 40 << 20
    finally:
        tracemalloc.stop()
    assert memo.words > 199_000 and len(np.unique(np.concatenate(rows))) == memo.words
    again = [memo.rows(pretokens.Split(block)) for block in pretokens.blocks(texts, None)]
    assert all(map(np.array_equal, rows, again))


@pytest.mark.parametrize("kind", ["documents", "odd_documents"])
def test_pieces_agree_with_the_library(request, kind):
    import sentencepiece

    df, model = request.getfixturevalue(kind), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    expected = Counter((d, tuple(model.encode(t or "")), model.decode(model.encode(t or ""))) for d, t in texts_of(df))
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in piece_codec.encode_documents(df, PIECE_BPE).collect()) == expected


# -- op6 ---------------------------------------------------------------------------------------------------------

def slow_sets(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def slow_components(rows):
    sets = [slow_sets(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        least.setdefault(root(k), []).append(doc)
    return Counter((doc, len(sets[k]), min((d for d in least[root(k)] if d is not None), default=None)) for k, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("kind", ["documents", "odd_documents", "edits"])
def test_jaccard_components(request, spark, kind):
    if kind == "edits":  # chains of small edits, near and beyond the threshold, over a common passage
        rng, rows = np.random.default_rng(3), []
        common = [f"c{k}" for k in range(25)]
        for group in range(12):
            words = [f"g{group}w{k}" for k in range(40)]
            for copy in range(14):
                words = list(words)
                words[rng.integers(40)] = f"e{group}x{copy}"
                rows.append((len(rows), " ".join(words + common * (group % 2))))
        df = spark.createDataFrame(rows, "doc_id long, text string")
    else:
        df = request.getfixturevalue(kind)
    assert Counter(map(tuple, jaccard_join.jaccard_components(df).collect())) == slow_components(texts_of(df))


def test_every_link_inside_a_component(spark):
    rng, rows = np.random.default_rng(5), [(100, "alone with few words"), (101, None)]
    for group in range(3):
        words = [f"g{group}w{k}" for k in range(60)]
        for copy in range(10):
            edited = list(words)
            for k in range(copy % 3):
                edited[rng.integers(60)] = f"e{group}x{copy}y{k}"
            rows.append((10 * group + copy, " ".join(edited)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert_links(df, jaccard_join.count_links(df), distinct=True)


def assert_links(df, counted, distinct=False):
    """n_links of every row, and all links between distinct sets, against all pairs."""
    sets = {i: slow_sets(t) for i, t in texts_of(df)}
    linked = {(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    degree = Counter(x for pair in linked for x in pair)
    least = {s: min(i for i in sets if sets[i] == s) for s in sets.values()}
    assert {r.doc_id: r.n_links for r in counted.collect()} == {i: degree[i] for i in sets}
    if distinct:
        expected = {tuple(sorted((least[sets[i]], least[sets[j]]))) for i, j in linked if sets[i] != sets[j]}
        assert sorted(map(tuple, jaccard_join.jaccard_links(df).collect())) == sorted(expected)


@pytest.mark.parametrize("block", [8, 512])
def test_links_counted_inside_large_homes(spark, monkeypatch, block):
    """Near and far members of one passage: some links follow from costs, some from blocks, some cross homes."""
    monkeypatch.setattr(jaccard_join, "HOME_BLOCK", block)
    rng, rows = np.random.default_rng(11), []
    for group, length in enumerate((80, 200)):
        words = [f"g{group}w{k}" for k in range(length)]
        for copy in range(70):
            edited = list(words)
            for k in rng.choice(length, rng.integers(0, length // 22), replace=False):
                edited[k] = f"e{rng.integers(3)}k{k}" if copy % 2 else f"e{group}c{copy}k{k}"
            rows += [(len(rows) + k, " ".join(edited)) for k in range(1 + copy % 5 // 4)]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = jaccard_join.jaccard_join(df).cache()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == slow_components(texts_of(df))
    assert_links(df, got)
    assert 2 * len(rows) < got.agg(F.sum("n_links")).first()[0] < len(rows) * (len(rows) // 2 - 1)


def test_join_of_odd_rows(odd_documents):
    got = jaccard_join.jaccard_join(odd_documents)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == slow_components(texts_of(odd_documents))
    assert sorted((r.doc_id or 0, r.n_links) for r in got.collect()) == [
        (0, 0), (1, 2), (2, 2), (2, 2), (3, 0), (4, 0), (5, 1), (6, 0), (7, 0), (8, 0), (9, 0), (10, 1)]


def test_near_copies_without_id(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(None, " ".join(words)), (7, " ".join([*words[:-1], "end"])), (None, " ".join(["start", *words[1:]])), (8, "nothing like the others at all")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == slow_components(rows) == Counter({(None, 56, 7): 2, (7, 56, 7): 1, (8, 2, 8): 1})


def test_shingles_count_like_words():
    texts = ["", " ", "A b", "a B c d e", "a b c d e f a b c d e", "x y\x0bz"]
    assert [len(s) for s in shingles.shingle_sets([t.encode() for t in texts])] == [len(slow_sets(t)) for t in texts]


# -- op7, op10 ---------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["documents", "odd_documents"])
def test_licenses(request, kind):
    df = request.getfixturevalue(kind)
    templates = [(name, license_scan.bigrams(t)) for name, ts in license_scan.TEMPLATES.items() for t in ts]
    expected = Counter()
    for doc, text in texts_of(df):
        best = []
        for line, segment in license_scan.segments(text or ""):
            hits = [(-license_scan.dice(license_scan.bigrams(segment), b), line, n) for n, b in templates]
            hits = [h for h in hits if h[0] <= -license_scan.LEAST]
            best += [min(hits)] if hits else []
        first = min(best, default=None)
        expected[(doc, len(best), *((first[2], -first[0], first[1]) if first else (None, None, None)))] += 1
    assert Counter(map(tuple, license_scan.scan_licenses(df).collect())) == expected


def slow_words(text):
    """Words in lower case with their places: letters and digits, joined by single dots and hyphens."""
    words, at, n = [], 0, len(text)
    while at < n:
        end = at
        while end < n and (text[end].isalnum() or end > at and text[end] in ".-" and text[end - 1].isalnum() and end + 1 < n and text[end + 1].isalnum()):
            end += 1
        if end > at:
            words.append((text[at:end].lower(), at, end))
        at = end + 1
    return words


def slow_dice(words, template):
    own = {(a, b) for (a, *_), (b, *_) in zip(words, words[1:])}
    return 2 * len(own & template) / (len(own) + len(template)) if own or template else 0.0


def slow_licenses(text):
    """Every line, paragraph and window against every template, without bounds or index."""
    templates = [(name, {(a, b) for (a, *_), (b, *_) in zip(w, w[1:])}) for name, ts in license_scan.TEMPLATES.items() for t in ts for w in [slow_words(t)]]
    least, lines, place, natural, block = license_scan.LEAST, [], 0, [], []
    for number, line in enumerate([*text.split("\n"), ""]):
        if line.strip():
            block.append((number, place, place + len(line)))
        else:
            natural += [(block[0][0], block[0][1], block[-1][2])] if len(block) > 1 else []
            block = []
        lines.append((number, place, place + len(line)))
        place += len(line) + 1
    matches, taken = [], []
    for number, a, b in natural + lines[:-1]:
        hits = [(-score, number, name) for name, t in templates for score in [slow_dice(slow_words(text[a:b]), t)] if score >= least]
        if hits:
            matches.append(min(hits))
            taken.append((a, b, {h[2] for h in hits}))
    words, found = slow_words(text), []
    pairs = [(a, b) for (a, *_), (b, *_) in zip(words, words[1:])]
    for name, t in templates:
        at = [p for p, pair in enumerate(pairs) if pair in t]
        for first in at:
            best = max(((slow_dice(words[first:last + 2], t), -last) for last in at if last >= first))
            if best[0] >= least:
                found.append((-best[0], -len(t), first, -best[1], name))
    chosen = []
    for window in sorted(found):
        if all(window[3] + 1 < c[2] or c[3] + 1 < window[2] for c in chosen):
            chosen.append(window)
    for _, _, first, last, name in chosen:
        a, b = words[first][1], words[last + 1][2]
        if not any(x <= a and b <= y or x < b and a < y and name in names for x, y, names in taken):
            matches.append(min((-score, text.count("\n", 0, a), other) for other, t in templates for score in [slow_dice(slow_words(text[a:b]), t)] if score >= least))
    best = min(matches, default=None)
    return (len(matches), best[2], -best[0], best[1]) if best else (0, None, None, None)


def test_licenses_against_every_window(spark):
    rng, texts = np.random.default_rng(8), ["", "\n\n\nAll rights reserved.\n", "\nx\nAll rights reserved.\n\n\n \ny", "All rights\nreserved.\n"]
    parts = [t for ts in license_scan.TEMPLATES.values() for t in ts]
    for _ in range(60):
        pieces = []
        for _ in range(rng.integers(1, 5)):
            words = parts[rng.integers(len(parts))].split(" ")
            if rng.random() < 0.7:  # words lost, changed or broken off
                words = [w if rng.random() > 0.06 else f"q{rng.integers(9)}" for w in words if rng.random() > 0.04][:rng.integers(2, 70)]
            words = [w + ("\n" if rng.random() < 0.08 else " ") for w in words]
            pieces.append("".join(words) + " ".join(f"f{rng.integers(40)}" for _ in range(rng.integers(0, 6))))
        texts.append(["\n", " ", "\n\n", "\n \n\n"][rng.integers(4)].join(pieces))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in license_scan.scan_licenses(df).collect()}
    assert got == {k: slow_licenses(t) for k, t in enumerate(texts)}
    assert sum(g[0] > 0 for g in got.values()) > 40 and any(g[0] == 0 for g in got.values())


def test_license_text_over_several_lines(spark):
    mit = license_scan.TEMPLATES["MIT"][2].replace(", ", ",\n")
    df = spark.createDataFrame([(1, f"title\n\n{mit}\n\nend"), (2, "no licence at all")], "doc_id long, text string")
    assert [(r.license, r.line) for r in license_scan.scan_licenses(df).orderBy("doc_id").collect()] == [("MIT", 2), (None, None)]


def test_licenses_inside_longer_lines(spark):
    mit, filler = license_scan.TEMPLATES["MIT"], " ".join(f"w{k}" for k in range(90))
    clauses = license_scan.TEMPLATES["BSD"][2].replace("and the", "and\nthe")
    texts = ["Copyright 2020 Acme Inc. All rights reserved.", "Copyright (c) 2020 X. Released under the MIT License.", f"{filler} {mit[2]} {filler}",
             f"x\n{filler} {clauses} {filler}", f"{filler} {mit[4].upper()} {filler}", "All rights reserved. All rights reserved.", f"{filler} all rights {filler}"]
    got = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_matches, r.license, r.line) for r in got] == [
        (1, "reserved", 0), (1, "MIT", 0), (1, "MIT", 0), (1, "BSD", 1), (1, "MIT", 0), (1, "reserved", 0), (0, None, None)]


def test_archives_of_odd_pages(spark):
    big = "<html>" + "x" * 200
    rows = [(5, "http://www.B.example:8080/a?q=1#f", big), (3, "https://b.example/", big), (3, "https://b.example/", big), (9, None, big), (None, "x y\r\nz", big),
            (7, "http://a.example", None), (8, "http://a.example", "small"), (6, "http://a.example", "small"), (4, "http://u@c.example/é", "é" * 60)]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    expected = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and page != 3
        expected[(page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None)] += 1
    assert Counter(map(tuple, got.collect())) == expected
    assert warc.sort_key(rows[0][1]) == "example,b:8080)/a?q=1"


def test_archives_with_text_ids_and_unique_records(spark):
    big = "payload " * 30
    rows = [("p10", "http://a.example/1", big), ("p10", "http://a.example/1", big), ("p2", "http://a.example/2", big), ("ä\n", "http://a.example/3", big)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    captures = warc.write_archives(df)
    heads = []
    for r in captures.collect():
        folder, path = token_files.open_folder(r.file)
        heads.append(warc.parse(folder.open_input_file(path).read_at(r.size, r.offset))[0])
    assert len({h["WARC-Record-ID"] for h in heads}) == 4
    assert {h.get("WARC-Refers-To-Target-URI") for h in heads} == {None, "http://a.example/1"}
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.archive_pages(df).collect())
    assert got == Counter({("p10", "response", None): 2, ("p2", "revisit", "p10"): 1, ("ä\n", "revisit", "p10"): 1})


def test_index_finds_keys_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rows = [(i, f"http://h{i % 4}.example/p", f"page {i}") for i in range(40)]
    captures = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    index = warc.write_index(captures)
    wanted = spark.createDataFrame([("example,h1)/p", 9), ("example,h1)/p", 10), ("nowhere)/", 1)], "key string, id long")
    assert [(r.id, r.payload_bytes) for r in warc.look_up(spark, index, wanted).collect()] == [(9, 6)]


# -- empty tables, pipeline --------------------------------------------------------------------------------------

def test_empty_tables(spark, odd_documents):
    none = odd_documents.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for result in (fingerprints.compare_documents(none), quality_rules.quality_rules(none), packing.pack_documents(none, BYTE_BPE),
                   token_files.token_files(none, BYTE_BPE), piece_codec.digests(none, PIECE_BPE), jaccard_join.jaccard_components(none), jaccard_join.jaccard_join(none),
                   license_scan.scan_licenses(none), line_dedup.drop_shared_lines(none), token_counts.count_tokens(none, BYTE_BPE), warc.archive_pages(pages)):
        assert result.count() == 0


@pytest.mark.parametrize("kind", ["documents", "odd_documents"])
def test_pipeline_stages(request, spark, sf, kind):
    import corpus_pipeline

    docs = request.getfixturevalue(kind)
    stages = dict(corpus_pipeline.STAGES)
    judged = quality_rules.quality_rules(docs.select("doc_id", "text", "lang", "source"))
    good = stages["quality_rules"](spark, docs, sf).cache()
    assert Counter(texts_of(good)) == Counter((r.doc_id, t) for r, t in _with_text(judged.filter("kept").collect(), docs))
    clean = stages["line_dedup"](spark, good, sf).cache()
    assert good.columns == clean.columns == docs.columns
    single = stages["jaccard_join"](spark, clean, sf).cache()
    kept = {d for d, _, c in slow_components(texts_of(clean)) if d == c}
    assert Counter(d for d, _ in texts_of(single)) == Counter(kept)
    packed = stages["packing"](spark, single, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept


def test_pipeline_keeps_unique_rows_without_id(spark, sf):
    import corpus_pipeline

    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcde"]
    near = texts[3] + " more"
    rows = [(1, texts[0]), (None, texts[0]), (None, texts[1]), (2, texts[0]), (2, texts[2]), (None, texts[3]), (None, near), (None, texts[1]), (3, texts[4]), (3, texts[4])]
    single = texts_of(corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf))
    assert len(single) == 5 and len([t for _, t in single if t in (texts[3], near)]) == 1
    assert {x for x in single if x[1] not in (texts[3], near)} == {(1, texts[0]), (None, texts[1]), (2, texts[2]), (3, texts[4])}


def _with_text(rows, docs):
    texts = {d: t for d, t in texts_of(docs)}
    return [(r, texts[r.doc_id]) for r in rows]


def test_sql_of_every_query_with_sql(spark, sf):
    import duckdb
    from gradus.llm import queries as q

    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in q.oracles.items():
        got = q.queries[name](spark, sf)
        columns = sorted(got.columns)
        expected = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert Counter(map(json.dumps, (list(r) for r in got.select(columns).collect()))) == Counter(map(json.dumps, map(list, expected))), name
