"""Every operator against a plain version, over unusual texts and the smallest test table."""

import hashlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from blotter.llm import bpe, common, exact_dedup, license_scan, near_dup, packing, quality_rules, secret_scan, token_orc
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def test_near_duplicates(odd_docs, odd_rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(odd_docs).collect()}
    assert got == brute.near_dup(odd_rows)


@pytest.mark.parametrize("block", [8, 512])
def test_open_buckets_lose_no_link_and_meet_few_pairs(spark, monkeypatch, block):
    """One bucket of texts that share more than half of their words, among them planted pairs about the limit."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = np.random.default_rng(5)
    shared = [f"s{i}" for i in range(70)]
    rows = []
    for i in range(600):
        own = [f"w{x}" for x in rng.integers(0, 10**9, 50)]
        rows.append((i, " ".join(shared + own)))
        if i % 20 == 0:  # 0.72 to 0.9 alike
            rows.append((1000 + i, " ".join(shared + own[:50 - i // 30] + [f"x{i}y{k}" for k in range(i // 30)])))
            rows.append((2000 + i, " ".join(own + shared)))
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string")
    members = spark.createDataFrame([(7, i, i) for i, _ in rows], "bucket long, rep long, component long")
    got = {(r.src, r.dst) for r in near_dup.rest_pairs(members, docs).collect()}
    sets = {i: brute.shingles(t) for i, t in rows}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert len(links) > 20 and links <= got
    assert len(got) < 100 < len(rows) ** 2 / 2 / 1000
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).distinct().collect()}
    assert found == brute.near_dup(rows)


def test_near_duplicates_of_ids_that_name_several_texts(spark):
    """A text under an id that leads another text's class neither lends nor takes that class's links."""
    words = [[f"{c}{i}" for i in range(60)] for c in "abc"]
    rows = [(3, " ".join(words[1])), (5, " ".join(words[0])), (5, " ".join(words[1])), (7, " ".join(words[1][:58] + ["z", "y"])), (9, " ".join(words[0][:58])), (9, " ".join(words[2]))]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 3, False), (9, 5, False), (9, 9, True)]


def test_word_encoder_equals_the_library_whatever_its_tables_hold():
    import pyarrow as pa

    from blotter.llm import tokens

    letters = "".join(chr(i) for i in range(256) if chr(i).isalpha())
    texts = [letters, " ".join(letters), "don't DON'T dogs' it's, I'm. x's'", "", "  \t\n ", "a1b2 3.14 --- !?! (see) \"Quote,\"", "Stra\u00dfe STRASSE \u00aa\u00b5\u00ba\u00d7\u00f7",
             "e\u0301 \u0130stanbul \ufb00 \u4e2d\u6587 \u00c9A\u0300 na\u00efve. NA\u00cfVE! \u00e9", "a\u00a0b\u2003c\x1cd\x85e", "<|endoftext|> <|startoftext|>", "word\u2019s \u201cx\u201d", "\\[]^_`{|}~ a\\ b] c^ d_ e`"]
    texts += [f"{w}{p}" for w in ("House", "hOUSE", "\u00c9t\u00e9") for p in ("", ",", "...", "!?", "'", "\\", "]", "`")]
    encoder = tokens.WordEncoder(tokens.default_vocabulary("word_bpe_49k.json"))
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    small = tokens.WordEncoder(tokens.default_vocabulary("word_bpe_49k.json"))
    small.runs, small.rests = (tokens.IdTable(f, 4, True, 3) for f in (small.new_runs, small.new_rests))
    for e in (encoder, small):
        for n in (len(texts), 1, 5):
            for i in range(0, len(texts), n):
                ids, at = e.encode(pa.array(texts[i:i + n]))
                assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want[i:i + n], texts[i:i + n]
    assert sum(w in ("house", "\u00e9t\u00e9") for w in encoder.runs.words.to_pylist()) == 2  # one entry, whatever the case and what follows


def test_word_encoder_makes_few_python_objects_at_once():
    import tracemalloc

    import pyarrow as pa

    from blotter.llm import tokens

    encoder = tokens.WordEncoder(tokens.default_vocabulary("word_bpe_49k.json"))
    rng = np.random.default_rng(5)
    words = pa.array([" ".join("".join(chr(97 + c) for c in w) for w in rng.integers(26, size=(100_000, 7)))])
    tracemalloc.start()
    encoder.encode(words)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert most < 20, most


def test_workers_let_go_of_tables_that_no_task_asks_for(spark):
    """A worker keeps an encoder for tasks that want it and drops it when a task of another kind starts."""
    from blotter.llm import common

    def asks(name):
        def make():
            if name:
                common.kept(name, lambda: [name])
            return lambda batch: {"held": [",".join(sorted(common.KEPT))] * batch.num_rows}
        return make

    docs = spark.range(1).selectExpr("id AS doc_id", "'t' AS text").coalesce(1)
    for name in ("one", "one", "two", None):
        held = [r.held for r in common.map_slices(docs, asks(name), "held string").collect()]
        assert held == [name or ""]


def test_tables_are_written_from_small_batches(spark):
    """Ten million bytes of text in one task came as one Arrow batch before, held by the JVM and by the worker."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    docs = spark.range(0, 1000, 1, 1).select(F.lit("x" * 10_000).alias("text"))
    before = {k: spark.conf.get(k) for k in common.BATCHES}
    for written in (common.step(docs.mapInArrow(sizes, "n long, bytes long"), "sizes"),
                    common.verdict(spark, lambda: docs.mapInArrow(sizes, "n long, bytes long"), "sizes")):
        rows = written.collect()
        assert sum(r.n for r in rows) == 1000 and max(r.bytes for r in rows) < 4 << 20
    assert {k: spark.conf.get(k) for k in common.BATCHES} == before


def test_an_unwritten_ledger_needs_no_python_rows(spark, tmp_path):
    """Rows from Python's side started workers of another kind on each executor, beside those of the operators."""
    scans = secret_scan.Ledger(spark, str(tmp_path)).scans()
    assert "ExistingRDD" not in scans._jdf.queryExecution().toString()
    assert scans.dtypes == spark.createDataFrame([], secret_scan.SCANS).dtypes and scans.isEmpty()


def test_quality_base(odd_docs, odd_rows):
    got = {r[0]: tuple(r)[1:] for r in quality_rules.judge(odd_docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == {i: brute.quality_base(t) for i, t in odd_rows}


def test_packing(odd_docs, odd_rows):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = packing.pack_documents(odd_docs).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == brute.pieces(t, odd_rows)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(held) <= 1.02 * sum(r.length for r in rows) / packing.CAPACITY + 1


def test_sequences_hold_the_ids(odd_docs, odd_rows):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = packing.cut_pieces(odd_docs)
    got = [np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(pieces).collect()]
    assert max(map(len, got)) <= packing.CAPACITY
    want = sorted(i for _, x in odd_rows for i in [*t.encode(x or "", add_special_tokens=False).ids, 0])
    assert sorted(i for s in got for i in s) == want


def test_exact_dedup(odd_docs, odd_rows):
    got = sorted(tuple(r) for r in exact_dedup.exact_dedup(odd_docs).collect())
    assert got == brute.exact_dedup(odd_rows)


def test_exact_dedup_when_digests_collide(odd_docs, odd_rows):
    got = exact_dedup.dedup(odd_docs, digest_bytes=1).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(tuple(r) for r in got.collect()) == brute.exact_dedup(odd_rows)


def test_chunks_rebuild_documents(odd_docs, odd_rows):
    got = {r.doc_id: r.text for r in exact_dedup.rebuild(exact_dedup.cut_documents(odd_docs)).collect()}
    assert got == {i: brute.normal(t) for i, t in odd_rows}


def test_secrets(odd_docs, odd_rows):
    got = {r[0]: tuple(r)[1:] for r in secret_scan.secret_digests(odd_docs).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()}
    assert got == {i: brute.secrets(t) for i, t in odd_rows}


def test_token_files(spark, odd_docs, odd_rows, tmp_path):
    path = str(tmp_path / "tokens")
    token_orc.write_tokens(odd_docs, path)
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want, at = [], 0
    for i, text in sorted(odd_rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), brute.crc(ids)))
        at += len(ids)
    assert sorted(tuple(r) for r in token_orc.token_digests(spark, path).collect()) == want
    one = token_orc.read_tokens(spark, path, [want[5][0]])
    assert [r.n_tokens for r in one.collect()] == [want[5][2]]
    assert "PushedFilters: [In(doc_id" in one._jdf.queryExecution().toString() or "EqualTo(doc_id" in one._jdf.queryExecution().toString()
    assert token_orc.read_files(spark, path).agg({"tokens": "sum"}).first()[0] == at


def test_bpe(odd_docs, odd_rows):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r[0]: tuple(r)[1:] for r in bpe.round_trip(odd_docs).collect()}
    for i, text in odd_rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        raw = np.asarray(ids, dtype="<u4").tobytes()
        assert got[i] == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_bpe_tables(odd_docs, odd_rows):
    back = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(odd_docs)).collect()}
    assert back == {i: t or "" for i, t in odd_rows}


@pytest.mark.parametrize("run", [
    near_dup.near_duplicates, quality_rules.judge, packing.pack_documents, exact_dedup.exact_dedup, secret_scan.secret_digests,
    bpe.round_trip, license_scan.scan_licenses])
def test_empty_table(empty_docs, run):
    assert run(empty_docs).collect() == []


@pytest.mark.parametrize("run", [
    near_dup.near_duplicates, quality_rules.judge, packing.pack_documents, exact_dedup.exact_dedup, secret_scan.secret_digests,
    bpe.round_trip, license_scan.scan_licenses])
def test_null_ids_and_repeated_rows(spark, run):
    text = "some words that come again and again in more than one row of this table"
    rows = [(None, None, None), (None, text, "a"), (1, text, "a"), (1, text, "a"), (1, "other text", None), (2, text, "b"), (3, None, None), (3, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert run(docs).count() == len(rows)
