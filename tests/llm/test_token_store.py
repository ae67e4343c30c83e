from __future__ import annotations

import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.llm import common, token_store as store


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(store.tokenizer_path())


@pytest.mark.parametrize("text", ["Hello, World! it's 42nd", "a\nb  c\t d", "ÀÉÎ ß œuvre naïve Ünïcode", "日本語 text ⅷ ½ ªº µm", "<|endoftext|> x<|startoftext|>", "İstanbul Σίσυφος ſ", "á éclair ​ zero", "don't they'll we've I'M", "😀 emoji 👩‍👩‍👧", "x" * 5000, "___ --- ??? a_b", "\x1c\x1f\x85 ", ""])
def test_remembered_pieces_encode_as_the_library(tokenizer, text):
    assert store.encoder(store.tokenizer_path()).encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_plain_texts_are_encoded_together_as_the_library_does(tokenizer, monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("aeinorstléßÖ'.,;-#059  \n"), n)) for n in rng.integers(0, 400, 300)]
    texts += ["don'ts 'tis 'll'd 're's ''s x'", "co" * 60 + " " + "=" * 90, "\u4e00 a", None, "", " ", "It's\tso", "Z" * 41]
    wanted = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    encoder = store.Encoder(store.tokenizer_path())
    assert list(encoder.encode_all(texts)) == wanted
    assert not any(p in encoder.pieces for p in "don'ts 'tis".split())  # plain texts' pieces are neither remembered nor encoded one by one
    monkeypatch.setattr(store, "LOOKED_AT", 50)
    assert list(encoder.encode_all(texts)) == wanted


def test_encoding_together_holds_few_bytes_a_character(tokenizer):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeinorstl"), n)) for n in rng.integers(1, 9, 3000)]
    texts = [" ".join(rng.choice(words, 2000)) for _ in range(200)]
    encoder = store.Encoder(store.tokenizer_path())
    tracemalloc.start()
    try:
        sizes = [len(ids) for ids in encoder.encode_all(texts)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sizes == [4 * len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert peak < 20 * sum(map(len, texts))


def brute(tokenizer, rows):
    start, out = 0, []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_digests_and_streams(spark, docs, tokenizer):
    folder = common.new_path(spark, "t")
    store.write(spark, docs, folder)
    store.verify(spark, folder)
    got = [tuple(r) for r in store.read_digests(spark, folder).orderBy("start").collect()]
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    assert got == brute(tokenizer, rows)
    ids = {r.doc_id: r.ids for r in store.read_ids(spark, folder).collect()}
    assert all(ids[d] == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows)
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("chunk_id").distinct().count() and len(store.store_root(spark, folder)) == 16


def test_odd_rows(spark, odd, empty, tokenizer):
    got = [tuple(r) for r in store.tokens_of(spark, odd).collect()]
    assert len(got) == 16 and sorted((g[0] or -1, g[2], g[3]) for g in got) == sorted((b[0] or -1, b[2], b[3]) for b in brute(tokenizer, [(r.doc_id, r.text) for r in odd.collect()]))
    by_start = sorted(got, key=lambda g: g[1])
    assert [g[1] for g in by_start] == list(np.cumsum([0] + [g[2] for g in by_start])[:-1])
    assert [g[0] for g in by_start] == sorted((g[0] for g in got), key=lambda d: (d is not None, d or 0))
    assert store.tokens_of(spark, empty).count() == 0


def test_damage_is_found(spark, odd):
    folder = common.new_path(spark, "t")
    store.write(spark, odd.select("doc_id", "text"), folder)
    spark.read.parquet(f"{folder}/chunks").withColumn("payload", F.first("payload").over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy(F.lit(1)))).write.parquet(f"{folder}-bad/chunks")
    with pytest.raises(Exception, match="damaged"):
        store.chunk_facts(spark, f"{folder}-bad").count()


def test_changed_recipes_are_found(spark, odd):
    folder = common.new_path(spark, "t")
    store.write(spark, odd.select("doc_id", "text"), folder)
    whole = spark.read.parquet(f"{folder}/manifest").filter(F.col("part") == store.WHOLE).collect()
    assert [bytes(r.root) for r in whole] == [store.store_root(spark, folder)] and whole[0].n_docs == 16
    recipes, manifest = spark.read.parquet(f"{folder}/recipes"), spark.read.parquet(f"{folder}/manifest")
    assert recipes.filter("size(chunk_ids) > 1").count() == 1

    def copy(name, recipes, manifest):
        recipes.write.parquet(f"{folder}-{name}/recipes")
        manifest.write.parquet(f"{folder}-{name}/manifest")
        spark.read.parquet(f"{folder}/chunks").write.parquet(f"{folder}-{name}/chunks")
        return f"{folder}-{name}"

    swapped = copy("swapped", recipes.withColumn("chunk_ids", F.reverse("chunk_ids")), manifest)
    for read in (store.verify, lambda *a: store.read_digests(*a).collect(), lambda *a: store.read_ids(*a).collect()):
        with pytest.raises(Exception, match="differ from its root"):
            read(spark, swapped)
    part = recipes.agg(F.max("part")).first()[0]
    short = copy("short", recipes.filter(F.col("part") != part), manifest.filter(F.col("part") != part))
    with pytest.raises(ValueError, match="differ from its root"):
        store.verify(spark, short)


def test_borders_follow_content():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 60_000).astype("<u4")
    ends = store.borders(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= store.LONGEST and sizes[:-1].min() >= store.SHORTEST
    chunks = lambda x: {x[a:b].tobytes() for a, b in zip([0, *store.borders(x)], store.borders(x), strict=False)}
    shifted = np.concatenate([ids[:100], ids[:7], ids[100:]])
    assert len(chunks(ids) & chunks(shifted)) > 0.6 * len(ends)


def test_crc_of_joined_parts():
    a, b = b"abc" * 100, b"xyz" * 33333
    got = store.joined_crc(np.array([zlib.crc32(a)]), np.array([zlib.crc32(b)], np.uint64), np.array([len(b)]), store._shift_tables())
    assert int(got[0]) == zlib.crc32(a + b)
