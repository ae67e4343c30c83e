"""Token-ID output: a content-addressed store of id streams.

Texts are encoded whole, an end id is appended, and a rolling hash over the ids cuts each stream into chunks whose borders
depend on content alone. ``chunks`` holds each distinct chunk once under the hash of its ids; ``recipes`` holds, in
ascending doc_id order, the chunk list, first id position and Merkle root of each document; ``manifest`` holds the roots of
each recipe file part and, as part WHOLE, of the store. Reading verifies every chunk against its name, every document's
chunk list against its root and the manifest against the recipes.

Defined cases: a null or empty text is the end id alone; rows that share a doc_id are kept as rows of their own, ordered by
Merkle root; null ids come first; an empty table makes an empty store; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import operator
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import common

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Chunk borders: a hash of WINDOW ids with MASK_BITS zero bits, no chunk shorter than SHORTEST or longer than LONGEST ids.
WINDOW, MASK_BITS, SHORTEST, LONGEST = 8, 11, 1024, 16384
#: Documents to a recipe part at most, on average.
PART_ROWS = 200_000
#: The manifest's row of the whole store.
WHOLE = -1

_CODED = "doc_id long, n_tokens long, root binary, chunk_ids array<binary>, chunk_sizes array<int>, payloads array<binary>"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Pieces of plain Latin letters, digits and signs: for these the vocabulary's normaliser is lower case alone, and its
#: pre-tokens are the matches of PRE_TOKEN.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
PRE_TOKEN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


#: Words of more bytes than this go through the library's model one by one.
LONGEST_WORD = 40
#: Characters of plain texts that are looked at together; pre-tokens whose ids are put in place together.
LOOKED_AT, PLACED = 4_000_000, 1 << 17

_ID = operator.attrgetter("id")


class _Words(dict):
    """A pre-token's ids, by the library's model."""

    def __init__(self, tokenizer, bound: int):
        self.model, self.bound = tokenizer.model, bound
        # the letters by which the pre-tokenizer writes the bytes of a character; those of ASCII signs are the signs
        self.letters = {k: "".join(x for x, _ in tokenizer.pre_tokenizer.pre_tokenize_str(chr(k))) for k in range(0xC0, 0x100)}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.bound:
            self.clear()
        ids = self[word] = array("I", map(_ID, self.model.tokenize(word if word.isascii() else word.translate(self.letters)))).tobytes()
        return ids


class _Pieces(dict):
    """The ids of what stands between spaces and line feeds."""

    def __init__(self, tokenizer, bound: int):
        self.tokenizer, self.bound, self.words = tokenizer, bound, _Words(tokenizer, bound)
        spec = json.loads(tokenizer.to_str())
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_words = kinds == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") == "</w>"

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.bound:
            self.clear()
        if self.by_words and piece.isascii() and piece.isalpha():
            ids = self.words[piece.lower()]
        elif self.by_words and PLAIN.fullmatch(piece) and "<|" not in piece:
            ids = b"".join(map(self.words.__getitem__, PRE_TOKEN.findall(piece.lower())))
        else:
            ids = array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        self[piece] = ids
        return ids


class _Merges:
    """A byte-pair vocabulary's merges: a hash table of symbol pairs, looked up an array at a time."""

    BITS, NONE = 19, np.int32(1 << 30)

    def __init__(self, vocabulary: dict[str, int], merges: list):
        signs = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(signs)]
        written = {**{b: chr(b) for b in signs}, **{b: chr(256 + k) for k, b in enumerate(others)}}
        #: Ids of bytes within a word and at its end, -1 where there is none.
        self.inner, self.last = (np.array([vocabulary.get(written[b] + end, -1) for b in range(256)], np.int32) for end in ("", "</w>"))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.keys = np.full((1 << self.BITS) + len(pairs), -1, np.int64)
        self.ranks = np.full(len(self.keys), self.NONE, np.int32)
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slots(keys).tolist(), strict=True)):
            while self.keys[at] not in (-1, key):
                at += 1
            self.keys[at], self.ranks[at] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * common._GOLD >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pairs' ranks, NONE where they aren't merged."""
        keys = left.astype(np.int64) << 32 | right
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.ranks[slots], self.NONE)
        more = np.flatnonzero((found != keys) & (found != -1))
        while len(more):  # another pair's slot: the next one
            slots[more] += 1
            found = self.keys[slots[more]]
            out[more] = np.where(found == keys[more], self.ranks[slots[more]], self.NONE)
            more = more[(found != keys[more]) & (found != -1)]
        return out

    def merge(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of one length, a row each -> (places, ids) of those done. Each round makes a word's first merge, the leftmost of them."""
        places = np.arange(len(symbols))
        ranks = self.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(symbols), -1) if symbols.shape[1] > 1 else np.zeros((len(symbols), 0), np.int32)
        while ranks.shape[1] and len(places):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(ranks)), at]
            on = best < self.NONE
            if not on.all():
                yield places[~on], symbols[~on]
                places, symbols, ranks, at, best = places[on], symbols[on], ranks[on], at[on], best[on]
            rows, columns = np.arange(len(places)), np.arange(symbols.shape[1] - 1)
            symbols = np.where(columns <= at[:, None], symbols[:, :-1], symbols[:, 1:])
            symbols[rows, at] = self.merged[best]
            ranks = np.where(columns[:-1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < symbols.shape[1] - 1)
            ranks[before, at[before] - 1] = self.rank(symbols[before, at[before] - 1], symbols[before, at[before]])
            ranks[after, at[after]] = self.rank(symbols[after, at[after]], symbols[after, at[after] + 1])
        yield places, symbols


#: Kinds of bytes of plain texts in lower case: space, letter (bytes beyond ASCII are of letters alone), digit, sign.
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_KINDS = np.array([_LETTER if k >= 0x80 or chr(k).isalpha() else _DIGIT if chr(k).isdigit() else _SPACE if chr(k) in " \n" else _SIGN for k in range(256)], np.uint8)
PLAIN_TEXT = re.compile("[ \n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")


def pre_tokens(low: np.ndarray) -> np.ndarray:
    """Where the pre-tokens and the spaces between them start in a plain text's bytes: the matches of PRE_TOKEN."""
    kinds = _KINDS[low]
    starts = np.ones(len(low) + 3, bool)
    np.not_equal(kinds[1:], kinds[:-1], out=starts[1 : len(low)])
    starts[1 : len(low)] |= kinds[1:] == _DIGIT
    quotes = np.flatnonzero((low == ord("'")) & starts[: len(low)])
    one, two = (np.where(quotes + k < len(low), low[np.minimum(quotes + k, len(low) - 1)], 32) for k in (1, 2))
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    starts[quotes[short | long] + 1] = False
    starts[quotes[short] + 2] = starts[quotes[long] + 3] = True
    step = 1 << 20
    return np.concatenate([np.flatnonzero(starts[at : min(at + step, len(low))]).astype(np.int32) + np.int32(at) for at in range(0, len(low), step)])


class Encoder:
    """text -> ids as little-endian uint32 bytes, by the tokenizers library's vocabulary.

    Plain texts are cut into pre-tokens many texts at a time, and the different ones among these merged in arrays, those of
    one length together. In other texts, pieces between spaces and line feeds, which pre-tokens never span, are encoded on
    their own and remembered, up to a bound: plain pieces are made of remembered pre-tokens, new ones by the library's
    model, other pieces by the whole library.
    """

    def __init__(self, path: str, remembered: int = 300_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.pieces = _Pieces(tokenizer, remembered)
        model = json.loads(tokenizer.to_str())["model"]
        merges_alone = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        self.merges = _Merges(model["vocab"], model["merges"]) if self.pieces.by_words and merges_alone else None

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """One after the other, LOOKED_AT characters at a time; longer texts are cut at spaces."""
        at = 0
        while at < len(texts):
            some: list[str] = []
            held = 0
            while at < len(texts) and (not some or held + len(texts[at] or "") <= LOOKED_AT):
                some.append(texts[at] or "")
                held += len(some[-1])
                at += 1
            plain = [self.merges is not None and "<|" not in t and PLAIN_TEXT.fullmatch(t) is not None for t in some]
            if held > LOOKED_AT and plain[0]:
                yield b"".join(ids for part in _parts_of(some[0]) for ids in self._plain([part]))
                continue
            done = iter(self._plain([t for t, p in zip(some, plain, strict=True) if p]))
            for text, p in zip(some, plain, strict=True):
                yield next(done) if p else b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))

    def _plain(self, texts: list[str]) -> Iterator[bytes]:
        ids, ends = self._ids(texts)
        for a, b in zip(ends, ends[1:], strict=False):
            yield ids[a:b].tobytes()

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """The ids of all texts, and where each text's begin, the last place being the end. Arrays as long as the texts are few and narrow here."""
        raw = [t.lower().encode() for t in texts]
        begins = np.cumsum([0, *(len(r) + 1 for r in raw)], dtype=np.int32)
        low = np.frombuffer(b"\n".join(raw), np.uint8)
        del raw
        if not len(low):
            return np.zeros(0, "<u4"), [0] * (len(texts) + 1)
        starts = pre_tokens(low)
        begins = np.searchsorted(starts, begins)
        offsets = np.append(starts, np.int32(len(low)))
        del starts
        tokens = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(low)]).dictionary_encode()
        del offsets, low
        which = tokens.indices.to_numpy()
        firsts, sizes, ids = self._merged(tokens.dictionary)
        upto = np.zeros(len(which) + 1, np.int32)
        np.cumsum(sizes[which], out=upto[1:])
        found = np.empty(upto[-1], "<u4")
        for at in range(0, len(which), PLACED):
            some = which[at : at + PLACED]
            lo, hi = upto[at], upto[at + len(some)]
            found[lo:hi] = ids[np.repeat(firsts[some] - upto[at : at + len(some)], sizes[some]) + np.arange(lo, hi)]
        return found, upto[begins].tolist()

    def _merged(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different pre-tokens -> first place and number of each one's ids, and all ids; spaces have none."""
        _, offsets, data = tokens.buffers()
        ends = np.frombuffer(offsets, np.int32)[tokens.offset : tokens.offset + len(tokens) + 1].astype(np.int64)
        letters, lengths = np.frombuffer(data, np.uint8), np.diff(ends)
        firsts, sizes, made, total = np.zeros(len(tokens), np.int32), np.zeros(len(tokens), np.int32), [], 0
        lengths[_KINDS[letters[ends[:-1]]] == _SPACE] = 0
        order = np.argsort(lengths, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            length = lengths[rows[0]]
            if not length:
                continue
            fit = np.zeros(len(rows), bool)
            if length <= LONGEST_WORD:
                bytes_ = letters[ends[rows][:, None] + np.arange(length)]
                symbols = np.concatenate([self.merges.inner[bytes_[:, :-1]], self.merges.last[bytes_[:, -1:]]], axis=1)
                fit = (symbols >= 0).all(1)
                for places, ids in self.merges.merge(symbols[fit]):
                    at = rows[fit][places]
                    firsts[at], sizes[at] = total + ids.shape[1] * np.arange(len(ids)), ids.shape[1]
                    made.append(ids.ravel())
                    total += ids.size
            for at in rows[~fit].tolist():
                ids = np.frombuffer(self.pieces.words[tokens[at].as_py().decode()], "<u4").astype(np.int32)
                firsts[at], sizes[at] = total, len(ids)
                made.append(ids)
                total += len(ids)
        return firsts, sizes, np.concatenate(made) if made else np.zeros(0, np.int32)


def _parts_of(text: str) -> Iterator[str]:
    """A long text in parts that end at spaces."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + LOOKED_AT)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process, kept between tasks."""
    return Encoder(path)


def borders(ids: np.ndarray) -> list[int]:
    """Chunk ends of an id stream, the last being its length."""
    n = len(ids)
    if n <= SHORTEST:
        return [n]
    with np.errstate(over="ignore"):
        h = common.mix(ids.astype(np.uint64) + common._GOLD)
        rolled = np.zeros(n - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            rolled += h[k : n - WINDOW + 1 + k] << np.uint64(k)
    marks = np.flatnonzero((rolled >> np.uint64(20)) & np.uint64((1 << MASK_BITS) - 1) == 0) + WINDOW
    ends, start = [], 0
    for m in [*marks.tolist(), n]:
        while m - start > LONGEST:
            start += LONGEST
            ends.append(start)
        if m - start >= SHORTEST and m < n:
            start = m
            ends.append(m)
    if start < n:
        ends.append(n)
    return ends


def chunk_name(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


def merkle_root(names: list[bytes]) -> bytes:
    """Root of a binary hash tree; leaves and inner nodes are hashed under different prefixes."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in names] or [b"\0" * 16]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + b"".join(level[k : k + 2]), digest_size=16).digest() for k in range(0, len(level), 2)]
    return level[0]


def check_root(doc: int | None, names: list[bytes], root: bytes) -> None:
    """Raise unless the chunk list gives the document's root."""
    if merkle_root(names) != root:
        raise ValueError(f"document {doc}: its chunks differ from its root")


def pack(ids: bytes, packer: zstandard.ZstdCompressor) -> bytes:
    """Stored form: the width of an id in bytes (2 where all fit, else 4), then the ids, compressed."""
    wide = np.frombuffer(ids, "<u4")
    return packer.compress(b"\x04" + ids if wide.max(initial=0) > 0xFFFF else b"\x02" + wide.astype("<u2").tobytes())


def unpack(payload: bytes) -> bytes:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    return raw[1:] if raw[0] == 4 else np.frombuffer(raw, "<u2", offset=1).astype("<u4").tobytes()


def encoded(df: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, text -> one row per document with its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, end = encoder(path).encode_all, zstandard.ZstdCompressor(level=3), np.array([end_id], "<u4").tobytes()
        for ids, texts in common.column_lists(batches):
            rows = []
            for raw in encode(texts):
                raw += end
                ends = borders(np.frombuffer(raw, "<u4"))
                parts = [raw[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]
                names = [chunk_name(p) for p in parts]
                rows.append((len(raw) // 4, merkle_root(names), names, [len(p) // 4 for p in parts], [pack(p, packer) for p in parts]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_tokens", "root", "chunk_ids", "chunk_sizes", "payloads"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _CODED)


def write(spark: SparkSession, df: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Encode ``df`` (doc_id, text) and write the store under ``folder``."""
    common.small_batches(spark)
    coded = common.stage(spark, encoded(df, path or tokenizer_path(), end_id), "encoded")
    loose = coded.select(F.explode(F.arrays_zip("chunk_ids", "chunk_sizes", "payloads")).alias("c")).select(F.col("c.chunk_ids").alias("chunk_id"), F.col("c.chunk_sizes").alias("n_ids"), F.col("c.payloads").alias("payload"))
    loose.groupBy("chunk_id").agg(F.first("n_ids").alias("n_ids"), F.first("payload").alias("payload")).write.option("compression", "uncompressed").parquet(f"{folder}/chunks")

    lists = coded.select("doc_id", "n_tokens", "root", "chunk_ids")
    parts = max(1, min(10_000, -(-lists.count() // PART_ROWS)), spark.sparkContext.defaultParallelism)
    ordered = lists.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.col("root")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root").withColumn("part", F.spark_partition_id())
    ordered.write.parquet(f"{folder}/unplaced")
    common.remove(spark, coded)
    placed = _placed(spark.read.parquet(f"{folder}/unplaced"))
    placed.repartitionByRange(parts, "start").sortWithinPartitions("start").write.parquet(f"{folder}/recipes")
    common.remove(spark, spark.read.parquet(f"{folder}/unplaced"))
    roots = part_roots(spark.read.parquet(f"{folder}/recipes"), checked=False).orderBy("part")  # made from these lists just now
    roots.write.parquet(f"{folder}/manifest")
    found = _parts(spark, folder).collect()  # their number is bounded above
    whole = [(WHOLE, sum(r.n_docs for r in found), sum(r.n_tokens for r in found), _root_of(found))]
    spark.createDataFrame(whole, roots.schema).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def _placed(recipes: DataFrame) -> DataFrame:
    """Add start: ids before the part (a handful of sums) plus a running sum within the part."""
    from pyspark.sql import Window

    totals = recipes.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # one row a part; the number of parts is bounded above
    before = totals.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    within = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return recipes.withColumn("upto", F.sum("n_tokens").over(within)).join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "root", "chunk_ids", "part")


def part_roots(recipes: DataFrame, checked: bool = True) -> DataFrame:
    """Per part: documents, ids and the hash chain of the documents' roots in order; ``checked``: raise where chunks and root differ."""
    lists = ["doc_id", "chunk_ids"] if checked else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for parts, roots, sizes, *known in common.column_lists(batches):
            for doc, chunks, root in zip(*known, roots, strict=True) if known else ():
                check_root(doc, chunks, root)
            for part, root, size in zip(parts, roots, sizes, strict=True):
                state = seen.setdefault(part, [hashlib.blake2b(digest_size=16), 0, 0])
                state[0].update(root)
                state[1] += 1
                state[2] += size
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([s[1] for s in seen.values()], pa.int64()), pa.array([s[2] for s in seen.values()], pa.int64()), pa.array([s[0].digest() for s in seen.values()], pa.binary())], names=["part", "n_docs", "n_tokens", "root"])

    columns = ["part", "root", "n_tokens", *lists]
    return recipes.select(*columns, "start").repartition("part").sortWithinPartitions("part", "start").select(*columns).mapInArrow(run, "part int, n_docs long, n_tokens long, root binary")


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest").filter(F.col("part") != WHOLE)


def _root_of(parts: list) -> bytes:
    return merkle_root([bytes(r.root) for r in sorted(parts, key=lambda r: r.part)])


def store_root(spark: SparkSession, folder: str) -> bytes:
    """The root over all parts (their number is bounded)."""
    return _root_of(_parts(spark, folder).collect())


def verify(spark: SparkSession, folder: str) -> None:
    """Raise unless the chunk lists give the documents' roots, these the manifest's, and its parts the root of the store."""
    found = {r.part: r for r in part_roots(spark.read.parquet(f"{folder}/recipes")).collect()}  # a row a part
    written = {r.part: r for r in spark.read.parquet(f"{folder}/manifest").collect()}
    whole = written.pop(WHOLE, None)
    wrong = sum(found.get(p) != written.get(p) for p in found.keys() | written.keys())
    if wrong:
        raise ValueError(f"{wrong} parts of the store differ from its manifest")
    if whole is None or bytes(whole.root) != _root_of(list(found.values())):
        raise ValueError("the parts of the store differ from its root")


def chunk_facts(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_id, crc32 and number of the ids that its stored bytes unpack to; raises where bytes and name differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, payloads in common.column_lists(batches):
            crcs, sizes = [], []
            for name, payload in zip(names, payloads, strict=True):
                raw = unpack(payload)
                if chunk_name(raw) != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
                crcs.append(zlib.crc32(raw))
                sizes.append(len(raw) // 4)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64())], names=["chunk_id", "crc", "n"])

    return spark.read.parquet(f"{folder}/chunks").select("chunk_id", "payload").mapInArrow(run, "chunk_id binary, crc long, n long")


def _shift_tables(bits: int = 40) -> np.ndarray:
    """[bit, byte, value]: what 2**bit zero bytes make of a crc32 whose given byte has the given value."""
    one = np.zeros(32, np.uint64)  # the step of one zero bit, by columns
    one[0] = 0xEDB88320
    one[1:] = 1 << np.arange(31, dtype=np.uint64)

    def times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for k in range(32):
            out ^= np.where((v >> np.uint64(k)) & np.uint64(1), m[k], np.uint64(0))
        return out

    m = one
    for _ in range(3):
        m = times(m, m)
    tables = np.zeros((bits, 4, 256), np.uint64)
    for k in range(bits):
        for byte in range(4):
            tables[k, byte] = times(m, np.arange(256, dtype=np.uint64) << np.uint64(8 * byte))
        m = times(m, m)
    return tables


def joined_crc(left: np.ndarray, right: np.ndarray, right_bytes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """crc32 of a + b from the crc32 of each and the length of b, for arrays."""
    out = left.astype(np.uint64)
    for k in range(int(right_bytes.max(initial=0)).bit_length()):
        on = (right_bytes >> k) & 1 == 1
        v = out[on]
        t = tables[k]
        out[on] = t[0][v & np.uint64(255)] ^ t[1][(v >> np.uint64(8)) & np.uint64(255)] ^ t[2][(v >> np.uint64(16)) & np.uint64(255)] ^ t[3][(v >> np.uint64(24)) & np.uint64(255)]
    return out ^ right.astype(np.uint64)


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    Chunks are unpacked where they lie; a document's crc32 is put together from those of its chunks, so id bytes aren't
    moved. ``start`` identifies a row, as every document has an id at least. ``verify`` has held every chunk list against
    its root before; here every chunk is held against its name, and their number and length against the recipe.
    """
    verify(spark, folder)
    recipes = spark.read.parquet(f"{folder}/recipes")
    steps = recipes.select("start", F.posexplode("chunk_ids").alias("seq", "chunk_id")).join(chunk_facts(spark, folder), "chunk_id").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("seq", "crc", "n"))).alias("steps"))
    whole = recipes.select("doc_id", "start", "n_tokens", F.size("chunk_ids").alias("chunks")).join(steps, "start", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _shift_tables()
        for docs, starts, sizes, counts, lists in common.column_lists(batches):
            crc = np.zeros(len(docs), np.uint64)
            total = np.zeros(len(docs), np.int64)
            for doc, n, steps in zip(docs, counts, lists, strict=True):
                if len(steps or ()) != n:
                    raise ValueError(f"document {doc}: chunks are missing")
            for k in range(max(counts, default=0)):
                on = np.array([i for i, c in enumerate(counts) if c > k])
                n = np.array([lists[i][k]["n"] for i in on])
                crc[on] = joined_crc(crc[on], np.array([lists[i][k]["crc"] for i in on], np.uint64), 4 * n, tables)
                total[on] += n
            if total.tolist() != sizes:
                raise ValueError("a document's length differs from its recipe")
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return whole.select("doc_id", "start", "n_tokens", "chunks", "steps").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids (array<int>): the streams themselves; raises where chunk, chunk list or root differ."""
    verify(spark, folder)
    recipes = spark.read.parquet(f"{folder}/recipes")
    steps = recipes.select("start", F.posexplode("chunk_ids").alias("seq", "chunk_id")).join(spark.read.parquet(f"{folder}/chunks"), "chunk_id")
    steps = steps.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("seq", "payload"))).alias("steps"))
    whole = recipes.select("doc_id", "start", "root", "chunk_ids").join(steps, "start", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, starts, roots, names, lists in common.column_lists(batches):
            ids = []
            for doc, root, chunks, steps in zip(docs, roots, names, lists, strict=True):
                check_root(doc, chunks, root)
                parts = [unpack(s["payload"]) for s in steps or ()]
                if [chunk_name(p) for p in parts] != chunks:
                    raise ValueError(f"document {doc}: chunks are missing or damaged")
                ids.append(np.frombuffer(b"".join(parts), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return whole.select("doc_id", "start", "root", "chunk_ids", "steps").mapInArrow(run, "doc_id long, start long, ids array<int>")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(spark, common.table(spark, sf_dir, "documents"))


def tokens_of(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the store of ``docs`` into the shared folder, verify it and return the digests read back from it."""
    folder = common.new_path(spark, "store")
    write(spark, docs, folder)
    return read_digests(spark, folder)
