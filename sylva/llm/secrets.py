"""Secret scans by token efficiency.

Base patterns find assignments, access keys and long hexadecimal strings. The token-efficiency test looks at every run of
key-like characters: a byte-pair vocabulary spends few tokens on words and many on random strings, so a low number of
characters per token exposes them. Runs that are known digests (hexadecimal of a digest's length), UUIDs or without a
letter (numbers, dates, rules of signs) are excluded first; all others are judged, with digits or without.

Defined cases: a null or empty text has no spans; positions are code points of the whole text, ends exclusive; rows that
repeat a doc_id are scanned each on its own; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import common

VOCABULARY = "byte_bpe_50k.tiktoken"
KINDS = ("assign", "access", "hex", "random")
#: A run of SHORTEST characters or more with fewer than RATIO characters a token is random.
SHORTEST, LONGEST_JUDGED, RATIO = 16, 512, 1.9

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST)
#: Characters of the digests that count as known: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)
#: UUIDs, and numbers or signs without a letter. Names are left to the ratio: words take few tokens.
IDENTIFIER = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_=-]+")


@functools.cache
def _vocabulary(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if (":" in text or "=" in text) else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def random_spans(text: str, encode, ratio: float = RATIO) -> list[tuple[int, int, str]]:
    """Runs that cost many tokens; a very long run is judged by its whole, in pieces that the encoder takes at once."""
    out = []
    for m in RUN.finditer(text):
        run = m[0]
        if IDENTIFIER.fullmatch(run) or (len(run) in DIGESTS and re.fullmatch("[0-9a-f]+|[0-9A-F]+", run)):
            continue
        tokens = sum(len(encode(run[k : k + LONGEST_JUDGED])) for k in range(0, len(run), LONGEST_JUDGED))
        if len(run) / tokens < ratio:
            out.append((m.start(), m.end(), "random"))
    return out


def described(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def scan(df: DataFrame, path: str | None = None, ratio: float = RATIO) -> DataFrame:
    """doc_id, spans (array of kind, start, end, found text) of every text."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _vocabulary(path).encode_ordinary
        for ids, texts in common.column_lists(batches):
            rows = []
            for text in texts:
                text = text or ""
                found = sorted(base_spans(text) + random_spans(text, encode, ratio), key=lambda s: (s[0], KINDS.index(s[2])))
                rows.append([{"kind": kind, "start": a, "end": b, "found": text[a:b]} for a, b, kind in found])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("found", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, kind)], names=["doc_id", "spans"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,found:string>>")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    found = scan(common.table(spark, sf_dir, "documents"))
    line = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
