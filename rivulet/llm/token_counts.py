"""Token counts through a digest cache.

Texts become digests of their normalised content. Distinct digests are joined with the cache's counts for this tokenizer
version; only the misses are encoded, each once, and appended to the cache. Copies cost a join of digests, not an encoding.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import limit_batches, maybe_in, work_path, written

#: ASCII white space, which this kind of tokenizer splits at before anything else.
SPACES = re.compile(r"[\t-\r ]+")

CACHE = "digest binary, version string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and its library's version: a change of either makes other cache keys."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


@lru_cache(maxsize=4)
def loaded(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: Normalisers that do the same to a text as to its words.
BY_WORD = ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents")


def splits_at_spaces(path: str) -> bool:
    """Whether the tokenizer drops ASCII white space and never joins what it separates, by its file: its normalisers work on words, and
    its first pre-tokenizer keeps only pieces without white space. False where the file doesn't tell."""
    import regex

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm, first = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    steps = [] if norm is None else norm["normalizers"] if norm["type"] == "Sequence" else [norm]
    if not all(x["type"] in BY_WORD or (x["type"] == "Replace" and x["pattern"].get("Regex") == r"\s+" and x["content"] == " ") for x in steps):
        return False
    if any(re.search(r"\s", x["content"]) for x in spec.get("added_tokens") or []):
        return False
    while first.get("type") == "Sequence":
        first = first["pretokenizers"][0]
    if first.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"):
        return True
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert") or "Regex" not in first["pattern"]:
        return False
    probe = " ".join(f"{a}{space}{b}" for a in "aÉ1!'\u0301" for b in "aÉ1!'\u0301" for space in (" ", "  ", "\t", "\n", "\r\n", "\v", "\f"))
    return not any(SPACES.search(piece) for piece in regex.findall(first["pattern"]["Regex"], probe))


#: Counts of words that this worker process has encoded, by tokenizer; emptied at so many words.
_words: dict[str, dict[str, int]] = {}
WORDS = 600_000


def encode_count(path: str, texts: list[str], by_word: bool) -> list[int]:
    """Tokens of each text, without added special tokens.

    by_word: the tokenizer never joins characters across ASCII white space, so a text's count is the sum of its words' counts,
    and words that recur are encoded once a worker. Otherwise each text is encoded as a whole.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    tokenizer = loaded(path)

    def counts(parts: list[str]) -> list[int]:
        return [len(x) for x in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]  # the same tokens without offsets

    if not by_word:
        return counts(texts)
    known, out = _words.setdefault(path, {}), []
    for text in texts:
        words = SPACES.split(text)
        missing = list({w for w in words if w not in known})
        if len(known) + len(missing) > WORDS:
            known.clear()
            missing = list(set(words))
        known.update(zip(missing, counts(missing)))
        out.append(sum(map(known.__getitem__, words)))
    return out


def content(column: str) -> "F.Column":
    """Normalised content: null is empty, and white space at the ends, which this kind of tokenizer drops, is cut."""
    return F.trim(F.coalesce(F.col(column), F.lit("")), F.lit(" \t\n\r\x0b\x0c"))


def chosen(texts: DataFrame, judged: DataFrame, distinct: int, missing: int, alone: int) -> DataFrame:
    """digest, t: a text of each missing digest. texts: digest, mark, t; judged: digest, mark, rows, missing, h, of which `alone` are
    missing and of one row.

    A Bloom filter says which texts need the join with `judged`, and a shuffle: those that may be missing, if they are few; else
    those that may be known or of several rows. Where both are too many for a filter, all texts are shuffled.
    """
    misses, h = judged.where("missing"), F.xxhash64("digest")
    joined = lambda some: some.join(misses, ["digest", "mark"], "left_semi").select("digest", "t")
    few = maybe_in(misses, "h", missing, texts) if 2 * missing < distinct else None
    if few is not None:
        return joined(texts.where(few(h)))
    others = maybe_in(judged.where("NOT missing OR rows > 1"), "h", distinct - alone, texts)
    if others is not None:
        return texts.where(~others(h)).select("digest", "t").union(joined(texts.where(others(h))))
    return joined(texts)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; empty if nothing is there yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, by_word: bool | None = None) -> DataFrame:
    """One row per document: id_col, n_bytes (UTF-8), n_tokens, over_limit.

    tokenizer: path of a tokenizers .json file that every executor has. cache: folder of the digest cache, in a store that all
    executors share; it is created or appended to (default: a new one). A digest may stand there more than once (rows that
    repeat an id and a text may be encoded by several tasks); all its counts are equal. Special strings inside texts are handled as the
    tokenizer's default; nothing is truncated or padded. Null texts are empty (0 bytes). Rows with null or repeated ids
    are counted like any other. by_word: the tokenizer drops white space and splits there, so that words that recur are encoded
    once; None: as its file says. Otherwise digests and encodings are of whole texts. Filters keep most
    texts out of shuffles (chosen); without misses no text is read a second time.
    """
    spark = docs.sparkSession
    limit_batches(spark, 4 << 20)
    version = tokenizer_version(tokenizer)
    by_word = splits_at_spaces(tokenizer) if by_word is None else by_word
    cache = cache or work_path(spark, "token-cache")
    norm = content(text_col) if by_word else F.coalesce(F.col(text_col), F.lit(""))
    mark = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    ids = written(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")), "digests")
    known = read_cache(spark, cache).where(F.col("version") == version).select("digest", "n_tokens").dropDuplicates(["digest"])
    found = ids.groupBy("digest").agg(F.min(F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("mark"), F.count(F.lit(1)).alias("rows"))
    judged = found.join(known.select("digest", F.lit(False).alias("missing")), "digest", "left").withColumn("missing", F.coalesce("missing", F.lit(True))).withColumn("h", F.xxhash64("digest"))
    judged = written(judged, "judged")
    once = F.col("missing") & (F.col("rows") == 1)
    distinct, missing, alone = judged.agg(F.count(F.lit(1)), F.count_if("missing"), F.count_if(once)).first()
    # the text of one document for each missing digest
    texts = docs.select(mark.alias("mark"), norm.alias("t")).withColumn("digest", F.unhex(F.sha2(F.col("t").cast("binary"), 256)))
    texts = chosen(texts, judged, distinct, missing, alone)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in batches:
            found = {d: t for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if d not in done}
            done.update(found)
            counts, todo = [], list(found.values())
            for k in range(0, len(todo), 64):
                counts += encode_count(tokenizer, todo[k : k + 64], by_word)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([version] * len(found)), pa.array(counts, pa.int64())], names=["digest", "version", "n_tokens"])

    if missing or not distinct:  # an empty cache has a folder too
        texts.mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    # written, so that the join has an exchange of its own on either side and Spark can split the partition of a common digest
    counts = written(read_cache(spark, cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return ids.join(counts, "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
