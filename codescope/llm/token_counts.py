"""Token counts through a cache of digests."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.plans.lineage import new_location, stored

#: Texts are encoded in groups of about so many bytes.
GROUP_BYTES = 1 << 20
#: Distinct units whose counts a task remembers at most, and the longest unit it remembers.
MEMO_UNITS = 300_000
MEMO_CHARS = 64
_CACHE_SCHEMA = "digest binary, tokenizer string, n_bytes long, n_tokens long"


class Tokenizer:
    """A vocabulary file of a public library: ``tokenizers`` for .json, ``sentencepiece`` for .model.

    Counts are those of the library's own encoding without begin, end or added special tokens; special strings inside
    a text are handled as the library does by default; nothing is truncated or padded.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as file:
            content = file.read()
        self.version = hashlib.sha256(os.path.splitext(path)[1].encode() + content).hexdigest()
        self._model, self._by_unit, self._memo = None, False, {}

    def __getstate__(self) -> dict:
        return {"path": self.path, "version": self.version, "_model": None, "_by_unit": False, "_memo": {}}

    def _load(self) -> None:
        if self.path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=self.path)
            self._model = lambda texts: list(map(len, processor.encode(texts, num_threads=1)))
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task on each core
            import tokenizers

            model = tokenizers.Tokenizer.from_file(self.path)
            model.no_truncation()
            model.no_padding()
            self._model = lambda texts: list(map(len, model.encode_batch_fast(texts, add_special_tokens=False)))
            self._by_unit = _parts_at_spaces(json.loads(model.to_str()))

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text.

        Where the vocabulary parts every text before a space that follows another character, the text is the
        concatenation of such units, and each distinct unit is encoded once for the whole task.
        """
        if self._model is None:
            self._load()
        if not self._by_unit:
            return self._model(texts)
        parted = [[text] if _CONTROLS.search(text) else _UNIT.findall(text) for text in texts]
        if len(self._memo) > MEMO_UNITS:
            self._memo.clear()
        misses = list({unit for units in parted for unit in units if unit not in self._memo})
        self._memo.update(zip(misses, self._model(misses)))
        long = [unit for unit in misses if len(unit) > MEMO_CHARS]  # not worth remembering
        counts = [sum(map(self._memo.__getitem__, units)) for units in parted]
        for unit in long:
            del self._memo[unit]
        return counts


#: White space and what follows it. Python counts four controls as white space that other definitions do not.
_UNIT = re.compile(r"\s*\S+|\s+")
_CONTROLS = re.compile("[\x1c-\x1f]")


def _parts_at_spaces(model: dict) -> bool:
    """Whether a .json vocabulary is byte-level, with no rule that looks across the start of a run of white space."""
    before = model.get("pre_tokenizer") or {}
    return (
        before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space")
        and not model.get("normalizer")
        and (model.get("post_processor") or {}).get("type") in (None, "ByteLevel")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
                    for t in model["added_tokens"])
    )


def content(text: Column | str) -> Column:
    """The normalised content that a digest stands for: null as empty, and otherwise the text itself.

    A tokenizer may tell any two texts apart, so no further change of the text would keep every count.
    """
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


class CountCache:
    """Stored counts by content digest and tokenizer version, a Parquet table that is only appended to."""

    def __init__(self, spark: SparkSession, location: str | None = None):
        self.spark, self.location = spark, location or new_location(spark)
        if location is None:
            spark.createDataFrame([], _CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(self.location)

    def counts(self, version: str) -> DataFrame:
        """``(digest, n_tokens)`` for one tokenizer; an entry that was appended twice is given once."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.location)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], "digest binary, n_tokens long")
        rows = self.spark.read.schema(_CACHE_SCHEMA).parquet(self.location).where(F.col("tokenizer") == version)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counted: DataFrame, version: str) -> None:
        counted.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(self.location)


def _encoded(misses: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``(digest, n_bytes, n_tokens)`` of ``misses(digest, content)``, a bounded group of texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1))
            counts, group, size = [], [], 0
            for text, length in zip(batch.column(1), sizes.to_pylist()):
                if group and size + length > GROUP_BYTES:
                    counts += tokenizer.counts(group)
                    group, size = [], 0
                group.append(text.as_py())
                size += length
            counts += tokenizer.counts(group) if group else []
            columns = [batch.column(0), sizes.cast(pa.int64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "n_bytes", "n_tokens"])

    return misses.select("digest", "content").mapInArrow(run, "digest binary, n_bytes long, n_tokens long")


def token_counts(docs: DataFrame, tokenizer: Tokenizer, cache: CountCache) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)``, one row for each row of ``docs``.

    Digests of the texts are joined to the cache; of those it lacks, each distinct text is encoded once and its count
    appended; then every row takes its count from the cache. Copies are combined before the texts are shuffled, so a
    text that a third of all rows have costs one row per task; the last join moves digests only, and splits hot ones
    at run time.

    A null text counts as empty and has no bytes and no tokens. Repeated rows and null ids are returned as they come,
    an empty table gives an empty result; further columns are ignored.
    """
    rows = docs.select("doc_id", content("text").alias("content")).withColumn("digest", F.unhex(F.sha2("content", 256)))
    known = cache.counts(tokenizer.version).select("digest")
    misses = rows.groupBy("digest").agg(F.first("content").alias("content")).join(known, "digest", "left_anti")
    cache.append(_encoded(misses, tokenizer), tokenizer.version)
    brief = rows.select("doc_id", "digest", F.octet_length("content").cast("long").alias("n_bytes"))
    counts = stored(cache.counts(tokenizer.version))  # so that the join may split hot digests on both sides
    return brief.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
