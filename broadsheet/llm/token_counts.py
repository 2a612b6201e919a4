"""Token counts by source, language and tokenizer version, kept up to date by signed changes.

A batch of changes (insert, delete, revise) becomes signed ledger rows: what a change replaces is taken back, what it brings is added. Their sums
by (source, lang, tokenizer) are the batch's delta, and totals are sums of deltas. Ledger rows lie in PARTS parts by a hash of their key: a batch reads
only the parts of its own keys, and there only rows of its own documents.

A batch is committed by the next numbered entry of the log, which is created last and only if no one else has that number: a batch id in the log changes nothing
any more, a run that broke off leaves only files that nothing refers to, and of two writers at once the later one starts over from what the other
committed (the store must create files exclusively, as HDFS does). ``compact`` replaces the ledgers so far by what stands.

Of several changes to one (doc_id, tokenizer) in a batch, the one of the largest seq stands, if the changes have this column (null orders first);
of equal ones deletes yield to inserts and revisions, and of these the largest count stands. Inserting a known document revises it; deleting or revising an
unknown one deletes nothing or inserts it. A null tokenizer is a version of its own. Any other op than the three, null included, fails the batch as a whole. Rows
without doc_id can't be addressed again: inserting them adds them, each one, and other changes to them do nothing. Null texts have no tokens, texts of
any length are counted whole; null sources and languages are groups of their own; null counts add nothing. Groups whose documents have all gone leave the
totals. An empty batch is committed like any other, and an empty rollup has empty totals. Other columns of changes don't matter.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm.token_files import library_ids
from broadsheet.storage import new_path

KEY = ["doc_id", "tokenizer"]
GROUP = ["source", "lang", "tokenizer"]
OPS = ("insert", "delete", "revise")
PARTS = 64
LEDGER = "doc_id long, source string, lang string, tokenizer string, n_tokens long, sign int, part int"
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, lang, n_tokens of every whole text."""

    def run(batches):
        encode = library_ids(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                b = batch.slice(k, 128)
                n = [len(x) // encode.v.dtype.itemsize for x in encode([t or "" for t in b["text"].to_pylist()])]
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"], b["lang"], pa.array(n, pa.int64())], ["doc_id", "source", "lang", "n_tokens"])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text"))]
    return docs.select(*columns).mapInArrow(run, "doc_id long, source string, lang string, n_tokens long")


def _part() -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(PARTS)).cast("int").alias("part")


def _same_key(a: DataFrame, b: DataFrame) -> Column:
    return (a["doc_id"] == b["doc_id"]) & a["tokenizer"].eqNullSafe(b["tokenizer"])


class Rollup:
    """Totals under a folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "token-counts")
        self.fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def log(self) -> list[dict]:
        """Entries in order: batch, files (the attempt's name), and in compactions `covers` (entries that they stand for). Unfinished ones count as taken."""
        root = self.fs_path(f"{self.path}/log")
        names = sorted(x.getPath().getName() for x in self.fs.listStatus(root)) if self.fs.exists(root) else []
        out = []
        for n in (n for n in names if n.endswith(".json")):
            stream = self.fs.open(self.fs_path(f"{self.path}/log/{n}"))
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            out.append(json.loads(text) if text.endswith("}") else {"batch": None, "files": None})
        return out

    def _commit(self, number: int, entry: dict) -> bool:
        """Create the entry; False if another writer has the number."""
        target = self.fs_path(f"{self.path}/log/{number:08d}.json")
        if self.fs.exists(target):
            return False
        try:
            out = self.fs.create(target, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e) or "AlreadyBeingCreated" in str(e):
                return False
            raise
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return True

    def committed(self) -> list[str]:
        """Ids of the batches in the log."""
        return sorted(e["batch"] for e in self.log() if e["batch"] is not None)

    def _ledgers(self, log: list[dict]) -> list[str]:
        covered = max((e["covers"] for e in log if "covers" in e), default=0)
        latest = [e["files"] for e in log if e.get("covers") == covered and covered][:1]
        return [f"{self.path}/ledger/{f}" for f in [*latest, *(e["files"] for e in log[covered:] if e["files"] and "covers" not in e)]]

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        """Rows of all paths; parts are folders, so that a filter on them prunes files."""
        frames = [self.spark.read.schema(schema).parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    def current(self, log: list[dict] | None = None, keys: DataFrame | None = None) -> DataFrame:
        """What stands for each document (of the given keys): ledger rows that no later row took back."""
        columns = [*KEY, "source", "lang", "n_tokens"]
        rows = self._read(self._ledgers(self.log() if log is None else log), LEDGER).filter("doc_id IS NOT NULL")
        if keys is not None:
            parts = [r["part"] for r in keys.select(_part()).distinct().collect()]  # PARTS numbers at most
            rows = rows.filter(F.col("part").isin(parts))
            rows = rows.join(keys, _same_key(rows, keys), "left_semi")
        return rows.groupBy(*columns).agg(F.sum("sign").alias("sign")).filter("sign > 0").select(*columns)

    def _write(self, signed: DataFrame, files: str) -> str:
        path = f"{self.path}/ledger/{files}"
        signed.select(*(F.col(c) for c in ("doc_id", *GROUP, "n_tokens")), F.col("sign").cast("int").alias("sign"), _part()).repartition("part").write.partitionBy("part").parquet(path)
        return path

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit changes (op, doc_id, source, lang, tokenizer, n_tokens, and seq if order matters) under an id; False if it was committed before."""
        checked = F.when(F.col("op").isin(*OPS), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("no such change: "), F.coalesce(F.col("op"), F.lit("null"))))).alias("op")
        seq = (F.col("seq") if "seq" in changes.columns else F.lit(None)).cast("long").alias("seq")
        texts = [F.col(c).cast("string").alias(c) for c in GROUP]
        rows = changes.select(checked, F.col("doc_id").cast("long").alias("doc_id"), *texts, F.col("n_tokens").cast("long").alias("n_tokens"), seq)
        keyed = rows.filter("doc_id IS NOT NULL").groupBy(*KEY).agg(F.max(F.struct("seq", (F.col("op") != "delete").alias("live"), "n_tokens", "source", "lang")).alias("new"))
        loose = rows.filter("doc_id IS NULL").filter(F.col("op") == "insert").withColumn("sign", F.lit(1))
        new = keyed.filter("new.live").select(*KEY, "new.n_tokens", "new.source", "new.lang", F.lit(1).alias("sign"))
        columns = ["doc_id", *GROUP, "n_tokens", "sign"]
        while True:
            log = self.log()
            if any(e["batch"] == batch for e in log):
                return False
            files = f"{batch}-{uuid.uuid4().hex}"
            signed = [x.select(*columns) for x in (new, loose)]
            if self._ledgers(log):
                signed.append(self.current(log, keyed.select(*KEY)).withColumn("sign", F.lit(-1)).select(*columns))
            written = self.spark.read.schema(LEDGER).parquet(self._write(reduce(DataFrame.unionByName, signed), files))
            delta = written.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.coalesce("n_tokens", F.lit(0))).alias("n_tokens"))
            delta.select(*GROUP, "n_docs", "n_tokens").write.parquet(f"{self.path}/deltas/{files}")
            if self._commit(len(log), {"batch": batch, "files": files}):
                return True

    def compact(self) -> bool:
        """One ledger of what stands in place of all before it; False if another writer came first. Totals don't change, old files may go afterwards."""
        log = self.log()
        ledgers = self._ledgers(log)
        if len(ledgers) < 2:
            return True
        loose = self._read(ledgers, LEDGER).filter("doc_id IS NULL").select("doc_id", *GROUP, "n_tokens", "sign")
        files = f"compacted-{uuid.uuid4().hex}"
        self._write(self.current(log).withColumn("sign", F.lit(1)).select("doc_id", *GROUP, "n_tokens", "sign").unionByName(loose), files)
        return self._commit(len(log), {"batch": None, "files": files, "covers": len(log)})

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens."""
        deltas = [f"{self.path}/deltas/{e['files']}" for e in self.log() if e["batch"] is not None]
        summed = (self.spark.read.schema(DELTA).parquet(*deltas) if deltas else self.spark.createDataFrame([], DELTA)).groupBy(*GROUP)
        return summed.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0")
