"""A lexical index that outlives a batch of queries: base, deltas, tombstones, compaction.

Postings lie in folders by a hash of (store, term), so a batch of queries reads the folders
of its own terms and no text. A folder has one packed row for every document with terms in it.
Every change writes one version: the new documents' packed rows, the names of rows that went
(tombstones), and what both add to or take from the stores' sizes. A marker written last makes a
version visible. Sizes are sums over versions; a row is live unless a later version names it among
those that went. Document frequencies are counts of the live postings a batch of queries reads, so
no change reads or shuffles the terms of what it adds or takes. Compaction writes all live documents
as a new base, before which nothing is read.

Every task packs the documents it reads and writes its own part of every folder, so postings
are never shuffled, and no row per posting is written or sorted.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tiermem.functions import text
from tiermem.session import cut_lineage, folders, path_exists

#: Folders of postings; a large index wants thousands.
BUCKETS = 16
#: Terms of a store, and stores, whose folders a task remembers.
KEPT_TERMS, KEPT_STORES = 100_000, 8
#: Documents per batch that leaves a task.
BATCH_DOCS = 2000
TABLES = {
    "postings": "store_key string, id string, doc_len long, terms string, tfs array<int>, version long, bucket int",
    "sizes": "store_key string, n_docs long, words long, version long",
    "gone": "store_key string, id string, version long",
}
PACKED = "store_key string, id string, doc_len long, terms string, tfs array<int>, bucket int"


class _Places(dict):
    """The folders of a store's terms, kept for the terms met last."""

    def __init__(self, store: str, buckets: int):
        super().__init__()
        self.key, self.buckets = zlib.crc32(store.encode()), buckets

    def __missing__(self, term: str) -> int:
        if len(self) >= KEPT_TERMS:
            self.clear()
        self[term] = place = zlib.crc32(term.encode(), self.key) % self.buckets
        return place


def _parts(places: _Places, counts: Counter) -> list[tuple[int, str, list[int]]]:
    """(bucket, terms, counts) of one document; the folder of the empty term has a row in any case, ending in that term."""
    found: list[list] = [[] for _ in range(places.buckets)]
    for term in counts:
        found[places[term]].append(term)
    home = places[""]
    return [(b, " ".join(terms + [""] if b == home else terms), [counts[t] for t in terms])
            for b, terms in enumerate(found) if terms or b == home]


def packed_terms(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """docs(store_key, id, body), one row per store and id -> (store_key, id, doc_len, terms, tfs, bucket), without a shuffle.

    A row per document and folder; ``terms`` are parted by a space, ``tfs`` has their counts.
    Rows without store, id or body are left out.
    """
    rows = docs.where("store_key IS NOT NULL AND id IS NOT NULL AND body IS NOT NULL").select(
        "store_key", F.col("id").cast("string").alias("id"), F.array_join(text.tokens(F.col("body")), " ").alias("words"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict[str, _Places] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_DOCS):
                found, counts = [], []
                for store, id_, words in zip(*(column.to_pylist() for column in batch.slice(start, BATCH_DOCS).columns)):
                    words = words.split()
                    if store not in stores:
                        stores = {store: _Places(store, buckets)} if len(stores) >= KEPT_STORES else {**stores, store: _Places(store, buckets)}
                    for bucket, terms, tfs in _parts(stores[store], Counter(words)):
                        found.append((store, id_, len(words), terms, bucket, len(tfs)))
                        counts.extend(tfs)
                keys, ids, lengths, terms, numbers, sizes = zip(*found)
                ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.string()), pa.array(ids, pa.string()), pa.array(lengths, pa.int64()), pa.array(terms, pa.string()),
                    pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32())), pa.array(numbers, pa.int32()),
                ], ["store_key", "id", "doc_len", "terms", "tfs", "bucket"])

    return rows.mapInArrow(pack, PACKED)


def unpacked(packed: DataFrame) -> DataFrame:
    """A row per term of every packed document, and one under the empty term, so that sizes follow from the same rows."""
    others = [c for c in packed.columns if c not in ("terms", "tfs")]
    rows = packed.select(*others, "tfs", F.posexplode(F.split("terms", " ")).alias("_n", "term"))
    return rows.select(*others, "term", F.coalesce(F.get("tfs", "_n"), F.lit(0)).cast("long").alias("tf"))


class LexicalIndex:
    """An index in a folder that all executors share. One writer at a time; readers see whole versions only."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, *parts: str):
        return F.pmod(F.crc32(F.concat(*parts)), F.lit(self.buckets)).cast("int")

    def _documents(self, packed: DataFrame) -> DataFrame:
        """One row (store_key, id, doc_len) per packed document, the one in the folder of its store's empty term; no term is read."""
        return packed.where(F.col("bucket") == self._bucket("store_key"))

    def _wanted(self) -> list[int]:
        """Published versions from the last base on."""
        versions = self._versions()
        base = max((v for v, is_base in versions if is_base), default=0)
        return [v for v, _ in versions if v >= base]

    def _read(self, name: str) -> DataFrame:
        """Rows of all published versions from the last base on."""
        schema = StructType.fromDDL(TABLES[name])
        wanted = self._wanted()
        if not wanted or not path_exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("version").isin(wanted))

    def _versions(self) -> list[tuple[int, bool]]:
        """Published versions; a row per change since the index began, so compaction keeps few deltas behind its base."""
        folder = f"{self.path}/published"
        if not path_exists(self.spark, folder):
            return []
        rows = self.spark.read.schema("base boolean, version long").parquet(folder).collect()
        return sorted((r.version, r.base) for r in rows)

    def _write(self, name: str, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/version={version}")

    def _write_documents(self, packed: DataFrame, version: int) -> DataFrame:
        """Write packed documents into their folders; the rows as written."""
        path = f"{self.path}/postings/version={version}"
        packed.select("store_key", "id", "doc_len", "terms", "tfs", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return self.spark.read.schema(PACKED).parquet(path)

    def _publish(self, version: int, base: bool) -> None:
        self.spark.range(1).select(F.lit(base).alias("base")).write.mode("overwrite").parquet(f"{self.path}/published/version={version}")

    def _next(self) -> int:
        return max((v for v, _ in self._versions()), default=0) + 1

    def _change(self, version: int, added: DataFrame | None, gone: DataFrame | None) -> None:
        """Write one version: ``added`` has packed documents, ``gone`` the store_key and id of rows that go if they are there."""
        parts = []
        if gone is not None:
            names = gone.where("store_key IS NOT NULL AND id IS NOT NULL").select("store_key", "id").distinct()
            there = self._documents(self._read("postings")).select("store_key", "id", "doc_len", "version")
            left = cut_lineage(self._live(there.join(names, ["store_key", "id"], "left_semi")).drop("version"))
            parts.append(left.withColumn("one", F.lit(-1).cast("long")))
            if not left.isEmpty():
                self._write("gone", left.select("store_key", "id").distinct(), version)
        if added is not None:
            parts.append(self._documents(self._write_documents(added, version)).select("store_key", "id", "doc_len").withColumn("one", F.lit(1).cast("long")))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        self._write("sizes", rows.groupBy("store_key").agg(F.sum("one").alias("n_docs"), F.sum(F.col("one") * F.col("doc_len")).alias("words")), version)
        self._publish(version, False)

    def add(self, docs: DataFrame) -> None:
        """docs(store_key, id, body): a row takes the place of an earlier one of its store and id."""
        version = self._next()
        replaced = docs.select("store_key", "id") if version > 1 else None
        self._change(version, packed_terms(docs, self.buckets), replaced)

    def delete(self, ids: DataFrame) -> None:
        """ids(store_key, id): these rows are found no more; unknown ids do nothing."""
        self._change(self._next(), None, ids)

    def compact(self) -> None:
        """Write the live documents as a new base; older versions are read no more."""
        version = self._next()
        self._write_documents(self._live(self._read("postings")), version)
        self._write("sizes", self._read("sizes").groupBy("store_key").agg(F.sum("n_docs").alias("n_docs"), F.sum("words").alias("words")), version)
        self._publish(version, True)

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows without those a later version names among the gone; versions without such names join nothing."""
        named = {int(name.removeprefix("version=")) for name in folders(self.spark, f"{self.path}/gone") if name.startswith("version=")}
        if not named.intersection(self._wanted()):
            return rows
        last = self._read("gone").groupBy("store_key", "id").agg(F.max("version").alias("_gone"))
        kept = rows.join(last, ["store_key", "id"], "left").where("_gone IS NULL OR version >= _gone")
        return kept.drop("_gone")

    def _folders_of(self, name: str, wanted: DataFrame) -> DataFrame:
        """The folders of the wanted (store_key, term); at most ``buckets`` numbers go to the driver."""
        numbers = [r[0] for r in wanted.select(self._bucket("store_key", "term").alias("b")).distinct().collect()]
        return self._read(name).where(F.col("bucket").isin(numbers))

    def postings(self, wanted: DataFrame) -> DataFrame:
        """(store_key, id, term, tf, doc_len) of the live rows that hold a wanted (store_key, term)."""
        wanted = wanted.select("store_key", "term").distinct()
        rows = unpacked(self._folders_of("postings", wanted)).join(wanted, ["store_key", "term"], "left_semi")
        return self._live(rows).select("store_key", "id", "term", "tf", "doc_len")

    def statistics(self, wanted: DataFrame, found: DataFrame | None = None) -> DataFrame:
        """(store_key, term, df, n_docs, avg_len) of the wanted terms that a live row holds; ``found`` are their postings, if they are at hand."""
        rows = self.postings(wanted) if found is None else found
        df = rows.where("term <> ''").groupBy("store_key", "term").agg(F.count(F.lit(1)).alias("df"))
        sizes = self._read("sizes").groupBy("store_key").agg(F.sum("n_docs").alias("n_docs"), F.sum("words").alias("_words"))
        whole = sizes.where("n_docs > 0").select("store_key", "n_docs", (F.col("_words") / F.col("n_docs")).alias("avg_len"))
        return df.join(whole, "store_key")
