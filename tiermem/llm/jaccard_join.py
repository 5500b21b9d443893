"""N-gram Jaccard join with a token-group matrix.

A document is the set of its hashed word n-grams. Documents with equal sets are one
representative. Similar representatives are put into groups; the matrix holds for every
token of a group's union the group. A query document meets a group only if enough of its
tokens are in the group's union: for two sets of sizes n and m whose similarity reaches
the threshold, the first ``prefix`` tokens of both, in one order of all tokens, share at
least ``needed`` tokens, so counts over these prefixes bound the overlap. Tokens are
ordered by a hashed count over the whole corpus, rarest first: any order is exact, and this
one keeps frequent passages out of the matrix. Qualifying groups are opened twice:

1. against the group's pivot alone, which settles families of near copies;
2. where a query and a group are still not in one component, against blocks of the
   group's members, again only if the block's full token union can reach the overlap.

Only links that join something are kept (a spanning forest per opened block), never all
pairs of a group. Groups and queries are cut into blocks of bounded size, so a family that
holds a third of all rows is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiermem.llm.common import bucketed, cut_lineage, release, text_rows
from tiermem.llm.components import components

CACHED_WORDS = 300_000
COUNTERS = 1 << 21
CHUNKS = 64
MEMBERS = 256
BLOCK_TOKENS = 300_000
SMALL_TOKENS = 2_000  # no use in more parts than that for a small table
BROADCAST_IDS = 2_000_000
QUERIES = 512
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Shingler(dict):
    """Hashed word n-grams of texts: A-Z lower-cased, words between ASCII white space; the cache of words is bounded."""

    def __init__(self, words: int):
        super().__init__()
        self.words = words

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value

    def grams(self, text: str | None) -> np.ndarray:
        """Hashes of all n-grams of a text, repeats included; a text with fewer words is one n-gram."""
        found = (text or "").encode("utf-8", "replace").lower().split()
        if not found:
            return np.empty(0, np.uint64)
        ids = np.fromiter(map(self.__getitem__, found), np.uint64, len(found))
        width = min(self.words, len(ids))
        out = np.full(len(ids) - width + 1, np.uint64(width))
        for j in range(width):
            out = (out ^ ids[j:len(ids) - width + 1 + j]) * MIX_A
            out ^= out >> np.uint64(29)
            out *= MIX_B
            out ^= out >> np.uint64(32)
        return out


def needed_overlap(n, m, percent: int):
    """Least intersection of two sets of sizes n and m whose similarity is at least percent / 100."""
    return -(-(percent * (n + m)) // (100 + percent))


def _ceil_share(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100)


def _token_counts(docs: DataFrame, words: int, id_col: str, text_col: str) -> np.ndarray:
    """Counts of all n-grams of the corpus in ``COUNTERS`` hashed counters: bounded, whatever the corpus."""
    size = COUNTERS // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, total, seen = Shingler(words), np.zeros(COUNTERS, np.uint32), False
        for _, texts in text_rows(batches):
            for text in texts:
                total += np.bincount((shingler.grams(text) >> np.uint64(43)).astype(np.int64), minlength=COUNTERS).astype(np.uint32) \
                    if len(text or "") > 1 << 20 else 0
            short = [shingler.grams(t) for t in texts if len(t or "") <= 1 << 20]
            if short:
                total += np.bincount((np.concatenate(short) >> np.uint64(43)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            seen = True
        if seen:
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array(range(CHUNKS), pa.int32()),
                "counts": pa.array([total[i * size:(i + 1) * size].tobytes() for i in range(CHUNKS)], pa.binary())})

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint64)
        for batch in batches:
            for cell in batch.column("counts"):
                total += np.frombuffer(cell.as_buffer(), np.uint32)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([key[0].as_py()], pa.int32()),
                                          "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    parts = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(count, "chunk int, counts binary")
    out = np.zeros(COUNTERS, np.uint32)
    for chunk, counts in parts.groupBy("chunk").applyInArrow(merge, "chunk int, counts binary").collect():
        out[chunk * size:(chunk + 1) * size] = np.frombuffer(counts, np.uint32)
    return out


def _prefixes(docs: DataFrame, words: int, percent: int, counts, id_col: str, text_col: str) -> DataFrame:
    """Id, ``n`` (set size), ``sig`` (digest of the set; null if empty) and ``prefix`` (its rarest tokens, packed)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, common = Shingler(words), counts.value
        for ids, texts in text_rows(batches):
            rows = []
            for text in texts:
                tokens = np.unique(shingler.grams(text))
                n = len(tokens)
                if not n:
                    rows.append((0, None, None))
                    continue
                take = n + (-percent * n) // 100 + 1
                order = np.lexsort((tokens, common[(tokens >> np.uint64(43)).astype(np.int64)]))[:take]
                rows.append((n, hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), tokens[order].tobytes()))
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(ids, pa.int64()), "n": pa.array([r[0] for r in rows], pa.int64()),
                "sig": pa.array([r[1] for r in rows], pa.binary()), "prefix": pa.array([r[2] for r in rows], pa.binary())})

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id bigint, n bigint, sig binary, prefix binary")


def _in_block(left: pa.Table, right: pa.Table) -> tuple[list[tuple], np.ndarray, np.ndarray, dict[int, bytes]]:
    """A block's representatives (ids, sizes), their prefix tokens, and the answers by bucket."""
    letters = list(zip(*(right.column(c).to_pylist() for c in ("kind", "number", "first"))))
    copies = {(n, f) for k, n, f in letters if k == 0}
    answers = {n: f for k, n, f in letters if k == 1}
    rows = [(i, n, p) for i, n, g, p in zip(*(left.column(c).to_pylist() for c in ("id", "n", "sig", "prefix"))) if (i, g) not in copies]
    tokens = np.frombuffer(b"".join(r[2] for r in rows), np.uint64)
    return rows, tokens, np.repeat(np.arange(len(rows)), [len(r[2]) // 8 for r in rows]), answers


def _shared_posts(sets: DataFrame, copies: DataFrame, total: int) -> DataFrame:
    """Rows (token, id, n) of the prefix tokens that at least two representatives hold.

    Blocks of documents name each of their tokens once to the token's bucket and get one
    answer per token, so tokens travel as packed numbers and a token that many
    documents hold costs a row per block.
    """
    spark = sets.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, min(parts, total // SMALL_TOKENS), -(-total // BLOCK_TOKENS))
    stored = bucketed(sets.select("id", "n", "sig", "prefix").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "block", min(parts, blocks))
    block_of = F.pmod(F.xxhash64("id"), F.lit(blocks))
    letters = "block bigint, kind int, number bigint, first binary"
    mail = cut_lineage(copies.select(block_of.alias("block"), F.lit(0).alias("kind"), F.col("id").alias("number"), F.col("sig").alias("first")))

    def cuts_of(tokens: np.ndarray) -> list[tuple[int, slice]]:
        bucket = ((tokens >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
        return [(int(bucket[i]), slice(int(i), int(j))) for i, j in zip(start, [*start[1:], len(bucket)])]

    def ask(key, left, right):
        _, tokens, _, _ = _in_block(left, right)
        names, counts = np.unique(tokens, return_counts=True)
        cuts, many = cuts_of(names), (counts > 1).astype(np.uint8)
        return pa.table({"bucket": pa.array([i for i, _ in cuts], pa.int64()), "block": pa.array([key[0].as_py()] * len(cuts), pa.int64()),
                         "tokens": pa.array([names[c].tobytes() for _, c in cuts], pa.binary()),
                         "many": pa.array([many[c].tobytes() for _, c in cuts], pa.binary())})

    def answer(key, asked):
        sizes = [len(m) for m in asked.column("many").to_pylist()]
        tokens = np.frombuffer(b"".join(asked.column("tokens").to_pylist()), np.uint64)
        many = np.frombuffer(b"".join(asked.column("many").to_pylist()), np.uint8)
        _, back, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        held = counts > 1
        held[back[many == 1]] = True
        bits, ends = held[back], np.cumsum(sizes)
        return pa.table({"block": asked.column("block"), "kind": pa.array([1] * len(sizes), pa.int32()),
                         "number": pa.array([key[0].as_py()] * len(sizes), pa.int64()),
                         "first": pa.array([np.packbits(bits[e - s:e]).tobytes() for s, e in zip(sizes, ends)], pa.binary())})

    def post(key, left, right):
        rows, tokens, owner, answers = _in_block(left, right)
        names, back = np.unique(tokens, return_inverse=True)
        held = np.zeros(len(names), bool)
        for i, c in cuts_of(names):
            held[c] = np.unpackbits(np.frombuffer(answers[i], np.uint8), count=c.stop - c.start).astype(bool)
        keep = held[back]
        ids, sizes = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        return pa.table({"token": pa.array(tokens[keep].view(np.int64)), "id": pa.array(ids[owner[keep]]), "n": pa.array(sizes[owner[keep]])})

    def with_mail(letter: DataFrame, step, schema: str) -> DataFrame:
        return stored.groupBy("block").cogroup(letter.groupBy("block")).applyInArrow(step, schema)

    asked = with_mail(mail, ask, "bucket bigint, block bigint, tokens binary, many binary")
    mail = mail.unionByName(cut_lineage(asked.groupBy("bucket").applyInArrow(answer, letters)))
    return cut_lineage(with_mail(mail, post, "token bigint, id bigint, n bigint"))


def _sets(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for ids, texts in text_rows(batches):
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(ids, pa.int64()),
                "tokens": pa.array([np.unique(shingler.grams(t)).tobytes() for t in texts], pa.binary())})

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id bigint, tokens binary")


class _Forest:
    """Union-find over the labels of one opened block."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


class _Block:
    """Members of a block with their token union and, per token of it, the members that hold it."""

    def __init__(self, members: list[tuple[int, int, np.ndarray]], percent: int):
        self.ids = np.array([m[0] for m in members])
        self.label = [m[1] for m in members]
        self.sizes = np.array([len(m[2]) for m in members])
        flat = np.concatenate([m[2] for m in members])
        owner = np.repeat(np.arange(len(members)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.union, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.percent = percent
        self.forest = _Forest()

    def links(self, query: int, label: int, tokens: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links of a query to members that are not in its class yet, one for each class it joins."""
        n, t = len(tokens), self.percent
        fits = (100 * self.sizes >= t * n) & (t * self.sizes <= 100 * n) & (self.ids != query)
        if not fits.any():
            return
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        if len(at) < needed_overlap(n, int(self.sizes[fits].min()), t):
            return  # the union bounds every member's overlap
        counts = self.count[at]
        starts = np.repeat(self.first[at] - np.cumsum(counts) + counts, counts)
        shared = np.bincount(self.owner[starts + np.arange(len(starts))], minlength=len(self.ids))
        for i in np.flatnonzero(fits & (100 * shared >= t * (n + self.sizes - shared))):
            if self.forest.join(label, self.label[i]):
                yield query, int(self.ids[i])


def _opened(rows: DataFrame, percent: int) -> DataFrame:
    """Links found by opening blocks. ``rows``: unit, role (0 member, 1 query), id, label, tokens.

    Rows of a unit are sorted into one task, members first; a task holds one unit's members.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, members, block = None, [], None
        for batch in batches:
            out: list[tuple[int, int]] = []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for u, role, i, label, cell in zip(*columns, batch.column(4)):
                if u != unit:
                    unit, members, block = u, [], None
                tokens = np.frombuffer(cell.as_buffer(), np.uint64)
                if role == 0:
                    members.append((i, label, tokens.copy()))
                elif members:
                    block = block or _Block(members, percent)
                    out += block.links(i, label, tokens)
            if out:
                yield pa.RecordBatch.from_pydict({"a": pa.array([o[0] for o in out], pa.int64()),
                                                  "b": pa.array([o[1] for o in out], pa.int64())})

    # a long document's tokens are large, so Arrow batches here are left to the session's size limit
    return rows.select("unit", "role", "id", "label", "tokens").repartition("unit").sortWithinPartitions("unit", "role").mapInArrow(
        run, "a bigint, b bigint")


def classes(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (smallest id reachable by links) of every row.

    Documents link when 100 * intersection >= percent * union. Null, empty and blank texts have
    no n-grams and link with nothing. Every row is judged by its text; equal texts
    are one class. Only the id and the text are read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(_token_counts(docs, words, id_col, text_col))
    sets = cut_lineage(_prefixes(docs, words, percent, counts, id_col, text_col))
    same = sets.filter(F.col("sig").isNotNull()).groupBy("sig").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    copies = sets.select("id", "sig").join(same.drop("copies"), "sig").filter("id <> rep").select("id", "sig")
    total = sets.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0

    # tokens that two representatives share, with the smallest of them as leader
    posts = _shared_posts(sets.filter(F.col("prefix").isNotNull() & F.col("id").isNotNull()), copies, total // 8)
    leaders = posts.groupBy("token").agg(F.min("id").alias("leader"))
    posts = cut_lineage(posts.join(leaders, "token"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.03)))
    members = posts.groupBy("id").agg(F.min("leader").alias("leader"), F.first("n").alias("n")).withColumn("band", band)
    copied = same.filter("copies > 1").select(F.col("rep").alias("id"), "copies")
    members = cut_lineage(members.join(copied, "id", "left").withColumn("grp", F.xxhash64("leader", "band")))
    # the text most often copied is the likeliest middle of its family
    middle = F.min_by("id", F.struct((-F.coalesce("copies", F.lit(1))).alias("c"), "id"))
    groups = members.groupBy("grp").agg(F.min("n").alias("low"), F.max("n").alias("high"), middle.alias("pivot"), F.count(F.lit(1)).alias("size"))

    # the matrix (token, group), met by the tokens of every query
    matrix = posts.join(members.select("id", "grp"), "id").groupBy("token", "grp").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    met = posts.join(matrix, "token").filter(
        (F.col("n") * percent <= F.col("high") * 100) & (F.col("low") * percent <= F.col("n") * 100))
    met = met.groupBy("id", "grp").agg(F.count(F.lit(1)).alias("hits"), F.first("n").alias("n")).join(groups, "grp")
    near = F.greatest(F.col("low"), F.ceil(F.col("n") * percent / 100))
    far = F.least(F.col("high"), F.floor(F.col("n") * 100 / percent))

    def wanted(m: Column) -> Column:
        overlap = F.ceil((F.col("n") + m) * percent / (100 + percent))
        return overlap - F.greatest(_ceil_share(F.col("n"), percent), _ceil_share(m, percent)) + 1

    # one less than the bound guards the rounding of the divisions
    met = met.filter((near <= far) & (F.col("hits") >= F.least(wanted(near), wanted(far)) - 1)).filter("size > 1 OR id <> pivot")
    met = cut_lineage(met.select("id", "grp", "pivot"))
    used = met.select("id").unionByName(met.select(F.col("pivot").alias("id"))).unionByName(
        members.join(met.select("grp").distinct(), "grp", "left_semi").select("id")).distinct()
    used = cut_lineage(used)
    release(spark)
    # ids of a checked number are sent to the texts; beyond it both sides are shuffled
    few = F.broadcast(used) if used.count() <= BROADCAST_IDS else used
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text_")).join(few, "id")
    full = cut_lineage(_sets(chosen, words, "id", "text_"))

    def units(member: DataFrame, query: DataFrame) -> DataFrame:
        """member: grp, block, id, label; query: grp, block, id, label. Queries of a block are cut, members copied to each cut."""
        salts = query.groupBy("grp", "block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("salts"))
        q = query.join(salts, ["grp", "block"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).withColumn("role", F.lit(1))
        m = member.join(salts, ["grp", "block"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("role", F.lit(0))
        columns = ["grp", "block", "salt", "role", "id", "label"]
        both = m.select(*columns).unionByName(q.select(*columns))
        both = both.select(F.concat_ws(":", "grp", "block", "salt").alias("unit"), "role", "id", "label")
        return both.join(full, "id")

    zero = F.lit(0).cast("long")
    pivots = met.select("grp", F.col("pivot").alias("id")).distinct()
    stars = _opened(units(pivots.select("grp", zero.alias("block"), "id", F.col("id").alias("label")),
                          met.select("grp", zero.alias("block"), "id", F.col("id").alias("label")).filter("true")), percent)
    stars = cut_lineage(stars)
    first = cut_lineage(components(stars))

    def labelled(df: DataFrame) -> DataFrame:
        return df.join(first, df["id"] == first["node"], "left").withColumn("label", F.coalesce("component", "id")).drop("node", "component")

    # blocks of about MEMBERS members; members of one class stand together, so that most blocks are of one class
    opened = labelled(members.join(met.select("grp").distinct(), "grp", "left_semi").select("grp", "id"))
    opened = opened.join(groups.select("grp", F.ceil(F.col("size") / MEMBERS).alias("parts")), "grp").withColumn(
        "part", F.pmod(F.xxhash64("label"), F.col("parts")))
    place = F.row_number().over(Window.partitionBy("grp", "part").orderBy("label", "id")) - 1
    opened = opened.withColumn("block", F.floor(place / MEMBERS) * F.col("parts") + F.col("part"))
    opened = cut_lineage(opened.select("grp", "block", "id", "label"))
    spans = opened.groupBy("grp", "block").agg(F.min("label").alias("from_"), F.max("label").alias("to_"))
    asking = labelled(met.select("grp", "id")).join(spans, "grp").filter("NOT (label = from_ AND label = to_)").select("grp", "block", "id", "label")
    edges = stars.unionByName(_opened(units(opened, asking), percent))
    found = components(edges)

    rows = sets.join(same.drop("copies"), "sig", "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    rows = rows.join(found, rows["rep"] == found["node"], "left")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
