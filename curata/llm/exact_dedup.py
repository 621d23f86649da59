"""Operator 4: exact deduplication by a log-structured merge index of text digests.

Two texts are equal when they are identical after each run of ASCII white space became one space (null is empty). The
index maps a digest to the smallest doc_id that has it:

* *memtables*: each task keeps a table from digest to (smallest id, its text, all ids). A row whose digest is there is a
  hit, and is verified byte by byte against the text; another text under the same digest gets an entry (a variant) of
  its own. A full memtable is flushed, so its memory is bounded by MEMTABLE_BYTES whatever the table's size.
* *runs*: a flush is a run of level 0, sorted by digest, with a number of its own. Runs are written to the shared folder.
* *compaction*: runs of any level are merged into one of the next level: their entries meet by digest range, in order of
  digest and id, and are merged as they stream by; the smallest id stays, sizes add up, and every digest has an entry. A
  group of copies that holds a third of all rows sends one entry from each memtable.
* *filters*: a run has two Bloom filters of a fixed number of bits, which are broadcast: of its digests, and of those that
  several entries had. A lookup asks the filter first, and only digests that pass it are joined to the run. So entries
  without a copy in another run, in most corpora nearly all, move nowhere and stand for themselves. A full filter lets
  everything pass, which costs work and no results.
* *batches*: Index holds the runs of several batches of documents, two of one level being compacted into one of the next;
  a batch that comes later is looked up in all of them, and added.
* *verification*: where runs share a digest, the text of each run's smallest id is compared, byte by byte, with that of
  the id that stays. Only these texts move. Texts that differ from it (a digest collision) are grouped by the texts
  themselves.

A null id sorts last: it stays only where all ids of its group are null; such entries have no id to fetch a text by, and
match by their whole SHA-256. Repeated rows with one id count as copies: one of them stays. A long text makes a memtable
fuller and nothing else. An empty table gives an empty result. Only doc_id and text are read, so other columns cannot
clash; survivors() returns them as they were. ``digest_bits`` exists to make collisions testable.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.common import SPACE, IdFilter, drop_staged, settled, shards, ship, staged, text_or_empty, tidy

#: A memtable is flushed when its texts have so many bytes, or it has so many rows.
MEMTABLE_BYTES, MEMTABLE_ROWS = 24 << 20, 200_000
#: Ids in one entry of a run: a hot group's entries are cut into pieces of this size.
ENTRY_IDS = 10_000
#: Bits of a run's filters, as a power of two.
FILTER_BITS = 23


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


@dataclass
class Run:
    """A merged run of some level: entries (digest, keep_id, keep_run, keep_variant, group_size, parts), and a filter of the
    digests with several parts. That of all digests is made when a later batch asks."""

    level: int
    entries: DataFrame
    repeated: IdFilter

    @cached_property
    def known(self) -> IdFilter:
        return IdFilter.build(self.entries.select(_mark().alias("mark")), "mark", FILTER_BITS)


def _flushed(digest_bits: int, nth: int):
    """Rows (doc_id, text, sha) to the entries of sorted runs."""
    size = digest_bits // 8
    kinds = {"run": pa.int64(), "digest": pa.binary(), "variant": pa.int32(), "sha": pa.binary(), "least": pa.int64(), "n": pa.int64(), "ids": pa.list_(pa.int64())}

    def flush(table: dict, run: int) -> Iterator[pa.RecordBatch]:
        entries = []
        for digest in sorted(table):
            for variant, (text, sha, ids) in enumerate(table[digest]):
                ids.sort(key=lambda i: (i is None, i))
                for k in range(0, len(ids), ENTRY_IDS):
                    entries.append((run, digest, variant, sha, ids[0], len(ids) if k == 0 else 0, ids[k : k + ENTRY_IDS]))
        for k in range(0, len(entries), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries[k : k + 4096]), kinds.values())], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = nth << 52 | TaskContext.get().partitionId() << 28
        table: dict[bytes, list] = {}
        held = rows = 0
        for batch in batches:
            for doc, text, sha in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = text.as_buffer().to_pybytes()
                for entry in table.setdefault(sha[:size], []):
                    if entry[0] == text:  # the hit is verified
                        entry[2].append(doc)
                        break
                else:
                    table[sha[:size]].append((text, sha, [doc]))
                    held += len(text)
                rows += 1
                if held > MEMTABLE_BYTES or rows >= MEMTABLE_ROWS:
                    yield from flush(table, number)
                    number += 1
                    table, held, rows = {}, 0, 0
        if rows:
            yield from flush(table, number)

    return run


def build_runs(documents: DataFrame, digest_bits: int = 256, batch: int = 0) -> DataFrame:
    """Flush the runs of level 0 into the shared folder and return their entries."""
    ship(documents.sparkSession)
    text = normalised().cast("binary")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("sha"))
    return staged(rows.mapInArrow(tidy(_flushed(digest_bits, batch)), "run long, digest binary, variant int, sha binary, least long, n long, ids array<long>"), "runs")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads (digest, least, run, variant, n, parts) in the order of digest and id, to one for each digest: the first one's
    id, run and variant, and the sums."""
    names, kinds = MERGED, [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    out, now = [], None
    for batch in batches:
        for head in zip(*(c.to_pylist() for c in batch.columns)):
            if now is not None and now[0] == head[0]:
                now[4] += head[4]
                now[5] += head[5]
                continue
            if now is not None:
                out.append(now)
            now = list(head)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out = []
    if now is not None:
        out.append(now)
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)


MERGED = ["digest", "keep_id", "keep_run", "keep_variant", "group_size", "parts"]


def _merge(heads: DataFrame, level: int) -> Run:
    """Merge heads (digest, least, run, variant, n, parts) into a run."""
    ordered = heads.repartition(shards(heads.sparkSession), "digest").sortWithinPartitions("digest", F.asc_nulls_last("least"), "run", "variant")
    merged = staged(ordered.mapInArrow(tidy(_merged), "digest binary, keep_id long, keep_run long, keep_variant int, group_size long, parts long"), "merged")
    return Run(level, merged, IdFilter.build(merged.where("parts > 1").select(_mark().alias("mark")), "mark", FILTER_BITS))


def _mark() -> Column:
    return F.xxhash64(F.lit("digest"), "digest")


def compact(runs: DataFrame) -> Run:
    """Merge the runs of level 0 of a batch into one of level 1."""
    return _merge(runs.where("n > 0").select("digest", "least", "run", "variant", "n", F.lit(1).cast("long").alias("parts")), 1)


def merge(runs: list[Run]) -> Run:
    """Merge runs of any level into one above them; their tables are deleted."""
    heads = None
    for run in runs:
        own = run.entries.toDF("digest", "least", "run", "variant", "n", "parts")
        heads = own if heads is None else heads.unionByName(own)
    out = _merge(heads, 1 + max(run.level for run in runs))
    drop_staged(*(run.entries for run in runs))
    return out


def passing(probes: DataFrame, run: Run, repeated: bool = True) -> tuple[DataFrame, DataFrame]:
    """``probes`` whose digest the run's filter lets pass, and the others."""
    some, none = (run.repeated if repeated else run.known).split(probes.withColumn("__mark", _mark()), "__mark")
    return some.drop("__mark"), none.drop("__mark")


def lookup(probes: DataFrame, run: Run, repeated: bool = True) -> DataFrame:
    """``probes`` (with a column digest) and the run's entries for them, null where it has none; with ``repeated`` only
    entries of several parts count. Only probes that pass the filter are joined to the run."""
    asked, missing = passing(probes, run, repeated)
    entries = run.entries.where("parts > 1") if repeated else run.entries
    found = asked.join(entries.drop("parts"), "digest", "left")
    for field in entries.drop("parts").schema.fields:
        if field.name != "digest":
            missing = missing.withColumn(field.name, F.lit(None).cast(field.dataType))
    return found.unionByName(missing)


class Index:
    """Exact copies over batches of documents that come one after the other.

    add() gives the decisions on a batch, against all that came before, and takes its documents in. Its rows are those of
    index(), with keep_id and group_size over all batches so far: kept tells that no copy with a smaller id is known, in
    the batch or before. A kept row of an earlier batch is superseded if a smaller id comes later. Texts of one batch that
    share a SHA-256 are told apart as in index(); with those of other batches such texts are not linked.
    """

    def __init__(self) -> None:
        self.runs: list[Run] = []
        self.documents: list[DataFrame] = []
        self.batches = 0

    def add(self, documents: DataFrame) -> DataFrame:
        rows = settled(lambda: self._decided(documents), "batch")
        flushed = build_runs(documents, batch=self.batches)
        self.runs.append(compact(flushed))
        drop_staged(flushed)
        self.documents.append(documents)
        self.batches += 1
        while len(self.runs) > 1 and self.runs[-1].level >= self.runs[-2].level:
            self.runs[-2:] = [merge(self.runs[-2:])]
        return rows

    def _decided(self, documents: DataFrame) -> DataFrame:
        own = index(documents).withColumn("digest", F.col("sha"))
        if not self.runs:
            return own.drop("digest")
        heads = own.groupBy("digest", "sha").agg(F.min("keep_id").alias("mine"))
        hits = None
        for run in self.runs:
            one = lookup(heads, run, repeated=False).where("keep_run IS NOT NULL").select("digest", "sha", "mine", F.col("keep_id").alias("theirs"), F.col("group_size").alias("more"))
            hits = one if hits is None else hits.unionByName(one)
        hits = staged(hits, "hits")
        texts = lambda docs, name, key: IdFilter.build(hits, key).thin(docs.select(F.col("doc_id").cast("long").alias(key), normalised().alias(name)), key).distinct()
        earlier = None
        for d in self.documents:
            earlier = d.select("doc_id", "text") if earlier is None else earlier.unionByName(d.select("doc_id", "text"))
        # the texts themselves decide, so a digest that two texts share links nothing
        met = hits.join(texts(documents, "text", "mine").withColumn("own", F.unhex(F.sha2(F.col("text").cast("binary"), 256))), "mine").where("own = sha").drop("own")
        same = met.join(texts(earlier, "other", "theirs"), "theirs").where("text = other")
        known = same.groupBy("sha").agg(F.min("theirs").alias("theirs"), F.sum("more").alias("more"))
        joined = own.join(known, "sha", "left")
        keep = F.least("keep_id", "theirs")
        kept = F.col("kept") & (F.col("theirs").isNull() | (F.col("keep_id") < F.col("theirs")))
        return joined.select("doc_id", keep.alias("keep_id"), (F.col("group_size") + F.coalesce("more", F.lit(0))).alias("group_size"), kept.alias("kept"), "sha")


def index(documents: DataFrame, digest_bits: int = 256) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept and sha, the SHA-256 of its normalised text."""
    return settled(lambda: _index(documents, digest_bits), "index")


def _index(documents: DataFrame, digest_bits: int) -> DataFrame:
    runs = build_runs(documents, digest_bits)
    merged = compact(runs)
    collided = _collisions(documents, runs, merged)
    # pieces of a hot entry have their own rows; the first has the smallest id
    own = lookup(runs.select("digest", "run", "variant", "sha", "least", "n", "ids"), merged)
    alone = F.col("keep_run").isNull()
    stays = alone | ((F.col("keep_run") == F.col("run")) & (F.col("keep_variant") == F.col("variant")))
    size = runs.where("n > 0").select("run", F.col("digest").alias("__digest"), "variant", F.col("n").alias("all"))
    pieces = own.where(F.size("ids") >= ENTRY_IDS).isEmpty()
    sized = own.withColumn("all", F.col("n")) if pieces else own.join(size.withColumnRenamed("run", "__run").withColumnRenamed("variant", "__variant"), (F.col("run") == F.col("__run")) & (F.col("variant") == F.col("__variant")) & (F.col("digest") == F.col("__digest")))
    rows = sized.select("digest", "sha", F.posexplode("ids").alias("at", "doc_id"), F.when(alone, F.col("least")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(alone, F.col("all")).otherwise(F.col("group_size")).alias("group_size"), (stays & (F.col("n") > 0)).alias("first"))
    rows = rows.select("digest", "doc_id", "keep_id", "group_size", (F.col("first") & (F.col("at") == 0)).alias("kept"), "sha")
    return rows.drop("digest") if collided is None else _by_text(rows, runs, collided, documents)


def _collisions(documents: DataFrame, runs: DataFrame, merged: Run) -> DataFrame | None:
    """Digests under which different texts were found, or None."""
    heads = lookup(runs.where("n > 0").select("digest", "variant", "sha", "least"), merged).where("keep_run IS NOT NULL")
    hits = staged(heads.select("digest", F.hex("sha").alias("hex"), "least", "keep_id"), "hits")
    ids = hits.select(F.explode(F.array("least", "keep_id")).alias("doc_id")).where("doc_id IS NOT NULL")
    thinned = IdFilter.build(ids, "doc_id").thin(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    texts = thinned.select("doc_id", normalised().alias("text"), F.upper(F.sha2(normalised().cast("binary"), 256)).alias("hex"))
    left = texts.select(F.col("doc_id").alias("least"), "hex", "text").groupBy("least", "hex").agg(F.min("text").alias("text"))
    own = hits.where("least > keep_id").select("digest", "hex", "least", "keep_id").join(left, ["least", "hex"]).select("digest", "keep_id", "text")
    kept = texts.select(F.col("doc_id").alias("keep_id"), F.col("text").alias("kept_text"))
    differing = own.join(kept, "keep_id").groupBy("digest", "keep_id", "text").agg(F.max(F.col("text") == F.col("kept_text")).alias("same")).where("NOT same").select("digest")
    twice = hits.groupBy("digest").agg(F.min("hex").alias("a"), F.max("hex").alias("b")).where("a < b").select("digest")
    found = staged(differing.union(twice).distinct(), "collisions")
    drop_staged(hits)
    return None if found.isEmpty() else found


def _by_text(clean: DataFrame, runs: DataFrame, collided: DataFrame, documents: DataFrame) -> DataFrame:
    """The index where some digests collided: rows under those are grouped by their texts."""
    shas = runs.join(collided, "digest", "left_semi").select("sha").distinct()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("text")).withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).join(shas, "sha", "left_semi")
    groups = rows.groupBy("sha", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    equal = rows.groupBy("sha", "text", "doc_id").agg(F.count("*").alias("k")).join(groups, ["sha", "text"])
    each = equal.select(F.posexplode(F.array_repeat("doc_id", F.col("k").cast("int"))).alias("at", "doc_id"), "keep_id", "group_size", "sha")
    found = each.select("doc_id", "keep_id", "group_size", ((F.col("at") == 0) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "sha")
    return clean.join(collided, "digest", "left_anti").drop("digest").unionByName(found)


def dedup(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``documents`` (doc_id, text)."""
    return index(documents).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def survivors(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each group of equal texts, all columns as they were."""
    rows = index(documents)
    dropped = rows.where("NOT doc_id <=> keep_id").select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha")).distinct()
    # copies that share the id of the one that stays cannot be told from it by id
    again = rows.where("doc_id <=> keep_id AND NOT kept").select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha")).distinct()
    names = [f"c{k}" for k in range(len(documents.columns))]
    by = lambda name: F.col(names[[c.lower() for c in documents.columns].index(name)])
    text = F.regexp_replace(F.coalesce(by("text"), F.lit("")), SPACE, " ")
    keyed = documents.toDF(*names)
    same = by("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.unhex(F.sha2(text.cast("binary"), 256)) == F.col("__sha"))
    left = keyed.join(dropped, same, "left_anti")
    if not again.isEmpty():
        repeated = left.join(again, same).groupBy("__id", "__sha").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row")).select("row.*")
        left = left.join(again, same, "left_anti").unionByName(repeated)
    return left.toDF(*documents.columns)
