r"""Operator 13: spelling variants, found with forward and backward minimal acyclic automata.

1. *count*: runs ``[A-Za-zÀ-ÿ]+`` of whole texts, with A-Z lower-cased, are counted. A block of texts has a
   dictionary of its runs, and the CRC-32 of each is taken once; the checksum of ``<doc_id>:<run>`` follows from it and
   that of ``<doc_id>:``, as checksums are linear. Where DAMAGE divides it, a code point is deleted. Words are the results
   of LEAST_LENGTH code points and LEAST_COUNT occurrences, or more.
2. *near words*: two words differ by one insertion, deletion or replacement only if one half of the first is there
   exactly in the second: its first half as the beginning, or its second half as the end. So words are dealt to shards
   by these halves. A shard builds the minimal automaton of its words (of their reversals, for second halves); its states
   know how many words lie behind them, so a path gives a word's number without its letters. A word's half is matched
   exactly, the rest is completed with one error, and numbers lead to counts. A near word that both directions find
   counts in the forward one.
3. *forms*: a word's form is its near word of the largest count, if that is RATIO times its own; roots come from
   doubling the steps from word to form, in joins.

Halves that more than GROUP words share are split: of such words, the part that may hold the error is halved again, so
they meet by a longer beginning or by a beginning and an end. When that part is down to one letter, no more than some
10,000 words can share all others, so every group is bounded, and no pair is listed.

Null texts have no runs, a null doc_id counts as empty. Each row counts, repeated ones too. Ties of near words go to the
smallest in code-point order. Long texts are read in one block of their own; a run may be of any length. An empty table
gives an empty result. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.common import drop_staged, settled, ship, staged, tidied_table, tidy
from curata.llm.kernels import blocks, column_bytes, crc_sql, values

DAMAGE, LEAST_LENGTH, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Bytes of text in a block; words that share halves, and words of a shard, about.
BLOCK_BYTES, GROUP, SHARD_WORDS = 16 << 20, 20_000, 20_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _behind(n: int) -> np.ndarray:
    """Tables (4, 256) by which a checksum's bytes tell that of its text followed by ``n`` others, but for theirs."""
    one = np.array([zlib.crc32(bytes(n), 1 << b) ^ zlib.crc32(bytes(n)) for b in range(32)], np.uint32)
    value = np.arange(256, dtype=np.uint32)
    out = np.zeros((4, 256), np.uint32)
    for b in range(32):
        out[b // 8] ^= np.where(value >> np.uint32(b % 8) & 1, one[b], np.uint32(0)).astype(np.uint32)
    return out


def joined_crc(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of texts put together, from those of both parts and the bytes of the second."""
    out = np.empty(len(first), np.uint32)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        c, table = first[at], _behind(n)
        out[at] = table[0][c & 255] ^ table[1][c >> np.uint32(8) & np.uint32(255)] ^ table[2][c >> np.uint32(16) & np.uint32(255)] ^ table[3][c >> np.uint32(24)] ^ second[at]
    return out


def _runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All runs of the texts, lower-cased, and the text each belongs to."""
    ink = _LETTER[raw]
    ink[1:] |= raw[:-1] == 0xC3  # U+00C0 to U+00FF are C3 80 to C3 BF
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    first[edges] = ink[edges]
    last[edges[edges > 0] - 1] = ink[edges[edges > 0] - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    data = _LOWER[raw[ink]]
    runs = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(0, np.cumsum(lengths))), pa.py_buffer(data))
    return runs, np.searchsorted(offsets, starts, "right") - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, BLOCK_BYTES):
        raw, offsets = column_bytes(batch.column(1))
        runs, row = _runs(raw, offsets)
        coded = runs.dictionary_encode()
        run, data = coded.indices.to_numpy(), values(coded.dictionary)
        words = [w.decode() for w in data]
        ids = [b":" if i is None else f"{i}:".encode() for i in batch.column(0).to_pylist()]
        size = np.fromiter(map(len, data), np.int64, len(data))
        start = np.fromiter(map(zlib.crc32, ids), np.uint32, len(ids))
        own = np.fromiter(map(zlib.crc32, data), np.uint32, len(data))
        h = joined_crc(start[row], own[run], size[run])
        damaged = h % np.uint32(DAMAGE) == 0
        n = np.bincount(run[~damaged], minlength=len(words))
        out: dict[str, int] = {words[k]: int(n[k]) for k in np.flatnonzero((n > 0) & (size >= LEAST_LENGTH)).tolist() if len(words[k]) >= LEAST_LENGTH}
        for k, c in zip(run[damaged].tolist(), h[damaged].tolist()):
            at = c % len(words[k])
            if len(word := words[k][:at] + words[k][at + 1 :]) >= LEAST_LENGTH:
                out[word] = out.get(word, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(out.values(), pa.int64())], ["word", "n"])


def counts(documents: DataFrame) -> DataFrame:
    """Rows (word, n) of the words with at least LEAST_COUNT occurrences."""
    ship(documents.sparkSession)
    found = documents.select("doc_id", "text").mapInArrow(tidy(_counted), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words, whose paths give words' numbers.

    A state is a dictionary from a letter to (next state, number of words that precede those behind it), and is
    registered by its arcs when no later word can change it, so that equal ends of words share their states.
    """

    END = ""  # the arc of a word that ends here; it precedes all letters

    def __init__(self, words: list[str]):
        self.register: dict[tuple, tuple[dict, int]] = {}
        self.path: list[tuple[str, list]] = []  # letters of the last word, and the arcs of the state each leads from
        arcs: list = []  # of the state behind the last letter
        before = ""
        for word in words:
            same = 0
            while same < min(len(word), len(before)) and word[same] == before[same]:
                same += 1
            while len(self.path) > same:
                arcs = self._done(arcs)
            for letter in word[same:]:
                self.path.append((letter, arcs))
                arcs = []
            arcs.append((self.END, None, 1))
            before = word
        while self.path:
            arcs = self._done(arcs)
        self.start = self._state(arcs)[0]

    def _done(self, arcs: list) -> list:
        letter, parent = self.path.pop()
        state, number = self._state(arcs)
        parent.append((letter, state, number))
        return parent

    def _state(self, arcs: list) -> tuple[dict, int]:
        key = tuple((letter, id(state)) for letter, state, _ in arcs)
        if key not in self.register:
            state, total = {}, 0
            for letter, after, number in arcs:
                state[letter] = (after, total)
                total += number
            self.register[key] = state, total
        return self.register[key]

    def walk(self, letters: str, state: dict, number: int) -> tuple[dict, int] | None:
        for letter in letters:
            arc = state.get(letter)
            if arc is None:
                return None
            state, number = arc[0], number + arc[1]
        return state, number

    def one_error(self, half: str, rest: str) -> set[int]:
        """Numbers of words that begin with ``half`` and go on as ``rest`` with one insertion, deletion or replacement."""
        found: set[int] = set()
        end = self.END
        here = self.walk(half, self.start, 0)
        for i in range(len(rest) + 1):
            if here is None:
                break
            state, number = here
            letter, behind, after = rest[i : i + 1], rest[i:], rest[i + 1 :]
            for other, (target, skipped) in state.items():
                if other == end:
                    continue
                # the word has a letter more, or another one
                for tail in (behind,) if other == letter or not letter else (behind, after):
                    if (last := self.walk(tail, target, number + skipped)) is not None and end in last[0]:
                        found.add(last[1])
            if not letter:
                break
            if (last := self.walk(after, state, number)) is not None and end in last[0]:  # the word lacks it
                found.add(last[1])
            here = self.walk(letter, state, number)
        return found


def _near(rows: pa.Table) -> pa.Table:
    """Of each asking row, its near words in the shard: how many, the largest count and the smallest word that has it."""
    counts = dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist()))
    out: list[tuple] = []
    for forward in (True, False):
        way = slice(None) if forward else slice(None, None, -1)
        side = rows.filter(pa.array([p.endswith("F") == forward for p in rows.column("path").to_pylist()], pa.bool_()))
        words = sorted({w[way] for w in side.column("word").to_pylist()})
        automaton = Automaton(words)
        for row in side.filter(side.column("asks")).select(["word", "path", "low", "high"]).to_pylist():
            word, low, high = row["word"], row["low"], row["high"]
            half, rest = (word[:low], word[low:]) if forward else (word[high:][::-1], word[:high][::-1])
            mids = _passed(len(word), row["path"])
            best, near = (0, ""), 0
            for k in automaton.one_error(half, rest):
                other = words[k][way]
                if other.startswith(word[:low]) and other.endswith(word[high:]) and not any(other.startswith(word[:m]) for m in mids):
                    near += 1
                    if (c := counts[other]) > best[0] or c == best[0] and other < best[1]:
                        best = c, other
            if near:
                out.append((word, near, *best))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, kinds)], ["word", "near", "most", "form"])


def _passed(length: int, path: str) -> list[int]:
    """Beginnings that a near word found by ``path`` does not share: a forward step would have found it with these."""
    low, high, out = 0, length, []
    for step in path:
        middle = (low + high) // 2
        if step == "F":
            low = middle
        else:
            high = middle
            out.append(middle)
    return out


def _halved(rows: DataFrame) -> DataFrame:
    """Both ways of halving the part [low, high) that may hold the error; what is before and behind it must match."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    way: Column = F.explode(F.array(F.struct(F.concat("path", F.lit("F")).alias("path"), middle.alias("low"), F.col("high").alias("high")), F.struct(F.concat("path", F.lit("B")).alias("path"), F.col("low").alias("low"), middle.alias("high"))))
    split = rows.select("word", "n", "asked", way.alias("way")).select("word", "n", "asked", "way.*")
    return split.where(F.col("low") + F.col("asked") - F.col("high") <= F.length("word"))


def _grouped(rows: DataFrame) -> DataFrame:
    end = F.col("asked") - F.col("high")
    ends = F.when(end > 0, F.expr("right(word, asked - high)")).otherwise("")
    return rows.withColumn("group", F.xxhash64("asked", "path", F.expr("substring(word, 1, low)"), ends))


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """Rows (word, n_near, form, form_n) of the words (word, n) that have near ones; form is the most frequent of these."""
    # a word is asked for by words of its own length and of one letter more or less
    asked = F.explode(F.array(*(F.length("word") + d for d in (-1, 0, 1)))).alias("asked")
    rows = words.select("word", "n", asked).where(F.col("asked") >= LEAST_LENGTH).select("word", "n", "asked", F.lit("").alias("path"), F.lit(0).alias("low"), F.col("asked").alias("high"))
    rows, ready, made = _grouped(_halved(rows)), None, []
    while True:
        # groups of one hash count as one, which splits them early and does no harm
        large = staged(rows.groupBy("group", "asked", "path").agg(F.count("*").alias("size"), F.first(F.col("high") - F.col("low")).alias("part")).where((F.col("size") > group) & (F.col("part") > 1)).select("group", "asked", "path"), "large")
        made.append(large)
        if large.isEmpty():
            ready = rows if ready is None else ready.unionByName(rows)
            break
        keys = ["group", "asked", "path"]
        small = rows.join(large, keys, "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        rows = _grouped(_halved(rows.join(large, keys, "left_semi")))
    shards = 1 + words.count() * 6 // SHARD_WORDS
    shard = F.pmod(F.col("group"), F.lit(shards).cast("long"))
    dealt = ready.select(shard.alias("shard"), "word", "n", "path", "low", "high", (F.length("word") == F.col("asked")).alias("asks"))
    found = dealt.groupBy("shard").applyInArrow(tidied_table(_near), "word string, near long, most long, form string")
    out = staged(found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("most")).alias("least"), F.col("form").alias("form"))).alias("best")).select("word", "n_near", "best.form", (-F.col("best.least")).alias("form_n")), "near")
    drop_staged(*made)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) from rows (word, form): where the steps from word to form end. Counts grow, so they do end."""
    steps = staged(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = staged(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        drop_staged(steps)
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        steps = after


def variants(documents: DataFrame, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``documents`` (doc_id, text)."""
    return settled(lambda: _variants(documents, group), "variants")


def _variants(documents: DataFrame, group: int) -> DataFrame:
    words = staged(counts(documents), "words")
    near = near_words(words, group)
    joined = words.join(near, "word", "left")
    is_form = F.col("form_n") >= RATIO * F.col("n")
    table = joined.select("word", F.when(is_form, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("form_n")).alias("form_n"))
    found = roots(table.where("form is not null"))
    return table.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB SQL of variants() over ``documents``.
SQL = rf"""
    WITH RECURSIVE v AS MATERIALIZED (
        SELECT doc_id || ':' || w AS k, w, count(*) AS n FROM (
            SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents
        ) x GROUP BY ALL
    ), {crc_sql('v')}, o AS (
        SELECT CASE WHEN crc % 199 = 0 THEN substr(w, 1, (crc % length(w))::INT) || substr(w, (crc % length(w))::INT + 2) ELSE w END AS word, n FROM v JOIN crc USING (k)
    ), d AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM o WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    x AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM d) y),
    m AS (
        SELECT a.word, b.word AS near FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
        UNION SELECT x.word, x.rest FROM x JOIN d ON d.word = x.rest
        UNION SELECT x.rest, x.word FROM x JOIN d ON d.word = x.rest
    ), q AS (
        SELECT m.word, count(*) AS n_near, max(d.n) AS most, arg_min(m.near, (-d.n, m.near)) AS best FROM m JOIN d ON d.word = m.near GROUP BY m.word
    ), e AS (
        SELECT d.word, CASE WHEN most >= 5 * d.n THEN best END AS form, d.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * d.n THEN most END AS form_n FROM d LEFT JOIN q ON q.word = d.word
    ), s AS (SELECT word, form AS root FROM e WHERE form IS NOT NULL UNION ALL SELECT s.word, e.form FROM s JOIN e ON e.word = s.root WHERE e.form IS NOT NULL),
    r AS (SELECT s.word, s.root FROM s JOIN e ON e.word = s.root WHERE e.form IS NULL)
    SELECT e.word, e.form, coalesce(r.root, e.word) AS root, e.n, e.n_near, e.form_n FROM e LEFT JOIN r ON r.word = e.word
"""
