"""Removal of passages that an earlier document has too, by windows whose length doubles level by level."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import bucketed, cut, flat, hot_keys, lean, spread_join
from lumenframe.llm.wordhash import blocks, lowest, ranges, spans, windows, word_hashes


#: Words in the windows of the first level; each level's are twice as long, less one where the last length asks for it.
SHORTEST = 7


def levels(length: int) -> list[int]:
    """The window lengths from the shortest to `length`: half of each, rounded up, is the one before."""
    out = [length]
    while out[0] > SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


class _Texts:
    """The full windows of some texts, and at a level what stands for them.

    At a level of shorter windows, low[i] is the smallest hash of those that lie in the full window at i: two equal full
    windows have equal ones, so it stands for the full window. Neighbours share it: runs are the stretches of full
    windows of one text with the same one, and a run's span is all words that its windows cover.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int) -> None:
        self.starts, self.ends, self.by = spans(data, offsets)
        self.hashes, _ = word_hashes(data, offsets)
        self.length = length
        counts = np.maximum(0, np.diff(self.by) - length + 1)
        self.text = np.repeat(np.arange(len(counts)), counts)  # of each full window
        self.at = ranges(self.by[:-1], counts)  # its first word

    def low(self, level: int) -> np.ndarray:
        """What stands for each full window at a level."""
        if len(self.hashes) < self.length:
            return np.zeros(0, dtype=np.int64)
        return lowest(windows(self.hashes, level), self.length - level + 1)[self.at].view(np.int64)

    def full(self, salt: int = 0) -> np.ndarray:
        """The hash of each full window."""
        return windows(self.hashes, self.length, salt)[self.at]

    def among(self, low: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which full windows have a low among their text's values. Neighbours with the same one are looked up once."""
        if not len(low) or at[-1] == at[0]:
            return np.zeros(len(low), dtype=bool)
        new = np.ones(len(low), dtype=bool)
        new[1:] = (low[1:] != low[:-1]) | (self.text[1:] != self.text[:-1])
        run = np.flatnonzero(new)
        return _among(low[run], self.text[run], values, at)[np.cumsum(new) - 1]


def _anchors(parts: Iterator[pa.RecordBatch], length: int, level: int, before: int | None) -> Iterator[pa.RecordBatch]:
    """The runs of a level. After the first level only full windows count whose low of the level before is open."""
    for part in parts:
        keys, marks = np.asarray(part.column("doc")), np.asarray(part.column("mark"))
        values, at = flat(part.column("open")) if before else (None, None)
        for rows, data, offsets in blocks(part.column("text")):
            t = _Texts(data, offsets, length)
            low, some = t.low(level), np.arange(len(t.at))
            if before:
                some = np.flatnonzero(t.among(t.low(before), values, at[rows.start : rows.stop + 1]))
            if not len(some):
                continue
            low, text = low[some], t.text[some]
            new = np.ones(len(some), dtype=bool)
            new[1:] = (low[1:] != low[:-1]) | (some[1:] != some[:-1] + 1) | (text[1:] != text[:-1])
            run = np.flatnonzero(new)
            sizes = np.diff(np.append(run, len(some)))
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(t.full()[some], dtype=np.uint64)])
            with np.errstate(over="ignore"):  # the sum of a run's full windows, with their count, tells its span
                span = (sums[run + sizes] - sums[run] + sizes.astype(np.uint64)).view(np.int64)
            who = text[run]
            yield pa.RecordBatch.from_arrays([pa.array(low[run]), pa.array(span), pa.array(keys[rows][who]), pa.array(marks[rows][who])], names=["low", "span", "doc", "mark"])


def _extended(parts: Iterator[pa.RecordBatch], length: int, before: int) -> Iterator[pa.RecordBatch]:
    """The full windows, by two hashes, whose low of the level before is among the row's open ones; each once a text."""
    for part in parts:
        keys, marks = np.asarray(part.column("doc")), np.asarray(part.column("mark"))
        values, at = flat(part.column("open"))
        for rows, data, offsets in blocks(part.column("text")):
            t = _Texts(data, offsets, length)
            some = np.flatnonzero(t.among(t.low(before), values, at[rows.start : rows.stop + 1]))
            if len(some):
                one, two, who = t.full()[some].view(np.int64), t.full(1)[some].view(np.int64), t.text[some]
                order = np.lexsort((two, one, who))
                one, two, who = one[order], two[order], who[order]
                new = np.ones(len(who), dtype=bool)
                new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (who[1:] != who[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(one[new]), pa.array(two[new]), pa.array(keys[rows][who[new]]), pa.array(marks[rows][who[new]])], names=["one", "two", "doc", "mark"])


def _among(x: np.ndarray, text: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each x is among its own text's values."""
    hit = np.zeros(len(x), dtype=bool)
    bounds = np.searchsorted(text, np.arange(len(at)))
    for k in np.flatnonzero(np.diff(at)):
        a, b = bounds[k], bounds[k + 1]
        if b > a:
            hit[a:b] = np.isin(x[a:b], values[at[k] : at[k + 1]])
    return hit


def _removed(parts: Iterator[pa.RecordBatch], length: int, with_text: bool, steps: list[int]) -> Iterator[pa.RecordBatch]:
    """Each document's counts, and the digest of what is left or the text itself.

    The levels are walked as they were compared: what one settles holds only for full windows that the one before left open.
    """
    for part in parts:
        lists = {k: (flat(part.column(f"gone{k}")), flat(part.column(f"open{k}"))) for k in steps}
        for rows, data, offsets in blocks(part.column("text")):
            t = _Texts(data, offsets, length)
            gone, left_open = np.zeros(len(t.at), dtype=bool), np.ones(len(t.at), dtype=bool)
            for k, ((shut, at), (still, to)) in lists.items():
                at, to = at[rows.start : rows.stop + 1], to[rows.start : rows.stop + 1]
                if not left_open.any() or (at[-1] == at[0] and to[-1] == to[0]):
                    break  # no text here went on to this level
                low = t.full().view(np.int64) if k == length else t.low(k)
                gone |= left_open & t.among(low, shut, at)
                left_open &= t.among(low, still, to)
            cover = np.zeros(len(t.hashes) + 1, dtype=np.int64)
            np.add.at(cover, t.at[gone], 1)
            np.add.at(cover, t.at[gone] + length, -1)
            kept = np.cumsum(cover[:-1]) == 0
            raw, starts, ends = data.tobytes(), t.starts.tolist(), t.ends.tolist()
            out, removed = [], []
            for k in range(len(offsets) - 1):
                a, b = t.by[k], t.by[k + 1]
                ok = kept[a:b]
                removed.append(int(b - a - ok.sum()))
                if with_text and not removed[-1]:
                    out.append(raw[offsets[k] : offsets[k + 1]].decode())  # untouched texts stay as they are
                else:
                    left = b" ".join([raw[starts[i] : ends[i]] for i in (np.flatnonzero(ok) + a).tolist()])
                    out.append(left.decode() if with_text else hashlib.sha256(left).hexdigest())
            s = slice(rows.start, rows.stop)
            columns = {"row": part.column("row")[s], "rest": part.column("rest")[s], "n_words": pa.array(np.diff(t.by)), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays([c.cast(pa.int64()) if k == "n_words" else c for k, c in columns.items()], names=list(columns))


def remove_repeats(docs: DataFrame, length: int = 50, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, n_words, n_removed, and kept: the text without what an earlier document has too.

    A word goes if it lies in a window of `length` words whose words, in order, also stand in a document with a smaller
    id. Windows are judged on the input. kept has the words that are left joined by a blank; a text of which nothing
    goes stays as it is. With with_text false, kept is the SHA-256 of the words that are left joined by a blank.

    Null and empty texts have no words and lose none. Rows with a null id lose nothing and make nobody lose anything.
    Rows with equal ids are no smaller than each other; a repeated row gives a repeated result. Other columns stay
    as they are with with_text, else they are left out. An empty table gives no rows. Columns named like the results are
    an error.

    A first level looks at windows of SHORTEST words or a few less, of each full window the one with the smallest hash.
    What occurs in one document alone is out. Where all documents agree on the words around such a window, the smallest
    id among them settles it. Only the others are extended to twice the length and compared again, level by level until
    none is left or the full length is reached, where 128 bits of hash decide between documents and 64 of them tell a
    document's own windows apart. A hash that many documents have is one row
    by task before it is counted and is dealt to several tasks where it is joined; lists of hashes are lists of one
    document's own. Texts are dealt to buckets by id once, so no level shuffles them again.
    """
    if clash := {"n_words", "n_removed", "kept"} & (set(docs.columns) - {text_col}):
        raise ValueError(f"the table already has {sorted(clash)}")
    others = [c for c in docs.columns if c not in (id_col, text_col)] if with_text else []
    rest = F.struct(*[F.col(c) for c in others], F.lit(0).alias("__none"))
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), rest.alias("rest")).withColumn("mark", F.xxhash64("text"))
    kind = d.schema["rest"].dataType.simpleString()
    d = bucketed(d, ["doc", "mark"])
    known = d.where("doc is not null").select("doc", "text", "mark")
    steps, before, read, settled = levels(length), None, known, []
    for k in steps[:-1]:
        anchors = cut(read.mapInArrow(lean(lambda p, k=k, before=before: _anchors(p, length, k, before)), "low long, span long, doc long, mark long"))
        facts = anchors.groupBy("low").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min("span").alias("a"), F.max("span").alias("b"), F.count("*").alias("n")).where("lo < hi").select("low", "lo", (F.col("a") == F.col("b")).alias("same"), "n")
        facts = cut(facts)
        hot = hot_keys(facts, ["low"], "n", anchors.count())
        found = spread_join(anchors, facts.drop("n"), ["low"], hot, "doc").where("not same or doc > lo")
        lists = cut(found.groupBy("doc", "mark").agg(F.collect_set(F.when(F.col("same"), F.col("low"))).alias("shut"), F.collect_set(F.when(~F.col("same"), F.col("low"))).alias("open")))
        settled.append(lists.select("doc", "mark", F.lit(k).alias("level"), F.col("shut").alias("gone"), "open"))
        open_ = lists.where("size(open) > 0").select("doc", "mark", "open")
        before = k
        if open_.isEmpty():
            break
        read = known.join(open_, ["doc", "mark"]).select("doc", "mark", "text", "open")
    else:
        if before is None:  # a length of one level: nothing is left out beforehand
            raise ValueError(f"windows must be longer than {SHORTEST} words")
        longer = cut(read.mapInArrow(lean(lambda p: _extended(p, length, before)), "one long, two long, doc long, mark long"))
        least = cut(longer.groupBy("one", "two").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("one", "two", "lo", "n"))
        hot = hot_keys(least, ["one", "two"], "n", longer.count())
        full = spread_join(longer, least.drop("n"), ["one", "two"], hot, "doc").where("doc > lo").groupBy("doc", "mark").agg(F.collect_set("one").alias("gone"))
        settled.append(full.select("doc", "mark", F.lit(length).alias("level"), "gone", F.array().cast("array<long>").alias("open")))
    lists = settled[0]
    for one in settled[1:]:
        lists = lists.unionByName(one)
    lists = cut(lists.groupBy("doc", "mark").agg(*[F.first(F.when(F.col("level") == k, F.col(c)), ignorenulls=True).alias(f"{c}{k}") for k in steps for c in ("gone", "open")]))
    none = F.array().cast("array<long>")
    each = d.join(lists, ["doc", "mark"], "left").select(F.col("doc").alias("row"), "text", "rest", *[F.coalesce(f"{c}{k}", none).alias(f"{c}{k}") for k in steps for c in ("gone", "open")])
    out = each.mapInArrow(lean(lambda p: _removed(p, length, with_text, steps)), f"row long, rest {kind}, n_words long, n_removed long, kept string")
    return out.select(F.col("row").alias(id_col), *[F.col(f"rest.{c}").alias(c) for c in others], "n_words", "n_removed", "kept")


def op9_doubling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without windows of 50 words that a document with a smaller id has too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, with_text=False).withColumnRenamed("kept", "kept_sha256")
