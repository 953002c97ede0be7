"""Quality rules: cross-document line frequency, beside per-text word statistics.

Lines are normalised (A-Z lower-cased, white space between words collapsed) and hashed. A
line is boilerplate of a host when more of the host's distinct documents hold it than the
limit allows; boilerplate lines are removed, and documents left with too little go.

What is one document is decided by what it has of its own. Texts with the same set of lines are
one. Of lines that would be boilerplate if every other text counted (candidates), a text may hold
some; if the pairs of neighbouring words in its other lines are mostly those of candidates, these
lines are edits of shared ones and the text is a copy, else it is a document of its own. Copies
count once for each candidate that is the rarest of theirs (of equals the first in the text), so
light copies of a text are a few documents at most, however many they are, and copies of thirty
texts are thirty; texts with lines of their own count each, however much they share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolarium.llm.sorted_keys import SortedKeys, sorted_keys
from symbolarium.llm.textarrays import Lines, Words, chunks, line_hashes, mix64, words
from symbolarium.llm.workspace import in_batches, mapped_files, spare_name, stored

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LineLimits:
    """A line is boilerplate above ``least`` documents of its host and above ``share_percent``
    of them, or above ``enough`` documents whatever the host's size; a document is depleted
    when boilerplate is over ``depleted_percent`` of its words."""

    least: int = 20
    share_percent: int = 2
    depleted_percent: int = 70
    enough: int = 1000


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    run = np.r_[0, np.cumsum(flags)]
    return run[at[1:]] - run[at[:-1]]


def _in(scope: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Names of ``hashes`` within a scope each, such as a host or a text."""
    return mix64(hashes + mix64(scope.astype(np.uint64) + np.uint64(1)) * _STEP)


def _once(lines: Lines) -> np.ndarray:
    """The first place of every line of every text."""
    return np.sort(np.unique(_in(lines.owner, lines.words), return_index=True)[1])


def _line_sets(lines: Lines, once: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit name of each text's set of lines, whatever their order and repetition."""
    run = np.zeros(len(once) + 1, np.uint64)
    np.cumsum(mix64(lines.words[once]), out=run[1:])
    at = np.searchsorted(lines.owner[once], np.arange(n + 1))
    return mix64(run[at[1:]] - run[at[:-1]] + np.diff(at).astype(np.uint64))


def _pairs(w: Words, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbouring words within a line, and the line of each; a line of one word has that
    word alone. Lines hold all words of the batch, in order."""
    line = np.repeat(np.arange(len(lines.size)), lines.size)
    h = w.hashes
    two = np.flatnonzero(line[:-1] == line[1:])
    alone = np.cumsum(lines.size)[lines.size == 1] - 1
    hashes = np.r_[mix64(h[two] * np.uint64(3) + mix64(h[two + 1] * np.uint64(5))), mix64(h[alone] * np.uint64(7) + np.uint64(1))]
    return hashes, np.r_[line[two], line[alone]]


def _hosts(chunk: pa.RecordBatch, owner: np.ndarray) -> np.ndarray:
    return chunk.column("host").to_numpy(zero_copy_only=False)[owner]


def _named(docs: DataFrame, *more: Column) -> DataFrame:
    return in_batches(docs).select(*more, F.col("text").cast("string").alias("text"), F.coalesce(F.xxhash64("host"), F.lit(0)).alias("host"))


def _candidates(rows: DataFrame, limits: LineLimits) -> DataFrame:
    """``(host, line, held)``: what more texts hold than the limits allow, equal line sets counted once."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            lines = line_hashes(words(chunk.column("text"), lower=True))
            once = _once(lines)
            owner = lines.owner[once]
            sets = _line_sets(lines, once, chunk.num_rows)
            some = np.unique(owner)  # a row for the text itself, as line 0
            columns = np.r_[_hosts(chunk, some), _hosts(chunk, owner)], np.r_[sets[some], sets[owner]], np.r_[np.zeros(len(some), np.uint64), lines.words[once]]
            yield pa.record_batch([pa.array(c.view(np.int64)) for c in columns], ["host", "document", "line"])

    return _above(rows.mapInArrow(gather, "host long, document long, line long"), limits)


def _above(holding: DataFrame, limits: LineLimits) -> DataFrame:
    """Lines of ``holding(host, document, line)`` above the limits; line 0 marks a document alone."""
    held = stored(holding.distinct().groupBy("host", "line").agg(F.count("*").alias("held")).where((F.col("held") > limits.least) | (F.col("line") == 0)), "held-lines")
    sizes = held.where("line = 0").select("host", F.col("held").alias("documents"))
    enough = (F.col("held") * 100 > limits.share_percent * F.col("documents")) | (F.col("held") > limits.enough)
    return held.where((F.col("line") != 0) & (F.col("held") > limits.least)).join(sizes, "host").where(enough).select("host", "line", "held")


def _keys(table: DataFrame) -> SortedKeys:
    """``table(host, line, number)`` by the name of the line within its host."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            host, line = (b.column(c).to_numpy(zero_copy_only=False) for c in ("host", "line"))
            yield pa.record_batch([pa.array(_in(host, line.view(np.uint64)).view(np.int64)), b.column("number")], ["key", "number"])

    return sorted_keys(table.mapInArrow(name, "key long, number long"))


def _known_pairs(rows: DataFrame, candidates: SortedKeys) -> SortedKeys:
    """The word pairs of every host's candidate lines."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with mapped_files(candidates.paths) as local:
            for chunk in chunks(batches):
                w = words(chunk.column("text"), lower=True)
                lines = line_hashes(w)
                host = _hosts(chunk, lines.owner)
                held = candidates.lookup(local, _in(host, lines.words).view(np.int64)) > 0
                pairs, line = _pairs(w, lines)
                mine = held[line]
                yield pa.record_batch([pa.array(np.unique(_in(host[line[mine]], pairs[mine]).view(np.int64)))], ["key"])

    return sorted_keys(rows.mapInArrow(gather, "key long").distinct().withColumn("number", F.lit(1).cast("long")))


def _documents(rows: DataFrame, candidates: SortedKeys, pairs: SortedKeys) -> DataFrame:
    """``(host, document, line)`` for the candidates that a text holds, and line 0 for itself; what
    counts as one document has one name."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with mapped_files(candidates.paths) as local, mapped_files(pairs.paths) as near:
            for chunk in chunks(batches):
                n = chunk.num_rows
                w = words(chunk.column("text"), lower=True)
                lines = line_hashes(w)
                once = _once(lines)
                owner, hashes = lines.owner[once], lines.words[once]
                host = _hosts(chunk, owner)
                held = candidates.lookup(local, _in(host, hashes).view(np.int64))
                shares = np.bincount(owner[held > 0], minlength=n) > 0
                # Word pairs of the other lines of texts that hold a candidate, and how many are known.
                other = np.zeros(len(lines.size), bool)
                other[once] = (held == 0) & shares[owner]
                made, line = _pairs(w, lines)
                made, line = made[other[line]], line[other[line]]
                text = lines.owner[line]
                known = pairs.lookup(near, _in(_hosts(chunk, text), made).view(np.int64)) > 0
                total, met = np.bincount(text, minlength=n), np.bincount(text[known], minlength=n)
                own = ~shares | (2 * met < total)
                # A copy goes by its rarest candidate, of equals the first.
                names = _line_sets(lines, once, n)
                common = np.flatnonzero(held > 0)
                order = common[np.lexsort((lines.place[once][common], held[common], owner[common]))]
                first = order[np.r_[True, owner[order][1:] != owner[order][:-1]]] if len(order) else order
                copies = first[~own[owner[first]]]
                names[owner[copies]] = mix64(hashes[copies] ^ _STEP)
                some = np.unique(owner)
                columns = np.r_[_hosts(chunk, some), host[common]], np.r_[names[some], names[owner[common]]], np.r_[np.zeros(len(some), np.uint64), hashes[common]]
                yield pa.record_batch([pa.array(c.view(np.int64)) for c in columns], ["host", "document", "line"])

    return rows.mapInArrow(gather, "host long, document long, line long")


def boilerplate_lines(docs: DataFrame, limits: LineLimits = LineLimits()) -> SortedKeys:
    """The boilerplate of ``docs(text, host)``, by the names of lines within their hosts."""
    rows = _named(docs)
    candidates = _keys(_candidates(rows, limits).withColumnRenamed("held", "number"))
    counted = _above(_documents(rows, candidates, _known_pairs(rows, candidates)), limits)
    return _keys(counted.select("host", "line", F.lit(1).cast("long").alias("number")))


def _judged(chunk: pa.RecordBatch, frequent: SortedKeys, local: list[str]) -> tuple[dict[str, np.ndarray], Lines, np.ndarray]:
    """Statistics of each text with ``taken``, the words in its boilerplate lines; its lines, and
    which of them are boilerplate."""
    texts = chunk.column("text")
    w = words(texts)
    n, m = chunk.num_rows, len(w.hashes)
    owner = np.repeat(np.arange(n), np.diff(w.first))
    # Words in 3-word windows that the text holds twice or more.
    repeat = np.zeros(m, bool)
    if m > 2:
        win = mix64(w.hashes[:-2] * np.uint64(3) + mix64(w.hashes[1:-1] * np.uint64(5) + mix64(w.hashes[2:])))
        win = mix64(win + owner[:-2].astype(np.uint64) * _STEP)
        inside = owner[:-2] == owner[2:]
        order = np.argsort(win)
        order = order[inside[order]]
        same = win[order][1:] == win[order][:-1]
        twice = order[np.r_[same, False] | np.r_[False, same]]
        for k in range(3):
            repeat[twice + k] = True
    visible = np.r_[0, np.cumsum((w.data & 0xC0) != 0x80)]
    raw, norm = line_hashes(w), line_hashes(words(texts, lower=True))
    _, once = np.unique(_in(raw.owner, raw.exact), return_index=True)
    flagged = frequent.lookup(local, _in(_hosts(chunk, norm.owner), norm.words).view(np.int64)) > 0
    return {
        "n_words": np.diff(w.first), "word_chars": np.bincount(owner, weights=visible[w.ends] - visible[w.starts], minlength=n),
        "n_symbols": _per_text(_SYMBOL[w.data], w.bounds), "n_dup_lines": np.bincount(raw.owner, minlength=n) - np.bincount(raw.owner[once], minlength=n),
        "n_repeat_words": _per_text(repeat, w.first), "taken": np.bincount(norm.owner[flagged], weights=norm.size[flagged], minlength=n),
    }, norm, flagged


_STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "taken"]


def base_rules() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_verdicts(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """``docs(doc_id, text, host, ...)`` to a row per document: word statistics,
    ``base_failed``, ``kept`` and ``n_removed_words``.

    Null or wordless text: zeros, base_failed. A null host is a host of its own. Repeated
    rows are judged each; for line counts they and light copies are one document. Other columns are ignored;
    an empty table gives an empty result.
    """
    frequent = boilerplate_lines(docs, limits)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with mapped_files(frequent.paths) as local:
            for chunk in chunks(batches):
                stats, _, _ = _judged(chunk, frequent, local)
                yield pa.record_batch([chunk.column("doc_id"), *(pa.array(stats[c].astype(np.int64)) for c in _STATISTICS)], ["doc_id", *_STATISTICS])

    judged = _named(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(judge, "doc_id long, " + ", ".join(f"{c} long" for c in _STATISTICS)).withColumn("base_failed", base_rules())
    kept = ~F.col("base_failed") & (100 * F.col("taken") <= limits.depleted_percent * F.col("n_words"))
    return judged.select("doc_id", *_STATISTICS[:5], "base_failed", kept.alias("kept"), F.col("taken").alias("n_removed_words"))


def without_boilerplate(docs: DataFrame, host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """The documents that the rules keep, all columns, their boilerplate lines taken out of
    ``text`` and ``n_chars`` (if there) counted anew. Texts without such lines stay as they are.
    Null or wordless texts go; a null host is a host of its own, a null doc_id a value like others;
    repeated rows stay or go together; an empty table gives an empty result."""
    frequent = boilerplate_lines(docs.select("text", F.col(host).alias("host")), limits)
    mark, names = spare_name(docs, "_host"), docs.columns

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with mapped_files(frequent.paths) as local:
            for chunk in chunks(batches):
                seen = pa.record_batch([chunk.column("text"), chunk.column(mark)], ["text", "host"])
                stats, lines, flagged = _judged(seen, frequent, local)
                failed = (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])
                keep = ~failed & (100 * stats["taken"] <= limits.depleted_percent * stats["n_words"])
                texts = chunk.column("text").to_pylist()
                counts = chunk.column("n_chars").to_pylist() if "n_chars" in names else None
                at = np.flatnonzero(flagged)
                some, starts = np.unique(lines.owner[at], return_index=True)
                for k, places in zip(some.tolist(), np.split(lines.place[at], starts[1:]), strict=True) if len(some) else ():
                    gone = set(places.tolist())
                    texts[k] = "\n".join(p for j, p in enumerate(texts[k].split("\n")) if j not in gone)
                    if counts:
                        counts[k] = len(texts[k])
                new = {"text": pa.array(texts, pa.string())} | ({"n_chars": pa.array(counts, chunk.column("n_chars").type)} if counts else {})
                yield pa.record_batch([new.get(c, chunk.column(c)) for c in names], names).filter(pa.array(keep))

    rows = docs.withColumn(mark, F.coalesce(F.xxhash64(host), F.lit(0)))
    return rows.mapInArrow(take_out, docs.schema)
