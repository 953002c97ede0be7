"""Personal data by pattern, and terms that give it away by what the corpus says of them.

A protected entity is a distinct e-mail address, IP address, card or phone number. A term
discloses it as far as the pointwise mutual information of the two reaches the entity's own
information content: what is left, ``log2(n(t) / n(e, t))`` bits, is how unsure one who reads
the term still is of the entity. Terms that leave at most one bit are generalised, those that
leave next to nothing are removed. ``n`` counts documents; a pair also needs several *different*
surroundings, so that copies of one passage prove nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolarium.llm.sorted_keys import SortedKeys, sorted_keys
from symbolarium.llm.textarrays import chunks, mix64, words
from symbolarium.llm.workspace import joined_by_weight, mapped_files, stored

# Kinds in the order that ties go by, and the patterns. Each pattern finds the same
# spans as without its lookbehind and possessive loops, in time linear in the text.
KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

#: Terms are runs of ASCII letters and digits and of everything beyond ASCII.
_BETWEEN = np.ones(256, bool)
_BETWEEN[48:58] = _BETWEEN[65:91] = _BETWEEN[97:123] = _BETWEEN[128:] = False


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match ends a run of local characters at an ``@``, so the ``@`` is sought first."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, done
        at = text.find("@", done)


def personal_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the personal data in ``text``, sorted; ``kind`` counts in ``KINDS``."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _entity(kind: int, value: str) -> str:
    """One name for all ways to write an entity."""
    return f"{kind}:{value.lower() if kind < 2 else ''.join(c for c in value if c.isdigit())}"


@dataclass
class _Terms:
    """The terms of a batch of texts, in order, with their places in code points."""

    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray


def _terms(texts: pa.Array) -> _Terms:
    w = words(texts, lower=True, separators=_BETWEEN)
    lead = np.r_[0, np.cumsum((w.data & 0xC0) != 0x80)]
    owner = np.repeat(lead[w.bounds[:-1]], np.diff(w.first))
    return _Terms(w.first, lead[w.starts] - owner, lead[w.ends] - owner, w.hashes.view(np.int64))


def _covered(terms: _Terms, k: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Which terms of text ``k`` share a character with one of its spans."""
    a, b = terms.first[k], terms.first[k + 1]
    out = np.zeros(b - a, bool)
    for start, _, end in spans:
        out[np.searchsorted(terms.ends[a:b], start, side="right") : np.searchsorted(terms.starts[a:b], end)] = True
    return out


def _surroundings(docs: DataFrame, window: int) -> DataFrame:
    """``(entity, term, context)``, hashes, once a document: every term within ``window`` terms of
    one of the entity's places, and what all these terms together are. Term 0 stands for the entity."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            terms, out = None, []
            for k, text in enumerate(batch.column("text").to_pylist()):
                spans = personal_spans(text) if text else []
                if not spans:
                    continue
                terms = terms or _terms(batch.column("text"))
                a, b = terms.first[k], terms.first[k + 1]
                free = a + np.flatnonzero(~_covered(terms, k, spans))
                starts, around = terms.starts[free], {}
                for start, kind, end in spans:
                    i, j = np.searchsorted(starts, [start, end])
                    around.setdefault(_entity(kind, text[start:end]), []).append(free[max(0, i - window) : j + window])
                for entity, places in around.items():
                    near = np.unique(terms.hashes[np.concatenate(places)])
                    context = mix64(near.view(np.uint64)).sum(dtype=np.uint64).view(np.int64)
                    out.append((entity, np.r_[0, near], context))
            if out:
                sizes = [len(t) for _, t, _ in out]
                names = pa.array([e for e, _, _ in out]).take(pa.array(np.repeat(np.arange(len(out)), sizes)))
                columns = [names, pa.array(np.concatenate([t for _, t, _ in out])), pa.array(np.repeat([c for *_, c in out], sizes))]
                yield pa.record_batch(columns, ["entity", "term", "context"])

    found = docs.select("text").mapInArrow(gather, "entity string, term long, context long")
    return found.select(F.xxhash64("entity").alias("entity"), "term", "context")


def _document_counts(docs: DataFrame, asked: SortedKeys) -> DataFrame:
    """``(term, n_term)``: documents that hold each of the terms ``asked``."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with mapped_files(asked.paths) as local:
            for batch in chunks(batches):
                terms = _terms(batch.column("text"))
                distinct, number = np.unique(terms.hashes, return_inverse=True)
                wanted = asked.lookup(local, distinct)[number] > 0
                owner = np.repeat(np.arange(batch.num_rows), np.diff(terms.first))[wanted]
                pairs = np.unique(owner * len(distinct) + number[wanted])
                found, n = np.unique(pairs % max(1, len(distinct)), return_counts=True)
                yield pa.record_batch([pa.array(distinct[found]), pa.array(n)], ["term", "n"])

    return docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosing_terms(docs: DataFrame, window: int = 10, support: int = 3, share: float = 0.8) -> DataFrame:
    """Terms of ``docs(text)`` that disclose an entity, as ``(term, number)``: 1 to generalise, 2 to
    remove. A term counts if, with one entity that at most half of the documents hold,

    * it stands within ``window`` terms of it in ``support`` different surroundings or more,
    * it leaves at most one bit: ``2 * n(e, t) >= n(t)`` (to remove: ``10 * n(e, t) >= 9 * n(t)``),
    * it gives at least ``share`` of the entity's information: ``PMI(e, t) >= share * IC(e)``.

    All documents count; null texts hold nothing; no entity, no term.
    """
    seen = _surroundings(docs, window).groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
    pairs = stored(seen.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("n_contexts")), "pii-pairs")
    near = pairs.where((F.col("term") != 0) & (F.col("n_contexts") >= support)).drop("n_contexts")
    entities = pairs.where("term = 0").select("entity", F.col("n_both").alias("n_entity"))
    rows = near.groupBy("entity").agg(F.count("*").alias("n_pairs"))
    near = joined_by_weight(near, entities.join(rows, "entity"), ["entity"], "n_pairs").drop("n_pairs")
    asked = stored(near.groupBy("term").agg(F.count("*").alias("n_pairs")), "pii-asked")
    counts = _document_counts(docs, sorted_keys(asked.select(F.col("term").alias("key"), F.lit(1).alias("number"))))
    near = joined_by_weight(near, stored(counts.join(asked, "term"), "pii-terms"), ["term"], "n_pairs")
    total = F.lit(docs.count()).cast("double")
    pmi = F.log2(F.col("n_both") * total / (F.col("n_entity").cast("double") * F.col("n_term")))
    enough = (2 * F.col("n_both") >= F.col("n_term")) & (2 * F.col("n_entity") <= total)
    number = F.when(10 * F.col("n_both") >= 9 * F.col("n_term"), 2).otherwise(1)
    return near.where(enough & (pmi >= share * F.log2(total / F.col("n_entity")))).groupBy("term").agg(F.max(number).alias("number"))


def _rewritten(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    out, done = [], 0
    for start, kind, end, action in spans:
        if end <= done:
            continue
        if start >= done:
            out.append(text[done:start])
            if kind < 4:
                out.append(f"[{KINDS[kind].upper()}]")
            elif action == "generalise":
                letters, digits = any(c.isalpha() for c in text[start:end]), any(c.isdigit() for c in text[start:end])
                out.append("[code]" if letters and digits else "[number]" if digits else "[word]")
        done = end
    return "".join([*out, text[done:]])


def personal_data(docs: DataFrame, terms: DataFrame | None = None, rewrite: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` with ``spans``, an array of ``kind, start, end, action`` in code points
    sorted by start and kind, and, if ``rewrite``, ``sanitised``: personal data replaced by its
    kind, terms by theirs or by nothing.

    ``terms`` are those of ``disclosing_terms``, by default of ``docs`` itself; they count outside
    personal data, in every document. Null texts have no spans and stay null, null and repeated
    doc_ids and repeated rows stay as they are, very long texts are read whole; other columns are
    left out; an empty table stays empty.
    """
    known = sorted_keys((disclosing_terms(docs) if terms is None else terms).withColumnRenamed("term", "key"))
    actions = ("", "generalise", "remove")

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with mapped_files(known.paths) as local:
            for batch in chunks(batches):
                terms = _terms(batch.column("text"))
                action = known.lookup(local, terms.hashes)
                all_spans, rewritten = [], []
                for k, text in enumerate(batch.column("text").to_pylist()):
                    base = personal_spans(text) if text else []
                    a, b = terms.first[k], terms.first[k + 1]
                    hits = np.flatnonzero(action[a:b])
                    if len(hits) and base:
                        hits = hits[~_covered(terms, k, base)[hits]]
                    spans = [(s, kind, e, "replace") for s, kind, e in base]
                    spans += zip(terms.starts[a + hits].tolist(), [4] * len(hits), terms.ends[a + hits].tolist(), [actions[x] for x in action[a + hits]], strict=True)
                    spans.sort()
                    all_spans.append([{"kind": KINDS[kind], "start": s, "end": e, "action": done} for s, kind, e, done in spans])
                    rewritten.append(_rewritten(text, spans) if rewrite and spans else text)
                columns = [batch.column("doc_id"), pa.array(all_spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("action", pa.string())])))]
                yield pa.record_batch([*columns, pa.array(rewritten, pa.string())][: 2 + rewrite], ["doc_id", "spans", "sanitised"][: 2 + rewrite])

    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long, action: string>>" + ", sanitised string" * rewrite
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, schema)


def personal_data_digests(docs: DataFrame) -> DataFrame:
    """``personal_data`` as ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term``."""

    def named(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "term")
    found = personal_data(docs, rewrite=False)
    return found.select("doc_id", *map(of, KINDS[:4]), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"), of("term"))
